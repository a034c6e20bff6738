"""Triples to a graph: merging, the witness bar, conflicts and their resolution, integrity, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import SEPARATOR, digest, folded

KEY = ("head", "relation", "tail")
LIVE = ("admitted", "review")


def merge(triples: DataFrame) -> DataFrame:
    """One row for each ``head, relation, tail``: distinct spans and methods, the higher materiality, the first tail kind and status.

    ``triples``: key, ``seq, passage_id, start, stop, method, materiality, tail_kind, status``.
    """
    spans = F.array_sort(F.collect_set(F.struct("passage_id", "start", "stop")))
    high = F.bool_or(F.col("materiality") == "high")
    return triples.groupBy(*KEY).agg(
        spans.alias("spans"), F.array_sort(F.collect_set("method")).alias("methods"), F.when(high, "high").otherwise("normal").alias("materiality"),
        F.min_by("tail_kind", "seq").alias("tail_kind"), F.min_by("status", "seq").alias("status"),
    )


def witness_bar(merged: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status after review: an answer decides; else a weighty fact from one method and one passage waits.

    ``decisions``: key, ``answer`` (``approve``, ``reject``). Only admitted triples change.
    """
    return barred(merged.join(decisions, list(KEY), "left"))


def barred(answered: DataFrame) -> DataFrame:
    """Triples with the status that ``witness_bar`` gives them, of such as have their ``answer``, or null, already."""
    passages = F.size(F.array_distinct(F.transform("spans", lambda s: s["passage_id"])))
    weak = (F.col("materiality") == "high") & (F.array_join("methods", ",") == "model") & (passages <= 1)
    status = F.when(F.col("status") != "admitted", F.col("status")).when(F.col("answer") == "reject", "rejected").when(F.col("answer") == "approve", "admitted").when(weak, "review").otherwise(F.col("status"))
    return answered.withColumn("status", status).drop("answer")


def cardinality_conflicts(triples: DataFrame, single: list[str]) -> DataFrame:
    """``head, relation, n_tails`` where a relation that allows one tail has several."""
    return triples.filter(F.col("relation").isin(*single)).groupBy("head", "relation").agg(F.count_distinct("tail").alias("n_tails")).filter("n_tails > 1")


def terminal_conflicts(triples: DataFrame, terminal: str, succession: str) -> DataFrame:
    """Heads that are terminal and yet go on."""
    ends = triples.filter((F.col("relation") == terminal) & (F.lower(F.trim("tail")) == "true")).select("head").distinct()
    return ends.join(triples.filter(F.col("relation") == succession), "head", "left_semi")


def deontic_conflicts(triples: DataFrame, requires: str, forbids: str) -> DataFrame:
    """``tail, n_requiring, n_forbidding``: what is both required and forbidden."""
    sides = triples.filter(F.col("relation").isin(requires, forbids)).groupBy("tail").agg(F.count_distinct(F.when(F.col("relation") == requires, F.col("head"))).alias("n_requiring"), F.count_distinct(F.when(F.col("relation") == forbids, F.col("head"))).alias("n_forbidding"))
    return sides.filter("n_requiring > 0 AND n_forbidding > 0")


def resolve_by_date(sides: DataFrame) -> DataFrame:
    """Sides of conflicts with ``status``: if each has one date and one is latest, the others are superseded; else all conflict.

    ``sides``: ``conflict_id, side, dates`` (array of ISO date strings).
    """
    dated = sides.withColumns({"valid": (F.size("dates") == 1) & (F.element_at("dates", 1) != ""), "date": F.try_element_at("dates", F.lit(1))})
    per = dated.groupBy("conflict_id").agg(F.bool_and("valid").alias("all_valid"), F.max("date").alias("latest"))
    rows = dated.join(per, "conflict_id")
    first = rows.filter(F.col("date") == F.col("latest")).groupBy("conflict_id").agg(F.count("*").alias("n_latest"))
    rows = rows.join(first, "conflict_id", "left")
    won = F.col("all_valid") & (F.col("n_latest") == 1)
    return rows.select("conflict_id", "side", F.when(~won | won.isNull(), "conflicted").when(F.col("date") == F.col("latest"), "admitted").otherwise("superseded").alias("status"))


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key ``have`` lacks: the integrity checks' common shape."""
    return wanted.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")


def top_evidence(rows: DataFrame, group: list[str], order: list[str], most: int = 4) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= most)


def undeclared_relations(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """``relation, n``: relations that triples have and the schema lacks."""
    return triples.groupBy("relation").agg(F.count("*").alias("n")).join(relations.select(F.col("name").alias("relation")), "relation", "left_anti")


def unchecked_relations(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """``relation, n``: relations of live triples that the schema declares with neither a check nor a word that there can be none, so that nothing verifies them.

    ``relations``: ``name, kind`` (of the check, else null)``, not_checkable``. Relations that the schema lacks are another matter (``undeclared_relations``).
    """
    silent = relations.filter(F.col("kind").isNull() & ~F.coalesce("not_checkable", F.lit(False))).select(F.col("name").alias("relation")).distinct()
    return triples.filter(F.col("status").isin(*LIVE)).groupBy("relation").agg(F.count("*").alias("n")).join(silent, "relation", "left_semi")


def review_questions(triples: DataFrame, quotes: DataFrame) -> DataFrame:
    """``question_id, kind, heading, evidence_key``: one question for each triple that is held for review.

    ``quotes``: ``head, relation, tail, quote``. The key names the text that an answer is about: its folded quotes in order.
    """
    held = triples.filter("status = 'review'").select(*KEY)
    evidence = held.join(quotes, list(KEY), "left").groupBy(*KEY).agg(F.array_sort(F.collect_list(folded(F.col("quote")))).alias("q"))
    return evidence.select(digest([F.lit("review"), *[F.col(c) for c in KEY]], 12).alias("question_id"), F.lit("review").alias("kind"), F.concat_ws(" ", *KEY).alias("heading"), digest([F.array_join("q", SEPARATOR)], 12).alias("evidence_key"))


def resolved_decisions(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (``question_id, evidence_key, answer``) that were answered and whose question is asked no more: they are kept."""
    return decisions.filter("answer <> ''").join(questions.select("question_id"), "question_id", "left_anti")


def touching(triples: DataFrame) -> DataFrame:
    """``entity, n_out, n_in`` over live triples: how many leave and reach each entity."""
    live = triples.filter(F.col("status").isin(*LIVE))
    ends = live.select(F.col("head").alias("entity"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(live.filter("tail_kind = 'entity'").select(F.col("tail").alias("entity"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("entity").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def review_queue(questions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Questions with ``answer`` where one holds, ``previous_answer`` where its evidence has changed, and ``outstanding``.

    ``questions``: ``question_id, evidence_key``; ``decisions``: ``question_id, evidence_key, answer``.
    """
    d = decisions.select("question_id", F.col("evidence_key").alias("old_key"), F.col("answer").alias("given"))
    rows = questions.join(d, "question_id", "left")
    holds = F.col("old_key") == F.col("evidence_key")
    return rows.select("question_id", F.when(holds, F.col("given")).alias("answer"), F.when(~holds, F.col("given")).alias("previous_answer"), (~F.coalesce(holds, F.lit(False))).alias("outstanding"))
