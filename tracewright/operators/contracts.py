"""Triples of checked relations to assertions, and assertions to contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import digest


#: Severities that a rule may declare.
SEVERITIES = ("blocker", "error", "warning", "info")


def compile_assertions(triples: DataFrame, rules: DataFrame, declared: DataFrame, conditions: DataFrame, boolean: Sequence[str] = ("IS_TERMINAL",)) -> DataFrame:
    """``assertion_id, kind, subject, expected, scope, dimension, provisional, severity, level``.

    ``triples``: ``head, relation, tail, methods, materiality, status``; ``rules``: ``relation, kind, dimension, scope, grouping`` (``per_triple``, ``per_head`` or ``all``, which
    is for relations of few heads); ``declared``: ``head, severity``; ``conditions``: ``head`` of what has a condition.
    Rejected triples assert nothing, nor does the false tail of a ``boolean`` relation. An assertion is provisional, and then advisory, while one of its triples waits for
    review or if all were only observed in traces; else the severity that its first head declares holds (an unknown one is a warning), else weighty facts give errors, and others warnings.
    Conditions make level L3; facts that rules found without a model, each of them at least also so, L1; others are L2.
    """
    says = ~F.col("relation").isin(*boolean) | (F.lower(F.trim("tail")) == "true")
    level = F.lower(F.trim("severity"))
    own = declared.groupBy("head").agg(F.min(F.when(level.isin(*SEVERITIES), level).otherwise("warning")).alias("own"))
    # Rules are a catalogue and relations are few: dealt by relation, each one's facts would be one task's.
    rows = triples.filter(F.col("status").isin("admitted", "review") & says).join(F.broadcast(rules), "relation").join(own, "head", "left")
    group = F.when(F.col("grouping") == "per_triple", F.concat_ws("\x1f", "head", "tail")).when(F.col("grouping") == "per_head", F.col("head")).otherwise(F.lit(""))
    subject = F.when(F.col("grouping") == "all", F.lit("journey")).otherwise(F.col("head"))
    made = rows.withColumns({"part": group, "subject": subject}).groupBy("relation", "kind", "dimension", "scope", "part", "subject").agg(
        F.array_sort(F.collect_set(F.when(F.col("grouping") == "all", F.col("head")).otherwise(F.col("tail")))).alias("expected"),
        (F.bool_or(F.col("status") == "review") | F.bool_and(F.array_join("methods", "|") == "telemetry")).alias("provisional"),
        F.bool_or(F.col("materiality") == "high").alias("high"), F.bool_and(F.array_contains("methods", "deterministic")).alias("plain"), F.min_by("own", F.when(F.col("own").isNotNull(), F.col("head"))).alias("own"),
    )
    made = made.join(conditions.select(F.col("head").alias("subject"), F.lit(True).alias("conditional")).distinct(), "subject", "left")
    severity = F.when(F.col("provisional"), "advisory").when(F.col("own").isNotNull(), F.col("own")).when(F.col("high"), "error").otherwise("warning")
    return made.select(
        digest([F.col("kind"), F.col("subject"), F.array_join("expected", "\x1f")], 12).alias("assertion_id"), "kind", "subject", "expected", "scope", "dimension", "provisional",
        severity.alias("severity"), F.when(F.col("conditional"), "L3").when(F.col("plain"), "L1").otherwise("L2").alias("level"),
    )


def narrow(assertions: DataFrame, scopes: DataFrame) -> DataFrame:
    """``binding_id, assertion_id``: the assertions of each contract whose subject or expectation is in its scope.

    ``scopes``: ``binding_id, entity``. Those about the whole journey belong to every contract; they come once, with a null
    ``binding_id``, so that there are no rows for each contract with each of them.
    """
    whole = assertions.filter("scope = 'journey'").select(F.lit(None).cast(scopes.schema["binding_id"].dataType).alias("binding_id"), "assertion_id")
    about = assertions.filter("scope <> 'journey'").select("assertion_id", F.explode(F.array_union(F.array("subject"), "expected")).alias("entity")).join(scopes, "entity").select("binding_id", "assertion_id")
    return whole.unionByName(about).distinct()
