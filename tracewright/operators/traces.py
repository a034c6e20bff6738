"""Observations of conversations: binding to a graph, replayed state, placed turns.

Observations are rows ``conversation_id, seq, turn, kind, token, name, value``: ``seq`` orders a conversation, ``token`` is
what a name in the graph is sought for.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tracewright.functions.text import canonical_name, with_canonical

#: How sure a binding or a placement by each method is.
BINDING_CONFIDENCE = {"declared": 1.0, "lexical": 0.75, "none": 0.0}
PLACEMENT_CONFIDENCE = {"checkpoint": 1.0, "inferred": 0.8, "carried": 0.6, "ambiguous": 0.4, "none": 0.0}

MOST_STATES = 2_000


def bind(observations: DataFrame, declared: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Observations with ``entity`` and ``method``: declared names first, then labels, else none.

    ``declared``: ``entity_type, wire, entity``; the last of several names (by entity) wins. ``lexicon``:
    ``entity_type, label, entity``; the first wins. Keys are canonical names ("Card Check" finds ``card_check``), those that come out
    empty bind nothing, and observations carry the ``entity_type`` they are sought as. Each distinct token is folded once.
    """
    d = with_canonical(declared, "wire", "key").groupBy("entity_type", "key").agg(F.max("entity").alias("by_name")).filter("key <> ''")
    x = with_canonical(lexicon, "label", "key").groupBy("entity_type", "key").agg(F.min("entity").alias("by_label")).filter("key <> ''")
    if observations.isStreaming:  # distinct tokens can't be joined to their own stream
        is_odd = F.col("token").rlike(r"[^\x00-\x7F]")
        keyed = observations.withColumn("key", F.when(is_odd, canonical_name(F.when(is_odd, F.col("token")))).otherwise(canonical_name(F.col("token"), ascii_only=True)))
    else:
        keyed = with_canonical(observations, "token", "key")
    found = keyed.join(d, ["entity_type", "key"], "left").join(x, ["entity_type", "key"], "left")
    method = F.when(F.col("by_name").isNotNull(), "declared").when(F.col("by_label").isNotNull(), "lexical").otherwise("none")
    return found.withColumns({"entity": F.coalesce("by_name", "by_label"), "method": method}).drop("key", "by_name", "by_label")


def confidence(method: Column, table: dict[str, float], alternatives: Column | None = None) -> Column:
    """The method's confidence, shared among the alternatives, to three places."""
    out = F.lit(0.0)
    for name, value in table.items():
        out = F.when(method == name, F.lit(value)).otherwise(out)
    return F.round(out / F.greatest(alternatives, F.lit(1)), 3) if alternatives is not None else out


def coverage(bound: DataFrame, *keys: str) -> DataFrame:
    """Attempted and bound observations, and their share: 1 where nothing was attempted."""
    n, b = F.count("token"), F.count(F.when(F.col("token").isNotNull(), F.col("entity")))
    return bound.groupBy(*keys).agg(n.alias("attempted"), b.alias("bound"), F.coalesce(b / F.nullif(n, F.lit(0)), F.lit(1.0)).alias("coverage"))


def calls(bound: DataFrame) -> DataFrame:
    """``conversation_id, entity, calls, first_seq, last_seq`` of everything bound."""
    return bound.filter("entity IS NOT NULL").groupBy("conversation_id", "entity").agg(F.count("*").alias("calls"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def variables(observations: DataFrame) -> DataFrame:
    """``conversation_id, name, peak, last_value``: the largest number and the last value of each variable; blanks set nothing."""
    written = observations.filter(F.trim("value") != "")
    return written.groupBy("conversation_id", "name").agg(F.max(F.col("value").try_cast("bigint")).alias("peak"), F.max_by("value", "seq").alias("last_value"))


def standing_state(observations: DataFrame, state: Column) -> DataFrame:
    """Observations with ``standing``: the last state written up to them in their conversation."""
    order = Window.partitionBy("conversation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return observations.withColumn("standing", F.last(state, ignorenulls=True).over(order))


def visited(writes: DataFrame) -> DataFrame:
    """``conversation_id, turn, states``: the states that a turn wrote, in order, each once for a run of the same.

    ``writes``: ``conversation_id, turn, seq, state``.
    """
    order = Window.partitionBy("conversation_id", "turn").orderBy("seq")
    changed = writes.filter("state IS NOT NULL").withColumn("before", F.lag("state").over(order)).filter(~F.col("before").eqNullSafe(F.col("state")))
    listed = changed.groupBy("conversation_id", "turn").agg(F.array_sort(F.collect_list(F.struct("seq", "state"))).alias("w"))
    return listed.select("conversation_id", "turn", F.transform("w", lambda x: x["state"]).alias("states"))


def place_one(visits: list[str] | None, candidates: list[str] | None, before: str | None, reach: dict[str, set[str]]) -> tuple[list[str], list[str], str]:
    """States, alternatives and method of one turn (see ``place_turns``), ``before`` which stood the state ``before``."""
    some = sorted({c for c in candidates or () if c is not None})
    near = [c for c in some if c in reach.get(before, {before})] if before is not None else []
    some = near or some
    if visits:
        return visits, [], "checkpoint"
    if len(some) == 1:
        return some, [], "inferred"
    if some:
        return some[:1], some, "ambiguous"
    return ([before], [], "carried") if before is not None else ([], [], "none")


def reach_of(successors: DataFrame) -> dict[str, set[str]]:
    """Of each state, itself and the states that follow it. ``successors``: ``state, reach`` (array), a catalogue of the graph, whose size is checked."""
    found = successors.select("state", "reach").limit(MOST_STATES + 1).collect()
    if len(found) > MOST_STATES:
        raise ValueError(f"a graph may have {MOST_STATES} states at most")
    return {r["state"]: {r["state"], *(r["reach"] or ())} for r in found}


def place_turns(turns: DataFrame, successors: DataFrame) -> DataFrame:
    """``conversation_id, turn, states, alternatives, method, state, exit_state, confidence`` of every turn.

    ``turns``: ``conversation_id, turn, visits, candidates`` (arrays: the states that the turn wrote to its checkpoint, in order, and
    those that its tools and outcomes allow). Visits place a turn, in all of them. Else candidates that the previous turn's exit
    state reaches (or it itself) are preferred: one is inferred; of several, the first by name counts, all are ``alternatives``, and they share the confidence.
    Else the previous exit state is carried; without one there is none. ``state`` is where a turn began, ``exit_state`` where it ended.
    ``successors``: ``state, reach`` (array), a catalogue of the graph. As each turn depends on the one before, the turns of a conversation are
    sorted within a partition and folded as they pass; the previous state is all that is kept.
    """
    reach = reach_of(successors)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, before = None, None
        for batch in batches:
            out = []
            for name, visits, candidates in zip(*(batch.column(c).to_pylist() for c in ("conversation_id", "visits", "candidates")), strict=True):
                if run is None or name != run[0]:
                    run, before = (name,), None
                row = place_one(visits, candidates, before, reach)
                before = row[0][-1] if row[0] else before
                out.append(row)
            texts = pa.list_(pa.string())
            columns = [pa.array([r[0] for r in out], texts), pa.array([r[1] for r in out], texts), pa.array([r[2] for r in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("conversation_id"), batch.column("turn"), *columns], ["conversation_id", "turn", "states", "alternatives", "method"])

    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}
    ordered = turns.select("conversation_id", "turn", "visits", "candidates").repartition("conversation_id").sortWithinPartitions("conversation_id", "turn")
    placed = ordered.mapInArrow(fold, f"conversation_id {kinds['conversation_id']}, turn {kinds['turn']}, states array<string>, alternatives array<string>, method string")
    placed = placed.withColumns({"state": F.try_element_at("states", F.lit(1)), "exit_state": F.try_element_at("states", F.lit(-1))})
    return placed.withColumn("confidence", confidence(F.col("method"), PLACEMENT_CONFIDENCE, F.size("alternatives")))


def look_ahead(partition: WindowSpec, order: str, value: Column) -> Column:
    """The first value behind a row that isn't null. Rows are taken from the end, so each adds one step to the frame, however many follow it."""
    return F.last(value, ignorenulls=True).over(partition.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1))


def following_state(placed: DataFrame) -> DataFrame:
    """Turns with ``following``: the next turn's first state that there is."""
    return placed.withColumn("following", look_ahead(Window.partitionBy("conversation_id"), "turn", F.col("state")))


def hops(placed: DataFrame) -> DataFrame:
    """``conversation_id, turn, source, target``: changes of state within a turn, and from its exit state to the next placed turn."""
    rows = following_state(placed).withColumn("way", F.when(F.col("following").isNull(), F.col("states")).otherwise(F.concat("states", F.array("following"))))
    pairs = F.transform("way", lambda x, k: F.struct(F.get("way", k - 1).alias("source"), x.alias("target")))
    moved = rows.select("conversation_id", "turn", F.explode(F.slice(pairs, 2, F.greatest(F.size("way"), F.lit(1)))).alias("h")).select("conversation_id", "turn", "h.source", "h.target")
    return moved.filter("source <> target")


def transitions(observations: DataFrame, value: str) -> DataFrame:
    """``source, target, n``: how often a value follows a different one in a conversation."""
    order = Window.partitionBy("conversation_id").orderBy("seq")
    moved = observations.select(F.lag(value).over(order).alias("source"), F.col(value).alias("target")).filter("source <> target")
    return moved.groupBy("source", "target").agg(F.count("*").alias("n"))


def checkpoint_candidates(writes: DataFrame) -> DataFrame:
    """``name, n_values, rank``: variables whose values are all symbols, most values first.

    A symbol is no number, no truth value and not empty. Ranks are counted over the distinct numbers of values, of which there are
    few: names with the same one are ranked apart from others.
    """
    v = F.lower(F.trim("value"))
    symbol = (v != "") & ~v.isin("true", "false") & v.try_cast("double").isNull()
    found = writes.groupBy("name").agg(F.bool_and(symbol).alias("symbolic"), F.count_distinct("value").alias("n_values")).filter("symbolic")
    # How many names have more values: a running sum over one row for each number of values, of which there are few.
    sizes = found.groupBy("n_values").agg(F.count("*").alias("n"))
    larger = Window.orderBy(F.desc("n_values")).rowsBetween(Window.unboundedPreceding, -1)
    more = sizes.select("n_values", F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("n_values").orderBy("name"))
    return found.join(more, "n_values").select("name", "n_values", (F.col("before") + own).alias("rank"))


def discovered_triples(moves: DataFrame, state_tools: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``head, relation, tail, n``: what was observed, as facts that are known from traces only.

    ``moves``: ``source, target, n``; ``state_tools``: ``state, tool, n``; ``outcomes``: ``tool, outcome, n``.
    """
    parts = [(moves, "source", "HAS_NEXT_STEP", "target"), (state_tools, "state", "USES_TOOL", "tool"), (outcomes, "tool", "RETURNS", "outcome")]
    rows = [df.select(F.col(head).alias("head"), F.lit(relation).alias("relation"), F.col(tail).alias("tail"), "n") for df, head, relation, tail in parts]
    found = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return found.groupBy("head", "relation", "tail").agg(F.sum("n").alias("n"))
