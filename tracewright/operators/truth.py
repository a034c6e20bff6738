"""What a graph expects of each placed turn, and what was observed instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.traces import following_state


def state_facts(uses: DataFrame, returns: DataFrame, steps: DataFrame, terminals: DataFrame) -> DataFrame:
    """``state, tools, outcomes, next_states, terminal``: what the graph says of each state, computed once for all turns.

    ``uses``: ``state, tool``; ``returns``: ``tool, outcome``; ``steps``: ``state, next_state``; ``terminals``: ``state``.
    """
    states = uses.select("state").unionByName(steps.select("state")).unionByName(terminals.select("state")).distinct()
    tools = uses.groupBy("state").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    outcomes = uses.join(returns, "tool").groupBy("state").agg(F.array_sort(F.collect_set("outcome")).alias("outcomes"))
    after = steps.groupBy("state").agg(F.array_sort(F.collect_set("next_state")).alias("next_states"))
    ends = terminals.select("state", F.lit(True).alias("terminal")).distinct()
    none = F.array().cast("array<string>")
    out = states.join(tools, "state", "left").join(outcomes, "state", "left").join(after, "state", "left").join(ends, "state", "left")
    return out.select("state", *[F.coalesce(c, none).alias(c) for c in ("tools", "outcomes", "next_states")], F.coalesce("terminal", F.lit(False)).alias("terminal"))


def findings(placed: DataFrame, observed: DataFrame, facts: DataFrame) -> DataFrame:
    """``conversation_id, turn, finding, detail``: one row for each thing that a turn did against the graph.

    ``placed``: ``conversation_id, turn, states, state, exit_state``; ``observed``: ``conversation_id, turn, tools, outcomes`` (arrays), ``silent``. A turn may use what
    any of its states uses; where it may go and whether it is at an end its exit state says. Outcomes are stray
    only where some are expected, hops are illegal only from states with successors.
    """
    turns = following_state(placed)
    through = turns.select("conversation_id", "turn", F.explode(F.array_distinct("states")).alias("state")).join(facts, "state")
    may = through.groupBy("conversation_id", "turn").agg(F.array_distinct(F.flatten(F.collect_list("tools"))).alias("may_use"), F.array_distinct(F.flatten(F.collect_list("outcomes"))).alias("may_return"))
    ends = facts.select(F.col("state").alias("exit_state"), "next_states", "terminal")
    rows = turns.join(observed, ["conversation_id", "turn"]).join(may, ["conversation_id", "turn"], "left").join(ends, "exit_state", "left")
    known = F.col("may_use").isNotNull()
    hops = (F.col("following") != F.col("exit_state")) & F.col("next_states").isNotNull()
    none = F.array().cast("array<string>")

    def when(condition: Column, values: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), values).otherwise(none)

    def named(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("finding"), v.alias("detail")))

    one = F.array(F.lit(""))
    found = F.flatten(
        F.array(*[
            named(name, values)
            for name, values in (
                ("unplaced", when(F.col("state").isNull(), one)),
                ("undeclared_tool", when(known, F.array_except("tools", "may_use"))),
                ("stray_outcome", when(known & (F.size("may_return") > 0), F.array_except("outcomes", "may_return"))),
                ("illegal_hop", when(hops & (F.size("next_states") > 0) & ~F.array_contains("next_states", F.col("following")), F.array(F.col("following")))),
                ("continues_after_terminal", when(F.col("terminal") & F.col("following").isNotNull(), F.array(F.col("following")))),
                ("silent", when(F.col("silent") & ~F.coalesce("terminal", F.lit(False)) & F.col("state").isNotNull(), one)),
            )
        ])
    )
    return rows.select("conversation_id", "turn", F.explode(found).alias("f")).select("conversation_id", "turn", "f.finding", "f.detail")


def profile_triples(profile: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples that say how entities are named on the wire, and the profile's names that the graph lacks.

    ``profile``: ``entity_type, wire, entity``; ``entities``: ``entity``.
    """
    relation = F.concat(F.lit("EMITTED_AS_"), F.upper("entity_type"))
    known = profile.join(entities.select("entity").distinct(), "entity", "left_semi")
    return known.select(F.col("entity").alias("head"), relation.alias("relation"), F.col("wire").alias("tail")), profile.join(entities, "entity", "left_anti")
