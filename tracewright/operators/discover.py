"""Structure that traces show: what was called, written and returned, as facts of a graph that are known from telemetry alone.

Observations are rows ``conversation_id, seq, kind, name, value, arguments, ref`` (see ``evaluate``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import canonical_name, entity_id
from tracewright.storage import stash


def symbolic(value: Column) -> Column:
    """No number, no truth value and not empty."""
    v = F.lower(F.trim(value))
    return (v != "") & ~v.isin("true", "false") & v.try_cast("double").isNull()


def moves(observations: DataFrame) -> DataFrame:
    """``name, source, target, n``: how often a variable's value was followed by another one in a conversation."""
    order = Window.partitionBy("conversation_id", "name").orderBy("seq")
    writes = observations.filter("kind = 'state_write'").select("name", F.lag("value").over(order).alias("source"), F.col("value").alias("target"))
    return writes.filter("source <> target").groupBy("name", "source", "target").agg(F.count("*").alias("n"))


def values(observations: DataFrame) -> DataFrame:
    """``name, value, n``: the values that each variable had, written or given to a call."""
    given = observations.filter("kind = 'tool_call'").select(F.explode("arguments").alias("a")).select(F.col("a.key").alias("name"), F.col("a.value").alias("value"))
    return observations.filter("kind = 'state_write'").select("name", "value").unionByName(given).groupBy("name", "value").agg(F.count("*").alias("n"))


def observed_facts(observations: DataFrame, use_case: str, checkpoint: str) -> DataFrame:
    """``head_type, head, relation, tail_type, tail, ref``: all that traces say of a use case, each fact once; ``head`` and ``tail`` as they were written.

    States are the values of the variable ``checkpoint``; they follow each other as its writes do, and use the tools that were called while they stood. Everything that no
    state accounts for hangs on the first capability by name (or on the use case, where there is none): tools that were never called in a state, variables, and the states themselves. States
    that nothing led to are where it starts. ``ref`` is where the fact's name was first seen, by conversation and place.
    """
    rows = observations.filter("conversation_id IS NOT NULL")
    named = stash(rows.groupBy("kind", F.when(F.col("kind") == "outcome", F.col("value")).otherwise(F.col("name")).alias("surface")).agg(F.count("*").alias("n")).filter("surface <> ''"), "named")
    seen = rows.filter("name <> ''").groupBy(F.col("name").alias("surface")).agg(F.min(F.struct("conversation_id", "seq", "ref"))["ref"].alias("ref"))
    states = stash(values(rows).filter((F.col("name") == checkpoint) & (F.col("value") != "")).select(F.col("value").alias("state")).distinct(), "states")
    up_to = Window.partitionBy("conversation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    write, call = F.col("kind") == "state_write", F.col("kind") == "tool_call"
    stood = rows.withColumns({"state": F.last(F.when(write & symbolic(F.col("value")), F.col("value")), ignorenulls=True).over(up_to), "last_tool": F.last(F.when(call, F.col("name")), ignorenulls=True).over(up_to)})
    stood = stash(stood.filter(F.col("kind").isin("tool_call", "outcome")).select("kind", "name", "value", "state", "last_tool").distinct(), "stood")
    used = stood.filter("kind = 'tool_call' AND name <> ''").join(states, "state").select("state", F.col("name").alias("tool")).distinct()
    steps = moves(rows).select("source", "target").distinct().join(states.withColumnRenamed("state", "source"), "source").join(states.withColumnRenamed("state", "target"), "target")
    tools = named.filter("kind = 'tool_call'").select(F.col("surface").alias("tool"))
    capabilities = named.filter("kind = 'capability'").select("surface")
    first = capabilities.agg(F.min("surface")).first()[0]
    anchor = ("Capability", first) if first is not None else ("UseCase", use_case)

    def facts(df: DataFrame, head: tuple[str, str | Column], relation: str, tail: tuple[str, str], surface: str) -> DataFrame:
        left = F.lit(head[1]) if isinstance(head[1], str) else head[1]
        return df.select(F.lit(head[0]).alias("head_type"), left.alias("head"), F.lit(relation).alias("relation"), F.lit(tail[0]).alias("tail_type"), F.col(tail[1]).alias("tail"), F.col(surface).alias("surface"))

    parts = [
        facts(capabilities, ("UseCase", use_case), "HAS_CAPABILITY", ("Capability", "surface"), "surface"), facts(steps, ("State", F.col("source")), "HAS_NEXT_STEP", ("State", "target"), "source"),
        facts(states.join(steps.select(F.col("target").alias("state")), "state", "left_anti"), ("UseCase", use_case), "STARTS_AT", ("State", "state"), "state"), facts(used, ("State", F.col("state")), "USES_TOOL", ("Tool", "tool"), "tool"),
        facts(named.filter((F.col("kind") == "state_write") & (F.col("surface") != checkpoint)).select("surface").unionByName(values(rows).filter((F.col("name") != checkpoint) & (F.col("name") != "")).select(F.col("name").alias("surface"))).distinct(), anchor, "HAS_STATE_VARIABLE", ("StateVariable", "surface"), "surface"),
        facts(stood.filter("kind = 'outcome' AND value <> ''").withColumn("tool", F.coalesce(F.nullif("name", F.lit("")), "last_tool")).join(tools, "tool").select("tool", "value").distinct(), ("Tool", F.col("tool")), "RETURNS", ("Outcome", "value"), "value"),
    ]
    if first is not None:
        parts += [facts(states, anchor, "HAS_STATE", ("State", "state"), "state"), facts(tools.join(used, "tool", "left_anti"), anchor, "USES_TOOL", ("Tool", "tool"), "tool")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(seen, "surface", "left").drop("surface")


def apply_observations(entities: DataFrame, triples: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph with observed facts merged in: entities gain the surfaces they were seen under, triples the method ``telemetry``; what the graph had stays.

    ``entities``: ``entity, entity_type, canonical, surfaces``; ``triples``: ``head, relation, tail, methods, status``; ``facts`` as of ``observed_facts``. Names whose canonical form is empty have no identity and are left out.
    """
    ends = facts.select(F.col("head_type").alias("entity_type"), F.col("head").alias("surface")).unionByName(facts.select(F.col("tail_type").alias("entity_type"), F.col("tail").alias("surface"))).distinct()
    ends = stash(ends.withColumn("canonical", canonical_name(F.col("surface"))).withColumn("entity", entity_id(F.col("entity_type"), F.col("canonical"))).filter("entity IS NOT NULL"), "ends")
    known = entities.select("entity", "entity_type", "canonical", F.explode_outer("surfaces").alias("surface"))
    merged = known.unionByName(ends.select("entity", "entity_type", "canonical", "surface")).groupBy("entity", "entity_type", "canonical").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))
    head, tail = (ends.select(F.col("entity_type").alias(f"{e}_type"), F.col("surface").alias(e), F.col("entity").alias(f"{e}_id")) for e in ("head", "tail"))
    new = facts.join(head, ["head_type", "head"]).join(tail, ["tail_type", "tail"]).select(F.col("head_id").alias("head"), "relation", F.col("tail_id").alias("tail"), F.array(F.lit("telemetry")).alias("methods"), F.lit("admitted").alias("status"))
    # A triple that the graph has keeps its status; only its methods grow.
    both = triples.select("head", "relation", "tail", "methods", "status", F.lit(0).alias("order")).unionByName(new.withColumn("order", F.lit(1)))
    grown = both.groupBy("head", "relation", "tail").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("methods")))).alias("methods"), F.min_by("status", "order").alias("status"))
    return merged, grown
