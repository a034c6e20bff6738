"""What traces show, as facts, merged into a graph."""

from pyspark.sql import functions as F

from tracewright.functions.text import entity_id
from tracewright.operators import discover

KIND = "conversation_id string, seq long, kind string, name string, value string, ref string, arguments array<struct<key: string, value: string>>"
ROWS = [
    ("a", 1, "tool_call", "Early", "OK", "a1", [("level", "2")]), ("a", 2, "state_write", "place", "Start", "a2", None), ("a", 3, "tool_call", "look", "OK", "a3", None), ("a", 4, "outcome", "", "SEEN", "a4", None),
    ("a", 5, "state_write", "tries", "7", "a5", None), ("a", 6, "state_write", "place", "End", "a6", None), ("a", 7, "tool_call", "Early", "OK", "a7", None), ("a", 8, "outcome", "unheard", "LOST", "a8", None),
    ("b", 1, "tool_call", "apart", "OK", "b1", []), ("b", 2, "state_write", "place", "", "b2", None), (None, 1, "tool_call", "nobody's", "OK", None, None),
]


def found(df):
    return {(r["head"], r["relation"], r["tail"], r["ref"]) for r in df.collect()}


def test_facts_without_a_capability(spark):
    got = found(discover.observed_facts(spark.createDataFrame(ROWS, KIND), "Case", "place"))
    assert got == {
        ("Start", "HAS_NEXT_STEP", "End", None), ("Case", "STARTS_AT", "Start", None), ("Start", "USES_TOOL", "look", "a3"), ("End", "USES_TOOL", "Early", "a1"), ("look", "RETURNS", "SEEN", None),
        ("Case", "HAS_STATE_VARIABLE", "tries", "a5"), ("Case", "HAS_STATE_VARIABLE", "level", None),
    }


def test_what_no_state_accounts_for_hangs_on_the_first_capability(spark):
    rows = ROWS + [("b", 3, "capability", "Beta", "", "b3", None), ("b", 4, "capability", "Alpha", "", "b4", None)]
    got = found(discover.observed_facts(spark.createDataFrame(rows, KIND), "Case", "place"))
    assert {("Case", "HAS_CAPABILITY", "Alpha", "b4"), ("Alpha", "USES_TOOL", "apart", "b1"), ("Alpha", "HAS_STATE", "Start", None), ("Alpha", "HAS_STATE_VARIABLE", "tries", "a5")} <= got
    assert ("Alpha", "USES_TOOL", "look", "a3") not in got and len(got) == 7 + 2 + 1 + 2
    assert discover.observed_facts(spark.createDataFrame([], KIND), "Case", "place").count() == 0


def test_observed_facts_are_merged_and_keep_what_the_graph_had(spark):
    facts = spark.createDataFrame([("State", "Start", "USES_TOOL", "Tool", "look!", None), ("State", "start", "USES_TOOL", "Tool", "Look", None), ("State", "…", "USES_TOOL", "Tool", "look", None)], "head_type string, head string, relation string, tail_type string, tail string, ref string")
    ids = spark.range(1).select(entity_id(F.lit("State"), F.lit("start")).alias("s"), entity_id(F.lit("Tool"), F.lit("look")).alias("t")).first()
    entities = spark.createDataFrame([(ids["s"], "State", "start", ["START"]), ("Rule:1", "Rule", "r", None)], "entity string, entity_type string, canonical string, surfaces array<string>")
    triples = spark.createDataFrame([(ids["s"], "USES_TOOL", ids["t"], ["llm"], "review"), ("Rule:1", "RULE_STATES", "x", ["llm"], "rejected")], "head string, relation string, tail string, methods array<string>, status string")
    merged, grown = discover.apply_observations(entities, triples, facts)
    assert {(r["entity"], tuple(r["surfaces"])) for r in merged.collect()} == {(ids["s"], ("START", "Start", "start")), (ids["t"], ("Look", "look", "look!")), ("Rule:1", ())}
    assert {(r["head"], r["tail"], tuple(r["methods"]), r["status"]) for r in grown.collect()} == {(ids["s"], ids["t"], ("llm", "telemetry"), "review"), ("Rule:1", "x", ("llm",), "rejected")}
