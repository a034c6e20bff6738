"""Evaluation of traces: contracts, placements and findings of small conversations, in batch and as a stream."""

import time

import pytest
from pyspark.sql import functions as F

from tracewright.operators import evaluate as E
from tracewright.operators import grading, journeys, traces
from tracewright.plans import evaluation
from tracewright.streaming import live, truths

OBSERVATIONS = "conversation_id string, seq long, turn long, kind string, name string, value string, arguments array<struct<key: string, value: string>>"
ROWS = [
    ("x", 1, 0, "state_write", "checkPoint", "Start", None), ("x", 2, 0, "tool_call", "view", "OK", [("attempts", "3"), ("other", "")]), ("x", 3, 0, "outcome", "view", "ERROR", None),
    ("x", 4, 1, "state_write", "checkpoint", "payment", None), ("x", 5, 1, "assistant", "assistant", "Thank  YOU for number 7!", None), ("x", 6, 1, "tool_call", "click", "OK", []), ("x", 7, 1, "outcome", "click", "PURCHASE", None),
    ("x", 8, 2, "utterance", "user", "hello", None), ("x", 9, 2, "silence", "", "no tool call", None), ("x", 10, 3, "state_write", "checkpoint", "done", None), ("x", 11, 3, "state_write", "attempts", "97", None),
    ("y", 1, 0, "tool_call", "unheard of", "OK", None), ("y", 2, 1, "tool_call", "click", None, None), ("y", 3, 2, "tool_call", "view", None, None), ("y", 4, 2, "tool_call", "click", None, None),
    ("z", 1, 5, "utterance", "user", None, None), (None, 1, 0, "tool_call", "view", None, None),
]


@pytest.fixture(scope="module")
def shop(spark):
    triples, entities, assertions = evaluation.graph(spark)
    rows = spark.createDataFrame(ROWS, OBSERVATIONS).withColumn("ref", F.concat("conversation_id", "seq")).repartition(3)
    bound = traces.bind(E.sought(rows, "checkpoint"), *E.names(triples, entities)).cache()
    index, facts = E.inverse_index(triples, entities), E.state_facts(triples)
    return bound, E.place(bound, index, facts).cache(), index, facts, triples, entities, assertions


def test_writes_are_sought_twice_and_arguments_as_variables(shop):
    found = {(r["seq"], r["kind"], r["entity_type"]): r["entity"] for r in shop[0].filter("conversation_id = 'x'").collect()}
    assert found[1, "state_write", "StateVariable"] is None and found[1, "state_write", "State"] == "State:start"
    assert found[2, "tool_call", "Tool"] == "Tool:view" and found[2, "argument", "StateVariable"] in ("StateVariable:tries", None)
    assert found[11, "state_write", "StateVariable"] == "StateVariable:tries" and (11, "state_write", "State") not in found
    assert found[5, "assistant", None] is None


def test_turns_are_placed_by_what_they_wrote_did_and_what_came_before(shop):
    placed = {(r["conversation_id"], r["turn"]): (r["states"], r["method"], r["alternatives"]) for r in shop[1].collect()}
    assert placed["x", 0] == (["State:start"], "checkpoint", []) and placed["x", 2] == (["State:payment"], "carried", [])
    assert placed["y", 0] == ([], "none", []) and placed["y", 1] == (["State:basket"], "ambiguous", ["State:basket", "State:payment"])
    # Nothing uses both, so any state that uses one counts; of these, basket and payment follow the basket.
    assert placed["y", 2][1:] == ("ambiguous", ["State:basket", "State:payment"])
    assert placed["z", 5][1] == "none" and len(placed) == 8


def test_verdicts_of_all_kinds(shop):
    bound, _, _, _, triples, entities, assertions = shop
    got = {(r["conversation_id"], r["assertion_id"]): r["outcome"] for r in E.verdicts(E.trace_contracts(bound, assertions), assertions, bound, triples, entities).collect()}
    x = {a: o for (c, a), o in got.items() if c == "x"}
    assert x == {
        "a01": "pass", "a02": "fail", "a03": "pass", "a04": "pass", "a05": "not_applicable", "a06": "pass", "a07": "pass", "a08": "fail", "a09": "pass", "a10": "pass", "a11": "undecided", "a12": "pass", "a14": "pass", "a15": "undecided",
    }
    y = {a: o for (c, a), o in got.items() if c == "y"}
    assert y["a01"] == "pass" and y["a03"] == "not_applicable" and y["a06"] == "undecided" and y["a07"] == "fail" and "a04" not in y
    assert {a for c, a in got if c == "z"} == {"a06", "a07", "a10", "a11", "a12"}


def test_turns_that_the_agent_did_not_place_are_only_advised(shop):
    bound, placed, _, facts, _, _, assertions = shop
    rows = E.turn_contracts(placed, facts, assertions).collect()
    sure = {r["assertion_id"] for r in rows if (r["conversation_id"], r["turn"]) == ("x", 1)}
    assert {"a02", "a03", "a05", "a14"} <= sure and "a08" not in sure
    assert {r["severity"] for r in rows if r["conversation_id"] == "y"} == {"advisory"} and not [r for r in rows if r["conversation_id"] == "z"]
    assert all(r["certain"] == ((r["conversation_id"], r["turn"]) in (("x", 0), ("x", 1), ("x", 3))) for r in rows)


def test_findings_of_turns(shop):
    bound, placed, _, facts, *_ = shop
    got = {(r["conversation_id"], r["turn"], r["finding"], r["detail"]) for r in E.findings(placed, bound, facts).collect()}
    assert {g for g in got if g[0] == "x"} == {("x", 0, "illegal_hop", "State:start>State:payment"), ("x", 2, "missing_text", "thank you for  Number 7"), ("x", 2, "silent", "")}
    assert ("y", 0, "unplaced", "") in got and ("y", 2, "undeclared_tool", "Tool:view") in got and ("z", 5, "unplaced", "") in got


def test_one_row_for_each_conversation(shop):
    bound, placed, _, _, triples, entities, assertions = shop
    graded = E.verdicts(E.trace_contracts(bound, assertions), assertions, bound, triples, entities)
    got = {r["conversation_id"]: r for r in E.evaluate(graded, bound, placed).collect()}
    assert (got["x"]["turns"], got["x"]["placed"], got["x"]["certain"], got["x"]["blocked"]) == (4, 4, 3, True)
    assert got["y"]["unbound"] == ["unheard of"] and got["y"]["coverage"] == 0.75 and got["z"]["coverage"] == 1.0


def test_an_index_follows_the_changes_of_its_graph(spark, shop):
    triples, entities = shop[4:6]
    changes = [("State:start", "OFFERS_DECISION", "Decision:pay", 1), ("Decision:pay", "HAS_OUTCOME", "Outcome:failed", -1), ("Decision:pay", "HAS_OUTCOME", "Outcome:odd", 1), ("State:payment", "USES_TOOL", "Tool:click", -1), ("Tool:view", "USES_TOOL", "Tool:view", 1)]
    merged = E.merge_index(shop[2], triples, spark.createDataFrame(changes, "head string, relation string, tail string, change int"), entities)
    after = [(h, r, t) for h, r, t in evaluation.TRIPLES if (h, r, t, -1) not in changes] + [c[:3] for c in changes if c[3] > 0]
    whole = E.inverse_index(spark.createDataFrame(after, "head string, relation string, tail string"), entities)
    pairs = lambda df: {(r["entity"], r["state"]) for r in df.collect()}
    assert pairs(merged) == pairs(whole) == {("Tool:view", "State:start"), ("Tool:click", "State:basket"), *((o, s) for o in ("Outcome:paid", "Outcome:odd") for s in ("State:start", "State:payment"))}


def test_nothing_observed_gives_nothing(spark, shop):
    bound, placed, index, facts, triples, entities, assertions = shop
    none = bound.limit(0)
    assert E.place(none, index, facts).count() == 0 and E.findings(placed.limit(0), none, facts).count() == 0
    assert E.verdicts(E.trace_contracts(none, assertions), assertions, none, triples, entities).count() == 0 and E.turn_contracts(placed.limit(0), facts, assertions).count() == 0
    assert E.state_facts(triples.limit(0)).count() == 0


def test_a_stream_ends_where_the_batch_does(spark, shop, tmp_path):
    bound, placed, index, facts, triples, _, assertions = shop
    rows = bound.filter("conversation_id IS NOT NULL").select("conversation_id", "turn", "seq", "entity_type", "entity")
    # Turns of x come in several files, with another conversation between them.
    cuts = ["conversation_id = 'x' AND seq < 2", "conversation_id = 'x' AND seq BETWEEN 2 AND 3", "conversation_id = 'y'", "conversation_id = 'x' AND seq BETWEEN 4 AND 6", "conversation_id = 'x' AND seq > 6", "conversation_id = 'z'"]
    for cut in cuts:
        rows.filter(cut).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        time.sleep(1.1)  # files are taken in order of their times
    stream = live.read_stream(spark, str(tmp_path / "rows"), files_per_batch=1)
    got = {(r["conversation_id"], r["turn"]): r for r in truths.live_truths(stream, triples, index, assertions).collect()}
    want = {(r["conversation_id"], r["turn"]): r for r in placed.filter("conversation_id IS NOT NULL").collect()}
    assert {k: (r["states"], r["method"]) for k, r in got.items()} == {k: (r["states"], r["method"]) for k, r in want.items()}
    contracts: dict = {}
    for r in E.turn_contracts(placed, facts, assertions).collect():
        contracts.setdefault((r["conversation_id"], r["turn"]), []).append(r["assertion_id"])
    assert {k: r["assertions"] for k, r in got.items() if r["assertions"]} == {k: sorted(v) for k, v in contracts.items() if k[0] is not None}
    assert got["x", 0]["closed"] and got["x", 2]["closed"] and not got["x", 3]["closed"]


def test_the_dispatch_knows_ten_kinds_however_many_others_there_are(spark):
    evidence = spark.createDataFrame([("c", 1, "T", "Tool", "n"), ("c", 2, "T", "Tool", "n"), ("c", 3, "U", "Tool", "m"), ("c", 4, "O", "Outcome", "n")], "conversation_id string, seq long, entity string, entity_type string, name string")
    kinds = [(f"odd {k}", "T", ["x"]) for k in range(3000)] + [("count_limit", "T", ["one"]), ("text_required", "W", ["Say  it"]), ("tool_called", "S", ["T"]), ("outcome_allowed", "T", ["O"]), ("outcome_allowed", "U", ["O"])]
    assertions = spark.createDataFrame(kinds, "kind string, subject string, expected array<string>")
    none = spark.createDataFrame([], "action string, tool string")
    said = spark.createDataFrame([("c", "assistant", "please say it now")], "conversation_id string, role string, text string")
    few = assertions.filter("NOT kind LIKE 'odd%' OR kind = 'odd 7'")
    got = {(r["kind"], r["subject"]): r["outcome"] for r in grading.grade(few, evidence, spark.createDataFrame([("T",)], "tool string"), none, utterances=said).collect()}
    assert got == {("count_limit", "T"): "fail", ("text_required", "W"): "pass", ("tool_called", "S"): "pass", ("outcome_allowed", "T"): "pass", ("outcome_allowed", "U"): "not_applicable", ("odd 7", "T"): "undecided"}
    assert grading.grade(assertions, evidence, none.select("tool"), none).filter("kind = 'tool_called'").count() == 1


def test_looking_ahead_is_linear(spark):
    rows = spark.range(300_000).select(F.lit(1).alias("conversation_id"), F.col("id").alias("turn"), F.when(F.col("id") % 1000 == 999, F.col("id").cast("string")).alias("state"))
    began = time.time()
    found = traces.following_state(rows)
    assert found.filter("turn = 5").first()["following"] == "999" and found.filter("turn = 299999").first()["following"] is None
    assert found.filter("following IS NULL").count() == 1
    assert time.time() - began < 60  # some 2,000 seconds if each row looked through all behind it
    assert "unboundedpreceding$(), -1" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_paths_that_die_use_no_budget(spark):
    step = "state string, decision string, outcome string, next_state string"
    edges = spark.createDataFrame([(a, "", "", b) for a, b in ("SA", "SB", "AA")], step)
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "state string")
    limits = spark.createDataFrame([("A", 1)], "state string, n int")
    got = journeys.enumerate_paths(edges, one("S"), one("S").limit(0), limits, max_paths=1).collect()
    assert [(r["path"], r["truncated"]) for r in got] == [(["S", "B"], True)]
    wide = spark.createDataFrame([("S", "", "", f"M{k}") for k in range(9)] + [(f"M{k}", "", "", "S") for k in range(8)] + [("M8", "", "", "T")], step)
    got = journeys.enumerate_paths(wide, one("S"), one("T"), spark.createDataFrame([("S", 1)], "state string, n int"), max_paths=2).collect()
    assert [(r["path"], r["complete"], r["truncated"]) for r in got] == [(["S", "M8", "T"], True, False)]
