"""Operators on small tables: edges that the queries' tables don't have."""

import re

import pytest
from pyspark.sql import functions as F

from tracewright.functions import payloads, text
from tracewright.operators import admission, catalogues, contracts, corpus, design, grading, journeys, reconcile, traces


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_canonical_names_fold_accents_and_may_be_empty(spark):
    df = spark.createDataFrame([("Crème  Brûlée!",), ("__A-b__",), ("日本",), (None,)], "s string")
    rows = [r[0] for r in df.select(text.canonical_name(F.col("s"))).collect()]
    assert rows == ["creme_brulee", "a_b", "", None]
    named = df.select(text.entity_id(F.lit("T"), text.canonical_name(F.col("s"))).alias("i")).collect()
    assert [r["i"] is None for r in named] == [False, False, True, True]


def test_numbers_and_values(spark):
    df = spark.createDataFrame([("three",), (" 12 ",), ("1_0",), ("many",), (None,)], "s string")
    assert [r[0] for r in df.select(text.as_number(F.col("s"))).collect()] == [3, 12, None, None, None]
    df = spark.createDataFrame([(" 3 business days ",), ("two glass",), ("x Days",), ("2.5 hours",), ("3 --",), ("7",), (None,)], "s string")
    assert [r[0] for r in df.select(text.canonical_value(F.col("s"))).collect()] == ["3_day", "two_glass", "x_days", "2_5_hour", "3", "7", None]


def test_batches_restart_after_a_long_block(spark):
    blocks = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([5, 5, 20, 3, 3])], "doc_id long, block_no int, text string")
    assert values(corpus.greedy_batches(blocks, 10), "batch_no", "n_blocks", "n_chars") == [(0, 2, 10), (1, 1, 20), (2, 2, 6)]


def test_quotes_are_located_inside_texts_only(spark):
    quotes = spark.createDataFrame([(1, "b c d e f"), (2, "b c x e f"), (3, "short one")], "item_id long, quote string")
    texts = spark.createDataFrame([(7, "a b c d e f g"), (8, "ab c d e fg"), (9, None), (10, "")], "doc_id long, text string")
    assert values(corpus.locate_quotes(quotes, texts), "item_id", "doc_id", "start") == [(1, 7, 2), (1, 8, 1)]


def test_short_quotes_and_texts_without_spaces_are_located(spark):
    quotes = spark.createDataFrame([(1, "short one"), (2, "本日は晴天なり、明日も"), (3, "a short"), (4, "b c d e f g"), (5, " tiny   "), (6, "😀 and 日本語")], "item_id long, quote string")
    texts = spark.createDataFrame([(7, "this is a short one, again a short one"), (8, "天気:本日は晴天なり、明日も晴れ"), (9, "a b c d e f g"), (10, None), (11, "a tiny   x"), (12, "see 😀😀 and 日本語.")], "doc_id long, text string")
    assert values(corpus.locate_quotes(quotes, texts), "item_id", "doc_id", "start") == [(1, 7, 10), (2, 8, 3), (4, 9, 2), (6, 12, 5)]


def test_payload_outcomes(spark):
    df = spark.createDataFrame([('{"status": "OK_1"}',), ('{"b": {"result": "LATE"}, "a": {"x": 1}}',), ('{"status": "ok"}',), ("{'a': 1}",), (None,)], "p string")
    assert [r[0] for r in df.select(payloads.symbolic_outcome(F.col("p"))).collect()] == ["OK_1", "LATE", None, None, None]
    df = spark.createDataFrame([('{"policy_input": ["v", "7"]}',), ('{"policy_input": ["v"]}',), ("x",)], "p string")
    assert [r[0] and tuple(r[0]) for r in df.select(payloads.state_write(F.col("p"))).collect()] == [("v", "7"), None, None]


def test_first_failing_criterion_counts(spark):
    relations = spark.createDataFrame([("SAYS", ["A"], [], "str", [], "positive")], "name string, domain array<string>, range array<string>, literal_type string, enum array<string>, polarity string")
    rows = [("h", "A", "SAYS", "five", None, 1, "it says five times"), ("h", "B", "SAYS", "", None, 9, "x"), ("h", "A", "SAYS", " ", None, 9, "x"), ("h", "A", "SAYS", "five", None, 9, "x"), ("h", "A", "SAYS", "six", None, 1, "it says five times"), ("h", "A", "SAYS", "five", None, 2, "it must not say five"), ("h", "A", "SAYS", "5", None, 1, "it says five times")]
    candidates = spark.createDataFrame(rows, "head string, head_type string, relation string, tail string, tail_type string, passage_id long, quote string")
    passages = spark.createDataFrame([(1, "And it says  five times."), (2, "But it must not say five.")], "passage_id long, text string")
    found = admission.admit(candidates, relations, passages)
    assert sorted(str(r["criterion"]) for r in found.collect()) == ["None", "None", "citation", "empty", "polarity", "schema", "value"]


def test_latest_date_wins_unless_tied(spark):
    sides = spark.createDataFrame([(1, "a", ["2020"]), (1, "b", ["2021"]), (2, "a", ["2020"]), (2, "b", ["2020"]), (3, "a", ["2020", "2021"]), (3, "b", ["2019"])], "conflict_id int, side string, dates array<string>")
    got = values(reconcile.resolve_by_date(sides), "conflict_id", "side", "status")
    assert [x[2] for x in got] == ["superseded", "admitted", "conflicted", "conflicted", "conflicted", "conflicted"]


def graph(spark, *edges):
    rows = [(a, *(rest or ("", "")), b) for a, b, *rest in edges]  # a step has neither decision nor outcome
    return spark.createDataFrame(rows, "state string, decision string, outcome string, next_state string")


def named(spark, *states):
    return spark.createDataFrame([(s,) for s in states], "state string")


def test_paths_respect_visits_and_depth(spark):
    edges = graph(spark, ("a", "b"), ("b", "a"), ("b", "c", "d1", "yes"))
    none = spark.createDataFrame([], "state string, n int")
    found = journeys.enumerate_paths(edges, named(spark, "a"), named(spark, "c"), none, default_limit=2, max_depth=6)
    assert values(found.select(F.array_join("path", "").alias("p"), "complete", "truncated"), "p", "complete", "truncated") == [("ababc", True, False), ("abc", True, False)]
    assert [tuple(x) for x in found.filter("depth = 2").first()["steps"]] == [("", "", "b"), ("d1", "yes", "c")]
    short = journeys.enumerate_paths(edges, named(spark, "a"), named(spark, "c"), none, max_depth=1)
    assert values(short, "path", "complete", "truncated") == [(["a", "b"], False, True)]
    assert journeys.enumerate_paths(edges, named(spark).limit(0), named(spark, "c"), none).count() == 0


def test_a_budget_keeps_the_first_paths_and_gaps_get_their_own(spark):
    edges = graph(spark, *[("s", f"m{k}") for k in range(6)], *[(f"m{k}", "t") for k in range(6)], ("lost", "t"))
    none = spark.createDataFrame([], "state string, n int")
    paths = journeys.enumerate_paths(edges, named(spark, "s"), named(spark, "t"), none, max_paths=2)
    assert values(paths, "path", "truncated") == [(["s", "m0", "t"], True), (["s", "m1", "t"], True)]
    gaps = {(r["state"], r["next_state"]): r["steps"] and "".join(x["next_state"] for x in r["steps"]) for r in journeys.edge_gaps(edges, paths, named(spark, "s")).collect()}
    assert gaps == {**{("s", f"m{k}"): f"m{k}" for k in range(2, 6)}, **{(f"m{k}", "t"): f"m{k}t" for k in range(2, 6)}, ("lost", "t"): None}
    assert values(journeys.unreachable_states(edges, paths), "state") == [("lost",), ("m2",), ("m3",), ("m4",), ("m5",)]


def test_layers_take_the_longest_way_forward(spark):
    edges = graph(spark, ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "d"), ("d", "d"))
    assert values(journeys.layers(edges, named(spark, "a")), "state", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_a_threshold_bounds_the_states_that_offer_its_decision(spark):
    edges = graph(spark, ("retry", "ask", "again", "yes"), ("ask", "retry", "other", "no"), ("end", "end"))
    heads = spark.createDataFrame([("again", "v3"), ("retry", "v5"), ("other", "v0"), ("gone", "v3"), ("end", "vx")], "head string, value string")
    literals = spark.createDataFrame([("v3", "three"), ("v5", "5"), ("v0", "0"), ("vx", "many")], "value string, literal string")
    assert values(journeys.revisit_limits(heads, literals, edges), "state", "n") == [("retry", 3)]


def test_placement_carries_and_prefers_what_is_near(spark):
    rows = [(1, 0, None, []), (1, 1, ["t", "s"], ["y"]), (1, 2, None, ["x", "y"]), (1, 3, None, []), (1, 4, None, ["p", "q", None]), (2, 0, None, ["y", "x"]), (None, 0, None, None)]
    turns = spark.createDataFrame(rows, "conversation_id int, turn int, visits array<string>, candidates array<string>")
    reach = spark.createDataFrame([("s", ["x"]), ("t", ["y"])], "state string, reach array<string>")
    got = traces.place_turns(turns, reach)
    assert values(got, "conversation_id", "turn", "method", "state", "exit_state", "confidence") == [
        (1, 0, "none", None, None, 0.0), (1, 1, "checkpoint", "t", "s", 1.0), (1, 2, "inferred", "x", "x", 0.8), (1, 3, "carried", "x", "x", 0.6), (1, 4, "ambiguous", "p", "p", 0.2), (2, 0, "ambiguous", "x", "x", 0.2), (None, 0, "none", None, None, 0.0),
    ]
    assert values(traces.hops(got), "turn", "source", "target") == [(1, "s", "x"), (1, "t", "s"), (3, "x", "p")]
    assert traces.place_turns(turns.limit(0), reach).count() == 0


def test_states_are_visited_once_for_a_run(spark):
    writes = spark.createDataFrame([(1, 0, 3, "b"), (1, 0, 1, "a"), (1, 0, 2, "a"), (1, 0, 4, None), (1, 0, 5, "a"), (1, 1, 6, "a")], "conversation_id int, turn int, seq int, state string")
    assert values(traces.visited(writes), "turn", "states") == [(0, ["a", "b", "a"]), (1, ["a"])]


def test_names_bind_as_they_are_folded(spark):
    seen = spark.createDataFrame([("Tool", "Card Check"), ("Tool", "Réglage"), ("Tool", "日本"), ("State", "card_check"), ("Tool", None)], "entity_type string, token string")
    declared = spark.createDataFrame([("Tool", "card_check", "T1"), ("Tool", "!", "T9")], "entity_type string, wire string, entity string")
    lexicon = spark.createDataFrame([("Tool", "reglage", "T2"), ("Tool", "CARD check", "T3")], "entity_type string, label string, entity string")
    assert values(traces.bind(seen, declared, lexicon), "entity_type", "token", "entity", "method") == [("State", "card_check", None, "none"), ("Tool", "Card Check", "T1", "declared"), ("Tool", "Réglage", "T2", "lexical"), ("Tool", "日本", None, "none"), ("Tool", None, None, "none")]


def test_batches_end_where_a_section_does(spark):
    rows = [(1, 0, "x" * 3, "a"), (1, 1, "x" * 3, "b"), (1, 2, "x" * 2, "b"), (1, 3, "x", "c"), (2, 0, "", None)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_no int, text string, section string")
    got = corpus.batch_context(corpus.greedy_batches(blocks, 100, min_chars=5))
    assert values(got, "doc_id", "batch_no", "n_chars", "first_block", "last_block", "before", "after") == [(1, 0, 8, 0, 2, None, 3), (1, 1, 1, 3, 3, 2, None), (2, 0, 0, 0, 0, None, None)]


def test_limits_and_modals(spark):
    docs = spark.createDataFrame([(1, "Make at most three login attempts, and No More Than 12 calls. See 4 boxes within reach; within 5 days."), (2, "up to many things"), (3, None)], "doc_id int, text string")
    assert values(corpus.limits(docs), "doc_id", "place", "name", "number", "quote") == [(1, 0, "3 login attempts", 3, "at most three login attempts"), (1, 1, "12 calls", 12, "No More Than 12 calls"), (1, 2, "5 days", 5, "within 5 days")]
    said = spark.createDataFrame([("You MUST NOT go.",), ("You must go.",), ("You ought not go.",), ("You should.",), ("One may.",), ("Musty.",)], "s string")
    assert [r[0] for r in said.select(corpus.modal_severity(F.col("s"))).collect()] == ["error", "error", "warning", "warning", "info", None]


def test_folded_quotes_are_located_in_the_source(spark):
    quotes = spark.createDataFrame([(1, "it's  “Fine” – really"), (2, "now then"), (3, "not here at all"), (4, " \t      ")], "item_id int, quote string")
    texts = spark.createDataFrame([(7, "  Well,\nIT’S\n\n\"fine\" -  really so. Now\tthen."), (8, ""), (9, None)], "doc_id int, text string")
    got = {r["item_id"]: r for r in corpus.locate_spans(quotes, texts).collect()}
    source = texts.filter("doc_id = 7").first()["text"]
    assert {k: source[r["start"] : r["end"]] for k, r in got.items()} == {1: "IT’S\n\n\"fine\" -  really", 2: "Now\tthen"} and not got[1]["exact"]


def test_denials_of_every_form(spark):
    said = ["You must never go.", "It is prohibited to go.", "They do not go.", "Don't go.", "Going is forbidden.", "Please refrain.", "You will not go.", "All notes go."]
    got = spark.createDataFrame([(x,) for x in said], "s string").select(F.col("s").rlike(admission.MODAL_DENIAL), F.col("s").rlike(admission.ANY_DENIAL)).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, True), (True, True), (False, True), (True, True), (False, True), (False, True), (False, False)]


def test_python_literals_are_payloads(spark):
    df = spark.createDataFrame([("{'b': True, 'a': None, 'c': {'d': [1, 'x']}}",), ('{"a": 1}',), ("None",), ("nothing {",), (None,)], "p string")
    got = [r[0] and [tuple(x) for x in r[0]] for r in df.select(payloads.arguments(payloads.as_json(F.col("p")))).collect()]
    assert got == [[("a", ""), ("b", "true"), ("c", '{"d":[1,"x"]}')], [("a", "1")], None, None, None]


def test_unbound_outcomes_and_spelled_limits(spark):
    evidence = spark.createDataFrame([(1, 1, "T", "Tool"), (1, 2, None, "Outcome"), (2, 1, "T", "Tool"), (2, 2, "O", "Outcome")], "conversation_id int, seq int, entity string, entity_type string")
    claims = spark.createDataFrame([("T", ["O"])], "subject string, expected array<string>")
    assert values(grading.outcome_allowed(claims, evidence), "conversation_id", "outcome") == [(1, "fail"), (2, "pass")]
    limits = spark.createDataFrame([("T", "One", "k"), ("O", "several", "k")], "subject string, limit_text string, variable string")
    peaks = spark.createDataFrame([(2, "k", 2)], "conversation_id int, name string, peak long")
    assert values(grading.count_limit(limits, evidence, peaks), "conversation_id", "subject", "outcome") == [(1, "O", "undecided"), (1, "T", "pass"), (2, "O", "undecided"), (2, "T", "fail")]


def test_levels_and_severities_of_assertions(spark):
    facts = [("a", "R", "x", ["deterministic", "model"], "normal", "admitted"), ("b", "R", "x", ["model"], "high", "admitted"), ("c", "R", "x", ["telemetry"], "high", "admitted"), ("d", "R", "x", ["deterministic"], "high", "review"), ("e", "R", "x", ["model"], "high", "admitted"), ("f", "R", "x", ["model"], "normal", "rejected"), ("g", "IS_TERMINAL", "false", ["model"], "high", "admitted"), ("h", "IS_TERMINAL", "True ", ["model"], "high", "admitted")]
    triples = spark.createDataFrame(facts, "head string, relation string, tail string, methods array<string>, materiality string, status string")
    rules = spark.createDataFrame([("R", "tool_called", "tool", "state", "per_head"), ("IS_TERMINAL", "terminal_expected", "outcome", "journey", "all")], "relation string, kind string, dimension string, scope string, grouping string")
    own, with_condition = spark.createDataFrame([("e", "Info"), ("b", "dire")], "head string, severity string"), spark.createDataFrame([("b",)], "head string")
    got = contracts.compile_assertions(triples, rules, own, with_condition)
    assert values(got, "subject", "expected", "severity", "level") == [("a", ["x"], "warning", "L1"), ("b", ["x"], "warning", "L3"), ("c", ["x"], "advisory", "L2"), ("d", ["x"], "advisory", "L1"), ("e", ["x"], "info", "L2"), ("journey", ["h"], "error", "L2")]


def test_facts_are_not_dealt_by_their_few_relations(spark):
    triples = spark.createDataFrame([("a", "R", "x", ["model"], "high", "admitted")], "head string, relation string, tail string, methods array<string>, materiality string, status string")
    rules = spark.createDataFrame([("R", "tool_called", "tool", "state", "per_head")], "relation string, kind string, dimension string, scope string, grouping string")
    made = contracts.compile_assertions(triples, rules, spark.createDataFrame([("a", "info")], "head string, severity string"), spark.createDataFrame([("b",)], "head string"))
    assert not re.search(r"hashpartitioning\(relation#\d+, \d+\)", made._jdf.queryExecution().executedPlan().toString())
    assert values(made, "subject", "severity", "level") == [("a", "info", "L2")]


def test_answers_hold_for_all_that_a_head_says(spark):
    kind = "head string, relation string, tail string, spans array<struct<passage_id: int>>, methods array<string>, materiality string, status string"
    rows = [(h, "R", t, [(1,)], ["model"], "high", s) for h, t, s in (("a", "x", "admitted"), ("a", "y", "rejected"), ("b", "x", "admitted"), ("c", "x", "admitted"))]
    merged, answers = spark.createDataFrame(rows, kind), spark.createDataFrame([("a", "approve"), ("b", "reject")], "head string, answer string")
    want = [("a", "x", "admitted"), ("a", "y", "rejected"), ("b", "x", "rejected"), ("c", "x", "review")]
    assert values(reconcile.barred(merged.join(answers, "head", "left")), "head", "tail", "status") == want
    each = merged.select("head", "relation", "tail").join(answers, "head")
    assert values(reconcile.witness_bar(merged, each), "head", "tail", "status") == want


def last_plan(df):
    """The plan that ran last, after ``collect``."""
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_only_names_beyond_ascii_go_through_python(spark):
    names = ["3 Crème  brûlées", "7.5 Big  Boxes", "Ünits", "plain name", "", None, "7.5 Big  Boxes"]
    rows = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, k int")
    for fold in (text.canonical_name, text.canonical_value):
        got = text.with_canonical(rows, "name", "key", fold)
        assert values(got, "k", "key") == values(rows.select("k", fold(F.col("name")).alias("key")), "k", "key")
    plain = text.with_canonical(rows.filter("k IN (1, 3, 4, 5)"), "name", "key", text.canonical_value)
    assert len(plain.collect()) == 4 and "Python" not in last_plan(plain)


def test_a_graph_of_plain_names_is_bound_without_python(spark):
    seen = spark.createDataFrame([("Tool", "Card Check"), ("Tool", "scan"), ("Tool", "x"), ("State", "scan")], "entity_type string, token string")
    declared, lexicon = spark.createDataFrame([("Tool", "card_check", "T:1")], "entity_type string, wire string, entity string"), spark.createDataFrame([("Tool", "Scan!", "T:2")], "entity_type string, label string, entity string")
    bound = traces.bind(seen, declared, lexicon)
    assert values(bound, "entity_type", "token", "entity", "method") == [("State", "scan", None, "none"), ("Tool", "Card Check", "T:1", "declared"), ("Tool", "scan", "T:2", "lexical"), ("Tool", "x", None, "none")]
    assert "Python" not in last_plan(bound)
    odd = traces.bind(seen.replace("scan", "scän"), declared, lexicon.replace("Scan!", "SCÄN"))
    assert values(odd.filter("entity_type = 'Tool'"), "token", "entity") == [("Card Check", "T:1"), ("scän", "T:2"), ("x", None)]


def test_covering_rows_cover_all_pairs():
    factors = {"a": ["1", "2", "3"], "b": ["1", "2"], "c": ["1", "2", "3"], "d": ["1", "2"]}
    rows = design.covering_rows(factors)
    names = list(factors)
    for i, p in enumerate(names):
        for q in names[i + 1 :]:
            assert {(r[p], r[q]) for r in rows} == {(x, y) for x in factors[p] for y in factors[q]}
    assert len(rows) < 36


def test_a_large_catalogue_is_refused(spark):
    with pytest.raises(ValueError, match="at most"):
        catalogues.pair_with(spark.range(1), spark.range(20).toDF("x"), most=10)


def test_contracts_have_any_number_of_journey_assertions(spark):
    assertions = spark.range(6_000).select(F.col("id").cast("string").alias("assertion_id"), F.lit("journey").alias("scope"), F.lit("s").alias("subject"), F.array(F.lit("e")).alias("expected"))
    scopes = spark.createDataFrame([(1, "e"), (2, "x")], "binding_id int, entity string")
    assert values(contracts.narrow(assertions, scopes).groupBy("binding_id").count(), "binding_id", "count") == [(None, 6_000)]
    near = assertions.withColumn("scope", F.lit("state"))
    assert values(contracts.narrow(near, scopes).groupBy("binding_id").count(), "binding_id", "count") == [(1, 6_000)]


def test_graders_on_no_evidence(spark):
    evidence = spark.createDataFrame([], "conversation_id long, seq long, entity string, entity_type string")
    claims = spark.createDataFrame([("a", ["b"])], "subject string, expected array<string>")
    for grade in (grading.tool_called, grading.terminal_expected, grading.order_expected, grading.transition_allowed):
        assert grade(claims, evidence).count() == 0


def test_actions_are_observed_by_what_they_invoke(spark):
    claims = spark.createDataFrame([("a", ["T1", "A1"]), ("b", ["A2"]), ("c", [])], "subject string, expected array<string>")
    tools, invokes = spark.createDataFrame([("T1",), ("T2",), ("T3",)], "tool string"), spark.createDataFrame([("A1", "T2"), ("A1", "T3"), ("T1", "T3")], "action string, tool string")
    assert values(grading.observable(claims, tools, invokes), "subject", "expected") == [("a", ["T1", "T2", "T3"]), ("b", []), ("c", [])]


def test_kinds_without_a_grader_are_undecided(spark):
    evidence = spark.createDataFrame([(1, 1, "T1", "Tool"), (2, 1, None, "Tool")], "conversation_id int, seq int, entity string, entity_type string")
    claims = spark.createDataFrame([("tool_called", "s", ["T1"]), ("odd", "s", ["T1"])], "kind string, subject string, expected array<string>")
    none = spark.createDataFrame([], "tool string"), spark.createDataFrame([], "action string, tool string")
    assert values(grading.grade(claims, evidence, *none), "conversation_id", "kind", "outcome") == [(1, "odd", "undecided"), (1, "tool_called", "pass"), (2, "odd", "undecided"), (2, "tool_called", "fail")]


def test_batches_are_rendered_with_their_context(spark):
    blocks = spark.createDataFrame([(1, 0, "aa"), (1, 2, "bb"), (1, 3, "cc"), (2, 0, "dd")], "doc_id int, block_no int, text string").withColumn("location", F.concat(F.lit("#"), "block_no"))
    got = corpus.render_batches(blocks, corpus.greedy_batches(blocks, 4))
    assert values(got, "doc_id", "batch_no", "core", "rendered") == [(1, 0, 2, "[P1] (#0)\naa\n\n[P2] (#2)\nbb\n\n[P3] (#3)\ncc"), (1, 1, 1, "[P1] (#2)\nbb\n\n[P2] (#3)\ncc"), (2, 0, 1, "[P1] (#0)\ndd")]


def test_outcomes_are_found_depth_first_and_only_in_objects(spark):
    rows = ['{"a": {"x": {"status": "DEEP"}, "status": "no"}, "b": {"status": "LATER"}}', '{"s": "{\\"status\\": \\"TEXT\\"}"}', '{"status": 200, "r": [{"status": "LISTED"}]}', '{"z": {"q": 1}, "a": {"action": "GO", "match": "M_1"}}', "[1]", '{"result": "FIRST", "status": "SECOND"}']
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "p string").select(payloads.symbolic_outcome(F.col("p"))).collect()]
    assert got == ["DEEP", None, None, "M_1", None, "SECOND"]


def test_arguments_have_sorted_keys_inside(spark):
    got = spark.createDataFrame([('{"b": {"y": 1, "x": [{"d": 1.0, "c": null}]}, "a": 1.50, "c": null, "d": "{x"}',)], "p string").select(payloads.arguments(F.col("p"))).first()[0]
    assert [tuple(x) for x in got] == [("a", "1.5"), ("b", '{"x":[{"c":null,"d":1}],"y":1}'), ("c", ""), ("d", "{x")]


def test_folded_texts_keep_their_places():
    rows = ["  Well,\nIT’S\n\n\"fine\" -  really ", "", " \t\n", "ΑΣ İx  y", "日本 “x” z", "a"]
    for text_ in rows:
        f = text.Folded(text_)
        assert len(f.text) == len(f.places) and "  " not in f.text and f.text == f.text.strip()
        for c, k in zip(f.text, f.places, strict=True):
            assert c == " " if text_[k].isspace() else c in (text_[k].lower(), text.Folded(text_[k]).text, text_[k])
    assert text.Folded("x  IT’S\n ok").span(text.Folded("it's ok")) == (3, 11) and text.Folded("").span(text.Folded("a")) is None
