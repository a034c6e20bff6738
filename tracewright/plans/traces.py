"""Queries over observations made of ``events``: a user is a conversation, a day a turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import folded
from tracewright.operators import grading as G
from tracewright.operators import traces as X
from tracewright.operators import truth
from tracewright.storage import stash, table

#: The profile: wire names declared for entities, and labels that the graph's entities have.
DECLARED = [("Tool", " VIEW!", "Tool:browse"), ("Outcome", "purchase", "Outcome:paid"), ("State", "signup", "State:member")]
LEXICON = [("Tool", "Click", "Tool:select"), ("State", "SIGNUP", "State:by_label")]
LIMITS = [("Tool:browse", "15", "k"), ("Tool:select", "70", "none"), ("Outcome:paid", "Seven", "none"), ("State:member", "several", "none"), ("Tool:absent", "3", "none")]
#: What is graded: subjects and what is expected of them.
TOOL_CALLS = [("State:member", ["Tool:browse", "Tool:select"]), ("State:lost", ["Tool:absent"])]
REQUIRED_ACTIONS = [("Rule:buy", ["Outcome:paid"]), ("Rule:none", []), ("Rule:both", ["Outcome:paid", "State:member"])]
FORBIDDEN_ACTIONS = [("Rule:join", ["State:member"]), ("Rule:none", []), ("Rule:leave", ["Tool:absent"])]
ALLOWED_MOVES = [("signup", ["purchase"]), ("error", ["error", "signup"])]
ENDINGS = [("journey", ["purchase", "signup"])]
#: States stand for kinds of events where a query needs many of them.
STATES = ("click", "error", "purchase", "signup", "view")


def observations(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    sought = F.when(kind.isin("view", "click"), "Tool").when(kind.isin("purchase", "error"), "Outcome").otherwise("State")
    return table(spark, d, "events").select(
        F.col("user_id").alias("conversation_id"), F.col("event_id").alias("seq"), F.date_diff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("turn"),
        sought.alias("entity_type"), kind.alias("token"), F.lit("k").alias("name"), F.get_json_object("props", "$.k").alias("value"),
    )


def bound(spark: SparkSession, d: str) -> DataFrame:
    declared = spark.createDataFrame(DECLARED, "entity_type string, wire string, entity string")
    lexicon = spark.createDataFrame(LEXICON, "entity_type string, label string, entity string")
    return X.bind(observations(spark, d), declared, lexicon)


def assertions(spark: SparkSession, rows: list[tuple[str, list[str]]]) -> DataFrame:
    return spark.createDataFrame(rows, "subject string, expected array<string>")


def bind_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d)
    return rows.select("conversation_id", "seq", "entity", "method", X.confidence(F.col("method"), X.BINDING_CONFIDENCE).alias("confidence"))


def binding_coverage(spark: SparkSession, d: str) -> DataFrame:
    return X.coverage(bound(spark, d), "conversation_id").withColumn("coverage", F.round("coverage", 6))


def unbound_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = bound(spark, d).filter("entity IS NULL AND token IS NOT NULL")
    return rows.groupBy("conversation_id").agg(F.array_join(F.array_sort(F.collect_set("token")), "|").alias("tokens"))


def runtime_calls(spark: SparkSession, d: str) -> DataFrame:
    return X.calls(bound(spark, d))


def runtime_variables(spark: SparkSession, d: str) -> DataFrame:
    return X.variables(observations(spark, d))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return bound(spark, d).select("conversation_id", "seq", "entity", "entity_type")


def many_states(spark: SparkSession, d: str) -> DataFrame:
    """Evidence in which purchases, errors and sign-ups are states, views tools and clicks outcomes."""
    kind = F.when(F.col("token") == "view", "Tool").when(F.col("token") == "click", "Outcome").otherwise("State")
    return observations(spark, d).select("conversation_id", "seq", F.col("token").alias("entity"), kind.alias("entity_type"))


def grade_count_limit(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.createDataFrame(LIMITS, "subject string, limit_text string, variable string")
    return G.count_limit(limits, evidence(spark, d), X.variables(observations(spark, d)))


def count_limit_summary(spark: SparkSession, d: str) -> DataFrame:
    return grade_count_limit(spark, d).groupBy("subject", "outcome").agg(F.count("*").alias("n"))


def grade_tool_called(spark: SparkSession, d: str) -> DataFrame:
    return G.tool_called(assertions(spark, TOOL_CALLS), evidence(spark, d))


def grade_action_required(spark: SparkSession, d: str) -> DataFrame:
    return G.action_required(assertions(spark, REQUIRED_ACTIONS), evidence(spark, d))


def grade_action_forbidden(spark: SparkSession, d: str) -> DataFrame:
    return G.action_forbidden(assertions(spark, FORBIDDEN_ACTIONS), evidence(spark, d))


def grade_outcome_allowed(spark: SparkSession, d: str) -> DataFrame:
    return G.outcome_allowed(assertions(spark, [("Tool:browse", ["Outcome:paid"]), ("Tool:select", ["Outcome:failed"]), ("Tool:absent", ["Outcome:paid"])]), evidence(spark, d))


def grade_transition_expected(spark: SparkSession, d: str) -> DataFrame:
    return G.transition_expected(assertions(spark, [("click", ["purchase"]), ("view", ["error", "signup"])]), many_states(spark, d))


def grade_transition_allowed(spark: SparkSession, d: str) -> DataFrame:
    return G.transition_allowed(assertions(spark, ALLOWED_MOVES), many_states(spark, d))


def grade_terminal_expected(spark: SparkSession, d: str) -> DataFrame:
    return G.terminal_expected(assertions(spark, ENDINGS), many_states(spark, d))


def grade_order_expected(spark: SparkSession, d: str) -> DataFrame:
    return G.order_expected(assertions(spark, [("view", ["purchase"]), ("signup", ["error"]), ("absent", ["view"])]), many_states(spark, d))


def grade_text_required(spark: SparkSession, d: str) -> DataFrame:
    texts = spark.createDataFrame([("Turn:hello", "the"), ("Turn:of", " of  the "), ("Turn:none", "no such text")], "subject string, text string")
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), "role", "text")
    return G.text_required(texts, said, folded)


def all_verdicts(spark: SparkSession, d: str) -> DataFrame:
    # Five graders read two kinds of evidence, each of which is bound and written once.
    seen, many = stash(evidence(spark, d), "evidence"), stash(many_states(spark, d), "evidence")
    parts = [(G.tool_called, TOOL_CALLS, seen, "tool", "error"), (G.action_required, REQUIRED_ACTIONS, seen, "policy", "blocker"), (G.action_forbidden, FORBIDDEN_ACTIONS, seen, "policy", "warning"), (G.transition_allowed, ALLOWED_MOVES, many, "trajectory", "error"), (G.terminal_expected, ENDINGS, many, "outcome", "warning")]
    out = None
    for grader, rows, known, dimension, severity in parts:
        rows = grader(assertions(spark, rows), known).select("conversation_id", "outcome", F.lit(dimension).alias("dimension"), F.lit(severity).alias("severity"))
        out = rows if out is None else out.unionByName(rows)
    return out


def kinds_of_assertions(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assertions of several kinds, tools, and what actions invoke."""
    rows = [
        ("tool_called", "State:member", ["Tool:browse"]), ("order_expected", "Tool:browse", ["Outcome:paid"]), ("terminal_expected", "journey", ["State:member"]), ("action_required", "Rule:act", ["Action:look", "Tool:select"]),
        ("action_forbidden", "Rule:rest", ["Action:wish"]), ("action_forbidden", "Rule:stop", ["Action:look", "Action:wish"]), ("mood_expected", "Rule:smile", ["Mood:good"]),
    ]
    return spark.createDataFrame(rows, "kind string, subject string, expected array<string>"), spark.createDataFrame([("Tool:browse",), ("Tool:select",)], "tool string"), spark.createDataFrame([("Action:look", "Tool:browse")], "action string, tool string")


def grade_kinds(spark: SparkSession, d: str) -> DataFrame:
    return G.grade(*(lambda a, t, i: (a, evidence(spark, d), t, i))(*kinds_of_assertions(spark)))


def observable_targets(spark: SparkSession, d: str) -> DataFrame:
    """What of each assertion traces can show, and how often users' events do."""
    found = G.observable(*kinds_of_assertions(spark)).select("kind", "subject", F.explode_outer("expected").alias("target"))
    calls = evidence(spark, d).groupBy(F.col("entity").alias("target")).agg(F.count("*").alias("n"))
    return found.join(calls, "target", "left").groupBy("kind", "subject").agg(F.count("target").alias("targets"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def failures_ranked(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("kind") == "order_expected", "blocker").when(F.col("kind") == "terminal_expected", "advisory").otherwise("warning")
    return G.failures(grade_kinds(spark, d).withColumn("severity", severity)).select("conversation_id", "kind", "subject", F.col("place").cast("bigint").alias("place"))


def discover_triples(spark: SparkSession, d: str) -> DataFrame:
    """Moves between kinds of events, tools after each outcome, and outcomes after each tool, as facts."""
    rows = observations(spark, d)
    after_outcome = X.standing_state(rows, F.when(F.col("entity_type") == "Outcome", F.col("token"))).filter("entity_type = 'Tool' AND standing IS NOT NULL").groupBy(F.col("standing").alias("state"), F.col("token").alias("tool")).agg(F.count("*").alias("n"))
    after_tool = X.standing_state(rows, F.when(F.col("entity_type") == "Tool", F.col("token"))).filter("entity_type = 'Outcome' AND standing IS NOT NULL").groupBy(F.col("standing").alias("tool"), F.col("token").alias("outcome")).agg(F.count("*").alias("n"))
    return X.discovered_triples(X.transitions(rows, "token"), after_outcome, after_tool)


def verdict_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.summary(all_verdicts(spark, d))


def hop_counts(spark: SparkSession, d: str) -> DataFrame:
    """All changes of state, within days and between them."""
    return X.hops(placed(spark, d)).groupBy("source", "target").agg(F.count("*").alias("n"))


def discover_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Which tools an outcome came from: the last one before it."""
    rows = X.standing_state(observations(spark, d), F.when(F.col("entity_type") == "Tool", F.col("token"))).filter("entity_type = 'Outcome'")
    return rows.groupBy("token").agg(F.array_join(F.array_sort(F.collect_set("standing")), "|").alias("tools"), F.count("standing").alias("n"))


def dimension_matrix(spark: SparkSession, d: str) -> DataFrame:
    return G.summary(all_verdicts(spark, d), "dimension")


def blocked_runs(spark: SparkSession, d: str) -> DataFrame:
    return G.blocked(all_verdicts(spark, d))


def turn_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Days as turns: sign-ups, and views with an even number, write a state; purchases and errors allow states."""
    t, rows = F.col("token"), observations(spark, d)
    writes = rows.filter((t == "signup") | (t == "view") & (F.col("value").cast("int") % 2 == 0)).select("conversation_id", "turn", "seq", t.alias("state"))
    allowed = rows.groupBy("conversation_id", "turn").agg(F.array_sort(F.collect_set(F.when(t.isin("purchase", "error"), t))).alias("candidates"))
    return allowed.join(X.visited(writes).withColumnRenamed("states", "visits"), ["conversation_id", "turn"], "left")


def placed(spark: SparkSession, d: str) -> DataFrame:
    reach = spark.createDataFrame([("signup", ["purchase"]), ("purchase", ["error"]), ("error", ["error", "signup"])], "state string, reach array<string>")
    return X.place_turns(turn_inputs(spark, d), reach)


def place_turns(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d).select("conversation_id", "turn", F.array_join("states", "|").alias("states"), F.array_join("alternatives", "|").alias("alternatives"), "method", "exit_state", "confidence")


def standing_states(spark: SparkSession, d: str) -> DataFrame:
    rows = X.standing_state(observations(spark, d), F.when(F.col("entity_type") == "State", F.col("token")))
    return rows.filter("entity_type = 'Tool'").groupBy("token", "standing").agg(F.count("*").alias("n"))


def following_states(spark: SparkSession, d: str) -> DataFrame:
    return X.following_state(placed(spark, d)).select("conversation_id", "turn", "state", "following")


def illegal_hops(spark: SparkSession, d: str) -> DataFrame:
    legal = spark.createDataFrame([("signup", "purchase"), ("purchase", "error"), ("error", "signup")], "source string, target string")
    return X.hops(placed(spark, d)).join(legal, ["source", "target"], "left_anti").groupBy("source", "target").agg(F.count("*").alias("n"))


def gradable_turns(spark: SparkSession, d: str) -> DataFrame:
    """Only a checkpoint is certain enough to be graded by."""
    certain = (F.col("method") == "checkpoint") & (F.size("states") > 0)
    return placed(spark, d).groupBy("method").agg(F.count("*").alias("turns"), F.count_if(F.col("state").isNotNull()).alias("placed"), F.count_if(certain).alias("gradable"))


def silence_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns without a tool."""
    rows = observations(spark, d).groupBy("conversation_id", "turn").agg(F.count_if(F.col("entity_type") == "Tool").alias("tools"), F.count("*").alias("n"))
    return rows.filter("tools = 0").select("conversation_id", "turn", "n")


def turn_observed(spark: SparkSession, d: str) -> DataFrame:
    """What a turn's tools and outcomes were, in order, and what was said."""
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), F.count_if(F.col("role") == "assistant").alias("said"))
    return rows.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), "|").alias("roles"), "said")


def turn_findings(spark: SparkSession, d: str) -> DataFrame:
    """Turns against a graph in which members browse, buyers select, and a failure ends the journey."""
    facts = truth.state_facts(
        spark.createDataFrame([("signup", "view"), ("purchase", "view"), ("purchase", "click")], "state string, tool string"), spark.createDataFrame([("click", "purchase")], "tool string, outcome string"),
        spark.createDataFrame([("signup", "purchase"), ("purchase", "error")], "state string, next_state string"), spark.createDataFrame([("error",)], "state string"),
    )
    t = F.col("token")
    seen = observations(spark, d).groupBy("conversation_id", "turn").agg(
        F.array_sort(F.collect_set(F.when(t.isin("view", "click"), t))).alias("tools"), F.array_sort(F.collect_set(F.when(t.isin("purchase", "error"), t))).alias("outcomes"), (F.count_if(t.isin("view", "click")) == 0).alias("silent"),
    )
    return truth.findings(placed(spark, d), seen, facts).groupBy("finding", "detail").agg(F.count("*").alias("n"))


def profile_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Wire names of the profile, with those that no event bears out."""
    profile = spark.createDataFrame([*DECLARED, ("Tool", "lost", "Tool:absent")], "entity_type string, wire string, entity string")
    heard = bound(spark, d).filter("entity IS NOT NULL").select("entity").distinct()
    named, gaps = truth.profile_triples(profile, heard)
    return named.select("head", "relation", "tail").unionByName(gaps.select(F.col("entity").alias("head"), F.lit("UNHEARD").alias("relation"), F.col("wire").alias("tail")))


def discover_transitions(spark: SparkSession, d: str) -> DataFrame:
    return X.transitions(observations(spark, d), "token")


def discover_state_tools(spark: SparkSession, d: str) -> DataFrame:
    rows = X.standing_state(observations(spark, d), F.when(F.col("entity_type") == "Outcome", F.col("token"))).filter("entity_type = 'Tool' AND standing IS NOT NULL")
    return rows.groupBy("standing").agg(F.array_join(F.array_sort(F.collect_set("token")), "|").alias("tools"), F.min_by("seq", "seq").alias("first_seen"))


def discover_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    rows = observations(spark, d)
    writes = rows.select("name", "value").unionByName(rows.select(F.lit("event").alias("name"), F.col("token").alias("value"))).unionByName(rows.select(F.lit("kind").alias("name"), F.col("entity_type").alias("value")))
    return X.checkpoint_candidates(writes).select("name", "n_values", F.col("rank").cast("bigint").alias("rank"))


OBS = """obs AS (SELECT user_id AS conversation_id, event_id AS seq, date_diff('day', DATE '1970-01-01', ts::DATE) AS turn,
    CASE WHEN event_type IN ('view', 'click') THEN 'Tool' WHEN event_type IN ('purchase', 'error') THEN 'Outcome' ELSE 'State' END AS entity_type,
    event_type AS token, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events)"""
BOUND = f"""{OBS}, bound AS (SELECT *, CASE token WHEN 'view' THEN 'Tool:browse' WHEN 'purchase' THEN 'Outcome:paid' WHEN 'signup' THEN 'State:member' WHEN 'click' THEN 'Tool:select' END AS entity,
    CASE WHEN token IN ('view', 'purchase', 'signup') THEN 'declared' WHEN token = 'click' THEN 'lexical' ELSE 'none' END AS method FROM obs)"""
RUNS = "runs AS (SELECT conversation_id, bool_or(entity_type = 'State') AS has_states FROM ev GROUP BY 1), seen AS (SELECT conversation_id, entity AS subject, count(*) AS calls, min(seq) AS first_seq FROM ev WHERE entity IS NOT NULL GROUP BY 1, 2)"
EV = f"WITH {BOUND}, ev AS (SELECT * FROM bound), {RUNS}"
MANY = f"WITH {OBS}, ev AS (SELECT conversation_id, seq, token AS entity, CASE token WHEN 'view' THEN 'Tool' WHEN 'click' THEN 'Outcome' ELSE 'State' END AS entity_type FROM obs), {RUNS}"
COUNT_LIMIT = EV + """, limits(subject, limit_text, variable) AS (VALUES ('Tool:browse', '15', 'k'), ('Tool:select', '70', 'none'), ('Outcome:paid', '7', 'none'), ('State:member', 'several', 'none'), ('Tool:absent', '3', 'none')),
peaks AS (SELECT conversation_id, name, max(try_cast(value AS BIGINT)) AS peak FROM obs WHERE trim(value) <> '' GROUP BY 1, 2),
v AS (SELECT r.conversation_id, l.subject, try_cast(limit_text AS BIGINT) AS limit_value, greatest(coalesce(calls, 0), coalesce(peak, 0)) AS observed,
    CASE WHEN try_cast(limit_text AS BIGINT) IS NULL THEN 'undecided' WHEN coalesce(calls, 0) = 0 AND peak IS NULL THEN 'not_applicable'
        WHEN greatest(coalesce(calls, 0), coalesce(peak, 0)) <= try_cast(limit_text AS BIGINT) THEN 'pass' ELSE 'fail' END AS outcome
    FROM runs r CROSS JOIN limits l LEFT JOIN seen s ON s.conversation_id = r.conversation_id AND s.subject = l.subject
    LEFT JOIN peaks p ON p.conversation_id = r.conversation_id AND p.name = l.variable)
"""


def _expected(values: str) -> str:
    return f""", a(subject, expected) AS (VALUES {values}), rows AS (SELECT r.*, a.*, coalesce(s.calls, 0) AS calls, s.first_seq,
    (SELECT count(*) FROM seen e WHERE e.conversation_id = r.conversation_id AND list_contains(a.expected, e.subject)) AS met
    FROM runs r CROSS JOIN a LEFT JOIN seen s ON s.conversation_id = r.conversation_id AND s.subject = a.subject)
"""


NEXT = """, nxt AS (SELECT rows.*, (SELECT arg_min(e.entity, e.seq) FROM ev e WHERE e.conversation_id = rows.conversation_id AND e.entity_type = 'State' AND e.seq > rows.first_seq) AS next_state FROM rows)
"""
TOOL_CALLED = EV + _expected("('State:member', ['Tool:browse', 'Tool:select']), ('State:lost', ['Tool:absent'])") + "SELECT conversation_id, subject, CASE WHEN met = len(expected) THEN 'pass' WHEN has_states AND calls = 0 THEN 'not_applicable' ELSE 'fail' END AS outcome FROM rows"
REQUIRED = EV + _expected("('Rule:buy', ['Outcome:paid']), ('Rule:none', []::VARCHAR[]), ('Rule:both', ['Outcome:paid', 'State:member'])") + "SELECT conversation_id, subject, CASE WHEN len(expected) = 0 THEN 'undecided' WHEN met = len(expected) THEN 'pass' ELSE 'fail' END AS outcome FROM rows"
FORBIDDEN = EV + _expected("('Rule:join', ['State:member']), ('Rule:none', []::VARCHAR[]), ('Rule:leave', ['Tool:absent'])") + "SELECT conversation_id, subject, CASE WHEN len(expected) = 0 THEN 'undecided' WHEN met > 0 THEN 'fail' ELSE 'pass' END AS outcome FROM rows"
ALLOWED = MANY + _expected("('signup', ['purchase']), ('error', ['error', 'signup'])") + NEXT + "SELECT conversation_id, subject, CASE WHEN NOT has_states THEN 'undecided' WHEN first_seq IS NULL OR next_state IS NULL THEN 'not_applicable' WHEN list_contains(expected, next_state) THEN 'pass' ELSE 'fail' END AS outcome FROM nxt"
TERMINAL = MANY + ", l AS (SELECT conversation_id, arg_max(entity, seq) AS s FROM ev WHERE entity_type = 'State' GROUP BY 1) SELECT conversation_id, 'journey' AS subject, CASE WHEN s IS NULL THEN 'undecided' WHEN s IN ('purchase', 'signup') THEN 'pass' ELSE 'fail' END AS outcome FROM runs LEFT JOIN l USING (conversation_id)"
VERDICTS = "WITH " + ", ".join(
    f"v{k} AS (SELECT conversation_id, outcome, '{dim}' AS dimension, '{sev}' AS severity FROM ({sql}))"
    for k, (sql, dim, sev) in enumerate([(TOOL_CALLED, "tool", "error"), (REQUIRED, "policy", "blocker"), (FORBIDDEN, "policy", "warning"), (ALLOWED, "trajectory", "error"), (TERMINAL, "outcome", "warning")])
) + ", v AS (FROM v0 UNION ALL FROM v1 UNION ALL FROM v2 UNION ALL FROM v3 UNION ALL FROM v4) "
GRADED = EV + """, o AS (SELECT r.conversation_id, has_states, b.first_seq AS browse, p.first_seq AS paid, m.first_seq AS member, s.first_seq AS selected FROM runs r LEFT JOIN seen b ON b.conversation_id = r.conversation_id AND b.subject = 'Tool:browse'
    LEFT JOIN seen p ON p.conversation_id = r.conversation_id AND p.subject = 'Outcome:paid' LEFT JOIN seen m ON m.conversation_id = r.conversation_id AND m.subject = 'State:member' LEFT JOIN seen s ON s.conversation_id = r.conversation_id AND s.subject = 'Tool:select'),
graded AS (SELECT conversation_id, 'tool_called' AS kind, 'State:member' AS subject, CASE WHEN browse IS NOT NULL THEN 'pass' WHEN has_states AND member IS NULL THEN 'not_applicable' ELSE 'fail' END AS outcome FROM o
    UNION ALL SELECT conversation_id, 'order_expected', 'Tool:browse', CASE WHEN browse IS NULL OR paid IS NULL THEN 'not_applicable' WHEN browse < paid THEN 'pass' ELSE 'fail' END FROM o
    UNION ALL SELECT conversation_id, 'terminal_expected', 'journey', CASE WHEN member IS NULL THEN 'undecided' ELSE 'pass' END FROM o
    UNION ALL SELECT conversation_id, 'action_required', 'Rule:act', CASE WHEN browse IS NOT NULL AND selected IS NOT NULL THEN 'pass' ELSE 'fail' END FROM o
    UNION ALL SELECT conversation_id, 'action_forbidden', 'Rule:rest', 'undecided' FROM o
    UNION ALL SELECT conversation_id, 'action_forbidden', 'Rule:stop', CASE WHEN browse IS NOT NULL THEN 'fail' ELSE 'pass' END FROM o
    UNION ALL SELECT conversation_id, 'mood_expected', 'Rule:smile', 'undecided' FROM o)
"""
NEAR = "lambda x: x = f.before OR (f.before = 'signup' AND x = 'purchase') OR (f.before = 'purchase' AND x = 'error') OR (f.before = 'error' AND x IN ('error', 'signup'))"
PLACED = f"""WITH RECURSIVE {OBS}, writes AS (
    SELECT conversation_id, turn, seq, token, lag(token) OVER (PARTITION BY conversation_id, turn ORDER BY seq) AS prior FROM obs WHERE token = 'signup' OR token = 'view' AND value::INT % 2 = 0
), visits AS (SELECT conversation_id, turn, list(token ORDER BY seq) AS visits FROM writes WHERE token IS DISTINCT FROM prior GROUP BY 1, 2
), turns AS (
    SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS k FROM (
        SELECT conversation_id, turn, visits, coalesce(list_sort(list_distinct(list(token) FILTER (token IN ('purchase', 'error')))), []) AS candidates FROM obs LEFT JOIN visits USING (conversation_id, turn) GROUP BY 1, 2, 3)
), fold AS (
    SELECT conversation_id, turn, k, CASE WHEN visits IS NOT NULL THEN visits ELSE candidates[1:1] END AS states, CASE WHEN visits IS NULL AND len(candidates) > 1 THEN candidates ELSE [] END AS alternatives,
        CASE WHEN visits IS NOT NULL THEN 'checkpoint' WHEN len(candidates) = 1 THEN 'inferred' WHEN len(candidates) > 1 THEN 'ambiguous' ELSE 'none' END AS method,
        CASE WHEN visits IS NOT NULL THEN visits[-1] ELSE candidates[1] END AS before
    FROM turns WHERE k = 1
    UNION ALL
    SELECT conversation_id, turn, k, states, CASE WHEN method = 'ambiguous' THEN choice ELSE [] END, method, coalesce(states[-1], before) FROM (
        SELECT *, CASE method WHEN 'checkpoint' THEN visits WHEN 'inferred' THEN choice WHEN 'ambiguous' THEN choice[1:1] WHEN 'carried' THEN [before] ELSE []::VARCHAR[] END AS states FROM (
            SELECT *, CASE WHEN visits IS NOT NULL THEN 'checkpoint' WHEN len(choice) = 1 THEN 'inferred' WHEN len(choice) > 1 THEN 'ambiguous' WHEN before IS NOT NULL THEN 'carried' ELSE 'none' END AS method FROM (
                SELECT t.*, f.before, CASE WHEN f.before IS NOT NULL AND len(list_filter(t.candidates, {NEAR})) > 0 THEN list_filter(t.candidates, {NEAR}) ELSE t.candidates END AS choice
                FROM fold f JOIN turns t ON t.conversation_id = f.conversation_id AND t.k = f.k + 1)))
), placed AS (SELECT conversation_id, turn::BIGINT AS turn, states, alternatives, method, states[1] AS state, states[-1] AS exit_state,
    first_value(states[1] IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM fold)
"""

QUERIES = {
    "bind_tokens": (bind_tokens, f"WITH {BOUND} SELECT conversation_id, seq, entity, method, CASE method WHEN 'declared' THEN 1.0 WHEN 'lexical' THEN 0.75 ELSE 0 END::DOUBLE AS confidence FROM bound"),
    "binding_coverage": (binding_coverage, f"WITH {BOUND} SELECT conversation_id, count(token) AS attempted, count(entity) AS bound, round(count(entity) / count(token), 6) AS coverage FROM bound GROUP BY 1"),
    "unbound_tokens": (unbound_tokens, f"WITH {BOUND} SELECT conversation_id, string_agg(DISTINCT token, '|' ORDER BY token) AS tokens FROM bound WHERE entity IS NULL GROUP BY 1"),
    "runtime_calls": (runtime_calls, f"WITH {BOUND} SELECT conversation_id, entity, count(*) AS calls, min(seq) AS first_seq, max(seq) AS last_seq FROM bound WHERE entity IS NOT NULL GROUP BY 1, 2"),
    "runtime_variables": (runtime_variables, f"WITH {OBS} SELECT conversation_id, name, max(try_cast(value AS BIGINT)) AS peak, arg_max(value, seq) AS last_value FROM obs WHERE trim(value) <> '' GROUP BY 1, 2"),
    "grade_count_limit": (grade_count_limit, COUNT_LIMIT + "SELECT * FROM v"),
    "count_limit_summary": (count_limit_summary, COUNT_LIMIT + "SELECT subject, outcome, count(*) AS n FROM v GROUP BY 1, 2"),
    "grade_tool_called": (grade_tool_called, TOOL_CALLED),
    "grade_action_required": (grade_action_required, REQUIRED),
    "grade_action_forbidden": (grade_action_forbidden, FORBIDDEN),
    "grade_outcome_allowed": (
        grade_outcome_allowed,
        EV + _expected("('Tool:browse', ['Outcome:paid']), ('Tool:select', ['Outcome:failed']), ('Tool:absent', ['Outcome:paid'])") + """, w AS (SELECT *, last_value(CASE WHEN entity_type = 'Tool' THEN entity END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tool FROM ev),
got AS (SELECT conversation_id, tool AS subject, list(DISTINCT coalesce(entity, '')) AS got FROM w WHERE entity_type = 'Outcome' AND tool IS NOT NULL GROUP BY 1, 2)
SELECT rows.conversation_id, rows.subject, CASE WHEN got IS NULL THEN 'not_applicable' WHEN len(list_filter(got, lambda x: NOT list_contains(expected, x))) > 0 THEN 'fail' ELSE 'pass' END AS outcome FROM rows LEFT JOIN got ON got.conversation_id = rows.conversation_id AND got.subject = rows.subject""",
    ),
    "grade_transition_expected": (grade_transition_expected, MANY + _expected("('click', ['purchase']), ('view', ['error', 'signup'])") + NEXT + "SELECT conversation_id, subject, CASE WHEN first_seq IS NULL THEN 'not_applicable' WHEN NOT has_states OR next_state IS NULL THEN 'undecided' WHEN list_contains(expected, next_state) THEN 'pass' ELSE 'fail' END AS outcome FROM nxt"),
    "grade_transition_allowed": (grade_transition_allowed, ALLOWED),
    "grade_terminal_expected": (grade_terminal_expected, TERMINAL),
    "grade_order_expected": (
        grade_order_expected,
        MANY + ", a(subject, other) AS (VALUES ('view', 'purchase'), ('signup', 'error'), ('absent', 'view')) SELECT r.conversation_id, a.subject, CASE WHEN s.first_seq IS NULL OR o.first_seq IS NULL THEN 'not_applicable' WHEN s.first_seq < o.first_seq THEN 'pass' ELSE 'fail' END AS outcome FROM runs r CROSS JOIN a LEFT JOIN seen s ON s.conversation_id = r.conversation_id AND s.subject = a.subject LEFT JOIN seen o ON o.conversation_id = r.conversation_id AND o.subject = a.other",
    ),
    "grade_text_required": (
        grade_text_required,
        r"""WITH a(subject, text) AS (VALUES ('Turn:hello', 'the'), ('Turn:of', 'of the'), ('Turn:none', 'no such text')),
said AS (SELECT conv_id AS conversation_id, trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS said FROM conversations WHERE role = 'assistant'), r AS (SELECT DISTINCT conv_id AS conversation_id FROM conversations)
SELECT r.conversation_id, a.subject, CASE WHEN bool_or(contains(said, a.text)) IS NULL THEN 'undecided' WHEN bool_or(contains(said, a.text)) THEN 'pass' ELSE 'fail' END AS outcome FROM r CROSS JOIN a LEFT JOIN said USING (conversation_id) GROUP BY 1, 2""",
    ),
    "grade_kinds": (grade_kinds, GRADED + "SELECT conversation_id, kind, subject, outcome FROM graded"),
    "failures_ranked": (failures_ranked, GRADED + "SELECT conversation_id, kind, subject, row_number() OVER (PARTITION BY conversation_id ORDER BY CASE kind WHEN 'order_expected' THEN 1 WHEN 'terminal_expected' THEN 5 ELSE 3 END, kind, subject) AS place FROM graded WHERE outcome = 'fail'"),
    "observable_targets": (
        observable_targets,
        EV + """, w(kind, subject, target) AS (VALUES ('tool_called', 'State:member', 'Tool:browse'), ('order_expected', 'Tool:browse', NULL), ('terminal_expected', 'journey', NULL), ('action_required', 'Rule:act', 'Tool:browse'), ('action_required', 'Rule:act', 'Tool:select'), ('action_forbidden', 'Rule:rest', NULL), ('action_forbidden', 'Rule:stop', 'Tool:browse'), ('mood_expected', 'Rule:smile', NULL))
SELECT kind, w.subject, count(target) AS targets, coalesce(sum(n), 0)::BIGINT AS n FROM w LEFT JOIN (SELECT entity AS target, count(*) AS n FROM ev GROUP BY 1) USING (target) GROUP BY 1, 2""",
    ),
    "discover_triples": (
        discover_triples,
        f"WITH {OBS}, w AS (SELECT *, last_value(CASE WHEN entity_type = 'Tool' THEN token END IGNORE NULLS) OVER o AS tool, last_value(CASE WHEN entity_type = 'Outcome' THEN token END IGNORE NULLS) OVER o AS outcome, lag(token) OVER (PARTITION BY conversation_id ORDER BY seq) AS prior FROM obs WINDOW o AS (PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT prior AS head, 'HAS_NEXT_STEP' AS relation, token AS tail, count(*) AS n FROM w WHERE prior <> token GROUP BY ALL UNION ALL SELECT outcome, 'USES_TOOL', token, count(*) FROM w WHERE entity_type = 'Tool' AND outcome IS NOT NULL GROUP BY ALL UNION ALL SELECT tool, 'RETURNS', token, count(*) FROM w WHERE entity_type = 'Outcome' AND tool IS NOT NULL GROUP BY ALL",
    ),
    "verdict_summary": (verdict_summary, VERDICTS + "SELECT count(*) FILTER (outcome = 'pass') AS pass, count(*) FILTER (outcome = 'fail') AS fail, count(*) FILTER (outcome = 'undecided') AS undecided, count(*) FILTER (outcome = 'not_applicable') AS not_applicable FROM v"),
    "hops": (hop_counts, PLACED + "SELECT source, target, count(*) AS n FROM (SELECT exit_state AS source, following AS target FROM placed UNION ALL SELECT states[k] AS source, states[k + 1] AS target FROM (SELECT states, unnest(range(1, len(states))) AS k FROM placed)) WHERE source <> target GROUP BY 1, 2"),
    "discover_outcomes": (discover_outcomes, f"WITH {OBS}, w AS (SELECT *, last_value(CASE WHEN entity_type = 'Tool' THEN token END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tool FROM obs) SELECT token, string_agg(DISTINCT tool, '|' ORDER BY tool) AS tools, count(tool) AS n FROM w WHERE entity_type = 'Outcome' GROUP BY 1"),
    "dimension_matrix": (dimension_matrix, VERDICTS + "SELECT dimension, count(*) FILTER (outcome = 'pass') AS pass, count(*) FILTER (outcome = 'fail') AS fail, count(*) FILTER (outcome = 'undecided') AS undecided, count(*) FILTER (outcome = 'not_applicable') AS not_applicable FROM v GROUP BY 1"),
    "blocked_runs": (blocked_runs, VERDICTS + "SELECT conversation_id, bool_or(outcome = 'fail' AND severity IN ('blocker', 'error')) AS blocked FROM v GROUP BY 1"),
    "place_turns": (place_turns, PLACED + "SELECT conversation_id, turn, array_to_string(states, '|') AS states, array_to_string(alternatives, '|') AS alternatives, method, exit_state, round(CASE method WHEN 'checkpoint' THEN 1.0 WHEN 'inferred' THEN 0.8 WHEN 'carried' THEN 0.6 WHEN 'ambiguous' THEN 0.4 ELSE 0.0 END::DOUBLE / greatest(len(alternatives), 1), 3) AS confidence FROM placed"),
    "standing_states": (standing_states, f"WITH {OBS}, w AS (SELECT *, last_value(CASE WHEN entity_type = 'State' THEN token END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS standing FROM obs) SELECT token, standing, count(*) AS n FROM w WHERE entity_type = 'Tool' GROUP BY 1, 2"),
    "following_states": (following_states, PLACED + "SELECT conversation_id, turn, state, following FROM placed"),
    "illegal_hops": (
        illegal_hops,
        PLACED + "SELECT source, target, count(*) AS n FROM (SELECT exit_state AS source, following AS target FROM placed UNION ALL SELECT states[k] AS source, states[k + 1] AS target FROM (SELECT states, unnest(range(1, len(states))) AS k FROM placed)) WHERE source <> target AND (source, target) NOT IN (('signup', 'purchase'), ('purchase', 'error'), ('error', 'signup')) GROUP BY 1, 2",
    ),
    "gradable_turns": (gradable_turns, PLACED + "SELECT method, count(*) AS turns, count(state) AS placed, count(*) FILTER (method = 'checkpoint') AS gradable FROM placed GROUP BY 1"),
    "turn_findings": (
        turn_findings,
        PLACED + """, o AS (SELECT conversation_id, turn::BIGINT AS turn, list_distinct(list(token)) AS toks, count(*) FILTER (token IN ('view', 'click')) = 0 AS silent FROM obs GROUP BY 1, 2),
j AS (SELECT placed.*, toks, silent FROM placed JOIN o USING (conversation_id, turn)),
f AS (SELECT 'unplaced' AS finding, '' AS detail FROM j WHERE state IS NULL
    UNION ALL SELECT 'undeclared_tool', t FROM (SELECT states, unnest(toks) AS t FROM j WHERE list_has_any(states, ['signup', 'purchase', 'error'])) WHERE t IN ('view', 'click') AND NOT (list_contains(states, 'purchase') OR t = 'view' AND list_contains(states, 'signup'))
    UNION ALL SELECT 'stray_outcome', t FROM (SELECT states, unnest(toks) AS t FROM j) WHERE t = 'error' AND list_contains(states, 'purchase')
    UNION ALL SELECT 'illegal_hop', following FROM j WHERE exit_state <> following AND (exit_state = 'signup' AND following <> 'purchase' OR exit_state = 'purchase' AND following <> 'error')
    UNION ALL SELECT 'continues_after_terminal', following FROM j WHERE exit_state = 'error' AND following IS NOT NULL
    UNION ALL SELECT 'silent', '' FROM j WHERE silent AND exit_state <> 'error')
SELECT finding, detail, count(*) AS n FROM f GROUP BY 1, 2""",
    ),
    "profile_gaps": (profile_gaps, f"WITH {BOUND}, h AS (SELECT DISTINCT entity FROM bound), p(t, w, e) AS (VALUES ('Tool', ' VIEW!', 'Tool:browse'), ('Outcome', 'purchase', 'Outcome:paid'), ('State', 'signup', 'State:member'), ('Tool', 'lost', 'Tool:absent')) SELECT e AS head, CASE WHEN e IN (SELECT entity FROM h) THEN 'EMITTED_AS_' || upper(t) ELSE 'UNHEARD' END AS relation, w AS tail FROM p"),
    "silence_turns": (silence_turns, f"WITH {OBS} SELECT conversation_id, turn::BIGINT AS turn, count(*) AS n FROM obs GROUP BY 1, 2 HAVING count(*) FILTER (entity_type = 'Tool') = 0"),
    "turn_observed": (turn_observed, "SELECT conv_id, string_agg(role, '|' ORDER BY turn, role) AS roles, count(*) FILTER (role = 'assistant') AS said FROM conversations GROUP BY 1"),
    "discover_transitions": (discover_transitions, f"WITH {OBS}, m AS (SELECT lag(token) OVER (PARTITION BY conversation_id ORDER BY seq) AS source, token AS target FROM obs) SELECT source, target, count(*) AS n FROM m WHERE source <> target GROUP BY 1, 2"),
    "discover_state_tools": (discover_state_tools, f"WITH {OBS}, w AS (SELECT *, last_value(CASE WHEN entity_type = 'Outcome' THEN token END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS standing FROM obs) SELECT standing, string_agg(DISTINCT token, '|' ORDER BY token) AS tools, min(seq) AS first_seen FROM w WHERE entity_type = 'Tool' AND standing IS NOT NULL GROUP BY 1"),
    "discover_checkpoints": (
        discover_checkpoints,
        f"WITH {OBS}, w AS (SELECT name, value FROM obs UNION ALL SELECT 'event', token FROM obs UNION ALL SELECT 'kind', entity_type FROM obs), c AS (SELECT name, bool_and(trim(value) <> '' AND lower(trim(value)) NOT IN ('true', 'false') AND try_cast(value AS DOUBLE) IS NULL) AS s, count(DISTINCT value) AS n_values FROM w GROUP BY 1) SELECT name, n_values, row_number() OVER (ORDER BY n_values DESC, name) AS rank FROM c WHERE s",
    ),
}
