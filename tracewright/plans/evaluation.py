"""Whole evaluations: observations made of ``events``, in which a user is a conversation and a day a turn, against a shop's graph.

Views and clicks are calls with an argument, purchases and errors results of the span that their number names, sign-ups writes: of a counter, or of the state of
the shop. After a purchase the shop says something; a day without a call is a silence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import entity_id
from tracewright.operators import discover as D
from tracewright.operators import evaluate as E
from tracewright.operators import traces as X
from tracewright.sources import telemetry
from tracewright.storage import stash, table

STATES = ("start", "basket", "payment", "done")
TRIPLES = [
    ("State:start", "USES_TOOL", "Tool:view"), ("State:basket", "USES_TOOL", "Tool:click"), ("State:payment", "USES_TOOL", "Tool:click"), ("Tool:view", "RETURNS", "Outcome:failed"), ("Tool:click", "RETURNS", "Outcome:paid"),
    ("State:start", "HAS_NEXT_STEP", "State:basket"), ("State:basket", "HAS_NEXT_STEP", "State:payment"), ("State:payment", "OFFERS_DECISION", "Decision:pay"), ("Decision:pay", "HAS_OUTCOME", "Outcome:paid"), ("Decision:pay", "HAS_OUTCOME", "Outcome:failed"),
    ("Outcome:paid", "LEADS_TO", "State:done"), ("Outcome:failed", "LEADS_TO", "State:basket"), ("State:done", "IS_TERMINAL", " True"), ("State:start", "GOVERNED_BY", "Rule:look"), ("State:payment", "HAS_TURN", "Turn:thanks"), ("Turn:thanks", "HAS_CANONICAL_TEXT", "thank you for  Number 7"),
    ("Action:look", "INVOKES", "Tool:view"), ("Tool:view", "EMITTED_AS_TOOL", "View!"), ("Outcome:paid", "EMITTED_AS_RESULT", "PURCHASE"), ("Outcome:failed", "EMITTED_AS_RESULT", "error"), ("StateVariable:tries", "EMITTED_AS_FIELD", "attempts"),
]
ENTITIES = [(f"State:{s}", "State", [s.title()]) for s in STATES] + [("Tool:view", "Tool", ["Look"]), ("Tool:click", "Tool", ["click"]), ("Outcome:paid", "Outcome", []), ("Outcome:failed", "Outcome", []), ("StateVariable:tries", "StateVariable", ["tries"]), ("Tool:view2", "Tool", ["view 2"])]
#: assertion, kind, subject, expected, scope, severity
ASSERTIONS = [
    ("a01", "tool_called", "State:start", ["Tool:view"], "state", "error"), ("a02", "tool_called", "State:payment", ["Tool:click", "Tool:view2"], "state", "warning"), ("a03", "outcome_allowed", "Tool:click", ["Outcome:paid"], "tool", "error"),
    ("a04", "transition_expected", "Outcome:paid", ["State:done"], "state", "error"), ("a05", "transition_allowed", "State:basket", ["State:payment"], "state", "warning"), ("a06", "terminal_expected", "", ["State:done"], "journey", "warning"),
    ("a07", "order_expected", "Tool:view", ["Tool:click"], "journey", "warning"), ("a08", "count_limit", "StateVariable:tries", ["95"], "capability", "blocker"), ("a09", "count_limit", "Tool:view", ["ten"], "capability", "warning"), ("a10", "action_required", "Rule:look", ["Action:look", "Tool:click"], "journey", "error"),
    ("a11", "action_forbidden", "Rule:wait", ["Action:wait"], "journey", "error"), ("a12", "action_forbidden", "Rule:stop", ["Tool:view2", "Action:wait"], "journey", "error"), ("a13", "text_required", "Turn:thanks", ["thank you for  Number 7"], "turn", "info"), ("a14", "text_required", "Outcome:paid", ["thank you for  Number 7"], "turn", "info"), ("a15", "mood_expected", "Outcome:failed", [], "tool", "error"),
]


def graph(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triples, entities and assertions of the shop."""
    return (
        spark.createDataFrame(TRIPLES, "head string, relation string, tail string"), spark.createDataFrame(ENTITIES, "entity string, entity_type string, surfaces array<string>"),
        spark.createDataFrame(ASSERTIONS, "assertion_id string, kind string, subject string, expected array<string>, scope string, severity string"),
    )


def observations(events: DataFrame) -> DataFrame:
    """``conversation_id, seq, turn, kind, name, value, arguments``; the silences need all rows of a turn and come apart (``silences``)."""
    k, t = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    tool, result = t.isin("view", "click"), t.isin("purchase", "error")
    counter = k % 5 == 0
    span = F.when(k % 2 == 0, "view").otherwise("click")
    main = F.struct(
        F.lit(0).alias("part"), F.when(tool, "tool_call").when(result, "outcome").otherwise("state_write").alias("kind"), F.when(tool, t).when(result, span).when(counter, "Attempts").otherwise("CheckPoint").alias("name"),
        F.when(tool, "OK").when(result, F.upper(t)).when(counter, k.cast("string")).otherwise(F.element_at(F.array(*[F.lit(s) for s in ("start", "basket", "payment", "nowhere")]), F.pmod(k, F.lit(5)))).alias("value"),
    )
    said = F.struct(F.lit(1).alias("part"), F.lit("assistant").alias("kind"), F.lit("assistant").alias("name"), F.concat(F.lit("Thank you  for number "), k, F.lit(".")).alias("value"))
    none = F.array().cast("array<struct<key: string, value: string>>")
    rows = events.select(
        F.col("user_id").alias("conversation_id"), "event_id", F.date_diff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("turn"), k.alias("k"),
        F.explode(F.when(t == "purchase", F.array(main, said)).otherwise(F.array(main))).alias("o"),
    )
    arguments = F.when(F.col("o.kind") == "tool_call", F.array(F.struct(F.lit("level").alias("key"), F.col("k").cast("string").alias("value")))).otherwise(none)
    return rows.select("conversation_id", (F.col("event_id") * 4 + F.col("o.part")).alias("seq"), "turn", "o.kind", "o.name", "o.value", arguments.alias("arguments"))


def silences(rows: DataFrame) -> DataFrame:
    """A row more for each turn without a call, behind all others."""
    quiet = rows.groupBy("conversation_id", "turn").agg(F.max("seq").alias("seq"), F.count_if(F.col("kind") == "tool_call").alias("n")).filter("n = 0")
    return quiet.select("conversation_id", (F.col("seq") + 2).alias("seq"), "turn", F.lit("silence").alias("kind"), F.lit("").alias("name"), F.lit("no tool call in this turn").alias("value"), F.array().cast("array<struct<key: string, value: string>>").alias("arguments"))


def bound(spark: SparkSession, d: str) -> DataFrame:
    triples, entities, _ = graph(spark)
    rows = observations(table(spark, d, "events"))
    return stash(X.bind(E.sought(rows.unionByName(silences(rows)), "checkpoint"), *E.names(triples, entities)), "bound")


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bound observations, placed turns and what the graph says of its states."""
    triples, entities, _ = graph(spark)
    rows, facts = bound(spark, d), stash(E.state_facts(triples), "facts")
    return rows, stash(E.place(rows, E.inverse_index(triples, entities), facts), "placed"), facts


def candidate_states(spark: SparkSession, d: str) -> DataFrame:
    triples, entities, _ = graph(spark)
    found = E.candidate_states(bound(spark, d), E.inverse_index(triples, entities))
    return found.select("conversation_id", "turn", F.array_join("candidates", "|").alias("candidates"))


def evaluate_trace(spark: SparkSession, d: str) -> DataFrame:
    """Every assertion of every user's contract, graded."""
    triples, entities, assertions = graph(spark)
    rows = bound(spark, d)
    return E.verdicts(E.trace_contracts(rows, assertions), assertions, rows, triples, entities)


def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    triples, entities, assertions = graph(spark)
    rows, placed, _ = _placed(spark, d)
    graded = E.verdicts(E.trace_contracts(rows, assertions), assertions, rows, triples, entities)
    out = E.evaluate(graded, rows, placed)
    return out.withColumns({"coverage": F.round("coverage", 6), "unbound": F.array_join("unbound", "|")})


def turn_contracts(spark: SparkSession, d: str) -> DataFrame:
    rows, placed, facts = _placed(spark, d)
    return E.turn_contracts(placed, facts, graph(spark)[2])


def trace_findings(spark: SparkSession, d: str) -> DataFrame:
    rows, placed, facts = _placed(spark, d)
    return E.findings(placed, rows, facts)


def observed_turns(spark: SparkSession, d: str) -> DataFrame:
    """What each day's calls and results were, in order, what was said, and whether it was silent."""
    found = E.observed(bound(spark, d))
    return found.select("conversation_id", "turn", F.array_join("tools", "|").alias("tools"), F.array_join("outcomes", "|").alias("outcomes"), "said", "heard", "silent")


def observed_facts(spark: SparkSession, d: str) -> DataFrame:
    """What the users' days show of the shop: its departments are capabilities, a tenth of the calls belong to no state."""
    events = table(spark, d, "events")
    none = F.array().cast("array<struct<key: string, value: string>>")
    rows = observations(events)
    department = F.concat(F.lit("Dept "), (F.col("user_id") % 3).cast("string"))
    more = events.filter("event_type = 'error'").select(F.col("user_id").alias("conversation_id"), (F.col("event_id") * 4 + 3).alias("seq"), F.lit(0).cast("bigint").alias("turn"), F.lit("capability").alias("kind"), department.alias("name"), F.lit("").alias("value"), none.alias("arguments"))
    rows = rows.unionByName(more).withColumn("ref", F.concat_ws(".", "conversation_id", "seq"))
    return D.observed_facts(rows, "Shop", "CheckPoint")


def observed_graph(spark: SparkSession, d: str) -> DataFrame:
    """The shop's graph with what was observed: how many triples of each relation are known by which methods."""
    entities = spark.createDataFrame([("Tool", "view"), ("State", "start"), ("Outcome", "refund")], "entity_type string, canonical string")
    entities = entities.select(entity_id(F.col("entity_type"), F.col("canonical")).alias("entity"), "entity_type", "canonical", F.array("canonical").alias("surfaces"))
    ids = {r["canonical"]: r["entity"] for r in entities.collect()}
    triples = spark.createDataFrame([(ids["start"], "USES_TOOL", ids["view"], ["llm"], "review"), (ids["view"], "RETURNS", ids["refund"], ["llm"], "admitted")], "head string, relation string, tail string, methods array<string>, status string")
    _, merged = D.apply_observations(entities, triples, observed_facts(spark, d))
    return merged.groupBy("relation", F.array_join("methods", "|").alias("methods"), "status").agg(F.count("*").alias("n"))


def exports(spark: SparkSession, d: str) -> DataFrame:
    """An export for each user: a day is a turn; views and clicks are tools whose payloads are JSON or Python's, purchases model spans, errors workflows, sign-ups writes of a variable."""
    e = table(spark, d, "events").select("user_id", "event_id", F.date_diff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"), F.col("event_type").alias("t"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    k = F.col("k").cast("string")
    given = F.when(F.col("t") == "view", F.format_string('{"b": {"y": 1, "x": %d}, "a": null}', "k")).when(F.col("t") == "click", F.format_string("{'level': %d, 'late': True}", "k")).when(F.col("t") == "signup", F.format_string('{"policy_input": ["tries", "%d"]}', "k"))
    given = F.when(F.col("t") == "purchase", F.format_string("[{'role': 'user', 'content': 'I\\'d like %d'}, {'role': 'system', 'content': 'x'}]", "k")).when(F.col("t") == "error", F.lit("None")).otherwise(given)
    result = F.when(F.col("t") == "view", F.format_string('{"status": 200, "response": {"status": "%s"}}', F.when(F.col("k") % 2 == 0, "IN_STOCK").otherwise("gone"))).when(F.col("t") == "purchase", F.format_string('{"role": "assistant", "content": "No. %d"}', "k")).otherwise(F.lit("None"))
    kind = F.when(F.col("t") == "purchase", "llm").when(F.col("t") == "error", "workflow").otherwise("tool")
    span = F.struct("event_id", (F.col("event_id") + 1).cast("string").alias("step"), kind.alias("type"), F.when(F.col("t") == "signup", "set_metadata").otherwise(F.col("t")).alias("name"), given.alias("input"), result.alias("output"), F.concat(F.lit("S"), k).alias("status_code"))
    day = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    turn = F.struct(F.col("day").alias("day"), F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("day").cast("string")).alias("trace_name"), F.struct(F.col("day").cast("string").alias("galileo_turn_id")).alias("trace_attributes"), "spans")
    return day.groupBy("user_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select(F.to_json(F.struct(F.when(F.col("user_id") % 3 > 0, F.col("user_id").cast("string")).alias("session_external_id"), "turns")).alias("export"))


def read_exports(spark: SparkSession, d: str) -> DataFrame:
    """All observations of the users' exports, read back."""
    found = telemetry.observations_of(exports(spark, d))
    pairs = F.array_join(F.transform("arguments", lambda a: F.concat(a["key"], F.lit("="), a["value"])), "|")
    return found.select("conversation_id", "seq", "turn", "step", "kind", "name", "value", "ref", pairs.alias("arguments"))


OBS = """ev AS (SELECT user_id AS conversation_id, event_id, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS turn, event_type AS t, json_extract_string(props, '$.k')::INT AS k FROM events),
obs AS (SELECT conversation_id, event_id * 4 AS seq, turn, CASE WHEN t IN ('view', 'click') THEN 'tool_call' WHEN t IN ('purchase', 'error') THEN 'outcome' ELSE 'state_write' END AS kind,
    CASE WHEN t IN ('view', 'click') THEN t WHEN t IN ('purchase', 'error') THEN CASE WHEN k % 2 = 0 THEN 'view' ELSE 'click' END WHEN k % 5 = 0 THEN 'Attempts' ELSE 'CheckPoint' END AS name,
    CASE WHEN t IN ('view', 'click') THEN 'OK' WHEN t IN ('purchase', 'error') THEN upper(t) WHEN k % 5 = 0 THEN k::VARCHAR ELSE ['start', 'basket', 'payment', 'nowhere'][k % 5] END AS value, k FROM ev),
said AS (SELECT conversation_id, event_id * 4 + 1 AS seq, turn, 'Thank you  for number ' || k || '.' AS value FROM ev WHERE t = 'purchase'),
b AS (SELECT *, CASE kind WHEN 'tool_call' THEN 'Tool' WHEN 'outcome' THEN 'Outcome' ELSE 'StateVariable' END AS entity_type, CASE kind WHEN 'outcome' THEN value ELSE name END AS token,
        CASE WHEN kind = 'tool_call' AND name = 'view' THEN 'Tool:view' WHEN kind = 'tool_call' THEN 'Tool:click' WHEN value = 'PURCHASE' THEN 'Outcome:paid' WHEN value = 'ERROR' THEN 'Outcome:failed' WHEN name = 'Attempts' THEN 'StateVariable:tries' END AS entity FROM obs
    UNION ALL SELECT *, 'State', value, CASE WHEN value <> 'nowhere' THEN 'State:' || value END FROM obs WHERE name = 'CheckPoint')"""
CANDIDATES = """
cand AS (SELECT conversation_id, turn, bool_or(entity = 'Tool:view') AS v, bool_or(entity = 'Tool:click') AS c, bool_or(entity_type = 'Outcome') AS o FROM b GROUP BY 1, 2),
candidates AS (SELECT conversation_id, turn, CASE WHEN v AND (c OR o) THEN CASE WHEN c THEN ['State:basket', 'State:payment', 'State:start'] ELSE ['State:payment', 'State:start'] END
    WHEN v THEN ['State:start'] WHEN o THEN ['State:payment'] WHEN c THEN ['State:basket', 'State:payment'] ELSE [] END AS candidates FROM cand)"""
PAIRS = """
a(assertion_id, kind, subject, severity, scope, about) AS (VALUES """ + ", ".join(f"('{i}', '{k}', '{s}', '{v}', '{p}', {[s, *e]})".replace("['", "['").replace('"', "'") for i, k, s, e, p, v in ASSERTIONS) + """),
seen AS (SELECT DISTINCT conversation_id, entity FROM b WHERE entity IS NOT NULL), runs AS (SELECT DISTINCT conversation_id FROM b),
pairs AS (SELECT r.conversation_id, a.* FROM runs r, a WHERE scope = 'journey' OR EXISTS (SELECT 1 FROM seen s WHERE s.conversation_id = r.conversation_id AND list_contains(a.about, s.entity))),
steps AS (SELECT conversation_id, entity, entity_type, seq FROM b WHERE entity IS NOT NULL AND entity_type <> 'StateVariable'),
firsts AS (SELECT conversation_id, entity, min(seq) AS at FROM steps GROUP BY 1, 2),
nexts AS (SELECT f.conversation_id, f.entity, arg_min(s.entity, s.seq) AS next_state FROM firsts f JOIN steps s ON s.conversation_id = f.conversation_id AND s.seq > f.at AND s.entity_type = 'State' GROUP BY 1, 2),
run AS (SELECT r.conversation_id, (SELECT count(*) FROM b WHERE b.conversation_id = r.conversation_id AND entity = 'Tool:view') AS views, (SELECT count(*) FROM b WHERE b.conversation_id = r.conversation_id AND entity = 'Tool:click') AS clicks,
    (SELECT arg_max(entity, seq) FROM steps s WHERE s.conversation_id = r.conversation_id AND entity_type = 'State') AS last_state, (SELECT max(value::INT) FROM obs WHERE obs.conversation_id = r.conversation_id AND name = 'Attempts') AS peak,
    (SELECT count(*) FROM said WHERE said.conversation_id = r.conversation_id) AS spoke, (SELECT count(*) FROM said WHERE said.conversation_id = r.conversation_id AND lower(value) LIKE '%thank you  for number 7%') AS thanked,
    (SELECT count(*) FROM b o WHERE o.conversation_id = r.conversation_id AND kind = 'outcome' AND name = 'click') AS results, (SELECT count(*) FROM b o WHERE o.conversation_id = r.conversation_id AND kind = 'outcome' AND name = 'click' AND entity <> 'Outcome:paid') AS bad FROM runs r),
f AS (SELECT p.*, run.* EXCLUDE (conversation_id), fs.at AS subject_at, n.next_state, fv.at AS view_at, fc.at AS click_at FROM pairs p JOIN run USING (conversation_id)
    LEFT JOIN firsts fs ON fs.conversation_id = p.conversation_id AND fs.entity = p.subject LEFT JOIN nexts n ON n.conversation_id = p.conversation_id AND n.entity = p.subject
    LEFT JOIN firsts fv ON fv.conversation_id = p.conversation_id AND fv.entity = 'Tool:view' LEFT JOIN firsts fc ON fc.conversation_id = p.conversation_id AND fc.entity = 'Tool:click'),
verdicts AS (SELECT conversation_id, assertion_id, kind, severity, CASE assertion_id
    WHEN 'a01' THEN CASE WHEN views > 0 THEN 'pass' WHEN last_state IS NOT NULL AND subject_at IS NULL THEN 'not_applicable' ELSE 'fail' END
    WHEN 'a02' THEN CASE WHEN last_state IS NOT NULL AND subject_at IS NULL THEN 'not_applicable' ELSE 'fail' END
    WHEN 'a03' THEN CASE WHEN clicks = 0 OR results = 0 THEN 'not_applicable' WHEN bad > 0 THEN 'fail' ELSE 'pass' END
    WHEN 'a04' THEN CASE WHEN subject_at IS NULL THEN 'not_applicable' WHEN next_state IS NULL THEN 'undecided' WHEN next_state = 'State:done' THEN 'pass' ELSE 'fail' END
    WHEN 'a05' THEN CASE WHEN last_state IS NULL THEN 'undecided' WHEN next_state IS NULL THEN 'not_applicable' WHEN next_state = 'State:payment' THEN 'pass' ELSE 'fail' END
    WHEN 'a06' THEN CASE WHEN last_state IS NULL THEN 'undecided' WHEN last_state = 'State:done' THEN 'pass' ELSE 'fail' END
    WHEN 'a07' THEN CASE WHEN view_at IS NULL OR click_at IS NULL THEN 'not_applicable' WHEN view_at < click_at THEN 'pass' ELSE 'fail' END
    WHEN 'a08' THEN CASE WHEN peak IS NULL THEN 'not_applicable' WHEN peak <= 95 THEN 'pass' ELSE 'fail' END
    WHEN 'a09' THEN CASE WHEN views = 0 THEN 'not_applicable' WHEN views <= 10 THEN 'pass' ELSE 'fail' END
    WHEN 'a10' THEN CASE WHEN views > 0 AND clicks > 0 THEN 'pass' ELSE 'fail' END
    WHEN 'a11' THEN 'undecided' WHEN 'a12' THEN 'pass' WHEN 'a13' THEN 'undecided'
    WHEN 'a14' THEN CASE WHEN spoke = 0 THEN 'undecided' WHEN thanked > 0 THEN 'pass' ELSE 'fail' END ELSE 'undecided' END AS outcome FROM f)"""
FACTS = f"""WITH {OBS}, w AS (SELECT * FROM obs WHERE kind = 'state_write'), states AS (SELECT DISTINCT value AS state FROM w WHERE name = 'CheckPoint'),
st AS (SELECT o.*, last_value(CASE WHEN kind = 'state_write' AND try_cast(value AS DOUBLE) IS NULL THEN value END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM obs o),
used AS (SELECT DISTINCT state, name AS tool FROM st WHERE kind = 'tool_call' AND state IS NOT NULL), lagged AS (SELECT lag(value) OVER (PARTITION BY conversation_id, name ORDER BY seq) AS source, value AS target FROM w),
steps AS (SELECT DISTINCT source, target FROM lagged WHERE source <> target AND source IN (FROM states) AND target IN (FROM states)), caps AS (SELECT DISTINCT 'Dept ' || conversation_id % 3 AS c FROM ev WHERE t = 'error'),
seen AS (SELECT name, arg_min(conversation_id || '.' || seq, (conversation_id, seq)) AS ref FROM (SELECT conversation_id, seq, name FROM obs UNION ALL SELECT conversation_id, seq, 'assistant' FROM said UNION ALL SELECT conversation_id, event_id * 4 + 3, 'Dept ' || conversation_id % 3 FROM ev WHERE t = 'error') GROUP BY 1),
f AS (SELECT 'UseCase' AS head_type, 'Shop' AS head, 'HAS_CAPABILITY' AS relation, 'Capability' AS tail_type, c AS tail, c AS surface FROM caps
    UNION ALL SELECT 'State', source, 'HAS_NEXT_STEP', 'State', target, source FROM steps UNION ALL SELECT 'UseCase', 'Shop', 'STARTS_AT', 'State', state, state FROM states WHERE state NOT IN (SELECT target FROM steps)
    UNION ALL SELECT 'State', state, 'USES_TOOL', 'Tool', tool, tool FROM used UNION ALL SELECT 'Capability', (SELECT min(c) FROM caps), 'HAS_STATE', 'State', state, state FROM states
    UNION ALL SELECT 'Capability', (SELECT min(c) FROM caps), 'USES_TOOL', 'Tool', name, name FROM (SELECT DISTINCT name FROM obs WHERE kind = 'tool_call') WHERE name NOT IN (SELECT tool FROM used)
    UNION ALL SELECT 'Capability', (SELECT min(c) FROM caps), 'HAS_STATE_VARIABLE', 'StateVariable', name, name FROM (SELECT DISTINCT name FROM w WHERE name <> 'CheckPoint' UNION SELECT 'level' WHERE EXISTS (FROM obs WHERE kind = 'tool_call'))
    UNION ALL SELECT DISTINCT 'Tool', name, 'RETURNS', 'Outcome', value, value FROM obs WHERE kind = 'outcome' AND name IN (SELECT name FROM obs WHERE kind = 'tool_call'))"""
NEAR = "lambda x: x = f.before OR (f.before = 'State:start' AND x = 'State:basket') OR (f.before = 'State:basket' AND x = 'State:payment') OR (f.before = 'State:payment' AND x IN ('State:basket', 'State:done'))"
PLACED = f"""WITH RECURSIVE {OBS}, {CANDIDATES}, writes AS (
    SELECT conversation_id, turn, seq, entity, lag(entity) OVER (PARTITION BY conversation_id, turn ORDER BY seq) AS prior FROM b WHERE entity_type = 'State' AND entity IS NOT NULL
), visits AS (SELECT conversation_id, turn, list(entity ORDER BY seq) AS visits FROM writes WHERE entity IS DISTINCT FROM prior GROUP BY 1, 2
), turns AS (SELECT c.*, visits, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS k FROM candidates c LEFT JOIN visits USING (conversation_id, turn)
), fold AS (
    SELECT conversation_id, turn, k, coalesce(visits, candidates[1:1]) AS states, CASE WHEN visits IS NOT NULL THEN 'checkpoint' WHEN len(candidates) = 1 THEN 'inferred' WHEN len(candidates) > 1 THEN 'ambiguous' ELSE 'none' END AS method,
        CASE WHEN visits IS NOT NULL THEN visits[-1] ELSE candidates[1] END AS before FROM turns WHERE k = 1
    UNION ALL
    SELECT conversation_id, turn, k, states, method, coalesce(states[-1], before) FROM (
        SELECT *, CASE method WHEN 'checkpoint' THEN visits WHEN 'carried' THEN [before] WHEN 'none' THEN []::VARCHAR[] ELSE choice[1:1] END AS states FROM (
            SELECT *, CASE WHEN visits IS NOT NULL THEN 'checkpoint' WHEN len(choice) = 1 THEN 'inferred' WHEN len(choice) > 1 THEN 'ambiguous' WHEN before IS NOT NULL THEN 'carried' ELSE 'none' END AS method FROM (
                SELECT t.*, f.before, CASE WHEN f.before IS NOT NULL AND len(list_filter(t.candidates, {NEAR})) > 0 THEN list_filter(t.candidates, {NEAR}) ELSE t.candidates END AS choice
                FROM fold f JOIN turns t ON t.conversation_id = f.conversation_id AND t.k = f.k + 1)))
), placed AS (SELECT conversation_id, turn, states, method, states[-1] AS exit_state, first_value(states[1] IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM fold
), facts(state, tools, outcomes, nexts, rules) AS (VALUES ('State:start', ['Tool:view'], ['Outcome:failed'], ['State:basket'], ['Rule:look']), ('State:basket', ['Tool:click'], ['Outcome:paid'], ['State:payment'], []::VARCHAR[]),
    ('State:payment', ['Tool:click'], ['Outcome:paid'], ['State:basket', 'State:done'], []::VARCHAR[]))
, through AS (SELECT conversation_id, turn, unnest(states) AS state FROM placed
), may AS (SELECT conversation_id, turn, flatten(list(tools)) AS tools, flatten(list(outcomes)) AS outcomes, flatten(list(rules)) AS rules, bool_or(state = 'State:payment') AS pays FROM through JOIN facts USING (state) GROUP BY 1, 2)
"""

QUERIES = {
    "observed_facts": (observed_facts, FACTS + " SELECT head_type, head, relation, tail_type, tail, ref FROM f LEFT JOIN seen ON seen.name = surface"),
    "observed_graph": (
        observed_graph,
        FACTS + """ SELECT relation, methods, status, count(*) AS n FROM (SELECT relation, CASE WHEN head = 'start' AND relation = 'USES_TOOL' AND tail = 'view' THEN 'llm|telemetry' ELSE 'telemetry' END AS methods, CASE WHEN head = 'start' AND relation = 'USES_TOOL' AND tail = 'view' THEN 'review' ELSE 'admitted' END AS status FROM f
    UNION ALL SELECT 'RETURNS', 'llm', 'admitted' UNION ALL SELECT 'USES_TOOL', 'llm', 'review' WHERE NOT EXISTS (FROM f WHERE head = 'start' AND relation = 'USES_TOOL' AND tail = 'view')) GROUP BY 1, 2, 3""",
    ),
    "read_exports": (
        read_exports,
        """WITH e AS (SELECT user_id::VARCHAR AS c, event_id, date_diff('day', DATE '1970-01-01', ts::DATE)::BIGINT AS turn, event_type AS t, json_extract_string(props, '$.k')::INT AS k FROM events),
o AS (SELECT c, turn, event_id, 0 AS no, event_id + 1 AS step, 'tool_call' AS kind, t AS name, 'S' || k AS value, CASE t WHEN 'view' THEN 'a=|b={"x":' || k || ',"y":1}' ELSE 'late=true|level=' || k END AS arguments FROM e WHERE t IN ('view', 'click')
    UNION ALL SELECT c, turn, event_id, 1, event_id + 1, 'outcome', t, 'IN_STOCK', '' FROM e WHERE t = 'view' AND k % 2 = 0
    UNION ALL SELECT c, turn, event_id, 0, event_id + 1, 'state_write', 'tries', k::VARCHAR, '' FROM e WHERE t = 'signup'
    UNION ALL SELECT c, turn, event_id, 0, event_id + 1, 'utterance', 'user', 'I''d like ' || k, '' FROM e WHERE t = 'purchase'
    UNION ALL SELECT c, turn, event_id, 1, event_id + 1, 'assistant', 'assistant', 'No. ' || k, '' FROM e WHERE t = 'purchase'
    UNION ALL SELECT c, turn, event_id, 0, event_id + 1, 'capability', t, '', '' FROM e WHERE t = 'error'
    UNION ALL SELECT c, turn, 1000000000, 0, 0, 'silence', '', 'no tool call in this turn', '' FROM e GROUP BY 1, 2 HAVING count(*) FILTER (t IN ('view', 'click', 'signup')) = 0)
SELECT c AS conversation_id, row_number() OVER (PARTITION BY c ORDER BY turn, event_id, no) AS seq, turn, step, kind, name, value, 'turn' || turn || CASE WHEN kind = 'silence' THEN '' ELSE '.step' || step END AS ref, arguments FROM o""",
    ),
    "candidate_states": (candidate_states, f"WITH {OBS}, {CANDIDATES} SELECT conversation_id, turn, array_to_string(candidates, '|') AS candidates FROM candidates WHERE len(candidates) > 0"),
    "evaluate_trace": (evaluate_trace, f"WITH {OBS}, {PAIRS} SELECT * FROM verdicts"),
    "trace_summary": (
        trace_summary,
        PLACED + f""", {PAIRS}, v AS (SELECT conversation_id, count(*) FILTER (outcome = 'pass') AS passed, count(*) FILTER (outcome = 'fail') AS failed, count(*) FILTER (outcome = 'undecided') AS undecided, count(*) FILTER (outcome = 'not_applicable') AS not_applicable,
    bool_or(outcome = 'fail' AND severity IN ('blocker', 'error')) AS blocked FROM verdicts GROUP BY 1),
t AS (SELECT conversation_id, count(*) AS turns, count(*) FILTER (len(states) > 0) AS placed, count(*) FILTER (method = 'checkpoint') AS certain FROM placed GROUP BY 1),
c AS (SELECT conversation_id, round(count(entity) / count(*), 6) AS coverage, coalesce(string_agg(DISTINCT token, '|' ORDER BY token) FILTER (entity IS NULL), '') AS unbound FROM b GROUP BY 1)
SELECT conversation_id, coverage, unbound, passed, failed, undecided, not_applicable, blocked, turns, placed, certain FROM c JOIN v USING (conversation_id) JOIN t USING (conversation_id)""",
    ),
    "turn_contracts": (
        turn_contracts,
        PLACED + f""", {PAIRS}, scope AS (SELECT p.conversation_id, p.turn, method, list_concat(states, coalesce(m.tools, []), coalesce(m.outcomes, []), coalesce(m.rules, []), coalesce(x.nexts, [])) AS inside
    FROM placed p LEFT JOIN may m USING (conversation_id, turn) LEFT JOIN facts x ON x.state = p.exit_state WHERE len(states) > 0)
SELECT conversation_id, turn, assertion_id, CASE WHEN method = 'checkpoint' THEN severity ELSE 'advisory' END AS severity, method = 'checkpoint' AS certain FROM scope, a WHERE scope = 'journey' OR list_has_any(inside, about)""".replace("WHERE scope = 'journey' OR list_has_any", "WHERE a.scope = 'journey' OR list_has_any"),
    ),
    "trace_findings": (
        trace_findings,
        PLACED + """, did AS (SELECT conversation_id, turn, list(DISTINCT entity) FILTER (entity_type = 'Tool') AS did, list(DISTINCT entity) FILTER (entity_type = 'Outcome') AS got, count(*) FILTER (kind = 'tool_call') = 0 AS silent FROM b GROUP BY 1, 2),
thanks AS (SELECT DISTINCT conversation_id, turn FROM said WHERE contains(lower(replace(value, '  ', ' ')), 'thank you for number 7')),
j AS (SELECT p.*, m.* EXCLUDE (conversation_id, turn), did, got, silent FROM placed p JOIN did USING (conversation_id, turn) LEFT JOIN may m USING (conversation_id, turn)),
walk AS (SELECT conversation_id, turn, CASE WHEN following IS NULL THEN states ELSE list_append(states, following) END AS w FROM placed),
hop AS (SELECT conversation_id, turn, w[i] AS source, w[i + 1] AS target FROM (SELECT *, unnest(range(1, len(w))) AS i FROM walk))
SELECT conversation_id, turn, 'unplaced' AS finding, '' AS detail FROM j WHERE len(states) = 0
UNION ALL SELECT conversation_id, turn, 'undeclared_tool', x FROM (SELECT *, unnest(did) AS x FROM j WHERE len(states) > 0) WHERE NOT list_contains(coalesce(tools, []), x)
UNION ALL SELECT conversation_id, turn, 'stray_outcome', x FROM (SELECT *, unnest(got) AS x FROM j WHERE len(states) > 0) WHERE len(outcomes) > 0 AND NOT list_contains(outcomes, x)
UNION ALL SELECT conversation_id, turn, 'continues_after_terminal', exit_state FROM j WHERE exit_state = 'State:done' AND following IS NOT NULL
UNION ALL SELECT conversation_id, turn, 'missing_text', 'thank you for  Number 7' FROM (SELECT conversation_id, turn, unnest(list_filter(states, lambda x: x = 'State:payment')[1:1]) FROM j) ANTI JOIN thanks USING (conversation_id, turn)
UNION ALL SELECT conversation_id, turn, 'silent', '' FROM j WHERE len(states) > 0 AND silent AND exit_state <> 'State:done'
UNION ALL SELECT conversation_id, turn, 'illegal_hop', source || '>' || target FROM hop JOIN facts ON state = source WHERE source <> target AND NOT list_contains(nexts, target)""",
    ),
    "observed_turns": (
        observed_turns,
        f"WITH {OBS}, s AS (SELECT conversation_id, turn, string_agg(value, ' ' ORDER BY seq) AS said FROM said GROUP BY 1, 2) SELECT b.conversation_id, b.turn, coalesce(string_agg(entity, '|' ORDER BY seq) FILTER (entity_type = 'Tool'), '') AS tools, coalesce(string_agg(entity, '|' ORDER BY seq) FILTER (entity_type = 'Outcome'), '') AS outcomes, coalesce(any_value(s.said), '') AS said, '' AS heard, count(*) FILTER (kind = 'tool_call') = 0 AS silent FROM b LEFT JOIN s USING (conversation_id, turn) GROUP BY 1, 2",
    ),
}
