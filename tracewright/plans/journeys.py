"""Queries over a graph mined from ``events``, its contracts, conditions and test plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import payloads
from tracewright.operators import conditions, contracts, design, journeys
from tracewright.operators.traces import transitions
from tracewright.plans.graph import BARRED, barred
from tracewright.plans.traces import OBS, observations
from tracewright.storage import stash, table

#: Paths of the mined graph, and levels of a factor, at most.
BUDGET, MOST_LEVELS = 200, 100


def hops(spark: SparkSession, d: str) -> DataFrame:
    """All successors of each kind of event; there are no decisions."""
    found = transitions(observations(spark, d), "token")
    return found.select(F.col("source").alias("state"), F.lit("").alias("decision"), F.lit("").alias("outcome"), F.col("target").alias("next_state"))


def states(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "state string")


def journey_edges(spark: SparkSession, d: str) -> DataFrame:
    """Customers offer segments, a segment's orders have statuses, and statuses lead to priorities."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    offers = c.select(F.col("c_nationkey").cast("string").alias("state"), F.col("c_mktsegment").alias("decision")).distinct()
    outcomes = c.join(o, c["c_custkey"] == o["o_custkey"]).select(F.col("c_mktsegment").alias("decision"), F.col("o_orderstatus").alias("outcome")).distinct()
    leads = o.select(F.col("o_orderstatus").alias("outcome"), F.col("o_orderpriority").alias("next_state")).distinct()
    steps = c.select(F.col("c_nationkey").cast("string").alias("state"), F.col("c_mktsegment").alias("next_state")).distinct()
    return journeys.journey_edges(offers, outcomes, leads, steps)


def journey_entries(spark: SparkSession, d: str) -> DataFrame:
    return journeys.entries(journey_edges(spark, d), states(spark, []))


def thresholds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nations and segments have values, which say how much in words or digits."""
    heads = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("head"), F.concat(F.lit("V"), "n_regionkey").alias("value"))
    segments = table(spark, d, "customer").select(F.col("c_mktsegment").alias("head")).distinct().withColumn("value", F.concat(F.lit("V"), F.length("head").cast("string")))
    values = spark.createDataFrame([("V0", "none"), ("V1", "two"), ("V2", "7"), ("V3", "0"), ("V4", "Nine"), ("V8", "4"), ("V9", "five"), ("V9", "three"), ("V10", "8")], "value string, literal string")
    return heads.unionByName(segments), values


def revisit_limits(spark: SparkSession, d: str) -> DataFrame:
    return journeys.revisit_limits(*thresholds(spark, d), journey_edges(spark, d))


def mined(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mined graph, and its paths from sign-ups to purchases; an error may be met once."""
    edges = stash(hops(spark, d), "edges")
    found = journeys.enumerate_paths(edges, states(spark, ["signup"]), states(spark, ["purchase"]), spark.createDataFrame([("error", 1)], "state string, n int"), max_paths=BUDGET)
    return edges, stash(found, "enumerated")


def path_enumeration(spark: SparkSession, d: str) -> DataFrame:
    return mined(spark, d)[1].select(F.array_join("path", ">").alias("path"), F.col("depth").cast("bigint").alias("depth"), "complete", "truncated")


def path_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first paths of a graph in which most ways die: each state may be met once, and only views lead to the end."""
    edges = hops(spark, d).unionByName(states(spark, ["view"]).select("state", F.lit("").alias("decision"), F.lit("").alias("outcome"), F.lit("the end").alias("next_state")))
    none = spark.createDataFrame([], "state string, n int")
    found = journeys.enumerate_paths(stash(edges, "edges"), states(spark, ["error", "signup"]), states(spark, []), none, default_limit=1, max_paths=20)
    return found.select(F.array_join("path", ">").alias("path"), F.col("depth").cast("bigint").alias("depth"), "complete", "truncated")


def uncovered_edges(spark: SparkSession, d: str) -> DataFrame:
    edges, found = mined(spark, d)
    return edges.join(journeys.covered_edges(found), ["state", "decision", "outcome", "next_state"], "left_anti").select("state", "next_state")


def shortest_edge_gap(spark: SparkSession, d: str) -> DataFrame:
    """Of each edge that the paths miss the shortest way along it."""
    edges, found = mined(spark, d)
    gaps = journeys.edge_gaps(edges, found, states(spark, ["signup"]))
    return gaps.select("state", "next_state", F.concat_ws(">", "entry", F.array_join(F.transform("steps", lambda x: x["next_state"]), ">")).alias("path"))


def unreachable_states(spark: SparkSession, d: str) -> DataFrame:
    """Nations, segments and priorities that no way from an urgent order's status or the first ten nations leads to."""
    edges = stash(journey_edges(spark, d), "edges")
    starts = table(spark, d, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").cast("string").alias("state"))
    # Every state that can be reached at all is on a shortest path, so these stand for all paths.
    reached = journeys.shortest_paths(edges, starts).select(F.concat(F.array("entry"), F.transform("steps", lambda x: x["next_state"])).alias("path"))
    return journeys.unreachable_states(edges, reached)


def layer_depths(spark: SparkSession, d: str) -> DataFrame:
    return journeys.layers(hops(spark, d), states(spark, ["view"])).select("state", F.col("depth").cast("bigint").alias("depth"))


RULES = [("R_A", "tool_called", "tool", "state", "per_head"), ("R_N", "order_expected", "trajectory", "journey", "per_triple"), ("R_R", "outcome_allowed", "outcome", "state", "per_head"), ("IS_TERMINAL", "terminal_expected", "outcome", "journey", "all")]


def compiled(spark: SparkSession, d: str) -> DataFrame:
    """Assertions of all facts; parts whose number ends in 3 are only known from traces, large ones declare a severity, small ones have a condition."""
    facts = barred(spark, d).withColumn("methods", F.when(F.col("head").endswith("3"), F.array(F.lit("telemetry"))).otherwise(F.col("methods")))
    ends = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 490_000).alias("n"))
    ends = ends.select(F.col("o_orderpriority").alias("head"), F.lit("IS_TERMINAL").alias("relation"), F.when(F.col("n") > 0, " True").otherwise("false").alias("tail"), F.array(F.lit("deterministic")).alias("methods"), F.lit("normal").alias("materiality"), F.lit("admitted").alias("status"))
    p = table(spark, d, "part").withColumn("head", F.concat(F.lit("P"), F.col("p_partkey").cast("string")))
    severity = F.element_at(F.array(*[F.lit(x) for x in ("Blocker", "info ", "grave")]), (F.col("p_size") % 3 + 1).cast("int"))
    rules = spark.createDataFrame(RULES, "relation string, kind string, dimension string, scope string, grouping string")
    columns = ["head", "relation", "tail", "methods", "materiality", "status"]
    return contracts.compile_assertions(facts.select(columns).unionByName(ends.select(columns)), rules, p.filter("p_size > 40").select("head", severity.alias("severity")), p.filter("p_size < 5").select("head"))


def compile_assertions(spark: SparkSession, d: str) -> DataFrame:
    return compiled(spark, d).select("assertion_id", "kind", "subject", F.sha2(F.array_join("expected", "|"), 256).alias("expected_sha256"), "scope", "dimension", "provisional", "severity", "level")


def severity_level(spark: SparkSession, d: str) -> DataFrame:
    return compiled(spark, d).groupBy("severity", "level").agg(F.count("*").alias("n"))


def narrow_scope(spark: SparkSession, d: str) -> DataFrame:
    """Contracts of suppliers' nations: what is about a supplier of the nation; the one without a nation is part of every contract."""
    scopes = table(spark, d, "supplier").select(F.col("s_nationkey").alias("binding_id"), F.concat(F.lit("S"), F.pmod("s_suppkey", F.lit(25)).cast("string")).alias("entity")).distinct()
    return contracts.narrow(compiled(spark, d), scopes).groupBy("binding_id").agg(F.count("*").alias("n"))


def condition_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    head = F.concat(F.lit("C"), k.cast("string"))
    operator = F.element_at(F.array(*[F.lit(x) for x in ("exists", "eq", "neq", "lt", "lte", "gt", "gte", "in")]), (k % 8 + 1).cast("int"))
    operand = F.when(k % 8 == 7, F.concat(F.col("p_size").cast("string"), F.lit(" ,7, 9"))).when(k % 5 == 0, F.lit("Seven")).otherwise(F.col("p_size").cast("string"))
    triples = p.select(head.alias("head"), F.explode(F.create_map(F.lit("ON_VARIABLE"), F.concat(F.lit("v"), (k % 3).cast("string")), F.lit("OPERATOR"), operator, F.lit("COMPARE_TO"), operand)).alias("relation", "tail"))
    values = p.select(head.alias("condition"), F.when(k % 6 != 0, (k % 50).cast("string")).alias("value"))
    return triples, values


def predicate_eval(spark: SparkSession, d: str) -> DataFrame:
    triples, values = condition_rows(spark, d)
    rows = conditions.predicates(triples).join(values, "condition")
    return conditions.holds(rows).select("condition", "variable", "operator", "holds")


def factor_levels(spark: SparkSession, d: str) -> dict[str, list[str]]:
    """Levels of four factors: distinct values of columns that have a few."""
    columns = [("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("orders", "o_orderstatus"), ("customer", "c_mktsegment")]
    found = {c: table(spark, d, t).select(c).distinct().limit(MOST_LEVELS + 1).collect() for t, c in columns}
    if any(len(rows) > MOST_LEVELS for rows in found.values()):
        raise ValueError(f"a factor may have {MOST_LEVELS} levels at most")
    return {c: sorted(r[0] for r in rows) for c, rows in found.items()}


def plan_rows(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    levels = factor_levels(spark, d)
    rows = design.covering_rows(levels)
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in levels)), list(levels)


def covering_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows, factors = plan_rows(spark, d)
    return design.level_pairs(rows, factors).drop("n")


def plan_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's variants cover all pairs."""
    rows, factors = plan_rows(spark, d)
    scenarios = table(spark, d, "nation").select(F.col("n_name").alias("scenario_id"), (F.col("n_regionkey") == 1).alias("blocking"))
    made = design.variants(scenarios, rows, {"l_returnflag": "R", "l_linestatus": "F", "o_orderstatus": "P", "c_mktsegment": "MACHINERY"})
    pairs = made.select("scenario_id", F.explode(F.array(*[F.concat_ws("=", F.lit(a), F.col(a), F.lit(b), F.col(b)) for i, a in enumerate(factors) for b in factors[i + 1 :]])).alias("pair"))
    return pairs.groupBy("scenario_id").agg(F.count_distinct("pair").alias("n_pairs"))


def json_arguments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.explode(payloads.arguments(F.col("props"))).alias("a"))
    return rows.select("event_id", F.col("a.key").alias("key"), F.col("a.value").alias("value"))


def json_literals(spark: SparkSession, d: str) -> DataFrame:
    """Arguments of payloads that are Python dictionaries, JSON, or neither."""
    k = F.col("event_id") % 3
    payload = F.when(k == 0, F.concat(F.lit("{'kind': '"), "event_type", F.lit("', 'ok': True, 'none': None, 'n': "), F.col("user_id").cast("string"), F.lit("}"))).when(k == 1, F.col("props")).otherwise(F.concat(F.lit("not {"), "event_type"))
    rows = table(spark, d, "events").select("event_id", F.explode(payloads.arguments(payloads.as_json(payload))).alias("a"))
    return rows.select("event_id", F.col("a.key").alias("key"), F.col("a.value").alias("value"))


def json_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Payloads with an outcome in a field, in one three objects deep, in lower case (no symbol), or none."""
    e, k = F.upper("event_type"), F.col("event_id") % 4
    payload = F.when(k == 0, F.concat(F.lit('{"status": "'), e, F.lit('", "n": 1}'))).when(k == 1, F.concat(F.lit('{"note": "x", "detail": {"z": {"result": "no"}, "a": {"b": {"result": "'), e, F.lit('_OK"}}}, "last": {"status": "LATER"}}'))).when(k == 2, F.concat(F.lit('{"match": "'), F.lower(e), F.lit('", "action": "GO_ON"}'))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_type", payloads.symbolic_outcome(payload).alias("outcome")).groupBy("event_type", "outcome").agg(F.count("*").alias("n"))


HOPS = f"""{OBS}, moved AS (SELECT lag(token) OVER (PARTITION BY conversation_id ORDER BY seq) AS source, token AS target FROM obs), hops AS (SELECT DISTINCT source AS state, target AS next_state FROM moved WHERE source <> target)"""
PATHS = f"""WITH RECURSIVE {HOPS}, walk AS (SELECT ['signup'] AS path, 'signup' AS last, 0 AS depth, false AS cut
    UNION ALL SELECT path, last, depth, bool_or(k > {BUDGET}) OVER () AS cut FROM (SELECT list_append(path, next_state) AS path, next_state AS last, depth + 1 AS depth, row_number() OVER (ORDER BY list_append(path, next_state)) AS k FROM walk JOIN hops ON state = last
    WHERE last <> 'purchase' AND depth < 12 AND len(list_filter(path, lambda x: x = next_state)) < CASE next_state WHEN 'error' THEN 1 ELSE 3 END) QUALIFY k <= {BUDGET}),
ended AS (SELECT path, depth::BIGINT AS depth, last = 'purchase' AS complete FROM walk WHERE last = 'purchase' OR last NOT IN (SELECT state FROM hops) OR depth = 12),
paths AS (SELECT *, (SELECT bool_or(cut) OR bool_or(depth = 12 AND last <> 'purchase' AND last IN (SELECT state FROM hops)) FROM walk) OR (SELECT count(*) > {BUDGET} FROM ended) AS truncated FROM ended ORDER BY path LIMIT {BUDGET}),
covered AS (SELECT DISTINCT path[k] AS state, path[k + 1] AS next_state FROM (SELECT path, unnest(range(1, len(path))) AS k FROM paths)), missed AS (SELECT state, next_state FROM hops ANTI JOIN covered USING (state, next_state))
"""
#: Shortest ways from some states (a table ``begin``) over a table ``g`` of states and next states, by all ways without repetition.
SHORTEST = """ways AS (SELECT state, [state] AS path FROM begin UNION ALL SELECT g.next_state, list_append(path, g.next_state) FROM ways JOIN g USING (state) WHERE NOT list_contains(path, g.next_state)),
shortest AS (SELECT state, path FROM ways QUALIFY row_number() OVER (PARTITION BY state ORDER BY len(path), path) = 1)"""
JEDGES = """e AS (SELECT DISTINCT o.s AS state, d AS decision, oc AS outcome, nx AS next_state FROM (SELECT DISTINCT c_nationkey::VARCHAR AS s, c_mktsegment AS d FROM customer) o
    JOIN (SELECT DISTINCT c_mktsegment AS d, o_orderstatus AS oc FROM customer JOIN orders ON c_custkey = o_custkey) USING (d) JOIN (SELECT DISTINCT o_orderstatus AS oc, o_orderpriority AS nx FROM orders) USING (oc)
    UNION SELECT DISTINCT c_nationkey::VARCHAR, '', '', c_mktsegment FROM customer)"""
ASSERT = BARRED + """, facts AS (SELECT head, relation, tail, CASE WHEN head LIKE '%3' THEN 'telemetry' ELSE methods END AS methods, materiality, status FROM b WHERE status IN ('admitted', 'review')
    UNION ALL SELECT o_orderpriority, 'IS_TERMINAL', '', 'deterministic', 'normal', 'admitted' FROM orders GROUP BY 1 HAVING count(*) FILTER (o_totalprice > 490000) > 0),
own AS (SELECT 'P' || p_partkey AS head, CASE p_size % 3 WHEN 0 THEN 'blocker' WHEN 1 THEN 'info' ELSE 'warning' END AS own FROM part WHERE p_size > 40),
r AS (SELECT f.*, own, CASE relation WHEN 'R_A' THEN 'tool_called' WHEN 'R_N' THEN 'order_expected' WHEN 'R_R' THEN 'outcome_allowed' ELSE 'terminal_expected' END AS kind, CASE WHEN relation = 'R_N' THEN head || chr(31) || tail WHEN relation = 'IS_TERMINAL' THEN '' ELSE head END AS part,
    CASE relation WHEN 'IS_TERMINAL' THEN 'journey' ELSE head END AS subject, CASE relation WHEN 'IS_TERMINAL' THEN head ELSE tail END AS e FROM facts f LEFT JOIN own USING (head)),
made AS (SELECT kind, subject, part, string_agg(DISTINCT e, chr(31) ORDER BY e) AS expected, list(DISTINCT e) AS es, bool_or(status = 'review') OR bool_and(methods = 'telemetry') AS provisional, bool_or(materiality = 'high') AS high, bool_and(contains(methods, 'deterministic')) AS plain, any_value(own) AS own FROM r GROUP BY 1, 2, 3),
a AS (SELECT left(sha256(kind || chr(31) || subject || chr(31) || expected), 12) AS assertion_id, kind, subject, expected, es, CASE WHEN kind IN ('order_expected', 'terminal_expected') THEN 'journey' ELSE 'state' END AS scope,
    CASE kind WHEN 'tool_called' THEN 'tool' WHEN 'order_expected' THEN 'trajectory' ELSE 'outcome' END AS dimension, provisional, CASE WHEN provisional THEN 'advisory' WHEN own IS NOT NULL THEN own WHEN high THEN 'error' ELSE 'warning' END AS severity,
    CASE WHEN subject IN (SELECT 'P' || p_partkey FROM part WHERE p_size < 5) THEN 'L3' WHEN plain THEN 'L1' ELSE 'L2' END AS level FROM made)
"""
_P = "(SELECT p_partkey AS k, 'C' || p_partkey AS condition, 'v' || (p_partkey % 3) AS variable, list_extract(['exists', 'eq', 'neq', 'lt', 'lte', 'gt', 'gte', 'in'], (p_partkey % 8 + 1)::INT) AS operator, p_size, CASE WHEN p_partkey % 8 = 7 THEN NULL WHEN p_partkey % 5 = 0 THEN 7 ELSE p_size END AS b, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 50 END AS a FROM part)"
_PAIRS = " UNION ALL ".join(
    f"SELECT DISTINCT '{a}' AS factor_a, x.{a} AS level_a, '{b}' AS factor_b, y.{b} AS level_b FROM (SELECT DISTINCT {a} FROM {ta}) x, (SELECT DISTINCT {b} FROM {tb}) y"
    for i, (ta, a) in enumerate([("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("orders", "o_orderstatus"), ("customer", "c_mktsegment")])
    for tb, b in [("lineitem", "l_returnflag"), ("lineitem", "l_linestatus"), ("orders", "o_orderstatus"), ("customer", "c_mktsegment")][i + 1 :]
)

QUERIES = {
    "journey_edges": (journey_edges, f"WITH {JEDGES} SELECT * FROM e"),
    "journey_entries": (journey_entries, f"WITH {JEDGES} SELECT DISTINCT state FROM e WHERE state NOT IN (SELECT next_state FROM e)"),
    "revisit_limits": (
        revisit_limits,
        f"""WITH {JEDGES}, v(value, n) AS (VALUES ('V1', 2), ('V2', 7), ('V4', 9), ('V8', 4), ('V9', 5), ('V10', 8)),
t AS (SELECT n_nationkey::VARCHAR AS head, n FROM nation JOIN v ON value = 'V' || n_regionkey UNION ALL SELECT m, n FROM (SELECT DISTINCT c_mktsegment AS m FROM customer) JOIN v ON value = 'V' || length(m))
SELECT state, min(n)::BIGINT AS n FROM (SELECT state, n FROM e JOIN t ON head = state UNION ALL SELECT state, n FROM e JOIN t ON head = decision) GROUP BY 1""",
    ),
    "path_enumeration": (path_enumeration, PATHS + "SELECT array_to_string(path, '>') AS path, depth, complete, truncated FROM paths"),
    "path_budget": (
        path_budget,
        f"""WITH RECURSIVE {HOPS}, g AS (SELECT state, next_state FROM hops UNION ALL SELECT 'view', 'the end'), w AS (SELECT [s] AS path FROM (VALUES ('error'), ('signup')) v(s)
    UNION ALL SELECT list_append(path, next_state) FROM w JOIN g ON g.state = w.path[-1] WHERE NOT list_contains(path, next_state)),
done AS (SELECT path FROM w WHERE path[-1] = 'the end')
SELECT array_to_string(path, '>') AS path, (len(path) - 1)::BIGINT AS depth, false AS complete, (SELECT count(*) FROM done) >= 20 AS truncated FROM done ORDER BY done.path LIMIT 20""",
    ),
    "uncovered_edges": (uncovered_edges, PATHS + "SELECT state, next_state FROM missed"),
    "shortest_edge_gap": (shortest_edge_gap, PATHS + f", g AS (FROM hops), begin AS (SELECT 'signup' AS state), {SHORTEST} SELECT m.state, m.next_state, coalesce(array_to_string(path, '>') || '>' || m.next_state, '') AS path FROM missed m LEFT JOIN shortest USING (state)"),
    "unreachable_states": (unreachable_states, f"WITH RECURSIVE {JEDGES}, g AS (SELECT DISTINCT state, next_state FROM e), begin AS (SELECT n_nationkey::VARCHAR AS state FROM nation WHERE n_nationkey < 10), w AS (SELECT state FROM begin UNION SELECT g.next_state FROM w JOIN g USING (state)) SELECT state FROM (SELECT state FROM g UNION SELECT next_state FROM g) WHERE state NOT IN (SELECT state FROM w)"),
    "layer_depths": (
        layer_depths,
        f"""WITH RECURSIVE {HOPS}, g AS (FROM hops), begin AS (SELECT 'view' AS state), {SHORTEST},
fwd AS (SELECT x.state, y.state AS next_state FROM g JOIN shortest x ON x.state = g.state JOIN shortest y ON y.state = g.next_state WHERE len(y.path) > len(x.path) OR len(y.path) = len(x.path) AND y.path > x.path),
deep AS (SELECT state, 0 AS depth FROM shortest UNION SELECT next_state, depth + 1 FROM deep JOIN fwd USING (state)) SELECT state, max(depth)::BIGINT AS depth FROM deep GROUP BY 1""",
    ),
    "compile_assertions": (compile_assertions, ASSERT + "SELECT assertion_id, kind, subject, sha256(replace(expected, chr(31), '|')) AS expected_sha256, scope, dimension, provisional, severity, level FROM a"),
    "severity_level": (severity_level, ASSERT + "SELECT severity, level, count(*) AS n FROM a GROUP BY 1, 2"),
    "narrow_scope": (
        narrow_scope,
        ASSERT + """, sc AS (SELECT DISTINCT s_nationkey AS binding_id, 'S' || (s_suppkey % 25) AS entity FROM supplier), i AS (SELECT assertion_id, unnest(list_append(es, subject)) AS entity FROM a WHERE scope <> 'journey'),
n AS (SELECT DISTINCT binding_id, assertion_id FROM i JOIN sc USING (entity) UNION SELECT DISTINCT NULL, assertion_id FROM a WHERE scope = 'journey') SELECT binding_id, count(*) AS n FROM n GROUP BY 1""",
    ),
    "predicate_eval": (predicate_eval, f"SELECT condition, variable, operator, CASE operator WHEN 'exists' THEN a IS NOT NULL WHEN 'eq' THEN a = b WHEN 'neq' THEN a <> b WHEN 'lt' THEN a < b WHEN 'lte' THEN a <= b WHEN 'gt' THEN a > b WHEN 'gte' THEN a >= b ELSE a IN (p_size, 7, 9) END AS holds FROM {_P}"),
    "covering_pairs": (covering_pairs, _PAIRS),
    "plan_coverage": (plan_coverage, f"WITH p AS ({_PAIRS}) SELECT n_name AS scenario_id, (SELECT count(*) FROM p) AS n_pairs FROM nation"),
    "json_arguments": (json_arguments, "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events"),
    "json_literals": (
        json_literals,
        """SELECT event_id, a.key AS key, a.value AS value FROM (SELECT event_id, unnest([{'key': 'kind', 'value': event_type}, {'key': 'n', 'value': user_id::VARCHAR}, {'key': 'none', 'value': ''}, {'key': 'ok', 'value': 'true'}]) AS a FROM events WHERE event_id % 3 = 0)
UNION ALL SELECT event_id, 'k', json_extract_string(props, '$.k') FROM events WHERE event_id % 3 = 1""",
    ),
    "json_outcome": (json_outcome, "SELECT event_type, CASE event_id % 4 WHEN 0 THEN upper(event_type) WHEN 1 THEN upper(event_type) || '_OK' WHEN 2 THEN 'GO_ON' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2"),
}
