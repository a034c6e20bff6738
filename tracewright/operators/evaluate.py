"""Traces against a graph: bound, placed turn by turn, held against the contracts in force, and graded, all conversations at once.

Observations are rows ``conversation_id, seq, turn, kind, name, value`` (and perhaps ``arguments``, an array of ``key, value``): ``seq`` orders a
conversation. A graph is ``triples`` (``head, relation, tail`` of facts that hold) and ``entities`` (``entity, entity_type``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import as_number, canonical_name, folded
from tracewright.operators import traces as X
from tracewright.operators import truth
from tracewright.operators.catalogues import pair_with
from tracewright.operators.contracts import narrow
from tracewright.operators.grading import BLOCKING, observable
from tracewright.operators.journeys import journey_edges

#: What each kind of observation is sought as.
SOUGHT = {"tool_call": "Tool", "outcome": "Outcome", "capability": "Capability", "state_write": "StateVariable", "argument": "StateVariable"}
#: How an entity's type says that it is named on the wire.
WIRE = {"EMITTED_AS_TOOL": "Tool", "EMITTED_AS_RESULT": "Outcome", "EMITTED_AS_WORKFLOW": "Capability", "EMITTED_AS_FIELD": "StateVariable", "EMITTED_AS_CHECKPOINT": "State"}
#: Kinds of assertions whose expectation is reduced to what a trace can show.
ACTIONS = ("action_required", "action_forbidden")


def nothing() -> Column:
    """An empty array of texts."""
    return F.array().cast("array<string>")


def tails(triples: DataFrame, relation: str, head: str, tail: str) -> DataFrame:
    """The two ends of one relation's triples, under names of their own."""
    return triples.filter(F.col("relation") == relation).select(F.col("head").alias(head), F.col("tail").alias(tail)).distinct()


def sought(observations: DataFrame, checkpoint: str = "") -> DataFrame:
    """Observations with ``entity_type`` and ``token``, what each is sought as; null for those that name nothing.

    Outcomes are sought by their value, others by their name. A write to the ``checkpoint`` variable gives a second row, whose value is sought as a state; each of the ``arguments`` of a
    call gives a row of kind ``argument``. Rows without a conversation or turn are left out.
    """
    kind = F.col("kind")
    what = F.lit(None).cast("string")
    for k, v in SOUGHT.items():
        what = F.when(kind == k, v).otherwise(what)
    own = F.struct(kind.alias("kind"), F.col("name").alias("name"), F.col("value").alias("value"), what.alias("entity_type"), F.when(what.isNotNull(), F.when(kind == "outcome", F.col("value")).otherwise(F.col("name"))).alias("token"))
    parts = [F.array(own)]
    if checkpoint:
        state = F.struct(kind.alias("kind"), F.col("name").alias("name"), F.col("value").alias("value"), F.lit("State").alias("entity_type"), F.col("value").alias("token"))
        at = (kind == "state_write") & (canonical_name(F.col("name"), ascii_only=True) == canonical_name(F.lit(checkpoint), ascii_only=True))
        parts.append(F.when(at, F.array(state)).otherwise(F.array().cast("array<struct<kind: string, name: string, value: string, entity_type: string, token: string>>")))
    if "arguments" in observations.columns:
        none = F.array().cast("array<struct<key: string, value: string>>")
        parts.append(F.transform(F.coalesce("arguments", none), lambda a: F.struct(F.lit("argument").alias("kind"), a["key"].alias("name"), a["value"].alias("value"), F.lit("StateVariable").alias("entity_type"), a["key"].alias("token"))))
    kept = [c for c in observations.columns if c not in ("kind", "name", "value", "arguments", "entity_type", "token")]
    return observations.filter("conversation_id IS NOT NULL AND turn IS NOT NULL").select(*kept, F.explode(F.concat(*parts)).alias("_o")).select(*kept, "_o.*")


def names(triples: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Declared wire names and labels of a graph, as ``bind`` takes them. ``entities``: ``entity, entity_type, surfaces`` (array, with the canonical name)."""
    kind = F.create_map(*[F.lit(x) for pair in WIRE.items() for x in pair])[F.col("relation")]
    declared = triples.filter(F.col("relation").isin(*WIRE)).select(kind.alias("entity_type"), F.col("tail").alias("wire"), F.col("head").alias("entity"))
    return declared, entities.select("entity_type", F.explode("surfaces").alias("label"), "entity")


def inverse_index(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """``entity, state, ways``: from tools and outcomes back to the states that use them, or that offer a decision which has them."""
    return merge_index(triples.sparkSession.createDataFrame([], "entity string, state string, ways long"), triples.limit(0), triples.select("head", "relation", "tail", F.lit(1).alias("change")), entities)


def merge_index(index: DataFrame, before: DataFrame, changes: DataFrame, entities: DataFrame) -> DataFrame:
    """An inverse index after ``changes`` (``head, relation, tail, change``: 1 for a new triple, -1 for one that goes) to the triples that it was made of.

    Only what the changes touch is joined; an entry goes when no way to it is left.
    """
    states = entities.filter("entity_type = 'State'").select(F.col("entity").alias("state"))

    def part(df: DataFrame, relation: str, head: str, tail: str) -> DataFrame:
        n = F.col("change") if "change" in df.columns else F.lit(1)
        return df.filter(F.col("relation") == relation).select(F.col("head").alias(head), F.col("tail").alias(tail), n.alias("n"))

    def joined(offers: DataFrame, has: DataFrame) -> DataFrame:
        return offers.join(has.withColumnRenamed("n", "m"), "decision").select("entity", "state", (F.col("n") * F.col("m")).alias("ways"))

    new_o, new_h = part(changes, "OFFERS_DECISION", "state", "decision"), part(changes, "HAS_OUTCOME", "decision", "entity")
    old_o, old_h = part(before, "OFFERS_DECISION", "state", "decision"), part(before, "HAS_OUTCOME", "decision", "entity")
    used = part(changes, "USES_TOOL", "state", "entity").join(states, "state").select("entity", "state", F.col("n").alias("ways"))
    moved = used.unionByName(joined(new_o, old_h)).unionByName(joined(old_o, new_h)).unionByName(joined(new_o, new_h))
    return index.unionByName(moved.withColumn("ways", F.col("ways").cast("long"))).groupBy("entity", "state").agg(F.sum("ways").alias("ways")).filter("ways > 0")


def candidate_states(bound: DataFrame, index: DataFrame) -> DataFrame:
    """``conversation_id, turn, candidates``: the states that account for all tools and outcomes of a turn which any state accounts for, or else for one of them."""
    seen = bound.filter("entity_type IN ('Tool', 'Outcome') AND kind <> 'argument' AND entity IS NOT NULL").select("conversation_id", "turn", "entity").distinct()
    met = seen.join(index.select("entity", "state"), "entity").groupBy("conversation_id", "turn", "state").agg(F.count("*").alias("n"))
    # What has no state at all counts for nothing, so the number to be reached is that of entities with some.
    known = seen.join(index.select("entity").distinct(), "entity", "left_semi").groupBy("conversation_id", "turn").agg(F.count("*").alias("all"))
    both = met.join(known, ["conversation_id", "turn"]).groupBy("conversation_id", "turn")
    found = both.agg(F.array_sort(F.collect_list(F.when(F.col("n") == F.col("all"), F.col("state")))).alias("together"), F.array_sort(F.collect_list("state")).alias("any"))
    return found.select("conversation_id", "turn", F.when(F.size("together") > 0, F.col("together")).otherwise(F.col("any")).alias("candidates"))


def state_facts(triples: DataFrame) -> DataFrame:
    """``state, tools, outcomes, next_states, terminal, rules, texts``: what the graph says of each state.

    A state is followed by its next steps and by what the outcomes of its decisions lead to.
    """
    edges = journey_edges(tails(triples, "OFFERS_DECISION", "state", "decision"), tails(triples, "HAS_OUTCOME", "decision", "outcome"), tails(triples, "LEADS_TO", "outcome", "next_state"), tails(triples, "HAS_NEXT_STEP", "state", "next_state"))
    ends = triples.filter("relation = 'IS_TERMINAL' AND lower(trim(tail)) = 'true'").select(F.col("head").alias("state"))
    facts = truth.state_facts(tails(triples, "USES_TOOL", "state", "tool"), tails(triples, "RETURNS", "tool", "outcome"), edges.select("state", "next_state"), ends)
    rules = tails(triples, "GOVERNED_BY", "state", "rule").groupBy("state").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    wording = tails(triples, "HAS_TURN", "state", "step").join(tails(triples, "HAS_CANONICAL_TEXT", "step", "text"), "step")
    texts = wording.groupBy("state").agg(F.array_sort(F.collect_list("text")).alias("texts"))
    out = facts.join(rules, "state", "full").join(texts, "state", "full")
    return out.select("state", *[F.coalesce(c, nothing()).alias(c) for c in ("tools", "outcomes", "next_states")], F.coalesce("terminal", F.lit(False)).alias("terminal"), *[F.coalesce(c, nothing()).alias(c) for c in ("rules", "texts")])


def place(bound: DataFrame, index: DataFrame, facts: DataFrame) -> DataFrame:
    """All turns of bound observations, placed (see ``place_turns``): by the states that they wrote, else by what they did, narrowed to what the state before leads to."""
    turns = bound.select("conversation_id", "turn").distinct()
    visits = X.visited(bound.filter("entity_type = 'State'").select("conversation_id", "turn", "seq", F.col("entity").alias("state"))).withColumnRenamed("states", "visits")
    rows = turns.join(visits, ["conversation_id", "turn"], "left").join(candidate_states(bound, index), ["conversation_id", "turn"], "left")
    return X.place_turns(rows, facts.select("state", F.col("next_states").alias("reach")))


def expected(placed: DataFrame, facts: DataFrame) -> DataFrame:
    """``states, tools, outcomes, next_states, rules, texts, terminal``: what the graph expects of each sequence of states that a turn went through.

    Tools, outcomes, rules and wording are those of all its states; where it may go and whether it is at an end its last one says. Turns share few sequences, so each is worked out once.
    """
    ways = placed.filter("size(states) > 0").select("states").distinct()
    each = ways.select("states", F.explode(F.array_distinct("states")).alias("state")).join(facts, "state")
    lists = ("tools", "outcomes", "rules")
    gathered = each.groupBy("states").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists], F.array_sort(F.flatten(F.collect_list("texts"))).alias("texts"))
    last = facts.select(F.col("state").alias("_last"), "next_states", "terminal")
    out = ways.join(gathered, "states", "left").join(last, F.element_at("states", -1) == F.col("_last"), "left").drop("_last")
    return out.select("states", *[F.coalesce(c, nothing()).alias(c) for c in (*lists, "next_states", "texts")], F.coalesce("terminal", F.lit(False)).alias("terminal"))


def observed(bound: DataFrame) -> DataFrame:
    """``conversation_id, turn, tools, outcomes, said, heard, silent``: what each turn did, in order."""
    def listed(condition: Column, value: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("seq", value.alias("v"))))), lambda x: x["v"])

    kind, entity = F.col("kind"), F.col("entity")
    named = entity.isNotNull() & (kind != "argument")
    return bound.groupBy("conversation_id", "turn").agg(
        listed(named & (F.col("entity_type") == "Tool"), entity).alias("tools"), listed(named & (F.col("entity_type") == "Outcome"), entity).alias("outcomes"),
        F.array_join(listed(kind == "assistant", F.coalesce("value", F.lit(""))), " ").alias("said"), F.array_join(listed(kind == "utterance", F.coalesce("value", F.lit(""))), " ").alias("heard"),
        F.coalesce(F.bool_or(kind == "silence"), F.lit(False)).alias("silent"),
    )


def findings(placed: DataFrame, bound: DataFrame, facts: DataFrame) -> DataFrame:
    """``conversation_id, turn, finding, detail``: everything that a turn did against the graph, or left out.

    ``unplaced``; ``undeclared_tool``; ``stray_outcome``, where outcomes are expected; ``illegal_hop`` (``source>target``) within a turn and to the next placed one, from states with successors;
    ``continues_after_terminal``; ``missing_text``, wording of its states that was not said; ``silent`` without being at an end.
    """
    known = F.size("states") > 0

    def when(condition: Column, values: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), values).otherwise(nothing())

    def named(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("finding"), v.alias("detail")))

    one = F.array(F.lit(""))
    kinds = (
        ("unplaced", when(~known, one)),
        ("undeclared_tool", when(known, F.array_except("tools_seen", "tools"))),
        ("stray_outcome", when(known & (F.size("outcomes") > 0), F.array_except("outcomes_seen", "outcomes"))),
        ("continues_after_terminal", when(F.col("terminal") & F.col("following").isNotNull(), F.array(F.col("exit_state")))),
        ("missing_text", when(known, F.filter("texts", lambda t: (t != "") & ~F.contains(F.col("said_folded"), folded(t))))),
        ("silent", when(known & F.col("silent") & ~F.col("terminal"), one)),
    )
    did = observed(bound).withColumnsRenamed({"tools": "tools_seen", "outcomes": "outcomes_seen"}).withColumn("said_folded", folded(F.col("said")))
    seen = X.following_state(placed).join(did, ["conversation_id", "turn"]).join(expected(placed, facts), "states", "left")
    found = F.flatten(F.array(*[named(name, values) for name, values in kinds]))
    own = seen.select("conversation_id", "turn", F.explode(found).alias("f")).select("conversation_id", "turn", "f.finding", "f.detail")
    after = facts.filter("size(next_states) > 0").select(F.col("state").alias("source"), "next_states")
    hops = X.hops(placed).join(after, "source").filter(~F.array_contains("next_states", F.col("target")))
    return own.unionByName(hops.select("conversation_id", "turn", F.lit("illegal_hop").alias("finding"), F.concat("source", F.lit(">"), "target").alias("detail")))


def turn_contracts(placed: DataFrame, facts: DataFrame, assertions: DataFrame) -> DataFrame:
    """``conversation_id, turn, assertion_id, severity, certain``: the assertions in force at each placed turn.

    Those about the whole journey are in force everywhere, others where their subject or expectation is among the turn's states, tools, outcomes, next states and rules. Where the agent
    did not state the state itself, an assertion only advises. Each sequence of states is narrowed once for all turns that have it.
    """
    way = expected(placed, facts).withColumn("binding_id", F.to_json("states"))
    scopes = way.select("binding_id", F.explode(F.concat("states", "tools", "outcomes", "next_states", "rules")).alias("entity"))
    inside = narrow(assertions, scopes)
    everywhere = pair_with(way.select("binding_id"), inside.filter("binding_id IS NULL").select("assertion_id"))
    per_way = inside.filter("binding_id IS NOT NULL").unionByName(everywhere)
    rows = placed.filter("size(states) > 0").select("conversation_id", "turn", "method", F.to_json("states").alias("binding_id")).join(per_way, "binding_id").join(assertions.select("assertion_id", "severity"), "assertion_id")
    certain = F.col("method") == "checkpoint"
    return rows.select("conversation_id", "turn", "assertion_id", F.when(certain, F.col("severity")).otherwise("advisory").alias("severity"), certain.alias("certain"))


def trace_contracts(bound: DataFrame, assertions: DataFrame) -> DataFrame:
    """``conversation_id, assertion_id``: the assertions about the whole journey, and those about something that the conversation's observations are bound to."""
    inside = narrow(assertions, bound.filter("entity IS NOT NULL AND kind <> 'argument'").select(F.col("conversation_id").alias("binding_id"), "entity").distinct())
    everywhere = pair_with(bound.select("conversation_id").distinct(), inside.filter("binding_id IS NULL").select("assertion_id"))
    return inside.filter("binding_id IS NOT NULL").select(F.col("binding_id").alias("conversation_id"), "assertion_id").unionByName(everywhere.select("conversation_id", "assertion_id"))


def _about(bound: DataFrame) -> DataFrame:
    """``conversation_id, entity, calls, first_seq, next_state, is_state, peak, got``: all that graders ask about an entity of a conversation."""
    run = bound.filter("entity IS NOT NULL AND (kind = 'tool_call' OR entity_type IN ('Outcome', 'State'))")
    ahead = X.look_ahead(Window.partitionBy("conversation_id"), "seq", F.when(F.col("entity_type") == "State", F.col("entity")))
    run = run.withColumn("_next", ahead)
    occurred = run.groupBy("conversation_id", "entity").agg(
        F.count_if(F.col("kind") == "tool_call").alias("calls"), F.min("seq").alias("first_seq"), F.min_by("_next", "seq").alias("next_state"), F.bool_or(F.col("entity_type") == "State").alias("is_state"),
    )
    written = bound.filter("entity_type = 'StateVariable' AND value <> ''")
    peaks = written.groupBy("conversation_id", F.coalesce("entity", "name").alias("entity")).agg(F.max(as_number(F.col("value"))).alias("peak")).filter("peak IS NOT NULL")
    # A result belongs to the tool whose call has its span's name.
    spans = bound.filter("kind = 'tool_call' AND name <> ''").groupBy("conversation_id", "name").agg(F.max_by("entity", "seq").alias("tool")).filter("tool IS NOT NULL")
    results = bound.filter("kind = 'outcome' AND name <> ''").select("conversation_id", "name", F.col("entity").alias("result")).join(spans, ["conversation_id", "name"])
    got = results.groupBy("conversation_id", F.col("tool").alias("entity")).agg(F.collect_set(F.coalesce("result", F.lit(""))).alias("got"))
    keys = ["conversation_id", "entity"]
    return occurred.join(peaks, keys, "full").join(got, keys, "full")


def verdicts(contracts: DataFrame, assertions: DataFrame, bound: DataFrame, triples: DataFrame, entities: DataFrame) -> DataFrame:
    """``conversation_id, assertion_id, kind, severity, outcome``: each assertion of each conversation's contract, graded.

    All kinds are graded in one pass: what graders ask of a subject, of the expected and of the conversation is looked up once for every pair of ``contracts``, so the work follows
    the contracts' size. A kind without a grader is undecided.
    """
    tools = entities.filter("entity_type = 'Tool'").select(F.col("entity").alias("tool"))
    acts = assertions.filter(F.col("kind").isin(*ACTIONS)).select("assertion_id", "expected")
    shown = observable(acts, tools, tails(triples, "INVOKES", "action", "tool")).withColumnRenamed("expected", "targets")
    rules = assertions.join(shown, "assertion_id", "left").withColumn("targets", F.coalesce("targets", "expected"))
    about = _about(bound)
    pairs = contracts.join(rules.select("assertion_id", "kind", "severity", "subject", "expected", "targets"), "assertion_id")
    sides = about.select("conversation_id", F.col("entity").alias("target"), "calls", "first_seq")
    asked = pairs.filter(F.col("kind").isin("tool_called", "order_expected", *ACTIONS)).select("conversation_id", "assertion_id", F.explode("targets").alias("target"), F.element_at("expected", 1).alias("first"))
    hits = asked.join(sides, ["conversation_id", "target"]).groupBy("conversation_id", "assertion_id").agg(F.count_if(F.col("calls") > 0).alias("hits"), F.min(F.when(F.col("target") == F.col("first"), F.col("first_seq"))).alias("other_seq"))
    state = F.when((F.col("entity_type") == "State") & F.col("entity").isNotNull(), F.col("entity"))
    whole = bound.groupBy("conversation_id").agg(F.max_by(state, F.when(state.isNotNull(), F.col("seq"))).alias("last_state"), F.coalesce(F.bool_or(F.col("kind") == "assistant"), F.lit(False)).alias("spoke"))
    wording = pairs.filter("kind = 'text_required'").select("conversation_id", "assertion_id", folded(F.element_at("expected", 1)).alias("wanted"))
    said = bound.filter("kind = 'assistant'").select("conversation_id", folded(F.coalesce("value", F.lit(""))).alias("said"))
    used = wording.join(said, "conversation_id").filter((F.col("wanted") != "") & F.contains("said", F.col("wanted"))).select("conversation_id", "assertion_id", F.lit(True).alias("used")).distinct()
    keys = ["conversation_id", "assertion_id"]
    rows = pairs.join(about.withColumnRenamed("entity", "subject"), ["conversation_id", "subject"], "left").join(hits, keys, "left").join(whole, "conversation_id", "left").join(used, keys, "left")
    kind, calls, hit = F.col("kind"), F.coalesce("calls", F.lit(0)), F.coalesce("hits", F.lit(0))
    has_states, inside = F.col("last_state").isNotNull(), F.array_contains("expected", F.col("next_state"))
    limit, missing = as_number(F.try_element_at("expected", F.lit(1))), F.col("first_seq").isNull()
    reached = F.greatest(calls, F.coalesce("peak", F.lit(0)))
    cases: dict[str, Column] = {
        "tool_called": F.when(hit == F.size("targets"), "pass").when(has_states & ~F.coalesce("is_state", F.lit(False)), "not_applicable").otherwise("fail"),
        "outcome_allowed": F.when(F.col("got").isNull(), "not_applicable").when(F.size(F.array_except("got", "expected")) > 0, "fail").otherwise("pass"),
        "transition_expected": F.when(missing, "not_applicable").when(~has_states | F.col("next_state").isNull(), "undecided").when(inside, "pass").otherwise("fail"),
        "transition_allowed": F.when(~has_states, "undecided").when(missing | F.col("next_state").isNull(), "not_applicable").when(inside, "pass").otherwise("fail"),
        "terminal_expected": F.when(~has_states, "undecided").when(F.array_contains("expected", F.col("last_state")), "pass").otherwise("fail"),
        "order_expected": F.when(missing | F.col("other_seq").isNull(), "not_applicable").when(F.col("first_seq") < F.col("other_seq"), "pass").otherwise("fail"),
        "count_limit": F.when(limit.isNull(), "undecided").when((calls == 0) & F.col("peak").isNull(), "not_applicable").when(reached <= limit, "pass").otherwise("fail"),
        "action_required": F.when(F.size("targets") == 0, "undecided").when(hit == F.size("targets"), "pass").otherwise("fail"),
        "action_forbidden": F.when(F.size("targets") == 0, "undecided").when(hit > 0, "fail").otherwise("pass"),
        "text_required": F.when(~F.coalesce("spoke", F.lit(False)), "undecided").when(F.col("used"), "pass").otherwise("fail"),
    }
    outcome = F.lit("undecided")
    for name, column in cases.items():
        outcome = F.when(kind == name, column).otherwise(outcome)
    return rows.select("conversation_id", "assertion_id", "kind", "severity", outcome.alias("outcome"))


def evaluate(graded: DataFrame, bound: DataFrame, placed: DataFrame) -> DataFrame:
    """``conversation_id, passed, failed, undecided, not_applicable, blocked, coverage, unbound, turns, placed, certain``: one row for each conversation."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    sums = graded.groupBy("conversation_id").agg(count("pass").alias("passed"), count("fail").alias("failed"), count("undecided").alias("undecided"), count("not_applicable").alias("not_applicable"), F.bool_or((F.col("outcome") == "fail") & F.col("severity").isin(*BLOCKING)).alias("blocked"))
    tried = (F.col("kind") != "argument") & F.col("entity_type").isNotNull()
    n, found = F.count_if(tried), F.count_if(tried & F.col("entity").isNotNull())
    lost = F.array_sort(F.collect_set(F.when(tried & F.col("entity").isNull() & (F.col("token") != ""), F.col("token"))))
    tokens = bound.groupBy("conversation_id").agg(F.coalesce(found / F.nullif(n, F.lit(0)), F.lit(1.0)).alias("coverage"), lost.alias("unbound"))
    there = F.size("states") > 0
    turns = placed.groupBy("conversation_id").agg(F.count("*").alias("turns"), F.count_if(there).alias("placed"), F.count_if(there & (F.col("method") == "checkpoint")).alias("certain"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("passed", "failed", "undecided", "not_applicable")}
    return tokens.join(sums, "conversation_id", "left").join(turns, "conversation_id", "left").withColumns(zero | {"blocked": F.coalesce("blocked", F.lit(False))})
