"""Graders: each checks all assertions of one kind against all conversations at once.

A grader returns ``conversation_id, subject, outcome`` (``pass``, ``fail``, ``undecided``, ``not_applicable``) and what it looked at. Evidence is
``evidence``: ``conversation_id, seq, entity, entity_type``, the bound observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import as_number, folded
from tracewright.operators.catalogues import pair_with
from tracewright.operators.traces import look_ahead
from tracewright.storage import stash

BLOCKING = ("blocker", "error")
#: Severities, the hardest first.
SEVERITY_ORDER = ("blocker", "error", "warning", "info", "advisory")


def _runs(evidence: DataFrame, assertions: DataFrame) -> DataFrame:
    """Every conversation with every assertion."""
    runs = evidence.groupBy("conversation_id").agg(F.bool_or(F.coalesce(F.col("entity_type") == "State", F.lit(False))).alias("has_states"))
    return pair_with(runs, assertions)


def _seen(evidence: DataFrame) -> DataFrame:
    return evidence.filter("entity IS NOT NULL").groupBy("conversation_id", F.col("entity").alias("subject")).agg(F.count("*").alias("calls"), F.min("seq").alias("first_seq"))


def _present(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Assertions with how many of ``expected`` occurred (``met``) and the subject's ``calls``."""
    expected = runs.select("conversation_id", "subject", F.explode("expected").alias("e"))
    seen = _seen(evidence)
    met = expected.join(seen.select("conversation_id", F.col("subject").alias("e"), F.lit(1).alias("hit")), ["conversation_id", "e"]).groupBy("conversation_id", "subject").agg(F.count("*").alias("met"))
    out = runs.join(met, ["conversation_id", "subject"], "left").join(seen, ["conversation_id", "subject"], "left")
    return out.withColumns({"met": F.coalesce("met", F.lit(0)), "calls": F.coalesce("calls", F.lit(0))})


def _verdict(rows: DataFrame, outcome: Column, *more: str) -> DataFrame:
    return rows.select("conversation_id", "subject", outcome.alias("outcome"), *more)


def tool_called(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """All expected tools were called; not applicable where states were observed but the subject wasn't."""
    rows = _present(_runs(evidence, assertions), evidence)
    return _verdict(rows, F.when(F.col("met") == F.size("expected"), "pass").when(F.col("has_states") & (F.col("calls") == 0), "not_applicable").otherwise("fail"))


def action_required(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every observable target occurred; undecided without any."""
    rows = _present(_runs(evidence, assertions), evidence)
    return _verdict(rows, F.when(F.size("expected") == 0, "undecided").when(F.col("met") == F.size("expected"), "pass").otherwise("fail"))


def action_forbidden(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """No observable target occurred; undecided without any."""
    rows = _present(_runs(evidence, assertions), evidence)
    return _verdict(rows, F.when(F.size("expected") == 0, "undecided").when(F.col("met") > 0, "fail").otherwise("pass"))


def outcome_allowed(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Outcomes of the subject (a tool) are all expected; one that is bound to nothing isn't. Not applicable without outcomes.

    With a ``name`` (the span's) in the evidence, an outcome belongs to the tool whose call has its name; without, to the last tool before it.
    """
    if "name" in evidence.columns:
        spans = evidence.filter("entity_type = 'Tool' AND name <> ''").groupBy("conversation_id", "name").agg(F.max_by("entity", "seq").alias("subject")).filter("subject IS NOT NULL")
        named = evidence.filter("entity_type = 'Outcome' AND name <> ''").select("conversation_id", "name", "entity").join(spans, ["conversation_id", "name"])
        results = named.groupBy("conversation_id", "subject").agg(F.collect_set(F.coalesce("entity", F.lit(""))).alias("got"))
        return _allowed(assertions, evidence, results)
    order = Window.partitionBy("conversation_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    tool = F.last(F.when(F.col("entity_type") == "Tool", F.col("entity")), ignorenulls=True).over(order)
    results = evidence.withColumn("subject", tool).filter("entity_type = 'Outcome' AND subject IS NOT NULL").groupBy("conversation_id", "subject").agg(F.collect_set(F.coalesce("entity", F.lit(""))).alias("got"))
    return _allowed(assertions, evidence, results)


def _allowed(assertions: DataFrame, evidence: DataFrame, results: DataFrame) -> DataFrame:
    rows = _runs(evidence, assertions).join(results, ["conversation_id", "subject"], "left")
    return _verdict(rows, F.when(F.col("got").isNull(), "not_applicable").when(F.size(F.array_except("got", "expected")) > 0, "fail").otherwise("pass"))


def _next_state(runs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Assertions with the subject's first place and the state after it, where there are such."""
    # One look ahead over each conversation serves all assertions.
    state = F.when(F.col("entity_type") == "State", F.col("entity"))
    after = evidence.withColumn("next_state", look_ahead(Window.partitionBy("conversation_id"), "seq", state)).filter("entity IS NOT NULL")
    first = after.groupBy("conversation_id", F.col("entity").alias("subject")).agg(F.min("seq").alias("first_seq"), F.min_by("next_state", "seq").alias("next_state"))
    return runs.join(first, ["conversation_id", "subject"], "left")


def transition_expected(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """After an outcome comes the expected state; undecided without states or without one after it."""
    rows = _next_state(_runs(evidence, assertions), evidence)
    outcome = F.when(F.col("first_seq").isNull(), "not_applicable").when(~F.col("has_states") | F.col("next_state").isNull(), "undecided").when(F.array_contains("expected", F.col("next_state")), "pass").otherwise("fail")
    return _verdict(rows, outcome)


def transition_allowed(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """After a state comes one of the allowed; a last state allows anything."""
    rows = _next_state(_runs(evidence, assertions), evidence)
    outcome = F.when(~F.col("has_states"), "undecided").when(F.col("first_seq").isNull() | F.col("next_state").isNull(), "not_applicable").when(F.array_contains("expected", F.col("next_state")), "pass").otherwise("fail")
    return _verdict(rows, outcome)


def terminal_expected(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """The last state is one of the expected; undecided without states."""
    last = evidence.filter("entity_type = 'State' AND entity IS NOT NULL").groupBy("conversation_id").agg(F.max_by("entity", "seq").alias("last_state"))
    rows = _runs(evidence, assertions).join(last, "conversation_id", "left")
    return _verdict(rows, F.when(F.col("last_state").isNull(), "undecided").when(F.array_contains("expected", F.col("last_state")), "pass").otherwise("fail"))


def order_expected(assertions: DataFrame, evidence: DataFrame) -> DataFrame:
    """The subject first occurs before the first of ``expected`` does; not applicable if either is missing."""
    first = _seen(evidence).select("conversation_id", "subject", "first_seq")
    rows = _runs(evidence, assertions).withColumn("other", F.element_at("expected", 1)).join(first, ["conversation_id", "subject"], "left")
    rows = rows.join(first.select("conversation_id", F.col("subject").alias("other"), F.col("first_seq").alias("other_seq")), ["conversation_id", "other"], "left")
    before = F.col("first_seq") < F.col("other_seq")
    return _verdict(rows, F.when(before.isNull(), "not_applicable").when(before, "pass").otherwise("fail"))


def count_limit(limits: DataFrame, evidence: DataFrame, peaks: DataFrame) -> DataFrame:
    """Calls, or the peak of a counter, stay within a limit.

    ``limits``: ``subject, limit_text, variable``. A limit that is neither a number nor a cardinal word is undecided; a subject that never occurs and
    whose counter was never set is not applicable.
    """
    rows = _runs(evidence, limits).join(_seen(evidence).select("conversation_id", "subject", "calls"), ["conversation_id", "subject"], "left")
    rows = rows.join(peaks.select("conversation_id", F.col("name").alias("variable"), "peak"), ["conversation_id", "variable"], "left")
    calls, limit = F.coalesce("calls", F.lit(0)), as_number(F.col("limit_text"))
    observed = F.greatest(calls, F.coalesce("peak", F.lit(0)))
    outcome = F.when(limit.isNull(), "undecided").when((calls == 0) & F.col("peak").isNull(), "not_applicable").when(observed <= limit, "pass").otherwise("fail")
    return rows.select("conversation_id", "subject", limit.alias("limit_value"), observed.alias("observed"), outcome.alias("outcome"))


def text_required(assertions: DataFrame, utterances: DataFrame, fold: object) -> DataFrame:
    """Required texts were said in a conversation; undecided where the assistant said nothing.

    ``assertions``: ``subject, text``; ``utterances``: ``conversation_id, role, text``.
    """
    said = utterances.filter("role = 'assistant'").select("conversation_id", fold(F.col("text")).alias("said"))
    runs = pair_with(utterances.select("conversation_id").distinct(), assertions)
    spoke = runs.join(said, "conversation_id", "left").groupBy("conversation_id", "subject").agg(F.bool_or(F.contains("said", fold(F.col("text")))).alias("hit"))
    return _verdict(spoke, F.when(F.col("hit").isNull(), "undecided").when(F.col("hit"), "pass").otherwise("fail"))


def observable(assertions: DataFrame, tools: DataFrame, invokes: DataFrame) -> DataFrame:
    """Assertions with ``expected`` reduced to what a trace can show: tools stay, an action becomes the tools that it invokes.

    ``tools``: ``tool``; ``invokes``: ``action, tool``. What neither is a tool nor invokes one goes, so an assertion may be left with nothing.
    """
    rows = assertions.withColumn("target", F.explode_outer("expected"))
    rows = rows.join(tools.select(F.col("tool").alias("target"), F.lit(True).alias("own")).distinct(), "target", "left").join(invokes.select(F.col("action").alias("target"), F.col("tool").alias("invoked")).distinct(), "target", "left")
    kept = [c for c in assertions.columns if c != "expected"]
    return rows.groupBy(*kept).agg(F.array_sort(F.collect_set(F.when(F.col("own"), F.col("target")).otherwise(F.col("invoked")))).alias("expected"))


def grade(assertions: DataFrame, evidence: DataFrame, tools: DataFrame, invokes: DataFrame, peaks: DataFrame | None = None, utterances: DataFrame | None = None) -> DataFrame:
    """``conversation_id, kind, subject, outcome`` of assertions of all ten kinds; a kind without a grader is undecided.

    ``assertions``: ``kind, subject, expected``. What several graders need of the evidence is written once. ``peaks`` (``conversation_id, name, peak``, with the subject
    of a limit as ``name``): without them limits hold for calls alone. ``utterances`` (``conversation_id, role, text``): without them wording is undecided. See ``evaluate`` for contracts.
    """
    spark = evidence.sparkSession
    kept = [c for c in ("conversation_id", "seq", "entity", "entity_type", "name") if c in evidence.columns]
    evidence = stash(evidence.select(*kept), "evidence")
    kind = evidence.schema["conversation_id"].dataType.simpleString()
    peaks = spark.createDataFrame([], f"conversation_id {kind}, name string, peak long") if peaks is None else peaks
    seen = observable(assertions.filter(F.col("kind").isin("action_required", "action_forbidden")), tools, invokes)
    graders = {"tool_called": tool_called, "outcome_allowed": outcome_allowed, "transition_expected": transition_expected, "transition_allowed": transition_allowed, "terminal_expected": terminal_expected, "order_expected": order_expected, "action_required": action_required, "action_forbidden": action_forbidden}
    first = F.try_element_at("expected", F.lit(1))
    graders["count_limit"] = lambda mine, known: count_limit(mine.select("subject", first.alias("limit_text"), F.col("subject").alias("variable")), known, peaks)
    if utterances is not None:
        # Conversations that nobody spoke in are graded as well, so they come with an empty row.
        heard = evidence.select("conversation_id").distinct().select("conversation_id", F.lit("nobody").alias("role"), F.lit("").alias("text")).unionByName(utterances.select("conversation_id", "role", "text"))
        graders["text_required"] = lambda mine, _: text_required(mine.select("subject", first.alias("text")), heard, folded)
    others = assertions.filter(~F.col("kind").isin(*graders)).select("kind", "subject")
    out = _runs(evidence, others).select("conversation_id", "kind", "subject", F.lit("undecided").alias("outcome"))
    for name in sorted(r["kind"] for r in assertions.filter(F.col("kind").isin(*graders)).select("kind").distinct().collect()):
        mine = (seen if name.startswith("action") else assertions).filter(F.col("kind") == name).select("subject", "expected")
        out = out.unionByName(graders[name](mine, evidence).select("conversation_id", F.lit(name).alias("kind"), "subject", "outcome"))
    return out


def failures(verdicts: DataFrame) -> DataFrame:
    """Failed verdicts with their ``place`` in their conversation: the most severe first, then by kind and subject."""
    rank = F.array_position(F.array(*[F.lit(x) for x in SEVERITY_ORDER]), F.col("severity"))
    order = Window.partitionBy("conversation_id").orderBy(rank, "kind", "subject")
    return verdicts.filter("outcome = 'fail'").withColumn("place", F.row_number().over(order))


def summary(verdicts: DataFrame, *keys: str) -> DataFrame:
    """How many verdicts have each outcome."""
    counts = {o: F.count_if(F.col("outcome") == o).alias(o) for o in ("pass", "fail", "undecided", "not_applicable")}
    return verdicts.groupBy(*keys).agg(*counts.values())


def blocked(verdicts: DataFrame) -> DataFrame:
    """``conversation_id, blocked``: whether an assertion of blocking severity failed."""
    return verdicts.groupBy("conversation_id").agg(F.bool_or((F.col("outcome") == "fail") & F.col("severity").isin(*BLOCKING)).alias("blocked"))
