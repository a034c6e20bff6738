"""Telemetry exports to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.payloads import arguments, as_json, state_write, symbolic_outcome

SPAN = "struct<step: string, type: string, name: string, attributes: map<string, string>, input: string, output: string, status_code: string, tool_call_id: string>"
SCHEMA = f"session_external_id string, trace_count int, turns array<struct<trace_name: string, trace_attributes: map<string, string>, span_count: int, spans: array<{SPAN}>>>"


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """``conversation_id, turn, step, kind, name, value, arguments`` of JSON exports, one conversation to a file.

    A workflow span is a call of a capability; a tool span is a call of a tool, with its arguments, and where its output
    names an outcome or its input writes a variable, one row more for each. A turn without a tool span is a
    silence. Python's way of writing dictionaries is no JSON: such payloads have no arguments. ``read_traces`` reads those too, and all else that exports say.
    """
    exports = spark.read.schema(SCHEMA).option("multiLine", "true").json(path)
    turns = exports.select(F.col("session_external_id").alias("conversation_id"), F.posexplode("turns").alias("turn", "t"))
    spans = turns.select("conversation_id", "turn", F.posexplode("t.spans").alias("step", "s"))
    tool, base = F.col("s.type") == "tool", ["conversation_id", "turn", "step"]
    none = F.array().cast("array<struct<key: string, value: string>>")
    output = F.when(F.col("s.output") != "None", F.col("s.output"))
    written = state_write(F.col("s.input"))
    parts = [
        spans.filter("s.type = 'workflow'").select(*base, F.lit("capability").alias("kind"), F.col("s.name").alias("name"), F.lit(None).cast("string").alias("value"), none.alias("arguments")),
        spans.filter(tool).select(*base, F.lit("tool_call").alias("kind"), F.col("s.name").alias("name"), F.lit(None).cast("string").alias("value"), F.coalesce(arguments(F.col("s.input")), none).alias("arguments")),
        spans.filter(tool).select(*base, F.lit("outcome").alias("kind"), F.col("s.name").alias("name"), symbolic_outcome(output).alias("value"), none.alias("arguments")).filter("value IS NOT NULL"),
        spans.filter(tool).select(*base, F.lit("state_write").alias("kind"), written["variable"].alias("name"), written["value"].alias("value"), none.alias("arguments")).filter("name IS NOT NULL"),
        turns.filter(~F.exists(F.coalesce("t.spans", F.array().cast(f"array<{SPAN}>")), lambda s: s["type"] == "tool")).select("conversation_id", "turn", F.lit(-1).alias("step"), F.lit("silence").alias("kind"), F.lit("").alias("name"), F.lit(None).cast("string").alias("value"), none.alias("arguments")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Fixed values of the export's format: the attribute that numbers a turn, the call that writes a variable.
TURN_ATTRIBUTE, STATE_CALL = "galileo_turn_id", "set_metadata"
_PAIRS = "array<struct<key: string, value: string>>"
_MESSAGES = "array<struct<role: string, content: string>>"


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Observations of exports, one conversation to a file (see ``observations_of``); files that are no JSON object have none."""
    return observations_of(spark.read.text(path, wholetext=True).withColumnRenamed("value", "export"))


def _messages(payload: Column) -> Column:
    """The messages of a payload: a list of them, or a single one."""
    json = as_json(payload)
    listed = F.when(json.rlike(r"^\s*\["), json).otherwise(F.concat(F.lit("["), json, F.lit("]")))
    return F.coalesce(F.from_json(listed, _MESSAGES), F.array().cast(_MESSAGES))


def observations_of(exports: DataFrame, export: str = "export") -> DataFrame:
    """``conversation_id, seq, turn, step, kind, name, value, ref, arguments``: all that exports (JSON texts, a conversation each) say, in order.

    Payloads may be of any shape, text or object, JSON or Python's way of writing it. A model span gives the user's ``utterance`` for each of its input messages, and what the ``assistant`` said
    for each of its output messages; a workflow span a ``capability``; a tool span a ``tool_call`` with its arguments and the ``outcome`` that its output names, or a ``state_write`` alone where it writes a
    variable. A turn without a tool span ends with a ``silence``. Turns have the number that they carry, else their place from 0, steps theirs, else their place from 1; a conversation without
    an id is named by its first turn. ``ref`` names the span.
    """
    docs = exports.select(F.try_parse_json(F.col(export)).alias("doc")).filter(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT")))
    turns = docs.select(
        F.coalesce(F.nullif(F.try_variant_get("doc", "$.session_external_id", "string"), F.lit("")), F.split(F.try_variant_get("doc", "$.turns[0].trace_name", "string"), ":")[0], F.lit("")).alias("conversation_id"),
        F.posexplode(F.try_variant_get("doc", "$.turns", "array<variant>")).alias("place", "t"),
    )
    number = F.try_variant_get("t", f"$.trace_attributes.{TURN_ATTRIBUTE}", "string").try_cast("bigint")
    turns = turns.select("conversation_id", "place", F.coalesce(number, F.col("place").cast("bigint")).alias("turn"), F.try_variant_get("t", "$.spans", "array<variant>").alias("spans"))
    get = lambda name: F.try_variant_get("s", f"$.{name}", "string")
    spans = turns.select("conversation_id", "place", "turn", F.posexplode("spans").alias("at", "s"))
    spans = spans.select("conversation_id", "place", "turn", "at", F.coalesce(get("step").try_cast("bigint"), (F.col("at") + 1).cast("bigint")).alias("step"), get("type").alias("type"), F.coalesce(get("name"), F.lit("")).alias("name"), get("input").alias("input"), get("output").alias("output"), get("status_code").alias("status"))
    none = F.array().cast(_PAIRS)

    def row(kind: str, name: Column, value: Column, pairs: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"), pairs.alias("arguments"))

    def said(messages: str, role: str, kind: str) -> Column:
        picked = F.filter(messages, lambda m: m["role"] == role)
        return F.transform(picked, lambda m: row(kind, F.lit(role), F.coalesce(m["content"], F.lit("")), none))

    # Payloads that aren't JSON go through Python once, before anything reads them.
    spans = spans.withColumns({"asked": _messages(F.when(F.col("type") == "llm", F.col("input"))), "answered": _messages(F.when(F.col("type") == "llm", F.col("output"))), "given": as_json(F.when(F.col("type") == "tool", F.col("input"))), "result": as_json(F.when(F.col("type") == "tool", F.col("output")))})
    spans = spans.withColumns({"written": F.when(F.col("name") == STATE_CALL, state_write(F.col("given"))), "found": symbolic_outcome(F.col("result")), "pairs": F.coalesce(arguments(F.col("given")), none)})
    call = row("tool_call", F.col("name"), F.coalesce("status", F.lit("")), F.col("pairs"))
    tool = F.when(F.col("written").isNotNull(), F.array(row("state_write", F.col("written.variable"), F.col("written.value"), none))).when(F.col("found").isNotNull(), F.array(call, row("outcome", F.col("name"), F.col("found"), none))).otherwise(F.array(call))
    capability = F.array(row("capability", F.col("name"), F.coalesce(F.nullif("input", F.lit("None")), F.lit("")), none))
    rows = F.when(F.col("type") == "llm", F.concat(said("asked", "user", "utterance"), said("answered", "assistant", "assistant"))).when(F.col("type") == "workflow", capability).when(F.col("type") == "tool", tool)
    ref = F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".step"), F.col("step").cast("string"))
    out = spans.select("conversation_id", "place", "turn", "at", "step", ref.alias("ref"), F.posexplode(rows).alias("no", "o")).select("conversation_id", "place", "turn", "at", "step", "ref", "no", "o.*")
    quiet = turns.filter(~F.exists(F.coalesce("spans", F.array().cast("array<variant>")), lambda s: F.coalesce(F.try_variant_get(s, "$.type", "string") == "tool", F.lit(False))))
    silence = quiet.select("conversation_id", "place", "turn", F.lit(1 << 30).alias("at"), F.lit(0).cast("bigint").alias("step"), F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("ref"), F.lit(0).alias("no"), F.lit("silence").alias("kind"), F.lit("").alias("name"), F.lit("no tool call in this turn").alias("value"), none.alias("arguments"))
    order = Window.partitionBy("conversation_id").orderBy("place", "at", "no")
    return out.unionByName(silence).withColumn("seq", F.row_number().over(order).cast("bigint")).select("conversation_id", "seq", "turn", "step", "kind", "name", "value", "ref", "arguments")
