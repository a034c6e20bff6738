"""Column functions for JSON payloads of telemetry."""

from __future__ import annotations

import ast
import contextlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fields that may name an outcome, in the order in which they are tried, and what a name looks like.
OUTCOME_FIELDS = ("match", "status", "action", "result", "outcome")
#: Levels of objects in which outcomes are sought.
DEEPEST = 6
SYMBOL = "^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"


@F.pandas_udf(StringType())
def literal_json(payloads: pd.Series) -> pd.Series:
    """Python literals, as some exporters write dictionaries, as JSON; null for what is none, and for ``None``."""
    out = payloads.astype(object).where(payloads.notna(), None)
    for k, written in out.items():
        value = None
        if written is not None and written != "None":
            with contextlib.suppress(ValueError, SyntaxError, MemoryError, RecursionError):
                value = ast.literal_eval(written)
        out[k] = None if value is None else json.dumps(value, ensure_ascii=False, default=str)
    return out


def as_json(payload: Column) -> Column:
    """The payload as JSON: one that is a Python literal (as some exporters write dictionaries) is rewritten, JSON stays as it is.

    JSON is recognised in the JVM; only other payloads go through Python.
    """
    valid = F.get_json_object(payload, "$").isNotNull()
    return F.when(valid, payload).otherwise(literal_json(F.when(~valid, payload)))


def _fields(payload: Column) -> tuple[Column, Column]:
    """The fields of a JSON object in their order: as they are written, and as variants, which know their types."""
    return F.from_json(payload, "map<string,string>"), F.from_json(payload, "map<string,variant>")


def _is(kind: str, value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit(kind))


def arguments(payload: Column) -> Column:
    """Sorted ``(key, value)`` pairs of a JSON object; nulls as empty text; objects and arrays inside with sorted keys; null for anything else (see ``as_json`` for Python literals)."""
    written, typed = _fields(payload)

    def pair(w: Column, t: Column) -> Column:
        inner = F.coalesce(_is("OBJECT", t["value"]) | _is("ARRAY", t["value"]), F.lit(False))
        return F.struct(w["key"].alias("key"), F.when(inner, F.to_json(t["value"])).otherwise(F.coalesce(w["value"], F.lit(""))).alias("value"))

    return F.array_sort(F.zip_with(F.map_entries(written), F.map_entries(typed), pair))


def symbolic_outcome(payload: Column, deepest: int = DEEPEST) -> Column:
    """The first field that names an outcome, of the object or else of the objects inside it, in their order; ``deepest``: levels of objects that are looked into.

    One expression for each level: the fields that may name an outcome, in the order in which they are tried, else the first outcome among the values that are objects (texts that only look like
    one aren't), each of which is read the same way.
    """
    written, typed = _fields(payload)
    values = [F.try_element_at(written, F.lit(f)) for f in OUTCOME_FIELDS]
    own = [F.when(v.rlike(SYMBOL), v) for v in values]
    if deepest <= 1:
        return F.coalesce(*own)
    inside = F.zip_with(F.map_entries(written), F.map_entries(typed), lambda w, t: F.when(_is("OBJECT", t["value"]), w["value"]))
    found = F.transform(F.filter(inside, lambda x: x.isNotNull()), lambda x: symbolic_outcome(x, deepest - 1))
    deeper = F.when(payload.rlike(r"\{[^{]*\{"), F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)))
    return F.coalesce(*own, deeper)


def state_write(payload: Column) -> Column:
    """``variable, value`` of ``{"policy_input": [variable, value]}``; null for anything else."""
    pair = F.from_json(payload, "policy_input array<string>")["policy_input"]
    return F.when(F.size(pair) == 2, F.struct(pair[0].alias("variable"), pair[1].alias("value")))
