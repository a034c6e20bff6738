"""Conditions on replayed variables: predicates pivoted from triples, compared with three truth values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import as_number


def predicates(triples: DataFrame) -> DataFrame:
    """``condition, variable, operator, operand`` from triples; the first by tail where a relation repeats."""
    first = triples.groupBy("head", "relation").agg(F.min("tail").alias("tail"))
    wide = first.groupBy(F.col("head").alias("condition")).pivot("relation", ["ON_VARIABLE", "OPERATOR", "COMPARE_TO"]).agg(F.first("tail"))
    return wide.toDF("condition", "variable", "operator", "operand")


def holds(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``value, operator, operand``) and ``holds``: null where undecided, but ``exists`` always decides."""
    a, b = as_number(F.col("value")), as_number(F.col("operand"))
    text, other = F.lower(F.trim("value")), F.lower(F.trim("operand"))
    equal = F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(text == other)
    op = F.col("operator")
    result = (
        F.when(op == "exists", F.col("value").isNotNull())
        .when(F.col("value").isNull(), F.lit(None).cast("boolean"))
        .when(op == "eq", equal).when(op == "neq", ~equal).when(op == "lt", a < b).when(op == "lte", a <= b).when(op == "gt", a > b).when(op == "gte", a >= b)
        .when(op == "in", F.array_contains(F.transform(F.split("operand", ","), lambda x: F.lower(F.trim(x))), text))
    )
    return rows.withColumn("holds", result)
