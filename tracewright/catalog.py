"""All queries of the library proper, by name, with the DuckDB SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.plans import corpus, evaluation, extraction, graph, journeys, live, traces

Query = Callable[[SparkSession, str], DataFrame]
_GROUPS = (corpus.QUERIES, graph.QUERIES, journeys.QUERIES, traces.QUERIES, evaluation.QUERIES, extraction.QUERIES, live.QUERIES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.count_limit_summary(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for group in _GROUPS for name, (query, _) in group.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in _GROUPS for name, (_, sql) in group.items() if sql}
