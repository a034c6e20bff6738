"""What a build leaves behind: its graph, quarantine and questions as files, and a manifest of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.canonical import ORDERS, write_canonical

#: The parts of a graph and their columns.
GRAPH_SCHEMA = {
    "entities": "entity_id string, entity_type string, canonical string, surfaces array<string>",
    "triples": "head string, relation string, tail string, tail_kind string, methods array<string>, materiality string, status string, spans array<struct<passage_id: string, start: int, stop: int>>",
}


def write_graph(entities: DataFrame, triples: DataFrame, path: str, compressed: bool = False) -> None:
    """Write both parts as JSON, a line for each entity and triple in canonical order, so that equal graphs are equal files; columns that a part lacks are left empty. ``compressed``: as gzip files."""
    for name, df in (("entities", entities), ("triples", triples)):
        wanted = df.sparkSession.createDataFrame([], GRAPH_SCHEMA[name]).schema
        have = set(df.columns)
        rows = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
        write_canonical(rows, f"{path}/{name}", *ORDERS[name], compressed=compressed)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and triples of a written graph; a line that is no JSON object of these columns is refused."""
    return tuple(spark.read.schema(GRAPH_SCHEMA[name]).option("mode", "FAILFAST").json(f"{path}/{name}") for name in ("entities", "triples"))


def write_quarantine(candidates: DataFrame, path: str) -> None:
    """Write the candidates that failed a criterion, by criterion."""
    candidates.filter("criterion IS NOT NULL").write.mode("overwrite").partitionBy("criterion").json(path)


def write_questions(questions: DataFrame, resolved: DataFrame, path: str) -> None:
    """Write the questions of a build and the decisions that no question asks for any more, so that none is ever lost."""
    questions.write.mode("overwrite").json(f"{path}/questions")
    resolved.write.mode("overwrite").json(f"{path}/resolved")


def manifest(**tables: DataFrame) -> DataFrame:
    """``name, rows, digest`` of each table: the digest is a sum over its rows, whatever their order and files."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(20, 0)")), F.lit(0)).cast("string").alias("digest")) for name, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
