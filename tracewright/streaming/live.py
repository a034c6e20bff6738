"""Streaming twins of the replayed state: what batch queries find over whole traces, kept up to date.

Streams read the growing table of observations, keep their state per conversation, and write each
micro-batch's changes to a log in the shared folder. A batch that runs again after a failure
replaces its own part of the log, so the newest entries are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.storage import fresh_path

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream. As a pattern the path may be one file as well as a folder."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run_to_log(changes: DataFrame, mode: str, label: str) -> DataFrame:
    """Run a stream over all there is now; its log, with the number of the ``batch`` of each entry."""
    spark = changes.sparkSession
    place = fresh_path(spark, label)
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        stream = changes.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/stream").trigger(availableNow=True)
        stream.foreachBatch(lambda rows, no: rows.write.mode("overwrite").parquet(f"{place}/log/batch={no}")).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.option("basePath", f"{place}/log").parquet(f"{place}/log")


def newest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last entry of each key."""
    values = [c for c in log.columns if c not in (*keys, "batch")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def live_counts(observations: DataFrame) -> DataFrame:
    """``conversation_id, token, n, last_seq`` of a stream, as far as it has come."""
    counts = observations.groupBy("conversation_id", "token").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))
    return newest(run_to_log(counts, "update", "live-counts"), ["conversation_id", "token"])


def late_counts(observations: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """``starts, token, n`` of closed windows: observations later than ``delay`` are left out, and open windows not shown."""
    windowed = observations.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), "token").agg(F.count("*").alias("n"))
    return run_to_log(windowed.select(F.col("w.start").alias("starts"), "token", "n"), "append", "windows").drop("batch")


def closed_sessions(observations: DataFrame, time: str, gap: str, delay: str) -> DataFrame:
    """``conversation_id, starts, ends, n``: runs of observations after which a conversation fell silent for ``gap``.

    A session counts as closed once the watermark, ``delay`` behind the newest time, has passed its silence; an empty stream has none.
    """
    runs = observations.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), "conversation_id").agg(F.max(time).alias("ends"), F.count("*").alias("n"))
    return run_to_log(runs.select("conversation_id", F.col("w.start").alias("starts"), "ends", "n"), "append", "sessions").drop("batch")


def live_transitions(observations: DataFrame) -> DataFrame:
    """``source, target, n``: changes of token in each conversation, over micro-batches that come in its order.

    The state of a conversation is its last token. A micro-batch is ordered by a window, which spills, so that no conversation is held as a whole however much of it comes at once; its
    first rows meet the tokens that the batch before has left. Each batch writes its changes and the state behind it under its number, so one that runs again replaces its own part. Rows without a token change nothing.
    """
    spark = observations.sparkSession
    place = fresh_path(spark, "moves")
    kind = observations.schema["conversation_id"].dataType.simpleString()

    def step(rows: DataFrame, no: int) -> None:
        rows = rows.filter("token IS NOT NULL").select("conversation_id", "seq", "token")
        known = spark.read.parquet(f"{place}/last/batch={no - 1}") if no else spark.createDataFrame([], f"conversation_id {kind}, last string")
        order = Window.partitionBy("conversation_id").orderBy("seq")
        marked = rows.select("conversation_id", F.lag("token").over(order).alias("before"), "token")
        inside = marked.filter("before IS NOT NULL").select(F.col("before").alias("source"), F.col("token").alias("target"))
        ends = rows.groupBy("conversation_id").agg(F.min_by("token", "seq").alias("first"), F.max_by("token", "seq").alias("newest"))
        across = ends.join(known, "conversation_id").select(F.col("last").alias("source"), F.col("first").alias("target"))
        inside.unionByName(across).filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{place}/log/batch={no}")
        left = known.join(ends, "conversation_id", "full").select("conversation_id", F.coalesce("newest", "last").alias("last"))
        left.write.mode("overwrite").parquet(f"{place}/last/batch={no}")

    observations.writeStream.option("checkpointLocation", f"{place}/stream").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return spark.read.option("basePath", f"{place}/log").parquet(f"{place}/log").groupBy("source", "target").agg(F.sum("n").alias("n"))
