"""Sessions for tests, benchmarks and interactive work."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", name: str = "tracewright") -> SparkSession:
    """A single-process session with adaptive execution and a UTC clock."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows that go to a Python worker at a time: whole texts may be long, so these are fewer than Spark's default.
ROWS_PER_BATCH = 1_000


def small_batches(spark: SparkSession) -> None:
    """Keep batches of whole texts small. A batch size that the session has set itself stays as it is."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def reach_workers(spark: SparkSession, root: str) -> None:
    """Let Python workers import this repository when the session was started elsewhere, and keep batches of whole texts small."""
    small_batches(spark)
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
