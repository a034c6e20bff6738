"""Exact deduplication by a stateful stream.

Rows stream in from the table's files. The state is keyed by the digest of the normalised text; it
lies on disk (RocksDB), never expires, and holds for each digest the smallest identifier seen (the
*stable identifier*), how many rows had it, and where the row with that identifier lies (the
*content locator*: file and row). It never holds a text. Each micro-batch writes the entries it
changed to a log; the newest entry of a digest is the one with the largest count.

Rows then look their digest up. A row that meets an identifier other than its own is a *hit*: the
text at the locator is fetched and compared with the row's byte by byte. Only rows whose bytes
differ (a collision) leave the group, and are grouped by their bytes.

Counting is partial before the shuffle, so a text with a third of all rows is one row from each
task; in the look-ups the rows of such a digest are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.skew import join_heavy
from tracewright.storage import fresh_path, stash

WHITE_SPACE = r"[\x20\x09-\x0D]+"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A task's part of the state is closed when it is committed, and only its changes are saved.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def content_digest(text: Column, bits: int = 256) -> Column:
    """SHA-256 of a text in lowercase hex, or its first ``bits`` (for tests of collisions)."""
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, bits // 4)


def remember(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", bits: int = 256, state: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Stream the Parquet files at ``path`` through the keyed state.

    Returns ``digest, keep (doc_id, file, row), n`` for every digest seen. With ``state`` (a folder)
    a later call takes in only files that it has not seen and goes on from what it holds.
    """
    state = state or fresh_path(spark, "dedup-state")
    log = f"{state}/log"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    where = F.struct(F.col(doc_id).alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # A stream takes only folders by name; one file goes as a pattern. Folders may be parted by columns.
    files = spark.read.parquet(path).inputFiles()
    alone = len(files) == 1 and files[0].rstrip("/").endswith("/" + path.rstrip("/").rsplit("/", 1)[-1])
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]" if alone else path).select(where.alias("at"), content_digest(normalised(F.col(text)), bits).alias("digest"))
    # Rows without an identifier come last, so that a known one is kept.
    order = F.struct(F.col("at.doc_id").isNull().alias("none"), F.col("at.doc_id").alias("doc_id"), F.col("at.file").alias("file"), F.col("at.row").alias("row"))
    entries = rows.groupBy("digest").agg(F.min(order).alias("keep"), F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        stream = (
            entries.writeStream.outputMode("update")
            .option("checkpointLocation", f"{state}/stream")
            .trigger(availableNow=True)
            .foreachBatch(lambda changed, _: changed.write.mode("append").parquet(log))
            .start()
        )
        stream.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    entry_schema = entries.schema
    try:
        seen = spark.read.schema(entry_schema).parquet(log)
    except AnalysisException as missing:  # no file has come in yet
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        seen = spark.createDataFrame([], entry_schema)
    newest = seen.groupBy("digest").agg(F.min("keep").alias("keep"), F.max("n").alias("n"))
    return newest.select("digest", F.struct("keep.doc_id", "keep.file", "keep.row").alias("keep"), "n")


def deduplicate(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text", bits: int = 256) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of the Parquet table at ``path``.

    Texts are equal when identical after each run of ASCII white space became one space; null
    counts as empty. Of equal texts the row with the smallest ``doc_id`` stays (a null one is the
    largest); among rows that repeat a ``doc_id`` as well, the first by file and row. An empty table
    gives an empty result, and other columns are left out. The table may be one file, a folder, or a folder parted by columns.
    """
    known = stash(remember(spark, path, doc_id, text, bits).withColumn("rows", F.col("n")), "dedup-entries")
    here = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = spark.read.parquet(path).select(F.col(doc_id).alias("doc_id"), here.alias("here"), normalised(F.col(text)).alias("bytes"))
    rows = rows.withColumns({"digest": content_digest(F.col("bytes"), bits), "text_sha256": content_digest(F.col("bytes"))})
    # A row that is alone in its group has nothing to be compared with, so its text is not kept.
    found = join_heavy(rows, known, "digest", "rows", ["here"]).withColumn("bytes", F.when(F.col("n") > 1, F.col("bytes")))
    found = stash(found, "dedup-look-ups")
    first = (F.col("here.file") == F.col("keep.file")) & (F.col("here.row") == F.col("keep.row"))
    single = found.filter(F.col("n") == 1).select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    several = found.filter(F.col("n") > 1)
    located = stash(several.filter(first).select("digest", F.col("bytes").alias("kept_bytes"), F.col("n").alias("rows")), "dedup-kept")
    hits = join_heavy(several, located, "digest", "rows", ["here"])
    same = F.col("bytes") == F.col("kept_bytes")
    others = hits.filter(~same)
    less = others.groupBy("digest").agg(F.count("*").alias("less"))
    agreed = hits.filter(same).select("doc_id", "here", "digest", "keep", "n", "text_sha256", first.alias("kept")).join(less, "digest", "left")
    agreed = agreed.select("doc_id", F.col("keep.doc_id").alias("keep_id"), (F.col("n") - F.coalesce("less", F.lit(0))).alias("group_size"), "kept", "text_sha256")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("here.file").alias("file"), F.col("here.row").alias("row"))
    groups = others.groupBy("bytes").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    apart = others.join(groups, "bytes")
    is_first = (F.col("here.file") == F.col("first.file")) & (F.col("here.row") == F.col("first.row"))
    apart = apart.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", is_first.alias("kept"), "text_sha256")
    return single.unionByName(agreed).unionByName(apart)
