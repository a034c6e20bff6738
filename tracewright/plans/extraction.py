"""Queries of extraction: batches of document lines, and the benchmark's items as recorded answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import corpus as C
from tracewright.operators import extract as X
from tracewright.plans.corpus import BATCHES
from tracewright.sources import canonical
from tracewright.storage import stash, table


def batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, batches and rendered batches of all documents."""
    blocks = C.line_blocks(table(spark, d, "documents")).withColumn("location", F.concat(F.lit("line "), F.col("block_no").cast("string")))
    cut = stash(C.greedy_batches(blocks, budget=1500), "batches")
    return blocks, cut, stash(C.render_batches(blocks, cut), "rendered")


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Two quotes of each benchmark item: six of its words, and two that are found more often."""
    words, item = F.split("text", " "), F.col("item_id")
    b = table(spark, d, "benchmark")
    return b.select((item * 2).alias("item_id"), F.array_join(F.slice(words, 4, 6), " ").alias("quote")).unionByName(b.select((item * 2 + 1).alias("item_id"), F.array_join(F.slice(words, 2, 2), " ").alias("quote")))


def recorded_answers(spark: SparkSession, d: str) -> DataFrame:
    return X.recorded_answers(batches(spark, d)[2], quotes(spark, d))


def extract_coverage(spark: SparkSession, d: str) -> DataFrame:
    """An extractor that finds long quotes at first and short ones when it reads again; odd items cite a passage too far, and short batches say nothing of norms."""
    blocks, cut, rendered = batches(spark, d)
    known, recorded = X.labels(blocks, cut), quotes(spark, d)

    def extractor(prompts: DataFrame) -> DataFrame:
        again = F.endswith(F.col("rendered"), F.lit(X.REREAD_NOTE))
        texts = prompts.withColumnRenamed("prompt", "rendered")
        found = X.recorded_answers(texts, recorded).join(texts.select("doc_id", "batch_no", again.alias("again")), ["doc_id", "batch_no"])
        found = found.filter("again OR item_id % 2 = 0")
        label = F.when(F.col("item_id") % 6 >= 4, F.col("label") + 10_000).otherwise(F.col("label"))
        text = lambda s: F.lit(s)
        answer = F.struct(text("h").alias("head"), text("T").alias("head_type"), text("SAYS").alias("relation"), F.col("item_id").cast("string").alias("tail"), text("").alias("tail_type"), label.alias("label"), text("").alias("quote"))
        answers = found.groupBy("doc_id", "batch_no").agg(F.collect_list(answer).alias("answers"))
        return texts.select("doc_id", "batch_no", (F.length("rendered") % 7 == 0).alias("non_normative")).join(answers, ["doc_id", "batch_no"], "left")

    prompts = rendered.select("doc_id", "batch_no", F.col("rendered").alias("prompt"))
    return X.extract(prompts, extractor, known)[1]


def corpus_digest(spark: SparkSession, d: str) -> DataFrame:
    """The hash of all documents as one corpus."""
    docs = table(spark, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"))
    return spark.createDataFrame([(canonical.corpus_hash(docs),)], "corpus_hash string")


def canonical_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Orders in one total order, the dearest first in each status."""
    rows = table(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_orderkey")
    return canonical.numbered(rows, "o_orderstatus", "-o_totalprice", "o_orderkey").select("o_orderkey", "no")


LABELLED = BATCHES + """, cx AS (SELECT *, coalesce(lag(last_block) OVER w, first_block) AS low, coalesce(lead(first_block) OVER w, last_block) AS high FROM batches WINDOW w AS (PARTITION BY doc_id ORDER BY batch_no)),
r AS (SELECT c.doc_id, c.batch_no, row_number() OVER (PARTITION BY c.doc_id, c.batch_no ORDER BY b.block_no) AS k, '[P' || k || '] (line ' || b.block_no || ')' || chr(10) || b.text AS part FROM cx c JOIN blocks b ON b.doc_id = c.doc_id AND b.block_no BETWEEN low AND high),
quotes AS (SELECT item_id * 2 AS item_id, array_to_string(string_split(text, ' ')[4:9], ' ') AS quote FROM benchmark UNION ALL SELECT item_id * 2 + 1, array_to_string(string_split(text, ' ')[2:3], ' ') FROM benchmark),
found AS (SELECT doc_id, batch_no, item_id, min(k)::INT AS label FROM r JOIN quotes ON quote <> '' AND contains(part, quote) GROUP BY 1, 2, 3)
"""

QUERIES = {
    "corpus_digest": (corpus_digest, "SELECT left(sha256(string_agg(e, chr(31) ORDER BY e)), 16) AS corpus_hash FROM (SELECT sha256(coalesce(text, '')) || ':' || source || '/' || doc_id AS e FROM documents)"),
    "canonical_numbers": (canonical_numbers, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) - 1 AS no FROM orders"),
    "recorded_answers": (recorded_answers, LABELLED + "SELECT * FROM found"),
    "extract_coverage": (
        extract_coverage,
        LABELLED + f""", b AS (SELECT doc_id, batch_no, length(string_agg(part, chr(10) || chr(10) ORDER BY k)) AS n FROM r GROUP BY 1, 2),
one AS (SELECT b.*, n % 7 = 0 AS nn, count(item_id) FILTER (item_id % 2 = 0 AND item_id % 6 < 4) AS c, count(item_id) FILTER (item_id % 2 = 0 AND item_id % 6 >= 4) AS j FROM b LEFT JOIN found USING (doc_id, batch_no) GROUP BY 1, 2, 3),
two AS (SELECT b.doc_id, b.batch_no, (n + {len(X.REREAD_NOTE)}) % 7 = 0 AS nn, count(item_id) FILTER (item_id % 6 < 4) AS c, count(item_id) FILTER (item_id % 6 >= 4) AS j FROM b LEFT JOIN found USING (doc_id, batch_no) GROUP BY 1, 2, 3)
SELECT doc_id, batch_no, one.c = 0 AND NOT one.nn AS reread, CASE WHEN reread THEN two.nn ELSE one.nn END AS non_normative, CASE WHEN reread THEN two.c ELSE one.c END AS candidates, CASE WHEN reread THEN one.j + two.j ELSE one.j END AS rejections,
    CASE WHEN reread THEN two.c = 0 AND NOT two.nn ELSE false END AS silent FROM one JOIN two USING (doc_id, batch_no)""",
    ),
}
