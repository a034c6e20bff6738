"""The corpus pipeline: toxic and unidentified documents go, repeated lines go, of near copies one
stays, and what is left is packed into training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as
the next stage's ``docs``. All stages but the last keep the columns of ``documents``. A stage may be called on its own,
so each sees to it that texts go to Python workers in small batches.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import language_id, line_dedup, ngram_join, packing, toxicity
from tracewright.session import small_batches
from tracewright.storage import stash, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents with at least this score are rejected as toxic.
TOXIC = 0.7
#: A language is taken as identified from this score on; scores of all languages add up to 1.
LANGUAGE = 0.4


def _stage(work: Stage) -> Stage:
    """A whole partition of texts is a batch otherwise, and lies in the executor and in its workers several times."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return work(spark, docs, sf_dir)

    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted to the labels of those that aren't held out, finds clean."""
    net = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_texts(docs, net).filter(F.col("score") < TOXIC).select(*docs.columns)


@_stage
def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; one without letters has none."""
    found = language_id.identify(docs, keep=docs.columns)
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE)).select(*docs.columns)


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line has; documents left without text go."""
    found = line_dedup.dedup_lines(docs)
    kept = found.filter((F.col("n_dropped") == 0) | (F.length(F.trim("text")) > 0))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    found = ngram_join.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2,048 tokens."""
    return packing.pack(docs, capacity=2048, vocabulary="byte_bpe_50k.json", end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unidentified),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("best-fit packing", pack),
]

#: No SQL expresses a trained network or a library's tokens; the stages are held against brute force in tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
