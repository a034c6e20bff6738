"""Document fingerprints: digests of quartiles of hashed byte triplets.

Every three bytes in a row of a text's UTF-8 are hashed into one of ``BUCKETS`` buckets. A bucket's
count is written as its quartile among the counts of all buckets (two bits), after a code of the
text's length on a logarithmic scale. Two digests are compared by the sum of their quartile
differences and a penalty for unlike lengths, bounded and turned into a likeness from 0 to 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
#: Length codes grow by one for each tenth more bytes, up to 255.
LENGTH_STEP = np.log(1.1)
#: Quartiles of unrelated digests differ by 1.25 on average; likeness is 0 from there on.
WORST = 1.25 * BUCKETS
LENGTH_WEIGHT = 4.0
#: Bytes that are hashed at a time.
BLOCK = 1 << 20

_MIX = np.random.default_rng(20240607).permutation(256).astype(np.uint8)


def bucket_counts(data: bytes) -> np.ndarray:
    """How many triplets of ``data`` fall into each bucket."""
    counts = np.zeros(BUCKETS, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)
    for a in range(0, max(0, len(raw) - 2), BLOCK):
        part = raw[a : a + BLOCK + 2]
        h = _MIX[_MIX[_MIX[part[:-2]] ^ part[1:-1]] ^ part[2:]]
        counts += np.bincount(h, minlength=BUCKETS)
    return counts


def digest(text: str | None) -> str:
    """The fingerprint in hexadecimal: two digits of length, then four quartiles to the byte."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    cuts = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > cuts[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = (codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]).astype(np.uint8)
    length = min(255, int(np.log(len(data) + 1) / LENGTH_STEP))
    return f"{length:02x}" + packed.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, down to 0 for unrelated ones."""
    x, y = np.frombuffer(bytes.fromhex(a), dtype=np.uint8), np.frombuffer(bytes.fromhex(b), dtype=np.uint8)
    apart = sum(int(np.abs(((x[1:] >> s) & 3).astype(int) - ((y[1:] >> s) & 3)).sum()) for s in (0, 2, 4, 6))
    return max(0.0, 1.0 - (apart + LENGTH_WEIGHT * abs(int(x[0]) - int(y[0]))) / WORST)


def fingerprint(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """Add the digest of every row's text; a null text counts as empty."""

    @F.pandas_udf("string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([digest(t) for t in texts], dtype=object)

    return docs.withColumn(to, digests(F.col(text)))


def with_next(docs: DataFrame, per_partition: int = 8) -> DataFrame:
    """``range_no, is_copy, doc_id, text``: the rows of ``docs`` (``doc_id, text``) in ranges of ``doc_id``.

    Each range is followed by a copy of the first row of the next one, and the last range by the
    first row of the table. So each row's successor in the whole table stands right below it, and
    no task needs more than its ranges. The cuts are approximate quantiles (``per_partition`` of
    them for each shuffle partition): where they fall changes no result.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError("documents are ordered by whole numbers")
    parts = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts)))
    bounds = np.array([int(c) for c in cuts])

    @F.pandas_udf("int")
    def ranges_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy()), dtype="int32")

    # Nulls, which would make a batch's ids decimal numbers, are in the first range.
    no = F.when(F.col("doc_id").isNull(), 0).otherwise(ranges_of(F.coalesce("doc_id", F.lit(0).cast(kind))))
    rows = docs.select(no.alias("range_no"), F.lit(False).alias("is_copy"), "doc_id", "text")
    first = F.when(~F.bool_or(F.col("doc_id").isNull()), F.min("doc_id"))
    found = sorted(map(tuple, rows.groupBy("range_no").agg(first.alias("first_id")).collect()), key=lambda r: r[0])
    ranges, firsts = [r[0] for r in found], [r[1] for r in found]
    if not ranges:
        return rows
    # The first row of each range: one id for each range, so at most ``parts``.
    goes = spark.createDataFrame([(ranges[k - 1], firsts[k]) for k in range(len(ranges))], T.StructType([T.StructField("to_range", T.IntegerType()), T.StructField("first_id", kind)]))
    heads = docs.join(F.broadcast(goes), docs["doc_id"].eqNullSafe(goes["first_id"])).groupBy("to_range", "doc_id").agg(F.min("text").alias("text"))
    return rows.unionByName(heads.select(F.col("to_range").alias("range_no"), F.lit(True).alias("is_copy"), "doc_id", "text"))


def edited_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has the last quarter of the code points (rounded down) replaced by the first as
    many, or all, of the next document in ascending ``doc_id`` (after the last: the first).

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. A null text counts as empty; equal texts have equal fingerprints; rows with a null
    ``doc_id`` come first, and rows with one ``doc_id`` follow each other by text; a single row is
    its own next; an empty table gives an empty result, and other columns are left out. Ids are whole numbers; others are refused.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = with_next(rows).repartition(parts, "range_no").sortWithinPartitions("range_no", "is_copy", "doc_id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            for no, copy, name, value in zip(*(batch.column(c).to_pylist() for c in ("range_no", "is_copy", "doc_id", "text")), strict=True):
                mark = digest(value)
                if last is not None and not last[1]:
                    n = len(last[3])
                    edited = last[3][: n - n // 4] + value[: n // 4]
                    changed = digest(edited)
                    out.append((last[2], n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), last[4], changed, likeness(last[4], changed), likeness(last[4], mark)))
                last = (no, copy, name, value, mark)
            kinds = {"doc_id": batch.column("doc_id").type, "n_chars": pa.int64()} | dict.fromkeys(("edited_sha256", "fingerprint", "edited_fingerprint"), pa.string()) | dict.fromkeys(("near_edited", "near_next"), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], list(kinds))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
