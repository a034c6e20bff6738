"""Outputs in one order, whatever the partitions they come in: files that are the same bytes on every run, and a digest of a sorted list."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import hashlib
import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.storage import fresh_path, stash

#: The orders of a build's parts.
ORDERS = {
    "entities": ("entity_type", "canonical", "entity_id"), "triples": ("head", "relation", "tail"), "assertions": ("kind", "subject", "assertion_id"), "questions": ("kind", "question_id"), "transitions": ("-n", "source", "target"),
}
#: Rows of one file.
ROWS_PER_FILE = 1_000_000
_ROW_BITS = 33


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``no``, their place from 0 in a total order, and ``part``, the range that they lie in.

    A name with a minus before it orders downwards. Nulls come first. Ranges are sorted apart, and only how many rows each has goes to the driver; rows that are
    equal in all of ``order`` should be equal altogether, else their places among each other may vary.
    """
    keys = [F.desc_nulls_first(c[1:]) if c.startswith("-") else F.asc_nulls_first(c) for c in order]
    placed = stash(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"part": F.spark_partition_id().cast("long"), "no": F.monotonically_increasing_id()}), "ordered")
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    first = rows.sparkSession.createDataFrame(starts, "part long, first long")
    return placed.join(F.broadcast(first), "part").withColumn("no", F.col("no").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("first")).drop("first")


def write_canonical(rows: DataFrame, path: str, *order: str, rows_per_file: int = ROWS_PER_FILE, compressed: bool = False) -> int:
    """Write rows as JSON lines in order, ``rows_per_file`` to a file; files are named by their numbers, and are gzip files if ``compressed``. Returns how many there are.

    What is at ``path`` is replaced. The bytes depend on the rows alone: rows with equal keys are ordered by all they have, nulls are written, and columns keep their order.
    """
    spark = rows.sparkSession
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    keyed = rows.select(*[F.col(f"`{c.lstrip('-')}`").alias(f"_{k}") for k, c in enumerate(order)], line.alias("line"))
    names = [("-" if c.startswith("-") else "") + f"_{k}" for k, c in enumerate(order)]
    placed = numbered(keyed, *names, "line").select("line", "no", F.expr(f"no div {rows_per_file}").alias("file"))
    n = -(-((placed.agg(F.max("no")).first()[0] or -1) + 1) // rows_per_file) if not placed.isEmpty() else 0
    rough = fresh_path(spark, "canonical")
    # Each file is one task's, in order; Spark names it by the run, so it is renamed at last.
    placed.repartition(max(1, n), "file").sortWithinPartitions("file", "no").select("file", "line").write.partitionBy("file").text(rough, compression="gzip" if compressed else "none")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files, target = at(rough).getFileSystem(conf), at(path)
    there = target.getFileSystem(conf)
    there.delete(target, True)
    there.mkdirs(target)
    near = files.getUri().equals(there.getUri())
    for k in range(n):
        for status in files.listStatus(at(f"{rough}/file={k}")):
            if status.getPath().getName().startswith("part-"):
                name = at(f"{path}/part-{k:08d}.jsonl" + (".gz" if compressed else ""))
                if not (near and files.rename(status.getPath(), name)):
                    jvm.org.apache.hadoop.fs.FileUtil.copy(files, status.getPath(), there, name, True, conf)
    return n


def _roots(n: int, power: int) -> list[int]:
    """The first 32 bits behind the point of the roots of the first n primes."""
    primes = [p for p in range(2, 400) if all(p % q for q in range(2, math.isqrt(p) + 1))][:n]
    out = []
    for p in primes:
        x = p << 32 * power
        low, high = 0, 1 << 40
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if mid**power <= x else (low, mid)
        out.append(low & 0xFFFFFFFF)
    return out


_ROUNDS, _START = _roots(64, 3), _roots(8, 2)



class _Context(ctypes.Structure):
    """A state as OpenSSL keeps it; only ``h`` is used, as whole blocks alone are handed over."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("length", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("md_len", ctypes.c_uint), ("spare", ctypes.c_uint32 * 16)]


@functools.cache
def _crypto() -> ctypes.CDLL | None:
    """OpenSSL's library, if there is one that hashes a block as it should; without it blocks take about 300 times as long."""
    try:
        library = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")
        context = _Context((ctypes.c_uint32 * 8)(*_START))
        library.SHA256_Update(ctypes.byref(context), b"abc\x80" + bytes(59) + b"\x18", ctypes.c_size_t(64))
    except (OSError, AttributeError):
        return None
    return library if struct.pack(">8I", *context.h) == hashlib.sha256(b"abc").digest() else None


class Sha256:
    """SHA-256 whose state can be handed on, which the standard library's can't: where one task ends, another goes on. Whole blocks are OpenSSL's work where it is installed."""

    def __init__(self, state: bytes = b"", rest: bytes = b"", length: int = 0) -> None:
        self.h = list(struct.unpack(">8I", state)) if state else list(_START)
        self.rest, self.length = rest, length

    def state(self) -> tuple[bytes, bytes, int]:
        return struct.pack(">8I", *self.h), self.rest, self.length

    def update(self, data: bytes) -> None:
        self.length += len(data)
        data = self.rest + data
        whole = len(data) // 64 * 64
        if whole and (crypto := _crypto()):
            context = _Context((ctypes.c_uint32 * 8)(*self.h))
            crypto.SHA256_Update(ctypes.byref(context), data, ctypes.c_size_t(whole))
            self.h = list(context.h)
        else:
            for k in range(0, whole, 64):
                self._block(data[k : k + 64])
        self.rest = data[whole:]

    def _block(self, block: bytes) -> None:
        def turn(x: int, n: int) -> int:
            return (x >> n | x << 32 - n) & 0xFFFFFFFF

        w = list(struct.unpack(">16I", block))
        for k in range(16, 64):
            x, y = w[k - 15], w[k - 2]
            w.append((w[k - 16] + (turn(x, 7) ^ turn(x, 18) ^ x >> 3) + w[k - 7] + (turn(y, 17) ^ turn(y, 19) ^ y >> 10)) & 0xFFFFFFFF)
        a, b, c, d, e, f, g, h = self.h
        for k in range(64):
            t = h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + (e & f ^ ~e & 0xFFFFFFFF & g) + _ROUNDS[k] + w[k]
            u = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + (a & b ^ a & c ^ b & c)
            a, b, c, d, e, f, g, h = (t + u) & 0xFFFFFFFF, a, b, c, (d + t) & 0xFFFFFFFF, e, f, g
        self.h = [(x + y) & 0xFFFFFFFF for x, y in zip(self.h, (a, b, c, d, e, f, g, h), strict=True)]

    def hexdigest(self) -> str:
        last = Sha256(*self.state())
        bits = 8 * last.length
        last.update(b"\x80" + bytes((55 - last.length) % 64) + struct.pack(">Q", bits))
        return "".join(f"{x:08x}" for x in last.h)


def ordered_digest(rows: DataFrame, column: str, separator: str = "\x1f") -> str:
    """The SHA-256, in hexadecimal digits, of a column's values joined in their order, byte by byte; nulls are left out.

    Such a digest has to see all values one behind the other. Each range of them is read by a task of its own, which goes on from the state of the one before: a job hands 32 bytes and
    an unfinished block to the next, and no task or driver has more than a range.
    """
    placed = stash(numbered(rows.select(F.col(column).cast("string").alias("v")).filter("v IS NOT NULL"), "v"), "listed")
    state, rest, length, seen = b"", b"", 0, 0
    for r in sorted(placed.select("part").distinct().collect()):

        def go_on(batches: Iterator[pa.RecordBatch], known: tuple = (state, rest, length), seen: int = seen) -> Iterator[pa.RecordBatch]:
            sha = Sha256(*known)
            for batch in batches:
                values = batch.column("v").to_pylist()
                if values:
                    sha.update(((separator if seen else "") + separator.join(values)).encode())
                    seen += len(values)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*sha.state(), seen)], ["state", "rest", "length", "seen"])

        mine = placed.filter(F.col("part") == r["part"]).select("no", "v").coalesce(1).sortWithinPartitions("no")
        state, rest, length, seen = mine.mapInArrow(go_on, "state binary, rest binary, length long, seen long").first()
        state, rest = bytes(state), bytes(rest)
    return Sha256(state, rest, length).hexdigest()


def corpus_hash(files: DataFrame) -> str:
    """The hash of a corpus, whatever the order of its documents. ``files``: ``sha256, name``."""
    return ordered_digest(files.select(F.concat("sha256", F.lit(":"), "name").alias("entry")), "entry")[:16]
