"""N-gram Jaccard join with count vectors in an R-tree.

A document's set is its distinct word n-grams (hashed). Two documents link when the Jaccard similarity of
their sets reaches a threshold. No link between different sets is lost:

1. *Sets.* Documents with one and the same set form a class; one of them is dealt.
2. *Cells.* The tree's top level deals sets to cells, in which every linked pair meets: the
   n-grams of all documents are put in one order, and a set of n n-grams goes to the cells of its first
   n - ceil(t n) + 1. Two sets that share none of these can't reach the threshold t. The order
   puts n-grams that many documents have last (by counts of hashed n-grams over all documents), so
   passages that everybody quotes make no cells. Sizes of linked sets differ by less than 1 / t, and the first n-gram that
   they share stands early in the smaller one; a set without such a mate in a cell leaves it.
3. *Spanning links.* Every set is first compared with one other, the pivot that it meets in most cells. This finds
   most groups of copies, however large, with a comparison for each member and not each pair.
4. *Trees.* Cells whose sets lie in several components are searched for the links that are left. A set
   is a point: its n-grams are hashed into ``GROUPS`` groups, and the coordinates are the groups' counts.
   Points are packed into an R-tree; a cell of up to ``FAN_OUT`` points is one leaf. The overlap of two sets is at most the sum of the smaller
   coordinates, which also bounds the overlap of a set with all sets below a node, from the largest
   coordinates there. Branches below the threshold are cut off. Large cells are split into
   tiles, each pair of which is a task of its own.
5. *Verification.* Surviving pairs are verified by their sets. Components of all links follow.

Cells that very many sets have are found in a sample beforehand and dealt to several tasks each, with a pivot known to all of them.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.batches import give_back
from tracewright.llm.components import connected_components
from tracewright.llm.membership import bitmap, contains, slot
from tracewright.llm.skew import join_heavy
from tracewright.storage import stash

#: Buckets of the counts that give the order of n-grams, as a power of two (16 MB where all are needed).
SKETCH_BITS = 22
SKETCH = 1 << SKETCH_BITS
SKETCH_PARTS = 64
#: Groups that n-grams are hashed into: the dimensions of a point.
GROUPS = 128
#: Bits of an n-gram's hash that name its cell. Cells that collide are only larger.
CELL_BITS = 48
#: Points below a leaf or node of a tree.
FAN_OUT = 16
#: Rounds after the first: with the pivots of all cells of a set, and of all pairs left in cells of several components.
ROUNDS = 2
#: Cells of a set that its rows know of.
KNOWN_CELLS = 16
#: Points of a cell in one task.
TILE = 1_000
#: One of so many texts is looked at for cells that many sets have; at most HOT_CELLS are then dealt to SALTS tasks each.
SAMPLE, HOT_ROWS, HOT_CELLS, SALTS = 64, 50, 10_000, 64
#: Sets that a task keeps in mind, so as not to deal a repeated one again.
KEPT_SETS = 1_000_000
#: Bytes that a task works on at a time.
STEP_BYTES = 1 << 20
_BASE = 0x5851F42D4C957F2D
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Sets of hashed n-grams of whole texts.

    The hash of a word is a difference of running sums over all bytes, so nothing is done word by word.
    """

    def __init__(self, n: int = 5) -> None:
        self.n = n
        # Bytes count from 1, A-Z as a-z; ASCII white space (and no other) parts words.
        self.fold = np.arange(1, 257, dtype=np.uint64)
        self.fold[65:91] += np.uint64(32)
        self.fold[[9, 10, 11, 12, 13, 32]] = 0
        self.power, self.back = _powers(_BASE, STEP_BYTES), _powers(pow(_BASE, -1, 1 << 64), STEP_BYTES)

    @staticmethod
    def _combine(h: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            x = h[j : len(h) - n + 1 + j]
            out = (out ^ x) * _PRIME
            out ^= out >> np.uint64(29)
        return out

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin, and their hashes."""
        folded = self.fold[np.frombuffer(data, dtype=np.uint8)]
        inside = np.concatenate([[False], folded != 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        power, back = (self.power, self.back) if len(data) <= STEP_BYTES else (_powers(_BASE, len(data)), _powers(pow(_BASE, -1, 1 << 64), len(data)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(folded * power[: len(data)], dtype=np.uint64)])
        h = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return starts, h ^ (h >> np.uint64(32))

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """For each text the sorted distinct hashes; a text of fewer than n words is one n-gram."""
        a = 0
        while a < len(texts):
            data, have = [], 0
            while a < len(texts) and (not data or have + len(data[-1]) < STEP_BYTES // 2):
                data.append((texts[a] or "").encode("utf-8", "surrogatepass"))
                have += len(data[-1]) + 1
                a += 1
            starts, h = self._words(b" ".join(data))
            counts = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data)])))
            grams = self._combine(h, self.n) if len(h) >= self.n else np.zeros(0, np.uint64)
            at = 0
            for k in counts.tolist():
                if k >= self.n:
                    yield np.unique(grams[at : at + k - self.n + 1])
                else:
                    yield self._combine(h[at : at + k], k) if k else np.zeros(0, np.uint64)
                at += k


def _point(s: np.ndarray) -> bytes:
    return np.bincount((s >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=GROUPS).astype(np.uint32).tobytes()


def _points(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(-1, GROUPS)


def _key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _counts(rows: DataFrame, n: int) -> np.ndarray:
    """How many (document, n-gram) pairs of all documents fall into each bucket of the sketch."""
    width = SKETCH // SKETCH_PARTS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back("ngram_join")
        shingler, total = Shingler(n), np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for s in shingler.sets(list(batch["text"])):
                np.add.at(total, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        if total.any():
            # Tasks are added up in groups first, so that no task adds up all of them.
            salt = int(xxhash.xxh32_intdigest(total.tobytes()) % 64)
            yield pd.DataFrame({"part": range(SKETCH_PARTS), "salt": salt, "counts": [zlib.compress(total[k * width : (k + 1) * width].tobytes(), 1) for k in range(SKETCH_PARTS)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, dtype=np.int64)
        for c in group["counts"]:
            total += np.frombuffer(zlib.decompress(c), dtype=np.int64)
        return pd.DataFrame({"part": group["part"].iloc[:1], "salt": 0, "counts": [zlib.compress(total.tobytes(), 1)]})

    schema = "part int, salt int, counts binary"
    summed = rows.select("text").mapInPandas(count, schema).groupBy("part", "salt").applyInPandas(add, schema).groupBy("part").applyInPandas(add, schema)
    out = np.zeros(SKETCH, dtype=np.uint32)
    for r in summed.collect():
        out[r["part"] * width : (r["part"] + 1) * width] = np.minimum(np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64), 2**32 - 1)
    return out


def prefix_size(n: int, num: int, den: int) -> int:
    """How many of n n-grams a set must share one of with every set that reaches num/den."""
    return n - -(-num * n // den) + 1


def pack(points: np.ndarray, order: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Levels of an R-tree from the leaves up: largest coordinates of each node."""
    levels, now = [], points[order]
    while True:
        firsts = np.arange(0, len(now), FAN_OUT)
        now = np.maximum.reduceat(now, firsts, axis=0)
        levels.append(now)
        if len(now) <= FAN_OUT:
            return levels


def search(queries: np.ndarray, q_sizes: np.ndarray, points: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, point) whose bound on the overlap allows the threshold num/den.

    J >= num/den needs an overlap of num / (num + den) of both sizes together.
    """
    # Points near each other in size and in their fullest groups share leaves.
    order = np.lexsort((points.argmax(axis=1), sizes))
    levels, small = pack(points, order), sizes[order].astype(np.int64)
    q, node = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(len(levels[-1])), indexing="ij"))
    for depth in range(len(levels) - 1, -2, -1):
        keep_q, keep_n = [], []
        for a in range(0, max(1, len(q)), 20_000):
            qs, ns = q[a : a + 20_000], node[a : a + 20_000]
            corner = levels[depth][ns] if depth >= 0 else points[order[ns]]
            bound = np.minimum(queries[qs], corner).sum(axis=1, dtype=np.int64)
            least = small[ns * FAN_OUT ** (depth + 1)] if depth >= 0 else small[ns]  # sizes ascend
            ok = bound * (num + den) >= num * (q_sizes[qs] + least)
            keep_q.append(qs[ok])
            keep_n.append(ns[ok])
        q, node = np.concatenate(keep_q), np.concatenate(keep_n)
        if depth >= 0:
            below = len(levels[depth - 1]) if depth else len(points)
            q, node = np.repeat(q, FAN_OUT), (node[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            q, node = q[node < below], node[node < below]
    return q, order[node]


def _bounded(pairs: DataFrame, points: DataFrame, on: str, num: int, den: int) -> DataFrame:
    """``a, b``: keys of the pairs (of ids or keys, as ``on`` says) whose bound on the overlap allows num/den."""
    x, y = (points.select(F.col(on).alias(k), F.col("key").alias(f"key_{k}"), F.col("n").alias(f"n_{k}"), F.col("point").alias(f"point_{k}")) for k in "ab")
    rows = pairs.join(x, "a").join(y, "b").filter("key_a <> key_b AND point_a IS NOT NULL AND point_b IS NOT NULL")

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                most = np.minimum(_points(batch["point_a"]), _points(batch["point_b"])).sum(axis=1, dtype=np.int64)
                yield batch.loc[most * (num + den) >= num * (batch["n_a"] + batch["n_b"]).to_numpy(), ["key_a", "key_b"]]

    return rows.mapInPandas(bound, "key_a binary, key_b binary").toDF("a", "b").distinct()


def _sets(rows: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """``key, grams``: the sets in ``pairs`` (of keys), dealt by their keys. A broadcast bitmap leaves out most others; a few more do no harm.

    They aren't written: both sides of a join read one and the same exchange.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    # A key is a hash itself: its last bits are its place.
    has = bitmap(wanted.select(F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("long").alias("last")), "last", hashed=True)

    def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, seen = Shingler(n), set()
        for batch in batches:
            out = {}
            for s in shingler.sets(list(batch["text"])):
                key = _key(s)
                if key not in seen and contains(has.value, np.array([int.from_bytes(key[12:], "big") % (8 * len(has.value))]))[0]:
                    seen.add(key)
                    out[key] = s.tobytes()
            if len(seen) > KEPT_SETS:
                seen.clear()
            yield pd.DataFrame({"key": list(out), "grams": list(out.values())}, dtype=object)

    return rows.select("text").mapInPandas(with_sets, "key binary, grams binary").dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` of the pairs whose sets reach num/den."""
    # The second key of a pair stands in fewer pairs, so its set goes to the pivots' and not the other way round.
    rows = pairs.join(sets.select(F.col("key").alias("b"), F.col("grams").alias("y")), "b")
    rows = rows.join(sets.select(F.col("key").alias("a"), F.col("grams").alias("x")), "a")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.loc[ok, ["a", "b"]]

    return rows.mapInPandas(verify, "a binary, b binary")


def _described(rows: DataFrame, n: int) -> DataFrame:
    """``doc_id, n, key, point`` of every document; a document without n-grams has neither key nor point."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back("ngram_join")
        shingler = Shingler(n)
        for batch in batches:
            sets = [(len(s), _key(s), _point(s)) if len(s) else (0, None, None) for s in shingler.sets(batch.column("text").to_pylist())]
            size, key, point = zip(*sets, strict=True) if sets else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int32()), pa.array(key, pa.binary()), pa.array(point, pa.binary())], ["doc_id", "n", "key", "point"])

    return rows.mapInArrow(describe, "doc_id long, n int, key binary, point binary")


def _dealt(rows: DataFrame, rank: Broadcast, has: Broadcast, n: int, num: int, den: int) -> DataFrame:
    """``cell, doc_id, n`` of the documents in the bitmap ``has``; a task deals a repeated set once.

    ``n`` is negative where an n-gram stands too late in the set for it to be the smaller one of a linked pair that shares none before.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back("ngram_join")
        shingler, mask, seen = Shingler(n), np.uint64((1 << CELL_BITS) - 1), set()
        for batch in batches:
            batch = batch[contains(has.value, batch["slot"].to_numpy())]
            cells, names, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for name, s in zip(batch["doc_id"].to_numpy(), shingler.sets(list(batch["text"])), strict=True):
                key = _key(s)
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                often = rank.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                # Sets are sorted by hash, and the sort is stable: one order of all n-grams.
                first = s[np.argsort(often, kind="stable")[: prefix_size(len(s), num, den)]] & mask
                early = np.arange(len(first)) * (num + den) <= len(s) * (den - num)
                cells.append(first)
                names.append(np.full(len(first), name, dtype=np.int64))
                sizes.append(np.where(early, len(s), -len(s)).astype(np.int32))
            if len(seen) > KEPT_SETS:
                seen.clear()
            yield pd.DataFrame({"cell": np.concatenate(cells).view(np.int64), "doc_id": np.concatenate(names), "n": np.concatenate(sizes)})

    return rows.filter("doc_id IS NOT NULL").select("doc_id", slot(F.col("doc_id")).alias("slot"), "text").mapInPandas(deal, "cell long, doc_id long, n int")


def _met(rows: DataFrame, rank: Broadcast, has: Broadcast, n: int, num: int, den: int) -> DataFrame:
    """``cell, doc_id, early, pivot`` of the sets that have a mate of a fitting size in a cell; ``early`` ones may be the smaller of a pair.

    There is one exchange of all cells. Those that many sets of the sample have are dealt to several tasks, and their pivot comes
    from the sample; a cell that the sample does not show as large is complete in one task.
    """
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    shown = _dealt(sample, rank, has, n, num, den).groupBy("cell").agg(F.count("*").alias("shown"), F.min("doc_id").alias("known"))
    hot = stash(shown.filter(F.col("shown") >= HOT_ROWS).orderBy(F.desc("shown"), "cell").limit(HOT_CELLS).select("cell", "known"), "hot-cells")
    salt = F.when(F.col("known").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    # As many tasks as the session deals rows to, not fewer larger ones: a task sorts all its cells.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(rows, rank, has, n, num, den).join(F.broadcast(hot), "cell", "left").withColumn("salt", salt).repartition(parts, "cell", "salt")
    size = F.abs("n")
    own = Window.partitionBy("cell", "salt")
    by_size = own.orderBy(size)
    smaller = F.last(F.when(F.col("n") > 0, size), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    dealt = dealt.withColumns({"larger": F.lead(size).over(by_size), "smaller": smaller})
    mate = ((F.col("n") > 0) & (F.col("larger") * num <= size * den)) | (F.col("smaller") * den >= size * num)
    met = dealt.filter(F.col("known").isNotNull() | mate)
    return met.select("cell", "doc_id", (F.col("n") > 0).alias("early"), F.coalesce("known", F.min("doc_id").over(own)).alias("pivot"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for every row.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. ``class_id`` is the smallest
    id among documents with the same set, ``component_id`` the smallest that links reach. A null, empty
    or blank text has no n-grams and links with nothing. Ids are taken as long integers; rows with
    a null id get no links (each its own null component). Rows that repeat an id are rows like any other: each is linked by
    its own text. An empty table gives an empty result; other columns are
    left out. The threshold is num/den, compared in integers.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = stash(_described(rows, n), "described")
    classes = stash(described.filter("doc_id IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members")), "classes")
    spark = docs.sparkSession
    met = stash(_met(rows, spark.sparkContext.broadcast(_counts(rows, n)), bitmap(classes, "class_id"), n, num, den), "cells")

    points = described.join(met.select("doc_id").distinct(), "doc_id", "left_semi").filter("key IS NOT NULL")
    points = stash(points.dropDuplicates(["doc_id", "key"]), "points")
    by_pivot = met.filter("doc_id <> pivot").groupBy("doc_id", "pivot").agg(F.count("*").alias("cells"))
    spanning = by_pivot.groupBy("doc_id").agg(F.max_by("pivot", F.struct("cells", "pivot")).alias("a")).select("a", F.col("doc_id").alias("b"))
    spanning = stash(_bounded(spanning, points, "doc_id", num, den), "spanning")
    links = stash(_verified(spanning, _sets(rows, spanning, n), num, den), "links")
    components = connected_components(links)

    for turn in range(ROUNDS):
        # Where all sets of a cell are in one component, nothing more can be learned from it.
        traits = points.join(components.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        traits = stash(traits, "traits")
        named = met.select("cell", "doc_id").join(traits.select("doc_id", "component"), "doc_id")
        mixed = named.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).filter("low <> high")
        left = stash(met.join(mixed.select("cell", "size"), "cell"), "mixed-cells")
        if left.isEmpty():
            break
        if turn < ROUNDS - 1:  # large groups of copies come together by the pivots of all their cells
            ends = [traits.select(F.col("doc_id").alias(c), F.col("component").alias(f"{c}_component")) for c in ("pivot", "doc_id")]
            pairs = left.select("doc_id", "pivot").distinct().join(ends[0], "pivot").join(ends[1], "doc_id").filter("pivot_component <> doc_id_component")
            found = _bounded(pairs.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")), points, "doc_id", num, den)
        else:
            small = left.filter(F.col("size") <= FAN_OUT).join(traits.select("doc_id", "key", "n", "component"), "doc_id")
            large = left.filter(F.col("size") > FAN_OUT)
            first = large.filter("early").groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list("cell")), 1, KNOWN_CELLS).alias("first"))
            found = _leaf_pairs(small, num, den).unionByName(_search_cells(large.join(traits, "doc_id").join(first, "doc_id", "left"), num, den)).distinct()
            found = _bounded(found, points.dropDuplicates(["key"]), "key", num, den)
        found = stash(found, "pairs")
        if found.isEmpty():
            continue
        links = stash(links.unionByName(_verified(found, _sets(rows, found, n), num, den)), "links")
        components = connected_components(links)
    named = classes.join(components.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    lowest = named.groupBy("component").agg(F.min("class_id").alias("component_id"), F.count("*").alias("sets"))
    named = stash(join_heavy(named, stash(lowest, "components"), "component", "sets", ["key"]).select("key", "class_id", "component_id", "members"), "classes")
    known, others = described.filter("doc_id IS NOT NULL AND key IS NOT NULL"), described.filter("doc_id IS NULL OR key IS NULL")
    out = join_heavy(known.select("key", "doc_id", "n"), named, "key", "members", ["doc_id"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class_id", "component_id")
    return out.unionByName(others.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id")))


def _leaf_pairs(left: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: pairs of keys from different components and of fitting sizes in cells of up to ``FAN_OUT`` sets."""
    members = left.groupBy("cell").agg(F.array_sort(F.collect_set(F.struct("n", "key", "component", "early"))).alias("m"))

    def partners(x: Column, k: Column) -> Column:
        fits = lambda y, j: (j > k) & x["early"] & (y["component"] != x["component"]) & (y["n"] * num <= x["n"] * den) & (y["early"] | (y["n"] > x["n"]))
        later = F.filter("m", fits)
        return F.transform(later, lambda y: F.struct(F.least(x["key"], y["key"]).alias("a"), F.greatest(x["key"], y["key"]).alias("b")))

    return members.select(F.explode(F.flatten(F.transform("m", partners))).alias("p")).select("p.*").distinct()


def _search_cells(left: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: pairs of keys from different components that meet in a cell and pass the bound.

    ``left``: ``cell, size, key, n, early, point, component`` and the ``first`` cells in which a set is early. A pair that both have such a cell before
    this one is found there, so copies that meet in very many cells aren't listed by each.
    """
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("key"), tiles).cast("int")
    # Of a cell in k tiles, a point goes to the k pairs of its own tile with each.
    rows = left.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), tiles - 1)))
    rows = rows.select("cell", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "key", "n", "early", "point", "component", "first")

    def search_tile(tile: pd.DataFrame, cell: int, i: int, j: int) -> list[tuple[bytes, bytes]]:
        x, y = (np.flatnonzero(tile["own"] == k) for k in (i, j))
        if not len(x) or not len(y):
            return []
        at, sizes, key = _points(tile["point"]), tile["n"].to_numpy(dtype=np.int64), tile["key"].to_numpy()
        component = pd.factorize(tile["component"])[0]
        p, q = search(at[x], sizes[x], at[y], sizes[y], num, den)
        p, q = x[p], y[q]
        early, less = tile["early"].to_numpy(dtype=bool), sizes[p] - sizes[q]
        ok = (component[p] != component[q]) & (early[p] | (less > 0)) & (early[q] | (less < 0))
        p, q = p[ok], q[ok]
        known = np.full((len(tile), KNOWN_CELLS), cell, dtype=np.int64)
        for k, cells in enumerate(tile["first"]):
            if cells is not None:
                known[k, : len(cells)] = cells
        ok = np.ones(len(p), dtype=bool)
        for a in range(0, len(p), 20_000):
            x, y = known[p[a : a + 20_000], :, None], known[q[a : a + 20_000], None, :]
            ok[a : a + 20_000] = ~((x == y) & (x < cell)).any(axis=(1, 2))
        return list({(min(key[k], key[m]), max(key[k], key[m])) for k, m in zip(p[ok], q[ok], strict=True)})

    def search_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by tile; one may go on in the next batch, and has 2 TILE rows or so."""
        waiting: pd.DataFrame | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                waiting = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
            if waiting is None or not len(waiting):
                continue
            tile = waiting[["cell", "i", "j"]].to_numpy()
            ends = np.append(np.flatnonzero((tile[1:] != tile[:-1]).any(axis=1)) + 1, len(tile))
            out, a = [], 0
            for b in ends if batch is None else ends[:-1]:
                out += search_tile(waiting.iloc[a:b], *tile[a])
                a = b
            waiting = waiting.iloc[a:].reset_index(drop=True)
            yield pd.DataFrame(out, columns=["a", "b"])

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles_sorted = rows.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return tiles_sorted.mapInPandas(search_tiles, "a binary, b binary").distinct()
