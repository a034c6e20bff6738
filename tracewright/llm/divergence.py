"""Divergence of the sources of each language, over terms, with exact whole numbers.

Terms are counted in Python workers (a table of bounded size each) and summed by Spark, first by language, source and term, then by language and term:
a term's row then has its counts in all sources that have it. Most terms are in few sources, so most of a pair's sum is known without looking at a
term: ``V`` times what two counts of 0 give, a correction for each term that one of the two has, and a correction for each term that both have. The last
come out of a frequent-pattern tree. A term's row is inserted as its nonzero counts in order of the sources; rows with the same beginning share a path, and a
node has the number of rows that run through it. Each pair of a node and one of its ancestors gives its correction once, times the node's number.

Rows are sorted in ranges, each task has the tree of its range, and as rows come in order it holds only the path that is open: a node is closed, and adds its corrections,
when a row comes that isn't below it. Corrections of different tasks add up, so ranges may cut the tree anywhere, and no source or language is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.storage import stash

#: Terms that a task gathers before it hands their counts on.
GATHERED = 400_000
#: Sums of pairs that a task gathers before it hands them on.
PAIRS = 500_000
#: Combinations of a node and an ancestor that are worked out at a time, about; rows of one tree are as many as this allows.
COMBINATIONS = 2_000_000
#: Tasks that the pairs of one language are dealt to.
SALTS = 16
#: Fixed value: shares are whole numbers of this many parts.
SCALE = 1_000_000_000

# A-Z become a-z; 0x00-0x40, 0x5B-0x60 and 0x7B-0x7F separate terms; all bytes of other characters stay.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and of all characters beyond ASCII, only A-Z lower-cased."""
    return text.encode().translate(_FOLD).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of a task's rows ``lang, source, text``, where ``docs`` counts rows."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            k = len(n)
            columns = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        found.clear()

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
            n, docs = found.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            here = Counter(terms(text.as_py()))
            n.update(here)
            docs.update(here.keys())
            held += len(n)
            if held >= GATHERED:
                yield from out()
                held = 0
    yield from out()


def share(n: Column, whole: Column) -> Column:
    """p: 1 + floor(SCALE * (n + 2) / whole), exact for all long counts."""
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (n.cast("decimal(19,0)") + F.lit(2).cast("decimal(1,0)"))
    return F.lit(1).cast("long") + F.call_function("div", scaled, whole.cast("decimal(20,0)")).cast("long")


def distance(p: Column, q: Column) -> Column:
    """f: floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def tree_corrections(lengths: np.ndarray, sources: np.ndarray, counts: np.ndarray, p: np.ndarray, p0: np.ndarray, times: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``a, b, value``: sums of corrections by pair of sources, out of the tree of some sorted distinct rows.

    Row r has ``lengths[r]`` items, its nonzero counts in order of the sources; those of all rows follow each other in the flat arrays ``sources``, ``counts``, ``p`` (the share of the
    count) and ``p0`` (that of a count of 0). ``times``: terms that have the row. Pairs can come several times.
    """
    width = int(lengths.max())
    inside = np.arange(width) < lengths[:, None]

    def padded(flat: np.ndarray, fill: int) -> np.ndarray:
        out = np.full(inside.shape, fill, dtype=np.int64)
        out[inside] = flat
        return out

    at, n, share_of, share_0 = padded(sources, -1), padded(counts, -1), padded(p, 1), padded(p0, 1)
    # How many items a row shares with the one before: nodes below that are its own, and the row has all their ancestors.
    common = np.zeros(len(lengths), dtype=np.int64)
    common[1:] = np.logical_and.accumulate((at[1:] == at[:-1]) & (n[1:] == n[:-1]) & inside[1:], axis=1).sum(axis=1)
    names = int(sources.max()) + 1
    keys, values, waiting = [], [], 0

    def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[starts] // names, key[starts] % names, np.add.reduceat(value[order], starts)

    for depth in range(1, width):
        starts = np.flatnonzero(common <= depth)
        through = np.add.reduceat(times, starts)  # rows below a node follow it until one shares less
        real = lengths[starts] > depth
        node, through = starts[real], through[real]
        if not len(node):
            break
        above, above_0 = share_of[node, :depth], share_0[node, :depth]
        own, own_0 = share_of[node, depth][:, None], share_0[node, depth][:, None]
        corrections = _f(above, own) - _f(above, own_0) - _f(above_0, own) + _f(above_0, own_0)
        keys.append((at[node, :depth] * names + at[node, depth][:, None]).ravel())
        values.append((corrections * through[:, None]).ravel())
        waiting += len(keys[-1])
        if waiting >= 2 * COMBINATIONS:
            yield summed()
            keys, values, waiting = [], [], 0
    if keys:
        yield summed()


def _corrected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, a, b, value`` of a task's sorted rows ``lang, path, times``."""
    sums: dict[tuple[str, str, str], int] = {}

    def out() -> pa.RecordBatch:
        lang, a, b = zip(*sums, strict=True) if sums else ((), (), ())
        columns = [pa.array(lang, pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(sums.values()), pa.int64())]
        sums.clear()
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "value"])

    for batch in batches:
        langs = batch.column(0).to_pylist()
        lengths = np.diff(batch.column(1).offsets.to_numpy())
        rows = max(1, COMBINATIONS // max(1, int(lengths.max(initial=1)) ** 2))
        first = 0
        while first < len(langs):
            last = first + 1
            while last < len(langs) and last - first < rows and langs[last] == langs[first]:
                last += 1
            part = batch.slice(first, last - first)
            items = part.column(1).flatten()
            names = items.field("source").dictionary_encode()
            flat = [items.field(c).to_numpy() for c in ("n", "p", "p0")]
            labels = names.dictionary.to_pylist()
            for a, b, value in tree_corrections(lengths[first:last], names.indices.to_numpy().astype(np.int64), *flat, part.column(2).to_numpy()):
                for x, y, v in zip(a.tolist(), b.tolist(), value.tolist(), strict=True):
                    key = (langs[first], labels[x], labels[y])
                    sums[key] = sums.get(key, 0) + v
                if len(sums) >= PAIRS:
                    yield out()
            first = last
    yield out()


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far the sources of each language lie from each other, and their most telling terms.

    A language keeps its terms in at least ``min_docs`` rows. Part ``pair`` has a row for each other source of the language, part ``term`` the ``top`` kept terms
    that the source has and has more of than its language. Equal values are ranked by the item. Null text, lang and source count as empty; a language without kept terms has
    pairs of value 0 and no terms; one with a single source has no pairs. Repeated rows count as often as they occur; no rows give no rows; other columns are left out.
    Sums are long integers, and a result beyond them is an error.
    """
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    found = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    items = F.collect_list(F.struct("source", "n")).alias("items")
    kept = stash(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), items).filter(F.col("docs") >= min_docs), "terms")

    single = kept.select("lang", "term", "total", F.explode("items").alias("item")).select("lang", "term", "total", "item.source", "item.n")
    by_source = single.groupBy("lang", "source").agg(F.sum("n").alias("in_source"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("in_lang"))
    params = rows.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
    whole = F.coalesce("in_source", F.lit(0)) + 2 * F.col("terms")
    params = stash(params.select("lang", "source", "terms", whole.alias("whole"), (F.col("in_lang") + 2 * F.col("terms")).alias("whole_lang"), share(F.lit(0), whole).alias("p0")), "groups")

    shares = stash(single.join(params, ["lang", "source"]).select("lang", "source", "term", "n", "p0", share(F.col("n"), F.col("whole")).alias("p"), share(F.col("total"), F.col("whole_lang")).alias("q")), "shares")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    telling = telling.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    # Every other source of the language: the rows of the result, dealt to several tasks for each language.
    deal = params.select("lang", "terms", "source", "p0", F.pmod(F.xxhash64("source"), F.lit(SALTS)).alias("salt"))
    others = params.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    pairs = stash(deal.join(others, ["lang", "salt"]).filter("source <> item").select("lang", "terms", "source", "item", "p0", "q0"), "pairs")
    a, b = F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")
    nothing = distance(F.col("p0"), F.col("q0"))
    both_zero = pairs.filter("source < item").select("lang", a, b, F.coalesce(F.col("terms") * nothing, F.lit(0)).alias("value"))
    alone = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    one_zero = pairs.join(alone, ["lang", "source"]).groupBy("lang", a, b).agg(F.sum(F.col("times") * (distance(F.col("p"), F.col("q0")) - nothing)).alias("value"))
    path = F.sort_array(F.collect_list(F.struct("source", "n", "p", "p0")))
    paths = shares.groupBy("lang", "term").agg(path.alias("path")).filter("size(path) > 1").groupBy("lang", "path").agg(F.count("*").alias("times"))
    # Ranges are found by the first items alone: rows of a sample go to the driver, and whole paths would be long.
    first = [F.get("path", F.lit(k))[c] for k in range(3) for c in ("source", "n")]
    none_zero = stash(paths, "paths").repartitionByRange("lang", *first).sortWithinPartitions("lang", "path").mapInArrow(_corrected, "lang string, a string, b string, value long")
    value = both_zero.unionByName(one_zero).unionByName(none_zero).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    ranked = value.select("lang", ways.alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", F.row_number().over(best))
    return ranked.unionByName(telling)
