"""Best-fit packing by patterns of lengths.

Pieces of documents are packed into sequences of ``capacity`` tokens. Only the histogram of piece
lengths (at most ``capacity`` numbers) reaches the driver. There, patterns are enumerated: sets of a few
lengths that fill a sequence (almost) exactly. Non-negative least squares finds how often each
pattern should be used so that the patterns' lengths add up to the histogram; the counts are rounded
down, and what remains is packed best-fit, longest first, in runs of equal sequences. The plan is
a list of (pattern, how many sequences).

Then every piece is given a rank among the pieces of its length, in parallel: pieces are counted by
(length, slot of a hash of the document), so even a length that a third of all pieces have is
ranked in many tasks. The rank says which pattern, sequence and offset the piece gets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.batches import give_back
from tracewright.llm.encoding import encoder, worker_path
from tracewright.storage import stash

#: Pairs and triples of lengths that the least squares may choose from, at most.
PATTERNS = 60_000
#: Sweeps of the least squares.
SWEEPS = 60
#: Pieces to rank in one task, about.
RANKED = 50_000


def pieces(docs: DataFrame, doc_id: str, text: str, capacity: int, vocabulary: str, end_id: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids and one end id, cut at ``capacity``.

    The first piece takes what is left over, so all others are full.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, end = encoder(worker_path(vocabulary)), end_id.to_bytes(4, "little")
        for batch in batches:
            out = []
            for name, value in zip(batch["doc_id"], batch["text"], strict=True):
                ids = units.encode(value or "") + end
                n = len(ids) // 4
                a, b = 0, (n - 1) % capacity + 1
                piece = 0
                while a < n:
                    out.append((name, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                    a, b, piece = b, b + capacity, piece + 1
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Sets of one, two, three or four lengths that fill a sequence, the fullest for each choice.

    All pairs are tried. Triples and fours add to a pair of lengths (every length with partners spread
    over the others) the longest length that still fits, then again.
    """
    have = lengths[np.argsort(lengths)]
    found: set[tuple[int, ...]] = {(int(x),) for x in have}
    partners = max(1, PATTERNS // (3 * len(have)))
    for k, x in enumerate(have):
        room = capacity - int(x)
        fit = np.searchsorted(have, room, side="right") - 1
        if fit >= 0:
            found.add(tuple(sorted((int(x), int(have[fit])), reverse=True)))
        usable = have[: max(0, fit + 1)]
        usable = usable[usable <= x]
        for y in usable[np.unique(np.linspace(0, len(usable) - 1, min(partners, len(usable))).astype(int))] if len(usable) else []:
            left = room - int(y)
            chosen = [int(x), int(y)]
            while left > 0 and len(chosen) < 5:
                fit = np.searchsorted(have, left, side="right") - 1
                if fit < 0:
                    break
                chosen.append(int(have[fit]))
                left -= chosen[-1]
                found.add(tuple(sorted(chosen, reverse=True)))
    # Patterns that waste more than a hundredth lose to packing the residuals.
    return sorted((p for p in found if sum(p) >= capacity * 0.99), reverse=True)


def least_squares(chosen: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts x that bring A x close to ``counts``, by coordinate descent.

    A[length, pattern] is how often the pattern has the length; each step solves one coordinate
    exactly and cuts it at 0, which converges to the constrained minimum.
    """
    at = {int(x): k for k, x in enumerate(lengths)}
    columns = []
    for p in chosen:
        rows, times = np.unique([at[x] for x in p], return_counts=True)
        columns.append((rows, times.astype(float), float((times**2).sum())))
    x = np.zeros(len(chosen))
    residual = counts.astype(float).copy()
    order = np.random.default_rng(0).permutation(len(chosen))
    for _ in range(SWEEPS):
        moved = 0.0
        for k in order:
            rows, times, norm = columns[k]
            step = max(-x[k], float(residual[rows] @ times) / norm)
            if step:
                x[k] += step
                residual[rows] -= step * times
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), which use up the histogram exactly."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    out: list[tuple[tuple[int, ...], int]] = []
    if full := left.pop(capacity, 0):
        out.append(((capacity,), full))
    if left:
        lengths = np.array(sorted(left))
        counts = np.array([left[int(x)] for x in lengths])
        chosen = patterns(lengths, counts, capacity)
        if chosen:
            times = least_squares(chosen, lengths, counts)
            for k in np.argsort(-times, kind="stable"):
                want = int(times[k] + 1e-9)
                if want <= 0:
                    break
                need = {x: chosen[k].count(x) for x in chosen[k]}
                use = min([want, *(left.get(x, 0) // n for x, n in need.items())])
                if use > 0:
                    out.append((chosen[k], use))
                    for x, n in need.items():
                        left[x] -= n * use
    out += residuals({k: v for k, v in left.items() if v}, capacity)
    return out


def residuals(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, in runs: a sequence is repeated as often as its lengths allow."""
    out = []
    while left:
        have = sorted(left)
        room, chosen = capacity, []
        take = dict.fromkeys(have, 0)
        while True:
            fit = next((x for x in reversed(have) if x <= room and left[x] > take[x]), None)
            if fit is None:
                break
            # What goes with the longest is chosen so that it fills the room, if one or two lengths can.
            if chosen and len(have) > 1:
                best = fit
                for x in reversed(have):
                    if x <= room and left[x] > take[x] and (y := room - x) in left and left[y] > take[y] + (x == y):
                        best = x
                        break
                fit = best
            chosen.append(fit)
            take[fit] += 1
            room -= fit
        use = min(left[x] // n for x, n in take.items() if n)
        out.append((tuple(sorted(chosen, reverse=True)), use))
        for x, n in take.items():
            left[x] -= n * use
            if not left[x]:
                del left[x]
    return out


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which rank on, which sequence (the first of a run) and which offset.

    Ranks of a length are dealt to its slots in the order of the plan, a run of sequences at a time.
    """
    slots: dict[int, list[tuple[int, int, int]]] = {}
    upto: dict[int, int] = {}
    first = 0
    for chosen, times in planned:
        offset = 0
        for x in chosen:
            slots.setdefault(x, []).append((upto.get(x, 0), first, offset))
            upto[x] = upto.get(x, 0) + times
            offset += x
        first += times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*found, strict=True)) for x, found in slots.items()}


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row.

    A document is its ids and one end id; a null or empty text is the end id alone. Only longer
    documents are cut, and all pieces but the first are full. Repeated rows are packed as often as
    they occur; an empty table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    cut = stash(pieces(docs, doc_id, text, capacity, vocabulary, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = spark.sparkContext.broadcast(places(plan(histogram, capacity)))
    n_slots = max(1, -(-max(histogram.values(), default=0) // RANKED))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slotted = cut.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(n_slots, parts))).cast("int"))
    # How many pieces of a length lie in earlier slots: (lengths x slots) rows.
    sizes = slotted.groupBy("length", "slot").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("length", "slot", before.alias("before"))
    ranked = slotted.join(starts, ["length", "slot"])
    order = Window.partitionBy("length", "slot").orderBy("doc_id", "piece")
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(order) - 1)

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        give_back("packing")  # all texts are encoded by now
        for length, rank in batches:
            out = np.zeros((len(length), 2), dtype=np.int64)
            lengths, ranks = length.to_numpy(), rank.to_numpy()
            for x in np.unique(lengths):
                rows = np.flatnonzero(lengths == x)
                since, first, offset = at.value[int(x)]
                k = np.searchsorted(since, ranks[rows], side="right") - 1
                out[rows, 0] = first[k] + ranks[rows] - since[k]
                out[rows, 1] = offset[k]
            yield pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = ranked.withColumn("_place", place("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset")
