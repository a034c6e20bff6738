"""Line deduplication over the corpus, fuzzy lines included.

1. *Normalise.* A line's normal form is its words in lower case, one space apart. Lines with one form are one *line
   class*. A line without words always stays.
2. *SimHash.* The features of a form are its 8-grams of characters (5-grams if it is short), and its SimHash has ``BLOCKS`` blocks of 40 bits. In a
   plain SimHash one changed word moves bits all over the hash, and hardly a block of a useful size stays whole. Here every
   gram votes in one block, and the weights of a block's grams are powers of two in the order of their hashes, so the
   heaviest outvotes all others together: a block's bits are those of its heaviest gram (which makes it a minwise hash), and
   what two forms differ in moves few blocks, as wholes. A block that no gram fell to is voted on by all grams.
3. *Pigeonhole.* A form goes to ``CELLS`` cells, each of which is named by ``BLOCKS / CELLS`` blocks: SimHashes that
   differ in fewer than ``CELLS`` blocks share a cell for certain, and others often do. Long grams keep unlike lines
   apart however many there are; short forms, of which an edit changes too many of these, go by 5-grams, and those of
   lengths between go to both kinds of cells.
4. *Verify.* In each cell all are compared with one pivot first; those that reach the edit similarity
   are linked, and groups of links are found. What is left are pairs from different groups: in each cell,
   those outside the pivot's group are compared with all others, tile by tile, and verified within the tile. So large families of variants cost
   a comparison for each member rather than each pair, and no link between groups is lost.
5. *Keep one.* Of the occurrences of each connected group the first stays; the others are dropped.

Two forms are linked if they share a cell, at least ``NEAR`` of their blocks have the same last byte (unless just one is short), and
their edit similarity is reached. Tests measure which part of all pairs that reach it is found. The cells of a line family that very many lines share are found in a sample beforehand and
dealt to several tasks each, with a pivot that is known to all of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.batches import give_back, joined
from tracewright.llm.components import connected_components
from tracewright.llm.membership import bitmap, contains
from tracewright.llm.skew import join_heavy
from tracewright.storage import stash

SIMILARITY = 0.85
#: Blocks of a SimHash, and cells, each of BLOCKS / CELLS blocks.
BLOCKS, CELLS = 36, 12
#: Blocks of which two forms must share the last byte to be verified.
NEAR = 14
#: Characters of a gram, and of one in short forms.
GRAM, SHORT_GRAM = 8, 5
#: Forms of fewer characters are short; no two different forms of fewer than LEAST_CHARS reach the similarity.
SHORT_CHARS, LEAST_CHARS = 48, 7
#: Characters that are read at a time.
STEP_CHARS = 100_000
#: Words of masks that the edit distances of a step hold, roughly.
STEP_CELLS = 1 << 20
#: Pairs of one size, for each word that they fill, from which on they go in step.
FEW_PAIRS = 12
#: Pairs that are verified at a time.
VERIFY_ROWS = 10_000
#: Characters whose grams are hashed at a time, so that they stay in the processor's cache.
GRAM_STEP = 1 << 15
#: Line classes that a task keeps in mind, so as not to deal a repeated line again.
KEPT_LINES = 1_000_000
#: One of so many texts is looked at for cells that many lines share; at most HOT_CELLS are then dealt to SALTS tasks each.
SAMPLE, HOT_ROWS, HOT_CELLS, SALTS = 64, 50, 10_000, 64
#: Forms of a cell in one task, and of a cell all pairs of which are listed by one row.
TILE, SMALL_CELL = 1_000, 16
#: Pairs of a tile that are verified at a time; what these link needs no more comparisons.
TILE_PAIRS = 2_500
#: Rounds of comparisons: with a line's main pivot, with the pivots of all its cells, and of all pairs left in cells of several groups.
ROUNDS = 2
_BASE = 0x5851F42D4C957F2D
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 40) - 1)


def _folding() -> np.ndarray:
    """For each code point what it counts as: itself in lower case; nothing (zero) if it is part of no word."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalnum() or char == "_":
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


_tables: dict[str, np.ndarray] = {}


def _table(name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
    if name not in _tables:
        _tables[name] = make()
    return _tables[name]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def normal_form(line: str) -> str:
    codes = _table("fold", _folding)[_codes(line)]
    codes[codes == 0] = 32
    return " ".join(codes.tobytes().decode("utf-32-le", "surrogatepass").split())


def _powers(base: int, n: int = STEP_CHARS) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93 + 2 * turn)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _rolling(codes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``n`` codes: those of twice the length come from two of half, a code more from one of them."""
    h, size = codes, 1
    for bit in bin(n)[3:]:
        h = h[: len(h) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
        if bit == "1":
            h = h[: len(codes) - size] * np.uint64(_BASE) + codes[size:]
            size += 1
    return h


class Lines:
    """The lines with words of a text: numbers, digests (two 64-bit halves) and lengths of their forms, and the forms.

    A word's hash is a difference of running sums over all characters, and a line's digest a sum over its
    words, so nothing is done word by word.
    """

    def __init__(self, text: str) -> None:
        codes = _codes(text)
        folded = _table("fold", _folding)[codes]
        inside = np.concatenate([[False], folded != 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        lines = np.searchsorted(np.flatnonzero(codes == 10), starts)
        first = np.flatnonzero(np.diff(lines, prepend=-1))
        self.number = lines[first].astype(np.int64)
        if not len(starts):
            self.digest, self.chars = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
            return
        power, back = (_table("power", lambda: _powers(_BASE)), _table("back", lambda: _powers(pow(_BASE, -1, 1 << 64))))
        if len(codes) > STEP_CHARS:
            power, back = _powers(_BASE, len(codes)), _powers(pow(_BASE, -1, 1 << 64), len(codes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(folded.astype(np.uint64) * power[: len(codes)], dtype=np.uint64)])
        sizes = ends - starts
        words = _mixed((sums[ends] - sums[starts]) * back[starts] + sizes.astype(np.uint64), 0)
        counts = np.diff(np.append(first, len(lines)))
        self.chars = np.add.reduceat(sizes, first) + counts - 1
        place = (np.arange(len(lines)) - np.repeat(first, counts)).astype(np.uint64)
        self.digest = np.stack([_mixed(np.add.reduceat(_mixed(words + place * _PRIME, turn), first), turn) for turn in (1, 2)], axis=1)
        # The forms, end to end, each word with a space behind it.
        stream = np.append(folded, np.uint32(0))
        stream[ends] = 32
        kept = stream != 0
        self.stream, self.at = stream[kept], (np.cumsum(kept) - 1)[starts[first]]

    def form(self, k: int) -> str:
        return self.stream[self.at[k] : self.at[k] + self.chars[k]].tobytes().decode("utf-32-le", "surrogatepass")

    def blocks(self, some: np.ndarray, n: int) -> np.ndarray:
        """The SimHashes of ``some`` lines by their ``n``-grams: 40 bits for each block."""
        at, grams = self.at[some], self.chars[some] + 2 - n
        ends = np.cumsum(grams)
        out, a = np.zeros((len(some), BLOCKS), dtype=np.uint64), 0
        while a < len(some):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - grams[a] + GRAM_STEP)))
            out[a:b] = self._blocks(at[a:b], grams[a:b], n)
            a = b
        return out

    def _blocks(self, at: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
        begin, symbols = np.cumsum(grams) - grams, grams + n - 1
        first = np.cumsum(symbols) - symbols
        h = _rolling(self.stream[np.arange(symbols.sum()) + np.repeat(at - first, symbols)].astype(np.uint64), n)
        h = _mixed(h[np.arange(grams.sum()) + np.repeat(first - begin, grams)], 5)
        # A gram's block, its line's number before that, and its hash behind: the first of each is the heaviest.
        vote = (np.repeat(np.arange(len(at), dtype=np.uint64), grams) * np.uint64(BLOCKS) + (((h >> np.uint64(40)) * np.uint64(BLOCKS)) >> np.uint64(24))) << np.uint64(40)
        vote |= h & _LOW
        vote.sort()
        block = (vote >> np.uint64(40)).astype(np.int64)
        heaviest = np.flatnonzero(np.diff(block, prepend=-1))
        out, have = np.zeros(len(at) * BLOCKS, dtype=np.uint64), np.zeros(len(at) * BLOCKS, dtype=bool)
        out[block[heaviest]], have[block[heaviest]] = vote[heaviest] & _LOW, True
        empty = np.flatnonzero(~have)
        if len(empty):
            size = grams[empty // BLOCKS]
            first = np.cumsum(size) - size
            all_grams = h[np.arange(size.sum()) + np.repeat(begin[empty // BLOCKS] - first, size)]
            turned = _mixed(all_grams ^ np.repeat((empty % BLOCKS + 1).astype(np.uint64) * _PRIME, size), 6)
            out[empty] = np.minimum.reduceat(turned, first) & _LOW
        return out.reshape(len(at), BLOCKS)

    def cells(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of ``some`` lines, and the line of each."""
        chars = self.chars[some]
        names, owners = [], []
        # A short form's partners have at most this many characters, so they are in its cells as well.
        both = (chars >= LEAST_CHARS) & (chars < SHORT_CHARS / SIMILARITY)
        for n, mine in ((GRAM, some[chars >= SHORT_CHARS]), (SHORT_GRAM, some[both])):
            if len(mine):
                blocks = self.blocks(mine, n).reshape(len(mine), CELLS, BLOCKS // CELLS)
                h = np.broadcast_to(np.arange(CELLS, dtype=np.uint64) + np.uint64(n * CELLS), blocks.shape[:2])
                for k in range(BLOCKS // CELLS):
                    h = _mixed(h * _PRIME + blocks[:, :, k], 4)
                names.append(h.view(np.int64).ravel())
                owners.append(np.repeat(mine, CELLS))
        return np.concatenate(names) if names else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)


def parts(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, Lines]]:
    """The texts' lines, some texts or a part of a long one at a time: for each line its text's place and its number there."""
    a = 0
    while a < len(texts):
        b, have = a, 0
        while b < len(texts) and (b == a or have + len(texts[b] or "") < STEP_CHARS):
            have += len(texts[b] or "") + 1
            b += 1
        if b > a + 1 or have <= STEP_CHARS:
            some = [t or "" for t in texts[a:b]]
            before = np.cumsum([0, *(t.count("\n") + 1 for t in some)])
            lines = Lines("\n".join(some))
            owner = np.searchsorted(before, lines.number, side="right") - 1
            yield a + owner, lines.number - before[owner], lines
        else:  # whole lines up to STEP_CHARS; a longer line goes alone
            text, at, no = texts[a] or "", 0, 0
            while at <= len(text):
                end = len(text) if len(text) - at <= STEP_CHARS else text.rfind("\n", at, at + STEP_CHARS)
                if end < at:
                    end = text.find("\n", at)
                    end = len(text) if end < 0 else end
                lines = Lines(text[at:end])
                yield np.full(len(lines.number), a), lines.number + no, lines
                no += text.count("\n", at, end) + 1
                at = end + 1
        a = b


class _Unseen:
    """Leaves out lines that the task has had (or has had too long ago to know)."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, lines: Lines, among: np.ndarray | None = None) -> np.ndarray:
        names, at = np.unique(lines.digest[:, 0], return_index=True)
        out = []
        for name, k in zip(names.tolist(), at.tolist(), strict=True):
            if name not in self.seen and (among is None or among[k]):
                self.seen.add(name)
                out.append(k)
        if len(self.seen) > KEPT_LINES:
            self.seen.clear()
        return np.array(sorted(out), dtype=np.int64)


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two texts (code points) without what they have in common at their ends, the shorter one first."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    n = len(a)
    differ = np.flatnonzero(a != b[:n])
    k = int(differ[0]) if len(differ) else n
    a, b, n = a[k:], b[k:], n - k
    differ = np.flatnonzero(a[::-1] != b[::-1][:n]) if n else differ
    k = int(differ[0]) if n and len(differ) else n
    return a[: n - k], b[: len(b) - k]


def edit_distances(pairs: list[tuple[str, str]], limits: np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distances of many pairs in step: of each pair a column of its table at a time, in the bits of 64-bit words.

    With ``limits``, which are at least the differences in length, a distance beyond its pair's limit may come out larger than it is.
    """
    short, long = zip(*(_trimmed(_codes(a), _codes(b)) for a, b in pairs), strict=True) if pairs else ((), ())
    out = np.array([len(x) for x in long], dtype=np.int64)
    words = np.array([_width(len(x)) for x in short], dtype=np.int64)
    order = np.lexsort((-out, words))
    order = order[words[order] > 0]
    at = 0
    while at < len(order):
        w = words[order[at]]
        end = min(int(np.searchsorted(words[order], w, side="right")), at + max(1, STEP_CELLS // (int(w) * 256)))
        some = order[at:end]
        if len(some) >= FEW_PAIRS * w:
            out[some] = _in_step([short[k] for k in some], [long[k] for k in some], int(w), int(w) * 64 if limits is None else int(limits[some].max()))
        else:
            out[some] = [_in_whole_numbers(short[k], long[k]) for k in some]
        at = end
    return out


def _width(size: int) -> int:
    """Words for a text of ``size`` characters, rounded up beyond four so that more pairs are of one width."""
    words = -(-size // 64)
    step = 1 << max(0, (words - 1).bit_length() - 2)
    return -(-words // step) * step


def _in_whole_numbers(short: np.ndarray, long: np.ndarray) -> int:
    """The distance of one pair, a column in one whole number of any size; faster where few pairs are of one size."""
    masks: dict[int, int] = {}
    for k, c in enumerate(short.tolist()):
        masks[c] = masks.get(c, 0) | 1 << k
    full, last, score = (1 << len(short)) - 1, 1 << (len(short) - 1), len(short)
    up, down = full, 0
    for c in long.tolist():
        match = masks.get(c, 0)
        flat = (((match & up) + up) ^ up) | match | down
        rise, fall = down | (full & ~(flat | up)), up & flat
        score += 1 if rise & last else -1 if fall & last else 0
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | (full & ~((match | down) | rise)), rise & (match | down)
    return score


def _in_step(short: list[np.ndarray], long: list[np.ndarray], w: int, band: int) -> np.ndarray:
    """Distances of pairs whose short texts fill up to ``w`` words each; the long texts come in falling order of length.

    Of a column only the words with rows up to ``band`` off the diagonal are worked out, which hold all ways of at most ``band`` edits. Above them
    a row is taken to rise from column to column, and below them a column from row to row: no distance comes out too small.
    """
    n, sizes = len(short), np.array([len(x) for x in short])
    # The letters of the short texts get classes; all others have one whose mask is empty.
    letters = np.unique(np.concatenate(short))
    masks = np.zeros((len(letters) + 1, w, n), dtype=np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    np.bitwise_or.at(masks, (np.searchsorted(letters, np.concatenate(short)), place >> 6, owner), np.uint64(1) << (place & 63).astype(np.uint64))
    lengths = np.array([len(x) for x in long])
    flat = np.concatenate(long)
    found = np.minimum(np.searchsorted(letters, flat), len(letters) - 1)
    classes = np.full((int(lengths[0]), n), len(letters), dtype=np.int32)
    classes[np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(np.arange(n), lengths)] = np.where(letters[found] == flat, found, len(letters))
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    score, lane = sizes.astype(np.int64), np.arange(n)
    one, top = np.uint64(1), np.uint64(63)
    # The row that the score is read from, if k is the last word worked out: a text's last one, or the word's.
    end, bit = (sizes - 1) >> 6, np.uint64(1) << ((sizes - 1) & 63).astype(np.uint64)
    own = [np.where(end == k, bit, np.uint64(0)) for k in range(w)]
    edge = [np.where(end > k, one << top, own[k]) for k in range(w)]
    ending = [bool((end == k).any()) for k in range(w)]
    # Where a column rises or falls from one row to the next.
    up, down = np.full((w, n), np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros((w, n), dtype=np.uint64)
    for step, m in enumerate(live):
        carry, grown, shrunk = np.zeros(m, np.uint64), np.ones(m, np.uint64), np.zeros(m, np.uint64)
        mine = classes[step, :m]
        low, high = max(0, (step - band) >> 6), min(w - 1, (step + band) >> 6)
        for k in range(low, high + 1):
            u, d, match = up[k, :m], down[k, :m], masks[mine, k, lane[:m]]
            part = match & u
            total = part + u
            over = total < part
            total += carry
            over |= total < carry
            flat_way = (total ^ u) | match | d
            carry = over.astype(np.uint64)
            rise, fall = d | ~(flat_way | u), u & flat_way
            if k == high or ending[k]:
                read = (edge if k == high else own)[k][:m]
                score[:m] += ((rise & read) != 0).astype(np.int64) - ((fall & read) != 0)
            next_rise, next_fall = rise >> top, fall >> top
            rise, fall = (rise << one) | grown, (fall << one) | shrunk
            grown, shrunk = next_rise, next_fall
            match = match | d
            up[k, :m], down[k, :m] = fall | ~(match | rise), rise & match
    return score


def edit_distance(a: str, b: str) -> int:
    return int(edit_distances([(a, b)])[0])


def similar_pairs(pairs: list[tuple[str, str]], least: float = SIMILARITY) -> np.ndarray:
    """Which pairs have 1 - distance / longer length of at least ``least``; two empty texts are equal."""
    longer = np.array([max(len(a), len(b), 1) for a, b in pairs], dtype=np.int64)
    fits = np.array([abs(len(a) - len(b)) for a, b in pairs], dtype=np.int64) <= (1 - least) * longer
    out = np.zeros(len(pairs), dtype=bool)
    some = np.flatnonzero(fits)
    limits = ((1 - least) * longer[some]).astype(np.int64) + 1
    out[some] = 1 - edit_distances([pairs[k] for k in some], limits) / longer[some] >= least
    return out


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    return bool(similar_pairs([(a, b)], least)[0])


def _keys(digest: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(digest).tobytes()
    return [raw[k : k + 16] for k in range(0, len(raw), 16)]


def _lines(rows: DataFrame) -> DataFrame:
    """``doc_id, body, line_no, key`` of every line with words; ``key`` is the form's digest."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back("line_dedup")
        for batch in batches:
            for owner, number, lines in parts(batch.column("text").to_pylist()):
                # Taken in Arrow, so that ids of any type keep their values and nulls.
                own = [batch.column(c).take(pa.array(owner)) for c in ("doc_id", "body")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(number.astype(np.int32)), pa.array(_keys(lines.digest), pa.binary())], ["doc_id", "body", "line_no", "key"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(split, f"doc_id {kind}, body long, line_no int, key binary")


def _dealt(rows: DataFrame) -> DataFrame:
    """``cell, line`` of every form; ``line`` is the first half of its digest. A task deals a repeated line once."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back("line_dedup")
        unseen = _Unseen()
        for batch in batches:
            for _, _, lines in parts(list(batch["text"])):
                cell, owner = lines.cells(unseen(lines))
                yield pd.DataFrame({"cell": cell, "line": lines.digest[owner, 0].view(np.int64)})

    return rows.select("text").mapInPandas(deal, "cell long, line long")


def _met(rows: DataFrame) -> DataFrame:
    """``cell, line, pivot`` of the cells that several lines have.

    There is one exchange of all cells. Those that many lines of the sample have are dealt to several tasks, and their pivot comes
    from the sample; a cell that the sample does not show as large is complete in one task.
    """
    shown = _dealt(rows.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)).groupBy("cell", "line").agg(F.count("*").alias("n"))
    shown = shown.groupBy("cell").agg(F.sum("n").alias("n"), F.max_by("line", F.struct("n", "line")).alias("known"))
    hot = stash(shown.filter(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "cell").limit(HOT_CELLS).select("cell", "known"), "hot-cells")
    salt = F.when(F.col("known").isNull(), 0).otherwise(F.pmod(F.col("line"), F.lit(SALTS)))
    # As many tasks as the session deals rows to, not fewer larger ones: a task sorts all its cells.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(rows).join(F.broadcast(hot), "cell", "left").withColumn("salt", salt).repartition(parts, "cell", "salt")
    own = Window.partitionBy("cell", "salt")
    met = dealt.withColumns({"low": F.min("line").over(own), "high": F.max("line").over(own)}).filter("known IS NOT NULL OR low <> high")
    # The pivot is the line that most tasks have: variants are mostly of a frequent line, and nearer to it than to each other.
    met = met.withColumn("often", F.count("*").over(Window.partitionBy("cell", "salt", "line")))
    return met.select("cell", "line", F.coalesce("known", F.max(F.struct("often", "line")).over(own)["line"]).alias("pivot"))


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``line, key, chars, blocks, form`` of the lines in ``wanted``. A broadcast bitmap leaves out most others before the join."""
    has = bitmap(wanted, "line", hashed=True)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back("line_dedup")
        unseen = _Unseen()
        for batch in batches:
            for _, _, lines in parts(list(batch["text"])):
                some = unseen(lines, contains(has.value, (lines.digest[:, 0] & np.uint64(len(has.value) * 8 - 1)).astype(np.int64)))
                last, chars = np.zeros((len(some), BLOCKS), np.uint8), lines.chars[some]
                for n, mine in ((GRAM, np.flatnonzero(chars >= SHORT_CHARS)), (SHORT_GRAM, np.flatnonzero((chars >= LEAST_CHARS) & (chars < SHORT_CHARS)))):
                    if len(mine):
                        last[mine] = (lines.blocks(some[mine], n) & np.uint64(255)).astype(np.uint8)
                yield pd.DataFrame({"line": lines.digest[some, 0].view(np.int64), "key": _keys(lines.digest[some]), "chars": lines.chars[some], "blocks": [x.tobytes() for x in last], "form": pd.Series([lines.form(k) for k in some], dtype=object)})

    found = rows.select("text").mapInPandas(pick, "line long, key binary, chars int, blocks binary, form string")
    return found.join(wanted, "line", "left_semi").dropDuplicates(["line", "key"])


def _near(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of last bytes ``x, y`` and lengths ``m, n`` are to be verified."""
    fits = np.abs(m - n) <= (1 - least) * np.maximum(m, n)
    # A short form and one that isn't have blocks of different grams.
    return fits & (((m < SHORT_CHARS) != (n < SHORT_CHARS)) | ((x == y).sum(axis=-1) >= NEAR))


def _block_array(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, BLOCKS)


def _verified(pairs: DataFrame, texts: DataFrame, on: str, least: float) -> DataFrame:
    """``a, b``: keys of the pairs (of keys or of their halves, as ``on`` says) whose forms reach the edit similarity."""
    x, y = (texts.select(F.col(on).alias(k), F.col("key").alias(f"key_{k}"), F.col("chars").alias(f"chars_{k}"), F.col("blocks").alias(f"blocks_{k}"), F.col("form").alias(f"form_{k}")) for k in "ab")
    few = ["key", "chars", "blocks"]
    rows = pairs.join(x.select("a", *[f"{c}_a" for c in few]), "a").join(y.select("b", *[f"{c}_b" for c in few]), "b")
    rows = rows.filter(F.abs(F.col("chars_a") - F.col("chars_b")) <= (1 - least) * F.greatest("chars_a", "chars_b"))

    def comparable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = _near(_block_array(batch["blocks_a"]), _block_array(batch["blocks_b"]), batch["chars_a"].to_numpy(), batch["chars_b"].to_numpy(), least)
            yield batch.loc[ok, ["key_a", "key_b"]]

    near = stash(rows.select(*[f"{c}_{k}" for k in "ab" for c in few]).mapInPandas(comparable, "key_a binary, key_b binary"), "near-lines")
    rows = near.join(x.select("key_a", "form_a"), "key_a").join(y.select("key_b", "form_b"), "key_b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        give_back("line_dedup")
        for batch in joined(batches, VERIFY_ROWS):
            ok = similar_pairs(list(zip(batch["form_a"], batch["form_b"], strict=True)), least)
            yield pd.DataFrame({"a": batch["key_a"][ok], "b": batch["key_b"][ok]})

    return rows.mapInPandas(verify, "a binary, b binary")


def _small_cell_pairs(left: DataFrame, least: float) -> DataFrame:
    """``a, b``: pairs of keys from different components and of fitting lengths, in cells of up to ``SMALL_CELL`` forms."""
    members = left.groupBy("cell").agg(F.array_sort(F.collect_set(F.struct("chars", "key", "component"))).alias("m"))

    def partners(x: Column, k: Column) -> Column:
        later = F.filter("m", lambda y, j: (j > k) & (y["component"] != x["component"]) & (x["chars"] >= least * y["chars"]))
        return F.transform(later, lambda y: F.struct(F.least(x["key"], y["key"]).alias("a"), F.greatest(x["key"], y["key"]).alias("b")))

    return members.select(F.explode(F.flatten(F.transform("m", partners))).alias("p")).select("p.*")


def _search_cells(left: DataFrame, least: float) -> DataFrame:
    """``a, b``: links between different components within cells, enough of them to connect all that are linked there.

    ``left`` has ``cell, key, chars, blocks, form, component``, the number ``n`` of the cell's forms, and all ``cells`` of its kind that the form is in.
    Pairs are verified where they meet, so only links leave a task; a pair that meets in several cells is verified in one of them.
    """
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("key"), tiles).cast("int")
    # Of a cell in k tiles, a form goes to the k pairs of its own tile with each.
    dealt = left.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), tiles - 1)))
    dealt = dealt.select("cell", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "key", "chars", "blocks", "form", "cells", "component")

    def search(tile: pd.DataFrame, cell: int, i: int, j: int) -> list[tuple[bytes, bytes]]:
        x, y = (np.flatnonzero(tile["own"] == k) for k in (i, j))
        chars, blocks, out = tile["chars"].to_numpy(), _block_array(tile["blocks"]), []
        component, key, form = pd.factorize(tile["component"])[0], tile["key"].to_numpy(), tile["form"].to_numpy()
        cells, waiting = [frozenset(c.tolist()) for c in tile["cells"]], []

        def here(k: int, m: int) -> bool:
            common = sorted(cells[k] & cells[m])
            return common[(key[k][0] + key[m][0]) % len(common)] == cell

        def verify() -> None:
            for (k, m), ok in zip(waiting, similar_pairs([(form[k], form[m]) for k, m in waiting], least), strict=True):
                if ok and component[k] != component[m]:
                    out.append((min(key[k], key[m]), max(key[k], key[m])))
                    component[component == component[m]] = component[k]
            waiting.clear()

        y = y[np.argsort(chars[y], kind="stable")]
        for k in x:  # against those of a fitting length
            some = y[np.searchsorted(chars[y], chars[k] * least) : np.searchsorted(chars[y], chars[k] / least + 1, side="right")]
            some = some[component[some] != component[k]]
            some = some[_near(blocks[some], blocks[k], chars[some], chars[k], least)]
            waiting += [(k, m) for m in some if (i != j or key[k] < key[m]) and here(k, m)]
            if len(waiting) >= TILE_PAIRS:
                verify()
        verify()
        return out

    def search_tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by tile; one may go on in the next batch, and has 2 TILE rows or so."""
        give_back("line_dedup")
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
                out += search(waiting.iloc[a:b], *tile[a].tolist())
                a = b
            waiting = waiting.iloc[a:].reset_index(drop=True)
            yield pd.DataFrame(out, columns=["a", "b"])

    count = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(count, "cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInPandas(search_tiles, "a binary, b binary")


def line_links(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``a, b``: keys of linked forms, enough of them that all linked forms are connected. ``rows`` has the ``text``."""
    met = stash(_met(rows), "line-cells")
    texts = stash(_texts(rows, met.select("line").distinct()), "line-texts")
    traits = texts.select("line", "key", "chars", "blocks")
    # Each line is first compared with the pivot that it meets in most cells.
    by_pivot = met.filter("line <> pivot").groupBy("line", "pivot").agg(F.count("*").alias("cells"))
    spanning = by_pivot.groupBy("line").agg(F.max_by("pivot", F.struct("cells", "pivot")).alias("a")).select("a", F.col("line").alias("b"))
    links = stash(_verified(spanning, texts, "line", least), "line-links")
    for turn in range(ROUNDS):
        groups = connected_components(links).withColumnRenamed("node", "key")
        # Where all forms of a cell are in one group, nothing more can be learned from it.
        grouped = stash(traits.join(groups, "key", "left").withColumn("component", F.coalesce("component", "key")), "line-traits")
        named = met.select("cell", "line").distinct().join(grouped.select("line", "component"), "line")
        mixed = named.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).filter("low <> high").select("cell", "n")
        left = stash(met.select("cell", "line", "pivot").distinct().join(mixed, "cell"), "mixed-line-cells")
        if left.isEmpty():
            return links
        if turn < ROUNDS - 1:  # large families of variants come together by the pivots of all their cells
            ends = [grouped.select(F.col("line").alias(c), F.col("component").alias(f"{c}_component")) for c in ("pivot", "line")]
            pairs = left.select("line", "pivot").distinct().join(ends[0], "pivot").join(ends[1], "line").filter("pivot_component <> line_component").select(F.col("pivot").alias("a"), F.col("line").alias("b"))
            more = _verified(pairs, texts, "line", least)
        else:
            left = left.drop("pivot").distinct()
            small = left.filter(F.col("n") <= SMALL_CELL).join(grouped.select("line", "key", "chars", "component"), "line")
            large = left.filter(F.col("n") > SMALL_CELL)
            cells = large.groupBy("line").agg(F.collect_set("cell").alias("cells"))
            members = cells.join(grouped, "line").join(texts.select("key", "form"), "key")
            more = _verified(_small_cell_pairs(small, least).distinct(), texts, "key", least).unionByName(_search_cells(large.join(members, "line"), least))
        links = stash(links.unionByName(more), "line-links")
    return links


def line_groups(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, body, line_no, group_id, kept`` of every line that has others like it; ``rows`` has ``doc_id, text`` and the text's hash ``body``."""
    lines = stash(_lines(rows), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body", "line_no")
    classes = lines.groupBy("key").agg(F.min(place).alias("place"), F.count("*").alias("n"))
    groups = connected_components(line_links(rows, least)).withColumnRenamed("node", "key")
    found = classes.join(groups, "key", "left").filter("n > 1 OR component IS NOT NULL").withColumn("group_id", F.coalesce("component", "key"))
    found = stash(found.select("key", "group_id", "place", "n"), "line-classes")
    first = found.groupBy("group_id").agg(F.min("place").alias("first"), F.count("*").alias("members"))
    found = stash(join_heavy(found.select("key", "group_id", "n"), first, "group_id", "members", ["key"]).select("key", "group_id", "first", "n"), "line-groups")
    return join_heavy(lines, found, "key", "n", ["doc_id", "body", "line_no"]).select("doc_id", "body", "line_no", "group_id", (place == F.col("first")).alias("kept"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """All rows of ``docs``, with the dropped lines taken out of their texts, and ``n_lines, n_dropped``.

    Of each group of alike lines the occurrence in the smallest ``doc_id`` (a null one is the largest),
    and there the first, stays. Lines are what newlines part; those kept are joined by newlines
    again. A null text stays null with 0 lines, an empty text is one line; lines without words stay. Rows that repeat a
    ``doc_id`` with another text are ordered by the text's hash; those that repeat both are taken for one
    document, and none of its lines goes on account of the repetition. An empty table stays empty.
    Other columns stay as they are, whatever their names, but ``n_lines`` and ``n_dropped`` are replaced.
    """
    # One column holds a whole row, so that no inner name can clash with one of its own.
    docs = docs.drop("n_lines", "n_dropped")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own_id, own_text = F.col("row").getField(doc_id), F.col("row").getField(text)
    rows = packed.select(own_id.alias("doc_id"), own_text.alias("text"), F.xxhash64(own_text).alias("body"))
    gone = line_groups(rows, least).filter("NOT kept").groupBy(F.col("doc_id").alias("id"), "body").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))
    found = packed.withColumn("body", F.xxhash64(own_text)).join(gone.withColumnRenamed("body", "of").hint("shuffle_hash"), own_id.eqNullSafe(F.col("id")) & (F.col("body") == F.col("of")), "left")

    @F.pandas_udf("string")
    def without(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        out = []
        for t, some in zip(texts, numbers, strict=True):
            if some is None:
                out.append(None)
                continue
            drop = set(some.tolist())
            out.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop))
        return pd.Series(out, dtype=object)

    shorter = without(F.when(F.col("gone").isNotNull(), own_text), F.col("gone"))
    found = found.withColumn("shorter", shorter)
    out = {c: F.col("row").getField(c) for c in docs.columns} | {text: F.coalesce("shorter", own_text)}
    n_lines = F.coalesce(F.length(own_text) - F.length(F.replace(own_text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    n_dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return found.select(*[c.alias(k) for k, c in out.items()], n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))
