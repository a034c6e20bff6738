"""Language identification by cross-parsing.

For every language a suffix automaton is built of labelled text: from its root it spells exactly the
substrings of that text. Parsing a document against it means following the automaton as long as
it goes on, which yields the longest match; there a phrase ends and the next begins at the root. A
document takes few phrases against text of its own language. The language with the fewest
phrases for each character wins.

An automaton is kept as a table of (state, character class); where it does not go on, the entry
leads to where the character leads from the root and is marked as the end of a phrase. So all texts
of a batch are parsed in step by table look-ups. The table has the most frequent letters; what the automaton
does on each other letter of the sample is kept as sorted (state, class) keys, so that scripts with many letters
are told apart as well. Texts are parsed in blocks of ``BLOCK`` characters at once, which bounds the work in step however long
a text is; then the phrase at the end of each block is followed into the next one, until a phrase begins at a place where one does there
as well. So the phrases are those of the whole text.

Training text is a bounded sample: whole texts of at most ``TRAIN_CHARS`` characters over all languages, shared evenly, of
the labelled documents that come first by a hash of their id. Everything else covers all rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.batches import give_back

#: Characters of labelled text for all languages together.
TRAIN_CHARS = 120_000
#: Texts of each language among which the training texts are sought.
CANDIDATES = 200
#: Character classes in an automaton's table: the most frequent letters of the sample; its other letters have classes from here on.
CLASSES = 64
BLOCK = 256
#: Characters (of one language) that are parsed in step.
STEP_CHARS = 1 << 20
END = np.int32(1 << 30)


class Alphabet:
    """Maps code points to classes; learned from the training text."""

    def __init__(self, texts: list[str]) -> None:
        counts = Counter(c for t in texts for c in t.lower() if c.isalpha())
        letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        frequent, others = sorted(letters[: CLASSES - 2]), sorted(letters[CLASSES - 2 :])
        self.size = len(frequent) + 2
        self.total = self.size + len(others)
        # Class 0: what is no letter; class 1: letters that the sample lacks.
        classes = {c: k + 2 for k, c in enumerate(frequent + others)}
        self.table = np.zeros(0x110000, dtype=np.uint16 if self.total < 1 << 16 else np.uint32)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                self.table[code] = classes.get(char) or classes.get(char.lower(), 1)

    def classes(self, text: str) -> np.ndarray:
        return self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def squeezed(classes: np.ndarray) -> np.ndarray:
    """Runs of what is no letter as one mark."""
    gap = classes == 0
    return classes[~(gap & np.concatenate([[True], gap[:-1]]))] if len(classes) else classes


def suffix_table(symbols: list[int], size: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The automaton of ``symbols``: a table of next states, plus END where a phrase ends before the symbol, for symbols below ``size``.

    For those from there up to ``total``, the keys ``state * total + symbol`` of its transitions, in order, and their next states.
    """
    links, lengths, edges = [-1], [0], [{}]
    last = 0
    for c in symbols:
        new = len(edges)
        edges.append({})
        lengths.append(lengths[last] + 1)
        links.append(0)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = new
            p = links[p]
        if p != -1:
            q = edges[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                while p != -1 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = links[p]
                links[q] = links[new] = copy
        last = new
    root = np.zeros(size, dtype=np.int32)
    for c, to in edges[0].items():
        if c < size:
            root[c] = to
    table = np.tile(root | END, (len(edges), 1))
    others = []
    for state, out in enumerate(edges):
        for c, to in out.items():
            if c < size:
                table[state, c] = to
            else:
                others.append((state * total + c, to))
    # At the root a symbol that the language lacks is a phrase of its own.
    keys, targets = np.array(sorted(others), dtype=np.int64).reshape(-1, 2).T
    return table.ravel(), np.ascontiguousarray(keys), targets.astype(np.int32)


class CrossParser:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        self.alphabet = Alphabet([t for k in self.languages for t in samples[k]])
        self.tables = []
        for k in self.languages:
            parts = [squeezed(self.alphabet.classes(t)) for t in samples[k]]
            flat = np.concatenate([np.append(p, 0).astype(p.dtype) for p in parts]) if parts else np.zeros(1, np.uint8)
            self.tables.append(suffix_table(flat.tolist(), self.alphabet.size, self.alphabet.total))

    def _step(self, automaton: tuple[np.ndarray, np.ndarray, np.ndarray], state: np.ndarray, symbols: np.ndarray, whole: bool) -> np.ndarray:
        """What the table would have for each state and symbol; ``whole`` if it has all symbols."""
        table, keys, targets = automaton
        if whole:
            return table[state * self.alphabet.size + symbols]
        inside = symbols < self.alphabet.size
        to = table[state * self.alphabet.size + np.where(inside, symbols, 0)]
        at = np.flatnonzero(~inside)
        if len(at):
            to[at] = END  # a letter that the language lacks
            for begin, mark in ((np.zeros(len(at), np.int64), END), (state[at].astype(np.int64), np.int32(0))):
                want = begin * self.alphabet.total + symbols[at]
                place = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
                hit = keys[place] == want if len(keys) else np.zeros(len(at), dtype=bool)
                to[at[hit]] = targets[place[hit]] | mark
        return to

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: phrases by language, symbols parsed, letters."""
        rows = [squeezed(self.alphabet.classes(t)) if t else np.zeros(0, self.alphabet.table.dtype) for t in texts]
        letters = np.array([int((r > 0).sum()) for r in rows], dtype=np.int64)
        counts = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        if not len(owner):
            return counts, sizes, letters
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = first[owner] + within * BLOCK
        width = np.minimum(sizes[owner] - within * BLOCK, BLOCK)
        flat = np.concatenate(rows).astype(np.int32)
        order = np.argsort(-width, kind="stable")  # so that those still being parsed are a prefix
        for k, automaton in enumerate(self.tables):
            begins, last = np.zeros((len(owner), BLOCK), dtype=bool), np.zeros(len(owner), dtype=np.int32)
            for a in range(0, len(order), STEP_CHARS // BLOCK):
                some = order[a : a + STEP_CHARS // BLOCK]
                self._parse_blocks(automaton, flat, starts[some], width[some], some, begins, last)
            found = begins.sum(axis=1, dtype=np.int64)
            more = self._join_blocks(automaton, flat, starts, width, within, begins, last)
            counts[:, k] = np.bincount(owner, weights=found + more, minlength=len(texts)).astype(np.int64)
        return counts, sizes, letters

    def _parse_blocks(self, automaton: tuple, flat: np.ndarray, starts: np.ndarray, width: np.ndarray, some: np.ndarray, begins: np.ndarray, last: np.ndarray) -> None:
        """Parse blocks from the root, the longest first: where phrases begin, and the last state."""
        live = np.searchsorted(-width, -np.arange(1, width[0] + 1), side="right")  # blocks longer than each step
        # One step's symbols stand together.
        grid = flat[np.minimum(starts[None, :] + np.arange(width[0])[:, None], len(flat) - 1)]
        whole = (grid < self.alphabet.size).all(axis=1)
        state, new = np.zeros(len(some), dtype=np.int32), np.zeros((int(width[0]), len(some)), dtype=bool)
        for step in range(int(width[0])):
            n = live[step]
            to = self._step(automaton, state[:n], grid[step, :n], whole[step])
            # A phrase also begins at the root: at the start, and behind a letter that the language lacks.
            new[step, :n] = (to >> 30).astype(bool) | (state[:n] == 0)
            state[:n] = to & (END - 1)
        begins[some, : width[0]] = new.T
        last[some] = state

    def _join_blocks(self, automaton: tuple, flat: np.ndarray, starts: np.ndarray, width: np.ndarray, within: np.ndarray, begins: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Parse on over the ends of blocks, until a phrase begins where one does in the next block's own parse; from there on both agree.

        Returns what this adds to each block's number of phrases. Where the two never agree, as in texts of one word, the block after is
        parsed from the carried parse's last state, one block of each text in a round, and the blocks behind are right again once they agree.
        """
        more, own = np.zeros(len(width), dtype=np.int64), begins.sum(axis=1, dtype=np.int64)

        def carry(live: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Parse ``live`` blocks from ``state``; which of them don't come to agree, and their last states."""
            carried, apart, behind = np.zeros(len(live), dtype=np.int64), [live[:0]], [state[:0]]
            for step in range(BLOCK + 1):
                ended = step >= width[live]
                if ended.any():
                    more[live[ended]] = carried[ended] - own[live[ended]]
                    apart.append(live[ended])
                    behind.append(state[ended])
                    live, state, carried = live[~ended], state[~ended], carried[~ended]
                if not len(live):
                    break
                symbols = flat[starts[live] + step]
                to = self._step(automaton, state, symbols, bool((symbols < self.alphabet.size).all()))
                new = (to >> 30).astype(bool) | (state == 0)
                met = new & begins[live, step]
                more[live[met]] = carried[met] - begins[live[met], :step].sum(axis=1)
                live, state, carried = live[~met], (to & (END - 1))[~met], (carried + new)[~met]
            apart, behind = np.concatenate(apart), np.concatenate(behind)
            order = np.argsort(apart)
            return apart[order], behind[order]

        joined = np.flatnonzero(within > 0)
        apart, behind = carry(joined, last[joined - 1])
        # Behind a block that doesn't agree another one of the same text follows (else nothing depends on it).
        inside = np.append(within[1:] > 0, False)
        apart, behind = apart[inside[apart]], behind[inside[apart]]
        text = np.cumsum(within == 0)
        at = np.unique(text[apart], return_index=True)[1]
        live, state = apart[at] + 1, behind[at]
        while len(live):
            still, states = carry(live, state)
            done = np.setdiff1d(live, still)
            # Those that agree go on at the next block of their text that didn't, if there is one.
            next_at = np.searchsorted(apart, done, side="right")
            there = next_at < len(apart)
            done, next_at = done[there], next_at[there]
            next_at = next_at[text[apart[next_at]] == text[done]]
            goes_on = inside[still]
            live = np.concatenate([still[goes_on] + 1, apart[next_at] + 1])
            state = np.concatenate([states[goes_on], behind[next_at]])
        return more

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Languages and scores; texts of together some ``STEP_CHARS`` characters (or one longer one) are parsed at a time."""
        names, scores, a = [], [], 0
        while a < len(texts):
            b, have = a, 0
            while b < len(texts) and (b == a or have + len(texts[b]) <= STEP_CHARS):
                have += len(texts[b])
                b += 1
            some = self._predict(texts[a:b])
            names += some[0]
            scores += some[1]
            a = b
        return names, scores

    def _predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        counts, sizes, letters = self.phrases(texts)
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        rate = counts / np.maximum(sizes, 1)[:, None]
        best = rate.argmin(axis=1)
        # Like posterior odds: a phrase costs about the same whatever the language.
        odds = np.exp(-4.0 * (counts - counts.min(axis=1, keepdims=True)) / np.sqrt(np.maximum(sizes, 1))[:, None])
        score = 1.0 / odds.sum(axis=1)
        named = letters > 0
        return [self.languages[b] if ok else "und" for b, ok in zip(best, named, strict=True)], np.where(named, score, 0.0).tolist()


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows kept from training: those whose crc32 of the id as text leaves no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_sample(docs: DataFrame, doc_id: str, text: str, lang: str, chars: int = TRAIN_CHARS) -> dict[str, list[str]]:
    """Whole labelled texts by language, together at most ``chars`` characters; a language of which no text fits into its share has its shortest candidate.

    The rows of each language are taken in order of a hash of their id, and those that don't fit any more are passed over. To find them without
    ordering all rows, each task keeps the smallest hashes: an aggregate per (language, hash slot). Only then the chosen texts are fetched.
    """
    rows = docs.filter(F.col(lang).isNotNull() & (F.length(F.col(text)) > 0) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id).cast("string")).alias("h"), F.col(text).alias("text"))
    sizes = rows.select("lang", F.pmod("h", F.lit(CANDIDATES)).alias("slot"), F.struct("h", F.length("text").alias("n")).alias("row"))
    sample: dict[str, list[tuple[int, int]]] = {}
    for r in sizes.groupBy("lang", "slot").agg(F.min("row").alias("row")).collect():
        sample.setdefault(r["lang"], []).append((r["row"]["h"], r["row"]["n"]))
    each = chars // max(1, len(sample))
    chosen = []
    for k, found in sample.items():
        have = 0
        for h, n in sorted(found):
            if have + n <= each:
                chosen.append((k, h, n))
                have += n
        if not have:
            n, h = min((n, h) for h, n in found)
            chosen.append((k, h, n))
    out: dict[str, list[str]] = {k: [] for k in sample}
    if chosen:
        picked = docs.sparkSession.createDataFrame(chosen, "lang string, h long, n int")
        # Rows with the same id have the same hash; of those with the chosen length one is taken.
        texts = rows.join(F.broadcast(picked), (rows["lang"] == picked["lang"]) & (rows["h"] == picked["h"]) & (F.length("text") == picked["n"]), "left_semi")
        for r in texts.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h").collect():
            out[r["lang"]].append(r["text"])
    return out


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", chars: int = TRAIN_CHARS, keep: list[str] | None = None) -> DataFrame:
    """``doc_id`` (or the columns named in ``keep``), ``held_out, lang_pred, score`` for every row.

    Learns only from rows with text and a label whose crc32 of the id is not 0 modulo 5. A text that is
    null or has no letter is ``und`` with score 0; so is every text if there is nothing to learn
    from. Equal rates go to the first language by name. Repeated rows get equal results, and an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    parser = spark.sparkContext.broadcast(CrossParser(training_sample(docs, doc_id, text, lang, chars)))

    kept = [c for c in keep if c not in ("held_out", "lang_pred", "score")] if keep else ["doc_id"]
    own = [F.col(f"`{c}`") for c in kept] if keep else [F.col(doc_id).alias("doc_id")]
    # The text has a longer name than any column that is kept, so none can clash with it.
    rows = docs.select(*own, held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias(max(["held_out", *kept], key=len) + "_"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back("language_id")
        for batch in batches:
            names, scores = parser.value.predict([t or "" for t in batch.column(len(kept) + 1).to_pylist()])
            columns = [batch.column(k) for k in range(len(kept) + 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "held_out", "lang_pred", "score"])

    fields = rows.schema.fields[:-1]
    return rows.mapInArrow(predict, T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
