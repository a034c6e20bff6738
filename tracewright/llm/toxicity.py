"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is scored in windows of ``WINDOW`` words, of which each shares some with the one before it, and gets the score of
its worst window. A word's input is the embedding of the word (hashed) beside the mean of the
embeddings of its character n-grams (hashed, with marks for the word's ends), so unseen forms of a word
are recognised. Two gated recurrent layers read the window forwards and backwards, an attention layer
weighs their states, and a logistic unit scores the weighted mean.

Labels are for documents, not windows. Training therefore starts from the windows of toxic
documents that hold words or n-grams which are frequent there and hardly occur in others, against
windows of clean documents; then the network scores all training windows and the clean windows that
it takes for toxic are learned in further rounds. A logistic curve fitted to documents turns the worst
window's logit into a probability. All of it is numpy; the network is some 2.5 MB.

Fitting uses a bounded sample of labelled documents (of each label ``TRAIN_DOCS`` whole texts at most, which together
have at most ``TRAIN_DOCS * TRAIN_CHARS`` characters). Scoring covers the whole of every text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.batches import give_back

WINDOW = 16
#: Words from the start of a window to that of the next: any half of a window's words in a row stands whole in one.
STRIDE = WINDOW // 2
HIDDEN = 8
WORD_DIM, WORD_BUCKETS = 8, 1 << 13
CHAR_DIM, CHAR_BUCKETS = 16, 1 << 15
GRAMS = (3, 4)
#: Labelled documents of each label that are learned from, at most, and characters for each on average, at most.
TRAIN_DOCS = 1_500
TRAIN_CHARS = 20_000
#: Windows of each kind in a round of training, at most.
TRAIN_WINDOWS = 10_000
CLEAN_WEIGHT = 3.0
#: Buckets that n-grams are counted in to find what tells labels apart, as a power of two.
TELLING_BITS = 23
#: Windows that are run in step, and words that a worker keeps the inputs of.
STEP_WINDOWS = 4096
KEPT_WORDS = 60_000
#: Words of the training vocabulary that go through arrays at a time.
STEP_WORDS = 20_000


def words(text: str) -> list[str]:
    return text.lower().split()


def _cores(tokens: list[str]) -> list[str]:
    """Words without what isn't a letter or digit at their ends; never empty."""
    return ["".join(c for c in t if c.isalnum()) if not t.isalnum() else t for t in tokens]


def features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token its word bucket; the n-gram buckets of all, end to end; where each token's begin."""
    marked = [f"\x02{c}\x03" for c in _cores(tokens)]
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    prime = np.uint64(0x9E3779B97F4A7C15)
    mixed = (codes + np.uint64(1)) * prime
    mixed ^= mixed >> np.uint64(29)
    # A word's own hash: the sum of its characters' hashes, each turned by its place.
    place = np.arange(len(codes)) - np.repeat(first, sizes)
    turned = mixed * (np.uint64(2) * (place.astype(np.uint64) + np.uint64(1)) * prime + np.uint64(1))
    whole = np.add.reduceat(turned, first) if len(tokens) else np.zeros(0, np.uint64)
    word = ((whole ^ (whole >> np.uint64(31))) * prime >> np.uint64(40)) % np.uint64(WORD_BUCKETS)
    owners, grams = [], []
    left = np.repeat(sizes, sizes) - place
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[at + k]) * prime
            h ^= h >> np.uint64(32)
        grams.append((h * prime >> np.uint64(40)) % np.uint64(CHAR_BUCKETS))
        owners.append(np.searchsorted(first, at, side="right") - 1)
    # Words of one letter have no more than one 3-gram; an empty core has its marks' bucket.
    bare = np.flatnonzero(sizes < min(GRAMS))
    owners.append(bare)
    grams.append(np.zeros(len(bare), dtype=np.uint64))
    owner, gram = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owner, kind="stable")
    return word.astype(np.int64), gram[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(tokens)))


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows of texts of ``sizes`` words: the text of each, and its first word's place.

    Windows begin every ``STRIDE`` words; the last one ends with the text, so nothing is left over. A text
    of at most ``WINDOW`` words has one.
    """
    count = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return owner, np.minimum(k * STRIDE, np.maximum(0, sizes[owner] - WINDOW))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters by name, and the curve from a document's worst logit to its score."""

    p: dict[str, np.ndarray]
    slope: float = 1.0
    bias: float = 0.0
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 0) -> Network:
        rng, d, h = np.random.default_rng(seed), WORD_DIM + CHAR_DIM, HIDDEN
        p = {"word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)), "char": rng.normal(0, 0.3, (CHAR_BUCKETS, CHAR_DIM))}
        for way in "fb":
            p[f"x{way}"] = rng.normal(0, d**-0.5, (d, 3 * h))
            p[f"u{way}"] = rng.normal(0, h**-0.5, (h, 3 * h))
            p[f"c{way}"] = np.zeros(3 * h)
        p |= {"attend": rng.normal(0, 0.3, 2 * h), "out": rng.normal(0, 0.5, 2 * h), "off": np.zeros(1)}
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, word: np.ndarray, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.empty((len(word), WORD_DIM + CHAR_DIM), dtype=self.p["word"].dtype)
        ends = np.append(first, len(gram))
        for a in range(0, len(word), STEP_WORDS):
            b = min(a + STEP_WORDS, len(word))
            out[a:b, :WORD_DIM] = self.p["word"][word[a:b]]
            sums = np.add.reduceat(self.p["char"][gram[ends[a] : ends[b]]], ends[a:b] - ends[a], axis=0)
            out[a:b, WORD_DIM:] = sums / np.diff(ends[a : b + 1])[:, None].astype(np.float32)
        return out

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of windows x (time, window, input), and what ``backward`` needs."""
        h, steps, n = HIDDEN, *x.shape[:2]
        memo: dict = {"x": x}
        states = np.zeros((steps, n, 2 * h), dtype=x.dtype)
        for way, cols in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            pre = x @ self.p[f"x{way}"] + self.p[f"c{way}"]
            u, now, kept = self.p[f"u{way}"], np.zeros((n, h), dtype=x.dtype), [None] * steps
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                rec = now @ u
                z, r = _sigmoid(pre[t, :, :h] + rec[:, :h]), _sigmoid(pre[t, :, h : 2 * h] + rec[:, h : 2 * h])
                new = np.tanh(pre[t, :, 2 * h :] + r * rec[:, 2 * h :])
                kept[t] = (now, z, r, new, rec[:, 2 * h :])
                now = new + z * (now - new)
                states[t, :, cols] = now
            memo[way] = kept
        e = states @ self.p["attend"]
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * states).sum(axis=0)
        memo |= {"states": states, "a": a, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["off"][0], memo

    def backward(self, grad: np.ndarray, memo: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the inputs, from those of the logits."""
        h, x, states, a = HIDDEN, memo["x"], memo["states"], memo["a"]
        g = {"out": memo["pooled"].T @ grad, "off": grad.sum(keepdims=True)}
        d_pool = grad[:, None] * self.p["out"]
        d_a = (states * d_pool).sum(axis=2)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["attend"] = np.einsum("tn,tnk->k", d_e, states)
        d_states = a[:, :, None] * d_pool + d_e[:, :, None] * self.p["attend"]
        d_x = np.zeros_like(x)
        for way, cols in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, d_now = self.p[f"u{way}"], np.zeros((x.shape[1], h), dtype=x.dtype)
            d_pre = np.zeros((*x.shape[:2], 3 * h), dtype=x.dtype)
            g_u = np.zeros_like(u)
            for t in range(len(x) - 1, -1, -1) if way == "f" else range(len(x)):
                before, z, r, new, rec_n = memo[way][t]
                d = d_now + d_states[t, :, cols]
                d_n = d * (1 - z) * (1 - new * new)
                d_z = d * (before - new) * z * (1 - z)
                d_r = d_n * rec_n * r * (1 - r)
                d_pre[t] = np.concatenate([d_z, d_r, d_n], axis=1)
                d_rec = np.concatenate([d_z, d_r, d_n * r], axis=1)
                g_u += before.T @ d_rec
                d_now = d * z + d_rec @ u.T
            g[f"u{way}"], g[f"c{way}"] = g_u, d_pre.sum(axis=(0, 1))
            g[f"x{way}"] = np.einsum("tnd,tnk->dk", x, d_pre, optimize=True)
            d_x += d_pre @ self.p[f"x{way}"].T
        return g, d_x

    def step(self, grads: dict[str, np.ndarray], t: int, rate: float, rows: dict[str, np.ndarray]) -> None:
        """Adam; of the embeddings only the ``rows`` that have gradients move."""
        for k, g in grads.items():
            if k not in self.moments:
                self.moments[k] = (np.zeros_like(self.p[k]), np.zeros_like(self.p[k]))
            at = rows.get(k, slice(None))
            m, v = self.moments[k]
            m[at] = 0.9 * m[at] + 0.1 * g
            v[at] = 0.99 * v[at] + 0.01 * g * g
            self.p[k][at] -= (rate / (1 - 0.9**t)) * m[at] / (np.sqrt(v[at] / (1 - 0.99**t)) + 1e-6)


def _gathered(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sum of the gradients of each."""
    order = np.argsort(rows, kind="stable")
    some, first = np.unique(rows[order], return_index=True)
    return some, np.add.reduceat(grads[order], first, axis=0)


class Vocabulary:
    """Inputs of the distinct words of the training texts.

    Each text (a list of words) is turned into word numbers as it comes, so none need be kept; what goes through arrays goes
    ``STEP_WORDS`` words at a time.
    """

    def __init__(self, texts: Iterable[list[str]]) -> None:
        self.index: dict[str, int] = {}
        self.rows = [np.fromiter((self.index.setdefault(w, len(self.index) + 1) for w in t), dtype=np.int32) if t else np.zeros(1, np.int32) for t in texts]
        parts = [features(some) for some in self._steps()]
        self.word = np.concatenate([p[0] for p in parts]).astype(np.int32)
        self.gram = np.concatenate([p[1] for p in parts]).astype(np.int32)
        before = np.cumsum([0, *(len(p[1]) for p in parts)])
        self.first = np.concatenate([p[2] + at for p, at in zip(parts, before, strict=False)]).astype(np.int32)

    def _steps(self) -> Iterator[list[str]]:
        """The empty word and all others, in the order of their numbers."""
        every = itertools.chain([""], self.index)
        while some := list(itertools.islice(every, STEP_WORDS)):
            yield some

    def window_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows x WINDOW) word numbers, padded with 0 (the empty word), and the text of each window."""
        sizes = np.array([len(r) for r in self.rows], dtype=np.int64)
        owner, start = windows(sizes)
        out = np.zeros((len(owner), WINDOW), dtype=np.int32)
        begins = np.searchsorted(owner, np.arange(len(sizes) + 1))
        for k, row in enumerate(self.rows):
            mine = slice(begins[k], begins[k + 1])
            at = start[mine, None] + np.arange(WINDOW)[None, :]
            out[mine] = np.where(at < len(row), row[np.minimum(at, len(row) - 1)], 0)
        return out, owner.astype(np.int32)

    def telling_grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of each word's n-grams of 4 and 5 and its own bucket, end to end, and where each word's begin and end."""
        prime, grams, counts, done = np.uint64(0x9E3779B97F4A7C15), [], [], 0
        for some in self._steps():
            marked = [f"\x02{c}\x03" for c in _cores(some)]
            sizes = np.array([len(m) for m in marked], dtype=np.int64)
            codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            first = np.cumsum(sizes) - sizes
            left = np.repeat(sizes, sizes) - (np.arange(len(codes)) - np.repeat(first, sizes))
            # Every word has a bucket of its own, behind those of the n-grams.
            own, owners = [(1 << TELLING_BITS) + done + np.arange(len(marked))], [np.arange(len(marked))]
            for n in (4, 5):
                at = np.flatnonzero(left >= n)
                h = np.full(len(at), n, dtype=np.uint64)
                for k in range(n):
                    h = (h ^ codes[at + k]) * prime
                    h ^= h >> np.uint64(32)
                own.append((h * prime >> np.uint64(64 - TELLING_BITS)).astype(np.int64))
                owners.append(np.searchsorted(first, at, side="right") - 1)
            owner = np.concatenate(owners)
            grams.append(np.concatenate(own)[np.argsort(owner, kind="stable")].astype(np.int32))
            counts.append(np.bincount(owner, minlength=len(marked)))
            done += len(marked)
        return np.concatenate(grams), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def telling(labels: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """For each distinct word, the log odds of the most telling of the word and its n-grams of 4 and 5.

    Counted in documents, by hash; what stands in fewer than three toxic ones tells nothing.
    """
    gram, starts = vocabulary.telling_grams()
    seen = np.zeros((2, (1 << TELLING_BITS) + len(starts) - 1), dtype=np.int16)
    for rows, label in zip(vocabulary.rows, labels, strict=True):
        some = np.unique(rows)
        counts = starts[some + 1] - starts[some]
        at = np.repeat(starts[some] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        seen[int(label)][np.unique(gram[at])] += 1
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    out = np.empty(len(starts) - 1)
    for a in range(0, len(out), STEP_WORDS):
        b = min(a + STEP_WORDS, len(out))
        some = gram[starts[a] : starts[b]]
        toxic, clean = seen[1][some].astype(float), seen[0][some].astype(float)
        odds = np.where(toxic >= 3, np.log(np.maximum(toxic - 1, 1) / n1) - np.log((clean + 1.0) / n0), -9.0)
        out[a:b] = np.maximum.reduceat(odds, starts[a:b] - starts[a])
    return out


def train(labelled: Iterable[tuple[str, int]], seed: int = 0, rounds: int = 3, epochs: int = 4) -> Network:
    """Fit a network to labelled texts, which may be a generator: no text is kept. Without texts of both labels it scores all alike, low."""
    net, labels = Network.fresh(seed), []

    def split() -> Iterator[list[str]]:
        for text, label in labelled:
            labels.append(label)
            yield words(text)

    vocabulary = Vocabulary(split())
    y = np.array(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        net.slope, net.bias = 0.0, -4.0 if not len(y) or not y.max() else 4.0
        return net
    ids, owner = vocabulary.window_ids()
    odds = telling(y, vocabulary).astype(np.float32)
    vocabulary.index, vocabulary.rows = {}, []  # the strings have served
    # Words count as telling from odds that few words of clean texts reach.
    strong = np.concatenate([odds[ids[a : a + STEP_WORDS]].max(axis=1) for a in range(0, len(ids), STEP_WORDS)])
    bar = max(2.0, float(np.quantile(strong[y[owner] == 0], 0.995)) + 0.5)
    seeds = np.flatnonzero((y[owner] == 1) & (strong >= bar))
    if not len(seeds):
        seeds = np.flatnonzero(y[owner] == 1)
    # The curve is fitted to documents that the network has not seen, if there are enough.
    apart = np.arange(len(y)) % 5 == 0 if len(y) >= 1000 else np.zeros(len(y), dtype=bool)
    seeds = seeds[~apart[owner[seeds]]]
    others = np.flatnonzero((y[owner] == 0) & ~apart[owner])
    rng = np.random.default_rng(seed)
    hard = np.zeros(0, dtype=np.int64)
    # Clean texts of one word over and over are rare in the sample; so some are made of its words.
    some = rng.choice(others, min(TRAIN_WINDOWS // 8, len(others)), replace=False)
    n_ids = len(ids)
    alike = n_ids + np.arange(len(some))
    ids = np.concatenate([ids, np.repeat(ids[some, :1], WINDOW, axis=1)])
    t = 0
    for turn in range(rounds):
        good = rng.choice(seeds, min(TRAIN_WINDOWS, len(seeds)), replace=False)
        bad = np.concatenate([rng.choice(others, min(TRAIN_WINDOWS, len(others)), replace=False), hard, alike])
        rows, want = np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))]).astype(np.float32)
        # Both kinds weigh alike.
        weigh = np.where(want == 1, 0.5 / len(good), 0.5 / len(bad)).astype(np.float32) * len(rows)
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), 256):
                some = order[a : a + 256]
                t += 1
                _learn(net, vocabulary, ids[rows[some]], want[some], weigh[some], t, 0.01 / (1 + turn + epoch / epochs))
        logits = score_windows(net, vocabulary, ids[:n_ids])
        wrong = others[logits[others] > -2.0]
        hard = np.union1d(hard, wrong[np.argsort(-logits[wrong])][: TRAIN_WINDOWS // 2])
        # Windows of toxic texts that the network is sure of are seeds as well.
        seeds = np.union1d(seeds, np.flatnonzero((y[owner] == 1) & ~apart[owner] & (logits > 3.0)))
    worst = np.full(len(y), -np.inf)
    np.maximum.at(worst, owner, logits)
    net.slope, net.bias = _curve(worst[apart], y[apart]) if apart.any() else _curve(worst, y)
    net.moments = {}
    return net


def _learn(net: Network, vocabulary: Vocabulary, ids: np.ndarray, want: np.ndarray, weigh: np.ndarray, t: int, rate: float) -> None:
    some, at = np.unique(ids, return_inverse=True)
    ends = np.append(vocabulary.first, len(vocabulary.gram))
    counts = ends[some + 1] - ends[some]
    first = np.cumsum(counts) - counts
    gram = vocabulary.gram[np.repeat(ends[some] - first, counts) + np.arange(counts.sum())]
    x = net.inputs(vocabulary.word[some], gram, first)
    at = at.reshape(ids.shape).T
    logits, memo = net.forward(x[at])
    grads, d_x = net.backward(((_sigmoid(logits) - want) * weigh / len(want)).astype(np.float32), memo)
    _, d_in = _gathered(at.ravel(), d_x.reshape(-1, x.shape[1]))
    rows = {}
    rows["word"], grads["word"] = _gathered(vocabulary.word[some], d_in[:, :WORD_DIM])
    rows["char"], grads["char"] = _gathered(gram, np.repeat(d_in[:, WORD_DIM:] / counts[:, None].astype(np.float32), counts, axis=0))
    net.step(grads, t, rate, rows)


def _curve(worst: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with short steps and a little shrinkage.

    A clean document weighs as much as ``CLEAN_WEIGHT`` toxic ones, since there are far more of them.
    """
    x = np.stack([worst, np.ones(len(worst))], axis=1)
    weight = np.where(y == 1, 1.0, CLEAN_WEIGHT)
    theta, ridge = np.array([0.5, 0.0]), np.diag([1.0, 0.01])
    for _ in range(300):
        p = _sigmoid(x @ theta)
        slope = x.T @ (weight * (p - y)) + ridge @ theta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        move = np.linalg.solve(bend, slope)
        theta = theta - move * min(1.0, 0.2 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def score_windows(net: Network, vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    return Runner(net).run_table(net.inputs(vocabulary.word, vocabulary.gram, vocabulary.first), ids)


class Runner:
    """Scores whole texts in a worker; keeps the layer inputs of the words it has met."""

    def __init__(self, net: Network) -> None:
        self.net, self.h = net, HIDDEN
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.tables: list[np.ndarray] = []
        self._add([""])

    def _project(self, x: np.ndarray) -> list[np.ndarray]:
        """Per direction, what the inputs add to the update, reset and new gates (the first two halved for tanh)."""
        h, out = self.h, []
        for way in "fb":
            pre = x @ self.net.p[f"x{way}"] + self.net.p[f"c{way}"]
            out += [np.ascontiguousarray(pre[:, :h] * np.float32(0.5)), np.ascontiguousarray(pre[:, h : 2 * h] * np.float32(0.5)), np.ascontiguousarray(pre[:, 2 * h :])]
        return out

    def _add(self, tokens: list[str]) -> None:
        new = self._project(self.net.inputs(*features(tokens)))
        at = len(self.index)
        self.index.update((w, at + k) for k, w in enumerate(tokens))
        if not self.tables:
            self.tables, self.size = new, len(tokens)
            return
        need = self.size + len(tokens)
        if need > len(self.tables[0]):
            grown = max(need, min(2 * len(self.tables[0]), KEPT_WORDS))
            self.tables = [np.concatenate([t[: self.size], np.zeros((grown - self.size, self.h), dtype=np.float32)]) for t in self.tables]
        for t, n in zip(self.tables, new, strict=True):
            t[self.size : need] = n
        self.size = need

    def run_table(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self._run(self._project(x), ids)

    def _run(self, tables: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
        p, h, half = self.net.p, self.h, np.float32(0.5)
        logits = np.zeros(len(ids), dtype=np.float32)
        for a in range(0, len(ids), STEP_WINDOWS):
            at = np.ascontiguousarray(ids[a : a + STEP_WINDOWS].T)
            n = at.shape[1]
            states, energy = [], np.zeros((WINDOW, n), dtype=np.float32)
            for way, (tz, tr, tn) in (("f", tables[:3]), ("b", tables[3:])):
                u = p[f"u{way}"]
                uz, ur, un = (np.ascontiguousarray(u[:, :h] * half), np.ascontiguousarray(u[:, h : 2 * h] * half), np.ascontiguousarray(u[:, 2 * h :]))
                weigh = p["attend"][:h] if way == "f" else p["attend"][h:]
                now, kept = np.zeros((n, h), dtype=np.float32), [None] * WINDOW
                for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
                    z = now @ uz
                    z += tz[at[t]]
                    np.tanh(z, out=z)
                    r = now @ ur
                    r += tr[at[t]]
                    np.tanh(r, out=r)
                    r += 1
                    new = now @ un
                    new *= r
                    new *= half
                    new += tn[at[t]]
                    np.tanh(new, out=new)
                    z += 1
                    z *= half
                    now = now - new
                    now *= z
                    now += new
                    kept[t] = now
                    energy[t] += now @ weigh
                states.append(kept)
            np.exp(energy - energy.max(axis=0), out=energy)
            total = energy.sum(axis=0)
            # The pooled state times the output weights is the weighted mean of each state's product.
            f, b = p["out"][:h], p["out"][h:]
            value = sum(energy[t] * (states[0][t] @ f + states[1][t] @ b) for t in range(WINDOW))
            logits[a : a + n] = value / total + p["off"][0]
        return logits

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its score and the place of the first word of its worst window."""
        scores, places = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        a = 0
        while a < len(texts):
            # As many texts at a time as hold some 50,000 words, one at least.
            b, have, split = a, 0, []
            while b < len(texts) and (not split or have < 50_000):
                split.append(words(texts[b]))
                have += len(split[-1])
                b += 1
            scores[a:b], places[a:b] = self._score(split)
            a = b
        return scores, places

    def _score(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        flat = [w for t in split for w in t]
        found = list(map(self.index.get, flat))
        if None in found:
            missing = list(dict.fromkeys(w for w, k in zip(flat, found, strict=True) if k is None))
            if self.size + len(missing) > KEPT_WORDS:
                self._clear()
                missing = list(dict.fromkeys(w for w in flat if w))
            for k in range(0, len(missing), 50_000):
                self._add(missing[k : k + 50_000])
            found = list(map(self.index.get, flat))
        row = np.array([*found, 0], dtype=np.int32)
        sizes = np.array([len(t) for t in split], dtype=np.int64)
        owner, start = windows(sizes)
        at = start[:, None] + np.arange(WINDOW)[None, :]
        first = np.cumsum(sizes) - sizes
        ids = row[np.where(at < sizes[owner][:, None], first[owner][:, None] + at, len(flat))]
        logits = self._run(self.tables, ids)
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        worst = np.maximum.reduceat(logits, begins)
        hit = np.flatnonzero(logits == worst[owner])
        place = start[hit[np.unique(owner[hit], return_index=True)[1]]]
        return _sigmoid(self.net.slope * worst.astype(np.float64) + self.net.bias), place


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves ``fold``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> Iterator[tuple[str, int]]:
    """At most ``TRAIN_DOCS`` texts of each label, one for each slot of a hash of the id, with their labels.

    A label goes for its whole text, so none is cut: in the order of their hashes those are taken that still fit
    into ``TRAIN_DOCS * TRAIN_CHARS`` characters. Texts come one after another, so that the driver holds few at a time.
    """
    # Own names, so that no other column of either table can clash.
    docs = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    labels = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    marked = labels.filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    h = F.xxhash64(F.col("id").cast("string"))
    # First the ids are chosen, so that texts move only for those.
    slot = F.pmod(h, F.lit(TRAIN_DOCS)).alias("slot")
    ids = marked.select("id", "label", slot, h.alias("h")).groupBy("label", "slot").agg(F.min(F.struct("h", "id")).alias("row")).select("row.id", "label", "row.h")
    sizes = docs.select("id", F.length("text").cast("long").alias("n")).join(F.broadcast(ids), "id").groupBy("label", "h", "id").agg(F.sum("n").alias("n"))
    chosen, have = [], {0: 0, 1: 0}
    for r in sorted(sizes.collect(), key=lambda r: (r["label"], r["h"])):
        if have[r["label"]] + r["n"] <= TRAIN_DOCS * TRAIN_CHARS:
            have[r["label"]] += r["n"]
            chosen.append((r["id"], r["label"]))
    picked = docs.sparkSession.createDataFrame(chosen, T.StructType([docs.schema["id"], T.StructField("label", T.IntegerType())]))
    rows = docs.join(F.broadcast(picked), "id").select("label", F.col("id").cast("string").alias("name"), "text")
    for r in rows.orderBy("label", "name", "text").toLocalIterator():
        yield r["text"], r["label"]


def score_texts(docs: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``worst_word`` (place of the worst window's first word) to every row.

    Other columns stay, or those named in ``keep``.
    The whole text is scored; a null or empty one is scored as a window of empty words. Equal texts
    get equal scores, and an empty table stays empty. Columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    kept = [c for c in keep or docs.columns if c not in ("score", "worst_word")]
    # The text has a longer name than any column that is kept, so none can clash with it.
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(max(["text", *kept], key=len) + "_"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back("toxicity")
        runner = Runner(shared.value)
        for batch in batches:
            scores, places = runner.score([t or "" for t in batch.column(len(kept)).to_pylist()])
            columns = [batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores), pa.array(places)], [*kept, "score", "worst_word"])

    fields = [docs.schema[c] for c in kept]
    return rows.mapInArrow(scored, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("worst_word", T.LongType())]))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Network:
    """A network fitted to the sample of ``labels`` (columns ``doc_id`` and ``label``) that isn't held out."""
    return train(labelled_sample(docs, labels, doc_id, text, label))
