"""Open-window packing, whitening and the divergence audit against brute force, on small tables with the awkward cases."""

import array
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import divergence, open_windows, whitening, words

ODD = [None, "", " ", "\n\n", "a", "Same TEXT here", "same  text\there", "Same TEXT here", "é" * 50, "é ́x ̈́", "日本 語 text", "x " * 9_000, "<|endoftext|> in the<|startoftext|>text <s>", "tail ", "\x1c odd\x85spaces here", "😀 emoji's 'll it's", "ΟΔΟΣ ΣΑΣ ΣΣ", "it 's", "İstanbul ǅ ﬁ"]


# 11: open windows


def test_words_are_encoded_as_the_library_does():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = words.WordEncoder(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    drawn = ["".join(rng.choice("aB' \t\n é́<|>1_ß😀Σ") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    for text in [t or "" for t in ODD] + drawn + drawn:
        assert array.array("I", own.encode(text)).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("capacity", "n_open", "fan_in"), [(64, 2, 2), (4096, 16, 16), (256, 1, 3)])
def test_windows_hold_every_id_once(spark, monkeypatch, capacity, n_open, fan_in):
    monkeypatch.setattr(open_windows, "FAN_IN", fan_in)
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["alpha", "beta", "Gamma", "x"]) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    rows = [(k, t, 1, "v", 2.0) for k, t in enumerate(texts)] + [(None, "no id", 1, "v", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, ids string, task double").repartition(7)
    got = open_windows.pack(docs, capacity=capacity, n_open=n_open).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == {r[0] for r in rows}
    for name, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by_doc[name], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(array.array("I", ids[at : at + r["length"]]).tobytes())
            at += r["length"]
        assert at == len(ids)
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        sizes.append(at)
    short = [s for s in sizes if s != capacity]
    assert max(sizes) <= capacity and len(set(short)) == len(short) and all(s & (s - 1) == 0 for s in short)


def test_windows_of_repeated_ids_and_of_nothing(spark):
    docs = spark.createDataFrame([("a", "one two")] * 3 + [("b", None)], "doc_id string, text string")
    got = open_windows.pack(docs).collect()
    assert sum(r["length"] for r in got) == 3 * 3 + 1 and {r["doc_tokens"] for r in got if r["doc_id"] == "a"} == {3}
    empty = open_windows.pack(docs.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_windows_stay_bounded_and_cut_only_when_nothing_fits():
    rng = random.Random(2)
    windows = open_windows.Windows(100, 4)
    for k in range(2000):
        n = rng.randint(1, 250)
        fits = n % 100 and any(room >= n % 100 for room, _ in windows.open)
        before = len(windows.open)
        full = list(windows.add([open_windows.Piece(k, 0, bytes(4 * n), n)]))
        assert all(sum(map(len, s)) == 100 for s in full) and len(windows.open) <= 4
        assert all(0 < room < 100 and room + sum(map(len, held)) == 100 for room, held in windows.open)
        if fits:  # the rest lies whole in one window, and at most that one was filled
            assert before - 1 <= len(windows.open) <= before and len(full) - n // 100 == before - len(windows.open)


# 12: whitening


def brute_whitening(vectors, k):
    x = np.array([[math.floor(256 * c) for c in v] for v in vectors], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    total = (centred**2).sum() / n
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ turn / np.sqrt(values), values / total


@pytest.mark.parametrize("fan_in", [64, 1])
def test_whitening_is_that_of_the_whole_decomposition(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((300, 12)) * np.linspace(0.2, 1.5, 12)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 200 + [vectors[5]]
    odd = [None, [], [None] + [0.0] * 11, [float("nan")] + [0.0] * 11, [float("-inf")] + [0.0] * 11, [1.0, 2.0], [0.5] * 13]
    rows = [(k, v, 1, "x") for k, v in enumerate(vectors)] + [(None, vectors[7], 1, "x"), (3, vectors[7], 1, "x")] + [(1000 + k, v, 1, "x") for k, v in enumerate(odd)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int, x string").repartition(5)
    got = whitening.whiten(table).collect()
    n, deviations, whitened, explained = brute_whitening(vectors, 4)
    assert len(got) == 4 * (len(vectors) + 2) and {r["n"] for r in got} == {n} and n == 300
    signs = {}
    for r in got:
        if r["vec_id"] is None or (r["vec_id"] == 3 and r["deviation"] != deviations[3]):
            continue
        k, c = r["vec_id"], r["component"]
        sign = signs.setdefault(c, np.sign(r["whitened"] * whitened[k, c - 1]))
        assert r["deviation"] == deviations[k]
        assert abs(r["whitened"] * sign - whitened[k, c - 1]) < 1e-10
        assert abs(r["explained"] - explained[c - 1]) < 1e-12 and r["identity_error"] < 1e-12
    assert sorted(r["component"] for r in got if r["vec_id"] is None) == [1, 2, 3, 4] and len([r for r in got if r["vec_id"] == 3]) == 8


def test_whitening_of_few_dimensions_and_of_nothing(spark):
    kind = "vec_id string, embedding array<double>"
    two = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.5]), ("c", [3.0, 0.1])], kind)
    assert sorted((r["vec_id"], r["component"]) for r in whitening.whiten(two).collect()) == [(v, c) for v in "abc" for c in (1, 2)]
    line = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 1.0])], kind)  # a single direction has spread
    assert [(r["component"], abs(r["whitened"]), r["explained"], r["deviation"]) for r in whitening.whiten(line).collect()] == [(1, 1.0, 1.0, 256 * 256)] * 2
    same = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [1.0, 1.0])], kind)
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(two.filter("vec_id is null")).count() == 0
    assert whitening.whiten(spark.createDataFrame([("a", None), ("b", [])], kind)).count() == 0


def test_deviations_are_exact_beyond_64_bits():
    fit = whitening.Fit(3, [2**62, -5])
    x = np.array([[2**61, 1], [0, -2]], dtype=np.int64)
    assert fit.squares(x) == [(3 * 2**61 - 2**62) ** 2 + 8**2, 2**124 + 1]
    assert fit.centred(x).dtype == np.float64 and fit.centred(x)[1, 1] == -1 / 3


@pytest.mark.parametrize("size", [1, 2, 5, 30, 60, 200])
def test_eigenvectors_to_double_precision(size):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((400, size)) * np.linspace(0.5, 2, size)
    v = a.T @ a / 400
    passes = []

    def product(block):
        passes.append(block.shape[1])
        return sum(part.T @ (part @ block) for part in np.array_split(a, 9)) / 400

    values, vectors = whitening.leading(product, size, 4)
    want = np.linalg.eigvalsh(v)[::-1][:4]
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 2e-14 * want[0]
    assert len(passes) < 200 and max(passes) <= 6  # never more than a few vectors in a pass


def test_minres_solves_indefinite_equations():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    m = q @ np.diag(np.r_[np.linspace(-3, -1, 8), np.linspace(1, 4, 12)]) @ q.T
    right = rng.standard_normal((20, 3))
    right[:, 1] = 0
    assert np.abs(m @ whitening.minres(lambda x: m @ x, right, 40) - right).max() < 1e-9


# 13: divergence


def brute_divergence(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = defaultdict(Counter)
    docs = defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        found[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in docs:
        kept = [t for t in docs[lang] if docs[lang][t] >= min_docs]
        sources = sorted(s for x, s in found if x == lang)

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {s: shares(found[lang, s]) for s in sources}
        q = shares(sum((found[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(items)}
    return out


@pytest.mark.parametrize("few", [False, True])
def test_divergence_is_that_of_the_definition(spark, monkeypatch, few):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcÉ語x") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = []
    for _ in range(500):
        lang, source = rng.choice(["en", "en", "fr", None, ""]), rng.choice(["s1", "s1", "s2", "é", "z", None, "", *(f"t{k}" for k in range(5))])
        rows.append((rng.choice([None, "", " ".join(rng.choice(vocabulary[: 20 if source == "z" else 150]).upper() + rng.choice([".", "9", "\n", ""]) for _ in range(rng.randint(1, 60)))]), lang, source))
    rows += [("too rare", "de", "one"), (None, "de", "two"), ("\u0085   ½", "de", "two"), ("alone " * 50, "it", "only")] + [("one word", "pt", "x")] * 12 + [("1 2 3", "pt", "y")]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "text string, lang string, source string, n int, term string, docs double").repartition(4)
    if few:
        docs = docs.coalesce(1)
        monkeypatch.setattr(divergence, "SALTS", 2)
    got = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs).collect()]
    want = brute_divergence(rows, 10, 10)
    assert len(got) == len(want) and set(got) == want


def test_tree_corrections_are_those_of_single_rows():
    rng = np.random.default_rng(8)
    rows = sorted({tuple((int(s), int(rng.integers(1, 4))) for s in np.flatnonzero(rng.random(9) < 0.5)) for _ in range(300)} - {()})
    p0 = {s: 100 + s for s in range(9)}
    lengths, times = np.array([len(r) for r in rows]), rng.integers(1, 5, len(rows))
    flat = np.array([x for r in rows for x in r])
    p = flat[:, 1] * 1000 + flat[:, 0]
    got = Counter()
    for a, b, v in divergence.tree_corrections(lengths, flat[:, 0], flat[:, 1], p, np.array([p0[s] for s in flat[:, 0]]), times):
        for x, y, z in zip(a.tolist(), b.tolist(), v.tolist(), strict=True):
            got[x, y] += z
    f = lambda a, b: (a - b) ** 2 // (a + b)
    want = Counter()
    for r, m in zip(rows, times.tolist(), strict=True):
        for k, (h, c) in enumerate(r):
            for g, d in r[:k]:
                x, y = d * 1000 + g, c * 1000 + h
                want[g, h] += m * (f(x, y) - f(x, p0[h]) - f(p0[g], y) + f(p0[g], p0[h]))
    assert got == want


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([("a", "en", "s")], "text string, lang string, source string")
    assert divergence.audit(docs.limit(0)).count() == 0
    assert divergence.audit(docs).count() == 0
    assert [r["value"] for r in divergence.audit(docs.union(docs.select("text", "lang", F.lit("t")))).collect()] == [0, 0]
