"""Token counts without token ids: each distinct pre-token is counted once.

The vocabulary merges pieces only inside a run of spaces and the characters after it (no piece of
it has a space mark behind another character, which is checked when it is loaded). So the count of
a text is the sum, over its *pre-tokens* (a run of spaces and what follows up to the next space),
of how often each occurs times its number of pieces.

1. Each task counts its pre-tokens and reports those that make up at least one in ``HEAD`` of what
   it has seen; Spark adds the reports up. Whatever the corpus, at most ``HEAD`` pre-tokens can have
   that share of all occurrences: they form the head, whose pieces are counted once and broadcast.
2. A document's pre-tokens in the head are added up in the document's own task. The others leave it
   as postings: a row for each pre-token of the task, with the documents that have it.
3. The postings are brought together by pre-token, the pieces of each are counted once, and meet the
   frequencies there; sums for each document follow. No pre-token is hot in this shuffle: a task
   sends one row for it, and it has less than about one in ``HEAD`` of all occurrences.
"""

from __future__ import annotations

import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import joined
from tracewright.llm.encoding import worker_path
from tracewright.storage import stash

#: A pre-token with at least 1/HEAD of all occurrences belongs to the broadcast head.
HEAD = 1 << 19
#: Distinct pre-tokens that a task gathers before it hands them on.
GATHERED = 300_000
#: Postings that are summed at a time.
SUMMED = 1_000_000
#: Rows of postings that are summed at a time: fewer would leave more sums to the shuffle.
SUMMED_ROWS = 10_000
#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = 33
#: Longer pre-tokens are counted where they occur, so that no key grows without bound.
KEY_CHARS = 200

_models: dict[str, sentencepiece.SentencePieceProcessor] = {}


def model(vocabulary: str) -> sentencepiece.SentencePieceProcessor:
    path = worker_path(vocabulary)
    if path not in _models:
        loaded = sentencepiece.SentencePieceProcessor(model_file=path)
        if any("▁" in loaded.id_to_piece(k).lstrip("▁") for k in range(loaded.get_piece_size())):
            raise ValueError(f"{path} has pieces that run on after a space; its texts can't be counted by pre-tokens")
        _models[path] = loaded
    return _models[path]


def pre_tokens(text: str) -> list[str]:
    """The parts of ``text``, whose first space (the one put before every text, at the start) is left out."""
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " " and "▁" not in text:
        return text.split(" ")
    # The mark itself counts as a space in this vocabulary.
    parts, spaces = [], ""
    for k, word in enumerate(text.replace("▁", " ").split(" ")):
        spaces += " " * (k > 0)
        if word:
            parts.append((spaces + word)[1:] if parts else spaces + word)
            spaces = ""
    if spaces:
        parts.append(spaces[1:] if parts else spaces)
    return parts


def pieces(texts: list[str], vocabulary: str) -> list[int]:
    # On its own an empty part is no text at all; here it stands for a space at the end.
    return [len(x) or 1 for x in model(vocabulary).encode(texts, num_threads=1)] if texts else []


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows, null and repeated ``doc_id`` are
    all counted on their own: rows meet by a number of their own, not by ``doc_id``. An empty table
    gives an empty result, and other columns are left out.
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()

        def report() -> pd.DataFrame:
            total = seen.total()
            heavy = [(p, n) for p, n in seen.items() if n * HEAD >= total and len(p) <= KEY_CHARS]
            seen.clear()
            return pd.DataFrame([*heavy, (None, total)], columns=["pre_token", "n"])

        for batch in batches:
            for value in batch["text"]:
                if value:
                    seen.update(pre_tokens(value))
                    if len(seen) >= GATHERED:
                        yield report()
        yield report()

    reports = picked.select("text").mapInPandas(gather, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    common = _heavy(stash(reports, "common-pre-tokens"))
    head = spark.sparkContext.broadcast(dict(zip(common, pieces(common, vocabulary), strict=True)))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = head.value.get
        postings: dict[str, array.array] = {}
        base = 0

        def hand_on() -> pd.DataFrame:
            out = pd.DataFrame({"pre_token": list(postings), "base": base, "doc_id": None, "n_bytes": None, "have": None, "rows": [p.tobytes() for p in postings.values()]}, dtype=object)
            postings.clear()
            return out

        for batch in batches:
            docs_out = []
            for key, name, value in zip(batch["row_key"], batch["doc_id"], batch["text"], strict=True):
                have, long = 0, []
                if value:
                    parts = pre_tokens(value)
                    counts = list(map(known, parts))
                    if None in counts:
                        k, row = -1, key & ((1 << ROW_BITS) - 1)
                        for _ in range(counts.count(None)):
                            k = counts.index(None, k + 1)
                            counts[k] = 0
                            part = parts[k]
                            if len(part) > KEY_CHARS:
                                long.append(part)
                            elif part in postings:
                                postings[part].append(row)
                            else:
                                postings[part] = array.array("I", (row,))
                    have = sum(counts) + sum(pieces(long, vocabulary))
                docs_out.append((f"\0{key}", key, name, len((value or "").encode("utf-8", "surrogatepass")), have))
                base = key >> ROW_BITS << ROW_BITS
                if len(postings) >= GATHERED:
                    yield hand_on()
            yield pd.DataFrame(docs_out, columns=["pre_token", "base", "doc_id", "n_bytes", "have"], dtype=object).assign(rows=None)
        if postings:
            yield hand_on()

    def total_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by pre-token: its pieces are counted when it first comes up."""
        last, last_pieces = None, 0
        for batch in joined(batches, SUMMED_ROWS):
            is_doc = batch["rows"].isna()
            found = batch[is_doc]
            yield pd.DataFrame({"row_key": found["base"], "doc_id": found["doc_id"], "n_bytes": found["n_bytes"], "have": found["have"]})
            tail = batch[~is_doc]
            for a in range(0, len(tail), SUMMED // 4):
                some = tail.iloc[a : a + SUMMED // 4]
                names, counts = list(some["pre_token"]), {}
                if last in names[:1]:
                    counts[last] = last_pieces
                fresh = [n for n in dict.fromkeys(names) if n not in counts]
                counts.update(zip(fresh, pieces(fresh, vocabulary), strict=True))
                last, last_pieces = names[-1], counts[names[-1]]
                sizes = np.array([len(r) // 4 for r in some["rows"]], dtype=np.int64)
                keys = np.frombuffer(b"".join(some["rows"]), dtype=np.uint32).astype(np.int64) + np.repeat(some["base"].to_numpy(dtype=np.int64), sizes)
                rows, at = np.unique(keys, return_inverse=True)
                sums = np.bincount(at, weights=np.repeat([counts[n] for n in names], sizes)).astype(np.int64)
                yield pd.DataFrame({"row_key": rows, "doc_id": None, "n_bytes": None, "have": sums})

    kind = picked.schema["doc_id"].dataType.simpleString()
    keyed = picked.withColumn("row_key", F.monotonically_increasing_id())
    met = keyed.mapInPandas(meet, f"pre_token string, base long, doc_id {kind}, n_bytes long, have long, rows binary")
    together = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pre_token").sortWithinPartitions("pre_token")
    sums = together.mapInPandas(total_up, f"row_key long, doc_id {kind}, n_bytes long, have long")
    rows = sums.groupBy("row_key").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("have").alias("n_tokens"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _heavy(reports: DataFrame) -> list[str]:
    """Pre-tokens with at least one in ``HEAD`` of all occurrences, as far as tasks reported them."""
    total = reports.filter("pre_token IS NULL").agg(F.sum("n")).first()[0] or 0
    return sorted(r[0] for r in reports.filter("pre_token IS NOT NULL").filter(F.col("n") * HEAD >= total).select("pre_token").collect())
