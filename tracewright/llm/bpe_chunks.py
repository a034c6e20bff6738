"""BPE encoding and decoding by content-defined chunks.

A rolling hash over the last ``WINDOW`` characters cuts each text where the hash matches a mask,
so passages that documents share are cut at the same places. Inside a chunk, the stretch between
its first and last safe cut (see ``encoding``) has ids of its own whatever stands around it: such a
*body* is encoded once for all documents of the task. What is left around the join of two chunks
is encoded again as one string: it starts as the tail of one chunk and the head of the next, and
grows over whole chunks until both of its ends are places where the two sides agree on a
pre-token boundary. The ids of bodies and joins in order are exactly those of the whole text.

Nothing is shuffled: chunks are shared among the documents of a partition, and every worker keeps
at most ``KEPT_CHARS`` characters of bodies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.encoding import SAFE_CUT, UnitEncoder, encoder, worker_path

#: Characters that the rolling hash sees; a power of two.
WINDOW = 16
#: A cut about every this many characters; a power of two.
CHUNK = 256
KEPT_CHARS = 8_000_000
#: Characters that are hashed at a time.
BLOCK = 1 << 20


def chunk_cuts(text: str, chunk: int = CHUNK) -> list[int]:
    """Positions at which ``text`` is cut; each depends on the ``WINDOW`` characters before it alone."""
    cuts: list[int] = []
    for base in range(0, len(text), BLOCK):
        lead = max(0, base - WINDOW)
        codes = np.frombuffer(text[lead : base + BLOCK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        h = (codes * np.uint32(2654435761)) ^ (codes >> np.uint32(3))
        span = 1
        while span < WINDOW:  # h[i] = sum of h[i - k] << k, doubled up
            more = h.copy()
            more[span:] += h[:-span] << np.uint32(span)
            h, span = more, span * 2
        h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
        at = np.flatnonzero((h >> np.uint32(12)) & np.uint32(chunk - 1) == 0) + lead + 1
        cuts += at[(at >= max(base, WINDOW)) & (at < len(text)) & (at < base + BLOCK)].tolist()
    return cuts


class ChunkEncoder:
    """Encodes chunk bodies once and mends the joins between them."""

    def __init__(self, units: UnitEncoder) -> None:
        self.units, self.bodies, self.held = units, {}, 0

    def body(self, text: str) -> bytes:
        ids = self.bodies.get(text)
        if ids is None:
            ids = self.units.encode(text)
            if self.held + len(text) > KEPT_CHARS:
                self.bodies, self.held = {}, 0
            self.bodies[text] = ids
            self.held += len(text)
        return ids

    def encode(self, text: str, chunk: int = CHUNK) -> bytes:
        cuts = [0, *chunk_cuts(text, chunk), len(text)]
        out, open_from = [], 0  # text[open_from:] up to the next body is the join to mend
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = text[a:b]
            first = SAFE_CUT.search(part)
            if first is None:
                continue  # no place to agree on: the join grows over this chunk
            head = a + first.start()
            tail = part.rfind(" ", first.start() + 1)
            while tail > first.start() and not SAFE_CUT.match(part, tail):
                tail = part.rfind(" ", 0, tail)
            if tail <= first.start():
                continue
            out.append(self.units.encode(text[open_from:head]))
            out.append(self.body(part[first.start() : tail]))
            open_from = a + tail
        out.append(self.units.encode(text[open_from:]))
        return b"".join(out)


def encode_column(text: Column, vocabulary: str = "byte_bpe_50k.json", chunk: int = CHUNK) -> Column:
    """The ids of a text as binary (little-endian unsigned 32-bit); a null text has none."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chunks = ChunkEncoder(encoder(worker_path(vocabulary)))
        for texts in batches:
            yield pd.Series([chunks.encode(t or "", chunk) for t in texts], dtype=object)

    return ids(text)


def decode_column(ids: Column, vocabulary: str = "byte_bpe_50k.json") -> Column:
    """The text of binary ids; special tokens are kept."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        units = encoder(worker_path(vocabulary))
        for rows in batches:
            yield pd.Series([units.decode(x or b"") for x in rows], dtype=object)

    return text(ids)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row.

    A null or empty text has no ids, and both digests are those of no bytes. Repeated rows give
    repeated results; an empty table gives none; other columns are left out. Ids are kept for one
    text at a time.
    """

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = encoder(worker_path(vocabulary))
        chunks = ChunkEncoder(units)
        for batch in batches:
            rows = []
            for value in batch["text"]:
                ids = chunks.encode(value or "", chunk)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(units.decode(ids).encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInPandas(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
