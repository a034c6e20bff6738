"""Bounded-space online packing: a fixed number of open windows per partition.

Every partition packs its documents as they come. A document goes to the open window that it fills best; where none has the room, a new window
is opened while fewer than ``n_open`` are open, and else the fullest is filled up with the document's first ids and emitted, and
the rest of the document is placed anew. So every emitted sequence is full, a document is cut only where nothing has room for it, and a task holds
``n_open`` windows of ids and one batch of texts.

What a partition has open at its end goes on, with its ids, to a merge: the windows of ``FAN_IN`` partitions are packed the same way, as wholes where
they fit, then those of ``FAN_IN`` such merges, until one task has the last ``n_open`` of them. Those are filled up one from the
other, and the last is cut into lengths that are powers of two, which need no padding either.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.encoding import worker_path
from tracewright.llm.words import word_encoder
from tracewright.storage import stash

#: Partitions (or merges of them) whose open windows one task merges.
FAN_IN = 16
#: Bits of a sequence's number within its task, and of the task's number.
SEQUENCE_BITS, TASK_BITS = 28, 30


@dataclass
class Piece:
    """``ids`` (four bytes each) of a document, from its id number ``start`` on."""

    doc_id: object
    start: int
    ids: bytes
    doc_tokens: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: 4 * at], self.doc_tokens), Piece(self.doc_id, self.start + at, self.ids[4 * at :], self.doc_tokens)


def cut_pieces(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``at`` ids of the pieces, and the others."""
    head: list[Piece] = []
    for k, piece in enumerate(pieces):
        if len(piece) >= at:
            if len(piece) == at:
                return head + [piece], pieces[k + 1 :]
            a, b = piece.cut(at)
            return (head + [a] if at else head), [b, *pieces[k + 1 :]]
        head.append(piece)
        at -= len(piece)
    return head, []


class Windows:
    """The open windows of one task."""

    def __init__(self, capacity: int, n_open: int) -> None:
        self.capacity, self.n_open = capacity, n_open
        self.open: list[tuple[int, list[Piece]]] = []  # room that is left, pieces

    def add(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """Place pieces that belong together; give the sequences that this fills."""
        n = sum(map(len, pieces))
        while n >= self.capacity:
            full, pieces = cut_pieces(pieces, self.capacity)
            n -= self.capacity
            yield full
        while n:
            best = min((k for k, (room, _) in enumerate(self.open) if room >= n), key=lambda k: self.open[k][0], default=None)
            if best is not None:
                room, held = self.open[best]
                held += pieces
                self.open[best] = (room - n, held)
                if room == n:
                    yield self.open.pop(best)[1]
                return
            if len(self.open) < self.n_open:
                self.open.append((self.capacity - n, list(pieces)))
                return
            room, held = self.open.pop(min(range(len(self.open)), key=lambda k: self.open[k][0]))
            head, pieces = cut_pieces(pieces, room)
            n -= room
            yield held + head

    def finish(self) -> Iterator[list[Piece]]:
        """Fill what is open up one from the other; the last goes out in powers of two."""
        left: list[Piece] = []
        n = 0
        for room, held in sorted(self.open, key=lambda w: w[0]):
            left, n = left + held, n + self.capacity - room
            if n >= self.capacity:
                full, left = cut_pieces(left, self.capacity)
                n -= self.capacity
                yield full
        while n:
            part = 1 << (n.bit_length() - 1)
            full, left = cut_pieces(left, part)
            n -= part
            yield full
        self.open = []


class _Rows:
    """Rows of finished sequences, and of windows that stay open (with their ids), for one task."""

    def __init__(self, level: int, task: int, kind: pa.DataType) -> None:
        self.first = (level << (SEQUENCE_BITS + TASK_BITS)) | (task << SEQUENCE_BITS)
        self.n, self.task, self.kind = 0, task, kind
        self.columns: list[list] = [[] for _ in range(9)]

    def add(self, pieces: list[Piece], still_open: bool = False) -> None:
        offset = 0
        for piece in pieces:
            row = (piece.doc_id, piece.start, len(piece), zlib.crc32(piece.ids), piece.doc_tokens, self.first + self.n, offset, self.task, piece.ids if still_open else None)
            for column, value in zip(self.columns, row, strict=True):
                column.append(value)
            offset += len(piece)
        self.n += 1

    def take(self) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "task", "ids"]
        kinds = [self.kind, *[pa.int64()] * 7, pa.binary()]
        columns, self.columns = self.columns, [[] for _ in range(9)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, n_open: int = 16) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` for every piece of every row.

    A document is its ids and one end id; a null or empty text is the end id alone. All sequences are full but at most ``log2(capacity)`` of
    the whole table, whose lengths are different powers of two. A row's pieces follow each other without a gap; repeated rows are packed as often as they
    occur, null ids stay null; an empty table gives an empty result; other columns, whatever their names, are left out.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long, ids binary"
    end = end_id.to_bytes(4, "little")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, windows, out = word_encoder(worker_path(vocabulary)), Windows(capacity, n_open), None
        for batch in batches:
            out = out or _Rows(0, TaskContext.get().partitionId(), batch.schema.field(0).type)
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = units.encode(value.as_py() or "") + end
                for full in windows.add([Piece(name, 0, ids, len(ids) // 4)]):
                    out.add(full)
            yield out.take()
        if out:
            for _, held in windows.open:
                out.add(held, still_open=True)
            yield out.take()

    def merged(level: int, last: bool):
        def merge(key: tuple, table: pa.Table) -> pa.Table:
            windows, out = Windows(capacity, n_open), _Rows(level, key[0].as_py(), table.schema.field("doc_id").type)
            waiting: dict[int, list[Piece]] = {}
            for r in table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
                waiting.setdefault(r["sequence_id"], []).append(Piece(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
            for _, held in sorted(waiting.items(), key=lambda w: (-sum(map(len, w[1])), w[0])):  # large ones first fit best
                for full in windows.add(held):
                    out.add(full)
            for full in windows.finish() if last else ():
                out.add(full)
            for _, held in windows.open:
                out.add(held, still_open=True)
            return pa.Table.from_batches([out.take()])

        return merge

    level, parts = 0, [stash(rows.mapInArrow(fill, schema), "windows")]
    most = parts[0].filter("ids IS NOT NULL").agg(F.max("task")).first()[0]
    while most is not None:
        level, last = level + 1, most < FAN_IN
        still_open = parts[-1].filter("ids IS NOT NULL").withColumn("task", F.expr(f"task div {FAN_IN}"))
        parts.append(stash(still_open.groupBy("task").applyInArrow(merged(level, last), schema), "windows"))
        most = None if last else most // FAN_IN
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("ids IS NULL").drop("task", "ids")
