"""Harmonic packing of token sequences.

A document's ids are cut into full sequences, then halves, quarters ... down to ``SMALLEST``, then one short rest. Class j holds the lengths in
(capacity / (j + 1), capacity / j], and a bin of class j takes exactly j pieces. The halves are of full class length, so their bins have no
padding; rests lose at most one (j + 1)th. Each task fills the bins of its own documents, with no shuffle; its unfinished bins are packed
together, longest piece first, when its input ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import mapped
from .tokens import default_vocabulary, encoder

CAPACITY, SMALLEST = 1024, 64
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]


def cut_lengths(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of the pieces of n ids, longest first."""
    out, n = [capacity] * (n // capacity), n % capacity
    part = capacity // 2
    while n and part >= smallest:
        if n >= part:
            out.append(part)
            n -= part
        part //= 2
    return [*out, n] if n else out


class Bins:
    """Open bins, one for each class. Sequence numbers are unique across tasks: the task's partition number is their upper half."""

    def __init__(self, partition: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next, self.open = capacity, partition << 32, {}

    def add(self, length: int, piece: tuple) -> list[tuple]:
        """Rows of the bin that this piece completes."""
        j = self.capacity // length
        bin_ = self.open.setdefault(j, [])
        bin_.append((length, piece))
        if len(bin_) < j:
            return []
        del self.open[j]
        return self._rows(bin_)

    def _rows(self, pieces: list[tuple]) -> list[tuple]:
        rows, at = [], 0
        for length, piece in pieces:
            rows.append((*piece, self.next, at))
            at += length
        self.next += 1
        return rows

    def close(self) -> list[tuple]:
        """First-fit decreasing over what the open bins hold, which is bounded by the number of classes."""
        left = sorted((x for b in self.open.values() for x in b), key=lambda x: -x[0])
        bins: list[list] = []
        room: list[int] = []
        for x in left:
            k = next((i for i, r in enumerate(room) if r >= x[0]), len(bins))
            if k == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[k].append(x)
            room[k] -= x[0]
        self.open = {}
        return [r for b in bins for r in self._rows(b)]


def _out(rows: list[tuple]) -> pa.RecordBatch:
    x = list(zip(*rows)) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in x], _NAMES)


def _pack(vocabulary: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        bins = Bins(TaskContext.get().partitionId() if TaskContext.get() else 0, capacity)
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), end).astype("<u4")
                start = 0
                for length in cut_lengths(len(ids), capacity):
                    rows += bins.add(length, (doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)))
                    start += length
                if len(rows) > 20_000:
                    yield _out(rows)
                    rows = []
        yield _out(rows + bins.close())

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then the id ``end``; each id lies in one piece. Null or empty text: just ``end``. Null id: packed, with a null doc_id.
    Repeated rows: packed each. Empty table: empty result. Other columns are not read. The vocabulary file must exist on every executor.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.transform(mapped, _pack(vocabulary or default_vocabulary(), capacity, end), _SCHEMA)
