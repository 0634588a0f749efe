"""Harmonic packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import arrow_map
from martwright.llm.pretokens import packed_ids

CAPACITY = 4096
END_OF_DOCUMENT = 2
# Pieces of class k share a bin in groups of k; shorter ones fill bins one after another.
CLASSES = 64
# A piece stays whole if it leaves at most this share of its slot empty.
SLACK = 1 / 32
_ROWS = 4096


def cut(length: int, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> list[int]:
    """Lengths of a document's pieces, in order.

    Class k takes pieces that fit k times: capacity/(k+1) < length <= capacity/k. A piece
    that would leave more than ``slack`` of its slot empty is cut to the next smaller
    slot size, and the rest is classed in turn.
    """
    pieces = [capacity] * (length // capacity)
    length %= capacity
    while length:
        k = capacity // length
        if k >= classes or capacity // k - length <= slack * (capacity // k):
            pieces.append(length)
            break
        pieces.append(capacity // (k + 1))
        length -= capacity // (k + 1)
    return pieces


class HarmonicPacker:
    """Fills bins of each class on its own; holds only pieces of open bins."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, classes: int = CLASSES):
        self.next_id, self.capacity, self.classes = first_id, capacity, classes
        self.open: dict[int, list[tuple]] = {}
        self.small_room = capacity

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for piece in pieces:
            yield (*piece, self.next_id, offset)
            offset += piece[2]
        self.next_id += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        """Add ``(doc_id, start, length, …)``; yields the pieces of a bin that got full."""
        k = self.capacity // piece[2]
        if k >= self.classes:
            if piece[2] > self.small_room:
                yield from self._close(self.open.pop(0))
                self.small_room = self.capacity
            self.small_room -= piece[2]
            self.open.setdefault(0, []).append(piece)
            return
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            yield from self._close(self.open.pop(k))

    def finish(self) -> Iterator[tuple]:
        """Pack what open bins hold, longest first, each into the first bin with room."""
        left = sorted((p for held in self.open.values() for p in held), key=lambda p: -p[2])
        bins: list[tuple[list, list]] = []
        for piece in left:
            for room, held in bins:
                if piece[2] <= room[0]:
                    break
            else:
                room, held = [self.capacity], []
                bins.append((room, held))
            room[0] -= piece[2]
            held.append(piece)
        self.open.clear()
        for _, held in bins:
            yield from self._close(held)


_PIECES = pa.schema(
    [
        (name, pa.int64())
        for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ]
)
_PIECES_DDL = ", ".join(f"{name} long" for name in _PIECES.names)


def _pack(
    path: str, end: int, capacity: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    ids = packed_ids(path)
    # 2^33 sequences for each task.
    packer = HarmonicPacker(TaskContext.get().partitionId() << 33, capacity)
    last = end.to_bytes(4, "little")
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in zip(*out)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_PIECES)

    for rows in batches:
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text")):
            packed = memoryview(ids.encode(text.as_py()) + last)
            total, start = len(packed) // 4, 0
            for length in cut(total, capacity):
                crc = zlib.crc32(packed[4 * start : 4 * (start + length)])
                out.extend(packer.add((doc_id, start, length, crc, total)))
                start += length
            if len(out) >= _ROWS:
                yield flush()
    out.extend(packer.finish())
    if out:
        yield flush()


def pack(
    docs: DataFrame, tokenizer: str, end: int = END_OF_DOCUMENT, capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every text is tokenised whole and ends with the id ``end``. Each task packs its own
    documents as it reads them; nothing is shuffled, and a task holds only the pieces of
    its open bins, fewer than ``CLASSES`` squared. At its end the pieces left are put
    together, so each task leaves little more than one bin part empty. NULL and empty texts
    are one id. A text longer than a sequence fills whole ones first. Repeated rows and rows
    without doc_id are packed like any other; an empty table gives no rows. Other columns
    are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(rows, partial(_pack, tokenizer, end, capacity), _PIECES_DDL)
