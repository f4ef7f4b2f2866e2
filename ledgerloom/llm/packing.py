"""Bounded-space online packing of tokenized documents into training sequences.

Each task keeps a fixed number of open windows. A piece goes to the window it fits best; if none fits, the fullest window is
emitted. What is left open at a task's end is merged at the end: leftovers of many tasks are packed once more.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, stored
from ledgerloom.llm.tokens import byte_bpe

#: A piece: document, its row's number in the task, ids before it, its ids, ids of the document.
Piece = tuple[int | None, int, bytes, int]


class Packer:
    """Open windows of `size` ids each; emits (sequence, [(offset, piece)])."""

    def __init__(self, size: int, most_open: int, most_padding: int):
        self.size, self.most_open, self.most_padding = size, most_open, most_padding
        self.free: list[tuple[int, int]] = []  # (free places, window) of the open windows, in order
        self.held: dict[int, list[tuple[int, Piece]]] = {}
        self.opened = 0

    def _put(self, at: int, piece: Piece) -> None:
        free, window = self.free.pop(at)
        self.held[window].append((self.size - free, piece))
        insort(self.free, (free - len(piece[2]) // 4, window))

    def _close(self, at: int) -> tuple[int, list[tuple[int, Piece]]]:
        _, window = self.free.pop(at)
        return window, self.held.pop(window)

    def add(self, piece: Piece) -> Iterator[tuple[int, list[tuple[int, Piece]]]]:
        """Places a piece; yields the windows that this emits. Pieces over `size` are cut into full windows and a rest."""
        doc, start, ids, total = piece
        while len(ids) >= 4 * self.size:
            self.opened += 1
            yield self.opened, [(0, (doc, start, ids[: 4 * self.size], total))]
            start, ids = start + self.size, ids[4 * self.size :]
        while ids:
            n = len(ids) // 4
            at = bisect_left(self.free, (n, 0))
            if at < len(self.free):
                exact = self.free[at][0] == n
                self._put(at, (doc, start, ids, total))
                if exact:
                    yield self._close(0)
                return
            if len(self.free) < self.most_open:
                self.opened += 1
                self.held[self.opened] = []
                insort(self.free, (self.size, self.opened))
                continue
            room = self.free[0][0]
            if room > self.most_padding:  # a cut costs less than so much padding
                self._put(0, (doc, start, ids[: 4 * room], total))
                start, ids = start + room, ids[4 * room :]
            yield self._close(0)

    def rest(self) -> Iterator[tuple[int, list[tuple[int, Piece]]]]:
        """The windows that are still open, fullest first."""
        while self.free:
            yield self._close(0)


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("leftover", pa.bool_())]
DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, leftover boolean"


class _Rows:
    def __init__(self, task: int, with_ids: bool):
        self.base, self.with_ids, self.rows = task << 32, with_ids, []

    def add(self, window: int, pieces: list[tuple[int, Piece]], leftover: bool) -> None:
        for offset, (doc, start, ids, total) in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.base + window, offset, ids if leftover or self.with_ids else None, leftover))

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], names=[n for n, _ in FIELDS])


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1,
    most_open: int = 64, most_padding: int = 32, with_ids: bool = True, merge_tasks: int = 8,
) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): pieces of documents in sequences.

    Each row of `docs` is a document: the ids of its text by the tokenizer file, then `end_id`. Null and empty texts have
    that id alone. Each id lies in exactly one piece; pieces fill their sequence from offset 0 without a gap. Repeated rows
    and rows that share a doc_id or have none are packed each. ids are little-endian unsigned 32-bit numbers (null with
    with_ids=False). `most_open` windows are open in a task; a window is emitted with at most `most_padding` free
    places, else the piece that didn't fit is cut to fill it.

    Leftovers (`most_open` windows a task at most) meet in groups of `merge_tasks` tasks. The first pass is written to the
    shared folder, so a sequence never changes when an executor is lost.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer, rows = byte_bpe(tokenizer), Packer(size, most_open, most_padding), _Rows(TaskContext.get().partitionId(), with_ids)
        end = end_id.to_bytes(4, "little")
        for batch in slices(batches, "_text", 1 << 20):
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.batch(batch.column(1))):
                ids += end
                for window, pieces in packer.add((doc, 0, ids, len(ids) // 4)):
                    rows.add(window, pieces, False)
            yield rows.take()
        for window, pieces in packer.rest():
            rows.add(window, pieces, True)
        yield rows.take()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows = Packer(size, most_open, most_padding), _Rows((1 << 30) + TaskContext.get().partitionId(), with_ids)
        for batch in batches:
            for doc, start, _, _, total, _, _, ids, _ in zip(*(c.to_pylist() for c in batch.columns)):
                for window, pieces in packer.add((doc, start, ids, total)):
                    rows.add(window, pieces, False)
            yield rows.take()
        # The last open windows fill each other; one alone stays partly empty.
        last = Packer(size, 1, 0)
        last.opened = packer.opened
        for _, pieces in packer.rest():
            for _, piece in pieces:
                for window, filled in last.add(piece):
                    rows.add(window, filled, False)
        for window, pieces in last.rest():
            rows.add(window, pieces, False)
        yield rows.take()

    chosen = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    packed = stored(chosen.mapInArrow(first, DDL), "packed")
    left = packed.where("leftover")
    group = F.shiftright(F.col("sequence_id"), 32) / merge_tasks
    left = left.repartition(F.floor(group)).sortWithinPartitions("sequence_id", "offset")
    return packed.where("NOT leftover").unionByName(left.mapInArrow(merged, DDL)).drop("leftover")
