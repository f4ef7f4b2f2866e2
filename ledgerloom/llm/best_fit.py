"""Best-fit-decreasing packing of tokenized documents into matrices of token ids.

Each task sorts the pieces of a bounded chunk of documents by decreasing length and puts each into the window with the least
free places that holds it, found by a segment tree over free capacities. The emptiest windows go on to the task's next chunk,
and at its end to a merge of a few tasks' leftovers. Only documents longer than a window are cut, and no id is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, stored
from ledgerloom.llm.packing import Piece
from ledgerloom.llm.tokens import byte_bpe


class Capacities:
    """Windows by their free places. A node of the tree holds the largest capacity below it that a window has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, free: int, window: int) -> None:
        self.windows[free].append(window)
        at = self.leaves + free
        while at and self.tree[at] < free:
            self.tree[at] = free
            at //= 2

    def take(self, least: int) -> tuple[int, int] | None:
        """The smallest capacity of `least` or more and its window, which goes; none if no window has so much."""
        if self.tree[1] < least:
            return None
        at = 1
        while at < self.leaves:
            at = 2 * at if self.tree[2 * at] >= least else 2 * at + 1
        free = at - self.leaves
        window = self.windows[free].pop()
        if not self.windows[free]:
            self.tree[at] = 0
            while at > 1:
                at //= 2
                self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])
        return free, window


def best_fit_decreasing(pieces: Iterable[Piece], size: int) -> list[tuple[int, list[Piece]]]:
    """(free places, pieces) of each window, for pieces of 1 to `size` ids."""
    capacities, free, held = Capacities(size), [], []
    for piece in sorted(pieces, key=lambda p: -len(p[2])):
        n = len(piece[2]) // 4
        found = capacities.take(n)
        if found is None:
            window = len(free)
            free.append(size - n)
            held.append([piece])
        else:
            window = found[1]
            free[window] = found[0] - n
            held[window].append(piece)
        if free[window]:
            capacities.put(free[window], window)
    return list(zip(free, held))


WINDOW = pa.schema([
    ("sequence_id", pa.int64()), ("n_ids", pa.int32()), ("ids", pa.binary()), ("cu_lengths", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())),
    ("starts", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("leftover", pa.bool_()),
])
DDL = "sequence_id bigint, n_ids int, ids binary, cu_lengths array<int>, doc_ids array<bigint>, starts array<bigint>, doc_tokens array<bigint>, leftover boolean"
MATRIX = "sequence_id bigint, n_ids int, ids binary, positions binary, cu_lengths array<int>, doc_ids array<bigint>, starts array<bigint>, doc_tokens array<bigint>"


class _Windows:
    def __init__(self, task: int):
        self.next, self.rows = task << 32, []

    def add(self, pieces: list[Piece], leftover: bool = False) -> None:
        docs, starts, ids, totals = zip(*pieces)
        cu = np.cumsum([0, *(len(x) // 4 for x in ids)]).tolist()
        self.rows.append((self.next, cu[-1], b"".join(ids), cu, docs, starts, totals, leftover))
        self.next += 1

    def take(self, most: int = 1024) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.rows), most):
            columns = zip(*self.rows[at : at + most])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, WINDOW)], schema=WINDOW)
        self.rows = []


def _pieces(row: tuple) -> Iterator[Piece]:
    _, _, ids, cu, docs, starts, totals, _ = row
    for a, b, doc, start, total in zip(cu, cu[1:], docs, starts, totals):
        yield doc, start, ids[4 * a : 4 * b], total


def pack_best_fit(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, pad_id: int = 0,
    most_ids: int = 1 << 22, most_open: int = 64, merge_tasks: int = 8,
) -> DataFrame:
    """A row of the id matrix for each sequence: sequence_id, n_ids, ids, positions, cu_lengths, doc_ids, starts, doc_tokens.

    Each row of `docs` is a document: the ids of its text by the tokenizer file, then `end_id`. Null and empty texts have that
    id alone. A document of over `size` ids is cut into full windows and a rest; all other documents stay whole. Repeated rows
    and rows that share a doc_id or have none are packed each.

    ids: `size` little-endian unsigned 32-bit numbers, `pad_id` behind the first n_ids. positions: as many numbers; they begin
    with 0 at each segment, and are 0 behind the last. cu_lengths: 0 and the segments' ends. doc_ids, starts and doc_tokens
    tell of each segment its document, the document's ids before it, and all ids of the document.

    A task packs chunks of `most_ids` ids, of which the `most_open` emptiest windows go on to its next chunk and at last, in
    groups of `merge_tasks` tasks, to a merge. The first pass is written to the shared folder, so a sequence never changes
    when an executor is lost.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, windows = byte_bpe(tokenizer), _Windows(TaskContext.get().partitionId())
        end = end_id.to_bytes(4, "little")
        waiting: list[Piece] = []
        held = 0

        def packed(last: bool) -> list[Piece]:
            found = sorted(best_fit_decreasing(waiting, size), key=lambda x: x[0])
            done = max(len(found) - most_open, sum(free == 0 for free, _ in found))
            for _, pieces in found[:done]:
                windows.add(pieces)
            if not last:
                return [piece for _, pieces in found[done:] for piece in pieces]
            for _, pieces in found[done:]:
                windows.add(pieces, True)
            return []

        for batch in slices(batches, "_text", 1 << 20):
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.batch(batch.column(1))):
                ids += end
                total = len(ids) // 4
                whole = total - total % size
                for start in range(0, whole, size):
                    windows.add([(doc, start, ids[4 * start : 4 * (start + size)], total)])
                if whole < total:
                    waiting.append((doc, whole, ids[4 * whole :], total))
                    held += total - whole
                    if held >= most_ids:
                        waiting = packed(False)
                        held = sum(len(p[2]) // 4 for p in waiting)
            yield from windows.take()
        packed(True)
        yield from windows.take()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows((1 << 30) + TaskContext.get().partitionId())
        group, waiting = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if (row[0] >> 32) // merge_tasks != group:
                    for _, pieces in best_fit_decreasing(waiting, size):
                        windows.add(pieces)
                    group, waiting = (row[0] >> 32) // merge_tasks, []
                    yield from windows.take()
                waiting.extend(_pieces(row))
        for _, pieces in best_fit_decreasing(waiting, size):
            windows.add(pieces)
        yield from windows.take()

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = pad_id.to_bytes(4, "little")
        for batch in slices(batches, "ids"):
            ids = [x + pad * (size - len(x) // 4) for x in batch.column("ids").to_pylist()]
            positions = []
            for cu in batch.column("cu_lengths").to_pylist():
                row = np.zeros(size, "<u4")
                row[: cu[-1]] = np.arange(cu[-1]) - np.repeat(cu[:-1], np.diff(cu))
                positions.append(row.tobytes())
            kept = [batch.column(c) for c in ("cu_lengths", "doc_ids", "starts", "doc_tokens")]
            names = [c.split(" ")[0] for c in MATRIX.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), batch.column("n_ids"), pa.array(ids, pa.binary()), pa.array(positions, pa.binary()), *kept], names=names)

    chosen = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    packed = stored(chosen.mapInArrow(first, DDL), "best-fit")
    group = F.floor(F.shiftright(F.col("sequence_id"), 32) / merge_tasks)
    left = packed.where("leftover").repartition(group).sortWithinPartitions("sequence_id")
    return packed.where("NOT leftover").unionByName(left.mapInArrow(merged, DDL)).mapInArrow(matrix, MATRIX)
