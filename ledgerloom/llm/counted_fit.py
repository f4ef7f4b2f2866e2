"""Best-fit packing planned over the counts of lengths instead of over documents.

The histogram of piece lengths has at most `size` rows, whatever the number of documents. Best fit decreasing runs over it on
the driver: equal pieces fill equal windows, so a step places a whole run of ranks of one length into a whole range of windows.
Each piece then takes its slot by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import slices, stored
from ledgerloom.llm.tokens import byte_bpe

#: length, first rank, rank behind the last, first window, pieces of this length in each window, place of the first in its window.
Run = tuple[int, int, int, int, int, int]


def plan_by_lengths(counts: Mapping[int, int], size: int) -> list[Run]:
    """Best fit decreasing of counts[n] pieces of n ids each (1 <= n <= size) into windows of `size` ids.

    A piece goes to the window with the least free places that holds it. Of equal pieces, one that follows another goes to
    the same window as long as it fits, since no other window that fits has become fuller. So ranges of equal windows are
    filled alike. A length splits one range at most and opens two, so there are at most 4 * size ranges, and runs in
    proportion to size squared, however many pieces there are.
    """
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # by free places: (first window, windows)
    runs: list[Run] = []
    windows = 0
    for length in sorted(counts, reverse=True):
        left, rank, free = counts[length], 0, length
        while left:
            while free <= size and not ranges[free]:
                free += 1
            if free <= size:
                first, n = ranges[free].pop()
            else:  # new windows, as many as the rest of this length needs
                free, first, n = size, windows, -(-left // (size // length))
                windows += n
            each = free // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, size - free))
                rank, left = rank + full * each, left - full * each
                ranges[free - each * length].append((first, full))
            if full < n:
                if left:
                    runs.append((length, rank, rank + left, first + full, left, size - free))
                    ranges[free - left * length].append((first + full, 1))
                    full, left = full + 1, 0
                if full < n:
                    ranges[free].append((first + full, n - full))
    return runs


FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("task", pa.int32()), ("place", pa.int64())]
DDL = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary, task int, place bigint"
PLAN = "length bigint, begin bigint, stop bigint, first bigint, each bigint, at bigint"


def pack_by_lengths(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, with_ids: bool = True
) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset): pieces of documents in sequences.

    Each row of `docs` is a document: the ids of its text by the tokenizer file, then `end_id`. Null and empty texts have that
    id alone. Only a document of over `size` ids is cut: into pieces of `size` ids, with what is over as the first piece.
    Repeated rows and rows that share a doc_id or have none are packed each; other columns of `docs` are not read. An empty
    table gives no rows. ids are little-endian unsigned 32-bit numbers (null with with_ids=False). Texts are worked on in
    slices of about 4 MB, one text at least, so a very long text takes memory in proportion to itself.

    Pieces are ranked within their length without bringing a length together: each task numbers its own, and what earlier
    tasks have of a length is added. Pieces are written to the shared folder first, so a rank never changes when an executor
    is lost. The plan is the only thing broadcast; its size follows `size`, not the table.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, task, seen = byte_bpe(tokenizer), TaskContext.get().partitionId(), Counter()
        end = end_id.to_bytes(4, "little")
        for batch in slices(batches, "_text", 1 << 20):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), bpe.batch(batch.column(1))):
                ids += end
                total = len(ids) // 4
                edges = [0, *range(total % size or size, total, size), total]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, k, a, b - a, zlib.crc32(part), total, part if with_ids else None, task, seen[b - a]))
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), FIELDS)], names=[n for n, _ in FIELDS])

    chosen = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    pieces = stored(chosen.mapInArrow(cut, DDL), "pieces")

    held = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    held = stored(held.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "lengths")
    counts = {row["length"]: row["n"] for row in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    plan = F.broadcast(docs.sparkSession.createDataFrame(plan_by_lengths(counts, size), PLAN))

    ranked = pieces.join(held.drop("n"), ["task", "length"]).withColumn("rank", F.col("place") + F.col("before"))
    rank = F.col("rank") - F.col("begin")
    placed = ranked.join(plan, "length").where("rank >= begin AND rank < stop")
    sequence = F.col("first") + F.expr("(rank - begin) DIV each")
    return placed.select(*(n for n, _ in FIELDS[:-2]), sequence.alias("sequence_id"), (F.col("at") + rank % F.col("each") * F.col("length")).alias("offset"))
