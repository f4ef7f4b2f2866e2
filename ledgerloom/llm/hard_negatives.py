"""Hard negatives of labelled vectors, found by rotated one-bit codes and scored with integers.

A vector is rotated and its signs are kept as a code, with the code's alignment (the inner product of code and vector). What
the code leaves over is coded in the same way, `levels` times; the norm of the last rest is kept. An anchor's rotated
components are rounded to eight bit planes, so its inner products with codes are popcounts. By Cauchy-Schwarz the rest adds no
more than the product of two norms, which with the rounding error bounds the score from both sides, without chance. Only rows
whose interval can still change an anchor's list are scored, with integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored

PLANES = 8
LEAST, NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
CODED = "row long, id long, label long, dims int, ints binary, codes binary, alignments array<double>, rest double, anchor boolean"


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """The same orthogonal matrix everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def one_bit_codes(vectors: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as 64-bit words [vector, level, word], alignments [vector, level], norm of what is left over)."""
    n, dims = vectors.shape
    rest = vectors @ rotation(dims).T
    words = -(-dims // 64)
    codes, alignments = np.zeros((n, levels, words), np.uint64), np.zeros((n, levels))
    for level in range(levels):
        signs = rest >= 0
        bits = np.zeros((n, words * 64), np.uint8)
        bits[:, :dims] = signs
        codes[:, level] = np.packbits(bits, axis=1).view(np.uint64)
        alignments[:, level] = np.abs(rest).sum(axis=1) / np.sqrt(dims)
        rest = rest - np.where(signs, 1, -1) * (alignments[:, level, None] / np.sqrt(dims))
    return codes, alignments, np.linalg.norm(rest, axis=1)


class Anchors:
    """Rotated anchors as bit planes. Bounds on their inner products with coded vectors."""

    def __init__(self, vectors: np.ndarray):
        n, self.dims = vectors.shape
        z = vectors @ rotation(self.dims).T
        self.low = z.min(axis=1)
        self.step = (z.max(axis=1) - self.low) / (2**PLANES - 1)
        units = np.rint((z - self.low[:, None]) / np.where(self.step > 0, self.step, 1)[:, None]).astype(np.int64)
        bits = np.zeros((PLANES, n, -(-self.dims // 64) * 64), np.uint8)
        for plane in range(PLANES):
            bits[plane, :, : self.dims] = (units >> plane) & 1
        self.planes = np.packbits(bits, axis=2).view(np.uint64)
        self.total = self.low * self.dims + self.step * units.sum(axis=1)
        self.norm = np.linalg.norm(vectors, axis=1)

    def bounds(self, at: slice, codes: np.ndarray, alignments: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lowest, highest) inner product of each anchor of `at` with each coded vector."""
        root = np.sqrt(self.dims)
        low, step, total, norm = (x[at, None] for x in (self.low, self.step, self.total, self.norm))
        error = root * step / 2  # of an anchor's inner product with a code, by rounding
        middle = 0.0
        for level in range(codes.shape[1]):
            ones = np.bitwise_count(codes[:, level]).sum(axis=1, dtype=np.int64)
            units = 0
            for plane in range(PLANES):
                for word in range(codes.shape[2]):
                    units = units + (np.bitwise_count(self.planes[plane, at, word][:, None] & codes[None, :, level, word]).astype(np.int32) << plane)
            aligned = (2 * (low * ones + step * units) - total) / root
            middle = middle + alignments[:, level] * aligned
        # The rest is at right angles to the last code, so the anchor's part along that code adds nothing.
        across = np.sqrt(np.maximum(norm**2 - np.maximum(np.abs(aligned) - error, 0) ** 2, 0))
        half = rest * across + alignments.sum(axis=1) * error + 1e-9 * norm * (alignments.sum(axis=1) + rest) + 1e-6
        return middle - half, middle + half


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices; an error where one doesn't fit into 64 bits."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 2**63:
        return np.einsum("ij,ij->i", a, b)
    return np.array([int(x) for x in (a.astype(object) * b.astype(object)).sum(axis=1)], np.int64)


class Best:
    """For each slot the `most` best (score, id): higher scores first, ties by smaller id."""

    def __init__(self, slots: int, most: int):
        self.scores, self.ids = np.full((slots, most), LEAST), np.full((slots, most), NO_ID)

    @property
    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
        touched, most = np.unique(slot), self.scores.shape[1]
        slots = np.r_[np.repeat(touched, most), slot]
        scores, ids = np.r_[self.scores[touched].ravel(), score], np.r_[self.ids[touched].ravel(), number]
        order = np.lexsort((ids, -(scores + 1), slots))  # + 1, as the least number has no negative
        slots, scores, ids = slots[order], scores[order], ids[order]
        place = np.arange(len(slots)) - np.searchsorted(slots, slots)
        held = place < most
        self.scores[slots[held], place[held]], self.ids[slots[held], place[held]] = scores[held], ids[held]


def _matrix(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), dims)


def _coded(levels: int) -> Callable:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number, label, ints, anchor, row = (batch.column(k).to_pylist() for k in range(5))
            dims = np.fromiter(map(len, ints), np.int64, len(ints))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d).tolist()
                vectors = np.array([ints[k] or [0] for k in at], np.int64)  # no components: as a single 0
                if np.abs(vectors).max(initial=0) >= 2**31:
                    raise OverflowError("a component times the scale is beyond 32 bits")
                codes, alignments, rest = one_bit_codes(vectors.astype(float), levels)
                columns = [
                    pa.array([row[k] for k in at], pa.int64()), pa.array([number[k] for k in at], pa.int64()), pa.array([label[k] for k in at], pa.int64()),
                    pa.array([d] * len(at), pa.int32()), pa.array([v.tobytes() for v in vectors.astype("<i4")], pa.binary()),
                    pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(list(alignments), pa.list_(pa.float64())), pa.array(rest), pa.array([anchor[k] for k in at]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in CODED.split(", ")])
    return code


class _Unit:
    """The anchors of a unit, and what its rows so far have shown. wanted: for each anchor its positives' scores, or None to find them."""

    def __init__(self, batch: pa.RecordBatch, dims: int, levels: int, most: int, low: int, high: int):
        self.dims, self.levels = max(dims, 1), levels
        self.row, self.id, self.label = (batch.column(c).to_numpy() for c in ("row", "id", "label"))
        self.ints = _matrix(batch.column("ints"), "<i4", self.dims).astype(np.int64)
        self.anchors = Anchors(self.ints.astype(float))
        self.wanted = None
        slots = len(self.row)
        if "positives" in batch.schema.names:
            lists = batch.column("positives").to_pylist()
            self.width = max(map(len, lists))
            self.wanted = np.array([[s["score"] for s in x] + [0] * (self.width - len(x)) for x in lists], np.int64)
            self.there = np.array([[True] * len(x) + [False] * (self.width - len(x)) for x in lists])
            self.low, self.high = low * self.wanted, high * self.wanted  # of 100 times a negative's score
            slots *= self.width
        self.best = Best(slots, most)

    def add(self, batch: pa.RecordBatch, pairs: int = 1 << 19) -> None:
        n = batch.num_rows
        row, number, label = (batch.column(c).to_numpy() for c in ("row", "id", "label"))
        ints = _matrix(batch.column("ints"), "<i4", self.dims).astype(np.int64)
        codes = _matrix(batch.column("codes"), "<u8", self.levels * -(-self.dims // 64)).reshape(n, self.levels, -1)
        alignments = np.array(batch.column("alignments").to_pylist()).reshape(n, self.levels)
        rest = batch.column("rest").to_numpy()
        chunk = max(1, pairs // n)
        for begin in range(0, len(self.row), chunk):
            at = slice(begin, begin + chunk)
            low, high = self.anchors.bounds(at, codes, alignments, rest)
            same = self.label[at, None] == label
            if self.wanted is None:
                open_ = same & (self.row[at, None] != row) & (high >= self.best.least[at, None])
            else:
                open_ = np.zeros(same.shape, bool)
                least = self.best.least.reshape(-1, self.width)
                for p in range(self.width):
                    reach = np.maximum(self.low[at, p] / 100, least[at, p])[:, None]
                    open_ |= self.there[at, p, None] & (high >= reach - 1e-6) & (low <= self.high[at, p, None] / 100 + 1e-6)
                open_ &= ~same
            a, r = np.nonzero(open_)
            a += begin
            for k in range(0, len(a), 1 << 16):
                self._score(a[k : k + (1 << 16)], r[k : k + (1 << 16)], ints, number)

    def _score(self, a: np.ndarray, r: np.ndarray, ints: np.ndarray, number: np.ndarray) -> None:
        scores = inner_products(self.ints[a], ints[r])
        if self.wanted is None:
            self.best.add(a, scores, number[r])
            return
        for p in range(self.width):
            slot = a * self.width + p
            held = self.there[a, p] & (self.low[a, p] <= 100 * scores) & (100 * scores <= self.high[a, p]) & (scores >= self.best.least[slot])
            self.best.add(slot[held], scores[held], number[r[held]])

    def found(self) -> pa.RecordBatch:
        slot, place = np.nonzero(self.best.ids != NO_ID)
        width = 1 if self.wanted is None else self.width
        columns = [self.row[slot // width], slot % width, self.best.ids[slot, place], self.best.scores[slot, place]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["row", "slot", "found_id", "score"])


def _scan(rows: DataFrame, anchors: DataFrame, keys: list[str], blocks: int, parts: int, levels: int, most: int, low: int = 0, high: int = 0) -> DataFrame:
    """(row, slot, found_id, score): the best of each block of rows for each anchor; a final choice is up to the caller.

    Rows are dealt into `blocks` and anchors into `parts` by hash, and each two meet in a task of their own, split by `keys`:
    its anchors come first and stay, its rows pass by.
    """
    r, q = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(parts))
    rows = rows.withColumn("r", r).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(1))
    anchors = anchors.withColumn("q", q).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("kind", F.lit(0))
    unit = [*keys, "r", "q"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting = None, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*unit, "kind")]
            marks = list(zip(*columns))
            begin = 0
            while begin < len(marks):
                end = begin + 1
                while end < len(marks) and marks[end] == marks[begin]:
                    end += 1
                *key, kind = marks[begin]
                if key != now:
                    if held:
                        yield held.found()
                    now, held, waiting = key, None, []
                piece = batch.slice(begin, end - begin)
                if kind == 0:
                    waiting.append(piece)
                elif waiting or held:
                    if waiting:
                        table = pa.Table.from_batches(waiting).combine_chunks()
                        held, waiting = _Unit(table.to_batches()[0], key[0], levels, most, low, high), []
                    for k in range(0, piece.num_rows, 2048):
                        held.add(piece.slice(k, 2048))
                begin = end
        if held:
            yield held.found()

    both = rows.unionByName(anchors, allowMissingColumns=True)
    return both.repartition(*unit).sortWithinPartitions(*unit, "kind").mapInArrow(meet, "row long, slot long, found_id long, score long")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, levels: int = 4, most_rows: int = 1 << 17, most_anchors: int = 1 << 15,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x). A score is the integer inner product of two rows; higher ones come first, ties by
    smaller id. An anchor's positives are its best `positives` other rows of the same label. For each of them come the best
    `negatives` rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score. Where there
    are fewer, all.

    Rows without id, label or vector, and rows with a null, NaN or infinite component, take no part. A repeated row is a row of
    its own: it is another row to its twin, and as an anchor gives its results again. Rows of different lengths have no
    score; rows without components score 0. is_anchor: a condition on `vectors`; null is no. Other columns are not read. An
    empty table gives no rows. Components times the scale of 32 bits or more, and scores of 64 bits or more, are errors.

    Rows are dealt into blocks of about `most_rows` (a 64th of the table, if that is less, but 4,096 at least), anchors into
    blocks of about `most_anchors`; each two blocks meet in one task, which holds the anchors and lets the rows pass. Codes are
    written to the shared folder first. A label that most rows have is split over all blocks.
    """
    value = F.col(vector_col)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    chosen = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & value.isNotNull() & F.coalesce(finite, F.lit(False)))
    ints = F.transform(value, lambda x: F.floor(scale * x.cast("double")))
    chosen = chosen.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), ints.alias("ints"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(chosen.mapInArrow(_coded(levels), CODED), "codes")
    size = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).first()
    blocks = max(1, -(-size["n"] // min(max(size["n"] // 64, 4096), most_rows)))
    parts = max(1, -(-size["anchors"] // most_anchors))
    rows, anchors = rows.drop("anchor"), rows.where("anchor").drop("anchor")

    better = [F.desc("score"), F.asc("found_id")]
    nearest = _scan(rows, anchors, ["dims", "label"], blocks, parts, levels, positives)
    place = F.row_number().over(Window.partitionBy("row").orderBy(*better))
    nearest = nearest.withColumn("place", place).where(F.col("place") <= positives)
    # The list's order is the slots' order.
    lists = nearest.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "score", "found_id"))).alias("positives"))
    paired = stored(anchors.join(lists, "row"), "positives")

    found = _scan(rows, paired, ["dims"], blocks, parts, levels, negatives, low, high)
    rank = F.row_number().over(Window.partitionBy("row", "slot").orderBy(*better))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    own = paired.select("row", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("slot", "positive"))
    return found.join(own, ["row", "slot"]).select(
        "anchor_id", F.col("positive.found_id").alias("positive_id"), "rank", F.col("found_id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
