"""Suffix-array dedup: bytes of long repeats stay only in the first document that has them.

Suffixes are dealt by the smallest hash of the k-grams in their first `length` bytes, so equal strings of that length always
meet. Neighbouring suffixes with one smallest hash travel together as a run (`length` - k + 1 suffixes at most). Only runs whose
key several documents share, in different surroundings, are sent with their bytes; a run that equals a run of an earlier
document as a whole is decided by its hash. In each task the runs' suffixes are sorted (an enhanced suffix array with its
common prefixes), and a stack scan over its interval tree gives the maximal repeat groups with all their occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import order_id, slices, stored

LENGTH, GRAM = 50, 16
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: So many different runs of one key are sorted in one task at most; beyond it their suffixes are dealt one by one.
MOST_RUNS = 5_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes (k a power of two) from each place on."""
    h, m, p = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    while m < k:
        h = h[:-m] * np.uint64(p) + h[m:]
        m, p = 2 * m, p * p & _MASK
    return _mix(h)


def _span_hashes(grams: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, from the hashes of the k-grams that cover it."""
    sizes = ends - starts
    found = sizes.astype(np.uint64)
    for offset in range(0, int(sizes.max(initial=0)), GRAM):
        place = starts + np.minimum(offset, sizes - GRAM)
        found = _mix(found * np.uint64(_BASE) + grams[place])
    return found


@dataclass
class Runs:
    """Runs of suffixes with one smallest hash, of some documents laid one behind another.

    doc: number of the document; key: the smallest hash (40 bits); hash: of the run's bytes, which are those of its suffixes'
    first LENGTH bytes; begin: its first suffix in `data`; long: number of its suffixes.
    """

    data: np.ndarray
    starts: np.ndarray
    doc: np.ndarray
    key: np.ndarray
    hash: np.ndarray
    begin: np.ndarray
    long: np.ndarray

    def own(self) -> np.ndarray:
        """The runs' hashes, told apart by document."""
        return _of_document(self.hash, self.doc)


def _of_document(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return hashes.view(np.uint64) + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)


def runs_of(texts: list[bytes]) -> Runs:
    """Every suffix of LENGTH bytes or more is in exactly one run of its document."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if not len(sizes) or sizes.max() < LENGTH:
        return Runs(data, starts, none, none, none, none, none)
    grams = low = _grams(data, GRAM)
    width, m = LENGTH - GRAM + 1, 1
    while 2 * m <= width:
        low, m = np.minimum(low[:-m], low[m:]), 2 * m
    if width > m:
        low = np.minimum(low[: len(low) - (width - m)], low[width - m :])
    edges = np.zeros(len(data) + 1, np.int8)  # suffixes of LENGTH bytes inside their document
    large = sizes >= LENGTH
    edges[starts[large]] = 1
    edges[(starts + sizes - LENGTH + 1)[large]] = -1
    valid = np.cumsum(edges, dtype=np.int8)[: len(low)].astype(bool)
    change = np.r_[True, low[1:] != low[:-1]]
    begin = np.flatnonzero(valid & (change | ~np.r_[False, valid[:-1]]))
    last = np.flatnonzero(valid & (np.r_[change[1:], True] | ~np.r_[valid[1:], False]))
    long = last - begin + 1
    if long.max() > width:  # periodic text: runs are cut every `width` suffixes, counted from their own beginning
        parts = -(-long // width)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, long = np.repeat(begin, parts) + width * number, np.minimum(width, np.repeat(long, parts) - width * number)
    hashes = _span_hashes(grams, begin, begin + long + LENGTH - 1).view(np.int64)
    keys = (low[begin] & np.uint64((1 << 40) - 1)).astype(np.int64)
    return Runs(data, starts, np.searchsorted(starts, begin, "right") - 1, keys, hashes, begin, long)


def _groups(texts: list[str | None], most: int = 256 << 10) -> Iterator[tuple[int, list[bytes]]]:
    """The texts' bytes in groups of about `most` bytes, with the number of each group's first: arrays that fit a cache."""
    first, group, held = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode()
        if group and held + len(data) > most:
            yield first, group
            first, group, held = i, [], 0
        group.append(data)
        held += len(data)
    if group:
        yield first, group


def _columns(out: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def _arrays(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def interval_repeats(pieces: list[bytes], least: int = LENGTH, suffixes: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Maximal repeats of at least `least` bytes among the suffixes of `pieces`.

    Gives the piece and the place of each suffix in sorted order, and groups (length, suffix numbers): all occurrences of a
    string that can't be extended to the right in all of them, nor to the left (their left bytes differ; the byte before a
    piece is unknown and so differs from every other). suffixes: how many first suffixes of each piece take part (all).
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    count = np.maximum(sizes - least + 1, 0) if suffixes is None else np.asarray(suffixes, np.int64)
    piece = np.repeat(np.arange(len(pieces)), count)
    place = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    if not len(piece):
        return piece, place, []
    words = int(-(-sizes.max() // 8))
    joined = np.frombuffer(b"".join(pieces) + bytes(8 * words + 8), np.uint8)
    begin = (np.cumsum(sizes) - sizes)[piece] + place
    left = np.where(place > 0, joined[np.maximum(begin - 1, 0)].astype(np.int64), -1 - np.arange(len(piece)))
    length = sizes[piece] - place
    # Eight bytes at a time as one big-endian number; bytes behind the piece's end are zero, and shorter suffixes come first.
    at_byte = np.zeros(len(joined) - 7, np.uint64)
    for i in range(8):
        at_byte = (at_byte << np.uint64(8)) | joined[i : len(joined) - 7 + i]
    columns = []
    for w in range(words):
        have = np.clip(length - 8 * w, 0, 8)
        value = at_byte[np.minimum(begin + 8 * w, len(at_byte) - 1)]
        shift = (8 * (8 - have)).astype(np.uint64)
        columns.append(np.where(have > 0, (value >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)), np.uint64(0)))
    order = np.lexsort((length, *columns[::-1]))
    piece, place, left, length = piece[order], place[order], left[order], length[order]
    common = np.zeros(len(order), np.int64)  # with the suffix before
    open_ = np.ones(len(order), bool)
    open_[0] = False
    for w in range(words):
        c = columns[w][order]
        differ = np.r_[np.uint64(0), c[1:] ^ c[:-1]]
        same = np.full(len(order), 8)
        odd = differ != 0
        same[odd] = (63 - np.floor(np.log2(differ[odd].astype(np.float64))).astype(np.int64).clip(0, 63)) // 8
        # a float's logarithm may round up at a power of two; look at the byte itself
        wrong = odd & (same < 8) & ((differ >> (np.uint64(56) - np.uint64(8) * np.minimum(same, 7).astype(np.uint64))) & np.uint64(255) == 0)
        same[wrong] += 1
        common += np.where(open_, same, 0)
        open_ &= ~odd
    common[1:] = np.minimum(common[1:], np.minimum(length[1:], length[:-1]))
    joins = common >= least
    joins[0] = False
    first = np.flatnonzero(~joins & np.r_[joins[1:], False])  # where trees of two or more suffixes begin
    behind = np.flatnonzero(joins & ~np.r_[joins[1:], False]) + 1
    groups: list[tuple[int, np.ndarray]] = []
    for a, b in zip(first.tolist(), behind.tolist()):
        if b - a == 2:
            if left[a] != left[a + 1]:
                groups.append((int(common[a + 1]), np.array([a, a + 1])))
            continue
        if (left[a:b] == left[a]).all():
            continue  # the same string one byte to the left has all these occurrences
        stack: list[tuple[int, int]] = []
        for i, height in enumerate([*common[a + 1 : b].tolist(), -1], a + 1):
            start = i - 1
            while stack and stack[-1][0] > height:
                depth, start = stack.pop()
                if (left[start:i] != left[start]).any():
                    groups.append((depth, np.arange(start, i)))
            if height >= 0 and (not stack or stack[-1][0] < height):
                stack.append((height, start))
    return piece, place, groups


SPANS = {"_id": pa.int64(), "run": pa.int64(), "start": pa.int32(), "end": pa.int32()}


def _later_spans(rows: list[tuple[int, int, bytes, int]]) -> list[tuple[int, int, int, int]]:
    """(document, run, from, to) of bytes that belong to a repeat with an earlier document; rows: document, run, bytes, suffixes."""
    docs = np.array([r[0] for r in rows], np.int64)
    piece, place, groups = interval_repeats([r[2] for r in rows], LENGTH, [r[3] for r in rows])
    own = docs[piece]
    out = []
    for length, numbers in groups:
        doc = own[numbers]
        for i in numbers[doc > doc.min()].tolist():
            row = rows[piece[i]]
            out.append((row[0], row[1], int(place[i]), int(place[i]) + length))
    return out


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column of numbers as arrays; null is empty."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    present = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if there else values[:0] for a, b, there in zip(offsets[:-1].tolist(), offsets[1:].tolist(), present.tolist())]


def _decided(rows: DataFrame, *key: str) -> DataFrame:
    """`rows` with `late`: whether a smaller _id has the same key. The first key's last byte is the salt of `_known`."""
    first = F.first("_id").over(Window.partitionBy(*key).orderBy("_id"))
    return rows.withColumn("late", (F.col(key[0]) % 256 != 0) | (F.col("_id") > first))


def _known(ids: np.ndarray, key: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows to send, a key once for each id, and the first key with a salt in its last byte.

    Rows with a smaller id for all their keys in the slice are late whatever other tasks find: a salt over 0 marks and spreads
    them, so that no key is hot by copies. Rows stay in the order of documents, which keeps the shuffle small.
    """
    order = np.lexsort((ids, *more, key))
    new = np.zeros(len(order), bool)
    for k in (key, *more):
        new |= np.r_[True, k[order][1:] != k[order][:-1]]
    again = ~(new | np.r_[True, ids[order][1:] != ids[order][:-1]])
    begins = np.flatnonzero(new)
    smallest = np.repeat(ids[order][begins], np.diff(np.r_[begins, len(order)]))
    salted = np.empty(len(order), np.int64)
    salted[order] = (key[order] << 8) | np.where(ids[order] > smallest, 1 + ids[order] % 64, 0)
    rows = np.sort(order[~again])
    return rows, salted[rows]


def repeat_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, whole, spans): runs, by their hash, that are removed as a whole; parts of others: run, from, to, one behind another."""
    chosen = docs.select(order_id(F.col(id_col)).alias("_id"), F.col(text_col).alias("_text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            ids = batch.column(0).to_numpy()
            found = [(first, runs_of(texts)) for first, texts in _groups(batch.column(1).to_pylist())]
            i = np.concatenate([ids[r.doc + first] for first, r in found])
            k, h = np.concatenate([r.key for _, r in found]), np.concatenate([r.hash for _, r in found])
            if len(i):
                rows, salted = _known(i, k, h)
                yield _arrays(_id=i[rows], key=salted, run=h[rows])

    rows = _decided(chosen.mapInArrow(keyed, "_id long, key long, run long"), "key", "run")
    same_key = Window.partitionBy("key")
    mixed = ~F.col("late") & (F.min("run").over(same_key) != F.max("run").over(same_key)) & (F.min("_id").over(same_key) != F.max("_id").over(same_key))
    rows = rows.withColumns({"mixed": mixed, "n": F.count("*").over(same_key)}).where("late OR mixed")
    kind = F.when(F.col("late"), 0).when(F.col("n") <= MOST_RUNS, 1).otherwise(2)
    # Rows are in the order of keys, so that a partial aggregate by document would only add to the shuffle.
    by_doc = rows.select("_id", "run", kind.alias("kind")).repartition("_id").groupBy("_id")
    by_doc = stored(by_doc.agg(*(F.collect_set(F.when(F.col("kind") == i, F.col("run"))).alias(k) for i, k in enumerate(("whole", "some", "many")))), "runs")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            ids, wanted, out = batch.column("_id").to_pylist(), _lists(batch.column("some")), []
            for first, texts in _groups(batch.column("_text").to_pylist()):
                r = runs_of(texts)
                chosen_runs = np.flatnonzero(np.isin(r.own(), _flat(wanted[first : first + len(texts)])))
                _, once = np.unique(r.own()[chosen_runs], return_index=True)
                for i in chosen_runs[once].tolist():
                    at, n = int(r.begin[i]), int(r.long[i])
                    out.append((int(r.key[i]), ids[first + r.doc[i]], int(r.hash[i]), r.data[at : at + n + LENGTH - 1].tobytes(), n))
            yield _columns(out, {"key": pa.int64(), "_id": pa.int64(), "run": pa.int64(), "piece": pa.binary(), "n": pa.int32()})

    def sorted_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, int]] = []
        last = None
        for batch in batches:
            found = []
            for key, doc, run, piece, n in zip(*(c.to_pylist() for c in batch.columns)):
                if key != last and len(held) >= 10_000:
                    found += _later_spans(held)
                    held = []
                held.append((doc, run, piece, n))
                last = key
            yield _columns(found, SPANS)
        if held:
            yield _columns(_later_spans(held), SPANS)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            ids, wanted, parts = batch.column("_id").to_numpy(), _lists(batch.column("many")), []
            for first, texts in _groups(batch.column("_text").to_pylist()):
                r = runs_of(texts)
                chosen_runs = np.flatnonzero(np.isin(r.own(), _flat(wanted[first : first + len(texts)])))
                long = r.long[chosen_runs]
                run = np.repeat(chosen_runs, long)
                if len(run):
                    place = np.arange(len(run)) - np.repeat(np.cumsum(long) - long, long)
                    at = r.begin[run] + place
                    parts.append((ids[r.doc[run] + first], _span_hashes(_grams(r.data, GRAM), at, at + LENGTH).view(np.int64), r.hash[run], place))
            if parts:
                i, h, run, place = (np.concatenate(c) for c in zip(*parts))
                rows, salted = _known(i, h & ((1 << 55) - 1), h, run, place)
                yield _arrays(_id=i[rows], suffix=salted, run=run[rows], place=place[rows])

    found = chosen.join(by_doc.select("_id", "some", "many"), "_id")
    pieces = found.where(F.size("some") > 0).mapInArrow(sent, "key long, _id long, run long, piece binary, n int")
    spans = pieces.repartition("key").sortWithinPartitions("key").mapInArrow(sorted_suffixes, "_id long, run long, start int, end int")
    if by_doc.where(F.size("many") > 0).limit(1).count():  # keys with very many surroundings: by the suffixes' own hashes
        single = _decided(found.where(F.size("many") > 0).mapInArrow(suffixes, "_id long, suffix long, run long, place long"), "suffix")
        spans = spans.unionByName(single.where("late").select("_id", "run", F.col("place").cast("int").alias("start"), (F.col("place") + LENGTH).cast("int").alias("end")))
    parts = stored(spans.groupBy("_id").agg(F.flatten(F.collect_list(F.array("run", F.col("start").cast("long"), F.col("end").cast("long")))).alias("spans")), "spans")
    return by_doc.select("_id", "whole").join(parts, "_id", "full")


def _flat(lists: list[np.ndarray]) -> np.ndarray:
    """The hashes of all lists, told apart by the list's number as `Runs.own` does by document."""
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return _of_document(np.concatenate(lists).astype(np.int64), doc)


def _removed(r: Runs, whole: list[np.ndarray], spans: list[np.ndarray]) -> np.ndarray:
    """Which bytes of `r.data` go: of each document the whole runs, and the spans (run, from, to one behind another)."""
    edges = np.zeros(len(r.data) + 1, np.int64)
    own = r.own()
    gone = np.isin(own, _flat(whole))
    np.add.at(edges, r.begin[gone], 1)
    np.add.at(edges, (r.begin + r.long + LENGTH - 1)[gone], -1)
    run = _flat([s[::3] for s in spans])
    if len(run):
        order = np.argsort(run)
        every = np.concatenate(spans).reshape(-1, 3)[order]
        low, high = np.searchsorted(run[order], own, "left"), np.searchsorted(run[order], own, "right")
        n = high - low
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        np.add.at(edges, np.repeat(r.begin, n) + every[number, 1], 1)
        np.add.at(edges, np.repeat(r.begin, n) + every[number, 2], -1)
    return np.cumsum(edges[:-1]) > 0


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes) for each row of `docs`.

    Texts are UTF-8 bytes (null: none). A byte goes if a string of 50 bytes over it also begins in a document with a smaller
    id, as the input has them. n_spans: maximal runs of removed bytes. kept_bytes (null unless with_bytes): the rest, which
    may cut a character. Rows with one id are one document: they take nothing from each other. Rows without id are one
    document behind all others. Texts under 50 bytes stay whole.
    """
    chosen = docs.select(order_id(F.col(id_col)).alias("_id"), F.col(text_col).alias("_text"))
    joined = chosen.join(repeat_spans(docs, id_col, text_col), "_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            out, ids = [], batch.column("_id").to_pylist()
            whole, spans = _lists(batch.column("whole")), _lists(batch.column("spans"))
            for first, texts in _groups(batch.column("_text").to_pylist()):
                some = [i for i in range(len(texts)) if len(whole[first + i]) or len(spans[first + i])]
                gone_of = dict.fromkeys(range(len(texts)))
                if some:
                    r = runs_of([texts[i] for i in some])
                    gone = _removed(r, [whole[first + i] for i in some], [spans[first + i] for i in some])
                    gone_of.update((i, gone[at : at + len(texts[i])]) for i, at in zip(some, r.starts.tolist()))
                for i, text in enumerate(texts):
                    gone = gone_of[i]
                    if gone is None or not gone.any():
                        kept, n_removed, n_spans = text, 0, 0
                    else:
                        kept, n_removed = np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum())
                        n_spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
                    out.append((ids[first + i], len(text), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
            yield _columns(out, {"_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept_bytes": pa.binary()})

    found = joined.select("_id", "_text", "whole", "spans").mapInArrow(run, "_id long, " + RESULT)
    return found.select(F.when(F.col("_id") != 2**63 - 1, F.col("_id")).alias("doc_id"), *(f.split(" ")[0] for f in RESULT.split(", ")))
