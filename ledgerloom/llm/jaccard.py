"""Exact Jaccard join of documents as sets of word n-grams, by pivots, regions and the triangle inequality.

Nearly all pairs of documents are at Jaccard distance 1 or close to it, so that regions around pivot documents would need
windows that take in every document. The first regions are therefore made in restricted spaces: the n-grams are dealt into m
parts by hash, and a document's restriction to a part is its pivot there. Restricting never lengthens the symmetric
difference, and two documents that link differ in at most D n-grams, so with m > D they are at distance 0 from the same pivot
in at least m - D parts. Documents meet in these regions (a few for each five n-grams). Each document knows in how many parts
any linked one agrees with it at least; so many that it can, it leaves out, those with the fewest n-grams first (empty ones and
common single n-grams, in which also unlike documents agree).

A pair of a small region is a candidate only if it meets in as many regions as linked documents of these sizes must, less the
large ones that it may share. Large regions connect only documents that have so many of them that they could meet a linked one
in no other: near copies, not documents with a common passage. Groups of connected candidates are then joined with the Jaccard metric
itself: pivots, nearest-pivot cells, and windows of twice the radius that replicate boundary documents, recursively and
exactly. Pairs that are already connected are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Marked, content_keys, order_id, shown_id, slices, stored

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            self[word] = h
        return h


class Shingler:
    """Sets of n-gram hashes. The word cache is emptied at `most` words."""

    def __init__(self, size: int, most: int = 150_000):
        self.size, self.most, self.words = size, most, _Words()

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes; a text of fewer words is one n-gram, one without words has none."""
        words = (text or "").encode().lower().split()  # of bytes: A-Z, and [\x20\x09-\x0D]
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > self.most:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(words))
        found = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            found = _mix(found * _BASE + h[k : len(h) - n + 1 + k])
        return np.unique(found)


def key_of(found: np.ndarray) -> int:
    """A hash of a whole set."""
    return int(_mix(_mix(found + np.uint64(1)).sum(keepdims=True) + np.uint64(len(found))).view(np.int64)[0])


class Classes:
    """Size classes and their parts, for links of `percent` of the union or more.

    Two sizes that can link are in one class or in neighbouring ones; such pairs meet in the parts of the upper class.
    """

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.low, n, "right")) - 1

    def parts(self, c: int) -> tuple[int, int]:
        """m, and the most n-grams of a set of the class: linked sets of the class differ in fewer than m - 3 parts."""
        self.of(self.low[min(c, len(self.low) - 1)] * 2)
        while len(self.low) < c + 2:
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        most = self.low[c + 1] - 1
        d = 2 * most * (100 - self.percent) // (100 + self.percent)
        return d + 4 + d // 10, most

    def described(self, found: np.ndarray) -> tuple[int, np.ndarray, list[int]]:
        """A set's class, its pivots as 64-bit hashes in the parts of its class and of the next one (the last bit tells the
        class's), and for both how many of them a linked set must share with it at least.

        Linked sets agree in `sure` parts, told by this set's size. Of these all but `need` can be left out: every set leaves
        out its first by one order of all pivots, by n-grams and hash. Both numbers grow with `sure`; so of the parts in which
        two sets agree, no more go than the one with the larger `sure` may leave out, and both needs hold.
        """
        own, out, needs = self.of(len(found)), [], []
        for c in (own, own + 1):
            m, most = self.parts(c)
            sure = m - (len(found) + min(len(found) * 100 // self.percent, most)) * (100 - self.percent) // (100 + self.percent)
            need = min(sure, 3 + sure // 3)
            part = (_mix(found ^ np.uint64(c + 1)) % np.uint64(m)).astype(np.int64)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, part, _mix(found + _BASE))
            pivots = _mix(sums + _mix(np.arange(m).astype(np.uint64) + np.uint64(c << 32))) >> np.uint64(1) << np.uint64(1) | np.uint64(c & 1)
            out.append(pivots[np.lexsort((pivots, np.bincount(part, minlength=m)))[sure - need :]])
            needs.append(need)
        return own, np.concatenate(out), needs


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def shared_cells(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """The members of each first region in which two or more sets meet; linked sets meet in one at least."""
    classes = Classes(percent)
    found = [classes.described(s)[1] if len(s) else s for s in sets]
    region = np.concatenate(found)
    member = np.repeat(np.arange(len(sets)), [len(f) for f in found])
    order = np.argsort(region, kind="stable")
    begin = np.flatnonzero(np.r_[True, region[order][1:] != region[order][:-1]])
    cells = {}
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(order)]):
        if b - a > 1:
            cell = member[order[a:b]]
            cells.setdefault(cell.tobytes(), cell)
    return list(cells.values())


def join_region(sets: list[np.ndarray], percent: int, brute: int = 16, cells: list[np.ndarray] | None = None) -> list[int]:
    """The component of each set: the number of its first member. Exact for pairs that are in one of `cells` (all in one)."""
    label = np.arange(len(sets))  # of each member the smallest one known to be connected to it
    if not sum(map(len, sets)):
        return label.tolist()

    done = np.zeros(len(sets), bool)  # members whose links are all found

    def unite(members: np.ndarray) -> None:
        names = np.unique(label[members])
        if len(names) > 1:
            chosen = np.zeros(len(sets), bool)
            chosen[names] = True
            label[chosen[label]] = names[0]

    # Postings: the members that hold each n-gram. Overlaps with a pivot are counts over its n-grams' postings.
    sizes = np.array([len(s) for s in sets])
    radius = 1 - percent / 100 + 1e-9
    _, item = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(item, kind="stable")
    frequency = np.bincount(item)
    ends = np.cumsum(frequency)
    posted = member[order].astype(np.int32)
    begins = np.cumsum(sizes) - sizes
    # Central members hold the region's frequent n-grams; as pivots they link to the most.
    weight = np.add.reduceat(frequency[item], np.minimum(begins, len(item) - 1))  # what counting a pivot's overlaps takes
    central = weight / np.maximum(sizes, 1)

    def distances(pivot: int) -> np.ndarray:
        """Jaccard distances to all members; what links is united with the pivot on the way, which is done then."""
        own = item[begins[pivot] : begins[pivot] + sizes[pivot]]
        n = frequency[own]
        at = np.arange(n.sum()) + np.repeat(ends[own] - n - (np.cumsum(n) - n), n)
        both = np.bincount(posted[at], minlength=len(sets))
        union = sizes + sizes[pivot] - both
        unite(np.flatnonzero(100 * both >= percent * union))
        done[pivot] = True
        return 1 - both / union

    # Empty sets link with nothing and are in no cell. A pair needs a comparison only while neither member is done.
    compared: set[tuple[int, int]] = set()
    work = [np.flatnonzero(sizes > 0)] if cells is None else sorted(cells, key=len)
    while work:
        cell = work.pop()
        cell = cell[~done[cell]]
        own = label[cell]
        if len(cell) < 2 or (own == own[0]).all():
            continue
        if len(cell) <= brute:
            for k, i in enumerate(cell[:-1].tolist()):
                others = cell[k + 1 :]
                fits = 100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])
                others = others[fits & ~done[others] & (label[others] != label[i])]
                if len(others) * 3000 > weight[i]:
                    distances(i)
                    continue
                for j in others.tolist():
                    if (i, j) not in compared:
                        compared.add((i, j))
                        if _links(sets[i], sets[j], percent):
                            unite(np.array([i, j]))
            continue
        # The pivot comes from the components outside the largest one, if that holds most of the cell.
        names, number = np.unique(own, return_inverse=True)
        largest = np.bincount(number).argmax()
        outside = cell[number != largest] if 2 * (number == largest).sum() > len(cell) else cell
        p = int(outside[np.argmax(central[outside])])
        rest = cell[cell != p]
        to_p = distances(p)[rest]
        apart = label[rest] != label[p]
        if not apart.any():
            continue
        # What is too near the pivot for everything that isn't connected to it has no more links to find.
        reach = to_p >= to_p[apart].min() - radius
        rest, to_p = rest[reach], to_p[reach]
        q = int(rest[np.argmax(to_p)])
        to_q = distances(q)[rest]
        near_p, near_q = rest[to_p <= to_q + 2 * radius], rest[to_q <= to_p + 2 * radius]
        if len(near_p) + len(near_q) < 1.5 * len(rest):
            work += [near_p, near_q]
        else:  # the windows take in nearly all: both pivots are done, the others go on
            work.append(rest[rest != q])
    return label.tolist()


def _components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node reachable by `edges` (a, b). Alternates large and small stars until nothing changes.

    Each node's minimum comes by a grouping, whose partial sums take a hot node to a row a task, and a join.
    """
    def with_least(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("a").agg(F.min("b").alias("least")), "a")

    edges = stored(edges.distinct(), name)
    before = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        large = with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        down = large.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))  # repeats do not change the minimum; they go below
        least = with_least(down)
        small = least.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")).distinct())
        edges = stored(small.where("a != b").distinct(), name, instead_of=edges)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.toDF("node", "root")
        before = state


_MEETING = np.dtype([("region", "<i8"), ("key", "<i8")])


def _met(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, whether of a large region): all pairs of the sets that meet in a region of up to `most`, and of larger ones the
    region and each set."""
    rows = np.unique(rows)
    begin = np.flatnonzero(np.r_[True, rows["region"][1:] != rows["region"][:-1]]) if len(rows) else np.zeros(0, np.int64)
    n = np.diff(np.r_[begin, len(rows)])
    a, b, large = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for size in range(2, most + 1):
        members = rows["key"][begin[n == size][:, None] + np.arange(size)]
        i, j = np.triu_indices(size, 1)
        a.append(members[:, i].ravel())
        b.append(members[:, j].ravel())
        large.append(np.zeros(len(a[-1]), bool))
    hot = rows[np.repeat(n > most, n)]
    a.append(hot["region"])
    b.append(hot["key"])
    large.append(np.ones(len(hot), bool))
    return np.concatenate(a), np.concatenate(b), np.concatenate(large)


def _candidates(found: DataFrame, percent: int, small: int = 32, chunk: int = 1 << 20) -> DataFrame:
    """(a, b): pairs of keys, a < b, that connect all sets that link. `found`: key, n, cls, own, next, regions.

    Regions are dealt in buckets of about `chunk` rows, as packed arrays. Of a region with over `small` sets in a chunk of a
    task, `small` + 1 go on, by which it is known to be large, and the others are known to be in a large one.

    Two linked sets share as many regions of a class as either of them needs. A set with fewer large ones than it needs meets
    all that link with it in small ones also. So only sets with as many large ones are connected by them.
    """
    buckets = max(1, -(-(found.agg(F.sum(F.size("regions"))).first()[0] or 0) // chunk))

    def edges(a: np.ndarray, b: np.ndarray, large: np.ndarray, part: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(a), part):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + part]) for x in (a, b, large)], names=["a", "b", "large"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            rows = np.unique(np.concatenate(held))
            begin = np.flatnonzero(np.r_[True, rows["region"][1:] != rows["region"][:-1]])
            place = np.arange(len(rows)) - np.repeat(begin, np.diff(np.r_[begin, len(rows)]))
            hot, rows = rows[place > small], rows[place <= small]
            bucket = (_mix(rows["region"].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            blobs = [rows[x:y].tobytes() for x, y in zip(at.tolist(), [*at[1:].tolist(), len(rows)])]
            numbers, blobs = [*bucket[at].tolist(), -1], [*blobs, hot.tobytes()]
            for k in range(0, len(blobs), 64):
                yield pa.RecordBatch.from_arrays([pa.array(numbers[k : k + 64], pa.int64()), pa.array(blobs[k : k + 64], pa.binary())], names=["bucket", "rows"])

        for batch in batches:
            lists = batch.column("regions")
            regions = lists.flatten().to_numpy()
            rows = np.empty(len(regions), _MEETING)
            rows["region"], rows["key"] = regions, np.repeat(batch.column("key").to_numpy(), np.diff(lists.offsets.to_numpy()))
            held.append(rows)
            size += len(rows)
            if size >= chunk:
                yield from sent()
                held, size = [], 0
        if size:
            yield from sent()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist()):
                if bucket < 0:  # of large regions
                    hot = np.frombuffer(rows, _MEETING)
                    yield from edges(hot["region"].copy(), hot["key"].copy(), np.ones(len(hot), bool))
                    continue
                if bucket != now and held:
                    yield from edges(*_met(np.concatenate(held), small))
                    held = []
                now = bucket
                held.append(np.frombuffer(rows, _MEETING))
        if held:
            yield from edges(*_met(np.concatenate(held), small))

    packed = found.where(F.size("regions") > 0).select("key", "regions").mapInArrow(dealt, "bucket long, rows binary")
    spread = F.when(F.col("bucket") < 0, F.xxhash64("rows")).otherwise(F.lit(0))  # what is known to be in large regions goes anywhere
    packed = packed.withColumn("spread", spread).repartition("bucket", "spread").sortWithinPartitions("bucket").drop("spread")
    together = stored(packed.mapInArrow(met, "a long, b long, large boolean"), "met")
    hot = together.where("large").select(F.col("a").alias("region"), F.col("b").alias("key")).distinct()
    odd = F.col("region").bitwiseAND(F.lit(1))
    counted = hot.groupBy("key").agg(F.sum(odd).alias("odd"), F.sum(1 - odd).alias("even"))
    of = found.groupBy("key").agg(*(F.max(c).alias(c) for c in ("n", "cls", "own", "next"))).join(counted, "key", "left")
    for list_, same in (("own", "cls % 2 = 1"), ("next", "cls % 2 = 0")):
        of = of.withColumn(f"{list_}_hot", F.expr(f"coalesce(IF({same}, odd, even), 0L)"))
    kept = ("n", "cls", "own", "next", "own_hot", "next_hot")
    pairs = together.where("NOT large").groupBy("a", "b").agg(F.count("*").alias("met"))
    for side in "ab":
        pairs = pairs.join(of.select(F.col("key").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in kept)), side)

    def need(a: str, b: str) -> str:
        return f"greatest(greatest({a}, {b}) - least({a}_hot, {b}_hot), 0)"

    needed = F.expr(f"""CASE WHEN a_cls = b_cls THEN {need("a_own", "b_own")} + {need("a_next", "b_next")}
                             WHEN a_cls + 1 = b_cls THEN {need("a_next", "b_own")} WHEN b_cls + 1 = a_cls THEN {need("b_next", "a_own")} END""")
    near = (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (F.col("met") >= needed)
    # What needs a large region is connected by way of the smallest such set in it, whatever the sizes.
    full = hot.join(of, "key").where(F.expr("IF(region & 1 = cls % 2, own_hot >= own, next_hot >= next)")).select("region", "key")
    stars = full.join(full.groupBy("region").agg(F.min("key").alias("least")), "region").where("least < key")
    return pairs.where(near).select("a", "b").union(stars.select("least", "key")).toDF("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85, most_items: int = 1 << 21
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`; see `grouped`. component_id: the smallest doc_id reachable by
    links, itself included; rows without id are one document behind all others, shown as null."""
    out = grouped(docs, id_col, text_col, size, percent, most_items)
    component = F.when(F.col("n") == 0, F.col("_id")).otherwise(F.col("component"))
    return out.select(shown_id(F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"), shown_id(component).alias("component_id"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of rows that `grouped` links, and all rows without words, which link with nothing.

    Of a group, the smallest id stays (rows without id are last), and of its texts the one with the smallest content keys; of
    rows equal in both, one. So one row stays also where ids repeat or are missing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = grouped(docs, id_col, text_col, size, percent)
    firsts = groups.where("n > 0").groupBy("group").agg(F.min(F.struct("_id", "_t1", "_t2")).alias("first")).select("first.*").distinct()
    keyed = docs.select(order_id(F.col(id_col)).alias("_id"), *content_keys(text, ("_t1", "_t2")), F.struct(*docs.columns).alias("_row"), (F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]"))).alias("_words"))
    one = keyed.where("_words").join(firsts, ["_id", "_t1", "_t2"], "left_semi").groupBy("_id", "_t1", "_t2").agg(F.first("_row").alias("_row"))
    return one.select("_row.*").unionByName(keyed.where("NOT _words").select("_row.*"))


def grouped(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, most_items: int = 1 << 21) -> DataFrame:
    """(_id, _t1, _t2, n, group, component) for each row of `docs`: its id and content keys as in `common`, the size of its set,
    the group of rows connected by links, and the smallest _id there. Without words, group and component are of no use.

    A document's set: its distinct runs of `size` words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased); with fewer words the whole
    sequence as one; none without words or text. Two documents link when 100 * intersection >= percent * union; empty
    sets link with nothing. Repeated rows and equal sets link as any others.

    Equal sets are one (by a 64-bit hash of the set), whatever their number; no pairs of copies are made. A region of connected
    candidates is joined in one task while its distinct sets have up to `most_items` n-grams together. A larger one is dealt
    into blocks by hash, and each two blocks are joined in a task of their own, so memory doesn't follow the region's size.
    """
    keys = content_keys(F.coalesce(F.col(text_col), F.lit("")), ("_t1", "_t2"))
    chosen = docs.select(order_id(F.col(id_col)).alias("_id"), F.col(text_col).alias("_text"))
    keyed = docs.select(order_id(F.col(id_col)).alias("_id"), F.col(text_col).alias("_text"), *keys)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, classes, seen = Shingler(size), Classes(percent), set()
        for batch in slices(batches, "_text", 1 << 20):
            n, key, regions, kinds = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = make(text)
                k = key_of(found)
                n.append(len(found))
                key.append(k)
                cls, own, needs = classes.described(found) if len(found) and k not in seen else (0, np.zeros(0, np.uint64), [0, 0])
                regions.append(own.view(np.int64))
                kinds.append((cls, *needs))
                seen.add(k)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, regions)]), pa.int32()), pa.array(np.concatenate(regions)))
            rows = [batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(key, pa.int64()), lists]
            rows += [pa.array(x, pa.int32()) for x in zip(*kinds)]
            yield pa.RecordBatch.from_arrays(rows, names=["_id", "_t1", "_t2", "n", "key", "regions", "cls", "own", "next"])

    schema = "_id long, _t1 long, _t2 long, n long, key long, regions array<long>, cls int, own int, next int"
    found = stored(keyed.mapInArrow(described, schema), "described")
    near = _components(_candidates(found, percent), "stars")
    near = stored(near.union(near.select("root", "root").distinct()), "regions")

    meta = found.select("_id", "_t1", "_t2", "n", "key")
    classes_of = meta.groupBy("key").agg(F.min("_id").alias("first"), F.max("n").alias("n"))
    wanted = stored(near.join(classes_of, F.col("node") == F.col("key")).select(F.col("first").alias("_id"), "key", F.col("root").alias("region"), "n"), "wanted")
    large = wanted.groupBy("region").agg(F.sum("n").alias("items")).where(F.col("items") > most_items)
    large = large.select("region", F.ceil(2 * F.col("items") / most_items).alias("blocks"))
    any_large = not large.isEmpty()
    blocks = F.coalesce("blocks", F.lit(1))
    wanted = wanted.drop("n").join(large, "region", "left").withColumn("blocks", blocks).withColumn("block", F.expr("pmod(xxhash64(key), blocks)"))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Shingler(size)
        for batch in slices(batches, "_text", 1 << 20):
            sets = [make(t) for t in batch.column("_text").to_pylist()]
            own = pa.array([key_of(s) == k for s, k in zip(sets, batch.column("key").to_pylist())])
            kept = ["region", "blocks", "block", "key"]
            rows = pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*kept, "items"])
            yield rows.filter(own)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        last = (0, 0, 0)

        def done() -> pa.RecordBatch:
            keys = list(held)
            sets = list(held.values())
            # Chains of regions can be long, but only sets that meet in one of them can link.
            roots = join_region(sets, percent, cells=shared_cells(sets, percent)) if len(keys) > 1 else [0] * len(keys)
            whole = pa.array([last[1] == last[2]] * len(keys))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([keys[r] for r in roots], pa.int64()), whole], names=["key", "root", "whole"])

        for batch in batches:
            for *unit, key, items in zip(*(c.to_pylist() for c in batch.columns)):
                if tuple(unit) != last and held:
                    yield done()
                    held = {}
                last = tuple(unit)
                held[key] = np.frombuffer(items, np.uint64)
        if held:
            yield done()

    # Only texts that are wanted are shuffled, and a few more: the ids are a set of bits of bounded size.
    marked = docs.sparkSession.sparkContext.broadcast(Marked(wanted.select(F.xxhash64("_id").alias("h")), "h"))

    def sifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pa.array(marked.value(batch.column("_h").to_numpy().view(np.uint64))))
            yield kept.select(["_id", "_text"])

    chosen = chosen.withColumn("_h", F.xxhash64("_id")).mapInArrow(sifted, "_id long, _text string")
    # Rows that repeat an id bring other texts along; the key tells which one is meant.
    pieces = chosen.join(wanted, "_id").mapInArrow(gathered, "region long, blocks long, block long, key long, items binary")
    # Each two blocks are a unit; a region of one block is one unit with itself.
    others = F.expr("IF(blocks = 1, array(0L), filter(sequence(0L, blocks - 1), other -> other != block))")
    units = pieces.withColumn("other", F.explode(others)).select("region", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "items")
    dealt_units = units.repartition("region", "low", "high").sortWithinPartitions("region", "low", "high", "key")
    linked = stored(dealt_units.mapInArrow(joined, "key long, root long, whole boolean"), "links")
    if any_large:  # a set is in several units then, and what they found is connected once more
        across = _components(linked.where("NOT whole AND key != root").select(F.col("root").alias("a"), F.col("key").alias("b")), "across").toDF("key", "root")
        linked = linked.where("whole").select("key", "root").union(across).union(across.select("root", "root").distinct())
    smallest = linked.join(classes_of, "key").groupBy("root").agg(F.min("first").alias("component"))
    by_key = classes_of.join(linked.join(smallest, "root"), "key", "left")
    by_key = by_key.select("key", F.coalesce("root", "key").alias("group"), F.coalesce("component", "first").alias("component"))
    return meta.join(by_key, "key").drop("key")
