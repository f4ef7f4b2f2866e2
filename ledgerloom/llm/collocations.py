"""Collocations of each language, counted in depth-truncated suffix trees that are built apart from one another.

The corpus is partitioned vertically: prefixes of one word, and of two where one word begins too many suffixes, are counted,
laid out in the order of their hashes and grouped so that a group's suffixes fit a memory budget. Each group's suffixes, cut
off at the longest phrase, are sorted, and one scan of the sorted stream builds the branches and reads each phrase's count from
the totals of its leaves. Prefixes that can't reach the least count are left out before: a phrase is never more frequent than a
part of it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import LOWER, UPPER, Marked, slices, stored

#: The contract's separators of pieces, [.,;:!?\x0A-\x0D], all shown as a full stop; tabs as blanks; A-Z lower-cased.
SEPARATORS = ".,;:!?\n\x0b\x0c\r"
_SHOWN = bytes.maketrans((UPPER + SEPARATORS + "\t").encode(), (LOWER + "." * len(SEPARATORS) + " ").encode())
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SIGN = np.int64(-(2**63))


def blocks_of_words(text: str | None, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words in order, with b"." between pieces and at the end, in lists of about `most` bytes of text."""
    data = (text or "").encode().translate(_SHOWN)
    begin = 0
    while len(data) - begin > most:
        at = data.rfind(b" ", begin, begin + most)
        at = at if at >= 0 else data.find(b" ", begin + most)
        if at < 0:
            break
        yield data[begin:at].replace(b".", b" . ").split()
        begin = at
    yield [*data[begin:].replace(b".", b" . ").split(), b"."]


def hash_of(word: bytes, seed: int) -> int:
    """Never 0, which marks the end of a piece."""
    return xxhash.xxh3_64_intdigest(word, seed) or 1


class _Hashes(dict):
    def __init__(self, seed: int):
        super().__init__({b".": 0})
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = hash_of(word, self.seed)
        if len(word) <= 40 and len(self) < 200_000:
            self[word] = h
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def keys(lang: np.ndarray, *words: np.ndarray) -> np.ndarray:
    """A key of each language and run of words."""
    return reduce(lambda h, w: _mix(h * _BASE + w), words, _mix(lang))


def _counted(key: np.ndarray, columns: list[np.ndarray]) -> list[np.ndarray]:
    """Distinct rows and their counts. Rows of one key that differ stay apart, though a row may then come twice."""
    order = np.argsort(key)
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [*(c[at] for c in columns), np.diff(np.r_[at, len(order)])]


def _shift(h: np.ndarray, by: int) -> np.ndarray:
    return np.r_[h[by:], np.zeros(min(by, len(h)), h.dtype)]


class Scan:
    """Runs over the corpus as hashes of words, a million words at a time, and counts what `rows` picks."""

    def __init__(self, seed: int, names: list[str], most: int = 1 << 20):
        self.seed, self.names, self.most = seed, names, most

    def rows(self, lang: np.ndarray, h: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        raise NotImplementedError

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, langs, held, size = _Hashes(self.seed), {}, [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            h = np.concatenate([h for _, h in held])
            lang = np.repeat(np.array([x for x, _ in held], np.uint64), [len(h) for _, h in held])
            for key, columns in self.rows(lang, h):
                if len(key):
                    found = [c.view(np.int64) if c.dtype == np.uint64 else c for c in _counted(key, columns)]
                    for k in range(0, len(found[0]), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in found], names=[*self.names, "n"])

        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang not in langs:
                    langs[lang] = hash_of(lang.encode(), self.seed)
                for words in blocks_of_words(text):
                    held.append((langs[lang], np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))))
                    size += len(words)
                # Texts end with a break, so runs never go on into the next text.
                if size >= self.most:
                    yield from counted()
                    held, size = [], 0
        if held:
            yield from counted()


class Pairs(Scan):
    """Two-word prefixes of frequent words."""

    def __init__(self, seed: int, frequent):
        super().__init__(seed, ["lang_id", "w1", "w2", "key"])
        self.frequent = frequent

    def rows(self, lang, h):
        good = (h != 0) & self.frequent.value(keys(lang, h))
        at = np.flatnonzero(good & _shift(good, 1))
        key = keys(lang[at], h[at], h[at + 1])
        yield key, [lang[at], h[at], h[at + 1], key]


class Suffixes(Scan):
    """Suffixes that begin with a frequent pair, cut off at `longest` words or behind the last frequent pair, and their groups.

    Under a pair that is over the budget itself, each longer prefix is a row of its own with a group of its own.
    """

    def __init__(self, seed: int, longest: int, frequent, layout):
        super().__init__(seed, ["prefix", "lang_id", *(f"w{k + 1}" for k in range(longest)), "grp"])
        self.longest, self.frequent, self.layout = longest, frequent, layout

    def rows(self, lang, h):
        hot_words, hot_pairs, cuts = self.layout.value
        after = _shift(h, 1)
        good = (h != 0) & (after != 0)
        pair = keys(lang, h, after)
        good &= self.frequent.value(pair)
        at = np.flatnonzero(good)
        words, runs = [h[at], after[at]], good[at]
        for k in range(2, self.longest):
            runs = runs & np.r_[good, np.zeros(k, bool)][at + k - 1]
            words.append(np.where(runs, np.r_[h, np.zeros(k, h.dtype)][at + k], 0))
        lang, pair, one = lang[at], pair[at], keys(lang[at], h[at])
        longer = np.flatnonzero(words[2] != 0) if self.longest > 2 else np.zeros(0, np.int64)  # pairs are counted already
        lang, pair, one, words = lang[longer], pair[longer], one[longer], [w[longer] for w in words]

        two = _among(hot_words, one)
        hot = two & _among(hot_pairs, pair)
        prefix = np.where(two, pair, one)
        group = np.searchsorted(cuts, prefix.view(np.int64) ^ _SIGN, "right") - 1
        cold = ~hot
        chosen = [w[cold] for w in words]
        yield keys(lang[cold], *chosen), [np.where(two[cold], 2, 1), lang[cold], *chosen, np.maximum(group[cold], 0)]
        for length in range(3, self.longest + 1):
            at = np.flatnonzero(hot & (words[length - 1] != 0))
            chosen = [words[k][at] if k < length else np.zeros(len(at), np.uint64) for k in range(self.longest)]
            key = keys(lang[at], *chosen[:length])
            yield key, [np.full(len(at), length), lang[at], *chosen, (key % np.uint64(max(len(cuts), 1))).astype(np.int64)]


def _among(ordered: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(found), bool)
    return ordered[np.minimum(np.searchsorted(ordered, found), len(ordered) - 1)] == found


def tree_scan(batches: Iterator[pa.RecordBatch], longest: int, least: int) -> Iterator[pa.RecordBatch]:
    """Phrases of three words or more and their counts, from sorted suffixes with counts.

    Equal beginnings of neighbours are a branch of the tree. Only the branch of the last suffix is open: its nodes' totals so
    far are carried from batch to batch, so memory doesn't follow a subtree's size.
    """
    names = [f"w{k + 1}" for k in range(longest)]
    open_: dict[int, tuple[list[int], int]] = {}  # depth: (prefix, lang_id, words) and total of the open node

    def emit(rows: list[tuple[list[int], int]], depth: int) -> Iterator[pa.RecordBatch]:
        kept = [(*row[1 : depth + 2], *[0] * (longest - depth), n) for row, n in rows if n >= least and row[depth + 1] and (row[0] <= 2 or row[0] == depth)]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], names=["lang_id", *names, "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("prefix", "lang_id", *names)])
        n = batch.column("n").to_numpy()
        differs = np.ones(columns.shape, bool)
        differs[:, 1:] = columns[:, 1:] != columns[:, :-1]
        for depth in range(3, longest + 1):
            new = differs[: depth + 2].any(axis=0)
            if depth in open_:
                new[0] = open_[depth][0][: depth + 2] != columns[: depth + 2, 0].tolist()
            begin = np.flatnonzero(np.r_[True, new[1:]])
            totals = np.add.reduceat(n, begin)
            if depth in open_:
                if new[0]:
                    yield from emit([open_[depth]], depth)
                else:
                    totals[0] += open_[depth][1]
            done = np.flatnonzero(totals[:-1] >= least)
            yield from emit([(columns[:, begin[k]].tolist(), int(totals[k])) for k in done.tolist()], depth)
            open_[depth] = (columns[:, begin[-1]].tolist(), int(totals[-1]))
    for depth, node in open_.items():
        yield from emit([node], depth)


def counted_words(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, lang_id, word, hash, key, n) of every word; ids, hashes and keys as 64 bits."""
    def count(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                words.pop(b".", None)
                if not words:
                    continue
                lang_id = hash_of(lang.encode(), seed)
                h = np.fromiter((hash_of(w, seed) for w in words), np.uint64, len(words))
                key = keys(np.full(len(h), lang_id, np.uint64), h)
                ids = pa.array(np.full(len(h), lang_id, np.uint64).view(np.int64))
                whole = pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(h)), ids, pa.array([w.decode() for w in words], pa.string()), pa.array(h.view(np.int64)), pa.array(key.view(np.int64)), pa.array(list(words.values()), pa.int64())],
                    names=["lang", "lang_id", "word", "hash", "key", "n"],
                )
                yield from slices(iter([whole]), "word")

        for batch in slices(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counter = held.setdefault(lang, Counter())
                for words in blocks_of_words(text):
                    counter.update(words)
            if sum(map(len, held.values())) > most:
                yield from counted()
                held.clear()
        yield from counted()

    found = docs.mapInArrow(count, "lang string, lang_id long, word string, hash long, key long, n long")
    return found.groupBy("lang", "lang_id", "word", "hash", "key").agg(F.sum("n").alias("n"))


def _distinct(words: DataFrame) -> bool:
    """Whether no two words and no two languages share a hash."""
    pairs = words.select(F.lit(0), "hash", "word").union(words.select(F.lit(1), "lang_id", "lang")).toDF("kind", "h", "s")
    return pairs.groupBy("kind", "h").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a != b").isEmpty()


def _layout(words: DataFrame, pairs: DataFrame, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of words over the budget, keys of pairs over it, first ordered key of each group of prefixes), all sorted.

    All words make N suffixes, so at most N / budget words, pairs and groups come to the driver; see `collocations`.
    """
    over = F.col("n") > budget
    hot_words = np.sort(words.where(over).select("key").toArrow().column(0).to_numpy().view(np.uint64))
    hot_pairs = np.sort(pairs.where(over).select("key").toArrow().column(0).to_numpy().view(np.uint64))
    hot = words.where(over).select("lang_id", F.col("hash").alias("w1"))
    prefixes = words.where(~over).select("key", "n").union(pairs.where(~over).join(hot, ["lang_id", "w1"], "left_semi").select("key", "n"))
    prefixes = prefixes.withColumn("place", F.col("key").bitwiseXOR(F.lit(int(_SIGN))))  # signed order of the unsigned key
    prefixes = prefixes.withColumn("strip", F.shiftright("place", 52))
    strips = {row["strip"]: row["n"] for row in prefixes.groupBy("strip").agg(F.sum("n").alias("n")).collect()}  # 4,096 at most
    before = np.cumsum([0, *(strips[k] for k in sorted(strips))]).tolist()
    offsets = F.broadcast(words.sparkSession.createDataFrame(list(zip(sorted(strips), before)), "strip long, before long"))
    running = F.sum("n").over(Window.partitionBy("strip").orderBy("place"))
    grouped = prefixes.withColumn("running", running).join(offsets, "strip").withColumn("grp", F.expr(f"(before + running - n) DIV {budget}"))
    cuts = grouped.groupBy("grp").agg(F.min("place").alias("first")).toArrow().column("first").to_numpy()
    return hot_words, hot_pairs, np.sort(cuts)


def _part(names: list[Column], longest: int) -> Column:
    """A run of words as a key of `longest` words, filled up with zeros."""
    return F.struct(*(c.alias(f"p{k + 1}") for k, c in enumerate([*names, *[F.lit(0).cast("long")] * (longest - len(names))])))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, top: int = 2000, scale: int = 2_000_000,
    covered: int = 80, least_budget: int = 1 << 16,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` collocations of each language.

    Texts (null: empty) are lower-cased in A-Z and split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at blanks and tabs into
    words. A null language is `und`. n: all words of the language. f(phrase): its occurrences within pieces, overlapping ones
    too. Candidates are phrases of 2 to `longest` words with a = f(phrase) >= `least`. Cut after k words, a candidate has l and r
    as f of both parts and the score scale * a // (l + r); its lowest score counts, of equal ones that with the smallest k.
    A candidate goes if a longer one holds its words in a run and has 100 * f >= covered * a. Ranks are by score and a, both
    descending, then by the phrase in the order of its bytes. Repeated rows count as often as they come. Other columns are not
    read. An empty table and texts without words give no rows. Very long texts are worked on in blocks of a megabyte.

    Words are 64-bit hashes on the way; that no two words share one is checked, else another seed is taken. Prefixes are grouped
    by a budget of max(`least_budget`, N / 2^16) suffixes, N being all words, so at most 2^16 cuts between groups, words and pairs
    over the budget are broadcast, and two sets of frequent prefixes as bits, of 16 MB at most. Counts are added up in each task
    before they are shuffled, so a word, pair or text that comes very often is a row a million words.
    """
    session = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    seed = 0
    words = stored(counted_words(docs, seed), "words")
    while not _distinct(words):
        seed += 1
        words = stored(counted_words(docs, seed), "words")
    totals = words.groupBy("lang", "lang_id").agg(F.sum("n").alias("total"))
    every = words.agg(F.sum("n")).first()[0] or 0
    budget = max(least_budget, every >> 16)
    words = words.where(F.col("n") >= least)

    share = session.sparkContext.broadcast
    scan = Pairs(seed, share(Marked(words, "key")))
    pairs = docs.mapInArrow(scan, "lang_id long, w1 long, w2 long, key long, n long")
    pairs = stored(pairs.groupBy("lang_id", "w1", "w2", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "pairs")

    names = [f"w{k + 1}" for k in range(longest)]
    scan = Suffixes(seed, longest, share(Marked(pairs, "key")), share(_layout(words, pairs, budget)))
    suffixes = docs.mapInArrow(scan, ", ".join(f"{c} long" for c in ("prefix", "lang_id", *names, "grp", "n")))
    order = ["grp", "prefix", "lang_id", *names]
    sorted_ = suffixes.repartition("grp").sortWithinPartitions(*order).drop("grp")
    longer = sorted_.mapInArrow(lambda batches: tree_scan(batches, longest, least), ", ".join(f"{c} long" for c in ("lang_id", *names, "n")))
    nothing = [F.lit(0).cast("long").alias(c) for c in names]
    phrases = stored(longer.union(pairs.select("lang_id", "w1", "w2", *nothing[2:], "n")), "phrases")

    # Each cut asks for the counts of its two parts.
    columns = [F.col(c) for c in names]
    length = sum(((F.col(c) != 0).cast("int") for c in names), F.lit(0))
    asks = []
    for size in range(2, longest + 1):
        for k in range(1, size):
            for side, part in enumerate((columns[:k], columns[k:size])):
                asks.append(F.when(F.col("length") == size, F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), _part(part, longest).alias("part"))))
    sized = phrases.withColumn("length", length)
    asked = sized.select("lang_id", *names, "length", "n", F.explode(F.array_compact(F.array(*asks))).alias("ask"))
    asked = asked.select("lang_id", *names, "length", F.col("n").alias("a"), "ask.k", "ask.side", "ask.part.*")
    parts = [f"p{k + 1}" for k in range(longest)]
    known = words.select("lang_id", F.col("hash").alias("w1"), *nothing[1:], "n").union(phrases.where(F.col(names[-1]) == 0)).toDF("lang_id", *parts, "f")
    cuts = asked.join(known, ["lang_id", *parts]).groupBy("lang_id", *names, "length", "a").agg(
        *(F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{c}{k}") for k in range(1, longest) for s, c in enumerate("lr"))
    )
    scores = [F.when(F.col("length") > k, F.struct(
        F.expr(f"(CAST(a AS decimal(20, 0)) * {scale}) DIV (CAST(l{k} AS decimal(20, 0)) + r{k})").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")
    )) for k in range(1, longest)]
    scored = cuts.withColumn("cut", F.array_min(F.array_compact(F.array(*scores)))).select("lang_id", *names, "a", "cut.l", "cut.r", "cut.score")

    if longest > 2:  # the largest count of a longer phrase around each phrase
        inner = [
            F.when(F.col("length") == size, _part(columns[k : k + n], longest)) for size in range(3, longest + 1) for n in range(2, size) for k in range(size - n + 1)
        ]
        around = sized.select("lang_id", "n", F.explode(F.array_compact(F.array(*inner))).alias("x")).select("lang_id", "x.*", "n").toDF("lang_id", *names, "n")
        around = around.groupBy("lang_id", *names).agg(F.max("n").alias("around"))
        scored = scored.join(around, ["lang_id", *names], "left")
        kept = F.expr(f"around IS NULL OR CAST(around AS decimal(20, 0)) * 100 < CAST(a AS decimal(20, 0)) * {covered}")
        scored = scored.where(kept).drop("around")

    # Two steps, so that no task holds all candidates of a language; ties at the last rank stay until phrases are spelt.
    best = [F.desc("score"), F.desc("a")]
    for by in ([F.pmod(F.xxhash64(*names), F.lit(64))], []):
        scored = scored.withColumn("place", F.rank().over(Window.partitionBy("lang_id", *by).orderBy(*best))).where(F.col("place") <= top).drop("place")
    spelt = scored.withColumn("words", F.array(*names)).select("*", F.posexplode("words").alias("at", "hash")).where("hash != 0")
    spelt = spelt.join(words.select("lang_id", "hash", "word"), ["lang_id", "hash"])
    spelt = spelt.groupBy("lang_id", "words", "a", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("found"))
    spelt = spelt.withColumn("phrase", F.array_join(F.col("found.word"), " "))
    rank = F.row_number().over(Window.partitionBy("lang_id").orderBy(*best, "phrase")).cast("long")
    ranked = spelt.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.join(totals, "lang_id").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
