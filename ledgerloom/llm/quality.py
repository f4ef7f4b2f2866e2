"""Quality rules: word statistics, and perplexity bands under an n-gram model of each language.

The model is an interpolated modified Kneser-Ney model of runs of four characters, one for each value of the language column.
Spark counts the runs over all documents; continuation counts, discounts and back-off weights are groupings and joins of the
counted runs, so the model grows with the corpus and never passes through the driver. It is stored in ranges of sorted 64-bit
hashes of the runs. Documents are scored in blocks: a block sends its distinct runs' hashes to a join with the model and gets
its part of the model back as sorted arrays.

A document doesn't vouch for itself: a run that no other row holds is scored by its shorter runs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import content_keys, order_id, slices, stored

ORDER = 4
#: Bytes of text in a block, one row at least.
BLOCK = 40 << 20
#: Bytes of text whose runs are held at once, one row at least; the arrays of its runs take about eighty times as much.
SLICE = 256 << 10
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIGNS = "#*$%&|<>"
#: Behind the numbers of all rows.
LAST_ROW = 2**62
#: Distance of a quartile from the median of a normal distribution, in standard deviations.
QUARTILE = 0.6745
_PLAIN = 0x3001  # no white space beyond


def _symbol(code: int) -> int:
    c = chr(code)
    return 32 if c.isspace() or not code else 48 if c.isdigit() else code


_TABLE = np.array([_symbol(c) for c in range(_PLAIN)], np.uint32)


def symbols(text: str) -> np.ndarray:
    """The text's characters in lower case; a digit is a 0, a run of white space one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    found = np.where(codes < _PLAIN, _TABLE[np.minimum(codes, _PLAIN - 1)], codes)
    return found[(found != 32) | (np.r_[0, found[:-1]] != 32)]


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))


def hashes(windows: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each column of `windows` (ORDER rows of symbols), under its language's seed."""
    found = seeds.copy()
    for row in windows:
        found ^= row
        found *= np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(29)
    return found


def _runs(langs: list[str], parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of the texts the run that ends there (a column of ORDER symbols, zeros before the text), and its hash."""
    gap = np.zeros(ORDER - 1, np.uint32)
    padded = np.concatenate([x for part in parts for x in (gap, part)])
    ends = np.flatnonzero(np.concatenate([x for part in parts for x in (gap > 0, np.ones(len(part), bool))]))
    windows = np.stack([padded[ends - k] for k in range(ORDER - 1, -1, -1)])
    seeds = {lang: np.uint64(_seed(lang)) for lang in set(langs)}
    return windows, hashes(windows, np.repeat(np.array([seeds[x] for x in langs], np.uint64), [len(p) for p in parts]))


def _texts(batch: pa.RecordBatch) -> tuple[list[int], list[str], list[np.ndarray]]:
    """Places, languages and symbols of the rows that have text."""
    rows = [(i, lang, symbols(text)) for i, (lang, text) in enumerate(zip(batch.column("_lang").to_pylist(), batch.column("_text").to_pylist())) if text]
    return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def base_figures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; see `quality_verdicts`."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    n = len(words)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
        elif _WORD.search(line):
            seen.add(line)
    repeated = 0
    threes = list(zip(words, words[1:], words[2:]))
    if len(set(threes)) < len(threes):
        counts, until = Counter(threes), 0
        for i, three in enumerate(threes):
            if counts[three] > 1:
                repeated += i + 3 - max(until, i)
                until = i + 3
    return n, sum(map(len, words)), sum(map(text.count, _SIGNS)), dup_lines, repeated


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        order_id(F.col(id_col)).alias("_id"), F.col(id_col).cast("long").alias("doc_id"), *content_keys(F.coalesce(text, F.lit("")), ("_t1", "_t2")),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang"), text.alias("_text"),
    )


def blocks(rows: DataFrame) -> DataFrame:
    """(block, packed): `rows` in compressed blocks of about BLOCK bytes of text, stored, so that all passes see the same blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9), use_threads=False)
        block, out, size = TaskContext.get().partitionId() << 20, None, 0
        for batch in slices(batches, "_text", min(BLOCK, 8 << 20)):
            if out is None:
                sink = pa.BufferOutputStream()
                out = pa.ipc.new_stream(sink, batch.schema, options=options)
            out.write_batch(batch)  # compressed at once, so that no more than a slice of plain text is held; larger slices compress better
            size += (pa.compute.sum(pa.compute.binary_length(batch.column("_text"))).as_py() or 0) + 64 * batch.num_rows
            if size >= BLOCK:
                out.close()
                yield packed(block, sink)
                block, out, size = block + 1, None, 0
        if out is not None:
            out.close()
            yield packed(block, sink)

    def packed(block: int, sink: pa.BufferOutputStream) -> pa.RecordBatch:
        value = sink.getvalue()
        ends = pa.array([0, value.size], pa.int32()).buffers()[1]
        whole = pa.Array.from_buffers(pa.binary(), 1, [None, ends, value])  # pa.array() of a memoryview never lets go of its buffer
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), whole], names=["block", "packed"])

    return stored(rows.mapInArrow(run, "block long, packed binary"), "blocks")


def _opened(packed: pa.Scalar, most_bytes: int) -> Iterator[pa.RecordBatch]:
    return slices(iter(pa.ipc.open_stream(packed.as_buffer(), options=pa.ipc.IpcReadOptions(use_threads=False))), "_text", most_bytes)


def _begins(found: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, found[1:] != found[:-1]])


def count_runs(packed: DataFrame, most_runs: int = 1 << 19) -> DataFrame:
    """(_lang, run, n, lo, hi): how often each run was seen in each language, and two numbers that are equal where one row only
    holds it, namely that row's. A block sends a run once, up to `most_runs` of them, and each task once more sums them before
    the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for block, value in zip(whole.column(0).to_pylist(), whole.column(1)):
                yield from count(block, value)

    def count(block: int, value: pa.Scalar) -> Iterator[pa.RecordBatch]:
        row, held, names = block << 19, [], []  # a block has fewer rows
        for batch in _opened(value, SLICE):
            places, langs, parts = _texts(batch)
            if places:
                names += set(langs) - set(names)
                windows, keys = _runs(langs, parts)
                owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
                spoken = np.array([names.index(x) for x in langs], np.int32)
                order = np.argsort(keys, kind="stable")
                begins = _begins(keys[order])
                first, last = (owner[order[x]].astype(np.int64) for x in (begins, np.r_[begins[1:], len(order)] - 1))
                shared = first != last  # in which rows doesn't matter then, and equal numbers compress
                n = np.diff(np.r_[begins, len(order)])
                at = order[begins]
                held.append((keys[at], windows[:, at], spoken[first], n, np.where(shared, -1, row + first), np.where(shared, LAST_ROW, row + last)))
                if sum(len(x[0]) for x in held[1:]) >= min(most_runs, max(len(held[0][0]), 1 << 16)):  # so held follows distinct runs
                    held = [merged(held)]
                    if len(held[0][0]) >= most_runs:
                        yield sent(held.pop(), names)
            row += batch.num_rows
        if held:
            yield sent(merged(held), names)

    def merged(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        keys, windows, spoken, n, lo, hi = (np.concatenate(x, axis=-1) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        begins = _begins(keys[order])
        at = order[begins]
        lo, hi = np.minimum.reduceat(lo[order], begins), np.maximum.reduceat(hi[order], begins)
        shared = lo != hi
        return keys[at], windows[:, at], spoken[at], np.add.reduceat(n[order], begins), np.where(shared, -1, lo), np.where(shared, LAST_ROW, hi)

    def sent(found: tuple[np.ndarray, ...], names: list[str]) -> pa.RecordBatch:
        _, windows, spoken, *numbers = found
        runs = np.ascontiguousarray(windows.T).view(f"<U{ORDER}").ravel().tolist()
        own = pa.array(np.array(names, object)[spoken], pa.string())
        return pa.RecordBatch.from_arrays([own, pa.array(runs, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], names=["_lang", "run", "n", "lo", "hi"])

    found = packed.mapInArrow(run, "_lang string, run string, n long, lo long, hi long")
    return found.groupBy("_lang", "run").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _discounts(level: DataFrame, n: int) -> DataFrame:
    """For each language the modified Kneser-Ney discounts of counts 1, 2 and 3 or more, and the number of runs."""
    c = [F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]
    found = level.groupBy("_lang").agg(*(x.alias(f"c{k}") for k, x in enumerate(c, 1)), F.count("*").alias("size"))
    y = F.when(F.col("c1") > 0, F.col("c1") / (F.col("c1") + 2 * F.col("c2"))).otherwise(0.5)
    cut = [F.when(F.col(f"c{k}") > 0, k - (k + 1) * y * F.col(f"c{k + 1}") / F.greatest(f"c{k}", F.lit(1))).otherwise(0.5 * k) for k in (1, 2, 3)]
    return found.select("_lang", F.lit(n).alias("order"), "size", *(F.least(F.greatest(x, F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}") for k, x in enumerate(cut, 1)))


def kneser_ney(counted: DataFrame) -> DataFrame:
    """(_lang, run, chance, score) of the runs counted by `count_runs`.

    chance: of the last symbol after the others, interpolated over all orders. score: the log chance as rows that hold the run
    see it: where no other row holds it, the back-off weight and the score of the run without its first symbol.
    """
    levels = {ORDER: counted}
    for n in range(ORDER - 1, 0, -1):  # in how many different contexts a shorter run was seen
        shorter = levels[n + 1].groupBy("_lang", F.substring("run", 2, n).alias("run"))
        levels[n] = stored(shorter.agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), f"runs_of_{n}")
    cuts = _discounts(levels[1], 1)
    for n in range(2, ORDER + 1):
        cuts = cuts.unionByName(_discounts(levels[n], n))
    cuts = stored(cuts, "discounts")  # a row for each language and order
    lower = cuts.where("order = 1").select("_lang", F.lit("").alias("rest"), (1 / (F.col("size") + 1)).alias("p"))
    lower = lower.withColumn("s", F.log("p"))
    for n in range(1, ORDER + 1):
        count = F.col("n")
        followers = Window.partitionBy("_lang", F.substring("run", 1, n - 1))  # at most one row for each symbol
        kinds = [F.sum(when.cast("int")).over(followers).alias(f"k{k}") for k, when in enumerate((count == 1, count == 2, count >= 3), 1)]
        found = levels[n].select(
            "_lang", F.substring("run", 1, 1).alias("first"), F.substring("run", 2, n - 1).alias("rest"), "n",
            F.sum("n").over(followers).alias("total"), *kinds, (F.col("lo") != F.col("hi")).alias("shared"),
        )
        found = found.join(lower, ["_lang", "rest"]).join(cuts.where(F.col("order") == n), "_lang")
        cut = F.when(count == 1, F.col("d1")).when(count == 2, F.col("d2")).otherwise(F.col("d3"))
        weight = (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total")
        chance = (count - cut) / F.col("total") + weight * F.col("p")
        score = F.when(F.col("shared"), F.log(chance)).otherwise(F.log(weight) + F.col("s"))
        lower = found.select("_lang", F.concat("first", "rest").alias("rest"), chance.alias("p"), score.alias("s"))
    return lower.select("_lang", F.col("rest").alias("run"), F.col("p").alias("chance"), F.col("s").alias("score"))


def fit(packed: DataFrame) -> DataFrame:
    """(key, score): the model of all rows of `blocks`, stored in ranges of sorted hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                langs, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                windows = np.array(names, f"<U{ORDER}").view("<u4").reshape(-1, ORDER).T
                seeds = {lang: np.uint64(_seed(lang)) for lang in set(langs)}
                keys = hashes(windows, np.array([seeds[x] for x in langs], np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(2)], names=["key", "score"])

    model = kneser_ney(stored(count_runs(packed), "runs")).select("_lang", "run", F.col("score").cast("float").alias("score"))
    model = stored(model.mapInArrow(run, "key long, score float"), "unsorted")
    return stored(model.repartitionByRange("key").sortWithinPartitions("key"), "model", instead_of=model)


def answers(found: DataFrame, most_rows: int = 1 << 19) -> DataFrame:
    """(block, keys, scores): the rows (block, key, score) as arrays, of 8 and 4 bytes a number, one pair for each block and
    `most_rows` rows of a task: as rows they take over twice the bytes in the shuffle by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= most_rows:
                yield dealt(held)
                held, rows = [], 0
        if rows:
            yield dealt(held)

    def dealt(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, keys, scores = (np.concatenate([batch.column(k).to_numpy(zero_copy_only=False) for batch in held]) for k in range(3))
        order = np.argsort(block, kind="stable")
        block, keys, scores = block[order], keys[order], scores[order]
        begins = _begins(block)
        ends = np.r_[begins[1:], len(block)]
        columns = [pa.array([x[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary()) for x in (keys, scores)]
        return pa.RecordBatch.from_arrays([pa.array(block[begins]), *columns], names=["block", "keys", "scores"])

    return found.mapInArrow(run, "block long, keys binary, scores binary")


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCORED = f"{FIGURES}, cost double, letters long"


def scored(packed: DataFrame, model: DataFrame) -> DataFrame:
    """(_id, doc_id, _t1, _t2, _lang, word statistics, cost, letters) of each row of the `blocks` that `model` was fit on; cost:
    the sum of the negative scores of all runs, null without text; letters: letters and digits in them."""
    names = ["_id", "doc_id", "_t1", "_t2", "_lang"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for block, value in zip(whole.column(0).to_pylist(), whole.column(1)):
                held, fresh = np.zeros(0, np.uint64), []
                for batch in _opened(value, SLICE):
                    places, langs, parts = _texts(batch)
                    if places:
                        fresh.append(np.unique(_runs(langs, parts)[1]))
                        if sum(map(len, fresh)) > max(1 << 20, len(held)):
                            held, fresh = np.unique(np.concatenate([held, *fresh])), []
                held = np.unique(np.concatenate([held, *fresh]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), block)), pa.array(held.view(np.int64))], names=["block", "key"])

    def score(whole: pa.Table, part: pa.Table) -> pa.Table:
        keys, scores = (np.frombuffer(b"".join(part.column(c).to_pylist()), kind) for c, kind in (("keys", np.uint64), ("scores", np.float32)))
        order = np.argsort(keys)
        keys, scores, out = keys[order], scores[order].astype(np.float64), []
        for value in whole.column("packed"):
            for batch in _opened(value, SLICE):
                figures = list(zip(*(base_figures(t) for t in batch.column("_text").to_pylist())))
                cost: list[float | None] = [None] * batch.num_rows
                letters = [0] * batch.num_rows
                places, langs, parts = _texts(batch)
                if places:
                    wanted = _runs(langs, parts)[1]
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    if (keys[at] != wanted).any():
                        raise ValueError("the model is of other rows")
                    sums = np.add.reduceat(scores[at], np.cumsum([0, *map(len, parts)])[:-1])
                    for i, total, text in zip(places, sums, parts):
                        cost[i], letters[i] = -float(total), _letters(text)
                columns = [*(batch.column(c) for c in names), *(pa.array(f, pa.int64()) for f in figures), pa.array(cost, pa.float64()), pa.array(letters, pa.int64())]
                out.append(pa.RecordBatch.from_arrays(columns, names=[*names, *(c.split(" ")[0] for c in SCORED.split(", "))]))
        return pa.Table.from_batches(out)

    asked = packed.mapInArrow(ask, "block long, key long")
    parts = answers(asked.join(model, "key").select("block", "key", "score"))
    return packed.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(score, f"_id long, doc_id long, _t1 long, _t2 long, _lang string, {SCORED}")


def _letters(found: np.ndarray) -> int:
    """How many of the symbols are letters or digits; beyond ASCII all but blanks count."""
    return int(((found > 127) | (found - 97 < 26) | (found == 48)).sum())


def with_bands(found: DataFrame, width: float, least: float) -> DataFrame:
    """`found` with low and high, its language's accepted log perplexities: the median, and on each side `width` standard
    deviations (at least `least`), as the quartile there tells them for a normal distribution: far values, junk too, don't
    widen it. From a histogram of the rows that are not base_failed, in steps of a thousandth; other languages have no band."""
    steps = found.where("NOT base_failed AND log_perplexity IS NOT NULL").groupBy("_lang", F.floor(F.col("log_perplexity") * 1000).alias("step")).count()
    upto = steps.withColumns({"upto": F.sum("count").over(Window.partitionBy("_lang").orderBy("step")), "all": F.sum("count").over(Window.partitionBy("_lang"))})
    quartile = [((F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("step"))) + 0.5) / 1000).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75), 1)]
    side = lambda far: F.greatest(F.lit(least), width / QUARTILE * far)
    ends = upto.groupBy("_lang").agg(*quartile).select(
        "_lang", (F.col("q2") - side(F.col("q2") - F.col("q1"))).alias("low"), (F.col("q2") + side(F.col("q3") - F.col("q2"))).alias("high")
    )
    return found.join(stored(ends, "bands"), "_lang", "left")


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = 5.0, least: float = 0.1) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    log_perplexity, with the keys _id, _t1, _t2 of `common`.

    Words are [^\\x20\\x09-\\x0D]+. word_chars: code points in words; n_symbols: characters of #*$%&|<>; n_dup_lines: lines
    (between line feeds) with a word, equal to an earlier line; n_repeat_words: words in windows of three found twice or more.
    base_failed: under 50 words, or over half of them repeated. log_perplexity: the cost of all characters for each letter or
    digit, so signs add cost but no length. kept: not base_failed, and the log perplexity lies in the band of the row's language,
    taken from the rows that are not base_failed. Null and empty texts have no words and fail. Each language has its own model;
    rows without a language are one. Repeated rows are judged alike, each vouching for the others. Very long texts are rows of
    their own blocks. Tables without rows give none.
    """
    packed = blocks(_rows(docs, id_col, text_col, lang_col))
    found = stored(scored(packed, fit(packed)), "quality", instead_of=packed).withColumn("log_perplexity", F.col("cost") / F.greatest("letters", F.lit(1)))
    found = found.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return with_bands(found, width, least).withColumn("kept", ~F.col("base_failed") & inside).drop("low", "high", "cost", "letters")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` that `quality_verdicts` keeps, with all their columns, whatever their names."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = quality_verdicts(docs, id_col, text_col, lang_col).where("kept").select("_id", "_t1", "_t2")
    keyed = docs.select(order_id(F.col(id_col)).alias("_id"), *content_keys(text, ("_t1", "_t2")), F.struct(*docs.columns).alias("_row"))
    return keyed.join(kept, ["_id", "_t1", "_t2"], "left_semi").select("_row.*")
