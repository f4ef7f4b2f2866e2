"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text and normalised by length.

Folding undoes homoglyphs (Cyrillic, Greek and full-width lookalikes), zero-width characters and digits put for letters.
The lexicon (words, and beginnings of words for families of forms) and its weights are learned from labelled texts.
Exception phrases cancel the lexicon words inside them.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerloom.llm.common import slices, stored

#: Letters of other scripts that look like Latin ones (fixed values).
_LOOKALIKES = dict(zip("абвеёзикмнорстухѕіјһԁԛԝɡαβεηικνορτυχω", "abbeezukmhopctyxsijhdqwgabenikvoptuxw"))
#: Digits and signs put for letters (fixed values).
_DIGITS = dict(zip("0134578@$!|€", "oieastbasile"))
_HIDDEN = "­​‌‍⁠﻿"
_FOLD = {ord(k): v for k, v in _LOOKALIKES.items()} | {ord(c): None for c in _HIDDEN}
_FOLD |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}
_NEEDS_FOLD = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
_PUT_FOR = re.compile(r"(?:(?<=[^\W\d_])|(?<![^\s]))[0134578@$!|€]+(?=[^\W\d_])")
_NO_WORD = re.compile(r"[\W_]+")
#: Common phrases in which a lexicon word is harmless. (A parameter; these are examples of the usual ones.)
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "sore loser", "pond scum", "stupid simple")
#: Lengths of word beginnings that can become lexicon entries.
STEMS = (4, 5, 6)


def folded(text: str | None) -> str:
    """Lower-case words between single blanks, a blank at both ends; empty without words."""
    if not text:
        return ""
    text = text.lower()
    if not text.isascii() and _NEEDS_FOLD.search(text):
        text = unicodedata.normalize("NFC", text.translate(_FOLD))
    text = _PUT_FOR.sub(lambda m: "".join(_DIGITS[c] for c in m[0]), text)
    text = _NO_WORD.sub(" ", text).strip(" ")
    return f" {text} " if text else ""


@dataclass
class Lexicon:
    """Entries: " word " or " beginning" in folded text, with weights. curve: intercept and two slopes of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)
    _automaton: ahocorasick.Automaton | None = field(default=None, repr=False)

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            found = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                found.add_word(entry, (len(entry), weight))
            for phrase in self.exceptions:
                if plain := folded(phrase):
                    found.add_word(plain, (len(plain), 0.0))
            if len(found):
                found.make_automaton()
            self._automaton = found
        return self._automaton

    def found(self, text: str | None) -> tuple[float, int, int]:
        """Sum of weights, number of matched words, number of words. A word counts by its heaviest entry."""
        plain = folded(text)
        automaton = self.automaton()
        if not plain or not len(automaton):
            return 0.0, 0, max(0, plain.count(" ") - 1)
        best: dict[int, float] = {}
        harmless: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(plain):
            start = end - length + 1
            if weight:
                best[start] = max(weight, best.get(start, 0.0))
            else:
                harmless.append((start, end))
        for start, end in harmless:
            for at in [at for at in best if start <= at < end]:
                del best[at]
        return sum(best.values()), len(best), plain.count(" ") - 1

    def features(self, text: str | None) -> tuple[float, float]:
        total, _, words = self.found(text)
        return math.log1p(total), math.log1p(1000.0 * total / (words + 20))

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.features(text)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _terms(text: str | None) -> set[str]:
    words = folded(text).split(" ")[1:-1]
    found = {f" {w} " for w in words}
    for n in STEMS:
        found |= {f" {w[:n]}" for w in words if len(w) > n}
    return found


def _near_key(text: str | None) -> int:
    """Smallest hash of the runs of four words: near copies mostly share it, other texts hardly ever."""
    words = folded(text).split(" ")[1:-1]
    return min((zlib.crc32(" ".join(words[i : i + 4]).encode()) for i in range(max(1, len(words) - 3))), default=0)


def _lower_bound(hits: int, total: int, z: float = 2.0) -> float:
    """Wilson's lower bound of a share."""
    p = hits / total
    middle = p + z * z / (2 * total)
    return (middle - z * math.sqrt(p * (1 - p) / total + z * z / (4 * total * total))) / (1 + z * z / total)


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; slopes are never negative."""
    full = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(full.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (p - y) + ridge * np.r_[0, w[1:]]
        bend = (full * (p * (1 - p))[:, None]).T @ full + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return float(w[0]), float(max(w[1], 0)), float(max(w[2], 0))


def learn(
    docs: DataFrame, labels: DataFrame, learned_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_rows: int = 20_000, most_entries: int = 20_000, least_weight: float = 2.0, exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """A lexicon from labelled rows for which `learned_from` (over the id) holds.

    The model is fitted on at most `most_rows` labelled rows, the first by a hash of the id (the documented bound; a lexicon
    needs no more), so their ids may be broadcast. Terms are counted once in each group of (near) copies.
    Word beginnings must be toxic in nine of ten texts, since they also match words that were never seen. A term's weight is the log-odds of Wilson's lower bound of its share of toxic texts, against the share of all texts.
    Null ids, labels and texts are passed over. Without labelled rows of both kinds the lexicon is empty, and all scores
    are the share of toxic rows (0 without rows).
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learned_from)
    chosen = chosen.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    texts = texts.join(F.broadcast(chosen), "_id")  # at most `most_rows` ids and labels

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = batch.column(1).to_pylist()
            near, found = [_near_key(t) for t in texts], [sorted(_terms(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int64()), pa.array(found, pa.list_(pa.string()))], names=["toxic", "near", "terms"])

    keyed = texts.select(F.col("_toxic").alias("toxic"), "_text")
    kept = stored(keyed.mapInArrow(terms, "toxic int, near long, terms array<string>"), "terms").dropDuplicates(["near", "toxic"])
    counted = kept.select("toxic", F.explode("terms").alias("term"))
    by_term = counted.groupBy("term").agg(F.sum("toxic").alias("hits"), F.count("*").alias("total"))
    size = kept.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("hits"), F.count("*").alias("total")).first()
    if not size["hits"] or size["hits"] == size["total"]:
        base = size["hits"] / max(1, size["total"])
        return Lexicon({}, exceptions, (math.log((base + 1e-6) / (1 - base + 1e-6)), 0.0, 0.0))
    base = size["hits"] / size["total"]
    odds = lambda p: math.log(p / (1 - p))
    rows = by_term.where("hits >= 3 AND 2 * hits > total AND (term LIKE '% ' OR 10 * hits >= 9 * total)").orderBy(F.desc("hits"), "total", "term").limit(most_entries).collect()
    weights = {r["term"]: odds(_lower_bound(r["hits"], r["total"])) - odds(base) for r in rows}
    lexicon = Lexicon({t: round(w, 6) for t, w in weights.items() if w >= least_weight}, tuple(exceptions))

    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            x = [shared.value.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64())], names=["toxic", "a", "b"])

    found = keyed.select("toxic", "_text").mapInArrow(features, "toxic int, a double, b double").groupBy("a", "b", "toxic").count()
    rows = np.array(sorted(map(tuple, found.collect())), float)  # at most `most_rows` rows; texts without a match are one
    fitted = np.repeat(rows[:, :3], rows[:, 3].astype(int), axis=0)
    lexicon.curve = tuple(round(x, 6) for x in _curve(fitted[:, :2], fitted[:, 2]))
    lexicon._automaton = None
    return lexicon


def with_score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", out: str = "score") -> DataFrame:
    """All rows and columns of `docs`, with the score from 0 to 1 in `out` (in place of a column of that name).

    Null and empty texts have no matches, which is a score as well. The whole text is matched, whatever its length.
    """
    docs = docs.drop(*([out] if out != text_col else []))
    place = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Lexicon(lexicon.weights, lexicon.exceptions, lexicon.curve))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            scores = pa.array([shared.value.score(t) for t in batch.column(place).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, DoubleType())]))
