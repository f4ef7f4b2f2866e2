"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items, each text scanned once.

A word is [0-9a-z] or anything beyond ASCII, after lower-casing A-Z. Normalised texts are their words between single blanks,
so a window of words is a substring with a blank at both ends. Matches carry their place in the normalised text; they are
mapped to words, and by the words to characters of the original.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from ledgerloom.llm.common import slices

#: ASCII characters that are no part of a word become blanks, A-Z become a-z; bytes of longer characters stay.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The normalised words, as UTF-8."""
    return [w for w in text.encode().translate(_FOLD).split(b" ") if w] if text else []


def normalised(text: str | None) -> str:
    """Words between single blanks, a blank at both ends; one character for each byte. Empty without words."""
    found = b" ".join(words_of(text))
    return f" {found.decode('latin-1')} " if found else ""


def windows(text: str | None, size: int) -> set[str]:
    found = [w.decode("latin-1") for w in words_of(text)]
    if not found:
        return set()
    return {f" {' '.join(found[i : i + size])} " for i in range(max(1, len(found) - size + 1))}


def item_blocks(items: DataFrame, id_col: str, text_col: str, size: int, most: int) -> Iterator[dict[str, list[str]]]:
    """The windows of the items with the ids of their items, in blocks of about `most` characters.

    Items come to the driver one partition at a time and are cut into blocks, so that what is broadcast has a bound
    whatever the size of the table. A benchmark of up to `most` characters is one block, and one automaton.
    """
    block, held = defaultdict(list), 0
    for row in items.select(id_col, text_col).toLocalIterator():
        for window in windows(row[1], size):
            block[window].append(str(row[0]))
            held += len(window)
            if held >= most:
                yield dict(block)
                block, held = defaultdict(list), 0
    if block:
        yield dict(block)


def build(block: dict[str, list[str]]) -> ahocorasick.Automaton:
    """Each window with its number of words and its items."""
    found = ahocorasick.Automaton()
    for window, ids in block.items():
        found.add_word(window, (window.count(" ") - 1, ids))
    found.make_automaton()
    return found


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def scan(text: str | None, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit runs of word numbers [from, to) in order, ids of the items that occur."""
    plain = normalised(text)
    n_words = plain.count(" ") - 1 if plain else 0
    runs: list[tuple[int, int]] = []
    ids: set[str] = set()
    word = at = 0
    for end, (length, items) in automaton.iter(plain) if n_words else ():
        word += plain.count(" ", at, end)  # blanks before the match's last: the number of its last word
        at = end
        runs.append((word - length, word))
        ids.update(items)
    return n_words, _merge(runs), ids


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of words as [from, to) in characters of the original text."""
    ends, spans, inside, begins = [], [], False, []
    for i, c in enumerate(text):
        word = ord(c) >= 128 or c.isalnum()
        if word and not inside:
            begins.append(i)
        if inside and not word:
            ends.append(i)
        inside = word
    if inside:
        ends.append(len(text))
    for start, end in runs:
        spans.append((begins[start], ends[end - 1]))
    return spans


FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
FOUND_DDL = "n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start: bigint, end: bigint>>"


def with_hits(
    docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text: str = "text", size: int = 10,
    most: int = 64 << 20, out: str = "contamination",
) -> DataFrame:
    """All rows and columns of `docs`, with the struct column `out` added (in place of one of that name).

    out.n_words: words of the text; out.n_hit: words inside any occurrence of a window (`size` consecutive words of an item,
    or all words of a shorter one); out.item_ids: items with an occurring window, sorted as strings; out.spans: hit runs
    in characters of the original text. Null and empty texts have no words and no hits; items without words have no window;
    a null item_id is the id "None"; repeated items count once by id. Nothing is dropped: rows are as many as in `docs`.
    """
    docs = docs.drop(*([out] if out != text_col else []))
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(b) for b in item_blocks(items, id_col, item_text, size, most)]
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [build(b.value) for b in shared]
        for batch in slices(batches, text_col):
            rows = []
            for text in batch.column(place).to_pylist():
                n_words, runs, ids = 0, [], set()
                for automaton in automata:
                    n_words, more, found = scan(text, automaton)
                    runs, ids = runs + more, ids | found
                if not automata:
                    n_words = len(words_of(text))
                if len(automata) > 1:
                    runs = _merge(runs)
                spans = [{"start": a, "end": b} for a, b in char_spans(text, runs)] if runs else []
                rows.append({"n_words": n_words, "n_hit": sum(b - a for a, b in runs), "item_ids": sorted(ids), "spans": spans})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, FOUND)], names=[*batch.schema.names, out])

    schema = StructType([*docs.schema.fields, StructField(out, StructType.fromDDL(FOUND_DDL))])
    return docs.mapInArrow(run, schema)
