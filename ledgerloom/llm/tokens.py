"""Token ids of a byte-level BPE vocabulary, as the `tokenizers` library gives them, at the speed of a word cache."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

#: The published splitting pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space across which a text can't be cut at single blanks.
_AWKWARD = re.compile(r"[^\S\n ]|[ \n] | \n")
#: All white space but the blank and the line feed, as Python's \s has it (fixed value).
_OTHER_BLANK = "[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _byte_characters() -> dict[str, int]:
    """The published way of writing bytes as characters: visible ones as themselves, the others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class _Ids(dict):
    """Ids, as little-endian unsigned 32-bit numbers, of a blank and a word."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(" " + word)).tobytes()
        if len(word) <= 40:
            self[word] = ids
        return ids


class ByteBpe:
    """Ids of whole texts. Added tokens of the file, as <|endoftext|>, are found in a text first, as the library does."""

    def __init__(self, path: str, most_words: int = 100_000):
        """path: a tokenizer file of the `tokenizers` library. most_words: bound of the cache."""
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocabulary, added = held["model"]["vocab"], held.get("added_tokens") or []
        if odd := [t["content"] for t in added if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]:
            raise ValueError(f"added tokens that take in or ask for their surroundings are not supported: {odd}")
        self._added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        longest = sorted(self._added, key=len, reverse=True)
        self._cuts = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        plain = _byte_characters()
        ranks = {bytes(plain[c] for c in piece): i for piece, i in vocabulary.items() if all(c in plain for c in piece)}
        self._encode = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=_only_merged(ranks), special_tokens={}).encode_ordinary
        self._words, self._most = _Ids(self._encode), most_words
        self._opens = np.zeros(max(ranks.values(), default=0) + 1, bool)  # ids of pieces that begin with a blank
        self._opens[[i for piece, i in ranks.items() if piece.startswith(b" ")]] = True

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self._cuts and self._cuts.search(text):  # each part is a text of its own
            return b"".join(self._added[part] if i % 2 else self._plain(part) for i, part in enumerate(self._cuts.split(text)))
        return self._plain(text)

    def batch(self, texts: pa.Array) -> list[bytes]:
        """`ids` of each text (null: of the empty one). Words are looked up once for all texts of the batch.

        Texts that hold an added token, or white space across which words can't be told apart by single blanks, go one by one.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return []
        parts = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(parts.flatten())
        number = coded.indices.to_numpy(zero_copy_only=False)
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        ends = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()  # every text has one part at least
        begins = np.r_[0, ends[:-1]]
        first, last = np.zeros(len(number), bool), np.zeros(len(number), bool)
        first[begins], last[ends - 1] = True, True

        def words_that(kernel, *args) -> np.ndarray:
            return kernel(coded.dictionary, *args).to_numpy(zero_copy_only=False)

        opens, closes = words_that(pc.starts_with, "\n"), words_that(pc.ends_with, "\n")
        empty, blank = words_that(pc.equal, ""), words_that(pc.match_substring_regex, _OTHER_BLANK)
        slow = blank[number] | (empty[number] & ~first & ~last) | (opens[number] & ~first) | (closes[number] & ~last)
        slow = np.logical_or.reduceat(slow, begins)
        for token in self._added:
            slow |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)

        found = self._each(words, opens | closes | empty | blank)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begin = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        n = np.where(first, 0, size[number])  # a text's first word has no blank before it
        stop = np.cumsum(n)
        ids = flat[np.repeat(begin[number] - (stop - n), n) + np.arange(stop[-1])].tobytes()
        edges = [0, *(4 * stop[ends - 1]).tolist()]
        heads = [words[k] for k in number[first].tolist()]
        whole = []
        for i, one_by_one in enumerate(slow.tolist()):
            if one_by_one:
                whole.append(self.ids(texts[i].as_py()))
            else:
                head = array("I", self._encode(heads[i])).tobytes()
                whole.append(head + ids[edges[i] : edges[i + 1]])
        return whole

    def _each(self, words: np.ndarray, alone: np.ndarray) -> list[bytes]:
        """The ids of a blank and each word. New words are encoded in one text; those `alone` hold white space or nothing."""
        held = self._words
        found = list(map(held.get, words))
        new = np.fromiter((x is None for x in found), bool, len(found))
        for k in np.flatnonzero(new & alone).tolist():
            found[k] = held[words[k]]
        new = np.flatnonzero(new & ~alone)
        if len(new):
            ids = np.array(self._encode(" " + " ".join(words[new])), "<u4")
            edges = [*(4 * np.flatnonzero(self._opens[ids])).tolist(), 4 * len(ids)]  # a word's first id holds its blank
            ids = ids.tobytes()
            for k, a, b in zip(new.tolist(), edges, edges[1:]):
                found[k] = ids[a:b]
            room = self._most - len(held)
            held.update((words[k], found[k]) for k in new[:max(room, 0)].tolist() if len(words[k]) <= 40)
        return found

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _AWKWARD.search(text):
            return np.array(self._encode(text), "<u4").tobytes()
        # At a single blank before a word the pattern always cuts, so words can be looked up one by one.
        first, *rest = text.split(" ")
        if len(self._words) > self._most:
            self._words.clear()
        head = np.array(self._encode(first), "<u4").tobytes() if first else b""
        return head + b"".join(map(self._words.__getitem__, rest))


def _only_merged(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Without the special tokens, which stand behind the merged pieces."""
    return {piece: i for piece, i in ranks.items() if i < len(ranks) and not (piece.startswith(b"<|") and piece.endswith(b"|>"))}


@lru_cache(maxsize=1)
def byte_bpe(path: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(path)
