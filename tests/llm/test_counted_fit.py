"""Packing planned over length counts, against plain best fit decreasing over documents."""

import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm.counted_fit import pack_by_lengths, plan_by_lengths
from ledgerloom.llm.queries import QUERIES
from ledgerloom.llm.tokens import byte_bpe
from tests.llm.test_operators import LONG, TEXTS, docs, empty  # noqa: F401

BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(lengths, size):
    """Windows as lists of lengths, each piece put into the fullest window that holds it."""
    windows = []
    for n in sorted(lengths, reverse=True):
        fitting = [w for w in windows if sum(w) + n <= size]
        if fitting:
            max(fitting, key=sum).append(n)
        else:
            windows.append([n])
    return windows


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_a_plain_best_fit(seed):
    rng = random.Random(seed)
    size = rng.choice([1, 7, 30, 64])
    lengths = [rng.choice([rng.randint(1, size), rng.randint(1, max(1, size // 4)), size]) for _ in range(rng.choice([0, 1, 20, 300]))]
    counts = Counter(lengths)
    windows, ranks = defaultdict(list), defaultdict(set)
    for length, begin, stop, first, each, at in plan_by_lengths(counts, size):
        for rank in range(begin, stop):
            ranks[length].add(rank)
            windows[first + (rank - begin) // each].append((at + (rank - begin) % each * length, length))
    assert {n: set(range(k)) for n, k in counts.items()} == ranks
    for pieces in windows.values():  # gapless from 0
        pieces.sort()
        assert [at for at, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
    # Which of equally full windows takes a piece is free, how full the windows get is not.
    assert sorted(sum(n for _, n in w) for w in windows.values()) == sorted(map(sum, plain_best_fit(lengths, size)))


def test_plan_follows_sizes_not_counts():
    small = plan_by_lengths({n: 7 for n in range(1, 1025)}, 1024)
    large = plan_by_lengths({n: 7_000_000_000 + n for n in range(1, 1025)}, 1024)
    assert len(large) < 20 * 1024 and len(small) < 20 * 1024


def held(rows, size, end_id, texts):
    """Checks pieces against the library's ids; gives the sequences' lengths."""
    library = Tokenizer.from_file(BPE)
    wanted = Counter()
    for doc, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        over = len(ids) % size
        edges = [0, *range(over or size, len(ids) + 1, size)]
        edges = edges if edges[-1] == len(ids) else [*edges, len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            part = b"".join(i.to_bytes(4, "little") for i in ids[a:b])
            wanted[doc, k, a, b - a, zlib.crc32(part), len(ids)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == wanted
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [at for at, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
    return [sum(n for _, n in pieces) for pieces in sequences.values()]


@pytest.mark.parametrize("size", [8, 64, 1024])
def test_packing(docs, empty, size):  # noqa: F811
    found = pack_by_lengths(docs, BPE, size=size)
    rows = found.collect()
    fill = held(rows, size, 2, TEXTS)
    assert max(fill) <= size and len(fill) == len(plain_best_fit([r.length for r in rows], size))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert pack_by_lengths(empty, BPE).count() == 0 and pack_by_lengths(empty, BPE).columns == found.columns


def test_repeated_rows_and_one_hot_length(spark):
    texts = [(7, "the same words")] * 500 + [(8, LONG), (8, LONG), (None, None), (None, None)]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "doc_id long, text string, sequence_id string, task int").repartition(7)
    fill = held(pack_by_lengths(frame, BPE).collect(), 1024, 2, texts)
    assert len(fill) == -(-sum(fill) // 1024)


def test_query(spark, folder):
    rows = QUERIES["op13_best_fit_packing"](spark, folder).collect()
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    fill = held(rows, 1024, 2, texts)
    assert max(fill) <= 1024 and len(fill) <= 1.01 * -(-sum(fill) // 1024)


def test_ids_of_a_batch_are_those_of_the_library():
    library = Tokenizer.from_file(BPE)
    odd = [
        None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "\n", "\n\n", "a\n\nb", "\n a", " \n", "a\tb c", "x<|endoftext|>", "a <|endoftext|> b", "<|endoftext|", "q w e",
        "q   w", "it's they'll  don't", "\r\n a", "123 4567", "trail \n", "a\x1cb c", "a　 b", "é è 漢字 🙂 Привет", "w" * 500 + " x", *[t for _, t in TEXTS],
    ]
    for bound in (300_000, 3, 0):
        bpe = type(byte_bpe(BPE))(BPE, most_words=bound)
        for texts in (odd, odd[::-1], odd[:1]):
            found = bpe.batch(pa.array(texts, pa.string()))
            assert found == [b"".join(i.to_bytes(4, "little") for i in library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert byte_bpe(BPE).batch(pa.array([], pa.string())) == []
