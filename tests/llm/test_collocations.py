"""Collocations against counting every phrase in a dictionary."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from ledgerloom.llm import collocations as module
from ledgerloom.llm.collocations import blocks_of_words, collocations, tree_scan
from ledgerloom.llm.queries import QUERIES, SQL
from tests.compare import connect, differences

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "lang string, text string, n long, word string, hash string, doc_id long"


def brute_force(rows, longest=4, least=30, top=2000, covered=80):
    total, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    around[p[i : i + n]] = max(around[p[i : i + n]], a)
        kept = []
        for p, a in candidates.items():
            if p in around and 100 * around[p] >= covered * a:
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top]):
            out.append((lang, rank + 1, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found(spark, rows, partitions=3, **options):
    frame = spark.createDataFrame([(lang, text, 7, "clash", "clash", None) for lang, text in rows], SCHEMA).repartition(partitions)
    return sorted(map(tuple, collocations(frame, **options).collect()))


def random_rows(seed, words="a b c d the New New_York é Z"):
    rng = random.Random(seed)
    names = words.split()
    weights = [1 / (k + 1) for k in range(len(names))]
    text = lambda: "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ", ", "!"]) for w in rng.choices(names, weights, k=rng.randint(0, 60)))
    return [(rng.choice(["en", "en", "en", None, "de", ""]), text()) for _ in range(60)]


@pytest.mark.parametrize("longest, least, budget", [(4, 3, 1 << 16), (4, 3, 20), (4, 2, 1), (2, 3, 5), (3, 3, 10), (5, 3, 10)])
def test_random_texts(spark, longest, least, budget):
    rows = random_rows(longest * 100 + budget)
    wanted = brute_force(rows, longest, least)
    assert len(wanted) > 50
    assert found(spark, rows, longest=longest, least=least, least_budget=budget) == wanted
    assert found(spark, rows, longest=longest, least=least, least_budget=budget, top=7) == brute_force(rows, longest, least, 7)


def test_odd_texts(spark):
    rows = [("en", None), ("en", ""), (None, None), ("en", " \t \n.;"), ("xx", "alone"), ("en", "a" * 3000 + " b"), ("en", "x y" * 1), *[("fr", "x x x x x x")] * 40, *[(None, "New York\x0bNEW YORK\x0cnew\tyork")] * 20]
    assert found(spark, rows, least=5) == brute_force(rows, least=5)
    assert found(spark, []) == [] and found(spark, [("en", "a b")]) == []


def test_hot_passage_and_many_small_partitions(spark):
    rows = [("en", "one very common passage of words that many texts share")] * 300 + random_rows(3) * 2
    assert found(spark, rows, partitions=17, least=4, least_budget=30) == brute_force(rows, least=4)


def test_very_long_text(spark, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice(["ab", "c", "de", "f"]) + rng.choice([" ", " ", " ", ". "]) for _ in range(700_000))
    assert len(text) > 1 << 20
    blocks = list(blocks_of_words(text))
    assert len(blocks) > 1 and [w for b in blocks for w in b] == [*text.replace(".", " . ").encode().split(), b"."]
    assert found(spark, [("en", text)], partitions=1, least_budget=1 << 12) == brute_force([("en", text)])


def test_shared_hashes_take_another_seed(spark, monkeypatch):
    rows = random_rows(9)
    real = module.hash_of
    monkeypatch.setattr(module, "hash_of", lambda word, seed: 5 if seed == 0 and word in (b"a", b"the") else real(word, seed))
    words = module.counted_words(spark.createDataFrame(rows, "lang string, text string").na.fill("und"), 0)
    assert module._distinct(module.counted_words(spark.createDataFrame(rows, "lang string, text string").na.fill("und"), 1))
    clash = words.withColumn("hash", module.F.when(module.F.col("word").isin("a", "the"), 5).otherwise(module.F.col("hash")))
    assert not module._distinct(clash) and not module._distinct(words.withColumn("lang_id", module.F.lit(1)))


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_tree_scan_over_batches(size):
    rng = random.Random(size)
    rows = sorted({(rng.choice([1, 2]), 9, *w): rng.randint(1, 4) for w in [(rng.randint(1, 2), rng.randint(1, 2), rng.randint(1, 3), rng.randint(0, 3)) for _ in range(200)]}.items())
    totals = Counter()
    for (_, lang, a, b, c, d), n in rows:
        totals[lang, a, b, c, 0] += n
        if d:
            totals[lang, a, b, c, d] += n
    names = ["prefix", "lang_id", "w1", "w2", "w3", "w4", "n"]
    # One prefix length a prefix, as the layout has it.
    rows = [((1 if a == 1 else 2, lang, a, b, c, d), n) for (_, lang, a, b, c, d), n in rows]
    rows.sort()
    columns = list(zip(*[(*k, n) for k, n in rows]))
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + size], pa.int64()) for c in columns], names=names) for k in range(0, len(rows), size)]
    got = [tuple(r.values()) for b in tree_scan(iter(batches), 4, 5) for r in b.to_pylist()]
    assert sorted(got) == sorted((*k, n) for k, n in totals.items() if n >= 5)


@pytest.mark.parametrize("folder", ["sf0.01"])
def test_statement(spark, folder):
    path = f"/root/testdata/{folder}"
    assert not differences(QUERIES["op11_collocations"](spark, path), connect(path), SQL["op11_collocations"])
