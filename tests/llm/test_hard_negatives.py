"""Hard negatives against brute force over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hard_negatives as module
from ledgerloom.llm.hard_negatives import Anchors, Best, hard_negatives, inner_products, one_bit_codes
from ledgerloom.llm.queries import QUERIES, SQL
from tests.compare import connect, differences

SCHEMA = "vec_id long, embedding array<float>, label int, row string, ints string, kind string"


def brute_force(rows, every, scale=256, positives=5, negatives=10, low=30, high=90):
    """Each row (id, vector, label) is a row of its own."""
    used = [
        (i, [math.floor(scale * float(np.float32(x))) for x in v], label)
        for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for k, (anchor, a, own) in enumerate(used):
        if anchor % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), i, label) for j, (i, b, label) in enumerate(used) if j != k and len(b) == len(a)]
        for ps, positive, _ in sorted(s[:2] + (0,) for s in scored if s[2] == own)[:positives]:
            fits = sorted((s, i) for s, i, label in scored if label != own and low * -ps <= 100 * -s <= high * -ps)
            out += [(anchor, positive, rank + 1, i, -ps, -s) for rank, (s, i) in enumerate(fits[:negatives])]
    return sorted(out)


def found(spark, rows, every, partitions=3, **options):
    frame = spark.createDataFrame([(i, v, label, "clash", "clash", "clash") for i, v, label in rows], SCHEMA).repartition(partitions)
    return sorted(map(tuple, hard_negatives(frame, F.col("vec_id") % every == 0, **options).collect()))


@pytest.mark.parametrize("dims", [1, 3, 64, 70, 130])
@pytest.mark.parametrize("levels", [1, 4])
def test_bounds_hold(dims, levels):
    rng = np.random.default_rng(dims)
    a = np.rint(rng.normal(size=(40, dims)) * 256)
    b = np.concatenate([np.rint(rng.normal(size=(300, dims)) * 256), a, -a, np.zeros((1, dims)), np.full((1, dims), 999.0)])
    low, high = Anchors(a).bounds(slice(0, 40), *one_bit_codes(b, levels))
    assert (low <= a @ b.T).all() and (a @ b.T <= high).all()


def test_more_levels_leave_less_to_score():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 64)), rng.normal(size=(2000, 64))
    a, b = np.rint(256 * a / np.linalg.norm(a, axis=1, keepdims=True)), np.rint(256 * b / np.linalg.norm(b, axis=1, keepdims=True))
    tenth = np.sort(a @ b.T, axis=1)[:, -10, None]
    scored = [(Anchors(a).bounds(slice(0, 20), *one_bit_codes(b, levels))[1] >= tenth).mean() for levels in (1, 2, 4)]
    assert scored[0] > scored[1] > scored[2] and scored[2] < 0.15


def test_best_keeps_order_and_ties():
    rng = np.random.default_rng(2)
    best, seen = Best(6, 4), []
    for _ in range(30):
        n = int(rng.integers(0, 20))
        slot, score, number = rng.integers(0, 5, n), rng.integers(-3, 3, n), rng.permutation(1000)[:n]
        best.add(slot, score, number)
        seen += zip(slot, -score, number)
    for s in range(6):
        wanted = sorted((score, number) for slot, score, number in seen if slot == s)[:4]
        assert [(-score, number) for score, number in zip(best.scores[s], best.ids[s]) if number != module.NO_ID] == wanted


def test_inner_products_beyond_floats():
    a = np.array([[2**31 - 1, 2**31 - 1], [3, 4]])
    assert inner_products(a, a).tolist() == [2 * (2**31 - 1) ** 2, 25]
    big = np.full((1, 4), 2**31 - 1)
    with pytest.raises(OverflowError):
        inner_products(big, big)


@pytest.mark.parametrize("seed", range(3))
def test_random_rows(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, 8))
    rows = [(i, (centres[i % 3] + 0.7 * rng.normal(size=8)).tolist(), int(rng.integers(0, 3)) if i % 4 else 7) for i in range(200)]  # 7: a hot label
    wanted = brute_force(rows, 10)
    assert len(wanted) > 100 and found(spark, rows, 10) == wanted
    assert found(spark, rows, 10, partitions=11, levels=1, most_rows=37, most_anchors=6) == wanted


def test_blocks(spark, monkeypatch):
    """Several blocks of rows and of anchors, as on large tables."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=5).tolist(), i % 2) for i in range(9000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, hard_negatives(frame, F.col("vec_id") % 900 == 0, most_anchors=3).collect()))
    assert got == brute_force(rows, 900)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.2, 0.9], 1), (10, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.25], 2), (3, [0.5, 0.25], 3), (3, [0.5, 0.25], 3),
        (4, None, 1), (5, [1.0, None], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 2), (8, [-inf, 1.0], 2), (9, [0.6, 0.3], None), (None, [1.0, 0.5], 1),
        (20, [1.0], 1), (21, [1.0], 1), (22, [0.5], 2), (30, [], 1), (31, [], 1), (32, [], 2), (40, [0.0, 0.0], 5), (41, [0.0, 0.0], 5), (50, [-1.0, -1.0], 9),
        (51, [1.0, 1.0], 9), (60, [0.3], 77), (-10, [0.9, 0.4], 1), (-3, [0.45, 0.3], -2),
    ]
    wanted = brute_force(rows, 10)
    assert len(wanted) > 20 and found(spark, rows, 10) == wanted
    assert found(spark, [], 10) == [] and found(spark, rows, 1000, low=91) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 1)], 10) == []


def test_very_long_vectors_and_large_numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5000) + 0.2).tolist(), i % 2) for i in range(12)] + [(100 + i, [float(2**22), 1.0 + i], i % 2) for i in range(6)]
    assert found(spark, rows, 4) == brute_force(rows, 4)
    with pytest.raises(Exception, match="32 bits"):
        found(spark, [(1, [1e9], 1)], 1)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_statement(spark, folder):
    path = f"/root/testdata/{folder}"
    assert not differences(QUERIES["op12_hard_negatives"](spark, path), connect(path), SQL["op12_hard_negatives"])
