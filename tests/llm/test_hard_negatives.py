"""Hard negatives against all products, ties, odd rows and chunks of anchors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, score string, anchor long, q int, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3, 4, "y") for r in rows], SCHEMA)


def brute(rows, every=10, positives=5, negatives=10, low=30, high=90, scale=256):
    kept = set()
    for key, label, x in rows:
        if key is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        own = tuple(int(max(-H.MOST, min(H.MOST, math.floor(scale * float(np.float32(v)))))) for v in x)
        kept.add((key, label, own))
    out = []
    for a in sorted(kept):
        if a[0] % every:
            continue
        score = lambda r: sum(p * q for p, q in zip(a[2], r[2]))  # noqa: B023, E731
        best = lambda found, k: sorted(found, key=lambda f: (-f[0], f[1]))[:k]
        same = best({(score(r), r[0]) for r in kept if r != a and r[1] == a[1]}, positives)
        others = {(score(r), r[0]) for r in kept if r[1] != a[1]}
        for s, key in same:
            for rank, (t, other) in enumerate(best({o for o in others if low * s <= 100 * o[0] <= high * s}, negatives), 1):
                out.append((a[0], key, rank, other, s, t))
    return sorted(out)


def mined(frame, **more):
    return sorted(tuple(r) for r in H.mine(frame, F.col("vec_id") % 10 == 0, **more).collect())


def test_equals_all_products(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(3), [rng.gauss(0, 0.4) for _ in range(6)]) for i in range(400)]
    # Few distinct values: many ties, at the ends of windows too.
    rows += [(400 + i, rng.randrange(2), [rng.choice([0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(200)]
    df = frame(spark, rows).repartition(5)
    want = brute(rows)
    assert len(want) > 200 and mined(df) == want
    assert mined(df, anchor_values=64) == want  # many chunks


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, -1.0]), (0, 1, [1.0, -1.0]), (1, 1, [0.9, -0.5]), (1, 1, [0.9, -0.5]), (2, 2, [0.6, -0.2]), (2, 2, [0.6, -0.2]),
        (3, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (4, 1, None), (5, 2, [None, 1.0]), (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]),
        (8, 2, [0.5]), (9, 2, [0.5, -0.5, 9.0]), (11, 2, []), (-10, 1, [0.0, 0.0]), (12, 2, [3e38, 3e38]), (10, 2, [0.1, 0.1, 0.1]),
    ]
    # A shorter vector's missing components are 0; what lies beyond the anchor's does not count.
    assert mined(frame(spark, rows)) == brute(rows)
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(1, 1, [1.0])])) == []
    assert mined(frame(spark, [(10, 1, [1.0])])) == []


def test_rows_that_share_a_key(spark):
    rows = [(0, 1, [1.0]), (0, 2, [0.5]), (1, 1, [0.9]), (1, 1, [0.8]), (2, 2, [0.7]), (2, 2, [0.7]), (3, 2, [0.6])]
    assert mined(frame(spark, rows)) == brute(rows)


def test_reading_stops_below_the_bound():
    values = np.arange(1, 4001, dtype=np.int32).reshape(-1, 1)
    lists = H.Lists(np.arange(4000), np.zeros(4000, np.int64), values)
    best = H.Best(5)
    depth = H.search(lists, np.array([2], np.int32), np.ones(4000, bool), [best])
    assert depth == H.FIRST_DEPTH and best.scores.tolist() == [8000, 7998, 7996, 7994, 7992]
    # A later block without better rows is not read at all.
    assert H.search(H.Lists(np.arange(9), np.zeros(9, np.int64), values[:9]), np.array([2], np.int32), np.ones(9, bool), [best]) == 0
    # Equal scores go on until the smaller id is certain.
    tied = H.Lists(np.arange(100)[::-1].copy(), np.zeros(100, np.int64), np.ones((100, 1), np.int32))
    best = H.Best(2)
    assert H.search(tied, np.array([1], np.int32), np.ones(100, bool), [best]) == 100 and best.keys.tolist() == [0, 1]


@pytest.mark.parametrize("largest", [10, H.MOST])
def test_scores_are_exact(largest):
    rng = np.random.default_rng(4)
    values = rng.integers(-largest, largest, (50, 64)).astype(np.int32)
    lists = H.Lists(np.arange(50), np.zeros(50, np.int64), values)
    anchor = rng.integers(-largest, largest, 64)
    want = [sum(int(a) * int(b) for a, b in zip(row, anchor)) for row in values]
    assert lists.scores(np.arange(50), anchor).tolist() == want
