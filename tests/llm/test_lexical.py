"""Ranked search against a plain version, odd rows, ties and masks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from signalmill.llm import lexical as X

ITEMS = "item_id long, text string, rank int, key string"


def terms(text):
    fold = {c: c + 32 for c in range(65, 91)}
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))


def brute(texts, items, k=20, first_id=0):
    own = [Counter(terms(t)) for t in texts]
    held = [(first_id + i, c, c.total()) for i, c in enumerate(own) if c]
    N, L = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for key, c, n in held:
            m = 100 - 25 + (25 * n * N) // L
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((-score, key))
        out += [(item, r, key, -s) for r, (s, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(docs, items, **more):
    return sorted((tuple(r) for r in X.search(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def frame(spark, items):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)


def test_equals_the_plain_version(spark, docs_of):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(500)]
    texts += texts[:60] + ["Und Über-Größe; naïve words ÀÉ x" * 3, "UPPER lower 42_x"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 90)))) for i in range(25)] + [(90, "UND über größe lower 42 x X"), (91, "w1 w1 w1 w2")]
    want = brute(texts, items)
    docs = docs_of(texts).repartition(4)
    assert len(want) > 300
    assert found(docs, frame(spark, items)) == want
    assert found(docs, frame(spark, items), item_bytes=700) == want  # many chunks
    assert found(docs, frame(spark, items), k=3) == brute(texts, items, 3)


def test_odd_rows(spark, docs_of):
    long = "rare " + "common " * 900_000
    texts = [None, "", " .,;!", "common", "common", "common rare", long, " ", "x" * 100_000]
    items = [(1, "rare common"), (1, "rare common"), (2, None), (3, ""), (4, "absent"), (5, "x" * 100_000), (1, "rare"), (None, "rare rare")]
    assert found(docs_of(texts), frame(spark, items)) == brute(texts, items)
    assert found(docs_of([]), frame(spark, items)) == []
    assert found(docs_of([None, "..."]), frame(spark, items)) == []
    assert found(docs_of(texts), frame(spark, [])) == []


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(2, "a b"), (2, "a b"), (1, "a b"), (None, "a b"), (7, "c"), (8, "d")], "doc_id long, text string")
    got = found(docs, frame(spark, [(1, "a")]))
    assert [r[1:3] for r in got] == [(1, 1), (2, 2), (3, 2), (4, None)] and len({r[3] for r in got}) == 1


def test_masks_are_left_once_they_cannot_win():
    n = 5000
    lists = [[0, 1] if i < 30 else [1] for i in range(n)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    flat = pa.array([t for x in lists for t in x], pa.int32())
    column = pa.ListArray.from_arrays(pa.array(offsets), flat)
    ones = pa.ListArray.from_arrays(pa.array(offsets), pa.array([1] * len(flat), pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([5] * n, pa.int64()), column, ones], names=["key", "n", "terms", "tfs"])
    block = X.Block(batch, np.array([5000, 10]), n, 5 * n)
    held, order, starts = block.masks(np.array([0, 1]))
    assert sorted(map(tuple, held.tolist())) == [(0, 1), (1, 1)] and sorted(order.tolist()) == list(range(n))
    best, zeros = X.Best(20), np.zeros(2, np.int64)
    assert X.rank_block(block, batch.column(0), np.array([0, 1]), np.array([1, 1]), best, zeros) == 30
    assert [f[3] for f in best.found] == list(range(20)) and not zeros.any()


def test_wide_masks():
    terms = list(range(70))
    lists = [sorted(random.Random(i).sample(terms, 30)) for i in range(50)] * 2
    offsets = pa.array(np.arange(0, 3001, 30, dtype=np.int32))
    column = pa.ListArray.from_arrays(offsets, pa.array([t for x in lists for t in x], pa.int32()))
    ones = pa.ListArray.from_arrays(offsets, pa.array([1] * 3000, pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([30] * 100, pa.int64()), column, ones], names=["key", "n", "terms", "tfs"])
    held, order, starts = X.Block(batch, np.ones(70, np.int64), 100, 3000).masks(np.arange(70))
    groups = {tuple(np.flatnonzero(m).tolist()): sorted(g.tolist()) for m, g in zip(held, np.split(order, starts[1:]))}
    want = {}
    for i, x in enumerate(lists):
        want.setdefault(tuple(x), []).append(i)
    assert groups == want
