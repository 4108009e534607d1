"""Windows, block tables and leaks against brute force."""

import random
import re
from collections import Counter

import numpy as np

from signalmill.llm import decontaminate as D


def tokens(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())


def brute_best(text, item, width=5):
    own, query = tokens(text), tokens(item)
    n = min(width, len(query))
    bag = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    want, best = bag(query), 0.0
    for at in range(len(own) - len(query) + 1):
        got = bag(own[at : at + len(query)])
        shared = (want & got).total()
        best = max(best, shared / (want.total() + got.total() - shared))
    return best


def test_block_tables_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**64, 60, np.uint64)
    queries = rng.integers(0, 2**64, 80, np.uint64)
    flips = rng.integers(0, 64, (80, 25))
    for q in range(60):
        queries[q] = prints[q]
        for b in flips[q, : rng.integers(0, 25)]:
            queries[q] ^= np.uint64(1) << np.uint64(b)
    got = list(zip(*(x.tolist() for x in D.HammingBlocks(prints).near(queries))))
    near = np.bitwise_count(queries[:, None] ^ prints[None, :]) <= D.RADIUS
    assert len(got) == len(set(got)) and set(got) == set(zip(*np.nonzero(near)))


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"word{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([3, 15, 30, 31, 59])))) for i in range(20)] + [(20, None), (21, ""), (22, "...")]
    items += [(23, items[0][1])]
    texts = [None, "", "??"]
    for _ in range(120):
        body = some(rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            passage = (items[rng.randrange(20)][1]).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
            at = rng.randint(0, len(body))
            body[at:at] = [p.upper() + "," for p in passage]
        texts.append(" ".join(body))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, text in enumerate(texts):
        for k, item in items:
            if tokens(item) and (best := brute_best(text, item)) >= 0.8:
                want[i, k] = round(best, 9)
    found = D.leaks(docs, bench)
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found.collect()}
    assert got == want and len(want) > 15 and min(want.values()) < 1
    clean = D.without_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_parts_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(D, "BENCHMARK_BYTES", 40)
    items = [(i, f"alpha{i} beta gamma delta epsilon zeta") for i in range(9)]
    docs = spark.createDataFrame([(1, " x ".join(t for _, t in items))] * 2, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r["item_id"] for r in D.leaks(docs, bench).collect()) == list(range(9))
    assert D.without_leaks(docs, bench).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(docs, none).count() == 0 and D.without_leaks(docs, none).count() == 1
    assert D.leaks(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_items_of_any_id(spark, docs_of):
    words = [" ".join(f"{c}{k}" for k in range(12)) for c in "abcd"]
    docs = docs_of([f"start {words[0]} end", f"start {words[1]} end", f"{words[2]} and {words[3]}", "clean text of nobody"])
    bench = spark.createDataFrame([("x", words[0]), (None, words[1]), ("7", words[2]), (None, words[3]), ("y", None)], "item_id string, text string")
    found = {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, bench).collect()}
    assert found == {(0, "x"), (1, None), (2, "7"), (2, None)}
    assert [r["doc_id"] for r in D.without_leaks(docs, bench).collect()] == [3]
    assert dict(D.leaks(docs, bench).dtypes)["item_id"] == "string"
