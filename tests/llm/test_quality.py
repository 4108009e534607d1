"""Counts against brute force; both classifiers on held-out rows and on odd tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.llm import quality_knn, quality_rules
from signalmill.llm.linear import Block


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside)


def some_texts(rng):
    letters = ["a", "b", "é", "漢", "\x85", "#", "|", " ", " ", "\n", "\t", "\x0b"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    texts += [None, "", "\n", "\n\n a \n a \n a", "x", "ab ab ab ab ab ab", "one two three four five " * 40, "a b c d e f a b c d e"]
    return texts


def test_counts_equal_the_definition():
    texts = some_texts(random.Random(1))
    found = quality_rules.counts(Block(texts))
    got = list(zip(*(found[c].tolist() for c in quality_rules.COUNTS)))
    assert got == [brute_counts(t) for t in texts]


def test_block_results_do_not_depend_on_neighbours():
    texts = some_texts(random.Random(2))
    weights = np.random.default_rng(0).standard_normal(3 << 16)
    together = Block(texts).linear(weights)
    alone = [float(Block([t]).linear(weights)[0]) for t in texts]
    assert np.allclose(together, alone)
    for t, (place, share) in zip(texts, Block(texts).features()):
        assert np.isclose(share @ weights[place], float(Block([t]).linear(weights)[0]))


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose and junk; every third key is held out by its hash."""
    rng = random.Random(6)
    syllables = ["tha", "ing", "ore", "ent", "al", "be", "un", "ver"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(12, 120))]
        good = int(rng.random() < 0.8)
        if not good:
            words = [w + rng.choice(["###", "%%%", "$$$"]) if rng.random() < 0.7 else w for w in words]
        rows.append((i, " ".join(words), 0.5, "x"))
        labels.append((i, good, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, kept string").repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, q) for i, q, _ in labels)


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_rules_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    model = quality_rules.train(docs, labels, fit_rows=200, calibration_rows=200)
    found = quality_rules.judge(docs, model).collect()
    assert len(found) == 900
    right = [r["kept"] == bool(truth[r["doc_id"]]) for r in found if held(r["doc_id"])]
    assert sum(right) / len(right) > 0.97
    loss = np.mean([(r["score"] - truth[r["doc_id"]]) ** 2 for r in found if held(r["doc_id"])])
    assert loss < 0.03  # probabilities, not only an order
    kept = quality_rules.judge(docs, model, keep_columns=True)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in found if r["kept"])


def test_neighbours_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    found = quality_knn.score(docs, quality_knn.train(docs, labels, labelled_rows=300)).collect()
    assert len(found) == 900 and all(r["held_out"] == held(r["doc_id"]) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    right = [r["predicted"] == truth[r["doc_id"]] for r in found if r["held_out"]]
    assert sum(right) / len(right) > 0.97


def test_cosines_are_exact_and_ties_vote(monkeypatch):
    rng = np.random.default_rng(3)
    shape = (40, sum(quality_knn.TERMS))
    terms = (rng.random(shape) * (rng.random(shape) < 0.02)).astype(np.float32)
    terms[7] = terms[8] = terms[9]
    labels = rng.integers(0, 2, 40)
    space = quality_knn.fit_space(terms, labels)
    monkeypatch.setattr(quality_knn, "COSINE_BLOCK", 7)
    got = space.scores(terms)
    for row, value in zip(quality_knn.unit(terms @ space.projection), got):
        cosine = np.array([max(0.0, float(row @ v)) for v in space.vectors])
        voters = cosine >= sorted(cosine)[-quality_knn.NEIGHBOURS] - 1e-6
        assert np.isclose(value, (cosine * labels)[voters].sum() / cosine[voters].sum(), atol=1e-4)
    assert got[7] == got[8] == got[9]


def test_labels_of_the_held_out_fold_are_not_read(corpus):
    docs, labels, _ = corpus
    flipped = labels.withColumn("quality", F.when(quality_rules.fold("doc_id") == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(tuple, quality_knn.score(docs, quality_knn.train(docs, x, labelled_rows=200)).collect())) for x in (labels, flipped))
    assert one == two


def test_odd_tables(spark, docs_of):
    docs = docs_of([None, "", "too short", "one two three four five six seven eight nine ten", "x y " * 3000])
    for labels in ([], [(0, 1, 0), (3, None, None), (3, 1, 0), (3, 1, 0), (99, 0, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        rules = {r["doc_id"]: r for r in quality_rules.judge(docs, quality_rules.train(docs, table)).collect()}
        assert [rules[i]["base_failed"] for i in range(5)] == [True, True, True, False, True]
        assert rules[3]["kept"] and not rules[4]["kept"]
        found = quality_knn.score(docs, quality_knn.train(docs, table)).collect()
        assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
    none = docs.limit(0)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(none, quality_rules.train(none, empty)).count() == 0
    assert quality_knn.score(none, quality_knn.train(none, empty)).count() == 0


def test_training_reads_whole_texts(spark):
    rng = random.Random(3)
    clean = " ".join(str(rng.random()) for _ in range(1500))
    late = clean + " one two three four five" * 1500  # rejected by the counts, but not for its first 20,000 characters
    docs = spark.createDataFrame([(1, clean), (2, late)], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows, code = quality_rules.training_rows(docs, chosen, "doc_id", "text", "quality")
    assert len(clean) > 20_000 and code.tolist() == [1]
    assert np.array_equal(rows[0][0], Block([clean]).features()[0][0])


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


def test_counts_hold_where_hashes_collide():
    """Sums of odd powers modulo 2**64 do not tell a Thue-Morse word of 2,048 letters and more from its complement."""
    s = thue_morse(4096)
    t = s.translate(str.maketrans("ab", "ba"))
    texts = [f"{s}\n{t}\nx y z", f"{s} b c d e {t} b c d e x", f"{s}\n{t}\n{s}\n{t}", f"{s} b c d e {t} b c d e {s} b c d e"]
    found = quality_rules.counts(Block(texts))
    assert found["n_dup_lines"].tolist() == [0, 0, 2, 0]
    assert found["n_repeat_words"].tolist() == [0, 0, 0, 10]
