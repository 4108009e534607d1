"""SimHash, the trie join and components against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from signalmill.llm import simhash


def brute_print(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, prints, budget):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= budget:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(ids))]


def keys_with_clusters(rng, n):
    keys = set()
    while len(keys) < n:
        k = rng.getrandbits(64)
        for _ in range(rng.randint(1, 5)):
            keys.add(k)
            for _ in range(rng.randint(0, 4)):
                k ^= 1 << rng.randrange(64)
    return np.array(sorted(keys)[:n], np.uint64)


def test_fingerprint_equals_the_definition(monkeypatch):
    texts = [None, "", " \t\n", "One", "a b c", "A b C d É", "x\x0by\x0cz w v u", "the cat sat on the mat " * 30]
    for text in texts:
        assert simhash.fingerprint(text) == brute_print(text)
    monkeypatch.setattr(simhash, "HASH_BLOCK", 7)
    assert simhash.fingerprint(texts[-1]) == brute_print(texts[-1])


@pytest.mark.parametrize("budget", [0, 1, 4])
@pytest.mark.parametrize("small", [1, 4, 50])
def test_trie_join_finds_every_pair(budget, small, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "PAIR_BLOCK", 100)
    keys = keys_with_clusters(random.Random(budget), 300)
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= budget
    want = {(a, b) for a, b in zip(*np.nonzero(near)) if a < b}
    trie = simhash.Trie(keys)
    got = [p for x, y in simhash.linked_leaves(trie, trie, budget) for p in zip(x, y)]
    assert len(got) == len(set(got)) and set(got) == want
    left, right = keys[::2], keys[1::2]
    got = [(2 * a, 2 * b + 1) for x, y in simhash.linked_leaves(*simhash.tries(left, right), budget) for a, b in zip(x, y)]
    assert len(got) == len(set(got))
    assert {tuple(sorted(p)) for p in got} == {p for p in want if (p[0] + p[1]) % 2}


def test_trie_cut_covers_every_prefix():
    counts = {5: 10, 6: 1000, 7: 3, 16000: 5}
    nodes = simhash.trie_nodes(counts, 100)
    assert (6, simhash.MOST_DEPTH, 10) in nodes
    for prefix in counts:
        assert sum(prefix >> (simhash.MOST_DEPTH - d) == p for p, d, _ in nodes) == 1


@pytest.mark.parametrize("node_rows", [16, 1 << 17])
def test_near_duplicates_against_brute_force(spark, node_rows):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(base))
            if base:
                base[rng.randrange(len(base))] = rng.choice(words)
    texts += [None, "", "same text here again now"] * 3
    ids = list(range(len(texts)))
    ids[3] = ids[-1] = None
    ids[8] = ids[7]
    rows = list(zip(ids, texts, ["x"] * len(ids)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    found = simhash.near_duplicates(docs, node_rows=node_rows)
    prints = [brute_print(t) for t in texts]
    want = sorted(zip(ids, (f"{p:016x}" for p in prints), brute_components(ids, prints, 4)), key=repr)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    kept = simhash.one_of_each(docs, found)
    assert kept.columns == docs.columns
    chosen = {c for _, _, c in want if c is not None}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(chosen)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "least long, fp long")
    got = {r["fp"]: r["least"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e")] * 3 + [(None, None), (4, "a b c d e")], "doc_id long, text string")
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(4, "a b c d e"), (None, None)], key=repr)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_different_texts_under_one_id_stay(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(str(rng.random()) for _ in range(60)) for _ in range(3))
    # 5 has a text of its own and one that 3 has too; both components of 8 have 8 as their least id.
    rows = [(5, a), (7, a), (3, b), (5, b), (8, c), (8, c + " end"), (8, c), (8, a[::-1]), (9, a[::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs, keep_label=True)).collect()
    prints = {t: brute_print(t) for t in (c, c + " end")}
    least = {c} if bin(prints[c] ^ prints[c + " end"]).count("1") > 4 else set()
    near = {c, c + " end"} if least else {min(prints, key=lambda t: (f"{prints[t]:016x}", t))}
    assert sorted(map(tuple, kept)) == sorted([(3, b), (5, a), (8, a[::-1]), *((8, t) for t in near)])


def test_one_of_each_leaves_other_columns_alone(spark):
    texts = ["one two three four five six", "one two three four five six", "other words are written down here", None]
    rows = [(i if i < 3 else None, t, f"keep {i}", [i]) for i, t in enumerate(texts)] + [(0, "one two three four five six", "keep 9", [9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, fp array<int>")
    for width in (2, 4):
        found = simhash.near_duplicates(docs, width=width, budget=4, keep_label=True)
        kept = simhash.one_of_each(docs, found, width=width)
        assert kept.columns == docs.columns
        got = sorted(((r["doc_id"], r["_text"]) for r in kept.collect()), key=repr)
        assert [g[0] for g in got] == [0, 2, None] and {g[1] for g in got} <= {f"keep {i}" for i in (0, 2, 3, 9)}
