"""Cutting-stock packing: no id is lost, sequences are gapless and full, patterns are as few as the bound allows."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from signalmill.llm import cutting_stock as C

PATH = P.path("byte_bpe_50k.json")


def ids_of(texts):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return [e.ids + [1] for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def checked(rows, want, size):
    """Every id in one piece, every sequence gapless; returns the padding beyond powers of two, and pieces of each document."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(pieces) == list(range(len(want)))
    for key, ids in enumerate(want):
        at = 0
        for r in sorted(pieces[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        padding += size - at if at & (at - 1) else 0
    return padding, pieces


def test_every_id_lies_in_one_piece(spark, docs_of):
    rng = random.Random(8)
    words = ["alpha", "bete noire", "42", "naïve", "  ", "\n", "x" * 30, "日本語", "<|endoftext|>", "it's"]
    texts = [None, "", "word " * 900, "word " * 900] + [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(1500)]
    docs, want = docs_of(texts).repartition(5), ids_of(texts)
    padding, pieces = checked(C.pack(docs, PATH, P.PATTERN, size=64, width=4).collect(), want, 64)
    assert padding == 0
    short = [k for k, ids in enumerate(want) if len(ids) <= 64]
    assert sum(len(pieces[k]) == 1 for k in short) > 0.5 * len(short)


def test_small_and_odd_tables(spark, docs_of):
    for texts in ([], [None], ["", ""], ["same words here"] * 40):
        rows = C.pack(docs_of(texts), PATH, P.PATTERN, size=32, width=4).collect()
        checked(rows, ids_of(texts), 32)
    bare = docs_of(["a b c"] * 3).select("text", "doc_id").selectExpr("text", "cast(null as long) as doc_id")
    assert [r["doc_id"] for r in C.pack(bare, PATH, P.PATTERN, size=32, width=4).collect()] == [None] * 3


def test_repeated_keys_are_packed_as_often(spark, docs_of):
    docs = docs_of(["one two three"]).union(docs_of(["one two three"])).union(docs_of(["other"]))
    rows = C.pack(docs, PATH, P.PATTERN, size=32, width=4).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids_of(["one two three", "one two three", "other"])))


def test_patterns_are_optimal_on_small_programs():
    rng = random.Random(9)
    for _ in range(25):
        capacity = rng.randint(4, 14)
        sizes = np.array(sorted(rng.sample(range(1, capacity + 1), rng.randint(1, min(4, capacity)))))
        demand = np.array([float(rng.randint(1, 30)) for _ in sizes])
        patterns, amounts = C.cover(sizes, demand, capacity)
        assert (patterns @ sizes <= capacity).all() and (patterns.T @ amounts >= demand - 1e-6).all()
        # Weak duality: no prices under which every pattern costs at most 1 give more than the optimum.
        every = [c for c in itertools.product(*(range(capacity // s + 1) for s in sizes.tolist())) if np.dot(c, sizes) <= capacity]
        best = max((C.best_pattern(np.array([rng.random() for _ in sizes]), sizes, capacity) for _ in range(3)), key=lambda b: b[0])
        assert tuple(best[1].astype(int)) in set(every)
        bound = 0.0
        for _ in range(300):
            prices = np.array([rng.random() for _ in sizes])
            prices /= max(float(np.dot(c, prices)) for c in every)
            bound = max(bound, float(demand @ prices))
        assert amounts.sum() >= bound - 1e-6
        # And the program's own prices prove it: the amounts meet the bound of a feasible pricing.
        prices = np.linalg.lstsq(patterns.astype(float)[amounts > 1e-9], np.ones(int((amounts > 1e-9).sum())), rcond=None)[0]
        if (prices >= -1e-9).all() and max(float(np.dot(c, prices)) for c in every) <= 1 + 1e-6:
            assert amounts.sum() <= float(demand @ prices) * 1.001 + 1e-6


def test_knapsack_equals_all_patterns():
    rng = random.Random(10)
    for _ in range(50):
        capacity = rng.randint(1, 12)
        sizes = np.array(sorted(rng.sample(range(1, capacity + 1), rng.randint(1, min(4, capacity)))))
        prices = np.array([rng.choice([0.0, rng.random()]) for _ in sizes])
        value, counts = C.best_pattern(prices, sizes, capacity)
        every = [c for c in itertools.product(*(range(capacity // s + 1) for s in sizes.tolist())) if np.dot(c, sizes) <= capacity]
        assert abs(value - max(float(np.dot(c, prices)) for c in every)) < 1e-9
        assert counts @ sizes <= capacity and abs(counts @ prices - value) < 1e-9


def test_ranks_fall_into_places_once():
    rng = np.random.default_rng(11)
    lengths = rng.integers(1, 256, 6000)
    found, counts = np.unique(lengths, return_counts=True)
    places = C.Places(dict(zip(found.tolist(), counts.tolist())), 256, 8)
    bins = -(-lengths // 8)
    ranks = np.zeros(len(bins), np.int64)
    for b in np.unique(bins):
        ranks[bins == b] = np.arange((bins == b).sum())
    sequence, place = places.of(bins, ranks)
    inside = sequence >= 0
    assert inside.mean() > 0.9 and len(set(zip(sequence[inside], place[inside]))) == inside.sum()
    used = np.bincount(sequence[inside], weights=lengths[inside])
    assert len(used) <= places.sequences and used.max() <= 256 and used.sum() > 0.95 * 256 * places.sequences


def test_filling_cuts_at_rooms_and_tails():
    rng = np.random.default_rng(12)
    for free, tails in (([], []), ([5], []), ([], [7, 9]), ([3, 4], [2, 2, 30]), (rng.integers(1, 9, 50), rng.integers(1, 60, 40))):
        free, tails = np.array(free, np.int64), np.array(tails, np.int64)
        tail, inside, length, room, offset, more = C.fill(free, tails, 16)
        rooms = np.concatenate([free, more])
        assert length.sum() == tails.sum() and (length > 0).all()
        for k in range(len(tails)):
            own = np.flatnonzero(tail == k)
            assert inside[own].tolist() == (np.cumsum(length[own]) - length[own]).tolist() and length[own].sum() == tails[k]
        for k in np.unique(room):
            own = np.flatnonzero(room == k)
            assert offset[own].tolist() == (np.cumsum(length[own]) - length[own]).tolist() and length[own].sum() <= rooms[k]
        assert all(m == 16 or m & (m - 1) == 0 for m in more.tolist())


def test_vocabulary_gives_the_ids_of_its_own_library():
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b 1{c}2 {c} {c}{c}  x" for c in points] + ["<|endoftext|> it's  \n\n we'll"]
    encoding = C._encoding(open(PATH, "rb").read(), P.PATTERN)
    assert [encoding.encode_ordinary(t) + [1] for t in texts] == ids_of(texts)
