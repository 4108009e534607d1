"""Packing: nothing is lost, rows are the fullest that fit, positions restart at segments."""

import random

import numpy as np
import public_tokenizers as P

from signalmill.llm import bpe, packing

PATH = P.path("byte_bpe_50k.tiktoken")


def brute_best_fit(lengths, size):
    rooms, rows = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in range(len(rooms)) if rooms[r] >= lengths[i]]
        if fits:
            row = min(fits, key=lambda r: rooms[r])
        else:
            row = len(rooms)
            rooms.append(size)
            rows.append([])
        rooms[row] -= lengths[i]
        rows[row].append(i)
    return rows


def test_best_fit_decreasing_uses_as_many_rows_as_the_plain_search():
    rng = random.Random(2)
    for size in (1, 7, 64, 100):
        for _ in range(20):
            lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 120))]
            rows = packing.best_fit_decreasing(np.array(lengths, np.int64), size)
            assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
            fill = lambda rows: sorted(sum(lengths[i] for i in r) for r in rows)  # noqa: E731, B023
            assert fill(rows) == fill(brute_best_fit(lengths, size)) and all(f <= size for f in fill(rows))


def test_capacity_tree_gives_the_least_sufficient_room():
    rng, tree, rooms = random.Random(1), packing.CapacityTree(50), []
    for _ in range(2000):
        if rng.random() < 0.6:
            room = rng.randint(1, 50)
            tree.add(room, len(rooms))
            rooms.append(room)
        else:
            least = rng.randint(1, 50)
            fits = [c for c in rooms if c is not None and c >= least]
            found = tree.take(least)
            assert (found is None) == (not fits)
            if found:
                assert found[1] == min(fits) == rooms[found[0]]
                rooms[found[0]] = None


def test_rows_hold_all_documents(spark, docs_of):
    rng = random.Random(5)
    texts = [None, "", "word " * 500, "word " * 500] + [" ".join(str(rng.random()) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    docs = docs_of(texts).repartition(3)
    packed = packing.pack(docs, PATH, P.PATTERN, row_ids=64, block_ids=700).collect()
    encoder = bpe.Bpe(bpe.rank_file(PATH), P.PATTERN)
    pieces = {}
    for r in packed:
        ids = np.frombuffer(bytes(r["input_ids"]), "<u2")
        assert len(ids) == 64 and (ids[r["n_ids"] :] == 50256).all() and r["cu_seqlens"][-1] == r["n_ids"]
        ends = r["cu_seqlens"][1:]
        assert r["position_resets"] == [0, *(ends if r["n_ids"] < 64 else ends[:-1])]
        for key, start, a, b in zip(r["doc_keys"], r["doc_starts"], r["cu_seqlens"], ends):
            pieces[key, start] = ids[a:b]
    for i, text in enumerate(texts):
        own = [pieces[k] for k in sorted(pieces) if k[0] == i]
        whole = np.concatenate(own) if own else np.zeros(0, int)
        assert whole.tolist() == encoder.encode([text or ""])[0].tolist()
    assert packing.digest(packing.pack(docs.limit(0), PATH, P.PATTERN)).count() == 0
