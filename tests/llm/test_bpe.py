"""BPE against the tiktoken library, and round trips."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from signalmill.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.rank_file(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_equal_the_library(own, library):
    rng = random.Random(3)
    letters = "abcdeghiz  \n\n\t'sté漢字😀1290.,!#  A\x1c\x85 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(2000)]
    texts += ["", " ", "\n", "  a", "a ", "a\n", "\n\nB", "don't we'll", "<|endoftext|>", "a  \n  b\n \nc"]
    for text, ids in zip(texts, own.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()
        assert own.decimals(ids).decode() == " ".join(map(str, ids.tolist()))


def test_long_pretokens(own, library):
    rng = random.Random(4)
    for letters in ("ab", "aaeinst", "é漢a", "0123456789"):
        text = "".join(rng.choice(letters) for _ in range(5000))
        assert own.encode([text])[0].tolist() == library.encode_ordinary(text)
        data = text.encode()
        assert own.merge_long(data) == own.merge_many([b"", data, b"x"])[1]


def test_cutting_long_texts_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    text = ("The quick  brown\nfox. " * 40) + "x" * 200 + " end"
    assert "".join(bpe.cut(text, 50)) == text
    assert next(own.encode_blocks([text])).tolist() == library.encode_ordinary(text)


def test_emptied_memory_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    for text in ("one two three four five", "six seven one two", "one"):
        assert own.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_rank_queue_gives_least_rank_first():
    queue = bpe.RankQueue(50_000)
    rng = random.Random(5)
    ranks = [rng.randrange(50_000) for _ in range(500)]
    for i, r in enumerate(ranks):
        queue.put(r, [i])
    got = []
    while (entry := queue.take()) is not None:
        got += [entry[0]] * len(entry[1])
    assert got == sorted(ranks)


def test_operator_round_trip(spark, docs_of, library):
    texts = [None, "", "plain words here", "plain words here", "é漢😀 " * 500, "x" * 3000]
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs_of(texts), PATH, P.PATTERN).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(docs_of(texts).limit(0), PATH, P.PATTERN).count() == 0


def test_encode_and_decode_columns(spark, docs_of):
    texts = [None, "", "some words", "😀"]
    both = bpe.decode(bpe.encode(docs_of(texts), PATH, P.PATTERN, out="score"), PATH, P.PATTERN, ids="score")
    assert "score" in both.columns and both.columns.count("score") == 1
    for r in both.collect():
        assert bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode()
