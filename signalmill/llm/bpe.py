"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merges are taken from a queue with one bucket per merge rank. A three-level bitmap tells which buckets
have entries, so the next rank is three find-first-set steps away whatever the length of the text.
Buckets hold positions of a linked list of tokens; entries whose pair has changed since are skipped.

Short pre-tokens of a block go through one queue together: they are independent, so the least rank of
the block is the least rank of each pre-token that has it. Long ones get a queue of their own.

Nulls count as empty texts; an empty text has no token. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from signalmill.llm.common import blocks, narrow

#: Characters encoded at a time: a queue serves more pre-tokens the larger a block is.
BLOCK_CHARS = 4_000_000
#: Pre-tokens of so many bytes have a queue of their own.
LONG_BYTES = 512
#: Entries of a worker's memory of encoded words; beyond it the memory is emptied. Results don't depend on it.
CACHE_ENTRIES = 400_000
#: Bytes of a rank file that may be broadcast: vocabularies do not grow with the data.
MAX_RANK_BYTES = 64 << 20
#: A match of the pattern begins at every white space that anything else follows, so a text may be cut there.
_CUT = re.compile(r"(?=[ \n]\S)")
_ODD_SPACE = re.compile(r"[ \n](?:\s|\Z)")


def units(text: str) -> list[str]:
    """The text cut before blanks and line ends that anything else follows; a unit's blank in front is left out.

    The first unit has nothing in front; the others lack a blank unless they begin with a line end.
    """
    if _ODD_SPACE.search(text) is None:
        return text.replace("\n", " \n").split(" ")
    first, *rest = _CUT.split(text)
    return [first, *(unit.removeprefix(" ") for unit in rest)]


class RankQueue:
    """Buckets of positions by merge rank below a bitmap of 64-way words in three levels."""

    def __init__(self, ranks: int):
        if ranks > 64**3:
            raise ValueError("at most 262,144 ranks")
        self.buckets: list[list[int] | None] = [None] * ranks
        self.leaf = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def put(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.buckets[rank] = positions
            self.leaf[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.extend(positions)

    def take(self) -> tuple[int, list[int]] | None:
        """The least rank that has entries, and all of them; the bucket is emptied."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = (a << 6) | ((self.mid[a] & -self.mid[a]).bit_length() - 1)
        rank = (b << 6) | ((self.leaf[b] & -self.leaf[b]).bit_length() - 1)
        self.leaf[b] &= self.leaf[b] - 1
        if not self.leaf[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        positions, self.buckets[rank] = self.buckets[rank], None
        return rank, positions


class Bpe:
    """Encoder and decoder of one vocabulary and split pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        pairs = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.size = max(self.ids.values()) + 1
        if self.size > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self._pairs()
        self._tables()
        self.word_ids: dict[str, bytes] = {}  # pre-token: its ids as 16-bit numbers
        self.units: dict[str, bytes] = {}  # and of units()
        self.firsts: dict[str, bytes] = {}

    def _pairs(self) -> None:
        """Every pair of tokens whose joined bytes are a token, sorted by pair."""
        self.pair: dict[int, int] = {}
        lowest = np.full(self.size, self.size, np.int64)
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                left, right = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if left is not None and right is not None:
                    self.pair[left << 16 | right] = rank
                    lowest[left] = min(lowest[left], rank)
                    lowest[right] = min(lowest[right], rank)
        order = sorted(self.pair)
        self.pair_keys = np.array(order + [np.iinfo(np.int64).max], np.int64)
        self.pair_rank = np.array([self.pair[k] for k in order] + [-1], np.int64)
        # Merging such a rank never allows a lower one, so all its places in a pre-token can be merged at once.
        self.settled = lowest > np.arange(self.size)

    def _tables(self) -> None:
        tokens = [b""] * self.size
        for token, rank in self.ids.items():
            tokens[rank] = token
        self.tokens = tokens
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = np.zeros((self.size, 6), np.uint8)
        for i in range(self.size):
            text = f"{i} ".encode()
            self.decimal[i, : len(text)] = np.frombuffer(text, np.uint8)

    # Merging

    def _rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 16 | right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], -1)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of several pre-tokens, as 16-bit numbers, through one queue."""
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(words) else 0
        if not n:
            return [b""] * len(words)
        token = np.append(self.byte_id[np.frombuffer(b"".join(words), np.uint8)], 0)
        word = np.repeat(np.arange(len(words)), lengths)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        filled = lengths > 0
        after[ends[filled] - 1] = n  # n: no neighbour
        before[(ends - lengths)[filled]] = n
        after[n] = n
        rank = np.full(n + 1, -1, np.int64)
        paired = np.flatnonzero(after[:n] < n)
        rank[paired] = self._rank_of(token[paired], token[after[paired]])
        queue = RankQueue(self.size)
        queued = paired[rank[paired] >= 0]
        queued = queued[np.argsort(rank[queued], kind="stable")]
        edges = np.flatnonzero(np.diff(rank[queued], prepend=-2))
        for lo, hi in zip(edges, [*edges[1:], len(queued)]):
            queue.put(int(rank[queued[lo]]), queued[lo:hi].tolist())
        while (entry := queue.take()) is not None:
            r, found = entry
            at = np.array(found, np.int64)
            at.sort()
            at = at[rank[at] == r]
            if at.size > 1:
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            if not at.size:
                continue
            if not self.settled[r] and at.size > 1:
                first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
                if not first.all():
                    queue.put(r, at[~first].tolist())
                    at = at[first]
            elif at.size > 1 and (chained := after[at[:-1]] == at[1:]).any():
                # Overlapping places: every second one, from the left of each run.
                order = np.arange(at.size)
                run = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), order, 0))
                at = at[(order - run) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            token[at] = r
            after[at] = beyond
            before[beyond] = at
            rank[gone] = -1
            token[gone] = -1
            left = before[at]
            touched = np.concatenate([at, left[left < n]])
            right = after[touched]
            new = np.where(right < n, self._rank_of(token[touched], token[right]), -1)
            rank[touched] = new
            live = new >= 0
            for q, p in zip(new[live].tolist(), touched[live].tolist()):
                queue.put(q, [p])
        kept = token[:n] >= 0
        ids = token[:n][kept].astype("<u2").tobytes()
        cuts = [0, *(2 * np.cumsum(np.bincount(word[kept], minlength=len(words)))).tolist()]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one pre-token of any length."""
        n = len(word)
        token = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), self.pair.get
        rank = [pair(a << 16 | b, -1) for a, b in zip(token, token[1:])] + [-1]
        queue = RankQueue(self.size)
        for p, r in enumerate(rank):
            if r >= 0:
                queue.put(r, [p])
        while (entry := queue.take()) is not None:
            r, found = entry
            found.sort()
            settled = bool(self.settled[r])
            for k, p in enumerate(found):
                if rank[p] != r:
                    continue
                gone = after[p]
                beyond = after[gone]
                token[p], after[p], rank[gone], token[gone] = r, beyond, -1, -1
                if beyond < n:
                    before[beyond] = p
                    rank[p] = pair(r << 16 | token[beyond], -1)
                else:
                    rank[p] = -1
                if rank[p] >= 0:
                    queue.put(rank[p], [p])
                left = before[p]
                if left >= 0:
                    rank[left] = pair(token[left] << 16 | r, -1)
                    if rank[left] >= 0:
                        queue.put(rank[left], [left])
                if not settled:  # a lower rank may wait now
                    if k + 1 < len(found):
                        queue.put(r, found[k + 1 :])
                    break
        return np.array([t for t in token if t >= 0], "<u2").tobytes()

    # Texts

    def learn(self, words: Iterable[str]) -> None:
        """Encode the pre-tokens that the worker's memory does not have yet."""
        short, names = [], []
        for word in words:
            if word not in self.word_ids:
                data = word.encode()
                known = self.ids.get(data)
                if known is not None:
                    self.word_ids[word] = known.to_bytes(2, "little")
                elif len(data) >= LONG_BYTES:
                    self.word_ids[word] = self.merge_long(data)
                else:
                    self.word_ids[word] = b""
                    short.append(data)
                    names.append(word)
        self.word_ids.update(zip(names, self.merge_many(short)))

    def _learn_units(self, firsts: set[str], rest: set[str]) -> None:
        new = [(unit, unit if unit[:1] == "\n" else " " + unit, self.units) for unit in rest if unit not in self.units]
        new += [(unit, unit, self.firsts) for unit in firsts if unit not in self.firsts]
        found = [self.pattern.findall(whole) for _, whole, _ in new]
        self.learn({word for words in found for word in words})
        get = self.word_ids.__getitem__
        for (unit, _, memory), words in zip(new, found):
            memory[unit] = b"".join(map(get, words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if max(len(self.units), len(self.word_ids), len(self.firsts)) > CACHE_ENTRIES:
            for memory in (self.units, self.word_ids, self.firsts):
                memory.clear()
        split = [units(text) for text in texts]
        self._learn_units({parts[0] for parts in split}, {unit for parts in split for unit in parts[1:]})
        get = self.units.__getitem__
        return [np.frombuffer(self.firsts[parts[0]] + b"".join(map(get, parts[1:])), "<u2") for parts in split]

    def encode_blocks(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text in turn, in blocks of bounded size."""
        for start, end in blocks(texts, BLOCK_CHARS):
            block = [t or "" for t in texts[start:end]]
            if end - start == 1 and len(block[0]) > BLOCK_CHARS:
                yield np.concatenate([self.encode([part])[0] for part in cut(block[0], BLOCK_CHARS)])
            else:
                yield from self.encode(block)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        lengths = self.token_len[ids]
        total = int(lengths.sum())
        first = np.repeat(self.token_start[ids] - (np.cumsum(lengths) - lengths), lengths)
        return self.token_bytes[first + np.arange(total)].tobytes()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one space."""
        flat = self.decimal[ids].ravel()
        return flat[flat != 0].tobytes()[:-1]


def cut(text: str, chars: int = BLOCK_CHARS) -> Iterator[str]:
    """Pieces of about ``chars`` characters; their encodings, joined, are that of the text."""
    start = 0
    while len(text) - start > chars:
        place = _CUT.search(text, start + chars)
        if place is None:
            break
        yield text[start : place.start()]
        start = place.start()
    yield text[start:]


_LOADED: dict[tuple[bytes, str], Bpe] = {}


def loaded(rank_file: bytes, pattern: str) -> Bpe:
    """The encoder of this worker process, built once for all its tasks."""
    key = (hashlib.sha256(rank_file).digest(), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(rank_file, pattern)
    return _LOADED[key]


def rank_file(path: str) -> bytes:
    """A tiktoken rank file, read on the driver; its size is checked, as it goes to every task."""
    with open(path, "rb") as file:
        data = file.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path}: over {MAX_RANK_BYTES} bytes")
    return data


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in ``out`` (array<int>); an earlier column of that name is replaced."""
    docs = docs.drop(out) if out in docs.columns else docs
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file(path))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks.value, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for start, end in blocks(texts):
                ids = list(bpe.encode_blocks(texts[start:end]))
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
                rows = batch.slice(start, end - start)
                columns = [*rows.columns, pa.ListArray.from_arrays(offsets, flat)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of ``ids`` in ``out`` (binary); null ids count as none."""
    rows = rows.drop(out) if out in rows.columns else rows
    ranks = rows.sparkSession.sparkContext.broadcast(rank_file(path))
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks.value, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            found = [bpe.decode(np.array(x.as_py() or [], np.int64)) for x in lists]
            columns = [*batch.columns, pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids again, and return both as digests.

    Returns ``key``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space) and
    ``decoded_sha256``; one row per row of ``docs``, repeated keys included.
    """
    docs = narrow(docs, key, text)
    ranks = docs.sparkSession.sparkContext.broadcast(rank_file(path))
    schema = T.StructType(
        [docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
         T.StructField("decoded_sha256", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks.value, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for ids in bpe.encode_blocks(batch.column(1).to_pylist()):
                counts.append(len(ids))
                listed, restored = hashlib.sha256(), hashlib.sha256()
                for at in range(0, len(ids), BLOCK_CHARS):
                    part = ids[at : at + BLOCK_CHARS]
                    listed.update(b" " * (at > 0) + bpe.decimals(part))
                    restored.update(bpe.decode(part))
                of_ids.append(listed.hexdigest())
                of_bytes.append(restored.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)
