"""Benchmark decontamination by SimHash windows of an item's size.

Every benchmark item has a SimHash of its five-word shingles. In each document, windows of exactly the
item's size slide by one word; their SimHashes come from running sums of the shingles' bits. Tables of
bit blocks find every item within ``radius`` bits of a window: of BLOCKS blocks one at least differs in
no more than radius // BLOCKS bits. A candidate is a leak if the weighted Jaccard similarity of its
shingles (each shingle counted as often as it occurs) and the item's is ``similarity`` or more.

A window can only reach the similarity if it shares shingles with the item, so windows are placed around
shared ones; all others are left out before their SimHash is computed, which loses none.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Items of fewer than five
words have one shingle, all their words, and match documents that hold these words in a row. Null or
wordless texts and items match nothing. Repeated rows give repeated results once per id. An item's id may be of any
simple type; items without an id are searched for like others and reported together under a null id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from signalmill.llm.common import SpanHash, blocks, narrow, runs_of, spans, text_bytes

#: Bytes of benchmark texts that one broadcast may hold; larger benchmarks are worked off in parts.
BENCHMARK_BYTES = 16 << 20
#: Bit blocks of a 64-bit fingerprint, and the largest distance that they find.
BLOCKS, RADIUS = 8, 23
_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum() or _c >= 128:
        _CLASS[_c] = _c + 32 if 65 <= _c <= 90 else _c


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and end byte of every word of the texts, and each text's first word (n + 1 numbers)."""
    low = _CLASS[data]
    starts, ends = spans(low > 0, offsets[1:-1])
    return SpanHash(low).of(starts, ends), starts, ends, np.searchsorted(starts, offsets)


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def simhash(hashes: np.ndarray) -> np.uint64:
    counts = bits_of(hashes).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


class HammingBlocks:
    """Fingerprints by the value of each bit block, with all values a block may have within its share of the radius."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, n_blocks: int = BLOCKS):
        self.prints, self.radius, self.n_blocks = prints, radius, n_blocks
        self.width = 64 // n_blocks
        values = np.arange(1 << self.width, dtype=np.uint64)
        self.tables = []
        for b in range(n_blocks):
            own = self._block(prints, b)
            near = np.bitwise_count(values[:, None] ^ own[None, :]) <= radius // n_blocks
            value, item = np.nonzero(near)
            self.tables.append((np.searchsorted(value, np.arange(len(values) + 1)), item))

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) index pairs within the radius, each once: it shows in the first block that holds it."""
        out = []
        share = self.radius // self.n_blocks
        for b, (first, item) in enumerate(self.tables):
            value = self._block(queries, b).astype(np.int64)
            n = first[value + 1] - first[value]
            q = np.repeat(np.arange(len(queries)), n)
            i = item[np.repeat(first[value] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            differ = queries[q] ^ self.prints[i]
            ok = np.bitwise_count(differ) <= self.radius
            for earlier in range(b):
                ok &= np.bitwise_count(self._block(differ, earlier)) > share
            out.append((q[ok], i[ok]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


class Benchmark:
    """Items with equally many words share a window size and its block tables."""

    def __init__(self, items: list[tuple[int, str | None]], width: int, similarity: float, radius: int):
        self.width, self.similarity, self.radius = width, similarity, radius
        by_size: dict[int, list[tuple[int, np.ndarray, Counter]]] = {}
        for item_id, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            hashes, starts, ends, _ = words_of(data, np.array([0, len(data)]))
            if len(hashes):
                n = min(width, len(hashes))
                spelt = _CLASS[data].tobytes()
                bag = bag_of([spelt[a:b] for a, b in zip(starts.tolist(), ends.tolist())], n)
                by_size.setdefault(len(hashes), []).append((item_id, runs_of(hashes, n), bag))
        self.sizes = []
        for size, group in sorted(by_size.items()):
            prints = np.array([simhash(s) for _, s, _ in group], np.uint64)
            self.sizes.append((size, group, HammingBlocks(prints, radius)))
        # By shingle width: shingles of the items and, in step, the sizes (places in self.sizes) that have them.
        self.known = {}
        for n in sorted({min(width, size) for size in by_size}):
            own = [
                (s, np.full(len(s), k)) for k, (size, group, _) in enumerate(self.sizes)
                if min(width, size) == n for _, s, _ in group
            ]
            pairs = np.unique(np.rec.fromarrays([np.concatenate(c) for c in zip(*own)], names="shingle,size"))
            self.known[n] = (pairs["shingle"].copy(), pairs["size"].copy())

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item id, similarity, first word, words) of the best window of each text and item."""
        hashes, starts, ends, first_word = words_of(data, offsets)
        for n, (known, size_of) in self.known.items():
            shingles = runs_of(hashes, n)
            lo = np.searchsorted(known, shingles)
            where = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == shingles)
            text = np.searchsorted(first_word, where, side="right") - 1
            inside = where + n <= first_word[text + 1]
            where, text = where[inside], text[inside]
            first, last = lo[where], np.searchsorted(known, shingles[where], side="right")
            times = last - first
            at = np.repeat(np.arange(len(where)), times)
            size = size_of[first[at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)]
            order = np.lexsort((where[at], size, text[at]))
            at, size = at[order], size[order]
            group = np.flatnonzero((np.diff(text[at], prepend=-1) != 0) | (np.diff(size, prepend=-1) != 0))
            for a, b in zip(group, [*group[1:], len(at)]):
                t = int(text[at[a]])
                begin, end = int(first_word[t]), int(first_word[t + 1])

                def spelt(w: int, size: int, begin: int = begin) -> list[bytes]:
                    spans = zip(starts[begin + w : begin + w + size], ends[begin + w : begin + w + size])
                    return [_CLASS[data[s:e]].tobytes() for s, e in spans]

                found = self._in_text(int(size[a]), shingles[begin : end - n + 1], where[at[a:b]] - begin, n, spelt)
                for item_id, value, w, words in found:
                    yield t, item_id, value, w, words

    def _in_text(self, k: int, shingles, hits, n: int, spelt) -> Iterator[tuple[int, float, int, int]]:
        size, group, tables = self.sizes[k]
        each = size - n + 1  # shingles of a window
        # Similarity s of two bags of equal size needs 2 s / (1 + s) of their shingles to be shared.
        least = max(1, int(np.ceil(2 * self.similarity * each / (1 + self.similarity) - 1e-9)))
        if len(shingles) < each or len(hits) < least:
            return
        reach = np.flatnonzero(hits[least - 1 :] - hits[: len(hits) - least + 1] < each)
        if not len(reach):
            return
        # Windows that hold hits[k] to hits[k + least - 1], for every such k.
        low = np.maximum(hits[reach + least - 1] - each + 1, 0)
        high = np.minimum(hits[reach], len(shingles) - each)
        low = np.maximum(low, np.concatenate([[0], np.maximum.accumulate(high)[:-1] + 1]))
        wide = np.maximum(high - low + 1, 0)
        window = np.repeat(low - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))
        best: dict[int, tuple[float, int]] = {}
        for at in range(0, len(window), 1024):
            part = window[at : at + 1024]
            lo, hi = int(part[0]), int(part[-1]) + each
            if hi - lo <= 4 * (len(part) + each):  # close together: differences of running sums
                sums = np.zeros((hi - lo + 1, 64), np.int32)
                np.cumsum(bits_of(shingles[lo:hi]), axis=0, out=sums[1:])
                counts = sums[part - lo + each] - sums[part - lo]
            else:
                counts = np.stack([bits_of(shingles[w : w + each]).sum(axis=0, dtype=np.int64) for w in part])
            prints = np.packbits(counts * 2 > each, axis=1, bitorder="little").view(np.uint64)[:, 0]
            for q, i in zip(*tables.near(prints)):
                w = int(part[q])
                if best.get(i, (0.0, 0))[0] < 1.0:
                    value = weighted(bag_of(spelt(w, size), n), group[i][2])
                    if value >= self.similarity and value > best.get(i, (0.0, 0))[0]:
                        best[i] = (value, w)
        for i, (value, w) in best.items():
            yield group[i][0], value, w, size


def bag_of(words: list[bytes], n: int) -> Counter:
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def weighted(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    shared = (a & b).total()
    total = a.total() + b.total() - shared
    return shared / total if total else 0.0


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", width: int = 5, similarity: float = 0.8, radius: int = RADIUS,
) -> DataFrame:
    """One row for each document and item that it holds: key, item, similarity, first word and words of the best window.

    The benchmark's size is checked: beyond BENCHMARK_BYTES its items are dealt over several passes.
    """
    narrowed = narrow(docs, key, text)
    schema = T.StructType(
        [docs.schema[key], T.StructField(item, benchmark.schema[item].dataType), T.StructField("similarity", T.DoubleType()),
         T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]
    )

    item_kind = to_arrow_type(benchmark.schema[item].dataType)

    def listed(bench: Benchmark, ids: list, batch: pa.RecordBatch, start: int, end: int) -> pa.RecordBatch:
        column = batch.column(1).slice(start, end - start)
        rows, items, *rest = zip(*found) if (found := list(bench.leaks(*text_bytes(column)))) else ((), (), (), (), ())
        keys = batch.column(0).slice(start, end - start).take(pa.array(rows, pa.int64()))
        names = pa.array([ids[i] for i in items], item_kind)
        kinds = (pa.float64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([keys, names, *(pa.array(c, k) for c, k in zip(rest, kinds))], names=schema.names)

    found = None
    for sent in _parts(benchmark, item, item_text):
        one = narrowed.mapInArrow(_on_blocks(sent, width, similarity, radius, 1, listed), schema)
        found = one if found is None else found.unionByName(one)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("at"), "n_words")).alias("_best")
    return found.groupBy(key, item).agg(best).select(
        key, item, "_best.similarity", (-F.col("_best.at")).alias("first_word"), "_best.n_words"
    )


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = 5, similarity: float = 0.8, radius: int = RADIUS,
) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item."""

    def clean(bench: Benchmark, ids: list, batch: pa.RecordBatch, start: int, end: int) -> pa.RecordBatch:
        rows = batch.slice(start, end - start)
        kept = np.ones(end - start, bool)
        kept[[found[0] for found in bench.leaks(*text_bytes(rows.column(at)))]] = False
        return rows.filter(pa.array(kept))

    at = docs.columns.index(text)
    for sent in _parts(benchmark, item, item_text):
        docs = docs.mapInArrow(_on_blocks(sent, width, similarity, radius, at, clean), docs.schema)
    return docs


def _parts(benchmark: DataFrame, item: str, item_text: str) -> list:
    """The items, as broadcasts of BENCHMARK_BYTES on average at most: the benchmark is a stated query set."""
    items = narrow(benchmark, item, item_text).where(F.col(f"`{item_text}`").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length(item_text))).head()[0] or 0
    parts = max(1, -(-int(size) // BENCHMARK_BYTES))
    sent = []
    for p in range(parts):
        own = items.where(F.pmod(F.xxhash64(item, item_text), F.lit(parts)) == p) if parts > 1 else items
        # An item's own id may be of any type, null, or that of several items: here it goes by its number.
        rows = sorted(own.collect(), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
        sent.append(benchmark.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [(i, r[1]) for i, r in enumerate(rows)])))
    return sent


def _on_blocks(sent, width: int, similarity: float, radius: int, at: int, fn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = None
        for batch in batches:
            names, items = sent.value
            bench = bench or Benchmark(items, width, similarity, radius)
            for start, end in blocks(batch.column(at).to_pylist()):
                out = fn(bench, names, batch, start, end)
                if out.num_rows:
                    yield out

    return run
