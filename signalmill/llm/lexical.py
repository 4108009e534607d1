"""Ranked lexical search by presence masks.

Every whole text becomes a row of an index: its number of terms and, of the terms that the searched items use,
their numbers and occurrences. The index gives the corpus counts (documents, terms, documents of a term), and
is then read in blocks. In a block each term has a bitmap of the documents that hold it; an item's bitmaps laid
across each other give every document's mask of matched terms, and documents are grouped by mask. A mask cannot
score more than the sum of its terms' greatest scores in the block, so masks are evaluated from the greatest
such sum on, until it falls below the item's kth score (at equality a smaller id may still win). What a
task has found for an item bounds its next blocks; a task returns ``k`` rows an item at most.

Null texts have no term, as have empty ones; they never score, and do not count as documents. Repeated
rows are documents like any other. Equal scores are ordered by key, null keys last. Repeated items (same id
and text) count once; items that share an id are searched for one by one. Null items and those without
a term find nothing. Whole items are sent to the tasks in chunks of bounded size. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.llm.common import narrow
from signalmill.session import reliable
from signalmill.sources.tables import written

#: Bytes of items sent to the tasks at once, and of a text taken apart at once.
ITEM_BYTES, PART_BYTES = 1 << 20, 4 << 20
#: Bytes of bitmaps that a block remembers.
BITMAP_BYTES = 32 << 20
#: Documents scored at a time, at first; doubled while masks go on.
FIRST_DOCS = 64
#: What separates terms: the ASCII characters that are no letter or digit. Only A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SEPARATOR = b" "


def term_parts(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    start = 0
    while len(data) - start > PART_BYTES:
        cut = data.find(SEPARATOR, start + PART_BYTES)
        if cut < 0:
            break
        yield data[start:cut].split(SEPARATOR)
        start = cut
    yield data[start:].split(SEPARATOR)


def index(docs: DataFrame, terms: dict[bytes, int], key: str, text: str) -> DataFrame:
    """``key``, ``n`` (terms with repeats), ``terms`` (numbers of those in ``terms``, ascending) and ``tfs`` of every text with a term."""
    docs = narrow(docs, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # of the items of a chunk: bounded by ITEM_BYTES
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("terms", numbers), T.StructField("tfs", numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in batches:
            counts, terms, tfs, sizes = [], [], [], []
            for value in batch.column(1):
                n, found = 0, Counter()
                for words in term_parts(value.as_py()):
                    n += len(words) - words.count(b"")
                    found.update(map(number, words))
                found.pop(None, None)
                own = sorted(found)
                counts.append(n)
                terms += own
                tfs += map(found.__getitem__, own)
                sizes.append(len(own))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, tfs)]
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *lists], names=schema.names)
            yield rows.filter(pa.array([n > 0 for n in counts], pa.bool_()))

    return docs.mapInArrow(run, schema)


class Items:
    """Items of a chunk: distinct term numbers, and how often each occurs in the item."""

    def __init__(self, texts: list[str | None]):
        self.terms: dict[bytes, int] = {}
        self.of: list[tuple[np.ndarray, np.ndarray]] = []
        for text in texts:
            found = Counter(w for words in term_parts(text) for w in words if w)
            numbers = [self.terms.setdefault(w, len(self.terms)) for w in found]
            self.of.append((np.array(numbers, np.int64), np.array(list(found.values()), np.int64)))


class Block:
    """Documents of an index block: postings by document and by term, with their scores for one occurrence in an item."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, documents: int, length: int):
        self.n_docs = len(batch)
        lists = batch.column(2)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        self.first = offsets - offsets[0]
        self.term = lists.flatten().to_numpy().astype(np.int64)
        tf = batch.column(3).flatten().to_numpy().astype(np.int64)
        m = 75 + (25 * batch.column(1).to_numpy() * documents) // length
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self.score = weights[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[self.doc]))
        order = np.argsort(self.term, kind="stable")
        self.by_term = self.doc[order]
        self.term_first = np.searchsorted(self.term[order], np.arange(len(weights) + 1))
        self.best = np.zeros(len(weights), np.int64)
        np.maximum.at(self.best, self.term, self.score)
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, term: int) -> np.ndarray:
        """One byte a document: whether it holds the term."""
        if term not in self.bitmaps:
            held = np.zeros(self.n_docs, np.uint8)
            held[self.by_term[self.term_first[term] : self.term_first[term + 1]]] = 1
            if len(self.bitmaps) * self.n_docs > 8 * BITMAP_BYTES:
                self.bitmaps.clear()
            self.bitmaps[term] = np.packbits(held)
        return np.unpackbits(self.bitmaps[term], count=self.n_docs)

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct masks (rows of 0 and 1, one column a term), documents grouped by mask, and where the groups start."""
        packed = np.packbits(np.stack([self.bitmap(t) for t in terms.tolist()]), axis=0).T
        names = np.ascontiguousarray(packed).view(f"V{packed.shape[1]}").ravel()
        if packed.shape[1] <= 8:  # a mask of up to 64 terms is a number
            wide = np.zeros((len(packed), 8), np.uint8)
            wide[:, : packed.shape[1]] = packed
            names = wide.view(np.uint64).ravel()
        order = np.argsort(names, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = names[order[1:]] != names[order[:-1]]
        starts = np.flatnonzero(new)
        return np.unpackbits(packed[order[starts]], axis=1, count=len(terms)), order, starts

    def scores(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Scores of documents for an item that holds each term so many ``times``."""
        sizes = self.first[docs + 1] - self.first[docs]
        at = np.repeat(self.first[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        sums = np.concatenate([[0], np.cumsum(times[self.term[at]] * self.score[at])])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


class Best:
    """The ``k`` greatest scores above 0, ties by key, null keys last."""

    def __init__(self, k: int):
        self.k, self.found = k, []

    @property
    def bound(self) -> int:
        return -self.found[-1][0] if len(self.found) == self.k else 1

    def add(self, scores: np.ndarray, keys: list) -> None:
        bound = self.bound
        rows = [(-s, key is None, key if key is not None else 0, key) for s, key in zip(scores.tolist(), keys) if s >= bound]
        self.found = sorted(self.found + rows)[: self.k]


def rank_block(block: Block, keys: pa.Array, terms: np.ndarray, times: np.ndarray, best: Best, occurrences: np.ndarray) -> int:
    """Bring an item's best documents up to date with a block; returns how many documents were scored.

    ``occurrences`` is a vector of zeros over all terms, and is left so.
    """
    if not len(terms):
        return 0
    held, order, starts = block.masks(terms)
    most = held.astype(np.int64) @ (times * block.best[terms])
    ends = np.append(starts[1:], len(order))
    by_most = np.argsort(-most, kind="stable")
    by_most = by_most[most[by_most] > 0]
    occurrences[terms] = times
    sizes = np.cumsum((ends - starts)[by_most])
    at, step, scored = 0, FIRST_DOCS, 0
    while at < len(by_most) and most[by_most[at]] >= best.bound:
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + step, side="right")))
        chosen = by_most[at:upto]
        chosen = chosen[most[chosen] >= best.bound]
        docs = np.concatenate([order[starts[g] : ends[g]] for g in chosen.tolist()])
        scores = block.scores(docs, occurrences)
        wanted = np.flatnonzero(scores >= best.bound)
        best.add(scores[wanted], keys.take(pa.array(docs[wanted])).to_pylist())
        scored += len(docs)
        at, step = upto, 2 * step
    occurrences[terms] = 0
    return scored


def _ranked(postings: DataFrame, items: Items, weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(``item``, ``key``, ``score``, ``rank``) of a chunk's items."""
    sent = postings.sparkSession.sparkContext.broadcast((items.of, weights))
    key_type = postings.schema["key"].dataType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("key", key_type), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, weights = sent.value
        best, occurrences, kind = [Best(k) for _ in of], np.zeros(len(weights), np.int64), pa.null()
        for batch in batches:
            if not len(batch):
                continue
            kind = batch.schema.types[0]
            block = Block(batch, weights, documents, length)
            for (terms, times), found in zip(of, best):
                rank_block(block, batch.column(0), terms, times, found, occurrences)
        rows = [(i, key, -s) for i, b in enumerate(best) for s, _, _, key in b.found]
        for at in range(0, len(rows), 1 << 14):
            item, key, score = zip(*rows[at : at + (1 << 14)])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(key, kind), pa.array(score, pa.int64())], names=schema.names)

    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return postings.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame, queries: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The ``k`` documents of greatest score above 0 for each item: ``item``, ``rank`` from 1, ``key``, ``score``.

    A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))); a document's score is the sum over the item's terms,
    repeats included, of w * ((10**9 tf) div (1000 tf + 12 m)), with m = 75 + ((25 n N) div L).
    """
    spark = docs.sparkSession
    own = reliable(queries.select(F.col(f"`{item}`").alias("item"), F.coalesce(f"`{item_text}`", F.lit("")).alias("text")).distinct())
    size = own.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    chunks = -(-size // item_bytes)
    marked = own.withColumn("chunk", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, chunks))))
    names = [(item, F.col("name")), ("rank", F.col("rank")), (key, F.col("key")), ("score", F.col("score"))]
    out = []
    for i in range(chunks):
        # At most about item_bytes of items come to the driver at once.
        rows = marked.where(F.col("chunk") == i).select("item", "text").toArrow()
        items = Items(rows["text"].to_pylist())
        if not items.terms:
            continue
        postings = written(index(docs, items.terms, key, text), "postings")
        documents, length = postings.agg(F.count("*"), F.sum("n")).head()
        if not documents:
            continue
        df = np.zeros(len(items.terms), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # terms of the chunk
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        found = _ranked(postings, items, weights, documents, length, k)
        ids = T.StructType([T.StructField("number", T.LongType()), T.StructField("name", queries.schema[item].dataType)])
        named = spark.createDataFrame(list(enumerate(rows["item"].to_pylist())), ids)
        found = found.join(F.broadcast(named), F.col("item") == F.col("number")).select(*[c.alias(n) for n, c in names])
        out.append(written(found, "ranked") if chunks > 1 else found)
    if not out:
        kinds = [queries.schema[item].dataType, T.IntegerType(), docs.schema[key].dataType, T.LongType()]
        return spark.createDataFrame([], T.StructType([T.StructField(n, t) for (n, _), t in zip(names, kinds)]))
    return functools.reduce(DataFrame.unionByName, out)
