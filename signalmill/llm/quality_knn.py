"""Quality by nearest neighbours among labelled documents in a latent-semantic space.

A text's terms (hashed character n-grams, words and word pairs) are counted over the whole text; the
roots of their shares, weighted by rarity, are projected on the leading singular vectors of a bounded
sample of labelled texts. The sample's vectors and labels are broadcast. Every document's cosines with
all of them are computed in blocks, exactly; its NEIGHBOURS nearest vote, weighted by similarity, and
texts that tie with the last of them vote too.

Labels are learnt from keys whose crc32 modulo 3 is not 1. Empty and null texts, and texts without a
positive similarity, score the share of good ones among the sample; without any label all score 0.5.
Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.llm.common import blocks, narrow
from signalmill.llm.linear import Block
from signalmill.llm.quality_rules import fold, one_text_each, sample

#: Terms by family, dimensions of the space, labelled rows in it at most, neighbours that vote.
TERMS, DIMENSIONS, LABELLED_ROWS, NEIGHBOURS = (2048, 512, 512), 48, 3000, 15
#: Cosines that differ by less are ties: equal vectors may differ in the last bits of a product.
TIE = 1e-6
#: Documents whose cosines are held at a time.
COSINE_BLOCK = 512


@dataclass(frozen=True)
class Space:
    projection: np.ndarray  # terms by dimensions, rarity included
    vectors: np.ndarray  # labelled rows by dimensions, of length one or zero
    labels: np.ndarray

    def scores(self, terms: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(terms), prior)
        if not len(self.labels):
            return out
        found = unit(terms @ self.projection)
        nth = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(found), COSINE_BLOCK):
            cosine = np.maximum(found[at : at + COSINE_BLOCK] @ self.vectors.T, 0)
            last = np.partition(cosine, -nth, axis=1)[:, -nth, None]
            weight = np.where(cosine >= last - TIE, cosine, 0)
            total = weight.sum(axis=1)
            some = total > 0
            out[at : at + COSINE_BLOCK][some] = (weight @ self.labels)[some] / total[some]
        return np.clip(out, 0.0, 1.0)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(length > 0, length, 1)).astype(np.float32)


def term_shares(texts: list[str | None]) -> np.ndarray:
    """Roots of the shares of each term within its family, one row per text."""
    block = Block(texts)
    out = []
    for size, (buckets, first) in zip(TERMS, block.grams()):
        times = np.diff(first)
        owner = np.repeat(np.arange(block.n), times)
        # The least bucket is that of repeated words: it stays alone.
        term = np.where(buckets == 0, 0, 1 + buckets % (size - 1))
        counts = np.bincount(owner * size + term, minlength=block.n * size).reshape(block.n, size)
        out.append(np.sqrt(counts / np.maximum(times, 1)[:, None]))
    return np.concatenate(out, axis=1).astype(np.float32)


def fit_space(terms: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 7) -> Space:
    """Leading singular vectors by subspace iteration."""
    if not len(labels):
        return Space(np.zeros((sum(TERMS), 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    rarity = np.log((1 + len(terms)) / (1 + (terms > 0).sum(axis=0))) + 1
    weighted = terms * rarity.astype(np.float32)
    rank = min(dimensions, *weighted.shape)
    basis = np.random.default_rng(seed).standard_normal((weighted.shape[1], rank)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    projection = (rarity[:, None] * basis).astype(np.float32)
    return Space(projection, unit(terms @ projection), labels.astype(np.float32))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    labelled_rows: int = LABELLED_ROWS,
) -> Space:
    """The space of at most ``labelled_rows`` labelled texts; their terms are counted on the executors."""
    chosen = sample(labels.where(fold(key) != 1).where(F.col(label).isin(0, 1)), labelled_rows, key, label)
    rows = one_text_each(narrow(docs, key, text).where(F.col(text).isNotNull()).join(F.broadcast(chosen), key), key, text, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in blocks(texts):
                part = batch.slice(start, end - start)
                packed = [row.tobytes() for row in term_shares(texts[start:end])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(packed, pa.binary())], names=["key", "label", "terms"]
                )

    schema = T.StructType(
        [T.StructField("key", docs.schema[key].dataType), T.StructField("label", chosen.schema[label].dataType),
         T.StructField("terms", T.BinaryType())]
    )
    found = sorted(rows.mapInArrow(run, schema).collect(), key=lambda r: (r["key"], bytes(r["terms"])))
    terms = np.stack([np.frombuffer(r["terms"], np.float32) for r in found]) if found else np.zeros((0, sum(TERMS)))
    return fit_space(terms, np.array([r["label"] for r in found]))


def score(docs: DataFrame, space: Space, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every row."""
    docs = narrow(docs, key, text)
    # Bounded: at most LABELLED_ROWS vectors of DIMENSIONS numbers, and the projection.
    sent = docs.sparkSession.sparkContext.broadcast(space)
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in blocks(texts):
                found = own.scores(term_shares(texts[start:end])).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(found)], names=schema.names)

    scored = docs.mapInArrow(run, schema)
    return scored.select(
        key, F.coalesce(fold(key) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
