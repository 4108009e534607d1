"""Quality rules: fixed counts of a text, and a calibrated n-gram classifier trained on labelled rows.

The counts decide first. What passes them is judged by logistic regression on hashed word and character
n-grams, whose probabilities are calibrated (Platt) on labelled rows that it was not fitted on. Every
whole text is scored in Arrow batches against a fixed threshold.

Nulls are empty texts: they have no words and fail the counts. Rows without a label, with a null label or
without a text take no part in the training, and a key that repeats is learnt from once. Where labels of both classes are missing there is no
classifier: every score is 1 and the counts alone decide. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.llm.common import blocks, least_hashes, mix, narrow, runs_of
from signalmill.llm.linear import BUCKETS, FAMILIES, Block, fit, platt

#: Labelled rows that the classifier is fitted on (half of each class) and calibrated on, at most.
FIT_ROWS, CALIBRATION_ROWS = 2000, 2000
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_FROM = 10, 20, 0.5
REPEAT_WIDTH = 5
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, block: Block) -> np.ndarray:
        z = block.linear(self.weights) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -500, 500)))


def counts(block: Block) -> dict[str, np.ndarray]:
    """The counts of every text of a block."""
    text_of_word = np.repeat(np.arange(block.n), np.diff(block.first_word))
    out = {"n_words": np.diff(block.first_word)}
    chars = np.bincount(text_of_word, block.word_end - block.word_start, block.n)
    out["word_chars"] = chars.astype(np.int64)
    symbol = np.isin(block.points, np.array([ord(c) for c in SYMBOLS], np.uint32))
    sums = np.concatenate([[0], np.cumsum(symbol)])
    out["n_symbols"] = sums[block.offsets[1:]] - sums[block.offsets[:-1]]

    # Lines: the parts between line ends; those with a word that equal an earlier one of their text.
    ends = np.flatnonzero(block.points == 10)
    starts = np.sort(np.concatenate([block.offsets[:-1], ends + 1]))
    stops = np.sort(np.concatenate([ends, block.offsets[1:]]))
    filled = np.searchsorted(block.word_start, stops) > np.searchsorted(block.word_start, starts)
    # A line start and a text's first place sort alike, so starts and stops pair up in order.
    line_text = np.repeat(np.arange(block.n), 1 + np.diff(np.searchsorted(ends, block.offsets)))
    starts, stops, line_text = starts[filled], stops[filled], line_text[filled]
    line_hash = mix(block.hash.of(starts, stops) ^ mix(line_text.astype(np.uint64)))
    own = lambda i: (int(line_text[i]), block.points[starts[i] : stops[i]].tobytes())
    line = same_groups(line_hash, lambda i, j: (line_text[i] == line_text[j]) & same_spans(block.points, starts, stops, i, j), own)
    out["n_dup_lines"] = _repeats(line, line_text, block.n)

    width = REPEAT_WIDTH
    covered = np.zeros(len(block.words) + 1, np.int64)
    if len(block.words) >= width:
        first = np.arange(len(block.words) - width + 1)
        first = first[text_of_word[first] == text_of_word[first + width - 1]]
        gram = mix(runs_of(block.words, width)[first] ^ mix(text_of_word[first].astype(np.uint64)))

        def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = text_of_word[first[i]] == text_of_word[first[j]]
            for k in range(width):
                out &= same_spans(block.points, block.word_start, block.word_end, first[i] + k, first[j] + k)
            return out

        def own(i: int) -> tuple:
            at = range(first[i], first[i] + width)
            return int(text_of_word[first[i]]), *(block.points[block.word_start[w] : block.word_end[w]].tobytes() for w in at)

        gram = same_groups(gram, same, own)
        _, inverse, times = np.unique(gram, return_inverse=True, return_counts=True)
        twice = first[times[inverse] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + width, -1)
    inside = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.bincount(text_of_word, inside, block.n).astype(np.int64)
    return out


def same_spans(points: np.ndarray, starts: np.ndarray, stops: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the characters of spans ``i`` are those of spans ``j``."""
    sizes = stops[i] - starts[i]
    out = sizes == stops[j] - starts[j]
    wide = np.flatnonzero(out & (sizes > 0))
    if len(wide):
        n = sizes[wide]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = points[np.repeat(starts[i[wide]], n) + at] == points[np.repeat(starts[j[wide]], n) + at]
        out[wide] = np.logical_and.reduceat(equal, first)
    return out


def same_groups(hashes: np.ndarray, same: Callable, own: Callable) -> np.ndarray:
    """Numbers that are equal for equal things only: hashes tell most apart, equal ones are compared (``same``).

    Where a hash turns out to stand for several things, each is named by itself (``own``).
    """
    _, first, group, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[group] > 1)
    differ = shared[~same(shared, first[group[shared]])]
    if len(differ):
        names: dict = {}
        for i in np.flatnonzero(np.isin(group, group[differ])).tolist():
            group[i] = len(first) + names.setdefault(own(i), len(names))
    return group


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    n, repeated = found["n_words"], found["n_repeat_words"]
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)


def _repeats(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each text its keys less its distinct keys; equal keys belong to one text."""
    distinct, first = np.unique(keys, return_index=True)
    return np.bincount(text, minlength=n) - np.bincount(text[first], minlength=n)


def sample(labels: DataFrame, rows: int, key: str, label: str) -> DataFrame:
    """At most ``rows`` labelled keys, chosen by hash; a key with several labels takes the least."""
    known = labels.select(key, label).dropna()
    marked = least_hashes(known, [key], rows, known.count()).withColumn("_h", F.xxhash64(F.col(key).cast("string")))
    return marked.orderBy("_h", key, label).limit(rows).groupBy(key).agg(F.min(label).alias(label))


def fold(key: str):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def one_text_each(rows: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """One of the texts of each key, by hash: a key that is repeated is learnt from once."""
    least = F.min_by(F.struct(text, label), F.struct(F.xxhash64(text), F.col(text))).alias("_least")
    return rows.groupBy(key).agg(least).select(key, f"_least.{text}", f"_least.{label}")


def training_rows(docs: DataFrame, chosen: DataFrame, key: str, text: str, label: str) -> tuple[list, np.ndarray]:
    """Features and labels of a bounded choice of rows, ordered by key; features of the whole texts are computed on the executors.

    Rows that the counts reject are left out: the classifier only judges what passes them.
    """
    docs = narrow(docs, key, text).where(F.col(text).isNotNull())
    rows = one_text_each(docs.join(F.broadcast(chosen), key), key, text, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in blocks(texts):
                block, part = Block(texts[start:end]), batch.slice(start, end - start)
                found = block.features()
                rows = pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2),
                        pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()),
                        pa.array([s.astype("<f4").tobytes() for _, s in found], pa.binary()),
                    ],
                    names=["key", "label", "place", "share"],
                )
                yield rows.filter(pa.array(~base_failed(counts(block))))

    schema = T.StructType(
        [T.StructField("key", docs.schema[key].dataType), T.StructField("label", chosen.schema[label].dataType),
         T.StructField("place", T.BinaryType()), T.StructField("share", T.BinaryType())]
    )
    found = sorted(rows.mapInArrow(run, schema).collect(), key=lambda r: (r["key"], r["label"], bytes(r["place"])))
    features = [(np.frombuffer(r["place"], "<i4"), np.frombuffer(r["share"], "<f4").astype(float)) for r in found]
    return features, np.array([int(r["label"]) for r in found], int)


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS,
) -> Model | None:
    """Fitted on keys whose crc32 modulo 3 is 0, calibrated on those where it is 2; the others are left for tests."""
    own = labels.where(fold(key) == 0)
    half = fit_rows // 2
    chosen = [sample(own.where(F.col(label) == side), half, key, label) for side in (0, 1)]
    rest = sample(labels.where(fold(key) == 2).where(F.col(label).isin(0, 1)), calibration_rows, key, label)
    tagged = chosen[0].unionByName(chosen[1]).groupBy(key).agg(F.min(label).alias(label)).withColumn("_fit", F.lit(10))
    both = tagged.unionByName(rest.withColumn("_fit", F.lit(0)))
    both = both.select(key, (F.col(label) + F.col("_fit")).cast("int").alias(label))
    rows, code = training_rows(docs, both, key, text, label)
    fitting = code >= 10
    y = code[fitting] - 10
    if len(set(y.tolist())) < 2:
        return None
    weights, bias = fit([r for r, f in zip(rows, fitting) if f], y, BUCKETS * FAMILIES)
    w, b = (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0])
    held = [r for r, f in zip(rows, fitting) if not f]
    z = np.array([float(r[1] @ w[r[0]]) + b for r in held])
    truth = code[~fitting]
    if len(set(truth.tolist())) < 2:  # too few rows to calibrate apart
        z, truth = np.array([float(r[1] @ w[r[0]]) + b for r, f in zip(rows, fitting) if f]), y
    return Model(w.astype(np.float32), b, *platt(z, truth))


def judge(
    docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", keep_from: float = KEEP_FROM,
    keep_columns: bool = False,
) -> DataFrame:
    """``key``, the counts, ``base_failed``, ``score`` and ``kept`` of every row, or with ``keep_columns`` the rows kept."""
    rows = docs if keep_columns else narrow(docs, key, text)
    at = rows.columns.index(text)
    # Bounded: the weights have BUCKETS * FAMILIES numbers whatever the input.
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()),
               T.StructField("kept", T.BooleanType())]
    schema = rows.schema if keep_columns else T.StructType([rows.schema[key], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for start, end in blocks(texts):
                block = Block(texts[start:end])
                found = counts(block)
                failed = base_failed(found)
                score = own.score(block) if own is not None else np.ones(block.n)
                kept = ~failed & (score >= keep_from)
                part = batch.slice(start, end - start)
                if keep_columns:
                    yield part.filter(pa.array(kept))
                    continue
                columns = [part.column(0), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)]
                columns += [pa.array(failed), pa.array(score), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
