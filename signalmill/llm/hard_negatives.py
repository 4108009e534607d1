"""Hard negatives of anchor rows by the threshold algorithm.

Vectors become whole numbers, so scores are exact. A task reads its rows in blocks and keeps one list per
dimension, sorted by component. For an anchor each list is read from the end that its sign prefers; every
row met there is scored whole (random access). The anchor's products with the components read last add up
to a threshold that no unread row can exceed. A window of wanted scores is finished once the threshold lies
strictly below its kth score, or below the window: at equality a smaller id may still be unread. What a task
has found for an anchor bounds its next blocks.

Two passes: the best rows of the anchor's own label (positives), then for each of them the best rows of other
labels whose score lies in the positive's window. Anchors are sent to the tasks in chunks of bounded size; a
task returns as many rows as its anchors have places, whatever it has read.

Rows whose key or label is null, whose vector is null or holds a null or a number that is not finite take no part.
Missing components of shorter vectors count as 0, so an empty vector scores 0. Components are held within
2**25 of zero, so that scores fit a long. Repeated rows count once, as do rows of one key with the same score.
Ties go to the smaller key. A table without anchors gives no row. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.session import reliable
from signalmill.sources.tables import written

#: Components of the anchors sent to the tasks at once, and of the rows that a task sorts at once.
ANCHOR_VALUES, BLOCK_VALUES = 1 << 20, 1 << 20
#: Rows read from each list at first; every further read doubles it.
FIRST_DEPTH = 16
#: Components lie within this distance of zero.
MOST = 1 << 25
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def quantized(vectors: DataFrame, key: str, label: str, vector: str, scale: int, anchors: Column) -> DataFrame:
    """``key``, ``label``, whole components ``q`` and ``is_anchor`` of the rows that take part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    near = lambda v: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), v * F.lit(float(scale))))).cast("int")
    own = F.col(f"`{key}`").cast("long")
    return vectors.where(own.isNotNull() & F.col(f"`{label}`").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select(
        own.alias("key"), F.col(f"`{label}`").alias("label"), F.transform(x, near).alias("q"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    )


class Lists:
    """Rows of a block, and for each dimension the rows in ascending order of their component."""

    def __init__(self, keys: np.ndarray, codes: np.ndarray, values: np.ndarray):
        self.keys, self.codes, self.values = keys, codes, values
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(values, order, 0).T)
        self.order = np.ascontiguousarray(order.T.astype(np.int32))
        self.largest = int(np.abs(values).max(initial=0))
        self.doubles = values.astype(np.float64)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact products: in doubles where every sum is below 2**53."""
        if self.largest * int(np.abs(anchor).max(initial=0)) * len(anchor) < 1 << 53:
            return (self.doubles[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.values[rows].astype(np.int64) @ anchor


class Best:
    """The ``k`` rows of greatest score within [low, high], ties by key; unfilled places are not there."""

    def __init__(self, k: int, low: int = LOWEST, high: int = HIGHEST):
        self.k, self.low, self.high = k, low, high
        self.scores, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def bound(self) -> int:
        """Rows of a lesser score are not wanted."""
        return max(self.low, int(self.scores[-1])) if len(self.scores) == self.k else self.low

    def add(self, scores: np.ndarray, keys: np.ndarray) -> None:
        wanted = np.flatnonzero((scores >= self.bound) & (scores <= self.high))
        if not len(wanted):
            return
        scores, keys = np.concatenate([self.scores, scores[wanted]]), np.concatenate([self.keys, keys[wanted]])
        order = np.lexsort((keys, -scores))
        scores, keys = scores[order], keys[order]
        new = np.ones(len(scores), bool)
        new[1:] = (scores[1:] != scores[:-1]) | (keys[1:] != keys[:-1])
        self.scores, self.keys = scores[new][: self.k], keys[new][: self.k]


def search(lists: Lists, anchor: np.ndarray, taking_part: np.ndarray, windows: list[Best]) -> int:
    """Bring the windows of an anchor up to date with a block; returns how deep its lists were read."""
    n = len(lists.keys)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    anchor = anchor.astype(np.int64)
    if not len(up) and not len(down):  # every score is 0
        rows = np.flatnonzero(taking_part)
        for best in windows:
            best.add(np.zeros(len(rows), np.int64), lists.keys[rows])
        return n
    seen, depth, step = ~taking_part, 0, FIRST_DEPTH
    while depth < n:
        # What is read next, and at depth 0 the first rows: no unread row scores more.
        at = max(depth - 1, 0)
        threshold = int(lists.sorted[up, n - 1 - at].astype(np.int64) @ anchor[up]) + int(lists.sorted[down, at].astype(np.int64) @ anchor[down])
        if all(threshold < best.bound for best in windows):
            break
        upto = min(n, depth + step)
        before = seen.copy()
        seen[lists.order[up, n - upto : n - depth]] = True
        seen[lists.order[down, depth:upto]] = True
        rows = np.flatnonzero(seen & ~before)
        if len(rows):
            scores, keys = lists.scores(rows, anchor), lists.keys[rows]
            for best in windows:
                best.add(scores, keys)
        depth, step = upto, 2 * step
    return depth


def _gathered(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.Table]:
    """Rows in blocks of about BLOCK_VALUES components."""
    most, waiting, rows = max(1, BLOCK_VALUES // max(1, dims)), [], 0
    for batch in batches:
        for at in range(0, len(batch), most):
            part = batch.slice(at, most)
            if rows and rows + len(part) > most:
                yield pa.Table.from_batches(waiting)
                waiting, rows = [], 0
            waiting.append(part)
            rows += len(part)
    if rows:
        yield pa.Table.from_batches(waiting)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Lists as rows of ``dims`` numbers, shorter ones filled up with 0; what goes beyond has no use."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims), np.int32)
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = place < dims
    out[row[kept], place[kept]] = flat[kept]
    return out


class Anchors:
    """A chunk of anchors as arrays, in a fixed order; goes to the tasks."""

    def __init__(self, rows: pa.Table):
        self.dims = int(pc.max(pc.list_value_length(rows["q"])).as_py() or 0)
        self.keys = rows["key"].to_numpy()
        self.labels = rows["label"].combine_chunks().unique()
        self.codes = pc.index_in(rows["label"], self.labels).to_numpy().astype(np.int64)
        self.values = _matrix(rows["q"], self.dims)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[Lists]:
        for block in _gathered(batches, self.dims):
            codes = pc.fill_null(pc.index_in(block["label"], self.labels), -1).to_numpy().astype(np.int64)
            yield Lists(block["key"].to_numpy(), codes, _matrix(block["q"], self.dims))


def _positives(rows: DataFrame, sent, k: int) -> DataFrame:
    """(``anchor``, ``key``, ``score``): the first ``k`` rows of each anchor's label, from 1 by ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = sent.value
        best = [Best(k) for _ in chunk.keys]
        for lists in chunk.blocks(batches):
            for i, found in enumerate(best):
                part = lists.codes == chunk.codes[i]
                own = np.flatnonzero(part & (lists.keys == chunk.keys[i]))
                part[own[(lists.values[own] == chunk.values[i]).all(axis=1)]] = False
                search(lists, chunk.values[i], part, [found])
        at = np.repeat(np.arange(len(best)), [len(b.keys) for b in best])
        for a in range(0, len(at), 1 << 16):
            part = slice(a, a + (1 << 16))
            columns = [at, np.concatenate([b.keys for b in best]), np.concatenate([b.scores for b in best])]
            yield pa.RecordBatch.from_arrays([pa.array(c[part], pa.int64()) for c in columns], names=["anchor", "key", "score"])

    found = rows.mapInArrow(run, "anchor long, key long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "key")
    return found.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k).distinct()


def _negatives(rows: DataFrame, sent, positives, k: int, share: tuple[int, int]) -> DataFrame:
    """The result of a chunk: the first ``k`` rows of other labels in each positive's window."""
    low, high = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, (at, keys, scores) = sent.value, positives.value
        # Whole scores: the window's ends are rounded inwards.
        best = [Best(k, -(-low * s // 100), high * s // 100) for s in scores.tolist()]
        first = np.searchsorted(at, np.arange(len(chunk.keys) + 1))
        for lists in chunk.blocks(batches):
            for i in range(len(chunk.keys)):
                windows = [b for b in best[first[i] : first[i + 1]] if b.low <= b.high]
                if windows:
                    search(lists, chunk.values[i], lists.codes != chunk.codes[i], windows)
        for a in range(0, len(best), 1 << 12):
            part = best[a : a + (1 << 12)]
            of = np.repeat(np.arange(a, a + len(part)), [len(b.keys) for b in part])
            columns = [
                of, chunk.keys[at[of]], keys[of], np.concatenate([b.keys for b in part]), scores[of],
                np.concatenate([b.scores for b in part]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    names = ["window", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    found = rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    order = Window.partitionBy("window").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).distinct()
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(
    vectors: DataFrame, anchors: Column, key: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90), scale: int = 256,
    anchor_values: int = ANCHOR_VALUES,
) -> DataFrame:
    """Hard negatives of the rows that ``anchors`` marks, searched for among all rows.

    A row's score is the product of its components and the anchor's, each floor(``scale`` * x). An anchor's positives are the first
    ``positives`` other rows of its label; for each, the first ``negatives`` rows of other labels whose score lies
    between ``share`` percent of the positive's are returned: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``,
    ``positive_score``, ``negative_score``. ``key`` is a whole number, ``label`` of any simple type.
    """
    spark = vectors.sparkSession
    rows = quantized(vectors, key, label, vector, scale, anchors)
    chosen = reliable(rows.where("is_anchor").drop("is_anchor").distinct())
    rows = rows.drop("is_anchor")
    values = chosen.agg(F.sum(F.size("q") + 2)).head()[0]
    chunks = -(-values // anchor_values) if values else 0
    marked = chosen.withColumn("chunk", F.pmod(F.xxhash64("key", "label", "q"), F.lit(max(1, chunks))))
    out = []
    for i in range(chunks):
        # At most about anchor_values components come to the driver at once, and as many places of positives.
        own = marked.where(F.col("chunk") == i).drop("chunk").toArrow()
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast(Anchors(own))
        found = _positives(rows, sent, positives).select("anchor", "place", "key", "score").toArrow().sort_by([("anchor", "ascending"), ("place", "ascending")])
        if not found.num_rows:
            continue
        places = spark.sparkContext.broadcast(tuple(found[c].to_numpy() for c in ("anchor", "key", "score")))
        result = _negatives(rows, sent, places, negatives, share)
        out.append(written(result, "hard-negatives") if chunks > 1 else result)
    if not out:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], schema)
    return functools.reduce(DataFrame.unionByName, out)
