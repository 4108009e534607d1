"""Exponentially weighted baselines per series, exact in row order.

    m' = m + a (x - m)          v' = (1 - a) (v + a (x - m)^2)          first sample: m = x, v = 0

Both are first-order recurrences, so a stretch of rows folded on its own can be placed behind any state. With q = 1 - a, a
stretch of t rows whose first value is c, its own fold (m, v), and the true state (M, V) before it, D = M - c:

    state after it:  m + q^t D          v + q^t V - 2 q^t (m - c) D + q^t (1 - q^t) D^2

Rows are cut into chunks by key and time. A first pass folds the value column of each chunk and leaves one row per chunk; a
scan over those rows gives the state before each chunk; the second pass starts every chunk from that state, which travels as
the row before the chunk's first. A series holding a third of all rows is therefore folded by as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.time import bucket_number
from signalmill.operators.skew import LEAF_ROWS, fitting_ids, fitting_step, id_slot

# Baseline defaults.
ALPHA = 0.05
MIN_SAMPLES = 30
MIN_STDDEV = 1e-9

_STATE = ["mean", "var", "n"]
_CHUNK = ["_b", "_i"]


def ewma_baseline(
    df: DataFrame,
    keys: list[str],
    value: str,
    time: str,
    row_id: str,
    alpha: float = ALPHA,
    init: DataFrame | None = None,
    before: bool = False,
    chunk_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Adds ``mean``, ``var`` and ``n`` after each row (and ``mean_before`` … with ``before``).

    ``init`` (keys, mean, var, n) continues from saved baselines. Rows with a null value are left
    out, as they are no samples. Rows of equal time and id follow each other by value.

    A chunk is a day of a key, or as much less as ``chunk_rows`` needs. Python sees numbers only; all
    other columns stay in Spark's rows.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    width = fitting_step(rows, keys, time, "1d", chunk_rows)
    ids = fitting_ids(rows, keys, time, row_id, width, chunk_rows)
    rows = rows.withColumns(
        {"_b": bucket_number(F.col(time), timedelta(microseconds=width)), "_i": id_slot(row_id, ids)}
        | {f"_{c}0": F.lit(None).cast("double") for c in _STATE}
    )
    order = [time, row_id, value]
    narrow = rows.select(*dict.fromkeys([*keys, *_CHUNK, *order]), *[f"_{c}0" for c in _STATE])
    ends = (
        _folded(narrow, keys, value, order, alpha)
        .groupBy(*keys, *_CHUNK)
        .agg(
            F.max_by(F.struct("_f.mean", "_f.var", "_f.n"), "_number").alias("_end"),
            F.min_by(F.col(value).cast("double"), "_number").alias("_first"),
        )
        .select(*keys, *_CHUNK, "_end.*", "_first")
    )
    entered = _entered(ends, keys, alpha, init)
    both = rows.unionByName(entered, allowMissingColumns=True)
    state = _folded(both, keys, value, order, alpha).where(F.col("_n0").isNull())
    out = [F.col("_f.mean"), F.col("_f.var"), F.col("_f.n").cast("long").alias("n")]
    if before:
        out += [F.col(f"_f.{c}_before").cast("long" if c == "n" else "double").alias(f"{c}_before") for c in _STATE]
    return state.select(*[F.col(c) for c in df.columns], *out)


def _folded(rows: DataFrame, keys: list[str], value: str, order: list[str], alpha: float) -> DataFrame:
    """Each chunk folded in its order, from the state in its first row if there is one.

    The window sorts a chunk and numbers its rows; the fold reads them in that order. It is declared
    nondeterministic, so that no later filter is moved below it.
    """
    in_order = Window.partitionBy(*keys, *_CHUNK).orderBy(F.col("_n0").isNull(), *order)
    numbered = rows.withColumn("_number", F.row_number().over(in_order))
    fold = F.pandas_udf(
        _folder(alpha), ", ".join(f"{c} double" for c in [*_STATE, *[f"{c}_before" for c in _STATE]])
    ).asNondeterministic()
    return numbered.withColumn("_f", fold("_number", F.col(value).cast("double"), *[F.col(f"_{c}0") for c in _STATE]))


def _folder(alpha: float):
    q = 1.0 - alpha

    def fold(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        last = (0.0, 0.0, 0.0)
        for number, value, mean0, var0, n0 in batches:
            start, seeded = number.to_numpy() == 1, n0.notna().to_numpy()
            x = np.where(seeded, mean0, value).astype("float64")
            v0 = np.where(seeded, var0, 0.0).astype("float64")
            first_n = np.where(seeded, n0, 1.0).astype("float64")
            # The chunk that the last batch left open goes on from its last row.
            open_rows = int(len(start) > 0 and not start[0])
            if open_rows:
                start = np.concatenate([[True], start])
                x, v0, first_n = (np.concatenate([[s], a]) for s, a in zip(last, (x, v0, first_n), strict=True))
            chunk = pd.Series(np.cumsum(start))
            mean = _ewm(pd.Series(x), chunk, alpha)
            earlier = np.where(start, x, np.roll(mean, 1))
            var = _ewm(pd.Series(np.where(start, v0, q * (x - earlier) ** 2)), chunk, alpha)
            head = np.flatnonzero(start)[chunk.to_numpy() - 1]
            n = first_n[head] + (np.arange(len(x)) - head)
            out = pd.DataFrame(
                {
                    "mean": mean, "var": var, "n": n, "mean_before": earlier,
                    "var_before": np.where(start, 0.0, np.roll(var, 1)), "n_before": np.where(start, 0.0, n - 1),
                }
            )
            if len(out):
                last = (mean[-1], var[-1], n[-1])
            yield out.iloc[open_rows:]

    return fold


def _entered(ends: DataFrame, keys: list[str], alpha: float, init: DataFrame | None) -> DataFrame:
    """The state before each chunk that has one: a scan over one row per key and chunk.

    A key's rows are read by one task; their number depends on its time range and the width of a chunk.
    """
    if init is not None:
        saved = init.select(*keys, *[F.col(c).cast("double").alias(c) for c in _STATE])
        ends = ends.unionByName(saved, allowMissingColumns=True)
    in_order = Window.partitionBy(*keys).orderBy(F.col("_first").isNotNull(), *_CHUNK)
    scan = F.pandas_udf(_scanner(1.0 - alpha), ", ".join(f"{c} double" for c in _STATE)).asNondeterministic()
    before = ends.withColumn("_number", F.row_number().over(in_order)).withColumn(
        "_s", scan("_number", *_STATE, "_first")
    )
    return before.where(F.col("_first").isNotNull() & F.col("_s.n").isNotNull()).select(
        *keys, *_CHUNK, *[F.col(f"_s.{c}").alias(f"_{c}0") for c in _STATE]
    )


def _scanner(q: float):
    def scan(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        state = None
        for columns in batches:
            before = []
            for number, mean, var, n, first in zip(*[c.tolist() for c in columns], strict=True):
                if number == 1:
                    state = None
                before.append(state or (None, None, None))
                # Saved baselines have no first value: they are a state, not a stretch.
                state = (mean, var, n) if state is None else _advance(state, (mean, var, n, first), q)
            yield pd.DataFrame(before, columns=_STATE, dtype="float64")

    return scan


def _ewm(series: pd.Series, stretch: pd.Series, alpha: float) -> np.ndarray:
    return series.groupby(stretch, sort=False).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def fold_on(values: np.ndarray, state: tuple[float, float, int] | None, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variance and count after each of ``values``, folded in their order from ``state``, or from nothing."""
    x = np.concatenate([[state[0]], values]) if state else values
    v0, n0 = (state[1], state[2]) if state else (0.0, 1)
    one = pd.Series(np.zeros(len(x), np.int8))
    mean = _ewm(pd.Series(x, dtype="float64"), one, alpha)
    change = np.concatenate([[v0], (1 - alpha) * (x[1:] - mean[:-1]) ** 2])
    var, count = _ewm(pd.Series(change), one, alpha), n0 + np.arange(len(x))
    skip = 1 if state else 0
    return mean[skip:], var[skip:], count[skip:]


def _advance(state, fold, q):
    """State after a stretch that follows ``state``."""
    m, v, t, first = fold
    qt = q**t
    delta = state[0] - first
    mean = m + qt * delta
    var = v + qt * state[1] - 2 * qt * (m - first) * delta + qt * (1 - qt) * delta * delta
    return mean, max(var, 0.0), state[2] + t


def zscore(x: Column, mean: Column, var: Column, n: Column, min_samples: int) -> Column:
    """Standardised deviation; 0 while the baseline is young or flat."""
    std = F.sqrt(var)
    return F.when((n < min_samples) | (std < MIN_STDDEV), F.lit(0.0)).otherwise((x - mean) / std)


def latency_zscore(
    df: DataFrame,
    keys: list[str],
    value: str,
    time: str,
    row_id: str,
    alpha: float = ALPHA,
    init: DataFrame | None = None,
) -> DataFrame:
    """Adds ``z`` of each value against the baseline before it, and the baseline after it."""
    state = ewma_baseline(df, keys, value, time, row_id, alpha, init, before=True)
    z = zscore(F.col(value), F.col("mean_before"), F.col("var_before"), F.col("n_before"), MIN_SAMPLES)
    return state.withColumn("z", z).drop("mean_before", "var_before", "n_before")


def final_baselines(state: DataFrame, keys: list[str]) -> DataFrame:
    """Last (mean, var, n) per key; ``n`` grows with every row, so it orders them."""
    return (
        state.groupBy(*keys)
        .agg(F.max_by(F.struct(*_STATE), "n").alias("_s"))
        .select(*keys, "_s.mean", "_s.var", "_s.n")
    )


def save_baselines(state: DataFrame, keys: list[str], path: str) -> None:
    """Write baselines as (keys, m, v, n), one file set per call."""
    final_baselines(state, keys).select(
        *keys, F.col("mean").alias("m"), F.col("var").alias("v"), "n"
    ).write.mode("overwrite").parquet(path)


def load_baselines(spark, path: str) -> DataFrame:
    """Saved baselines in the form ``init`` takes."""
    saved = spark.read.parquet(path)
    return saved.withColumnsRenamed({"m": "mean", "v": "var"})
