"""Anomaly scores per metric series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.operators.ewma import ALPHA, ewma_baseline, zscore

# Detector defaults.
WARMUP = 50
Z_THRESHOLD = 3.0

_KEYS = ["tenant_id", "metric_name"]


def anomaly_zscore(
    df: DataFrame,
    alpha: float = ALPHA,
    warmup: int = WARMUP,
    z: float = Z_THRESHOLD,
    init: DataFrame | None = None,
    row_id: str = "signal_id",
    state: bool = False,
) -> DataFrame:
    """Score of each sample against its series' baseline including that sample.

    Because the sample is part of its own baseline, |score| stays below sqrt((1 - alpha) / alpha);
    larger thresholds never fire. ``state`` also returns the baseline's variance and count.
    """
    rows = ewma_baseline(
        df.select(*_KEYS, "timestamp", "value", row_id), _KEYS, "value", "timestamp", row_id, alpha, init
    )
    scored = rows.withColumn("score", zscore(F.col("value"), F.col("mean"), F.col("var"), F.col("n"), warmup))
    return scored.select(
        *_KEYS, "timestamp", "value", row_id, "score",
        F.col("mean").alias("baseline"),
        F.lit(float(z)).alias("threshold"),
        (F.abs("score") >= z).alias("anomaly"),
        *(["mean", "var", "n"] if state else []),
    )


def feature_vector(features: str | Column = "features", value: str | Column = "value") -> Column:
    """The feature array, or ``[value]`` where there is none; an empty array stays empty."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.coalesce(col(features), F.array(col(value).cast("double")))


def score_model(
    df: DataFrame,
    loader: Callable[[], Callable[[np.ndarray], np.ndarray]],
    width: int,
    threshold: float,
    features: str = "features",
) -> DataFrame:
    """Adds ``score``, ``anomaly`` and ``score_error`` from a user model.

    ``loader`` runs once per task and returns a function from a float32 matrix (rows, width) to one
    score per row. Vectors are cut or zero-padded to ``width``. If the model fails on a batch, its
    rows are retried one by one and only those that fail again carry the error.
    """

    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loader()
        for part in parts:
            matrix = np.stack(part.to_numpy()) if len(part) else np.zeros((0, width), dtype="float32")
            try:
                scores = np.asarray(model(matrix), dtype="float64").reshape(len(part))
                errors: list[str | None] = [None] * len(part)
            except Exception:
                scores, errors = np.full(len(part), np.nan), [None] * len(part)
                for i in range(len(part)):
                    try:
                        scores[i] = float(np.asarray(model(matrix[i : i + 1])).reshape(1)[0])
                    except Exception as exc:
                        errors[i] = str(exc)
            yield pd.DataFrame({"score": scores, "error": errors})

    result = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])
    predict = F.pandas_udf(batches, result)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.lit(width))
    given = F.coalesce(F.col(features).cast("array<float>"), F.array().cast("array<float>"))
    fitted = F.slice(F.concat(F.transform(given, lambda x: F.coalesce(x, F.lit(0.0).cast("float"))), zeros), 1, width)
    out = df.withColumn("_p", predict(fitted))
    failed = F.col("_p.error").isNotNull()
    return (
        out.withColumn("score", F.when(~failed, F.col("_p.score")))
        .withColumn("anomaly", F.coalesce(F.col("score") >= threshold, F.lit(False)))
        .withColumn("score_error", F.col("_p.error"))
        .drop("_p")
    )


def model_counts(scored: DataFrame) -> DataFrame:
    """Samples, anomalies and errors of a scored frame."""
    return scored.agg(
        F.count("*").alias("samples"),
        F.count_if("anomaly").alias("anomalies"),
        F.count("score_error").alias("errors"),
    )


def onnx_loader(path: str, output_index: int = 0) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Loader for an ONNX model file that every executor can read; one column of its first output."""

    def load():
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name

        def predict(matrix: np.ndarray) -> np.ndarray:
            out = np.asarray(session.run(None, {name: matrix})[0]).reshape(len(matrix), -1)
            column = output_index if 0 <= output_index < out.shape[1] else 0
            return out[:, column]

        return predict

    return load
