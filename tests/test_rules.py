"""Sliding-window rules against ring-buffer models."""

import random
from datetime import UTC, datetime, timedelta

import models
import pytest
from pyspark.sql import functions as F

from signalmill.operators import cep

START = datetime(2024, 1, 1, tzinfo=UTC)


def frame(spark, rows, extra):
    data = [(t, s, START + timedelta(seconds=sec), rid, v) for (t, s), sec, rid, v in rows]
    return spark.createDataFrame(
        data, f"tenant_id string, service_name string, event_time timestamp, signal_id long, {extra}"
    )


def random_rows(seed, n, value, hot=0.4, horizon=3600):
    """A third and more of the rows on one key, many of them in one minute and second."""
    rng = random.Random(seed)
    rows = []
    for rid in range(n):
        key = ("t0", "hot") if rng.random() < hot else (f"t{rng.randrange(2)}", f"s{rng.randrange(3)}")
        second = 600 if rng.random() < 0.2 else rng.randrange(horizon)
        rows.append((key, second, rid, value(rng)))
    return rows


@pytest.mark.parametrize("window", [1, 5])
def test_sliding_rate_equals_ring(spark, window):
    rows = random_rows(1, 1500, lambda r: r.random() < 0.3)
    df = frame(spark, rows, "is_error boolean")
    got = cep.sliding_rate(df, cep.KEYS, F.col("is_error"), f"{window}m").collect()
    want = models.sliding_counts(rows, window)
    assert {r["signal_id"]: r["n"] for r in got} == want
    assert all(r["rate"] == pytest.approx(r["n"] / (window * 60)) for r in got)


@pytest.mark.parametrize("seed,window,threshold", [(2, 5, 0.05), (3, 3, 0.02), (4, 1, 0.05), (5, 5, 1 / 300)])
def test_error_edges_equal_ring(spark, seed, window, threshold):
    rows = random_rows(seed, 1200, lambda r: r.random() < 0.15)
    got = cep.high_error_rate(frame(spark, rows, "is_error boolean"), f"{window}m", threshold).collect()
    want = models.error_edges(rows, window, threshold)
    assert want
    assert {r["signal_id"] for r in got} == set(want)
    for r in got:
        assert (r["error_rate"], r["error_ratio"], r["total_rate"]) == pytest.approx(want[r["signal_id"]])


@pytest.mark.parametrize("seed,window,threshold", [(6, 5, 900.0), (7, 2, 700.0), (8, 1, 500.0)])
def test_latency_edges_equal_ring(spark, seed, window, threshold):
    rows = random_rows(seed, 800, lambda r: round(r.random() * 1000, 1))
    got = cep.high_latency(frame(spark, rows, "duration_ms double"), f"{window}m", threshold).collect()
    want = models.latency_edges(rows, window, threshold)
    assert want
    assert {r["signal_id"]: r["peak_latency"] for r in got} == want


def test_burst_fires_once_per_service(spark):
    rows = [(("acme", "api"), 0, i, True) for i in range(100)]
    rows += [(("acme", "db"), 1, 100 + i, True) for i in range(100)]
    got = cep.high_error_rate(frame(spark, rows, "is_error boolean"), "1m", 1.0).collect()
    assert sorted((r["service_name"], r["signal_id"]) for r in got) == [("api", 59), ("db", 159)]


def test_latency_fires_on_the_first_slow_span_only(spark):
    rows = [(("acme", "api"), i, i, 100.0 + i) for i in range(10)]
    rows += [(("acme", "api"), 10, 10, 750.0), (("acme", "api"), 11, 11, 800.0), (("acme", "log"), 12, 12, None)]
    got = cep.high_latency(frame(spark, rows, "duration_ms double"), "1m", 500.0).collect()
    assert [(r["signal_id"], r["peak_latency"]) for r in got] == [(10, 750.0)]


def test_counts_leave_the_window(spark):
    rows = [(("a", "s"), 0, i, True) for i in range(5)] + [(("a", "s"), 180, 5, True)]
    got = cep.sliding_rate(frame(spark, rows, "is_error boolean"), cep.KEYS, F.col("is_error"), "2m").collect()
    assert {r["signal_id"]: r["n"] for r in got}[5] == 1


def test_first_rule_wins(spark):
    rows = frame(spark, [(("a", "s"), 0, 1, 2000.0), (("a", "s"), 1, 2, 10.0)], "duration_ms double")
    rows = rows.withColumn("is_error", F.lit(True))
    errors = cep.high_error_rate(rows, "1m", 1 / 60)
    slow = cep.high_latency(rows, "1m", 1000.0)
    got = cep.rule_engine([(cep.HIGH_ERROR_RATE, errors), (cep.HIGH_LATENCY, slow)]).collect()
    assert [(r["signal_id"], r["event_type"]) for r in got] == [(1, cep.HIGH_ERROR_RATE)]
    got = cep.rule_engine([(cep.HIGH_LATENCY, slow), (cep.HIGH_ERROR_RATE, errors)]).collect()
    assert [(r["signal_id"], r["event_type"]) for r in got] == [(1, cep.HIGH_LATENCY)]


def test_thresholds_must_be_positive(spark):
    rows = frame(spark, [(("a", "s"), 0, 1, True)], "is_error boolean")
    with pytest.raises(ValueError):
        cep.high_error_rate(rows, "1m", 0)
