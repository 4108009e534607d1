"""Baselines, sampling, anomalies and model scores against folds."""

import math
import random
from datetime import UTC, datetime, timedelta

import models
import numpy as np
import pytest
from pyspark.sql import functions as F

from signalmill.operators import anomaly, ewma, sampling

START = datetime(2024, 1, 1, tzinfo=UTC)


def series(spark, values):
    """values: {key: [x, ...]}; all keys share the time range, ids are unique."""
    rows, rid = [], 0
    for key, xs in values.items():
        for i, x in enumerate(xs):
            rows.append((key, START + timedelta(seconds=i), rid, x))
            rid += 1
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "k string, at timestamp, rid long, x double")


def by_key(rows, key="k"):
    out = {}
    for r in sorted(rows, key=lambda r: r["rid"]):
        out.setdefault(r[key], []).append(r)
    return out


@pytest.fixture(scope="module")
def values():
    rng = random.Random(11)
    out = {"hot": [1e6 + rng.gauss(0, 50) for _ in range(6000)], "one": [5.0], "flat": [3.0] * 200}
    out |= {f"k{i}": [rng.expovariate(0.01) for _ in range(rng.randrange(1, 90))] for i in range(30)}
    return out


@pytest.mark.parametrize("chunk_rows", [1_000_000, 50])
def test_hot_series_is_split_and_exact(spark, values, chunk_rows):
    df = series(spark, values)
    state = ewma.ewma_baseline(df, ["k"], "x", "at", "rid", 0.05, before=True, chunk_rows=chunk_rows)
    got = by_key(state.collect())
    for key, xs in values.items():
        for r, (before, after) in zip(got[key], models.ewma(xs, 0.05), strict=True):
            assert (r["mean"], r["n"]) == (pytest.approx(after[0], rel=1e-12), after[2])
            assert r["var"] == pytest.approx(after[1], rel=1e-7, abs=1e-9)
            assert r["n_before"] == before[2]
            if before[2]:
                assert r["mean_before"] == pytest.approx(before[0], rel=1e-12)
                assert r["var_before"] == pytest.approx(before[1], rel=1e-7, abs=1e-9)


@pytest.mark.parametrize("chunk_rows", [1_000_000, 50])
def test_saved_baselines_continue(spark, values, chunk_rows):
    df = series(spark, values)
    cut = F.lit(START + timedelta(seconds=40))

    def state(rows, init=None):
        return ewma.ewma_baseline(rows, ["k"], "x", "at", "rid", init=init, chunk_rows=chunk_rows)

    saved = ewma.final_baselines(state(df.where(F.col("at") < cut)), ["k"])
    whole = {r["rid"]: r for r in state(df).collect()}
    rest = state(df.where(F.col("at") >= cut), saved).collect()
    assert len(rest) == df.where(F.col("at") >= cut).count()
    for r in rest:
        want = whole[r["rid"]]
        assert (r["mean"], r["n"]) == (pytest.approx(want["mean"], rel=1e-12), want["n"])
        assert r["var"] == pytest.approx(want["var"], rel=1e-6, abs=1e-9)


def test_chunks_of_one_instant_are_split_by_id(spark, values):
    xs = values["hot"][:400]
    df = spark.createDataFrame([("a", START, i, x) for i, x in enumerate(xs)], "k string, at timestamp, rid long, x double")
    got = by_key(ewma.ewma_baseline(df, ["k"], "x", "at", "rid", chunk_rows=64).collect())["a"]
    for r, (_, after) in zip(got, models.ewma(xs, 0.05), strict=True):
        assert (r["mean"], r["n"]) == (pytest.approx(after[0], rel=1e-12), after[2])


def test_null_keys_and_filters_above(spark):
    df = spark.createDataFrame(
        [(k, START + timedelta(days=i), i, float(i)) for k in (None, "b") for i in range(5)],
        "k string, at timestamp, rid long, x double",
    )
    state = ewma.ewma_baseline(df, ["k"], "x", "at", "rid", 0.5)
    late = state.where(F.col("at") >= F.lit(START + timedelta(days=3))).orderBy("k", "rid").collect()
    assert [(r["k"], r["rid"], r["n"]) for r in late] == [(None, 3, 4), (None, 4, 5), ("b", 3, 4), ("b", 4, 5)]
    assert state.where("rid = 4").count() == 2


def test_null_values_are_no_samples(spark):
    df = spark.createDataFrame(
        [("a", START + timedelta(seconds=i), i, x) for i, x in enumerate([1.0, None, float("nan"), 3.0])],
        "k string, at timestamp, rid long, x double",
    )
    got = ewma.ewma_baseline(df, ["k"], "x", "at", "rid", 0.5).orderBy("rid").collect()
    assert [(r["rid"], r["mean"], r["n"]) for r in got] == [(0, 1.0, 1), (3, 2.0, 2)]


def test_zscore_needs_history_and_spread(spark):
    got = by_key(
        ewma.latency_zscore(series(spark, {"a": [80.0 + i % 40 for i in range(60)] + [5000.0], "flat": [1.0] * 60}),
                            ["k"], "x", "at", "rid").collect()
    )
    assert all(r["z"] == 0 for r in got["a"][:30]) and all(r["z"] == 0 for r in got["flat"])
    assert 10 * got["a"][60]["z"] > 50


def test_baselines_of_tenants_are_separate(spark):
    rows = [("a", "m", START + timedelta(seconds=i), i, 100.0) for i in range(20)]
    rows += [("b", "m", START + timedelta(seconds=i), 100 + i, 5000.0) for i in range(20)]
    rows += [("a", "m", START + timedelta(seconds=30), 200, 100.0), ("b", "m", START + timedelta(seconds=30), 201, 100.0)]
    df = spark.createDataFrame(rows, "tenant_id string, metric_name string, timestamp timestamp, signal_id long, value double")
    got = anomaly.anomaly_zscore(df, warmup=10, z=2.0).where("anomaly").collect()
    assert [r["signal_id"] for r in got] == [201]


def test_outlier_fires_once(spark):
    xs = [90.0 + i % 20 for i in range(50)] + [10_000.0]
    rows = [("t", "m", START + timedelta(seconds=i), i, x) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "tenant_id string, metric_name string, timestamp timestamp, signal_id long, value double")
    got = anomaly.anomaly_zscore(df, warmup=30, z=3.0).where("anomaly").collect()
    assert [r["signal_id"] for r in got] == [50]
    assert 3 <= got[0]["score"] < math.sqrt(0.95 / 0.05)


def spans(spark, rows):
    data = [
        (tenant, "api", trace, START + timedelta(seconds=sec), rid, "TRACE", sev, ms, attrs)
        for tenant, trace, sec, rid, sev, ms, attrs in rows
    ]
    return spark.createDataFrame(
        data,
        "tenant_id string, service_name string, trace_id string, event_time timestamp, signal_id long, type string, "
        "severity string, duration_ms double, attributes map<string,string>",
    )


def test_score_weights(spark):
    rows = [("t", "a", 0, 0, "ERROR", 1500.0, {}), ("t", "b", 1, 1, "", 10.0, {"parent_sampled": "true"}),
            ("t", "c", 2, 2, "", None, {})]
    got = {r["signal_id"]: r["score"] for r in sampling.trace_score(spans(spark, rows), ("api",)).collect()}
    assert got == {0: 170.0, 1: 45.0, 2: 20.0}


@pytest.mark.parametrize("seed,rate,size", [(1, 0.2, 20), (2, 0.05, 10), (3, 1.0, 5), (4, 0.5, 8)])
def test_decisions_equal_queue_model(spark, seed, rate, size):
    rng = random.Random(seed)
    rows, second = [], 0
    for rid in range(400):
        second += rng.choice([0, 1, 30, 200])
        trace = "hot" if rng.random() < 0.3 else f"tr{rng.randrange(60)}"
        rows.append((f"t{rng.randrange(2)}", trace, second, rid, "ERROR" if rng.random() < 0.05 else "", 1.0, {}))
    scored = sampling.trace_score(spans(spark, rows), ())
    got = {r["signal_id"]: r["keep"] for r in sampling.sample_decision(scored, rate, size).collect()}
    for tenant in ("t0", "t1"):
        mine = [(tr, sec, rid, 100.0 if sev else 0.0) for t, tr, sec, rid, sev, _, _ in rows if t == tenant]
        for rid, keep in models.sampler(mine, rate, size, 300).items():
            assert got[rid] == keep


def test_features_fall_back_to_the_value(spark):
    df = spark.createDataFrame(
        [(None, 1.5), ([10.0, 20.0, 30.0], 0.0), ([], 7.0)], "features array<double>, value double"
    )
    got = [r[0] for r in df.select(anomaly.feature_vector()).collect()]
    assert got == [[1.5], [10.0, 20.0, 30.0], []]


def test_model_pads_cuts_and_reports_errors(spark):
    def load():
        def model(matrix):
            if np.any(matrix[:, 0] == 99):
                raise RuntimeError("bad row")
            return matrix.sum(axis=1)

        return model

    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 50.0]), (3, [99.0]), (4, None)], "id int, features array<double>")
    scored = anomaly.score_model(df, load, 2, 3.0)
    got = {r["id"]: (r["score"], r["anomaly"], r["score_error"]) for r in scored.collect()}
    assert got == {1: (1.0, False, None), 2: (3.0, True, None), 3: (None, False, "bad row"), 4: (0.0, False, None)}
    assert anomaly.model_counts(scored).head().asDict() == {"samples": 4, "anomalies": 1, "errors": 1}
