"""Balanced building blocks against plain models."""

import random
from datetime import UTC, datetime, timedelta

import models
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalmill.operators import cep, skew
from signalmill.operators.logs import log_streams

START = datetime(2024, 1, 1, tzinfo=UTC)


@pytest.mark.parametrize("leaf_rows", [1_000_000, 50, 1])
def test_quantiles_are_exact_at_any_refinement(spark, leaf_rows):
    rng = random.Random(5)
    groups = {"hot": [rng.lognormvariate(0, 3) for _ in range(3000)], "same": [2.5] * 400, "one": [-1.0],
              "mixed": [rng.choice([-1e9, 0.0, 1e-9, 7.0]) for _ in range(300)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    ps = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["g"]: r for r in skew.exact_quantiles(df, ["g"], "v", ps, slots=16, leaf_rows=leaf_rows).collect()}
    for g, vs in groups.items():
        for name, p in ps.items():
            assert got[g][name] == pytest.approx(models.quantile(vs, p), rel=1e-12, abs=1e-15), (g, name)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e300, 1e300), min_size=1, max_size=60), st.floats(0, 1))
def test_quantile_of_any_floats(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = skew.exact_quantiles(df, [], "v", {"q": p}, slots=4, leaf_rows=1).head()["q"]
    assert got == pytest.approx(models.quantile(values, p), rel=1e-9, abs=1e-300)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert skew.exact_quantiles(df, ["g"], "v", {"q": 0.5}).collect() == []


def test_nth_flagged(spark):
    rng = random.Random(9)
    rows = [("g" if rng.random() < 0.5 else f"g{rng.randrange(3)}", rng.randrange(300), i, rng.random() < 0.4) for i in range(800)]
    df = spark.createDataFrame(
        [(g, START + timedelta(seconds=s), i, f) for g, s, i, f in rows], "g string, at timestamp, rid long, f boolean"
    )
    for nth in (1, 7, 10_000):
        wanted = df.select("g").distinct().withColumn("nth", F.lit(nth).cast("long"))
        got = {r["g"]: (r["rid"], r["position"]) for r in skew.nth_flagged(df, ["g"], "at", "rid", F.col("f"), wanted, "10s").collect()}
        want = {}
        for g in {r[0] for r in rows}:
            ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
            hits = [(r[2], i + 1) for i, r in enumerate(ordered) if r[3]]
            if len(hits) >= nth:
                want[g] = hits[nth - 1]
        assert got == want


def test_previous_value_across_buckets(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else "b", rng.randrange(900), i, rng.choice([True, False, None])) for i in range(500)]
    df = spark.createDataFrame(
        [(k, START + timedelta(seconds=s), i, v) for k, s, i, v in rows], "k string, at timestamp, rid long, v boolean"
    )
    got = {r["rid"]: r["prev"] for r in skew.previous_value(df, ["k"], "at", "rid", "v", "prev").collect()}
    last = {}
    for k, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        assert got[i] == last.get(k)
        last[k] = v


def test_broadcast_only_below_the_limit(spark):
    df = spark.range(100)
    assert "broadcast" in skew.checked_broadcast(df, 1000)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in skew.checked_broadcast(df, 10)._jdf.queryExecution().logical().toString().lower()


def test_hot_log_stream_is_paged(spark):
    rows = [("api", "INFO", START + timedelta(seconds=i), f"line {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "service_name string, severity string, timestamp timestamp, body string")
    pages = log_streams(df, page_rows=70).orderBy("page_start").collect()
    assert len(pages) > 4 and all(len(p["entries"]) <= 70 for p in pages)
    assert [e["body"] for p in pages for e in p["entries"]] == [r[3] for r in rows]


@pytest.mark.parametrize("leaf_rows", [1_000_000, 5])
def test_steps_shrink_for_hot_buckets(spark, leaf_rows):
    rng = random.Random(1)
    rows = [("g", rng.randrange(3_000_000), i, rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(
        [(g, START + timedelta(microseconds=us), i, f) for g, us, i, f in rows], "g string, at timestamp, rid long, f boolean"
    )
    assert skew.fitting_step(df, ["g"], "at", "1s", leaf_rows) == (1_000_000 if leaf_rows > 300 else 1_000)
    wanted = df.select("g").distinct().withColumn("nth", F.lit(90).cast("long"))
    got = skew.nth_flagged(df, ["g"], "at", "rid", F.col("f"), wanted, "1s", leaf_rows).head()
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    hits = [(r[2], i + 1) for i, r in enumerate(ordered) if r[3]]
    assert (got["rid"], got["position"]) == hits[89]


def test_equal_times_are_split_by_id(spark):
    rows = [("a", 0, 3 * i, i % 3 == 0) for i in range(600)] + [("b", i, 10_000 + i, True) for i in range(20)]
    df = spark.createDataFrame([(k, START + timedelta(seconds=s), i, f) for k, s, i, f in rows], "k string, at timestamp, rid long, f boolean")
    width = skew.fitting_ids(df, ["k"], "at", "rid", 1, 50)
    sizes = df.where("k = 'a'").groupBy(skew.id_slot("rid", width)).count().agg(F.max("count")).head()[0]
    assert width and sizes <= 50 and skew.fitting_ids(df, ["k"], "at", "rid", 1, 600) == 0
    got = {r["rid"]: r["n"] for r in cep.sliding_rate(df, ["k"], F.col("f"), "1m", "1m", "at", "rid", leaf_rows=50).collect()}
    assert got == {**{3 * i: i // 3 + 1 for i in range(600)}, **{10_000 + i: i + 1 for i in range(20)}}
    got = {r["rid"]: r["p"] for r in skew.previous_value(df, ["k"], "at", "rid", "rid", "p", leaf_rows=50).collect()}
    assert all(got[3 * i] == (3 * (i - 1) if i else None) for i in range(600))
    wanted = spark.createDataFrame([("a", 150)], "k string, nth long")
    found = skew.nth_flagged(df, ["k"], "at", "rid", F.col("f"), wanted, "1s", 50).head()
    assert (found["rid"], found["position"]) == (3 * 447, 448)
