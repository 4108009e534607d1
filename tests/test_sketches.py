"""Sketches against exact forms, and lookups that open few rows."""

import random
from datetime import UTC, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from signalmill.functions.time import micros
from signalmill.operators import select, series, stats, traces
from signalmill.sources import tables

START = datetime(2024, 1, 1, tzinfo=UTC)


def metric_rows(spark, n=6000):
    rng = random.Random(3)
    values = [rng.choice([rng.gauss(0, 1), rng.gauss(50, 9), 7.0]) for _ in range(n)] + [None, float("nan")]
    rows = [("t", "m", START + timedelta(seconds=i % 600), v, {"k": "x"}) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "tenant_id string, metric_name string, timestamp timestamp, value double, labels map<string,string>"), rows


def rank_error(values, found, phi):
    values = np.sort(values)
    low, high = np.searchsorted(values, found, "left") / len(values), np.searchsorted(values, found, "right") / len(values)
    return max(0.0, low - phi, phi - high)


def test_sketched_quantiles_lie_near_the_exact_rank(spark):
    df, rows = metric_rows(spark)
    step, back = micros("1m"), 5
    for phi in (0.05, 0.5, 0.99):
        looked = series.over_time(df, "m", "quantile", step="1m", lookback="5m", phi=phi, exact=False).collect()
        plain = series.over_time(df, "m", "quantile", step="1m", phi=phi, exact=False).collect()
        assert len(looked) == 14 and len(plain) == 10
        for found, width in ((looked, back), (plain, 1)):
            for r in found:
                end = int(r["t"].replace(tzinfo=UTC).timestamp() * 1e6) + step
                own = [v for _, _, at, v, _ in rows if v is not None and v == v and end - width * step <= int(at.timestamp() * 1e6) < end]
                assert rank_error(own, r["v"], phi) <= 0.01


def test_sketches_are_what_look_backs_repeat(spark):
    df, _ = metric_rows(spark, 60)
    plan = series.over_time(df, "m", "quantile", step="1m", lookback="5m", exact=False)._jdf.queryExecution().optimizedPlan().toString()
    generate, below = plan.split("Generate", 1)[1].split("\n", 1)
    assert "kll_sketch_agg" in below and "kll_sketch_agg" not in plan.split("Generate", 1)[0]


def test_latency_sketches(spark):
    rng = random.Random(5)
    rows = [("t", "api", START + timedelta(seconds=i % 50), int(rng.lognormvariate(0, 1) * 1e6)) for i in range(3000)]
    df = spark.createDataFrame(rows, "tenant_id string, service_name string, start_time timestamp, duration_ns long")
    row = traces.latency_percentiles(df, "t", exact=False).collect()[0]
    for name, phi in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert rank_error([r[3] / 1e6 for r in rows], row[name], phi) <= 0.01


def test_statistics_merge_by_day(spark):
    rows = [(START + timedelta(days=i % 4), f"u{i % 700}", i % 9, None if i % 2 else "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "at timestamp, user string, code int, mostly string").withColumn("date", F.to_date("at"))
    columns = ["user", "code", "mostly"]
    daily = stats.column_sketches(df, columns, ["date"])
    assert daily.count() == 4
    found = {r["column_name"]: (r["row_count"], r["ndv"]) for r in stats.merged_stats(daily, columns, "t").collect()}
    assert all(n == 4000 for n, _ in found.values()) and abs(found["user"][1] - 700) <= 21 and found["code"][1] == 9 and found["mostly"][1] == 1
    none = stats.merged_stats(stats.column_sketches(df.limit(0), columns, ["date"]), columns, "t").collect()
    assert [(r["row_count"], r["ndv"]) for r in none] == [(0, 0)] * 3


def test_a_trace_lookup_opens_few_rows(spark, tmp_path):
    rows = [("t", f"{d * 997 + i * 31:08x}", f"s{i}", START + timedelta(days=d, seconds=i)) for d in range(6) for i in range(500)]
    df = spark.createDataFrame(rows, "tenant_id string, trace_id string, span_id string, start_time timestamp")
    for name in ("parent_span_id", "operation_name", "service_name", "status_code"):
        df = df.withColumn(name, F.lit("x"))
    df = df.withColumns({"end_time": F.col("start_time"), "duration_ns": F.lit(1).cast("long"), "attributes": F.create_map().cast("map<string,string>")})
    root = str(tmp_path)
    tables.write_source(df, "traces", root)
    found = select.trace_detail(tables.scan_source(spark, root, "traces", "t"), "t", rows[1234][1])
    assert {r["span_id"] for r in found.collect()} == {r[2] for r in rows if r[1] == rows[1234][1]}
    # Without its sort the lookup is one scan, whose metrics tell the rows of the row groups it opened.
    bare = tables.scan_source(spark, root, "traces", "t").where(F.col("trace_id") == rows[1234][1])
    assert len(bare.collect()) == 1
    scan = bare._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 0 < scan.metrics().apply("numOutputRows").value() <= 1500 < len(rows)
