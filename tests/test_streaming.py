"""Streams give the batch result however the input is cut, and count late rows."""

import random
from datetime import UTC, datetime, timedelta

import models
import pytest
from pyspark.sql import functions as F

from signalmill.operators import sampling
from signalmill.streaming import jobs
from signalmill.streaming.state import Store

START = datetime(2024, 1, 1, tzinfo=UTC)
ROW = (
    "tenant_id string, service_name string, event_time timestamp, signal_id long, is_error boolean, duration_ms double"
)


def rule_rows(n=400):
    rng = random.Random(8)
    rows = []
    for rid in range(n):
        key = ("t", "hot") if rng.random() < 0.5 else ("t", f"s{rng.randrange(3)}")
        rows.append((*key, rng.randrange(1800), rid, rng.random() < 0.2, round(rng.random() * 1000, 1)))
    return sorted(rows, key=lambda r: (r[2], r[3]))


def slices(spark, rows, parts, tmp_path, schema, start):
    """Append the rows in ``parts`` files, running the stream to its end after each."""
    source = str(tmp_path / "in")
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        part = [(*r[:2], START + timedelta(seconds=r[2]), *r[3:]) for r in rows[i : i + size]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        start(spark.readStream.schema(schema).parquet(source)).awaitTermination()


@pytest.mark.parametrize("parts", [1, 5])
def test_rules(spark, tmp_path, parts):
    rows = rule_rows()
    store = Store(str(tmp_path / "store"))
    slices(spark, rows, parts, tmp_path, ROW, lambda s: jobs.stream_cep(s, store, "3m", 0.025, 900.0))
    errors = {r["signal_id"] for r in store.output(spark, "high_error_rate").collect()}
    slow = {r["signal_id"]: r["peak_latency"] for r in store.output(spark, "high_latency").collect()}
    keyed = [((t, s), sec, rid, e, ms) for t, s, sec, rid, e, ms in rows]
    want_errors = models.error_edges([r[:4] for r in keyed], 3, 0.025)
    want_slow = models.latency_edges([(*r[:3], r[4]) for r in keyed], 3, 900.0)
    assert want_errors and want_slow
    assert (errors, slow) == (set(want_errors), want_slow)


def test_late_rows_are_handed_out_as_they_are(spark, tmp_path):
    rows = rule_rows(60)
    late = [("t", "hot", 0, 1000 + i, True, 1.0) for i in range(3)]
    store = Store(str(tmp_path / "store"))
    slices(spark, rows[:30] + late + rows[30:57], 2, tmp_path, ROW, lambda s: jobs.stream_cep(s, store, "3m", 0.025, 900.0))
    assert sorted(r["signal_id"] for r in store.output(spark, "late").collect()) == [1000, 1001, 1002]


def test_a_fast_clock_holds_up_nobody_else(spark, tmp_path):
    rows = rule_rows(200)
    fast = [("b", "api", 50_000 + i, 5000 + i, False, 1.0) for i in range(5)]
    store = Store(str(tmp_path / "store"))
    slices(spark, fast + rows, 4, tmp_path, ROW, lambda s: jobs.stream_cep(s, store, "3m", 0.025, 900.0))
    assert store.output(spark, "late").count() == 0
    got = {r["signal_id"] for r in store.output(spark, "high_error_rate").collect()}
    assert got == set(models.error_edges([((t, s), sec, rid, e) for t, s, sec, rid, e, _ in rows + fast], 3, 0.025))


def test_rows_out_of_order_within_the_lateness_take_their_place(spark, tmp_path):
    rng = random.Random(4)
    rows = rule_rows(240)
    shuffled = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 200))
    ends = [("t", s, 9000 + i, 9000 + i, False, 1.0) for i, s in enumerate(("hot", "s0", "s1", "s2"))]
    store = Store(str(tmp_path / "store"))
    start = lambda s: jobs.stream_cep(s, store, "3m", 0.025, 900.0, lateness="5m")
    slices(spark, shuffled, 4, tmp_path, ROW, start)
    # One more row per key passes on what was held back.
    last = [(*r[:2], START + timedelta(seconds=r[2]), *r[3:]) for r in ends]
    spark.createDataFrame(last, ROW).write.mode("append").parquet(str(tmp_path / "in"))
    start(spark.readStream.schema(ROW).parquet(str(tmp_path / "in"))).awaitTermination()
    assert store.output(spark, "late").count() == 0
    got = {r["signal_id"] for r in store.output(spark, "high_error_rate").collect()}
    assert got == set(models.error_edges([((t, s), sec, rid, e) for t, s, sec, rid, e, _ in rows], 3, 0.025))


def test_state_belongs_to_keys_and_leaves_no_scratch(spark, tmp_path):
    from signalmill.session import checkpoint_dir, listed

    schema = "tenant_id string, metric_name string, timestamp timestamp, value double, signal_id long"
    store = Store(str(tmp_path / "store"))
    source, sizes = str(tmp_path / "in"), []
    for i in range(4):
        rows = [("t", "m", START + timedelta(seconds=60 * i + k), float(k), 10 * i + k) for k in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = jobs.stream_anomaly(spark.readStream.schema(schema).parquet(source), store)
        query.awaitTermination()
        rows = sum(op.numRowsTotal for op in query.lastProgress.stateOperators)
        sizes.append((rows, len(listed(spark, checkpoint_dir(spark)))))
    assert sizes[-1] == sizes[0]
    assert store.output(spark, "scores").count() == 40


def test_live_tail_runs_until_it_is_stopped(spark, tmp_path):
    schema = "tenant_id string, service_name string, timestamp timestamp, severity string, body string, trace_id string, span_id string"
    store, source = Store(str(tmp_path / "store")), str(tmp_path / "in")
    write = lambda i: spark.createDataFrame([("t", "api", START, "INFO", f"line {i}", "tr", str(i))], schema).write.mode("append").parquet(source)
    write(0)
    query = jobs.log_tail(spark.readStream.schema(schema).parquet(source), store, "t", trigger={"processingTime": "200 milliseconds"})
    try:
        query.processAllAvailable()
        write(1)
        query.processAllAvailable()
        assert query.isActive and sorted(r["body"] for r in store.output(spark, "pages").collect()) == ["line 0", "line 1"]
    finally:
        query.stop()


def test_ingest_stores_every_valid_signal(spark, tmp_path):
    import base64
    import json

    def line(tenant, at, body):
        return json.dumps({"tenant_id": tenant, "type": "log", "payload": base64.b64encode(body.encode()).decode(), "attributes": {}, **({"received_at": at} if at else {})})

    source, store = tmp_path / "in", Store(str(tmp_path / "store"))
    source.mkdir()
    batches = [
        [line("b", "2024-01-01T00:50:00Z", "fast")],
        [*(line("a", f"2024-01-01T00:{m:02d}:00Z", f"old {m}") for m in range(2, 12)), line("a", None, "no time"), "not json", line("", "2024-01-01T00:00:00Z", "nobody")],
    ]
    from signalmill.sources import envelope

    for i, lines in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(lines) + "\n")
        jobs.stream_ingest(envelope.read_signals(spark, str(source), stream=True), store).awaitTermination()
    stored = sorted(r["body"] for r in store.output(spark, "logs").collect())
    assert stored == sorted(["fast", "no time", *(f"old {m}" for m in range(2, 12))])
    rejects = {(r["reason"], r["_corrupt_record"]) for r in store.output(spark, "rejects").collect()}
    assert rejects == {("decode", "not json"), ("no_tenant", None)}
    dropped = {(r["tenant_id"], r["reason"]): r["n"] for r in store.output(spark, "dropped").groupBy("tenant_id", "reason").agg(F.sum("n").alias("n")).collect()}
    assert dropped["a", "received"] == 11 and dropped["", "decode"] == 1 and dropped["", "no_tenant"] == 1


def test_sampler_across_batches(spark, tmp_path):
    rng = random.Random(5)
    schema = (
        "tenant_id string, trace_id string, event_time timestamp, signal_id long, type string, service_name string, "
        "severity string, duration_ms double, attributes map<string,string>"
    )
    rows, second = [], 0
    for rid in range(150):
        second += rng.choice([0, 5, 100, 400])
        rows.append((f"t{rng.randrange(2)}", f"tr{rng.randrange(40)}", second, rid, "TRACE", "api",
                     "ERROR" if rng.random() < 0.05 else "", 1.0, {}))
    store = Store(str(tmp_path / "store"))
    slices(spark, rows, 3, tmp_path, schema, lambda s: jobs.stream_sampler(s, store, 0.25, 20, ()))
    got = {r["signal_id"]: r["keep"] for r in store.output(spark, "decisions").collect()}
    assert len(got) == len(rows)
    for tenant in ("t0", "t1"):
        mine = [(r[1], r[2], r[3], 100.0 if r[6] else 0.0) for r in rows if r[0] == tenant]
        for rid, keep in models.sampler(mine, 0.25, 20, 300).items():
            assert got[rid] == keep
    assert sampling.queue_limit(0.25, 20) == 5


def test_tail_keeps_every_row_in_order(spark, tmp_path):
    rows = [("t", "api", i // 7, "INFO", f"line {i}", "tr", f"{i:04d}") for i in range(450)]
    schema = "tenant_id string, service_name string, timestamp timestamp, severity string, body string, trace_id string, span_id string"
    store = Store(str(tmp_path / "store"))
    slices(spark, rows, 2, tmp_path, schema, lambda s: jobs.log_tail(s, store, "t", service="api"))
    pages = store.output(spark, "pages").withColumn("file", F.input_file_name())
    assert pages.count() == 450
    sizes = pages.groupBy("file").agg(F.count("*").alias("n"), F.min("span_id").alias("a"), F.max("span_id").alias("b")).orderBy("a").collect()
    assert all(p["n"] <= jobs.TAIL_PAGE for p in sizes)
    assert all(p["b"] < q["a"] for p, q in zip(sizes, sizes[1:]))


SPAN = (
    "tenant_id string, trace_id string, event_time timestamp, signal_id long, type string, service_name string, "
    "severity string, duration_ms double, attributes map<string,string>"
)


def feed(spark, path, schema, batches, start):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        start(spark.readStream.schema(schema).parquet(path)).awaitTermination()


def test_a_fast_clock_makes_nobody_forget_traces(spark, tmp_path):
    def span(tenant, trace, at, rid):
        return (tenant, trace, at, rid, "TRACE", "api", "", 1.0, {"_k": "v"})

    batches = [
        [span("a", "fills", START, 1), span("a", "tr", START + timedelta(seconds=1), 2), span("b", "x", datetime(2031, 1, 1, tzinfo=UTC), 3)],
        [span("a", "tr", START + timedelta(seconds=61), 4), span("a", "new", START + timedelta(seconds=62), 5), span("b", "x", START, 6)],
        [span("a", "tr", START + timedelta(seconds=500), 7), span(None, "tr", START, 8), span("a", None, START, 9)],
    ]
    store = Store(str(tmp_path / "store"))
    feed(spark, str(tmp_path / "in"), SPAN, batches, lambda s: jobs.stream_sampler(s, store, 0.5, 2, ()))
    got = {r["signal_id"]: (r["keep"], r["attributes"]) for r in store.output(spark, "decisions").collect()}
    # The queue of tenant a is full with its first trace; "tr" is kept while it was seen within five minutes.
    keep = {i: k for i, (k, _) in got.items()}
    assert keep == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: False, 8: True, 9: True}
    assert all(a == {"_k": "v"} for _, a in got.values())


def test_anomalies_of_a_shuffled_feed_equal_the_batch(spark, tmp_path):
    from signalmill.operators import anomaly

    schema = "tenant_id string, metric_name string, timestamp timestamp, value double, signal_id long"
    rng = random.Random(9)
    rows = [("t", f"m{i % 2}", START + timedelta(seconds=i), rng.gauss(10, 2) if i % 50 else 60.0, i) for i in range(300)]
    shuffled = sorted(rows, key=lambda r: r[4] + rng.uniform(0, 25))
    ends = [("t", m, START + timedelta(seconds=4000), 1.0, 9000 + i) for i, m in enumerate(("m0", "m1"))]
    late = [("t", "m0", START, 5.0, 9998), ("t", "m1", None, 5.0, 9999), ("t", "m1", START + timedelta(seconds=9000), None, 9997)]
    store = Store(str(tmp_path / "store"))
    batches = [shuffled[:120], shuffled[120:], ends, late]
    feed(spark, str(tmp_path / "in"), schema, batches, lambda s: jobs.stream_anomaly(s, store, warmup=20, lateness="30s"))
    got = {r["signal_id"]: r for r in store.output(spark, "scores").collect()}
    want = {r["signal_id"]: r for r in anomaly.anomaly_zscore(spark.createDataFrame(rows, schema), warmup=20).collect()}
    assert set(want) == set(got) and any(r["anomaly"] for r in want.values())
    for rid, r in want.items():
        assert got[rid]["anomaly"] == r["anomaly"] and got[rid]["score"] == pytest.approx(r["score"], abs=1e-9)
        assert got[rid]["baseline"] == pytest.approx(r["baseline"]) and got[rid]["timestamp"] == r["timestamp"]
    assert sorted(r["signal_id"] for r in store.output(spark, "late").collect()) == [9998, 9999]


def test_burn_decisions_count_late_rows_in_their_minute(spark, tmp_path):
    from signalmill.operators import slo

    rng, schema = random.Random(2), "slo string, event_time timestamp, good boolean"
    pairs = ((60, 5, 2.0, "page"), (120, 10, 1.0, "ticket"))
    rows = [(f"t:s{i % 2}", START + timedelta(seconds=60 * i), rng.random() < (0.5 if 100 < i < 130 else 0.98)) for i in range(400)]
    shuffled = sorted(rows, key=lambda r: (r[1] - START).total_seconds() + rng.uniform(0, 500))
    targets = spark.createDataFrame([("t:s0", 0.9), ("t:s1", 0.95)], "slo string, target double")
    store, very_late = Store(str(tmp_path / "store")), [("t:s0", START, False), ("t:s1", None, True)]
    start = lambda s: jobs.stream_slo(s, store, targets, F.col("good"), pairs, lateness="10m")
    feed(spark, str(tmp_path / "in"), schema, [shuffled[:150], shuffled[150:], very_late], start)
    events = spark.createDataFrame(rows, schema)
    batch = slo.slo_decision(slo.burn_rates(slo.slo_minutes(events, F.col("good")), targets, pairs), pairs)
    got = jobs.latest_decisions(store.output(spark, "decisions")).select(*batch.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    late = store.output(spark, "late").collect()
    assert sorted((r["slo"], r["minute"], r["good"], r["bad"]) for r in late) == [("t:s0", int(START.timestamp()) // 60, 0, 1), ("t:s1", None, 1, 0)]


def test_alerts_equal_the_batch_across_restarts(spark, tmp_path):
    from signalmill.operators import alerts

    rng = random.Random(6)
    schema = (
        "event_id long, tenant_id string, rule_id string, severity string, title string, description string, "
        "labels map<string,string>, annotations map<string,string>, resolved boolean, occurred_at timestamp"
    )
    rows = [
        (i, f"t{i % 2}", "r", rng.choice(["critical", "info"]), f"title {i}", None if i % 7 else "d", {"service": f"s{rng.randrange(3)}", "a": 'q"'},
         {"n": str(i)}, rng.random() < 0.3, START + timedelta(seconds=i, microseconds=i))
        for i in range(160)
    ]
    hush = [("t0", {"service": "s1"}, START + timedelta(seconds=20), START + timedelta(seconds=90)), ("t1", {}, START, START + timedelta(seconds=40))]
    silences = spark.createDataFrame(hush, "tenant_id string, matcher map<string,string>, created_at timestamp, expires_at timestamp")
    store = Store(str(tmp_path / "store"))
    feed(spark, str(tmp_path / "in"), schema, [rows[:70], rows[70:]], lambda s: jobs.stream_alerts(s, store, silences))
    steps = alerts.alert_steps(spark.createDataFrame(rows, schema))
    plain = lambda df: sorted((str(sorted(r.asDict(True).items())) for r in df.collect()))
    assert plain(jobs.latest_alerts(store.output(spark, "alerts"))) == plain(alerts.alert_lifecycle(steps, silences))
    changes = store.output(spark, "changes")
    fired = {r["event_id"] for r in changes.where("change_type = 'alert.fired'").collect()}
    created = steps.where("step = 'created'")
    hits = {r["event_id"] for r in alerts.silence_hits(created, ["event_id"], F.col("occurred_at"), silences).collect()}
    assert hits and fired == {r["event_id"] for r in created.collect()} - hits
    row = changes.where("change_type = 'alert.resolved'").orderBy("event_id").first()
    want = next(r for r in rows if r[8])
    assert (row["event_id"], row["labels"], row["occurred_at"].replace(tzinfo=UTC)) == (want[0], want[6], want[9])


def test_a_service_keeps_only_its_window(spark, tmp_path):
    store, source, totals = Store(str(tmp_path / "store")), str(tmp_path / "in"), []
    for i in range(6):
        rows = [("t", "api", START + timedelta(seconds=300 * i + 10 * k), 100 * i + k, k % 5 == 0, 1.0) for k in range(30)]
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(source)
        query = jobs.stream_cep(spark.readStream.schema(ROW).parquet(source), store, "3m", 0.025, 900.0)
        query.awaitTermination()
        totals.append(sum(op.numRowsTotal for op in query.lastProgress.stateOperators))
    assert totals[-1] == totals[1] <= 3 + 2
    with pytest.raises(ValueError):
        jobs.stream_cep(spark.readStream.schema(ROW).parquet(source), store, idle="1h")


def test_ingest_stores_what_the_sampler_keeps(spark, tmp_path):
    import base64
    import json

    from signalmill.sources import envelope

    def line(i, kind, trace, tenant="a"):
        attributes = {"trace_id": trace, "span_id": str(i), "service.name": "api", "duration_ms": "1"}
        at = (START + timedelta(seconds=400 * i)).isoformat()
        return json.dumps({"tenant_id": tenant, "type": kind, "payload": base64.b64encode(b"{}").decode(), "attributes": attributes, "received_at": at})

    source, store = tmp_path / "in", Store(str(tmp_path / "store"))
    source.mkdir()
    for b in range(2):
        spans = [line(10 * b + i, "trace", f"tr{10 * b + i}") for i in range(8)]
        (source / f"{b}.json").write_text("\n".join([*spans, line(900 + b, "log", ""), line(950 + b, "trace", "z", ""), "not json"]) + "\n")
        jobs.stream_ingest(envelope.read_signals(spark, str(source), stream=True), store, rate=0.5, max_size=10).awaitTermination()
    # Five traces fill the queue; later ones, each seen once, are dropped. Logs and rejects are not sampled.
    assert sorted(r["trace_id"] for r in store.output(spark, "traces").collect()) == [f"tr{i}" for i in range(5)]
    assert store.output(spark, "logs").count() == 2
    rows = store.output(spark, "dropped").groupBy("tenant_id", "reason").agg(F.sum("n").alias("n")).collect()
    dropped = {(r["tenant_id"], r["reason"]): r["n"] for r in rows}
    assert dropped["a", "sampled_out"] == 11 and dropped["", "no_tenant"] == 2 and dropped["a", "received"] == 18
    assert store.output(spark, "rejects").count() == 4


def test_streamed_alerts_find_silences_by_hour(spark, tmp_path):
    from test_alerts_slo import EVENT, SILENCE, covered, odd_silences

    from signalmill.operators import alerts

    rng = random.Random(9)
    silences = odd_silences(rng)
    rows = [
        (i, rng.choice(["t0", "t1", "t2"]), f"r{i}", "info", "title", "d", rng.choice([None, {}, {"service": f"s{i % 4}"}, {"service": f"s{i % 3}", "team": "core"}]),
         {}, False, START + timedelta(seconds=rng.uniform(-1e6, 1e6)))
        for i in range(300)
    ]
    rows += rows[:20]
    store = Store(str(tmp_path / "store"))
    hush = spark.createDataFrame(silences, SILENCE)
    start = lambda s: jobs.stream_alerts(s, store, hush)
    feed(spark, str(tmp_path / "in"), EVENT, [rows], start)
    # Every rule is its own alert, so each fires once unless a silence covers it.
    want = sorted(i for i, tenant, _, _, _, _, labels, _, _, at in rows[:300] if not covered(tenant, labels, at, silences))
    assert sorted(r["event_id"] for r in store.output(spark, "changes").where("change_type = 'alert.fired'").collect()) == want
    noted = {r["rule_id"]: r["notify_count"] for r in jobs.latest_alerts(store.output(spark, "alerts")).collect()}
    assert noted == {f"r{i}": int(i in want) for i in range(300)}
    # The rows that a batch looks silences up in grow with the hours and matchers, not with the silences.
    assert alerts.silence_spells(hush.unionByName(hush)).count() == alerts.silence_spells(hush).count()
