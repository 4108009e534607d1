"""Readers, gates and writers on hand-made inputs."""

import base64
import json
import random
from datetime import UTC, datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from signalmill.functions import time as ftime
from signalmill.operators import clean, enrich, select, traces
from signalmill.schemas import LOGS, METRICS, SIGNAL, TRACES
from signalmill.sources import envelope, otlp, statsd, tables

START = datetime(2024, 1, 1, tzinfo=UTC)
AS_OF = "2024-01-02 00:00:00"


def lines(tmp_path, name, docs):
    path = tmp_path / name
    path.write_text("".join((d if isinstance(d, str) else json.dumps(d)) + "\n" for d in docs))
    return str(path)


def attr(key, **value):
    return {"key": key, "value": value}


def test_envelopes(spark, tmp_path):
    docs = [
        {"tenant_id": "a", "type": "signal_type_log", "payload": base64.b64encode(b"hi").decode(), "attributes": {"k": "v"}},
        {"type": "3"}, {"tenant_id": "b", "type": "odd"}, "{broken", {"tenant_id": "a", "type": "4", "payload": "%%%"},
    ]
    rows = envelope.read_signals(spark, lines(tmp_path, "s.json", docs), received_at=F.lit(AS_OF).cast("timestamp"))
    good = rows.where("_corrupt_record IS NULL")
    kept, rejected = envelope.accept_tenant(good, "a")
    assert sorted((r["type"], bytes(r["payload"] or b"")) for r in kept.collect()) == [("LOG", b"hi"), ("TRACE", b"")]
    assert [(r["tenant_id"], r["type"], r["reason"]) for r in rejected.collect()] == [("b", "METRIC", "tenant_mismatch")]
    assert rows.where("_corrupt_record IS NOT NULL").count() == 2


def test_otlp_spans(spark, tmp_path):
    span = {
        "traceId": "0AF7", "spanId": "B7", "name": "pay", "startTimeUnixNano": "1000000000", "endTimeUnixNano": 1500000000,
        "status": {"code": 2, "message": "boom"},
        "attributes": [attr("env", stringValue="span"), attr("n", intValue="7"), attr("ok", boolValue=True),
                       attr("raw", bytesValue=base64.b64encode(b"\x01\xff").decode()), attr("d", doubleValue=2.0),
                       attr("tiny", doubleValue=0.00001), attr("big", doubleValue=1e9),
                       attr("list", arrayValue={"values": [{"intValue": 1}, {"arrayValue": {"values": [{"stringValue": "x"}]}}]})],
    }
    resource = {"attributes": [attr("service.name", stringValue="checkout"), attr("env", stringValue="resource")]}
    scopes = [{"scope": {"name": f"lib{j}"}, "spans": [span] * 5} for j in range(2)]
    path = lines(tmp_path, "t.json", [{"resourceSpans": [{"resource": resource, "scopeSpans": scopes}] * 3}])
    rows = otlp.otlp_traces(otlp.read_otlp(spark, path, "traces"), "a", AS_OF)
    assert rows.columns == TRACES.names
    assert rows.count() == 30
    r = rows.head()
    assert (r["trace_id"], r["span_id"], r["service_name"], r["status_code"], r["duration_ns"]) == (
        "0af7", "b7", "checkout", "ERROR", 500_000_000)
    assert r["start_time"].timestamp() == 1.0 and r["end_time"].timestamp() == 1.5
    want = {"env": "span", "n": "7", "ok": "true", "raw": "01ff", "d": "2", "tiny": "0.00001", "big": "1000000000",
            "list": "[1,[x]]", "duration_ms": "500.000", "severity": "ERROR", "status.message": "boom", "otel.scope.name": "lib0"}
    assert want.items() <= r["attributes"].items()


def test_span_without_duration_has_no_duration_label(spark, tmp_path):
    spans = [{"spanId": "a", "startTimeUnixNano": "1000", "endTimeUnixNano": "1000"}, {"spanId": "b"}]
    path = lines(tmp_path, "t.json", [{"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]}])
    rows = otlp.otlp_traces(otlp.read_otlp(spark, path, "traces"), "a", AS_OF).collect()
    assert [(r["duration_ns"], "duration_ms" in r["attributes"]) for r in rows] == [(0, False), (0, False)]


def test_otlp_metrics(spark, tmp_path):
    metrics = [
        {"name": "reqs", "sum": {"aggregationTemporality": 2, "dataPoints": [{"asInt": "42", "attributes": [attr("method", stringValue="GET")]}]}},
        {"name": "lat", "unit": "ms", "histogram": {"dataPoints": [{"count": "10", "sum": 1.5, "timeUnixNano": "2000000000"}]}},
    ]
    path = lines(tmp_path, "m.json", [{"resourceMetrics": [{"scopeMetrics": [{"metrics": metrics}]}]}])
    got = {r["metric_name"]: r for r in otlp.otlp_metrics(otlp.read_otlp(spark, path, "metrics"), "a", AS_OF).collect()}
    assert (got["reqs"]["value"], got["reqs"]["labels"], got["reqs"]["count"]) == (42.0, {"method": "GET"}, None)
    assert got["reqs"]["temporality"].endswith("CUMULATIVE")
    assert (got["lat"]["count"], got["lat"]["sum"], got["lat"]["value"], got["lat"]["unit"]) == (10, 1.5, 1.5, "ms")
    assert got["lat"]["timestamp"].timestamp() == 2.0


def test_otlp_logs(spark, tmp_path):
    records = [{"severityText": "ERROR", "body": {"stringValue": "boom"}, "traceId": "AB"},
               {"severityNumber": 18, "body": {"intValue": 5}}, {"severityNumber": 9}]
    path = lines(tmp_path, "l.json", [{"resourceLogs": [{"scopeLogs": [{"logRecords": records}]}]}])
    rows = otlp.otlp_logs(otlp.read_otlp(spark, path, "logs"), "a", AS_OF)
    assert rows.columns == LOGS.names
    assert [(r["severity"], r["body"], r["trace_id"]) for r in rows.collect()] == [("ERROR", "boom", "ab"), ("ERROR", "5", ""), ("", "", "")]


def test_statsd_lines(spark):
    good = ["a.b:1.5|c|@0.5|#user:8,env:prod,flag,env:test", "g:-3|g", "h:2e3|h|@1", "t:7|ms|#a:b:c"]
    bad = ["nocolon|c", "x:1", "x:1|z", ":1|c", "s:alice|s", "p:+5|g"]
    df = spark.createDataFrame([(x,) for x in [*good, *bad, "", "  "]], "value string")
    metrics, rejects = statsd.statsd_metrics(df, "t", received_at="2024-01-02")
    got = {r["metric_name"]: r for r in metrics.collect()}
    assert got["a.b"]["labels"] == {
        "source": "statsd", "metric_type": "c", "sample_rate": "0.5", "tag.user": "8", "tag.flag": "", "tag.env": "test"}
    assert got["g"]["timestamp"] == got["g"]["received_at"] == datetime(2024, 1, 2)
    assert [(n, r["value"], r["metric_type"], r["sample_rate"]) for n, r in sorted(got.items())] == [
        ("a.b", 1.5, "c", 0.5), ("g", -3.0, "g", None), ("h", 2000.0, "h", None), ("t", 7.0, "ms", None)]
    assert got["t"]["labels"] == {"source": "statsd", "metric_type": "ms", "tag.a": "b:c"}
    assert sorted(r["line"] for r in rejects.collect()) == sorted(bad)


def test_gates(spark):
    rows = [("a", "METRIC", b'{"x":1}', {}, START), ("a", "METRIC", b"{bad", {}, START), ("", "METRIC", b"", {}, START),
            ("a", "LOG", b"plain", None, START), ("a", "METRIC", b"null", {}, START)]
    df = spark.createDataFrame(rows, SIGNAL)
    kept, bad = clean.decode_gate(df)
    assert (kept.count(), bad.count()) == (4, 1)
    assert clean.decode_gate(df, strict=True)[1].count() == 2
    stamped = clean.enrich_stamp(kept, "2", AS_OF).where("type = 'LOG'").head()["attributes"]
    assert stamped == {"ingest.version": "2", "ingest.at": "2024-01-02T00:00:00.000000Z"}
    payload = clean.metric_payload(df.where("type = 'METRIC'")).select("metric_name", "value").distinct().collect()
    assert [tuple(r) for r in payload] == [("unknown", 0.0)]


def test_hook_failure_keeps_the_row(spark):
    df = spark.createDataFrame([("a", "LOG", b"x", {"k": "1"}, START), ("b", "LOG", b"y", None, START)], SIGNAL)

    def hook(signal):
        return {**signal, "tenant_id": "z"} if signal["attributes"]["k"] else None

    got = enrich.enrich_hook(df, hook).orderBy("payload").collect()
    assert (got[0]["tenant_id"], bytes(got[0]["payload"]), got[0]["enrich_error"]) == ("z", b"x", None)
    assert got[0]["received_at"].timestamp() == START.timestamp()
    assert (got[1]["tenant_id"], got[1]["enrich_error"][:9]) == ("b", "TypeError")


def test_selection_errors(spark):
    logs = spark.createDataFrame([], LOGS)
    with pytest.raises(ValueError):
        select.select_columns(logs, "logs", ["password"])
    with pytest.raises(ValueError):
        select.label_match(logs, [("k", "=~", "[bad")], "attributes")
    with pytest.raises(ValueError):
        select.line_filter(logs, [("|~", "[bad")])
    with pytest.raises(ValueError):
        select.group_agg(logs, [], [("median", "x", "y")])
    for bad in ("5", "m5", "", "5x", -1):
        with pytest.raises(ValueError):
            ftime.micros(bad)
    assert ftime.micros("1h30m") == 5400 * 10**6 == ftime.micros(timedelta(minutes=90))


def test_native_query(spark, tmp_path):
    rows = [("acme", "api", sev, body, {}, START, "", "") for sev, body in (("INFO", "hello world"), ("ERROR", "boom"))]
    rows.append(("evil", "api", "ERROR", "other tenant", {}, START, "", ""))
    tables.write_source(spark.createDataFrame(rows, LOGS), "logs", str(tmp_path))
    mine = tables.scan_source(spark, str(tmp_path), "logs", "acme", "2024-01-01 00:00:00", "2024-01-01 01:00:00")
    hits = select.where_expr(select.since_filter(mine, "logs", "1h", as_of="2024-01-01 00:30:00"), F.col("severity") == "ERROR")
    assert [r["body"] for r in select.newest_rows(hits, "logs", 50).collect()] == ["boom"]
    assert select.where_expr(mine, F.col("tenant_id") == "evil").count() == 0
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "date" in plan


def test_hot_and_cold_union(spark):
    at = lambda h: START + timedelta(hours=h)
    hot = spark.createDataFrame([("hot", at(10)), ("hot", at(11))], "src string, _ts timestamp")
    cold = spark.createDataFrame([("cold", at(0)), ("cold", at(10))], "src string, _ts timestamp")
    got = [(r["src"], r["_ts"].astimezone(UTC).hour) for r in tables.hot_cold_union(hot, cold).collect()]
    assert got == [("cold", 0), ("hot", 10), ("cold", 10), ("hot", 11)]


def test_exports(spark, tmp_path):
    df = spark.range(200_000).select("id", F.lit("x").alias("tenant_id"))
    path = f"{tmp_path}/out"
    tables.export_parquet(df.coalesce(1), path)
    files = list((tmp_path / "out").glob("*.parquet"))
    meta = pq.ParquetFile(files[0]).metadata
    assert all(meta.row_group(i).num_rows <= tables.EXPORT_ROW_GROUP for i in range(meta.num_row_groups))
    assert meta.row_group(0).column(0).compression == "SNAPPY"
    assert spark.read.parquet(path).count() == 200_000
    tables.export_parquet(df.limit(0), path)
    assert spark.read.schema(df.schema).parquet(path).count() == 0
    head = tables.export_ndjson(df.limit(7), f"{tmp_path}/nd", "logs", limit=7).head()
    assert (head["rows_returned"], head["columns"], head["limit"]) == (7, ["id", "tenant_id"], 7)


def tree(spark, spans):
    rows = [("t", "tr", sid, parent, "op", "svc", START + timedelta(milliseconds=ms), START + timedelta(milliseconds=ms + 10),
             10_000_000, {}, status) for sid, parent, ms, status in spans]
    return spark.createDataFrame(rows, TRACES)


@pytest.mark.parametrize("large_trace", [50_000, 0])
def test_waterfall_of_odd_trees(spark, large_trace):
    spans = [("a", "", 0, "OK"), ("b", "a", 20, "ERROR"), ("c", "a", 10, ""), ("d", "c", 30, "OK"), ("orphan", "gone", 5, "OK"),
             ("x", "y", 1, "OK"), ("y", "x", 2, "OK"), ("self", "self", 3, "OK"), ("d", "b", 90, "OK"), ("r2", "", 40, "OK")]
    got = traces.waterfall(tree(spark, spans), large_trace).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["span_id"], r["depth"], r["is_error"]) for r in got] == [
        (0, "a", 0, False), (1, "c", 1, False), (2, "d", 2, False), (3, "b", 1, True), (4, "orphan", 0, False), (5, "r2", 0, False)]
    assert [r["left_pct"] for r in got] == pytest.approx([0, 20, 60, 40, 10, 80])
    assert all(r["width_pct"] == pytest.approx(20) and r["duration_ms"] == 10 for r in got)


def test_waterfalls_by_joins_equal_whole_ones(spark):
    rng = random.Random(2)
    rows = []

    def add(tenant, trace, sid, parent, ms):
        at = START + timedelta(milliseconds=ms)
        rows.append((tenant, trace, sid, parent, "op", "svc", at, at + timedelta(milliseconds=7), 7_000_000, {}, "OK"))

    for tenant, trace in (("t", "tr"), ("t", None), ("u", None), ("u", "tr")):
        for i in range(60 if tenant == "t" else 40):
            add(tenant, trace, f"s{i:02d}", f"s{rng.randrange(70):02d}" if rng.random() < 0.9 else None, rng.randrange(8))
    for i in range(100):
        add("t", "chain", f"c{i}", f"c{i - 1}", 300 - i)
    for i in range(300):
        add("t", "star", f"w{i}", "w0" if i else None, i // 100)
    for i in range(60):
        add("t", "cycle", f"y{i}", f"y{(i - 1) % 10}" if i < 10 else f"y{i - 1}", i)
    df = spark.createDataFrame(rows, TRACES)
    whole = traces.waterfall(df)
    key = lambda r: (r["tenant_id"], r["trace_id"] or "", r["ordinal"])
    want = sorted(whole.collect(), key=key)
    assert len(want) > 450 and {r["trace_id"] for r in want} == {"tr", None, "chain", "star"}
    assert max(r["depth"] for r in want) == 99
    assert sorted(traces.waterfall(df, 50).select(whole.columns).collect(), key=key) == want


def test_metrics_schema_round_trip(spark, tmp_path):
    rows = [("7", "m", START, 1.0, {"k": "v"}, START)]
    tables.write_source(spark.createDataFrame(rows, METRICS), "metrics", str(tmp_path))
    back = tables.scan_source(spark, str(tmp_path), "metrics", "7")
    assert back.columns == METRICS.names and back.head()["tenant_id"] == "7"
