"""Answers at the edges: ranges, unreadable input, hooks, names, infinities, limits, nesting."""

import json
import random

import pytest
from pyspark.sql import functions as F

from signalmill.operators import alerts, audit, clean, enrich, series, skew
from signalmill.sources import envelope, otlp


def test_look_back_reads_before_the_range(spark):
    rows = [("t", "m", f"2024-01-01 00:0{i}:00", v, {}) for i, v in enumerate((10.0, 20.0, 30.0))]
    df = spark.createDataFrame(rows, "tenant_id string, metric_name string, timestamp string, value double, labels map<string,string>")
    df = df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    got = series.over_time(df, "m", "sum", t0="2024-01-01 00:01:00", t1="2024-01-01 00:02:00", step="1m", lookback="3m")
    assert [r["v"] for r in got.orderBy("t").collect()] == [30.0, 60.0]
    high = series.over_time(df, "m", "quantile", t0="2024-01-01 00:01:00", t1="2024-01-01 00:02:00", step="1m", lookback="3m", phi=1.0)
    assert [r["v"] for r in high.orderBy("t").collect()] == [20.0, 30.0]


def test_unreadable_lines_are_rejected_and_counted(spark, tmp_path):
    good = {"tenant_id": "", "type": "metric", "payload": "eyJ2YWx1ZSI6MX0=", "attributes": {}, "received_at": "2024-01-01T00:00:00Z"}
    (tmp_path / "a.json").write_text("not json at all\n" + json.dumps(good) + "\n")
    signals = envelope.read_signals(spark, str(tmp_path))
    kept, rejected = envelope.accept_tenant(signals, "t1")
    assert [r["tenant_id"] for r in kept.collect()] == ["t1"]
    assert [(r["reason"], r["_corrupt_record"]) for r in rejected.collect()] == [("decode", "not json at all")]
    passed, failed = clean.decode_gate(signals)
    assert passed.count() == 1
    counted = {(r["type"], r["reason"]): r["n"] for r in clean.drop_accounting(passed, failed).collect()}
    assert counted[None, "decode"] == 1
    assert clean.route_signals(kept)[0].count() == 1


@pytest.mark.parametrize("result", [{"id": 1, "v": "abc"}, "text", [1, 2], 3])
def test_hook_results_that_do_not_fit_keep_the_row(spark, result):
    df = spark.createDataFrame([(1, 2.5)], "id long, v double")
    row = enrich.enrich_hook(df, lambda r: result).head()
    assert (row["id"], row["v"]) == (1, 2.5) and row["enrich_error"].startswith("TypeError")
    row = enrich.enrich_hook(df, lambda r: {**r, "v": 7}).head()
    assert (row["id"], row["v"], row["enrich_error"]) == (1, 7.0, None)


def test_slo_names_with_colons_stay_apart(spark):
    rows = [(f"t0:{name}", 1, "page", 20.0, 20.0, 0.01) for name in ("api:read", "web:read")]
    df = spark.createDataFrame(rows, "slo string, minute long, severity string, burn_long double, burn_short double, error_budget double")
    events = alerts.alert_fingerprint(alerts.slo_to_alerts(df))
    assert {r["rule_id"] for r in events.collect()} == {"slo:api:read", "slo:web:read"}
    assert {r["tenant_id"] for r in events.collect()} == {"t0"} and events.select("fingerprint").distinct().count() == 2


@pytest.mark.parametrize("values", [
    [float("inf"), 1.0, 2.0, 3.0], [float("-inf"), float("inf"), 5.0, 5.0, 6.0], [float("-inf")] * 3 + [1.0, 1.7e308, -1.7e308],
])
def test_quantiles_with_infinities_end(spark, values):
    df = spark.createDataFrame([("a", v) for v in values] * 3, "k string, v double")
    got = skew.exact_quantiles(df, ["k"], "v", {"lo": 0.0, "mid": 0.5, "hi": 1.0}, slots=4, leaf_rows=2).head()
    ordered = sorted(values * 3)
    n = len(ordered)
    mid = ordered[(n - 1) // 2] if ordered[(n - 1) // 2] == ordered[n // 2] else (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
    assert (got["lo"], got["mid"], got["hi"]) == (ordered[0], mid, ordered[-1])


def test_audit_limit_is_kept_within_its_range(spark):
    df = spark.range(700).select(F.col("id"), F.lit("t").alias("tenant_id"))
    sizes = {k: audit.recent_audit(df, None, k).count() for k in (-1, 0, 1, 500, 501, 10_000)}
    assert sizes == {-1: 100, 0: 100, 1: 1, 500: 500, 501: 500, 10_000: 500}


def test_arrays_nested_deeply(spark, tmp_path):
    def nested(depth):
        return {"stringValue": "x"} if depth == 0 else {"arrayValue": {"values": [nested(depth - 1), {"intValue": "1"}]}}

    attributes = [{"key": f"k{d}", "value": nested(d)} for d in (0, 1, 3, 8, 30)]
    request = {"resourceSpans": [{"resource": {"attributes": attributes}, "scopeSpans": [{"scope": {"name": "s"}, "spans": [{"traceId": "t", "spanId": "s"}]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(request))
    spans = otlp.otlp_traces(otlp.read_otlp(spark, str(tmp_path), "traces"), "t", "2024-01-01")
    attributes = spans.head()["attributes"]
    assert attributes["k0"] == "x" and attributes["k1"] == "[x,1]" and attributes["k3"] == "[[[x,1],1],1]"
    for depth in (8, 30):
        assert attributes[f"k{depth}"] == "[" * depth + "x" + ",1]" * depth


def test_arrays_of_odd_values_equal_a_recursive_decoder(spark, tmp_path):
    def text(value):
        if value is None:
            return ""
        if "arrayValue" in value:
            return "[" + ",".join(text(v) for v in value["arrayValue"].get("values", [])) + "]"
        if "boolValue" in value:
            return str(value["boolValue"]).lower()
        return next((str(v) for k, v in value.items() if k in ("stringValue", "intValue")), "")

    rng = random.Random(4)
    odd = ['a,b', '{"arrayValue":{}}', '[x]', 'back\\slash "quoted"', '"kvlistValue":', "", " two  words\n\t", "ünïcode 😀", "},{", "q\\" * 20_000]

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind == 0:
            return {"intValue": str(rng.randrange(-9, 2**62))}
        if kind == 1:
            return {"boolValue": rng.random() < 0.5}
        if kind == 2:
            return rng.choice([None, {}, {"arrayValue": {}}, {"arrayValue": {"values": []}}])
        if kind == 3:
            pairs = [{"key": "[k", "value": value(max(0, depth - 1))} for _ in range(rng.randrange(3))]
            return {"kvlistValue": {"values": pairs}}
        if kind == 4:
            return {"stringValue": rng.choice(odd)}
        return {"arrayValue": {"values": [value(depth - 1) for _ in range(rng.randrange(5))]}}

    values = [{"arrayValue": {"values": [value(6) for _ in range(4)]}} for _ in range(120)]
    for i, indent in enumerate((None, 1)):
        attributes = [{"key": f"k{j}", "value": v} for j, v in enumerate(values)]
        request = {"resourceSpans": [{"scopeSpans": [{"spans": [{"spanId": "s", "attributes": attributes}]}]}]}
        folder = tmp_path / str(i)
        folder.mkdir()
        body = json.dumps(request, indent=indent, ensure_ascii=bool(i))
        (folder / "a.json").write_text(body.replace("\n", " "))
        got = otlp.otlp_traces(otlp.read_otlp(spark, str(folder), "traces"), "t", "2024-01-01").head()["attributes"]
        assert {k: v for k, v in got.items() if k.startswith("k")} == {f"k{j}": text(v) for j, v in enumerate(values)}
