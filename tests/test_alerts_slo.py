"""Alert lifecycle, silences, notifications, SLO decisions, retention and audit."""

import hashlib
import json
import random
from datetime import UTC, datetime, timedelta

import models
import pytest
from pyspark.sql import functions as F

from signalmill.operators import alerts, audit, retention, slo
from signalmill.schemas import AUDIT, SILENCES
from signalmill.session import listed
from signalmill.sources import tables

START = datetime(2024, 1, 1, tzinfo=UTC)
EVENT = (
    "event_id long, tenant_id string, rule_id string, severity string, title string, description string, "
    "labels map<string,string>, annotations map<string,string>, resolved boolean, occurred_at timestamp"
)


def events(spark, rows):
    """rows: (id, service, resolved)."""
    data = [
        (i, "acme", "r1", f"sev{i}", f"title {i}", f"text {i}", {"service": svc}, {}, resolved, START + timedelta(seconds=i))
        for i, svc, resolved in rows
    ]
    return spark.createDataFrame(data, EVENT)


def silence(tenant="acme", matcher=None, start=-3600, end=3600):
    at = lambda s: START + timedelta(seconds=s)
    return ("id", tenant, {} if matcher is None else matcher, "", "", at(start), at(end))


def test_fingerprint_is_the_digest_of_sorted_labels(spark):
    rows = spark.createDataFrame([("t", "r", {"b": "2", "a": "1"}), ("t", "r", {})], "tenant_id string, rule_id string, labels map<string,string>")
    got = [r["fingerprint"] for r in alerts.alert_fingerprint(rows).collect()]
    assert got == [hashlib.sha256(b"t\0r\0a=1;b=2;").hexdigest(), hashlib.sha256(b"t\0r\0").hexdigest()]


def test_lifecycle_equals_state_machine(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if rng.random() < 0.4 else f"s{rng.randrange(5)}", rng.random() < 0.4) for i in range(600)]
    steps = alerts.alert_steps(events(spark, rows))
    table, want = models.alert_table(rows)
    got = {r["event_id"]: r["step"] for r in steps.collect() if r["step"]}
    assert got == want
    final = {r["labels"]["service"]: r for r in alerts.alert_lifecycle(steps).collect()}
    assert set(final) == set(table)
    for svc, row in table.items():
        r = final[svc]
        stamp = lambda c: None if r[c] is None else int((r[c].astimezone(UTC) - START).total_seconds())
        assert (r["state"], stamp("starts_at"), stamp("last_seen_at"), stamp("resolved_at"), r["title"]) == (
            row["state"], row["starts"], row["last"], row["ended"], f"title {row['starts']}"
        )
    history = alerts.alert_history(steps).groupBy("event").count().collect()
    counts = {r["event"]: r["count"] for r in history}
    assert counts["notified"] == counts["created"] == sum(s == "created" for s in want.values())


@pytest.mark.parametrize(
    "item,covered",
    [
        (silence(matcher={"service": "api"}), True),
        (silence(), True),
        (silence(matcher={"service": "api", "team": ""}), True),
        (silence(matcher={"service": "api", "team": "core"}), False),
        (silence(matcher={"service": "db"}), False),
        (silence(matcher={"service": "api"}, end=-10), False),
        (silence(tenant="other", matcher={"service": "api"}), False),
    ],
)
def test_silences(spark, item, covered):
    hush = spark.createDataFrame([item], SILENCES)
    steps = alerts.alert_steps(events(spark, [(0, "api", False)]))
    final = alerts.alert_lifecycle(steps, hush)
    assert final.head()["notify_count"] == (0 if covered else 1)
    assert alerts.silenced_alerts(final, hush, as_of="2024-01-01 00:00:01").count() == int(covered)
    assert alerts.unsilenced_alerts(final, hush, as_of="2024-01-01 00:00:01").count() == int(not covered)


def test_outbox(spark):
    rows = [(0, "api", False), (1, "api", False), (2, "api", True), (3, "api", True), (4, "api", False), (5, "new", True)]
    out = alerts.notification_outbox(
        alerts.alert_steps(events(spark, rows)), None, {"c": "chat", "p": "pager", "w": "webhook"}, routing_key="k"
    ).collect()
    sent = sorted((r["event_id"], r["channel"], r["action"]) for r in out)
    expected = [(0, "trigger"), (2, "resolve"), (3, "resolve"), (4, "trigger"), (5, "resolve")]
    assert sent == sorted((i, c, a) for i, a in expected for c in "cpw")
    pager = json.loads(next(r["payload"] for r in out if r["channel"] == "p" and r["event_id"] == 0))
    assert (pager["event_action"], pager["dedup_key"], pager["payload"]["custom_details"]["labels"]) == (
        "trigger", out[0]["fingerprint"], {"service": "api"}
    )
    chat = json.loads(next(r["payload"] for r in out if r["channel"] == "c" and r["event_id"] == 2))
    assert chat["text"].startswith(":white_check_mark: *[RESOLVED][sev2] title 2*")


def observations(spark, rows):
    return spark.createDataFrame(
        [("acme:api", good, START + timedelta(seconds=s)) for good, s in rows], "slo string, good boolean, event_time timestamp"
    )


def test_fast_burn_pages_and_no_errors_is_ok(spark):
    targets = slo.slo_table(spark, [slo.Slo("acme:api", 0.999)])
    burning = [(i >= 500, i * 240 // 10_000) for i in range(10_000)]
    random.Random(1).shuffle(burning)
    for rows, severity in ((burning, "page"), ([(True, i % 240) for i in range(1000)], "ok")):
        minutes = slo.slo_minutes(observations(spark, rows), F.col("good"))
        last = slo.slo_decision(slo.burn_rates(minutes, targets)).orderBy(F.desc("minute")).head()
        assert last["severity"] == severity
        assert (last["burn_long"] >= 14.4 and last["burn_short"] >= 14.4) == (severity == "page")


def test_decisions_equal_loop(spark):
    rng = random.Random(2)
    rows = [(rng.random() < (0.3 if 3000 < m < 3300 else 0.93), m * 60 + rng.randrange(60)) for m in rng.choices(range(6000), k=2500)]
    minutes = slo.slo_minutes(observations(spark, rows), F.col("good"))
    got = slo.slo_decision(slo.burn_rates(minutes, slo.slo_table(spark, [slo.Slo("acme:api", 0.9)]))).collect()
    base = int(START.timestamp()) // 60
    seen = set()
    for r in got:
        now = r["minute"] - base

        def burn(width, now=now):
            inside = [good for good, s in rows if now - width < s // 60 <= now]
            return inside.count(False) / len(inside) / 0.1 if inside else 0.0

        want = ("ok", 0.0, 0.0)
        for long, short, limit, severity in slo.WINDOW_PAIRS:
            b = burn(long), burn(short)
            if b[0] >= limit and b[1] >= limit:
                want = (severity, *b)
                break
            if b[0] > want[1]:
                want = ("ok", *b)
        seen.add(want[0])
        assert r["severity"] == want[0]
        assert (r["burn_long"], r["burn_short"]) == pytest.approx(want[1:])
    assert len(seen) > 1


@pytest.mark.parametrize("args", [("", 0.9), ("x", 0), ("x", 1.1), ("x", 0.9, ())])
def test_bad_slos(args):
    with pytest.raises(ValueError):
        slo.Slo(*args)


def test_slo_alerts_fire_and_resolve(spark):
    rows = [("acme:api", m, s, 2.0, 1.5, 0.1) for m, s in enumerate(["ok", "page", "page", "ticket", "ok"])]
    df = spark.createDataFrame(rows, "slo string, minute long, severity string, burn_long double, burn_short double, error_budget double")
    got = sorted((int(r["occurred_at"].timestamp()) // 60, r["severity"], r["resolved"]) for r in alerts.slo_to_alerts(df).collect())
    assert got == [(1, "page", False), (2, "page", False), (3, "page", True), (3, "ticket", False), (4, "ticket", True)]
    assert alerts.slo_to_alerts(df).head()["description"] == "long-window burn rate: 2.00x; short-window: 1.50x; error budget: 10.000%"


SPEC = ", ".join(["tenant_id string"] + [f"{t}_{n}_days int" for t in ("metrics", "logs", "traces") for n in ("hot", "total")])


def test_retention_specs(spark):
    rows = [("ok", 7, 30), ("inverted", 30, 10), ("negative", -1, 10), ("long", 9999, 0), ("Bad Name", 7, 30), ("zero", 0, 0)]
    good, bad = retention.checked_specs(spark.createDataFrame([(t, *[h, n] * 3) for t, h, n in rows], SPEC))
    assert {r["tenant_id"] for r in good.collect()} == {"ok", "zero"}
    assert {r["tenant_id"]: r["reason"] for r in bad.collect()}["inverted"] == "metrics_total_days below metrics_hot_days"


def test_retention_job_is_repeatable(spark, tmp_path):
    rows = [("a" if i % 2 else "b", "s", "INFO", f"line {i}", {}, START + timedelta(days=i), "", str(i)) for i in range(40)]
    from signalmill.schemas import LOGS

    tables.write_source(spark.createDataFrame(rows, LOGS), "logs", str(tmp_path))
    specs = spark.createDataFrame([("a", *[5, 20] * 3)], SPEC)
    run = lambda as_of: retention.retention_apply(
        spark, f"{tmp_path}/logs", f"{tmp_path}/cold", "logs", specs, as_of=as_of
    ).agg(F.sum("kept"), F.sum("moved"), F.sum("dropped")).head()
    as_of = "2024-02-10 00:00:00"
    # Ages are 1..40 days; a keeps 5 and expires at 20, b keeps 14 and expires at 30.
    ages = {i: 40 - i for i in range(40)}
    want = [0, 0, 0]
    for i, age in ages.items():
        hot, total = (5, 20) if i % 2 else (14, 30)
        want[2 if age >= total else 1 if age >= hot else 0] += 1
    assert list(run(as_of)) == want
    assert list(run(as_of)) == [want[0], 0, 0]
    assert spark.read.parquet(f"{tmp_path}/logs").count() == want[0]
    assert spark.read.parquet(f"{tmp_path}/cold").count() == want[1]
    sizes = {(r["table_name"], r["tier"]): r["files"] for r in retention.storage_tiers(
        spark, {("logs", "hot"): f"{tmp_path}/logs", ("logs", "cold"): f"{tmp_path}/cold"}).collect()}
    assert sizes[("logs", "hot")] > 0 and sizes[("logs", "cold")] > 0


@pytest.mark.parametrize("breaks_at", [1, 4])
def test_an_interrupted_retention_run_loses_and_doubles_nothing(spark, tmp_path, monkeypatch, breaks_at):
    from signalmill.schemas import LOGS

    rows = [(f"t{i % 3}", "s", "INFO", "x", {}, START + timedelta(hours=i), "", str(i)) for i in range(60)]
    tables.write_source(spark.createDataFrame(rows, LOGS), "logs", str(tmp_path))
    specs = spark.createDataFrame([("t0", *[1, 2] * 3)], SPEC)
    run = lambda as_of: retention.retention_apply(spark, f"{tmp_path}/logs", f"{tmp_path}/cold", "logs", specs, as_of=as_of)
    run("2024-01-16 00:00:00")
    swap, calls = retention._swap, []

    def breaking(*args):
        calls.append(args)
        if len(calls) == breaks_at + 1:
            raise OSError("lost")
        swap(*args)

    monkeypatch.setattr(retention, "_swap", breaking)
    try:
        run("2024-01-17 12:00:00")
    except OSError:
        pass
    monkeypatch.setattr(retention, "_swap", swap)
    as_of = datetime(2024, 1, 17, 18, tzinfo=UTC)
    run("2024-01-17 18:00:00")
    want = {"hot": set(), "cold": set()}
    for tenant, *_, at, _, span in rows:
        hot, total = (1, 2) if tenant == "t0" else (14, 30)
        age = as_of - at
        if age < timedelta(days=total):
            want["cold" if age >= timedelta(days=hot) else "hot"].add(span)
    for store, path in (("hot", f"{tmp_path}/logs"), ("cold", f"{tmp_path}/cold")):
        got = [r["span_id"] for r in spark.read.schema(LOGS).parquet(path).collect()] if want[store] else []
        assert sorted(got) == sorted(want[store])
    run("2024-06-01 00:00:00")
    assert not any(n.startswith("date=") for p in ("logs", "cold") for n in listed(spark, f"{tmp_path}/{p}"))


def test_audit_export(spark, tmp_path):
    rows = [(i, None, "ann", "key.issue", None, None, START + timedelta(minutes=i)) for i in range(130)]
    rows += [(200, None, "", "x", None, None, START), (201, None, "bob", None, None, None, START), (202, None, "bob", "x", None, None, None)]
    df = spark.createDataFrame(rows, AUDIT)
    manifest = audit.export_audit(df, f"{tmp_path}/audit", batch_records=50).collect()
    assert sum(r["records"] for r in manifest) == 130
    for r in manifest:
        folder = f"{tmp_path}/audit/y={r['y']}/m={r['m']}/d={r['d']}/h={r['h']}"
        lines = [x["value"] for x in spark.read.text(folder).collect()]
        mine = sorted((x for x in lines if json.loads(x)["id"] // 50 == r["batch"]), key=lambda x: json.loads(x)["id"])
        assert len(mine) == r["records"]
        assert hashlib.sha256("".join(x + "\n" for x in mine).encode()).hexdigest() == r["sha256"]
    assert [r["id"] for r in audit.recent_audit(df, k=2).collect()] == [202, 201]


def odd_silences(rng):
    """Silences that overlap, meet, last an instant or years, or have no start; matchers with empty, missing and null values."""
    matchers = [{}, {"service": "s0"}, {"service": "s1", "team": ""}, {"service": "s1", "team": None}, {"service": "s2", "team": "core"}, {"pod": ""}]
    out = []
    for i in range(300):
        start, length = rng.uniform(-9e5, 9e5), rng.choice([0, 1, 60, 3600, 40_000, 400_000])
        at = lambda s: START + timedelta(seconds=s)
        since = None if i % 97 == 0 else at(start)
        out.append((rng.choice(["t0", "t1", "t2", None]), rng.choice(matchers) if i % 50 else None, since, None if i % 41 == 0 else at(start + length)))
    return [*out, ("t2", {"service": "s0"}, None, START), ("t1", {"pod": ""}, START, START + timedelta(days=9000))]


def covered(tenant, labels, at, silences):
    own = {k: v or "" for k, v in (labels or {}).items()}
    return any(
        t is not None and t == tenant and m is not None and until is not None and at is not None and at < until and (since is None or since <= at)
        and all(own.get(k, "") == (v or "") for k, v in m.items())
        for t, m, since, until in silences
    )


SILENCE = "tenant_id string, matcher map<string,string>, created_at timestamp, expires_at timestamp"


def test_silences_are_found_by_hour(spark):
    rng = random.Random(8)
    silences = odd_silences(rng)
    rows = [
        (i, rng.choice(["t0", "t1", "t2", None]), rng.choice([None, {}, {"service": f"s{i % 4}"}, {"service": f"s{i % 3}", "team": "core", "pod": None}]),
         None if i % 61 == 0 else START + timedelta(seconds=rng.uniform(-1e6, 1e6)))
        for i in range(700)
    ]
    df = spark.createDataFrame(rows, "id long, tenant_id string, labels map<string,string>, at timestamp")
    hits = alerts.silence_hits(df, ["id"], F.col("at"), spark.createDataFrame(silences, SILENCE))
    want = {i for i, tenant, labels, at in rows if covered(tenant, labels, at, silences)}
    assert 100 < len(want) < 600 and {r["id"] for r in hits.collect()} == want


def test_silences_of_a_matcher_come_to_few_spells(spark):
    """Events are compared with spells of their hour, however many silences there are."""
    at = lambda s: START + timedelta(seconds=s)
    rows = [("t", {"service": "api"}, at(s * 10), at(s * 10 + 600)) for s in range(2000)] + [("t", {"service": "api"}, at(10**6), at(10**7))] * 5
    spells = alerts.silence_spells(spark.createDataFrame(rows, SILENCE)).collect()
    assert len(spells) == 6 + 1 and sum(r["_slot"] == alerts.LONG for r in spells) == 1
    assert len({(r["_since"], r["_until"]) for r in spells}) == 2
