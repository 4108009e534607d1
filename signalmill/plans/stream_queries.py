"""Streaming jobs, fed in three slices of the events with a restart before each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalmill.functions.time import half_open_range
from signalmill.operators.cep import HIGH_ERROR_RATE, HIGH_LATENCY
from signalmill.plans import rule_queries as R
from signalmill.plans import views
from signalmill.plans.alert_queries import _LIFECYCLE
from signalmill.plans.ingest_queries import ROUTED_SQL, routed_rows
from signalmill.plans.registry import ORACLES, query
from signalmill.plans.rule_queries import LATENCY_MS, WINDOW
from signalmill.session import scratch_path
from signalmill.sources import envelope
from signalmill.streaming import jobs
from signalmill.streaming.state import Store

# The first and the last slice are open, so that the feed holds every row.
CUTS = (None, "2024-01-10 03:20:30", "2024-01-20 18:45:10", None)


def feed(spark, rows: DataFrame, time: str, start: Callable[[DataFrame], StreamingQuery], cuts=CUTS) -> None:
    """Write the rows slice by slice as files, and run the stream after each slice until it has read them."""
    source = scratch_path(spark, "feed")
    for t0, t1 in zip(cuts, cuts[1:], strict=False):
        rows.where(half_open_range(F.col(time), t0, t1)).write.mode("append").parquet(source)
        start(spark.readStream.schema(rows.schema).parquet(source)).awaitTermination()


def _store(spark, name: str) -> Store:
    return Store(scratch_path(spark, name))


_H = "(epoch_us(timestamp) // 3600000000) * 3600000000"


@query(
    "stream_range_agg",
    f"""SELECT {_H} AS t, service_name AS lbl_service_name, round(sum(value), 6) AS v FROM metrics_v
        WHERE metric_name = 'm_purchase' GROUP BY 1, 2
        HAVING {_H} + 3600000000 <= (SELECT max(epoch_us(timestamp)) FROM metrics_v WHERE metric_name = 'm_purchase') - 60000000""",
)
def stream_range_agg(spark, sf):
    store = _store(spark, "range")
    feed(
        spark, views.metrics(spark, sf), "timestamp",
        lambda s: jobs.write_append(jobs.stream_range_agg(s, "m_purchase", "sum", (), ["service.name"], "1h"), store),
    )
    return spark.read.parquet(store.output_path("rows"))


@query(
    "stream_cep",
    f"""SELECT 'HIGH_ERROR_RATE' AS event_type, tenant_id, service_name, event_time, signal_id, error_rate AS measure
        FROM ({R.HIGH_ERROR_SQL})
        UNION ALL SELECT 'HIGH_LATENCY', tenant_id, service_name, event_time, signal_id, peak_latency FROM ({R.HIGH_LATENCY_SQL})""",
)
def stream_cep(spark, sf):
    store = _store(spark, "cep")
    feed(
        spark, views.rule_rows(spark, sf), "event_time",
        lambda s: jobs.stream_cep(s, store, WINDOW, R.ERROR_RATE, LATENCY_MS),
    )
    keys = ["tenant_id", "service_name", "event_time", "signal_id"]

    def events(name, kind, measure):
        return store.output(spark, name).select(F.lit(kind).alias("event_type"), *keys, F.col(measure).alias("measure"))

    return events("high_error_rate", HIGH_ERROR_RATE, "error_rate").unionByName(
        events("high_latency", HIGH_LATENCY, "peak_latency")
    )


@query("stream_sampler")
def stream_sampler(spark, sf):
    store = _store(spark, "sampler")
    feed(
        spark, views.sampler_rows(spark, sf), "event_time",
        lambda s: jobs.stream_sampler(s, store, R.SAMPLE_RATE, R.SAMPLE_SIZE, ("svc-4",)),
    )
    return store.output(spark, "decisions").select("tenant_id", "signal_id", "keep")


ORACLES["stream_sampler"] = ORACLES["sample_decision"]


@query("stream_anomaly")
def stream_anomaly(spark, sf):
    store = _store(spark, "anomaly")
    feed(spark, views.metrics(spark, sf), "timestamp", lambda s: jobs.stream_anomaly(s, store))
    scores = store.output(spark, "scores").drop("timestamp")
    return R.settled(scores, "baseline")


ORACLES["stream_anomaly"] = ORACLES["anomaly_zscore"]


@query("stream_slo")
def stream_slo(spark, sf):
    store = _store(spark, "slo")
    events = R.slo_events(spark, sf)
    targets = R.slo_targets(events)
    feed(spark, events, "event_time", lambda s: jobs.stream_slo(s, store, targets, F.col("good")))
    return jobs.latest_decisions(store.output(spark, "decisions"))


ORACLES["stream_slo"] = ORACLES["slo_decision"]


@query("stream_alerts")
def stream_alerts(spark, sf):
    store = _store(spark, "alerts")
    hush = views.silences(spark, sf)
    feed(spark, views.alert_events(spark, sf), "occurred_at", lambda s: jobs.stream_alerts(s, store, hush))
    final = jobs.latest_alerts(store.output(spark, "alerts"))
    return final.withColumn("service", F.element_at("labels", F.lit("service"))).drop("labels", "annotations", "rule_id")


ORACLES["stream_alerts"] = ORACLES["alert_lifecycle"]


@query(
    "stream_alert_changes",
    f"""WITH {_LIFECYCLE}
    SELECT fingerprint, event_id, CASE WHEN resolved THEN 'alert.resolved' ELSE 'alert.fired' END AS change_type
    FROM steps WHERE resolved OR (step = 'created' AND event_id NOT IN (SELECT event_id FROM hushed))""",
)
def stream_alert_changes(spark, sf):
    store = _store(spark, "alerts")
    hush = views.silences(spark, sf)
    feed(spark, views.alert_events(spark, sf), "occurred_at", lambda s: jobs.stream_alerts(s, store, hush))
    return store.output(spark, "changes").select("fingerprint", "event_id", "change_type")


@query(
    "log_tail",
    """SELECT epoch_us(timestamp) AS timestamp, severity, service_name, body, span_id FROM logs_v
       WHERE tenant_id = 't1' AND severity = 'ERROR'""",
)
def log_tail(spark, sf):
    store = _store(spark, "tail")
    feed(
        spark, views.logs(spark, sf), "timestamp",
        lambda s: jobs.log_tail(s, store, "t1", severity="ERROR"),
    )
    return store.output(spark, "pages").select("timestamp", "severity", "service_name", "body", "span_id")


@query(
    "stream_ingest",
    f"""{ROUTED_SQL}
    UNION ALL SELECT 'dropped', NULL, tenant_id, reason, '', NULL, count(*) FROM gated WHERE reason IS NOT NULL GROUP BY tenant_id, reason
    UNION ALL SELECT 'dropped', NULL, tenant_id, 'received', '', NULL, count(*) FROM gated GROUP BY tenant_id""",
)
def stream_ingest(spark, sf):
    """All stored rows of a feed whose slices are mixed in time, and the counts of what was dropped."""
    store = _store(spark, "ingest")
    files = scratch_path(spark, "envelopes")
    signals = views.signals(spark, sf)
    part = F.pmod(F.xxhash64(F.element_at("attributes", F.lit("event_id"))), F.lit(3))
    for i in range(3):
        envelope.write_signals(signals.where(part == i), files, mode="append")
        jobs.stream_ingest(envelope.read_signals(spark, files, stream=True), store).awaitTermination()
    stored = routed_rows(*(store.output(spark, name).drop("batch", "date") for name in ("metrics", "logs", "traces")))
    dropped = store.output(spark, "dropped").groupBy("tenant_id", F.col("reason").alias("name")).agg(
        F.sum("n").cast("double").alias("number")
    )
    dropped = dropped.withColumns({"target": F.lit("dropped"), "service": F.lit("")})
    return stored.unionByName(dropped, allowMissingColumns=True)
