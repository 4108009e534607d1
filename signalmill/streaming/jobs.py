"""Streaming jobs.

Keyed ones (rules, sampler, anomalies, burn rates, alerts) keep their state in Spark's state store, see ``keyed``.
``idle`` drops the state of a key that has had no rows for so long (processing time, for triggers that go on); by default it is kept.
"""

from __future__ import annotations

import contextlib
import keyword

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from signalmill.functions import match
from signalmill.functions.time import bucket_number, Duration, duration_text, micros, seconds
from signalmill.operators import alerts, anomaly, cep, clean, ewma, sampling, slo
from signalmill.operators.select import for_tenant
from signalmill.operators.series import _RANGE_AGGREGATES
from signalmill.schemas import ALERTS
from signalmill.streaming import keyed, processors
from signalmill.streaming.state import Store, Tables, run_batches

# Fixed value: rows of one tail page.
TAIL_PAGE = 200


def stream_range_agg(
    stream: DataFrame, metric: str, agg: str = "avg", matchers=(), by=(), step: Duration = "30s",
    watermark: str = "1 minute", tenant: str | None = None,
) -> DataFrame:
    """Range aggregate of a metric stream; a bucket is final once the watermark passes its end."""
    rows = for_tenant(stream, tenant).where((F.col("metric_name") == metric) & match.label_matchers(matchers))
    labels = [match.label("labels", key).alias(match.label_alias(key)) for key in by]
    width = f"{micros(step)} microseconds"
    return (
        rows.withWatermark("timestamp", watermark)
        .groupBy(F.window("timestamp", width).alias("w"), *labels)
        .agg(_RANGE_AGGREGATES[agg]("value").alias("v"))
        .select(F.col("w.start").alias("t"), *map(match.label_alias, by), "v")
    )


def write_append(df: DataFrame, store: Store, name: str = "rows", trigger: dict | None = None) -> StreamingQuery:
    """Append-mode Parquet sink of a streaming frame; by default it ends when all input is read."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", store.output_path(name))
        .option("checkpointLocation", store.checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's watermark has left out, as far as its progress reports go back."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def stream_cep(
    stream: DataFrame, store: Store, window: Duration = cep.WINDOW,
    error_rate: float = cep.ERROR_RATE_THRESHOLD, latency_ms: float = cep.LATENCY_THRESHOLD_MS,
    lateness: Duration | None = None, trigger: dict | None = None, idle: Duration | None = None,
) -> StreamingQuery:
    """Rule events of a stream of logs and spans: outputs ``high_error_rate``, ``high_latency`` and ``late``.

    A service's rows take their place in time: they are held back until it has a row that is newer by ``lateness``
    (default: not at all). Older rows than one passed on, and rows without a time, go to ``late``. Rows come to a service packed;
    its state is a window of minutes. ``signal_id`` is a whole number; a duration that is no number counts as none.
    """
    if latency_ms <= 0:
        raise ValueError("threshold must be positive")
    needed, span = cep.count_threshold(error_rate, window), F.lit(seconds(window))
    rows = stream.select(
        *cep.KEYS, keyed.at_micros("event_time").alias("at_us"), F.col("signal_id").cast("long").alias("signal_id"),
        F.coalesce("is_error", F.lit(False)).alias("is_error"), F.col("duration_ms").cast("double").alias("duration_ms"),
    )
    packed = keyed.packed(rows, cep.KEYS, processors.RULE_COLUMNS)
    order = keyed.Ordered("signal_id", lateness, keyed.ttl(idle, trigger))
    rules = processors.Rules(order, max(1, micros(window) // micros("1m")), needed, float(latency_ms))
    found = keyed.transform(packed, cep.KEYS, rules, processors.RULE_RESULT, idle)
    at = [*cep.KEYS, keyed.time_of("at").alias("event_time"), "signal_id"]
    text = F.lit(duration_text(window)).alias("window")
    outputs = {
        "high_error_rate": [
            *at, (F.col("count") / span).alias("error_rate"), (F.col("count") / F.col("total")).alias("error_ratio"),
            (F.col("total") / span).alias("total_rate"), text,
        ],
        "high_latency": [*at, F.col("duration_ms").alias("peak_latency"), F.lit(float(latency_ms)).alias("threshold"), text],
        "late": [*at, "is_error", "duration_ms"],
    }
    return keyed.write_outputs(found, store, outputs, trigger)


#: How long a trace's last sighting is remembered at least, in event time: spans may come that much out of order.
REMEMBERED = "1h"
#: Keys that a tenant's traces, and rows that a step passes by, are spread over.
SPREAD = 64


def sampled(
    spans: DataFrame, rate: float, max_size: int, boosted_services: tuple[str, ...] = sampling.BOOSTED_SERVICES,
    recent: Duration = sampling.RECENT, remembered: Duration = REMEMBERED,
) -> DataFrame:
    """A stream of spans with ``score`` and ``keep``, in three keyed steps: service, trace, tenant.

    A span is decided in the micro-batch that brings it, those of a micro-batch in time order, so no span waits or
    is lost, and nobody's clock touches another's traces. A trace counts as recent while one of its spans lies within ``recent``.
    What a step has no say on passes it under keys of its own, spread by hash: a tenant's step sees one span for each trace and ``recent``.
    """
    limit = sampling.queue_limit(rate, max_size)
    aside = F.concat(F.lit(processors.ASIDE), F.pmod(F.xxhash64("signal_id"), F.lit(SPREAD)).cast("string"))
    columns = spans.columns
    measured = (F.col("type") == "TRACE") & F.col("duration_ms").isNotNull() & ~F.isnan("duration_ms") & (F.col("service_name") != "")
    traced = (F.col("type") == "TRACE") & (F.coalesce("trace_id", F.lit("")) != "")

    def step(rows: DataFrame, group: str, takes_part: Column, name: Column, processor, added: str) -> DataFrame:
        rows = rows.withColumn(group, F.when(takes_part, F.concat(F.lit("+"), name)).otherwise(aside))
        schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(added).fields])
        return keyed.transform(rows, ["tenant_id", group], processor, schema).drop(group)

    # Frames rename columns whose names are no attributes.
    odd = {c: f"c{i}_" for i, c in enumerate(columns) if c.startswith("_") or not c.isidentifier() or keyword.iskeyword(c)}
    rows = spans.withColumnsRenamed(odd).withColumn("at_us", keyed.at_micros("event_time"))
    rows = step(
        rows, "service_key", measured, F.col("service_name"), processors.ServiceBaseline(ewma.ALPHA), "mean0 double, var0 double, n0 long"
    )
    z = ewma.zscore(F.col("duration_ms"), F.col("mean0"), F.col("var0"), F.col("n0"), ewma.MIN_SAMPLES)
    rows = rows.withColumn("z", F.when(measured, z).otherwise(0.0))
    rows = rows.withColumn("score", sampling.span_score(boosted_services)).drop("mean0", "var0", "n0", "z")
    back = {new: old for old, new in odd.items()}
    if limit is None:
        return rows.withColumn("keep", F.lit(True)).drop("at_us").withColumnsRenamed(back)
    rows = step(
        rows, "trace_key", traced, F.pmod(F.xxhash64("trace_id"), F.lit(SPREAD)).cast("string"),
        processors.TraceRecency(micros(recent), max(micros(recent), micros(remembered))), "unseen boolean",
    )
    rows = step(rows, "queue_key", F.col("unseen"), F.lit(""), processors.Queue(limit, sampling.KEEP_SCORE), "keep boolean")
    return rows.drop("at_us", "unseen").withColumnsRenamed(back)


def stream_sampler(
    stream: DataFrame, store: Store, rate: float, max_size: int,
    boosted_services: tuple[str, ...] = sampling.BOOSTED_SERVICES, recent: Duration = sampling.RECENT,
    trigger: dict | None = None, remembered: Duration = REMEMBERED,
) -> StreamingQuery:
    """Score and keep decision of every span of a stream: output ``decisions``; see :func:`sampled`."""
    rows = sampled(stream, rate, max_size, boosted_services, recent, remembered)
    columns = rows.columns
    return keyed.write_outputs(rows.withColumn("output", F.lit("decisions")), store, {"decisions": columns}, trigger)


def stream_anomaly(
    stream: DataFrame, store: Store, alpha: float = ewma.ALPHA, warmup: int = anomaly.WARMUP,
    z: float = anomaly.Z_THRESHOLD, lateness: Duration | None = None, trigger: dict | None = None, idle: Duration | None = None,
) -> StreamingQuery:
    """Anomaly scores of a metric stream: outputs ``scores`` and ``late``; samples take their place in time as rows of rules do."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    keys, value = ["tenant_id", "metric_name"], F.col("value").cast("double")
    rows = stream.where(F.col("value").isNotNull() & ~F.isnan(value)).select(
        *keys, keyed.at_micros("timestamp").alias("at_us"), F.col("signal_id").cast("long").alias("signal_id"), value.alias("value")
    )
    packed = keyed.packed(rows, keys, processors.SAMPLE_COLUMNS)
    processor = processors.Baseline(keyed.Ordered("signal_id", lateness, keyed.ttl(idle, trigger)), alpha)
    schema = "tenant_id string, metric_name string, output string, at long, signal_id long, value double, mean double, var double, n long"
    found = keyed.transform(packed, keys, processor, schema, idle)
    found = found.withColumn("score", ewma.zscore(F.col("value"), F.col("mean"), F.col("var"), F.col("n"), warmup))
    sample = [*keys, keyed.time_of("at").alias("timestamp"), "value", "signal_id"]
    scores = [
        *sample, "score", F.col("mean").alias("baseline"), F.lit(float(z)).alias("threshold"), (F.abs("score") >= z).alias("anomaly"),
    ]
    return keyed.write_outputs(found, store, {"scores": scores, "late": sample}, trigger)


def stream_slo(
    stream: DataFrame, store: Store, targets: DataFrame, good: Column, pairs=slo.WINDOW_PAIRS,
    lateness: Duration | None = None, trigger: dict | None = None, idle: Duration | None = None,
) -> StreamingQuery:
    """Burn decisions of an SLO event stream: outputs ``decisions`` and ``late`` (counts by minute).

    Tasks count their rows by minute before an SLO's minutes come together. Rows out of order by up to ``lateness`` count in their minute;
    all minutes from there on are decided again, and the decision of the greatest ``revision`` holds (:func:`latest_decisions`).
    """
    windows = slo.window_minutes(pairs)
    minute = F.coalesce(bucket_number(F.col("event_time"), "1m"), F.lit(keyed.NO_TIME))
    rows = stream.select("slo", minute.alias("minute"), F.coalesce(good, F.lit(False)).alias("_ok"))
    counted = rows.mapInArrow(_minute_counts, T.StructType([rows.schema["slo"], *T.StructType.fromDDL("minute long, good long, bad long").fields]))
    # A whole minute more: a lateness need not end with one.
    late = -(-micros(lateness) // micros("1m")) if lateness else 0
    processor = processors.Minutes(windows, late, keyed.ttl(idle, trigger))
    sums = ", ".join(f"good_{w} long, bad_{w} long" for w in windows)
    found = keyed.transform(counted, ["slo"], processor, f"slo string, output string, minute long, revision long, {sums}, good long, bad long", idle)
    found = found.join(targets, "slo", "left").where((F.col("output") == "late") | F.col("target").isNotNull())
    budget = 1 - F.col("target")
    burns = found.withColumns({f"burn_{w}": slo.burn_of(F.col(f"good_{w}"), F.col(f"bad_{w}"), budget) for w in windows})
    decided = slo.slo_decision(burns, pairs, keep=["output", "revision", "good", "bad"])
    names = ["slo", "minute", "severity", "burn_long", "burn_short", "long_s", "short_s", "error_budget", "revision"]
    at = F.when(F.col("minute") != keyed.NO_TIME, F.col("minute")).alias("minute")
    return keyed.write_outputs(decided, store, {"decisions": names, "late": ["slo", at, "good", "bad"]}, trigger)


def _minute_counts(batches):
    """Good and bad rows of each Arrow batch by SLO and minute."""
    for batch in batches:
        if len(batch):
            group, first = keyed.key_groups([batch.column(0), batch.column(1)])
            ok = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            good, every = (np.bincount(group, w, len(first)).astype(np.int64) for w in (ok, None))
            named = [batch.column(i).take(pa.array(first)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*named, pa.array(good), pa.array(every - good)], names=["slo", "minute", "good", "bad"])


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """One decision per SLO and minute, the last that was made."""
    rest = [c for c in decisions.columns if c not in ("slo", "minute")]
    latest = decisions.groupBy("slo", "minute").agg(F.max_by(F.struct(*rest), "revision").alias("_d"))
    return latest.select("slo", "minute", "_d.*").drop("revision")


_TEXTS = ["tenant_id", "rule_id", "severity", "title", "description", "labels", "annotations"]
_MOMENTS = ("starts_at", "last_seen_at", "resolved_at", "notified_at")


def stream_alerts(
    stream: DataFrame, store: Store, silences: DataFrame | None = None, row_id: str = "event_id",
    lateness: Duration | None = None, trigger: dict | None = None, idle: Duration | None = None,
) -> StreamingQuery:
    """Alert lifecycle of an alert event stream.

    Outputs ``changes`` (alert.fired for unsilenced transitions, alert.resolved for every resolve event), ``alerts`` (the
    row of an alert whenever a micro-batch changed it; :func:`latest_alerts` gives the table) and ``late``. A micro-batch touches its own
    alerts only. Events take their place in time per alert, as rows of rules do. Silences are read anew by every micro-batch.
    """
    rows = stream if "fingerprint" in stream.columns else alerts.alert_fingerprint(stream)
    rows = rows.withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    # Times travel as whole numbers: JSON would round them.
    moments = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.TimestampType)]
    whole = F.to_json(F.struct(*[F.unix_micros(c).alias(c) if c in moments else F.col(c) for c in rows.columns]))
    noted = rows.withColumns({"_hushed": F.lit(False), "_vote": F.lit(False)}) if silences is None else _with_votes(rows, silences)
    events = noted.select(
        "fingerprint", keyed.at_micros("occurred_at").alias("at_us"), row_id, "resolved", F.col("_hushed").alias("hushed"),
        F.col("_vote").alias("vote"), F.to_json(F.struct(*_TEXTS)).alias("texts"), F.when(~F.col("_vote"), whole).alias("whole"),
    )
    processor = processors.Alert(keyed.Ordered(row_id, lateness, keyed.ttl(idle, trigger)))
    found = keyed.transform(events, ["fingerprint"], processor, "fingerprint string, output string, row string, revision long", idle)
    sent = T.StructType([T.StructField(f.name, T.LongType() if f.name in moments else f.dataType) for f in rows.schema.fields])
    event = F.from_json("row", sent)
    own = [(F.timestamp_micros(event[c]) if c in moments else event[c]).alias(c) for c in rows.columns]
    state = T.StructType([T.StructField(c, T.LongType()) for c in (*_MOMENTS, "notify_count")] + [T.StructField(c, T.StringType()) for c in ("texts", "state")])
    row = F.from_json("row", state)
    texts = F.from_json(row["texts"], T.StructType([ALERTS[c] for c in _TEXTS]))
    table = {c: texts[c] for c in _TEXTS} | {c: F.timestamp_micros(row[c]) for c in _MOMENTS}
    table |= {"fingerprint": F.col("fingerprint"), "state": row["state"], "notify_count": F.coalesce(row["notify_count"], F.lit(0))}
    changed = found.withColumn("_kind", F.col("output")).withColumn("output", F.when(F.col("output").isin("alerts", "late"), F.col("output")).otherwise("changes"))
    outputs = {
        "changes": [*own, F.col("_kind").alias("change_type")], "late": own,
        "alerts": [*[table[c].alias(c) for c in ALERTS.names], "revision"],
    }
    return keyed.write_outputs(changed, store, outputs, trigger)


def latest_alerts(changed: DataFrame) -> DataFrame:
    """The alert table: each alert's last row."""
    rest = ALERTS.names[1:]
    latest = changed.groupBy("fingerprint").agg(F.max_by(F.struct(*rest), "revision").alias("_a"))
    return latest.select("fingerprint", *[F.col(f"_a.{c}").alias(c) for c in rest])


def _with_votes(rows: DataFrame, silences: DataFrame) -> DataFrame:
    """Alert events with ``_hushed``, and further rows (``_vote``) for events that a silence covers which lies under a pair of their labels.

    The events' own rows look silences up that lie under no pair. An event's row and votes agree in ``texts`` and time.
    """
    spells = alerts.silence_spells(silences)
    named = F.collect_list(F.struct("_matcher", "_since", "_until"))
    by_hour = spells.where(F.col("_slot") != alerts.LONG).groupBy("_tenant", "_anchor", "_slot").agg(named.alias("_near"))
    long = spells.where(F.col("_slot") == alerts.LONG).groupBy(F.col("_tenant").alias("_owner"), F.col("_anchor").alias("_pair")).agg(
        named.alias("_far")
    )
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    found = rows.select("*", F.posexplode(alerts.label_anchors(labels)).alias("_n", "_key"))
    here = (F.col("tenant_id") == F.col("_tenant")) & (F.col("_key") == F.col("_anchor"))
    found = found.join(by_hour, here & (alerts.slot_of(F.col("occurred_at")) == F.col("_slot")), "left")
    found = found.join(long, (F.col("tenant_id") == F.col("_owner")) & (F.col("_key") == F.col("_pair")), "left")
    hit = lambda spells: F.exists(spells, lambda s: alerts.spell_covers(s, labels, F.col("occurred_at")))
    hushed = F.coalesce(hit("_near"), F.lit(False)) | F.coalesce(hit("_far"), F.lit(False))
    found = found.withColumns({"_hushed": hushed, "_vote": F.col("_n") > 0}).where(~F.col("_vote") | F.col("_hushed"))
    return found.select(*rows.columns, "_hushed", "_vote")


def log_tail(
    stream: DataFrame, store: Store, tenant: str, service: str | None = None, severity: str | None = None,
    page: int = TAIL_PAGE, trigger: dict | None = None,
) -> StreamingQuery:
    """New log rows of a tenant, each batch's in time order, in files of at most ``page`` rows: output ``pages``.

    A live tail runs with ``trigger={"processingTime": "1 second"}``.

    The source's offsets are the cursor, so rows of equal time at a page's end are not lost.
    """
    rows = for_tenant(stream, tenant).where(
        match.any_of_values(F.col("service_name"), service) & match.any_of_values(F.col("severity"), severity)
    )

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.orderBy("timestamp", "span_id").write.mode("overwrite").option("maxRecordsPerFile", page).parquet(
            f"{store.output_path('pages')}/batch={batch_id}"
        )

    writer = rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", store.checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_ingest(
    stream: DataFrame, store: Store, version: str = "1.0.0", at=None, strict: bool = False,
    rate: float = 1.0, max_size: int = 10_000, boosted_services: tuple[str, ...] = sampling.BOOSTED_SERVICES,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Signals through the gates, the stamp and the sampler into the stored tables.

    Every readable signal with a tenant and a valid payload is stored, whenever it arrives; one without
    a time gets that of its arrival. Outputs ``metrics``, ``logs``, ``traces``, ``rejects`` (the rows
    that did not pass a gate, with the reason) and ``dropped`` (counts per tenant, type and reason).
    """
    rows = stream.withColumn("received_at", F.coalesce("received_at", F.current_timestamp()))
    # A rate of 1 keeps every span, so nothing has to be scored.
    sampling_on = sampling.queue_limit(rate, max_size) is not None
    if sampling_on:
        rows = _kept_signals(rows, strict, rate, max_size, boosted_services)

    def step(rows: DataFrame) -> Tables:
        keep = F.col("keep") if sampling_on else F.lit(True)
        decoded, bad_payload = clean.decode_gate(rows, strict)
        kept, no_tenant = clean.tenant_gate(decoded)
        rejects = bad_payload.unionByName(no_tenant)
        stamped = clean.enrich_stamp(kept.drop("_corrupt_record"), version, at)
        sampled_out = stamped.where(~keep).withColumn("reason", F.lit("sampled_out"))
        stamped, rejects = (df.drop("keep") for df in (stamped.where(keep), rejects))
        metrics, logs, traces = clean.route_signals(stamped)
        outputs = {
            "metrics": metrics.withColumn("date", F.to_date("timestamp")),
            "logs": logs.withColumn("date", F.to_date("timestamp")),
            "traces": traces.withColumn("date", F.to_date("start_time")),
            "rejects": rejects,
            "dropped": clean.drop_accounting(stamped, bad_payload, no_tenant, sampled_out),
        }
        return outputs

    by_day = {name: ["date", "tenant_id"] for name in ("metrics", "logs", "traces")}
    with keyed.state_store(rows.sparkSession) if sampling_on else contextlib.nullcontext():
        return run_batches(rows, store, step, trigger, by_day)


def _kept_signals(rows: DataFrame, strict: bool, rate: float, max_size: int, boosted_services: tuple[str, ...]) -> DataFrame:
    """Signals with the sampler's decision ``keep``; only spans that pass the gates are put to it."""
    text = lambda key: match.label("attributes", key)
    passes = clean.passes_gates(rows, strict)
    span = F.coalesce((F.col("type") == "TRACE") & passes, F.lit(False))
    service = F.when(cep.service_of() == "unknown", "").otherwise(cep.service_of())
    seen = rows.select(
        *[F.col(c).alias(f"s_{c}") for c in rows.columns], F.when(span, "TRACE").otherwise("").alias("type"), "tenant_id", "attributes",
        F.col("received_at").alias("event_time"),
        F.xxhash64("tenant_id", text("trace_id"), text("span_id"), "received_at").alias("signal_id"),
        service.alias("service_name"), text("trace_id").alias("trace_id"), text("severity").alias("severity"),
        text("duration_ms").try_cast("double").alias("duration_ms"),
    )
    decided = sampled(seen, rate, max_size, boosted_services)
    return decided.select(*[F.col(f"s_{c}").alias(c) for c in rows.columns], "keep")

