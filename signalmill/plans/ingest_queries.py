"""Ingest: envelopes, OTLP, StatsD, gates, routing and hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.functions import match
from signalmill.operators import clean, enrich
from signalmill.plans import views
from signalmill.plans.registry import query
from signalmill.plans.views import AS_OF
from signalmill.session import scratch_path
from signalmill.sources import envelope, otlp, statsd


def _event_id():
    return match.label("attributes", "event_id").cast("long").alias("event_id")


def _envelopes(spark, sf):
    path = scratch_path(spark, "envelopes")
    envelope.write_signals(views.signals(spark, sf), path)
    return path


@query(
    "read_signals",
    """SELECT event_id, CASE WHEN tenant_id = '' THEN 't1' ELSE tenant_id END AS tenant_id, type, payload,
              epoch_us(ts) AS received_at
       FROM signals_v WHERE tenant_id IN ('', 't1')""",
)
def read_signals(spark, sf):
    kept, _ = envelope.accept_tenant(envelope.read_signals(spark, _envelopes(spark, sf)), "t1")
    return kept.select(_event_id(), "tenant_id", "type", F.col("payload"), "received_at")


@query(
    "decode_gate",
    """SELECT event_id, tenant_id, type,
              CASE WHEN type = 'METRIC' AND payload <> '' AND NOT json_valid(payload) THEN 'decode' ELSE '' END AS reason
       FROM signals_v""",
)
def decode_gate(spark, sf):
    kept, rejects = clean.decode_gate(views.signals(spark, sf))
    cols = [_event_id(), "tenant_id", "type"]
    return kept.select(*cols, F.lit("").alias("reason")).unionByName(rejects.select(*cols, "reason"))


@query(
    "decode_gate_strict",
    """SELECT event_id, CASE WHEN payload <> '' AND NOT json_valid(payload) THEN 'decode' ELSE '' END AS reason
       FROM signals_v""",
)
def decode_gate_strict(spark, sf):
    kept, rejects = clean.decode_gate(views.signals(spark, sf), strict=True)
    return kept.select(_event_id(), F.lit("").alias("reason")).unionByName(rejects.select(_event_id(), "reason"))


@query("tenant_gate", "SELECT event_id, tenant_id FROM signals_v WHERE tenant_id <> ''")
def tenant_gate(spark, sf):
    kept, _ = clean.tenant_gate(views.signals(spark, sf))
    return kept.select(_event_id(), "tenant_id")


@query(
    "enrich_stamp",
    """SELECT event_id, '1.0.0' AS version, '2024-01-31T00:00:00.000000Z' AS stamped_at, service_name FROM signals_v""",
)
def enrich_stamp(spark, sf):
    stamped = clean.enrich_stamp(views.signals(spark, sf), "1.0.0", AS_OF)
    return stamped.select(
        _event_id(),
        match.label("attributes", "ingest.version").alias("version"),
        match.label("attributes", "ingest.at").alias("stamped_at"),
        match.label("attributes", "service.name").alias("service_name"),
    )


_GATED = """gated AS (SELECT *, CASE WHEN type = 'METRIC' AND payload <> '' AND NOT json_valid(payload) THEN 'decode'
                              WHEN tenant_id = '' THEN 'no_tenant' END AS reason FROM signals_v)"""


def _gated(spark, sf):
    decoded, bad_payload = clean.decode_gate(views.signals(spark, sf))
    kept, no_tenant = clean.tenant_gate(decoded)
    return kept, bad_payload, no_tenant


@query(
    "drop_accounting",
    f"""WITH {_GATED}
    SELECT tenant_id, type, 'received' AS reason, count(*) AS n FROM gated GROUP BY 1, 2
    UNION ALL SELECT tenant_id, type, reason, count(*) FROM gated WHERE reason IS NOT NULL GROUP BY 1, 2, 3""",
)
def drop_accounting(spark, sf):
    return clean.drop_accounting(*_gated(spark, sf))


_METRIC_SQL = """SELECT event_id, CASE event_type WHEN 'click' THEN 'm_click' ELSE 'm_purchase' END AS metric_name,
    round(CASE event_type WHEN 'click' THEN CAST(user_id AS DOUBLE) ELSE value END, 6) AS value"""


@query("metric_payload", f"WITH {_GATED} {_METRIC_SQL} FROM gated WHERE reason IS NULL AND type = 'METRIC'")
def metric_payload(spark, sf):
    kept, _, _ = _gated(spark, sf)
    return clean.metric_payload(kept.where("type = 'METRIC'")).select(_event_id(), "metric_name", "value")


ROUTED_SQL = f"""WITH {_GATED}
    SELECT 'metrics' AS target, event_id, tenant_id, CASE event_type WHEN 'click' THEN 'm_click' ELSE 'm_purchase' END AS name,
           service_name AS service, epoch_us(ts) AS at,
           round(CASE event_type WHEN 'click' THEN CAST(user_id AS DOUBLE) ELSE value END, 6) AS number
    FROM gated WHERE reason IS NULL AND type = 'METRIC'
    UNION ALL SELECT 'logs', event_id, tenant_id, payload, service_name, epoch_us(ts), 0 FROM gated WHERE reason IS NULL AND type = 'LOG'
    UNION ALL SELECT 'traces', event_id, tenant_id, event_type, service_name, epoch_us(ts), round(round(value * 1000000), 6)
    FROM gated WHERE reason IS NULL AND type = 'TRACE'"""


def routed_rows(metrics, logs, traces):
    """The three tables in one shape."""
    def rows(df, target, attributes, name, service, at, number):
        event_id = match.label(attributes, "event_id").cast("long").alias("event_id")
        return df.select(
            F.lit(target).alias("target"), event_id, "tenant_id", F.col(name).alias("name"), service.alias("service"),
            F.col(at).alias("at"), number.cast("double").alias("number"),
        )

    return (
        rows(metrics, "metrics", "labels", "metric_name", match.label("labels", "service.name"), "timestamp", F.col("value"))
        .unionByName(rows(logs, "logs", "attributes", "body", F.col("service_name"), "timestamp", F.lit(0)))
        .unionByName(
            rows(traces, "traces", "attributes", "operation_name", F.col("service_name"), "start_time", F.col("duration_ns"))
        )
    )


@query("route_signals", ROUTED_SQL)
def route_signals(spark, sf):
    kept, _, _ = _gated(spark, sf)
    return routed_rows(*clean.route_signals(kept))



_LINE_SQL = """CASE event_type
    WHEN 'click' THEN concat('  m_click:', CAST(user_id AS VARCHAR), '|c|@0.', CAST(user_id % 10 AS VARCHAR), '|#user:8,env:prod,flag,env:test')
    WHEN 'view' THEN concat('m_view:', CAST(user_id AS VARCHAR), '|ms|@2|#user:', CAST(user_id AS VARCHAR))
    WHEN 'purchase' THEN concat('m_purchase:', CAST(user_id AS VARCHAR), '|', CASE WHEN user_id % 2 = 0 THEN 'g' ELSE 'x' END)
    WHEN 'signup' THEN concat('m_signup ', CAST(user_id AS VARCHAR), '|c')
    ELSE concat(':', CAST(user_id AS VARCHAR), '|s') END"""


def statsd_lines(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    tenth = F.pmod("user_id", F.lit(10)).cast("string")
    line = (
        F.when(kind == "click", F.concat(F.lit("  m_click:"), user, F.lit("|c|@0."), tenth, F.lit("|#user:8,env:prod,flag,env:test")))
        .when(kind == "view", F.concat(F.lit("m_view:"), user, F.lit("|ms|@2|#user:"), user))
        .when(kind == "purchase", F.concat(F.lit("m_purchase:"), user, F.when(F.pmod("user_id", F.lit(2)) == 0, "|g").otherwise("|x")))
        .when(kind == "signup", F.concat(F.lit("m_signup "), user, F.lit("|c")))
        .otherwise(F.concat(F.lit(":"), user, F.lit("|s")))
    )
    return views.base(spark, sf).select(line.alias("value"), "ts")


@query(
    "statsd_metrics",
    f"""WITH lines AS (SELECT event_type, user_id, ts, {_LINE_SQL} AS line FROM base),
    good AS (SELECT * FROM lines WHERE event_type IN ('click', 'view') OR (event_type = 'purchase' AND user_id % 2 = 0))
    SELECT 'metric' AS kind, concat('m_', event_type) AS name,
           CASE event_type WHEN 'click' THEN 'c' WHEN 'view' THEN 'ms' ELSE 'g' END AS metric_type,
           CAST(user_id AS DOUBLE) AS value,
           CASE WHEN event_type = 'click' AND user_id % 10 > 0 THEN round((user_id % 10) / 10, 6) END AS sample_rate,
           CASE event_type
                WHEN 'click' THEN concat('metric_type=c,', CASE WHEN user_id % 10 > 0 THEN concat('sample_rate=0.', CAST(user_id % 10 AS VARCHAR), ',') ELSE '' END,
                                         'source=statsd,tag.env=test,tag.flag=,tag.user=8')
                WHEN 'view' THEN concat('metric_type=ms,source=statsd,tag.user=', CAST(user_id AS VARCHAR))
                ELSE 'metric_type=g,source=statsd' END AS labels,
           epoch_us(ts) AS timestamp
    FROM good
    UNION ALL
    SELECT 'reject', line, NULL, NULL, NULL, NULL, NULL FROM lines
    WHERE NOT (event_type IN ('click', 'view') OR (event_type = 'purchase' AND user_id % 2 = 0))""",
)
def statsd_metrics(spark, sf):
    metrics, rejects = statsd.statsd_metrics(statsd_lines(spark, sf), "t0", received_at=F.col("ts"))
    good = metrics.select(
        F.lit("metric").alias("kind"), F.col("metric_name").alias("name"), "metric_type", "value", "sample_rate",
        match.labels_text("labels").alias("labels"), "timestamp",
    )
    bad = rejects.select(F.lit("reject").alias("kind"), F.col("line").alias("name"))
    return good.unionByName(bad, allowMissingColumns=True)


def _kv(key, **value):
    ((kind, col),) = value.items()
    return F.struct(F.lit(key).alias("key"), F.struct(col.alias(kind)).alias("value"))


def _resource(*pairs):
    return F.to_json(F.struct(F.array(*pairs).alias("attributes")))


def _nanos(us):
    return F.concat(us.cast("string"), F.lit("000"))


def _json_list(*texts):
    return F.concat(F.lit("["), F.concat_ws(",", *texts), F.lit("]"))


def _request(kind, scope_key, record_key, resource, *records):
    """One export request per event with one resource, one scope and the given records."""
    return F.concat(
        F.lit(f'{{"resource{kind}":[{{"resource":'), resource,
        F.lit(f',"scope{kind}":[{{"scope":{{"name":"lib"}},"{record_key}":'), _json_list(*records), F.lit("}]}]}"),
    )


def _written_lines(df, spark, name):
    path = scratch_path(spark, name)
    df.write.text(path)
    return path


@query(
    "otlp_traces",
    """SELECT 't0' AS tenant_id, lpad(lower(to_hex(event_id)), 32, '0') AS trace_id, lpad(lower(to_hex(event_id * 2 + i)), 16, '0') AS span_id,
              CASE i WHEN 0 THEN '' ELSE lpad(lower(to_hex(event_id * 2)), 16, '0') END AS parent_span_id,
              event_type AS operation_name, CASE i WHEN 0 THEN service_name ELSE 'db' END AS service_name,
              epoch_us(ts) + i AS start_time, epoch_us(ts) + i + CAST(round(value * 1000) AS BIGINT) AS end_time,
              CAST(round(value * 1000) AS BIGINT) * 1000 AS duration_ns,
              CASE WHEN event_type = 'error' AND i = 0 THEN 'ERROR' ELSE '' END AS status_code,
              concat(CASE WHEN CAST(round(value * 1000) AS BIGINT) > 0 THEN concat('duration_ms=', printf('%.3f', CAST(round(value * 1000) AS BIGINT) / 1000), ',') ELSE '' END,
                     'otel.scope.name=lib,service.name=', CASE i WHEN 0 THEN service_name ELSE 'db' END,
                     CASE WHEN event_type = 'error' AND i = 0 THEN ',severity=ERROR' ELSE '' END,
                     ',span.kind=SPAN_KIND_SERVER',
                     CASE WHEN event_type = 'error' AND i = 0 THEN ',status.message=boom' ELSE '' END,
                     CASE i WHEN 0 THEN concat(',tags=[a,', CAST(user_id AS VARCHAR), ']') ELSE '' END) AS attributes
       FROM base, range(2) r(i)""",
)
def otlp_traces(spark, sf):
    us = F.unix_micros("ts")
    duration = F.round(F.col("value") * 1000).cast("long")
    hex_id = lambda n, width: F.lower(F.lpad(F.hex(n), width, "0"))

    def span(i, parent, attributes, status):
        return F.to_json(
            F.struct(
                F.upper(hex_id(F.col("event_id"), 32)).alias("traceId"),
                hex_id(F.col("event_id") * 2 + i, 16).alias("spanId"),
                parent.alias("parentSpanId"),
                F.col("event_type").alias("name"),
                F.lit(2).alias("kind"),
                _nanos(us + i).alias("startTimeUnixNano"),
                _nanos(us + i + duration).alias("endTimeUnixNano"),
                F.array(*attributes).alias("attributes"),
                status.alias("status"),
            )
        )

    tags = F.struct(
        F.lit("tags").alias("key"),
        F.from_json(
            F.concat(F.lit('{"arrayValue":{"values":[{"stringValue":"a"},{"intValue":"'), F.col("user_id").cast("string"), F.lit('"}]}}')),
            "arrayValue struct<values:array<struct<stringValue:string,intValue:string>>>, stringValue string",
        ).alias("value"),
    )
    none = F.lit(None).cast("arrayValue struct<values:array<struct<stringValue:string,intValue:string>>>".replace("arrayValue ", ""))
    db = F.struct(
        F.lit("service.name").alias("key"), F.struct(none.alias("arrayValue"), F.lit("db").alias("stringValue")).alias("value")
    )
    failed = F.when(
        F.col("event_type") == "error", F.struct(F.lit(2).alias("code"), F.lit("boom").alias("message"))
    )
    first = span(0, F.lit(None).cast("string"), [tags], failed)
    second = span(1, hex_id(F.col("event_id") * 2, 16), [db], F.lit(None).cast("struct<code:int,message:string>"))
    resource = _resource(_kv("service.name", stringValue=F.col("service_name")))
    lines = views.base(spark, sf).select(_request("Spans", "scope", "spans", resource, first, second))
    rows = otlp.otlp_traces(otlp.read_otlp(spark, _written_lines(lines, spark, "otlp"), "traces"), "t0", AS_OF)
    return rows.withColumn("attributes", match.labels_text("attributes"))


@query(
    "otlp_metrics",
    """SELECT 't0' AS tenant_id, concat('m_', event_type) AS metric_name, epoch_us(ts) AS timestamp,
              round(CASE event_type WHEN 'click' THEN CAST(user_id AS DOUBLE) ELSE value END, 6) AS value,
              concat(CASE event_type WHEN 'click' THEN 'method=GET,' ELSE '' END, 'metric_unit=ms,otel.scope.name=lib,ratio=1.5,service.name=', service_name) AS labels,
              CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN user_id END AS count,
              round(CASE WHEN event_type IN ('purchase', 'signup', 'error') THEN value END, 6) AS sum,
              CASE event_type WHEN 'click' THEN 'AGGREGATION_TEMPORALITY_CUMULATIVE' END AS temporality, 'ms' AS unit
       FROM base""",
)
def otlp_metrics(spark, sf):
    us, kind = F.unix_micros("ts"), F.col("event_type")
    at, user = _nanos(us).alias("timeUnixNano"), F.col("user_id").cast("string")
    counted = F.struct(at, user.alias("count"), F.col("value").alias("sum"))

    def metric(**data):
        ((name, body),) = data.items()
        return F.to_json(F.struct(F.concat(F.lit("m_"), kind).alias("name"), F.lit("ms").alias("unit"), body.alias(name)))

    def points(point):
        return F.struct(F.array(point).alias("dataPoints"))

    method = F.array(_kv("method", stringValue=F.lit("GET")))
    total = F.struct(
        F.array(F.struct(method.alias("attributes"), at, user.alias("asInt"))).alias("dataPoints"),
        F.lit(2).alias("aggregationTemporality"),
    )
    record = (
        F.when(kind == "click", metric(sum=total))
        .when(kind == "view", metric(gauge=points(F.struct(at, F.col("value").alias("asDouble")))))
        .when(kind == "purchase", metric(histogram=points(counted)))
        .when(kind == "signup", metric(exponentialHistogram=points(counted)))
        .otherwise(metric(summary=points(counted)))
    )
    service = F.to_json(F.struct(F.array(_kv("service.name", stringValue=F.col("service_name"))).alias("attributes")))
    resource = F.regexp_replace(service, r"\]\}$", ',{"key":"ratio","value":{"doubleValue":1.5}}]}')
    lines = views.base(spark, sf).select(_request("Metrics", "scope", "metrics", resource, record))
    rows = otlp.otlp_metrics(otlp.read_otlp(spark, _written_lines(lines, spark, "otlp"), "metrics"), "t0", AS_OF)
    return rows.drop("received_at").withColumn("labels", match.labels_text("labels"))


@query(
    "otlp_logs",
    f"""SELECT 't0' AS tenant_id, service_name, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' ELSE '' END AS severity,
               CASE event_type WHEN 'click' THEN 'true' WHEN 'view' THEN CAST(user_id AS VARCHAR) ELSE concat('boom ', CAST(user_id AS VARCHAR)) END AS body,
               CASE event_type WHEN 'signup' THEN epoch_us(TIMESTAMP '{AS_OF}') ELSE epoch_us(ts) END AS timestamp,
               lpad(lower(to_hex(event_id)), 32, '0') AS trace_id, '' AS span_id, event_id
        FROM base""",
)
def otlp_logs(spark, sf):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    body = (
        F.when(kind == "click", '{"boolValue":true}')
        .when(kind == "view", F.concat(F.lit('{"intValue":"'), user, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"stringValue":"boom '), user, F.lit('"}')))
    )
    level = (
        F.when(kind == "error", ',"severityNumber":17').when(kind == "view", ',"severityNumber":17,"severityText":"WARN"').otherwise(',"severityNumber":9')
    )
    time = F.when(kind == "signup", "0").otherwise(_nanos(F.unix_micros("ts")))
    record = F.concat(
        F.lit('{"timeUnixNano":"'), time, F.lit('"'), level, F.lit(',"traceId":"'), F.lower(F.lpad(F.hex("event_id"), 32, "0")),
        F.lit('","body":'), body, F.lit(',"attributes":[{"key":"event_id","value":{"intValue":"'), F.col("event_id").cast("string"),
        F.lit('"}},{"key":"","value":{"stringValue":"dropped"}}]}'),
    )
    resource = _resource(_kv("service.name", stringValue=F.col("service_name")))
    lines = views.base(spark, sf).select(_request("Logs", "scope", "logRecords", resource, record))
    rows = otlp.otlp_logs(otlp.read_otlp(spark, _written_lines(lines, spark, "otlp"), "logs"), "t0", AS_OF)
    return rows.withColumn("event_id", match.label("attributes", "event_id").cast("long")).drop("attributes")


@query(
    "enrich_hook",
    """SELECT event_id, CASE type WHEN 'LOG' THEN 'seen' ELSE '' END AS mark, type, payload, epoch_us(ts) AS received_at,
              CASE type WHEN 'PROFILE' THEN 'ValueError: no profiles' END AS enrich_error
       FROM signals_v""",
)
def enrich_hook(spark, sf):
    def hook(signal):
        if signal["type"] == "PROFILE":
            raise ValueError("no profiles")
        if signal["type"] != "LOG":
            return None
        signal["attributes"]["mark"] = "seen"
        return signal

    rows = enrich.enrich_hook(views.signals(spark, sf), hook)
    return rows.select(
        _event_id(), match.label("attributes", "mark").alias("mark"), "type", "payload", "received_at", "enrich_error"
    )
