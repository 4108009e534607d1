"""Scans, filters, searches, group aggregates and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.functions import match
from signalmill.operators import select as S
from signalmill.operators import stats
from signalmill.plans import views
from signalmill.plans.registry import query
from signalmill.plans.views import AS_OF, T0, T1
from signalmill.sources import tables

_METRIC_COLS = "tenant_id, metric_name, epoch_us(timestamp) AS timestamp, round(value, 6) AS value, service_name AS service"
_LOG_COLS = "tenant_id, service_name, severity, body, epoch_us(timestamp) AS timestamp, trace_id, span_id"
_LOG_SELECT = ["tenant_id", "service_name", "severity", "body", "timestamp", "trace_id", "span_id"]


def _metric_rows(df):
    return df.select(
        "tenant_id", "metric_name", "timestamp", "value", match.label("labels", "service.name").alias("service")
    )


def _stored(spark, sf, source):
    """A stored table written from its view, partitioned by day and tenant."""
    from signalmill.session import scratch_path

    root = scratch_path(spark, "tables")
    view = {"metrics": views.metrics, "logs": views.logs, "traces": views.spans}[source](spark, sf)
    tables.write_source(view, source, root)
    return root


@query("scan_source", f"SELECT {_METRIC_COLS} FROM metrics_v WHERE tenant_id = 't1'")
def scan_source(spark, sf):
    root = _stored(spark, sf, "metrics")
    return _metric_rows(tables.scan_source(spark, root, "metrics", "t1", T0, T1))


@query(
    "hot_cold_union",
    f"""SELECT {_METRIC_COLS} FROM metrics_v""",
)
def hot_cold_union(spark, sf):
    rows = _metric_rows(views.metrics(spark, sf))
    split = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return tables.hot_cold_union(rows.where(F.col("timestamp") >= split), rows.where(F.col("timestamp") < split))


@query("cold_scan", f"SELECT {_LOG_COLS} FROM logs_v")
def cold_scan(spark, sf):
    root = _stored(spark, sf, "logs")
    cold = tables.cold_scan(spark, f"{root}/logs/date=*", base_path=f"{root}/logs")
    return cold.select(*_LOG_SELECT)


@query("export_parquet", f"SELECT {_LOG_COLS} FROM logs_v")
def export_parquet(spark, sf):
    from signalmill.session import scratch_path

    path = scratch_path(spark, "export")
    tables.export_parquet(views.logs(spark, sf).select(*_LOG_SELECT), path)
    return spark.read.parquet(path)


@query(
    "export_ndjson",
    """SELECT 'metrics' AS source, count(*) AS rows_returned, count(*) AS rows_read, round(sum(value), 3) AS total
       FROM metrics_v""",
)
def export_ndjson(spark, sf):
    from signalmill.session import scratch_path

    path = scratch_path(spark, "export")
    meta = tables.export_ndjson(_metric_rows(views.metrics(spark, sf)), path, "metrics")
    trailer = meta.head()
    return spark.read.schema("value double").json(path).agg(
        F.lit(trailer["source"]).alias("source"),
        F.lit(trailer["rows_returned"]).alias("rows_returned"),
        F.count("*").alias("rows_read"),
        F.round(F.sum("value"), 3).alias("total"),
    )


@query("export_ndjson_rows", f"SELECT {_METRIC_COLS} FROM metrics_v")
def export_ndjson_rows(spark, sf):
    """Every exported line, read back."""
    from signalmill.session import scratch_path

    path = scratch_path(spark, "export")
    rows = _metric_rows(views.metrics(spark, sf))
    tables.export_ndjson(rows, path, "metrics")
    return spark.read.schema(rows.schema).json(path)


@query("select_columns", "SELECT tenant_id, metric_name, round(value, 6) AS value FROM metrics_v")
def select_columns(spark, sf):
    return S.select_columns(views.metrics(spark, sf), "metrics", ["tenant_id", "metric_name", "value"])


@query(
    "where_expr",
    f"""SELECT {_LOG_COLS} FROM logs_v
        WHERE tenant_id = 't2' AND (severity = 'ERROR' OR NOT (service_name >= 'svc-3')) AND span_id <> trace_id""",
)
def where_expr(spark, sf):
    c = lambda name: S.column("logs", name)
    condition = (
        (c("tenant_id") == "t2")
        & ((c("severity") == "ERROR") | ~(c("service_name") >= "svc-3"))
        & (c("span_id") != c("trace_id"))
    )
    return S.where_expr(views.logs(spark, sf), condition).select(*_LOG_SELECT)


@query(
    "since_filter",
    f"""SELECT trace_id, span_id, epoch_us(start_time) AS start_time FROM spans_v
        WHERE start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""",
)
def since_filter(spark, sf):
    rows = S.since_filter(views.spans(spark, sf), "traces", "7d", as_of=AS_OF)
    return rows.select("trace_id", "span_id", "start_time")


@query(
    "label_match",
    f"""SELECT {_METRIC_COLS} FROM metrics_v
        WHERE service_name <> 'svc-0' AND regexp_matches(k, '^[1-4]') AND NOT regexp_matches(service_name, '[45]$')""",
)
def label_match(spark, sf):
    matchers = [
        ("service.name", "!=", "svc-0"), ("k", "=~", "^[1-4]"), ("service.name", "!~", "[45]$"),
        ("region", "!=", "eu"), ("zone", "=", ""), ("bad key!", "=", ""),
    ]
    return _metric_rows(S.label_match(views.metrics(spark, sf), matchers))


@query(
    "stream_select",
    f"""SELECT {_LOG_COLS} FROM logs_v
        WHERE service_name = 'svc-2' AND severity <> 'INFO' AND regexp_matches(k, '7') AND span_id <> '1'""",
)
def stream_select(spark, sf):
    matchers = [("Service", "=", "svc-2"), ("level", "!=", "INFO"), ("k", "=~", "7"), ("spanId", "!=", "1"),
                ("region", "!~", "us-.*")]
    return S.stream_select(views.logs(spark, sf), matchers).select(*_LOG_SELECT)


@query(
    "line_filter",
    f"""SELECT {_LOG_COLS} FROM logs_v
        WHERE contains(lower(body), 'user=1') AND NOT contains(lower(body), 'signup')
          AND regexp_matches(body, 'k=[0-9]+') AND NOT regexp_matches(body, 'k=9')""",
)
def line_filter(spark, sf):
    filters = [("|=", "USER=1"), ("!=", "Signup"), ("|~", "k=[0-9]+"), ("!~", "k=9")]
    return S.line_filter(views.logs(spark, sf), filters).select(*_LOG_SELECT)


@query(
    "document_search",
    """SELECT doc_id, source, CAST(strlen(text) AS BIGINT) AS body_bytes FROM documents
       WHERE contains(lower(text), 'error') OR contains(lower(text), 'data')""",
)
def document_search(spark, sf):
    body = F.col("text")
    hits = views.table(spark, sf, "documents").where(
        match.contains_ci(body, "Error") | match.contains_ci(body, "DATA")
    )
    return hits.select("doc_id", "source", F.octet_length("text").cast("long").alias("body_bytes"))


@query(
    "log_search",
    f"""SELECT {_LOG_COLS} FROM logs_v
        WHERE tenant_id = 't0' AND service_name IN ('svc-1', 'svc-2') AND contains(lower(body), 'user=')
        ORDER BY logs_v.timestamp DESC, span_id DESC LIMIT 500""",
)
def log_search(spark, sf):
    found = S.log_search(
        views.logs(spark, sf), "t0", T0, T1, service=["svc-1", "svc-2"], severity="__all__", text="User="
    )
    return found.select(*_LOG_SELECT)


@query(
    "trace_search",
    """SELECT trace_id, service_name, operation_name, epoch_us(start_time) AS start_time,
              round(duration_ns / 1e6, 6) AS duration_ms, status_code
       FROM spans_v WHERE tenant_id = 't1' AND duration_ns >= 20000000
       ORDER BY spans_v.start_time DESC, span_id DESC LIMIT 200""",
)
def trace_search(spark, sf):
    return S.trace_search(views.spans(spark, sf), "t1", T0, T1, min_ms=20)


@query(
    "trace_detail",
    """SELECT tenant_id, trace_id, span_id, parent_span_id, operation_name, service_name,
              epoch_us(start_time) AS start_time, end_us AS end_time, duration_ns, status_code
       FROM spans_v WHERE tenant_id = 't1' AND trace_id = 'tr-5'""",
)
def trace_detail(spark, sf):
    return S.trace_detail(views.spans(spark, sf), "t1", "tr-5").drop("attributes", "signal_id")


@query(
    "group_agg",
    """SELECT tenant_id, service_name, count(*) AS n, count(value) AS n_value, round(sum(value), 6) AS total,
              round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high
       FROM base GROUP BY tenant_id, service_name""",
)
def group_agg(spark, sf):
    aggs = [("count", "*", "n"), ("count", "value", "n_value"), ("sum", "value", "total"), ("avg", "value", "mean"),
            ("min", "value", "low"), ("max", "value", "high")]
    return S.group_agg(views.base(spark, sf), ["tenant_id", "service_name"], aggs)


@query(
    "newest_rows",
    """SELECT tenant_id, trace_id, span_id, epoch_us(start_time) AS start_time FROM spans_v
       ORDER BY spans_v.start_time DESC, event_id DESC LIMIT 300""",
)
def newest_rows(spark, sf):
    rows = S.newest_rows(views.spans(spark, sf), "traces", 99_999, cap=300, tiebreak="signal_id")
    return rows.select("tenant_id", "trace_id", "span_id", "start_time")


@query(
    "top_metrics",
    f"""SELECT metric_name, count(*) AS samples FROM metrics_v
        WHERE tenant_id = 't0' AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 40 DAY
        GROUP BY metric_name ORDER BY samples DESC, metric_name LIMIT 20""",
)
def top_metrics(spark, sf):
    return S.top_metrics(views.metrics(spark, sf), "t0", as_of=AS_OF, window="40d")


@query(
    "slow_operations",
    """SELECT concat(service_name, ' · ', operation_name) AS op, round(avg(duration_ns) / 1e6, 6) AS avg_ms
       FROM spans_v WHERE tenant_id = 't3' AND duration_ns >= 5000000
       GROUP BY op ORDER BY avg_ms DESC, op LIMIT 15""",
)
def slow_operations(spark, sf):
    return S.slow_operations(views.spans(spark, sf), "t3", T0, T1, min_ms=5)


@query(
    "recent_samples",
    f"""SELECT epoch_us(timestamp) AS timestamp, metric_name, round(value, 6) AS value, service_name AS service
        FROM metrics_v WHERE tenant_id = 't2' AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY
        ORDER BY metrics_v.timestamp DESC, metric_name, service, value LIMIT 100""",
)
def recent_samples(spark, sf):
    return S.recent_samples(views.metrics(spark, sf), "t2", as_of=AS_OF, window="2d")


@query(
    "distinct_values",
    """SELECT 'label' AS picker, service_name AS value FROM (SELECT DISTINCT service_name FROM metrics_v WHERE tenant_id = 't1')
       UNION ALL SELECT 'metric', metric_name FROM (SELECT DISTINCT metric_name FROM metrics_v WHERE tenant_id = 't1')
       UNION ALL SELECT 'tenant', tenant_id FROM (SELECT DISTINCT tenant_id FROM metrics_v)""",
)
def distinct_values(spark, sf):
    m = views.metrics(spark, sf)
    pickers = {
        "label": S.distinct_values(m, match.label("labels", "service.name"), "t1"),
        "metric": S.distinct_values(m, F.col("metric_name"), "t1"),
        "tenant": S.distinct_values(m, F.col("tenant_id")),
    }
    parts = [df.select(F.lit(name).alias("picker"), "value") for name, df in pickers.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "table_stats",
    """SELECT 'logs' AS table_name, 'service_name' AS column_name, count(*) AS row_count, count(DISTINCT service_name) AS ndv FROM logs_v
       UNION ALL SELECT 'logs', 'trace_id', count(*), count(DISTINCT trace_id) FROM logs_v
       UNION ALL SELECT 'logs', 'body', count(*), count(DISTINCT body) FROM logs_v""",
)
def table_stats(spark, sf):
    return stats.table_stats(views.logs(spark, sf), ["service_name", "trace_id", "body"], "logs", exact=True)


@query(
    "table_stats_approx",
    """SELECT 'logs' AS table_name, unnest(['service_name', 'trace_id', 'body']) AS column_name, count(*) AS row_count, true AS near
       FROM logs_v""",
)
def table_stats_approx(spark, sf):
    """Statistics merged from one sketch a day, and whether they are within three percent of the exact ones."""
    logs, columns = views.logs(spark, sf), ["service_name", "trace_id", "body"]
    daily = stats.column_sketches(logs.withColumn("date", F.to_date("timestamp")), columns, ["date"])
    exact = stats.table_stats(logs, columns, "logs", exact=True).select("column_name", F.col("ndv").alias("exact"))
    found = stats.merged_stats(daily, columns, "logs").join(F.broadcast(exact), "column_name")
    return found.select("table_name", "column_name", "row_count", (F.abs(F.col("ndv") - F.col("exact")) <= 0.03 * F.col("exact")).alias("near"))


@query(
    "series_count",
    "SELECT tenant_id, count(DISTINCT metric_name) AS series FROM metrics_v GROUP BY tenant_id",
)
def series_count(spark, sf):
    return stats.series_count(views.metrics(spark, sf))
