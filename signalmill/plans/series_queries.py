"""Series over metrics and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.operators import logs as L
from signalmill.operators import series as S
from signalmill.plans import views
from signalmill.plans.registry import query
from signalmill.plans.views import T0, T1

HOUR_US = 3_600_000_000


def _bucket(step_s: int, col: str = "timestamp") -> str:
    width = step_s * 1_000_000
    return f"(epoch_us({col}) // {width}) * {width}"


_H = _bucket(3600)
_D = _bucket(86400)


@query(
    "range_agg",
    f"""SELECT {_H} AS t, service_name AS lbl_service_name, round(sum(value), 6) AS v FROM metrics_v
        WHERE metric_name = 'm_purchase' AND service_name <> 'svc-5' GROUP BY 1, 2""",
)
def range_agg(spark, sf):
    return S.range_agg(
        views.metrics(spark, sf), "m_purchase", "sum", [("service.name", "!=", "svc-5")], ["service.name"], T0, T1, "1h"
    )


@query(
    "range_agg_avg",
    f"""SELECT {_D} AS t, round(avg(value), 6) AS v FROM metrics_v WHERE tenant_id = 't0' AND metric_name = 'm_click'
        GROUP BY 1""",
)
def range_agg_avg(spark, sf):
    return S.range_agg(views.metrics(spark, sf), "m_click", t0=T0, t1=T1, step="1d", tenant="t0")


@query(
    "range_quantile",
    f"""SELECT {_D} AS t, service_name AS lbl_service_name, round(quantile_cont(value, 0.9), 6) AS v FROM metrics_v
        WHERE metric_name = 'm_view' GROUP BY 1, 2""",
)
def range_quantile(spark, sf):
    return S.range_quantile(views.metrics(spark, sf), "m_view", 0.9, (), ["service.name"], T0, T1, "1d")


# A sketch of fewer rows than its accuracy (10,000) holds them all: it gives the value of the rank itself.
@query(
    "range_quantile_approx",
    f"""SELECT t, lbl_service_name, round(value, 6) AS v FROM (
          SELECT *, row_number() OVER (PARTITION BY t, lbl_service_name ORDER BY value) AS rn,
                 count(*) OVER (PARTITION BY t, lbl_service_name) AS n
          FROM (SELECT {_D} AS t, service_name AS lbl_service_name, value FROM metrics_v WHERE metric_name = 'm_view'))
        WHERE rn = greatest(1, CAST(ceil(0.9 * n) AS BIGINT))""",
)
def range_quantile_approx(spark, sf):
    return S.range_quantile(views.metrics(spark, sf), "m_view", 0.9, (), ["service.name"], T0, T1, "1d", exact=False)


@query(
    "range_without",
    f"""SELECT {_D} AS t, concat('service.name=', service_name) AS labels_key, round(max(value), 6) AS v FROM metrics_v
        WHERE metric_name = 'm_error' GROUP BY 1, 2""",
)
def range_without(spark, sf):
    return S.range_without(views.metrics(spark, sf), "m_error", "max", (), ["k"], T0, T1, "1d")


_PER_SERIES = f"""SELECT {_D} AS t, service_name AS svc, k, {{expr}} AS x FROM metrics_v
    WHERE metric_name = '{{metric}}' GROUP BY 1, 2, 3"""


def _summed(expr: str, metric: str) -> str:
    inner = _PER_SERIES.format(expr=expr, metric=metric)
    return f"SELECT t, svc AS lbl_service_name, round(sum(x), 6) AS v FROM ({inner}) GROUP BY 1, 2"


@query("rate", _summed("(max(value) - min(value)) / 86400.0", "m_click"))
def rate(spark, sf):
    return S.rate(views.metrics(spark, sf), "m_click", (), ["service.name"], T0, T1, "1d")


@query(
    "rate_merged",
    f"""SELECT {_H} AS t, round((max(value) - min(value)) / 3600.0, 6) AS v FROM metrics_v
        WHERE metric_name = 'm_click' GROUP BY 1""",
)
def rate_merged(spark, sf):
    return S.rate(views.metrics(spark, sf), "m_click", (), None, T0, T1, "1h", merge_series=True)


@query(
    "increase",
    f"""SELECT {_D} AS t, concat('k=', k, ',service.name=', service_name) AS labels_key,
               round(max(value) - min(value), 6) AS v
        FROM metrics_v WHERE metric_name = 'm_view' GROUP BY 1, 2""",
)
def increase(spark, sf):
    return S.increase(views.metrics(spark, sf), "m_view", (), None, T0, T1, "1d")


@query(
    "irate",
    f"""SELECT {_D} AS t, service_name AS lbl_service_name,
               round((arg_max(value, timestamp) - arg_min(value, timestamp)) / 86400.0, 6) AS v
        FROM metrics_v WHERE metric_name = 'm_signup' GROUP BY 1, 2""",
)
def irate(spark, sf):
    return S.irate(views.metrics(spark, sf), "m_signup", (), ["service.name"], T0, T1, "1d", merge_series=True)


@query(
    "over_time",
    f"""SELECT s.t AS t, round(avg(m.value), 6) AS v
        FROM (SELECT DISTINCT b.t + i * {HOUR_US} AS t
              FROM (SELECT DISTINCT {_H} AS t FROM metrics_v WHERE metric_name = 'm_view') b, range(6) r(i)) s
        JOIN (SELECT {_H} AS b, value FROM metrics_v WHERE metric_name = 'm_view') m
          ON m.b <= s.t AND m.b > s.t - 6 * {HOUR_US}
        WHERE s.t <= epoch_us(TIMESTAMP '{T1}') GROUP BY 1""",
)
def over_time(spark, sf):
    return S.over_time(views.metrics(spark, sf), "m_view", "avg", (), (), T0, T1, "1h", lookback="6h")


@query(
    "quantile_over_time",
    f"""SELECT {_H} AS t, round(quantile_cont(value, 0.25), 6) AS v FROM metrics_v WHERE metric_name = 'm_view' GROUP BY 1""",
)
def quantile_over_time(spark, sf):
    return S.over_time(views.metrics(spark, sf), "m_view", "quantile", (), (), T0, T1, "1h", phi=0.25)


_FROM = "2024-01-12 05:00:00"


def _looking_back(value: str) -> str:
    """Points from _FROM on that cover six hours each, those before _FROM included."""
    return f"""SELECT s.t AS t, round({value}, 6) AS v
        FROM (SELECT DISTINCT b.t + i * {HOUR_US} AS t
              FROM (SELECT DISTINCT {_H} AS t FROM metrics_v WHERE metric_name = 'm_view') b, range(6) r(i)) s
        JOIN (SELECT {_H} AS b, value FROM metrics_v WHERE metric_name = 'm_view') m
          ON m.b <= s.t AND m.b > s.t - 6 * {HOUR_US}
        WHERE s.t BETWEEN epoch_us(TIMESTAMP '{_FROM}') AND epoch_us(TIMESTAMP '{T1}') GROUP BY 1"""


@query("over_time_from", _looking_back("sum(m.value)"))
def over_time_from(spark, sf):
    return S.over_time(views.metrics(spark, sf), "m_view", "sum", (), (), _FROM, T1, "1h", lookback="6h")


@query("quantile_over_time_from", _looking_back("quantile_cont(m.value, 0.9)"))
def quantile_over_time_from(spark, sf):
    return S.over_time(views.metrics(spark, sf), "m_view", "quantile", (), (), _FROM, T1, "1h", lookback="6h", phi=0.9)


@query(
    "metric_panel",
    f"""SELECT {_H} AS t, metric_name, round(avg(value), 6) AS v FROM metrics_v
        WHERE tenant_id = 't1' AND metric_name IN ('m_view', 'm_click') AND service_name IN ('svc-1', 'svc-3')
        GROUP BY 1, 2""",
)
def metric_panel(spark, sf):
    return S.metric_panel(views.metrics(spark, sf), "t1", ["m_view", "m_click"], ["svc-1", "svc-3"], T0, T1, "1h")


@query(
    "ingest_rate",
    f"""SELECT {_H} AS t, service_name AS service, round(count(*) / 3600.0, 6) AS rate FROM metrics_v
        WHERE tenant_id = 't2' GROUP BY 1, 2""",
)
def ingest_rate(spark, sf):
    return S.ingest_rate(views.metrics(spark, sf), "t2", T0, T1, "1h")


_DAILY = f"SELECT {_D} AS t, avg(value) AS v, service_name FROM metrics_v WHERE metric_name = 'm_view' GROUP BY 1, 3"


def _daily(spark, sf):
    return S.range_agg(views.metrics(spark, sf), "m_view", "avg", (), ["service.name"], T0, T1, "1d")


@query(
    "scalar_arith",
    f"SELECT t, service_name AS lbl_service_name, round(100 / ((v * 1000) - 5), 6) AS v FROM ({_DAILY})",
)
def scalar_arith(spark, sf):
    scaled = S.scalar_arith(S.scalar_arith(_daily(spark, sf), "*", 1000), "-", 5)
    return S.scalar_arith(scaled, "/", 100, swapped=True)


@query(
    "scalar_compare",
    f"SELECT t, service_name AS lbl_service_name, round(v, 6) AS v FROM ({_DAILY}) WHERE v > 20 AND 30 >= v",
)
def scalar_compare(spark, sf):
    return S.scalar_compare(S.scalar_compare(_daily(spark, sf), ">", 20), ">=", 30, swapped=True)


@query(
    "instant_value",
    f"""SELECT service_name AS lbl_service_name, max(t) AS t, round(arg_max(v, t), 6) AS v FROM ({_DAILY})
        WHERE t <= epoch_us(TIMESTAMP '2024-01-20 12:00:00') AND t > epoch_us(TIMESTAMP '2024-01-18 12:00:00')
        GROUP BY 1""",
)
def instant_value(spark, sf):
    return S.instant_value(_daily(spark, sf), "2024-01-20 12:00:00", "2d")


@query(
    "series_matrix",
    f"""SELECT service_name AS lbl_service_name, row_number() OVER (PARTITION BY service_name ORDER BY t) - 1 AS pos, t, round(v, 6) AS v
        FROM ({_DAILY})""",
)
def series_matrix(spark, sf):
    """Every point of every series with its place."""
    points = S.series_matrix(_daily(spark, sf)).select("lbl_service_name", F.posexplode("points").alias("pos", "p"))
    return points.select("lbl_service_name", "pos", "p.t", "p.v")


@query(
    "series_shape",
    f"""SELECT service_name AS series, t, round(v, 6) AS v FROM ({_DAILY})""",
)
def series_shape(spark, sf):
    return S.series_shape(_daily(spark, sf).select("t", "lbl_service_name", "v"))


@query(
    "series_shape_wide",
    f"""SELECT 'low' AS series, {_D} AS t, round(min(value), 6) AS v FROM metrics_v GROUP BY 2
        UNION ALL SELECT 'high', {_D} AS t, round(max(value), 6) FROM metrics_v GROUP BY 2""",
)
def series_shape_wide(spark, sf):
    from signalmill.functions.time import bucket_start

    wide = views.metrics(spark, sf).groupBy(bucket_start(F.col("timestamp"), "1d").alias("t")).agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )
    return S.series_shape(wide)


_LOG_WHERE = "service_name <> 'svc-0' AND severity <> 'WARN' AND contains(lower(body), 'user=')"
_LOG_MATCH = [("service", "!=", "svc-0"), ("level", "!=", "WARN")]
_LOG_FILTER = [("|=", "user=")]


@query("log_count_over_time", f"SELECT {_H} AS t, count(*) AS v FROM logs_v WHERE {_LOG_WHERE} GROUP BY 1")
def log_count_over_time(spark, sf):
    return L.log_count_over_time(views.logs(spark, sf), _LOG_MATCH, _LOG_FILTER, T0, T1, "1h")


@query("log_rate", f"SELECT {_H} AS t, round(count(*) / 3600.0, 6) AS v FROM logs_v WHERE {_LOG_WHERE} GROUP BY 1")
def log_rate(spark, sf):
    return L.log_rate(views.logs(spark, sf), _LOG_MATCH, _LOG_FILTER, T0, T1, "1h")


@query(
    "log_bytes_over_time",
    f"SELECT {_H} AS t, CAST(sum(strlen(body)) AS BIGINT) AS v FROM logs_v WHERE {_LOG_WHERE} GROUP BY 1",
)
def log_bytes_over_time(spark, sf):
    return L.log_bytes_over_time(views.logs(spark, sf), _LOG_MATCH, _LOG_FILTER, T0, T1, "1h")


@query(
    "document_bytes",
    f"""SELECT {_D.replace('timestamp', "TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 700 AS INTEGER))")} AS t,
               CAST(sum(strlen(text)) AS BIGINT) AS v FROM documents WHERE lang <> 'de' GROUP BY 1""",
)
def document_bytes(spark, sf):
    """Long texts as log bodies, one hour apart."""
    docs = views.table(spark, sf, "documents")
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.pmod("doc_id", F.lit(700)) * 3600)
    logs = docs.select(
        F.lit("t").alias("tenant_id"), F.col("source").alias("service_name"), F.col("lang").alias("severity"),
        F.col("text").alias("body"), at.alias("timestamp"), F.create_map().cast("map<string,string>").alias("attributes"),
    )
    return L.log_bytes_over_time(logs, [("level", "!=", "de")], (), None, None, "1d")


@query(
    "log_volume",
    f"""SELECT {_H} AS t, severity, count(*) AS n FROM logs_v
        WHERE tenant_id = 't3' AND severity IN ('ERROR', 'INFO') AND contains(lower(body), 'k=1') GROUP BY 1, 2""",
)
def log_volume(spark, sf):
    return L.log_volume(views.logs(spark, sf), "t3", T0, T1, "1h", severity=["ERROR", "INFO"], text="K=1")


@query(
    "log_streams",
    "SELECT service_name, severity, epoch_us(timestamp) * 1000 AS ts_ns, body FROM logs_v",
)
def log_streams(spark, sf):
    """Every entry of every stream's pages."""
    pages = L.log_streams(views.logs(spark, sf))
    entries = pages.select("service_name", "severity", F.explode("entries").alias("e"))
    return entries.select("service_name", "severity", "e.ts_ns", "e.body")


@query(
    "log_lines",
    f"""SELECT epoch_us(timestamp) AS timestamp, severity, service_name, body, trace_id, span_id FROM logs_v
        WHERE {_LOG_WHERE} ORDER BY logs_v.timestamp DESC, span_id DESC LIMIT 1000""",
)
def log_lines(spark, sf):
    rows = L.log_lines(views.logs(spark, sf), _LOG_MATCH, _LOG_FILTER, T0, T1)
    return rows.select("timestamp", "severity", "service_name", "body", "trace_id", "span_id")
