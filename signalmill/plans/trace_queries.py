"""Service graph, span panels and waterfalls."""

from __future__ import annotations

from signalmill.operators import traces
from signalmill.plans import views
from signalmill.plans.registry import query
from signalmill.plans.views import T0, T1

_H = "(epoch_us(start_time) // 3600000000) * 3600000000"


@query(
    "service_map",
    """SELECT c.tenant_id, p.service_name AS src_service, c.service_name AS dst_service, count(*) AS calls
       FROM spans_v c JOIN spans_v p
         ON p.tenant_id = c.tenant_id AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id
       WHERE c.parent_span_id <> '' AND p.service_name <> '' AND p.service_name <> c.service_name
       GROUP BY 1, 2, 3""",
)
def service_map(spark, sf):
    return traces.service_map(views.spans(spark, sf))


@query(
    "service_map_per_trace",
    """SELECT c.tenant_id, c.trace_id, p.service_name AS src_service, c.service_name AS dst_service, count(*) AS calls
       FROM spans_v c JOIN spans_v p
         ON p.tenant_id = c.tenant_id AND p.trace_id = c.trace_id AND p.span_id = c.parent_span_id
       WHERE p.service_name <> c.service_name GROUP BY 1, 2, 3, 4""",
)
def service_map_per_trace(spark, sf):
    return traces.service_map(views.spans(spark, sf), per_trace=True)


@query("service_nodes", "SELECT DISTINCT tenant_id, service_name FROM spans_v")
def service_nodes(spark, sf):
    return traces.service_nodes(views.spans(spark, sf))


@query(
    "span_rate",
    f"""SELECT {_H} AS t, service_name, round(count(*) / 3600.0, 6) AS rps FROM spans_v
        WHERE tenant_id = 't0' AND service_name IN ('svc-0', 'svc-1') GROUP BY 1, 2""",
)
def span_rate(spark, sf):
    return traces.span_rate(views.spans(spark, sf), "t0", ["svc-0", "svc-1"], T0, T1, "1h")


@query(
    "latency_percentiles",
    f"""SELECT {_H} AS t, round(quantile_cont(duration_ns / 1e6, 0.5), 6) AS p50,
               round(quantile_cont(duration_ns / 1e6, 0.95), 6) AS p95,
               round(quantile_cont(duration_ns / 1e6, 0.99), 6) AS p99
        FROM spans_v WHERE tenant_id = 't0' GROUP BY 1""",
)
def latency_percentiles(spark, sf):
    return traces.latency_percentiles(views.spans(spark, sf), "t0", None, T0, T1, "1h")


# A sketch of fewer rows than its accuracy (10,000) holds them all: it gives the values of the ranks themselves.
@query(
    "latency_percentiles_approx",
    """WITH ranked AS (
         SELECT (epoch_us(start_time) // 3600000000) * 3600000000 AS t, duration_ns / 1e6 AS ms FROM spans_v WHERE tenant_id = 't0'),
       placed AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY ms) AS rn, count(*) OVER (PARTITION BY t) AS n FROM ranked)
       SELECT t, round(max(ms) FILTER (rn = ceil(0.5 * n)), 6) AS p50, round(max(ms) FILTER (rn = ceil(0.95 * n)), 6) AS p95,
              round(max(ms) FILTER (rn = ceil(0.99 * n)), 6) AS p99 FROM placed GROUP BY t""",
)
def latency_percentiles_approx(spark, sf):
    return traces.latency_percentiles(views.spans(spark, sf), "t0", None, T0, T1, "1h", exact=False)


@query(
    "error_ratio",
    """SELECT round(count(*) FILTER (status_code NOT IN ('OK', '')) / count(*), 6) AS error_rate
       FROM spans_v WHERE tenant_id = 't2'""",
)
def error_ratio(spark, sf):
    return traces.error_ratio(views.spans(spark, sf), "t2", T0, T1)


WATERFALL_SQL = """WITH RECURSIVE tree AS (
  SELECT s.*, [(epoch_us(start_time), event_id)] AS path, 0 AS depth FROM spans_v s WHERE parent_span_id = ''
  UNION ALL
  SELECT c.*, list_append(t.path, (epoch_us(c.start_time), c.event_id)), t.depth + 1
  FROM tree t JOIN spans_v c ON c.trace_id = t.trace_id AND c.parent_span_id = t.span_id),
extent AS (SELECT trace_id, min(epoch_us(start_time)) AS a, max(end_us) AS b FROM spans_v GROUP BY 1)
SELECT tenant_id, tree.trace_id, row_number() OVER (PARTITION BY tree.trace_id ORDER BY path) - 1 AS ordinal, span_id,
       CAST(depth AS BIGINT) AS depth,
       round((epoch_us(start_time) - a) / greatest(1, b - a) * 100, 6) AS left_pct,
       round(greatest(0.4, (end_us - epoch_us(start_time)) / greatest(1, b - a) * 100), 6) AS width_pct,
       round(duration_ns / 1e6, 6) AS duration_ms, status_code NOT IN ('OK', '') AS is_error
FROM tree JOIN extent ON extent.trace_id = tree.trace_id"""


@query("waterfall", WATERFALL_SQL)
def waterfall(spark, sf):
    return traces.waterfall(views.spans(spark, sf))


@query("waterfall_large_traces", WATERFALL_SQL)
def waterfall_large_traces(spark, sf):
    """The join-based layout, which otherwise serves traces of very many spans."""
    return traces.waterfall(views.spans(spark, sf), large_trace=0)
