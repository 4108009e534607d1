"""Alerts, silences, retention and audit."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.functions import match
from signalmill.operators import alerts, audit, retention, slo
from signalmill.operators import cep
from signalmill.plans import views
from signalmill.plans.registry import query
from signalmill.plans.rule_queries import (
    DECISION_SQL, HIGH_ERROR_SQL, LATENCY_MS, WINDOW, _burns, _error_events,
)
from signalmill.plans.views import AS_OF, SILENCE_COVERS
from signalmill.session import listed, scratch_path
from signalmill.sources import tables

_FP = "sha256(concat(tenant_id, chr(0), rule_id, chr(0), 'service=', service_name, ';'))"

_STEPS = f"""fp AS (SELECT *, {_FP} AS fingerprint FROM alert_events),
prev AS (SELECT *, lag(resolved) OVER (PARTITION BY fingerprint ORDER BY occurred_at, event_id) AS was FROM fp),
steps AS (SELECT *, CASE WHEN resolved AND NOT coalesce(was, true) THEN 'resolved'
    WHEN NOT resolved AND NOT coalesce(was, true) THEN 'updated' WHEN NOT resolved THEN 'created' END AS step FROM prev),
hushed AS (SELECT DISTINCT e.event_id FROM steps e JOIN silences_v s ON {SILENCE_COVERS.format(at="e.occurred_at")}
    WHERE e.step = 'created')"""


def _steps(spark, sf):
    return alerts.alert_steps(views.alert_events(spark, sf))


@query("alert_fingerprint", f"SELECT event_id, {_FP} AS fingerprint FROM alert_events")
def alert_fingerprint(spark, sf):
    return alerts.alert_fingerprint(views.alert_events(spark, sf)).select("event_id", "fingerprint")


@query(
    "alert_transitions",
    f"""WITH {_STEPS} SELECT fingerprint, epoch_us(occurred_at) AS occurred_at, step = 'created' AS new_transition
        FROM steps WHERE step IN ('created', 'updated')""",
)
def alert_transitions(spark, sf):
    return alerts.transitions(_steps(spark, sf))


_LIFECYCLE = f"""{_STEPS},
final AS (SELECT fingerprint,
    arg_max(tenant_id, (occurred_at, event_id)) FILTER (step = 'created') AS tenant_id,
    arg_max(severity, (occurred_at, event_id)) FILTER (step = 'created') AS severity,
    arg_max(title, (occurred_at, event_id)) FILTER (step = 'created') AS title,
    arg_max(description, (occurred_at, event_id)) FILTER (step = 'created') AS description,
    arg_max(service_name, (occurred_at, event_id)) FILTER (step = 'created') AS service,
    max(occurred_at) FILTER (step = 'created') AS starts_at,
    max(occurred_at) FILTER (step IN ('created', 'updated')) AS last_seen_at,
    arg_max(resolved, (occurred_at, event_id)) FILTER (step IS NOT NULL) AS ended,
    max(occurred_at) FILTER (step = 'resolved') AS ended_at,
    max(occurred_at) FILTER (step = 'created' AND event_id NOT IN (SELECT event_id FROM hushed)) AS notified_at,
    count(*) FILTER (step = 'created' AND event_id NOT IN (SELECT event_id FROM hushed)) AS notify_count
  FROM steps GROUP BY 1)"""


@query(
    "alert_lifecycle",
    f"""WITH {_LIFECYCLE}
    SELECT fingerprint, tenant_id, severity, title, description, service,
           CASE WHEN ended THEN 'resolved' ELSE 'firing' END AS state, epoch_us(starts_at) AS starts_at,
           epoch_us(last_seen_at) AS last_seen_at, epoch_us(CASE WHEN ended THEN ended_at END) AS resolved_at,
           epoch_us(notified_at) AS notified_at, notify_count
    FROM final WHERE starts_at IS NOT NULL""",
)
def alert_lifecycle(spark, sf):
    final = alerts.alert_lifecycle(_steps(spark, sf), views.silences(spark, sf))
    return final.withColumn("service", F.element_at("labels", F.lit("service"))).drop("labels", "annotations", "rule_id")


@query(
    "alert_history",
    f"""WITH {_STEPS}
    SELECT fingerprint, tenant_id, step AS event, CASE WHEN step <> 'resolved' THEN severity END AS severity,
           epoch_us(occurred_at) AS occurred_at FROM steps WHERE step IS NOT NULL
    UNION ALL SELECT fingerprint, tenant_id, 'notified', NULL, epoch_us(occurred_at) FROM steps
    WHERE step = 'created' AND event_id NOT IN (SELECT event_id FROM hushed)""",
)
def alert_history(spark, sf):
    return alerts.alert_history(_steps(spark, sf), views.silences(spark, sf))


_MESSAGES = """messages AS (SELECT * FROM steps
    WHERE resolved OR (step = 'created' AND event_id NOT IN (SELECT event_id FROM hushed)))"""


@query(
    "notification_outbox",
    f"""WITH {_STEPS}, {_MESSAGES}
    SELECT fingerprint, channel, CASE WHEN resolved THEN 'resolve' ELSE 'trigger' END AS action, event_id,
           epoch_us(occurred_at) AS occurred_at,
           CASE channel WHEN 'team-chat' THEN concat('{{"text":"',
                CASE WHEN resolved THEN ':white_check_mark:' WHEN severity = 'critical' THEN ':rotating_light:'
                     WHEN severity = 'warning' THEN ':warning:' ELSE ':information_source:' END,
                ' *[', CASE WHEN resolved THEN 'RESOLVED' ELSE 'FIRING' END, '][', severity, '] ', title, '* — tenant `',
                tenant_id, '`\\n', description, '"}}')
           ELSE concat('{{"routing_key":"key","event_action":"', CASE WHEN resolved THEN 'resolve' ELSE 'trigger' END,
                '","dedup_key":"', fingerprint, '","payload":{{"summary":"', title, '","source":"alert-manager","severity":"',
                severity, '","custom_details":{{"tenant_id":"', tenant_id, '","description":"', description,
                '","labels":{{"service":"', service_name, '"}},"annotations":{{"user":"', CAST(user_id AS VARCHAR), '"}}}}}}}}') END AS payload
    FROM messages, (VALUES ('team-chat'), ('on-call')) c(channel)""",
)
def notification_outbox(spark, sf):
    channels = {"team-chat": "chat", "on-call": "pager"}
    return alerts.notification_outbox(_steps(spark, sf), views.silences(spark, sf), channels, routing_key="key")


_SILENCED = f"""{_LIFECYCLE},
covered AS (SELECT DISTINCT e.fingerprint FROM (SELECT *, service AS service_name FROM final) e JOIN silences_v s
    ON {SILENCE_COVERS.format(at="TIMESTAMP '2024-01-20 00:00:00'")})"""


@query(
    "silenced_alerts",
    f"""WITH {_SILENCED}
    SELECT fingerprint, tenant_id, service, fingerprint IN (SELECT fingerprint FROM covered) AS silenced
    FROM final WHERE starts_at IS NOT NULL""",
)
def silenced_alerts(spark, sf):
    final = alerts.alert_lifecycle(_steps(spark, sf))
    final = final.select("fingerprint", "tenant_id", "labels", F.element_at("labels", F.lit("service")).alias("service"))
    hush = views.silences(spark, sf)
    at = "2024-01-20 00:00:00"
    yes = alerts.silenced_alerts(final, hush, as_of=at).withColumn("silenced", F.lit(True))
    no = alerts.unsilenced_alerts(final, hush, as_of=at).withColumn("silenced", F.lit(False))
    return yes.unionByName(no).drop("labels")


@query(
    "recent_alerts",
    f"""WITH {_LIFECYCLE}
    SELECT fingerprint, title, epoch_us(last_seen_at) AS last_seen_at FROM final WHERE tenant_id = 't1' AND starts_at IS NOT NULL
    ORDER BY final.last_seen_at DESC, fingerprint LIMIT 10""",
)
def recent_alerts(spark, sf):
    return alerts.recent_alerts(alerts.alert_lifecycle(_steps(spark, sf)), "t1", 10).select(
        "fingerprint", "title", "last_seen_at"
    )


@query(
    "cep_to_alerts",
    f"""WITH fired AS ({HIGH_ERROR_SQL})
    SELECT tenant_id, 'cep:HIGH_ERROR_RATE' AS rule_id, 'critical' AS severity,
           concat('HIGH_ERROR_RATE on ', service_name) AS title,
           concat('event_type=HIGH_ERROR_RATE,service=', service_name) AS labels,
           concat('service=', service_name, ',window=', "window") AS noted,
           false AS resolved, event_time AS occurred_at FROM fired""",
)
def cep_to_alerts(spark, sf):
    events = _error_events(spark, sf).withColumn("event_type", F.lit(cep.HIGH_ERROR_RATE))
    out = alerts.cep_to_alerts(events, ["error_rate", "error_ratio", "total_rate", "window"])
    # The engines print doubles differently, so the measured annotations and the text made of them stay out.
    noted = F.map_filter("annotations", lambda k, _: k.isin("service", "window"))
    return out.withColumns({"labels": match.labels_text("labels"), "noted": match.labels_text(noted)}).drop(
        "annotations", "description"
    )


@query(
    "slo_to_alerts",
    f"""{DECISION_SQL},
    before AS (SELECT *, lag(severity) OVER (PARTITION BY slo ORDER BY minute) AS was FROM decided),
    events AS (SELECT *, severity AS sev, false AS resolved FROM before WHERE severity <> 'ok'
        UNION ALL SELECT *, was, true FROM before WHERE was <> 'ok' AND was <> severity)
    SELECT split_part(slo, ':', 1) AS tenant_id, concat('slo:', split_part(slo, ':', 2)) AS rule_id, sev AS severity,
           concat('SLO burning: ', split_part(slo, ':', 2)) AS title, resolved, minute * 60000000 AS occurred_at
    FROM events""",
)
def slo_to_alerts(spark, sf):
    events = alerts.slo_to_alerts(slo.slo_decision(_burns(spark, sf)))
    return events.drop("description", "labels", "annotations")


_VALID_SPECS = """valid AS (SELECT tenant_id, max(hot) AS hot, max(total) AS total FROM specs_v
    WHERE hot BETWEEN 0 AND 730 AND total BETWEEN 0 AND 730 AND NOT (hot > 0 AND total > 0 AND total < hot) GROUP BY 1)"""


@query(
    "retention_overrides",
    f"""WITH {_VALID_SPECS}
    SELECT l.span_id, CAST(coalesce(nullif(v.hot, 0), 14) AS BIGINT) AS hot_days,
           CAST(coalesce(nullif(v.total, 0), 30) AS BIGINT) AS total_days
    FROM logs_v l LEFT JOIN valid v ON v.tenant_id = l.tenant_id""",
)
def retention_overrides(spark, sf):
    rows = retention.retention_overrides(views.logs(spark, sf), views.retention_specs(spark, sf), "logs")
    return rows.select("span_id", "hot_days", "total_days")


@query(
    "retention_rejects",
    """SELECT tenant_id, CAST(hot AS BIGINT) AS hot, CAST(total AS BIGINT) AS total FROM specs_v
       WHERE NOT (hot BETWEEN 0 AND 730 AND total BETWEEN 0 AND 730 AND NOT (hot > 0 AND total > 0 AND total < hot))""",
)
def retention_rejects(spark, sf):
    _, bad = retention.checked_specs(views.retention_specs(spark, sf))
    return bad.select("tenant_id", F.col("logs_hot_days").alias("hot"), F.col("logs_total_days").alias("total"))


_TIERED = f"""{_VALID_SPECS},
tiered AS (SELECT l.*, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(date_trunc('second', l.timestamp)) AS age,
    86400000000 * coalesce(nullif(v.hot, 0), 14) AS hot_us, 86400000000 * coalesce(nullif(v.total, 0), 30) AS total_us
  FROM logs_v l LEFT JOIN valid v ON v.tenant_id = l.tenant_id),
placed AS (SELECT *, CASE WHEN age >= total_us THEN 'expired' WHEN age >= hot_us THEN 'cold' ELSE 'hot' END AS tier FROM tiered)"""


@query("retention_tier", f"WITH {_TIERED} SELECT span_id, tier FROM placed")
def retention_tier(spark, sf):
    rows = retention.retention_tier(views.logs(spark, sf), "logs", views.retention_specs(spark, sf), as_of=AS_OF)
    return rows.select("span_id", "tier")


def _tiered(table: str, view: str, at: str, as_of: str = AS_OF) -> str:
    """Rows of a table with their tier; the specs have the same days for every table."""
    hot, total = retention.DEFAULT_DAYS[table]
    return f"""SELECT '{table}' AS table_name, r.event_id, CAST(CAST(r.{at} AS DATE) AS VARCHAR) AS date, CASE
        WHEN epoch_us(TIMESTAMP '{as_of}') - epoch_us(date_trunc('second', r.{at})) >= 86400000000 * coalesce(nullif(v.total, 0), {total}) THEN 'expired'
        WHEN epoch_us(TIMESTAMP '{as_of}') - epoch_us(date_trunc('second', r.{at})) >= 86400000000 * coalesce(nullif(v.hot, 0), {hot}) THEN 'cold'
        ELSE 'hot' END AS tier FROM {view} r LEFT JOIN valid v ON v.tenant_id = r.tenant_id"""


def _all_tiered(as_of: str = AS_OF) -> str:
    return " UNION ALL ".join(
        _tiered(table, view, at, as_of)
        for table, view, at in (("metrics", "metrics_v", "timestamp"), ("logs", "logs_v", "timestamp"), ("traces", "spans_v", "start_time"))
    )


def _stores(spark, sf, *as_of: str):
    """Per table: the reports of successive runs, the hot and the cold path."""
    out = {}
    specs = views.retention_specs(spark, sf)
    for table, rows in (("metrics", views.metrics), ("logs", views.logs), ("traces", views.spans)):
        root, cold = scratch_path(spark, "hot"), scratch_path(spark, "cold")
        tables.write_source(rows(spark, sf), table, root)
        reports = [
            retention.retention_apply(spark, f"{root}/{table}", cold, table, specs, as_of=at) for at in as_of
        ]
        out[table] = (reports, f"{root}/{table}", cold)
    return out


@query(
    "retention_apply",
    f"""WITH {_VALID_SPECS}, placed AS ({_all_tiered()})
    SELECT table_name, date, count(*) FILTER (tier = 'hot') AS kept,
           count(*) FILTER (tier = 'cold') AS moved, count(*) FILTER (tier = 'expired') AS dropped
    FROM placed GROUP BY 1, 2""",
)
def retention_apply(spark, sf):
    parts = [r[-1].withColumn("table_name", F.lit(t)) for t, (r, _, _) in _stores(spark, sf, AS_OF).items()]
    return functools.reduce(DataFrame.unionByName, parts)


_EARLIER = "2024-01-22 00:00:00"


@query(
    "retention_stores",
    f"""WITH {_VALID_SPECS}, placed AS ({_all_tiered()})
    SELECT table_name, tier AS store, date, count(*) AS n FROM placed WHERE tier <> 'expired' GROUP BY 1, 2, 3""",
)
def retention_stores(spark, sf):
    """The rows that both stores of every table hold after two runs."""
    parts = [
        spark.read.parquet(path).select(F.lit(table).alias("table_name"), F.lit(store).alias("store"), F.col("date").cast("string").alias("date"))
        for table, (_, hot, cold) in _stores(spark, sf, _EARLIER, AS_OF).items()
        for store, path in (("hot", hot), ("cold", cold)) if any(n.startswith("date=") for n in listed(spark, path))
    ]
    return functools.reduce(DataFrame.unionByName, parts).groupBy("table_name", "store", "date").agg(F.count("*").alias("n"))


@query(
    "storage_tiers",
    f"""WITH {_VALID_SPECS}, placed AS ({_all_tiered()})
    SELECT DISTINCT table_name, tier, true AS has_files, true AS has_bytes FROM placed WHERE tier <> 'expired'""",
)
def storage_tiers(spark, sf):
    """Which stores hold files; their number and size depend on how the writer splits them."""
    roots = {(t, tier): path for t, (_, hot, cold) in _stores(spark, sf, AS_OF).items() for tier, path in (("hot", hot), ("cold", cold))}
    found = retention.storage_tiers(spark, roots)
    return found.select("table_name", "tier", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


_LINES = """lines AS (SELECT *, id // 1000 AS batch, concat('{"id":', CAST(id AS VARCHAR), ',"tenant_id":"', tenant_id, '","actor":"', actor,
    '","action":"', action, '","details":"', details, '","source_ip":"', source_ip, '","occurred_at":"',
    strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%fZ'), '"}') AS line FROM audit_v WHERE actor <> '')"""


@query(
    "export_audit",
    f"""WITH {_LINES}
    SELECT strftime(occurred_at, '%Y') AS y, strftime(occurred_at, '%m') AS m, strftime(occurred_at, '%d') AS d,
           strftime(occurred_at, '%H') AS h, batch, count(*) AS records,
           sha256(string_agg(concat(line, chr(10)), '' ORDER BY id)) AS sha256
    FROM lines GROUP BY ALL""",
)
def export_audit(spark, sf):
    return audit.export_audit(views.audit(spark, sf), scratch_path(spark, "audit"))


@query(
    "recent_audit",
    "SELECT id, actor, action, epoch_us(occurred_at) AS occurred_at FROM audit_v WHERE tenant_id = 't3' ORDER BY id DESC LIMIT 500",
)
def recent_audit(spark, sf):
    return audit.recent_audit(views.audit(spark, sf), "t3", 500).select("id", "actor", "action", "occurred_at")
