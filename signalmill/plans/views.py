"""Signal tables derived from the test tables, in Spark and as SQL views for the oracles.

Every view is row-wise over its table, so it scales with the table and adds no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.operators.clean import with_attributes

AS_OF = "2024-01-31 00:00:00"
T0, T1 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
SPANS_PER_TRACE = 16

_SQL = {
    "base": """
        SELECT event_id, ts, user_id, event_type, value, json_extract_string(props, '$.k') AS k,
               concat('t', CAST(user_id % 4 AS VARCHAR)) AS tenant_id,
               concat('svc-', CAST((user_id + event_id) % 6 AS VARCHAR)) AS service_name
        FROM events""",
    "metrics_v": """
        SELECT tenant_id, concat('m_', event_type) AS metric_name, ts AS timestamp, value, service_name, k,
               event_id FROM base""",
    "logs_v": """
        SELECT tenant_id, service_name,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS severity,
               concat(event_type, ' user=', CAST(user_id AS VARCHAR), ' k=', k) AS body,
               ts AS timestamp, concat('tr-', CAST(event_id // 16 AS VARCHAR)) AS trace_id,
               CAST(event_id AS VARCHAR) AS span_id, k, event_id, user_id FROM base""",
    "spans_v": """
        SELECT concat('t', CAST((event_id // 16) % 4 AS VARCHAR)) AS tenant_id,
               concat('tr-', CAST(event_id // 16 AS VARCHAR)) AS trace_id,
               CAST(event_id AS VARCHAR) AS span_id,
               CASE WHEN event_id % 16 = 0 THEN ''
                    ELSE CAST(event_id - event_id % 16 + (event_id % 16 - 1) // 2 AS VARCHAR) END AS parent_span_id,
               event_type AS operation_name, service_name, ts AS start_time,
               epoch_us(ts) + CAST(round(value * 1000) AS BIGINT) AS end_us,
               CAST(round(value * 1000000) AS BIGINT) AS duration_ns,
               CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status_code, event_id FROM base""",
    "rule_rows": """
        SELECT tenant_id, service_name, timestamp AS event_time, event_id * 2 AS signal_id,
               severity = 'ERROR' AS is_error, CAST(NULL AS DOUBLE) AS duration_ms FROM logs_v
        UNION ALL
        SELECT tenant_id, service_name, start_time, event_id * 2 + 1, status_code = 'ERROR', duration_ns / 1e6
        FROM spans_v""",
    "alert_events": """
        SELECT event_id, tenant_id, concat('rule-', CAST(user_id % 3 AS VARCHAR)) AS rule_id,
               CASE WHEN value > 50 THEN 'critical' WHEN value > 10 THEN 'warning' ELSE 'info' END AS severity,
               concat('Rule ', CAST(user_id % 3 AS VARCHAR), ' on ', service_name) AS title,
               concat('value of user ', CAST(user_id AS VARCHAR)) AS description,
               service_name, user_id, event_type = 'signup' AS resolved, ts AS occurred_at
        FROM base""",
    "silences_v": """
        SELECT c_custkey AS id, concat('t', CAST(c_custkey % 4 AS VARCHAR)) AS tenant_id, c_mktsegment AS kind,
               concat('svc-', CAST(c_custkey % 6 AS VARCHAR)) AS service,
               TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 720 AS INTEGER)) AS created_at,
               TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey % 720 AS INTEGER))
                 + to_minutes(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 5 ELSE 360 END) AS expires_at
        FROM customer""",
    "specs_v": """
        SELECT concat('t', CAST(s_suppkey - 1 AS VARCHAR)) AS tenant_id,
               s_nationkey AS hot, s_nationkey * 3 - 10 AS total FROM supplier""",
    "audit_v": """
        SELECT o_orderkey AS id, concat('t', CAST(o_custkey % 4 AS VARCHAR)) AS tenant_id,
               CASE WHEN o_orderpriority LIKE '5%' THEN '' ELSE concat('user-', CAST(o_custkey AS VARCHAR)) END AS actor,
               concat('order.', lower(o_orderstatus)) AS action, o_orderpriority AS details,
               concat('10.0.0.', CAST(o_custkey % 250 AS VARCHAR)) AS source_ip,
               TIMESTAMP '2024-01-01' + to_seconds(CAST(o_orderkey * 7919 % 259200 AS INTEGER)) AS occurred_at
        FROM orders""",
    "signals_v": """
        SELECT event_id, ts, user_id, event_type, value, k, service_name,
               CASE WHEN user_id % 10 = 3 THEN '' ELSE tenant_id END AS tenant_id,
               CASE event_type WHEN 'error' THEN 'LOG' WHEN 'view' THEN 'TRACE' WHEN 'signup' THEN 'PROFILE'
                    ELSE 'METRIC' END AS type,
               CASE WHEN event_type = 'error' THEN concat('plain text of user ', CAST(user_id AS VARCHAR))
                    WHEN event_type = 'view' THEN ''
                    WHEN value < 1 THEN '{"name": broken'
                    WHEN event_type = 'click' THEN concat('{"name":"m_click","value":', CAST(user_id AS VARCHAR), '}')
                    ELSE '{}' END AS payload
        FROM base""",
}
_DEPENDS = {
    name: [other for other in _SQL if other != name and re.search(rf"\b{other}\b", text)]
    for name, text in _SQL.items()
}


def with_views(sql: str) -> str:
    """The statement with the views it names prepended as common table expressions."""
    wanted: list[str] = []

    def need(text_names):
        for name in text_names:
            need(_DEPENDS[name])
            if name not in wanted:
                wanted.append(name)

    need([name for name in _SQL if re.search(rf"\b{name}\b", sql)])
    if not wanted:
        return sql
    ctes = ",\n".join(f"{name} AS ({_SQL[name]})" for name in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _modulo_name(prefix: str, number, n: int):
    return F.concat(F.lit(prefix), F.pmod(number, F.lit(n)).cast("string"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").alias("k"),
        _modulo_name("t", F.col("user_id"), 4).alias("tenant_id"),
        _modulo_name("svc-", F.col("user_id") + F.col("event_id"), 6).alias("service_name"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select(
        "tenant_id",
        F.concat(F.lit("m_"), "event_type").alias("metric_name"),
        F.col("ts").alias("timestamp"),
        "value",
        F.create_map(F.lit("service.name"), "service_name", F.lit("k"), "k").alias("labels"),
        F.col("ts").alias("received_at"),
        F.col("event_id").alias("signal_id"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN")
    return base(spark, sf_dir).select(
        "tenant_id",
        "service_name",
        severity.otherwise("INFO").alias("severity"),
        F.concat("event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" k="), "k").alias("body"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("k"), "k").alias("attributes"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("tr-"), F.floor(F.col("event_id") / SPANS_PER_TRACE).cast("string")).alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.col("event_id").alias("signal_id"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of 16 consecutive events each; span j's parent is span (j - 1) / 2 of its trace."""
    place = F.pmod("event_id", F.lit(SPANS_PER_TRACE))
    trace = F.floor(F.col("event_id") / SPANS_PER_TRACE)
    parent = F.col("event_id") - place + F.floor((place - 1) / 2)
    return base(spark, sf_dir).select(
        _modulo_name("t", trace, 4).alias("tenant_id"),
        F.concat(F.lit("tr-"), trace.cast("string")).alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.when(place == 0, "").otherwise(parent.cast("string")).alias("parent_span_id"),
        F.col("event_type").alias("operation_name"),
        "service_name",
        F.col("ts").alias("start_time"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1000).cast("long")).alias("end_time"),
        F.round(F.col("value") * 1_000_000).cast("long").alias("duration_ns"),
        F.create_map(F.lit("k"), "k").alias("attributes"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status_code"),
        F.col("event_id").alias("signal_id"),
    )


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs and spans as the rows that rules see."""
    from_logs = logs(spark, sf_dir).select(
        "tenant_id", "service_name", F.col("timestamp").alias("event_time"),
        (F.col("signal_id") * 2).alias("signal_id"), (F.col("severity") == "ERROR").alias("is_error"),
        F.lit(None).cast("double").alias("duration_ms"),
    )
    from_spans = spans(spark, sf_dir).select(
        "tenant_id", "service_name", F.col("start_time").alias("event_time"),
        (F.col("signal_id") * 2 + 1).alias("signal_id"), (F.col("status_code") == "ERROR").alias("is_error"),
        (F.col("duration_ns") / 1e6).alias("duration_ms"),
    )
    return from_logs.unionByName(from_spans)


def sampler_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as the rows that the sampler sees."""
    return spans(spark, sf_dir).select(
        "tenant_id", "service_name", "trace_id", F.col("start_time").alias("event_time"), "signal_id",
        F.lit("TRACE").alias("type"), F.col("status_code").alias("severity"),
        (F.col("duration_ns") / 1e6).alias("duration_ms"),
        with_attributes(
            F.col("attributes"),
            parent_sampled=F.when(F.col("operation_name") == "purchase", "true").otherwise("false"),
        ).alias("attributes"),
    )


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.pmod("user_id", F.lit(3)).cast("string")
    severity = F.when(F.col("value") > 50, "critical").when(F.col("value") > 10, "warning").otherwise("info")
    return base(spark, sf_dir).select(
        "event_id",
        "tenant_id",
        F.concat(F.lit("rule-"), rule).alias("rule_id"),
        severity.alias("severity"),
        F.concat(F.lit("Rule "), rule, F.lit(" on "), "service_name").alias("title"),
        F.concat(F.lit("value of user "), F.col("user_id").cast("string")).alias("description"),
        F.create_map(F.lit("service"), "service_name").alias("labels"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("annotations"),
        (F.col("event_type") == "signup").alias("resolved"),
        F.col("ts").alias("occurred_at"),
    )


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One silence per customer; the market segment picks the kind of matcher."""
    service = _modulo_name("svc-", F.col("c_custkey"), 6)
    hour = F.pmod("c_custkey", F.lit(720))
    created = F.timestamp_seconds(F.unix_seconds(F.lit(T0).cast("timestamp")) + hour * 3600)
    minutes = F.when(F.col("c_mktsegment") == "HOUSEHOLD", 5).otherwise(360)
    matcher = (
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.create_map().cast("map<string,string>"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.create_map(F.lit("service"), service, F.lit("team"), F.lit("")))
        .when(F.col("c_mktsegment") == "BUILDING", F.create_map(F.lit("service"), service, F.lit("team"), F.lit("core")))
        .otherwise(F.create_map(F.lit("service"), service))
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        _modulo_name("t", F.col("c_custkey"), 4).alias("tenant_id"),
        matcher.alias("matcher"),
        created.alias("created_at"),
        F.timestamp_seconds(F.unix_seconds(created) + minutes * 60).alias("expires_at"),
    )


# Whether silence s covers alert event e, for the oracles.
SILENCE_COVERS = """s.tenant_id = e.tenant_id AND s.created_at <= {at} AND s.expires_at > {at}
    AND (s.kind = 'HOUSEHOLD' OR (s.kind <> 'BUILDING' AND s.service = e.service_name))"""


def retention_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spec per supplier, among them invalid ones."""
    hot, total = F.col("s_nationkey"), F.col("s_nationkey") * 3 - 10
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("t"), (F.col("s_suppkey") - 1).cast("string")).alias("tenant_id"),
        *[c.alias(f"{t}_{n}_days") for t in ("metrics", "logs", "traces") for n, c in (("hot", hot), ("total", total))],
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.concat(F.lit("user-"), F.col("o_custkey").cast("string"))
    second = F.pmod(F.col("o_orderkey") * 7919, F.lit(259_200))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        _modulo_name("t", F.col("o_custkey"), 4).alias("tenant_id"),
        F.when(F.col("o_orderpriority").startswith("5"), "").otherwise(user).alias("actor"),
        F.concat(F.lit("order."), F.lower("o_orderstatus")).alias("action"),
        F.col("o_orderpriority").alias("details"),
        _modulo_name("10.0.0.", F.col("o_custkey"), 250).alias("source_ip"),
        F.timestamp_seconds(F.unix_seconds(F.lit(T0).cast("timestamp")) + second).alias("occurred_at"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as signal envelopes: metrics, logs, spans and profiles, some of them invalid."""
    kind = F.col("event_type")
    signal = F.when(kind == "error", "LOG").when(kind == "view", "TRACE").when(kind == "signup", "PROFILE")
    user = F.col("user_id").cast("string")
    payload = (
        F.when(kind == "error", F.concat(F.lit("plain text of user "), user))
        .when(kind == "view", "")
        .when(F.col("value") < 1, '{"name": broken')
        .when(kind == "click", F.concat(F.lit('{"name":"m_click","value":'), user, F.lit("}")))
        .otherwise("{}")
    )
    attributes = F.create_map(
        F.lit("event_id"), F.col("event_id").cast("string"),
        F.lit("metric_name"), F.when(kind == "purchase", "m_purchase").otherwise(""),
        F.lit("value"), F.when(kind == "purchase", F.col("value").cast("string")).otherwise(""),
        F.lit("service.name"), F.col("service_name"),
        F.lit("severity"), F.when(kind == "error", "ERROR").otherwise(""),
        F.lit("trace_id"), F.concat(F.lit("tr-"), F.floor(F.col("event_id") / 16).cast("string")),
        F.lit("span_id"), F.col("event_id").cast("string"),
        F.lit("span.name"), kind,
        F.lit("duration_ms"), F.format_string("%.3f", F.col("value")),
    )
    return base(spark, sf_dir).select(
        F.when(F.pmod("user_id", F.lit(10)) == 3, "").otherwise(F.col("tenant_id")).alias("tenant_id"),
        signal.otherwise("METRIC").alias("type"),
        F.encode(payload, "UTF-8").alias("payload"),
        attributes.alias("attributes"),
        F.col("ts").alias("received_at"),
    )
