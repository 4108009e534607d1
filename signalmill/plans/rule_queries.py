"""Sliding-window rules, baselines, sampling, anomalies and SLOs."""

from __future__ import annotations

from pyspark.sql import functions as F

from signalmill.functions.time import duration_text
from signalmill.operators import anomaly, cep, ewma, sampling, slo
from signalmill.plans import views
from signalmill.plans.registry import query
from signalmill.session import scratch_path

# A day-long window suits the sparse test events.
WINDOW, WINDOW_MIN, WINDOW_S = "1d", 1440, 86_400.0
ERROR_RATE = 6e-5
LATENCY_MS = 200.0
SLO_TARGET = 0.9


# Early baselines are short decimals that can lie exactly between two values of six digits, where the
# last bit of a double would decide. Both engines round them as decimals of nine digits, half up.
def settled_sql(value: str) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(38, 9)), 6) AS DOUBLE)"


def settled(df, *columns: str):
    return df.withColumns({c: F.round(F.col(c).cast("decimal(38,9)"), 6).cast("double") for c in columns})


_RANKED = f"""rows_m AS (SELECT *, epoch_us(event_time) // 60000000 AS m FROM rule_rows),
counted AS (SELECT *,
  sum(CAST(is_error AS INTEGER)) OVER (PARTITION BY tenant_id, service_name ORDER BY m, event_time, signal_id ROWS UNBOUNDED PRECEDING)
  - coalesce(sum(CAST(is_error AS INTEGER)) OVER (PARTITION BY tenant_id, service_name ORDER BY m
      RANGE BETWEEN UNBOUNDED PRECEDING AND {WINDOW_MIN} PRECEDING), 0) AS errs,
  count(*) OVER (PARTITION BY tenant_id, service_name ORDER BY m, event_time, signal_id ROWS UNBOUNDED PRECEDING)
  - count(*) OVER (PARTITION BY tenant_id, service_name ORDER BY m
      RANGE BETWEEN UNBOUNDED PRECEDING AND {WINDOW_MIN} PRECEDING) AS total FROM rows_m),
edges AS (SELECT *, errs / {WINDOW_S} >= {ERROR_RATE} AS breach,
  lag(errs / {WINDOW_S} >= {ERROR_RATE}) OVER (PARTITION BY tenant_id, service_name ORDER BY m, event_time, signal_id) AS was
  FROM counted),
peaks AS (SELECT *, greatest(
    max(duration_ms) OVER (PARTITION BY tenant_id, service_name, m ORDER BY event_time, signal_id ROWS UNBOUNDED PRECEDING),
    max(duration_ms) OVER (PARTITION BY tenant_id, service_name ORDER BY m RANGE BETWEEN {WINDOW_MIN - 1} PRECEDING AND 1 PRECEDING)) AS peak
  FROM rows_m WHERE duration_ms IS NOT NULL),
slow AS (SELECT *, lag(peak >= {LATENCY_MS}) OVER (PARTITION BY tenant_id, service_name ORDER BY m, event_time, signal_id) AS was
  FROM peaks)"""

HIGH_ERROR_SQL = f"""WITH {_RANKED}
SELECT tenant_id, service_name, epoch_us(event_time) AS event_time, signal_id,
       round(errs / {WINDOW_S}, 6) AS error_rate, round(errs / total, 6) AS error_ratio,
       round(total / {WINDOW_S}, 6) AS total_rate, '{duration_text(WINDOW)}' AS "window"
FROM edges WHERE breach AND NOT coalesce(was, false)"""

HIGH_LATENCY_SQL = f"""WITH {_RANKED}
SELECT tenant_id, service_name, epoch_us(event_time) AS event_time, signal_id,
       round(peak, 6) AS peak_latency, CAST({LATENCY_MS} AS DOUBLE) AS threshold, '{duration_text(WINDOW)}' AS "window"
FROM slow WHERE peak >= {LATENCY_MS} AND NOT coalesce(was, false)"""


@query(
    "sliding_rate",
    f"""WITH {_RANKED}
    SELECT tenant_id, service_name, epoch_us(event_time) AS event_time, signal_id,
           CAST(errs AS BIGINT) AS n, round(errs / {WINDOW_S}, 6) AS rate FROM counted""",
)
def sliding_rate(spark, sf):
    rows = views.rule_rows(spark, sf).select(*cep.KEYS, "event_time", "signal_id", "is_error")
    return cep.sliding_rate(rows, cep.KEYS, F.col("is_error"), WINDOW).drop("is_error")


def _error_events(spark, sf):
    return cep.high_error_rate(views.rule_rows(spark, sf), WINDOW, ERROR_RATE)


def _latency_events(spark, sf):
    return cep.high_latency(views.rule_rows(spark, sf), WINDOW, LATENCY_MS)


@query("high_error_rate", HIGH_ERROR_SQL)
def high_error_rate(spark, sf):
    return _error_events(spark, sf)


@query("high_latency", HIGH_LATENCY_SQL)
def high_latency(spark, sf):
    return _latency_events(spark, sf)


@query(
    "rule_engine",
    f"""WITH {_RANKED},
    fired AS (
      SELECT signal_id, '{cep.HIGH_ERROR_RATE}' AS event_type, tenant_id, service_name, event_time, 0 AS rank
      FROM edges WHERE breach AND NOT coalesce(was, false)
      UNION ALL SELECT signal_id, '{cep.HIGH_LATENCY}', tenant_id, service_name, event_time, 1
      FROM slow WHERE peak >= {LATENCY_MS} AND NOT coalesce(was, false))
    SELECT signal_id, event_type, tenant_id, service_name, epoch_us(event_time) AS event_time
    FROM fired QUALIFY row_number() OVER (PARTITION BY tenant_id, signal_id ORDER BY rank) = 1""",
)
def rule_engine(spark, sf):
    return cep.rule_engine(
        [(cep.HIGH_ERROR_RATE, _error_events(spark, sf)), (cep.HIGH_LATENCY, _latency_events(spark, sf))]
    )


def _fold(rows: str, key: str, x: str) -> str:
    """Recursive fold of an exponentially weighted baseline; ``m0``/``v0``/``n0`` are the state before."""
    return f"""WITH RECURSIVE numbered AS (
      SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY event_time, signal_id) AS rn FROM ({rows})),
    fold AS (
      SELECT {key}, signal_id, rn, {x} AS x, CAST({x} AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v,
             CAST(NULL AS DOUBLE) AS m0, CAST(0 AS DOUBLE) AS v0
      FROM numbered WHERE rn = 1
      UNION ALL
      SELECT {", ".join("s." + k.strip() for k in key.split(","))}, s.signal_id, s.rn, s.{x},
             f.m + 0.05 * (s.{x} - f.m), 0.95 * (f.v + 0.05 * (s.{x} - f.m) * (s.{x} - f.m)), f.m, f.v
      FROM fold f JOIN numbered s ON {" AND ".join(f"s.{k.strip()} = f.{k.strip()}" for k in key.split(","))} AND s.rn = f.rn + 1)"""


_SPAN_ROWS = """SELECT tenant_id, service_name, trace_id, start_time AS event_time, event_id AS signal_id,
    status_code AS severity, operation_name, duration_ns / 1e6 AS duration_ms FROM spans_v"""
_SPAN_FOLD = _fold(_SPAN_ROWS, "tenant_id, service_name", "duration_ms")
_Z = "CASE WHEN f.rn - 1 < 30 OR sqrt(v0) < 1e-9 THEN 0.0 ELSE (x - m0) / sqrt(v0) END"


@query(
    "ewma_baseline",
    f"""{_SPAN_FOLD}
    SELECT tenant_id, service_name, signal_id, round(x, 6) AS duration_ms, {settled_sql('m')} AS mean,
           {settled_sql('v')} AS var, rn AS n FROM fold""",
)
def ewma_baseline(spark, sf):
    rows = views.sampler_rows(spark, sf).select("tenant_id", "service_name", "signal_id", "event_time", "duration_ms")
    state = ewma.ewma_baseline(rows, ["tenant_id", "service_name"], "duration_ms", "event_time", "signal_id")
    return settled(state.drop("event_time"), "mean", "var")


@query(
    "latency_zscore",
    f"""{_SPAN_FOLD}
    SELECT tenant_id, service_name, signal_id, round({_Z}, 6) AS z FROM fold f""",
)
def latency_zscore(spark, sf):
    rows = views.sampler_rows(spark, sf).select("tenant_id", "service_name", "signal_id", "event_time", "duration_ms")
    z = ewma.latency_zscore(rows, ["tenant_id", "service_name"], "duration_ms", "event_time", "signal_id")
    return z.select("tenant_id", "service_name", "signal_id", "z")


_SCORED = f"""{_SPAN_FOLD},
scored AS (SELECT n.*, CASE WHEN n.severity = 'ERROR' THEN 100.0 ELSE 0 END
    + CASE WHEN n.duration_ms > 1000 THEN 50.0 ELSE 0 END + 10.0 * greatest({_Z}, 0)
    + CASE WHEN n.service_name = 'svc-4' THEN 20.0 ELSE 0 END
    + CASE WHEN n.operation_name = 'purchase' THEN 25.0 ELSE 0 END AS score
  FROM numbered n JOIN fold f ON f.tenant_id = n.tenant_id AND f.signal_id = n.signal_id)"""


def _scored(spark, sf):
    return sampling.trace_score(views.sampler_rows(spark, sf), boosted_services=("svc-4",))


@query("trace_score", f"{_SCORED} SELECT tenant_id, signal_id, round(score, 6) AS score FROM scored")
def trace_score(spark, sf):
    return _scored(spark, sf).select("tenant_id", "signal_id", "score")


SAMPLE_RATE, SAMPLE_SIZE = 0.1, 200


@query(
    "sample_decision",
    f"""{_SCORED},
    firsts AS (SELECT tenant_id, trace_id, min((event_time, signal_id)) AS f FROM scored GROUP BY 1, 2),
    cutoffs AS (SELECT tenant_id, f AS c FROM firsts
                QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY f) = {int(SAMPLE_RATE * SAMPLE_SIZE) + 1}),
    seen AS (SELECT *, lag(event_time) OVER (PARTITION BY tenant_id, trace_id ORDER BY event_time, signal_id) AS before
             FROM scored)
    SELECT s.tenant_id, s.signal_id,
           s.score >= 50 OR coalesce(s.event_time - s.before < INTERVAL 5 MINUTE, false)
           OR c.c IS NULL OR (s.event_time, s.signal_id) < c.c AS keep
    FROM seen s LEFT JOIN cutoffs c ON c.tenant_id = s.tenant_id""",
)
def sample_decision(spark, sf):
    decided = sampling.sample_decision(_scored(spark, sf), SAMPLE_RATE, SAMPLE_SIZE)
    return decided.select("tenant_id", "signal_id", "keep")


@query(
    "baseline_snapshot",
    f"""{_SPAN_FOLD}
    SELECT tenant_id, service_name, round(arg_max(m, rn), 6) AS m, round(arg_max(v, rn), 6) AS v, max(rn) AS n
    FROM fold GROUP BY 1, 2""",
)
def baseline_snapshot(spark, sf):
    """Two halves of the data, the second continuing from the baselines saved after the first."""
    keys = ["tenant_id", "service_name"]
    rows = views.sampler_rows(spark, sf).select(*keys, "signal_id", "event_time", "duration_ms")
    noon = F.lit("2024-01-15 12:00:00").cast("timestamp")
    first, second = scratch_path(spark, "baselines"), scratch_path(spark, "baselines")

    def run(part, init, path):
        state = ewma.ewma_baseline(part, keys, "duration_ms", "event_time", "signal_id", init=init)
        ewma.save_baselines(state, keys, path)

    run(rows.where(F.col("event_time") < noon), None, first)
    run(rows.where(F.col("event_time") >= noon), ewma.load_baselines(spark, first), second)
    return spark.read.parquet(second)


_METRIC_FOLD = _fold(
    "SELECT tenant_id, metric_name, timestamp AS event_time, event_id AS signal_id, value FROM metrics_v",
    "tenant_id, metric_name",
    "value",
)

_ANOMALY_SQL = f"""{_METRIC_FOLD},
    z AS (SELECT *, CASE WHEN rn < 50 OR sqrt(v) < 1e-9 THEN 0.0 ELSE (x - m) / sqrt(v) END AS score FROM fold)
    SELECT tenant_id, metric_name, signal_id, round(x, 6) AS value, round(score, 6) AS score,
           {settled_sql('m')} AS baseline, CAST(3 AS DOUBLE) AS threshold, abs(score) >= 3 AS anomaly FROM z"""


@query("anomaly_zscore", _ANOMALY_SQL)
def anomaly_zscore(spark, sf):
    scored = anomaly.anomaly_zscore(views.metrics(spark, sf)).drop("timestamp")
    return settled(scored, "baseline")


_SLO_MINUTES = """minutes AS (SELECT concat(tenant_id, ':', service_name) AS slo, epoch_us(timestamp) // 60000000 AS minute,
    count(*) FILTER (severity <> 'ERROR') AS good, count(*) FILTER (severity = 'ERROR') AS bad
  FROM logs_v GROUP BY 1, 2)"""


def slo_events(spark, sf):
    return views.logs(spark, sf).select(
        F.concat("tenant_id", F.lit(":"), "service_name").alias("slo"),
        F.col("timestamp").alias("event_time"),
        (F.col("severity") != "ERROR").alias("good"),
    )


@query("slo_minutes", f"WITH {_SLO_MINUTES} SELECT slo, minute, good, bad FROM minutes")
def slo_minutes(spark, sf):
    return slo.slo_minutes(slo_events(spark, sf), F.col("good"))


def slo_targets(minutes):
    return minutes.select("slo").distinct().withColumn("target", F.lit(SLO_TARGET))


def _burns(spark, sf):
    minutes = slo.slo_minutes(slo_events(spark, sf), F.col("good"))
    return slo.burn_rates(minutes, slo_targets(minutes))


_WIDTHS = (5, 30, 60, 120, 360, 1440, 4320)
_BURNS_SQL = f"""{_SLO_MINUTES},
burns AS (SELECT slo, minute, {", ".join(
    f"sum(bad) OVER w{w} / (sum(good) OVER w{w} + sum(bad) OVER w{w}) / (1 - CAST({SLO_TARGET} AS DOUBLE)) AS burn_{w}" for w in _WIDTHS)}
  FROM minutes WINDOW {", ".join(
    f"w{w} AS (PARTITION BY slo ORDER BY minute RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in _WIDTHS)})"""


@query(
    "burn_rates",
    f"""WITH {_BURNS_SQL} SELECT slo, minute, CAST({SLO_TARGET} AS DOUBLE) AS target,
        {", ".join(f"round(burn_{w}, 6) AS burn_{w}" for w in _WIDTHS)} FROM burns""",
)
def burn_rates(spark, sf):
    return _burns(spark, sf)


_TRIPS = "\n".join(
    f"WHEN burn_{long} >= {limit} AND burn_{short} >= {limit} THEN {{{i}}}"
    for i, (long, short, limit, _) in enumerate(slo.WINDOW_PAIRS)
)
_LOUD = "\n".join(
    f"WHEN loud > 0 AND burn_{long} = loud THEN {{{i}}}" for i, (long, *_) in enumerate(slo.WINDOW_PAIRS)
)


def _case(per_pair, none, severity=False) -> str:
    values = [per_pair(p) for p in slo.WINDOW_PAIRS]
    quiet = ["'ok'"] * 4 if severity else values
    return f"CASE {_TRIPS.format(*values)} {_LOUD.format(*quiet)} ELSE {none} END"


DECISION_SQL = f"""WITH {_BURNS_SQL},
loudest AS (SELECT *, greatest(burn_60, burn_360, burn_1440, burn_4320) AS loud FROM burns),
decided AS (SELECT slo, minute, {_case(lambda p: f"'{p[3]}'", "'ok'", severity=True)} AS severity,
  round({_case(lambda p: f"burn_{p[0]}", "0.0")}, 6) AS burn_long,
  round({_case(lambda p: f"burn_{p[1]}", "0.0")}, 6) AS burn_short,
  CAST({_case(lambda p: str(p[0] * 60), "0")} AS BIGINT) AS long_s,
  CAST({_case(lambda p: str(p[1] * 60), "0")} AS BIGINT) AS short_s,
  round(1 - CAST({SLO_TARGET} AS DOUBLE), 6) AS error_budget FROM loudest)"""


@query("slo_decision", f"{DECISION_SQL} SELECT * FROM decided")
def slo_decision(spark, sf):
    return slo.slo_decision(_burns(spark, sf))


@query(
    "slo_worst",
    f"""{DECISION_SQL} SELECT * FROM decided
    QUALIFY row_number() OVER (PARTITION BY slo ORDER BY CASE severity WHEN 'page' THEN 2 WHEN 'ticket' THEN 1 ELSE 0 END DESC,
                               minute DESC) = 1""",
)
def slo_worst(spark, sf):
    return slo.slo_worst(slo.slo_decision(_burns(spark, sf)))


@query(
    "score_model",
    """SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS DOUBLE) AS score,
              len(list_filter(embedding, lambda x: x > 0)) >= 36 AS anomaly, CAST(NULL AS VARCHAR) AS score_error
       FROM embeddings""",
)
def score_model(spark, sf):
    def load():
        return lambda matrix: (matrix > 0).sum(axis=1)

    scored = anomaly.score_model(views.table(spark, sf, "embeddings"), load, 64, 36.0, features="embedding")
    return scored.select("vec_id", "score", "anomaly", "score_error")


@query(
    "model_counts",
    """SELECT count(*) AS samples, count(*) FILTER (len(list_filter(embedding, lambda x: x > 0)) >= 36) AS anomalies,
              CAST(0 AS BIGINT) AS errors FROM embeddings""",
)
def model_counts(spark, sf):
    def load():
        return lambda matrix: (matrix > 0).sum(axis=1)

    return anomaly.model_counts(
        anomaly.score_model(views.table(spark, sf, "embeddings"), load, 64, 36.0, features="embedding")
    )
