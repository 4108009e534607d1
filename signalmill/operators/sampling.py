"""Adaptive trace sampling: priority score and keep decision, per tenant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions import match
from signalmill.functions.time import Duration, bucket_number, micros
from signalmill.operators.ewma import ALPHA, latency_zscore
from signalmill.operators.skew import checked_broadcast, nth_flagged

# Score weights, and the score that is always kept.
ERROR_POINTS = 100.0
SLOW_POINTS = 50.0
SLOW_MS = 1000.0
Z_POINTS = 10.0
BOOSTED_POINTS = 20.0
PARENT_POINTS = 25.0
KEEP_SCORE = 50.0
RECENT = "5m"
BOOSTED_SERVICES = ("payment-service",)

_KEYS = ["tenant_id", "service_name"]


def trace_score(
    df: DataFrame,
    boosted_services: tuple[str, ...] = BOOSTED_SERVICES,
    alpha: float = ALPHA,
    init: DataFrame | None = None,
) -> DataFrame:
    """Adds ``z`` and ``score`` (and the baseline after each row).

    ``df`` has tenant_id, service_name, event_time, signal_id, type, severity, duration_ms (double
    or null) and attributes. Spans with a service and a duration feed the service's baseline; other
    rows get no z. Rows that are not spans score 0.
    """
    measured = (F.col("type") == "TRACE") & F.col("duration_ms").isNotNull() & (F.col("service_name") != "")
    with_z = latency_zscore(
        df.where(measured), _KEYS, "duration_ms", "event_time", "signal_id", alpha, init
    )
    rest = df.where(~F.coalesce(measured, F.lit(False)))
    rows = with_z.unionByName(rest, allowMissingColumns=True).withColumn("z", F.coalesce("z", F.lit(0.0)))
    return rows.withColumn("score", span_score(boosted_services))


def span_score(boosted_services: tuple[str, ...]) -> Column:
    """Score of a row with ``z``; 0 for what is no span."""

    def points(condition, amount):
        return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))

    score = (
        points(F.col("severity") == "ERROR", ERROR_POINTS)
        + points(F.col("duration_ms") > SLOW_MS, SLOW_POINTS)
        + F.lit(Z_POINTS) * F.greatest(F.col("z"), F.lit(0.0))
        + points(F.col("service_name").isin(list(boosted_services)), BOOSTED_POINTS)
        + points(match.label("attributes", "parent_sampled") == "true", PARENT_POINTS)
    )
    return F.when(F.col("type") == "TRACE", score).otherwise(F.lit(0.0))


def queue_limit(rate: float, max_size: int) -> int | None:
    """Distinct traces admitted by queue length alone; ``None`` when the queue never gets longer."""
    kept = max(1, int(max_size * rate))
    return None if kept >= max_size else kept


def first_sightings(df: DataFrame) -> DataFrame:
    """First row of every (tenant, trace)."""
    spans = df.where((F.col("type") == "TRACE") & (F.coalesce("trace_id", F.lit("")) != ""))
    first = F.min(F.struct("event_time", "signal_id")).alias("f")
    return spans.groupBy("tenant_id", "trace_id").agg(first).select(
        "tenant_id", "trace_id", "f.event_time", "f.signal_id"
    )


def queue_cutoffs(sightings: DataFrame, limit: int, step: Duration = "1m") -> DataFrame:
    """Per tenant the time and id at which the queue first exceeds its limit."""
    tenants = sightings.select("tenant_id").distinct()
    wanted = checked_broadcast(tenants.withColumn("nth", F.lit(limit + 1).cast("long")))
    crossing = nth_flagged(sightings, ["tenant_id"], "event_time", "signal_id", F.lit(True), wanted, step)
    return crossing.select("tenant_id", F.struct("event_time", "signal_id").alias("_cutoff"))


def unseen_rows(df: DataFrame, recent: Duration = RECENT, last_seen: DataFrame | None = None) -> DataFrame:
    """Spans whose trace was not seen within ``recent`` before them: (tenant, trace, signal).

    Rows are bucketed by ``recent``. Two rows of a trace in one bucket are always recent, so only
    each bucket's first row needs a look at the last row of the bucket before.
    """
    spans = df.where((F.col("type") == "TRACE") & (F.coalesce("trace_id", F.lit("")) != ""))
    per_bucket = spans.groupBy(
        "tenant_id", "trace_id", bucket_number(F.col("event_time"), recent).alias("_b")
    ).agg(
        F.min(F.struct("event_time", "signal_id")).alias("_first"), F.max("event_time").alias("_last")
    )
    if last_seen is not None:
        per_bucket = per_bucket.unionByName(
            last_seen.select(
                "tenant_id", "trace_id",
                bucket_number(F.col("event_time"), recent).alias("_b"),
                F.lit(None).cast(per_bucket.schema["_first"].dataType).alias("_first"),
                F.col("event_time").alias("_last"),
            )
        )
    order = Window.partitionBy("tenant_id", "trace_id").orderBy("_b", F.col("_first").isNotNull())
    gap = F.unix_micros("_first.event_time") - F.unix_micros(F.lag("_last").over(order))
    return (
        per_bucket.withColumn("_gap", gap)
        .where(F.col("_first").isNotNull() & (F.col("_gap").isNull() | (F.col("_gap") >= micros(recent))))
        .select("tenant_id", F.col("_first.signal_id").alias("signal_id"), F.lit(True).alias("_unseen"))
    )


def sample_decision(
    df: DataFrame,
    rate: float,
    max_size: int,
    recent: Duration = RECENT,
    last_seen: DataFrame | None = None,
    cutoffs: DataFrame | None = None,
) -> DataFrame:
    """Adds ``keep`` to scored rows.

    Kept: rows that are no spans or have no trace, scores of 50 and more, traces seen within
    ``recent``, and everything while the queue is within ``max(1, max_size * rate)``. The queue
    holds one entry per trace and never shrinks, so that last rule ends at the first row of the
    (limit + 1)-th trace of the tenant.
    """
    keep = (
        (F.col("type") != "TRACE")
        | (F.coalesce("trace_id", F.lit("")) == "")
        | (F.col("score") >= KEEP_SCORE)
        | F.col("_unseen").isNull()
    )
    limit = queue_limit(rate, max_size)
    if limit is None:
        return df.withColumn("keep", F.lit(True))
    if cutoffs is None:
        cutoffs = queue_cutoffs(first_sightings(df), limit)
    rows = df.join(unseen_rows(df, recent, last_seen), ["tenant_id", "signal_id"], "left")
    rows = rows.join(checked_broadcast(cutoffs), "tenant_id", "left")
    within = F.col("_cutoff").isNull() | (F.struct("event_time", "signal_id") < F.col("_cutoff"))
    return rows.withColumn("keep", keep | within).select(*df.columns, "keep")
