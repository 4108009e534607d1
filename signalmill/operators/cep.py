"""Sliding-window rules with edge-triggered events.

Windows are whole one-minute buckets: a row at minute ``m`` sees minutes ``m-N+1 .. m``, its own
minute only up to itself. Within a minute counts and peaks never fall, so a rule can start firing at
most once per (key, minute). Everything but the position inside that minute follows from
per-minute aggregates.
"""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions import match
from signalmill.functions.time import bucket_number, Duration, duration_text, micros, seconds
from signalmill.operators.skew import LEAF_ROWS, checked_broadcast, fitting_ids, fitting_step, id_slot, nth_flagged

KEYS = ["tenant_id", "service_name"]

# Event types and rule defaults.
HIGH_ERROR_RATE = "HIGH_ERROR_RATE"
HIGH_LATENCY = "HIGH_LATENCY"
ERROR_RATE_THRESHOLD = 1.0
LATENCY_THRESHOLD_MS = 1000.0
WINDOW = "5m"


def service_of(attributes: str | Column = "attributes") -> Column:
    """``service.name``, else ``service_name``, else ``unknown``."""
    return F.coalesce(
        F.nullif(match.label(attributes, "service.name"), F.lit("")),
        F.nullif(match.label(attributes, "service_name"), F.lit("")),
        F.lit("unknown"),
    )


def _buckets(window: Duration, bucket: Duration) -> int:
    return max(1, micros(window) // micros(bucket))


def _earlier_buckets(keys: list[str], n: int):
    """Frame of the ``n - 1`` buckets before the current one."""
    return Window.partitionBy(*keys).orderBy("_b").rangeBetween(-(n - 1), -1)


def _earlier_sum(value: Column, keys: list[str], n: int) -> Column:
    """Sum over the ``n - 1`` buckets before the current one, as a difference of running sums."""
    order = Window.partitionBy(*keys).orderBy("_b")

    def running(lag: int) -> Column:
        return F.coalesce(F.sum(value).over(order.rangeBetween(Window.unboundedPreceding, -lag)), F.lit(0))

    return running(1) - running(n)


def sliding_rate(
    df: DataFrame,
    keys: list[str],
    flag: Column,
    window: Duration = WINDOW,
    bucket: Duration = "1m",
    time: str = "event_time",
    row_id: str = "signal_id",
    slice_width: Duration = "1s",
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Per row: flagged rows in the last N buckets up to and including it, and that per second.

    Rows are windowed per (key, slice) only; everything before the slice comes from counts per
    slice and per bucket, so a hot key is spread over its slices, which shrink while one of them is
    too large; what shares one microsecond is split by id.
    """
    n = _buckets(window, bucket)
    if micros(bucket) % micros(slice_width):
        raise ValueError("bucket must be a multiple of slice_width")
    slice_width = timedelta(microseconds=fitting_step(df, keys, time, slice_width, leaf_rows))
    ids = fitting_ids(df, keys, time, row_id, micros(slice_width), leaf_rows)
    rows = df.withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("long")).withColumns(
        {"_s": bucket_number(F.col(time), slice_width), "_i": id_slot(row_id, ids)}
    )
    per_slice = F.lit(micros(bucket) // micros(slice_width))
    counts = (
        rows.groupBy(*keys, "_s", "_i")
        .agg(F.sum("_flag").alias("_c"))
        .withColumn("_b", ((F.col("_s") - F.pmod("_s", per_slice)) / per_slice).cast("long"))
    )
    earlier = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c")).select(
        *keys, "_b", _earlier_sum(F.col("_c"), keys, n).alias("_base")
    )
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_s", "_i").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        counts.withColumn("_in", F.coalesce(F.sum("_c").over(in_bucket), F.lit(0)))
        .join(earlier, [*keys, "_b"])
        .select(*keys, "_s", "_i", (F.col("_base") + F.col("_in")).alias("_before"))
    )
    running = Window.partitionBy(*keys, "_s", "_i").orderBy(time, row_id).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(before, [*keys, "_s", "_i"])
        .withColumn("n", F.col("_before") + F.sum("_flag").over(running))
        .withColumn("rate", F.col("n") / F.lit(seconds(window)))
        .drop("_flag", "_s", "_i", "_before")
    )


def count_threshold(threshold: float, window: Duration) -> int:
    """Smallest count whose rate over the window reaches the threshold."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    span = seconds(window)
    count = max(0, math.floor(threshold * span) - 1)
    while count / span < threshold:
        count += 1
    return count


def _with_carried(here: DataFrame, carried: DataFrame | None, sums: list[str], peaks: list[str]) -> DataFrame:
    """This batch's minutes and the carried ones, one row per (key, minute).

    ``_old_<c>`` holds the carried part of each column, ``_old_firing`` the state at its end.
    """
    columns = sums + peaks
    if carried is None:
        return here.withColumns(
            {f"_old_{c}": (F.lit(0) if c in sums else F.lit(None)).cast(here.schema[c].dataType) for c in columns}
        ).withColumns({"_new": F.lit(True), "_old_firing": F.lit(None).cast("boolean")})
    extra = [c for c in here.columns if c not in (*KEYS, "_b", *columns)]
    old = carried.select(
        *KEYS, "_b", *[F.col(c).alias(f"_old_{c}") for c in columns], F.col("_firing").alias("_old_firing")
    )
    # A carried minute only meets the batch in the minute the batch boundary cuts.
    both = here.withColumn("_new", F.lit(True)).join(old, [*KEYS, "_b"], "full_outer")
    return both.select(
        *KEYS,
        "_b",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in sums],
        *peaks,
        *extra,
        *[F.coalesce(f"_old_{c}", F.lit(0)).alias(f"_old_{c}") for c in sums],
        *[f"_old_{c}" for c in peaks],
        F.coalesce("_new", F.lit(False)).alias("_new"),
        "_old_firing",
    )


def _edge_state(minutes: DataFrame, breached: Column) -> DataFrame:
    """Adds the rule's state at the end of each minute, and just before its new rows."""
    firing = F.when(F.col("_new"), breached).otherwise(F.col("_old_firing"))
    before = F.lag("_firing").over(Window.partitionBy(*KEYS).orderBy("_b"))
    return minutes.withColumn("_firing", firing).withColumn(
        "_was_firing", F.coalesce("_old_firing", before, F.lit(False))
    )


def error_minutes(
    df: DataFrame, window: Duration, threshold: float, carried: DataFrame | None = None
) -> DataFrame:
    """Per key and minute: rows, errors, both over the minutes before, and the rule's state."""
    n = _buckets(window, "1m")
    needed = count_threshold(threshold, window)
    here = df.groupBy(*KEYS, bucket_number(F.col("event_time"), "1m").alias("_b")).agg(
        F.count("*").alias("_rows"), F.count_if(F.col("is_error")).alias("_errors")
    )
    minutes = _with_carried(here, carried, ["_rows", "_errors"], [])

    def base(name: str) -> Column:
        return _earlier_sum(F.col(name) + F.col(f"_old_{name}"), KEYS, n) + F.col(f"_old_{name}")

    minutes = minutes.withColumn("_base_errors", base("_errors")).withColumn("_base_rows", base("_rows"))
    return _edge_state(minutes, F.col("_base_errors") + F.col("_errors") >= needed)


def high_error_rate(
    df: DataFrame,
    window: Duration = WINDOW,
    threshold: float = ERROR_RATE_THRESHOLD,
    minutes: DataFrame | None = None,
) -> DataFrame:
    """One event per rising edge of the per-service error rate.

    ``df`` has tenant_id, service_name, event_time, signal_id, is_error (logs and spans).
    ``minutes`` is its :func:`error_minutes`, given where earlier minutes are carried in.
    """
    needed = count_threshold(threshold, window)
    if minutes is None:
        minutes = error_minutes(df, window, threshold)
    candidates = minutes.where(
        F.col("_new") & (F.col("_base_errors") < needed) & (F.col("_base_errors") + F.col("_errors") >= needed)
    ).select(*KEYS, "_b", "_base_rows", "_was_firing", (needed - F.col("_base_errors")).alias("nth"))
    candidates = checked_broadcast(candidates)
    rows = df.select(*KEYS, "event_time", "signal_id", "is_error").withColumn(
        "_b", bucket_number(F.col("event_time"), "1m")
    )
    crossing = nth_flagged(rows, [*KEYS, "_b"], "event_time", "signal_id", F.col("is_error"), candidates, "1s")
    span = F.lit(seconds(window))
    total = F.col("_base_rows") + F.col("position")
    return (
        crossing.drop("nth")
        .join(candidates, [*KEYS, "_b"])
        # The minute's first row continues a breach that held just before it.
        .where(~(F.col("_was_firing") & (F.col("position") == 1)))
        .select(
            *KEYS,
            "event_time",
            "signal_id",
            (F.lit(needed) / span).alias("error_rate"),
            (F.lit(needed) / total).alias("error_ratio"),
            (total / span).alias("total_rate"),
            F.lit(duration_text(window)).alias("window"),
        )
    )


def latency_minutes(
    df: DataFrame, window: Duration, threshold_ms: float, carried: DataFrame | None = None
) -> DataFrame:
    """Per key and minute: peak, first time, first time at or above the threshold, and the rule's state.

    Every aggregate has a fixed-width buffer, so this is a hash aggregate without a sort.
    """
    if threshold_ms <= 0:
        raise ValueError("threshold must be positive")
    n = _buckets(window, "1m")
    here = (
        df.where(F.col("duration_ms").isNotNull())
        .groupBy(*KEYS, bucket_number(F.col("event_time"), "1m").alias("_b"))
        .agg(
            F.max("duration_ms").alias("_peak"),
            F.min("event_time").alias("_first_at"),
            F.min(F.when(F.col("duration_ms") >= threshold_ms, F.col("event_time"))).alias("_crossing_at"),
        )
    )
    minutes = _with_carried(here, carried, [], ["_peak"])
    whole = F.greatest("_peak", "_old__peak")
    earlier = F.max(whole).over(_earlier_buckets(KEYS, n)) if n > 1 else F.lit(None).cast("double")
    minutes = minutes.withColumn("_base", F.coalesce(F.greatest(earlier, F.col("_old__peak")), F.lit(0.0)))
    return _edge_state(minutes, F.greatest("_base", "_peak") >= threshold_ms)


def high_latency(
    df: DataFrame,
    window: Duration = WINDOW,
    threshold_ms: float = LATENCY_THRESHOLD_MS,
    minutes: DataFrame | None = None,
) -> DataFrame:
    """One event per rising edge of the per-service latency peak.

    ``df`` has tenant_id, service_name, event_time, signal_id, duration_ms (spans). One aggregate
    per (key, minute) decides every edge; the rows at the few crossing times are then looked up for
    their ids. ``minutes`` is its :func:`latency_minutes`, given where earlier minutes are carried in.
    """
    if minutes is None:
        minutes = latency_minutes(df, window, threshold_ms)
    crossings = checked_broadcast(
        minutes.where(F.col("_new") & (F.col("_base") < threshold_ms) & F.col("_crossing_at").isNotNull()).select(
            *KEYS, F.col("_crossing_at").alias("event_time"), (F.col("_crossing_at") == F.col("_first_at")).alias("_at_first"),
            "_was_firing",
        )
    )
    rows = df.where(F.col("duration_ms").isNotNull()).select(*KEYS, "event_time", "signal_id", "duration_ms")
    slow = F.when(F.col("duration_ms") >= threshold_ms, F.struct("signal_id", "duration_ms"))
    found = (
        rows.join(crossings, [*KEYS, "event_time"])
        .groupBy(*KEYS, "event_time", "_at_first", "_was_firing")
        .agg(F.min(slow).alias("_row"), F.min("signal_id").alias("_least"))
    )
    # The minute's first row continues a breach that held just before it.
    continues = F.col("_was_firing") & F.col("_at_first") & (F.col("_row.signal_id") == F.col("_least"))
    return found.where(~continues).select(
        *KEYS,
        "event_time",
        F.col("_row.signal_id").alias("signal_id"),
        F.col("_row.duration_ms").alias("peak_latency"),
        F.lit(float(threshold_ms)).alias("threshold"),
        F.lit(duration_text(window)).alias("window"),
    )


def rule_engine(rule_events: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rules' events in rule order; a signal that trips several keeps the first rule's event."""
    merged = None
    for rank, (event_type, events) in enumerate(rule_events):
        one = events.select(
            "signal_id", F.lit(event_type).alias("event_type"), *KEYS, "event_time", F.lit(rank).alias("_rank")
        )
        merged = one if merged is None else merged.unionByName(one)
    if merged is None:
        raise ValueError("rule_engine needs at least one rule")
    pick = F.min_by(F.struct("event_type", *[c for c in KEYS if c != "tenant_id"], "event_time"), "_rank")
    return merged.groupBy("tenant_id", "signal_id").agg(pick.alias("e")).select(
        "signal_id", "e.event_type", "tenant_id", "e.service_name", "e.event_time"
    )
