"""Bucketed series over metrics: range aggregates, rates, quantiles, arithmetic and shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.functions import match
from signalmill.functions.time import Duration, bucket_start, closed_range, half_open_range, instant, micros, seconds
from signalmill.operators.select import for_tenant
from signalmill.operators.skew import exact_quantiles

_RANGE_AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def _selected(df, metric, matchers, t0, t1, tenant) -> DataFrame:
    """Samples of one metric; tenant and time predicates sit below every aggregate."""
    return for_tenant(df, tenant).where(
        (F.col("metric_name") == metric)
        & closed_range(F.col("timestamp"), t0, t1)
        & match.label_matchers(matchers)
    )


def _label_columns(by: list[str]) -> list[Column]:
    return [match.label("labels", key).alias(match.label_alias(key)) for key in by]


def _bucket(step: Duration) -> Column:
    return bucket_start(F.col("timestamp"), step).alias("t")


def range_agg(
    df: DataFrame, metric: str, agg: str = "avg", matchers=(), by=(), t0=None, t1=None,
    step: Duration = "30s", tenant: str | None = None,
) -> DataFrame:
    """One aggregate per step bucket and label group; a bare metric is its average."""
    if agg not in _RANGE_AGGREGATES:
        raise ValueError(f"unknown range aggregate {agg!r}")
    rows = _selected(df, metric, matchers, t0, t1, tenant)
    return rows.groupBy(_bucket(step), *_label_columns(by)).agg(_RANGE_AGGREGATES[agg]("value").alias("v"))


def range_quantile(
    df: DataFrame, metric: str, phi: float, matchers=(), by=(), t0=None, t1=None,
    step: Duration = "30s", tenant: str | None = None, exact: bool = True,
) -> DataFrame:
    """Quantile per bucket: exact by rank selection, or one approximate pass with bounded sketches (see :func:`sketched`)."""
    rows = _selected(df, metric, matchers, t0, t1, tenant).select(_bucket(step), *_label_columns(by), "value")
    groups = ["t", *map(match.label_alias, by)]
    if exact:
        return exact_quantiles(rows, groups, "value", {"v": phi})
    return sketched(rows, groups).select(*groups, F.kll_sketch_get_quantile_double("_sketch", F.lit(float(phi))).alias("v"))


#: Size of quantile sketches: ranks are within about half a percent of the rows, whatever their number.
SKETCH_K = 800


def sketched(rows: DataFrame, groups: list[str]) -> DataFrame:
    """A mergeable quantile sketch of ``value`` per group, ``_sketch``, built map-side; nulls and NaN count for nothing."""
    value = F.col("value").cast("double")
    rows = rows.where(value.isNotNull() & ~F.isnan(value))
    return rows.groupBy(*groups).agg(F.kll_sketch_agg_double(value, SKETCH_K).alias("_sketch"))


def range_without(
    df: DataFrame, metric: str, agg: str = "avg", matchers=(), without=(), t0=None, t1=None,
    step: Duration = "30s", tenant: str | None = None,
) -> DataFrame:
    """As :func:`range_agg`, grouped by every label except ``without`` (as sorted ``k=v`` text)."""
    dropped = F.array(*[F.lit(key) for key in without]).cast("array<string>")
    kept = F.map_filter("labels", lambda key, _: ~F.array_contains(dropped, key))
    rows = _selected(df, metric, matchers, t0, t1, tenant)
    return rows.groupBy(_bucket(step), match.labels_text(kept).alias("labels_key")).agg(
        _RANGE_AGGREGATES[agg]("value").alias("v")
    )


def _counter(df, metric, expr: Column, matchers, by, t0, t1, step, tenant, merge_series, agg) -> DataFrame:
    """A counter expression per bucket and series.

    ``by=None`` gives one row per series (``labels_key``); a list of labels combines the series of
    each label group with ``agg``. ``merge_series`` evaluates the expression over all samples of a
    group together instead, whatever series they belong to.
    """
    rows = _selected(df, metric, matchers, t0, t1, tenant)
    if merge_series:
        return rows.groupBy(_bucket(step), *_label_columns(by or ())).agg(expr.alias("v"))
    key = match.labels_text("labels").alias("labels_key")
    if by is None:
        return rows.groupBy(_bucket(step), key).agg(expr.alias("v"))
    one = rows.groupBy(_bucket(step), *_label_columns(by), key).agg(expr.alias("_v"))
    return one.groupBy("t", *map(match.label_alias, by)).agg(_RANGE_AGGREGATES[agg]("_v").alias("v"))


def rate(
    df, metric, matchers=(), by=None, t0=None, t1=None, step: Duration = "30s", tenant=None,
    merge_series=False, agg="sum",
) -> DataFrame:
    """(max - min) / step per bucket."""
    expr = (F.max("value") - F.min("value")) / F.lit(seconds(step))
    return _counter(df, metric, expr, matchers, by, t0, t1, step, tenant, merge_series, agg)


def increase(
    df, metric, matchers=(), by=None, t0=None, t1=None, step: Duration = "30s", tenant=None,
    merge_series=False, agg="sum",
) -> DataFrame:
    """max - min per bucket."""
    expr = F.max("value") - F.min("value")
    return _counter(df, metric, expr, matchers, by, t0, t1, step, tenant, merge_series, agg)


def irate(
    df, metric, matchers=(), by=None, t0=None, t1=None, step: Duration = "30s", tenant=None,
    merge_series=False, agg="sum",
) -> DataFrame:
    """(last - first) / step per bucket."""
    at = F.struct("timestamp", "value")
    expr = (F.max_by("value", at) - F.min_by("value", at)) / F.lit(seconds(step))
    return _counter(df, metric, expr, matchers, by, t0, t1, step, tenant, merge_series, agg)


def over_time(
    df, metric, fn: str, matchers=(), by=(), t0=None, t1=None, step: Duration = "30s", tenant=None,
    lookback: Duration | None = None, phi: float = 0.5, exact: bool = True,
) -> DataFrame:
    """``avg|sum|min|max|count|quantile`` over time, evaluated at every step; quantiles exact, or merged from sketches.

    Without ``lookback`` the range is the step bucket. With it (a multiple of the step) the value
    at bucket ``t`` covers the ``lookback / step`` whole buckets ending with that one, also those before ``t0``.
    """
    if lookback is not None and micros(lookback) != micros(step):
        times, remainder = divmod(micros(lookback), micros(step))
        if remainder:
            raise ValueError("lookback must be a multiple of step")
        # Each sample counts towards `times` consecutive evaluation buckets. For the mergeable
        # aggregates the samples are reduced to step buckets before they are repeated.
        return _looking_back(df, metric, fn, matchers, by, t0, t1, step, tenant, times, phi, exact)
    if fn == "quantile":
        return range_quantile(df, metric, phi, matchers, by, t0, t1, step, tenant, exact)
    return range_agg(df, metric, fn, matchers, by, t0, t1, step, tenant)


def _looking_back(df, metric, fn, matchers, by, t0, t1, step, tenant, times, phi, exact):
    groups = ["t", *map(match.label_alias, by)]
    # The first points look back behind t0: samples are read from there, points are given from t0's bucket on.
    first = bucket_start(instant(t0), step) if t0 is not None else None
    earliest = F.timestamp_micros(F.unix_micros(first) - F.lit((times - 1) * micros(step))) if t0 is not None else None
    rows = _selected(df, metric, matchers, earliest, t1, tenant).select(_bucket(step), *_label_columns(by), "value")
    if fn == "quantile" and not exact:
        rows = sketched(rows, groups)  # what is repeated below are sketches, not samples
    elif fn != "quantile":
        rows = rows.groupBy(*groups).agg(
            F.sum("value").alias("_s"), F.count("value").alias("_c"),
            F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        )
    last = F.lit(t1).cast("timestamp") if t1 is not None else None
    shifted = rows.withColumn(
        "t",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(times - 1)),
                lambda i: F.timestamp_micros(F.unix_micros("t") + i * F.lit(micros(step))),
            )
        ),
    )
    if last is not None:
        shifted = shifted.where(F.col("t") <= last)
    if first is not None:
        shifted = shifted.where(F.col("t") >= first)
    if fn == "quantile" and not exact:
        merged = shifted.groupBy(*groups).agg(F.kll_merge_agg_double("_sketch", SKETCH_K).alias("_sketch"))
        return merged.select(*groups, F.kll_sketch_get_quantile_double("_sketch", F.lit(float(phi))).alias("v"))
    if fn == "quantile":
        return exact_quantiles(shifted, groups, "value", {"v": phi})
    merged = {
        "sum": F.sum("_s"), "count": F.sum("_c"), "min": F.min("_lo"), "max": F.max("_hi"),
        "avg": F.sum("_s") / F.sum("_c"),
    }
    return shifted.groupBy(*groups).agg(merged[fn].alias("v"))


def metric_panel(df, tenant, metrics, services=None, t0=None, t1=None, step: Duration = "1m") -> DataFrame:
    """Average per bucket and metric name for the picked metrics and services."""
    rows = for_tenant(df, tenant).where(
        F.col("metric_name").isin(list(metrics))
        & match.any_of_values(match.label("labels", "service.name"), services)
        & half_open_range(F.col("timestamp"), t0, t1)
    )
    return rows.groupBy(_bucket(step), "metric_name").agg(F.avg("value").alias("v"))


def ingest_rate(df, tenant, t0=None, t1=None, step: Duration = "1m") -> DataFrame:
    """Samples received per second by bucket of arrival time and service."""
    rows = for_tenant(df, tenant).where(half_open_range(F.col("received_at"), t0, t1))
    return rows.groupBy(
        bucket_start(F.col("received_at"), step).alias("t"),
        match.label("labels", "service.name").alias("service"),
    ).agg((F.count("*") / F.lit(seconds(step))).alias("rate"))


_ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
}
_COMPARISONS = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def scalar_arith(series: DataFrame, op: str, x: float, swapped: bool = False, value: str = "v") -> DataFrame:
    """``series op x``, or ``x op series`` when swapped."""
    left, right = F.col(value), F.lit(float(x))
    return series.withColumn(value, _ARITHMETIC[op](right, left) if swapped else _ARITHMETIC[op](left, right))


def scalar_compare(series: DataFrame, op: str, x: float, swapped: bool = False, value: str = "v") -> DataFrame:
    """Keep the points for which the comparison holds; labels stay."""
    left, right = F.col(value), F.lit(float(x))
    return series.where(_COMPARISONS[op](right, left) if swapped else _COMPARISONS[op](left, right))


def instant_value(series: DataFrame, at, lookback: Duration = "30s", by: list[str] | None = None) -> DataFrame:
    """Last point of every series at or before ``at``, no older than ``lookback``."""
    by = [c for c in series.columns if c not in ("t", "v")] if by is None else by
    end = instant(at)
    start = end - F.make_dt_interval(secs=F.lit(seconds(lookback)))
    rows = series.where((F.col("t") <= end) & (F.col("t") > start))
    last = rows.groupBy(*by).agg(F.max(F.struct("t", "v")).alias("_p"), F.count("*").alias("_n"))
    return last.where(F.col("_n") > 0).select(*by, F.col("_p.t").alias("t"), F.col("_p.v").alias("v"))


def series_matrix(series: DataFrame) -> DataFrame:
    """One row per label set with its points in time order.

    The input is a bucketed series, so an array holds at most one point per step of the range.
    """
    by = [c for c in series.columns if c not in ("t", "v")]
    return series.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("points"))


def series_shape(df: DataFrame) -> DataFrame:
    """A chart table (series, t, v) from a wide result, decided from its schema.

    The first time column is t. A string column splits the first numeric column into series;
    otherwise every numeric column is a series.
    """
    times = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    numbers = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not times or not numbers:
        raise ValueError("a series needs a time column and a numeric column")
    if strings:
        return df.select(
            F.coalesce(F.col(strings[0]), F.lit("")).alias("series"),
            F.col(times[0]).alias("t"),
            F.col(numbers[0]).cast("double").alias("v"),
        )
    wide = df.select(F.col(times[0]).alias("t"), *[F.col(n).cast("double").alias(n) for n in numbers])
    return wide.unpivot("t", numbers, "series", "v").select("series", "t", "v")
