"""Projections, filters, searches and top-k over the stored tables.

Every entry takes the tenant first, so the predicate reaches the scan and prunes partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions import match
from signalmill.functions.time import Duration, half_open_range, instant, micros
from signalmill.schemas import TIME_COLUMN, columns_of

# Fixed value: the largest LIMIT a query may ask for.
LIMIT_CAP = 10_000

# Aggregate functions of the query surface.
_AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def for_tenant(df: DataFrame, tenant: str | None) -> DataFrame:
    return df if tenant is None else df.where(F.col("tenant_id") == tenant)


def select_columns(df: DataFrame, source: str, cols: list[str] | str = "*") -> DataFrame:
    """Projection limited to the source's columns; ``"*"`` gives all of them."""
    allowed = columns_of(source)
    wanted = allowed if cols in ("*", ["*"]) else list(cols)
    unknown = [c for c in wanted if c not in allowed]
    if unknown:
        raise ValueError(f"unknown columns for {source}: {unknown}")
    return df.select(*wanted)


def column(source: str, name: str) -> Column:
    """A column of the source for use in :func:`where_expr`."""
    if name not in columns_of(source):
        raise ValueError(f"unknown column for {source}: {name}")
    return F.col(name)


def where_expr(df: DataFrame, condition: Column) -> DataFrame:
    """Boolean filter built from :func:`column` with comparisons and ``& | ~``."""
    return df.where(condition)


def since_filter(df: DataFrame, source: str, duration: Duration = "1h", *, as_of) -> DataFrame:
    """Rows whose time is at or after ``as_of - duration``; prunes the day partition if there is one."""
    start = instant(as_of) - F.make_dt_interval(secs=F.lit(micros(duration) / 1e6))
    kept = df.where(F.col(TIME_COLUMN[source]) >= start)
    return kept.where(F.col("date") >= F.to_date(start)) if "date" in df.columns else kept


def label_match(df: DataFrame, matchers: list[match.Matcher], map_col: str = "labels") -> DataFrame:
    return df.where(match.label_matchers(matchers, map_col))


def stream_select(df: DataFrame, matchers: list[match.Matcher]) -> DataFrame:
    return df.where(match.stream_matchers(matchers))


def line_filter(df: DataFrame, filters: list[tuple[str, str]]) -> DataFrame:
    return df.where(match.line_filters(filters))


def group_agg(
    df: DataFrame, by: list[str], aggs: list[tuple[str, str, str]], tenant: str | None = None
) -> DataFrame:
    """``aggs`` are (function, column or ``*``, output name); no ``by`` aggregates globally."""
    exprs = []
    for function, col, name in aggs:
        if function not in _AGGREGATES:
            raise ValueError(f"unknown aggregate {function!r}")
        if col == "*" and function != "count":
            raise ValueError(f"{function}(*) is not an aggregate")
        exprs.append(_AGGREGATES[function](col).alias(name))
    return for_tenant(df, tenant).groupBy(*by).agg(*exprs)


def newest_rows(df: DataFrame, source: str, limit: int = 1000, cap: int = LIMIT_CAP, tiebreak: str | None = None):
    """Newest rows by the source's time column; the limit is clamped to ``cap``."""
    order = [F.col(TIME_COLUMN[source]).desc()] + ([F.col(tiebreak).desc()] if tiebreak else [])
    return df.orderBy(*order).limit(min(limit if limit > 0 else cap, cap))


def log_search(
    df: DataFrame,
    tenant: str,
    t0=None,
    t1=None,
    service: list[str] | str | None = None,
    severity: list[str] | str | None = None,
    text: str = "",
    limit: int = 500,
) -> DataFrame:
    """Newest matching log lines; each filter is optional."""
    hits = for_tenant(df, tenant).where(
        half_open_range(F.col("timestamp"), t0, t1)
        & match.any_of_values(F.col("service_name"), service)
        & match.any_of_values(F.col("severity"), severity)
    )
    if text:
        hits = hits.where(match.contains_ci(F.col("body"), text))
    return hits.orderBy(F.desc("timestamp"), F.desc("span_id")).limit(limit)


def trace_search(
    df: DataFrame,
    tenant: str,
    t0=None,
    t1=None,
    service: list[str] | str | None = None,
    min_ms: float = 0,
    limit: int = 200,
) -> DataFrame:
    """Newest spans of at least ``min_ms``."""
    hits = for_tenant(df, tenant).where(
        half_open_range(F.col("start_time"), t0, t1)
        & match.any_of_values(F.col("service_name"), service)
        & (F.col("duration_ns") >= int(min_ms * 1_000_000))
    )
    return (
        hits.orderBy(F.desc("start_time"), F.desc("span_id"))
        .limit(limit)
        .select(
            "trace_id", "service_name", "operation_name", "start_time",
            (F.col("duration_ns") / 1e6).alias("duration_ms"), "status_code",
        )
    )


def trace_detail(df: DataFrame, tenant: str, trace_id: str) -> DataFrame:
    return for_tenant(df, tenant).where(F.col("trace_id") == trace_id).orderBy("start_time", "span_id")


def top_metrics(df: DataFrame, tenant: str, *, as_of, k: int = 20, window: Duration = "1h") -> DataFrame:
    """Metric names with the most samples in the last ``window``."""
    recent = since_filter(for_tenant(df, tenant), "metrics", window, as_of=as_of)
    return (
        recent.groupBy("metric_name")
        .agg(F.count("*").alias("samples"))
        .orderBy(F.desc("samples"), "metric_name")
        .limit(k)
    )


def slow_operations(df: DataFrame, tenant: str, t0=None, t1=None, min_ms: float = 0, k: int = 15) -> DataFrame:
    """Operations with the largest mean duration among spans of at least ``min_ms``."""
    hits = for_tenant(df, tenant).where(
        half_open_range(F.col("start_time"), t0, t1) & (F.col("duration_ns") >= int(min_ms * 1_000_000))
    )
    return (
        hits.groupBy(F.concat("service_name", F.lit(" · "), "operation_name").alias("op"))
        .agg((F.avg("duration_ns") / 1e6).alias("avg_ms"))
        .orderBy(F.desc("avg_ms"), "op")
        .limit(k)
    )


def recent_samples(df: DataFrame, tenant: str, *, as_of, k: int = 100, window: Duration = "15m") -> DataFrame:
    """Newest samples of the last ``window``."""
    recent = since_filter(for_tenant(df, tenant), "metrics", window, as_of=as_of)
    return (
        recent.select("timestamp", "metric_name", "value", match.label("labels", "service.name").alias("service"))
        .orderBy(F.desc("timestamp"), "metric_name", "service", "value")
        .limit(k)
    )


def distinct_values(df: DataFrame, expr: Column, tenant: str | None = None) -> DataFrame:
    """Sorted distinct non-empty values, as pickers list them."""
    values = for_tenant(df, tenant).select(expr.alias("value")).where(F.col("value") != "")
    return values.distinct().orderBy("value")
