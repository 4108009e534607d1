"""Log-derived series and stream shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions import match
from signalmill.functions.time import Duration, bucket_start, closed_range, half_open_range, seconds
from signalmill.operators.select import for_tenant

# Fixed value: default row limit of a log stream query.
STREAM_LIMIT = 1000


def _selected(df, matchers, filters, t0, t1, tenant) -> DataFrame:
    return for_tenant(df, tenant).where(
        match.stream_matchers(matchers)
        & match.line_filters(filters)
        & closed_range(F.col("timestamp"), t0, t1)
    )


def _per_bucket(df, expr: Column, matchers, filters, t0, t1, step, tenant) -> DataFrame:
    rows = _selected(df, matchers, filters, t0, t1, tenant)
    return rows.groupBy(bucket_start(F.col("timestamp"), step).alias("t")).agg(expr.alias("v"))


def log_count_over_time(df, matchers=(), filters=(), t0=None, t1=None, step: Duration = "60s", tenant=None):
    return _per_bucket(df, F.count("*"), matchers, filters, t0, t1, step, tenant)


def log_rate(df, matchers=(), filters=(), t0=None, t1=None, step: Duration = "60s", tenant=None):
    return _per_bucket(df, F.count("*") / F.lit(seconds(step)), matchers, filters, t0, t1, step, tenant)


def log_bytes_over_time(df, matchers=(), filters=(), t0=None, t1=None, step: Duration = "60s", tenant=None):
    """Bytes (not characters) of matching bodies per bucket."""
    return _per_bucket(df, F.sum(F.octet_length("body")), matchers, filters, t0, t1, step, tenant)


def log_volume(
    df, tenant, t0=None, t1=None, step: Duration = "1m", service=None, severity=None, text: str = ""
) -> DataFrame:
    """Lines per bucket and severity."""
    rows = for_tenant(df, tenant).where(
        half_open_range(F.col("timestamp"), t0, t1)
        & match.any_of_values(F.col("service_name"), service)
        & match.any_of_values(F.col("severity"), severity)
    )
    if text:
        rows = rows.where(match.contains_ci(F.col("body"), text))
    return rows.groupBy(bucket_start(F.col("timestamp"), step).alias("t"), "severity").agg(F.count("*").alias("n"))


def log_lines(df, matchers=(), filters=(), t0=None, t1=None, tenant=None, limit: int = STREAM_LIMIT) -> DataFrame:
    """Newest lines matching a stream selector and its line filters."""
    rows = _selected(df, matchers, filters, t0, t1, tenant)
    return rows.orderBy(F.desc("timestamp"), F.desc("span_id")).limit(limit)


def log_streams(logs: DataFrame, page_rows: int = STREAM_LIMIT) -> DataFrame:
    """Lines per (service, severity) with ordered (ts_ns, body) entries.

    A stream comes as pages of at most ``page_rows`` lines; ``page_start`` orders them. Lines are
    range-partitioned on (stream, time), so a hot stream is cut into many partitions and never
    becomes one array. Where partitions end, pages may be shorter.
    """
    stream = ["service_name", "severity"]
    order = [*stream, "timestamp", "body"]
    paged = (
        logs.select(*order)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    page = (F.col("_row") - F.pmod("_row", F.lit(page_rows))).alias("_page")
    entry = F.struct((F.unix_micros("timestamp") * 1000).alias("ts_ns"), "body")
    pages = paged.groupBy(*stream, page).agg(
        F.min("timestamp").alias("page_start"), F.array_sort(F.collect_list(entry)).alias("entries")
    )
    return pages.drop("_page")
