"""Stored tables: scans, hot and cold unions, and writers."""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.functions.time import closed_range, instant
from signalmill.schemas import SOURCES, TIME_COLUMN
from signalmill.session import scratch_path

# Row-group size of exports, and the columns that order a hot and cold union.
EXPORT_ROW_GROUP = 64 * 1024
UNION_ORDER = ("_ts", "timestamp", "start_time", "ts")

_SORT_KEY = {
    "metrics": ["tenant_id", "metric_name", "timestamp"],
    "logs": ["tenant_id", "service_name", "timestamp"],
    "traces": ["tenant_id", "trace_id", "start_time"],
}


def write_source(df: DataFrame, source: str, root: str, mode: str = "append") -> None:
    """Write a stored table under ``root/<source>``, partitioned by day and tenant.

    Rows are rebalanced on the partition columns: small partitions share a task and a hot one is
    split over several. Files are sorted by the table's key for row-group pruning; those with trace ids have
    Bloom filters on them, so that a lookup of one trace opens few row groups of few files.
    """
    time = TIME_COLUMN[source]
    writer = df.withColumn("date", F.to_date(time)).hint("rebalance", "date", "tenant_id").sortWithinPartitions("date", *_SORT_KEY[source]).write
    if "trace_id" in df.columns:
        writer = writer.option("parquet.bloom.filter.enabled#trace_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
    (
        writer.mode(mode)
        .partitionBy("date", "tenant_id")
        .parquet(f"{root.rstrip('/')}/{source}")
    )


def scan_source(
    spark: SparkSession, root: str, source: str, tenant: str, t0: str | datetime | None = None, t1=None
) -> DataFrame:
    """One tenant's rows of a stored table; tenant and day prune directories."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}; expected one of {sorted(SOURCES)}")
    schema = T.StructType([*SOURCES[source].fields, T.StructField("date", T.DateType())])
    rows = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{source}").where(F.col("tenant_id") == tenant)
    if t0 is not None:
        rows = rows.where(F.col("date") >= F.to_date(instant(t0)))
    if t1 is not None:
        rows = rows.where(F.col("date") <= F.to_date(instant(t1)))
    return rows.where(closed_range(F.col(TIME_COLUMN[source]), t0, t1)).select(*SOURCES[source].names)


def cold_scan(spark: SparkSession, path: str, base_path: str | None = None) -> DataFrame:
    """Cold Parquet files by path or glob; ``base_path`` keeps their partition columns."""
    reader = spark.read
    if base_path is not None:
        reader = reader.option("basePath", base_path)
    return reader.parquet(path)


def hot_cold_union(*stores: DataFrame) -> DataFrame:
    """Rows of several stores in time order; equal times keep the order of the stores and their rows.

    The row position also splits a time that very many rows share over several sort partitions.
    """
    columns = stores[0].columns
    tagged = [
        store.withColumns({"_store": F.lit(i), "_row": F.monotonically_increasing_id()})
        for i, store in enumerate(stores)
    ]
    union = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    times = [F.col(c) for c in UNION_ORDER if c in union.columns]
    order = [F.coalesce(*times)] if times else []
    return union.orderBy(*order, "_store", "_row").select(*columns)


def export_parquet(df: DataFrame, path: str, codec: str = "snappy", rows_per_group: int = EXPORT_ROW_GROUP) -> None:
    """Write a result as Parquet; files are cut at a multiple of the row group."""
    (
        df.write.mode("overwrite")
        .option("compression", codec)
        .option("parquet.page.row.count.limit", str(rows_per_group))
        .option("parquet.block.row.count.limit", str(rows_per_group))
        .option("maxRecordsPerFile", rows_per_group * 16)
        .parquet(path)
    )


def export_ndjson(df: DataFrame, path: str, source: str, limit: int | None = None, estimate: int | None = None) -> DataFrame:
    """Write a result as NDJSON and return its header and trailer as one row."""
    seen = Observation("export")
    started = datetime.now()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
    ).json(path)
    elapsed = int((datetime.now() - started).total_seconds() * 1000)
    return df.sparkSession.createDataFrame(
        [(source, df.columns, limit, estimate, seen.get["rows"], elapsed)],
        "source string, columns array<string>, limit long, estimate long, rows_returned long, duration_ms long",
    )


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
