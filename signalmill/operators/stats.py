"""Table and series statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_stats(df: DataFrame, columns: list[str], table_name: str, exact: bool = False) -> DataFrame:
    """Row count and distinct values per column in one pass; sketches unless ``exact``."""
    ndv = F.count_distinct if exact else F.approx_count_distinct
    counted = df.agg(F.count("*").alias("row_count"), *[ndv(F.col(c)).alias(c) for c in columns])
    return counted.unpivot("row_count", list(columns), "column_name", "ndv").select(
        F.lit(table_name).alias("table_name"), "column_name", "row_count", "ndv"
    )


def column_sketches(df: DataFrame, columns: list[str], by: list[str], precision: int = 14) -> DataFrame:
    """Per group of ``by`` (such as the day): ``row_count`` and a distinct-count sketch of each column.

    Kept beside a table they make its statistics without its rows: a new day is sketched alone, and
    :func:`merged_stats` puts all days together. A sketch has at most 2**``precision`` bytes.
    """
    text = lambda c: F.col(c) if dict(df.dtypes)[c] in ("string", "bigint", "int", "binary") else F.col(c).cast("string")
    return df.groupBy(*by).agg(F.count("*").alias("row_count"), *[F.hll_sketch_agg(text(c), precision).alias(c) for c in columns])


def merged_stats(sketches: DataFrame, columns: list[str], table_name: str) -> DataFrame:
    """:func:`table_stats` from sketches, whatever groups they were made by."""
    merged = sketches.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
        *[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in columns],
    )
    return merged.unpivot("row_count", list(columns), "column_name", "ndv").select(
        F.lit(table_name).alias("table_name"), "column_name", "row_count", "ndv"
    )


def default_ndv(row_count: int) -> int:
    """Assumed distinct values of a column without statistics."""
    return row_count // 10


def series_count(df: DataFrame) -> DataFrame:
    """Distinct (tenant, metric) series per tenant."""
    return df.select("tenant_id", "metric_name").distinct().groupBy("tenant_id").agg(F.count("*").alias("series"))
