"""Retention: per-tenant lifetimes, storage tiers and the job that applies them."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.functions.time import instant
from signalmill.operators.skew import checked_broadcast
from signalmill.schemas import SOURCES, TIME_COLUMN
from signalmill.session import listed, reliable, remove, rename

# Default (hot, total) days and the largest allowed number of days per table.
DEFAULT_DAYS = {"metrics": (30, 90), "logs": (14, 30), "traces": (7, 30)}
MAX_DAYS = {"metrics": 3650, "logs": 730, "traces": 730}
TENANT_PATTERN = r"^[a-z0-9_-]{1,63}$"


def checked_specs(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid retention specs, and the rejected ones with a reason."""
    problems = [
        (~F.coalesce(F.col("tenant_id").rlike(TENANT_PATTERN), F.lit(False)), "tenant_id"),
    ]
    for table, most in MAX_DAYS.items():
        hot = F.coalesce(F.col(f"{table}_hot_days"), F.lit(0))
        total = F.coalesce(F.col(f"{table}_total_days"), F.lit(0))
        problems += [
            (~hot.between(0, most), f"{table}_hot_days"),
            (~total.between(0, most), f"{table}_total_days"),
            ((hot > 0) & (total > 0) & (total < hot), f"{table}_total_days below {table}_hot_days"),
        ]
    bad = functools.reduce(operator.or_, [condition for condition, _ in problems])
    reason = F.coalesce(*[F.when(condition, F.lit(text)) for condition, text in problems])
    return specs.where(~bad), specs.where(bad).withColumn("reason", reason)


def retention_overrides(df: DataFrame, specs: DataFrame, table: str) -> DataFrame:
    """Adds hot_days and total_days: the tenant's valid spec where set, else the table default."""
    hot, total = DEFAULT_DAYS[table]
    valid, _ = checked_specs(specs)
    per_tenant = valid.groupBy("tenant_id").agg(
        F.max(f"{table}_hot_days").alias("_hot"), F.max(f"{table}_total_days").alias("_total")
    )
    joined = df.join(checked_broadcast(per_tenant), "tenant_id", "left")
    return joined.select(
        *df.columns,
        F.coalesce(F.nullif("_hot", F.lit(0)), F.lit(hot)).cast("long").alias("hot_days"),
        F.coalesce(F.nullif("_total", F.lit(0)), F.lit(total)).cast("long").alias("total_days"),
    )


def retention_tier(df: DataFrame, table: str, specs: DataFrame, *, as_of) -> DataFrame:
    """Adds ``tier``: hot, cold or expired by age in days at ``as_of``."""
    rows = retention_overrides(df, specs, table)
    age_us = F.unix_micros(instant(as_of)) - F.unix_micros(F.date_trunc("second", F.col(TIME_COLUMN[table])))
    day = F.lit(86_400_000_000)
    tier = (
        F.when(age_us >= F.col("total_days") * day, "expired")
        .when(age_us >= F.col("hot_days") * day, "cold")
        .otherwise("hot")
    )
    return rows.withColumn("tier", tier)


def retention_apply(
    spark: SparkSession,
    hot_path: str,
    cold_path: str,
    table: str,
    specs: DataFrame,
    *,
    as_of: str,
    partitions: tuple[str, ...] = ("date", "tenant_id"),
) -> DataFrame:
    """Move hot rows that are due to the cold store and drop rows past their total age from both.

    Both stores are partitioned by ``partitions`` (day first); only days that change are replaced. The
    new content of those days is first staged beside each store, then a plan is written, then whole days
    are swapped. A run that finds the plan of an interrupted one swaps its days first, so no row is lost
    or stored twice wherever a run breaks off. Returns per day the hot rows kept and moved, and the rows
    dropped from either store.
    """
    day = partitions[0]
    hot, cold = hot_path.rstrip("/"), cold_path.rstrip("/")
    _finish(spark, hot, cold, day)
    schema = T.StructType([*SOURCES[table].fields, T.StructField(day, T.DateType())])

    def tiered(path: str) -> DataFrame:
        stored = any(name.startswith(f"{day}=") for name in listed(spark, path))
        rows = spark.read.schema(schema).parquet(path) if stored else spark.createDataFrame([], schema)
        return retention_tier(rows, table, specs, as_of=as_of).select(*schema.names, "tier")

    in_hot, in_cold = tiered(hot), tiered(cold)
    is_tier = lambda *names: F.count_if(F.col("tier").isin(*names))
    hot_days = in_hot.groupBy(day).agg(is_tier("hot").alias("kept"), is_tier("cold").alias("moved"), is_tier("expired").alias("_gone"))
    cold_days = in_cold.groupBy(day).agg(is_tier("expired").alias("_cold_gone"), is_tier("hot", "cold").alias("_cold_kept"))
    zero = F.lit(0).cast("long")
    # One row per day of the table's lifetime.
    report = reliable(
        hot_days.join(cold_days, day, "full_outer")
        .na.fill(0, ["kept", "moved", "_gone", "_cold_gone", "_cold_kept"])
        .withColumn("dropped", F.coalesce(F.col("_gone") + F.col("_cold_gone"), zero))
    )
    changing = report.where("moved + dropped > 0")
    days = [row[day] for row in changing.select(day).collect()]
    if days:
        of_days = F.col(day).isin(days)
        moved = in_hot.where(of_days & (F.col("tier") == "cold"))
        kept = in_cold.where(of_days & (F.col("tier") != "expired"))
        for rows, path in ((in_hot.where(of_days & (F.col("tier") == "hot")), hot), (kept.unionByName(moved), cold)):
            rows.drop("tier").write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/{_STAGE}")
        changing.select(
            day, F.col("kept").alias("hot_rows"), (F.col("_cold_kept") + F.col("moved")).alias("cold_rows")
        ).write.mode("overwrite").parquet(f"{hot}/{_PLAN}")
        _finish(spark, hot, cold, day)
    return report.where("kept + moved + dropped > 0").select(day, "kept", "moved", "dropped")


# Folders beside a store's days; Spark's readers pass over names that begin with an underscore.
_STAGE, _PLAN = "_retention", "_retention_plan"


def _finish(spark: SparkSession, hot: str, cold: str, day: str) -> None:
    """Swap the days of a complete plan, if there is one; days that were swapped before stay as they are."""
    if "_SUCCESS" not in listed(spark, f"{hot}/{_PLAN}"):
        return
    for row in spark.read.parquet(f"{hot}/{_PLAN}").collect():
        for path, rows in ((cold, row["cold_rows"]), (hot, row["hot_rows"])):
            _swap(spark, path, f"{day}={row[day]}", rows)
    for path in (f"{hot}/{_PLAN}", f"{hot}/{_STAGE}", f"{cold}/{_STAGE}"):
        remove(spark, path)


def _swap(spark: SparkSession, path: str, name: str, rows: int) -> None:
    staged = name in listed(spark, f"{path}/{_STAGE}")
    if staged or not rows:
        remove(spark, f"{path}/{name}")
    if staged:
        rename(spark, f"{path}/{_STAGE}/{name}", f"{path}/{name}")


def storage_tiers(spark: SparkSession, roots: dict[tuple[str, str], str]) -> DataFrame:
    """Files and bytes per (table, tier) from a file listing; no file is opened."""
    parts = [
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select(F.lit(table).alias("table_name"), F.lit(tier).alias("tier"), "length")
        for (table, tier), path in roots.items()
    ]
    files = functools.reduce(DataFrame.unionByName, parts)
    return files.groupBy("table_name", "tier").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
