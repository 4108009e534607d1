"""StatsD lines as metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions.time import instant
from signalmill.sources.otlp import last_wins, plain_double

# Metric types, and the number syntax a value must have.
TYPES = ("c", "g", "ms", "h", "s")
_NUMBER = r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"


def statsd_metrics(
    df_lines: DataFrame, tenant: str, line: str = "value", received_at: str | Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """``name:value|type[|@rate][|#k:v,…]`` lines as metric rows, and the lines that are none.

    Tags become labels ``tag.<k>``, beside ``source``, ``metric_type`` and, when it lies strictly
    between 0 and 1, ``sample_rate``. Rows have the time of their arrival: ``received_at``, a time or a
    column of the lines (default: now).
    """
    at = F.current_timestamp() if received_at is None else instant(received_at)
    lines = df_lines.select(F.trim(F.col(line), F.lit(" \t\r\n")).alias("line"), at.alias("received_at")).where("line <> ''")
    colon = F.instr("line", ":")
    parts = F.split(F.substr("line", colon + 1), r"\|")
    parsed = lines.withColumn("_colon", colon).withColumn("_parts", parts)
    raw = F.get("_parts", 0)
    kind = F.get("_parts", 1)
    good = F.coalesce((F.col("_colon") > 1) & kind.isin(list(TYPES)) & raw.rlike(_NUMBER), F.lit(False))

    # Columns of their own, so that what refers to them often is worked out once.
    parsed = parsed.withColumn("_extras", F.slice("_parts", 3, F.greatest(F.size("_parts"), F.lit(1))))
    extras = F.col("_extras")
    rates = F.filter(
        F.transform(
            F.filter(extras, lambda p: p.startswith("@")), lambda p: F.substr(p, F.lit(2)).try_cast("double")
        ),
        lambda r: r.isNotNull(),
    )
    rate = F.try_element_at(rates, F.lit(-1))
    tag_parts = F.filter(extras, lambda p: p.startswith("#"))
    pairs = F.flatten(F.transform(tag_parts, lambda p: F.split(F.substr(p, F.lit(2)), ",")))
    tags = F.transform(
        pairs,
        lambda p: F.struct(
            F.concat(F.lit("tag."), F.substring_index(p, ":", 1)).alias("key"),
            F.when(F.instr(p, ":") > 0, F.substr(p, F.instr(p, ":") + 1)).otherwise(F.lit("")).alias("value"),
        ),
    )
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    parsed = parsed.withColumn("_rate", rate)
    kept_rate = F.when((F.col("_rate") > 0) & (F.col("_rate") < 1), F.col("_rate"))
    labels = F.concat(
        F.array(entry("source", F.lit("statsd")), entry("metric_type", kind)),
        tags,
        F.when(kept_rate.isNotNull(), F.array(entry("sample_rate", plain_double(kept_rate.cast("string"))))).otherwise(
            F.array().cast("array<struct<key:string,value:string>>")
        ),
    )
    metrics = parsed.where(good).select(
        F.lit(tenant).alias("tenant_id"),
        F.substr("line", F.lit(1), F.col("_colon") - 1).alias("metric_name"),
        kind.alias("metric_type"),
        raw.cast("double").alias("value"),
        kept_rate.alias("sample_rate"),
        last_wins(labels).alias("labels"),
        F.col("received_at").alias("timestamp"),
        "received_at",
    )
    return metrics, parsed.where(~good).select("line")
