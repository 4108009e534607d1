"""Audit trail: listing and tamper-evident export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalmill.operators.select import for_tenant

# List limits, and records per checksum.
LIST_DEFAULT, LIST_MAX = 100, 500
BATCH_RECORDS = 1000

_HOUR = ["y", "m", "d", "h"]


def checked_audit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with an actor, an action and a time; and the others."""
    complete = (
        (F.coalesce("actor", F.lit("")) != "")
        & (F.coalesce("action", F.lit("")) != "")
        & F.col("occurred_at").isNotNull()
    )
    return df.where(complete), df.where(~complete)


def audit_lines(df: DataFrame, batch_records: int = BATCH_RECORDS) -> DataFrame:
    """Records as JSON lines with their UTC hour and batch.

    Ids are unique, so a batch of ``batch_records`` consecutive ids is bounded by construction.
    """
    valid, _ = checked_audit(df)
    at = F.col("occurred_at")
    fields = ["id", "tenant_id", "actor", "action", "details", "source_ip"]
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurred_at")
    return valid.select(
        F.date_format(at, "yyyy").alias("y"),
        F.date_format(at, "MM").alias("m"),
        F.date_format(at, "dd").alias("d"),
        F.date_format(at, "HH").alias("h"),
        ((F.col("id") - F.pmod("id", F.lit(batch_records))) / batch_records).cast("long").alias("batch"),
        "id",
        F.to_json(F.struct(*fields, stamp)).alias("line"),
    )


def audit_manifest(lines: DataFrame) -> DataFrame:
    """Record count and SHA-256 of the lines in id order, per hour and batch."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda r: F.concat(r["line"], F.lit("\n")))
    return lines.groupBy(*_HOUR, "batch").agg(
        F.count("*").alias("records"), F.sha2(F.array_join(ordered, ""), 256).alias("sha256")
    )


def export_audit(df: DataFrame, prefix: str, batch_records: int = BATCH_RECORDS) -> DataFrame:
    """Write NDJSON under ``prefix/y=/m=/d=/h=`` and return the manifest."""
    lines = audit_lines(df, batch_records)
    # Rebalancing groups an hour's lines into few files and splits an hour that is too large.
    lines.hint("rebalance", *_HOUR).sortWithinPartitions(*_HOUR, "id").select(*_HOUR, "line").write.mode(
        "overwrite"
    ).partitionBy(*_HOUR).text(prefix)
    return audit_manifest(lines)


def recent_audit(audit: DataFrame, tenant: str | None = None, k: int = LIST_DEFAULT) -> DataFrame:
    """Newest records by id; the limit is kept within 1..500, none or a negative one is 100."""
    k = LIST_DEFAULT if k <= 0 else min(k, LIST_MAX)
    return for_tenant(audit, tenant).orderBy(F.desc("id")).limit(k)
