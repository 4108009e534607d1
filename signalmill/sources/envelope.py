"""Signals from JSON envelope files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.operators.clean import readable, signal_type

_WIRE = (
    "tenant_id string, type string, payload string, attributes map<string,string>, "
    "received_at timestamp, _corrupt_record string"
)


def read_signals(
    spark: SparkSession, path: str, stream: bool = False, received_at: Column | None = None, **options: str
) -> DataFrame:
    """JSON lines as signals; an unreadable line keeps its text in ``_corrupt_record``.

    Type aliases are resolved, the payload is base64, and rows without ``received_at`` get the given
    time (default: now).
    """
    reader = (spark.readStream if stream else spark.read).schema(_WIRE).options(mode="PERMISSIVE", **options)
    rows = reader.json(path)
    payload = F.try_to_binary("payload", F.lit("base64"))
    bad_payload = F.col("payload").isNotNull() & payload.isNull()
    return rows.select(
        "tenant_id",
        F.when(F.col("_corrupt_record").isNull(), signal_type(F.col("type"))).alias("type"),
        payload.alias("payload"),
        "attributes",
        F.coalesce("received_at", F.current_timestamp() if received_at is None else received_at).alias("received_at"),
        F.coalesce("_corrupt_record", F.when(bad_payload, F.col("payload"))).alias("_corrupt_record"),
    )


def accept_tenant(signals: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """Signals sent by an authenticated tenant: an empty tenant is filled in, another one rejected.

    Unreadable lines are rejected as ``decode``.
    """
    signals, unreadable = readable(signals)
    claimed = F.coalesce("tenant_id", F.lit(""))
    kept = signals.where((claimed == "") | (claimed == tenant)).withColumn("tenant_id", F.lit(tenant))
    rejected = signals.where((claimed != "") & (claimed != tenant)).withColumn("reason", F.lit("tenant_mismatch"))
    return kept, rejected.unionByName(unreadable)


def write_signals(signals: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Signals as JSON envelope lines."""
    signals.select(
        "tenant_id", "type", F.base64("payload").alias("payload"), "attributes", "received_at"
    ).write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
