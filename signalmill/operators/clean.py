"""Gates, enrichment and routing of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions import match
from signalmill.functions.time import instant

# Signal type aliases (upper case); anything else reads as METRIC.
TYPE_ALIASES = {
    "METRIC": ("METRIC", "SIGNAL_TYPE_METRIC", "1"),
    "LOG": ("LOG", "SIGNAL_TYPE_LOG", "2"),
    "TRACE": ("TRACE", "SIGNAL_TYPE_TRACE", "3"),
    "PROFILE": ("PROFILE", "SIGNAL_TYPE_PROFILE", "4"),
}


def signal_type(raw: Column) -> Column:
    upper = F.upper(raw)
    out = F.lit("METRIC")
    for name, aliases in TYPE_ALIASES.items():
        out = F.when(upper.isin(list(aliases)), name).otherwise(out)
    return out


def split(df: DataFrame, good: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and the others with a reason."""
    passes = F.coalesce(good, F.lit(False))
    return df.where(passes), df.where(~passes).withColumn("reason", F.lit(reason))


def readable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that could be read, and those that still carry the text of an unreadable line (reason ``decode``)."""
    if "_corrupt_record" not in df.columns:
        return df, df.limit(0).withColumn("reason", F.lit("decode"))
    return split(df, F.col("_corrupt_record").isNull(), "decode")


def decode_gate(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """A non-empty payload must be JSON: for metrics, or for every type when ``strict``.

    Unreadable lines do not pass either.
    """
    return split(df, _decodes(df, strict), "decode")


def _decodes(df: DataFrame, strict: bool) -> Column:
    text = F.decode(F.col("payload"), "UTF-8")
    empty = F.col("payload").isNull() | (F.octet_length("payload") == 0)
    good = empty | F.try_parse_json(text).isNotNull()
    if not strict:
        good = good | (F.col("type") != "METRIC")
    if "_corrupt_record" in df.columns:
        good = good & F.col("_corrupt_record").isNull()
    return good


def _has_tenant() -> Column:
    return F.coalesce("tenant_id", F.lit("")) != ""


def tenant_gate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(df, _has_tenant(), "no_tenant")


def passes_gates(df: DataFrame, strict: bool = False) -> Column:
    """Whether a row passes both gates."""
    return F.coalesce(_decodes(df, strict), F.lit(False)) & _has_tenant()


def with_attributes(attributes: Column, **added: Column) -> Column:
    """A string map with entries set, replacing earlier ones of the same key."""
    names = [name.replace("__", ".") for name in added]
    kept = F.map_filter(
        F.coalesce(attributes, F.create_map().cast("map<string,string>")), lambda key, _: ~key.isin(names)
    )
    pairs = [c for name, value in zip(names, added.values(), strict=True) for c in (F.lit(name), value)]
    return F.map_concat(kept, F.create_map(*pairs))


def enrich_stamp(df: DataFrame, version: str, at=None) -> DataFrame:
    """Stamps the platform version and the ingest time into the attributes."""
    stamp = F.date_format(F.current_timestamp() if at is None else instant(at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return df.withColumn(
        "attributes", with_attributes(F.col("attributes"), ingest__version=F.lit(version), ingest__at=stamp)
    )


def drop_accounting(kept: DataFrame, *rejects: DataFrame) -> DataFrame:
    """Counts per tenant, type and outcome (``received`` for all rows, else the drop reason)."""
    rows = kept.select("tenant_id", "type", F.lit(None).cast("string").alias("reason"))
    for reject in rejects:
        rows = rows.unionByName(reject.select("tenant_id", "type", "reason"))
    counted = rows.groupBy("tenant_id", "type", "reason").agg(F.count("*").alias("n"))
    outcomes = F.filter(F.array(F.lit("received"), F.col("reason")), lambda r: r.isNotNull())
    return (
        counted.withColumn("reason", F.explode(outcomes))
        .groupBy(F.coalesce("tenant_id", F.lit("")).alias("tenant_id"), "type", "reason")
        .agg(F.sum("n").alias("n"))
    )


def metric_payload(df: DataFrame) -> DataFrame:
    """Adds metric_name and value.

    Name: payload, else the ``metric_name`` attribute, else ``unknown``. Value: payload, else the
    ``value`` attribute, else ``sum``, else 0.
    """
    doc = F.from_json(F.decode(F.col("payload"), "UTF-8"), "name string, value double")

    def attribute(key: str) -> Column:
        return F.nullif(match.label("attributes", key), F.lit(""))

    name = F.coalesce(F.nullif(doc["name"], F.lit("")), attribute("metric_name"), F.lit("unknown"))
    value = F.coalesce(
        doc["value"], attribute("value").try_cast("double"), attribute("sum").try_cast("double"), F.lit(0.0)
    )
    return df.withColumn("metric_name", name).withColumn("value", value)


def _attribute(*keys: str) -> Column:
    found = [F.nullif(match.label("attributes", key), F.lit("")) for key in keys]
    return F.coalesce(*found, F.lit(""))


def route_signals(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signals as rows of the metrics, logs and traces tables. Profiles have no table."""
    metrics = metric_payload(df.where("type = 'METRIC'")).select(
        "tenant_id", "metric_name", F.col("received_at").alias("timestamp"), "value",
        F.col("attributes").alias("labels"), "received_at",
    )
    logs = df.where("type = 'LOG'").select(
        "tenant_id",
        _attribute("service_name", "service.name").alias("service_name"),
        _attribute("severity").alias("severity"),
        F.decode(F.col("payload"), "UTF-8").alias("body"),
        "attributes",
        F.col("received_at").alias("timestamp"),
        _attribute("trace_id").alias("trace_id"),
        _attribute("span_id").alias("span_id"),
    )
    duration = F.coalesce(
        _attribute("duration_ns").try_cast("long"),
        F.round(_attribute("duration_ms").try_cast("double") * 1_000_000).cast("long"),
        F.lit(0).cast("long"),
    )
    start = F.coalesce(_attribute("start_time").try_cast("timestamp"), F.col("received_at"))
    status = F.coalesce(
        F.nullif(_attribute("status_code"), F.lit("")), F.when(_attribute("severity") == "ERROR", "ERROR"), F.lit("")
    )
    traces = (
        df.where("type = 'TRACE'")
        .withColumn("_start", start)
        .withColumn("duration_ns", duration)
        .select(
            "tenant_id",
            _attribute("trace_id").alias("trace_id"),
            _attribute("span_id").alias("span_id"),
            _attribute("parent_span_id").alias("parent_span_id"),
            _attribute("operation_name", "span.name").alias("operation_name"),
            _attribute("service_name", "service.name").alias("service_name"),
            F.col("_start").alias("start_time"),
            F.timestamp_micros(F.unix_micros("_start") + (F.col("duration_ns") / 1000).cast("long")).alias("end_time"),
            "duration_ns",
            "attributes",
            status.alias("status_code"),
        )
    )
    return metrics, logs, traces
