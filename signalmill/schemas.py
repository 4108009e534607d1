"""Schemas of the stored tables and the signal envelope."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING_MAP = T.MapType(T.StringType(), T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SIGNAL = _struct(
    tenant_id=T.StringType(),
    type=T.StringType(),
    payload=T.BinaryType(),
    attributes=_STRING_MAP,
    received_at=T.TimestampType(),
)

METRICS = _struct(
    tenant_id=T.StringType(),
    metric_name=T.StringType(),
    timestamp=T.TimestampType(),
    value=T.DoubleType(),
    labels=_STRING_MAP,
    received_at=T.TimestampType(),
)

LOGS = _struct(
    tenant_id=T.StringType(),
    service_name=T.StringType(),
    severity=T.StringType(),
    body=T.StringType(),
    attributes=_STRING_MAP,
    timestamp=T.TimestampType(),
    trace_id=T.StringType(),
    span_id=T.StringType(),
)

TRACES = _struct(
    tenant_id=T.StringType(),
    trace_id=T.StringType(),
    span_id=T.StringType(),
    parent_span_id=T.StringType(),
    operation_name=T.StringType(),
    service_name=T.StringType(),
    start_time=T.TimestampType(),
    end_time=T.TimestampType(),
    duration_ns=T.LongType(),
    attributes=_STRING_MAP,
    status_code=T.StringType(),
)

ALERTS = _struct(
    fingerprint=T.StringType(),
    tenant_id=T.StringType(),
    rule_id=T.StringType(),
    severity=T.StringType(),
    title=T.StringType(),
    description=T.StringType(),
    labels=_STRING_MAP,
    annotations=_STRING_MAP,
    state=T.StringType(),
    starts_at=T.TimestampType(),
    last_seen_at=T.TimestampType(),
    resolved_at=T.TimestampType(),
    notified_at=T.TimestampType(),
    notify_count=T.LongType(),
)

SILENCES = _struct(
    id=T.StringType(),
    tenant_id=T.StringType(),
    matcher=_STRING_MAP,
    reason=T.StringType(),
    created_by=T.StringType(),
    created_at=T.TimestampType(),
    expires_at=T.TimestampType(),
)

AUDIT = _struct(
    id=T.LongType(),
    tenant_id=T.StringType(),
    actor=T.StringType(),
    action=T.StringType(),
    details=T.StringType(),
    source_ip=T.StringType(),
    occurred_at=T.TimestampType(),
)

# The queryable columns per source and each source's time column.
SOURCES = {"metrics": METRICS, "logs": LOGS, "traces": TRACES}
TIME_COLUMN = {"metrics": "timestamp", "logs": "timestamp", "traces": "start_time"}


def columns_of(source: str) -> list[str]:
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}; expected one of {sorted(SOURCES)}")
    return SOURCES[source].names
