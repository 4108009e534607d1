"""Imports every query module, so that the registry is complete."""

from signalmill.plans import (  # noqa: F401
    alert_queries,
    ingest_queries,
    rule_queries,
    select_queries,
    series_queries,
    stream_queries,
    trace_queries,
)
from signalmill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
