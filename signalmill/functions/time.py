"""Durations and epoch-aligned time buckets."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Microseconds per duration unit.
_UNIT_US = {
    "ms": 1_000,
    "s": 1_000_000,
    "m": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
    "w": 604_800_000_000,
    "y": 31_536_000_000_000,
}

Duration = str | int | float | timedelta


def micros(duration: Duration) -> int:
    """Microseconds in ``"5m"``, ``"1h30m"``, a timedelta, or a number of seconds."""
    if isinstance(duration, timedelta):
        total = round(duration / timedelta(microseconds=1))
    elif isinstance(duration, (int, float)):
        total = round(duration * 1_000_000)
    else:
        parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h|d|w|y)", duration)
        if not parts or "".join(n + u for n, u in parts) != duration.strip():
            raise ValueError(f"bad duration {duration!r}")
        total = round(sum(float(n) * _UNIT_US[u] for n, u in parts))
    if total <= 0:
        raise ValueError(f"duration must be positive: {duration!r}")
    return total


def seconds(duration: Duration) -> float:
    return micros(duration) / 1_000_000


def duration_text(duration: Duration) -> str:
    """``24h0m0s``, ``5m0s`` or ``1.5s``: hours and minutes from the largest that is not zero on."""
    hours, rest = divmod(micros(duration), 3_600_000_000)
    minutes, rest = divmod(rest, 60_000_000)
    text = f"{rest / 1_000_000:.6f}".rstrip("0").rstrip(".") + "s"
    return f"{hours}h{minutes}m{text}" if hours else f"{minutes}m{text}" if minutes else text


def instant(value: str | datetime | Column) -> Column:
    """A timestamp literal (UTC session time zone) from a string, datetime or column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp")


def bucket_number(ts: Column, step: Duration) -> Column:
    """Index of the epoch-aligned bucket holding ``ts``; exact in integers."""
    us = F.unix_micros(ts)
    width = F.lit(micros(step))
    return ((us - F.pmod(us, width)) / width).cast("long")


def bucket_start(ts: Column, step: Duration) -> Column:
    """Start of the epoch-aligned bucket holding ``ts``."""
    us = F.unix_micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(micros(step))))


def closed_range(ts: Column, t0, t1) -> Column:
    """Inclusive at both ends, as range queries are; ``None`` leaves an end open."""
    return _range(ts, t0, t1, closed=True)


def half_open_range(ts: Column, t0, t1) -> Column:
    """``t0 <= ts < t1``, as dashboard panels are; ``None`` leaves an end open."""
    return _range(ts, t0, t1, closed=False)


def _range(ts: Column, t0, t1, closed: bool) -> Column:
    condition = F.lit(True)
    if t0 is not None:
        condition = condition & (ts >= instant(t0))
    if t1 is not None:
        condition = condition & ((ts <= instant(t1)) if closed else (ts < instant(t1)))
    return condition
