"""Label lookups, matchers and line filters as Column predicates."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Matcher = tuple[str, str, str]  # (label, op, value)

_SAFE_KEY = re.compile(r"[A-Za-z0-9_.\-]*\Z")

# Log selector labels that are columns rather than attributes (case-insensitive).
_STREAM_ALIASES = {
    "service": "service_name",
    "service_name": "service_name",
    "severity": "severity",
    "level": "severity",
    "trace_id": "trace_id",
    "traceid": "trace_id",
    "span_id": "span_id",
    "spanid": "span_id",
}


def label(map_col: str | Column, key: str) -> Column:
    """``map[key]`` with a missing key reading as the empty string.

    A key with characters outside ``[A-Za-z0-9_.-]`` is never a stored label, so it reads as
    missing too.
    """
    if not _SAFE_KEY.match(key):
        return F.lit("")
    col = F.col(map_col) if isinstance(map_col, str) else map_col
    return F.coalesce(F.element_at(col, F.lit(key)), F.lit(""))


def label_alias(key: str) -> str:
    """Output column for a grouped label."""
    return "lbl_" + re.sub(r"[^A-Za-z0-9_]", "_", key)


def _checked_regex(pattern: str) -> str:
    try:
        re.compile(pattern)
    except re.error as exc:
        raise ValueError(f"bad regex {pattern!r}: {exc}") from exc
    return pattern


def compare(col: Column, op: str, value: str) -> Column:
    """One matcher: ``=``, ``!=``, ``=~`` or ``!~`` (regexes are unanchored searches)."""
    if op == "=":
        return col == F.lit(value)
    if op == "!=":
        return col != F.lit(value)
    if op == "=~":
        return col.rlike(_checked_regex(value))
    if op == "!~":
        return ~col.rlike(_checked_regex(value))
    raise ValueError(f"unknown matcher op {op!r}")


def all_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def label_matchers(matchers: Iterable[Matcher], map_col: str = "labels") -> Column:
    return all_of(compare(label(map_col, name), op, value) for name, op, value in matchers)


def stream_matchers(matchers: Iterable[Matcher], map_col: str = "attributes") -> Column:
    """Log stream selector: known labels address columns, the rest the attribute map."""

    def target(name: str) -> Column:
        alias = _STREAM_ALIASES.get(name.lower())
        return F.coalesce(F.col(alias), F.lit("")) if alias else label(map_col, name)

    return all_of(compare(target(name), op, value) for name, op, value in matchers)


def contains_ci(col: Column, text: str) -> Column:
    return F.contains(F.lower(col), F.lower(F.lit(text)))


def line_filters(filters: Iterable[tuple[str, str]], body: str = "body") -> Column:
    """Chained line filters: ``|=``/``!=`` are case-insensitive substrings, ``|~``/``!~`` regexes."""

    def one(op: str, text: str) -> Column:
        col = F.col(body)
        if op == "|=":
            return contains_ci(col, text)
        if op == "!=":
            return ~contains_ci(col, text)
        if op == "|~":
            return col.rlike(_checked_regex(text))
        if op == "!~":
            return ~col.rlike(_checked_regex(text))
        raise ValueError(f"unknown line filter {op!r}")

    return all_of(one(op, text) for op, text in filters)


def any_of_values(col: Column, values: list[str] | str | None) -> Column:
    """Picker filter: no values, or the all-marker among them, keeps everything."""
    if isinstance(values, str):
        values = [values]
    if not values or "__all__" in values:
        return F.lit(True)
    return col.isin(list(values))


def sorted_labels(map_col: str | Column) -> Column:
    """A map as a key-sorted array of entries, usable for grouping and hashing."""
    return F.array_sort(F.map_entries(map_col))


def labels_text(map_col: str | Column) -> Column:
    """A map as sorted ``k=v`` pairs joined by commas; equal maps give equal text."""
    pair = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    return F.array_join(F.transform(sorted_labels(map_col), pair), ",")
