"""Span trees, the service graph and span panels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions import match
from signalmill.functions.time import Duration, bucket_start, half_open_range, seconds
from signalmill.operators.select import for_tenant
from signalmill.operators.series import sketched
from signalmill.operators.skew import checked_broadcast, exact_quantiles
from signalmill.session import reliable

_TRACE = ["tenant_id", "trace_id"]

# Fixed value: the narrowest bar of a waterfall, in percent of the trace.
MIN_WIDTH_PCT = 0.4

_WATERFALL = (
    "tenant_id string, trace_id string, ordinal long, span_id string, depth long, "
    "left_pct double, width_pct double, duration_ms double, is_error boolean"
)

_WATERFALL_COLUMNS = [field.split()[0] for field in _WATERFALL.split(", ")]


def service_map(spans: DataFrame, per_trace: bool = False) -> DataFrame:
    """Calls between different services: one edge per (parent service, child service).

    Children are counted per (parent span, service) before the join, so a parent with very many
    children contributes a handful of rows.
    """
    children = (
        spans.where(F.coalesce(F.col("parent_span_id"), F.lit("")) != "")
        .groupBy(*_TRACE, "parent_span_id", F.coalesce("service_name", F.lit("")).alias("dst_service"))
        .agg(F.count("*").alias("_calls"))
    )
    # A repeated span id resolves to its latest span.
    parents = (
        spans.groupBy(*_TRACE, "span_id")
        .agg(F.max_by("service_name", F.struct("start_time", "service_name")).alias("src_service"))
        .where(F.coalesce(F.col("src_service"), F.lit("")) != "")
        .withColumnRenamed("span_id", "parent_span_id")
    )
    edges = children.join(parents, [*_TRACE, "parent_span_id"]).where("src_service <> dst_service")
    keys = [*(_TRACE if per_trace else ["tenant_id"]), "src_service", "dst_service"]
    return edges.groupBy(*keys).agg(F.sum("_calls").alias("calls"))


def service_nodes(spans: DataFrame) -> DataFrame:
    """Distinct services; a span without one shows as ``?``."""
    name = F.coalesce(F.nullif("service_name", F.lit("")), F.lit("?")).alias("service_name")
    return spans.select("tenant_id", name).distinct()


def span_rate(df, tenant, services=None, t0=None, t1=None, step: Duration = "1m") -> DataFrame:
    rows = for_tenant(df, tenant).where(
        match.any_of_values(F.col("service_name"), services) & half_open_range(F.col("start_time"), t0, t1)
    )
    return rows.groupBy(bucket_start(F.col("start_time"), step).alias("t"), "service_name").agg(
        (F.count("*") / F.lit(seconds(step))).alias("rps")
    )


def latency_percentiles(
    df, tenant, services=None, t0=None, t1=None, step: Duration = "1m", ps=(0.5, 0.95, 0.99), exact: bool = True
) -> DataFrame:
    """Duration percentiles in milliseconds per bucket; exact, or one pass of bounded sketches."""
    rows = (
        for_tenant(df, tenant)
        .where(
            match.any_of_values(F.col("service_name"), services) & half_open_range(F.col("start_time"), t0, t1)
        )
        .select(bucket_start(F.col("start_time"), step).alias("t"), (F.col("duration_ns") / 1e6).alias("ms"))
    )
    names = {f"p{p * 100:g}".replace(".", "_"): p for p in ps}
    if exact:
        return exact_quantiles(rows, ["t"], "ms", names)
    found = sketched(rows.withColumnRenamed("ms", "value"), ["t"])
    return found.select("t", *[F.kll_sketch_get_quantile_double("_sketch", F.lit(float(p))).alias(n) for n, p in names.items()])


def _is_error(status: Column) -> Column:
    return ~F.coalesce(status, F.lit("")).isin("OK", "")


def error_ratio(df, tenant, t0=None, t1=None) -> DataFrame:
    """Share of spans whose status is neither OK nor unset; null without spans."""
    rows = for_tenant(df, tenant).where(half_open_range(F.col("start_time"), t0, t1))
    return rows.agg(F.try_divide(F.count_if(_is_error(F.col("status_code"))), F.count("*")).alias("error_rate"))


def waterfall(spans: DataFrame, large_trace: int = 50_000) -> DataFrame:
    """Depth-first layout of every trace: order, depth, bar offset and width in percent.

    Children follow their parent by start time (then span id); a span whose parent is absent is a
    root. Spans on a cycle have no root and do not appear; a repeated span id keeps its first span.

    Spans without a trace id form one trace of their tenant. Traces up to ``large_trace`` spans are
    laid out whole, many of them per Arrow batch. Larger ones never come together in one task: they
    are numbered from subtree sizes by joins, twice the logarithm of their depth many, and their
    layout is the same.
    """
    rows = spans.select(
        *_TRACE,
        "span_id",
        F.coalesce("parent_span_id", F.lit("")).alias("parent"),
        F.unix_micros("start_time").alias("start_us"),
        F.unix_micros("end_time").alias("end_us"),
        F.coalesce("duration_ns", F.lit(0)).cast("long").alias("duration_ns"),
        _is_error(F.col("status_code")).alias("is_error"),
    )
    sizes = rows.groupBy(*_TRACE).agg(F.count("*").alias("_n")).where(F.col("_n") > large_trace).select(*_TRACE)
    big = reliable(sizes)
    if big.isEmpty():
        return _waterfall_whole(rows)
    big = checked_broadcast(big.select(F.struct(*_TRACE).alias("_trace")))
    # As a struct, a trace without an id equals itself.
    rows = rows.withColumn("_trace", F.struct(*_TRACE))
    small = _waterfall_whole(rows.join(big, "_trace", "left_anti").drop("_trace"))
    return small.unionByName(_waterfall_by_joins(_first_spans(rows.join(big, "_trace", "left_semi").drop("_trace"))))


def _first_spans(rows: DataFrame) -> DataFrame:
    """The first span of every span id."""
    rest = [c for c in rows.columns if c not in (*_TRACE, "span_id")]
    first = F.min_by(F.struct(*rest), F.struct("start_us", "end_us")).alias("s")
    return rows.groupBy(*_TRACE, "span_id").agg(first).select(*_TRACE, "span_id", "s.*")


def _waterfall_whole(rows: DataFrame) -> DataFrame:
    ordered = rows.repartition(*_TRACE).sortWithinPartitions(*_TRACE, "start_us", "span_id", "end_us")
    return ordered.mapInPandas(_layouts, _WATERFALL)


def _layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lay out every complete trace of a batch; the last one waits for the next batch."""
    waiting = None
    for batch in batches:
        rows = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
        if rows.empty:
            continue
        keys = list(zip(rows["tenant_id"], rows["trace_id"], strict=True))
        start = len(keys)
        while start > 0 and keys[start - 1] == keys[-1]:
            start -= 1
        waiting = rows.iloc[start:].reset_index(drop=True)
        if start:
            yield _layout(rows.iloc[:start], keys[:start])
    if waiting is not None:
        yield _layout(waiting, list(zip(waiting["tenant_id"], waiting["trace_id"], strict=True)))


def _layout(rows: pd.DataFrame, keys: list[tuple]) -> pd.DataFrame:
    """Layout of whole traces, sorted by trace and start."""
    rows = rows.reset_index(drop=True)
    span_ids, parents = rows["span_id"].tolist(), rows["parent"].tolist()
    order: list[int] = []
    depths: list[int] = []
    ordinals: list[int] = []
    begin = 0
    while begin < len(keys):
        end = begin
        row_of: dict[str, int] = {}
        while end < len(keys) and keys[end] == keys[begin]:
            row_of.setdefault(span_ids[end], end)
            end += 1
        children: dict[int, list[int]] = {}
        roots = []
        for i in row_of.values():
            above = row_of.get(parents[i])
            (roots if above is None else children.setdefault(above, [])).append(i)
        todo = [(i, 0) for i in reversed(roots)]
        ordinal = 0
        while todo:
            i, depth = todo.pop()
            order.append(i)
            depths.append(depth)
            ordinals.append(ordinal)
            ordinal += 1
            todo.extend((c, depth + 1) for c in reversed(children.get(i, ())))
        begin = end
    # A repeated span id keeps its first span, also in the extent of the trace.
    kept = rows.drop_duplicates([*_TRACE, "span_id"])
    trace = kept.groupby(_TRACE, sort=False, dropna=False)
    first, last = trace["start_us"].transform("min"), trace["end_us"].transform("max")
    width = (last - first).clip(lower=1)
    left = (kept["start_us"] - first) / width * 100
    bar = ((kept["end_us"] - kept["start_us"]) / width * 100).clip(lower=MIN_WIDTH_PCT)
    out = kept.assign(left_pct=left, width_pct=bar, duration_ms=kept["duration_ns"] / 1e6).loc[order]
    return out.assign(ordinal=ordinals, depth=depths)[_WATERFALL_COLUMNS]


def _waterfall_by_joins(rows: DataFrame) -> DataFrame:
    """Layout of very large traces by pointer doubling.

    A round lets every span look twice as far up as the round before, so ``log2(depth)`` rounds give
    depths and subtree sizes. A span's ordinal is the sum, over itself and its ancestors, of the spans
    ahead of it among its siblings' subtrees, plus one for each level; the pointers of the first
    rounds, taken again, sum it.
    """
    spans = rows.withColumn("_id", F.struct(*_TRACE, "span_id")).withColumn("_up", F.struct(*_TRACE, "parent"))
    known = spans.select(F.col("_id").alias("_up"), F.col("_id").alias("_anc"))
    spans = reliable(spans.join(known, "_up", "left").drop("_up"))

    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    state = spans.select("_id", "_anc", F.when(F.col("_anc").isNull(), none).otherwise(one).alias("depth"), one.alias("_size"))
    pointers: list[DataFrame] = []
    unfinished = None
    while True:
        active = state.where("_anc IS NOT NULL")
        left = active.count()
        # Depths have no gaps: a round that finishes no span leaves only those on or below a cycle.
        if left in (0, unfinished):
            break
        unfinished = left
        pointers.append(active.select("_id", "_anc"))
        state = reliable(_twice_as_far(state))

    finished = state.where("_anc IS NULL").select("_id", "depth", "_size")
    placed = reliable(_offsets_among_siblings(spans.join(finished, "_id")))
    ordinal = placed.select("_id", (F.col("_ahead") + F.when(F.col("_anc").isNull(), none).otherwise(one)).alias("ordinal"))
    for pointer in pointers:
        above = ordinal.select(F.col("_id").alias("_anc"), F.col("ordinal").alias("_above"))
        added = pointer.join(above, "_anc").select("_id", "_above")
        ordinal = reliable(
            ordinal.join(added, "_id", "left").select("_id", (F.col("ordinal") + F.coalesce("_above", none)).alias("ordinal"))
        )

    extent = checked_broadcast(
        rows.groupBy(F.struct(*_TRACE).alias("_trace")).agg(F.min("start_us").alias("_first"), F.max("end_us").alias("_last"))
    )
    width = F.greatest(F.lit(1), F.col("_last") - F.col("_first"))
    return placed.join(ordinal, "_id").withColumn("_trace", F.struct(*_TRACE)).join(extent, "_trace").select(
        *_TRACE,
        "ordinal",
        "span_id",
        "depth",
        ((F.col("start_us") - F.col("_first")) / width * 100).alias("left_pct"),
        F.greatest(F.lit(MIN_WIDTH_PCT), (F.col("end_us") - F.col("start_us")) / width * 100).alias("width_pct"),
        (F.col("duration_ns") / 1e6).alias("duration_ms"),
        "is_error",
    )


def _twice_as_far(state: DataFrame) -> DataFrame:
    """Sizes counted and ancestors found twice as far away; a span without an ancestor there takes no part in the join."""
    active, done = state.where("_anc IS NOT NULL"), state.where("_anc IS NULL")
    gains = active.groupBy(F.col("_anc").alias("_id")).agg(F.sum("_size").alias("_gain"))
    above = state.select(F.col("_id").alias("_anc"), F.col("_anc").alias("_next"), F.col("depth").alias("_further"))
    moved = active.join(above, "_anc").select("_id", F.col("_next").alias("_anc"), (F.col("depth") + F.col("_further")).alias("depth"), "_size")
    both = moved.unionByName(done).join(gains, "_id", "left")
    return both.withColumn("_size", F.col("_size") + F.coalesce("_gain", F.lit(0))).drop("_gain")


def _offsets_among_siblings(spans: DataFrame) -> DataFrame:
    """Spans ahead of each span among its siblings' subtrees, by (start, span id); roots are siblings.

    Siblings are summed per millisecond of start first; only one millisecond's siblings are ever
    windowed together.
    """
    siblings = F.struct(*_TRACE, F.col("_anc.span_id").alias("span_id"), F.col("_anc").isNull().alias("root"))
    spans = spans.withColumns({"_group": siblings, "_ms": F.coalesce(F.floor(F.col("start_us") / 1000), F.lit(-(2**62)))})
    before = Window.partitionBy("_group").orderBy("_ms").rowsBetween(Window.unboundedPreceding, -1)
    per_ms = (
        spans.groupBy("_group", "_ms")
        .agg(F.sum("_size").alias("_sum"))
        .select("_group", "_ms", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_earlier"))
    )
    inside = Window.partitionBy("_group", "_ms").orderBy("start_us", "span_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        spans.join(per_ms, ["_group", "_ms"])
        .withColumn("_ahead", F.col("_earlier") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        .drop("_group", "_ms", "_earlier")
    )
