"""Building blocks that stay balanced when one key holds a large share of the rows.

Three ideas recur:

* histogram first: counts per (key, small time bucket) are combined map-side, so a hot key costs
  its number of buckets, not its number of rows; windows run over the histogram;
* select inside one bucket: only the bucket that holds a wanted rank is read at row level;
* chunks: where a fold really needs every row in order, a key is cut by time (and id) into chunks
  of bounded size, and a scan over one small state row per chunk links them.
"""

from __future__ import annotations

import functools
import operator
from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.time import Duration, bucket_number, micros
from signalmill.session import reliable

# Rows of the largest table to broadcast, and of the largest bucket to window in one task.
BROADCAST_ROWS = 200_000
LEAF_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a small table and mark it for broadcast only if its counted size allows it.

    Beyond ``max_rows`` the table is returned unmarked and the join falls back to a shuffle join,
    where adaptive execution splits skewed partitions.
    """
    fixed = reliable(df)
    return F.broadcast(fixed) if fixed.count() <= max_rows else fixed


def fitting_step(
    df: DataFrame, keys: list[str], time: str, step: Duration, leaf_rows: int = LEAF_ROWS
) -> int:
    """``step`` in microseconds, cut by 1000 until no (key, bucket) holds more than ``leaf_rows`` rows."""
    width = micros(step)
    while width > 1:
        counts = df.groupBy(*keys, bucket_number(F.col(time), timedelta(microseconds=width)).alias("_b")).count()
        largest = counts.agg(F.max("count")).head()[0]
        if largest is None or largest <= leaf_rows:
            break
        width = max(1, width // 1000)
    return width


def id_slot(row_id: str, width: int) -> Column:
    """Rows of equal time by id: a slot of ``width`` consecutive ids, or one slot where ``width`` is 0."""
    return F.floor(F.col(row_id) / F.lit(width)).cast("long") if width else F.lit(0).cast("long")


def fitting_ids(
    df: DataFrame, keys: list[str], time: str, row_id: str, width_us: int, leaf_rows: int = LEAF_ROWS
) -> int:
    """Width of id slots that split what shares one microsecond, 0 where times alone are fine enough.

    Only whole-number ids can be split.
    """
    if width_us > 1 or df.schema[row_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return 0
    at = [*keys, F.unix_micros(time).alias("_b")]
    crowded = df.groupBy(*at).agg(F.count("*").alias("_n"), F.min(row_id).alias("_low"), F.max(row_id).alias("_high"))
    crowded = checked_broadcast(crowded.where(F.col("_n") > leaf_rows))
    spread = crowded.agg(F.max(F.col("_high") - F.col("_low"))).head()[0]
    if spread is None:
        return 0
    same = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys] + [F.unix_micros(time) == F.col("_c_b")]
    names = crowded.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_b").alias("_c_b"))
    inside = df.join(names, functools.reduce(operator.and_, same), "left_semi").select(*at, row_id)
    width = max(1, int(spread) // 64)
    while width > 1:
        largest = inside.groupBy(*keys, "_b", id_slot(row_id, width).alias("_i")).count().agg(F.max("count")).head()[0]
        if largest <= leaf_rows:
            break
        width = max(1, width // 64)
    return width


def nth_flagged(
    df: DataFrame,
    group: list[str],
    time: str,
    row_id: str,
    flag: Column,
    wanted: DataFrame,
    step: Duration,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Per group, the ``nth`` row (by time, id) whose flag is true.

    ``wanted`` has the group columns and ``nth`` (1-based); pass it through
    :func:`checked_broadcast` where it is small against the rows. Adds ``position``, the number of
    rows of the group up to and including the found one. Groups with fewer flagged rows give no row.

    Rows are counted per time bucket and only the bucket with the wanted row is looked into, first
    by smaller buckets while it holds more than ``leaf_rows`` rows, and by id slots within one microsecond.
    """
    rows = df.select(*group, time, row_id, F.coalesce(flag, F.lit(False)).cast("long").alias("_flag"))
    zero = F.lit(0).cast("long")
    hit = wanted.select(*group, "nth", zero.alias("_flags_before"), zero.alias("_rows_before"))
    inside, width = list(group), micros(step)
    while True:
        rows = rows.withColumn(f"_sub{width}", bucket_number(F.col(time), timedelta(microseconds=width)))
        hit = checked_broadcast(_bucket_with_nth(rows, inside, f"_sub{width}", hit))
        inside.append(f"_sub{width}")
        largest = hit.agg(F.max("_rows")).head()[0]
        if largest is None or largest <= leaf_rows:
            break
        if width == 1:
            slot = fitting_ids(rows, group, time, row_id, 1, leaf_rows)
            if slot:
                rows = rows.withColumn("_subid", id_slot(row_id, slot))
                hit = checked_broadcast(_bucket_with_nth(rows, inside, "_subid", hit))
                inside.append("_subid")
            break
        width = max(1, width // 1000)
    running = Window.partitionBy(*inside).orderBy(time, row_id).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(hit, inside)
        .withColumn("_nth_here", F.col("_flags_before") + F.sum("_flag").over(running))
        .withColumn("position", F.col("_rows_before") + F.count("*").over(running))
        .where((F.col("_flag") == 1) & (F.col("_nth_here") == F.col("nth")))
        .select(*group, time, row_id, "nth", "position")
    )


def _bucket_with_nth(rows: DataFrame, inside: list[str], sub: str, hit: DataFrame) -> DataFrame:
    """The bucket of each group that holds its wanted row, with the counts before it."""
    before = Window.partitionBy(*inside).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    earlier = ["nth", "_flags_before", "_rows_before"]
    hist = rows.join(hit.select(*inside, *earlier), inside).groupBy(*inside, sub, *earlier).agg(
        F.sum("_flag").alias("_flags"), F.count("*").alias("_rows")
    )
    placed = hist.withColumns(
        {
            "_flags_before": F.col("_flags_before") + F.coalesce(F.sum("_flags").over(before), F.lit(0)),
            "_rows_before": F.col("_rows_before") + F.coalesce(F.sum("_rows").over(before), F.lit(0)),
        }
    )
    found = (F.col("_flags_before") < F.col("nth")) & (F.col("nth") <= F.col("_flags_before") + F.col("_flags"))
    return placed.where(found).select(*inside, sub, *earlier, "_rows")


def previous_value(
    df: DataFrame, keys: list[str], time: str, row_id: str, col: str, out: str, step: Duration = "1m",
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``lag(col)`` per key in (time, id) order, windowed per (key, time bucket).

    Across buckets the last value comes from a per-bucket aggregate, so a hot key is spread over
    its buckets; the step shrinks while one of them is too large, and rows of one microsecond are
    split by id.
    """
    width = timedelta(microseconds=fitting_step(df, keys, time, step, leaf_rows))
    ids = fitting_ids(df, keys, time, row_id, micros(width), leaf_rows)
    bucketed = df.withColumns({"_b": bucket_number(F.col(time), width), "_i": id_slot(row_id, ids)})
    order = F.struct(time, row_id)
    last = (
        bucketed.groupBy(*keys, "_b", "_i")
        .agg(F.max_by(F.struct(F.col(col).alias("v")), order).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b", "_i")))
        .select(*keys, "_b", "_i", "_carry")
    )
    inside = Window.partitionBy(*keys, "_b", "_i").orderBy(time, row_id)
    return (
        bucketed.join(last, [*keys, "_b", "_i"])
        .withColumn(
            out,
            F.when(F.row_number().over(inside) == 1, F.col("_carry.v")).otherwise(F.lag(col).over(inside)),
        )
        .drop("_b", "_i", "_carry")
    )


def _slot(value: Column, low: Column, high: Column, slots: int) -> Column:
    """Monotone slot of ``value`` among ``slots`` equal parts of [low, high]; halves avoid overflow.

    Infinities have slots of their own at the ends, so what is left between them is finite next time.
    """
    most = F.lit(float(np.finfo(np.float64).max))
    low, high = F.greatest(low, -most), F.least(high, most)
    part = F.floor((value / 2 - low / 2) / (high / 2 - low / 2) * F.lit(slots))
    inside = F.greatest(F.lit(0), F.least(F.lit(slots - 1), part))
    ends = F.when(value > most, slots).when(value < -most, -1)
    return ends.when(high > low, inside).otherwise(F.lit(0)).cast("long")


def exact_quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    probabilities: dict[str, float],
    slots: int = 1024,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """Exact interpolated quantiles per group without sorting or buffering a whole group.

    Each round counts rows per (group, cell, slot) with map-side combining and keeps only the slots
    that hold a wanted rank, until every kept cell is small or holds a single value. The kept cells
    are then read as (value, count) pairs. Small inputs need no refining round.

    ``probabilities`` maps output columns to probabilities in [0, 1].
    """
    for p in probabilities.values():
        if not 0 <= p <= 1:
            raise ValueError(f"quantile probability out of [0, 1]: {p}")
    keyed = by or ["_all"]
    rows = df.select(
        *(by or [F.lit(1).alias("_all")]), F.col(value).cast("double").alias("_v")
    ).where(F.col("_v").isNotNull() & ~F.isnan("_v"))

    ranks = rows.groupBy(*keyed).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    rank_of = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in probabilities.items()}
    wanted = F.array_distinct(
        F.array(*[side(rank).cast("long") for rank in rank_of.values() for side in (F.floor, F.ceil)])
    )
    ranks = reliable(ranks.withColumn("_want", wanted))
    # A cell is a value range of one group, named by the rank of its first row.
    cells = checked_broadcast(ranks.withColumn("_base", F.lit(0).cast("long")))
    while True:
        widest = cells.where(F.col("_high") > F.col("_low")).agg(F.max("_n")).head()[0]
        if widest is None or widest <= leaf_rows:
            break
        cells = checked_broadcast(_refine(rows, keyed, cells, slots))

    counted = _inside(rows, keyed, cells).groupBy(*keyed, "_base", "_want", "_v").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keyed, "_base").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_end", F.col("_base") + F.sum("_c").over(upto))
    mine = F.filter("_want", lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end")))
    found = (
        placed.select(*keyed, "_v", F.explode(mine).alias("_r"))
        .groupBy(*keyed)
        .agg(F.map_from_entries(F.collect_set(F.struct("_r", "_v"))).alias("_at"))
    )
    out = []
    for name, rank in rank_of.items():
        low = F.element_at("_at", F.floor(rank).cast("long"))
        high = F.element_at("_at", F.ceil(rank).cast("long"))
        part = rank - F.floor(rank)
        # Equal neighbours may be infinite, as may a greater one that takes no part.
        out.append(F.when((low == high) | (part == 0) | (low == float("-inf")), low).otherwise(low + (high - low) * part).alias(name))
    return ranks.join(found, keyed).select(*by, *out)


def _inside(rows: DataFrame, keyed: list[str], cells: DataFrame) -> DataFrame:
    """Rows of each kept cell; cells of a group do not overlap, so a row meets at most one."""
    return rows.join(cells, keyed).where(F.col("_v").between(F.col("_low"), F.col("_high")))


def _refine(rows: DataFrame, keyed: list[str], cells: DataFrame, slots: int) -> DataFrame:
    """Split every kept cell into slots and keep the slots that hold a wanted rank."""
    hist = (
        _inside(rows, keyed, cells)
        .withColumn("_slot", _slot(F.col("_v"), F.col("_low"), F.col("_high"), slots))
        .groupBy(*keyed, "_base", "_want", "_slot")
        .agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    )
    upto = Window.partitionBy(*keyed, "_base").orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.withColumn("_end", F.col("_base") + F.sum("_n").over(upto))
        .withColumn("_base", F.col("_end") - F.col("_n"))
        .withColumn("_want", F.filter("_want", lambda r: (r >= F.col("_base")) & (r < F.col("_end"))))
        .where(F.size("_want") > 0)
        .select(*keyed, "_n", "_low", "_high", "_want", "_base")
    )
