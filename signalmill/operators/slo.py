"""Multi-window SLO burn rates."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmill.functions.time import bucket_number

# Fixed values: (long window, short window, burn threshold, severity), windows in minutes.
WINDOW_PAIRS = (
    (60, 5, 14.4, "page"),
    (360, 30, 6.0, "page"),
    (1440, 120, 3.0, "ticket"),
    (4320, 360, 1.0, "ticket"),
)
_SEVERITY_RANK = {"page": 2, "ticket": 1}
LONGEST_MINUTES = max(pair[0] for pair in WINDOW_PAIRS)


@dataclass(frozen=True)
class Slo:
    name: str
    target: float
    pairs: tuple[tuple[int, int, float, str], ...] = WINDOW_PAIRS

    def __post_init__(self):
        if not self.name:
            raise ValueError("an SLO needs a name")
        if not 0 < self.target < 1:
            raise ValueError(f"SLO target must be in (0, 1): {self.target}")
        if not self.pairs:
            raise ValueError("an SLO needs window pairs")


def slo_minutes(events: DataFrame, good: Column, slo: str = "slo", time: str = "event_time") -> DataFrame:
    """Good and bad events per SLO and minute number."""
    ok = F.coalesce(good, F.lit(False))
    return events.groupBy(F.col(slo).alias("slo"), bucket_number(F.col(time), "1m").alias("minute")).agg(
        F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad")
    )


def slo_table(spark, slos: list[Slo]) -> DataFrame:
    schema = T.StructType([T.StructField("slo", T.StringType()), T.StructField("target", T.DoubleType())])
    return spark.createDataFrame([(s.name, s.target) for s in slos], schema)


def window_minutes(pairs) -> list[int]:
    return sorted({minutes for long, short, _, _ in pairs for minutes in (long, short)})


def burn_rates(minutes: DataFrame, targets: DataFrame, pairs=WINDOW_PAIRS) -> DataFrame:
    """Burn rate per window ending at each minute that has events: ``burn_<minutes>``.

    ``targets`` has (slo, target). A window's sum is the difference of two running sums, which cost
    one step per row whatever the width; all of them share one sort over minutes, whose number per
    SLO depends on the time range only.
    """
    rows = minutes.join(targets, "slo")
    budget = 1 - F.col("target")
    order = Window.partitionBy("slo").orderBy("minute")

    def running(name: str, lag: int) -> Column:
        return F.coalesce(F.sum(name).over(order.rangeBetween(Window.unboundedPreceding, -lag)), F.lit(0))

    rows = rows.withColumns({f"_{name}_{lag}": running(name, lag) for name in ("good", "bad") for lag in (0, *window_minutes(pairs))})
    burns = []
    for width in window_minutes(pairs):
        good, bad = (F.col(f"_{name}_0") - F.col(f"_{name}_{width}") for name in ("good", "bad"))
        burns.append(burn_of(good, bad, budget).alias(f"burn_{width}"))
    return rows.select("slo", "target", "minute", *burns)


def burn_of(good: Column, bad: Column, budget: Column) -> Column:
    """How many times the budget allows; 0 without traffic."""
    return F.when((good + bad > 0) & (budget > 0), bad / (good + bad) / budget).otherwise(F.lit(0.0))


def slo_decision(burns: DataFrame, pairs=WINDOW_PAIRS, keep: list[str] | None = None) -> DataFrame:
    """Severity per SLO and minute; columns in ``keep`` are carried along.

    Pairs are tried from most severe; the first whose long and short burn both reach the threshold
    decides. Without one the result is ``ok`` with the pair of the largest long burn.
    """
    ranked = sorted(pairs, key=lambda p: -_SEVERITY_RANK.get(p[3], 0))

    def outcome(pair, severity):
        long, short, _, _ = pair
        return F.struct(
            F.lit(severity).alias("severity"),
            F.col(f"burn_{long}").alias("burn_long"),
            F.col(f"burn_{short}").alias("burn_short"),
            F.lit(long * 60).cast("long").alias("long_s"),
            F.lit(short * 60).cast("long").alias("short_s"),
        )

    no_burn = F.struct(
        F.lit("ok").alias("severity"),
        F.lit(0.0).alias("burn_long"),
        F.lit(0.0).alias("burn_short"),
        F.lit(0).cast("long").alias("long_s"),
        F.lit(0).cast("long").alias("short_s"),
    )
    loudest = F.greatest(*[F.col(f"burn_{p[0]}") for p in ranked]) if len(ranked) > 1 else F.col(f"burn_{ranked[0][0]}")
    chain = None
    for pair in ranked:
        long, short, threshold, severity = pair
        trips = (F.col(f"burn_{long}") >= threshold) & (F.col(f"burn_{short}") >= threshold)
        chain = F.when(trips, outcome(pair, severity)) if chain is None else chain.when(trips, outcome(pair, severity))
    for pair in ranked:
        chain = chain.when((loudest > 0) & (F.col(f"burn_{pair[0]}") == loudest), outcome(pair, "ok"))
    decided = burns.withColumn("_d", chain.otherwise(no_burn))
    return decided.select("slo", "minute", "_d.*", (1 - F.col("target")).alias("error_budget"), *(keep or []))


def slo_worst(decisions: DataFrame) -> DataFrame:
    """Most severe decision per SLO, latest first among equals."""
    rank = functools.reduce(
        operator.add,
        [F.when(F.col("severity") == name, F.lit(value)).otherwise(F.lit(0)) for name, value in _SEVERITY_RANK.items()],
    )
    cols = [c for c in decisions.columns if c != "slo"]
    return decisions.groupBy("slo").agg(F.max_by(F.struct(*cols), F.struct(rank, "minute")).alias("_d")).select("slo", "_d.*")
