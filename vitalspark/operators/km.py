"""Event tables and weighted Kaplan-Meier curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cohort import CohortSpec
from ..functions.stats import confidence
from .scan import running, sized, suffix_sum


def time_counts(df: DataFrame, spec: CohortSpec, by: Sequence[str] = ()) -> DataFrame:
    """(by..., time, leaving, events): weighted counts at each distinct time, one partial aggregation."""
    w = spec.w
    return df.where(F.col(spec.duration).isNotNull()).groupBy(*by, F.col(spec.duration).alias("time")).agg(F.sum(w).alias("leaving"), F.sum(w * F.col(spec.event)).alias("events"))


def event_table(df: DataFrame, spec: CohortSpec, by: Sequence[str] = (), buckets: int = 1) -> DataFrame:
    """(by..., time, at_risk, events): weighted counts at each distinct time and of those at risk; one scan."""
    return _at_risk(time_counts(df, spec, by), by, buckets)


def _at_risk(counts: DataFrame, by: Sequence[str], buckets: int) -> DataFrame:
    return running(counts, list(by), "time", {"at_risk": F.col("leaving")}, descending=True, buckets=buckets).select(*by, "time", "at_risk", "events")


def center_event_table(df: DataFrame, spec: CohortSpec, centers: Sequence[str]) -> DataFrame:
    """Events of each centre on the union of all event times, and their sum."""
    events = df.where(F.col(spec.event) == 1).groupBy(F.col(spec.duration).alias("time")).pivot(spec.center, list(centers)).agg(F.sum(spec.w)).na.fill(0.0, list(centers))
    return events.withColumn("events", sum((F.col(f"`{c}`") for c in centers[1:]), F.col(f"`{centers[0]}`")))


def center_risk_table(df: DataFrame, spec: CohortSpec, centers: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Each centre's number at risk on the union of all centres' times, and their sum: one pivot and one scan by time."""
    leaving = df.where(F.col(spec.duration).isNotNull()).groupBy(F.col(spec.duration).alias("time")).pivot(spec.center, list(centers)).agg(F.sum(spec.w)).na.fill(0.0, list(centers))
    leaving, buckets = sized(leaving) if buckets is None else (leaving, buckets)
    out = suffix_sum(leaving, [], "time", list(centers), buckets)
    return out.withColumn("at_risk", sum((F.col(f"`{c}`") for c in centers[1:]), F.col(f"`{centers[0]}`")))


def survival_curve(events: DataFrame, by: Sequence[str] = (), buckets: int = 1) -> DataFrame:
    """S(t) as a running product, Greenwood's sum and variance; the variance is null once everyone at risk has failed."""
    d, n = F.col("events"), F.col("at_risk")
    out = running(events, list(by), "time", {"cum_greenwood": F.try_divide(d, n * (n - d))}, {"survival": 1 - d / n}, buckets=buckets)
    ended = F.max(F.when(n == d, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy("time").rangeBetween(Window.unboundedPreceding, 0)) if buckets <= 1 else F.when(F.col("survival") <= 0, 1).otherwise(0)
    out = out.withColumn("cum_greenwood", F.when(ended == 0, F.col("cum_greenwood")))
    return out.withColumn("var_survival", F.col("survival") * F.col("survival") * F.col("cum_greenwood"))


def with_confidence(curve: DataFrame, alpha: float = 0.05, method: str = "exp-greenwood") -> DataFrame:
    low, high = confidence(F.col("survival"), F.col("var_survival"), F.col("cum_greenwood"), alpha, method)
    return curve.withColumns({"ci_low": low, "ci_high": high})


def on_grid(curve: DataFrame, grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The curve as a step function at grid(by..., time): the last value at or before, 1 before the first."""
    values = ["survival", "var_survival", "cum_greenwood"]
    both = grid.select(*by, "time", F.lit(True).alias("__grid"), *[F.lit(None).cast("double").alias(v) for v in values], F.lit(None).cast("int").alias("__known"))
    both = both.unionByName(curve.select(*by, "time", F.lit(False).alias("__grid"), *values, F.lit(1).alias("__known")))
    w = Window.partitionBy(*by).orderBy("time", "__grid").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__known") == 1, F.struct(*values)), ignorenulls=True).over(w)
    out = both.withColumn("__last", last).where("__grid")
    return out.select(*by, "time", F.coalesce("__last.survival", F.when(F.col("__last").isNull(), 1.0)).alias("survival"), F.when(F.col("__last").isNull(), 0.0).otherwise(F.col("__last.var_survival")).alias("var_survival"))


def regular_grid(curve: DataFrame, steps: int, by: Sequence[str] = ()) -> DataFrame:
    """steps + 1 equally spaced times from 0 to the largest time of each group."""
    ends = curve.groupBy(*by).agg(F.max("time").alias("__end"))
    return ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).select(*by, (F.col("k") * F.col("__end") / F.lit(steps)).alias("time"))


def kaplan_meier(df: DataFrame, spec: CohortSpec, by: Sequence[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Weighted curves, by arm unless told otherwise; centres need no separate step because sums merge.

    Without a number of buckets, distinct times are counted on the aggregated table: beyond a million, no arm is scanned in
    one task.
    """
    by = [spec.treated] if by is None else list(by)
    counts, buckets = sized(time_counts(df, spec, by)) if buckets is None else (time_counts(df, spec, by), buckets)
    return survival_curve(_at_risk(counts, by, buckets), by, buckets)
