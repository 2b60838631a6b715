"""Sufficient statistics of centres, kept as tables that later centres merge into without going back to anyone's rows.

A delivery holds, for each of its centres, weighted counts by (arm, time), sums of covariates by arm, and sums of their
products. Deliveries are added once by name (`log.append_once`); a centre counts with its newest delivery. From the merged
tables come curves, the weighted Cox fit of the treatment, moments and covariances of the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..cohort import CohortSpec
from .log import append_once, read_once


class CentreStates:
    def __init__(self, spark: SparkSession, path: str, covariates: Sequence[str]):
        self.spark, self.path, self.covariates = spark, path.rstrip("/"), list(covariates)

    def deliver(self, df: DataFrame, spec: CohortSpec, version: int) -> bool:
        """Add the statistics of the centres in df; whether this version was new. Rows that lack a covariate are in its sums
        nowhere, but count by time. The rows are cached for the three tables, and made once."""
        rows = df.select(*dict.fromkeys([spec.center, spec.treated, spec.duration, spec.event, *([spec.weight] if spec.weight else []), *self.covariates])).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._deliver(rows, spec, version)
        finally:
            rows.unpersist()

    def _deliver(self, df: DataFrame, spec: CohortSpec, version: int) -> bool:
        w, e, known = spec.w, F.col(spec.event), {c: F.col(c).cast("double") for c in self.covariates}
        keys = [F.col(spec.center).alias("center"), F.col(spec.treated).cast("int").alias("arm")]
        marked = lambda rows: rows.withColumn("version", F.lit(version))
        times = df.groupBy(*keys, F.col(spec.duration).cast("double").alias("time")).agg(F.sum(w).alias("leaving"), F.sum(w * e).alias("events"))
        sums = [F.struct(F.lit(c).alias("covariate"), F.count(x).alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.sum(F.when(x.isNotNull(), w)).alias("w0"), F.sum(w * x).alias("w1"), F.sum(w * x * x).alias("w2")).alias(f"__{k}") for k, (c, x) in enumerate(known.items())]
        moments = df.groupBy(*keys).agg(*sums).select("center", "arm", F.explode(F.array(*[f"__{k}" for k in range(len(sums))])).alias("s")).select("center", "arm", "s.*")
        pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(x * y).alias("n"), F.sum(F.when(y.isNotNull(), x)).alias("sa"), F.sum(F.when(x.isNotNull(), y)).alias("sb"), F.sum(x * y).alias("sab")).alias(f"__{i}_{j}") for i, (a, x) in enumerate(known.items()) for j, (b, y) in enumerate(known.items()) if i <= j]
        names = [f"__{i}_{j}" for i in range(len(known)) for j in range(i, len(known))]
        gram = df.groupBy(keys[0]).agg(*pairs).select("center", F.explode(F.array(*names)).alias("s")).select("center", "s.*")
        return all([append_once(marked(rows), f"{self.path}/{name}", f"version {version}") for name, rows in (("times", times), ("moments", moments), ("gram", gram))])

    def _newest(self, name: str) -> DataFrame:
        rows = read_once(self.spark, f"{self.path}/{name}")
        if rows is None:
            raise ValueError(f"{self.path}: no delivery yet")
        last = rows.groupBy("center").agg(F.max("version").alias("version"))  # a row a centre
        return rows.join(last, ["center", "version"])

    def event_counts(self, by: Sequence[str] = ("arm",)) -> DataFrame:
        """(by..., time, leaving, events) of all centres: what curves are made of."""
        return self._newest("times").groupBy(*by, "time").agg(F.sum("leaving").alias("leaving"), F.sum("events").alias("events"))

    def time_table(self) -> DataFrame:
        """The table by time of the weighted Cox fit of the treatment (`cox.fit_binary`)."""
        from ..operators.scan import sized, suffix_sum

        part = lambda c, arm: F.sum(F.when(F.col("arm") == arm, F.col(c)).otherwise(0.0))
        at = self._newest("times").groupBy("time").agg(part("leaving", 0).alias("r0"), part("leaving", 1).alias("r1"), F.sum("events").alias("dw"), part("events", 1).alias("dwx"))
        at, buckets = sized(at)
        return suffix_sum(at, [], "time", ["r0", "r1"], buckets).where("dw > 0")

    def moments(self, by: Sequence[str] = ()) -> DataFrame:
        """(by..., covariate, n, mean, var, w_mean, w_var) of the whole."""
        own = self._newest("moments").groupBy(*by, "covariate").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "w0", "w1", "w2")])
        mean, w_mean = F.col("s1") / F.col("n"), F.col("w1") / F.col("w0")
        return own.select(*by, "covariate", "n", mean.alias("mean"), (F.col("s2") / F.col("n") - mean * mean).alias("var"), w_mean.alias("w_mean"), (F.col("w2") / F.col("w0") - w_mean * w_mean).alias("w_var"))

    def covariances(self) -> DataFrame:
        """(a, b, n, cov): population covariances of every two covariates over the rows that have both."""
        own = self._newest("gram").groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab")])
        return own.select("a", "b", "n", (F.col("sab") / F.col("n") - F.col("sa") * F.col("sb") / F.col("n") / F.col("n")).alias("cov"))
