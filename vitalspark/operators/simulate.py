"""Simulated cohorts from a Cox model: features, allocation, effects, times, ties, censoring.

Every draw is a digest of (seed, number of the draw, row id), so a cohort of any size is a map over spark.range, the same
for any partitioning and in any engine that has MD5; the scheme is statistical, not bitwise, parity.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cohort import bucket_rank, zscore
from .newton import dot


def uniforms(seed: int, draw: int, key: str) -> tuple[Column, Column]:
    """Two independent uniform draws in (0, 1) of 52 bits each, from one digest of (seed, draw, row id)."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(draw), F.col(key)).cast("binary"))
    part = lambda at: (F.conv(F.substring(digest, at, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return part(1), part(14)


def normal(seed: int, draw: int, key: str) -> Column:
    """A standard normal draw by the Box-Muller transform."""
    u, v = uniforms(seed, draw, key)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


@dataclass(frozen=True)
class CoxSimulator:
    n: int
    p: int = 10
    features: str = "toeplitz"  # or uniform_covariance, independent
    correlation: float = 0.5
    propensity: str = "linear"  # or constant
    share: float = 0.5  # of treated rows under constant propensity
    overlap: float = 1.0  # divides the linear propensity's score: larger means better overlap
    cate: str = "constant"  # or linear, lognormal
    effect: float = 0.7  # hazard ratio where the effect is constant
    scale: float = 1.0
    shape: float = 1.0  # of the Weibull baseline
    censoring: str = "exponential"  # or random
    censored: float = 0.2
    ties: float = 0.0  # distinct times are fewer than rows by this share of the rows
    standardize: bool = False  # features by their population mean and deviation
    seed: int = 1

    def coefficients(self) -> np.ndarray:
        return np.random.default_rng(self.seed).normal(0, 1 / math.sqrt(self.p), (2, self.p))

    def _features(self) -> np.ndarray:
        """Cholesky factor of the features' covariance."""
        k = np.arange(self.p)
        if self.features == "toeplitz":
            cov = self.correlation ** abs(k[:, None] - k)
        elif self.features == "uniform_covariance":
            cov = np.full((self.p, self.p), self.correlation) + (1 - self.correlation) * np.eye(self.p)
        elif self.features == "independent":
            cov = np.eye(self.p)
        else:
            raise ValueError(f"unknown features {self.features!r}")
        return np.linalg.cholesky(cov)

    def generate(self, spark: SparkSession, partitions: int | None = None) -> DataFrame:
        """patient_id, X_0.., propensity_scores, treatment, cate, time, event; rows at or before censoring are events."""
        base = spark.range(0, self.n, 1, partitions) if partitions else spark.range(self.n)
        df = base.withColumnRenamed("id", "patient_id")
        (u0, u1), (u2, _) = uniforms(self.seed, self.p, "patient_id"), uniforms(self.seed, self.p + 1, "patient_id")
        df = df.withColumns({f"__g{k}": normal(self.seed, k, "patient_id") for k in range(self.p)} | {"__u0": u0, "__u1": u1, "__u2": u2})
        factor, (alpha, beta) = self._features(), self.coefficients()
        g = [F.col(f"__g{k}") for k in range(self.p)]
        df = df.withColumns({f"X_{i}": dot(g[: i + 1], factor[i, : i + 1]) for i in range(self.p)})
        if self.standardize:
            df = zscore(df, [f"X_{i}" for i in range(self.p)], ddof=0)
        x = [F.col(f"X_{i}") for i in range(self.p)]
        score = 1 / (1 + F.exp(-dot(x, alpha) / F.lit(float(self.overlap)))) if self.propensity == "linear" else F.lit(self.share)
        df = df.withColumn("propensity_scores", score)
        if self.propensity == "constant":  # the exact share, by rank of a random key
            df = bucket_rank(df, "__u0", max(1, self.n // 100_000), "__rank").withColumn("treatment", (F.col("__rank") < round(self.n * self.share)).cast("int"))
        else:
            df = df.withColumn("treatment", (F.col("__u0") < F.col("propensity_scores")).cast("int"))
        effect = {"constant": F.lit(self.effect), "linear": F.exp(math.log(self.effect) + dot(x, alpha) / 2), "lognormal": F.exp(math.log(self.effect) + F.col("__g0") / 2)}[self.cate]
        df = df.withColumn("cate", effect)
        hazard = F.exp(dot(x, beta)) * F.when(F.col("treatment") == 1, F.col("cate")).otherwise(1.0)
        latent = F.lit(self.scale) * F.pow(-F.log(F.col("__u1")) / hazard, F.lit(1 / self.shape))
        df = df.withColumn("__t", latent)
        if self.ties:
            df = with_ties(df, "__t", self.ties)
        return self._censor(df).select("patient_id", *[f"X_{i}" for i in range(self.p)], "propensity_scores", "treatment", "cate", "time", "event")

    def _censor(self, df: DataFrame) -> DataFrame:
        if self.censoring == "random":  # a share of rows, at a uniform fraction of their time
            hit = F.col("__u2") < self.censored
            return df.withColumns({"event": F.when(hit, 0).otherwise(1), "time": F.when(hit, F.col("__t") * F.col("__u2") / self.censored).otherwise(F.col("__t"))})
        mean = df.agg(F.avg("__t")).first()[0]
        limit = -F.log(F.col("__u2")) * F.lit(mean * (1 - self.censored) / max(self.censored, 1e-9))
        return df.withColumns({"event": (F.col("__t") <= limit).cast("int"), "time": F.least(F.col("__t"), limit)})


def with_ties(df: DataFrame, time: str, share: float) -> DataFrame:
    """Times replaced by the means of quantile bins, as many as leave n - int(share * n) distinct times.

    Bins are ranges of ranks, which need no sort of all rows in one task; a bin's rows move together.
    """
    n = df.count()
    bins = max(1, n - int(share * n))
    if bins >= n:
        return df
    ranked = bucket_rank(df, time, max(1, n // 100_000), "__place").withColumn("__bin", F.floor(F.col("__place") * bins / F.lit(n)))
    means = ranked.groupBy("__bin").agg(F.avg(time).alias("__mean"))
    return ranked.join(means, "__bin").withColumn(time, F.col("__mean")).drop("__bin", "__mean", "__place", "__n")


def with_categoricals(df: DataFrame, columns: Sequence[str], levels: int | Sequence[int] | None = None, missing: float = 0.0, seed: int = 9, key: str = "patient_id") -> DataFrame:
    """Columns cut at quantiles to ordinal codes `cat_*`, a share of all cells replaced by nulls.

    levels: a number for all columns, one for each, or none, when each column draws between 2 and 10.
    """
    if levels is None:
        levels = np.random.default_rng(seed).integers(2, 11, len(columns)).tolist()
    counts = [levels] * len(columns) if isinstance(levels, int) else list(levels)
    cuts = df.select(*[F.percentile_approx(c, [j / n for j in range(1, n)], 10_000).alias(f"c{k}") for k, (c, n) in enumerate(zip(columns, counts, strict=True))]).first() if columns else []
    out = df
    for k, c in enumerate(columns):
        code = sum((F.when(F.col(c) > F.lit(float(v)), 1).otherwise(0) for v in cuts[k][1:]), F.when(F.col(c) > F.lit(float(cuts[k][0])), 1).otherwise(0))
        out = out.withColumn(f"cat_{c}", F.when(uniforms(seed, k, key)[0] < missing, None).otherwise(code.cast("long")))
    return out
