"""Weighted moments, standardized mean differences, effective sample size."""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cohort import CohortSpec


def raw_moment(x: Column, w: Column, k: int) -> Column:
    """Sum of w x^k over that of w, both over the rows where x is known."""
    return F.sum(w * F.pow(x, F.lit(k))) / F.sum(F.when(x.isNotNull(), w))


def centred_from_raw(raw: Sequence[Column], k: int) -> Column:
    """The centred moment of order k from raw moments 1..k by binomial expansion."""
    mean = raw[0]
    terms = [F.lit(float(comb(k, j))) * F.pow(-mean, F.lit(k - j)) * (raw[j - 1] if j else F.lit(1.0)) for j in range(k + 1)]
    return sum(terms[1:], terms[0])


def arm_moments(df: DataFrame, spec: CohortSpec, columns: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """(by..., covariate, n, sum_w, sum_w2, mean, var, w_mean, w_var): one aggregation with generated sums, then a
    reshape of one row a group."""
    by = [spec.treated] if by is None else list(by)
    w = spec.w
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        known = F.when(x.isNotNull(), w)
        aggs += [F.count(x).alias(f"n__{c}"), F.sum(known).alias(f"sw__{c}"), F.sum(known * known).alias(f"sw2__{c}"), F.avg(x).alias(f"m__{c}"), F.var_pop(x).alias(f"v__{c}"), F.sum(w * x).alias(f"wx__{c}"), F.sum(w * x * x).alias(f"wx2__{c}"), F.min(x).alias(f"lo__{c}"), F.max(x).alias(f"hi__{c}"), F.count_if((x != 0) & (x != 1)).alias(f"odd__{c}")]
    wide = df.groupBy(*by).agg(*aggs)
    field = lambda c: F.struct(F.lit(c).alias("covariate"), *[F.col(f"{k}__{c}").alias(k) for k in ("n", "sw", "sw2", "m", "v", "wx", "wx2", "odd")])
    long = wide.select(*by, F.explode(F.array(*[field(c) for c in columns])).alias("s"))
    w_mean = F.col("s.wx") / F.col("s.sw")
    return long.select(
        *by, F.col("s.covariate").alias("covariate"), F.col("s.n").alias("n"), F.col("s.sw").alias("sum_w"), F.col("s.sw2").alias("sum_w2"),
        F.col("s.m").alias("mean"), F.col("s.v").alias("var"), w_mean.alias("w_mean"), (F.col("s.wx2") / F.col("s.sw") - w_mean * w_mean).alias("w_var"), (F.col("s.odd") == 0).alias("is_binary"),
    )


def merged_moments(local: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means and variances of the whole from those of the parts (n, mean, var), as a server would merge them."""
    n, m, v = F.col("n"), F.col("mean"), F.col("var")
    mean = F.sum(n * m) / F.sum(n)
    second = F.sum(n * (v + m * m)) / F.sum(n)
    return local.groupBy(*keys).agg(F.sum(n).alias("n"), mean.alias("mean"), (second - mean * mean).alias("var"))


def smd(df: DataFrame, spec: CohortSpec, columns: Sequence[str], ddof: int = 0, scale: float = 1.0, binary: bool = False, tol: float = 1e-12, by: Sequence[str] = ()) -> DataFrame:
    """(by..., covariate, smd_raw, smd_weighted, smd_weighted_var).

    smd_weighted has weighted means over the raw pooled deviation; smd_weighted_var the weighted variance with the
    effective-size correction. With binary, 0/1 covariates use p(1 - p).
    """
    arms = arm_moments(df, spec, columns, [*by, spec.treated])
    raw = F.col("var") * F.col("n") / (F.col("n") - 1) if ddof else F.col("var")
    if binary:
        raw = F.when(F.col("is_binary"), F.col("mean") * (1 - F.col("mean"))).otherwise(raw)
    sw2 = F.col("sum_w") * F.col("sum_w")
    weighted = F.col("w_var") * sw2 / (sw2 - F.col("sum_w2"))
    arms = arms.withColumns({"raw_var": raw, "weighted_var": weighted})
    at = lambda c, arm: F.max(F.when(F.col(spec.treated) == arm, F.col(c)))
    difference = lambda mean, var: (at(mean, 1) - at(mean, 0)) / (F.sqrt((at(var, 1) + at(var, 0)) / 2) + F.lit(tol)) * F.lit(float(scale))
    return arms.groupBy(*by, "covariate").agg(difference("mean", "raw_var").alias("smd_raw"), difference("w_mean", "raw_var").alias("smd_weighted"), difference("w_mean", "weighted_var").alias("smd_weighted_var"))


def effective_sample_size(df: DataFrame, weight: Column, by: Sequence[str] = ()) -> DataFrame:
    s, s2 = F.sum(weight), F.sum(weight * weight)
    return df.groupBy(*by).agg(F.when(s2 == 0, 0.0).otherwise(F.try_divide(s * s, s2)).alias("ess"))


def variance_ratio(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Ratio of population variances, infinite if the second is 0."""
    return df.agg(F.when(F.var_pop(y) == 0, float("inf")).otherwise(F.try_divide(F.var_pop(x), F.var_pop(y))).alias("variance_ratio"))


def relative_error(x: Column, y: Column) -> Column:
    return F.abs(y - x) / F.abs(x)


def relative_error_l2(x: Column, y: Column) -> Column:
    """Aggregate: length of y - x over the length of x."""
    return F.sqrt(F.sum((y - x) * (y - x))) / F.sqrt(F.sum(x * x))
