"""Scalar statistics: normal and chi-square tails, confidence transforms as columns."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def two_sided_p(z: float) -> float:
    """2 P(Z > |z|), which is also the upper tail of chi-square with one degree at z squared."""
    return math.erfc(abs(z) / math.sqrt(2))


@F.pandas_udf(DoubleType())
def two_sided_p_column(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or x != x else two_sided_p(x))


def soft_abs(x: float, a: float) -> tuple[float, float, float]:
    """(1/a)(ln(1+e^-ax) + ln(1+e^ax)), its slope and curvature."""
    half = math.tanh(a * x / 2)
    value = abs(x) + 2 * math.log1p(math.exp(-a * abs(x))) / a
    return value, half, a / 2 * (1 - half * half)


def confidence(survival: Column, variance: Column, greenwood: Column, alpha: float = 0.05, method: str = "exp-greenwood") -> tuple[Column, Column]:
    """Lower and upper bound of a survival curve.

    exp-greenwood works on log(-log S): S = 1 gives 1, S = 0 or an undefined variance gives null.
    """
    z = normal_quantile(1 - alpha / 2)
    if method == "greenwood":
        half = F.lit(z) * F.sqrt(variance)
        return survival - half, survival + half
    if method != "exp-greenwood":
        raise ValueError(f"unknown method {method!r}")
    inside = (survival > 0) & (survival < 1)
    v = F.log(-F.log(F.when(inside, survival)))
    half = F.lit(z) * F.sqrt(greenwood) / F.abs(F.log(F.when(inside, survival)))
    bound = lambda x: F.when(survival >= 1, 1.0).when(inside, F.exp(-F.exp(x)))
    return bound(v + half), bound(v - half)


def repair_bounds(survival: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Where the interval leaves out the curve, both bounds become the curve."""
    out = (low > survival) | (high < survival)
    return F.when(out, survival).otherwise(low), F.when(out, survival).otherwise(high)
