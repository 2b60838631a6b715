"""Matching-adjusted weights by the method of moments."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .newton import dot, weighted_sums

#: Weights at or below 0 are replaced by this.
LEAST_WEIGHT = 0.01


def maic_targets(df: DataFrame, treated: str, columns: Sequence[str], arm: int = 0) -> DataFrame:
    """One row with mean and sample deviation of each column in an arm."""
    return df.where(F.col(treated) == arm).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


@dataclass(frozen=True)
class MaicModel:
    columns: tuple[str, ...]
    targets: tuple[tuple[float, float], ...]
    a: tuple[float, ...]
    binary: tuple[bool, ...] = ()

    def balance(self) -> list[Column]:
        x = [F.col(c).cast("double") for c in self.columns]
        second = [c * c - F.lit(m * m + s * s) for c, (m, s), b in zip(x, self.targets, self.binary) if not b]
        return [c - F.lit(m) for c, (m, _) in zip(x, self.targets)] + second

    def weight(self, treated: str) -> Column:
        w = F.exp(dot(self.balance(), self.a))
        return F.when(F.col(treated) == 1, F.when(w <= 0, LEAST_WEIGHT).otherwise(w)).otherwise(1.0)


def fit_maic(df: DataFrame, treated: str, columns: Sequence[str], max_iter: int = 50, tol: float = 1e-9) -> MaicModel:
    """Minimise the sum of exp(a z) over treated rows, z their moments less the control targets. A 0/1 column has its
    second moment fixed by the first, so only its mean is matched."""
    row = maic_targets(df, treated, columns).first()
    targets = tuple((float(row[f"{c}_mean"]), float(row[f"{c}_std"])) for c in columns)
    own = df.where(F.col(treated) == 1).select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop().persist(StorageLevel.MEMORY_AND_DISK)
    odd = own.agg(*[F.count_if((F.col(c) != 0) & (F.col(c) != 1)).alias(c) for c in columns]).first()
    binary = tuple(not odd[c] for c in columns)
    a = np.zeros(2 * len(columns) - sum(binary))
    try:
        value = None
        for _ in range(max_iter):
            z = MaicModel(tuple(columns), targets, tuple(a), binary).balance()
            e = F.exp(dot(z, a))
            g, h, (value,) = weighted_sums(own, z, e, e, [e])
            move = -np.linalg.pinv(h, rcond=1e-10, hermitian=True) @ g
            scale = 1.0
            for _ in range(20):  # halve until the objective falls
                new = own.agg(F.sum(F.exp(dot(z, a + scale * move)))).first()[0]
                if new is not None and np.isfinite(new) and new <= value * (1 + 1e-12):
                    break
                scale /= 2
            a = a + scale * move
            if abs(scale * move).max() < tol:
                break
    finally:
        own.unpersist()
    return MaicModel(tuple(columns), targets, tuple(float(v) for v in a), binary)
