"""Logistic regression by iteratively reweighted least squares, one aggregation an iteration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .newton import dot, weighted_sums


@dataclass(frozen=True)
class LogitModel:
    features: tuple[str, ...]
    coef: tuple[float, ...]  # intercept first
    iterations: int
    converged: bool

    def probability(self) -> Column:
        eta = dot([F.col(c).cast("double") for c in self.features], self.coef[1:], self.coef[0])
        return 1 / (1 + F.exp(-eta))


def fit_logit(df: DataFrame, features: Sequence[str], label: str, weight: Column | None = None, l2: float = 0.0, damping: float = 1.0, max_iter: int = 30, tol: float = 1e-10, largest: float = 50.0) -> LogitModel:
    """Maximum likelihood from zero, on unscaled columns. Complete separation stops once a coefficient passes
    `largest` and is reported as not converged. Rows with a null feature or label are left out."""
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(F.col(label).cast("double").alias("y"), w.alias("w"), F.lit(1.0).alias("x0"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features, 1)]).na.drop().persist(StorageLevel.MEMORY_AND_DISK)
    x = [F.col(f"x{k}") for k in range(len(features) + 1)]
    beta = np.zeros(len(x))
    ridge = l2 * np.diag([0.0] + [1.0] * len(features))
    done = False
    step = 0
    try:
        for step in range(1, max_iter + 1):
            p = 1 / (1 + F.exp(-dot(x, beta)))
            with_p = rows.withColumn("p", p)
            g, h, _ = weighted_sums(with_p, x, F.col("w") * (F.col("y") - F.col("p")), F.col("w") * F.col("p") * (1 - F.col("p")))
            move = np.linalg.solve(h + ridge, g - ridge @ beta) * damping
            beta = beta + move
            done = bool(abs(move).max() < tol)
            if done or abs(beta).max() > largest:
                break
    finally:
        rows.unpersist()
    return LogitModel(tuple(features), tuple(float(b) for b in beta), step, done)
