"""Newton iterations whose sums come from one Spark aggregation each; only sums reach the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From this many columns on, second-order sums are taken as partial Gram matrices and not as generated expressions.
WIDE = 40


def dot(columns: Sequence[Column], beta: Sequence[float], intercept: float = 0.0) -> Column:
    out = F.lit(float(intercept))
    for c, b in zip(columns, beta, strict=True):
        out = out + F.lit(float(b)) * c
    return out


def safe_offset(beta: Sequence[float], reach: tuple[np.ndarray, np.ndarray] | None) -> float:
    """What is to be taken from linear predictors so that their exponentials, and products of these with columns, stay
    finite: 0 unless a predictor could pass 500. reach: least and largest value of each column."""
    if reach is None:
        return 0.0
    return max(0.0, float(np.maximum(np.asarray(beta) * reach[0], np.asarray(beta) * reach[1]).sum()) - 500.0)


def triangle(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def symmetric(values: Sequence[float], p: int) -> np.ndarray:
    h = np.zeros((p, p))
    for (i, j), v in zip(triangle(p), values, strict=True):
        h[i, j] = h[j, i] = v
    return h


def weighted_sums(df: DataFrame, x: Sequence[Column], first: Column, second: Column, extra: Sequence[Column] = ()) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Sum of first * x, sum of second * x x', and the sums of extra columns, in one pass."""
    p = len(x)
    if p < WIDE:
        aggs = [F.sum(first * c) for c in x] + [F.sum(second * x[i] * x[j]) for i, j in triangle(p)] + [F.sum(e) for e in extra]
        row = [0.0 if v is None else float(v) for v in df.agg(*[a.alias(f"a{k}") for k, a in enumerate(aggs)]).first()]
        return np.array(row[:p]), symmetric(row[p : p + p * (p + 1) // 2], p), row[p + p * (p + 1) // 2 :]
    cols = df.select(first.cast("double").alias("f"), second.cast("double").alias("s"), *[c.cast("double").alias(f"x{k}") for k, c in enumerate(x)], *[e.cast("double").alias(f"e{k}") for k, e in enumerate(extra)])

    n_extra = len(extra)

    def gram(batches):
        g, h, rest = np.zeros(p), np.zeros((p, p)), np.zeros(n_extra)
        for b in batches:
            own = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in b.columns], 1)
            own = own[~np.isnan(own).any(axis=1)]
            g += own[:, 0] @ own[:, 2 : 2 + p]
            h += (own[:, 2 : 2 + p] * own[:, 1:2]).T @ own[:, 2 : 2 + p]
            rest += own[:, 2 + p :].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g, h.ravel(), rest]).tolist()], pa.list_(pa.float64()))], names=["v"])

    n = p + p * p + len(extra)
    parts = cols.mapInArrow(gram, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    v = np.zeros(n)
    for r in parts.collect():  # p + p*p values
        v[r["k"]] = r["v"]
    return v[:p], v[p : p + p * p].reshape(p, p), v[p + p * p :].tolist()
