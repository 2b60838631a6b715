"""Newton fits of many groups at once, such as bootstrap replicates: one aggregation an iteration, whatever their number.

Coefficients are a table with a row a group that joins the rows; sums come back as a row a group. Only these reach the
driver, so groups are for replicates and folds (hundreds), not for patients.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..cohort import CohortSpec
from .newton import safe_offset, symmetric, triangle
from .scan import auto_buckets, suffix_sum

Fits = dict[int, tuple[np.ndarray, np.ndarray]]


def newton(df: DataFrame, by: str, groups: Sequence[int], p: int, sums: Callable[[DataFrame], DataFrame], reach: tuple[np.ndarray, np.ndarray] | None = None, max_iter: int = 60, tol: float = 1e-9) -> Fits:
    """{group: (coefficients, curvature)} that maximise the value of `sums`.

    sums(betas) gets (by, b0.., offset), the offset as `safe_offset` has it for columns of this reach, and gives (by, l, g0.., h0_0..): value, gradient and negative Hessian. All groups step in
    lockstep; a group whose value fell halves its own step, one whose step is below tol is done.
    """
    base = {g: np.zeros(p) for g in groups}
    move = {g: np.zeros(p) for g in groups}
    value: dict[int, float] = {}
    curve: dict[int, np.ndarray] = {}
    live = set(groups)
    for _ in range(max_iter):
        spark = df.sparkSession
        at = {g: base[g] + move[g] for g in sorted(live)}
        betas = spark.createDataFrame([(g, *map(float, b), safe_offset(b, reach)) for g, b in at.items()], f"{by} int, " + ", ".join(f"b{k} double" for k in range(p)) + ", offset double")
        for r in sums(betas).collect():  # a row a group
            g = r[by]
            ok = r["l"] is not None and np.isfinite(r["l"])
            if g in value and not (ok and r["l"] >= value[g] - 1e-9 * abs(value[g])) and abs(move[g]).max() > 1e-12:
                move[g] = move[g] / 2
                continue
            small = g in value and float(np.linalg.norm(move[g])) < tol
            base[g], value[g] = at[g], r["l"]
            curve[g] = symmetric([float(r[f"h{i}_{j}"] or 0.0) for i, j in triangle(p)], p)
            slope = np.array([float(r[f"g{k}"] or 0.0) for k in range(p)])
            move[g] = np.linalg.pinv(curve[g], rcond=1e-10, hermitian=True) @ slope
            if small:
                live.discard(g)
        live &= value.keys()  # a group without rows has no fit
        if not live:
            break
    return {g: (base[g], curve[g]) for g in value}


def _dot(p: int) -> Column:
    return sum((F.col(f"b{k}") * F.col(f"x{k}") for k in range(1, p)), F.col("b0") * F.col("x0"))


def fit_logits(df: DataFrame, by: str, groups: Sequence[int], features: Sequence[str], label: str, weight: Column, l2: float = 0.0) -> Fits:
    """Logistic regressions, intercept first."""
    p = len(features) + 1
    rows = df.select(by, F.col(label).cast("double").alias("y"), weight.alias("w"), F.lit(1.0).alias("x0"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(features, 1)]).na.drop().persist(StorageLevel.MEMORY_AND_DISK)

    def sums(betas: DataFrame) -> DataFrame:
        own = rows.join(F.broadcast(betas), by).withColumn("eta", _dot(p)).withColumn("q", 1 / (1 + F.exp(-F.col("eta"))))  # betas: a row a group
        ridge = [F.lit(0.0)] + [F.lit(float(l2))] * (p - 1)
        v = F.col("w") * F.col("q") * (1 - F.col("q"))
        value = F.sum(F.col("w") * (F.col("y") * F.col("eta") - F.greatest(F.col("eta"), F.lit(0.0)) - F.log1p(F.exp(-F.abs("eta"))))) - sum((r * F.first(f"b{k}") * F.first(f"b{k}") / 2 for k, r in enumerate(ridge)), F.lit(0.0))
        slope = [(F.sum(F.col("w") * (F.col("y") - F.col("q")) * F.col(f"x{k}")) - ridge[k] * F.first(f"b{k}")).alias(f"g{k}") for k in range(p)]
        return own.groupBy(by).agg(value.alias("l"), *slope, *[(F.sum(v * F.col(f"x{i}") * F.col(f"x{j}")) + (ridge[i] if i == j else 0.0)).alias(f"h{i}_{j}") for i, j in triangle(p)])

    try:
        return newton(df, by, groups, p, sums)
    finally:
        rows.unpersist()


def fit_moments(df: DataFrame, by: str, groups: Sequence[int], treated: str, columns: Sequence[str], weight: Column) -> tuple[DataFrame, Fits]:
    """Moment-matched weights of treated rows by group: rows with z0.. (their moments less the controls'), and the fits.

    Controls count by weight too. Deviations are those of a sample with that many rows; a 0/1 column has no second moment.
    """
    x = [F.col(c).cast("double") for c in columns]
    odd = df.where(F.col(treated) == 1).agg(*[F.count_if((c != 0) & (c != 1)).alias(f"o{k}") for k, c in enumerate(x)]).first()
    w = weight
    mean = lambda c: F.sum(w * c) / F.sum(w)
    control = df.where(F.col(treated) == 0).groupBy(by).agg(*[v.alias(f"{n}{k}") for k, c in enumerate(x) for n, v in (("m", mean(c)), ("v", (F.sum(w * c * c) - F.sum(w * c) * F.sum(w * c) / F.sum(w)) / (F.sum(w) - 1)))])
    own = df.join(F.broadcast(control), by)  # a row a group
    z = [c - F.col(f"m{k}") for k, c in enumerate(x)] + [c * c - (F.col(f"m{k}") * F.col(f"m{k}") + F.col(f"v{k}")) for k, c in enumerate(x) if odd[f"o{k}"]]
    p = len(z)
    scored = own.withColumns({f"x{k}": c for k, c in enumerate(z)}).drop(*control.columns[1:])
    rows = scored.where(F.col(treated) == 1).select(by, weight.alias("w"), *[f"x{k}" for k in range(p)]).na.drop().persist(StorageLevel.MEMORY_AND_DISK)

    def sums(betas: DataFrame) -> DataFrame:
        e = rows.join(F.broadcast(betas), by).withColumn("e", F.col("w") * F.exp(_dot(p)))
        return e.groupBy(by).agg((-F.sum("e")).alias("l"), *[(-F.sum(F.col("e") * F.col(f"x{k}"))).alias(f"g{k}") for k in range(p)], *[F.sum(F.col("e") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in triangle(p)])

    try:
        return scored, newton(df, by, groups, p, sums)
    finally:
        rows.unpersist()


def fit_coxes(df: DataFrame, spec: CohortSpec, by: str, groups: Sequence[int], columns: Sequence[str], ties: str = "breslow") -> Fits:
    """Weighted Cox regressions; columns are standardized by the moments of all rows, and coefficients given back unscaled."""
    p = len(columns)
    rows = df.select(by, F.col(spec.duration).cast("double").alias("t"), F.col(spec.event).cast("double").alias("e"), spec.w.alias("w"), *[F.col(c).cast("double").alias(f"z{k}") for k, c in enumerate(columns)]).na.drop().where("w > 0")
    stats = rows.agg(*[f(f"z{k}").alias(f"s{k}{n}") for k in range(p) for n, f in enumerate((F.avg, F.stddev_samp, F.min, F.max))], F.approx_count_distinct("t").alias("times")).first()
    scale = np.array([stats[f"s{k}1"] or 1.0 for k in range(p)], float)
    rows = rows.select(by, "t", "e", "w", *[((F.col(f"z{k}") - F.lit(float(stats[f"s{k}0"] or 0.0))) / F.lit(float(scale[k]))).alias(f"x{k}") for k in range(p)]).persist(StorageLevel.MEMORY_AND_DISK)
    buckets = auto_buckets(stats["times"])
    mean = np.array([stats[f"s{k}0"] or 0.0 for k in range(p)])
    reach = tuple((np.array([stats[f"s{k}{n}"] or 0.0 for k in range(p)], float) - mean) / scale for n in (2, 3))
    names = ["s0", *[f"s1_{i}" for i in range(p)], *[f"s2_{i}_{j}" for i, j in triangle(p)]]

    def sums(betas: DataFrame) -> DataFrame:
        own = rows.join(F.broadcast(betas), by).withColumn("eta", _dot(p))
        own = own.withColumn("r", F.col("w") * F.exp(F.col("eta") - F.col("offset")))
        x = [F.col(f"x{k}") for k in range(p)]
        risk = dict(zip(names, [F.col("r"), *[F.col("r") * c for c in x], *[F.col("r") * x[i] * x[j] for i, j in triangle(p)]]))
        events = {"dw": F.col("w") * F.col("e"), "n_events": F.col("e"), "le": F.col("w") * F.col("e") * (F.col("eta") - F.col("offset"))} | {f"d1_{i}": F.col("w") * F.col("e") * x[i] for i in range(p)}
        if ties == "efron":
            events |= {"e" + n[1:]: c * F.col("e") for n, c in risk.items()}
        at = own.groupBy(by, "t").agg(*[F.sum(c).alias(n) for n, c in (risk | events).items()])
        t = suffix_sum(at, [by], "t", names, buckets).where("dw > 0")
        weight, share = F.col("dw"), F.lit(1.0)
        if ties == "efron":
            t = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_events").cast("int") - 1)))
            weight, share = F.col("dw") / F.col("n_events"), 1 / F.col("n_events")
            t = t.withColumns({n: F.col(n) - F.col("k") / F.col("n_events") * F.col("e" + n[1:]) for n in names})
        m = [F.col(f"s1_{i}") / F.col("s0") for i in range(p)]
        slope = [F.sum(share * F.col(f"d1_{i}") - weight * m[i]).alias(f"g{i}") for i in range(p)]
        return t.groupBy(by).agg(F.sum(share * F.col("le") - weight * F.log("s0")).alias("l"), *slope, *[F.sum(weight * (F.col(f"s2_{i}_{j}") / F.col("s0") - m[i] * m[j])).alias(f"h{i}_{j}") for i, j in triangle(p)])

    try:
        return {g: (b / scale, h * np.outer(scale, scale)) for g, (b, h) in newton(df, by, groups, p, sums, reach).items()}
    finally:
        rows.unpersist()
