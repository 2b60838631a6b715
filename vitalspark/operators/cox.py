"""Weighted Cox regression: general columns, and the binary-treatment case whose table by time does not depend on beta.

Risk-set sums are running sums over a table aggregated by time, never a join of patients with event times. Each Newton
step is one Spark job over cached rows or, for a binary treatment, over the table by time alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..cohort import CohortSpec
from ..functions.stats import normal_quantile, soft_abs, two_sided_p
from .newton import dot, safe_offset, symmetric, triangle
from .resample import packed_time_sums
from .scan import auto_buckets, running, sized, suffix_sum

#: Rows of a table by time that the driver takes to iterate on; larger ones stay in Spark.
DRIVER_ROWS = 50_000


@dataclass(frozen=True)
class CoxFit:
    columns: tuple[str, ...]
    beta: np.ndarray
    hessian: np.ndarray  # of the log-likelihood, negative definite
    log_likelihood: float
    iterations: int
    converged: bool
    variance: np.ndarray = field(default=None)
    ties: str = "breslow"
    trace: tuple[tuple[int, float, float], ...] = ()  # iteration, log-likelihood after it, length of its step

    def first_converged(self, tol: float) -> int | None:
        """The first iteration whose step was shorter than tol."""
        return next((k for k, _, step in self.trace if step < tol), None)

    @property
    def naive_variance(self) -> np.ndarray:
        return -np.linalg.inv(self.hessian)


def _exp(x: float) -> float:
    return math.exp(x) if x < 700 else math.inf


def summary_rows(names: Sequence[str], beta: np.ndarray, variance: np.ndarray, alpha: float = 0.05, cmp_to: float = 0.0) -> list[tuple]:
    """(covariate, coef, exp_coef, se, ci_low, ci_high, exp_low, exp_high, cmp_to, z, p, minus_log2_p) rows."""
    q = normal_quantile(1 - alpha / 2)
    out = []
    for name, b, v in zip(names, map(float, beta), map(float, np.diag(np.atleast_2d(variance))), strict=True):
        se = math.sqrt(v)
        z = (b - cmp_to) / se if se > 0 else math.copysign(math.inf, b - cmp_to)
        p = two_sided_p(z)
        out.append((name, b, _exp(b), se, b - q * se, b + q * se, _exp(b - q * se), _exp(b + q * se), float(cmp_to), z, p, -math.log2(p) if p > 0 else math.inf))
    return out


SUMMARY_SCHEMA = "covariate string, coef double, exp_coef double, se double, ci_low double, ci_high double, exp_low double, exp_high double, cmp_to double, z double, p double, minus_log2_p double"


def time_table(df: DataFrame, spec: CohortSpec, x: Column, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """(by..., time, r0, r1, dw, dwx): weights at risk with x = 0 and 1, weighted events, of them those with x = 1.

    Without a number of buckets the distinct times are counted on the aggregated table.
    """
    w, e = spec.w, F.col(spec.event)
    at = df.groupBy(*by, F.col(spec.duration).cast("double").alias("time")).agg(
        F.sum(F.when(x == 0, w).otherwise(0.0)).alias("r0"), F.sum(F.when(x == 1, w).otherwise(0.0)).alias("r1"),
        F.sum(w * e).alias("dw"), F.sum(w * e * x).alias("dwx"))
    if buckets is None:
        at, buckets = sized(at)
    return suffix_sum(at, list(by), "time", ["r0", "r1"], buckets).where(F.col("dw") > 0)


def packed_time_table(df: DataFrame, spec: CohortSpec, x: Column, replicates: int, name: str = "multiplicities") -> DataFrame:
    """The `time_table` of all replicates, by replicate, of rows with packed multiplicities."""
    w, e = spec.w, F.col(spec.event)
    sums = {"r0": F.when(x == 0, w), "r1": F.when(x == 1, w), "dw": w * e, "dwx": w * e * x}
    at, buckets = sized(packed_time_sums(df, spec, sums, replicates, name))
    return suffix_sum(at, ["replicate"], "time", ["r0", "r1"], buckets).where(F.col("dw") > 0)


def fit_binary(table: DataFrame, by: str | None = None, max_iter: int = 50, tol: float = 1e-9) -> dict:
    """{group: (beta, information, log-likelihood, iterations)} from a `time_table`; one group None without by.

    A small table is iterated on the driver; a larger one by one grouped aggregation an iteration, all groups at once.
    """
    keys = [by] if by else []
    table = table.select(*keys, "r0", "r1", "dw", "dwx").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if table.limit(DRIVER_ROWS + 1).count() <= DRIVER_ROWS:
            pdf = table.toPandas()
            groups = pdf.groupby(by) if by else [(None, pdf)]
            return {g: _newton_local(*(own[c].to_numpy(float) for c in ("r0", "r1", "dw", "dwx")), max_iter, tol) for g, own in groups}
        names = [r[0] for r in table.select(by).distinct().collect()] if by else [None]
        state = {g: (0.0, 0.0, 0.0, 0) for g in names}
        live = set(names)
        for step in range(1, max_iter + 1):
            theta = F.lit(math.exp(state[None][0])) if not by else F.exp(F.create_map(*[v for g in names for v in (F.lit(g), F.lit(state[g][0]))])[F.col(by)])
            s0 = F.col("r0") + theta * F.col("r1")
            share = theta * F.col("r1") / s0
            sums = table.groupBy(*keys).agg(F.sum(F.col("dwx") - F.col("dw") * share).alias("g"), F.sum(F.col("dw") * share * (1 - share)).alias("h"), F.sum(F.col("dw") * F.log(s0)).alias("l"), F.sum("dwx").alias("x"))
            for r in sums.collect():  # a row a group
                g = r[by] if by else None
                if g in live:
                    beta = state[g][0]
                    move = max(-2.0, min(2.0, r["g"] / r["h"])) if r["h"] > 0 else 0.0
                    state[g] = (beta + move, r["h"], beta * r["x"] - r["l"], step)
                    if abs(move) < tol:
                        live.discard(g)
            if not live:
                break
        return state
    finally:
        table.unpersist()


def _newton_local(r0, r1, dw, dwx, max_iter: int, tol: float) -> tuple[float, float, float, int]:
    beta, h, ll, step = 0.0, 0.0, 0.0, 0
    for step in range(1, max_iter + 1):
        theta = math.exp(beta)
        s0 = r0 + theta * r1
        share = theta * r1 / s0
        g, h, ll = float((dwx - dw * share).sum()), float((dw * share * (1 - share)).sum()), float(beta * dwx.sum() - (dw * np.log(s0)).sum())
        move = max(-2.0, min(2.0, g / h)) if h > 0 else 0.0
        beta += move
        if abs(move) < tol:
            break
    return beta, h, ll, step


class _Problem:
    """Rows of a Cox regression as x0..x{p-1}, t, e, w, cached for the iterations."""

    def __init__(self, df: DataFrame, spec: CohortSpec, columns: Sequence[str], ties: str):
        self.p, self.ties = len(columns), ties
        rows = df.select(F.col(spec.duration).cast("double").alias("t"), F.col(spec.event).cast("double").alias("e"), spec.w.alias("w"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)])
        self.rows = rows.na.drop().where("w > 0").persist(StorageLevel.MEMORY_AND_DISK)
        self.x = [F.col(f"x{k}") for k in range(self.p)]
        stats = self.rows.agg(*[f(c).alias(f"s{k}{n}") for k, c in enumerate(self.x) for n, f in enumerate((F.avg, F.stddev_samp, F.min, F.max))], F.approx_count_distinct("t").alias("times"), F.count(F.lit(1)).alias("n")).first()
        self.mean = np.array([stats[f"s{k}0"] for k in range(self.p)], float)
        self.scale = np.array([stats[f"s{k}1"] or 1.0 for k in range(self.p)], float)
        self.n, self.buckets = stats["n"], auto_buckets(stats["times"])
        self.reach = tuple((np.array([stats[f"s{k}{n}"] or 0.0 for k in range(self.p)], float) - self.mean) / self.scale for n in (2, 3))
        self.z = [(c - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.x, self.mean, self.scale)]

    def by_time(self, beta: np.ndarray) -> DataFrame:
        """Sums at each time, and of everyone at risk: s0, s1_i, s2_ij; of events: dw, n_events, d1_i, with e0, e1_i, e2_ij."""
        rows = self.rows.withColumns({f"z{k}": z for k, z in enumerate(self.z)})
        z = [F.col(f"z{k}") for k in range(self.p)]
        r = F.col("w") * F.exp(dot(z, beta, -safe_offset(beta, self.reach)))
        sums = {"s0": r} | {f"s1_{i}": r * z[i] for i in range(self.p)} | {f"s2_{i}_{j}": r * z[i] * z[j] for i, j in triangle(self.p)}
        events = {"dw": F.col("w") * F.col("e"), "n_events": F.col("e")} | {f"d1_{i}": F.col("w") * F.col("e") * z[i] for i in range(self.p)}
        if self.ties == "efron":
            events |= {"e" + n[1:]: c * F.col("e") for n, c in sums.items()}
        at = rows.groupBy("t").agg(*[F.sum(c).alias(n) for n, c in (sums | events).items()])
        return suffix_sum(at, [], "t", list(sums), self.buckets).where("dw > 0")

    def step(self, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, gradient and Hessian at beta (scaled columns): one job."""
        t, p = self.by_time(beta), self.p
        weight = F.col("dw")
        if self.ties == "efron":  # d terms, each with the mean event weight and a part of the tied events taken out
            t = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n_events").cast("int") - 1)))
            part = F.col("k") / F.col("n_events")
            weight = F.col("dw") / F.col("n_events")
            t = t.withColumns({"s" + n: F.col("s" + n) - part * F.col("e" + n) for n in ["0", *[f"1_{i}" for i in range(p)], *[f"2_{i}_{j}" for i, j in triangle(p)]]})
            share = 1 / F.col("n_events")
        else:
            share = F.lit(1.0)
        m = [F.col(f"s1_{i}") / F.col("s0") for i in range(p)]
        aggs = [F.sum(share * F.col(f"d1_{i}") - weight * m[i]) for i in range(p)]
        aggs += [F.sum(weight * (F.col(f"s2_{i}_{j}") / F.col("s0") - m[i] * m[j])) for i, j in triangle(p)]
        aggs += [F.sum(weight * (F.log("s0") + F.lit(safe_offset(beta, self.reach))))] + [F.sum(share * F.col(f"d1_{i}")) for i in range(p)]
        row = [0.0 if v is None else float(v) for v in t.agg(*[a.alias(f"a{k}") for k, a in enumerate(aggs)]).first()]
        q = p * (p + 1) // 2
        return float(np.dot(row[p + q + 1 :], beta)) - row[p + q], np.array(row[:p]), -symmetric(row[p : p + q], p)


def fit_cox(df: DataFrame, spec: CohortSpec, columns: Sequence[str], ties: str = "breslow", penalizer: float = 0.0, l1_ratio: float = 0.0, max_iter: int = 50, tol: float = 1e-7) -> CoxFit:
    """Weighted partial likelihood from zero on standardized columns; coefficients and Hessian are given back unscaled.

    The elastic net n * penalizer * (l1_ratio softabs + (1 - l1_ratio) / 2 beta^2) applies to the standardized
    coefficients, softabs sharpening by 1.3 an iteration. A step that lowers the objective is halved.
    """
    if ties not in ("breslow", "efron"):
        raise ValueError(f"unknown ties {ties!r}")
    problem = _Problem(df, spec, columns, ties)
    p = len(columns)

    def penalty(beta: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
        soft = [soft_abs(b, 1.3**k) for b in beta]
        scale = problem.n * penalizer
        return scale * sum(l1_ratio * s[0] + (1 - l1_ratio) / 2 * b * b for s, b in zip(soft, beta)), scale * np.array([l1_ratio * s[1] + (1 - l1_ratio) * b for s, b in zip(soft, beta)]), scale * np.diag([l1_ratio * s[2] + (1 - l1_ratio) for s in soft])

    try:
        beta, done, k, trace = np.zeros(p), False, 0, []
        ll, g, h = problem.step(beta)
        for k in range(1, max_iter + 1):
            value, slope, curve = penalty(beta, k)
            move = np.linalg.solve(h - curve, -(g - slope))
            scale = 1.0
            while True:
                new = beta + scale * move
                new_ll, new_g, new_h = problem.step(new)
                if new_ll - penalty(new, k)[0] >= ll - value - 1e-9 * abs(ll) or scale < 1e-5:
                    break
                scale /= 2
            beta, ll, g, h = new, new_ll, new_g, new_h
            trace.append((k, float(ll), float(np.linalg.norm(scale * move))))
            done = trace[-1][2] < tol
            if done:
                break
        s = problem.scale
        unscaled = h * np.outer(s, s)
        final = h - penalty(beta, k)[2] if penalizer else h
        return CoxFit(tuple(columns), beta / s, unscaled, ll + 0.0, k, done, -np.linalg.inv(final) / np.outer(s, s), ties, tuple(trace))
    finally:
        problem.rows.unpersist()


def sandwich(df: DataFrame, spec: CohortSpec, columns: Sequence[str], fit: CoxFit) -> np.ndarray:
    """Robust variance V Q V, Q the Gram matrix of the weighted score residuals, with the ties of the fit.

    With Breslow's ties running sums A = sum of dw / s0 and B = sum of dw s1 / s0^2 over event times up to a row's time turn
    the double sum over patients and event times into one join by time with a table of distinct times.

    With Efron's ties a time with m events has m terms, term k with the part k / m of the tied events taken out of the risk
    set. A and B are then sums over all terms, for those who only are at risk. The time's own events count in term k by
    1 - k / m alone, and their mean covariate is that of the m terms; both are sums by time, joined like A and B.
    """
    p, efron = len(columns), fit.ties == "efron"
    x = [F.col(f"x{k}") for k in range(p)]
    rows = df.select(F.col(spec.duration).cast("double").alias("t"), F.col(spec.event).cast("double").alias("e"), spec.w.alias("w"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)]).na.drop().persist(StorageLevel.MEMORY_AND_DISK)
    ends = rows.agg(*[f(c) for f in (F.min, F.max) for c in x]).first()
    offset = safe_offset(fit.beta, (np.array(ends[:p], float), np.array(ends[p:], float))) if p and ends[0] is not None else 0.0
    rows = rows.where("w > 0").withColumn("r", F.exp(dot(x, fit.beta, -offset)))
    try:
        w, e = F.col("w"), F.col("e")
        risk_sums = {"s0": w * F.col("r")} | {f"s1_{i}": w * F.col("r") * x[i] for i in range(p)}
        tied = {f"e{n[1:]}": c * e for n, c in risk_sums.items()} | {"n_events": e} if efron else {}
        at = rows.groupBy("t").agg(F.sum(w * e).alias("dw"), *[F.sum(c).alias(n) for n, c in (risk_sums | tied).items()])
        at, buckets = sized(at)
        risk = suffix_sum(at, [], "t", list(risk_sums), buckets)
        if efron:
            risk = _efron_terms(risk, p)
        else:
            risk = risk.withColumns({"a": F.col("dw") / F.col("s0")} | {f"b_{i}": F.col("dw") * F.col(f"s1_{i}") / (F.col("s0") * F.col("s0")) for i in range(p)} | {f"m_{i}": F.col(f"s1_{i}") / F.col("s0") for i in range(p)})
        over = {"A": F.col("a")} | {f"B_{i}": F.col(f"b_{i}") for i in range(p)}
        own = ["over_a", *[f"over_b_{i}" for i in range(p)]] if efron else []  # what the time's own events are spared of
        times = running(risk, [], "t", over, buckets=buckets).select("t", *[f"m_{i}" for i in range(p)], *over, *own)
        joined = rows.join(times, "t")
        hazard = lambda name, less: F.col(name) - e * F.col(less) if efron else F.col(name)
        phi = {f"phi{i}": w * (e * (x[i] - F.col(f"m_{i}")) - F.col("r") * (hazard("A", "over_a") * x[i] - hazard(f"B_{i}", f"over_b_{i}"))) for i in range(p)}
        scored = joined.withColumns(phi)
        row = scored.agg(*[F.sum(F.col(f"phi{i}") * F.col(f"phi{j}")).alias(f"q{k}") for k, (i, j) in enumerate(triangle(p))]).first()
        at.unpersist()
        v = fit.naive_variance
        return v @ symmetric([float(q) for q in row], p) @ v
    finally:
        rows.unpersist()


def _efron_terms(risk: DataFrame, p: int) -> DataFrame:
    """Of a table by time with s0, s1_i of those at risk and e0, e1_i of the events: the sums over the terms of hazard (a)
    and hazard by mean (b_i), the parts of these that the events are spared of, and the mean of the terms' means (m_i)."""
    term = F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_events").cast("int") - 1, F.lit(0))))
    terms = risk.withColumn("k", term).withColumn("part", F.when(F.col("n_events") > 0, F.col("k") / F.col("n_events")).otherwise(0.0))
    s0 = F.col("s0") - F.col("part") * F.col("e0")
    terms = terms.withColumns({"h": F.when(F.col("n_events") > 0, F.col("dw") / F.col("n_events") / s0).otherwise(0.0)} | {f"m{i}": (F.col(f"s1_{i}") - F.col("part") * F.col(f"e1_{i}")) / s0 for i in range(p)})
    sums = [F.sum("h").alias("a"), F.sum(F.col("h") * F.col("part")).alias("over_a")]
    for i in range(p):
        m = F.col(f"m{i}")
        sums += [F.sum(F.col("h") * m).alias(f"b_{i}"), F.sum(F.col("h") * F.col("part") * m).alias(f"over_b_{i}"), F.avg(m).alias(f"m_{i}")]
    return terms.groupBy("t").agg(*sums)
