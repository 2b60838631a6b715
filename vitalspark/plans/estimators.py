"""Estimators with fit(df) → result: external-control analysis and its baselines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..cohort import WEIGHTS, CohortSpec, ate_weight, model_columns
from ..operators.cox import SUMMARY_SCHEMA, CoxFit, fit_binary, fit_cox, sandwich, summary_rows, time_table
from ..operators.grouped import fit_coxes, fit_logits, fit_moments
from ..operators.logit import LogitModel, fit_logit
from ..operators.maic import LEAST_WEIGHT, MaicModel, fit_maic
from ..operators.resample import draw_multiplicities, draw_valid, poisson_multiplicities, replicate


@dataclass(frozen=True)
class Result:
    """Fitted outcome model, its summary table, and the scored rows."""

    fit: CoxFit
    variance: np.ndarray
    summary: DataFrame
    scored: DataFrame
    propensity: LogitModel | MaicModel | None = None
    replicates: dict[int, np.ndarray] = field(default_factory=dict)  # the coefficients of each; 0 is the data as it is


def _variance_name(name: str) -> str:
    return {"naïve": "naive", "naive": "naive", "robust": "robust", "bootstrap": "bootstrap"}[name]


class _Estimator:
    ties = "breslow"
    effect = "ATE"

    def __init__(self, spec: CohortSpec, variance: str = "naive", alpha: float = 0.05, replicates: int = 50, per_center: bool = False, sampling: str | Callable[[DataFrame], DataFrame] = "exact"):
        """sampling: exact (redrawn until every centre has two rows), poisson, or a function of the rows that gives
        (replicate from 1 on, id, multiplicity), as folds do."""
        self.spec, self.variance, self.alpha, self.replicates, self.per_center, self.sampling = spec, _variance_name(variance), alpha, replicates, per_center, sampling

    def outcome_columns(self) -> tuple[str, ...]:
        return (self.spec.treated,)

    def weigh(self, df: DataFrame) -> tuple[DataFrame, CohortSpec, object]:
        """Rows with a weight column, the spec that names it, and the weight model."""
        return df, self.spec, None

    def fit(self, df: DataFrame) -> Result:
        scored, spec, model = self.weigh(df)
        columns = self.outcome_columns()
        if columns == (spec.treated,) and self.ties == "breslow":
            fit = self._binary(scored, spec)
        else:
            fit = fit_cox(scored, spec, columns, ties=self.ties)
        boot: dict[int, np.ndarray] = {}
        if self.variance == "naive":
            v = fit.naive_variance
        elif self.variance == "robust":
            v = sandwich(scored, spec, columns, fit)
        else:
            boot = self.bootstrap(df)
            v = np.atleast_2d(np.cov(np.array([b for k, b in sorted(boot.items()) if k]).T, ddof=0))
        summary = df.sparkSession.createDataFrame(summary_rows(columns, fit.beta, v, self.alpha), SUMMARY_SCHEMA)
        return Result(fit, v, summary, scored, model, boot)

    def _binary(self, df: DataFrame, spec: CohortSpec) -> CoxFit:
        beta, info, ll, steps = fit_binary(time_table(df, spec, F.col(spec.treated)))[None]
        return CoxFit((spec.treated,), np.array([beta]), np.array([[-info]]), ll, steps, True)

    def multiplicities(self, df: DataFrame) -> DataFrame:
        if callable(self.sampling):
            return self.sampling(df)
        if self.sampling == "poisson":
            return poisson_multiplicities(df, self.spec, self.replicates)
        if self.per_center:
            return draw_multiplicities(df, self.spec, self.replicates, [self.spec.center])
        return draw_valid(df, self.spec, self.replicates) if self.spec.center in df.columns else draw_multiplicities(df, self.spec, self.replicates)

    def keep_all(self) -> str | None:
        return None

    def bootstrap(self, df: DataFrame) -> dict[int, np.ndarray]:
        """Coefficients by replicate, the weight model refitted in each; replicate 0 is the data as it is.

        Replicates share one drawn table, and each iteration of the weight model and of the outcome model is one
        aggregation for all of them: the number of jobs does not depend on the number of replicates.
        """
        spec = self.spec.weighted("boot_weight")
        boot = replicate(df, self.spec, self.multiplicities(df), self.keep_all()).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            groups = sorted(r[0] for r in boot.select("replicate").distinct().collect())  # a row a replicate
            rows, columns = self._replicate_weights(boot, groups), self.outcome_columns()
            if columns == (spec.treated,) and self.ties == "breslow":
                found = fit_binary(time_table(rows, spec, F.col(spec.treated), by=["replicate"]), by="replicate")
                return {int(k): np.array([v[0]]) for k, v in found.items()}
            return {k: b for k, (b, _) in fit_coxes(self._rows(rows), spec, "replicate", groups, columns, self.ties).items()}
        finally:
            boot.unpersist()

    def _rows(self, boot: DataFrame) -> DataFrame:
        """Replicates as the outcome model takes them: Efron's ties count rows, so there a row drawn twice is two rows."""
        if self.ties != "efron":
            return boot
        return boot.withColumn("boot_weight", F.col("boot_weight") / F.col("multiplicity")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("multiplicity").cast("int")))).drop("__copy")

    def _replicate_weights(self, rows: DataFrame, groups: Sequence[int]) -> DataFrame:
        """Rows of all replicates with their weights, `boot_weight`, times those that the replicates' own models give."""
        return rows


def _coefficients(spark: SparkSession, fits: dict, names: Sequence[str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(k, *map(float, b)) for k, (b, _) in fits.items()], "replicate int, " + ", ".join(f"{n} double" for n in names)))  # a row a replicate


class ExternalControlAnalysis(_Estimator):
    """Propensity scores, inverse-probability weights, weighted Cox model: strategies iptw, aiptw, and cox without weights."""

    def __init__(self, spec: CohortSpec, strategy: str = "iptw", effect: str = "ATE", ps: Column | None = None, propensity_columns: Sequence[str] = (), cox_columns: Sequence[str] = (), l2: float = 0.0, clip: float | None = 1e-16, ties: str = "breslow", **kwargs):
        super().__init__(spec, **kwargs)
        self.strategy, self.effect, self.ps, self.l2, self.clip, self.ties = strategy, effect, ps, l2, clip, ties
        self.propensity_columns = tuple(propensity_columns) or spec.covariates
        self.cox_columns = tuple(cox_columns)
        if effect not in WEIGHTS:
            raise ValueError(f"unknown effect {effect!r}")

    def outcome_columns(self) -> tuple[str, ...]:
        return model_columns(self.spec, self.strategy, self.cox_columns)

    def _weight(self, df: DataFrame, ps: Column) -> DataFrame:
        ps = ps if self.clip is None else F.least(F.greatest(ps, F.lit(float(self.clip))), F.lit(1 - float(self.clip)))
        scored = df.withColumn("propensity", ps)
        weight = ate_weight(self.spec.treated, F.col("propensity"), None) if self.effect == "ATE" else WEIGHTS[self.effect](self.spec.treated, F.col("propensity"))
        return scored.withColumn("iptw", weight)

    def weigh(self, df: DataFrame) -> tuple[DataFrame, CohortSpec, object]:
        if self.strategy == "cox":
            return df, self.spec, None
        model = None if self.ps is not None else fit_logit(df, self.propensity_columns, self.spec.treated, self.spec.w if self.spec.weight else None, self.l2)
        scored = self._weight(df, self.ps if model is None else model.probability())
        if self.spec.weight:
            scored = scored.withColumn("iptw", F.col("iptw") * self.spec.w)
        return scored, self.spec.weighted("iptw"), model

    def _replicate_weights(self, rows: DataFrame, groups: Sequence[int]) -> DataFrame:
        if self.strategy == "cox":
            return rows
        ps = self.ps
        if ps is None:
            fits = fit_logits(rows, "replicate", groups, self.propensity_columns, self.spec.treated, F.col("boot_weight"), self.l2)
            names = [f"__b{k}" for k in range(len(self.propensity_columns) + 1)]
            rows = rows.join(_coefficients(rows.sparkSession, fits, names), "replicate")
            eta = sum((F.col(n) * F.col(c).cast("double") for n, c in zip(names[1:], self.propensity_columns)), F.col(names[0]))
            ps = 1 / (1 + F.exp(-eta))
            scored = self._weight(rows, ps).drop(*names)
        else:
            scored = self._weight(rows, ps)
        return scored.withColumn("boot_weight", F.col("boot_weight") * F.col("iptw")).drop("iptw", "propensity")


class PooledIPTW(ExternalControlAnalysis):
    """The pooled baseline: Efron ties unless told otherwise."""

    def __init__(self, spec: CohortSpec, effect: str = "ATE", ties: str = "efron", **kwargs):
        super().__init__(spec, "iptw", effect, ties=ties, **kwargs)


class MatchingAdjusted(_Estimator):
    """Moment-matched weights for treated rows, then a weighted Cox model; only treated rows are resampled."""

    def __init__(self, spec: CohortSpec, ties: str = "efron", **kwargs):
        super().__init__(spec, **kwargs)
        self.ties = ties

    def weigh(self, df: DataFrame) -> tuple[DataFrame, CohortSpec, object]:
        model = fit_maic(df, self.spec.treated, self.spec.covariates)
        return df.withColumn("maic", model.weight(self.spec.treated)), self.spec.weighted("maic"), model

    def keep_all(self) -> str | None:
        return f"{self.spec.treated} = 0"

    def _replicate_weights(self, rows: DataFrame, groups: Sequence[int]) -> DataFrame:
        scored, fits = fit_moments(rows, "replicate", groups, self.spec.treated, self.spec.covariates, F.col("boot_weight"))
        p = len(next(iter(fits.values()))[0])
        names = [f"__b{k}" for k in range(p)]
        own = F.exp(sum((F.col(n) * F.col(f"x{k}") for k, n in enumerate(names[1:], 1)), F.col(names[0]) * F.col("x0")))
        weight = F.when(F.col(self.spec.treated) == 1, F.when(own <= 0, LEAST_WEIGHT).otherwise(own)).otherwise(1.0)
        scored = scored.join(_coefficients(rows.sparkSession, fits, names), "replicate")
        return scored.withColumn("boot_weight", F.col("boot_weight") * weight).drop(*names, *[f"x{k}" for k in range(p)])


class NaiveComparison(_Estimator):
    """Unweighted Cox model on the treatment."""

    def __init__(self, spec: CohortSpec, ties: str = "efron", **kwargs):
        super().__init__(spec, **kwargs)
        self.ties = ties


class CovariateAdjusted(_Estimator):
    """Unweighted Cox model on the treatment and the covariates."""

    def __init__(self, spec: CohortSpec, ties: str = "efron", **kwargs):
        super().__init__(spec, **kwargs)
        self.ties = ties

    def outcome_columns(self) -> tuple[str, ...]:
        return (self.spec.treated, *self.spec.covariates)


ESTIMATORS = {"eca": ExternalControlAnalysis, "pooled_iptw": PooledIPTW, "maic": MatchingAdjusted, "naive": NaiveComparison, "adjusted": CovariateAdjusted}
