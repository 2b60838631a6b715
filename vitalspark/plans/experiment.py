"""One simulated experiment: data, every estimator, balance and effective sample size, as one result row a method."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cohort import CohortSpec
from ..operators.moments import effective_sample_size, smd
from ..operators.report import to_prefixed_row
from ..operators.simulate import CoxSimulator
from .estimators import ESTIMATORS


def single_experiment(spark: SparkSession, simulator: CoxSimulator, methods: Sequence[str] = ("eca", "pooled_iptw", "maic", "naive", "adjusted"), rep_id: int = 0, variance: str = "naive") -> DataFrame:
    """(method, rep_id, coef, se, p, ess, smd_weighted_* ..., fit_time) rows."""
    covariates = tuple(f"X_{i}" for i in range(simulator.p))
    spec = CohortSpec(treated="treatment", covariates=covariates)
    df = simulator.generate(spark).withColumn("center", F.lit("c0")).persist()
    out = None
    try:
        for method in methods:
            began = time.time()
            result = ESTIMATORS[method](spec, variance=variance).fit(df)
            took = time.time() - began
            weight = next((c for c in ("iptw", "maic") if c in result.scored.columns), None)
            weighted = result.scored if weight else result.scored.withColumn("one", F.lit(1.0))
            own = spec.weighted(weight or "one")
            balance = to_prefixed_row(smd(weighted, own, covariates), "covariate", "smd_weighted", "smd_weighted_", covariates)
            size = effective_sample_size(weighted, F.col(own.weight))
            row = result.summary.where(F.col("covariate") == spec.treated).select(F.lit(method).alias("method"), F.lit(rep_id).alias("rep_id"), "coef", "exp_coef", "se", "p").crossJoin(size).crossJoin(balance).withColumn("fit_time", F.lit(took))
            out = row if out is None else out.unionByName(row)
        return spark.createDataFrame(out.collect(), out.schema)  # a row a method
    finally:
        df.unpersist()


def experiment_grid(spark: SparkSession, base: CoxSimulator, values: dict[str, Sequence], repetitions: int, **kwargs) -> DataFrame:
    """single_experiment for each point of a grid and each repetition, with the point's parameters as columns."""
    from dataclasses import replace
    from itertools import product

    out = None
    for point in product(*values.values()):
        for rep in range(repetitions):
            named = dict(zip(values, point, strict=True))
            rows = single_experiment(spark, replace(base, **named, seed=base.seed + rep), rep_id=rep, **kwargs)
            rows = rows.withColumns({k: F.lit(v) for k, v in named.items()})
            out = rows if out is None else out.unionByName(rows)
    return out
