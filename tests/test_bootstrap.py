"""Bootstrap of whole estimators: every replicate equals a fit of its own rows, whatever the estimator."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.cohort import CohortSpec
from vitalspark.operators import resample
from vitalspark.operators.cox import fit_cox
from vitalspark.operators.grouped import fit_coxes
from vitalspark.operators.resample import draw_multiplicities, draw_valid, fold_multiplicities, poisson_multiplicities, replicate
from vitalspark.plans.estimators import CovariateAdjusted, ExternalControlAnalysis, MatchingAdjusted, NaiveComparison, PooledIPTW

SPEC = CohortSpec(covariates=("x1", "x2"))


@pytest.fixture(scope="module")
def tied(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(160):
        x1, x2 = rng.normal(), rng.normal()
        t = int(rng.random() < 1 / (1 + math.exp(-0.5 * x1)))
        time = float(math.ceil(8 * rng.exponential() * math.exp(-0.4 * t - 0.3 * x1)))
        rows.append((k, f"c{k % 3}", time, int(rng.random() < 0.8), t, x1, x2))
    return spark.createDataFrame(rows, "patient_id long, center string, time double, event int, treated int, x1 double, x2 double").persist()


ESTIMATORS = {
    "eca": lambda **kw: ExternalControlAnalysis(SPEC, **kw), "att": lambda **kw: ExternalControlAnalysis(SPEC, effect="ATT", **kw), "aiptw": lambda **kw: ExternalControlAnalysis(SPEC, strategy="aiptw", cox_columns=["x1"], **kw),
    "pooled": lambda **kw: PooledIPTW(SPEC, **kw), "adjusted": lambda **kw: CovariateAdjusted(SPEC, **kw), "naive": lambda **kw: NaiveComparison(SPEC, **kw), "maic": lambda **kw: MatchingAdjusted(SPEC, **kw),
}


@pytest.mark.parametrize("name", ESTIMATORS)
def test_replicates_equal_fits_of_their_rows(tied, name):
    make = ESTIMATORS[name]
    own = make(variance="bootstrap", replicates=3)
    result = own.fit(tied)
    assert set(result.replicates) == {0, 1, 2, 3}
    assert np.allclose(result.replicates[0], result.fit.beta, atol=1e-6)
    boot = np.array([result.replicates[k] for k in (1, 2, 3)])
    assert np.allclose(result.variance, np.cov(boot.T, ddof=0).reshape(result.variance.shape))
    assert result.variance.shape == (len(result.fit.beta),) * 2
    rows = replicate(tied, SPEC, own.multiplicities(tied), own.keep_all()).where("replicate = 2")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("multiplicity").cast("int")))).drop("replicate", "boot_weight", "multiplicity")
    assert np.allclose(make().fit(copies).fit.beta, result.replicates[2], atol=1e-5)


def test_jobs_do_not_grow_with_replicates(spark, tied):
    def jobs(n):
        before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
        ExternalControlAnalysis(SPEC, strategy="aiptw", variance="bootstrap", replicates=n).fit(tied)
        return spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before

    assert jobs(12) <= jobs(3) + 25


def test_clip_bounds_the_weights(tied):
    fit = lambda clip: ExternalControlAnalysis(SPEC, ps=F.lit(1e-6), clip=clip).fit(tied).scored.agg(F.max("iptw")).first()[0]
    assert fit(0.01) == pytest.approx(100) and fit(None) == pytest.approx(1e6) and fit(1e-16) == pytest.approx(1e6)


def test_invalid_replicates_are_drawn_anew(spark):
    rows = [(k, "big" if k >= 3 else "small", 1.0 + k, 1, k % 2, 0.0, 0.0) for k in range(30)]
    df = spark.createDataFrame(rows, "patient_id long, center string, time double, event int, treated int, x1 double, x2 double")
    drawn = draw_valid(df, SPEC, 12)
    per = drawn.join(df, "patient_id").groupBy("replicate", "center").agg(F.sum("multiplicity").alias("n")).collect()
    assert len(per) == 24 and min(r["n"] for r in per) >= 2
    assert all(r[0] == 30 for r in drawn.groupBy("replicate").agg(F.sum("multiplicity")).select("sum(multiplicity)").collect())
    plain = draw_multiplicities(df, SPEC, 12).join(df, "patient_id").groupBy("replicate", "center").agg(F.sum("multiplicity").alias("n")).where("center = 'small' and n >= 2").count()
    assert plain < 12  # some needed another draw
    with pytest.raises(ValueError):
        draw_valid(df.withColumn("center", F.col("patient_id").cast("string")), SPEC, 1, least=20)


def test_draws_are_uniform(spark):
    df = spark.range(2000).select(F.col("id").alias("patient_id"))
    m = draw_multiplicities(df, SPEC, 20).groupBy("multiplicity").count().collect()
    share = {r["multiplicity"]: r["count"] / 40_000 for r in m}
    assert all(abs(share[k] - math.exp(-1) / math.factorial(k)) < 0.01 for k in (1, 2, 3)) and max(share) > 5
    p = poisson_multiplicities(df, SPEC, 20).agg(F.sum("multiplicity") / 40_000, F.sum(F.col("multiplicity") * F.col("multiplicity")) / 40_000).first()
    assert abs(p[0] - 1) < 0.02 and abs(p[1] - 2) < 0.06


def test_folds_are_replicates(spark, tied):
    folds = fold_multiplicities(tied, SPEC, 4, repeats=2)
    left_out = {r["patient_id"]: r["n"] for r in folds.groupBy("patient_id").count().withColumnRenamed("count", "n").collect()}
    assert set(left_out.values()) == {6} and folds.select("replicate").distinct().count() == 8  # 3 of 4 folds, twice
    result = ExternalControlAnalysis(SPEC, variance="bootstrap", sampling=lambda df: fold_multiplicities(df, SPEC, 4)).fit(tied)
    assert set(result.replicates) == set(range(5))


def test_large_predictors_do_not_overflow(spark):
    df = spark.createDataFrame([(k, float(k % 40) + 1, 1, k % 2, 1e5 * (k % 7), 0.0, "c") for k in range(200)], "patient_id long, time double, event int, treated int, x1 double, x2 double, center string")
    fit = fit_cox(df, SPEC, ["x1"])
    assert np.isfinite(fit.beta).all()
    from vitalspark.operators.cox import _Problem

    big = _Problem(df, SPEC, ["x1"], "breslow")
    ll, g, h = big.step(np.array([900.0]))
    assert np.isfinite([ll, *g, *h.ravel()]).all()
    assert set(fit_coxes(df.withColumn("g", F.lit(1)), SPEC, "g", [1], ["x1"])) == {1}


def test_two_levels_on_more_than_a_million_times(spark, monkeypatch):
    from vitalspark.operators import scan
    from vitalspark.operators.km import kaplan_meier

    df = spark.range(1_200_000).select(F.col("id").alias("patient_id"), (F.col("id") * 7919 % 1_200_007).cast("double").alias("time"), (F.col("id") % 3 > 0).cast("int").alias("event"), (F.col("id") % 2).cast("int").alias("treated"))
    two = kaplan_meier(df, SPEC).where("time % 1000 < 1").select("treated", "time", "survival", "at_risk")
    plan = two._jdf.queryExecution().optimizedPlan().toString()
    assert "__b" in plan
    one = kaplan_meier(df, SPEC, buckets=1).where("time % 1000 < 1").select("treated", "time", F.col("survival").alias("s"), F.col("at_risk").alias("n"))
    off = two.join(one, ["treated", "time"]).agg(F.count("*"), F.max(F.abs(F.col("survival") - F.col("s"))), F.max(F.abs(F.col("at_risk") - F.col("n")))).first()
    assert off[0] == two.count() > 1000 and off[1] < 1e-9 and off[2] == 0
    assert scan.auto_buckets(1_000_000) == 1


def test_sampling_names(spark, tied):
    poisson = ExternalControlAnalysis(SPEC, variance="bootstrap", replicates=3, sampling="poisson").fit(tied)
    assert set(poisson.replicates) == {0, 1, 2, 3} and resample.MAX_ATTEMPTS > 1


@pytest.mark.parametrize("by", [[], ["center"]])
def test_packed_multiplicities_are_those_of_rows(spark, by):
    rows = spark.createDataFrame([(k, "ab"[k % 3 > 1], float(k % 7), k % 2, k % 3 % 2) for k in range(300)], "patient_id long, center string, time double, event int, treated int")
    spec = CohortSpec()
    unpack = lambda df: {(r["patient_id"], k + 1): m for r in df.collect() for k, m in enumerate(r["multiplicities"]) if m}
    flat = lambda df: {(r["patient_id"], r["replicate"]): r["multiplicity"] for r in df.collect()}
    assert unpack(resample.draws_packed(rows, spec, 6, by)) == flat(resample.draw_multiplicities(rows, spec, 6, by))
    poisson = resample.poisson_packed(rows, spec, 6)
    assert poisson.columns == [*rows.columns, "multiplicities"] and unpack(poisson) == flat(resample.poisson_multiplicities(rows, spec, 6))


def test_packed_sums_by_time_equal_grouped_ones_whatever_is_held(spark):
    rows = spark.createDataFrame([(k, float(k % 11) if k % 50 else None, k % 2, float(k)) for k in range(400)], "patient_id long, time double, event int, v double")
    spec = CohortSpec()
    packed = resample.poisson_packed(rows, spec, 5)
    flat = rows.join(resample.poisson_multiplicities(rows, spec, 5), "patient_id").where("time is not null").groupBy("replicate", "time").agg(F.sum(F.col("multiplicity") * F.col("v")).alias("a"), F.sum(F.col("multiplicity") * F.col("event")).cast("double").alias("b"))
    want = sorted(map(tuple, flat.collect()))
    for flush in (1, 4 << 20):
        got = resample.packed_time_sums(packed.repartition(3), spec, {"a": F.col("v"), "b": F.col("event")}, 5, flush=flush)
        assert np.allclose(sorted(map(tuple, got.collect())), want)


def test_mean_of_a_metric_over_replicates(spark):
    rows = spark.createDataFrame([(k, float(k)) for k in range(40)], "patient_id long, v double")
    spec = CohortSpec()
    draws = resample.draw_multiplicities(rows, spec, 7)
    boot = resample.replicate(rows, spec, draws)
    metric = lambda df, by: df.groupBy(*by).agg((F.sum(F.col("multiplicity") * F.col("v")) / F.sum("multiplicity")).alias("m"))
    drawn = draws.toPandas()
    want = drawn.assign(v=drawn["multiplicity"] * drawn["patient_id"]).groupby("replicate").agg({"v": "sum", "multiplicity": "sum"}).eval("v / multiplicity").mean()
    assert resample.bootstrap_metric(boot, metric, "m").first()[0] == pytest.approx(want)


def test_packed_draws_read_their_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(300).select(F.col("id").alias("patient_id"), (F.col("id") % 7).cast("double").alias("time"))
    packed = resample.draws_packed(df.mapInArrow(seen, df.schema), CohortSpec(), 9)
    got = [(r["patient_id"], k + 1, m) for r in packed.collect() for k, m in enumerate(r["multiplicities"]) if m]
    assert read.value == 300  # it was read for sizes, cuts, ranks and rows
    want = resample.draw_multiplicities(df, CohortSpec(), 9).collect()
    assert sorted(got) == sorted((r["patient_id"], r["replicate"], r["multiplicity"]) for r in want)
