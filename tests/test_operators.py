"""Operators on tiny frames with closed-form answers, invariants, and numpy oracles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.cohort import CohortSpec, bucket_rank, covariates_of, in_order, model_columns, prepare, split_by, split_uniform, violations, zscore
from vitalspark.functions.stats import normal_quantile, soft_abs, two_sided_p, two_sided_p_column
from vitalspark.operators import etl, report
from vitalspark.operators.cox import fit_binary, fit_cox, sandwich, time_table
from vitalspark.operators.km import event_table, kaplan_meier, on_grid, with_confidence
from vitalspark.operators.logit import fit_logit
from vitalspark.operators.maic import fit_maic
from vitalspark.operators.metrics import concordance
from vitalspark.operators.moments import arm_moments, centred_from_raw, effective_sample_size, raw_moment, smd
from vitalspark.operators.newton import weighted_sums
from vitalspark.operators.privacy import PrivateState, fit_private_logit, noise_multiplier, spent_epsilon
from vitalspark.operators.resample import bootstrap_variance, draw_multiplicities, poisson_multiplicities, replicate
from vitalspark.operators.scan import running, suffix_sum
from vitalspark.operators.simulate import CoxSimulator, with_categoricals
from vitalspark.plans.estimators import CovariateAdjusted, ExternalControlAnalysis, MatchingAdjusted, NaiveComparison, PooledIPTW

SPEC = CohortSpec(covariates=("x1", "x2"))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 240
    x1, x2 = rng.normal(size=n), rng.integers(0, 2, n).astype(float)
    treated = (rng.random(n) < 1 / (1 + np.exp(-0.8 * x1))).astype(int)
    time = np.ceil(rng.exponential(np.exp(-0.5 * x1 - 0.7 * treated)) * 10)
    event = (rng.random(n) < 0.8).astype(int)
    rows = [(k, f"c{k % 3}", float(t), int(e), int(a), float(u), float(v), float(w)) for k, (t, e, a, u, v, w) in enumerate(zip(time, event, treated, x1, x2, rng.random(n) + 0.5))]
    df = spark.createDataFrame(rows, "patient_id long, center string, time double, event int, treated int, x1 double, x2 double, w double").persist()
    return df, (time, event, treated, x1, x2, np.array([r[-1] for r in rows]))


def hand(spark):
    rows = [(0.0, 1), (3.2, 1), (3.2, 0), (5.5, 1), (5.5, 1), (10.0, 0)]
    return spark.createDataFrame([(k, "c", t, e, 0) for k, (t, e) in enumerate(rows)], "patient_id long, center string, time double, event int, treated int")


def test_event_table_by_hand(spark):
    for df in (hand(spark), hand(spark).orderBy(F.desc("patient_id"))):
        got = [tuple(r) for r in event_table(df, CohortSpec()).orderBy("time").collect()]
        assert got == [(0.0, 6.0, 1.0), (3.2, 5.0, 1.0), (5.5, 3.0, 2.0), (10.0, 1.0, 0.0)]


def test_curve_by_hand(spark):
    got = [r["survival"] for r in kaplan_meier(hand(spark), CohortSpec(), []).orderBy("time").collect()]
    assert got == pytest.approx([5 / 6, 5 / 6 * 4 / 5, 5 / 6 * 4 / 5 / 3, 5 / 6 * 4 / 5 / 3])


def test_curve_that_reaches_zero_has_no_variance(spark):
    df = spark.createDataFrame([(1, "c", 1.0, 1, 0), (2, "c", 2.0, 1, 0)], "patient_id long, center string, time double, event int, treated int")
    rows = with_confidence(kaplan_meier(df, CohortSpec())).orderBy("time").collect()
    assert rows[1]["survival"] == 0 and rows[1]["var_survival"] is None and rows[1]["ci_low"] is None


def test_step_evaluation(spark):
    grid = spark.createDataFrame([(-1.0,), (0.0,), (4.0,), (99.0,)], "time double")
    got = {r["time"]: r["survival"] for r in on_grid(kaplan_meier(hand(spark), CohortSpec(), []), grid).collect()}
    assert got == pytest.approx({-1.0: 1.0, 0.0: 5 / 6, 4.0: 2 / 3, 99.0: 2 / 9})


def test_two_level_scan_equals_one_level(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.pmod(F.col("id") * 37, F.lit(101)).cast("double").alias("t"), (F.col("id") % 7 + 1.0).alias("v"))
    for down in (False, True):
        one = running(df, ["k"], "t", {"s": F.col("v")}, {"p": 1 - F.col("v") / 100}, down).orderBy("k", "t", "v").collect()
        two = running(df, ["k"], "t", {"s": F.col("v")}, {"p": 1 - F.col("v") / 100}, down, buckets=7).orderBy("k", "t", "v").collect()
        assert [r["s"] for r in one] == pytest.approx([r["s"] for r in two]) and [r["p"] for r in one] == pytest.approx([r["p"] for r in two])
    assert suffix_sum(df.limit(0), ["k"], "t", ["v"]).count() == 0


def test_moments_and_smd(spark, data):
    df, (_, _, a, x1, x2, w) = data
    spec = SPEC.weighted("w")
    got = {(r["treated"], r["covariate"]): r for r in arm_moments(df, spec, ["x1", "x2"]).collect()}
    for arm in (0, 1):
        own = x1[a == arm]
        assert got[arm, "x1"]["mean"] == pytest.approx(own.mean()) and got[arm, "x1"]["var"] == pytest.approx(own.var())
        assert got[arm, "x1"]["w_mean"] == pytest.approx(np.average(own, weights=w[a == arm]))
    ref = (x1[a == 1].mean() - x1[a == 0].mean()) / math.sqrt((x1[a == 1].var() + x1[a == 0].var()) / 2)
    out = {r["covariate"]: r for r in smd(df, spec, ["x1", "x2"]).collect()}
    assert out["x1"]["smd_raw"] == pytest.approx(ref)
    pct = {r["covariate"]: r for r in smd(df, SPEC, ["x1", "x2"], ddof=1, scale=100, binary=True).collect()}
    p, q = x2[a == 1].mean(), x2[a == 0].mean()
    assert pct["x2"]["smd_raw"] == pytest.approx(100 * (p - q) / math.sqrt((p * (1 - p) + q * (1 - q)) / 2))
    third = df.agg(*[raw_moment(F.col("x1"), F.lit(1.0), k).alias(f"m{k}") for k in (1, 2, 3)]).select(centred_from_raw([F.col("m1"), F.col("m2"), F.col("m3")], 3).alias("v")).first()["v"]
    assert third == pytest.approx(((x1 - x1.mean()) ** 3).mean())
    assert effective_sample_size(df, F.lit(0.0)).first()["ess"] == 0 and effective_sample_size(df, F.lit(2.0)).first()["ess"] == len(x1)


def test_moments_skip_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, 4.0), (0, 1.0)], "treated int, x1 double")
    got = {r["treated"]: r for r in arm_moments(df, CohortSpec(), ["x1"]).collect()}
    assert got[1]["n"] == 1 and got[1]["w_mean"] == 4


def nll(beta, t, e, x, w, ties="breslow"):
    r = w * np.exp(x @ beta)
    out = 0.0
    for u in np.unique(t[e == 1]):
        dead = (t == u) & (e == 1)
        s0, d = r[t >= u].sum(), int(dead.sum())
        if ties == "breslow":
            out += (w[dead] * (x[dead] @ beta)).sum() - w[dead].sum() * math.log(s0)
        else:
            out += (w[dead] * (x[dead] @ beta)).sum() - w[dead].mean() * sum(math.log(s0 - k / d * r[dead].sum()) for k in range(d))
    return -out


def slope(f, b, h=1e-5):
    return np.array([(f(b + h * v) - f(b - h * v)) / (2 * h) for v in np.eye(len(b))])


@pytest.mark.parametrize("ties", ["breslow", "efron"])
def test_cox_is_at_the_optimum(data, ties):
    df, (t, e, a, x1, x2, w) = data
    spec = SPEC.weighted("w")
    fit = fit_cox(df, spec, ["treated", "x1"], ties=ties)
    x = np.stack([a, x1], 1).astype(float)
    f = lambda b: nll(b, t, e, x, w, ties)
    assert fit.converged and abs(slope(f, fit.beta)).max() < 1e-3
    h = np.array([slope(lambda b: slope(f, b)[k], fit.beta, 1e-3) for k in range(2)])
    assert np.allclose(-fit.hessian, h, rtol=1e-2)


def test_binary_form_equals_general_form_and_centres_do_not_matter(data):
    df, _ = data
    general = fit_cox(df, SPEC, ["treated"])
    beta, info, _, _ = fit_binary(time_table(df, SPEC, F.col("treated")))[None]
    assert beta == pytest.approx(float(general.beta[0]), abs=1e-7) and info == pytest.approx(-float(general.hessian[0, 0]), rel=1e-6)
    moved = df.withColumn("center", F.lit("other")).orderBy(F.rand(1))
    assert fit_binary(time_table(moved, SPEC, F.col("treated")))[None][0] == pytest.approx(beta, abs=1e-9)


def test_large_time_tables_iterate_in_spark(data, monkeypatch):
    from vitalspark.operators import cox

    df, _ = data
    table = time_table(df, SPEC, F.col("treated"), by=["center"])
    here = fit_binary(table, by="center")
    monkeypatch.setattr(cox, "DRIVER_ROWS", 0)
    there = fit_binary(table, by="center")
    assert all(here[c][0] == pytest.approx(there[c][0], abs=1e-8) for c in here)


def test_sandwich_equals_brute_force(data):
    df, (t, e, a, x1, _, w) = data
    spec = SPEC.weighted("w")
    fit = fit_cox(df, spec, ["treated", "x1"])
    x = np.stack([a, x1], 1).astype(float)
    r = np.exp(x @ fit.beta)
    phi = np.zeros_like(x)
    for i in range(len(t)):
        at = t >= t[i]
        phi[i] += e[i] * (x[i] - (w[at] * r[at]) @ x[at] / (w[at] * r[at]).sum())
        for j in np.flatnonzero((e == 1) & (t <= t[i])):
            at = t >= t[j]
            s0, s1 = (w[at] * r[at]).sum(), (w[at] * r[at]) @ x[at]
            phi[i] -= w[j] / s0 * r[i] * (x[i] - s1 / s0)
    phi *= w[:, None]
    v = np.linalg.inv(-fit.hessian)
    assert np.allclose(sandwich(df, spec, ["treated", "x1"], fit), v @ (phi.T @ phi) @ v, rtol=1e-6)


@pytest.mark.parametrize("distinct", [3, 8, 10_000])
def test_sandwich_of_tied_events_equals_brute_force(spark, distinct):
    """Efron's residuals, term by term of each tied time, with few, some and no ties."""
    rng = np.random.default_rng(distinct)
    n = 120
    t, e, w = np.ceil(rng.random(n) * distinct), (rng.random(n) < 0.6).astype(int), rng.uniform(0.3, 3, n)
    x = np.stack([rng.integers(0, 2, n), rng.standard_normal(n)], 1).astype(float)
    rows = [(int(k), float(a), int(b), float(c), *map(float, v)) for k, (a, b, c, v) in enumerate(zip(t, e, w, x))]
    df = spark.createDataFrame([*rows, (900, 1.0, 1, 0.0, 1.0, 1.0), (901, None, 1, 1.0, 1.0, 1.0)], "patient_id long, time double, event int, w double, x0 double, x1 double")
    spec = CohortSpec().weighted("w")
    fit = fit_cox(df, spec, ["x0", "x1"], ties="efron")
    r, phi = np.exp(x @ fit.beta), np.zeros_like(x)
    for time in np.unique(t[e == 1]):
        risk, tied = t >= time, (t == time) & (e == 1)
        m, dw = tied.sum(), w[tied].sum()
        for k in range(m):
            left = w * r * np.where(tied, 1 - k / m, risk)  # tied ones count by their part in this term
            mean, hazard = left @ x / left.sum(), dw / m / left.sum()
            phi -= (r * np.where(tied, 1 - k / m, risk) * hazard)[:, None] * (x - mean)
            phi += (tied / m)[:, None] * (x - mean)
    phi *= w[:, None]
    v = np.linalg.inv(-fit.hessian)
    assert np.allclose(sandwich(df, spec, ["x0", "x1"], fit), v @ (phi.T @ phi) @ v, rtol=1e-6)


def test_elastic_net_shrinks(data):
    df, _ = data
    free, held = fit_cox(df, SPEC, ["treated", "x1"]), fit_cox(df, SPEC, ["treated", "x1"], penalizer=0.5, l1_ratio=0.0)
    assert np.abs(held.beta).sum() < np.abs(free.beta).sum()


def test_logit_gradient_is_zero_and_separation_is_reported(spark, data):
    df, (_, _, a, x1, x2, _) = data
    m = fit_logit(df, ["x1", "x2"], "treated")
    x = np.stack([np.ones_like(x1), x1, x2], 1)
    assert m.converged and abs(x.T @ (a - 1 / (1 + np.exp(-x @ np.array(m.coef))))).max() < 1e-6
    split = spark.createDataFrame([(float(k), int(k > 5)) for k in range(12)], "x1 double, treated int")
    assert not fit_logit(split, ["x1"], "treated", max_iter=15).converged


def test_wide_gram_equals_generated_sums(data, monkeypatch):
    from vitalspark.operators import newton

    df, _ = data
    x = [F.col("x1"), F.col("x2")]
    a = weighted_sums(df, x, F.col("w"), F.col("w"), [F.col("w")])
    monkeypatch.setattr(newton, "WIDE", 1)
    b = weighted_sums(df, x, F.col("w"), F.col("w"), [F.col("w")])
    assert all(np.allclose(p, q) for p, q in zip(a, b))


def test_maic_matches_targets(data):
    df, (_, _, a, x1, _, _) = data
    w = np.array([r[0] for r in df.where("treated = 1").orderBy("patient_id").select(fit_maic(df, "treated", ["x1"]).weight("treated")).collect()])
    own = x1[a == 1]
    assert np.average(own, weights=w) == pytest.approx(x1[a == 0].mean(), abs=1e-6)
    assert np.average(own**2, weights=w) == pytest.approx(x1[a == 0].mean() ** 2 + x1[a == 0].std(ddof=1) ** 2, abs=1e-6)


def test_concordance_equals_pairs(data):
    df, (t, e, _, x1, _, _) = data
    for name, s in (("x1", x1), ("r", np.round(x1))):
        conc = tied = pairs = 0
        for i in range(len(t)):
            for j in range(len(t)):
                if i != j and e[i] and (t[j] > t[i] or (t[j] == t[i] and not e[j])):
                    pairs += 1
                    conc += s[j] > s[i]
                    tied += s[j] == s[i]
        got = concordance(df.withColumn("r", F.rint("x1")), "time", "event", name).first()
        assert (got["concordant"], got["tied"], got["comparable"]) == (conc, tied, pairs)


def test_bootstrap(spark, data):
    df, _ = data
    m = draw_multiplicities(df, SPEC, 3, ["center"])
    assert {r["n"] for r in m.groupBy("replicate").agg(F.sum("multiplicity").alias("n")).collect()} == {240}
    boot = replicate(df, SPEC, m)
    assert boot.where("replicate = 0").count() == 240
    found = fit_binary(time_table(boot, SPEC.weighted("boot_weight"), F.col("treated"), by=["replicate"]), by="replicate")
    assert found[0][0] == pytest.approx(fit_binary(time_table(df, SPEC, F.col("treated")))[None][0])
    alone = boot.where("replicate = 2")
    assert found[2][0] == pytest.approx(fit_binary(time_table(alone, SPEC.weighted("boot_weight"), F.col("treated")))[None][0])
    mean = poisson_multiplicities(df, SPEC, 20).agg(F.sum("multiplicity")).first()[0] / (20 * 240)
    assert mean == pytest.approx(1, abs=0.1)
    rows = bootstrap_variance(spark.createDataFrame([(0, 9.0), (1, 1.0), (2, 3.0)], "replicate int, b double"), ["b"]).first()
    assert rows["std_b"] == 1.0


def test_estimators(data):
    df, _ = data
    ate = ExternalControlAnalysis(SPEC, variance="robust").fit(df)
    pooled = PooledIPTW(SPEC, ties="breslow").fit(df)
    assert float(ate.fit.beta[0]) == pytest.approx(float(pooled.fit.beta[0]), rel=1e-6)
    boot = ExternalControlAnalysis(SPEC, ps=F.lit(0.5), variance="bootstrap", replicates=4, per_center=True).fit(df)
    assert set(boot.replicates) == set(range(5)) and boot.variance[0, 0] > 0
    assert NaiveComparison(SPEC, variance="naïve").fit(df).summary.count() == 1
    assert CovariateAdjusted(SPEC).fit(df).summary.count() == 3
    assert MatchingAdjusted(SPEC).fit(df).summary.first()["se"] > 0
    with pytest.raises(ValueError):
        ExternalControlAnalysis(SPEC, effect="ATX")


def test_cohort_tools(spark, data):
    df, (_, _, _, x1, _, _) = data
    assert covariates_of(df, SPEC, ["w"]) == ("x1", "x2")
    with pytest.raises(ValueError):
        covariates_of(df.withColumn("s", F.lit("a")), SPEC)
    assert model_columns(SPEC, "iptw") == ("treated",) and model_columns(SPEC, "aiptw", ["x1"]) == ("treated", "x1") and model_columns(SPEC, "cox") == ("x1", "x2")
    bad = spark.createDataFrame([(1.0, 2, 1, float("nan"), 0.0), (-1.0, 1, 5, 1.0, 0.0), (None, 0, 0, 1.0, 0.0)], "time double, event int, treated int, x1 double, x2 double")
    row = violations(prepare(bad, SPEC), SPEC).first()
    assert (row["bad_event"], row["bad_treated"], row["nonpositive_event_time"], row["missing_time"], row["missing_covariate"]) == (1, 1, 1, 1, 1)
    z = np.array([r[0] for r in zscore(df, ["x1"]).orderBy("patient_id").select("x1").collect()])
    assert np.allclose(z, (x1 - x1.mean()) / x1.std(ddof=1))
    ranks = sorted(r["rank"] for r in bucket_rank(df, "patient_id", 5).collect())
    assert ranks == list(range(240))
    sizes = [r["count"] for r in split_uniform(df, 7, F.col("patient_id"), "site").groupBy("site").count().orderBy("site").collect()]
    assert sizes == [35] * 6 + [30]
    with pytest.raises(ValueError):
        split_by(df, lambda d: F.when(F.col("x1") > 0, 1))


def test_stats(spark):
    assert normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert two_sided_p(1.959963984540054) == pytest.approx(0.05)
    value, d, d2 = soft_abs(0.7, 5.0)
    h = 1e-5
    assert d == pytest.approx((soft_abs(0.7 + h, 5.0)[0] - soft_abs(0.7 - h, 5.0)[0]) / (2 * h), rel=1e-6)
    assert d2 == pytest.approx((soft_abs(0.7 + h, 5.0)[1] - soft_abs(0.7 - h, 5.0)[1]) / (2 * h), rel=1e-6)
    assert spark.createDataFrame([(0.0,)], "z double").select(two_sided_p_column("z")).first()[0] == 1.0


def test_privacy_accountant():
    noise = noise_multiplier(1.0, 0.01, 0.1, 100)
    assert spent_epsilon(0.1, noise, 100, 0.01) <= 1.0 < spent_epsilon(0.1, noise * 0.98, 100, 0.01)
    assert noise_multiplier(10.0, 0.01, 0.1, 100) < noise


def test_trace_order_and_standardized_features(spark, data):
    df, _ = data
    fit = fit_cox(df, SPEC, ["x1", "x2"])
    assert [t[0] for t in fit.trace] == list(range(1, fit.iterations + 1)) and fit.first_converged(1e-7) == fit.iterations and fit.first_converged(0.0) is None
    assert all(b[1] >= a[1] - 1e-6 for a, b in zip(fit.trace, fit.trace[1:]))
    got = [(r["time"], r["event"], r["patient_id"]) for r in in_order(df, SPEC).collect()]
    assert got == sorted(got)
    x = CoxSimulator(400, 2, seed=4, standardize=True).generate(spark).agg(F.avg("X_0"), F.stddev_pop("X_0"), F.stddev_pop("X_1")).first()
    assert tuple(x) == pytest.approx((0, 1, 1), abs=1e-9)


def test_private_fit_goes_on_from_its_state(spark, data, tmp_path):
    df, _ = data
    fit = lambda **kw: fit_private_logit(df, ["x1"], "treated", "patient_id", 8.0, 0.01, 1.0, batch=64, updates=2, rounds=4, center="center", **kw)
    half = fit(until=2)
    assert not half.converged and half.iterations == 4
    PrivateState(1, half.coef).save(spark, str(tmp_path / "states"))
    PrivateState(2, half.coef).save(spark, str(tmp_path / "states"))
    assert fit(state=PrivateState.load(spark, str(tmp_path / "states"))).coef == pytest.approx(fit().coef, abs=1e-12)


def test_etl(spark):
    index = spark.sql("SELECT 1 AS k, timestamp_ntz'2024-01-10 00:00:00' AS at UNION ALL SELECT 2, timestamp_ntz'2024-01-10 00:00:00'")
    records = spark.sql("SELECT 1 AS k, timestamp_ntz'2024-01-08 00:00:00' AS seen, 5.0 AS v UNION ALL SELECT 1, timestamp_ntz'2024-01-12 00:00:00', 6.0 UNION ALL SELECT 1, timestamp_ntz'2023-01-01 00:00:00', 7.0")
    got = {r["k"]: r["v"] for r in etl.nearest_record(index, records, "k", "at", "seen", F.expr("INTERVAL -30 DAYS"), F.expr("INTERVAL 7 DAYS")).collect()}
    assert float(got[1]) == 5.0 and got[2] is None
    holes = spark.createDataFrame([(1, 1.0, "a"), (2, None, "a"), (3, 3.0, None)], "id int, x double, c string")
    filled = {r["id"]: (r["x"], r["c"]) for r in etl.fill_mean_mode(holes, ["x"], ["c"]).collect()}
    assert filled == {1: (1.0, "a"), 2: (2.0, "a"), 3: (3.0, "a")}
    assert etl.missing_order(holes, ["x", "id"]) == ["id", "x"]
    rows = spark.createDataFrame([(k, float(k % 5), float(k % 5) * 2 if k % 7 else None, k % 2) for k in range(60)], "id int, a double, b double, c int")
    out = etl.miss_forest(rows, "id", ["a", "b"], ["c"], max_iter=2, trees=3, depth=4)
    assert out.where("b is null").count() == 0 and out.count() == 60
    assert etl.select_matching(rows, "^[ab]$").columns == ["a", "b"]


def test_nearest_record_of_several_index_rows(spark):
    index = spark.createDataFrame([(1, "2020-01-10"), (1, "2020-03-10"), (1, "2020-03-10"), (2, None)], "id int, at string").withColumn("at", F.to_timestamp("at"))
    records = spark.createDataFrame([(1, "2020-01-12", "a"), (1, "2020-03-09", "b"), (1, "2020-03-11", "c")], "id int, seen string, v string").withColumn("seen", F.to_timestamp("seen"))
    got = etl.nearest_record(index, records, "id", "at", "seen", F.expr("interval -5 days"), F.expr("interval 5 days")).collect()
    assert sorted((r["id"], str(r["at"])[:10], r["v"]) for r in got) == [(1, "2020-01-10", "a"), (1, "2020-03-10", "b"), (1, "2020-03-10", "b"), (2, "None", None)]


def test_impute_once_and_overwrite(spark):
    rows = spark.createDataFrame([(1, 2.0, "os"), (1, None, "pfs"), (2, None, "os"), (2, None, "pfs"), (3, 4.0, "os")], "id int, x double, kind string")
    got = {(r["id"], r["kind"]): r["x"] for r in etl.impute_once(rows, "id", ["x"]).collect()}
    assert got == {(1, "os"): 2.0, (1, "pfs"): 2.0, (2, "os"): 3.0, (2, "pfs"): 3.0, (3, "os"): 4.0}
    out = rows.withColumns(etl.overwrite_where(F.col("x") > 3, kind="far", x=F.col("x") * 2))
    assert {(r["id"], r["kind"], r["x"]) for r in out.where("id <> 2").collect()} == {(1, "os", 2.0), (1, "pfs", None), (3, "far", 8.0)}


def test_reports(spark):
    rows = spark.createDataFrame([("m", 0, 0.01), ("m", 1, 0.2), ("o", 0, 0.3)], "method string, rep int, p double")
    assert {r["method"]: r["power"] for r in report.power(rows, ["method"]).collect()} == {"m": 0.5, "o": 0.0}
    assert report.repeat_rows(rows, F.col("rep")).count() == 1
    assert r"\begin{tabular}" in report.latex_table(rows, ["method", "p"])
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "id int, smd_x1 double, smd_x2 double")
    assert {(r["covariate"], r["value"]) for r in report.wide_to_long(wide, ["id"], r"(smd)_(x\d)").collect()} == {("x1", 2.0), ("x2", 3.0)}


def test_simulator(spark):
    df = CoxSimulator(2000, 3, seed=5, propensity="constant", share=0.3, censoring="random", censored=0.25).generate(spark).persist()
    row = df.agg(F.sum("treatment").alias("t"), F.avg("event").alias("e"), F.min("time").alias("m"), F.corr("X_0", "X_1").alias("c")).first()
    assert row["t"] == 600 and row["e"] == pytest.approx(0.75, abs=0.05) and row["m"] > 0 and row["c"] == pytest.approx(0.5, abs=0.1)
    linear = CoxSimulator(2000, 3, seed=5).generate(spark)
    assert linear.agg(F.avg(F.col("treatment") - F.col("propensity_scores"))).first()[0] == pytest.approx(0, abs=0.05)
    coded = with_categoricals(df, ["X_0"], 4, missing=0.1)
    assert {r[0] for r in coded.select("cat_X_0").distinct().collect()} == {None, 0, 1, 2, 3}
    levels = with_categoricals(df, ["X_0", "X_1", "X_2"], seed=4).agg(*[F.countDistinct(f"cat_X_{k}") for k in range(3)]).first()
    assert all(2 <= n <= 10 for n in levels) and len(set(levels)) > 1


@pytest.mark.parametrize("share", [0.02, 0.3, 0.9])
def test_simulated_ties_reach_the_share(spark, share):
    df = CoxSimulator(500, 2, ties=share, censored=1e-6, seed=2).generate(spark)
    assert 500 - df.select("time").distinct().count() == int(share * 500)
    assert df.count() == 500 and df.where("time <= 0").count() == 0


def test_simulator_does_not_depend_on_partitions(spark):
    make = lambda n: CoxSimulator(600, 2, seed=3, ties=0.1).generate(spark, n).orderBy("patient_id").collect()
    a, b = make(2), make(7)
    assert [r["patient_id"] for r in a] == [r["patient_id"] for r in b]
    assert all(x == pytest.approx(y, rel=1e-9) for r, s in zip(a, b) for x, y in zip(r, s))
    g = CoxSimulator(20_000, 2, seed=8, features="independent").generate(spark).agg(F.avg("X_0"), F.stddev("X_0"), F.corr("X_0", "X_1"), F.kurtosis("X_1")).first()
    assert abs(g[0]) < 0.03 and abs(g[1] - 1) < 0.03 and abs(g[2]) < 0.03 and abs(g[3]) < 0.15
