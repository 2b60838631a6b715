"""States of centres that merge, and exact quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.cohort import CohortSpec
from vitalspark.operators import quantiles
from vitalspark.operators.cox import fit_binary, time_table
from vitalspark.operators.km import kaplan_meier
from vitalspark.sources.states import CentreStates
from vitalspark.streaming.incremental import curve_of_counts


@pytest.mark.parametrize("digit", [3, 11, 16])
def test_quantiles_equal_sorted_ones(spark, monkeypatch, digit):
    monkeypatch.setattr(quantiles, "DIGIT", digit)
    rng = np.random.default_rng(1)
    a = np.r_[rng.standard_normal(400) * 10.0 ** rng.integers(-300, 300, 400), 0.0, -0.0, np.inf, -np.inf]
    b = rng.integers(-3, 4, len(a)).astype(float)
    rows = [(float(x), float(y), None, float("nan")) for x, y in zip(a, b)] + [(None, float("nan"), None, None)] * 5
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(6)
    shares = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, ["a", "b", "c", "d"], shares)
    assert got["c"] == got["d"] == [None] * 6
    assert got["b"] == np.quantile(b, shares).tolist()
    ordered = np.sort(a)
    for p, v in zip(shares, got["a"]):
        at = (len(a) - 1) * p
        low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        assert v == pytest.approx(low if low == high else low + (high - low) * (at - np.floor(at)), rel=1e-12)
    one = spark.createDataFrame([(2.5,)], "x double")
    assert quantiles.exact_quantiles(one, ["x"], [0.0, 0.5]) == {"x": [2.5, 2.5]} and quantiles.exact_quantiles(one.limit(0), ["x"], [0.5]) == {"x": [None]}
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(one, ["x"], [1.5])


def test_bits_sort_like_numbers():
    x = np.array([-np.inf, -1e300, -1.0, -1e-320, -0.0, 0.0, 5e-324, 2.0, np.inf])
    keys = quantiles._keys(x)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5] and np.array_equal(quantiles._values(keys), x + 0.0)


def test_states_of_centres_merge_to_the_pooled_results(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(k, f"c{k % 4}", float(np.ceil(rng.exponential() * 6)), int(rng.random() < 0.7), int(rng.random() < 0.5), None if k % 17 == 0 else float(rng.normal()), float(rng.random()), float(rng.uniform(0.5, 2))) for k in range(400)]
    df = spark.createDataFrame(rows, "patient_id long, center string, time double, event int, treated int, x1 double, x2 double, w double")
    spec = CohortSpec(covariates=("x1", "x2")).weighted("w")
    states = CentreStates(spark, str(tmp_path / "states"), ["x1", "x2"])
    with pytest.raises(ValueError):
        states.moments()
    assert states.deliver(df.where("patient_id < 100"), spec, 1)
    assert states.deliver(df.where("center <> 'c0'"), spec, 2) and not states.deliver(df.where("center <> 'c0'").limit(5), spec, 2)
    assert states.deliver(df.where("center = 'c0'"), spec, 3)  # a centre that joins later, or delivers anew
    pooled, merged = (fit_binary(t)[None] for t in (time_table(df, spec, F.col("treated")), CentreStates(spark, str(tmp_path / "states"), ["x1", "x2"]).time_table()))
    assert merged[:2] == pytest.approx(pooled[:2])
    curve = {(r["arm"], r["time"]): (r["survival"], r["var_survival"]) for r in curve_of_counts(states.event_counts(), ["arm"]).collect()}
    want = {(r["treated"], r["time"]): (r["survival"], r["var_survival"]) for r in kaplan_meier(df, spec).collect()}
    assert curve.keys() == want.keys() and all(curve[k] == pytest.approx(want[k]) for k in want)
    for r in states.moments().collect():
        own = df.where(F.col(r["covariate"]).isNotNull()).agg(F.count("*"), F.avg(r["covariate"]), F.var_pop(r["covariate"]), F.sum(F.col("w") * F.col(r["covariate"])) / F.sum("w")).first()
        assert (r["n"], r["mean"], r["var"], r["w_mean"]) == pytest.approx(tuple(own))
    both = df.na.drop()
    for r in states.covariances().collect():
        assert r["cov"] == pytest.approx(both.agg(F.covar_pop(r["a"], r["b"])).first()[0] if "x1" in (r["a"], r["b"]) else df.agg(F.var_pop("x2")).first()[0])


def test_a_delivery_makes_its_rows_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(200).select(F.lit("a").alias("center"), (F.col("id") % 2).alias("treated"), (F.col("id") % 7 + 1.0).alias("time"), F.lit(1).alias("event"), F.col("id").cast("double").alias("x1"))
    states = CentreStates(spark, str(tmp_path / "once"), ["x1"])
    assert states.deliver(df.mapInArrow(seen, df.schema), CohortSpec(), 1) and read.value == 200
    assert states.moments().first()["n"] == 200 and not states.deliver(df, CohortSpec(), 1)
