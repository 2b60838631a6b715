"""Histogram forests against trees grown one by one in plain loops, and imputation by them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.operators import etl, forest
from vitalspark.sources import scratch, tables


def plain_tree(bins, y, w, tree, depth, least, some, seed, classes):
    """{node: (feature, bin or None, value)} of one tree, node by node and split by split."""
    def worth(rows):
        if classes:
            own = np.bincount(y[rows].astype(int), w[rows], classes)
            return (own**2).sum() / own.sum() if own.sum() else 0.0
        return (w[rows] @ y[rows]) ** 2 / w[rows].sum() if w[rows].sum() else 0.0

    out, todo = {}, [(0, np.arange(len(y)), 0)]
    while todo:
        node, rows, level = todo.pop()
        rows = rows[w[rows] > 0]
        value = np.bincount(y[rows].astype(int), w[rows], classes) / w[rows].sum() if classes else np.array([w[rows] @ y[rows] / w[rows].sum()])
        best = (1e-9 * abs(worth(rows)) + 1e-300, None)
        may = forest.allowed(np.array([tree]), np.array([node]), bins.shape[1], some, seed)[0]
        if level < depth:
            for f in np.flatnonzero(may):
                for b in range(forest.BINS - 1):
                    left = bins[rows, f] <= b
                    if w[rows][left].sum() >= least and w[rows][~left].sum() >= least:
                        gain = worth(rows[left]) + worth(rows[~left]) - worth(rows)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (f, b))
        out[node] = (*(best[1] or (-1, 0)), value)
        if best[1]:
            left = bins[rows, best[1][0]] <= best[1][1]
            todo += [(2 * node + 1, rows[left], level + 1), (2 * node + 2, rows[~left], level + 1)]
    return out


@pytest.mark.parametrize("classes", [0, 3])
def test_trees_equal_those_grown_one_by_one(spark, monkeypatch, classes):
    monkeypatch.setattr(forest, "CHUNK_ROWS", 90)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 8, (300, 4)).astype(np.uint8)
    y = rng.integers(0, 3, 300).astype(float) if classes else np.rint(3 * bins[:, 0] - bins[:, 1] + rng.normal(0, 2, 300))
    ids = rng.integers(-(1 << 62), 1 << 62, 300)
    df = spark.createDataFrame([(int(i), bytes(b), float(v)) for i, b, v in zip(ids, bins, y)], "id long, bins binary, y double")
    low = -20.0
    made = lambda parts: forest.fit_forest(df.repartition(parts), 4, classes, (low, low + (1 << 20)), trees=3, depth=4, least=2, some=2, seed=9)
    got = made(5)
    for t in range(3):
        w = forest.weights(ids.view(np.uint64), t, 9).astype(float)
        want = plain_tree(bins, y - low if not classes else y, w, t, 4, 2, 2, 9, classes)
        for node, (f, b, value) in want.items():
            assert (got.feature[t, node], got.bin[t, node]) == (f, b), (t, node)
            assert np.allclose(got.value[t, node], value + (0 if classes else low), atol=1e-4)
        assert (got.feature[t] >= 0).sum() == sum(v[0] >= 0 for v in want.values())
    again = made(2)
    assert np.array_equal(again.feature, got.feature) and np.array_equal(again.value, got.value)
    predicted = got.predict(bins)
    assert (predicted == y).mean() > 0.4 if classes else np.corrcoef(predicted, y)[0, 1] > 0.9


@pytest.mark.parametrize("classes", [0, 3])
def test_few_combinations_give_the_same_forest_in_one_pass(spark, monkeypatch, classes):
    rng = np.random.default_rng(4)
    bins = rng.integers(0, (8, 3, 32, 2), (400, 4)).astype(np.uint8)
    y = rng.integers(0, 3, 400).astype(float) if classes else np.rint(3 * bins[:, 0] - bins[:, 1] + rng.normal(0, 2, 400))
    df = spark.createDataFrame([(int(i), bytes(b), float(v)) for i, b, v in zip(rng.integers(-(1 << 62), 1 << 62, 400), bins, y)], "id long, bins binary, y double").repartition(3)
    made = lambda sizes: forest.fit_forest(df, 4, classes, (-40.0, 40.0), trees=5, depth=5, least=2, some=3, seed=9, sizes=sizes)
    want = made(None)
    monkeypatch.setattr(forest, "_level", None)  # no job a level
    monkeypatch.setattr(forest, "BLOCK_ROWS", 70)
    got = made([8, 3, 32, 2])
    assert (want.feature >= 0).sum() > 50
    assert all(np.array_equal(getattr(got, n), getattr(want, n)) for n in ("feature", "bin", "value"))


def test_weights_by_starts_are_those_of_the_bounds():
    ids = np.r_[np.arange(50_000), np.array([-1, 1 << 62])].astype(np.int64).view(np.uint64)
    x = forest._uniform(ids, 5 * 65_537 + 8)
    assert np.array_equal(forest.weights(ids, 7, 5), np.searchsorted(forest._POISSON, x, side="right"))


def test_sample_weights_are_poisson_and_nodes_choose_features():
    w = np.stack([forest.weights(np.arange(20_000, dtype=np.uint64), t, 5) for t in range(3)])
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01 and abs(np.corrcoef(w)[0, 1]) < 0.03
    may = forest.allowed(np.zeros(4000, int), np.arange(4000), 6, 2, 5)
    assert (may.sum(1) == 2).all() and (abs(may.mean(0) - 1 / 3) < 0.03).all()


def test_bins_keep_few_values_apart_and_cut_many_at_quantiles(spark):
    df = spark.createDataFrame([(float(k % 3), float(k), None) for k in range(1000)], "a double, b double, c double")
    a, b, c = forest.edges(df, ["a", "b", "c"])
    assert a.tolist() == [0, 1] and len(b) == forest.BINS - 1 and abs(b[15] - 500) < 20 and c.tolist() == []
    assert forest.binned([np.array([0.0, 1, 2, 9]), np.array([0.0, 0, 0, 0])], [a, c]).tolist() == [[0, 0], [1, 0], [2, 0], [2, 0]]


def holes(spark, n=1500, seed=2):
    rng = np.random.default_rng(seed)
    a, u = rng.normal(50, 10, n), rng.random(n)
    b = 2 * a + rng.normal(0, 3, n)
    c = (a > 50).astype(int) + (u > 0.9)
    rows = [(k, float(x), None if k % 4 == 0 else float(y), None if k % 5 == 0 else int(z), float(y), int(z)) for k, (x, y, z) in enumerate(zip(a, b, c))]
    return spark.createDataFrame(rows, "id int, a double, b double, c int, true_b double, true_c int")


def test_imputation_beats_means_and_modes_and_ignores_partitions(spark):
    df = holes(spark)
    fill = lambda d: etl.miss_forest(d.select("id", "a", "b", "c"), "id", ["a", "b"], ["c"], max_iter=4, trees=20, depth=6)
    out = fill(df)
    both = out.join(df.select("id", "true_b", "true_c"), "id")
    rmse = both.where("id % 4 = 0").agg(F.sqrt(F.avg(F.pow(F.col("b") - F.col("true_b"), F.lit(2))))).first()[0]
    right = both.where("id % 5 = 0").agg(F.avg((F.col("c") == F.col("true_c")).cast("double"))).first()[0]
    assert rmse < 6 and right > 0.8 and out.where("a is null or b is null or c is null").count() == 0  # a mean is off by 20, a mode right by 0.5
    kept = both.where("id % 20 > 0 and id % 4 > 0 and b <> true_b").count() + both.where("id % 5 > 0 and c <> true_c").count()
    assert kept == 0
    assert sorted(map(tuple, fill(df.repartition(7)).collect())) == sorted(map(tuple, out.collect()))


def test_nothing_missing_one_column_and_a_column_of_nulls(spark):
    df = spark.createDataFrame([(k, float(k), None) for k in range(20)], "id int, a double, b double")
    assert [tuple(r) for r in etl.miss_forest(df.select("id", "a"), "id", ["a"]).orderBy("id").collect()] == [(k, float(k)) for k in range(20)]
    one = etl.miss_forest(df.select("id", F.when(F.col("id") > 3, F.col("a")).alias("a")), "id", ["a"], trees=3, depth=2, max_iter=1)
    assert one.where("a is null").count() == 0
    all_null = etl.miss_forest(df.select("id", F.when(F.col("id") > 3, F.col("a")).alias("a"), "b"), "id", ["a", "b"], trees=3, depth=2, max_iter=1)
    assert all_null.where("a is null").count() == 0 and all_null.where("b is null").count() == 20


def test_scratch_tables_of_passes_go(spark):
    begun = scratch.written()
    etl.miss_forest(holes(spark, 200).select("id", "a", "b", "c"), "id", ["a", "b"], ["c"], max_iter=3, trees=3, depth=3).count()
    assert scratch.written() - begun <= 5
    scratch.remove_written(spark, begun)


def test_the_clinical_scan_imputes_by_forests(spark):
    df = holes(spark, 400).select(F.col("a").alias("age"), F.col("b").alias("weight"), F.element_at(F.array(F.lit("no"), F.lit("some"), F.lit("much")), F.col("c") + 1).alias("pain"), F.lit(3.0).alias("death"), (F.col("id") + 1.0).alias("follow"), F.when(F.col("id") % 2 == 0, "new").otherwise("old").alias("arm"))
    bounds, levels = {"age": (0, 100), "weight": (0, 250)}, {"pain": ["no", "some", "much"]}
    out = tables.clinical(df, bounds, levels, "death", "follow", "arm", "new", "c0", impute="forest", trees=10, depth=4, max_iter=2)
    assert out.count() == 400 and out.where("weight is null or age is null").count() == 0 and out.where("treated = 1").count() == 200
    near = out.where(F.abs(F.col("weight") * 250 - 2 * F.col("age") * 100) < 25).count()
    assert near > 380
    assert {c for c in out.columns if c.startswith("pain")} and sum(out.agg(*[F.sum(c) for c in out.columns if c.startswith("pain")]).first()) > 150
    with pytest.raises(ValueError):
        tables.clinical(df, bounds, levels, "death", "follow", "arm", "new", "c0", impute="magic")
