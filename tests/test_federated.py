"""Federated averaging, privacy budgets and the logs that they are kept in."""

import hashlib
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalspark.operators.fedavg import fit_fed_avg
from vitalspark.operators.privacy import BudgetExceeded, PrivacyLedger, composed_epsilon, fit_private_logit, renyi_epsilon, spent_epsilon
from vitalspark.sources import log


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((230, 2))
    y = (rng.random(230) < 1 / (1 + np.exp(-(0.5 + x @ [1.5, -1])))).astype(int)
    return [(k, "ab"[k % 10 > 6], float(a), float(b), int(c)) for k, ((a, b), c) in enumerate(zip(x, y))]


@pytest.fixture(scope="module")
def cohort(spark, rows):
    return spark.createDataFrame([*rows, (900, "a", None, 0.0, 1), (901, "b", 0.0, 0.0, None)], "id long, site string, x1 double, x2 double, y int").repartition(5)


def plain(groups, rounds, updates, batch, rate, l2, seed):
    """Parameters after each round; groups of (id, x, y) train apart and are averaged by rows."""
    shared, out = np.zeros(3), []
    for r in range(rounds):
        ends = []
        for own in groups:
            w, per = shared, -(-len(own) // batch)
            for s in range(r * updates, (r + 1) * updates):
                draw = lambda i, e=s // per: (int(hashlib.md5(f"{seed}:{e}:{i}".encode()).hexdigest()[:13], 16), str(i))
                part = sorted(own, key=lambda v: draw(v[0]))[s % per * batch :][:batch]
                x, y = np.array([[1.0, *v[1]] for v in part]), np.array([v[2] for v in part])
                w = w - rate * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + l2 * np.array([0, *w[1:]]))
            ends.append((len(own), w))
        shared = sum(n * w for n, w in ends) / sum(n for n, _ in ends)
        out.append(shared)
    return out


FIT = {"rounds": 4, "updates": 5, "batch": 16, "rate": 0.3, "l2": 0.01, "seed": 9}


def test_rounds_equal_local_training_of_each_centre(cohort, rows):
    got = fit_fed_avg(cohort, ["x1", "x2"], "y", "id", "site", **FIT)
    groups = [[(i, (a, b), y) for i, s, a, b, y in rows if s == site] for site in "ab"]
    for (r, coef, _), want in zip(got.rounds, plain(groups, **FIT), strict=True):
        assert np.allclose(coef, want, atol=1e-10), r
    assert got.model.converged and got.model.iterations == 20 and got.rounds[0][2] > got.rounds[-1][2] > 0


def test_a_large_centre_is_many_shards(cohort, rows):
    got = fit_fed_avg(cohort, ["x1", "x2"], "y", "id", "site", shard_rows=50, **FIT)
    per = cohort.na.drop().groupBy("site").count().collect()
    shards = {r["site"]: -(-r["count"] // 50) for r in per}
    named = cohort.na.drop().select("id", F.xxhash64(F.col("id").cast("string")).alias("h")).collect()
    hashed = {r["id"]: r["h"] for r in named}
    groups: dict = {}
    for i, s, a, b, y in rows:
        groups.setdefault((s, hashed[i] % shards[s]), []).append((i, (a, b), y))
    assert len(groups) > 4 and np.allclose(got.model.coef, plain(list(groups.values()), **FIT)[-1], atol=1e-10)


def test_a_fit_goes_on_from_its_state_and_ignores_partitions(cohort):
    fit = lambda df=cohort, **kw: fit_fed_avg(df, ["x1", "x2"], "y", "id", "site", **FIT, **kw)
    half = fit(until=2)
    assert half.state.round == 2 and not half.model.converged
    assert fit(state=half.state).model.coef == pytest.approx(fit().model.coef, abs=1e-12) == fit(cohort.repartition(1)).model.coef
    assert fit(state=fit().state).model.coef == pytest.approx(fit().model.coef)


def test_budgets_of_unlike_runs_add_up_by_order(spark, tmp_path):
    both = composed_epsilon([(0.1, 1.1, 8), (0.05, 1.5, 4)], 0.01)
    assert max(spent_epsilon(0.1, 1.1, 8, 0.01), spent_epsilon(0.05, 1.5, 4, 0.01)) < both < spent_epsilon(0.1, 1.1, 8, 0.01) + spent_epsilon(0.05, 1.5, 4, 0.01)
    assert composed_epsilon([(0.1, 1.1, 3), (0.1, 1.1, 5)], 0.01) == spent_epsilon(0.1, 1.1, 8, 0.01) and composed_epsilon([], 0.01) == 0
    assert renyi_epsilon(1.0, 2.0, 4) == 0.5
    ledger = PrivacyLedger(spark, str(tmp_path / "l"), both, 0.01)
    assert ledger.spent() == {} and ledger.charge("one", 0, {"a": (0.1, 1.1, 8), "b": (1.0, 30.0, 1)}) and not ledger.charge("one", 0, {"a": (0.1, 1.1, 8), "b": (1.0, 30.0, 1)})
    with pytest.raises(ValueError):
        ledger.charge("one", 0, {"a": (0.1, 1.1, 9)})
    assert PrivacyLedger(spark, str(tmp_path / "l"), both, 0.01).charge("two", 0, {"a": (0.05, 1.5, 4)})
    with pytest.raises(BudgetExceeded):
        ledger.charge("three", 0, {"b": (0.01, 5.0, 1), "a": (0.001, 5.0, 10)})
    assert ledger.spent()["a"] == pytest.approx(both) and ledger.spent()["b"] == pytest.approx(spent_epsilon(1.0, 30.0, 1, 0.01))


def test_a_resumed_private_fit_spends_what_an_unbroken_one_does(spark, cohort, tmp_path):
    fit = lambda name, epsilon=8.0, batch=64, **kw: fit_private_logit(cohort, ["x1", "x2"], "y", "id", epsilon, 0.01, 1.0, batch=batch, updates=2, rounds=3, center="site", ledger=PrivacyLedger(spark, str(tmp_path / name), 12.0, 0.01), **kw)
    spent = lambda name: PrivacyLedger(spark, str(tmp_path / name), 12.0, 0.01).spent()
    whole = fit("whole")
    from vitalspark.operators.privacy import PrivateState

    half = fit("broken", until=2)
    fit("broken", until=2)  # a retry of the same rounds is free
    again = fit("broken", state=PrivateState(2, half.coef))
    assert spent("broken") == spent("whole") and again.coef == pytest.approx(whole.coef, abs=1e-12)
    assert all(7.5 < e <= 8.0 + 1e-6 for e in spent("whole").values())
    fit("broken", epsilon=1.0, batch=16, run="smaller")
    assert all(spent("whole")[s] < spent("broken")[s] < 9.5 for s in "ab")
    before = spent("broken")
    with pytest.raises(BudgetExceeded):
        fit("broken", run="another")
    assert all(spent("broken")[s] <= 12.0 + 1e-6 and spent("broken")[s] >= before[s] for s in "ab")


def test_writers_at_once_lose_no_entry(spark, tmp_path):
    path, seen = str(tmp_path / "log"), []
    work = lambda k: [seen.append(log.EntryLog(spark, path).append(lambda _, j=j: {"who": k, "n": j})) for j in range(6)]
    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(seen) == 18 and all(seen)
    got = log.EntryLog(spark, path).read()
    assert sorted((e["who"], e["n"]) for e in got) == [(k, j) for k in range(3) for j in range(6)]


def test_a_job_adds_its_results_once(spark, tmp_path):
    path = str(tmp_path / "results")
    assert log.read_once(spark, path) is None
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "rep int, coef double")
    assert log.append_once(df, path, "job 1") and not log.append_once(df, path, "job 1")
    assert log.append_once(df.withColumn("more", F.lit("x")), path, "job 2")
    df.write.parquet(f"{path}/part-torn")  # of a job that died before it was named
    assert log.read_once(spark, path).count() == 4 and "more" in log.read_once(spark, path).columns
    assert log.sweep(spark, path) == 1 and log.read_once(spark, path).count() == 4


def test_two_copies_of_a_job_leave_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    df = spark.createDataFrame([(1,)], "rep int")
    write = log.EntryLog.append

    def late(self, decide):  # the other copy is named between this one's write and its entry
        monkeypatch.setattr(log.EntryLog, "append", write)
        assert log.append_once(df, path, "job")
        return self.append(decide)

    monkeypatch.setattr(log.EntryLog, "append", late)
    assert not log.append_once(df, path, "job")
    assert log.read_once(spark, path).count() == 1 and log.sweep(spark, path) == 0
