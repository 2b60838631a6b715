"""Whitening against the whole eigenproblem in numpy and against exact integers."""

import math

import numpy as np
import pytest

from vitalspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def rows_of(spark, rows, kind=SCHEMA):
    return {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(rows, kind)).collect()}


def check(spark, rows, width, loose=1e-9):
    """All columns, up to the components' signs."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v))) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(distinct), [int(s) for s in distinct.sum(0)]
    centred = distinct - distinct.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = rows_of(spark, rows)
    k = min(4, width)
    assert len(got) == len({i for i, _ in kept}) * k
    signs = {}
    for i, x in kept:
        z = (np.array(x) - distinct.mean(0)) @ vectors[:, :k]
        for j in range(k):
            r = got[i, j + 1]
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert r["explained"] == pytest.approx(values[j] / values.sum(), rel=1e-9) and 0 <= r["identity_error"] < 1e-9
            want = z[j] / math.sqrt(values[j])
            if j not in signs and abs(want) > 0.05:
                signs[j] = math.copysign(1, want * r["whitened"])
            assert r["whitened"] * signs.get(j, 1) == pytest.approx(want, abs=loose if j in signs else 0.2)
    return got


def test_low_rank_rows_settle_in_the_block_and_flat_ones_expand(spark, monkeypatch):
    rng = np.random.default_rng(1)
    passes = []
    added = whitening._added
    monkeypatch.setattr(whitening, "_added", lambda rows, width, part, shape: passes.append(shape) or added(rows, width, part, shape))
    monkeypatch.setattr(whitening, "TOLERANCE", 1e-9)
    strong = (rng.standard_normal((400, 4)) * [400, 160, 60, 25]) @ rng.standard_normal((4, 40))
    check(spark, [(k, v.tolist()) for k, v in enumerate(strong)], 40, 1e-6)
    assert (40, 41) not in passes and passes.count((40, 13)) == whitening.POWER
    passes.clear()
    flat = rng.standard_normal((500, 40))
    check(spark, [(k, v.tolist()) for k, v in enumerate(flat)], 40)
    assert (40, 41) in passes


def test_copies_count_once_and_odd_rows_have_defined_results(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((50, 6)).tolist()
    rows = [(k, v) for k, v in enumerate(vectors)] + [(1000 + k, vectors[3]) for k in range(400)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [1.5]), (2005, []), (2006, [-0.0] * 6)]
    got = check(spark, rows, 6)
    assert not any(i in (2000, 2001, 2002, 2003) for i, _ in got)
    assert [got[2005, j]["whitened"] for j in range(1, 5)] == [got[2006, j]["whitened"] for j in range(1, 5)]


def test_no_rows_one_row_few_dimensions_repeats_and_clashing_columns(spark):
    assert rows_of(spark, []) == {} == rows_of(spark, [(1, None), (2, [])])
    one = rows_of(spark, [(1, [1.0, 2.0])])
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one.values()] == [(0, None, 0.0, 0.0)] * 2
    two = rows_of(spark, [(1, [1.0]), (2, [2.0])])
    assert {abs(r["whitened"]) for r in two.values()} == {1.0} and {r["deviation"] for r in two.values()} == {256 * 256}
    flat = rows_of(spark, [(1, [1.0, 1.0, 0.0]), (2, [2.0, 2.0, 0.0]), (3, [4.0, 4.0, 0.0])])
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in flat.values())
    df = spark.createDataFrame([(1, [1.0, 2.0], 5, "a"), (1, [1.0, 2.0], 5, "b"), (None, [0.0, 1.0], 6, "c")], "vec_id long, embedding array<float>, x int, width string")
    assert len(whitening.whiten(df).collect()) == 6


def test_huge_entries_do_not_crash_and_exact_sums_hold(spark):
    rows = [(k, [3e38 * (-1) ** k, float(k), 1e15]) for k in range(6)]
    got = rows_of(spark, rows)
    assert len(got) == 18 and all(r["deviation"] is None for r in got.values())
    big = [(k, [float(k) * 128.0, 8192.0 - k * k % 97]) for k in range(200)]
    check(spark, big, 2)
    assert whitening.deviations(np.array([[1 << 30, 0], [0, 0]]), 4, [1 << 30, 0]) == [None, 1 << 60]


def test_packing_is_one_form_for_equal_vectors():
    for x in ([], [0, 0], [1], [127, -128], [128], [1 << 20, 0, -5], [1 << 40], [-(1 << 63), (1 << 63) - 1]):
        own = np.array(x, np.int64)
        assert whitening.unpack([whitening.pack(own)], len(x) + 2)[0].tolist() == x + [0, 0]
        assert whitening.pack(np.r_[own, 0, 0].astype(np.int64)) == whitening.pack(own)


def test_rows_are_packed_and_unpacked_as_one_by_one():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-(1 << b), 1 << b, (20, 5)) for b in (0, 6, 7, 8, 15, 16, 31, 40, 62)] + [np.zeros((2, 5), np.int64), np.array([[1, 0, 0, 0, 0], [0, 0, 0, 0, 200]])])
    raws = whitening.pack_rows(x)
    assert raws == [whitening.pack(r) for r in x] and (whitening.unpack(raws, 5) == x).all()
    for k in range(0, len(x), 10):
        assert (whitening.unpack(raws[k : k + 10], 5) == x[k : k + 10]).all() and (whitening.unpack(raws[k : k + 10], 7)[:, :5] == x[k : k + 10]).all()
    assert whitening.pack_rows(np.zeros((2, 0), np.int64)) == [whitening.pack(np.zeros(0, np.int64))] * 2 and whitening.unpack([], 3).shape == (0, 3)


def test_whole_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check(spark, rows, 64)
