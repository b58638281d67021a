"""Whitening: brute force on the whole table, exact sums, merging, vectors that are dropped, tables without variance."""

import numpy as np
import pytest

from tarnwright.llm import whitening
from tarnwright.llm.queries import op11_whitening, table

from .conftest import DATA

KIND = "vec_id long, embedding array<float>, label int, component string, n string"


def brute(rows):
    """x, eigenvalues and eigenvectors by plain numpy, deviations by Python's integers."""
    c = np.array([r[1] for r in rows], float)
    x = np.floor(1024 * c).astype(np.int64) + 100_000
    n, s = len(x), [sum(int(v) for v in col) for col in x.T]
    d = x - np.array(s) / n
    e, u = np.linalg.eigh(d.T @ d / n)
    order = np.argsort(-e)
    deviation = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s, strict=True)) for row in x]
    return n, deviation, d, e[order], u[:, order]


def check(rows, got, k):
    n, deviation, d, e, u = brute(rows)
    assert len(got) == len(rows) * k
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    for i, (vec_id, _) in enumerate(rows):
        for c in range(k):
            r = by[vec_id][c + 1]
            assert r["n"] == n and r["deviation"] == deviation[i] and r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9)
            assert abs(r["whitened"]) == pytest.approx(abs(d[i] @ u[:, c]) / e[c] ** 0.5, abs=1e-6)
    for c in range(k):  # one sign for all rows
        z = np.array([by[v][c + 1]["whitened"] for v, _ in rows])
        assert abs(abs(z @ (d @ u[:, c])) / e[c] ** 0.5 / n - 1) < 1e-9


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, DATA, "embeddings").select("vec_id", "embedding").collect()]
    check(rows, op11_whitening(spark, DATA).collect(), 8)


def test_many_uneven_partitions(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(700, 5)) * [9, 4, 2, 1, 0.3] + [1000, -500, 3, 0, 0]).astype(np.float32)
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(v)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(rows, whitening.whitening(frame.repartition(37)).collect(), 5)
    check(rows, whitening.whitening(frame.coalesce(1), 3).collect(), 3)


def test_merging_equals_one_batch():
    rng = np.random.default_rng(4)
    x = rng.integers(-(10**9), 10**9, size=(300, 4)) + np.array([2**60, -(2**61), 0, 7])
    whole, cuts = whitening.Moments.of(x), [0, 1, 50, 50, 299, 300]
    parts = [whitening.Moments.of(x[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    left = parts[0]
    for p in parts[1:]:
        left = left.merge(p)
    assert left.n == 300 and left.sums == whole.sums == [sum(map(int, c)) for c in x.T]
    assert np.allclose(left.scatter, whole.scatter, rtol=1e-12)
    none = whitening.Moments(0, [0] * 4, np.zeros((4, 4)))
    assert none.merge(whole) is whole and whole.merge(none) is whole


def test_deviations_are_exact_up_to_a_long_and_null_beyond():
    rng = np.random.default_rng(5)
    for n, size in ((10, 1000), (10**6, 2000), (3 * 10**6, 200), (10**9, 10**4)):
        x = rng.integers(-size, size, size=(200, 64)) + 100_000
        sums = [int(v) * n + int(rng.integers(n)) for v in rng.integers(99_990, 100_010, size=64)]
        w = whitening.Whitener(n, sums, np.eye(64)[:, :1], np.ones(1), 1.0)
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
        assert w.deviation(x).to_pylist() == [v if v < 2**63 else None for v in exact]


def test_states_on_the_driver_are_bounded():
    for parts in (1, 10, 10**3, 10**6):
        for dim in (8, 64, 1024, 4096):
            size = 8 * dim * (dim + 2)
            left = parts ** (1 / whitening.tree_depth(parts, size))
            assert left * size <= max(whitening.TREE_BYTES, 2 * size) * 1.001


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(1, [0.5, -0.25, 0.0]), (2, [0.1, 0.2, 0.3]), (None, [0.0, 0.0, 0.0]), (3, [-1.0, 4.0, 2.0]), (3, [-1.0, 4.0, 2.0]), (5, [0.25, 0.5, 9.0])]
    bad = [(7, None), (8, [None, 1.0, 2.0]), (9, [nan, 1.0, 2.0]), (10, [inf, 0.0, 0.0]), (11, [-inf, 0.0, 0.0]), (12, [1.0, 2.0]), (13, []), (14, [1e30, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1, "clash", "clash") for i, v in fine + bad], KIND)
    got = whitening.whitening(frame).collect()
    n, deviation, *_ = brute(fine)
    assert sorted((str(r["vec_id"]), r["component"], r["deviation"]) for r in got) == sorted((str(i), c, deviation[j]) for j, (i, _) in enumerate(fine) for c in (1, 2, 3))
    assert {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    assert whitening.whitening(frame.where("vec_id in (7, 8, 13)")).count() == 0 == whitening.whitening(frame.where("false")).count()
    for some in (frame.where("vec_id = 1"), frame.where("vec_id = 3")):
        got = some.transform(whitening.whitening).collect()
        assert len(got) == 3 * some.count() and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(0, None, None, None)}


def test_components_without_variance(spark):
    rows = [(i, [float(i % 7), 3.0, float(i % 3)]) for i in range(40)]
    got = whitening.whitening(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all((r["whitened"] is None) == (r["component"] == 3) and r["identity_error"] < 1e-9 for r in got)


def test_whitened_vectors(spark):
    rows = whitening.usable(table(spark, DATA, "embeddings"))
    w = whitening.fit(rows, 64, 64)
    z = np.array([r["whitened"] for r in whitening.whitened(rows, 64, w).collect()])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(64)).max() < 1e-9
    assert whitening.identity_error(rows, 64, w) < 1e-9
