"""Exact search by pivots: SQL on the whole table, brute force on ties, clusters, repeated rows and long vectors."""

import numpy as np
import pytest

from tarnwright.llm import pivots
from tarnwright.llm.queries import op13_topk

from .conftest import DATA

KIND = "vec_id long, embedding array<double>"


def test_whole_table_equals_sql(spark, tables):
    got, want = op13_topk(spark, DATA), tables.sql(pivots.oracle_sql())
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def brute(rows, k=5, every=50):
    """By Python's integers; of repeated ids the smallest vector asks and the best is found."""
    whole = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    asks = {}
    for i, v in whole:
        if i % every == 0:
            asks[i] = min(asks.get(i, v), v)
    out = []
    for q, own in asks.items():
        best = {}
        for i, v in whole:
            if i != q:
                s = sum(a * b for a, b in zip(own, v, strict=True))
                best[i] = max(best.get(i, s), s)
        top = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:k]
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(top)]
    return sorted(out)


def found(spark, rows, parts=5, **more):
    frame = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in rows], KIND).repartition(parts)
    return sorted(map(tuple, pivots.top_products(frame, **more).collect()))


@pytest.mark.parametrize("case", ["clusters", "ties", "one_vector", "lengths", "long"])
def test_equals_brute_force(spark, case):
    rng = np.random.default_rng(8)
    n, dim = 900, 8
    if case == "clusters":
        v = rng.normal(size=(12, dim))[rng.integers(12, size=n)] * 3 + 0.05 * rng.normal(size=(n, dim))
    elif case == "ties":
        v = rng.integers(-2, 3, size=(n, dim)) / 4
    elif case == "one_vector":
        v = np.where(rng.random(n)[:, None] < 0.5, np.full(dim, 0.3), rng.normal(size=(n, dim)))
    elif case == "lengths":
        v = rng.normal(size=(n, dim)) * 10.0 ** rng.integers(-3, 4, size=(n, 1))
    else:
        v = rng.normal(size=(n, dim)) * 10.0 ** rng.integers(0, 7, size=(n, 1)) / 4
    rows = list(zip(rng.permutation(n) - 40, v.tolist(), strict=True))
    assert found(spark, rows) == brute(rows)


def test_repeated_ids_and_few_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.integers(0, 120, size=400), rng.normal(size=(400, 4)), strict=True)]
    assert found(spark, rows, k=3, every=10) == brute(rows, 3, 10)
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 5.0])]
    assert found(spark, rows) == brute(rows) == [(0, 1, 1, 0), (0, 2, 2, -65536)]
    assert found(spark, [(50, [1.0, 2.0])]) == []
    assert found(spark, [(7, [1.0, 2.0]), (8, [1.0, 2.0])]) == []


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(0, [0.5, -0.25, 0.0]), (1, [0.1, 0.2, 0.3]), (2, [0.0, 0.0, 0.0]), (100, [-1.0, 4.0, 2.0]), (3, [8e6, 0.0, 0.0])]
    bad = [(150, None), (8, [None, 1.0, 2.0]), (200, [nan, 1.0, 2.0]), (10, [inf, 0.0, 0.0]), (11, [-inf, 0.0, 0.0]), (12, [1.0, 2.0]), (13, []), (14, [1e30, 0.0, 0.0]), (15, [8.3e6, 8.3e6, 0.0]), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1, "clash", 2) for i, v in fine + bad], "vec_id long, embedding array<double>, cell int, level string, near int")
    assert sorted(map(tuple, pivots.top_products(frame).collect())) == brute(fine)
    assert pivots.top_products(frame.where("false")).count() == 0 == pivots.top_products(frame.where("vec_id in (150, 200)")).count()


def test_clusters_spare_most_rows(spark, monkeypatch):
    """Rows that are multiplied out, of all; the result equals brute force."""
    rng = np.random.default_rng(10)
    n, dim = 6000, 16
    x = np.floor(256 * (rng.normal(size=(40, dim)) * 4)[rng.integers(40, size=n)] + 8 * rng.normal(size=(n, dim))).astype(np.int64)
    ids = np.arange(n)
    table = x[:: n // 33][:33]
    own = np.concatenate([np.zeros((1, dim), np.int64), table])
    d = pivots.distances(x, own)
    cell = d[:, 1:].argmin(axis=1) + 1
    order = np.lexsort((d[ids, cell], cell))
    asks = ids[::50]
    search = pivots.Search(asks, x[asks], d[asks], np.full(len(asks), np.iinfo(np.int64).min), 5, True)
    met, block = [], pivots.Search._block
    monkeypatch.setattr(pivots.Search, "_block", lambda self, some, rows, *rest: (met.append(len(some) * len(rows)), block(self, some, rows, *rest)))
    for at in range(0, n, pivots.HELD):
        part = order[at : at + pivots.HELD]
        search.rows(ids[part], x[part], d[part], cell[part])
    assert sum(met) < 0.25 * n * len(asks)
    for i, q in enumerate(asks):
        score = x @ x[q]
        top = sorted((j for j in ids if j != q), key=lambda j: (-score[j], j))[:5]
        assert search.found[i].tolist() == top and search.best[i].tolist() == score[top].tolist()


def test_bounds_hold():
    rng = np.random.default_rng(11)
    for scale in (1, 10**4, 2 * 10**8):
        x = rng.integers(-scale * 256, scale * 256, size=(300, 6))
        own = np.concatenate([np.zeros((1, 6), np.int64), x[:20]])
        d = pivots.distances(x, own)
        exact = bool(4 * d[:, 0].max() ** 2 < pivots.EXACT)
        s = pivots.Search(np.arange(300), x, d, np.zeros(300, np.int64), 3, exact)
        apart = np.abs(d[:, None, :] - d[None, :, :]).max(axis=2)
        assert (s.upper(slice(0, 300), apart, d[:, 0]) >= (x.astype(object) @ x.T.astype(object)).astype(float)).all()
