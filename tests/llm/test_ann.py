"""Nearest neighbours against brute force; bounds; edge cases."""

import numpy as np

from tarnwright.llm import ann
from tarnwright.llm.queries import op6_ann

from .conftest import DATA


def test_whole_table_equals_sql(spark, tables, same):
    same(op6_ann(spark, DATA), tables.sql(ann.oracle_sql()))


def test_recall(spark, tables):
    truth = spark.createDataFrame(tables.sql(ann.oracle_sql()).df())
    assert ann.recall(op6_ann(spark, DATA), truth) >= 0.99


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(0)
    for dim in (8, 64):
        turn = ann.rotation(dim)
        assert np.allclose(turn @ turn.T, np.eye(dim))
        o, q = rng.normal(size=(500, dim)), rng.normal(size=(200, dim))
        codes, length, f = ann.encode(o, turn)
        signs = np.unpackbits(codes, axis=1, count=turn.shape[1]) * 2.0 - 1
        guess = (length / f)[:, None] * (signs @ (q @ turn).T / turn.shape[1] ** 0.5)
        bound = (np.sqrt(1 - f * f) / f * length)[:, None] * np.linalg.norm(q, axis=1) * ann.EPSILON / (turn.shape[1] - 1) ** 0.5
        assert np.mean(np.abs(guess - o @ q.T) <= bound) > 0.999


def test_counted_bits_give_the_products_of_codes():
    """What is counted from packed words equals the product of unpacked codes and rounded queries, and bounds hold with the rounding."""
    rng = np.random.default_rng(2)
    o, q = rng.normal(size=(300, 20)), rng.normal(size=(50, 20))
    search = ann.Search(np.arange(50), q, np.full(50, -np.inf), 5)
    turn = ann.rotation(20)
    codes, length, f = ann.encode(o, turn)
    signs = np.unpackbits(codes, axis=1, count=turn.shape[1]) * 2.0 - 1
    words = np.ascontiguousarray(codes.view(np.uint64).T)
    got = search.estimates(np.arange(50), words, np.bitwise_count(words).sum(axis=0))
    turned = q @ turn
    level = np.rint((turned - search.low[:, None]) / search.step[:, None])
    rounded = search.low[:, None] + search.step[:, None] * level
    true = (signs @ rounded.T + rounded.sum(axis=1) - turned.sum(axis=1)) / turn.shape[1] ** 0.5
    assert np.abs(got - true).max() < 1e-4
    bound = (length / f)[:, None] * search.slack(np.arange(50), f)
    assert np.mean(np.abs((length / f)[:, None] * got - o @ q.T) <= bound) > 0.999


def test_clustered_vectors_spare_most_of_the_table(spark, monkeypatch):
    """Blocks that cannot hold a better neighbour are not looked at; what is found equals brute force."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16)) * 4
    v = np.concatenate([c + 0.05 * rng.normal(size=(150, 16)) for c in centres]).astype(np.float32).astype(float)
    rng.shuffle(v)
    stored_cells = ann.cells(v)
    own = ann.nearest_centre(v, stored_cells)
    order = np.argsort(own, kind="stable")
    ids = np.arange(len(v))
    q = np.flatnonzero(ids % 20 == 0)
    search = ann.Search(q, v[q], ann.floors(q, v[q], ids[:800], v[:800], 20), 20)
    looked, counted = [], ann.Search.estimates
    monkeypatch.setattr(ann.Search, "estimates", lambda self, some, codes, ones: looked.append(len(some) * codes.shape[1]) or counted(self, some, codes, ones))
    codes, length, f = ann.encode(v, ann.rotation(16))
    for c in np.unique(own):
        part = order[own[order] == c]
        search.block(part, v[part], codes[part], length[part], f[part])
    assert sum(looked) < 0.25 * len(v) * len(q)
    for i, x in enumerate(q):
        score = v @ v[x]
        score[x] = -np.inf
        assert set(search.found[i].tolist()) == set(np.argsort(-score, kind="stable")[:20].tolist())


def test_ties_blocks_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(300)]
    rows += [(400 + i, [1.0, 1.0, 1.0, 1.0, 1.0, 1.0]) for i in range(60)]
    odd = [(500, None), (520, [0.0] * 6), (540, [None] + [1.0] * 5), (560, [float("nan")] * 6), (580, [float("inf")] * 6), (None, [1.0] * 6), (600, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows + odd], "vec_id long, embedding array<float>, score string").repartition(3)
    got = {}
    for r in ann.nearest(frame).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    usable = {i: np.array(v) for i, v in rows if any(v)}
    assert set(got) == {i for i in usable if i % 20 == 0}
    for q, found in got.items():
        true = sorted(((-float(usable[q] @ v), i) for i, v in usable.items() if i != q))[:20]
        assert [(i, -s) for s, i in true] == [found[k] for k in range(1, 21)]


def test_few_rows_repeated_rows_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.9, 0.0]), (0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:3] for r in ann.nearest(frame).collect()] == [(0, 1, 1)]
    assert ann.nearest(frame.limit(0)).count() == 0
    assert ann.nearest(frame.where("vec_id = 1")).count() == 0
