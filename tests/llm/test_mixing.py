"""Mixing against projected gradients in numpy, targets, plans without Python, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwright.llm import mixing
from tarnwright.llm.queries import op1_mixing

from .conftest import DATA


def test_whole_table_meets_the_targets(spark, documents):
    rows = op1_mixing(spark, DATA).toPandas()
    assert len(rows) == documents.count() and (rows.rate >= 0).all()
    p = rows[[f"p_{d}" for d in mixing.TARGETS]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1)
    got = (rows.rate.to_numpy() * rows.n_words.to_numpy())[:, None] * p
    assert np.allclose(got.sum(axis=0) / rows.n_words.sum(), list(mixing.TARGETS.values()), atol=2e-3)


def test_labels_are_learned(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", mixing.quality_domain().alias("domain"))
    rows = mixing.mix(documents, labels).join(labels, "doc_id").toPandas()
    best = rows[[f"p_{d}" for d in mixing.TARGETS]].to_numpy().argmax(axis=1)
    assert np.mean([list(mixing.TARGETS)[b] == d for b, d in zip(best, rows.domain, strict=True)]) > 0.85


def reference(n, p, targets, budget):
    """The same projected gradients, plainly."""
    goal = np.array(targets) / sum(targets) * budget
    share = n / n.sum()
    m = (share[:, None, None] * p[:, :, None] * p[:, None, :]).sum(axis=0)
    w = 1 / np.maximum(np.diag(m), 1e-9)
    step = 1 / np.linalg.eigvalsh(m * np.sqrt(w[:, None] * w[None])).max()
    r = np.ones(len(n))
    for _ in range(mixing.STEPS):
        off = (r * share) @ p - goal
        if (np.abs(off) / np.maximum(goal, 1e-3)).max() < mixing.EXACT:
            break
        r = np.maximum(0, r - step * (p @ (w * off)))
    return r


@pytest.mark.parametrize("targets", [[0.6, 0.3, 0.1], [1.0, 0.0, 0.0], [0.2, 0.2, 0.6]])
def test_rates_equal_plain_gradients(spark, targets):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    n = rng.integers(1, 500, 300)
    members = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(300)], "doc_id long, n_words long, p0 double, p1 double, p2 double")
    got = mixing.rates(members, targets, 1.5).orderBy("doc_id").toPandas().rate.to_numpy()
    assert (got >= 0).all() and np.allclose(got, reference(n, p, targets, 1.5), atol=1e-6)
    miss = mixing.rates(members, targets, 1.5).first()["target_miss"]
    goal = np.array(targets) / sum(targets) * 1.5
    assert miss == pytest.approx((np.abs((got * n) @ p / n.sum() - goal) / np.maximum(goal, 1e-3)).max(), rel=1e-6, abs=1e-9)


def test_posteriors_equal_plain_naive_bayes(spark, documents):
    """Log-likelihoods of hashed words, tempered, with priors: by plain code over the same buckets."""
    import math
    from collections import Counter

    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", mixing.quality_domain().alias("domain"))
    domains = list(mixing.TARGETS)
    bucket = {r["w"]: r["b"] for r in documents.select(F.explode(mixing.words()).alias("w")).distinct().select("w", mixing._bucket("w").alias("b")).collect()}
    text = {r["doc_id"]: [w for w in r["w"] if w] for r in documents.select("doc_id", mixing.words().alias("w")).collect()}
    domain = {r["doc_id"]: r["domain"] for r in labels.collect() if r["domain"] and r["doc_id"] is not None}
    count, size = {k: Counter() for k in domains}, Counter(domain.values())
    for d, k in domain.items():
        count[k].update(bucket[w] for w in text.get(d, ()))
    met = set().union(*count.values())
    prior = [math.log((size[k] + 1) / (sum(size.values()) + len(domains))) for k in domains]
    weight = {b: [math.log((count[k][b] + 0.5) / (sum(count[k].values()) + 0.5 * mixing.BUCKETS)) for k in domains] for b in met}
    rows = {r["doc_id"]: r for r in mixing.posteriors(documents, labels, domains).collect()}
    for d, ws in text.items():
        known = [weight[bucket[w]] for w in ws if bucket[w] in met]
        score = [p + sum(x[i] for x in known) * mixing.TEMPER / (len(known) + mixing.TEMPER) for i, p in enumerate(prior)]
        e = [math.exp(x - max(score)) for x in score]
        assert rows[d]["n_words"] == len(ws)
        assert np.allclose([rows[d][f"p{i}"] for i in range(len(domains))], np.array(e) / sum(e), atol=1e-9)


def test_free_steps_equal_passes(spark, monkeypatch):
    """While no rate can be clipped no pass is made, and the rates are those of passes."""
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet([2, 2, 2], 200), rng.integers(1, 100, 200)
    members = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(200)], "doc_id long, n_words long, p0 double, p1 double, p2 double")
    rows = mixing.rates(members, [0.4, 0.3, 0.3]).orderBy("doc_id").toPandas()
    assert np.allclose(rows.rate, reference(n, p, [0.4, 0.3, 0.3], 1.0), atol=1e-9) and rows.target_miss[0] < 1e-2


def test_no_python_in_the_plan(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", mixing.quality_domain().alias("domain"))
    plan = mixing.posteriors(documents, labels, list(mixing.TARGETS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_drawing_follows_the_rates(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", mixing.quality_domain().alias("domain"))
    out = mixing.drawn(documents, labels, budget=3.0)
    assert out.columns == documents.columns
    rate = {r["doc_id"]: r["rate"] for r in mixing.mix(documents, labels, budget=3.0).collect()}
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    for d, r in rate.items():
        assert int(r) <= times.get(d, 0) <= int(r) + 1


def test_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, "good"), (1, "good"), (4, "poor"), (None, "good"), (3, None)], "doc_id long, domain string")
    rows = mixing.mix(odd_docs, labels).collect()
    assert len(rows) == 9
    for r in rows:
        if r["doc_id"] in (2, 3, 6, 7):
            assert r["n_words"] == 0
        assert sum(r[f"p_{d}"] for d in mixing.TARGETS) == pytest.approx(1) and r["rate"] >= 0
    assert {r["n_words"] for r in rows if r["doc_id"] == 4} == {60_000}
    none = mixing.mix(odd_docs, labels.limit(0)).collect()
    assert all(r["p_good"] == pytest.approx(0.25) for r in none)
    out = mixing.drawn(odd_docs, labels)
    assert out.columns == odd_docs.columns and out.where(F.col("doc_id").isNull()).count() == 1
    assert mixing.mix(no_docs, labels).count() == 0 and mixing.drawn(no_docs, labels).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd_docs, labels, {"good": -1.0, "poor": 2.0}).count()
