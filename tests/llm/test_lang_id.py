"""Language identification: gradients, held-out accuracy, edge cases."""

import zlib

import numpy as np

from tarnwright.llm import lang_id
from tarnwright.llm.queries import op2_langid

from .conftest import DATA, doc


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    net = lang_id._start(["a", "b", "c"], rng)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    parts = [b"abc ab", b"cab", b"b"]
    length = np.array([len(p) for p in parts])
    x, live = lang_id._lanes(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length)
    there = (np.arange(3) < live[:, None]).astype(float)
    y = np.array([0, 1, 2])

    def loss():
        p = lang_id._labels(net, x, live)[y, :, np.arange(3)].T
        return -np.where(there > 0, np.log(p), 0).sum() / there.sum()

    g = lang_id._gradient(net, x, live, y, there)
    for name in g:
        w = net.weights[name]
        for i in [tuple(i) for i in np.argwhere(np.abs(g[name]) > 1e-4)[:4]]:
            before = w[i]
            w[i] = before + 1e-4
            high = loss()
            w[i] = before - 1e-4
            low = loss()
            w[i] = before
            assert abs((high - low) / 2e-4 - g[name][i]) < 2e-3 * max(1, abs(g[name][i]))


def small_network(texts):
    rows = [(t[i : i + lang_id.SEGMENT], "odd" if d % 2 else "even") for d, t in texts[:60] for i in range(0, len(t), lang_id.SEGMENT)]
    return lang_id.train(rows[:400])


def test_states_are_carried_along_the_text(texts, monkeypatch):
    """Read in stretches or in one go, the labels are the same; and they depend on what stands before a word."""
    net = small_network(texts)
    raw = [t.encode() for _, t in texts if len(t) > 3 * lang_id.STRETCH][:12] + ["你好世界".encode() * 500]
    parted = lang_id._sums(net, raw)
    monkeypatch.setattr(lang_id, "STRETCH", 1 << 30)
    whole = lang_id._sums(net, raw)
    share = lambda s: s / s.sum(axis=1, keepdims=True)
    assert np.abs(share(parted) - share(whole)).max() < 1e-5
    alone, after = (lang_id._sums(net, [b])[0] for b in (b"the", b"zz xyq the"))
    without = lang_id._sums(net, [b"zz xyq"])[0]
    assert np.abs(after - without - alone).max() > 1e-4


def test_every_letter_of_a_long_text_counts(texts, monkeypatch):
    net = small_network(texts)
    raw = [("é" * 5000).encode(), b"a1 " * 3000]
    monkeypatch.setattr(lang_id, "PART_BYTES", 100)
    assert np.allclose(lang_id._sums(net, raw).sum(axis=1), [10_000, 3000], rtol=1e-5)
    assert lang_id.predict(net, [b"", *raw, b"12 ..", "—…".encode()])[0][0] == "und"
    assert lang_id.predict(net, [b"12 ..", "—…".encode()]) == (["und", "und"], [0.0, 0.0])


def test_training_pieces_come_from_everywhere_and_are_bounded(spark, monkeypatch):
    """A text however long is drawn from over its whole length; repeated rows add nothing."""
    drawn = []
    monkeypatch.setattr(lang_id, "train", lambda rows, seed=7: drawn.append(rows))
    monkeypatch.setattr(lang_id, "MOST_SEGMENTS", 200)
    long = " ".join(f"w{i}" for i in range(40_000))
    lang_id.learned(spark.createDataFrame([doc(1, long, "en"), doc(1, long, "en"), doc(2, "kurz und gut", "de"), doc(3, "petit", "fr")], "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept string, rate int, `row` string"))
    places = [long.index(t) / len(long) for t, k in drawn[0] if k == "en"]
    assert 30 < len(places) < 110 and min(places) < 0.1 and max(places) > 0.9 and len({t for t, _ in drawn[0]}) == len(drawn[0])


def test_whole_table(spark, documents):
    rows = op2_langid(spark, DATA).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_labels_of_held_out_rows_do_not_matter(spark, documents):
    from pyspark.sql import functions as F

    other = documents.withColumn("lang", F.when(lang_id.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a = lang_id.train([(r["text"], r["lang"]) for r in documents.where(~lang_id.held_out()).limit(40).collect()])
    assert "xx" not in {r["lang_pred"] for r in lang_id.identify(other, a).collect()}
    assert lang_id.learned(other).langs == lang_id.learned(documents).langs


def test_edges(spark, odd_docs, no_docs):
    rows = lang_id.identify(odd_docs).collect()
    assert len(rows) == 9
    for r in rows:
        if r["doc_id"] in (2, 3, 5, 6, 7):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert (r["lang_pred"], r["score"]) == ("en", 1.0)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {True}
    assert lang_id.identify(no_docs).count() == 0 and lang_id.accepted(no_docs).count() == 0
    kept = lang_id.accepted(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "4", "None"]
    unlabelled = spark.createDataFrame([doc(1, "some words", None)], odd_docs.schema)
    assert lang_id.identify(unlabelled).first()["lang_pred"] == "und"
