"""Language-model scores: exact base, the filter's one-sided error, held-out gain, edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from tarnwright.llm import lm_score
from tarnwright.llm.queries import op10_lmscore

from .conftest import DATA, DOCS, doc


def counts_of(rows):
    c = Counter()
    for d, t in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            c.update([*(t or "").encode().lower().split(), b"\n"])
    return c


def check(frame, rows):
    c = counts_of(rows)
    n, v = sum(c.values()), len(c)
    text = {d: t for d, t in rows}
    got = frame.collect()
    for r in got:
        w = [*(text[r["doc_id"]] or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert abs(r["base_score"] - base) <= 1e-9 * max(1, abs(base))
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert r["score"] <= 0 and math.isfinite(r["score"])
    return got


def test_whole_table(spark, texts):
    got = check(op10_lmscore(spark, DATA), texts)
    assert len(got) == len(texts)
    held = [r for r in got if r["held_out"]]
    seen = [r for r in got if not r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert sum(r["score"] for r in seen) > sum(r["base_score"] for r in seen)


def test_rare_words_meet_their_counts_by_the_shuffle(spark, texts, documents, monkeypatch):
    monkeypatch.setattr(lm_score, "MOST_WORDS", 50)
    check(lm_score.score_documents(documents), texts)


def test_tokens_are_words_and_ends(monkeypatch):
    rng = random.Random(4)
    docs = ["".join(rng.choice("ab Zz\t\n\x0b\x1cé ") for _ in range(rng.randrange(60))).encode() for _ in range(300)] + [b"", b"x" * 2000, b"  y"]
    plain = [w for d in docs for w in [*d.lower().split(), b"\n"]]
    for slab in (lm_score._SLAB, 64):
        monkeypatch.setattr(lm_score, "_SLAB", slab)
        words, length = lm_score.tokens(docs)
        assert length.tolist() == [len(d.split()) + 1 for d in docs]
        known = {}
        assert all(known.setdefault(w, h) == h for w, h in zip(plain, words.tolist(), strict=True)) and len(set(known.values())) == len(known)
    assert len(lm_score.tokens([])[0]) == 0


def test_packing_keeps_keys():
    key = np.unique(np.random.default_rng(1).integers(0, 1 << 56, 5000).astype(np.uint64))
    for some in (key, key[:1], key[:0]):
        assert (lm_score.unpacked(lm_score.packed(some)) == some).all()
    parts = lm_score.part_of(key, 7)
    assert (np.diff(parts) >= 0).all() and set(parts.tolist()) == set(range(7))
    assert (lm_score.part_of(key, 7 * 32) // 32 == parts).all()


def test_the_filter_never_underestimates():
    rng = np.random.default_rng(0)
    key = np.unique(rng.integers(0, 1 << 56, 4000).astype(np.uint64))
    n = np.minimum(rng.zipf(1.4, len(key)), 10_000_000)
    segment = lm_score.part_of(key, 3)
    f = lm_score.Filter(np.array([lm_score.Filter.lines_for(n[segment == s]) for s in range(3)]))
    f.enter(key, n, segment)
    true = f.entries(n)
    levels = f.levels(key, segment)
    assert (levels >= true).all() and np.mean(levels == true) > 0.9
    other = rng.integers(0, 1 << 56, 4000).astype(np.uint64)
    assert np.mean(f.levels(other, lm_score.part_of(other, 3)) == 0) > 0.9
    level = np.searchsorted(lm_score.LOWS, n, side="right") - 1
    assert np.all((lm_score.MIDDLES[level] >= lm_score.LOWS[level] * 0.99) & (lm_score.MIDDLES[level] < lm_score.LOWS[level + 1]))


def test_filters_too_large_to_broadcast_give_the_same_scores(spark, texts, documents, monkeypatch):
    for blocks, groups in ((1 << 22, 1 << 25), (30_000, 100_000)):
        monkeypatch.setattr(lm_score, "BLOCK_BYTES", blocks)
        monkeypatch.setattr(lm_score, "GROUP_BYTES", groups)
        monkeypatch.setattr(lm_score, "BROADCAST_BYTES", 1 << 27)
        here = {tuple(r) for r in check(lm_score.score_documents(documents), texts)}
        monkeypatch.setattr(lm_score, "BROADCAST_BYTES", 0)
        there = {tuple(r) for r in check(lm_score.score_documents(documents), texts)}
        near = lambda rows: sorted((r[:5], round(r[5], 6), r[6]) for r in rows)
        assert near(here) == near(there)


def test_documents_that_occur_twice_gain_more(spark):
    """Each pair of a repeated text has count 2 at least; the model tells such texts from those that occur once."""
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(120))
    rows = [(i, text()) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(40)]
    trained = lambda d: zlib.crc32(str(d).encode()) % 10 > 0
    got = {r["doc_id"]: r["gain_per_token"] for r in lm_score.score_documents(spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)).collect()}
    twice = [got[i] for i in range(40) if trained(i) and trained(1000 + i)]
    once = [got[i] for i in range(40, 300) if trained(i)]
    assert min(twice) > max(once)


def test_scores_follow_the_counts_of_all_pairs(spark, monkeypatch):
    """Against the formula with exact counts on the filter's scale; the filter is all but empty, so that nothing collides."""
    monkeypatch.setattr(lm_score, "BITS_A_LEVEL", 4096)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh", f"w{rng.randrange(300)}"]) for _ in range(30))) for i in range(60)]
    trained = [["\n", *t.split(), "\n"] for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    word = Counter(w for ws in trained for w in ws[1:])
    pair = Counter(p for ws in trained for p in zip(ws, ws[1:], strict=False))
    n, v = sum(word.values()), len(word)
    scale = lambda c: float(lm_score.MIDDLES[np.searchsorted(lm_score.LOWS, c, side="right") - 1]) if c else 0.0
    assert sum(c == 1 for c in pair.values()) > 100
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)).collect()}
    for d, t in rows:
        ws = ["\n", *t.split(), "\n"]
        one = lambda w: (scale(word[w]) + 0.1) / (n + 0.1 * (v + 1))
        p = [(min(scale(pair[h, w]), scale(word[h])) + lm_score.PRIOR * one(w)) / (scale(word[h]) + lm_score.PRIOR) for h, w in zip(ws, ws[1:], strict=False)]
        assert abs(got[d] - sum(math.log10(min(x, 1)) for x in p)) < 1e-6, d


def test_edges(spark, odd_docs, no_docs):
    rows = lm_score.score_documents(odd_docs).collect()
    assert len(rows) == 9
    for r in rows:
        if r["doc_id"] in (2, 3, 6, 7):
            assert r["n_tokens"] == 1
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 4} == {60_001}
    assert lm_score.score_documents(no_docs).count() == 0
    alone = lm_score.score_documents(odd_docs.where("doc_id is null")).first()
    assert (alone["train_tokens"], alone["n_known"], alone["base_score"]) == (0, 0, 0.0)


def test_a_group_probes_each_segment_once_for_all_blocks(monkeypatch):
    """However many blocks ask; n-grams of held-out documents only have no level unless the filter errs."""
    rng = np.random.default_rng(5)
    groups, group, asked = 3, 1, []
    for block in range(200):
        key = np.unique(rng.integers(0, 1 << 40, 300).astype(np.uint64) * np.uint64(3) << np.uint64(14))
        key = key[lm_score.part_of(key, groups) == group]
        asked.append({"block": block, "keys": lm_score.packed(key), "counts": (key >> np.uint64(20) & np.uint64(1)).astype(np.uint8).tobytes()})
    calls, probe = [], lm_score.Filter.levels
    monkeypatch.setattr(lm_score.Filter, "levels", lambda self, key, segment: calls.append(len(key)) or probe(self, key, segment))
    rows = [dict(r) for r in asked]
    own = lm_score.Group(group, groups, iter(rows), lm_score.BITS_A_LEVEL)
    words = list(own.levels())
    assert len(calls) <= lm_score.SEGMENTS
    count = Counter()
    for r in asked:
        for k, n in zip(lm_score.unpacked(r["keys"]).tolist(), r["counts"], strict=True):
            count[k] += n
    assert sum(calls) == len(count)
    assert {int(k): int(n) for key, n in words for k, n in zip(key, n, strict=True)} == {k: n for k, n in count.items() if n and not k & 3}
    known = false = 0
    for r, levels in zip(asked, own.answers, strict=True):
        true = np.searchsorted(lm_score.LOWS, [count[k] for k in lm_score.unpacked(r["keys"]).tolist()], side="right")
        assert (levels >= true).all()
        known, false = known + len(true), false + int((levels > true).sum())
    assert [r["block"] for r in own.rest] == list(range(200)) and false < 0.1 * known
