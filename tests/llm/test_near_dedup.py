"""Near duplicates against brute force: components, hot groups, edge cases."""

import random
from collections import Counter, defaultdict

from tarnwright.llm import near_dedup
from tarnwright.llm.queries import op8_minhash

from .conftest import DATA, DOCS, doc


def brute(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    held, parent = defaultdict(list), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        for o, n in Counter(o for x in s for o in held[x]).items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(d), find(o)))
                parent[b] = a
        for x in s:
            held[x].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def compare(frame, rows):
    true = brute(rows)
    got = {r["doc_id"]: r for r in frame.collect()}
    assert len(got) == len(true)
    for d, (n, c) in true.items():
        assert (got[d]["n_shingles"], got[d]["component_id"], got[d]["kept"]) == (n, c, c == d), d


def test_whole_table(spark, texts):
    compare(op8_minhash(spark, DATA), texts)


def edited(rng, words, share):
    return " ".join(rng.choice(("x", "y", "z")) + str(rng.randrange(999)) if rng.random() < share else w for w in words)


def test_a_hot_group_with_chains_and_borderline_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(160)]
    rows = [(i, edited(rng, base, rng.choice((0.0, 0.005, 0.02, 0.03, 0.05, 0.08)))) for i in range(400)]
    shared = [word() for _ in range(60)]
    rows += [(1000 + i, " ".join(shared + [word() for _ in range(25)])) for i in range(150)]
    at = [word() for _ in range(100)]
    for i in range(40):  # a chain: each is near the next, the ends are far apart
        rows.append((2000 + i, " ".join(at)))
        at = at[4:] + [word() for _ in range(4)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([doc(i, t) for i, t in rows], DOCS).repartition(4)
    compare(near_dedup.near_duplicates(frame), rows)


def test_many_blocks_of_one_bucket(spark, monkeypatch):
    rng = random.Random(8)
    base = ["w%d" % i for i in range(120)]
    rows = [(i, edited(rng, base, rng.choice((0.02, 0.05, 0.06)))) for i in range(160)]
    for name, size in (("BLOCK", 16), ("FAMILY_BLOCK", 8), ("SPOKES", 4), ("BROADCAST_ROWS", 1)):
        monkeypatch.setattr(near_dedup, name, size)
    compare(near_dedup.near_duplicates(spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)), rows)


def test_sketches_of_linked_pairs_meet_and_are_alike():
    """Pairs at exactly 75 %, 2000 at each size: all share a band, and none that asks its sketches is told to be unlike."""
    np, rng = near_dedup.np, near_dedup.np.random.default_rng(4)
    for union in (4, 8, 16, 32, 40, 64, 100):
        for _ in range(2000):
            x = rng.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2)
            more = union // 4
            a, b = np.sort(x[: union - more // 2]), np.sort(np.concatenate([x[: union - more], x[union - more // 2 :]]))
            assert 100 * (union - more) >= 75 * union
            one, two = near_dedup.sketch(a), near_dedup.sketch(b)
            assert (one == two).any(), union
            if min(len(a), len(b)) > near_dedup.SMALL:
                assert (one.view(np.uint16) == two.view(np.uint16)).sum() >= near_dedup.LEAST_AGREEING


def test_many_small_sets_in_one_bucket(spark):
    """Short texts that share most words: brute force decides each link, sketches do not."""
    rng = random.Random(12)
    rows = []
    for i in range(250):
        w = ["a", "b", "c", "d", "e", "f", "g", "h"]
        for _ in range(rng.choice((0, 1, 1, 2))):
            w[rng.choice((0, 7, 7))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w + [f"y{rng.randrange(6)}"] * rng.choice((0, 1)))))
    compare(near_dedup.near_duplicates(spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)), rows)


def test_short_texts(spark):
    rows = [(1, "a b c"), (2, "A  b\nc"), (3, "a b"), (4, ""), (5, "."), (6, "a b c d e"), (7, "A B C D E"), (8, " \t ")]
    compare(near_dedup.near_duplicates(spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)), rows)


def test_edges(odd_docs, no_docs):
    rows = near_dedup.near_duplicates(odd_docs).collect()
    assert len(rows) == 9
    for r in rows:
        assert r["kept"] and r["component_id"] == r["doc_id"]
    assert {r["n_shingles"] for r in rows if r["doc_id"] == 4} == {1}
    kept = near_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7", "None"]
    assert near_dedup.near_duplicates(no_docs).count() == 0 and near_dedup.deduplicated(no_docs).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in near_dedup.components(links).collect()}
    assert got == {**{i: 1 for i in range(2, 201)}, 501: 500}
