"""Repeated passages: planted ones are found, clean texts are left alone, boundaries resist shifts."""

import random
from collections import defaultdict

from tarnwright.llm import substring_dedup
from tarnwright.llm.queries import op4_substrings

from .conftest import DATA, DOCS, doc


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_chunks_cover_the_text_and_depend_on_its_own_bytes():
    rng = random.Random(1)
    docs = [words(rng, n).encode() for n in (1, 5, 50, 800)] + [b"", b"a" * 3000]
    together = substring_dedup.cuts(docs)
    assert together == [substring_dedup.cuts([d])[0] for d in docs]
    for d, ends in zip(docs, together, strict=True):
        assert (ends[-1] if ends else 0) == len(d)
        assert all(b - a <= substring_dedup.MOST for a, b in zip([0, *ends], ends, strict=False))


def test_an_insertion_moves_few_boundaries():
    text = words(random.Random(2), 2000).encode()
    one = set(substring_dedup.cuts([text])[0])
    two = {e - 7 for e in substring_dedup.cuts([b"inserts" + text])[0]}
    assert len(one - two) <= 5


def test_planted_passages(spark):
    rng = random.Random(3)
    planted = [words(rng, 55 + i % 30) for i in range(60)]
    rows = [(i, words(rng, rng.randrange(0, 80)) + " " + planted[i // 2] + " " + words(rng, rng.randrange(0, 80))) for i in range(120)]
    rows += [(1000 + i, words(rng, 120)) for i in range(60)]
    got = defaultdict(list)
    for r in substring_dedup.repeated_passages(spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)).collect():
        got[r["doc_id"]].append(r)
    assert not [d for d in got if d >= 1000]
    assert len(got) >= 118
    text = dict(rows)
    for d, found in got.items():
        for r in found:
            assert text[d].encode()[r["start_byte"] : r["end_byte"]].decode() in planted[d // 2] + " "
            assert (r["owner_id"], r["redundant"]) == (d // 2 * 2, d % 2 == 1)


def test_whole_table_against_word_windows(spark, texts):
    held = defaultdict(set)
    for d, t in texts:
        w = t.split()
        for i in range(len(w) - 49):
            held[tuple(w[i : i + 50])].add(d)
    true = {d for ds in held.values() if len(ds) > 1 for d in ds}
    shared = defaultdict(set)
    for d, t in texts:
        w = t.split()
        for i in range(len(w) - 11):
            shared[tuple(w[i : i + 12])].add(d)
    clean = {d for d, _ in texts} - {d for ds in shared.values() if len(ds) > 1 for d in ds}
    got = {r["doc_id"] for r in op4_substrings(spark, DATA).collect()}
    assert len(true - got) <= 0.02 * len(true) and not got & clean


def merged(rows):
    """Pieces by plain code: chunks, owners, runs."""
    import xxhash

    cut = {}
    for d, t in dict.fromkeys(rows):
        raw = t.encode()
        ends = substring_dedup.cuts([raw])[0]
        cut[d, t] = [(a, b, xxhash.xxh3_64_intdigest(raw[a:b])) for a, b in zip([0, *ends], ends, strict=False)]
    held, first = defaultdict(set), {}
    for (d, t), cs in sorted(cut.items()):
        for a, _, x in cs:
            held[x].add(d)
            first.setdefault((x, d), a)
    out = set()
    for (d, t), cs in cut.items():
        raw, passages = t.encode(), []
        n_words = lambda a, b: len((raw[a:b] if a == 0 or raw[a - 1 : a].isspace() else b"x" + raw[a:b]).split()) - (a > 0 and not raw[a - 1 : a].isspace())  # noqa: B023, E731
        for a, b, x in cs:
            if len(held[x]) < 2:
                continue
            owner = min(held[x])
            shift = 0 if owner == d else first[x, owner] - a
            if passages and passages[-1][-1][1] == a:
                if passages[-1][-1][2:4] == [owner, shift]:
                    passages[-1][-1][1] = b
                    passages[-1][-1][4] += 1
                else:
                    passages[-1].append([a, b, owner, shift, 1])
            else:
                passages.append([[a, b, owner, shift, 1]])
        for p in passages:
            if n_words(p[0][0], p[-1][1]) >= substring_dedup.CORE_WORDS:
                out |= {(d, a, b, n_words(a, b), n, owner, owner != d) for a, b, owner, _, n in p}
    return out


def test_whole_table_equals_plain_merging(spark, texts):
    got = [tuple(r)[:7] for r in op4_substrings(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == merged(texts)


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    """Two texts under one id: cuts are those of the text they were found in, and nothing unrepeated is lost."""
    rng = random.Random(11)
    passage, other = words(rng, 120), words(rng, 150)
    plain = words(rng, 300)
    rows = [(1, words(rng, 40) + " " + passage), (2, plain), (2, other[:50] + " " + passage), (2, plain), (3, plain + " x")]
    frame = spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)
    got = substring_dedup.repeated_passages(frame).collect()
    assert {tuple(r)[:7] for r in got} == merged(rows) and len(got) == len(merged(rows))
    out = sorted((r["doc_id"], r["text"]) for r in substring_dedup.without_repeats(frame).collect())
    assert len(out) == 5 and out.count((2, plain)) == 2 and (1, rows[0][1]) in out
    cut = next(t for d, t in out if d == 2 and t != plain)
    assert cut.startswith(other[:50]) and len(cut) < 150


def test_words_repeated_over_and_over_fall_into_step(spark):
    rows = [(1, words(random.Random(1), 30) + " " + "Ononea " * 90), (2, words(random.Random(2), 33) + "! " + "Ononea " * 70 + "end"), (3, words(random.Random(3), 90))]
    got = {r["doc_id"] for r in substring_dedup.repeated_passages(spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)).collect()}
    assert got == {1, 2}


def test_cutting_leaves_the_owner_whole(spark):
    rng = random.Random(4)
    passage = words(rng, 100)
    rows = [(1, "début " + passage), (2, "fin " + passage + " ende ñ")]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)).collect()}
    assert out[1] == rows[0][1] and len(out[2]) < 120 and out[2].startswith("fin") and out[2].endswith("ñ")


def test_one_shared_chunk_does_not_give_a_passage_away(spark):
    """Documents 2 and 3 are copies; document 1 holds one chunk of theirs, and all of them letters of two bytes."""
    copy = words(random.Random(5), 400).replace("a", "é")
    raw = copy.encode()
    ends = substring_dedup.cuts([raw])[0]
    at = next(i for i in range(60, len(ends)) if ends[i] - ends[i - 1] >= 40)
    # from the chunk before on, so that cuts fall into step
    rows = [(1, words(random.Random(6), 60) + " " + raw[ends[at - 3] : ends[at] + 3].decode("utf-8", "ignore") + " " + words(random.Random(7), 60)), (2, copy), (3, copy)]
    rows += [(i, words(random.Random(i), 60)) for i in (4, 5)]
    frame = spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)
    text = {i: t.encode() for i, t in rows}
    held = defaultdict(set)
    for d, b in text.items():
        found = substring_dedup.cuts([b])[0]
        for x, y in zip([0, *found], found, strict=False):
            held[b[x:y]].add(d)
    repeated = {c for c, ds in held.items() if len(ds) > 1}
    assert any(held[c] == {1, 2, 3} for c in repeated)
    got = substring_dedup.repeated_passages(frame).collect()
    assert {2, 3} <= {r["doc_id"] for r in got}
    for r in got:
        assert text[r["doc_id"]][r["start_byte"] : r["end_byte"]] in text[r["owner_id"]]
        assert r["redundant"] == (r["owner_id"] != r["doc_id"])
    out = {r["doc_id"]: r["text"].encode() for r in substring_dedup.without_repeats(frame).collect()}
    assert all(any(c in b for b in out.values()) for c in repeated)
    assert out[1] == text[1] and len(out[3]) < 60


def test_owners_hold_what_is_reported_in_the_order_reported(spark):
    a, b = (words(random.Random(i), 100) for i in (8, 9))
    rows = [(1, a + " . " + b), (2, b + " . " + a), (3, b + " . " + a)]
    text = {i: t.encode() for i, t in rows}
    got = substring_dedup.repeated_passages(spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3}
    for r in got:
        assert text[r["doc_id"]][r["start_byte"] : r["end_byte"]] in text[r["owner_id"]]


def test_edges(odd_docs, no_docs):
    assert substring_dedup.repeated_passages(odd_docs).count() == 0
    assert substring_dedup.repeated_passages(no_docs).count() == 0
    out = substring_dedup.without_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == 9
