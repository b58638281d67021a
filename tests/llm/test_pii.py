"""Personal data against plain patterns; what the trees add, and what they leave alone."""

import hashlib
import random
import re

import pytest

from tarnwright.llm import pii
from tarnwright.llm.queries import op3_pii

from .conftest import DATA

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()  # noqa: B023
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], pii.ORDER[s[1]]))


def test_base_layer_equals_the_patterns(texts):
    rng = random.Random(3)
    made = ["".join(rng.choice("0123456789..@@ab-+() é%_0012") for _ in range(rng.randrange(45))) for _ in range(20_000)]
    for t in [*made, *(t for _, t in texts)]:
        assert sorted(pii.base_spans(t), key=lambda s: (s[0], pii.ORDER[s[1]])) == brute(t), t


def test_whole_table(spark, texts):
    got = {r["doc_id"]: r for r in op3_pii(spark, DATA).collect()}
    for d, t in texts:
        spans = brute(t)
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == k for s in spans) for k in pii.KINDS]
        assert got[d]["base_sha256"] == hashlib.sha256(pii.listed(spans).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, k, b in spans} <= set(got[d]["spans"].split(","))  | {""}
    # what the trees add, against every candidate judged by itself
    trees = pii.model()
    for d, t in texts:
        base = pii.base_spans(t)
        more = [c for c in pii.candidates(t) if not any(a <= c[0] and c[2] <= b for a, _, b in base) and trees.margin(pii.np.array([pii.features(t, c)]))[0] > trees.bound[c[1]]]
        every = sorted({*base, *more}, key=lambda s: (s[0], pii.ORDER[s[1]], s[2]))
        assert (got[d]["spans"], got[d]["n_spans"]) == (pii.listed(every), len(every))


@pytest.mark.parametrize(
    ("text", "span"),
    [
        ("write to anna [at] mail [dot] org now", "anna [at] mail [dot] org"),
        ("see père.55@mail9.example.com there", "père.55@mail9.example.com"),
        ("phone 555-123-4567 today", "555-123-4567"),
        ("reach (017) 555-7713 late", "(017) 555-7713"),
    ],
)
def test_the_trees_add(text, span):
    base, every = pii.all_spans([text], pii.model())[0]
    assert span in {text[a:b] for a, _, b in every} and set(base) <= set(every)


@pytest.mark.parametrize("text", ["JOHN [AT] EXAMPLE [DOT] COM", "jane [ at ] example.com", "Jane ( At ) example ( Dot ) com", "{at} jane{AT}example.com", "JANE AT EXAMPLE DOT COM", "jane at example.com"])
def test_no_spelt_address_is_passed_over(text):
    for t in (text, text.swapcase(), f"so write to {text} today"):
        spelt = {m.span() for m in pii._SPELT.finditer(t)}
        assert spelt and spelt <= {(a, b) for a, k, b in pii.candidates(t) if k == "email"}


@pytest.mark.parametrize("text", ["order 8123456789 went out", "version 1-2-3-4", "look at this dot com", "on 2021-03-04 they met", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "sum 4444 4444 4444 now", "id 908076543211"])
def test_the_trees_leave_alone(text):
    assert pii.all_spans([text], pii.model())[0][1] == pii.base_spans(text)


def test_written_data_held_out():
    rng, right, wrong, missed = random.Random(77), 0, 0, 0
    for _ in range(600):
        text, true = pii._written(rng, "abcdeinrstéèêçà")
        base, every = pii.all_spans([text], pii.model())[0]
        added = set(every) - set(base)
        right, wrong, missed = right + len(added & set(true)), wrong + len(added - set(true)), missed + len(set(true) - set(every))
    assert wrong <= 0.02 * right and missed <= 0.1 * right


def test_spans_start_where_the_address_starts():
    for text, start, end in (
        ("see " + "é" * 100 + "@mail.example.com now", 4, 121),
        ("see " + "é.x" * 60 + "@mail9.example.com", 4, 202),
        ("to " + "a" * 90 + " [at] mail [dot] org", 3, 113),
        ("to anna [at] " + "m" * 80 + " [dot] x [dot] y [dot] z [dot] u [dot] org", 3, 135),
    ):
        found = [c for c in pii.candidates(text) if c[1] == "email"]
        assert (start, "email", end) in found, text
        every = pii.all_spans([text], pii.model())[0][1]
        assert "é" not in pii.redact(text, every)


def test_numbers_in_a_row_are_proposed_one_by_one():
    for text in ("phone 555-123-4567 555-987-6543 ok", "call (017) 555-7713 (017) 555-7714 now"):
        spans = pii.all_spans([text], pii.model())[0][1]
        assert [k for _, k, _ in spans] == ["phone", "phone"]
    long = " ".join(["1234 5678 90"] * 40)
    assert pii.all_spans([long], pii.model())[0][1] == []


def test_work_grows_with_the_text_only():
    import time

    def took(text):
        began = time.process_time()
        pii.all_spans([text], pii.model())
        return time.process_time() - began

    pii.model()
    address = lambda n: " ".join(f"a{i}@mail.example.com (555) 555-{i:04d}" for i in range(n))
    assert took(address(8000)) < 8 * took(address(2000)) + 1
    for text in ("1 " * 100_000, "1.2.3.4 " * 20_000, "a at b." * 20_000, "é@é." * 20_000, "a@" * 100_000, "x at " + "a.b." * 50_000):
        assert took(text) < 10


def test_spans_within_longer_base_spans_are_not_added():
    text = "x 10.0.0.1.5 y +1 (443) 555-5793 z"
    base, every = pii.all_spans([text], pii.model())[0]
    plain = [c for c in pii.candidates(text) if not any(a <= c[0] and c[2] <= b for a, _, b in base)]
    assert set(every) <= set(base) | set(plain)


def test_redaction_merges_overlaps():
    assert pii.redact("abcdefgh", [(1, "email", 4), (3, "phone", 6)]) == "a[email]gh"
    assert pii.redact("abc", []) == "abc"


def test_edges(odd_docs, no_docs):
    rows = pii.find_pii(odd_docs).collect()
    assert len(rows) == 9
    for r in rows:
        assert r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = pii.redacted(odd_docs)
    assert clean.columns == odd_docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, odd_docs.collect()))
    assert pii.find_pii(no_docs).count() == 0
    assert len(pii.all_spans(["1" * 100_000, "1." * 50_000, "a@" * 50_000, "+1" * 50_000], pii.model())) == 4
