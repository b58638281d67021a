"""Fill-in-the-middle: SQL on the whole table, rank and select against plain counting, brute force on odd texts."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwright.llm import infill
from tarnwright.llm.queries import op12_infill

from .conftest import DATA, LONG


def test_whole_table_equals_sql(spark, tables):
    got, want = op12_infill(spark, DATA), tables.sql(infill.oracle_sql())
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def plain(doc_id, text):
    """By a list of tokens."""
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    a, b, c = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(u), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(u), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


@settings(max_examples=300, deadline=None)
@given(st.integers(-5, 10**12), st.text(alphabet=st.one_of(st.sampled_from("aZ <>PSM\n\0é漢😀K"), st.characters(codec="utf-8"))))
def test_cuts_equal_those_of_token_lists(doc_id, text):
    n, form, a, b, out = infill.rearranged(text.encode(), hashlib.sha256(f"1:{doc_id}".encode()).hexdigest())
    assert (n, form, a, b, out.decode()) == plain(doc_id, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 700)), max_size=12))
def test_rank_and_select(runs):
    flags = np.concatenate([np.zeros(0, bool), *(np.full(n, v) for v, n in runs)])
    bits, ones = infill.Bits(flags), np.flatnonzero(flags)
    assert bits.total == len(ones)
    assert [bits.select(k) for k in range(len(ones))] == ones.tolist()
    assert bits.select(len(ones)) == bits.select(len(ones) + 9) == len(flags)
    assert all(bits.rank(i) == flags[:i].sum() for i in range(0, len(flags) + 1, 7))


def test_odd_documents(spark, odd_docs, no_docs):
    texts = ["", "<", "a<P>b", "<S", "<S<M", "<<P<S<M", "é漢😀", "word\nword", "\0", ">", "a" * 200_000, None]
    more = spark.createDataFrame([(100 + 17 * i + j, t) for i, t in enumerate(texts) for j in range(17)], "doc_id long, text string")
    rows = odd_docs.select("doc_id", "text").unionByName(more)
    got = infill.fill_in_middle(rows).collect()
    want = [(r["doc_id"], *plain(r["doc_id"], r["text"])) for r in rows.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    back = infill.fill_in_middle(rows).select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((r["doc_id"], r["text"] or "")) for r in rows.collect())
    assert infill.infill_digests(odd_docs).count() == odd_docs.count() and infill.infill_digests(no_docs).count() == 0
    long = infill.infill_digests(odd_docs.where("doc_id = 4")).first()
    assert long["n"] == 2 * 60_000 and long["restored_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
