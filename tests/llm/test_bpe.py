"""BPE against the tokenizers library, and edge cases."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tarnwright.llm import bpe
from tarnwright.llm.queries import op5_bpe, tokenizer_path

from .conftest import DATA


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.vocabulary(tokenizer_path()), cache_words=500)


def test_whole_table(spark, library, texts):
    got = {r["doc_id"]: r for r in op5_bpe(spark, DATA).collect()}
    assert len(got) == len(texts)
    for d, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_strings(library, encoder):
    rng = random.Random(1)
    pool = "abcdefgh  \t\n'stremdl123#$%éÉßñİΣςﬁ你好 \x1c\x1d\x85​ \U0001f600́ŉǅ½²Ⅷ"
    for _ in range(4000):
        s = "".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        s += rng.choice(("", "", "<|endoftext|>", "<|startoftext|>x"))
        whole = library.encode(s, add_special_tokens=False)
        assert encoder.encode(s) == whole.ids, s
        assert encoder.decode(whole.ids) == library.decode(whole.ids, skip_special_tokens=False)


def test_both_trees_agree_and_long_words_are_whole(library, encoder):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdetionrs") for _ in range(rng.randrange(1, 65))).encode() for _ in range(800)]
    for size in (1, 2, 3, 64):
        words.append(b"a" * size)
    assert bpe.merge_many(encoder.v, words) == [bpe.merge_one(encoder.v, w) for w in words]
    long = "".join(rng.choice("abcdetion") for _ in range(20_000))
    assert encoder.encode(long) == library.encode(long, add_special_tokens=False).ids


def test_edges(odd_docs, no_docs):
    rows = bpe.bpe_encode(odd_docs, tokenizer_path()).collect()
    assert len(rows) == 9
    empty = hashlib.sha256(b"").hexdigest()
    for r in rows:
        if r["doc_id"] in (2, 3, 6, 7):
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["token_ids"]) == (0, empty, empty, [])
        assert len(r["token_ids"]) == r["n_tokens"]
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 4} == {60_000}
    assert bpe.bpe_digests(no_docs, tokenizer_path()).count() == 0
