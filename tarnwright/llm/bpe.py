"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are the leaves' left ends: leaf i holds the key rank * size + i of the pair that starts at symbol
i, or NONE. The root, the smallest key, is thus the leftmost pair of the lowest rank. A merge changes at most three
leaves (the pair itself, the pair before, the pair that vanished); each change walks one path to the root.

Words of a batch that no cache knows are merged in lockstep: one tree a row of a numpy array, one merge a row and
round. Long words get a tree of their own, so that no padding grows with them.

Defined results: null and empty texts have no token; the empty id list hashes as the empty string. White space
never makes a token. Strings of special tokens are single tokens, as in the library with its defaults. Texts of any
length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import cached_as, map_batches, texts

NONE = np.int64(1) << 62
#: Words up to so many symbols are merged in lockstep.
SHORT = 64
#: Words, and pieces, that a worker keeps encoded: about 50 MB at most.
CACHE_WORDS = 200_000
SEPARATORS = regex.compile("[\\x1c-\\x1f]")

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: ids, pair ranks, pattern and special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in whole["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters = byte_alphabet()
        self.inner = np.array([self.ids[c] for c in letters], np.int64)
        self.last = np.array([self.ids[c + self.end] for c in letters], np.int64)
        self.size = 1 + max(self.tokens)
        self.shown = {str(i): t for i, t in self.tokens.items()}
        pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pairs[self.ids[a] * self.size + self.ids[b]] = (rank, self.ids[a + b])
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [0], np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair its place among the known ones, and whether it is known; negative symbols are no symbols."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        known = (left >= 0) & (right >= 0)
        known[known] = self.keys[np.minimum(at[known], len(self.keys) - 1)] == key[known]
        return at, known


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_many(v: Vocabulary, words: list[bytes]) -> list[list[int]]:
    """Ids of words of at most SHORT bytes, merged in lockstep: a row of the arrays is one word's segment tree."""
    rows, width = len(words), 1
    longest = max(map(len, words))
    while width < longest:
        width *= 2
    length = np.fromiter(map(len, words), np.int64, rows)
    raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(rows, width)
    place = np.arange(width)
    symbols = np.where(place < length[:, None], v.inner[raw], -1)
    symbols[np.arange(rows), length - 1] = v.last[raw[np.arange(rows), length - 1]]
    after = np.broadcast_to(place + 1, (rows, width)).copy()
    before = np.broadcast_to(place - 1, (rows, width)).copy()

    tree = np.full((rows, 2 * width), NONE)
    if width > 1:
        at, known = v.find(symbols[:, :-1], symbols[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(known, v.ranks[np.minimum(at, len(v.ranks) - 1)] * width + place[:-1], NONE)
    for level in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * level], tree[:, 2 * level + 1], out=tree[:, level])

    live = np.flatnonzero(tree[:, 1] < NONE)
    while live.size:
        at = tree[live, 1] % width
        right = after[live, at]
        new = v.merged[v.find(symbols[live, at], symbols[live, right])[0]]
        symbols[live, at] = new
        symbols[live, right] = -1
        far = after[live, right]
        after[live, at] = far
        inside = far < length[live]
        before[live[inside], far[inside]] = at[inside]
        left = before[live, at]
        _set_leaves(tree, live, right, np.full(len(live), NONE), width)
        for start, other in ((at, far), (left, at)):
            ok = (start >= 0) & (other < length[live])
            one, two = np.maximum(start, 0), np.minimum(other, width - 1)
            where, known = v.find(np.where(ok, symbols[live, one], -1), np.where(ok, symbols[live, two], -1))
            key = np.where(known, v.ranks[np.minimum(where, len(v.ranks) - 1)] * width + one, NONE)
            some = start >= 0
            _set_leaves(tree, live[some], one[some], key[some], width)
        live = live[tree[live, 1] < NONE]
    return [row[row >= 0].tolist() for row in symbols]


def _set_leaves(tree: np.ndarray, rows: np.ndarray, leaves: np.ndarray, keys: np.ndarray, width: int) -> None:
    """One leaf of each row, then its path to the root."""
    node = leaves + width
    tree[rows, node] = keys
    while width > 1:
        node, width = node >> 1, width >> 1
        tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])


def merge_one(v: Vocabulary, word: bytes) -> list[int]:
    """Ids of one word of any length: the same tree in plain lists, O(log n) a merge."""
    n = len(word)
    symbols = [int(v.inner[b]) for b in word[:-1]] + [int(v.last[word[-1]])]
    width = 1 << max(0, (n - 1).bit_length())
    none, size, pairs = int(NONE), v.size, v.pairs
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def key(i: int, j: int) -> int:
        found = pairs.get(symbols[i] * size + symbols[j]) if i >= 0 and j < n else None
        return found[0] * width + i if found else none

    tree = [none] * (2 * width)
    for i in range(n - 1):
        tree[width + i] = key(i, i + 1)
    for level in range(width - 1, 0, -1):
        tree[level] = min(tree[2 * level], tree[2 * level + 1])

    def put(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        while node > 1:
            node >>= 1
            best = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best

    while width > 1 and tree[1] < none:
        i = tree[1] % width
        j = after[i]
        symbols[i] = pairs[symbols[i] * size + symbols[j]][1]
        symbols[j] = -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        put(j, none)
        put(i, key(i, after[i]))
        if before[i] >= 0:
            put(before[i], key(before[i], i))
    return [s for s in symbols if s >= 0]


class Encoder:
    """Encodes and decodes texts; what was met before, words and spaced pieces alike, comes from one bounded cache.

    No token spans white space, so a piece between white space has ids of its own. The cache is a pure shortcut: it
    holds what the merge gives, as ids joined by spaces, and its size bounds a worker's memory.
    """

    def __init__(self, v: Vocabulary, cache_words: int = CACHE_WORDS) -> None:
        self.v, self.most = v, cache_words
        #: In two generations, of which the older goes as the younger fills.
        self.known: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case is by character: no final sigma
        return text.lower()

    def split(self, text: str) -> list[str]:
        """The text's pieces after normalisation; special tokens are pieces, as they stand."""
        if self.v.cut and self.v.cut.search(text):
            out, at = [], 0
            for m in self.v.cut.finditer(text):
                out += self._spaced(self.normal(text[at : m.start()]))
                out.append(m[0])
                at = m.end()
            return out + self._spaced(self.normal(text[at:]))
        return self._spaced(self.normal(text))

    def _spaced(self, text: str) -> list[str]:
        # str.split() also splits at four separators that the pattern takes for signs
        return self.v.pattern.findall(text) if SEPARATORS.search(text) else text.split()

    def learn(self, pieces: set[str]) -> None:
        """Sees to it that the younger generation of the cache holds all of pieces."""
        if len(self.known) >= self.most // 2:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        parted: dict[str, list[str]] = {}
        new: set[str] = set()
        for p in pieces.difference(known):
            if p in old:
                known[p] = old[p]
                continue
            words = [p] if p in self.v.special else self.v.pattern.findall(p)
            if len(words) != 1 or words[0] != p:
                parted[p] = words
            new.update(words)
        self._learn_words(new)
        for p, words in parted.items():
            known[p] = " ".join([known[w] for w in words])

    def _learn_words(self, words: set[str]) -> None:
        known, old = self.known, self.old
        short: dict[int, list[tuple[str, bytes]]] = {}
        for w in words.difference(known):
            if w in old:
                known[w] = old[w]
            elif w in self.v.special:
                known[w] = str(self.v.special[w])
            elif len(b := w.encode()) <= SHORT:
                short.setdefault((len(b) - 1).bit_length(), []).append((w, b))
            else:
                known[w] = " ".join(map(str, merge_one(self.v, b)))
        for group in short.values():
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                for (w, _), ids in zip(part, merge_many(self.v, [b for _, b in part]), strict=True):
                    known[w] = " ".join(map(str, ids))

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        self.learn(set(pieces))
        return [int(i) for p in pieces for i in self.known[p].split()]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes without a decoder: the tokens, a space between them; unknown ids are skipped."""
        return " ".join(self.v.tokens[i] for i in ids if i in self.v.tokens)

    def strings(self, docs: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of tokens, ids and what they decode to, both joined by spaces."""
        shown = self.v.shown.__getitem__
        for at in range(0, len(docs), 200):
            cut = [self.split(t) for t in docs[at : at + 200]]
            self.learn({p for pieces in cut for p in pieces})
            known = self.known.__getitem__
            for pieces in cut:
                ids = " ".join(filter(None, map(known, pieces)))
                each = ids.split(" ") if ids else []
                yield len(each), ids, " ".join(map(shown, each))

    def digests(self, docs: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Of each text: number of tokens, SHA-256 of the ids, SHA-256 of what they decode to."""
        found = [(n, sha256(ids), sha256(shown)) for n, ids, shown in self.strings(docs)]
        return [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@cache
def encoder(path: str) -> Encoder:
    """One a worker process, so that later tasks find its cache filled."""
    return Encoder(vocabulary(path))


cached_as("bpe", encoder.cache_clear)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, for every row of docs. No shuffle."""

    def make():
        enc = encoder(path)

        def each(batch: pa.RecordBatch) -> dict[str, object]:
            n, ids, decoded = enc.digests(texts(batch))
            return {"doc_id": batch.column("doc_id"), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

        return each

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA, "bpe")


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """bpe_digests with the ids themselves, token_ids ARRAY<INT>, for every row of docs. No shuffle."""

    def make():
        enc = encoder(path)

        def each(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = list(enc.strings(texts(part)))
                yield {
                    "doc_id": part.column("doc_id"), "n_tokens": [f[0] for f in found], "ids_sha256": [sha256(f[1]) for f in found], "decoded_sha256": [sha256(f[2]) for f in found],
                    "token_ids": [np.array(f[1].split(), np.int32) for f in found],
                }

        return each

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA + ", token_ids array<int>", "bpe")
