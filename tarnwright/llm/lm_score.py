"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Tokens are runs of other than space and the characters 9 to 13, after A-Z is lower-cased, then one end. Training
documents are those whose crc32 of doc_id (as text) leaves a remainder by 10; a null doc_id is held out.

Counting covers every token and every pair of neighbours of all training documents (the end stands before the first
token as well), from count 1 on; n-grams are known by 54-bit hashes. The filter stores a count's level on a
logarithmic scale: an n-gram of level q is entered q times, once a level. Reading probes level after level until one
is missing, so a count is overestimated by a level with the filter's false-positive rate and never underestimated.

The filter has no bound. n-grams are dealt by hash into groups, one to GROUP_BYTES of text, and a group's into
SEGMENTS segments; the task that has a group counts its n-grams and makes its segments, each of a size that follows
what is entered. If all segments together have at most BROADCAST_BYTES, they are broadcast and each document's
n-grams are probed where the document is. Beyond that, all documents go in blocks, which send each group the n-grams
they have, once, with their training counts; the task that has the group makes its segments of them, probes each n-gram
once for all blocks and sends every block the levels it asked for. The answers are the same bit for bit (tested). Texts
of more than TEXTS_A_FILTER times BROADCAST_BYTES go this way at once. A token's probability is

    p(w | h) = (c(h, w) + PRIOR * p(w)) / (c(h) + PRIOR),    p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1))

with all c read from the filter and c(h, w) at most c(h): a history seen often is trusted more, and a pair seen twice
counts more than one seen once. `score` is the sum of log10 p(w | h); gain_per_token is how much it is above
base_score, by token.

base_score and n_known use exact counts instead: those of the most frequent words (at most MOST_WORDS) are broadcast,
the other words of each document are joined with the counts by a shuffle.

Defined results: null and empty texts are the end alone. Without training documents all counts, N and V are 0.
Repeated rows are scored each and, as training rows, counted each. A worker holds a few times the longest text.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, map_batches, materialise, utf8

FOLDS = 10
#: Bits of the filter a stored level, probes a level, bits of a line (all probes of a level are in one), segments a group.
BITS_A_LEVEL, PROBES, LINE, SEGMENTS = 8, 5, 512, 32
#: The greatest filter that is broadcast; larger ones answer by group. Texts of so many times its bytes are not tried.
BROADCAST_BYTES, TEXTS_A_FILTER = 1 << 27, 8
#: Words with exact counts that are broadcast (16 bytes each).
MOST_WORDS = 1 << 20
RATIO = 1.5
#: What the unigram share weighs against the counts after a history, in occurrences.
PRIOR = 32.0
#: Bytes of text that are tokenised together, and for which there is one group of n-grams.
BLOCK_BYTES, GROUP_BYTES = 1 << 22, 1 << 25

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_KINDS = np.uint64(3)
END = np.uint64(0xD1B54A32D192ED03)

# Words are hashed as sums of byte values times powers, all at once: what a word adds to the running sum, divided by
# the power at its start, depends on the word alone.
_SLAB = 1 << 18
_STEP = 0x9E3779B97F4A7C13
_ONE = np.ones(1, np.uint64)
_POWER = np.cumprod(np.concatenate([_ONE, np.full(_SLAB - 1, _STEP, np.uint64)]))
_INVERSE = np.cumprod(np.concatenate([_ONE, np.full(_SLAB - 1, pow(_STEP, -1, 1 << 64), np.uint64)]))
_BYTE = np.random.default_rng(20_240_415).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _lows() -> np.ndarray:
    """The least count of each level: 1, 2, 3, 4, then by RATIO."""
    out = [1]
    while out[-1] < 1 << 44:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return np.array(out, np.int64)


LOWS = _lows()
#: The count that a level stands for: the middle of its range, on the logarithmic scale.
MIDDLES = np.sqrt(LOWS[:-1].astype(float) * (LOWS[1:] - 1))
_COUNT = np.concatenate([[0.0], MIDDLES])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        base = int(start[at])
        end = int(np.searchsorted(stop, base + _SLAB, side="right"))
        if end == at:  # a word longer than a slab: its parts' sums, moved to their places
            total, place = 0, 1
            for part in range(base, int(stop[at]), _SLAB):
                piece = _BYTE[text[part : min(part + _SLAB, int(stop[at]))]]
                total += int((piece * _POWER[: len(piece)]).sum()) * place
                place = place * pow(_STEP, _SLAB, 1 << 64) % (1 << 64)
            out[at] = total % (1 << 64)
            at += 1
            continue
        piece = _BYTE[text[base : int(stop[end - 1])]]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece * _POWER[: len(piece)])])
        first = start[at:end] - base
        out[at:end] = (total[stop[at:end] - base] - total[first]) * _INVERSE[first]
        at = end
    return _mixed(out)


def tokens(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all documents, and each document's number of tokens."""
    text = np.frombuffer(b"\n".join([*docs, b""]), np.uint8)
    if not len(docs):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.diff(_SPACE[text].view(np.int8), prepend=1)
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    closes = np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)) + 1)
    length = np.diff(np.searchsorted(start, closes), prepend=0) + 1
    out = np.empty(int(length.sum()), np.uint64)
    inside = np.ones(len(out), bool)
    ends = np.cumsum(length) - 1
    inside[ends] = False
    out[inside], out[ends] = _word_hashes(text, start, stop), END
    return out, length


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """56-bit keys of the words (kind 0) and of the pairs with the token before (kind 1); documents follow one another, each after an end."""
    before = np.concatenate([[END], words[:-1]])
    kept = lambda h: h >> np.uint64(8) & ~_KINDS
    return kept(words), kept(_mixed(before * _FACTOR + words)) | np.uint64(1)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % FOLDS == 0, F.lit(True))


def groups_for(size: int) -> int:
    """The number of groups for so many bytes of text."""
    return max(1, -(-size // GROUP_BYTES))


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Which of so many equal ranges of keys each is in: groups and segments are such, so sorted keys are in their order."""
    return ((key >> np.uint64(24)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _planes(values: np.ndarray, n: int) -> bytes:
    """The n lower bytes of numbers, byte by byte of all: upper bytes that are all but empty compress so."""
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(n, -1).T
    return out.view(np.uint64).ravel()


def packed(key: np.ndarray, n: int = 7) -> bytes:
    """Ascending keys of n bytes as gaps."""
    return _planes(np.diff(key, prepend=np.uint64(0)), n)


def unpacked(data: bytes, n: int = 7) -> np.ndarray:
    return np.cumsum(_from_planes(data, n), dtype=np.uint64)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and its length."""
    first = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return first, np.diff(first, append=len(sorted_values))


def _blocks(raw: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of documents that are tokenised together."""
    filled = np.cumsum([0, *map(len, raw)])[:-1] // BLOCK_BYTES
    ends = [*(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(raw)] if raw else []
    return zip([0, *ends], ends, strict=False)


def _by_group(key: np.ndarray, n: np.ndarray, groups: int) -> dict[str, object]:
    """Ascending keys and their counts, a row a group that has any."""
    first, many = _runs(part_of(key, groups))
    parts = list(zip(first.tolist(), (first + many).tolist(), strict=True))
    return {
        "group": part_of(key[first], groups),
        "keys": [packed(key[a:b]) for a, b in parts],
        "counts": [n[a:b].astype(np.uint8 if n[a:b].max() < 256 else np.uint32).tobytes() for a, b in parts],
    }


def told(docs: DataFrame, groups: int) -> DataFrame:
    """group, keys, counts: the n-grams of training documents, counted by block; a row a block and group."""

    def make():
        held: list[bytes] = []

        def counted() -> dict[str, object]:
            key = np.concatenate(keys(tokens(held)[0]))
            held.clear()
            key.sort()
            first, n = _runs(key)
            return _by_group(key[first], n, groups)

        def each(batch: pa.RecordBatch | None) -> Iterator[dict[str, object]]:
            for text in utf8(batch) if batch is not None else ():
                held.append(text)
                if sum(map(len, held[-1:])) >= BLOCK_BYTES or len(held) % 256 == 0 and sum(map(len, held)) >= BLOCK_BYTES:
                    yield counted()
            if held and (batch is None or sum(map(len, held)) >= BLOCK_BYTES):
                yield counted()

        return each

    return map_batches(docs.where(~held_out()).select("text"), make, "group bigint, keys binary, counts binary", ends=True)


class Filter:
    """Segments of lines; all probes of an n-gram's level are in one line of the segment that its key chooses."""

    def __init__(self, lines: np.ndarray, bits: np.ndarray | None = None) -> None:
        self.lines = lines.astype(np.uint64)
        self.first = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.lines)])
        self.bits = np.zeros(int(self.first[-1]) * (LINE // 64), np.uint64) if bits is None else bits

    @staticmethod
    def lines_for(n: np.ndarray, bits: int = BITS_A_LEVEL) -> int:
        """Lines for n-grams of these counts, with so many bits a level."""
        return max(1, -(-int(Filter.entries(n).sum()) * bits // LINE))

    @staticmethod
    def entries(n: np.ndarray) -> np.ndarray:
        """The number of levels to enter."""
        return np.searchsorted(LOWS, n, side="right")

    def _lines(self, key: np.ndarray, segment: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each key the first bit of its line at this level, and a hash that says which bits of it."""
        h = _mixed(key + np.uint64((2 * level + 1) * int(_FACTOR) % 2**64))
        line = self.first[segment] + ((h >> np.uint64(32)) * self.lines[segment] >> np.uint64(32))
        return line * np.uint64(LINE), h

    def enter(self, key: np.ndarray, n: np.ndarray, segment: np.ndarray) -> None:
        """Sets the bits of all levels."""
        flags = np.zeros(len(self.bits) * 64, bool)
        levels, level = self.entries(n), 0
        while (some := levels > level).any():
            key, segment, levels = key[some], segment[some], levels[some]
            base, h = self._lines(key, segment, level)
            for i in range(PROBES):
                flags[(base + (h >> np.uint64(9 * i) & np.uint64(LINE - 1))).astype(np.int64)] = True
            level += 1
        self.bits |= np.packbits(flags, bitorder="little").view(np.uint64)

    def levels(self, key: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """How many levels of each key are present, one after the other."""
        out = np.zeros(len(key), np.uint8)
        live, level = np.arange(len(key)), 0
        while live.size and level < len(MIDDLES):
            base, h = self._lines(key[live], segment[live], level)
            for i in range(PROBES):
                place = base + (h >> np.uint64(9 * i) & np.uint64(LINE - 1))
                there = (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
                if i in (0, 1, PROBES - 1):
                    base, h, live = base[there], h[there], live[there]
                else:
                    base, h, live = (base, h, live) if there.all() else (base[there], h[there], live[there])
                if not live.size:
                    break
            out[live] += 1
            level += 1
        return out


def _batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _streamed(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows in order of key, as groups of rows; one row is held at a time."""

    def rows() -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                yield b.slice(i, 1).to_pylist()[0]

    return groupby(rows(), key=lambda r: r[key])


class Group:
    """A group's n-grams from rows keys, counts (others are kept), and its segments one by one."""

    def __init__(self, group: int, groups: int, rows: Iterator[dict], bits: int) -> None:
        self.bits, self.first, self.key, self.n, self.rest = bits, group * SEGMENTS, [], [], []
        for r in rows:
            self.key.append(unpacked(r.pop("keys")))
            counts = r.pop("counts")
            self.n.append(np.frombuffer(counts, np.uint8 if len(counts) == len(self.key[-1]) else np.uint32))
            self.rest.append(r)
        edges = np.array([(-(-(i << 32) // (groups * SEGMENTS))) << 24 for i in range(self.first, self.first + SEGMENTS + 1)], np.uint64)
        self.cut = [np.searchsorted(k, edges) for k in self.key]

    def segments(self) -> Iterator[tuple[int, Filter, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each segment its place in the group, filter, keys, counts, how often each key is in the rows, and in which order
        they are there: sorted position by position, row after row."""
        for s in range(SEGMENTS):
            k = np.concatenate([x[c[s] : c[s + 1]] for x, c in zip(self.key, self.cut, strict=True)])
            if not len(k):
                continue
            order = np.argsort(k, kind="stable")
            k = k[order]
            start, many = _runs(k)
            total = np.add.reduceat(np.concatenate([x[c[s] : c[s + 1]] for x, c in zip(self.n, self.cut, strict=True)])[order].astype(np.int64), start)
            k = k[start]
            own = Filter(np.array([Filter.lines_for(total, self.bits)]))
            own.enter(k, total, np.zeros(len(k), np.int64))
            yield s, own, k, total, many, order

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Makes the segments and answers all rows, in `answers`; gives the keys and counts of training words."""
        self.answers = [np.empty(len(k), np.uint8) for k in self.key]
        for s, own, k, total, many, order in self.segments():
            found = np.empty(len(order), np.uint8)
            found[order] = np.repeat(own.levels(k, np.zeros(len(k), np.int64)), many)
            at = 0
            for out, c in zip(self.answers, self.cut, strict=True):
                size = int(c[s + 1] - c[s])
                out[c[s] : c[s + 1]] = found[at : at + size]
                at += size
            words = (k & _KINDS == 0) & (total > 0)
            yield k[words], total[words]


BUILT = pa.schema([("segment", pa.int64()), ("lines", pa.int64()), ("bits", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])


def built(parts: DataFrame, groups: int) -> DataFrame:
    """The filter, a row (segment, lines, bits) each segment with n-grams, and a row (key, n) a training word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for group, rows in _streamed(batches, "group"):
            for s, own, k, total, _, _ in Group(group, groups, rows, BITS_A_LEVEL).segments():
                yield _batch(BUILT, segment=[group * SEGMENTS + s], lines=[int(own.lines[0])], bits=[own.bits.tobytes()])
                words = k & _KINDS == 0
                if words.any():
                    yield _batch(BUILT, key=k[words].view(np.int64), n=total[words])

    return _dealt(parts, groups, "group").mapInArrow(run, "segment bigint, lines bigint, bits binary, key bigint, n bigint")


def _dealt(parts: DataFrame, groups: int, *order: str) -> DataFrame:
    return parts.repartitionById(groups, F.col("group").cast("int")).sortWithinPartitions(*order)


def whole_filter(rows: pa.Table, segments: int) -> Filter:
    """Of rows segment, lines, bits; segments without n-grams have one empty line."""
    lines = np.ones(segments, np.int64)
    at = rows.column("segment").to_numpy()
    lines[at] = rows.column("lines").to_numpy()
    out = Filter(lines)
    for s, bits in zip(at.tolist(), rows.column("bits"), strict=True):
        part = np.frombuffer(bits.as_buffer(), np.uint64)
        begin = int(out.first[s]) * (LINE // 64)
        out.bits[begin : begin + len(part)] = part
    return out


class Scorer:
    def __init__(self, known: np.ndarray, n: np.ndarray, total: int, distinct: int) -> None:
        self.known, self.n = known, n
        self.whole = total + 0.1 * (distinct + 1)

    def score(self, words: np.ndarray, length: np.ndarray, levels: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> dict[str, object]:
        """levels gives those of a block's words and pairs, a value a token."""
        starts = np.cumsum(length) - length
        one, two = keys(words)
        unique, where = np.unique(one, return_inverse=True)
        # exact counts of frequent words
        frequent, exact = np.zeros(len(unique), bool), np.zeros(len(unique))
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, unique), len(self.known) - 1)
            frequent = self.known[at] == unique
            exact = np.where(frequent, np.log10((self.n[at] + 0.1) / self.whole), 0.0)
        often = frequent[where]
        # the model
        of_words, of_pairs = levels(one, two)
        count, joint = _COUNT[of_words], _COUNT[of_pairs]
        history = np.concatenate([count[length[0] - 1 : length[0]], count[:-1]])  # the first token comes after an end
        p = (np.minimum(joint, history) + PRIOR * (count + 0.1) / self.whole) / (history + PRIOR)
        rest = [np.unique(one[a : a + m][~often[a : a + m]], return_counts=True) for a, m in zip(starts.tolist(), length.tolist(), strict=True)]
        return {
            "n_tokens": length,
            "base": np.add.reduceat(exact[where], starts),
            "seen": np.add.reduceat(often.astype(np.int64), starts),
            "score": np.add.reduceat(np.log10(np.minimum(p, 1.0)), starts),
            "rare": [k.view(np.int64) for k, _ in rest],
            "times": [c for _, c in rest],
        }


SCORED = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, base double, seen bigint, score double, rare array<bigint>, times array<bigint>"


def scored_here(rows: DataFrame, found: Filter, segments: int, frequent: tuple[np.ndarray, np.ndarray], total: int, distinct: int) -> DataFrame:
    """Scores where the documents are, with the filter broadcast."""
    sent = rows.sparkSession.sparkContext.broadcast((found.lines, found.bits, frequent))

    def make():
        lines, bits, frequent = sent.value
        own, scorer = Filter(lines, bits), Scorer(*frequent, total, distinct)

        def levels(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            unique, where = np.unique(one, return_inverse=True)
            of_pairs = [own.levels(some, part_of(some, segments)) for some in np.split(two, range(1 << 16, len(two), 1 << 16))]
            return own.levels(unique, part_of(unique, segments))[where], np.concatenate(of_pairs)

        def each(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            raw = utf8(batch)
            for at, end in _blocks(raw):
                part = batch.slice(at, end - at)
                yield scorer.score(*tokens(raw[at:end]), levels) | {c: part.column(c) for c in ("row", "doc_id", "held_out")}

        return each

    return map_batches(rows, make, SCORED)


def blocked(rows: DataFrame) -> DataFrame:
    """block, docs: documents that are tokenised together, as a vocabulary and the places in it."""

    def make():
        block = TaskContext.get().partitionId() << 32

        def each(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            nonlocal block
            raw = utf8(batch)
            for at, end in _blocks(raw):
                part = batch.slice(at, end - at)
                words, length = tokens(raw[at:end])
                vocabulary, places = np.unique(words, return_inverse=True)
                what = (packed(vocabulary, 8), _planes(places, 4), length, *(part.column(c).to_pylist() for c in ("row", "doc_id", "held_out")))
                yield {"block": [block], "docs": [pickle.dumps(what)]}
                block += 1

        return each

    return map_batches(rows, make, "block bigint, docs binary")


def _of_block(docs: bytes) -> tuple[np.ndarray, np.ndarray, dict[str, list]]:
    """Words, lengths and the other columns of a block."""
    vocabulary, places, length, *rest = pickle.loads(docs)
    return unpacked(vocabulary, 8)[_from_planes(places, 4).astype(np.int64)], length, dict(zip(("row", "doc_id", "held_out"), rest, strict=True))


def asking(stored: DataFrame, groups: int) -> DataFrame:
    """block, group, keys, counts: the n-grams that a block has of a group, once each, with their counts in training documents."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs"), strict=True):
                words, length, rest = _of_block(docs.as_buffer())
                trained = np.repeat(~np.array(rest["held_out"], bool), length).astype(np.uint64)
                key = np.concatenate([k << np.uint64(1) | trained for k in keys(words)])  # 57 bits: the last tells training
                key.sort()
                trained = (key & np.uint64(1)).astype(np.int64)
                key >>= np.uint64(1)
                first, _ = _runs(key)
                made = _by_group(key[first], np.add.reduceat(trained, first), groups)
                yield {"block": [block] * len(made["group"])} | made

        return each

    return map_batches(stored, make, "block bigint, group bigint, keys binary, counts binary")


ANSWERED = pa.schema([("block", pa.int64()), ("group", pa.int64()), ("levels", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])
#: Answers that are handed on at once.
_ANSWERS = 64


def answered(asks: DataFrame, groups: int) -> DataFrame:
    """A row (block, group, levels) for each row asked, and a row (key, n) a training word. The filter stays in its tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for group, rows in _streamed(batches, "group"):
            own = Group(group, groups, rows, BITS_A_LEVEL)
            for key, n in own.levels():
                if len(key):
                    yield _batch(ANSWERED, key=key.view(np.int64), n=n)
            blocks = [r["block"] for r in own.rest]
            for at in range(0, len(blocks), _ANSWERS):
                some = blocks[at : at + _ANSWERS]
                yield _batch(ANSWERED, block=some, group=[group] * len(some), levels=[x.tobytes() for x in own.answers[at : at + _ANSWERS]])

    return _dealt(asks, groups, "group").mapInArrow(run, "block bigint, group bigint, levels binary, key bigint, n bigint")


def scored_by_group(stored: DataFrame, answers: DataFrame, groups: int, frequent: tuple[np.ndarray, np.ndarray], total: int, distinct: int) -> DataFrame:
    """The same scores with the levels that groups have answered to blocks."""
    nothing = lambda name, kind: F.lit(None).cast(kind).alias(name)
    # after all groups' answers comes what the block is
    back = answers.withColumn("docs", nothing("docs", "binary")).unionByName(stored.select("block", F.lit(groups).cast("bigint").alias("group"), nothing("levels", "binary"), "docs"))
    sent = stored.sparkSession.sparkContext.broadcast(frequent)
    out = pa.schema([pa.field(n, {"boolean": pa.bool_(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}.get(k, pa.int64())) for n, k in (f.split() for f in SCORED.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        scorer = Scorer(*sent.value, total, distinct)
        for _, some in _streamed(batches, "block"):
            got = []
            for r in some:
                if r["docs"] is None:
                    got.append(np.frombuffer(r["levels"], np.uint8))
                    continue
                words, length, rest = _of_block(r["docs"])
                every = np.concatenate(got)

                def levels(one: np.ndarray, two: np.ndarray, every: np.ndarray = every) -> tuple[np.ndarray, np.ndarray]:
                    where = np.unique(np.concatenate([one, two]), return_inverse=True)[1]
                    return every[where[: len(one)]], every[where[len(one) :]]

                columns = scorer.score(words, length, levels) | rest
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)

    return back.repartition(groups, "block").sortWithinPartitions("block", "group").mapInArrow(run, SCORED)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, gain_per_token, for every row of docs."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = groups_for(size)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), "text")
    here = size <= TEXTS_A_FILTER * BROADCAST_BYTES
    if here:
        made = materialise(built(told(docs, groups), groups), "counts")
        here = made.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0] * LINE // 8 <= BROADCAST_BYTES
    if not here:
        stored = materialise(blocked(rows), "blocks", "zstd")
        made = materialise(answered(asking(stored, groups), groups), "answers", "zstd")
    words = made.where("key is not null").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("key")).first()
    by_size = words.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.col("n").desc()).collect()
    least, reached = 1 << 62, 0
    for r in by_size:
        if reached + r["count"] > MOST_WORDS:
            break
        least, reached = r["n"], reached + r["count"]
    got = words.where(F.col("n") >= F.lit(least)).toArrow() if reached else words.limit(0).toArrow()
    known = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(known)
    frequent = known[order], got.column("n").to_numpy()[order]
    if here:
        found = whole_filter(made.where("segment is not null").select("segment", "lines", "bits").toArrow(), groups * SEGMENTS)
        scored = scored_here(rows, found, groups * SEGMENTS, frequent, total, distinct)
    else:
        answers = made.where("block is not null").select("block", "group", "levels")
        scored = scored_by_group(stored, answers, groups, frequent, total, distinct)
    scored = materialise(scored, "scored")
    rest = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    whole = total + 0.1 * (distinct + 1)
    rest = rest.join(words.where(F.col("n") < F.lit(least)), "key", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    added = rest.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("n") + F.lit(0.1)) / F.lit(whole))).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("met"),
    )
    out = scored.drop("rare", "times").join(added, "row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("seen") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        "score",
        ((F.col("score") - base) / F.col("n_tokens")).alias("gain_per_token"),
    )
