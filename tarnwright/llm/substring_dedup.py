"""Repeated passages by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last WINDOW bytes is small, so boundaries depend on content
only and fall into step again after an insertion. Chunks have LEAST to MOST bytes (the last one of a text may be
shorter); where no hash is small for MOST bytes, the cut is where it is smallest, the first place if there are
several, so that words repeated over and over fall into step as well. A chunk whose digest occurs in at least two
documents is repeated; repeated chunks that follow one another in a text form a passage, reported if it has
CORE_WORDS words or more. The chunks at both ends of a copied stretch usually reach beyond it and are not part of
the core: of stretches of over 50 words on the tables, 99 % have a core of at least CORE_WORDS.

A chunk belongs to the document with the smallest doc_id that holds it; there it is kept, in the others it is
redundant, so every repeated digest survives. A passage is reported in pieces, a row each: a piece ends where the
owner changes or where the chunks no longer follow one another in the owner as they do here, so the owner holds each
piece as it stands. A chunk's place in its owner is the first one there; where an owner repeats a chunk, pieces may
be shorter than they could be.

Texts are read and cut once; a row a text is written, with arrays of its chunks. Counting is by digest with partial
sums before the shuffle; what is joined back is one row a chunk, and a digest is one row on the other side, so no
group of equal chunks is ever expanded or gathered. Passages are put together text by text.

Defined results: null and empty texts have no chunk. Rows that share a doc_id are one document, so what only they
share is not repeated; but each of their texts has passages and cuts of its own, told apart by text_key, a hash of
the text. Rows equal in both are reported once. Rows without doc_id take no part, as no result could name them.
Offsets are in bytes, end exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialise, spare, utf8

WINDOW, LEAST, MOST = 16, 12, 256
#: A cut where the 16-bit hash is below this: one position in 22.
BELOW = 65_536 // 22
CORE_WORDS = 28

GEAR = np.random.default_rng(20_240_229).integers(0, 65_536, 256).astype(np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def cuts(docs: list[bytes]) -> list[list[int]]:
    """The ends of each text's chunks."""
    buffer = np.frombuffer(b"".join(d + b"\0" * WINDOW for d in docs), np.uint8)
    length = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = np.cumsum(length + WINDOW) - length - WINDOW
    h = GEAR[buffer]
    for s, n in zip(starts.tolist(), length.tolist(), strict=True):
        h[s + n : s + n + WINDOW] = 0  # the hash starts anew with each text
    step = 1
    while step < WINDOW:  # sums over twice as many bytes a time
        h[step:] += h[:-step] << np.uint16(step)
        step *= 2
    found = np.flatnonzero(h < BELOW) + 1
    first = np.searchsorted(found, starts, side="right").tolist()
    last = np.searchsorted(found, starts + length, side="right").tolist()
    out = []
    for s, n, a, b in zip(starts.tolist(), length.tolist(), first, last, strict=True):
        ends, at = [], 0
        for c in [*(found[a:b] - s).tolist(), n]:
            while c - at > MOST:
                at += LEAST + int(h[s + at + LEAST - 1 : s + at + MOST].argmin())
                ends.append(at)
            if c - at >= LEAST and c < n:
                ends.append(c)
                at = c
        if n > at:
            ends.append(n)
        out.append(ends)
    return out


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and, a value a chunk, digest, place (start and end), words (word starts before start and before
    end), first (the start of the text's first chunk of that digest); a row a text."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            raw = utf8(batch)
            for at in range(0, len(raw), 200):
                part = raw[at : at + 200]
                digest, place, word, first = [], [], [], []
                for d, ends in zip(part, cuts(part), strict=True):
                    space = _SPACE[np.frombuffer(d, np.uint8)]
                    begun = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]))])
                    begins = [0, *ends[:-1]] if ends else []
                    made = [xxhash.xxh3_64_intdigest(d[a:b]) for a, b in zip(begins, ends, strict=True)]
                    met: dict[int, int] = {}
                    first.append([met.setdefault(x, a) for x, a in zip(made, begins, strict=True)])
                    digest.append(np.array(made, np.uint64).view(np.int64))
                    start, end = np.array(begins, np.int64), np.array(ends, np.int64)
                    place.append(start << 32 | end)
                    word.append(begun[start] << 32 | begun[end])
                own = batch.slice(at, 200)
                yield {"doc_id": own.column("doc_id"), "text_key": own.column("text_key"), "digest": digest, "place": place, "words": word, "first": first}

        return each

    rows = docs.where("doc_id is not null and text <> ''").select("doc_id", text_key().alias("text_key"), "text")
    return map_batches(rows, make, "doc_id bigint, text_key bigint, digest array<bigint>, place array<bigint>, words array<bigint>, first array<bigint>")


def text_key() -> Column:
    return F.xxhash64("text")


def _once(texts: DataFrame) -> DataFrame:
    """One row for each doc_id and text; rows that stand alone are not moved."""
    twice = texts.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key")
    if twice.isEmpty():
        return texts
    twice = materialise(twice, "twice")
    key = ["doc_id", "text_key"]
    return texts.join(twice, key, "left_anti").unionByName(texts.join(twice, key, "left_semi").dropDuplicates(key))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_byte, end_byte, n_words, n_chunks, owner_id, redundant, text_key: a row a piece of a repeated
    passage and text."""
    texts = _once(materialise(chunked(docs), "chunks", "zstd"))
    high = lambda c: F.shiftright(c, 32)
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    held = F.shiftleft(F.col("text_key").bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(F.col("x.first"))
    told = texts.select("doc_id", "text_key", F.explode(F.arrays_zip("digest", "first")).alias("x")).select("doc_id", F.col("x.digest").alias("digest"), held.alias("held"))
    repeated = told.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"), F.min_by("held", "doc_id").alias("held"))
    repeated = repeated.where("owner <> other").select("digest", "owner", "held")
    repeated = materialise(repeated, "repeated")  # a table of its own: its join deals both sides anew, and a hot digest's rows can be split
    made = texts.select("doc_id", "text_key", F.explode(F.arrays_zip("digest", "place", "words")).alias("x")).select("doc_id", "text_key", "x.*")
    start = high("place")
    # where the piece is in its owner, and in which of its texts: as long as this stays the same, chunks follow one another there
    shift = F.when(F.col("doc_id") == F.col("owner"), 0).otherwise(F.col("held") - start)
    rows = made.join(repeated, "digest").select(
        "doc_id", "text_key", "owner", shift.alias("shift"), start.alias("start"), low("place").alias("end"), high("words").alias("w0"), low("words").alias("w1")
    )
    text = ["doc_id", "text_key"]
    by_place = Window.partitionBy(*text).orderBy("start", "end")
    so_far = by_place.rowsBetween(Window.unboundedPreceding, 0)
    follows = F.lag("end").over(by_place) == F.col("start")
    goes_on = follows & (F.lag("owner").over(by_place) == F.col("owner")) & (F.lag("shift").over(by_place) == F.col("shift"))
    rows = rows.withColumn("new", F.when(follows, 0).otherwise(1)).withColumn("turn", F.when(goes_on, 0).otherwise(1))
    rows = rows.withColumn("passage", F.sum("new").over(so_far)).withColumn("piece", F.sum("turn").over(so_far))
    pieces = rows.groupBy(*text, "passage", "piece").agg(
        F.min("start").alias("start_byte"),
        F.max("end").alias("end_byte"),
        F.min("w0").alias("w0"),
        F.max("w1").alias("w1"),
        F.count("*").alias("n_chunks"),
        F.min("owner").alias("owner_id"),
    )
    passage = Window.partitionBy(*text, "passage")
    pieces = pieces.withColumn("core", F.max("w1").over(passage) - F.min("w0").over(passage)).where(F.col("core") >= CORE_WORDS)
    n_words = (F.col("w1") - F.col("w0")).alias("n_words")
    return pieces.select("doc_id", "start_byte", "end_byte", n_words, "n_chunks", "owner_id", (F.col("owner_id") != F.col("doc_id")).alias("redundant"), "text_key")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with redundant pieces cut out of their texts; rows, columns and other texts stay as they are.

    A character that reaches into a kept chunk is kept.
    """
    own, key, cuts = spare(docs, "_cut_id", "_cut_key", "_cuts")
    cuts_of = repeated_passages(docs).where("redundant").groupBy(F.col("doc_id").alias(own), F.col("text_key").alias(key))
    spans = cuts_of.agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias(cuts))

    @F.arrow_udf("string")
    def cut(text: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(text.to_pylist(), found.to_pylist(), strict=True):
            if t is not None and spans:
                raw, kept, at, i = t.encode(), [], 0, 0
                while i < len(spans):
                    start, end = spans[i]["start_byte"], spans[i]["end_byte"]
                    while i + 1 < len(spans) and spans[i + 1]["start_byte"] <= end:  # neighbours are one cut
                        i, end = i + 1, max(end, spans[i + 1]["end_byte"])
                    i += 1
                    while start < end and raw[start : start + 1] and raw[start] & 0xC0 == 0x80:
                        start += 1
                    while end > start and raw[end : end + 1] and raw[end] & 0xC0 == 0x80:
                        end -= 1
                    kept.append(raw[at:start])
                    at = end
                t = b"".join([*kept, raw[at:]]).decode()
            out.append(t)
        return pa.array(out, pa.string())

    joined = docs.join(spans, (docs["doc_id"] == spans[own]) & (F.xxhash64(docs["text"]) == spans[key]), "left")
    return joined.withColumn("text", cut("text", cuts)).select(*docs.columns)
