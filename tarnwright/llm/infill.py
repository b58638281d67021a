"""Fill-in-the-middle rearrangement of texts, cut between tokens that are found by rank and select.

Tokens are runs of ASCII letters, or single other code points. Of a text's UTF-8 bytes one bit each says whether a
token begins there; the bits are packed into 64-bit words, and a directory holds how many ones lie before each block of
BLOCK_WORDS words (`Bits`). The total is the number of tokens; the byte where token k begins is select(k): a search in
the directory, then popcounts of the words of one block, then the bits of one word. A second vector marks the bytes
where code points begin, and its rank turns byte cuts into code points. No list of tokens is ever made.

Two cuts and a form follow from doc_id alone (`plan`). Forms: `psm` is <P>prefix<S>suffix<M>middle, `spm` is
<S>suffix<P>prefix<M>middle, `plain` is the text as it is. Marks hold one `<` each, at their beginning, and a text that
holds a mark stays plain, so marks in an output are never mistaken and `restored` needs only the output and the form.

Defined results: a null text is empty, an empty one has 0 tokens and stays plain. A null doc_id reads as no digits.
Texts of any length are cut whole; a worker holds about four times the bytes of its longest text beside its batch.
Repeated rows give repeated rows, an empty table none; other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Marks of prefix, suffix and middle, and what a cut is drawn from: `1:` before the digits of doc_id.
PREFIX, SUFFIX, MIDDLE, SEED = "<P>", "<S>", "<M>", "1:"
#: Of a hundred texts so many are rearranged, and of a hundred of these so many begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20
#: Words of 64 bits between entries of a directory.
BLOCK_WORDS = 8

SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class Bits:
    """A packed vector of bits with a directory of ones: rank and select without unpacking it."""

    def __init__(self, flags: np.ndarray) -> None:
        self.length = len(flags)
        blocks = self.length // (64 * BLOCK_WORDS) + 1
        packed = np.zeros(blocks * BLOCK_WORDS * 8, np.uint8)
        bits = np.packbits(flags, bitorder="little")
        packed[: len(bits)] = bits
        self.words = packed.view("<u8")
        ones = np.bitwise_count(self.words).reshape(blocks, BLOCK_WORDS).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def rank(self, at: int) -> int:
        """Ones before place `at`."""
        word, bit = divmod(at, 64)
        block = word // BLOCK_WORDS
        whole = int(np.bitwise_count(self.words[block * BLOCK_WORDS : word]).sum())
        part = (int(self.words[word]) & ((1 << bit) - 1)).bit_count() if bit else 0
        return int(self.before[block]) + whole + part

    def select(self, k: int) -> int:
        """The place of the k-th one, from 0; the vector's length if there are no more than k."""
        if k >= self.total:
            return self.length
        block = int(np.searchsorted(self.before, k, side="right")) - 1
        left = k - int(self.before[block])
        for at in range(block * BLOCK_WORDS, (block + 1) * BLOCK_WORDS):
            word = int(self.words[at])
            ones = word.bit_count()
            if left < ones:
                for _ in range(left):
                    word &= word - 1
                return at * 64 + (word & -word).bit_length() - 1
            left -= ones
        raise AssertionError("a directory that does not fit its words")


def boundaries(data: np.ndarray) -> tuple[Bits, Bits]:
    """Where tokens begin, and where code points do, in UTF-8 bytes."""
    lower = data | np.uint8(0x20)
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    point = (data & np.uint8(0xC0)) != 0x80
    begins = point.copy()
    begins[1:] &= ~(letter[1:] & letter[:-1])
    return Bits(begins), Bits(point)


def plan(digest: str) -> tuple[int, int, int, int]:
    """The four numbers that a document's cuts and form are drawn from: the first 32 hex digits of its digest."""
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def rearranged(text: bytes, digest: str) -> tuple[int, str, int | None, int | None, bytes]:
    """Tokens, form, code points of prefix and middle (None if plain), and the output of one text."""
    h1, h2, h3, h4 = plan(digest)
    tokens, points = boundaries(np.frombuffer(text, np.uint8))
    n = tokens.total
    if not text or h3 % 100 >= REARRANGED or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((tokens.select(h1 % (n + 1)), tokens.select(h2 % (n + 1))))
    before = points.rank(low)
    sizes = before, points.rank(high) - before
    p, m, s = PREFIX.encode() + text[:low], MIDDLE.encode() + text[low:high], SUFFIX.encode() + text[high:]
    return (n, "spm", *sizes, s + p + m) if h4 % 100 < SUFFIX_FIRST else (n, "psm", *sizes, p + s + m)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every text. One pass without a shuffle."""
    key = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)

    def make() -> Callable[[pa.RecordBatch], dict[str, object]]:
        def each(batch: pa.RecordBatch) -> dict[str, object]:
            texts = batch.column("text").cast(pa.binary())
            made = [rearranged(t.as_py() or b"", d.as_py()) for t, d in zip(texts, batch.column("digest"), strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True) if made else ((),) * 5
            return {"doc_id": batch.column("doc_id"), "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": pa.array(output, pa.binary()).cast(pa.string())}

        return each

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", key.alias("digest")), make, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def infill_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    made = fill_in_middle(docs)
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def oracle_sql() -> str:
    """The same by lists of tokens."""
    group = [f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4)]
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents),
h AS (SELECT doc_id, text, u, len(u) AS n, {", ".join(group)} FROM t),
c AS (
  SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
      OR h3 % 100 >= {REARRANGED} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:low], '') AS a, array_to_string(u[low + 1:high], '') AS b,
    array_to_string(u[high + 1:n], '') AS z
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || a || '{SUFFIX}' || z || '{MIDDLE}' || b
    WHEN 'spm' THEN '{SUFFIX}' || z || '{PREFIX}' || a || '{MIDDLE}' || b ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""
