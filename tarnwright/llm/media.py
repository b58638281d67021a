"""Media columns: progressive JPEG, written and read here.

Reading: scans of any order, spectral selection and successive approximation accumulate into coefficient arrays;
blocks are then dequantised and inverse-transformed in numpy (whole-number matrices, so that results do not depend on
how work is batched), chroma is upsampled by repetition, and the picture is stored as a full-resolution RGB tensor of
8-bit values.

A text is stored losslessly in the format's unit, the block of 64 coefficients: a byte is a coefficient from -127 to
128, the commoner the byte in text, the nearer to 0 (a space is 0). So coefficients have all categories, and zeros,
runs and ends of bands as pictures have. Blocks go to luma first (four sixths), then to the two chroma planes, which
have half its resolution; the planes are filled up with spaces. A comment segment holds the number of payload bytes.
Scans: DC at half precision, the low bands at half precision, the high bands whole, then DC and the low bands refined,
all but the refined DC by Huffman codes; a restart marker after every RESTART units.

Many pictures are read at once. Restart intervals are independent, so each is a lane, and all lanes of all pictures
advance by one Huffman code a step, with the next 16 bits of each looked up in its table. Correction bits are not
read one by one: the steps only say where they stand, and all of them are applied at the end. A plain decoder, code
by code, reads the same (tested) and is what the fast one is held against.

Defined results: null and empty texts are stored as 64 zero bytes. Equal texts give equal values. Pictures without
payload comment decode to tensors as well; their payload is null. Damaged streams raise ValueError. A worker holds some
forty times the bytes of PART_BYTES, or of the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, utf8

SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
MEDIA_SCHEMA = "doc_id bigint, media binary, height int, width int, tensor binary, payload binary"
UNIT = 64
MARK = b"payload-bytes:"
#: Units between restart markers, and bytes of payload that are coded together.
RESTART, PART_BYTES = 8, 1 << 21


def zigzag_order() -> np.ndarray:
    """Natural (row-major) place of each coefficient in zigzag order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


ZIGZAG = zigzag_order()
#: Whole-number rows of the inverse transform, scaled by 2 ** 12: sums of products stay exact in double precision.
SCALE = 12
_U, _X = np.arange(8)[:, None], np.arange(8)[None, :]
INVERSE = np.rint(np.where(_U == 0, 8**-0.5, 0.5) * np.cos((2 * _X + 1) * _U * np.pi / 16) * 2**SCALE)
#: Both passes as one matrix: zigzag coefficients to the 64 samples of a block.
_BASIS = np.einsum("uy,vx->uvyx", INVERSE, INVERSE).reshape(64, 64)[ZIGZAG]

#: Bytes from the commonest on, as far as that matters; the others follow in their order.
COMMON = b" etaoinshrdlucmfwypvbg.,\nkjqxz"
_RANKED = np.array([*COMMON, *(b for b in range(256) if b not in COMMON)])
_OF_RANK = np.where(np.arange(256) % 2, 1, -1) * (np.arange(1, 257) // 2)  # 0, 1, -1, 2, -2, ...
_TO_COEFFICIENT = np.zeros(256, np.int32)
_TO_COEFFICIENT[_RANKED] = _OF_RANK
_TO_BYTE = np.zeros(257, np.uint8)  # by coefficient + 127
_TO_BYTE[_OF_RANK + 127] = _RANKED
#: Magnitude categories.
_SIZE = np.array([n.bit_length() for n in range(1 << 12)])


# Writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, slot: int, by_length: dict[int, list[int]]) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | slot, *(len(by_length.get(n, ())) for n in range(1, 17)), *(s for n in sorted(by_length) for s in by_length[n])]))


#: DC categories 0 to 11 by code length.
DC_LENGTHS = {2: [7, 8], 3: [5, 6], 4: [3, 4], 5: [0, 1, 2], 6: [9], 7: [10], 8: [11]}


def _ac_lengths() -> dict[int, list[int]]:
    """AC symbols (run, category) by code length: a Huffman code for zeros of one in seven, and no code of ones only."""
    share = (0.22, 0.22, 0.26, 0.17, 0.08, 0.03, 0.01, 0.01)
    weight = {r << 4 | n: 0.14**r * p for r in range(16) for n, p in enumerate(share, 1)}
    weight |= {r << 4: 0.01 / (r + 1) for r in range(15)} | {0xF0: 0.0}
    heap = [(max(w, 2e-4), s, (s,)) for s, w in weight.items()] + [(1e-4, 256, (256,))]
    depth = dict.fromkeys([*weight, 256], 0)
    heapify(heap)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heappop(heap), heappop(heap)
        for s in x + y:
            depth[s] += 1
        heappush(heap, (a + b, i, x + y))
    deepest = max(depth.values())
    if deepest > 16 or depth[256] != deepest:
        raise AssertionError("the rule gives codes that the format does not have")
    return {n: sorted(s for s, d in depth.items() if d == n and s < 256) for n in range(1, 17) if n in depth.values()}


AC_LENGTHS = _ac_lengths()


def _codes(by_length: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical."""
    out, code = {}, 0
    for n in range(1, 17):
        for s in by_length.get(n, ()):
            out[s] = (code, n)
            code += 1
        code <<= 1
    return out


_DC_CODES, _AC_CODES = _codes(DC_LENGTHS), _codes(AC_LENGTHS)


def _by_symbol(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        code[s], length[s] = c, n
    return code, length


_DC, _AC = _by_symbol(_DC_CODES), _by_symbol(_AC_CODES)


def _head(components: list[int], dc: int, ac: int, start: int, end: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(b for c in components for b in (c, dc << 4 | ac)), start, end, high << 4 | low]))


def _scan(components: list[int], dc: int, ac: int, start: int, end: int, high: int, low: int, data: bytes) -> bytes:
    return _head(components, dc, ac, start, end, high, low) + data.replace(b"\xff", b"\xff\x00")


def _put(out: np.ndarray, value: np.ndarray, length: np.ndarray, at: np.ndarray) -> None:
    """Ors values of up to 32 bits, in rising order of their first bits, into big-endian words of 32 bits."""
    some = np.flatnonzero(length)
    if not some.size:
        return
    value, length, at = value[some].astype(np.uint64), length[some], at[some]
    word = at >> 5
    value = value << (64 - (at & 31) - length).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] |= np.bitwise_or.reduceat(value >> np.uint64(32), first)
    out[word[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)


def _coded(value: np.ndarray, length: np.ndarray, first: np.ndarray, of_picture: np.ndarray, pictures: int) -> list[bytes]:
    """Entropy-coded data of each picture from its codes in order.

    first: where each restart interval's codes begin; of_picture: the picture of each interval.
    """
    before = np.concatenate([[0], np.cumsum(length)])
    opens = before[first]
    bits = np.append(opens[1:], before[-1]) - opens
    size = -(-bits // 8)
    begin = np.cumsum(size) - size
    n = int(size.sum())
    words = np.zeros(n // 4 + 3, np.uint64)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(value))))
    _put(words, value, length, before[:-1] - opens[of] + 8 * begin[of])
    fill = 8 * size - bits
    _put(words, (1 << fill) - 1, fill, 8 * begin + bits)
    raw = words.astype(">u4").view(np.uint8)[:n]
    # stuffing, and a marker before all but a picture's first interval
    new = np.diff(of_picture, prepend=-1) > 0
    number = np.arange(len(first)) - np.maximum.accumulate(np.where(new, np.arange(len(first)), 0))
    markers = np.cumsum(~new)
    full = raw == 255
    to = np.arange(n) + np.cumsum(full) - full + np.repeat(2 * markers, size)
    out = np.zeros(n + int(full.sum()) + 2 * int(markers[-1] if len(markers) else 0), np.uint8)
    out[to] = raw
    starts = np.append(to, len(out))[begin]  # every interval has a code, so a byte
    out[starts[~new] - 2], out[starts[~new] - 1] = 0xFF, 0xD0 + (number[~new] - 1) % 8
    edge = np.append(starts[new], len(out))
    data, own = out.tobytes(), of_picture[new]
    parts = [b""] * pictures
    for i, a, b in zip(own.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        parts[i] = data[a:b]
    return parts


def _bands(need: np.ndarray, empty: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where end-of-band runs begin, and how many blocks each has: an empty block goes on with the run before it."""
    goes_on = empty & need & np.concatenate([[False], need[:-1]]) & ~opens
    begins = need & ~goes_on
    return begins, np.bincount(np.cumsum(begins)[need] - 1, minlength=int(begins.sum()))


def _ac_first_codes(c: np.ndarray, low: int, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and lengths of the codes of a band (blocks by coefficients), and the first code of each block."""
    code, length = _AC
    n, width = c.shape
    size = np.abs(c) >> low
    block, k = np.nonzero(size)
    size = size[block, k]
    before = np.concatenate([[-1], k[:-1]])
    before[np.diff(block, prepend=-1) > 0] = -1
    run = k - before - 1
    category = _SIZE[size]
    symbol = (run & 15) << 4 | category
    extra = np.where(c[block, k] > 0, size, (1 << category) - 1 - size)
    last = np.full(n, -1)
    last[block] = k
    need = last < width - 1
    begins, blocks = _bands(need, last < 0, opens)
    ends_before = np.cumsum(begins) - begins
    many = (run >> 4) + 1
    total = np.cumsum(many)
    held = np.zeros(n + 1, np.int64)  # codes of coefficients before each block
    np.add.at(held, block + 1, many)
    held = np.cumsum(held)
    value, bits = np.full(int(held[-1] + begins.sum()), code[0xF0]), np.full(int(held[-1] + begins.sum()), length[0xF0])
    at = total - 1 + ends_before[block]
    value[at], bits[at] = code[symbol] << category | extra, length[symbol] + category
    at = (held[1:] + ends_before)[begins]
    r = _SIZE[blocks] - 1
    value[at], bits[at] = code[r << 4] << r | (blocks - (1 << r)), length[r << 4] + r
    return value, bits, held[:-1] + ends_before


def _ac_refine_codes(c: np.ndarray, low: int, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for a refinement of a band of at most 16 coefficients."""
    code, length = _AC
    n, width = c.shape
    size = np.abs(c) >> low
    old, new = size > 1, size == 1
    block, k = np.nonzero(new)
    zeros = np.cumsum(size == 0, axis=1)  # up to and with each
    own = zeros[block, k]
    before = np.concatenate([[0], own[:-1]])
    before[np.diff(block, prepend=-1) > 0] = 0
    symbol = (own - before) << 4 | 1
    last = np.full(n, -1)
    last[block] = k
    need = last < width - 1
    begins, blocks = _bands(need, last < 0, opens)
    ends_before = np.cumsum(begins) - begins
    news = np.concatenate([[0], np.cumsum(new.sum(axis=1))])
    event, end_event = np.arange(len(block)) + ends_before[block], (news[1:] + ends_before)[begins]
    # the event that each correction bit follows: the next new coefficient of its block, else the run that its block is in
    ob, ok = np.nonzero(old)
    following = np.cumsum(new.ravel()).reshape(n, width)[ob, ok]
    inside = following < news[ob + 1]
    of = np.empty(len(ob), np.int64)
    of[inside] = event[following[inside]]
    of[~inside] = end_event[np.cumsum(begins)[ob[~inside]] - 1]
    corrections = np.bincount(of, minlength=len(block) + len(end_event))
    at = np.cumsum(corrections + 1) - corrections - 1  # of each event's code
    value, bits = np.empty(len(corrections) + len(ob), np.int64), np.ones(len(corrections) + len(ob), np.int64)
    value[at[event]], bits[at[event]] = code[symbol] << 1 | (c[block, k] > 0), length[symbol] + 1
    r = _SIZE[blocks] - 1
    value[at[end_event]], bits[at[end_event]] = code[r << 4] << r | (blocks - (1 << r)), length[r << 4] + r
    value[np.arange(len(ob)) + of + 1] = size[ob, ok] & 1
    first_event = news[:-1] + ends_before
    return value, bits, np.append(at, len(value))[first_event]


#: Component, first and last coefficient, bits left out at first: the bands that scans have.
BANDS = ((0, 1, 5, 1), (1, 1, 9, 1), (2, 1, 9, 1), (0, 6, 63, 0), (1, 10, 63, 0), (2, 10, 63, 0))
_OF_UNIT = np.array([0, 0, 0, 0, 1, 2])


@lru_cache(maxsize=256)
def _unit_rows(across: int, down: int) -> np.ndarray:
    """Blocks of each unit, a picture's blocks being luma, then the chroma planes, each row by row."""
    y, x = np.divmod(np.arange(across * down), across)
    luma = (2 * y * 2 * across + 2 * x)[:, None] + np.array([0, 1, 2 * across, 2 * across + 1])
    units = across * down
    return np.column_stack([luma, 4 * units + np.arange(units), 5 * units + np.arange(units)])


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Progressive JPEGs whose coefficients are the payloads, each a positive multiple of 64 bytes."""
    shape = []
    for p in payloads:
        if not p or len(p) % UNIT:
            raise ValueError("payload must be a positive multiple of 64 bytes")
        units = -(-len(p) // (6 * UNIT))
        across = max(1, int(units**0.5))
        shape.append((across, -(-units // across)))
        if max(shape[-1]) * 16 > 65_535:
            raise ValueError("payload is too large for one picture")
    if not payloads:
        return []
    units = np.array([a * d for a, d in shape])
    base = 6 * (np.cumsum(units) - units)
    flat = np.full(6 * int(units.sum()) * UNIT, 32, np.uint8)
    for b, p in zip(base.tolist(), payloads, strict=True):
        flat[b * UNIT : b * UNIT + len(p)] = np.frombuffer(p, np.uint8)
    c = _TO_COEFFICIENT[flat].reshape(-1, UNIT)
    n = len(payloads)
    heads = []
    for p, (a, d) in zip(payloads, shape, strict=True):
        heads.append([b"\xff\xd8", _segment(0xFE, MARK + str(len(p)).encode()), _PLAIN_QUANTISER, _segment(0xC2, struct.pack(">BHHB", 8, d * 16, a * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), _TABLES])

    def add(head: bytes, parts: list[bytes]) -> None:
        for out, data in zip(heads, parts, strict=True):
            out += (head, data)

    # DC: units in order, luma blocks two by two
    unit = np.concatenate([b + _unit_rows(a, d) for b, (a, d) in zip(base.tolist(), shape, strict=True)])
    number = np.arange(len(unit)) - np.repeat(np.cumsum(units) - units, units)
    opens = number % RESTART == 0
    of_picture = np.repeat(np.arange(n), units)[opens]
    halves = c[unit, 0] >> 1
    diff = np.empty(halves.shape, np.int64)
    for i in range(3):
        own = halves[:, _OF_UNIT == i]
        before = np.concatenate([np.zeros(1, own.dtype), own.ravel()[:-1]]).reshape(own.shape)
        before[opens, 0] = 0
        diff[:, _OF_UNIT == i] = own - before
    diff = diff.ravel()
    size = _SIZE[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    first = 6 * np.flatnonzero(opens)
    add(_head([1, 2, 3], 0, 0, 0, 0, 0, 1), _coded(_DC[0][size] << size | extra, _DC[1][size] + size, first, of_picture, n))
    later = [(_head([1, 2, 3], 0, 0, 0, 0, 1, 0), _coded(c[unit, 0].ravel() & 1, np.ones(unit.size, np.int64), first, of_picture, n))]
    blocks = {}
    for i, (many, skip) in enumerate(((4, 0), (1, 4), (1, 5))):
        own = many * units
        place = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        blocks[i] = (place + np.repeat(base + skip * units, own), place % RESTART == 0, np.repeat(np.arange(n), own))
    for i, start, end, low in BANDS:
        rows, opens, picture = blocks[i]
        band = c[rows, start : end + 1]
        value, bits, first = _ac_first_codes(band, low, opens)
        add(_head([i + 1], 0, 0, start, end, 0, low), _coded(value, bits, first[opens], picture[opens], n))
        if low:
            value, bits, first = _ac_refine_codes(band, 0, opens)
            later.append((_head([i + 1], 0, 0, start, end, 1, 0), _coded(value, bits, first[opens], picture[opens], n)))
    for head, parts in later:
        add(head, parts)
    return [b"".join([*out, b"\xff\xd9"]) for out in heads]


def encode(payload: bytes) -> bytes:
    return encode_many([payload])[0]


_PLAIN_QUANTISER = _segment(0xDB, bytes([0]) + bytes([1]) * 64)
_TABLES = _table(0, 0, DC_LENGTHS) + _table(1, 0, AC_LENGTHS) + _segment(0xDD, struct.pack(">H", RESTART))


# Reading


@dataclass
class Component:
    key: int
    across: int  # sampling factors
    down: int
    table: int
    wide: int = 0  # blocks in the padded plane
    high: int = 0
    own_wide: int = 0  # blocks that scans of this component alone hold
    own_high: int = 0
    values: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Scan:
    owners: list[tuple[int, int, int]]  # component, DC table, AC table
    start: int
    end: int
    high: int
    low: int
    tables: dict[tuple[int, int], "Codes"]
    restart: int
    data: tuple[int, int]  # where the entropy-coded data are


@dataclass
class Picture:
    height: int = 0
    width: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)


class Codes:
    """A Huffman table: (length, code) -> symbol, and what the next 16 bits say, as packed fields."""

    def __init__(self, by_code: dict[tuple[int, int], int]) -> None:
        self.by_code = by_code
        self.look = np.zeros(1 << 16, np.uint32)
        for (n, code), symbol in by_code.items():
            run, size = divmod(symbol, 16)
            extra = size or (run if run < 15 else 0)
            self.look[code << (16 - n) : (code + 1) << (16 - n)] = n | extra << 5 | run << 9 | size << 13


@lru_cache(maxsize=64)
def _huffman(body: bytes) -> list[tuple[int, int, Codes]]:
    """Class, slot and codes of the tables in a segment."""
    at, out = 0, []
    while at < len(body):
        counts, where, code, table = body[at + 1 : at + 17], at + 17, 0, {}
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                if code >> n:
                    raise ValueError("more codes than a table can have")
                table[n, code] = body[where]
                code, where = code + 1, where + 1
            code <<= 1
        out.append((body[at] >> 4, body[at] & 15, Codes(table)))
        at = where
    return out


def _quantisers(body: bytes, picture: Picture) -> None:
    at = 0
    while at < len(body):
        wide, slot = body[at] >> 4, body[at] & 15
        picture.quantisers[slot] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int32)
        at += 1 + 64 * (1 + wide)


def _frame(body: bytes, picture: Picture) -> None:
    depth, picture.height, picture.width, n = struct.unpack_from(">BHHB", body)
    if depth != 8 or not picture.height or not picture.width or n not in (1, 3) or picture.components:
        raise ValueError("unsupported frame")
    picture.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    if not all(1 <= f <= 4 for c in picture.components for f in (c.across, c.down)):
        raise ValueError("sampling factors must be 1 to 4")
    most_a, most_d = max(c.across for c in picture.components), max(c.down for c in picture.components)
    for c in picture.components:
        c.wide, c.high = -(-picture.width // (8 * most_a)) * c.across, -(-picture.height // (8 * most_d)) * c.down
        c.own_wide = -(-(-(-picture.width * c.across // most_a)) // 8)
        c.own_high = -(-(-(-picture.height * c.down // most_d)) // 8)


def _parsed(data: bytes, start: int, end: int, marks: list[int]) -> Picture:
    """What the segments of data[start:end] say; marks: where a byte 255 stands before what is neither 0, 255 nor a restart."""
    picture, tables, restart, at = Picture(), {}, 0, start + 2
    if data[start : start + 2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while True:
        where = bisect_left(marks, at)
        if where == len(marks) or marks[where] + 2 > end:
            raise ValueError("picture ends early")
        at = marks[where]
        marker = data[at + 1]
        if marker == 0xD9:
            return picture
        if marker == 0x01:
            at += 2
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        if size < 2 or at + 2 + size > end:
            raise ValueError("segment leaves the picture")
        at += 2 + size
        if marker == 0xDB:
            _quantisers(body, picture)
        elif marker == 0xC2:
            _frame(body, picture)
        elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only progressive Huffman-coded pictures are read")
        elif marker == 0xC4:
            tables = tables | {(kind, slot): codes for kind, slot, codes in _huffman(body)}
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xFE:
            picture.comments.append(body)
        elif marker == 0xDA:
            where = bisect_left(marks, at)
            if where == len(marks) or marks[where] + 2 > end:
                raise ValueError("scan ends early")
            n, keys = body[0], [c.key for c in picture.components]
            owners = [(keys.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            first, last, exact = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n]
            if not owners or len({o[0] for o in owners}) < n or not first <= last < 64 or (first == 0) != (last == 0) or first and n > 1 or exact & 15 > 13:
                raise ValueError("no such scan")
            picture.scans.append(Scan(owners, first, last, exact >> 4, exact & 15, tables, restart, (at, marks[where])))
            at = marks[where]


@lru_cache(maxsize=256)
def _alone(wide: int, own_wide: int, own_high: int) -> np.ndarray:
    """Block places of a component's own scans: those that hold samples of the picture."""
    y, x = np.divmod(np.arange(own_wide * own_high), own_wide)
    return (y * wide + x)[:, None]


@lru_cache(maxsize=256)
def _in_units(wide: int, high: int, across: int, down: int) -> np.ndarray:
    """Block places of a component in scans of several: a row a unit."""
    y, x = np.divmod(np.arange(wide // across * (high // down)), wide // across)
    return np.column_stack([(y * down + v) * wide + x * across + h for v in range(down) for h in range(across)])


def _units(picture: Picture, scan: Scan) -> tuple[list[np.ndarray], int]:
    """Block places, by owner and then block of a unit, of all units of a scan, and the number of units."""
    own = [picture.components[i] for i, _, _ in scan.owners]
    if len(own) == 1:
        return [_alone(own[0].wide, own[0].own_wide, own[0].own_high)], own[0].own_wide * own[0].own_high
    return [_in_units(c.wide, c.high, c.across, c.down) for c in own], own[0].wide // own[0].across * (own[0].high // own[0].down)


class Stream:
    """Unstuffed bytes of many pictures, with the 64 bits from each byte on."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data, np.uint8)
        full, after = raw[:-1] == 255, raw[1:]
        restarts = full & (after >= 0xD0) & (after <= 0xD7)
        self.marks = np.flatnonzero(full & (after != 0) & (after != 255) & ~restarts).tolist()
        self.restarts = np.flatnonzero(restarts)
        kept = np.concatenate([[True], ~(full & (after == 0))])
        self.place = np.cumsum(kept) - kept  # of a byte without stuffing
        plain = np.concatenate([raw[kept], np.zeros(16, np.uint8)])
        self.last = len(plain) - 9
        self.ahead = np.ndarray((len(plain) - 7,), ">u8", plain.data, strides=(1,)).astype(np.uint64)

    def window(self, bit: np.ndarray) -> np.ndarray:
        """The bits from each bit on, 57 at least."""
        return self.ahead[np.minimum(bit >> 3, self.last)] << (bit & 7).astype(np.uint64)


@dataclass
class Lanes:
    """Restart intervals of scans of one kind: bits from at to end, blocks from first to first + blocks of rows."""

    at: np.ndarray
    end: np.ndarray
    first: np.ndarray
    blocks: np.ndarray
    rows: np.ndarray  # of the coefficient array, in order
    tables: np.ndarray  # offset in looks: of each lane (AC), or of each block (DC)
    looks: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    low: np.ndarray
    owner: np.ndarray  # of each block: which predictor


def _lanes(stream: Stream, chosen: list[tuple[Picture, Scan, list[int]]], dc: bool) -> Lanes:
    """chosen: pictures, their scans, and the first row of each component."""
    looks: list[np.ndarray] = []
    known: dict[int, int] = {}

    def offset(codes: Codes) -> int:
        if id(codes) not in known:
            known[id(codes)] = len(looks) << 16
            looks.append(codes.look)
        return known[id(codes)]

    rows, units, per, owners, tables = [], [], [], [], []
    for picture, scan, base in chosen:
        places, n = _units(picture, scan)
        moved = [p + base[i] for p, (i, _, _) in zip(places, scan.owners, strict=True)]
        rows.append((np.concatenate(moved, axis=1) if len(moved) > 1 else moved[0]).ravel())
        units.append(n)
        per.append(sum(p.shape[1] for p in places))
        if dc:
            pattern = [j for j, p in enumerate(places) for _ in range(p.shape[1])]
            owners.append(np.tile(pattern, n))
            if not scan.high:
                tables.append(np.tile([offset(scan.tables[0, scan.owners[j][1]]) for j in pattern], n))
        else:
            tables.append(offset(scan.tables[1, scan.owners[0][2]]))
    units, per = np.array(units), np.array(per)
    opens, closes = (np.array(x) for x in zip(*(s.data for _, s, _ in chosen), strict=True))
    restart = np.array([s.restart or n for (_, s, _), n in zip(chosen, units.tolist(), strict=True)])
    many = -(-units // restart)
    a, b = np.searchsorted(stream.restarts, opens), np.searchsorted(stream.restarts, closes)
    if (b - a != many - 1).any():
        raise ValueError("restart markers do not fit the scan")
    of = np.repeat(np.arange(len(chosen)), many)
    number = np.arange(len(of)) - (np.cumsum(many) - many)[of]
    mark = np.append(stream.restarts, 0)
    begin = np.where(number > 0, mark[np.minimum(a[of] + number - 1, len(mark) - 1)] + 2, opens[of])
    end = np.where(number < many[of] - 1, mark[np.minimum(a[of] + number, len(mark) - 1)], closes[of])
    first = (np.cumsum(units * per) - units * per)[of] + number * restart[of] * per[of]
    blocks = np.minimum(restart[of], units[of] - number * restart[of]) * per[of]
    value = lambda name: np.array([getattr(s, name) for _, s, _ in chosen])[of]
    place = np.append(stream.place, len(stream.ahead) - 9)
    return Lanes(
        8 * place[begin], 8 * place[end], first, blocks, np.concatenate(rows),
        (np.concatenate(tables) if tables else np.zeros(0, np.int64)) if dc else np.array(tables)[of], np.concatenate(looks) if looks else np.zeros(1, np.uint32),
        value("start"), value("end"), value("low"), np.concatenate(owners) if dc else np.zeros(0, np.int64),
    )


_HALF = np.array([0, *(1 << n for n in range(15))])
_FULL = np.array([(1 << n) - 1 for n in range(16)])


def _next_code(stream: Stream, bit: np.ndarray, tables: np.ndarray, looks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each lane the length of the next code and its extra bits, their value, run, category, and whether there is a code."""
    w = stream.window(bit)
    look = looks[tables + (w >> np.uint64(48)).astype(np.int64)].astype(np.int64)
    length, extra = look & 31, look >> 5 & 15
    value = ((w << length.astype(np.uint64)) >> np.uint64(1) >> (63 - extra).astype(np.uint64)).astype(np.int64)
    return length + extra, value, look >> 9 & 15, look >> 13, look > 0


def _dc_first(stream: Stream, lanes: Lanes, values: np.ndarray) -> None:
    bit, before = lanes.at.copy(), np.zeros((len(lanes.at), 4), np.int64)
    for t in range(int(lanes.blocks.max(initial=0))):
        live = np.flatnonzero(lanes.blocks > t)
        at = lanes.first[live] + t
        used, v, run, size, good = _next_code(stream, bit[live], lanes.tables[at], lanes.looks)
        if not good.all() or run.any():
            raise ValueError("no such code")
        bit[live] += used
        before[live, lanes.owner[at]] += v - (v < _HALF[size]) * _FULL[size]
        values[lanes.rows[at], 0] = before[live, lanes.owner[at]] << lanes.low[live]
    if (bit > lanes.end).any():
        raise ValueError("entropy-coded data end early")


def _dc_refine(stream: Stream, lanes: Lanes, values: np.ndarray) -> None:
    if (lanes.at + lanes.blocks > lanes.end).any():
        raise ValueError("entropy-coded data end early")
    of = np.repeat(np.arange(len(lanes.at)), lanes.blocks)
    number = np.arange(len(of)) - (np.cumsum(lanes.blocks) - lanes.blocks)[of]
    bits = (stream.window(lanes.at[of] + number) >> np.uint64(63)).astype(np.int64)
    values[lanes.rows[lanes.first[of] + number], 0] |= (bits << lanes.low[of]).astype(values.dtype)


def _ac_first(stream: Stream, lanes: Lanes, values: np.ndarray) -> None:
    """values has one row more than blocks, for what lanes that are through would write."""
    flat, nowhere = values.reshape(-1), 64 * (len(values) - 1)
    bit, end, j, last = lanes.at, lanes.end, lanes.first, lanes.first + lanes.blocks
    tables, start, stop, low = lanes.tables, lanes.start, lanes.stop, lanes.low
    k, t, live = start, 0, j < last
    while live.any():
        if t % 16 == 0 and not live.all():
            if (bit > end)[~live].any():
                raise ValueError("entropy-coded data end early")
            bit, end, j, last, tables, start, stop, low, k = (x[live] for x in (bit, end, j, last, tables, start, stop, low, k))
            live = live[live]
        used, v, run, size, good = _next_code(stream, bit, tables, lanes.looks)
        bit = bit + used * live
        found = size > 0
        at = k + run
        if not good.all() and not good[live].all() or (found & live & (at > stop)).any():
            raise ValueError("no such code, or a run leaves the band")
        row = lanes.rows[np.minimum(j, len(lanes.rows) - 1)]
        flat[np.where(found & live, 64 * row + at, nowhere)] = (v - (v < _HALF[size]) * _FULL[size]) << low
        ends = ~found & (run < 15)
        k = at + 1
        j = j + np.where(ends, (1 << run) + v, k > stop)
        k = np.where(ends | (k > stop), start, k)
        live = j < last
        t += 1
    if (bit > end).any():
        raise ValueError("entropy-coded data end early")


def _ac_refine(stream: Stream, lanes: Lanes, values: np.ndarray) -> None:
    """Correction bits belong to the non-zero coefficients in the order of the scan: each code says how far they are given."""
    left, right = int(lanes.start.min()), int(lanes.stop.max())
    width = right - left + 1
    of = np.repeat(np.arange(len(lanes.at)), lanes.blocks)
    order = lanes.first[of] + np.arange(len(of)) - (np.cumsum(lanes.blocks) - lanes.blocks)[of]
    rows = lanes.rows[order]
    first = np.cumsum(lanes.blocks) - lanes.blocks
    column = np.arange(left, right + 1)
    inside = (column >= lanes.start[of][:, None]) & (column <= lanes.stop[of][:, None])
    old = (values[rows, left : right + 1] != 0) & inside
    zero = inside & ~old
    n_zero = np.zeros((len(rows) + 1, width + 1), np.int64)
    n_zero[:-1, 1:] = np.cumsum(zero, axis=1)  # zeros before each column
    n_old = np.zeros((len(rows) + 1, width + 1), np.int64)
    n_old[:-1, 1:] = np.cumsum(old, axis=1)
    n_old += np.concatenate([[0], np.cumsum(n_old[:-1, -1])])[:, None]  # and of non-zeros in the order of all blocks
    zeros = np.concatenate([np.argsort(~zero, axis=1, kind="stable"), np.full((len(rows), 1), width)], axis=1)  # columns, zeros first
    whose, bit, end = np.arange(len(lanes.at)), lanes.at, lanes.end
    j, last, tables, start, stop, low = first, first + lanes.blocks, lanes.tables, lanes.start - left, lanes.stop - left, lanes.low
    k, t, live = start, 0, j < last
    told: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while live.any():
        if not live.all():
            if (bit > end)[~live].any():
                raise ValueError("entropy-coded data end early")
            bit, end, j, last, tables, start, stop, low, k, whose = (x[live] for x in (bit, end, j, last, tables, start, stop, low, k, whose))
        used, v, run, size, good = _next_code(stream, bit, tables, lanes.looks)
        if not good.all() or (size > 1).any():
            raise ValueError("no such code")
        bit = bit + used
        ends = (size == 0) & (run < 15)
        which = n_zero[j, k] + run
        there = which < n_zero[j, stop + 1]
        if not (there | ends).all():
            raise ValueError("a run leaves the band")
        at = zeros[j, np.minimum(which, width)]
        done = n_old[j, k]
        new = size == 1
        fresh.append((64 * rows[j[new]] + left + at[new], v[new], low[new]))
        k = at + 1
        j = np.minimum(j + np.where(ends, (1 << run) + v, k > stop), last)
        k = np.where(ends | (k > stop), start, k)
        live = j < last
        # n_old at the start of a block counts all before it, whatever column the band starts at
        given = n_old[j, np.where(live, k, 0)] - done
        told.append((done, given, bit))
        bit = bit + given
        t += 1
    if (bit > end).any():
        raise ValueError("entropy-coded data end early")
    done, given, bit = (np.concatenate(x) for x in zip(*told, strict=True))
    which = np.repeat(np.arange(len(done)), given)
    number = np.arange(len(which)) - (np.cumsum(given) - given)[which]
    ones = (stream.window(bit[which] + number) >> np.uint64(63)).astype(np.int64)
    block, at = np.nonzero(old)
    place = (64 * rows[block] + left + at)[done[which] + number]
    flat = values.reshape(-1)
    flat[place] += (np.sign(flat[place]) * (ones << lanes.low[of][block][done[which] + number])).astype(values.dtype)
    at, v, low = (np.concatenate(x) for x in zip(*fresh, strict=True))
    flat[at] = ((2 * v - 1) << low).astype(values.dtype)


_READERS = {(True, False): _dc_first, (True, True): _dc_refine, (False, False): _ac_first, (False, True): _ac_refine}


def decode_many(data: list[bytes]) -> tuple[list[Picture], np.ndarray]:
    """Pictures with their coefficients (zigzag order), which are views of the one array that is given as well."""
    try:
        return _decode_many(data)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError("damaged picture") from e


def _decode_many(data: list[bytes]) -> tuple[list[Picture], np.ndarray]:
    # two bytes between pictures, so that no marker is seen across them
    stream, begin = Stream(b"\0\0".join([*data, b""])), 0
    pictures = []
    for d in data:
        pictures.append(_parsed_at(d, begin, stream))
        begin += len(d) + 2
    rows, bases = 0, []
    for p in pictures:
        bases.append([])
        for c in p.components:
            bases[-1].append(rows)
            rows += c.wide * c.high
    if rows > 8 * sum(map(len, data)):
        raise ValueError("more blocks than bits")
    values = np.zeros((rows + 1, 64), np.int32)
    for number in range(max((len(p.scans) for p in pictures), default=0)):
        for (dc, refines), read in _READERS.items():
            chosen = [(p, p.scans[number], b) for p, b in zip(pictures, bases, strict=True) if number < len(p.scans) and (p.scans[number].start == 0, p.scans[number].high > 0) == (dc, refines)]
            if chosen:
                read(stream, _lanes(stream, chosen, dc), values)
    for p, base in zip(pictures, bases, strict=True):
        for c, b in zip(p.components, base, strict=True):
            c.values = values[b : b + c.wide * c.high]
    return pictures, values[:-1]


def _parsed_at(data: bytes, begin: int, stream: Stream) -> Picture:
    low, high = bisect_left(stream.marks, begin), bisect_left(stream.marks, begin + len(data))
    picture = _parsed(data, 0, len(data), [m - begin for m in stream.marks[low:high]])
    for s in picture.scans:
        s.data = (s.data[0] + begin, s.data[1] + begin)
    return picture


def decode(data: bytes, vectorised: bool = True) -> Picture:
    """The picture of one stream; the plain decoder gives the same."""
    if vectorised:
        return decode_many([data])[0][0]
    try:
        return _decode_plainly(data)
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError("damaged picture") from e


# The plain decoder


class Bits:
    """The bits of one entropy-coded segment."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        if self.at + n > self.end:
            raise ValueError("entropy-coded data end early")
        byte, off = self.at >> 3, self.at & 7
        self.at += n
        return int.from_bytes(self.data[byte : byte + 4], "big") << off >> (32 - n) & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _decode_plainly(data: bytes) -> Picture:
    stream = Stream(data + b"\0")
    picture = _parsed(data, 0, len(data), stream.marks)
    if sum(c.wide * c.high for c in picture.components) > 8 * len(data):
        raise ValueError("more blocks than bits")
    for c in picture.components:
        c.values = np.zeros((c.wide * c.high, 64), np.int32)
    for scan in picture.scans:
        places, n = _units(picture, scan)
        opens, closes = scan.data
        cut = [r for r in stream.restarts.tolist() if opens <= r < closes]
        restart = scan.restart or n
        if len(cut) != -(-n // restart) - 1:
            raise ValueError("restart markers do not fit the scan")
        for i, (a, b) in enumerate(zip([opens, *(r + 2 for r in cut)], [*cut, closes], strict=True)):
            bits = Bits(data[a:b].replace(b"\xff\x00", b"\xff"))
            units = range(i * restart, min(n, (i + 1) * restart))
            if scan.start == 0:
                before = dict.fromkeys((o[0] for o in scan.owners), 0)
                for u in units:
                    for (owner, dc, _), p in zip(scan.owners, places, strict=True):
                        for row in p[u]:
                            values = picture.components[owner].values
                            if scan.high:
                                values[row, 0] |= bits.take(1) << scan.low
                                continue
                            size = bits.symbol(scan.tables[0, dc].by_code)
                            if size > 15:
                                raise ValueError("no such code")
                            before[owner] += bits.signed(size)
                            values[row, 0] = before[owner] << scan.low
                continue
            owner, _, ac = scan.owners[0]
            read = _ac_refine_plainly if scan.high else _ac_first_plainly
            read(bits, [places[0][u, 0] for u in units], picture.components[owner].values, scan.tables[1, ac].by_code, scan.start, scan.end, scan.low)
    return picture


def _ac_first_plainly(bits: Bits, places: list[int], values: np.ndarray, table: dict, start: int, end: int, low: int) -> None:
    run = 0
    for p in places:
        if run:
            run -= 1
            continue
        k = start
        while k <= end:
            r, size = divmod(bits.symbol(table), 16)
            if size:
                k += r
                if k > end:
                    raise ValueError("run leaves the band")
                values[p, k] = bits.signed(size) * (1 << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def _ac_refine_plainly(bits: Bits, places: list[int], values: np.ndarray, table: dict, start: int, end: int, low: int) -> None:
    run = 0

    def correct(p: int, k: int) -> None:
        if bits.take(1):
            values[p, k] += (1 << low) if values[p, k] > 0 else -(1 << low)

    for p in places:
        k = start
        if not run:
            while k <= end:
                r, size = divmod(bits.symbol(table), 16)
                if size > 1:
                    raise ValueError("no such code")
                if not size and r < 15:
                    run = (1 << r) + bits.take(r)
                    break
                new = ((1 << low) if bits.take(1) else -(1 << low)) if size else 0
                while k <= end:
                    if values[p, k]:
                        correct(p, k)
                    elif r:
                        r -= 1
                    else:
                        break
                    k += 1
                if k > end:
                    raise ValueError("a run leaves the band")
                if size:
                    values[p, k] = new
                k += 1
        if run:
            for j in range(k, end + 1):
                if values[p, j]:
                    correct(p, j)
            run -= 1


# From coefficients to payload and pixels


def payload_of(picture: Picture) -> bytes | None:
    """The bytes that the coefficients hold, if the comment says that they hold any."""
    size = next((int(c[len(MARK) :]) for c in picture.comments if c.startswith(MARK) and c[len(MARK) :].isdigit()), None)
    if size is None:
        return None
    values = np.concatenate([c.values for c in picture.components])
    return _TO_BYTE[np.clip(values, -127, 129) + 127].tobytes()[:size]


def samples(values: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """The 64 samples, 0 to 255, of each block."""
    whole = (values * quantiser).astype(np.float64) @ _BASIS
    whole *= 2.0 ** (-2 * SCALE)
    whole += 128.5
    return np.clip(np.floor(whole, out=whole), 0, 255, out=whole).astype(np.uint8)


def planes(c: Component, quantiser: np.ndarray) -> np.ndarray:
    """Samples of a component, as a plane."""
    return samples(c.values, quantiser).reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8)


def _rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit channels of samples less their offsets, in whole numbers."""
    y = (y.astype(np.int32) << 16) + (1 << 15)
    clip = lambda x: np.clip(x >> 16, 0, 255)
    return clip(y + 91_881 * cr), clip(y - 22_554 * cb - 46_802 * cr), clip(y + 116_130 * cb)


def tensor(picture: Picture) -> np.ndarray:
    """Height x width x 3, RGB; grey pictures have three equal channels."""
    most_a, most_d = max(c.across for c in picture.components), max(c.down for c in picture.components)
    full = []
    for c in picture.components:
        if c.table not in picture.quantisers or most_a % c.across or most_d % c.down:
            raise ValueError("no such quantiser, or sampling that is no whole number")
        p = planes(c, picture.quantisers[c.table])
        p = p.repeat(most_d // c.down, axis=0).repeat(most_a // c.across, axis=1)
        full.append(p[: picture.height, : picture.width].astype(np.int32))
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, axis=2).astype(np.uint8)
    return np.stack(_rgb(full[0], full[1] - 128, full[2] - 128), axis=2).astype(np.uint8)


def _described(shape: tuple[int, int], total: list[int], square: list[int], bins: list[int]) -> str:
    n = shape[0] * shape[1]
    mean = ",".join(str(1000 * t // n) for t in total)
    spread = ",".join(str((n * s - t * t) // (n * n)) for s, t in zip(square, total, strict=True))
    return f"{shape[0]}x{shape[1]};mean={mean};var={spread};hist={','.join(map(str, bins))}"


def feature(pixels: np.ndarray) -> str:
    """Size, channel means and spreads, and a 16-bin luminance histogram; whole numbers, so exact."""
    flat = pixels.reshape(-1, 3).astype(np.int64)
    luma = (19_595 * flat[:, 0] + 38_470 * flat[:, 1] + 7_471 * flat[:, 2]) >> 16
    return _described(pixels.shape[:2], flat.sum(axis=0).tolist(), (flat * flat).sum(axis=0).tolist(), np.bincount(luma >> 4, minlength=16).tolist())


#: Which of a chroma block's samples each of a unit's 256 luma samples has, in the order of its four blocks.
_UPSAMPLED = np.array([(4 * (b // 2) + y // 2) * 8 + 4 * (b % 2) + x // 2 for b in range(4) for y in range(8) for x in range(8)])


def unit_pixels(pictures: list[Picture], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """RGB by channel, unit and sample of pictures as they are written here, and each picture's number of units.

    The same pixels as those of tensor(), unit by unit, for all pictures at once.
    """
    units = np.array([p.height * p.width // 256 for p in pictures])
    base = 6 * (np.cumsum(units) - units)
    light = samples(values, np.ones(64, np.int32))
    place = np.concatenate([b + _unit_rows(p.width // 16, p.height // 16) for b, p in zip(base.tolist(), pictures, strict=True)])
    y = light[place[:, :4]].reshape(-1, 256)
    cb, cr = (light[place[:, i]].astype(np.int32)[:, _UPSAMPLED] - 128 for i in (4, 5))
    return np.stack(_rgb(y, cb, cr)).astype(np.uint8), units


def unit_features(pictures: list[Picture], values: np.ndarray) -> list[str]:
    """feature(tensor(p)) of pictures as they are written here, for all at once."""
    rgb, units = unit_pixels(pictures, values)
    first = np.cumsum(units) - units
    wide = rgb.astype(np.int32)
    total = np.add.reduceat(wide.sum(axis=2, dtype=np.int64), first, axis=1)
    square = np.add.reduceat((wide * wide).sum(axis=2, dtype=np.int64), first, axis=1)
    luma = (19_595 * wide[0] + 38_470 * wide[1] + 7_471 * wide[2]) >> 20
    luma += (16 * np.repeat(np.arange(len(units)), units))[:, None].astype(np.int32)
    bins = np.bincount(luma.ravel(), minlength=16 * len(units)).reshape(-1, 16)
    return [_described((p.height, p.width), total[:, i].tolist(), square[:, i].tolist(), bins[i].tolist()) for i, p in enumerate(pictures)]


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT))


def _parts(raw: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are coded together."""
    filled = np.cumsum([0, *map(len, raw)])[:-1] // PART_BYTES
    ends = [*(np.flatnonzero(np.diff(filled)) + 1).tolist(), len(raw)] if raw else []
    return zip([0, *ends], ends, strict=False)


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores each text as a picture, reads the stored bytes back, and gives sizes, digests and a feature. No shuffle."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            raw = utf8(batch)
            for at, end in _parts(raw):
                some = raw[at:end]
                stored = encode_many([padded(r) for r in some])
                pictures, values = decode_many(stored)
                back = [payload_of(p) for p in pictures]
                yield {
                    "doc_id": batch.column("doc_id").slice(at, end - at),
                    "n_bytes": [len(r) for r in some],
                    "payload_bytes": [len(b) for b in back],
                    "payload_sha256": [hashlib.sha256(b).hexdigest() for b in back],
                    "tail_crc32": [zlib.crc32(b[-UNIT:]) for b in back],
                    "media_bytes": [len(s) for s in stored],
                    "media_sha256": [hashlib.sha256(s).hexdigest() for s in stored],
                    "feature": unit_features(pictures, values),
                }

        return each

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, the stored picture, and what is read from it: its tensor (height x width x 3 bytes) and the payload."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            raw = utf8(batch)
            for at, end in _parts(raw):
                media = encode_many([padded(r) for r in raw[at:end]])
                pictures = decode_many(media)[0]
                yield {
                    "doc_id": batch.column("doc_id").slice(at, end - at), "media": media, "height": [p.height for p in pictures], "width": [p.width for p in pictures],
                    "tensor": [tensor(p).tobytes() for p in pictures], "payload": [payload_of(p) for p in pictures],
                }

        return each

    return map_batches(docs.select("doc_id", "text"), make, MEDIA_SCHEMA)
