"""Progressive JPEG: round trips, both decoders, general streams, transform, edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tarnwright.llm import media
from tarnwright.llm.queries import op9_media

from .conftest import DATA


@pytest.mark.parametrize("blocks", [1, 2, 5, 6, 7, 13, 50, 300])
def test_round_trip_by_both_decoders(blocks):
    payload = random.Random(blocks).randbytes(64 * blocks)
    stored = media.encode(payload)
    fast, plain = media.decode(stored), media.decode(stored, vectorised=False)
    assert media.payload_of(fast) == media.payload_of(plain) == payload
    assert all((a.values == b.values).all() for a, b in zip(fast.components, plain.components, strict=True))


@pytest.mark.parametrize("spaces", [0.0, 0.5, 0.9, 0.99, 1.0])
def test_runs_and_ends_of_bands(spaces):
    """Sparse coefficients: runs beyond sixteen, end-of-band runs, empty restart intervals; both decoders, many pictures at once."""
    rng = random.Random(3)
    payloads = [bytes(32 if rng.random() < spaces else rng.choice((101, 116, 97, 7, 200, rng.randrange(256))) for _ in range(64 * n)) for n in (1, 40, 3, 97, 11)]
    stored = media.encode_many(payloads)
    assert stored == [media.encode(p) for p in payloads]
    pictures, values = media.decode_many(stored)
    for payload, data, picture in zip(payloads, stored, pictures, strict=True):
        plain = media.decode(data, vectorised=False)
        assert media.payload_of(picture) == media.payload_of(plain) == payload
        assert all((a.values == b.values).all() for a, b in zip(picture.components, plain.components, strict=True))
    assert media.unit_features(pictures, values) == [media.feature(media.tensor(p)) for p in pictures]


def test_texts_are_really_coded(texts):
    """Codes of many lengths: a text takes less than its bytes, and the scans hold runs and categories, not packed numbers."""
    raw = media.padded(" ".join(t for _, t in texts[:40]).encode())
    stored = media.encode(raw)
    assert len(stored) < 0.95 * len(raw)
    picture = media.decode(stored)
    values = np.concatenate([c.values for c in picture.components])
    sizes = np.bincount(media._SIZE[np.abs(values)].ravel(), minlength=9)
    assert (sizes[:5] > 0.05 * values.size).all()
    kinds = {(s.start > 0, s.high > 0) for s in picture.scans}
    assert kinds == {(False, False), (False, True), (True, False), (True, True)}


def test_other_layouts_of_scans_and_samples():
    """Interleaved and single scans, padded planes, several tables, without restarts: the fast decoder reads what the plain one does."""
    rng = random.Random(8)
    ac = {2: [0x01, 0x00], 3: [0x11, 0x02], 4: [0xF0, 0x21], 5: [0x10]}
    for sampling in ((0x11, 0x11, 0x11), (0x21, 0x11, 0x11), (0x22, 0x12, 0x11)):
        head = [b"\xff\xd8", media._segment(0xDB, bytes([0]) + bytes(range(1, 65))), media._segment(0xC2, bytes([8, 0, 27, 0, 45, 3, 1, sampling[0], 0, 2, sampling[1], 0, 3, sampling[2], 0]))]
        head += [media._table(0, 0, media.DC_LENGTHS), media._table(1, 2, ac)]
        plan = media._parsed(b"".join([*head, b"\xff\xd9"]), 0, len(b"".join(head)) + 2, media.Stream(b"".join([*head, b"\xff\xd9"]) + b"\0").marks)
        units = -(-45 // (8 * max(s >> 4 for s in sampling))) * -(-27 // (8 * max(s & 15 for s in sampling))) * sum((s >> 4) * (s & 15) for s in sampling)
        w = Writer()
        for _ in range(units):
            w.put(*media._DC_CODES[(size := rng.randrange(4))])
            w.put(rng.getrandbits(size), size)
        scans = [media._scan([1, 2, 3], 0, 0, 0, 0, 0, 1, w.data())]
        codes = media._codes(ac)
        for c in plan.components:
            w = Writer()
            for _ in range(c.own_wide * c.own_high):
                k = 1
                while k < 60 and rng.random() < 0.7:
                    symbol = rng.choice((0x01, 0x11, 0x02, 0x21, 0xF0) if k < 40 else (0x01, 0x11, 0x02))
                    w.put(*codes[symbol])
                    w.put(rng.getrandbits(symbol & 15), symbol & 15)
                    k += (symbol >> 4) + 1
                w.put(*codes[0x00])
            scans.append(media._scan([c.key], 0, 2, 1, 63, 0, 1, w.data()))
        data = b"".join([*head, *scans, b"\xff\xd9"])
        fast, plain = media.decode(data), media.decode(data, vectorised=False)
        assert all((a.values == b.values).all() for a, b in zip(fast.components, plain.components, strict=True))
        assert media.tensor(fast).shape == (27, 45, 3) and any(c.values[:, 1:].any() for c in fast.components)


@pytest.mark.parametrize("byte", [0, 1, 127, 128, 255])
def test_uniform_payloads(byte):
    assert media.payload_of(media.decode(media.encode(bytes([byte]) * 640))) == bytes([byte]) * 640


def test_long_runs_of_blocks():
    payload = random.Random(1).randbytes(64 * 60_000)
    assert media.payload_of(media.decode(media.encode(payload))) == payload


class Writer:
    """A plain bit writer for streams that the encoder never writes."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += format(value, f"0{n}b") if n else ""

    def data(self):
        bits = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def grey(scans, tables, height=8, width=16, restart=0):
    out = [b"\xff\xd8", media._segment(0xDB, bytes([0]) + bytes([2]) * 64), media._segment(0xC2, bytes([8, 0, height, 0, width, 1, 1, 0x11, 0])), *tables]
    if restart:
        out.append(media._segment(0xDD, bytes([0, restart])))
    return b"".join([*out, *scans, b"\xff\xd9"])


def test_sparse_coefficients_with_runs_refinement_and_restarts():
    """Two blocks: zeros, runs, a zero run of sixteen, newly non-zero coefficients in the refinement."""
    ac = {1: [0x00], 2: [0x21], 4: [0xF0, 0x01, 0x12]}
    codes = media._codes(ac)
    dc = Writer()
    for diff, size in ((5, 3), (-3 + 3, 2)):  # second value: bits 00 of size 2 are -3
        code, n = media._DC_CODES[size]
        dc.put(code, n)
        dc.put(diff, size)
    first = Writer()
    first.put(*codes[0x21])  # run 2, size 1
    first.put(1, 1)  # coefficient 3 is +1 << 1
    first.put(*codes[0xF0])  # sixteen zeros: 4 to 19
    first.put(*codes[0x12])  # run 1, size 2
    first.put(0, 2)  # coefficient 21 is -3 << 1
    first.put(*codes[0x00])
    first.put(*codes[0x00])  # second block: none
    refine = Writer()
    refine.put(*codes[0x21])  # two zeros, then a new +1; coefficient 3 is passed with its correction bit
    refine.put(1, 1)
    # run: 1, 2 zero; 3 is non-zero (correction), then the new one is at 4
    refine.put(1, 1)
    refine.put(*codes[0x00])
    refine.put(0, 1)  # correction of 21
    refine.put(*codes[0x00])
    tables = [media._table(0, 0, media.DC_LENGTHS), media._table(1, 0, ac)]
    scans = [media._scan([1], 0, 0, 0, 0, 0, 0, dc.data()), media._scan([1], 0, 0, 1, 63, 0, 1, first.data()), media._scan([1], 0, 0, 1, 63, 1, 0, refine.data())]
    got = media.decode(grey(scans, tables)).components[0].values
    assert (media.decode(grey(scans, tables), vectorised=False).components[0].values == got).all()
    one, two = got
    assert (one[0], two[0]) == (5, 2)
    assert {k: int(v) for k, v in enumerate(one) if v and k} == {3: 3, 4: 1, 21: -6}
    assert not two[1:].any()

    parts = []
    for diff, size in ((5, 3), (3, 2)):
        w = Writer()
        w.put(*media._DC_CODES[size])
        w.put(diff, size)
        parts.append(w.data())
    restarted = media._segment(0xDA, bytes([1, 1, 0, 0, 0, 0])) + parts[0] + b"\xff\xd0" + parts[1]
    assert media.decode(grey([restarted], tables, restart=1)).components[0].values[:, 0].tolist() == [5, 3]


def test_inverse_transform_equals_the_formula():
    rng = np.random.default_rng(2)
    c = media.Component(1, 1, 1, 0, wide=3, high=2, values=rng.integers(-40, 40, (6, 64)).astype(np.int32))
    q = rng.integers(1, 5, 64).astype(np.int32)
    got = media.planes(c, q)
    u = np.arange(8)
    basis = np.where(u[:, None] == 0, 8**-0.5, 0.5) * np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16)
    for b in range(6):
        natural = np.zeros(64)
        natural[media.ZIGZAG] = c.values[b] * q
        true = np.clip(basis.T @ natural.reshape(8, 8) @ basis + 128, 0, 255)
        y, x = divmod(b, 3)
        assert np.abs(got[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] - true).max() < 0.6


def test_grey_flat_picture_has_equal_channels():
    w = Writer()
    for size in (0, 0):
        w.put(*media._DC_CODES[size])
    pixels = media.tensor(media.decode(grey([media._scan([1], 0, 0, 0, 0, 0, 0, w.data())], [media._table(0, 0, media.DC_LENGTHS)])))
    assert pixels.shape == (8, 16, 3) and (pixels == 128).all()


def test_damaged_streams_are_errors():
    stored = media.encode(bytes(range(256)) * 5)
    for bad in (b"", b"\xff", stored[:40], stored[: len(stored) // 2], stored[:-2], b"\xff\xd8\xff\xc0" + stored[4:], stored.replace(b"\xff\xd0", b"\xff\xd9", 1), stored[:2] + stored[2:].replace(b"\xff\xc4", b"\xff\xe4")):
        for vectorised in (True, False):
            with pytest.raises(ValueError):
                media.decode(bad, vectorised)
    for bad in (b"", b"x" * 63):
        with pytest.raises(ValueError):
            media.encode(bad)


def test_changed_bytes_are_errors_or_pictures():
    """Whatever a damaged byte does, it is a ValueError or another picture, and both decoders agree which."""
    stored, rng = media.encode(b"some text that is long enough to have several units, " * 30 + b"\0" * (-1590 % 64)), random.Random(2)
    for _ in range(400):
        bad = bytearray(stored)
        for _ in range(rng.randrange(1, 4)):
            bad[rng.randrange(2, len(bad))] = rng.randrange(256)
        got = []
        for vectorised in (True, False):
            try:
                got.append([c.values.tolist() for c in media.decode(bytes(bad), vectorised).components])
            except ValueError:
                got.append(None)
        assert (got[0] is None) == (got[1] is None) and got[0] == got[1]


def test_whole_table(spark, texts):
    got = {r["doc_id"]: r for r in op9_media(spark, DATA).collect()}
    for d, t in texts:
        raw = t.encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_edges(odd_docs, no_docs):
    rows = media.media_digests(odd_docs).collect()
    assert len(rows) == 9
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (2, 3, 7)}) == 1
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] == 1}) == 1
    assert media.media_digests(no_docs).count() == 0
    stored = {r["doc_id"]: r for r in media.media_column(odd_docs).collect()}
    for r in rows:
        if r["doc_id"] is not None:
            m = stored[r["doc_id"]]
            assert r["feature"] == media.feature(np.frombuffer(m["tensor"], np.uint8).reshape(m["height"], m["width"], 3)) and r["media_bytes"] == len(m["media"])
    for r in media.media_column(odd_docs).collect():
        assert len(r["tensor"]) == 3 * r["height"] * r["width"] and len(r["payload"]) % 64 == 0
        assert hashlib.sha256(r["media"]).hexdigest() in {x["media_sha256"] for x in rows}
