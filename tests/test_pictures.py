"""Pictures and named files: what is written is read again, and a job that fails leaves nothing."""

import struct
import zlib
from pathlib import Path

import numpy as np
import pytest

from tarnwright.sources import corpus, named, png

PIXEL = "layer string, y int, x int, r smallint, g smallint, b smallint, a smallint"


def decoded(data: bytes) -> np.ndarray:
    """A PNG of eight bits a sample with transparency, read by the letter: every check sum is looked at."""
    assert data[:8] == bytes.fromhex("89504e470d0a1a0a")
    at, stream, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            stream += body
        at += 12 + n
    assert kind == b"IEND"
    lines = np.frombuffer(zlib.decompress(stream), np.uint8).reshape(size[1], -1)
    assert set(lines[:, 0]) == {1}
    return np.cumsum(lines[:, 1:].reshape(size[1], size[0], 4).astype(np.int64), axis=1).astype(np.uint8)


def test_written_in_strips(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = {"one": rng.integers(0, 256, (37, 21, 4)), "dot": np.full((1, 1, 4), 9)}
    rows = [(n, y, x, *map(int, v[y, x])) for n, v in want.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    px = spark.createDataFrame(rows, PIXEL)
    assert png.strips(px, most=64).groupBy("path").count().where("path = 'one.png'").first()["count"] == 13 + 2
    named.write(png.strips(px, most=64), f"file://{tmp_path}/out")
    for n, v in want.items():
        assert (decoded((tmp_path / f"out/{n}.png").read_bytes()) == v).all()
    read = png.read_pixels(spark, f"file://{tmp_path}/out/*.png")
    assert sorted(map(tuple, read.collect())) == sorted(rows)
    assert not list(tmp_path.glob("*staging*"))


def test_absent_pixels_and_no_pixels(spark, tmp_path):
    px = spark.createDataFrame([("far", 0, 0, 1, 2, 3, 4), ("far", 300, 2, 5, 6, 7, 8)], PIXEL)
    named.write(png.strips(px, most=6), f"file://{tmp_path}/out")
    got = decoded((tmp_path / "out/far.png").read_bytes())
    assert got.shape == (301, 3, 4) and got.sum() == 36 and tuple(got[300, 2]) == (5, 6, 7, 8)
    png.write_pictures(px.where("false"), f"file://{tmp_path}/none")
    assert not list(tmp_path.glob("none/*"))


def test_transparency_goes_from_named_layers_only(spark, tmp_path):
    px = spark.createDataFrame([("hydro", 0, 0, 1, 2, 3, 4), ("present", 0, 0, 1, 2, 3, 4)], PIXEL)
    png.write_pictures(png.opaque(px), f"file://{tmp_path}/out")
    assert [decoded((tmp_path / f"out/{n}.png").read_bytes())[0, 0, 3] for n in ("hydro", "present")] == [255, 4]


@pytest.mark.parametrize("bad", [[("l", 0, 0, 1, 1, 1, 1)], [("l", 1, 1, 256, 0, 0, 0)], [("l", -1, 1, 0, 0, 0, 0)]])
def test_faulty_pixels_leave_no_file(spark, tmp_path, bad):
    px = spark.createDataFrame([("l", 0, 0, 1, 1, 1, 1), ("ok", 0, 0, 1, 1, 1, 1), *bad], PIXEL)
    with pytest.raises(Exception, match="a pixel twice|strip"):
        png.write_pictures(px, f"file://{tmp_path}/out")
    assert not list(tmp_path.rglob("*.png"))


def test_named_files(spark, tmp_path):
    parts = spark.createDataFrame([("a/b.txt", 2, b"!"), ("a/b.txt", 1, b"there"), ("a/b.txt", -3, b"hello "), ("c d.txt", 0, None)], named.SCHEMA)
    named.write(parts, f"file://{tmp_path}/out/")
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"a/b.txt": b"hello there!", "c d.txt": b""}
    named.write(parts.where("part = 1"), f"file://{tmp_path}/out")
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"there"
    for path in ("/etc/x", "../x", "a/../../x", "", None):
        with pytest.raises(Exception, match="no path below a folder"):
            named.write(spark.createDataFrame([("ok", 0, b"x"), (path, 0, b"x")], named.SCHEMA), f"file://{tmp_path}/bad")
    assert not (tmp_path / "bad").exists() or not list(Path(tmp_path / "bad").iterdir())
    assert not list(tmp_path.glob("*staging*"))


def test_triggers_without_the_driver(spark):
    head = "id: rule.{0}\ntitle: T\nkind: rule\nauthority: editorial\n{1}---\nBody.\n"
    whens = {"a": 'when: [["handM", "gte", 2]]\n', "b": 'when: [["handM", "like", 2]]\n', "c": 'when: [["x", "isnull"], ["y", "eq", 1]]\n', "d": "", "e": 'when: "handM"\n', "f": "when: [broken\n"}
    files = spark.createDataFrame([(head.format(k, w), f"k/rule/{k}.md") for k, w in whens.items()], "value string, file string")
    chunks = corpus.parse_chunks(files)
    got = {r.id: (r.fault, r.fields) for r in corpus.trigger_rows(chunks).collect()}
    held, faults = corpus.compiled(chunks)
    assert {c.id: sorted({x[0] for g in c.when for x in g}) for c in held} == {k: v for k, (f, v) in got.items() if f is None}
    assert {e for _, e in faults} == {f for f, _ in got.values() if f is not None} and len(got) == 5
