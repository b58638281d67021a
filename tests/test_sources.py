"""Sources, sinks and the stream."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tarnwright.operators import quality, raster, screening
from tarnwright.plans import fixtures as fx
from tarnwright.sources import corpus, manifest, png, sinks, tables, versions
from tarnwright.streaming.plots import screened_stream

from .conftest import DATA

CHUNK = """id: rule.one
title: A rule
kind: rule
authority: statute
# a comment
tags: [lake, buffer]
intents: [flood]
asserts: {"lakeM": {"v": 30, "u": "m"}}
always: true
---
The body
has lines.
"""


def _png(path, pixels, width):
    rows = [pixels[i : i + width] for i in range(0, len(pixels), width)]
    raw = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in rows)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    path.write_bytes(bytes.fromhex("89504e470d0a1a0a") + part(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))


def test_pictures_become_pixels(spark, tmp_path):
    _png(tmp_path / "history.png", [(1, 2, 3, 255), (4, 5, 6, 17), (7, 8, 9, 0), (10, 11, 12, 128)], 2)
    px = png.read_pixels(spark, str(tmp_path / "history.png"))
    assert sorted(tuple(r) for r in px.select("y", "x", "r", "g", "b", "a").collect()) == [(0, 0, 1, 2, 3, 255), (0, 1, 4, 5, 6, 17), (1, 0, 7, 8, 9, 0), (1, 1, 10, 11, 12, 128)]
    assert {r["a"] for r in png.opaque(px).collect()} == {255}
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert manifest.usable(files).first()["ok"]


def test_chunks_are_parsed_and_errors_collected(spark, tmp_path):
    folder = tmp_path / "rule"
    folder.mkdir()
    (folder / "one.md").write_text(CHUNK)
    (folder / "two.md").write_text("id: rule.other\nkind: rule\ncolour: red\n---\nx\n")
    one, two = corpus.read_chunks(spark, str(tmp_path)).collect()
    assert (one["id"], one["tags"], one["always"], one["body"], one["errors"]) == ("rule.one", ["lake", "buffer"], True, "The body\nhas lines.", [])
    assert two["errors"] == ["unknown keys: colour", "id is not kind.name"]
    row = corpus.parameters(corpus.read_chunks(spark, str(tmp_path))).first()
    assert (row["key"], row["v"], row["unit"]) == ("lakeM", 30.0, "m")


def test_bad_files_hide_no_others(spark):
    files = [
        ("id: rule.a\ntitle: one\ntitle: two\nkind: rule\ntags: [\"a, b\", \"c\"]\nasserts: {\"k\": {\"u\": \"m\"}}\n---\nB\n", "x/rule/a.md"),
        ("id: rule.b\nkind: rule\ntags: {broken\nasserts: [1\nalways: yes\nwhen: [[\nwhat is this\n---\nB", "x/rule/b.md"),
        ("id: rule.c\nkind: rule\nwhen: [\"n\", \"gt\", 1]\n---\nB", "x/rule/c.md"),
        ("id: rule.d\nkind: rule\nwhen: [[\"n\", \"gt\"]]\n---\nB", "x/rule/d.md"),
        ("no front matter", "x/rule/e.md"),
    ]
    rows = corpus.parse_chunks(spark.createDataFrame(files, "value string, file string"))
    got = {r["file"][-4]: r for r in rows.collect()}
    assert (got["a"]["title"], got["a"]["tags"], got["a"]["errors"]) == ("two", ["a, b", "c"], ["asserts without a number: k"])
    assert got["b"]["errors"] == ["no key and value: what is this", "tags is no list", "asserts is no JSON", "when is no JSON", "always is neither true nor false"]
    assert got["e"]["errors"][0] == "no body"
    chunks, faults = corpus.compiled(rows)
    assert [(c.id, c.when) for c in chunks] == [("rule.c", [[("n", "gt", 1)]])] and [f for f, _ in faults] == ["x/rule/d.md"]


def test_the_knowledge_that_comes_along_is_sound(spark):
    from tarnwright.plans import checks
    from tarnwright.operators import quality

    chunks = fx.corpus_table(spark)
    assert quality.corpus_report(chunks, checks._sites(spark, DATA).columns, checks._inventory(spark)).count() == 0
    assert {c.kind for c in checks.AUTHORED} == set(quality.KINDS)


@pytest.mark.parametrize(("master", "fine"), [("local", True), ("local[4]", True), ("local[*]", True), ("local[2, 3]", True), ("spark://somewhere:7077", False), ("local-cluster[2,1,1024]", False), ("yarn", False)])
def test_a_cluster_needs_a_shared_folder(master, fine):
    from types import SimpleNamespace

    kept = {}
    session = SimpleNamespace(conf=SimpleNamespace(get=kept.get, set=kept.__setitem__), sparkContext=SimpleNamespace(master=master))
    if fine:
        assert tables.shared_folder(session) == kept["spark.checkpoint.dir"]
    else:
        with pytest.raises(ValueError):
            tables.shared_folder(session)
    kept["spark.checkpoint.dir"] = "file:///somewhere/"
    assert tables.shared_folder(session) == "file:///somewhere"


def test_entry_without_what_the_operators_need(tmp_path):
    """A missing third-party module takes the training-data operators with it, and nothing else."""
    import subprocess
    import sys

    from .conftest import ROOT

    code = "import sys; sys.path.insert(0, sys.argv[1]); sys.modules['regex'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code, str(ROOT)], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_manifest_lines(spark, tmp_path):
    (tmp_path / "m.txt").write_text("PNG water: https://example.org/a\n# note without link\nGEOJSON homes: https://example.org/b tail\nhttps://example.org/c\n")
    got = [tuple(r) for r in manifest.read_manifest(spark, str(tmp_path / "m.txt")).collect()]
    assert got == [("PNG", "water", "https://example.org/a"), ("GEOJSON", "homes", "https://example.org/b")]


def test_feature_lines(spark, tmp_path):
    rows = spark.createDataFrame([({"type": "Point"}, 2.5)], "geo map<string, string>, risk double")
    line = json.loads(sinks.features(rows, "geo", ["risk"]).first()["value"])
    assert line == {"type": "Feature", "geometry": {"type": "Point"}, "properties": {"risk": 2.5}}
    sinks.write_csv(spark.range(2), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_pixel_tables_are_written_as_they_are(spark, tmp_path):
    px = fx.pixels(spark).selectExpr("CASE WHEN x < 32 THEN 'a' ELSE 'b' END AS layer", "y", "x", "occurrence AS r")
    sinks.write_pixels(px, f"file://{tmp_path}/px")
    back = spark.read.parquet(f"file://{tmp_path}/px")
    assert sorted(map(tuple, back.select("layer", "y", "x", "r").collect())) == sorted(map(tuple, px.collect()))
    assert {p.name for p in (tmp_path / "px").glob("layer=*")} == {"layer=a", "layer=b"}


def test_a_bad_table_does_not_replace_a_good_one(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert tables.swap_in(spark.range(3), path)
    assert not tables.swap_in(spark.range(0), path)
    assert spark.read.parquet(path).count() == 3
    assert tables.swap_in(spark.range(5), path) and spark.read.parquet(path).count() == 5


def test_missing_columns(spark):
    assert tables.with_optional(spark.range(1), ["id"], {"buildings": "int"}).first()["buildings"] is None
    with pytest.raises(ValueError):
        tables.with_optional(spark.range(1), ["water"], {})


def test_stream_screens_as_a_batch_does(spark, tmp_path):
    sites = fx.sites(tables.read(spark, DATA, "orders"))
    sites.limit(200).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(sites.schema).parquet(f"file://{tmp_path}/in")
    run = screened_stream(stream, screening.rulesets(spark)).writeStream.format("memory").queryName("screened").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(60)
    batch = screening.screen(screening.with_classes(spark.read.parquet(f"file://{tmp_path}/in")), screening.rulesets(spark))
    key = lambda df: sorted((r["site_id"], r["code"]) for r in df.select("site_id", "code").collect())
    assert key(spark.table("screened")) == key(batch)
    assert batch.where(F.col("verdict") == "APPROVE").count() == 0


def test_places_in_order(spark):
    rows = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v").repartition(7)
    got = tables.numbered(rows, ["v"], "place")
    assert got.where("v <> place").count() == 0 and got.count() == 1000


def test_lines_are_counted(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f.md").write_text("1\n2\n3\n")
    assert [tuple(r) for r in corpus.line_counts(spark, str(tmp_path)).collect()] == [("a/f.md", 3)]


def test_index_tables(spark, tmp_path):
    from tarnwright.operators.retrieval import build_index

    chunks = spark.createDataFrame([("b.two", "b", "2", "Lake", ["flood"], "lake lake"), ("a.one", "a", "1", "Drain", [], "water")], "id string, kind string, file string, title string, tags array<string>, body string")
    index = build_index(chunks)
    assert [(r["doc"], r["id"], r["dl"]) for r in index["docs"].orderBy("doc").collect()] == [(0, "a.one", 2), (1, "b.two", 6)]
    assert {(r["term"], r["doc"]): r["tf"] for r in index["postings"].collect()} == {("drain", 0): 1, ("water", 0): 1, ("lake", 1): 3, ("flood", 1): 3}
    sinks.write_index(index, f"file://{tmp_path}/index")
    assert spark.read.parquet(f"file://{tmp_path}/index/stats").first()["n"] == 2


def test_files_with_other_line_ends(spark):
    text = "id: rule.a\ntitle: T\nkind: rule\nalways: true\n---\nOne.\nTwo.\n"
    for end in ("\n", "\r\n", "\r"):
        row = corpus.parse_chunks(spark.createDataFrame([(text.replace("\n", end), "k/rule/a.md")], "value string, file string")).first()
        assert (row["id"], row["title"], row["always"], row["body"], row["errors"]) == ("rule.a", "T", True, "One.\nTwo.", [])


def test_swaps_that_fail_leave_a_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    read = lambda: spark.read.parquet(path).count()
    assert tables.swap_in(spark.range(3), path)
    true = tables.renamed
    monkeypatch.setattr(tables, "renamed", lambda *a: False)
    with pytest.raises(OSError, match="moved aside"):
        tables.swap_in(spark.range(5), path)
    assert read() == 3
    calls = []
    monkeypatch.setattr(tables, "renamed", lambda fs, a, b: not (calls.append(1) or len(calls) == 2) and true(fs, a, b))
    with pytest.raises(OSError, match="stays as it was"):
        tables.swap_in(spark.range(5), path)
    assert read() == 3
    monkeypatch.setattr(tables, "renamed", true)
    assert tables.swap_in(spark.range(5), path) and read() == 5


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    assert versions.commit(spark.range(3), root) == 1
    old = versions.read(spark, root)
    assert versions.commit(spark.range(7), root, {"no gaps": lambda t: t.agg({"id": "max"}).first()[0] == t.count() - 1}) == 2
    assert (old.count(), versions.read(spark, root).count(), versions.read(spark, root, 1).count()) == (3, 7, 3)
    for bad, checks in ((spark.range(0), {}), (spark.range(2, 9), {"from 0": lambda t: t.agg({"id": "min"}).first()[0] == 0})):
        with pytest.raises(versions.Invalid):
            versions.commit(bad, root, checks)
    with pytest.raises(versions.Conflict):  # another writer also began from version 1
        versions.commit(spark.range(9), root, base=1)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root, 9)
    assert versions.numbers(spark, root) == [1, 2] and versions.read(spark, root).count() == 7
    assert len(list((tmp_path / "v" / "data").iterdir())) == 2  # what was refused is gone


def test_a_writer_that_stops_anywhere_changes_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/v"
    versions.commit(spark.range(3), root)

    class Stopped(BaseException):
        pass

    def stop(*_):
        raise Stopped

    for step in ("stage", "claim", "write_bytes"):
        with monkeypatch.context() as m:
            m.setattr(versions, step, stop)
            with pytest.raises(Stopped):
                versions.commit(spark.range(8), root)
        assert versions.numbers(spark, root) == [1] and versions.read(spark, root).count() == 3
    versions.stage(spark.range(8), root)  # the data are written, their manifest is not
    assert versions.read(spark, root).count() == 3
    assert versions.commit(spark.range(4), root) == 2
    assert versions.remove_unused(spark, root) == []  # too young
    assert len(versions.remove_unused(spark, root, older_than_ms=0)) == 3
    assert versions.read(spark, root).count() == 4 and versions.read(spark, root, 1).count() == 3


def test_secrets_in_folders(spark, tmp_path):
    files = {"a.py": "x\nkey = AKIA1\nAKIA2\n", "data/b.json": "AKIA", "data/corpus.json": "AKIA", "__pycache__/c.py": "AKIA", "p.png": "AKIA", "deep/er/d.txt": "no\n\nAKIA", "deep/clean.txt": "fine", "odd [1].txt": "AKIA", "a+b.txt": "AKIA"}
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = {r["path"]: r["lines"] for r in quality.secret_files(spark, f"file://{tmp_path}", ("AKIA",)).collect()}
    assert found == {"a.py": 2, "data/corpus.json": 1, "deep/er/d.txt": 1, "odd [1].txt": 1, "a+b.txt": 1}
    # with nothing skipped: __pycache__ is not in Spark's listing
    assert len(quality.secret_files(spark, f"file://{tmp_path}", ("AKIA",), (), ()).collect()) == 7


def test_clear_scenes(spark):
    rows = spark.createDataFrame([(1, 29.9), (2, 30.0), (3, None), (4, 0.0)], "id int, cloudy double")
    assert sorted(r["id"] for r in raster.clear_scenes(rows, "cloudy").collect()) == [1, 4]
