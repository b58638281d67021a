"""Operators against brute force, invariants, and inputs that must be caught."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tarnwright.functions import classes, codecs, geometry, text
from tarnwright.operators import answers, flow, quality, raster, retrieval, screening, spatial, stats, triggers
from tarnwright.plans import fixtures as fx


def test_triggers_follow_the_operators(spark):
    rows = spark.createDataFrame([(1, "a", ["x"], None), (5, "b", [], 2.0)], "n int, s string, l array<string>, d double")
    of = lambda *c: [r[0] for r in rows.select(triggers.condition(c, rows.schema)).collect()]
    assert of("n", "lt", 3) == [True, False]
    assert of("n", "lt", "3") == [False, False]
    assert of("n", "between", (1, 4)) == [True, False]
    assert of("s", "in", ["a", "c"]) == [True, False]
    assert of("l", "in", "x") == [True, False]
    assert of("s", "in", "a") == [False, False]
    assert of("d", "ne", 3.0) == [False, True]
    assert of("d", "isnull", None) == [True, False]
    assert of("absent", "eq", 1) == [False, False]
    assert of("absent", "isnull", None) == [True, True]


def test_trigger_forms():
    assert triggers.normalise(["a", "eq", 1]) == [[("a", "eq", 1)]]
    assert triggers.normalise([["a", "isnull"], [["b", "gt", 1], ["c", "lt", 2]]]) == [[("a", "isnull", None)], [("b", "gt", 1), ("c", "lt", 2)]]
    with pytest.raises(ValueError):
        triggers.normalise(["a", "like", 1])
    assert triggers.unknown_fields([triggers.Chunk("rule.x", [[("nothing", "eq", 1)]])], ["something"]) == [("rule.x", "nothing")]


VALUES = {"n": 3, "d": 2.0, "s": "b", "b": True, "l": ["x", "y"], "i": [1, 2], "z": None}
OPERANDS = [3, 2.0, "b", "3", True, False, [3, "b"], ["x", "y"], [1, 2], ["x"], [1, 4], ["a", "c"], [True], None, "x", 1]


def plainly(x, op, v):
    """What an operator is, value by value; an order of unlike types is false."""
    if op == "isnull":
        return x is None
    if x is None:
        return False
    if op == "notnull":
        return True
    if op == "in":
        return v in x if isinstance(x, list) else isinstance(v, list) and x in v
    if op in ("eq", "ne"):
        return (x == v) == (op == "eq")
    try:
        if op == "between":
            return isinstance(v, list) and len(v) == 2 and v[0] <= x <= v[1]
        return {"lt": x < v, "lte": x <= v, "gt": x > v, "gte": x >= v}[op]
    except TypeError:
        return False


def test_every_operator_on_every_type(spark):
    """No pair of types throws, and each gives what plain comparisons give; lists have no order here."""
    rows = spark.createDataFrame([VALUES], "n int, d double, s string, b boolean, l array<string>, i array<int>, z string")
    tried = [(f, op, v) for f in VALUES for op in sorted(triggers.OPERATORS) for v in OPERANDS if not (isinstance(VALUES[f], list) and op in ("lt", "lte", "gt", "gte", "between")) and not (op in triggers.ORDERED and isinstance(v, list))]
    got = rows.select(F.array(*(triggers.condition(c, rows.schema) for c in tried))).first()[0]
    wrong = [(c, g) for c, g in zip(tried, got, strict=True) if g != plainly(VALUES[c[0]], c[1], c[2])]
    assert not wrong and len(tried) > 700


def test_first_problems(spark):
    chunks = [triggers.Chunk("rule.a", always=True), triggers.Chunk("limit.a", [[("n", "gt", 2)]]), triggers.Chunk("method.a", always=True), triggers.Chunk("refusal.not-a-flood-predictor", [[("n", "eq", 9)]])]
    rows = spark.range(10).selectExpr("id AS n", "CASE WHEN id > 7 THEN 'flood' ELSE 'evidence' END AS intent")
    assert [tuple(r) for r in triggers.problems(rows, chunks, "n").collect()] == [(0, "too few"), (1, "too few"), (2, "too few"), (8, "no refusal")]
    assert triggers.problems(rows, chunks, "n", most=2).count() == 2
    fields = spark.createDataFrame([("n",)], "field string")
    assert triggers.field_faults(spark, [*chunks, triggers.Chunk("rule.b", [[("m", "isnull", None)]])], fields).collect() == [("rule.b", "m")]


def test_sweep_has_no_hole(spark):
    got = triggers.coverage(screening.with_classes(fx.sweep(spark)), fx.CHUNKS).first()
    assert got["records"] == math.prod(map(len, fx.GRID.values()))
    assert (got["too_few"], got["no_rule"], got["no_limit"], got["no_refusal"]) == (0, 0, 0, 0)
    assert triggers.coverage(screening.with_classes(fx.sweep(spark)), fx.CHUNKS[1:5]).first()["no_rule"] > 0


def test_small_patches_go_and_the_filter_is_idempotent(spark):
    cells = [(0, 0), (1, 1), (2, 2), (5, 5), (10, 10), (11, 11), (12, 12), (13, 13)]
    mask = spark.createDataFrame(cells, "y int, x int")
    once = raster.min_patch(mask)
    assert sorted(map(tuple, once.collect())) == [(10, 10), (11, 11), (12, 12), (13, 13)]
    assert sorted(map(tuple, raster.min_patch(once).collect())) == sorted(map(tuple, once.collect()))


def test_distance_field_equals_brute_force(spark):
    rng = random.Random(4)
    on = {(rng.randrange(40), rng.randrange(50)) for _ in range(4)}
    px = spark.range(40 * 50).selectExpr("CAST(id DIV 50 AS INT) AS y", "CAST(id % 50 AS INT) AS x")
    px = px.join(spark.createDataFrame([(y, x, True) for y, x in on], "y int, x int, m boolean"), ["y", "x"], "left").fillna(False)
    for y, x, metres in raster.distance_field(px, "m").collect():
        true = min(math.hypot(y - a, x - b) for a, b in on) * 10
        assert metres == math.floor(min(true, 255) + 0.5)


def test_distances_over_gaps_and_several_areas(spark):
    """Rows with missing pixels, negative places, areas side by side."""
    rng = random.Random(6)
    px = [(k, y, x, rng.random() < 0.02) for k in ("a", "b") for y in range(-20, 20) for x in range(-30, 30) if rng.random() < 0.6]
    got = raster.distance_field(spark.createDataFrame(px, "area string, y int, x int, m boolean"), "m", keys=("area",)).collect()
    assert len(got) == len(px)
    on = {k: [(y, x) for a, y, x, m in px if a == k and m] for k in ("a", "b")}
    for k, y, x, metres in got:
        true = min((math.hypot(y - a, x - b) for a, b in on[k]), default=99) * 10
        assert metres == math.floor(min(true, 255) + 0.5)


def test_distances_where_rows_and_columns_are_missing(spark):
    px = spark.createDataFrame([(0, 0, True), (2, 2, False), (300, 300, False), (300, 312, None), (301, 301, True), (None, 4, True)], "y int, x int, m boolean")
    got = {(r["y"], r["x"]): r["metres"] for r in raster.distance_field(px, "m").collect()}
    assert got == {(0, 0): 0, (2, 2): 28, (300, 300): 14, (300, 312): 110, (301, 301): 0}


def test_distances_across_squares(spark, monkeypatch):
    """Work is by squares: set pixels count in all squares within reach, on either side of any seam."""
    rng = random.Random(16)
    on = {(rng.randrange(-70, 90), rng.randrange(-70, 90)) for _ in range(25)}
    px = [(y, x, (y, x) in on) for y in range(-70, 90) for x in range(-70, 90, 3)] + [(y, x, True) for y, x in on if (x + 70) % 3]
    frame = spark.createDataFrame(px, "y int, x int, m boolean")
    want = {(y, x): math.floor(min(min(math.hypot(y - a, x - b) for a, b in on) * 10, 255) + 0.5) for y, x, _ in px}
    for tile in (32, 256):
        monkeypatch.setattr(raster, "TILE", tile)
        assert {(r["y"], r["x"]): r["metres"] for r in raster.distance_field(frame, "m").collect()} == want


def test_distance_fields_need_no_window_over_a_column(spark):
    px = spark.range(1 << 20).selectExpr("CAST(id DIV 8 AS INT) AS y", "CAST(id % 8 AS INT) AS x", "id % 4096 = 0 AS m")
    plan = raster.distance_field(px, "m")._jdf.queryExecution().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert raster.distance_field(px, "m").where("metres < 255").count() > 0  # 131,072 lines


def test_clipping_after_and_unmasking_before(spark):
    px = spark.range(60).selectExpr("0 AS y", "CAST(id AS INT) AS x", "id = 0 AS m")
    field = raster.distance_field(px, "m")
    assert raster.clip(field, 0, 5, 1, 7).orderBy("x").select("metres").collect() == [(50,), (60,)]
    holed = spark.createDataFrame([(0, 0, None), (0, 1, 7)], "y int, x int, metres int")
    assert raster.unmask(holed, {"metres": 255}).select("metres").collect() == [(255,), (7,)]
    assert raster.self_mask(spark.createDataFrame([(0,), (3,)], "v int"), ["v"]).collect() == [(None,), (3,)]


def test_nothing_is_rescaled_on_export(spark):
    px = spark.createDataFrame([(0, 0.5, 300, None), (255, 1.0, -1, 4)], "a int, b double, c int, d int")
    got = {r["band"]: r for r in raster.export_contract(px, ["a", "b", "c", "d"]).collect()}
    assert [got[b]["ok"] for b in "abcd"] == [True, False, False, False]
    assert (got["b"]["fractions"], got["d"]["holes"], got["c"]["most"]) == (1, 1, 300.0)


def test_layers_of_another_size_are_told(spark):
    rows = [("a", 1, 2), ("b", 1, 2), ("c", 2, 2)]
    layers = spark.createDataFrame(rows, "layer string, y int, x int")
    assert {r["layer"]: r["same"] for r in raster.dimensions(layers).collect()} == {"a": True, "b": True, "c": False}
    assert not quality.size_report(layers).first()["ok"] and quality.size_report(layers.where("layer <> 'c'")).first()["ok"]
    joined = raster.overlay(spark.createDataFrame([(0, 0, 1)], "y int, x int, a int"), spark.createDataFrame([(0, 0, 2), (0, 1, 3)], "y int, x int, b int"))
    assert sorted(map(tuple, joined.collect()), key=str) == [(0, 0, 1, 2), (0, 1, None, 3)]


def test_names_however_far(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 900.0), (3, -5000.0, 40.0)], "site_id long, x double, y double")
    places = spark.createDataFrame([("lake", "water", 0.1, 0.0), ("hamlet", "settlement", 0.5, 0.0), ("road", "road", 880.0, 900.0)], "name string, kind string, px double, py double")
    got = {r["site_id"]: (r["name"], round(r["distance"], 1)) for r in spatial.nearest_name_anywhere(sites, places).collect()}
    assert got == {1: ("hamlet", 0.5), 2: ("road", 20.0), 3: ("hamlet", 5000.7)}
    assert [r["name"] for r in spatial.nearest_name_anywhere(sites, places.where("kind = 'water'")).collect()] == [None] * 3


def test_many_terms_meet_the_postings(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, ["d"])], "id long, toks array<string>")
    asked = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "c"), ("r", "none")], "query string, term string")
    few = {(r["query"], r["id"]): r["score"] for r in retrieval.bm25(docs, asked, "id", "toks").collect()}
    monkeypatch.setattr(retrieval, "MOST_TERMS", 1)
    many = {(r["query"], r["id"]): r["score"] for r in retrieval.bm25(docs, asked, "id", "toks").collect()}
    assert few.keys() == many.keys() == {("q", 1), ("q", 2), ("r", 2)} and all(few[k] == pytest.approx(many[k]) for k in few)


def test_decimals_of_six_figures(spark):
    for v in (1234.5678, 123456.7, 0.1, 20.0, 0.00012345, 0.0000125, 1e7, 1234567.8, 0.0, -2.5, 99999.96, 1e-120, 3e5):
        shown = f"{v:g}"
        assert spark.range(1).select(quality.decimals(F.lit(v))).first()[0] == (len(shown.split(".")[1]) if "." in shown else 0), (v, shown)


def test_numbers_are_declared_by_the_chunk_itself(spark):
    spec = "map<string, struct<v: double, pm: double, rel: double>>"
    rows = [("a", "T 5", "of 30 and 7.50 in 1999", {"x": (30.0, None, None)}, "book 7.5", "", ""), ("b", "T", "30 of 12.3.4", {}, "", "http://x/12", "f.md#L4")]
    chunks = spark.createDataFrame(rows, f"id string, title string, body string, asserts {spec}, source string, url string, repo_ref string")
    assert sorted(map(tuple, quality.undeclared_by_chunk(chunks).collect())) == [("a", "5"), ("b", "12.3.4"), ("b", "30")]


def test_scraped_regions(spark):
    files = spark.createDataFrame([("f", "x = ['no']\n# begin\n'one', 'two'\n# end\n'three'"), ("g", "nothing")], "path string, text string")
    assert [tuple(r) for r in quality.scraped(files, "text", "# begin", "# end", r"'(\w+)'").collect()] == [("f", "one"), ("f", "two")]


def test_spread_and_moments(spark):
    seeds = spark.createDataFrame([(0, 0.2, None), (1, 0.6, 0.5), (2, 0.4, 0.7)], "seed int, a double, b double")
    got = {r["figure"]: tuple(r)[1:] for r in stats.spread(seeds, ["a", "b"]).collect()}
    assert got == {"a": (0.2, 0.6, 0.4, 3), "b": (0.5, 0.7, 0.6, 2)}
    row = stats.moments(spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "v double"), "v").first()
    assert (row["median"], row["mean"], row["n"]) == (2.0, 3.0, 3) and row["sd"] == pytest.approx(math.sqrt(14 / 3))


def test_route_agreement_counts_every_pass(spark):
    traced = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (0, 2, 1), (1, 2, 1)], "seed int, ix long, iy long")
    cells = spark.createDataFrame([(1, 1, 0, True), (2, 1, 0, False)], "ix long, iy long, block int, on_flow boolean")
    blocks = flow.agreement(traced, cells)
    assert {(r["seed"], r["block"]): (r["cells"], r["hits"]) for r in blocks.collect()} == {(0, 0): (3, 2), (1, 0): (1, 0)}
    assert [tuple(r) for r in flow.agreement_summary(blocks, least_cells=2).collect()] == [(0, 1, 3, 2 / 3, 2 / 3, 2 / 3)]


def test_empty_mask_is_at_the_ceiling(spark):
    px = spark.range(6).selectExpr("CAST(id AS INT) AS y", "0 AS x", "false AS m")
    assert {r["metres"] for r in raster.distance_field(px, "m").collect()} == {255}


def test_masked_input_masks_the_result(spark):
    px = spark.createDataFrame([(3, None), (None, 6), (3, 6), (3, 0)], "transition int, landcover int")
    assert [r["lost"] for r in raster.water_eras(px).collect()] == [None, None, True, False]


def test_flipped_mask_is_found_out(spark):
    layers = fx.pixels(spark).withColumn("other", F.expr("((x * x * 7 + (36 - y) * (36 - y) * 13 + x * (36 - y) * 5) % 23) < 6"))
    best = max(raster.flip_diagnosis(layers, "m", "other", 37, 64).collect(), key=lambda r: r["match"])
    assert (best["pose"], best["match"]) == ("upside_down", 1.0)


def test_resampling_never_averages(spark):
    fine = spark.range(16).selectExpr("CAST(id DIV 4 AS INT) AS y", "CAST(id % 4 AS INT) AS x")
    coarse = spark.createDataFrame([(0, 0, 1), (0, 1, 9), (1, 0, 3), (1, 1, 7)], "y int, x int, v int")
    assert {r["v"] for r in raster.resample(fine, coarse, 2, ["v"]).collect()} == {1, 9, 3, 7}


def _route(spark, rows, start=(0, 0), **more):
    cells = spark.createDataFrame(rows, "ix long, iy long, d8 int, inside boolean, upa double")
    starts = spark.createDataFrame([(1, *start)], "trace_id long, ix long, iy long")
    got = flow.trace(cells, starts, **more).orderBy("step").collect()
    return len(got), got[-1]["how"] if got else None


def test_routes_end_for_the_right_reason(spark):
    line = lambda last, n=4: [(i, 0, 1 if i < n - 1 else last, True, float(i)) for i in range(n)]
    assert _route(spark, line(9)) == (4, "mouth")
    assert _route(spark, line(10)) == (4, "depression")
    assert _route(spark, line(0)) == (4, "nodata")
    assert _route(spark, line(1)) == (4, "edge")
    assert _route(spark, line(5)) == (4, "loop")
    assert _route(spark, line(1, 300)) == (200, "capped")
    assert _route(spark, line(9), stop_at_trunk=1.5) == (3, "trunk")
    assert _route(spark, line(9), start=(9, 9)) == (0, None)


def test_route_length_counts_diagonals(spark):
    traced = spark.createDataFrame([(1, 0, 1, None), (1, 1, 2, None), (1, 2, 9, "mouth")], "trace_id long, step int, d8 int, how string")
    assert flow.route_length(traced).first()["metres"] == pytest.approx(90 + 90 * math.sqrt(2))


def test_falls_beyond_one_code_are_counted(spark):
    traced = spark.createDataFrame([(1, i, v) for i, v in enumerate([5, 4, 7, 5, 9])], "trace_id long, step int, v int")
    got = flow.monotonicity(traced, "v").first()
    assert (got["steps"], got["falls"], got["grew"]) == (4, 1, True)


def test_area_codes_round_trip(spark):
    codes = spark.range(256).select(F.col("id").cast("int").alias("c"))
    assert codes.where(codecs.pack_area(codecs.unpack_area(F.col("c"))) != F.col("c")).count() == 0
    assert spark.range(1).select(codecs.pack_area(F.lit(5000.0))).first()[0] == 255


def test_lattice_rounds_half_to_even(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double").select(geometry.lattice(F.col("v") * geometry.CELL_DEG)).collect()
    assert [r[0] for r in got] == [0, 2, 2]


def test_runoff_of_a_thirty_metre_plot(spark):
    row = screening.runoff(spark.createDataFrame([(30,)], "plotM int")).first()
    assert (row["shown_m3"], row["shown_error_m3"], row["tankers"]) == (30.0, 14.0, pytest.approx(4.95))
    assert classes.error_budget() == pytest.approx(17.6, abs=0.01)


def test_blank_storage_stays_blank(spark):
    rows = spark.createDataFrame([(30.0, None), (30.0, 10.0), (30.0, 50.0)], "need double, have double")
    assert [r[0] for r in rows.select(classes.shortfall(F.col("need"), F.col("have"))).collect()] == [None, 20.0, 0.0]


SITE = {"site_id": 1, "ruleId": "state", "inAoi": True, "distPresent": 200, "distHistoric": 200, "distDrain": 200, "handM": 9, "occurrence": 0, "encroached": 0.0, "plotM": 30}


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"inAoi": False, "distPresent": 0}, "refer.outside-study-area"),
        ({"distPresent": 0}, "reject.on-present-water"),
        ({"distHistoric": 0, "occurrence": 50}, "reject.on-lasting-bed"),
        ({"distHistoric": 0, "encroached": 0.2}, "reject.built-on-bed"),
        ({"distPresent": 10}, "reject.inside-buffer"),
        ({"distPresent": 11}, "refer.within-uncertainty"),
        ({"distPresent": 50}, "refer.within-uncertainty"),
        ({"distPresent": 51}, "none"),
        ({"distHistoric": 0, "handM": 0}, "refer.low-bed"),
        ({"distHistoric": 0}, "refer.former-bed"),
        ({"distHistoric": 20}, "refer.shoreline-disagreement"),
        ({"distDrain": 25}, "refer.drain-buffer"),
        ({"handM": 1}, "conditions.low-ground"),
        ({"ruleId": "ngt", "distPresent": 55}, "reject.inside-buffer"),
        ({}, "none"),
    ],
)
def test_cascade(spark, change, code):
    site = spark.createDataFrame([SITE | change], "site_id long, ruleId string, inAoi boolean, distPresent int, distHistoric int, distDrain int, handM int, occurrence int, encroached double, plotM int")
    assert screening.screen(screening.with_classes(site), screening.rulesets(spark)).first()["code"] == code


def test_certificate_flags_the_ceiling(spark):
    site = spark.createDataFrame([SITE | {"distDrain": 255}], "site_id long, ruleId string, inAoi boolean, distPresent int, distHistoric int, distDrain int, handM int, occurrence int, encroached double, plotM int")
    got = json.loads(screening.certificate(screening.screen(screening.with_classes(site), screening.rulesets(spark))).first()["certificate"])
    assert "distDrain" not in got["measured"] and got["measured"]["distPresent"] == 200


def test_panel_needs_a_site_specific_option(spark):
    rows = spark.createDataFrame([(1, 90, 5, "ELEVATED", "OFF", 30.0), (2, 0, 60, "LOW_GROUND", "OFF", 30.0)], "site_id long, distHistoric int, occurrence int, handClass string, flowClass string, retentionRequiredM3 double")
    got = [(r["site_id"], r["option"].partition(".")[2]) for r in screening.options(rows).orderBy("site_id", "place").collect()]
    assert got == [(2, "wetland-restoration-tdr"), (2, "sponge-park-retention"), (2, "recharge-structure")]


def test_otsu_splits_two_heaps(spark):
    values = spark.createDataFrame([(-0.5,)] * 60 + [(0.5,)] * 40 + [(1.0,), (7.0,)], "v double")
    hist = stats.histogram(values, "v")
    assert {r["bin"]: r["n"] for r in hist.collect()} == {64: 60, 192: 40, 255: 1}
    assert -0.5 <= stats.otsu(hist).first()["threshold"] < 0.5


def test_scores_are_null_without_anything_to_score(spark):
    row = stats.confusion(spark.createDataFrame([(False, False)], "p boolean, t boolean"), "p", "t").first()
    assert (row["iou"], row["f1"], row["tn"]) == (None, None, 1)


def test_sample_is_seeded_and_without_replacement(spark):
    one, two, other = ([r[0] for r in stats.sample(spark.range(1000), "id", 50, s).collect()] for s in (1, 1, 2))
    assert one == two != other and len(set(one)) == 50


def test_polygons_with_a_notch(spark):
    ring = [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (3.0, 2.0), (0.0, 6.0)]
    zone = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ring])], "zone_id long, ring array<struct<x: double, y: double>>")
    px = spark.range(100).selectExpr("CAST(id DIV 10 AS INT) AS y", "CAST(id % 10 AS INT) AS x", "1.0D AS v")

    def inside(px, py):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > py) != (by > py) and px < ax + (py - ay) * (bx - ax) / (by - ay):
                hit = not hit
        return hit

    true = sum(inside(x + 0.5, y + 0.5) for x in range(10) for y in range(10))
    assert spatial.zonal_mean(px, zone, ["v"], tile=4).first()["pixels"] == true > 0


def test_water_never_names_a_site(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 90.0, 90.0)], "site_id long, x double, y double")
    places = spark.createDataFrame([("lake", "water", 0.1, 0.0), ("hamlet", "settlement", 0.5, 0.0)], "name string, kind string, px double, py double")
    assert {r["site_id"]: r["name"] for r in spatial.nearest_name(sites, places).collect()} == {1: "hamlet", 2: None}


def test_tokens(spark):
    one = lambda s: spark.createDataFrame([(s,)], "t string").select(text.tokenize("t")).first()[0]
    assert one("The LAKE-bed, 7 x 12m is a") == ["lake", "bed", "7", "12m"]
    assert one("") == [] and one(None) is None


def test_synonym_lines(spark):
    lines = spark.createDataFrame([("# none",), ("lake -> tank pond lake",), ("two words -> x1",), ("",)], "value string")
    assert sorted(map(tuple, text.parse_synonyms(lines).collect())) == [("lake", "pond"), ("lake", "tank")]


def test_conflicting_chunks_leave_the_better(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, id string, rank int")
    pairs = spark.createDataFrame([("b", "a")], "one string, two string")
    assert sorted(r["id"] for r in retrieval.without_conflicts(ranked, pairs, "id").collect()) == ["a", "c"]


def test_packs_that_lack_something(spark):
    rows = [("q1", "flood", "rule.a", "rule", False), ("q1", "flood", "limit.a", "limit", False), ("q1", "flood", "refusal.not-a-flood-predictor", "refusal", False), ("q2", "flood", "precedent.a", "precedent", True)]
    got = {r["query"]: r for r in retrieval.pack_rules(spark.createDataFrame(rows, "query string, intent string, id string, kind string, never_alone boolean"), "id").collect()}
    assert all(got["q1"][c] for c in ("enough", "rule", "limit", "not_alone", "refusal"))
    assert not any(got["q2"][c] for c in ("enough", "rule", "limit", "not_alone", "refusal"))


ANSWER = {"text": "It is {{fact.distPresent}} away [rule.a 30].", "verdict": "REFER", "screened": "REFER", "cited": ["rule.a"], "pack": ["rule.a"], "intent": "evidence", "refused": []}


@pytest.mark.parametrize(
    ("change", "fault"),
    [
        ({}, None),
        ({"text": "It is 12 m away."}, "bare digit"),
        ({"verdict": "REJECT"}, "wrong verdict"),
        ({"verdict": None}, "wrong verdict"),
        ({"cited": ["rule.b"]}, "unknown citation"),
        ({"intent": "flood"}, "no refusal"),
        ({"text": "This site is safe."}, "banned phrase"),
        ({"text": None}, "bare digit"),
    ],
)
def test_answers(spark, change, fault):
    schema = "text string, verdict string, screened string, cited array<string>, pack array<string>, intent string, refused array<string>"
    faults = answers.validate(spark.createDataFrame([ANSWER | change], schema)).first()["faults"]
    assert (faults == []) if fault is None else fault in faults


def test_composed_text_and_prompt(spark):
    row = answers.compose(spark.createDataFrame([("REFER", "state", 255, 20, ["rule.a"])], "verdict string, ruleId string, distPresent int, uncertaintyM int, chunks array<string>")).first()
    assert "farther from water" in row["text"] and "rule.a" in row["text"]
    shown = answers.accepted_text(spark.createDataFrame([("x", "t0", ["bare digit"])], "text string, tier0 string, faults array<string>")).first()
    assert (shown["shown"], shown["reason"]) == ("t0", "bare digit")
    packs = spark.createDataFrame([("why?", {"a": 1}, ["f"], [("rule.a", "body", True)])], "question string, site map<string, int>, facts array<string>, chunks array<struct<id: string, body: string, verify: boolean>>")
    assert "[rule.a] (unverified) body" in answers.prompt(packs).first()["prompt"]


def test_the_provider_that_is_asked():
    keys = {"one": "", "two": "k", "three": "k"}
    assert answers.chosen_provider("three", keys) == "three" and answers.chosen_provider("", keys) == "two"
    assert answers.chosen_provider("other", {"one": " "}) is None


def test_answer_schemas():
    schema = {"type": "object", "$id": "x", "properties": {"cited": {"type": "array", "items": {"type": "string", "pattern": "p"}}}}
    tight = answers.tightened(answers.reduced(schema))
    assert tight["required"] == ["cited"] and tight["additionalProperties"] is False and "$id" not in tight
    assert answers.pinned(tight, ["b", "a"])["properties"]["cited"]["items"]["enum"] == ["a", "b"]
    assert answers.pinned(tight, []) == tight


def test_corpus_faults_are_found(spark):
    rows = [
        ("rule.ok", "rule", "c/rule/ok.md", "t", "body", ["flood"]),
        ("Rule.Bad", "rule", "c/rule/bad.md", "t", "body", ["flood"]),
        ("zone.x", "zone", "c/zone/x.md", "t", "body", ["flood"]),
        ("rule.long", "rule", "c/rule/long.md", "t", "word " * 121, ["weather"]),
        ("rule.empty", "rule", "c/rule/empty.md", " ", "body", []),
    ]
    found = quality.chunk_faults(spark.createDataFrame(rows, "id string, kind string, file string, title string, body string, intents array<string>"))
    got = {(r["id"], r["problem"]) for r in found.collect()}
    assert {("Rule.Bad", "bad id"), ("zone.x", "unknown kind"), ("rule.long", "too long"), ("rule.long", "unknown intent"), ("rule.empty", "empty")} <= got
    assert not any(i == "rule.ok" for i, _ in got)


def test_provenance_and_mapping(spark):
    chunks = spark.createDataFrame(
        [("a", "statute", "", ""), ("b", "statute", "http://x", ""), ("c", "repo-derived", "", "f.md#L9"), ("d", "repo-derived", "", "f.md#L1-L3"), ("e", "repo-derived", "", "g.md#L1"), ("f", "repo-derived", "", "f.md")],
        "id string, authority string, url string, repo_ref string",
    )
    files = spark.createDataFrame([("f.md", 5)], "path string, lines int")
    got = {r["id"]: r["problem"] for r in quality.provenance(chunks, files).collect()}
    assert got == {"a": "no link", "c": "line beyond the end", "e": "no such file", "f": "no lines"}
    mapped = quality.unmapped(spark.createDataFrame([("x",)], "code string"), spark.createDataFrame([("y", "a")], "code string, chunk string"), chunks)
    assert {(r["problem"], r["value"]) for r in mapped.collect()} == {("code without chunk", "x"), ("mapped but never given", "y")}


def test_fingerprint_depends_on_content_only(spark):
    rows = [("b", "two"), ("a", "one")]
    one = quality.fingerprint(spark.createDataFrame(rows, "id string, body string"), "id", "body").first()[0]
    two = quality.fingerprint(spark.createDataFrame(rows[::-1], "id string, body string").repartition(2), "id", "body").first()[0]
    other = quality.fingerprint(spark.createDataFrame([("a", "one"), ("b", "three")], "id string, body string"), "id", "body").first()[0]
    assert one == two != other and len(one) == 8


def test_held_out_blocks(spark):
    rows = stats.hold_out(spark, 24, 8, [0, 1, 2]).collect()
    by = {s: sorted(r["block"] for r in rows if r["seed"] == s) for s in (0, 1, 2)}
    assert all(len(set(b)) == 8 and set(b) <= set(range(24)) for b in by.values()) and by[0] != by[1]


def test_bands_by_name(spark):
    assert raster.select_bands(fx.pixels(spark), "(upa|hand)").columns == ["y", "x", "hand", "upa"]


def channel(n, mouth=True):
    """Cells in a line, flowing east; the last one is a mouth or flows back."""
    return [(i, 0, 1 if i < n - 1 else 9 if mouth else 5, True) for i in range(n)]


def test_terminals_of_routes_of_any_length(spark):
    cells = spark.createDataFrame(channel(2000), "ix long, iy long, d8 int, inside boolean")
    got = flow.terminals(cells).collect()
    assert len(got) == 2000 and {(r["tx"], r["ty"], r["looped"]) for r in got} == {(1999, 0, False)}


def test_terminals_name_cycles(spark):
    ring = [(0, 11, 1, True), (1, 11, 3, True), (1, 10, 5, True), (0, 10, 7, True), (2, 12, 4, True), (3, 13, 4, True)]
    lone = [(50, 50, 10, True), (51, 50, 1, True), (60, 60, 1, False)]
    cells = spark.createDataFrame(channel(301, mouth=False) + ring + lone, "ix long, iy long, d8 int, inside boolean")
    got = {(r["ix"], r["iy"]): (r["tx"], r["ty"], r["looped"]) for r in flow.terminals(cells).collect()}
    assert len(got) == 301 + 6 + 2
    assert all(got[i, 0] == (299, 0, True) for i in range(301))  # the last two flow to one another
    assert all(got[x, y] == (0, 10, True) for x, y, _, _ in ring)
    assert got[50, 50] == (50, 50, False) and got[51, 50] == (51, 50, False)
    assert flow.terminals(cells.where("false")).count() == 0


def test_decimals_in_the_middle(spark):
    """Seven figures that end in 5 go where their binary value lies, as the C library shows them."""
    import random

    rng = random.Random(11)
    values = [99999.95, 0.00012345675, 1234565.0, 1234575.0, 2.000005, 9.999995, 0.5, 1.5, -99999.95, 1000005e9, 999999.5]
    values += [float(f"{rng.randrange(100_000, 1_000_000)}5e{rng.randrange(-15, 9)}") for _ in range(3000)]
    values += [x / 2**k for k in range(1, 12) for x in (2000001, 1000003, 1234567)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.n for r in rows.select("i", quality.decimals(F.col("v")).alias("n")).collect()}
    assert {i: len((f"{v:g}".split(".") + [""])[1]) for i, v in enumerate(values)} == got
