"""Shares of pixels in polygons, and projections: exact values, brute force, known places."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnwright.functions import projection
from tarnwright.operators import grids, raster, spatial

RING = "array<struct<x: double, y: double>>"


def clipped(ring, x, y):
    """Area of a convex or concave ring within a pixel: half-planes one after another."""
    for axis, bound, sign in ((0, x, 1), (0, x + 1, -1), (1, y, 1), (1, y + 1, -1)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            a, b = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if a >= 0:
                out.append(p)
            if (a > 0 > b) or (a < 0 < b):
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = out
        if not ring:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def star(rng, cx, cy, far, n):
    """A ring that goes round its middle once, so it does not cross itself."""
    turns = sorted((i + rng.uniform(0, 1)) * 2 * math.pi / n for i in range(n))
    far = [rng.uniform(0.2, 1) * far for _ in turns]
    return [(cx + r * math.cos(t), cy + r * math.sin(t)) for r, t in zip(far, turns, strict=True)]


def test_shares_equal_clipping(spark):
    rng = random.Random(12)
    rings = {i: star(rng, rng.uniform(-6, 6), rng.uniform(-6, 6), rng.choice((0.1, 0.4, 3, 7)), rng.choice((8, 12, 20))) for i in range(40)}
    rings |= {100: [(0, 0), (3, 0), (3, 2), (0, 2)], 101: [(0, 0), (0, 2), (3, 2), (3, 0)], 102: [(1, 1), (4, 1), (4, 4)], 103: [(0.25, 0.25), (0.5, 0.25), (0.5, 0.5)], 104: [(0, 0), (5, 0)], 105: [(1, 1), (2, 1), (3, 1)]}
    zones = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, r in rings.items()], f"zone_id int, ring {RING}")
    got = {(r["zone_id"], r["y"], r["x"]): r["share"] for r in spatial.coverage(zones).collect()}
    want = {}
    for i, ring in rings.items():
        if i >= 104:
            continue
        for y in range(math.floor(min(p[1] for p in ring)), math.ceil(max(p[1] for p in ring))):
            for x in range(math.floor(min(p[0] for p in ring)), math.ceil(max(p[0] for p in ring))):
                if i >= 100 or (a := area_within(ring, x, y)) > 1e-9:
                    want[i, y, x] = clipped(ring, x, y) if i >= 100 else a
    want = {k: v for k, v in want.items() if v > 1e-9}
    got = {k: v for k, v in got.items() if v > 1e-9}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def area_within(ring, x, y):
    """A star as triangles from its first point, with their signs: right for any ring."""
    total = 0.0
    for p, q in zip(ring[1:], ring[2:], strict=False):
        signed = (p[0] - ring[0][0]) * (q[1] - ring[0][1]) - (q[0] - ring[0][0]) * (p[1] - ring[0][1])
        total += math.copysign(clipped([ring[0], p, q], x, y), signed)
    return abs(total)


def test_holes_and_areas(spark):
    zones = spark.createDataFrame([(1, [(0.5, 0.5), (6.5, 0.5), (6.5, 6.5), (0.5, 6.5)], [[(2.25, 2.0), (4.0, 2.0), (4.0, 5.5)], [(5.0, 5.0), (5.0, 5.5), (5.5, 5.5), (5.5, 5.0)]]), (2, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], None)], f"zone_id int, ring {RING}, holes array<{RING}>")
    rows = spatial.coverage(zones)
    total = {r["zone_id"]: r["s"] for r in rows.groupBy("zone_id").agg(F.sum("share").alias("s")).collect()}
    assert total[1] == pytest.approx(36 - 1.75 * 3.5 / 2 - 0.25) and total[2] == pytest.approx(0.5)
    assert rows.where("zone_id = 1 and y = 3 and x = 3").first()["share"] == pytest.approx(1 - clipped([(2.25, 2.0), (4.0, 2.0), (4.0, 5.5)], 3, 3))


def test_buildings_smaller_than_a_pixel_have_its_value(spark):
    px = spark.createDataFrame([(0, 0, 8.0), (0, 1, 2.0), (1, 0, None)], "y int, x int, v double")
    small = [(0.1, 0.1), (0.3, 0.1), (0.3, 0.2), (0.1, 0.2)]
    across = [(0.75, 0.0), (1.25, 0.0), (1.25, 0.5), (0.75, 0.5)]
    masked = [(0.0, 0.5), (1.0, 0.5), (1.0, 1.5), (0.0, 1.5)]
    zones = spark.createDataFrame([(1, small), (2, across), (3, masked), (4, [(9.0, 9.0), (9.5, 9.0), (9.0, 9.5)]), (5, None)], f"zone_id int, ring {RING}")
    got = {r["zone_id"]: (r["pixels"], r["v"]) for r in spatial.zonal_fraction(px, zones, ["v"]).collect()}
    assert got[1] == (pytest.approx(0.02), pytest.approx(8)) and got[2] == (pytest.approx(0.25), pytest.approx(5))
    assert got[3] == (pytest.approx(1), pytest.approx(8)) and got[4] == got[5] == (0, None)
    assert spatial.zonal_mean(px, zones.where("zone_id = 1"), ["v"]).first()["v"] is None  # by centres it has none


def test_a_wide_zone_is_covered_by_runs(spark):
    zones = spark.createDataFrame([(1, [(0.5, 0.0), (100_000.5, 0.0), (100_000.5, 2.0), (0.5, 2.0)])], f"zone_id int, ring {RING}")
    got = spatial.coverage(zones).agg(F.count("*").alias("n"), F.sum("share").alias("s"), F.count_if(F.col("share") == 1).alias("whole")).first()
    assert (got["n"], got["s"], got["whole"]) == (200_002, 200_000.0, 199_998)


def places(spark, rows):
    return spark.createDataFrame(rows, "lon double, lat double")


def test_known_places(spark):
    """A tower in zone 17 whose published place is 630084 m, 4833438 m; the equator and a zone's meridian by definition."""
    east, north = projection.to_utm(F.col("lon"), F.col("lat"), 17)
    r = places(spark, [(-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600)]).select(east.alias("e"), north.alias("n")).first()
    assert abs(r["e"] - 630084) < 1 and abs(r["n"] - 4833438) < 1
    east, north = projection.to_utm(F.col("lon"), F.col("lat"), 17, False)
    r = places(spark, [(-81.0, 0.0)]).select(east.alias("e"), north.alias("n")).first()
    assert (r["e"], r["n"]) == (pytest.approx(500_000), pytest.approx(10_000_000))


def test_meridian_arcs_equal_their_integral(spark):
    """Northings on a zone's meridian, divided by its scale, are arcs of the ellipse: by Simpson's rule."""
    e2 = projection.FLATTENING * (2 - projection.FLATTENING)
    f = lambda p: projection.AXIS * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    for lat in (1.0, 12.97, 45.0, 80.0):
        n, top = 2000, math.radians(lat)
        h = top / n
        arc = h / 3 * (f(0) + f(top) + 4 * sum(f((2 * i + 1) * h) for i in range(n // 2)) + 2 * sum(f(2 * i * h) for i in range(1, n // 2)))
        _, north = projection.to_utm(F.col("lon"), F.col("lat"), 43)
        assert places(spark, [(75.0, lat)]).select(north.alias("n")).first()["n"] / projection.SCALE == pytest.approx(arc, abs=1e-5)


def test_round_trips_stay_below_a_millimetre(spark):
    rng = random.Random(2)
    rows = places(spark, [(rng.uniform(72, 78), rng.uniform(-84, 84)) for _ in range(500)])
    east, north = projection.to_utm(F.col("lon"), F.col("lat"), 43, False)
    lon, lat = projection.from_utm(F.col("e"), F.col("n"), 43, False)
    off = rows.withColumns({"e": east, "n": north}).select(F.max(F.greatest(F.abs(lon - F.col("lon")), F.abs(lat - F.col("lat")))).alias("d")).first()["d"]
    assert off * 111_700_000 < 0.01
    assert rows.select(projection.zone_of(F.col("lon"))).distinct().collect() == [(43,)]
    far = projection.to_utm(F.lit(-100.0), F.lit(3.0), 43)
    assert rows.select(far[0], far[1]).first() == (None, None)


def test_both_directions_of_lines(spark):
    """The same field on a lattice that grows north and on one that grows south: told apart by their places, not by row numbers."""
    rng = random.Random(3)
    up = grids.Grid(77.63, 12.90, 1e-4, 1e-4, 20, 30)
    down = grids.Grid(77.63, 12.90 + 30e-4, 1e-4, -1e-4, 20, 30)
    values = {(y, x): rng.randrange(1000) for y in range(30) for x in range(20)}
    source = spark.createDataFrame([(y, x, v) for (y, x), v in values.items()], "y int, x int, v int")
    turned = grids.reproject(source, up, down, ["v"])
    assert {(r["y"], r["x"]): r["v"] for r in turned.collect()} == {(29 - y, x): v for (y, x), v in values.items()}
    layers = source.withColumnRenamed("v", "a").join(turned.withColumnRenamed("v", "b"), ["y", "x"])
    poses = {r["pose"]: r["match"] for r in raster.flip_diagnosis(layers, "a", "b", 30, 20).collect()}
    assert poses["upside_down"] == 1 and poses["as_is"] < 0.5
    back = grids.reproject(turned, down, up, ["v"])
    assert {(r["y"], r["x"]): r["v"] for r in back.collect()} == values


def test_there_and_back_through_metres(spark):
    """A finer grid in metres holds every pixel of the lattice, and each comes back with its own value; off it is null."""
    lattice = grids.Grid(77.63, 12.97, 1e-3, -1e-3, 15, 10)
    source = lattice.pixels(spark).selectExpr("y", "x", "y * 100 + x AS v")
    ground = grids.over(spark, lattice, 43, 10.0, margin=50)
    there = grids.reproject(source, lattice, ground, ["v"])
    assert there.count() == ground.width * ground.height and there.where("v is null").count() > 0
    back = grids.reproject(there, ground, lattice, ["v"])
    assert back.where("v = y * 100 + x").count() == 150
