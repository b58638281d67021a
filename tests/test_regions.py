"""Regions against plain following, on random masks, across seams, and as polygons."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwright.operators import regions, spatial

AT = "y int, x int"


def plain(cells, eight):
    """Labels by flooding."""
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    label = {}
    for start in sorted(cells):
        if start not in label:
            label[start], todo = start, [start]
            while todo:
                y, x = todo.pop()
                for dy, dx in steps:
                    p = (y + dy, x + dx)
                    if p in cells and p not in label:
                        label[p] = start
                        todo.append(p)
    return label


def holes(cells, eight):
    """Parts of the rest that do not reach the outside; they are linked the other way."""
    ys, xs = [y for y, _ in cells], [x for _, x in cells]
    box = {(y, x) for y in range(min(ys) - 1, max(ys) + 2) for x in range(min(xs) - 1, max(xs) + 2)}
    return len(set(plain(box - cells, not eight).values())) - 1


@pytest.mark.parametrize("eight, share", [(False, 0.7), (True, 0.5)])
def test_random_masks(spark, eight, share):
    rng = random.Random(int(share * 10))
    cells = {(y, x) for y in range(-7, 24) for x in range(-5, 31) if rng.random() < share}
    mask = spark.createDataFrame([*cells, *list(cells)[:20], (None, 3)], AT)
    labels = regions.labelled(mask, eight=eight, tile=8)
    want = plain(cells, eight)
    assert {(r.y, r.x): (r.ly, r.lx) for r in labels.collect()} == want and labels.count() == len(cells)
    pieces = regions.outlines(labels, eight=eight, tile=8)
    got = {(r.ly, r.lx): r for r in regions.measures(pieces).collect()}
    by_label = {}
    for p, name in want.items():
        by_label.setdefault(name, set()).add(p)
    assert set(got) == set(by_label)
    for name, part in by_label.items():
        sides = sum((y + dy, x + dx) not in part for y, x in part for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        assert (got[name].area, got[name].perimeter) == (len(part), sides)
        assert got[name].rings == 1 + holes(part, eight)
    shapes = regions.polygons(pieces).collect()
    for r in shapes:
        for ring, sign in ((r.ring, 1), *((h, -1) for h in r.holes)):
            n = len(ring)
            ends = [(ring[i], ring[(i + 1) % n]) for i in range(n)]
            assert all((a.x == b.x) != (a.y == b.y) for a, b in ends) and all((a.x == b.x) != (ends[i - 1][0].x == ends[i - 1][1].x) for i, (a, b) in enumerate(ends))
            assert sign * sum(a.x * b.y - b.x * a.y for a, b in ends) > 0
        area = sum(a.x * b.y - b.x * a.y for ring in (r.ring, *r.holes) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
        assert area == 2 * len(by_label[r.ly, r.lx])


def test_shares_of_polygons_are_the_pixels(spark):
    rng = random.Random(5)
    cells = {(y, x) for y in range(20) for x in range(20) if rng.random() < 0.7}
    labels = regions.labelled(spark.createDataFrame(list(cells), AT), tile=6)
    shapes = regions.polygons(regions.outlines(labels, tile=6)).selectExpr("struct(ly, lx) AS zone_id", "ring", "holes")
    got = {(r.y, r.x): tuple(r.zone_id) for r in spatial.coverage(shapes).where("share > 1e-9").collect()}
    assert got == plain(cells, False)


def test_one_region_of_a_thousand_tiles(spark):
    """A comb: a line along the top, teeth below, so that the region winds through all tiles and its outline is one ring."""
    line = spark.range(4000).selectExpr("0 AS y", "CAST(id AS INT) AS x")
    teeth = spark.range(0, 4000, 2).selectExpr("explode(sequence(1, 3)) AS y", "CAST(id AS INT) AS x")
    labels = regions.labelled(line.unionByName(teeth), tile=4)
    assert [tuple(r) for r in labels.select("ly", "lx").distinct().collect()] == [(0, 0)]
    row = regions.measures(regions.outlines(labels, tile=4)).first()
    assert (row.area, row.rings, row.perimeter) == (10_000, 1, 2 * 4000 + 2 + 2 * 3 * 2000)


def test_areas_apart_and_nothing(spark):
    rows = [("a", 0, 0), ("a", 0, 1), ("b", 0, 1), (None, 0, 1), (None, 1, 1), ("b", 0, 3), ("b", 0, 4)]
    mask = spark.createDataFrame(rows, f"area string, {AT}")
    labels = regions.labelled(mask, keys=("area",), tile=1)
    want = {("a", 0, 0, 2), ("b", 0, 1, 1), (None, 0, 1, 2), ("b", 0, 3, 2)}
    assert {(r.area, r.ly, r.lx, r.n) for r in labels.groupBy("area", "ly", "lx").agg(F.count("*").alias("n")).collect()} == want
    got = regions.outlines(labels, keys=("area",), tile=1).groupBy("area", "ly", "lx").agg(F.sum("doubled").alias("d")).collect()
    assert {(r.area, r.ly, r.lx, r.d / 2) for r in got} == want
    none = regions.labelled(mask.where("false"))
    assert none.count() == 0 and regions.polygons(regions.outlines(none)).count() == 0
