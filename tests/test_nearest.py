"""Nearest places: against all pairs, at any density, and without all pairs."""

import math
import random

import pytest

from tarnwright.operators import nearest, spatial

SITES, PLACES = "site_id long, x double, y double", "name string, kind string, px double, py double"


def expected(sites, places, reach=math.inf):
    out = {}
    for i, x, y in sites:
        if x is None or y is None or not math.isfinite(x) or not math.isfinite(y):
            out[i] = (None, None)
            continue
        met = [((x - px) * (x - px) + (y - py) * (y - py), name is None, name or "") for name, kind, px, py in places if kind != "water" and px is not None and py is not None and math.isfinite(px) and math.isfinite(py)]
        best = min((m for m in met if m[0] <= reach * reach), default=None)
        out[i] = (None, None) if best is None else (None if best[1] else best[2], round(math.sqrt(best[0]), 9))
    return out


def found(frame):
    return {r["site_id"]: (r["name"], None if r["distance"] is None else round(r["distance"], 9)) for r in frame.collect()}


def points(rng, n):
    """Evenly spread, on a lattice, in a dense cluster, far off."""
    kinds = (lambda: (rng.uniform(0, 100), rng.uniform(0, 100)), lambda: (rng.randrange(8) * 10.0, rng.randrange(8) * 10.0), lambda: (70 + rng.gauss(0, 1e-3), 20 + rng.gauss(0, 1e-3)), lambda: (rng.uniform(-1e5, 1e5), 5e4))
    return [kinds[i % 4]() for i in range(n)]


@pytest.mark.parametrize("pairs", [1 << 24, 0])
def test_nearest_is_that_of_all_pairs(spark, monkeypatch, pairs):
    monkeypatch.setattr(nearest, "MOST_PAIRS", pairs)
    monkeypatch.setattr(nearest, "MOST_SITES", 4)
    rng = random.Random(3)
    sites = [(i, *xy) for i, xy in enumerate(points(rng, 300))] + [(1000, None, 1.0), (1001, math.nan, 1.0), (1002, math.inf, 1.0), (1003, 50.0, 50.0), (1004, 50.0, 50.0)]
    places = [(f"n{rng.randrange(100):03}", rng.choice(["settlement", "road", "water"]), *xy) for xy in points(rng, 400)]
    places += [(None, "road", 50.0, 50.0), ("same", "road", 20.0, 20.0), ("other", "road", 20.0, 20.0), ("nan", "road", math.nan, 1.0), ("none", "road", None, 1.0)]
    s, p = spark.createDataFrame(sites, SITES), spark.createDataFrame(places, PLACES)
    assert found(spatial.nearest_name_anywhere(s, p)) == expected(sites, places)
    for reach in (0.5, 15.0):
        assert found(spatial.nearest_name(s, p, reach=reach)) == expected(sites, places, reach)


def test_within_reach_of_many_places_few_are_met(spark, monkeypatch):
    """All 1,600 places are within reach of all 1,600 sites: 2,560,000 pairs by tiles of the reach."""
    monkeypatch.setattr(nearest, "MOST_PAIRS", 0)
    p = spark.range(1600).selectExpr("CAST(id AS STRING) AS name", "CAST(id % 40 AS DOUBLE) AS px", "CAST(id DIV 40 AS DOUBLE) AS py")
    s = spark.range(1600).selectExpr("CAST(id % 40 AS DOUBLE) + 0.25 AS x", "CAST(id DIV 40 AS DOUBLE) + 0.25 AS y")
    assert nearest._met(s, p, 100.0).count() < 1600 * 200
    got = spatial.nearest_name(s.selectExpr("CAST(y - 0.25 AS LONG) * 40 + CAST(x - 0.25 AS LONG) AS site_id", "x", "y"), p.selectExpr("*", "'road' AS kind"), reach=100.0)
    assert all(r["name"] == str(r["site_id"]) for r in got.collect())


def test_sites_at_one_position_are_met_once(spark):
    """20,000 sites at 10 positions and 20,000 places at 10: pair by pair they would be 400,000,000."""
    s = spark.range(20_000).selectExpr("id AS site_id", "CAST(id % 10 AS DOUBLE) AS x", "0D AS y")
    p = spark.range(20_000).selectExpr("lpad(CAST(id AS STRING), 5, '0') AS name", "'road' AS kind", "CAST(id % 10 AS DOUBLE) AS px", "1D AS py")
    got = spatial.nearest_name_anywhere(s, p)
    assert got.where("name = lpad(CAST(site_id % 10 AS STRING), 5, '0') AND distance = 1").count() == 20_000


def test_a_nearest_place_without_a_name(spark):
    """Looking farther does not end it: such a site was looked for forever."""
    s, p = spark.createDataFrame([(1, 0.0, 0.0)], SITES), spark.createDataFrame([(None, "road", 1.0, 0.0), ("b", "road", 3.0, 0.0)], PLACES)
    assert found(spatial.nearest_name_anywhere(s, p)) == {1: (None, 1.0)}
