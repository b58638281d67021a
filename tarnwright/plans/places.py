"""Named queries over footprints, grids and what is near: scans, clips, overlays, corridors, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwright.functions import codecs, geometry
from tarnwright.operators import flow, raster, spatial
from tarnwright.plans import fixtures as fx
from tarnwright.plans.catalogue import ERA_SQL, IN_ZONE, NEXT_X, NEXT_Y, ZONE_SQL, images, query, r6, zones
from tarnwright.sources.tables import read

AREA = geometry.AREAS["bengaluru"]


@query(
    """WITH b AS (SELECT p_partkey, 77.5::DOUBLE + (p_partkey % 400) / 1000.0::DOUBLE AS xmin, 12.8::DOUBLE + (p_partkey * 7 % 300) / 1000.0::DOUBLE AS ymin, p_size / 50.0::DOUBLE AS confidence, p_retailprice / 20 AS area FROM part)
SELECT p_partkey FROM b WHERE xmin + 0.001 >= 77.63 AND xmin <= 77.75 AND ymin + 0.001 >= 12.90 AND ymin <= 12.97 AND confidence >= 0.70 AND area >= 40"""
)
def footprint_scan(spark, d):
    rows = read(spark, d, "part").selectExpr("p_partkey", "77.5D + (p_partkey % 400) / 1000D AS xmin", "12.8D + (p_partkey * 7 % 300) / 1000D AS ymin", "p_size / 50D AS confidence", "p_retailprice / 20 AS area_in_meters")
    rows = rows.withColumns({"xmax": F.col("xmin") + 0.001, "ymax": F.col("ymin") + 0.001})
    return spatial.footprints(rows, AREA).select("p_partkey")


NEAR = "c AS (SELECT y, x FROM pxb WHERE m AND x < 9 AND y % 40 < 12)"
FIELD = "f AS (SELECT p.y, p.x, CAST(floor(LEAST(sqrt(min((p.y - c.y) * (p.y - c.y) + (p.x - c.x) * (p.x - c.x))) * 10, 255) + 0.5) AS INTEGER) AS metres FROM px p, c GROUP BY p.y, p.x)"


@query(f"WITH {fx.PIXEL_SQL}, {NEAR}, {FIELD} SELECT f.y, f.x, CASE WHEN hand > 5.5 THEN 255 ELSE metres END AS metres FROM f JOIN pxb USING (y, x) WHERE f.y BETWEEN 5 AND 29 AND f.x BETWEEN 2 AND 59")
def clip_after_distance(spark, d):
    """Distances over the whole picture, holes as the ceiling, and only then the rectangle."""
    px = fx.pixels(spark, d)
    field = raster.distance_field(px.withColumn("near", F.col("m") & (F.col("x") < 9) & (F.col("y") % 40 < 12)), "near")
    holed = raster.overlay(field, px.select("y", "x", "hand")).withColumn("metres", F.when(F.col("hand") <= 5.5, F.col("metres")))
    return raster.clip(raster.unmask(holed, {"metres": codecs.CEILING}), 5, 2, 30, 60).select("y", "x", "metres")


@query(f"WITH {fx.PIXEL_SQL} SELECT y, x, nullif(occurrence, 0)::DOUBLE AS occurrence, nullif(CAST(m AS INTEGER), 0)::DOUBLE AS water FROM pxb")
def self_masked(spark, d):
    return raster.self_mask(fx.pixels(spark, d).select("y", "x", "occurrence", F.col("m").cast("int").alias("water")), ["occurrence", "water"]).select("y", "x", F.col("occurrence").cast("double").alias("occurrence"), F.col("water").cast("double").alias("water"))


@query(
    f"WITH {fx.PIXEL_SQL}, q AS (SELECT *, CASE WHEN x > 3 THEN d8 END AS holed, occurrence * 3 AS tall FROM pxb) "
    + " UNION ALL ".join(f"SELECT '{b}' AS band, CAST(min({b}) AS DOUBLE) AS least, CAST(max({b}) AS DOUBLE) AS most, count(*) FILTER ({b} <> floor({b})) AS fractions, count(*) FILTER ({b} IS NULL) AS holes, {str(ok).lower()} AS ok FROM q" for b, ok in (("transition", True), ("hand", False), ("holed", False), ("tall", False)))
)
def export_contract(spark, d):
    px = fx.pixels(spark, d).withColumns({"holed": F.when(F.col("x") > 3, F.col("d8")), "tall": F.col("occurrence") * 3})
    return raster.export_contract(px, ["transition", "hand", "holed", "tall"])


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS byte, 93156 + l_orderkey % 145 AS ix, 15480 + l_suppkey % 85 AS iy, CASE WHEN l_partkey % 3 = 0 THEN 1984 + l_partkey % 38 END AS year FROM lineitem)
SELECT l_orderkey, l_linenumber, round(byte / 255 * 2 - 1, 6) AS grey, byte = 255 AS study_area, byte > 128 AS feature, byte <> 0 AS hotspot, byte > 0 AS valid, byte > 127 AS reference, CASE WHEN byte < 255 THEN byte END::DOUBLE AS metres,
CAST(round_even((ix * (1 / 1200::DOUBLE) - 77.63::DOUBLE) / (77.75::DOUBLE - 77.63::DOUBLE) * 2048 - 0.5, 0) AS INTEGER) AS px, CAST(round_even((1 - (iy * (1 / 1200::DOUBLE) - 12.90::DOUBLE) / (12.97::DOUBLE - 12.90::DOUBLE)) * 1195 - 0.5, 0) AS INTEGER) AS py,
coalesce(year - 1983, 0) AS year_code, year::DOUBLE AS year_back FROM b"""
)
def byte_meanings(spark, d):
    c = F.col
    rows = read(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey % 256 AS byte", "93156 + l_orderkey % 145 AS ix", "15480 + l_suppkey % 85 AS iy", "CASE WHEN l_partkey % 3 = 0 THEN 1984 + l_partkey % 38 END AS year")
    code = codecs.pack_year(c("year"))
    return rows.select(
        "l_orderkey", "l_linenumber", F.round(codecs.grey_to_unit(c("byte")), 6).alias("grey"), *(codecs.seen(c("byte"), k).alias(k) for k in ("study_area", "feature", "hotspot", "valid", "reference")), codecs.below_ceiling(c("byte")).cast("double").alias("metres"),
        geometry.lattice_pixel(c("ix"), AREA.west, AREA.east - AREA.west, 2048).alias("px"), geometry.lattice_pixel(c("iy"), AREA.south, AREA.north - AREA.south, 1195, flip=True).alias("py"), code.alias("year_code"), codecs.unpack_year(code).cast("double").alias("year_back"),
    )


@query("SELECT coalesce(a.y, b.y) AS y, coalesce(a.x, b.x) AS x, price, balance FROM (SELECT o_orderkey // 64 AS y, o_orderkey % 64 AS x, o_totalprice AS price FROM orders) a FULL JOIN (SELECT c_custkey // 32 AS y, c_custkey % 32 AS x, c_acctbal AS balance FROM customer) b ON a.y = b.y AND a.x = b.x")
def layer_overlay(spark, d):
    one = read(spark, d, "orders").select(F.expr("o_orderkey DIV 64").alias("y"), (F.col("o_orderkey") % 64).alias("x"), F.col("o_totalprice").alias("price"))
    return raster.overlay(one, read(spark, d, "customer").select(F.expr("c_custkey DIV 32").alias("y"), (F.col("c_custkey") % 32).alias("x"), F.col("c_acctbal").alias("balance")))


@query("SELECT CAST(o_orderkey // 64 AS INTEGER) AS y, CAST(o_orderkey % 64 AS INTEGER) AS x, c_acctbal AS balance FROM orders LEFT JOIN customer ON c_custkey // 16 = (o_orderkey // 64) // 4 AND c_custkey % 16 = (o_orderkey % 64) // 4")
def resampled(spark, d):
    coarse = read(spark, d, "customer").select(F.expr("CAST(c_custkey DIV 16 AS INT)").alias("y"), (F.col("c_custkey") % 16).cast("int").alias("x"), F.col("c_acctbal").alias("balance"))
    return raster.resample(fx.pixels(spark, d), coarse, 4, ["balance"])


@query(f"WITH {fx.PIXEL_SQL}, {ZONE_SQL} SELECT count(DISTINCT zone_id) AS zones FROM z JOIN pxb ON {IN_ZONE} WHERE hand < 0.5")
def zones_touching_count(spark, d):
    return spatial.touching(fx.pixels(spark, d).where("hand < 0.5"), zones(spark, d)).agg(F.count("*").alias("zones"))


@query("SELECT count(*) AS pixels, count(DISTINCT ((user_id % 64) * 16 // 64) * 100 + (event_id % 37) * 9 // 37) AS occupied FROM events")
def grid_totals(spark, d):
    return spatial.grid_totals(images(spark, d), 64, 37, 16, geometry.bins_down(AREA, 16))


@query(
    f"""WITH {ERA_SQL}, s AS (SELECT count(*) FILTER (historic) * 0.0404496::DOUBLE AS h, count(*) FILTER (present) * 0.0404496::DOUBLE AS p, count(*) FILTER (lost) * 0.0404496::DOUBLE AS l, count(*) FILTER (encroached) * 0.0404496::DOUBLE AS e FROM eras2)
SELECT round(h, 6) AS historic_ha, round(p, 6) AS present_ha, round(l, 6) AS lost_ha, round(e, 6) AS encroached_ha, round(h - p, 6) AS difference_ha, round((h - p) / h, 6) AS difference_share FROM s"""
)
def city_figures(spark, d):
    got = raster.figures(raster.water_eras(fx.pixels(spark, d)), 0.0404496)
    return got.select(*map(r6, got.columns))


POINTS = "p AS (SELECT c_custkey AS point_id, (c_custkey * 37) % 3000 * 1.0::DOUBLE AS x, (c_custkey * 53) % 2000 * 1.0::DOUBLE AS y FROM customer)"


@query(
    f"""WITH {POINTS}, s AS (SELECT s_suppkey % 5 AS route_id, (s_suppkey * 90) % 3000 * 1.0::DOUBLE AS ax, (s_suppkey * 60) % 2000 * 1.0::DOUBLE AS ay FROM supplier),
d AS (SELECT route_id, point_id, min(sqrt(pow(x - least(greatest(x, ax), ax + 90), 2) + pow(y - ay, 2))) AS metres FROM p, s GROUP BY ALL) SELECT route_id, count(*) AS points, round(min(metres), 6) AS nearest FROM d WHERE metres <= 150 GROUP BY route_id"""
)
def corridor_counts(spark, d):
    points = read(spark, d, "customer").selectExpr("c_custkey AS point_id", "(c_custkey * 37) % 3000 * 1D AS x", "(c_custkey * 53) % 2000 * 1D AS y")
    level = read(spark, d, "supplier").selectExpr("s_suppkey % 5 AS route_id", "(s_suppkey * 90) % 3000 * 1D AS ax", "(s_suppkey * 60) % 2000 * 1D AS ay").selectExpr("*", "ax + 90D AS bx", "ay AS by")
    return spatial.corridor_counts(spatial.corridor(points, level, 150.0)).select("route_id", "points", r6("nearest"))


@query(
    """WITH s AS (SELECT c_custkey AS site_id, (c_custkey * 37) % 3000 * 1.0::DOUBLE AS x, (c_custkey * 53) % 2000 * 1.0::DOUBLE AS y FROM customer),
p AS (SELECT s_name AS name, (s_suppkey * 41) % 300 * 1.0::DOUBLE AS px, (s_suppkey * 29) % 200 * 1.0::DOUBLE AS py FROM supplier WHERE s_suppkey % 3 > 0),
r AS (SELECT site_id, name, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS distance, row_number() OVER (PARTITION BY site_id ORDER BY (x - px) * (x - px) + (y - py) * (y - py), name) AS k FROM s, p) SELECT site_id, name, round(distance, 6) AS distance FROM r WHERE k = 1"""
)
def nearest_name_anywhere(spark, d):
    sites = read(spark, d, "customer").selectExpr("c_custkey AS site_id", "(c_custkey * 37) % 3000 * 1D AS x", "(c_custkey * 53) % 2000 * 1D AS y")
    places = read(spark, d, "supplier").selectExpr("s_name AS name", "CASE s_suppkey % 3 WHEN 0 THEN 'water' WHEN 1 THEN 'settlement' ELSE 'road' END AS kind", "(s_suppkey * 41) % 300 * 1D AS px", "(s_suppkey * 29) % 200 * 1D AS py")
    return spatial.nearest_name_anywhere(sites, places, reach=25.0).select("site_id", "name", r6("distance"))


@query("SELECT lower(n_name) AS asked, n_name AS name, n_nationkey * 1.0::DOUBLE AS lon, n_regionkey * 1.0::DOUBLE AS lat FROM nation WHERE n_nationkey % 2 = 0")
def place_lookup(spark, d):
    nations = read(spark, d, "nation")
    return spatial.lookup(nations.selectExpr("n_name AS name", "n_nationkey * 1D AS lon", "n_regionkey * 1D AS lat"), nations.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("asked")))


@query(
    f"""WITH RECURSIVE {fx.CELL_SQL}, walk AS (SELECT iy * 40 + ix AS trace_id, 0 AS step, ix, iy, d8, upa_code, [iy * 1000 + ix] AS path FROM cells WHERE inside
UNION ALL SELECT trace_id, step + 1, c.ix, c.iy, c.d8, c.upa_code, list_append(path, c.iy * 1000 + c.ix) FROM (SELECT *, ix + {NEXT_X} AS nx, iy + {NEXT_Y} AS ny FROM walk WHERE NOT upa_code > 215) w JOIN cells c ON c.ix = w.nx AND c.iy = w.ny
WHERE c.inside AND step < 199 AND NOT list_contains(path, c.iy * 1000 + c.ix)), l AS (SELECT *, step = max(step) OVER (PARTITION BY trace_id) AS last FROM walk)
SELECT trace_id, count(*) AS cells, bool_or(last AND upa_code > 215) AS at_trunk, round(sum(CASE WHEN last THEN 0 WHEN d8 % 2 = 0 THEN 90 * sqrt(2) ELSE 90 END), 6) AS metres FROM l GROUP BY trace_id"""
)
def client_routes(spark, d):
    """Routes that also end at a trunk channel, with their lengths on the ground."""
    cells = fx.cells(spark, d).withColumn("upa", F.col("upa_code").cast("double"))
    routes = flow.trace(cells, cells.select((F.col("iy") * 40 + F.col("ix")).alias("trace_id"), "ix", "iy"), stop_at_trunk=215.0)
    told = routes.groupBy("trace_id").agg(F.count("*").alias("cells"), F.bool_or(F.coalesce(F.col("how") == "trunk", F.lit(False))).alias("at_trunk"))
    return told.join(flow.route_length(routes), "trace_id").select("trace_id", "cells", "at_trunk", r6("metres"))
