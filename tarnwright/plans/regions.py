"""Named queries of regions: labels, measures and polygons of the set pixels of a picture that grows with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwright.operators import regions, spatial
from tarnwright.plans import fixtures as fx
from tarnwright.plans.catalogue import query, r6

#: Each set pixel with the first of those that it can be reached from, by sides and corners.
REGION_SQL = f"""{fx.PIXEL_SQL},
s AS (SELECT y, x, hand FROM pxb WHERE m),
d AS (SELECT a.range - 1 AS dy, b.range - 1 AS dx FROM range(3) a, range(3) b WHERE a.range <> 1 OR b.range <> 1),
link AS (SELECT a.y, a.x, b.y AS ty, b.x AS tx FROM s a, d JOIN s b ON b.y = a.y + dy AND b.x = a.x + dx),
reach(y, x, ty, tx) AS (SELECT y, x, y, x FROM s UNION SELECT reach.y, reach.x, link.ty, link.tx FROM reach JOIN link ON link.y = reach.ty AND link.x = reach.tx),
first AS (SELECT y, x, min(CAST(ty AS BIGINT) * 64 + tx) AS f FROM reach GROUP BY y, x),
labels AS (SELECT y, x, CAST(f // 64 AS INTEGER) AS ly, CAST(f % 64 AS INTEGER) AS lx FROM first)"""


def _labels(spark, d):
    return regions.labelled(fx.pixels(spark, d).where("m"), eight=True)


@query(f"WITH RECURSIVE {REGION_SQL} SELECT y, x, ly, lx FROM labels")
def region_labels(spark, d):
    return _labels(spark, d)


@query(
    f"""WITH RECURSIVE {REGION_SQL},
w AS (SELECT ly, lx, y + a.range AS wy, x + b.range AS wx, 2 * a.range + b.range AS bit FROM labels, range(2) a, range(2) b),
quad AS (SELECT ly, lx, count(*) AS n, sum(bit) = 3 AS across FROM w GROUP BY ly, lx, wy, wx),
q AS (SELECT ly, lx, count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 3) AS three, count(*) FILTER (n = 2 AND across) AS diagonal FROM quad GROUP BY ly, lx),
side AS (SELECT l.ly, l.lx, count(*) - count(o.y) AS perimeter FROM labels l, d LEFT JOIN s o ON o.y = l.y + dy AND o.x = l.x + dx WHERE dy = 0 OR dx = 0 GROUP BY ALL),
area AS (SELECT ly, lx, count(*) AS area FROM labels GROUP BY ALL)
SELECT ly, lx, area, perimeter, one + three + 2 * diagonal AS corners, CAST(2 - (one - three - 2 * diagonal) / 4 AS BIGINT) AS rings
FROM area JOIN side USING (ly, lx) JOIN q USING (ly, lx)"""
)
def region_measures(spark, d):
    """Areas by the outlines, held against counts of pixels; rings against the regions' Euler numbers."""
    return regions.measures(regions.outlines(_labels(spark, d), eight=True))


@query(
    f"""WITH RECURSIVE {REGION_SQL}
SELECT ly, lx, count(*)::DOUBLE AS pixels, round(avg(hand), 6) AS hand FROM labels JOIN s USING (y, x) GROUP BY ly, lx"""
)
def region_means(spark, d):
    """Polygons made from the mask, as zones of what lies below them: the same as the means of the regions' pixels."""
    shapes = regions.polygons(regions.outlines(_labels(spark, d), eight=True)).withColumn("zone_id", F.struct("ly", "lx"))
    means = spatial.zonal_fraction(fx.pixels(spark, d), shapes.select("zone_id", "ring", "holes"), ["hand"])
    return means.select("zone_id.ly", "zone_id.lx", r6("pixels"), r6("hand"))
