"""Spatial joins by tiles: hotspots, disc probes, zones, corridors, nearest names. None is a cross join, but for nearest names of few positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwright.functions.geometry import Area, bin_lat, bin_lon, bin_of, in_ring, to_segment
from tarnwright.operators.nearest import nearest


def hotspots(pixels: DataFrame, width: int, height: int, across: int, down: int, k: int, area: Area) -> DataFrame:
    """The k grid cells with most pixels (y, x), by count, then first in row-major order, with the cells' centres."""
    cells = pixels.groupBy(bin_of(F.col("x"), across, width).alias("cx"), bin_of(F.col("y"), down, height).alias("cy")).agg(
        F.count("*").alias("px"), F.min(F.col("y") * F.lit(width) + F.col("x")).alias("first_px")
    )
    top = cells.orderBy(F.col("px").desc(), "first_px").limit(k)
    return top.select("cx", "cy", "px", bin_lon(F.col("cx"), across, area).alias("lon"), bin_lat(F.col("cy"), down, area).alias("lat"))


def tiles(low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: float) -> Column:
    """The tiles (tx, ty) that a box touches."""
    span = lambda a, b: F.sequence(F.floor(a / size).cast("int"), F.floor(b / size).cast("int"))
    return F.flatten(F.transform(span(low_x, high_x), lambda tx: F.transform(span(low_y, high_y), lambda ty: F.struct(tx.alias("tx"), ty.alias("ty")))))


def _tiled(points: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return points.withColumns({"tx": F.floor(F.col(x) / size).cast("int"), "ty": F.floor(F.col(y) / size).cast("int")})


def disc_probe(pixels: DataFrame, plots: DataFrame, least: list[str], most: list[str], tile: int = 16) -> DataFrame:
    """Of each plot (plot_id, px, py, radius) the least of some bands and the most of others within its disc of pixels."""
    boxes = plots.withColumn("t", F.explode(tiles(F.col("px") - F.col("radius"), F.col("py") - F.col("radius"), F.col("px") + F.col("radius"), F.col("py") + F.col("radius"), tile)))
    boxes = boxes.select("plot_id", "px", "py", "radius", "t.tx", "t.ty")
    near = _tiled(pixels, "x", "y", tile).join(boxes, ["tx", "ty"])
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    inside = near.where(dx * dx + dy * dy <= F.col("radius") * F.col("radius"))
    return inside.groupBy("plot_id").agg(F.count("*").alias("pixels"), *(F.min(b).alias(f"min_{b}") for b in least), *(F.max(b).alias(f"max_{b}") for b in most))


def _in_zones(pixels: DataFrame, zones: DataFrame, tile: int) -> DataFrame:
    """Pixels whose centre is in a zone (zone_id, ring of (x, y)); candidates meet by tile."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxes = zones.withColumn("t", F.explode(tiles(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), tile))).select("zone_id", "ring", "t.tx", "t.ty")
    near = _tiled(pixels, "x", "y", tile).join(boxes, ["tx", "ty"])
    return near.where(in_ring(F.col("x") + 0.5, F.col("y") + 0.5, F.col("ring")))


def zonal_mean(pixels: DataFrame, zones: DataFrame, bands: list[str], tile: int = 16) -> DataFrame:
    """Mean of the bands over each zone's pixels; zones without a pixel have nulls."""
    means = _in_zones(pixels, zones, tile).groupBy("zone_id").agg(F.count("*").alias("pixels"), *(F.avg(b).alias(b) for b in bands))
    return zones.select("zone_id").join(means, "zone_id", "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)))


def coverage(zones: DataFrame) -> DataFrame:
    """zone_id, y, x, share: of each pixel that a zone (zone_id, ring of (x, y); holes, an array of rings, if there) meets,
    the share of it inside. Exact for rings of straight sides, which must not cross themselves.

    By Green's theorem, side by side: a side is cut at the pixels' borders, and each piece adds to its pixel the area to
    its right and to all pixels further right its height, with the sign of its direction. Running sums along a line give
    the shares of the pixels that sides pass through, and the one share of each run of pixels between them. Work grows
    with the sides' lengths and the pixels covered, not with boxes; everything is columns.
    """
    point = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
    rings = F.array(F.struct(F.transform("ring", point).alias("r"), F.lit(1).alias("s")))
    if "holes" in zones.columns:
        rings = F.concat(rings, F.transform(F.coalesce("holes", F.array().cast(zones.schema["holes"].dataType)), lambda r: F.struct(F.transform(r, point).alias("r"), F.lit(-1).alias("s"))))
    rows = zones.select("zone_id", F.explode(rings).alias("k")).select("zone_id", "k.r", "k.s").where(F.size("r") > 2)
    sides = F.transform("r", lambda p, i: F.struct(p.alias("a"), F.element_at("r", (F.pmod(i + 1, F.size("r")) + 1).cast("int")).alias("b")))
    area = F.aggregate("sides", F.lit(0.0), lambda t, e: t + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    rows = rows.withColumn("sides", sides).withColumn("s", F.col("s") * F.signum(area)).select("zone_id", "s", F.explode("sides").alias("e"))
    c = F.col
    rows = rows.select("zone_id", "s", c("e.a.x").alias("ax"), c("e.a.y").alias("ay"), c("e.b.x").alias("bx"), c("e.b.y").alias("by")).where("ay <> by")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = rows.withColumn("y", F.explode(F.sequence(F.floor(low).cast("int"), (F.ceil(high) - 1).cast("int"))))
    rows = rows.withColumns({"y0": F.greatest(low, c("y").cast("double")), "y1": F.least(high, c("y") + 1.0)})
    along = lambda y: c("ax") + (y - c("ay")) * (c("bx") - c("ax")) / (c("by") - c("ay"))
    rows = rows.withColumns({"x0": F.least(along(c("y0")), along(c("y1"))), "x1": F.greatest(along(c("y0")), along(c("y1")))})
    rows = rows.withColumn("x", F.explode(F.sequence(F.floor("x0").cast("int"), F.floor("x1").cast("int"))))
    left, right = F.greatest("x0", c("x").cast("double")), F.least("x1", c("x") + 1.0)
    part = F.when(c("x0") == c("x1"), 1.0).otherwise((right - left) / (c("x1") - c("x0")))
    height = -c("s") * F.signum(c("by") - c("ay")) * (c("y1") - c("y0")) * part
    pieces = rows.select("zone_id", "y", "x", height.alias("h"), (height * (c("x") + 1 - (left + right) / 2)).alias("a"))
    pieces = pieces.groupBy("zone_id", "y", "x").agg(F.sum("h").alias("h"), F.sum("a").alias("a"))
    line = Window.partitionBy("zone_id", "y").orderBy("x")
    pieces = pieces.withColumns({"total": F.sum("h").over(line.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("x").over(line)})
    own = F.array(F.struct(c("x").alias("x"), (c("total") - c("h") + c("a")).alias("share")))
    between = F.when((c("next") > c("x") + 1) & (c("total") > 1e-12), F.transform(F.sequence(c("x") + 1, c("next") - 1), lambda x: F.struct(x.alias("x"), c("total").alias("share"))))
    every = F.concat(own, F.coalesce(between, F.array().cast("array<struct<x: int, share: double>>")))
    return pieces.select("zone_id", "y", F.explode(every).alias("p")).select("zone_id", "y", "p.x", F.least("p.share", F.lit(1.0)).alias("share")).where("share > 1e-12")


def zonal_fraction(pixels: DataFrame, zones: DataFrame, bands: list[str]) -> DataFrame:
    """zone_id, pixels (as shares of them), and the means of the bands weighed by the share of each pixel inside.

    A zone smaller than a pixel has that pixel's value. Null values weigh nothing; a zone without any pixel, or without
    area, has 0 and nulls. The pixels and their shares meet by place, so neither large zones nor dense ones gather.
    """
    met = coverage(zones).join(pixels.select("y", "x", *bands), ["y", "x"])
    weighed = [F.try_divide(F.sum(F.col("share") * F.col(b)), F.sum(F.when(F.col(b).isNotNull(), F.col("share")))).alias(b) for b in bands]
    means = met.groupBy("zone_id").agg(F.sum("share").alias("pixels"), *weighed)
    return zones.select("zone_id").join(means, "zone_id", "left").withColumn("pixels", F.coalesce("pixels", F.lit(0.0)))


def touching(pixels: DataFrame, zones: DataFrame, tile: int = 16) -> DataFrame:
    """The zones that hold one of the pixels."""
    return zones.join(_in_zones(pixels, zones, tile).select("zone_id"), "zone_id", "left_semi")


def corridor(points: DataFrame, segments: DataFrame, metres: float, tile: float | None = None) -> DataFrame:
    """point_id, route_id, metres: the points (point_id, x, y) within `metres` of a route's segments (route_id, ax, ay, bx, by)."""
    size = tile or metres
    low, high = F.least, F.greatest
    boxes = segments.withColumn("t", F.explode(tiles(low("ax", "bx") - metres, low("ay", "by") - metres, high("ax", "bx") + metres, high("ay", "by") + metres, size)))
    near = _tiled(points, "x", "y", size).join(boxes.select("route_id", "ax", "ay", "bx", "by", "t.tx", "t.ty"), ["tx", "ty"])
    d = to_segment(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    return near.withColumn("metres", d).where(F.col("metres") <= metres).groupBy("route_id", "point_id").agg(F.min("metres").alias("metres"))


def corridor_counts(near: DataFrame) -> DataFrame:
    """How many points are along each route: rows of corridor() counted."""
    return near.groupBy("route_id").agg(F.count("*").alias("points"), F.min("metres").alias("nearest"))


def footprints(buildings: DataFrame, area: Area, least_confidence: float = 0.70, least_m2: float = 40.0) -> DataFrame:
    """Buildings (xmin, ymin, xmax, ymax, confidence, area_in_meters) whose box meets the area, sure and large enough.

    All conditions are comparisons of columns with constants, so they reach the scan.
    """
    c = F.col
    inside = (c("xmax") >= area.west) & (c("xmin") <= area.east) & (c("ymax") >= area.south) & (c("ymin") <= area.north)
    return buildings.where(inside & (c("confidence") >= least_confidence) & (c("area_in_meters") >= least_m2))


def grid_totals(pixels: DataFrame, width: int, height: int, across: int, down: int) -> DataFrame:
    """One row: pixels (y, x), and the grid cells that hold any."""
    cells = pixels.groupBy(bin_of(F.col("x"), across, width).alias("cx"), bin_of(F.col("y"), down, height).alias("cy")).agg(F.count("*").alias("px"))
    return cells.agg(F.coalesce(F.sum("px"), F.lit(0)).alias("pixels"), F.count("*").alias("occupied"))


def nearest_name(sites: DataFrame, places: DataFrame, kinds: tuple[str, ...] = ("settlement", "road"), reach: float = 1.0) -> DataFrame:
    """The nearest place of the kinds to each site (site_id, x, y) within reach, the smaller name on a tie.

    Names never come from water. Sites without a place in reach have nulls; nearest_name_anywhere() has no reach.
    """
    return nearest(sites, places.where(F.col("kind").isin(*kinds)), reach)


def nearest_name_anywhere(sites: DataFrame, places: DataFrame, kinds: tuple[str, ...] = ("settlement", "road"), reach: float = 1.0) -> DataFrame:
    """nearest_name() however far. Null only if there is no place of the kinds at all, or the site has no position.

    reach, where looking began, is still taken and changes nothing.
    """
    return nearest(sites, places.where(F.col("kind").isin(*kinds)))


def lookup(gazetteer: DataFrame, names: DataFrame) -> DataFrame:
    """asked, name, lon, lat: the places (name, lon, lat) that have the names asked for, whatever their case. A place
    moves the map; it never screens anything."""
    return names.select("asked").join(gazetteer.withColumn("_key", F.lower(F.trim("name"))), F.lower(F.trim("asked")) == F.col("_key")).select("asked", "name", "lon", "lat")


def ranked(rows: DataFrame, score: str, tie: str, k: int | None = None) -> DataFrame:
    """Rows by falling score; ranks are given within the k kept."""
    top = rows.orderBy(F.col(score).desc(), tie)
    top = top.limit(k) if k else top
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), tie))) if k else top
