"""Rasters as pixel tables (y, x, bands): composites, mask algebra, neighbourhoods, zones.

Neighbourhood operators look at set pixels and the offsets around them by equi-joins or windows; none uses a
cross join, and all run for many areas at once if `keys` names their columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Transition classes that were water before, that are water now, and that were lost.
HISTORIC, PRESENT, LOST = (1, 3, 4, 6, 7, 8), (1, 2, 4, 5, 7, 8), (3, 6)
#: Land cover that still is water (open, flooded vegetation), and built land.
GUARD, BUILT = (0, 3), 6
#: Fixed value: scenes with so many percent of clouds are left out.
CLOUDY = 30.0
#: Pixels along the side of a square that is one unit of work.
TILE = 256


def in_season(ts: Column, first: int = 10, last: int = 1) -> Column:
    """Months first..last, across the turn of the year if first > last."""
    m = F.month(ts)
    return (m >= first) | (m <= last) if first > last else m.between(first, last)


def between_dates(ts: Column, low: str, high: str) -> Column:
    """From low up to but without high."""
    return (ts >= F.lit(low).cast("timestamp_ntz")) & (ts < F.lit(high).cast("timestamp_ntz"))


def clear_scenes(images: DataFrame, cloudy: str, below: float = CLOUDY) -> DataFrame:
    """Images of scenes whose share of clouds, in percent, is known and below the bound; a comparison that reaches the scan."""
    return images.where(F.col(cloudy) < below)


def median_composite(images: DataFrame, bands: list[str], keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Median of each band over the images, nulls left out."""
    return images.groupBy(*keys).agg(*(F.median(b).alias(b) for b in bands))


def timeline(images: DataFrame, band: str, epochs: dict[str, tuple[str, str]], keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """The median composite of each epoch (name: from, up to) side by side; null where an epoch has no image. One pass."""
    each = (F.median(F.when(between_dates(F.col("ts"), low, high), F.col(band))).alias(name) for name, (low, high) in epochs.items())
    return images.groupBy(*keys).agg(*each)


def mode_composite(images: DataFrame, band: str, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Most frequent class; the smallest on a tie. Two partial aggregations, no window."""
    counts = images.where(F.col(band).isNotNull()).groupBy(*keys, band).count()
    return counts.groupBy(*keys).agg(F.min_by(band, F.struct(-F.col("count"), F.col(band))).alias(band))


def last_year_code(images: DataFrame, water: Column, year: Column, epoch: int, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """The last year with water since the epoch, 0 for never, and whether there was any."""
    code = F.when(water, year - epoch).otherwise(0)
    return images.groupBy(*keys).agg(F.max(code).alias("last_code"), F.max(water.cast("int")).alias("any_water"))


def water_eras(pixels: DataFrame, transition: str = "transition", cover: str = "landcover") -> DataFrame:
    """Masks from the transition and land cover classes; a masked (null) input masks what depends on it."""
    t, c = F.col(transition), F.col(cover)
    known = t.isNotNull() & c.isNotNull()
    guard = c.isin(*GUARD)
    lost = ((t.isin(*HISTORIC) & ~t.isin(*PRESENT)) | t.isin(*LOST)) & ~guard
    masks = pixels.withColumns({"historic": t.isin(*HISTORIC), "present": t.isin(*PRESENT), "lost": F.when(known, lost)})
    return masks.withColumn("encroached", F.when(known, F.col("lost") & (c == BUILT)))


def flow_masks(pixels: DataFrame, upstream: str = "upa", hand: str = "hand") -> DataFrame:
    up, h = F.col(upstream), F.col(hand)
    return pixels.withColumns({"flow_path": (up > 2) & (h < 2), "flood_prone": h < 2, "trunk": up > 10})


def mask_area(pixels: DataFrame, masks: list[str], pixel_ha: float) -> DataFrame:
    """Hectares of each mask, one row a mask."""
    sums = pixels.agg(*(F.sum(F.col(m).cast("bigint")).alias(m) for m in masks))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), F.coalesce(F.col(m), F.lit(0)).alias("pixels")) for m in masks))).alias("r")).select(
        "r.mask", "r.pixels", (F.col("r.pixels") * pixel_ha).alias("hectares")
    )


def _around(reach: int = 1, centre: bool = True) -> Column:
    return F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if centre or dy or dx))


def min_patch(mask: DataFrame, least: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """Set pixels (y, x) of 8-connected patches of at least `least` pixels.

    A patch has n pixels if and only if n or more lie within n - 1 steps of each: so `least` - 1 joins with the
    neighbours decide it, without following the patch.
    """
    at = [*keys, "y", "x"]
    cells = mask.select(*at).distinct()
    ball = cells.select(*at, F.col("y").alias("by"), F.col("x").alias("bx"))
    there = cells.select(*keys, F.col("y").alias("by"), F.col("x").alias("bx"))
    small = None
    for step in range(1, least):
        near = ball.withColumn("d", F.explode(_around())).select(*at, (F.col("by") + F.col("d.dy")).alias("by"), (F.col("bx") + F.col("d.dx")).alias("bx"))
        ball = near.distinct().join(there, [*keys, "by", "bx"], "left_semi")
    sizes = ball.groupBy(*at).agg(F.count("*").alias("reached"))
    return sizes.where(F.col("reached") >= least).select(*at)


def mask_edge(mask: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Set pixels with an unset 4-neighbour."""
    at = [*keys, "y", "x"]
    cells = mask.select(*at).distinct()
    sides = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))))
    near = cells.withColumn("d", F.explode(sides)).select(*at, (F.col("y") + F.col("d.dy")).alias("ny"), (F.col("x") + F.col("d.dx")).alias("nx"))
    there = cells.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"))
    return near.join(there, [*keys, "ny", "nx"], "left_anti").select(*at).distinct()


def distance_field(pixels: DataFrame, mask: str, metres: int = 10, ceiling: int = 255, keys: tuple[str, ...] = ()) -> DataFrame:
    """Metres from each pixel (y, x, mask; a row a pixel) to the nearest set one, saturated at the ceiling.

    Exact by coordinates, so pixels may be absent; a null mask is not set, and rows without a place are dropped. A pixel
    goes to the square of TILE pixels that holds it, a set one also to the squares within reach; farther ones cannot
    matter, as the result saturates. A square is the unit of work: distances within its columns first, then along its
    lines the lower envelope of the parabolas that stand on them, over the offsets within reach. One shuffle; work grows
    with the squares that hold pixels, whatever the picture's height.
    """
    reach = ceiling // metres + 1
    tile = max(TILE, reach)

    def squares(table: pa.Table) -> pa.Table:
        far = 1 << 40
        ty, tx = table["_ty"][0].as_py(), table["_tx"][0].as_py()
        y = table["y"].to_numpy().astype(np.int64) - (ty * tile - reach)
        x = table["x"].to_numpy().astype(np.int64) - (tx * tile - reach)
        is_set = table["_set"].to_numpy()
        side = tile + 2 * reach
        grid = np.zeros((side, side), bool)
        grid[y[is_set], x[is_set]] = True
        line = np.arange(side)[:, None]
        above = line - np.maximum.accumulate(np.where(grid, line, -far), axis=0)
        below = np.minimum.accumulate(np.where(grid, line, far)[::-1], axis=0)[::-1] - line
        down = np.minimum(above, below)[reach : reach + tile]
        square = np.where(down <= reach, down * down, far)
        best = np.full((tile, tile), far)
        for k in range(2 * reach + 1):
            np.minimum(best, square[:, k : k + tile] + (k - reach) ** 2, out=best)
        own = table["_own"].to_numpy()
        found = np.sqrt(best[y[own] - reach, x[own] - reach].astype(float)) * metres
        kept_rows = table.filter(table["_own"]).select([*keys, "y", "x"])
        return kept_rows.append_column("metres", pa.array(np.floor(np.minimum(found, ceiling) + 0.5).astype(np.int32)))

    at = lambda c, shift: F.floor((F.col(c) + shift) / tile).cast("int")
    here = F.struct(at("y", 0).alias("ty"), at("x", 0).alias("tx"))
    span = lambda c: F.sequence(at(c, -reach), at(c, reach))
    near = F.flatten(F.transform(span("y"), lambda ty: F.transform(span("x"), lambda tx: F.struct(ty.alias("ty"), tx.alias("tx")))))
    is_set = F.coalesce(F.col(mask), F.lit(False))
    rows = pixels.where(F.col("y").isNotNull() & F.col("x").isNotNull()).select(*keys, "y", "x", is_set.alias("_set"), F.explode(F.when(is_set, near).otherwise(F.array(here))).alias("_t"), here.alias("_h"))
    rows = rows.select(*keys, "y", "x", "_set", (F.col("_t") == F.col("_h")).alias("_own"), F.col("_t.ty").alias("_ty"), F.col("_t.tx").alias("_tx"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keys, "y", "x"]) + ", metres int"
    return rows.groupBy(*keys, "_ty", "_tx").applyInArrow(squares, schema)


def flip_diagnosis(layers: DataFrame, a: str, b: str, height: int, width: int) -> DataFrame:
    """Share of pixels where mask a equals mask b as it is, upside down, mirrored and turned."""
    moved = {"as_is": (F.col("y"), F.col("x")), "upside_down": (height - 1 - F.col("y"), F.col("x")), "mirrored": (F.col("y"), width - 1 - F.col("x")), "turned": (height - 1 - F.col("y"), width - 1 - F.col("x"))}
    other = layers.select(F.explode(F.array(*(F.struct(F.lit(n).alias("pose"), y.cast("int").alias("y"), x.cast("int").alias("x")) for n, (y, x) in moved.items()))).alias("p"), F.col(b).alias("other"))
    joined = layers.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col(a).alias("own")).join(other.select("p.*", "other"), ["y", "x"])
    return joined.groupBy("pose").agg(F.avg((F.col("own") == F.col("other")).cast("double")).alias("match"))


def resample(target: DataFrame, source: DataFrame, factor: int, bands: list[str]) -> DataFrame:
    """Nearest neighbour onto a grid `factor` times finer; never an average."""
    at = target.select("y", "x", F.floor(F.col("y") / factor).cast("int").alias("sy"), F.floor(F.col("x") / factor).cast("int").alias("sx"))
    return at.join(source.select(F.col("y").alias("sy"), F.col("x").alias("sx"), *bands), ["sy", "sx"], "left").select("y", "x", *bands)


def overlay(one: DataFrame, other: DataFrame, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Two co-registered layers as one wide table, pixel by pixel; a pixel that one of them lacks has nulls there."""
    return one.join(other, list(keys), "full")


def dimensions(layers: DataFrame) -> DataFrame:
    """layer, height, width, same: the size of each layer (layer, y, x), and whether it is that of the first by name."""
    sizes = layers.groupBy("layer").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    first = sizes.agg(F.min_by(F.struct("height", "width"), "layer").alias("_f"))
    return sizes.join(F.broadcast(first)).select("layer", "height", "width", ((F.col("height") == F.col("_f.height")) & (F.col("width") == F.col("_f.width"))).alias("same"))


def clip(pixels: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """The pixels of a rectangle, its lower and right edges left out. After neighbourhood operators, never before: what
    lies outside still counts for what is inside."""
    return pixels.where(F.col("y").between(top, bottom - 1) & F.col("x").between(left, right - 1))


def unmask(pixels: DataFrame, values: dict[str, object]) -> DataFrame:
    """Masked (null) bands replaced. Before clipping, so that a hole does not read as a distance of 0."""
    return pixels.withColumns({band: F.coalesce(F.col(band), F.lit(v)) for band, v in values.items()})


def self_mask(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Bands that are 0 become masked."""
    return pixels.withColumns({b: F.nullif(F.col(b), F.lit(0)) for b in bands})


def export_contract(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """band, least, most, fractions, holes, ok: a packed layer is written as it is, so its bands must be whole bytes.

    Nothing is rescaled on the way out; what does not fit is reported instead.
    """
    each = [
        F.struct(F.lit(b).alias("band"), F.min(b).cast("double").alias("least"), F.max(b).cast("double").alias("most"), F.count_if(F.col(b) != F.floor(F.col(b))).alias("fractions"), F.count_if(F.col(b).isNull()).alias("holes"))
        for b in bands
    ]
    rows = pixels.agg(F.array(*each).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return rows.withColumn("ok", F.coalesce((F.col("least") >= 0) & (F.col("most") <= 255) & (F.col("fractions") == 0) & (F.col("holes") == 0), F.lit(False)))


def figures(pixels: DataFrame, pixel_ha: float) -> DataFrame:
    """One row: hectares that were and are water, their difference and its share, and those lost and built on."""
    masks = ["historic", "present", "lost", "encroached"]
    sums = pixels.agg(*((F.coalesce(F.sum(F.col(m).cast("bigint")), F.lit(0)) * pixel_ha).alias(f"{m}_ha") for m in masks))
    gone = F.col("historic_ha") - F.col("present_ha")
    return sums.withColumns({"difference_ha": gone, "difference_share": F.try_divide(gone, F.col("historic_ha"))})


def select_bands(pixels: DataFrame, pattern: str, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """The keys and the bands whose whole name fits the pattern."""
    return pixels.select(*keys, pixels.colRegex(f"`(?!(?:{'|'.join(keys)})$){pattern}`"))


def above_minimum(pixels: DataFrame, band: str, ceiling: int = 255) -> DataFrame:
    """Whole units of a band above its least value in the table, clamped to a byte. The minimum is one broadcast row."""
    least = pixels.agg(F.min(band).alias("_least"))
    above = F.least(F.greatest(F.col(band) - F.col("_least"), F.lit(0)), F.lit(ceiling))
    return pixels.join(F.broadcast(least)).withColumn("above_min", F.floor(above + 0.5).cast("smallint")).drop("_least")
