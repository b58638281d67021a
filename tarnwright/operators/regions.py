"""Regions of set pixels: their labels, outlines and polygons, whatever their size, tile by tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwright.operators.raster import TILE
from tarnwright.sources.tables import kept

#: The sides of a pixel, clockwise from the top: the step along each, with the pixel on its right.
STEP_Y, STEP_X = (0, 1, 0, -1), (1, 0, -1, 0)
PIECE = (
    "sy int, sx int, side int, ny int, nx int, nside int, closed boolean, points array<struct<x: int, y: int>>, "
    "doubled long, length long, first struct<x: int, y: int>"
)


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of 0..n-1 that each is linked with, by links a[i] - b[i]."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _schema(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def labelled(mask: DataFrame, keys: tuple[str, ...] = (), eight: bool = False, tile: int = TILE) -> DataFrame:
    """y, x, ly, lx (and keys) of each set pixel (y, x): the first pixel, by line, of the region it belongs to.

    Pixels are linked by their sides, with `eight` by their corners too. A tile's own pixels are labelled in one task;
    labels that meet across a seam are edges of a graph, which has a node for each label at a seam and is contracted by
    stars in joins. So a region may be of any size, and nothing follows it pixel by pixel. Repeated pixels count once,
    rows without a place are dropped, a null key is an area like others.
    """

    def within(table: pa.Table) -> pa.Table:
        y, x = table["y"].to_numpy().astype(np.int64), table["x"].to_numpy().astype(np.int64)
        top, left = y.min(), x.min()
        wide = int(x.max() - left) + 3
        order = np.lexsort((x, y))
        place = np.full((int(y.max() - top) + 3) * wide, -1, np.int64)
        at = (y[order] - top + 1) * wide + x[order] - left + 1
        place[at] = np.arange(len(at))
        near = [place[at + s] for s in ((1, wide, wide + 1, wide - 1) if eight else (1, wide))]
        ends = [np.nonzero(other >= 0)[0] for other in near]
        root = components(len(at), np.concatenate(ends), np.concatenate([o[e] for o, e in zip(near, ends, strict=True)]))
        first = order[root]
        back = np.empty(len(at), np.int64)
        back[order] = first
        out = table.select([*keys, "y", "x"])
        return out.append_column("ly", pa.array(y[back].astype(np.int32))).append_column("lx", pa.array(x[back].astype(np.int32)))

    at = [*keys, "y", "x"]
    cells = mask.where("y IS NOT NULL AND x IS NOT NULL").select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    tiled = cells.withColumns({"_ty": F.floor(F.col("y") / tile), "_tx": F.floor(F.col("x") / tile)})
    local = kept(tiled.groupBy(*keys, "_ty", "_tx").applyInArrow(within, _schema(cells, at) + "ly int, lx int"), "labels")

    # What meets across a seam.
    on = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    node = F.struct(*keys, "ly", "lx")
    seam = local.where(on("y") | on("x")).select(F.struct(*keys).alias("k") if keys else F.lit(0).alias("k"), "y", "x", node.alias("node"))
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), *(((1, 1), (1, -1)) if eight else ()))))
    near = seam.withColumn("d", F.explode(steps)).select("k", "y", "x", (F.col("y") + F.col("d.dy")).alias("by"), (F.col("x") + F.col("d.dx")).alias("bx"), F.col("node").alias("u"))
    tile_of = lambda c: F.floor(F.col(c) / tile)
    near = near.where((tile_of("y") != tile_of("by")) | (tile_of("x") != tile_of("bx"))).select("k", "by", "bx", "u")
    met = F.col("n.k").eqNullSafe(F.col("s.k")) & (F.col("n.by") == F.col("s.y")) & (F.col("n.bx") == F.col("s.x"))
    edges = near.alias("n").join(seam.alias("s"), met).select("u", F.col("node").alias("v")).where("NOT u <=> v").distinct()
    names = stars(edges)
    told = local.withColumn("_node", node).alias("p").join(names.alias("n"), F.col("_node").eqNullSafe(F.col("n.node")), "left")
    return told.select(*at, F.coalesce("name.ly", "ly").alias("ly"), F.coalesce("name.lx", "lx").alias("lx"))


def stars(edges: DataFrame) -> DataFrame:
    """node, name: for each node of a graph (edges u, v of any type that has an order) but the first of its component, that first one.

    Large and small stars in turn (Kiveris and others, 2014) until nothing changes: each round hands every node's
    neighbours to its smallest one. Rounds grow with the logarithm of the nodes; no neighbourhood is ever in one row.
    """
    rows = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(rows)
    while before[0]:
        # Each node's larger neighbours go to the smallest of its neighbours and itself.
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        rows = kept(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        # Its smaller neighbours and itself go to the smallest of them.
        least = rows.groupBy("u").agg(F.min("v").alias("m"))
        small = rows.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        rows = kept(small.where("u <> v").distinct(), "edges")
        after = mark(rows)
        if after == before:
            break
        before = after
    return rows.select(F.col("u").alias("node"), F.col("v").alias("name"))


def outlines(labels: DataFrame, keys: tuple[str, ...] = (), eight: bool = False, tile: int = TILE) -> DataFrame:
    """The outlines of labelled() regions, as pieces in order: ly, lx (and keys), ring, place, points, doubled, length, corners.

    Sides between a set pixel and one that is not run clockwise round the set one (x to the right, y down), so outer
    rings have a positive area and holes a negative one; `doubled` is a piece's part of twice that area, `length` its
    sides. `points` are the corners it passes, where the direction changes. A ring is named by its first side (y, x,
    side), its pieces are numbered by `place` from that one on. Pass the same `eight` as to labelled().

    A tile's sides are followed in one task, with one more pixel around it, until they leave it. What is left is a
    permutation of pieces: rings are named and pieces ranked by doubling, so rounds grow with the logarithm of the
    pieces of the longest ring.
    """

    def followed(table: pa.Table) -> pa.Table:
        ty, tx = table["_ty"][0].as_py(), table["_tx"][0].as_py()
        y = table["y"].to_numpy().astype(np.int64) - ty * tile + 1
        x = table["x"].to_numpy().astype(np.int64) - tx * tile + 1
        grid = np.zeros((tile + 2, tile + 2), bool)
        grid[y, x] = True
        own = table["_own"].to_numpy()
        ids = np.nonzero(own)[0]
        row_of = np.full((tile + 2, tile + 2), -1, np.int64)
        row_of[y[own], x[own]] = ids
        # Side s of a pixel is open if the pixel beyond it (north, east, south, west) is not set.
        out_y, out_x = (-1, 0, 1, 0), (0, 1, 0, -1)
        following: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        oy, ox = y[own], x[own]
        for s in range(4):
            open_ = ~grid[oy + out_y[s], ox + out_x[s]]
            py, px = oy[open_], ox[open_]
            ay, ax = py + STEP_Y[s], px + STEP_X[s]
            ahead = grid[ay, ax]
            across = grid[ay + out_y[s], ax + out_x[s]]
            left = across & (ahead | eight)
            straight = ahead & ~left
            ny = np.where(left, ay + out_y[s], np.where(straight, ay, py))
            nx = np.where(left, ax + out_x[s], np.where(straight, ax, px))
            ns = np.where(left, (s + 3) % 4, np.where(straight, s, (s + 1) % 4))
            for a, b, c, d, e in zip(py.tolist(), px.tolist(), ny.tolist(), nx.tolist(), ns.tolist(), strict=True):
                following[a, b, s] = (c, d, e)
        entered = set(following) - set(following.values())
        dy, dx = ty * tile - 1, tx * tile - 1
        begin_y, begin_x = (0, 0, 1, 1), (0, 1, 1, 0)
        pieces: dict[str, list] = {n: [] for n in ("row", "sy", "sx", "side", "ny", "nx", "nside", "closed", "points", "doubled", "length", "first")}

        def follow(start: tuple[int, int, int]) -> None:
            edge, points, doubled, length = start, [], 0, 0
            while True:
                after = following.pop(edge)
                s = edge[2]
                by, bx = edge[0] + begin_y[s] + dy, edge[1] + begin_x[s] + dx
                ey, ex = by + STEP_Y[s], bx + STEP_X[s]
                doubled += bx * ey - ex * by
                length += 1
                if after[2] != s:
                    points.append({"x": ex, "y": ey})
                edge = after
                if edge not in following:
                    break
            values = (
                int(row_of[start[0], start[1]]), start[0] + dy, start[1] + dx, start[2], edge[0] + dy, edge[1] + dx, edge[2], edge == start, points,
                doubled, length, {"x": start[1] + begin_x[start[2]] + dx, "y": start[0] + begin_y[start[2]] + dy},
            )
            for n, v in zip(pieces, values, strict=True):
                pieces[n].append(v)

        for start in sorted(entered):
            follow(start)
        for start in sorted(following):  # rings that never leave the tile, from their first side on
            if start in following:
                follow(start)
        rows = table.select([*keys, "ly", "lx"]).take(pa.array(pieces.pop("row"), pa.int64()))
        place = pa.struct([("x", pa.int32()), ("y", pa.int32())])
        kinds = {"closed": pa.bool_(), "points": pa.list_(place), "doubled": pa.int64(), "length": pa.int64(), "first": place}
        for n, v in pieces.items():
            rows = rows.append_column(n, pa.array(v, kinds.get(n, pa.int32())))
        return rows

    at = lambda c, shift: F.floor((F.col(c) + shift) / tile).cast("int")
    span = lambda c: F.array_distinct(F.array(at(c, -1), at(c, 0), at(c, 1)))
    near = F.flatten(F.transform(span("y"), lambda a: F.transform(span("x"), lambda b: F.struct(a.alias("ty"), b.alias("tx")))))
    here = F.struct(at("y", 0).alias("ty"), at("x", 0).alias("tx"))
    rows = labels.select(*keys, "y", "x", "ly", "lx", F.explode(near).alias("_t"), here.alias("_h"))
    rows = rows.select(*keys, "y", "x", "ly", "lx", (F.col("_t") == F.col("_h")).alias("_own"), F.col("_t.ty").alias("_ty"), F.col("_t.tx").alias("_tx"))
    found = rows.groupBy(*keys, "_ty", "_tx").applyInArrow(followed, _schema(labels, [*keys, "ly", "lx"]) + PIECE)
    side = lambda a, b, c: F.struct(F.col(a).alias("y"), F.col(b).alias("x"), F.col(c).alias("side"))
    key = (F.struct(*keys) if keys else F.lit(0)).alias("k")
    pieces = kept(found.select(key, *keys, "ly", "lx", side("sy", "sx", "side").alias("begin"), side("ny", "nx", "nside").alias("after"), "closed", "points", "doubled", "length"), "pieces")
    order = _ranked(pieces.where("NOT closed").select("k", "begin", "after", F.struct("ly", "lx").alias("label")))
    placed = pieces.alias("p").join(order.alias("o"), F.col("p.k").eqNullSafe(F.col("o.k")) & (F.col("p.begin") == F.col("o.begin")), "left")
    ring, place = F.coalesce("o.ring", "p.begin").alias("ring"), F.coalesce("o.place", F.lit(0).cast("bigint")).alias("place")
    return placed.select(*(F.col(f"p.{c}") for c in (*keys, "ly", "lx")), ring, place, "points", "doubled", "length", F.size("points").alias("corners"))


def _ranked(pieces: DataFrame) -> DataFrame:
    """k, begin, ring, place: of each piece that leads to another (begin to after) the first of its ring and its place from there."""
    same = lambda a, b: F.col(f"{a}.k").eqNullSafe(F.col(f"{b}.k"))
    longest = pieces.groupBy("k", "label").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    rows, n = kept(pieces.select("k", "begin", F.col("after").alias("far"), F.col("begin").alias("ring")), "rings"), 1
    while n < longest:
        joined = rows.alias("a").join(rows.alias("b"), same("a", "b") & (F.col("a.far") == F.col("b.begin")))
        rows, n = kept(joined.select("a.k", "a.begin", F.col("b.far").alias("far"), F.least("a.ring", "b.ring").alias("ring")), "rings"), 2 * n
    named = rows.select("k", "begin", "ring")
    # Each ring ends before its first piece; how far that is, is found by doubling again.
    steps = named.alias("a").join(pieces.alias("b"), same("a", "b") & (F.col("a.begin") == F.col("b.begin")))
    steps = kept(steps.select("a.k", "a.begin", "ring", F.when(F.col("after") != F.col("ring"), F.col("after")).alias("far"), F.lit(1).cast("bigint").alias("left")), "ranks")
    while not steps.where("far IS NOT NULL").isEmpty():
        ahead = steps.select("k", F.col("begin").alias("far"), F.col("far").alias("farther"), F.col("left").alias("more"))
        joined = steps.alias("a").join(ahead.alias("b"), same("a", "b") & (F.col("a.far") == F.col("b.far")), "left")
        steps = kept(joined.select("a.k", "a.begin", "ring", F.col("farther").alias("far"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "ranks")
    first = steps.where("begin = ring").select("k", "ring", F.col("left").alias("all"))
    out = steps.alias("a").join(first.alias("b"), same("a", "b") & (F.col("a.ring") == F.col("b.ring")))
    return out.select("a.k", "a.begin", F.col("a.ring").alias("ring"), (F.col("all") - F.col("left")).alias("place"))


def measures(pieces: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """ly, lx (and keys), area, perimeter, corners, rings of each region, in pixels and their sides, from its outlines()."""
    rows = pieces.groupBy(*keys, "ly", "lx").agg(
        (F.sum("doubled") / 2).cast("bigint").alias("area"), F.sum("length").alias("perimeter"), F.sum("corners").alias("corners"), F.sum((F.col("place") == 0).cast("int")).alias("rings")
    )
    return rows


def polygons(pieces: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """ly, lx (and keys), ring, holes of each region, its corners as (x, y), for coverage(), in_ring() and sinks.

    A polygon is one value, so a row holds a region's corners; what only needs sums should take outlines() or measures().
    """
    rings = pieces.groupBy(*keys, "ly", "lx", F.col("ring").alias("name")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "points"))), lambda p: p["points"])).alias("r"), F.sum("doubled").alias("d")
    )
    outer = lambda is_outer: F.collect_list(F.when((F.col("d") > 0) == is_outer, F.struct("name", "r")))
    found = rings.groupBy(*keys, "ly", "lx").agg(F.element_at(outer(True), 1)["r"].alias("ring"), F.transform(F.array_sort(outer(False)), lambda h: h["r"]).alias("holes"))
    return found.select(*keys, "ly", "lx", "ring", "holes")
