"""Nearest neighbours at any density: cells of sites against cells of places, level by level, until few places can be nearest.

Sites and places lie in one grid, in which a cell has 4 x 4 cells of the next level. A cell stands for its points by their
box. Of the cells of places that a cell of sites still has, those go whose box lies farther from its box than the farthest
place of another can; the rest are split, if they hold more than LEAF places. A cell of sites is done when all that it has
are small and it has few sites itself. Only then sites meet places. So work follows sites, places and depth, not their
product, and far sites cost a few cells each. Points at the same position are one, of the smaller name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwright.sources.tables import kept

#: Products of positions up to this are compared pair by pair, with at most so many places broadcast.
MOST_PAIRS, MOST_SENT = 1 << 24, 1 << 13
#: Places in a cell that is not split, and sites in a cell that is done.
LEAF, MOST_SITES = 8, 256
#: Bits of a coordinate in the grid, and of them those a level takes.
DEPTH, STEP = 48, 2
#: Bounds give way by this much, so that rounding drops nothing.
SLACK = 1e-9


def _finite(x: str) -> Column:
    return F.abs(F.col(x)) < F.lit(float("inf"))


def _sq(dx: Column, dy: Column) -> Column:
    return dx * dx + dy * dy


def _cells(points: DataFrame, level: int, x: str, y: str, names: tuple[str, str], prefix: str) -> DataFrame:
    """The cells of a level that hold points, with those above, their boxes and their numbers of points."""
    by, c = (DEPTH - STEP * level), F.col
    found = points.groupBy(F.shiftright("gx", by).alias(names[0]), F.shiftright("gy", by).alias(names[1])).agg(
        F.count("*").alias(f"{prefix}n"), *(f(v).alias(f"{prefix}{name}") for v, name in ((x, "x"), (y, "y")) for f, name in ((F.min, f"low_{name}"), (F.max, f"high_{name}")))
    )
    return found.withColumns({f"{n}_above": F.shiftright(c(n), STEP) for n in names})


def _pruned(pairs: DataFrame, reach: float | None) -> DataFrame:
    """Pairs of a cell of sites (qx, qy) and one of places that may hold a nearest place."""
    c = F.col
    apart = lambda v: F.greatest(c(f"p_low_{v}") - c(f"s_high_{v}"), c(f"s_low_{v}") - c(f"p_high_{v}"), F.lit(0.0))
    across = lambda v: F.greatest(c(f"p_high_{v}") - c(f"s_low_{v}"), c(f"s_high_{v}") - c(f"p_low_{v}"))
    least, most = _sq(apart("x"), apart("y")) * F.lit(1 - SLACK), _sq(across("x"), across("y")) * F.lit(1 + SLACK)
    if reach is not None:
        pairs = pairs.where(least <= F.lit(reach * reach))
    return pairs.withColumn("most", F.min(most).over(Window.partitionBy("qx", "qy"))).where(least <= c("most")).drop("most")


def _candidates(s: DataFrame, p: DataFrame, reach: float | None) -> tuple[DataFrame, int]:
    """level, qx, qy, node_level, nx, ny: the cells of places that cells of sites which are done still have; and the last level."""
    c, level, done = F.col, 1, None
    sites, nodes = _cells(s, 1, "x", "y", ("qx", "qy"), "s_"), _cells(p, 1, "px", "py", ("nx", "ny"), "p_")
    boxes = [f"p_{side}_{v}" for v in "xy" for side in ("low", "high")]
    # at most 4 x 4 cells each
    pairs = sites.join(F.broadcast(nodes.withColumn("node_level", F.lit(1))))
    while True:
        splits = (c("p_n") > LEAF) & (c("node_level") == level)
        opened = (splits | (c("s_n") > MOST_SITES)) & F.lit(STEP * level < DEPTH)
        at = kept(_pruned(pairs, reach).withColumn("open", F.max(opened).over(Window.partitionBy("qx", "qy"))), "near")
        ready = at.where(~c("open")).select(F.lit(level).alias("level"), "qx", "qy", "node_level", "nx", "ny")
        done = ready if done is None else done.unionByName(ready)
        left = at.where("open")
        if left.isEmpty():
            return done, level
        left = left.select("qx", "qy", "node_level", "nx", "ny", "p_n", *boxes)
        sites, nodes = _cells(s, level + 1, "x", "y", ("qx", "qy"), "s_"), _cells(p, level + 1, "px", "py", ("nx", "ny"), "p_")
        above = left.where(splits).select(c("qx").alias("qx_above"), c("qy").alias("qy_above"), c("nx").alias("nx_above"), c("ny").alias("ny_above"))
        split = above.join(nodes, ["nx_above", "ny_above"]).withColumn("node_level", F.lit(level + 1))
        same = left.where(~splits).withColumnsRenamed({"qx": "qx_above", "qy": "qy_above"})
        columns = ["qx_above", "qy_above", "node_level", "nx", "ny", "p_n", *boxes]
        pairs = split.select(columns).unionByName(same.select(columns)).join(sites, ["qx_above", "qy_above"]).drop("qx_above", "qy_above")
        level += 1


def _met(s: DataFrame, p: DataFrame, reach: float | None) -> DataFrame:
    """Sites (x, y) beside all places (name, px, py) that may be nearest."""
    c = F.col
    low_x, low_y, high_x, high_y = (
        s.select("x", "y").union(p.select("px", "py")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    )
    span = max(high_x / 2 - low_x / 2, high_y / 2 - low_y / 2) or 1.0
    grid = lambda v, low: F.least(F.floor((c(v) / 2 - F.lit(low / 2)) / F.lit(span) * F.lit(float(1 << DEPTH))).cast("long"), F.lit((1 << DEPTH) - 1))
    s, p = (t.withColumns({"gx": grid(x, low_x), "gy": grid(y, low_y)}) for t, x, y in ((s, "x", "y"), (p, "px", "py")))
    done, last = _candidates(s, p, reach)
    levels = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.shiftright("gx", DEPTH - STEP * i).alias("gx"), F.shiftright("gy", DEPTH - STEP * i).alias("gy")) for i in range(1, last + 1))))
    within = lambda t, *own: t.select(*own, levels.alias("g")).select(*own, "g.*")
    nodes = within(p, "name", "px", "py").withColumnsRenamed({"level": "node_level", "gx": "nx", "gy": "ny"})
    cells = within(s, "x", "y").withColumnsRenamed({"gx": "qx", "gy": "qy"})
    return done.join(nodes, ["node_level", "nx", "ny"]).select("level", "qx", "qy", "name", "px", "py").join(cells, ["level", "qx", "qy"])


def nearest(sites: DataFrame, places: DataFrame, reach: float | None = None) -> DataFrame:
    """site_id, name, distance: of each row of sites (site_id, x, y) the nearest of places (name, px, py), within reach if there is
    one; the smaller name on a tie, a null one last. Null where none is. Positions that are not finite take no part."""
    c = F.col
    sites = sites.select("site_id", c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))
    places = places.select("name", c("px").cast("double").alias("px"), c("py").cast("double").alias("py"))
    s = kept(sites.where(_finite("x") & _finite("y")).select("x", "y").distinct(), "sites")
    p = kept(places.where(_finite("px") & _finite("py")).groupBy("px", "py").agg(F.min("name").alias("name")), "places")
    n_sites, n_places = s.count(), p.count()
    if n_places <= MOST_SENT and n_sites * n_places <= MOST_PAIRS:
        met = s.join(F.broadcast(p))
    else:
        met = _met(s, p, reach)
    met = met.withColumn("sq", _sq(c("x") - c("px"), c("y") - c("py")))
    if reach is not None:
        met = met.where(c("sq") <= F.lit(reach * reach))
    best = met.groupBy("x", "y").agg(F.min(F.struct("sq", F.col("name").isNull().alias("unnamed"), "name")).alias("best"))
    best = best.select("x", "y", "best.name", F.sqrt("best.sq").alias("distance"))
    return sites.join(best, ["x", "y"], "left").select("site_id", "name", "distance")
