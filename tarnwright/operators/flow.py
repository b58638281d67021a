"""Flow direction as a graph: cells (ix, iy, d8, inside) step to one of eight neighbours; iy grows north.

Codes: 0 no data, 1 to 8 clockwise from east, 9 a mouth, 10 a depression.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwright.sources.tables import kept

#: Steps of the codes 1 to 8: east, south-east, south, south-west, west, north-west, north, north-east.
STEPS = {1: (1, 0), 2: (1, -1), 3: (0, -1), 4: (-1, -1), 5: (-1, 0), 6: (-1, 1), 7: (0, 1), 8: (1, 1)}
MOST_STEPS, CELL_M = 200, 90


def target(code: Column, axis: int) -> Column:
    out = F.lit(None).cast("int")
    for c, step in STEPS.items():
        out = F.when(code == c, step[axis]).otherwise(out)
    return out


def edges(cells: DataFrame) -> DataFrame:
    """ix, iy, tx, ty of the cells that flow."""
    return cells.where(F.col("d8").between(1, 8)).select("ix", "iy", (F.col("ix") + target(F.col("d8"), 0)).cast("bigint").alias("tx"), (F.col("iy") + target(F.col("d8"), 1)).cast("bigint").alias("ty"))


def _twice(jump: DataFrame) -> DataFrame:
    """A table of jumps (ix, iy, tx, ty) joined with itself: twice as many steps at once."""
    far = jump.select(F.col("ix").alias("tx"), F.col("iy").alias("ty"), F.col("tx").alias("fx"), F.col("ty").alias("fy"))
    return jump.join(far, ["tx", "ty"]).select("ix", "iy", F.col("fx").alias("tx"), F.col("fy").alias("ty"))


def _jumps(step: DataFrame, rounds: int) -> Iterator[DataFrame]:
    """Tables of 1, 4, 16, ... steps at once; each is written, so that plans do not grow."""
    one = kept(step, "jumps")
    yield one
    for _ in range(rounds - 1):
        one = kept(_twice(_twice(one)), "jumps")
        yield one


def _steps(cells: DataFrame) -> DataFrame:
    """The edges between cells inside the study area."""
    inside = cells.where("inside")
    return edges(inside).join(inside.select(F.col("ix").alias("tx"), F.col("iy").alias("ty")), ["tx", "ty"], "left_semi").select("ix", "iy", "tx", "ty")


def trace(cells: DataFrame, starts: DataFrame, most: int = MOST_STEPS, stop_at_trunk: float | None = None) -> DataFrame:
    """trace_id, step, ix, iy, d8 of every route from starts (trace_id, ix, iy), and how it ended (on its last row).

    Where the next cell was met before, the route ends as `loop`; off the frame or the study area as `edge`; at codes
    9, 10 and other ones as `mouth`, `depression`, `nodata`; after `most` cells as `capped`; with stop_at_trunk (km2,
    column upa) at a trunk channel as `trunk`. Starts outside the study area have no row.

    All routes advance together: the cells at the steps from n to 2 n - 1 are those before, moved by a jump of n steps.
    So a few joins give whole routes of any length up to `most`, a row is made for each cell of a route and no more, and
    following stops when no route goes on.
    """
    flowing = cells if stop_at_trunk is None else cells.where(~(F.coalesce("upa", F.lit(0.0)) > stop_at_trunk))
    step = edges(flowing.where("inside")).join(cells.where("inside").select(F.col("ix").alias("tx"), F.col("iy").alias("ty")), ["tx", "ty"], "left_semi").select("ix", "iy", "tx", "ty")
    at = starts.select("trace_id", F.col("ix").cast("bigint").alias("ix"), F.col("iy").cast("bigint").alias("iy"))
    at = at.join(cells.where("inside").select("ix", "iy"), ["ix", "iy"], "left_semi")
    parts, n = [kept(at.select("trace_id", F.lit(0).alias("step"), "ix", "iy"), "route")], 1

    def moved(rows: DataFrame, jump: DataFrame, steps: int) -> DataFrame:
        far = rows.join(jump, ["ix", "iy"]).select("trace_id", (F.col("step") + F.lit(steps)).alias("step"), F.col("tx").alias("ix"), F.col("ty").alias("iy"))
        return far.where(F.col("step") < most)

    for jump in _jumps(step, -(-max(1, (most - 1).bit_length()) // 2)):
        before = reduce(DataFrame.unionByName, parts)
        next_ones = moved(before, jump, n)
        part = kept(next_ones.unionByName(moved(before.unionByName(next_ones), _twice(jump), 2 * n)), "route")
        if part.isEmpty():
            break
        parts.append(part)
        n *= 4
    at = reduce(DataFrame.unionByName, parts)
    first = F.min("step").over(Window.partitionBy("trace_id", "ix", "iy"))
    at = at.withColumn("again", F.when(F.col("step") > first, F.col("step")))
    whole = Window.partitionBy("trace_id")
    at = at.withColumn("looped", F.min("again").over(whole)).where(F.col("looped").isNull() | (F.col("step") < F.col("looped")))
    upa = [c for c in ("upa",) if stop_at_trunk is not None]
    at = at.join(cells.select("ix", "iy", "d8", *upa), ["ix", "iy"]).withColumn("last", F.max("step").over(whole) == F.col("step"))
    how = F.when(F.col("upa") > stop_at_trunk, "trunk").when(F.col("d8") == 9, "mouth") if upa else F.when(F.col("d8") == 9, "mouth")
    how = how.when(F.col("d8") == 10, "depression").when(~F.col("d8").between(1, 8), "nodata").when(F.col("step") >= most - 1, "capped").when(F.col("looped").isNotNull(), "loop").otherwise("edge")
    return at.withColumn("how", F.when(F.col("last"), how)).select("trace_id", "step", "ix", "iy", "d8", "how")


def endings(traced: DataFrame) -> DataFrame:
    """Routes and cells by the way they ended."""
    ends = traced.where("how is not null")
    return ends.groupBy("how").agg(F.count("*").alias("routes"), F.sum(F.col("step") + 1).alias("cells"))


def terminals(cells: DataFrame) -> DataFrame:
    """ix, iy, tx, ty, looped: where each cell's flow ends, however long its route; it stays where it ends.

    Flow that never ends goes round a cycle, which is named by its smallest cell (by iy, then ix); looped tells so.
    Jumps are doubled while any cell has not arrived: if after n steps m cells have not, those that ever will have done
    so after n + m, since the route of one that still flows passes only such cells. The rest lies on cycles or runs into
    one. So the number of rounds is logarithmic in the longest route.
    """
    inside = cells.where("inside").select("ix", "iy")
    step = kept(inside.join(_steps(cells), ["ix", "iy"], "left").select("ix", "iy", F.coalesce("tx", "ix").alias("tx"), F.coalesce("ty", "iy").alias("ty")), "steps")
    ends = step.where("ix = tx and iy = ty").select("tx", "ty")
    jump, n, enough = step, 1, None
    while True:
        open_ = jump.join(ends, ["tx", "ty"], "left_anti")
        left = open_.count()
        if not left:
            return jump.withColumn("looped", F.lit(False))
        enough = n + left if enough is None else min(enough, n + left)
        if n >= enough:
            break
        jump, n = kept(_twice(_twice(jump)), "jumps"), 4 * n
    names = _cycle_names(step.join(open_.select(F.col("tx").alias("ix"), F.col("ty").alias("iy")).distinct(), ["ix", "iy"], "left_semi"))
    looped = open_.join(names, ["tx", "ty"]).select("ix", "iy", F.col("name.ix").alias("tx"), F.col("name.iy").alias("ty"), F.lit(True).alias("looped"))
    arrived = jump.join(ends, ["tx", "ty"], "left_semi").select("ix", "iy", "tx", "ty", F.lit(False).alias("looped"))
    return arrived.unionByName(looped)


def _cycle_names(ring: DataFrame) -> DataFrame:
    """tx, ty, name: the smallest cell of the cycle of each cell, where all cells (ix, iy, tx, ty) lie on cycles."""
    cell = lambda x, y: F.struct(F.col(y).alias("iy"), F.col(x).alias("ix"))
    rows = kept(ring.withColumn("name", cell("ix", "iy")), "cycles")
    size, n = rows.count(), 1
    while n < size:
        far = rows.select(F.col("ix").alias("tx"), F.col("iy").alias("ty"), F.col("tx").alias("fx"), F.col("ty").alias("fy"), F.col("name").alias("other"))
        rows, n = kept(rows.join(far, ["tx", "ty"]).select("ix", "iy", F.col("fx").alias("tx"), F.col("fy").alias("ty"), F.least("name", "other").alias("name")), "cycles"), 2 * n
    return rows.select(F.col("ix").alias("tx"), F.col("iy").alias("ty"), "name")


def monotonicity(traced: DataFrame, value: str, tolerance: int = 1, least_cells: int = 3) -> DataFrame:
    """A route's steps, falls beyond the tolerance, and whether it ends higher than (or as high as) it began."""
    order = Window.partitionBy("trace_id").orderBy("step")
    stepped = traced.withColumn("_before", F.lag(value).over(order))
    out = stepped.groupBy("trace_id").agg(
        F.count("*").alias("cells"),
        F.count("_before").alias("steps"),
        F.count_if(F.col(value) < F.col("_before") - tolerance).alias("falls"),
        F.min_by(value, "step").alias("first"),
        F.max_by(value, "step").alias("last"),
    )
    out = out.where(F.col("cells") >= least_cells)
    return out.withColumns({"grew": F.col("last") > F.col("first"), "held": F.col("last") >= F.col("first")})


def route_length(traced: DataFrame, cell_m: float = CELL_M) -> DataFrame:
    """Metres of each route; diagonal steps are longer by the square root of two."""
    step = F.when(F.col("how").isNotNull(), 0.0).when(F.col("d8") % 2 == 0, cell_m * 2**0.5).otherwise(F.lit(float(cell_m)))
    return traced.groupBy("trace_id").agg(F.sum(step).alias("metres"))


def receiving(traced: DataFrame, upstream: DataFrame, k: int = 3) -> DataFrame:
    """The k cells of each route with most upstream area (ix, iy, upa), the nearer first on a tie."""
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.col("upa").desc(), "step"))
    rows = traced.join(upstream.select("ix", "iy", "upa"), ["ix", "iy"]).withColumn("rank", rank)
    return rows.where(F.col("rank") <= k).select("trace_id", "rank", "ix", "iy", "upa")


def agreement(traced: DataFrame, cells: DataFrame, block: str = "block", mask: str = "on_flow") -> DataFrame:
    """By seed and block: traced cells (seed, ix, iy), and how many of them lie on the mask; cells: ix, iy, block, mask.

    A cell counts as often as routes pass it.
    """
    rows = traced.join(cells.select("ix", "iy", block, mask), ["ix", "iy"])
    return rows.groupBy("seed", block).agg(F.count("*").alias("cells"), F.count_if(mask).alias("hits"))


def agreement_summary(blocks: DataFrame, least_cells: int = 100) -> DataFrame:
    """A row a seed: blocks with enough traced cells, and the median, least and greatest share on the mask."""
    live = blocks.where(F.col("cells") >= least_cells).withColumn("share", F.col("hits") / F.col("cells"))
    return live.groupBy("seed").agg(
        F.count("*").alias("blocks"), F.sum("cells").alias("cells"), F.median("share").alias("median"), F.min("share").alias("least"), F.max("share").alias("most")
    )
