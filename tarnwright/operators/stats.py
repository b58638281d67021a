"""Histograms, thresholds and scores on spatially held-out blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def block_of(y: Column, x: Column, height: int, width: int, across: int, down: int) -> Column:
    """The block of a pixel, in row-major order."""
    return (F.floor(y * down / F.lit(height)) * across + F.floor(x * across / F.lit(width))).cast("int")


def histogram(values: DataFrame, column: str) -> DataFrame:
    """bin (0 to 255), n: equal bins over -1..1, the right edge closed, other values left out."""
    v = F.col(column)
    at = F.when(v == 1, BINS - 1).otherwise(F.floor((v + 1) / 2 * BINS)).cast("int")
    return values.where(v.between(-1, 1)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def centre(bin: Column) -> Column:
    return (bin + 0.5) / (BINS / 2) - 1


def otsu(hist: DataFrame) -> DataFrame:
    """threshold, bin and between-class variance: the first bin that maximises it. Sums are of whole numbers.

    The histogram has at most 256 rows, so the ordered sums are in one task whatever the input's size.
    """
    spark = hist.sparkSession
    every = spark.range(BINS).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(hist), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    so_far = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    sums = every.select(
        "bin", F.sum("n").over(so_far).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(so_far).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("bin")).over(whole).alias("s")
    )
    w1, s1 = F.col("w") - F.col("w0"), F.col("s") - F.col("s0")
    gap = F.col("s0") / F.greatest("w0", F.lit(1)) - s1 / F.greatest(w1, F.lit(1))
    between = F.col("w0").cast("double") * w1 * F.pow(gap / (BINS / 2), 2)
    best = sums.select("bin", between.alias("between")).agg(F.min_by("bin", F.struct(-F.col("between"), F.col("bin"))).alias("bin"), F.max("between").alias("between"))
    return best.select("bin", centre(F.col("bin")).alias("threshold"), "between")


def _scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Null where nothing is there to be scored."""
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return {"iou": F.try_divide(tp, tp + fp + fn), "precision": precision, "recall": recall, "f1": F.try_divide(2 * precision * recall, precision + recall)}


def confusion(rows: DataFrame, predicted: str, truth: str, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn and the scores, of all rows or by the given columns."""
    p, t = F.col(predicted), F.col(truth)
    counts = rows.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    return counts.withColumns(_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def block_scores(rows: DataFrame, predicted: str, truth: str, block: str = "block", least: int = 100) -> DataFrame:
    """Scores of blocks with at least `least` pixels and something to find."""
    scored = confusion(rows, predicted, truth, (block,))
    return scored.where((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") >= least) & (F.col("tp") + F.col("fn") > 0))


def holdout_spread(rows: DataFrame, splits: DataFrame, predicted: str, truth: str, block: str = "block", least: int = 100) -> DataFrame:
    """A row a seed: pooled IoU and the median over blocks; splits: seed, block held out.

    Blocks are counted once; the splits meet these counts, not the pixels.
    """
    counts = confusion(rows, predicted, truth, (block,)).select(block, "tp", "fp", "fn", "tn")
    held = counts.join(splits, block)
    iou = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn"))
    usable = (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") >= least) & (F.col("tp") + F.col("fn") > 0)
    return held.groupBy("seed").agg(
        F.try_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fp") + F.col("fn"))).alias("pooled_iou"),
        F.median(F.when(usable, iou)).alias("median_block_iou"),
        F.count_if(usable).alias("blocks"),
    )


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement: those with the smallest digest of seed and key, the smaller key on a tie."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def hold_out(spark, blocks: int, k: int, seeds: list[int]) -> DataFrame:
    """seed, block: k of the blocks a seed, those with the smallest digest of both."""
    rows = spark.range(blocks * len(seeds)).select(F.get(F.array(*map(F.lit, seeds)), (F.col("id") % len(seeds)).cast("int")).alias("seed"), F.floor(F.col("id") / len(seeds)).cast("int").alias("block"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.md5(F.concat_ws(":", "seed", "block")), "block"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("seed", "block")


def hold_out_of(blocks: DataFrame, column: str, k: int, seeds: list[int]) -> DataFrame:
    """seed, and k of a table's blocks for each seed, those with the smallest digest of both. No seed is sorted whole."""
    out = None
    for seed in seeds:
        some = sample(blocks.select(column), column, k, seed).select(F.lit(seed).alias("seed"), column)
        out = some if out is None else out.unionByName(some)
    return out


def spread(seeds: DataFrame, columns: list[str]) -> DataFrame:
    """figure, least, most, median of each column over the seeds: the range is the result, not the best draw."""
    rows = seeds.select(F.explode(F.array(*(F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("v")) for c in columns))).alias("r")).select("r.*")
    return rows.where("v is not null").groupBy("figure").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.median("v").alias("median"), F.count("*").alias("draws"))


def moments(rows: DataFrame, column: str) -> DataFrame:
    """One row: median, mean, population standard deviation and number of the values."""
    return rows.agg(F.median(column).alias("median"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.count(column).alias("n"))
