"""BM25 over stored postings: an index in segments, and top-k that reads only blocks which can matter.

A segment is a table of blocks: (term, range, keys, tfs, dls, n, max_tf, min_dl). Documents are dealt to ranges of RANGE
in the order of their lengths, so a block holds the postings of one term in documents of much the same length, and its
two last columns bound what any of them scores. Rows lie by term; a search reads the blocks of its terms only, the four
small columns first. Segments are appended by numbered manifests (sources.versions), which also hold the counts that the
formula needs, so a search begins with whole segments only and all figures are those of the whole index.

Top-k: the bounds of a range's blocks summed over a query's terms bound every document of it. The best FIRST ranges of
each query are scored; their k-th score is a floor, and of the others only ranges whose bound reaches it are scored. What
is left out cannot be among the k best, so the result is that of scoring everything. Nothing is tokenised.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwright.operators.retrieval import K1, MOST_TERMS, B, idf, top
from tarnwright.sources import versions
from tarnwright.sources.tables import kept, numbered

#: Documents whose postings share a block, and ranges of a query that are scored first.
RANGE, FIRST = 128, 16


def append(docs: DataFrame, root: str, key: str, tokens: str) -> int:
    """Adds documents (key, tokens) as a segment and gives its number. Keys must be new to the index.

    Null tokens count as none. A writer that stops leaves no segment; of two at once one is refused (versions.Conflict).
    """
    spark = docs.sparkSession
    number = max(versions.numbers(spark, root), default=0) + 1
    folder = uuid.uuid4().hex
    rows = docs.select(F.col(key).alias("key"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
    rows = numbered(rows.withColumn("dl", F.size("tokens")), ["dl", "key"], "_place").withColumn("range", F.expr(f"CAST(_place DIV {RANGE} AS INT)"))
    counts = rows.select("key", "range", "dl", F.explode("tokens").alias("term")).groupBy("term", "range", "key", "dl").agg(F.count("*").cast("int").alias("tf"))
    blocks = counts.groupBy("term", "range").agg(F.sort_array(F.collect_list(F.struct("key", "tf", "dl"))).alias("p"))
    blocks = blocks.select(
        "term", "range", F.col("p.key").alias("keys"), F.col("p.tf").alias("tfs"), F.col("p.dl").alias("dls"), F.size("p").alias("n"),
        F.array_max("p.tf").alias("max_tf"), F.array_min("p.dl").alias("min_dl"),
    )
    blocks.repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.option("parquet.block.size", 8 << 20).parquet(f"{root}/data/{folder}")
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
    versions.claim(spark, root, number, {"folder": folder, "docs": sums["n"], "words": sums["words"]})
    return number


def opened(spark: SparkSession, root: str) -> tuple[DataFrame, int, float]:
    """The blocks of all segments (with their number), the number of documents, and their mean length."""
    found = {n: versions.manifest(spark, root, n) for n in versions.numbers(spark, root)}
    if not found:
        raise FileNotFoundError(f"no segment at {root}")
    parts = [spark.read.parquet(f"{root}/data/{m['folder']}").withColumn("segment", F.lit(n)) for n, m in found.items()]
    docs = sum(m["docs"] for m in found.values())
    return reduce(DataFrame.unionByName, parts), docs, sum(m["words"] for m in found.values()) / max(1, docs)


def part(tf: Column, dl: Column, mean: float) -> Column:
    """What a term's occurrences in a document weigh, before the term's own weight: grows with tf, falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean)))


def bounds(index: DataFrame, queries: DataFrame, docs: int, mean: float) -> tuple[DataFrame, DataFrame]:
    """weights (query, term, weight), and ranges (query, segment, range, most): what no document of a range exceeds."""
    asked = queries.select("query", "term").distinct()
    wanted = [r["term"] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    blocks = index.select("segment", "term", "range", "n", "max_tf", "min_dl")
    if len(wanted) <= MOST_TERMS:  # reaches the scan
        blocks = blocks.where(F.col("term").isin(wanted))
    else:
        blocks = blocks.join(asked.select("term").distinct(), "term", "left_semi")
    blocks = kept(blocks, "blocks")
    df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    weights = kept(asked.join(df, "term").select("query", "term", idf(F.lit(docs), F.col("df")).alias("weight")), "weights")
    each = blocks.join(weights, "term").withColumn("most", F.col("weight") * part(F.col("max_tf"), F.col("min_dl"), mean))
    return weights, kept(each.groupBy("query", "segment", "range").agg(F.sum("most").alias("most")), "ranges")


def scored(index: DataFrame, weights: DataFrame, ranges: DataFrame, mean: float) -> DataFrame:
    """query, key, score of all documents of the ranges (query, segment, range) that hold a term of the query."""
    wanted = [r["term"] for r in weights.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    blocks = index.where(F.col("term").isin(wanted)) if len(wanted) <= MOST_TERMS else index
    met = blocks.select("segment", "range", "term", "keys", "tfs", "dls").join(weights, "term").join(ranges.select("query", "segment", "range"), ["query", "segment", "range"])
    rows = met.select("query", "weight", F.explode(F.arrays_zip("keys", "tfs", "dls")).alias("p"))
    rows = rows.select("query", F.col("p.keys").alias("key"), (F.col("weight") * part(F.col("p.tfs"), F.col("p.dls"), mean)).alias("s"))
    return rows.groupBy("query", "key").agg(F.sum("s").alias("score"))


def search(spark: SparkSession, root: str, queries: DataFrame, k: int = 20, digits: int = 6) -> DataFrame:
    """query, key, score, rank: the k best documents of each query (query, term), by rounded score, then key."""
    index, docs, mean = opened(spark, root)
    weights, ranges = bounds(index, queries, docs, mean)
    first, rest = plan(index, weights, ranges, mean, k, digits)
    every = first.unionByName(scored(index, weights, rest, mean))
    return top(every, "key", k, digits).select("query", "key", "score", "rank")


def plan(index: DataFrame, weights: DataFrame, ranges: DataFrame, mean: float, k: int, digits: int) -> tuple[DataFrame, DataFrame]:
    """The scores of the best ranges of each query, and the other ranges that can still hold one of the k best."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("most").desc(), "segment", "range"))
    begun = kept(ranges.withColumn("_p", place).where(F.col("_p") <= FIRST).drop("_p"), "first")
    first = kept(scored(index, weights, begun, mean), "scores")
    floor = top(first, "key", k, digits).where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    left = ranges.join(begun, ["query", "segment", "range"], "left_anti").join(floor, "query", "left")
    return first, kept(left.where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - 2 * 10.0**-digits)).drop("floor"), "rest")
