"""Exact search for the largest inner products, by elimination with a table of distances to pivots.

Vectors become whole numbers, floor(SCALE * c), and every score is an exact whole number. PIVOTS rows, far from one
another, and the origin are pivots; the distances of every row to all of them are computed once and stored with it.
For a query q and a row o the triangle inequality gives, by every pivot p, |q - o| >= |d(q, p) - d(o, p)|; the greatest
of these lower bounds B gives

    <q, o> = (|q|^2 + |o|^2 - |q - o|^2) / 2 <= (|q|^2 + |o|^2 - B^2) / 2

(the origin alone gives |q| |o|). Rows are stored by their nearest pivot. Blocks of ROW_BLOCK rows know the range of
their distances to each pivot, so one bound counts for a whole block: blocks are visited in the order of these bounds,
each query leaves as soon as no later block can hold anything better (exact stopping), and in a visited block the rows'
own bounds come first, pivot by pivot, so that only the rest is multiplied out. Bounds are taken with a slack above
their rounding; scores are whole numbers, in doubles where all are below 2 ** 53 and in 64-bit integers otherwise.

What a query's k-th best reaches is known before a pass: by the pivots at first, then by a pass over one row in
LEVELS[0], then over one in LEVELS[1] (drawn by a hash of vec_id), so that of the whole table each query gives back some
k * LEVELS[1] rows at most in the mean, however many tasks there are. This changes only what is spared, never what is
found. If vectors lie in clusters, most blocks are spared; vectors that are spread evenly in many dimensions have no
bound that spares anything, and work is queries times rows, as it is for any exact search.

Queries are a stated set; they are sent in blocks of QUERY_BYTES at most, each to all rows. No pair of query and row is
ever a row of a table.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do those whose squared
length in whole numbers is 2 ** 62 or more (their scores need not fit a long), nor rows without vec_id. The dimension is
that of most vectors (the smaller on a tie, empty ones never), others take no part. Zero vectors do. Of repeated rows of
one vec_id the smallest vector asks, and the one with the highest score is found, once. A query never finds its own
vec_id. Empty tables and tables without a query give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hold, materialise, ship

#: Components become floor(SCALE * c); queries are rows whose vec_id is divisible by EVERY.
SCALE, NEIGHBOURS, EVERY = 256, 5, 50
#: Pivots beside the origin, chosen among some rows drawn by hash; one row in so many is searched first.
PIVOTS, DRAWN, LEVELS = 32, 2048, (256, 16)
#: Rows that share a bound, rows that a task holds and orders at once, queries that meet a block's rows at once, queries
#: whose bounds are held at once, and bytes of queries sent to all tasks.
ROW_BLOCK, HELD, SIDE, BOUNDED, QUERY_BYTES = 128, 4096, 64, 4096, 1 << 25
#: Share of a block's pairs from which on all of them are multiplied out together.
DENSE = 0.25
#: Squared lengths below LONG are sure to give scores that fit a long, below EXACT distances without rounding.
LONG, EXACT = 2.0**62, 2.0**51

RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def usable(table: DataFrame) -> DataFrame:
    """vec_id and vector (array of int) of the rows that take part, of whatever dimension."""
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < (2.0**31 - 1) / SCALE))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & fine)
    rows = rows.select("vec_id", F.transform("e", lambda c: F.floor(c * SCALE).cast("int")).alias("vector"))
    return rows.where(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c.cast("double") * c) < LONG)


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind, copy=False)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each row to each pivot; whole numbers below EXACT are exact before the root is taken."""
    f, p = x.astype(float), pivots.astype(float)
    square = (f * f).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (f @ p.T)
    return np.sqrt(np.maximum(square, 0))


def chosen_pivots(rows: DataFrame, total: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of up to PIVOTS rows of distinct ids: of at most twice DRAWN, each is the farthest from those before."""
    share = min(1.0, DRAWN / max(1, total))
    got = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(2**30 * share))).limit(2 * DRAWN).toArrow()
    ids, first = np.unique(got.column("vec_id").to_numpy(), return_index=True)
    x = matrix(got.column("vector").combine_chunks(), dim, np.int64)[first]
    if not len(x):
        return ids, x
    near, taken = distances(x, np.zeros((1, dim)))[:, 0], []
    for _ in range(min(PIVOTS, len(x))):
        far = int(near.argmax())
        if taken and near[far] <= 0:
            break
        taken.append(far)
        near = np.minimum(near, distances(x, x[[far]])[:, 0])
    return ids[taken], x[taken]


class Search:
    """Keeps the k best rows of each query over the rows it is given."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, distance: np.ndarray, floor: np.ndarray, k: int, exact: bool) -> None:
        self.ids, self.queries, self.distance, self.floor, self.k, self.exact = ids, queries, distance, floor, k, exact
        self.factors = queries.astype(float) if exact else queries
        self.length = distance[:, 0]  # to the origin
        self.best = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.found = np.full((len(ids), k), -1, np.int64)
        self.full = np.zeros(len(ids), bool)

    def sure(self, some: np.ndarray | slice) -> np.ndarray:
        """What a row's score must reach to matter."""
        return np.maximum(self.best[some, -1], self.floor[some])

    def upper(self, some: np.ndarray | slice, apart: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Upper bounds of scores from lower bounds of distances (queries by rows) and the greatest lengths of the rows."""
        own = self.length[some][:, None]
        apart = np.maximum(apart - (1e-9 if self.exact else 1e-5) * (own + length), 0)
        squares = own * own + length * length
        return (squares - apart * apart) / 2 + 1e-9 * squares + 1

    def rows(self, ids: np.ndarray, x: np.ndarray, distance: np.ndarray, cell: np.ndarray) -> None:
        """Rows as they are stored, in blocks of one cell."""
        cuts = np.flatnonzero(np.diff(cell, prepend=cell[:1] - 1))
        ends = np.append(cuts[1:], len(ids))
        starts = np.concatenate([np.arange(a, b, ROW_BLOCK) for a, b in zip(cuts, ends, strict=True)])
        stops = np.append(starts[1:], len(ids))
        low, high = np.minimum.reduceat(distance, starts), np.maximum.reduceat(distance, starts)
        factors = x.astype(float) if self.exact else x
        for at in range(0, len(self.ids), BOUNDED):
            some = slice(at, min(at + BOUNDED, len(self.ids)))
            apart = np.zeros((some.stop - at, len(starts)))
            for p in range(distance.shape[1]):
                own = self.distance[some, p][:, None]
                np.maximum(apart, own - high[:, p], out=apart)
                np.maximum(apart, low[:, p] - own, out=apart)
            bound = self.upper(some, apart, high[:, 0])
            order = np.argsort(-bound, axis=1)
            for turn in range(len(starts)):
                block = order[:, turn]
                going = np.flatnonzero(bound[np.arange(len(block)), block] >= self.sure(some))
                if not len(going):
                    break  # no later block has a greater bound
                going = going[np.argsort(block[going], kind="stable")]
                for group in np.split(going, np.flatnonzero(np.diff(block[going])) + 1):
                    part = slice(starts[block[group[0]]], stops[block[group[0]]])
                    for i in range(0, len(group), SIDE):
                        self._block(group[i : i + SIDE] + at, ids[part], factors[part], distance[part])

    def _block(self, some: np.ndarray, ids: np.ndarray, factors: np.ndarray, distance: np.ndarray) -> None:
        apart = np.abs(self.distance[some][:, None, :] - distance[None, :, :]).max(axis=2)
        sure = self.sure(some)
        open_ = (self.upper(some, apart, distance[:, 0]) >= sure[:, None]) & (self.ids[some][:, None] != ids)
        if np.count_nonzero(open_) >= DENSE * open_.size:
            score = (self.factors[some] @ factors.T).astype(np.int64)
            query, row = np.nonzero(open_ & (score >= sure[:, None]))
            score = score[query, row]
        else:
            query, row = np.nonzero(open_)
            score = np.einsum("ij,ij->i", self.factors[some[query]], factors[row]).astype(np.int64)
            good = score >= sure[query]
            query, row, score = query[good], row[good], score[good]
        query, row = some[query], ids[row]
        worse = self.full[query] & (score == self.best[query, -1]) & (row >= self.found[query, -1])
        if not worse.all():
            self._merge(query[~worse], row[~worse], score[~worse])

    def _merge(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        """By query, then falling score, then vec_id; a vec_id once."""
        touched = np.unique(query)
        kept, place = np.nonzero(np.arange(self.k) < self._count(touched)[:, None])
        q = np.concatenate([query, touched[kept]])
        v = np.concatenate([row, self.found[touched[kept], place]])
        s = np.concatenate([score, self.best[touched[kept], place]])
        order = np.lexsort((~s, v, q))
        q, v, s = q[order], v[order], s[order]
        once = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))
        q, v, s = q[once], v[once], s[once]
        order = np.lexsort((v, ~s, q))
        q, v, s = q[order], v[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.best[touched] = np.iinfo(np.int64).min
        self.best[q[top], rank[top]], self.found[q[top], rank[top]] = s[top], v[top]
        self.full[touched] = self._count(touched) == self.k

    def _count(self, some: np.ndarray) -> np.ndarray:
        return (self.best[some] > np.iinfo(np.int64).min).sum(axis=1)

    def results(self) -> Iterator[pa.RecordBatch]:
        q, i = np.nonzero(self.best > np.iinfo(np.int64).min)
        for at in range(0, len(q), 50_000):
            a, b = q[at : at + 50_000], i[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(self.found[a, b]), pa.array(self.best[a, b])], ["query_id", "vec_id", "score"])


def indexed(rows: DataFrame, dim: int, pivots: np.ndarray) -> DataFrame:
    """vec_id, vector, distance (to the origin, then to each pivot), cell, level of every row.

    Rows of a level lie together, by cell (the nearest pivot) and by their distance to it; equal ones are dealt by hash.
    """
    sent = rows.sparkSession.sparkContext.broadcast(np.concatenate([np.zeros((1, dim), np.int64), pivots]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        for b in batches:
            for at in range(0, b.num_rows, HELD):
                part = b.slice(at, HELD)
                d = distances(matrix(part.column("vector"), dim, np.int64), sent.value)
                cell = d[:, 1:].argmin(axis=1) + 1 if d.shape[1] > 1 else np.zeros(len(d), int)
                near = d[np.arange(len(d)), cell]
                columns = [part.column("vec_id"), part.column("vector"), pa.array(list(d), pa.list_(pa.float64())), pa.array(cell, pa.int32()), pa.array(near)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "distance", "cell", "near"])

    measured = rows.mapInArrow(run, "vec_id bigint, vector array<int>, distance array<double>, cell int, near double")
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(LEVELS[0]))
    level = F.when(drawn == 0, 0).when(drawn % LEVELS[1] == 0, 1).otherwise(2)
    order = ["level", "cell", "near", "salt"]
    salted = measured.withColumns({"level": level, "salt": F.xxhash64("vec_id")})
    return materialise(salted.repartitionByRange(*order).sortWithinPartitions(*order).drop("near", "salt"), "pivots")


def top_products(table: DataFrame, k: int = NEIGHBOURS, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`, against all rows."""
    spark = table.sparkSession
    ship(spark)
    rows = usable(table)
    sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], RESULT)
    dim = sizes["dim"]
    rows = rows.where(F.size("vector") == dim)
    pivot_ids, pivots = chosen_pivots(rows, sizes["count"], dim)
    stored = indexed(rows, dim, pivots)
    asking = stored.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = asking.groupBy("vec_id").agg(F.min(F.struct("vector", "distance")).alias("own")).select("vec_id", "own.*")
    longest = stored.agg(F.max(F.col("distance")[0])).first()[0]
    exact = 4 * longest**2 < EXACT
    blocks = -(-queries.count() // max(1, QUERY_BYTES // (8 * (dim + PIVOTS + 1))))
    parts = []
    for i in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)) == i).toArrow()
        if got.num_rows:
            parts += _block_results(spark, stored, got, (pivot_ids, pivots), dim, k, exact)
    if not parts:
        return spark.createDataFrame([], RESULT)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def floors(ids: np.ndarray, queries: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best is sure to reach: its k-th best among rows of distinct ids."""
    out = np.full(len(ids), np.iinfo(np.int64).min)
    if len(own) <= k:
        return out
    for at in range(0, len(ids), 1024):
        score = queries[at : at + 1024] @ x.T
        score[ids[at : at + 1024, None] == own] = np.iinfo(np.int64).min
        out[at : at + 1024] = np.partition(score, len(own) - k, axis=1)[:, len(own) - k]
    return out


def _block_results(spark: SparkSession, stored: DataFrame, got: pa.Table, pivots: tuple[np.ndarray, np.ndarray], dim: int, k: int, exact: bool) -> list[DataFrame]:
    """The best k of each partition for one block of queries, level by level; a level's rows raise the next one's floor."""
    ids = got.column("vec_id").to_numpy()
    order = np.argsort(ids)
    ids = ids[order]
    queries = matrix(got.column("vector").combine_chunks(), dim, np.int64)[order]
    distance = matrix(got.column("distance").combine_chunks(), len(pivots[0]) + 1, float)[order]
    floor, parts = floors(ids, queries, *pivots, k), []
    for level in range(len(LEVELS) + 1):
        sent = spark.sparkContext.broadcast((ids, queries, distance, floor, k, exact))
        parts.append(materialise(stored.where(F.col("level") == level).select("vec_id", "vector", "distance", "cell").mapInArrow(_scan(sent, dim), FOUND), "products"))
        if level < len(LEVELS):
            found = parts[0]
            for p in parts[1:]:
                found = found.unionByName(p)
            last = _ranked(found, k).where(F.col("rank") == k).select("query_id", "score").toArrow()  # a row a query of the block
            place = np.searchsorted(ids, last.column("query_id").to_numpy())
            floor = floor.copy()
            floor[place] = np.maximum(floor[place], last.column("score").to_numpy())
    return parts


def _scan(sent, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        search, held, count = None, [], 0

        def flush() -> None:
            rows = pa.Table.from_batches(held).combine_chunks()
            column = lambda c: rows.column(c).chunk(0)
            search.rows(column("vec_id").to_numpy(), matrix(column("vector"), dim, np.int64), matrix(column("distance"), search.distance.shape[1], float), column("cell").to_numpy())

        for b in batches:
            search = search or Search(*sent.value)
            for at in range(0, b.num_rows, HELD):
                held.append(b.slice(at, HELD))
                count += held[-1].num_rows
                if count >= HELD:
                    flush()
                    held, count = [], 0
        if count:
            flush()
        if search:
            yield from search.results()

    return run


def oracle_sql(k: int = NEIGHBOURS, every: int = EVERY) -> str:
    """Brute force; whole numbers are exact in doubles."""
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
