"""Nearest neighbours by inner product from randomly rotated one-bit codes.

A vector o of dimension D is padded with zeros to L, about LONGER * D, and rotated by a fixed random orthogonal
matrix; the signs of the L coordinates are its code, packed in 64-bit words, and scalars go with it: its length, f
(the inner product of the rotated unit vector and its code as a unit vector), and the number of ones. Codes are made
once and stored with the vectors. A rotated query q is rounded to 2 ** PLANES steps, so that the sum of its
coordinates where a code has ones is PLANES counts of common bits a word; the estimate of <o, q> follows from that
and the scalars, and its error is below

    |o| / f * EPSILON * sqrt((1 - f^2) |q|^2 / (L - 1) + |rounding|^2 / L)

but for a small probability. A candidate whose upper bound reaches what the query's K-th best is known to reach gets
its exact inner product; so with EPSILON well above 1.9 the result misses almost nothing (recall against brute force
is tested). What a K-th best reaches is known from a sample of about SAMPLE candidates, drawn by hash, and from those
seen so far.

Rows are stored by cell, the nearest of CELLS centres that are fitted to the sample, large cells being split; blocks of
ROW_BLOCK rows know their centre and radius, and a block that cannot hold a better neighbour of a query is skipped for
it: exactly, by the triangle inequality. That spares most of the table if vectors lie in clusters, and nothing if they
are spread evenly in many dimensions (then work is queries times candidates).

Queries are a stated set; they are sent in blocks of QUERY_BLOCK (at most QUERY_BYTES) to all candidates, which are
read once a block. No pair of query and candidate is ever a row: a task keeps K candidates a query, and the final
ranking merges these.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
vec_id. The dimension is that of most vectors (the smaller on a tie), others take no part. Of repeated rows of one
vec_id the smallest vector asks, and the nearest is found. A query never finds its own vec_id. Scores are sums over the components in order, in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hold, materialise, ship

NEIGHBOURS, EVERY = 20, 20
LONGER, EPSILON, PLANES = 4, 4.0, 4
QUERY_BLOCK, QUERY_BYTES, SAMPLE = 1 << 16, 1 << 25, 8192
#: Rows that share a centre, queries that are compared with them at once, cells, and steps of fitting those.
ROW_BLOCK, SIDE, CELLS, FITTING = 256, 256, 256, 4

SCHEMA = "query_id bigint, vec_id bigint, score double"


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """dim orthonormal rows of whole words of bits, the same wherever they are made."""
    long = -(-LONGER * dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(long, dim)))
    return (q * np.sign(np.diag(r))).T.copy()


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths and f of non-zero vectors."""
    length = np.linalg.norm(vectors, axis=1)
    turned = (vectors / length[:, None]) @ turn
    return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / turn.shape[1] ** 0.5


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, each a sum over the components in order."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Search:
    """Keeps the best candidates of each query over the blocks it is given."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.ids, self.queries, self.floor, self.k = ids, queries, floor, k
        turn = rotation(queries.shape[1])
        self.long = turn.shape[1]
        self.length = np.linalg.norm(queries, axis=1)
        n, words = len(ids), self.long // 64
        self.planes = np.empty((PLANES, words, n), np.uint64)
        self.low, self.step, self.total, self.rounding = (np.empty(n) for _ in range(4))
        for at in range(0, n, 4096):
            part = slice(at, at + 4096)
            turned = queries[part] @ turn
            self.low[part] = turned.min(axis=1)
            self.step[part] = np.maximum((turned.max(axis=1) - self.low[part]) / (2**PLANES - 1), 1e-300)
            level = np.rint((turned - self.low[part, None]) / self.step[part, None])
            self.total[part] = turned.sum(axis=1)
            self.rounding[part] = np.linalg.norm(turned - self.low[part, None] - level * self.step[part, None], axis=1)
            for j in range(PLANES):
                self.planes[j, :, part] = np.packbits(level.astype(np.uint8) >> j & 1, axis=1).view(np.uint64).T
        self.best = np.full((n, k), -np.inf)
        self.found = np.full((n, k), -1, np.int64)

    def estimates(self, some: np.ndarray, codes: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products of codes, as unit vectors, and rotated queries: codes (words by rows) by queries."""
        both, common = np.zeros((codes.shape[1], len(some)), np.uint16), np.empty((codes.shape[1], len(some)), np.uint64)
        for w in range(len(codes)):
            for j in range(PLANES):
                np.bitwise_and(codes[w][:, None], self.planes[j, w][some], out=common)
                both += np.bitwise_count(common).astype(np.uint16) << np.uint16(j)
        out = both.astype(np.float32)
        out *= (2 * self.step[some] / self.long**0.5).astype(np.float32)
        out += ones[:, None].astype(np.float32) * (2 * self.low[some] / self.long**0.5).astype(np.float32)
        out -= (self.total[some] / self.long**0.5).astype(np.float32)
        return out

    def slack(self, some: np.ndarray, f: np.ndarray) -> np.ndarray:
        """The greatest error of the estimates, of each query, that is allowed for."""
        return EPSILON * np.sqrt((1 - f.min() ** 2) * self.length[some] ** 2 / max(1, self.long - 1) + self.rounding[some] ** 2 / self.long)

    def block(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, f: np.ndarray) -> None:
        centre = vectors.mean(axis=0)
        radius = np.linalg.norm(vectors - centre, axis=1).max()
        sure = np.maximum(self.best[:, -1], self.floor)
        most = self.queries @ centre + self.length * radius
        asking = np.flatnonzero(most >= sure - 1e-9 * (np.abs(sure) + self.length * radius))
        words = np.ascontiguousarray(codes.view(np.uint64).T)
        ones = np.bitwise_count(words).sum(axis=0)
        for at in range(0, len(asking), SIDE):
            some = asking[at : at + SIDE]
            upper = self.estimates(some, words, ones)
            upper += self.slack(some, f).astype(np.float32)
            upper *= (length / f)[:, None].astype(np.float32)
            row, query = np.nonzero(upper >= (sure[some] - 1e-5 * np.abs(sure[some])).astype(np.float32))
            self._rerank(ids, vectors, row, some[query], sure)

    def _rerank(self, ids: np.ndarray, vectors: np.ndarray, row: np.ndarray, query: np.ndarray, sure: np.ndarray) -> None:
        other = ids[row] != self.ids[query]
        row, query = row[other], query[other]
        if not len(row):
            return
        about = np.einsum("ij,ij->i", vectors[row], self.queries[query])
        some = about >= sure[query] - 1e-9 * np.abs(sure[query])
        row, query = row[some], query[some]
        score = exact(vectors[row], self.queries[query])
        some = score >= sure[query]
        if not some.any():
            return
        row, query, score = row[some], query[some], score[some]
        # merge with what is kept of these queries: by query, then score, then vec_id; a vec_id once
        touched, place = np.unique(query, return_inverse=True)
        kept_q, kept_i = np.nonzero(self.found[touched] >= 0)
        q = np.concatenate([place, kept_q])
        s = np.concatenate([score, self.best[touched[kept_q], kept_i]])
        v = np.concatenate([ids[row], self.found[touched[kept_q], kept_i]])
        order = np.lexsort((-s, v, q))
        q, s, v = q[order], s[order], v[order]
        once = np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])])
        q, s, v = q[once], s[once], v[once]
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.k
        self.best[touched], self.found[touched] = -np.inf, -1
        self.best[touched[q[top]], rank[top]], self.found[touched[q[top]], rank[top]] = s[top], v[top]

    def rows(self) -> Iterator[pa.RecordBatch]:
        q, i = np.nonzero(self.found >= 0)
        for at in range(0, len(q), 50_000):
            a, b = q[at : at + 50_000], i[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(self.found[a, b]), pa.array(self.best[a, b])], ["query_id", "vec_id", "score"])


def usable(table: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    rows = table.select("vec_id", vector.alias("vector")).where("vec_id is not null and vector is not null")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("vector", lambda x: x != 0))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def sample(rows: DataFrame, total: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of about SAMPLE rows (twice that at most), drawn by a hash of vec_id; a row an id."""
    got = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(2**30 * min(1.0, SAMPLE / max(1, total))))).limit(2 * SAMPLE).toArrow()
    own, first = np.unique(got.column("vec_id").to_numpy(), return_index=True)
    return own, matrix(got.column("vector").combine_chunks(), dim)[first]


def cells(vectors: np.ndarray) -> np.ndarray:
    """Centres by a few steps of k-means, from evenly spaced rows on."""
    k = max(1, min(CELLS, len(vectors) // 16))
    centres = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)].copy() if len(vectors) else np.zeros((1, vectors.shape[1]))
    for _ in range(FITTING):
        own = nearest_centre(vectors, centres)
        for c in range(k):
            if (own == c).any():
                centres[c] = vectors[own == c].mean(axis=0)
    return centres


def nearest_centre(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * vectors @ centres.T).argmin(axis=1)


def indexed(rows: DataFrame, dim: int, centres: np.ndarray) -> DataFrame:
    """vec_id, vector, code, length, f of every row, by cell; a large cell is dealt to several partitions."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        turn = rotation(dim)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                vectors = matrix(part.column("vector"), dim)
                codes, length, f = encode(vectors, turn)
                columns = [part.column("vec_id"), part.column("vector"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(f), pa.array(nearest_centre(vectors, sent.value).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "code", "length", "f", "cell"])

    coded = rows.mapInArrow(run, "vec_id bigint, vector array<double>, code binary, length double, f double, cell int")
    salted = coded.withColumn("salt", F.xxhash64("vec_id"))
    return materialise(salted.repartitionByRange("cell", "salt").sortWithinPartitions("cell", "salt").drop("salt"), "codes")


def nearest(table: DataFrame, k: int = NEIGHBOURS, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`, against all rows."""
    spark = table.sparkSession
    ship(spark)
    rows = usable(table)
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = sizes["dim"]
    rows = rows.where(F.size("vector") == dim)
    known = sample(rows, sizes["count"], dim)
    stored = indexed(rows, dim, cells(known[1]))
    queries = stored.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    most = max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * dim)))
    blocks = max(1, -(-queries.count() // most))
    bounds = queries.approxQuantile("vec_id", [i / blocks for i in range(1, blocks)], 0.0001) if blocks > 1 else []
    edges = [None, *sorted({int(b) for b in bounds}), None]
    parts = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        chosen = queries
        if low is not None:
            chosen = chosen.where(F.col("vec_id") > low)
        if high is not None:
            chosen = chosen.where(F.col("vec_id") <= high)
        parts.append(_block_results(stored, chosen, known, dim, k))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def floors(ids: np.ndarray, queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best is sure to reach: its k-th best among some candidates of distinct ids."""
    if len(own) <= k:
        return np.full(len(ids), -np.inf)
    out = np.empty(len(ids))
    for at in range(0, len(ids), 512):
        score = queries[at : at + 512] @ vectors.T
        score[ids[at : at + 512, None] == own] = -np.inf
        kth = np.partition(score, len(own) - k, axis=1)[:, len(own) - k]
        out[at : at + 512] = kth - 1e-9 * np.abs(kth)
    return out


def _block_results(stored: DataFrame, queries: DataFrame, known: tuple[np.ndarray, np.ndarray], dim: int, k: int) -> DataFrame:
    """The best k of each partition of rows for one block of queries."""
    spark = stored.sparkSession
    got = queries.toArrow()
    ids, vectors = got.column("vec_id").to_numpy(), matrix(got.column("vector").combine_chunks(), dim)
    sent = spark.sparkContext.broadcast((ids, vectors, floors(ids, vectors, *known, k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        search = None
        for b in batches:
            search = search or Search(*sent.value, k)
            own, vectors = b.column("vec_id").to_numpy(), matrix(b.column("vector"), dim)
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(own), -1)
            length, f, cell = (b.column(c).to_numpy() for c in ("length", "f", "cell"))
            cuts = np.flatnonzero(np.diff(cell)) + 1  # a block has rows of one cell
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)], strict=True):
                for at in range(low, high, ROW_BLOCK):
                    part = slice(at, min(at + ROW_BLOCK, high))
                    search.block(own[part], vectors[part], codes[part], length[part], f[part])
        if search:
            yield from search.rows()

    return materialise(stored.mapInArrow(run, SCHEMA), "nearest")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true (query_id, vec_id) pairs that were found."""
    both = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return both / max(1, truth.count())


def oracle_sql(k: int = NEIGHBOURS, every: int = EVERY) -> str:
    """Brute force with the same order of summation."""
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
