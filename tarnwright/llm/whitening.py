"""Whitening of vectors: exact sums, covariance by Chan's merging formula, eigenvectors, and a verified identity.

Entries c become whole numbers x = floor(SCALE * c) + OFFSET. Each partition keeps a state of count, sums and centred
scatter (`Moments`): a batch is centred on its own mean before anything is multiplied, and batches and partitions are
merged in pairs by Chan's formula

    scatter = scatter_a + scatter_b + (mean_b - mean_a)(mean_b - mean_a)' * n_a * n_b / (n_a + n_b)

in a treeReduce, whose depth follows from the size of a state so that the driver never holds more than TREE_BYTES of
them. Sums are whole numbers of any size, so counts, sums, means and their differences are exact. The driver sees one
state of dim * dim numbers and takes its eigenvectors; a second pass over all vectors measures the covariance of the
whitened ones, by the same merging, and its largest departure from the identity is in every row. A lost executor costs
its partitions' states, which are made again.

Defined results: vectors that are null, or hold null or non-finite entries, are dropped, as are those with an entry
whose x does not fit a long. All others must share a dimension: the one of most vectors counts (the smaller on a tie),
other vectors are dropped. Repeated rows count and come back as often as they are there, null ids included. Components
without variance (up to the rounding of an eigenvalue) have a null `whitened` and take no part in the identity; without
any variance `explained` and `identity_error` are null. `deviation` is null where it is beyond a long. An empty table
gives no rows. Other columns of the table are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, map_batches, ship

#: Entries become floor(SCALE * c) + OFFSET; the query gives COMPONENTS components.
SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: The most that the states which reach the driver at once may take.
TREE_BYTES = 64 << 20
#: Entries in a batch beside which its copies are small.
BLOCK_ENTRIES = 1 << 20
#: Beyond this no whole number in double precision is sure to fit a long.
LONG = 2.0**62

SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass
class Moments:
    """Count, exact sums (whole numbers, as Python's) and centred scatter of some rows."""

    n: int
    sums: list[int]
    scatter: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        """x: rows of whole numbers as int64."""
        low = x & 0xFFFFFFFF
        sums = [(int(h) << 32) + int(lo) for h, lo in zip((x >> 32).sum(axis=0), low.sum(axis=0), strict=True)]
        return Moments(len(x), sums, _scatter(centred(x, len(x), sums)))

    def merge(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = np.array([b * self.n - a * other.n for a, b in zip(self.sums, other.sums, strict=True)], object)
        step = (apart / (self.n * other.n)).astype(float)
        scatter = self.scatter + other.scatter + np.outer(step, step) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], scatter)


@dataclass
class Spread:
    """Count, mean and centred scatter of some rows of doubles."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(z: np.ndarray) -> Spread:
        mean = z.mean(axis=0)
        return Spread(len(z), mean, _scatter(z - mean))

    def merge(self, other: Spread) -> Spread:
        if not self.n or not other.n:
            return self if self.n else other
        n, step = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(step, step) * (self.n * other.n / n)
        return Spread(n, self.mean + step * (other.n / n), scatter)


def _scatter(d: np.ndarray) -> np.ndarray:
    return d.T @ d


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n in double precision: the whole part of the mean is taken off before rounding."""
    whole = np.array([s // n for s in sums], object)
    rest = np.array([(s % n) / n for s in sums])
    if max(map(abs, whole), default=0) < LONG:
        return (x - whole.astype(np.int64)).astype(float) - rest
    return (x.astype(object) - whole).astype(float) - rest


def quantised(c: np.ndarray) -> np.ndarray:
    return (np.floor(SCALE * c) + OFFSET).astype(np.int64)


def usable(table: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vector (array of double) of the rows that can be fitted and whitened, of whatever dimension."""
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LONG / SCALE)))


def rows_of(column: pa.Array, dim: int) -> Iterator[np.ndarray]:
    """The vectors of an Arrow column, some rows at a time."""
    step = max(1, BLOCK_ENTRIES // dim)
    for at in range(0, len(column), step):
        yield column.slice(at, step).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def tree_depth(parts: int, state_bytes: int) -> int:
    """Levels of merging after which at most TREE_BYTES of states are left for the driver (two states at least)."""
    left = max(2, TREE_BYTES // max(1, state_bytes))
    return max(2, math.ceil(math.log(max(2, parts)) / math.log(left)))


def merged(rows: DataFrame, dim: int, state: Callable[[np.ndarray], Moments | Spread]) -> Moments | Spread:
    """The states of all rows' batches merged: within partitions first, then in a treeReduce."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        total = None
        for b in batches:
            for vectors in rows_of(b.column("vector"), dim):
                one = state(vectors)
                total = one if total is None else total.merge(one)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["state"])

    states = rows.select("vector").mapInArrow(run, "state binary").rdd.map(_state)
    return states.treeReduce(_merge, tree_depth(states.getNumPartitions(), 8 * dim * (dim + 2)))


def _state(row) -> Moments | Spread:
    return pickle.loads(row["state"])


def _merge(a: Moments | Spread, b: Moments | Spread) -> Moments | Spread:
    return a.merge(b)


@dataclass
class Whitener:
    """What whitens a vector: exact count and sums, unit eigenvectors as columns, their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @staticmethod
    def of(moments: Moments, components: int) -> Whitener:
        covariance = moments.scatter / moments.n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        top = np.argsort(-values, kind="stable")[:components]
        return Whitener(moments.n, moments.sums, vectors[:, top], values[top], float(np.trace(covariance)))

    @property
    def live(self) -> np.ndarray:
        """Which components have variance."""
        least = len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)
        return self.values > least

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; components without variance are not a number."""
        scale = np.where(self.live, self.values, np.nan) ** 0.5
        return centred(x, self.n, self.sums) @ self.vectors / scale

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Of each row the sum of (n * x - sums) ** 2, exact; null where it is beyond a long.

        Products are taken modulo 2 ** 64, which is exact wherever the sum in doubles is clearly within a long.
        """
        whole = np.array([s // self.n for s in self.sums], object)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        d = (x - whole.astype(np.int64)) if max(map(abs, whole), default=0) < LONG else (x.astype(object) - whole)
        about = ((d.astype(float) * self.n - rest) ** 2).sum(axis=1)
        if d.dtype == object:
            exact = [sum(int(v * self.n - r) ** 2 for v, r in zip(row, rest.tolist(), strict=True)) for row in d]
            return pa.array([v if v < 2**63 else None for v in exact], pa.int64())
        with np.errstate(over="ignore"):
            off = d * np.int64(self.n) - rest
            out = (off * off).sum(axis=1)
        beyond = about > 2.0**63
        for i in np.flatnonzero(np.abs(about / 2.0**63 - 1) < 1e-6):
            exact = sum((v * self.n - r) ** 2 for v, r in zip(d[i].tolist(), rest.tolist(), strict=True))
            beyond[i], out[i] = exact >= 2**63, exact if exact < 2**63 else 0
        return pa.array(out, pa.int64(), mask=beyond)


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitener:
    """The whitener of rows from usable(), all of dimension dim, of which there is at least one."""
    return Whitener.of(merged(rows, dim, lambda c: Moments.of(quantised(c))), components)


def identity_error(rows: DataFrame, dim: int, whitener: Whitener) -> float | None:
    """The second pass: the largest entry, by size, of the whitened rows' covariance less the identity."""
    live = whitener.live
    if not live.any():
        return None
    sent = rows.sparkSession.sparkContext.broadcast(whitener)
    spread = merged(rows, dim, lambda c: Spread.of(sent.value.apply(quantised(c))[:, live]))
    return float(np.abs(spread.scatter / spread.n - np.eye(int(live.sum()))).max())


def dominant(rows: DataFrame) -> int | None:
    """The dimension of most vectors, the smaller on a tie; None if there is no vector with an entry."""
    sizes = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    return sizes and sizes["dim"]


def whitened(rows: DataFrame, dim: int, whitener: Whitener) -> DataFrame:
    """vec_id, whitened (array of double, a component each) of rows from usable()."""
    sent = rows.sparkSession.sparkContext.broadcast(whitener)

    def make() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            at = 0
            for vectors in rows_of(batch.column("vector"), dim):
                z = sent.value.apply(quantised(vectors))
                yield {"vec_id": batch.column("vec_id").slice(at, len(z)), "whitened": pa.array(list(z), pa.list_(pa.float64()))}
                at += len(z)

        return each

    return map_batches(rows, make, "vec_id bigint, whitened array<double>")


def whitening(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component.

    Fits and verifies when called; the rows themselves are made in one pass without a shuffle.
    """
    spark = table.sparkSession
    rows = usable(table)
    dim = dominant(rows)
    if dim is None:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.where(F.size("vector") == dim)
    whitener = fit(rows, dim, components)
    error = identity_error(rows, dim, whitener)
    sent = spark.sparkContext.broadcast(whitener)

    def make() -> Callable[[pa.RecordBatch], Iterator[dict[str, object]]]:
        w = sent.value
        k = len(w.values)
        share = w.values / w.trace if w.trace > 0 else np.full(k, np.nan)

        def each(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            at = 0
            for vectors in rows_of(batch.column("vector"), dim):
                x = quantised(vectors)
                ids = batch.column("vec_id").slice(at, len(x))
                at += len(x)
                turn = pa.array(np.repeat(np.arange(len(x)), k))
                yield {
                    "vec_id": ids.take(turn),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                    "n": np.full(len(x) * k, w.n),
                    "deviation": w.deviation(x).take(turn),
                    "whitened": pa.array(w.apply(x).reshape(-1), from_pandas=True),
                    "explained": pa.array(np.tile(share, len(x)), from_pandas=True),
                    "identity_error": pa.array([error], pa.float64()).take(pa.array(np.zeros(len(x) * k, np.int64))),
                }

        return each

    return map_batches(rows, make, SCHEMA)
