"""MinHash near-duplicates: one-permutation sketches, banded buckets, star-shaped candidate edges, exact confirmation.

Words are runs of other than space and the characters 9 to 13, after A-Z is lower-cased. A document's set holds its
distinct shingles of five words; one with fewer words has its whole word sequence as the only shingle; one without
words or text has an empty set and is linked with nothing. Two documents are linked if
100 * |intersection| >= 75 * |union|; components are those of the links.

How: documents with equal sets form a class, which its smallest doc_id stands for. A class is hashed once: the
upper bits of a shingle's hash choose one of 256 bins, the smallest hash in a bin gives its value, empty bins borrow
from bins drawn by a fixed table (optimal densification). Four bins make a band; classes that agree in a band share
a bucket. A link at exactly 75 % misses all 64 bands with probability about 3e-11, were bins independent; in few
shingles they are not, so that was counted as well: none of 20,000 pairs at each of nine sizes of sets, and a test
counts again.

In a bucket every member is compared with the smallest one only (a star). Members of a bucket that are in different
components after that are the rest: their sketches are compared block by block within a task, and each one's
likeliest partners are confirmed. What may still be linked then (same bucket, different components, sketches alike
or too few shingles for sketches to tell) hangs together in families, found by stars again; full sets of a
family are compared block by block within tasks, which give links only. Sketches are alike if half of their bins
agree: of pairs at 75 % three quarters do, give or take 0.03, more in sets of few shingles, and those of up to
SMALL shingles are compared whatever their sketches say. No group's pairs are ever listed.

Defined results: rows that share a doc_id are one document. A row without doc_id keeps its n_shingles, has no
component and is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, map_batches, materialise, ship, spare, utf8

WORDS = 5
BINS, BAND = 256, 4
SHARE = 75
#: How many of its likeliest partners in a bucket a member is compared with before families are.
ASKED = 2
#: Bins in which the sketches of pairs that may reach the threshold agree, at least; sets of up to SMALL are not asked.
LEAST_AGREEING, SMALL = BINS // 2, 32
#: Spokes of a star, and members of a bucket's block, that one group of rows holds.
SPOKES, BLOCK, FAMILY_BLOCK = 512, 1024, 256
#: Edges of stars that one file has room for.
EDGES_A_FILE = 500_000
#: Up to so many rows of ids are broadcast to the documents; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000

_RNG = np.random.default_rng(20_240_611)
_BORROW = _RNG.integers(0, BINS, (1024, BINS))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(docs: list[bytes]) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    cut = [d.lower().split() for d in docs]
    total = sum(map(len, cut))
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in cut for w in ws), np.uint64, total)
    whole = max(0, total - WORDS + 1)
    rolled = np.zeros(whole, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WORDS):
            rolled = rolled * _FACTOR + words[i : i + whole]
        rolled = _mixed(rolled)
        out, at = [], 0
        for ws in cut:
            n = len(ws)
            if n >= WORDS:
                out.append(np.unique(rolled[at : at + n - WORDS + 1]))
            else:
                h = np.uint64(n)
                for w in words[at : at + n]:
                    h = h * _FACTOR + w
                out.append(_mixed(np.array([h]))[:n])
            at += n
    return out


def sketch(shingles: np.ndarray) -> np.ndarray:
    """BINS values of 16 bits, as BINS / BAND words of 64: a word is a band."""
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)
    first = np.searchsorted(shingles, edges)
    ends = np.append(first[1:], len(shingles))
    full = first < ends
    values = shingles[np.minimum(first, len(shingles) - 1)].astype(np.uint16)
    empty = np.flatnonzero(~full)
    for at in range(0, len(_BORROW), 64):
        if not empty.size:
            break
        drawn = _BORROW[at : at + 64, empty]
        hit = full[drawn]
        found = hit.any(axis=0)
        source = drawn[hit.argmax(axis=0), np.arange(len(empty))]
        values[empty[found]] = values[source[found]]
        empty = empty[~found]
    if empty.size:
        values[empty] = values[np.flatnonzero(full)[0]]
    return values.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit digest (hi, lo) and its bands; the last three are null for empty sets."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
            ids = batch.column("doc_id")
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(utf8(part))
                digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if len(s) else None for s in sets]
                yield {
                    "doc_id": ids.slice(at, 256),
                    "n_shingles": [len(s) for s in sets],
                    "hi": [None if d is None else int(d[0]) for d in digests],
                    "lo": [None if d is None else int(d[1]) for d in digests],
                    "bands": [sketch(s) if len(s) else None for s in sets],
                }

        return each

    return map_batches(docs.select("doc_id", "text"), make, "doc_id bigint, n_shingles bigint, hi bigint, lo bigint, bands array<bigint>")


def _streamed(df: DataFrame, keys: list[str], order: list[str], each: Callable, schema: str) -> DataFrame:
    """Calls each(rows of one key) for every key, rows in the given order, as a stream: nothing else is held."""
    ship(df.sparkSession)
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold()
        names = [f.strip().split()[0] for f in schema.split(",")]
        out = pa.schema([(n, pa.int64()) for n in names])

        def rows():
            for b in batches:
                for at in range(0, b.num_rows, 200):
                    yield from b.slice(at, 200).to_pylist()

        found: list[tuple] = []
        for _, group in groupby(rows(), key=lambda r: tuple(r[k] for k in keys)):
            for x in each(group):
                found.append(x)
                if len(found) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=out)
                    found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=out)

    return sorted_rows.mapInArrow(run, schema)


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (node, ...) with the texts of its nodes, as bytes. Few ids are sent to the texts, many meet them by a shuffle."""
    bodies = docs.select(F.col("doc_id").alias("node"), F.col("text").cast("binary").alias("text")).where(F.col("text").isNotNull())
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return bodies.join(wanted, "node")


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose full sets reach the threshold. A hub a with many spokes is dealt to several groups."""
    pairs = pairs.select("a", "b")
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPOKES).cast("int").alias("parts"))
    spokes = pairs.join(spread, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("node"))
    hubs = spread.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("node"))
    wanted = spokes.unionByName(hubs)
    rows = _with_text(docs, wanted).select("a", "part", "role", "node", "text")

    def each(group: Iterator[dict]) -> Iterator[tuple[int, int]]:
        hub: list[np.ndarray] = []
        for r in group:
            mine = shingle_sets([r["text"]])[0]
            if r["role"] == 0:
                hub.append(mine)
                continue
            for other in hub:
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= SHARE * (len(mine) + len(other) - both):
                    yield r["a"], r["node"]
                    break

    return _streamed(rows, ["a", "part"], ["role"], each, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b): large and small stars in turn."""
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    told = lambda e: e.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("decimal(38,0)"))).first()
    after = told(edges)
    while True:
        before = after
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = materialise(stars.coalesce(max(1, -(-before[0] // EDGES_A_FILE))), "stars")  # edges get fewer, so files may
        after = told(edges)
        if before == after:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _within_buckets(buckets: DataFrame, reps: DataFrame, found: DataFrame, asked: Callable) -> DataFrame:
    """Calls asked(node, near) for every block, or two, of each bucket with several components.

    near(i) gives the places of members that are in other components than member i and whose sketches say that the
    pair may reach the threshold, the likeliest first. A bucket's pairs are looked at here only, never listed.
    """
    rows = _labelled(buckets.select("bucket", "node"), found)
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("one"), F.max("component").alias("two"), F.count("*").alias("members")).where("one <> two")
    rows = rows.join(mixed.select("bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "bucket")
    rows = _blocked(rows.join(reps.select("node", "n_shingles", "bands"), "node")).select("bucket", "p", "q", "block", "node", "component", "n_shingles", "bands")

    def each(group: Iterator[dict]) -> Iterator[tuple[int, int]]:
        members = list(group)
        sketches = np.array([m["bands"] for m in members], np.int64).view(np.uint16)
        node, component, n, block = (np.array([m[k] for m in members], np.int64) for k in ("node", "component", "n_shingles", "block"))
        across = members[0]["p"] != members[0]["q"]

        def near(i: int) -> np.ndarray:
            ok = (component != component[i]) & (100 * np.minimum(n, n[i]) >= SHARE * np.maximum(n, n[i]))
            if across:
                ok &= block != block[i]
            some = np.flatnonzero(ok)
            agree = (sketches[some] == sketches[i]).sum(axis=1) if some.size else some
            alike = (agree >= LEAST_AGREEING) | (n[some] <= SMALL) | (n[i] <= SMALL)
            some, agree = some[alike], agree[alike]
            return some[np.lexsort((node[some], -agree))]

        yield from asked(node, near)

    return _streamed(rows, ["bucket", "p", "q"], [], each, "a bigint, b bigint").distinct()


def _blocked(rows: DataFrame) -> DataFrame:
    """Deals each key's rows to blocks, and each row to all pairs of blocks (p, q) that hold its own."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")})


def _likeliest(node: np.ndarray, near: Callable) -> Iterator[tuple[int, int]]:
    """Each member's likeliest partners."""
    for i in range(len(node)):
        for j in near(i)[:ASKED].tolist():
            yield int(min(node[i], node[j])), int(max(node[i], node[j]))


def _forest(node: np.ndarray, near: Callable) -> Iterator[tuple[int, int]]:
    """What hangs together in the graph of pairs that may reach the threshold, as stars around each tree's smallest member.

    Fewer edges than members; and as the same members meet in many buckets, mostly the same edges there.
    """
    fresh = np.ones(len(node), bool)
    for start in range(len(node)):
        if not fresh[start]:
            continue
        fresh[start], todo, tree = False, [start], [start]
        while todo:
            reached = near(todo.pop())
            reached = reached[fresh[reached]]
            fresh[reached] = False
            todo += reached.tolist()
            tree += reached.tolist()
        centre = int(node[tree].min())
        for j in tree:
            if node[j] != centre:
                yield centre, int(node[j])


def _within_families(docs: DataFrame, families: DataFrame, found: DataFrame) -> DataFrame:
    """Links between different components of a family, from full sets, compared block by block within tasks.

    families: node, component (the family). One link between two components is enough; within a group of rows,
    components that were linked there are not compared again.
    """
    # larger families have larger blocks, so that members are sent to fewer of them
    width = F.least(F.greatest(F.count("*") / 64, F.lit(float(FAMILY_BLOCK))), F.lit(float(BLOCK)))
    sizes = families.groupBy("component").agg(F.ceil(F.count("*") / width).cast("int").alias("blocks"))
    members = _labelled(families.join(sizes, "component").withColumnRenamed("component", "family"), found)
    rows = _with_text(docs, members)
    rows = _blocked(rows).select("family", "p", "q", "block", "node", "component", "text")

    def each(group: Iterator[dict]) -> Iterator[tuple[int, int]]:
        members = list(group)
        sets = [shingle_sets([m["text"]])[0] for m in members]
        sketches = np.array([sketch(s) for s in sets]).view(np.uint16)
        node, component, block = (np.array([m[k] for m in members], np.int64) for k in ("node", "component", "block"))
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        across = members[0]["p"] != members[0]["q"]
        for i in range(len(members)):
            ok = (component[:i] != component[i]) & (100 * np.minimum(n[:i], n[i]) >= SHARE * np.maximum(n[:i], n[i]))
            if across:
                ok &= block[:i] != block[i]
            some = np.flatnonzero(ok)
            if not some.size:
                continue
            agree = (sketches[some] == sketches[i]).sum(axis=1)
            alike = (agree >= LEAST_AGREEING) | (n[some] <= SMALL) | (n[i] <= SMALL)
            for j in some[alike][np.argsort(-agree[alike], kind="stable")].tolist():
                if component[j] == component[i]:
                    continue
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= SHARE * (n[i] + n[j] - shared):
                    yield int(min(node[i], node[j])), int(max(node[i], node[j]))
                    component[component == component[j]] = component[i]
                    if (component == component[i]).all():  # nothing is left to link here
                        return

    return _streamed(rows, ["family", "p", "q"], ["node"], each, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    docs = docs.select("doc_id", "text")
    drawn = materialise(sketches(docs), "sketches")
    full = drawn.where("hi is not null and doc_id is not null")
    # a table of its own: its joins then deal both sides anew, and a hot class's rows can be split
    classes = materialise(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("node")), "classes")
    reps = full.join(classes.withColumnRenamed("node", "doc_id"), ["hi", "lo", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "bands").dropDuplicates(["node"])
    reps = materialise(reps, "representatives")

    rows = reps.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
    stars = rows.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("members")).where("members > 1")
    buckets = materialise(rows.join(stars.select("bucket", "centre"), "bucket"), "buckets")
    spokes = buckets.where("node <> centre").groupBy("node").agg(F.min("centre").alias("a")).select("a", F.col("node").alias("b"))
    links = materialise(confirmed(docs, spokes), "confirmed")
    found = components(links)
    likely = materialise(_within_buckets(buckets, reps, found, _likeliest), "likely")
    if not likely.isEmpty():
        links = materialise(links.unionByName(confirmed(docs, likely)), "confirmed")
        found = components(links)
        families = components(_within_buckets(buckets, reps, found, _forest))
        families = families.unionByName(families.select(F.col("component").alias("node"), "component").distinct())
        more = materialise(_within_families(docs, families, found), "related")
        if not more.isEmpty():
            found = components(links.unionByName(more))

    nodes = drawn.select("doc_id", "n_shingles", "hi", "lo").join(_labelled(classes, found), ["hi", "lo"], "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), "doc_id")
    return nodes.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, that are kept: one of each component, and of each doc_id.

    Rows without doc_id stay. Of rows that share a doc_id any one stays.
    """
    told = materialise(near_duplicates(docs), "told")
    gone_id, twice_id = spare(docs, "_gone_id", "_twice_id")
    gone = told.where(~F.col("kept")).select(F.col("doc_id").alias(gone_id)).distinct()
    twice = told.where("doc_id is not null").groupBy(F.col("doc_id").alias(twice_id)).count().where("count > 1").select(twice_id)
    out = docs.join(_sent(gone), docs["doc_id"] == F.col(gone_id), "left_anti")
    if twice.isEmpty():
        return out
    once = out.join(_sent(twice), out["doc_id"] == F.col(twice_id), "left_anti")
    return once.unionByName(out.join(_sent(twice), out["doc_id"] == F.col(twice_id), "left_semi").dropDuplicates(["doc_id"]))


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids
