"""Mixing documents to target weights of domains, with soft membership. DataFrame functions only.

A table of labelled documents teaches a multinomial naive Bayes classifier over hashed words; it gives every document
a distribution over the domains (its log-likelihoods are tempered, so long documents keep soft membership). Each
document d with n_d words and probabilities p_dk then gets a rate r_d >= 0, how often it is to be used, such that
the expected words of each domain meet their targets: r minimises the least squares

    1/2 * sum_k w_k * (sum_d r_d n_d p_dk / N - target_k * budget)^2

by projected gradient steps from r = 1, in the metric that weighs a document by its words; w_k evens the domains'
scales. A step needs one distributed sum a domain, and none as long as no rate can have reached 0; only these sums and
the few classifier figures reach the driver. How far the targets are missed at the end is a column of the result.

The classifier may be fitted on a sample: labelled documents whose crc32 of doc_id is below a threshold that about
MOST_DOCS meet (twice that at most). All documents are classified, by all their words.

Defined results: null and empty texts have no word, the prior as probabilities, and the rate that follows from it.
Documents whose words the classifier never met get the prior too. Without labelled documents the domains of the
targets are equally probable. Targets are normalised; negative ones are errors. Repeated rows count each. Ties do
not arise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, spare

#: Labelled documents that are used, hashed words, the words at which half of the evidence is tempered away.
MOST_DOCS, BUCKETS, TEMPER = 20_000, 1 << 14, 64
STEPS, EXACT, KEEP_EVERY = 60, 1e-4, 12
BROADCAST_ROWS = 500_000

#: Production targets: shares of words by quality and toxicity.
TARGETS = {"good": 0.82, "good_toxic": 0.05, "poor": 0.12, "poor_toxic": 0.01}


def quality_domain() -> Column:
    """The domain of a row of `labels`; null if a label is."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return F.when(good & toxic, "good_toxic").when(good & ~toxic, "good").when(~good & toxic, "poor_toxic").when(~good & ~toxic, "poor")


def words(text: str = "text") -> Column:
    """The text's words: between white space, lower case."""
    spaced = F.translate(F.lower(F.col(text)), "\t\n\r\f\x0b", " " * 5)
    return F.split(F.trim(spaced), " ")


def _bucket(word: str) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def classifier(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float]]:
    """Log-likelihoods by bucket (w0, w1, ... a domain), and log priors. At most BUCKETS rows."""
    labelled = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).select("doc_id", "domain").distinct()
    n = labelled.count()
    some = labelled.where(F.crc32(F.col("doc_id").cast("string")) < F.lit(2.0**32 * min(1.0, MOST_DOCS / max(1, n)))).limit(2 * MOST_DOCS)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    found = rows.select("domain", F.explode(words()).alias("word")).where("word <> ''")
    counts = found.groupBy("domain", _bucket("word").alias("bucket")).count()
    told = {r["domain"]: r["n"] for r in counts.groupBy("domain").agg(F.sum("count").alias("n")).collect()}
    size = {r["domain"]: r["count"] for r in some.groupBy("domain").count().collect()}
    total = sum(size.values())
    prior = [math.log((size.get(k, 0) + 1) / (total + len(domains))) for k in domains]
    mass = 0.5
    weights = counts.groupBy("bucket").agg(
        *(F.log((F.coalesce(F.sum(F.when(F.col("domain") == k, F.col("count"))), F.lit(0)) + F.lit(mass)) / F.lit(told.get(k, 0) + mass * BUCKETS)).alias(f"w{i}") for i, k in enumerate(domains))
    )
    return weights, prior


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """doc_id, n_words and the probabilities p0, p1, ... of every row of docs."""
    weights, prior = classifier(docs, labelled, domains)
    k = range(len(domains))
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    rows = numbered.select("doc_id", "row", F.explode_outer(words()).alias("word"))
    rows = rows.select("row", "doc_id", F.when(F.col("word") != "", 1).alias("one"), F.when(F.col("word") != "", _bucket("word")).alias("bucket"))
    summed = rows.join(F.broadcast(weights), "bucket", "left").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.count("one").alias("n_words"),
        F.count("w0").alias("met"),
        *(F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in k),
    )
    temper = F.lit(float(TEMPER)) / (F.col("met") + F.lit(TEMPER))
    scores = summed.select("doc_id", "n_words", *((F.col(f"s{i}") * temper + F.lit(prior[i])).alias(f"s{i}") for i in k))
    top = F.greatest(*(F.col(f"s{i}") for i in k)) if len(domains) > 1 else F.col("s0")
    raised = scores.select("doc_id", "n_words", *(F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in k))
    whole = sum((F.col(f"e{i}") for i in k), F.lit(0.0))
    return raised.select("doc_id", "n_words", *((F.col(f"e{i}") / whole).alias(f"p{i}") for i in k))


def _largest(m: list[list[float]]) -> float:
    """Largest eigenvalue of a small non-negative symmetric matrix, by power iteration, from above."""
    v = [1.0] * len(m)
    for _ in range(100):
        v = [sum(a * b for a, b in zip(row, v, strict=True)) for row in m]
        top = max(v) or 1.0
        v = [x / top for x in v]
    return max(sum(a * b for a, b in zip(row, v, strict=True)) / max(x, 1e-12) for row, x in zip(m, v, strict=True))


def rates(members: DataFrame, targets: list[float], budget: float = 1.0) -> DataFrame:
    """members (n_words, p0, p1, ...) with the columns rate and target_miss, the same for all rows: by what share of itself
    a target (of 0.001 at least) is missed at the most when the descent ends, after STEPS steps or below EXACT. Targets
    that no rates meet, as those of a domain without words, stay missed. members must be cheap to read again."""
    k = range(len(targets))
    total = sum(targets)
    if total <= 0 or min(targets) < 0:
        raise ValueError("targets must be non-negative, with a positive sum")
    goal = [t / total * budget for t in targets]
    moments = members.agg(F.sum("n_words").alias("n"), *(F.sum(F.col("n_words") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"m{i}_{j}") for i in k for j in k if i <= j)).first()
    n = float(moments["n"] or 0)
    rated = members.withColumn("rate", F.lit(1.0))
    if not n:
        return rated.withColumn("target_miss", F.lit(1.0))
    m = [[float(moments[f"m{min(i, j)}_{max(i, j)}"]) / n for j in k] for i in k]
    weight = [1 / max(m[i][i], 1e-9) for i in k]
    step = 1 / _largest([[m[i][j] * math.sqrt(weight[i] * weight[j]) for j in k] for i in k])
    missed = lambda off: max(abs(x) / max(g, 1e-3) for x, g in zip(off, goal, strict=True))
    # A rate is 1 - sum_k a_k p_k until one is clipped, which none can be while no a_k is above 1, as probabilities sum
    # to 1: so far the sums follow from the second moments, and no pass over the documents is made.
    a, s = [0.0] * len(targets), 0
    while True:
        off = [sum(m[i][j] * (1 - a[j]) for j in k) - goal[i] for i in k]
        moved = [x + step * weight[i] * off[i] for i, x in enumerate(a)]
        if s == STEPS or missed(off) < EXACT or max(moved) > 1:
            break
        a, s = moved, s + 1
    if any(a):
        rated = members.withColumn("rate", F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.lit(a[i]) * F.col(f"p{i}") for i in k), F.lit(0.0))))
    passes = 0
    while s < STEPS and missed(off) >= EXACT:
        change = sum((F.lit(step * weight[i] * off[i]) * F.col(f"p{i}") for i in k), F.lit(0.0))
        rated = rated.withColumn("rate", F.greatest(F.lit(0.0), F.col("rate") - change))
        s, passes = s + 1, passes + 1
        if passes % KEEP_EVERY == 0:
            rated = materialise(rated, "rates")
        got = rated.agg(*(F.sum(F.col("rate") * F.col("n_words") * F.col(f"p{i}")).alias(f"g{i}") for i in k)).first()
        off = [float(got[f"g{i}"]) / n - goal[i] for i in k]
    return rated.withColumn("target_miss", F.lit(missed(off)))


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """doc_id, n_words, p_<domain> ..., rate and target_miss for every row of docs; labelled: doc_id, domain."""
    targets = targets or TARGETS
    domains = list(targets)
    members = materialise(posteriors(docs, labelled, domains), "members")
    rated = rates(members, list(targets.values()), budget)
    return rated.select("doc_id", "n_words", *(F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)), "rate", "target_miss")


def drawn(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, budget: float = 1.0, seed: int = 1) -> DataFrame:
    """docs with each row as often as its rate says: its whole part, and one more with the rest as probability.

    The draw is a hash of doc_id and seed, so it is the same in every run. Rows without doc_id stay once. Rows of one
    doc_id have one rate, the largest of theirs.
    """
    own, rate, count, copy = spare(docs, "_mix_id", "_mix_rate", "_mix_times", "_mix_copy")
    found = mix(docs, labelled, targets, budget).where("doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(F.max("rate").alias(rate))
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    chance = F.pmod(F.xxhash64(own, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.coalesce(F.floor(F.col(rate) + chance).cast("int"), F.lit(1))
    out = docs.join(found, docs["doc_id"] == found[own], "left").withColumn(count, times).where(F.col(count) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count)))).select(*(docs[c] for c in docs.columns))
