"""Retrieval: term statistics, BM25, fusion with triggers, evidence packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwright.functions.text import tokenize
from tarnwright.sources.tables import kept, numbered

#: Saturation and length normalisation of BM25, share of the trigger channel, chunks of a pack.
K1, B, TRIGGER_SHARE, PACK_CHUNKS = 1.2, 0.75, 0.65, 12
#: Weight of tags, tokens a word costs, tokens of the frame around a pack, limit.
TAG_WEIGHT, TOKENS_A_WORD, FRAME_TOKENS, TOKEN_LIMIT = 3, 1.4, 400, 3000
#: Terms of all questions together that are looked for within rows.
MOST_TERMS = 2000
#: The score of a chunk that is always in a pack.
ALWAYS_FLOOR = 0.2


def weighted_tokens(title: Column, tags: Column, body: Column) -> Column:
    """Tokens of title and body once, of the tags three times."""
    return F.concat(tokenize(title), F.flatten(F.array_repeat(tokenize(F.array_join(tags, " ")), TAG_WEIGHT)), tokenize(body))


def postings(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """term, key, tf."""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame, key: str, tokens: str) -> DataFrame:
    """term, df, cf over all documents."""
    return postings(docs, key, tokens).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, queries: DataFrame, key: str, tokens: str) -> DataFrame:
    """query, key, score of all documents that hold a term of a query (query, term).

    Up to MOST_TERMS terms are sent to the documents and counted within the row, so that no token is a row of its own
    and only matching rows are shuffled; texts are tokenised once. More terms meet the postings by a join.
    """
    terms = queries.select("query", "term").distinct()
    wanted = [r["term"] for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(wanted) > MOST_TERMS:
        whole = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("avgdl"))
        found = postings(docs, key, tokens).join(terms.select("term").distinct(), "term", "left_semi")
        tf = found.join(docs.select(key, F.size(tokens).alias("dl")), key)
    else:
        # read once: what is kept of a document is its length and the terms that were met
        rows = kept(docs.select(key, F.size(tokens).alias("dl"), F.filter(tokens, lambda t: t.isin(*wanted) if wanted else F.lit(False)).alias("met")), "met")
        whole = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        tf = rows.where(F.size("met") > 0).select(key, "dl", F.explode(F.array_distinct("met")).alias("term"), "met")
        tf = tf.select(key, "dl", "term", F.size(F.filter("met", lambda t: t == F.col("term"))).alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    if len(wanted) <= MOST_TERMS:  # a row a term
        df = F.broadcast(df)
    scored = tf.join(df, "term").join(terms, "term").join(F.broadcast(whole))  # the last has one row
    part = idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("query", key).agg(F.sum(part).alias("score"))


def top(scored: DataFrame, key: str, k: int, digits: int = 6) -> DataFrame:
    """The k best of each query by rounded score, then key."""
    rounded = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), key)
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(scored: DataFrame, triggered: DataFrame, key: str) -> DataFrame:
    """query, key, score: triggers weigh 0.65, BM25 normalised by the query's best 0.35; `always` has a floor."""
    best = scored.groupBy("query").agg(F.max("score").alias("best"))
    lexical = scored.join(best, "query").select("query", key, (F.col("score") / F.col("best")).alias("lexical"))
    both = lexical.join(triggered.select("query", key, "always"), ["query", key], "full")
    fired = F.when(F.col("always").isNotNull(), 1.0).otherwise(0.0)
    score = TRIGGER_SHARE * fired + (1 - TRIGGER_SHARE) * F.coalesce("lexical", F.lit(0.0))
    return both.select("query", key, F.when(F.col("always"), F.greatest(score, F.lit(ALWAYS_FLOOR))).otherwise(score).alias("score"))


def without_conflicts(ranked: DataFrame, conflicts: DataFrame, key: str) -> DataFrame:
    """Of two conflicting ids (one, two) in a query's rows (query, key, rank) the better ranked one stays."""
    pairs = conflicts.select(F.col("one").alias("a"), F.col("two").alias("b")).unionByName(conflicts.select(F.col("two").alias("a"), F.col("one").alias("b"))).distinct()
    better = ranked.select("query", F.col(key).alias("b"), F.col("rank").alias("other"))
    beaten = ranked.join(pairs, F.col(key) == F.col("a")).join(better, ["query", "b"]).where(F.col("other") < F.col("rank"))
    return ranked.join(beaten.select("query", key).distinct(), ["query", key], "left_anti")


def pack_budget(bodies: DataFrame, words: Column, k: int = PACK_CHUNKS) -> DataFrame:
    """Words and tokens of the worst pack, the k longest bodies, and whether it is within the limit."""
    longest = bodies.select(words.alias("w")).orderBy(F.col("w").desc()).limit(k).agg(F.sum("w").alias("words"))
    tokens = F.floor(F.col("words") * TOKENS_A_WORD) + FRAME_TOKENS
    return longest.select("words", tokens.alias("tokens"), (tokens <= TOKEN_LIMIT).alias("fits"))


def pack_rules(packs: DataFrame, key: str) -> DataFrame:
    """What a pack (query, intent, key, kind, never_alone) lacks: one row a query."""
    has = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    sums = packs.groupBy("query", "intent").agg(
        F.count("*").alias("chunks"), has("rule").alias("rule"), has("error", "limit").alias("limit"), F.bool_and("never_alone").alias("alone"),
        F.bool_or(F.col(key) == "refusal.not-a-flood-predictor").alias("refused"),
    )
    return sums.select("query", (F.col("chunks") >= 3).alias("enough"), "rule", "limit", (~F.col("alone")).alias("not_alone"), ((F.col("intent") != "flood") | F.col("refused")).alias("refusal"))


#: Words that tell a question's intent, in order of precedence (our own; the classes are fixed).
INTENT_WORDS = {
    "flood": "flood flooding inundation waterlogging submerge overflow depth",
    "consequence": "happens happen downstream effect effects impact consequence below neighbours",
    "procedure": "apply application procedure permission approval sanction authority form process",
    "evidence": "source sources evidence accuracy accurate data reliable confidence satellite",
    "feasibility": "build construct plot site allowed buffer setback",
}


def intent(question: Column) -> Column:
    """The first intent one of whose words is in the question; feasibility if none is."""
    found = tokenize(question)
    out = F.lit("feasibility")
    for name, words in reversed(INTENT_WORDS.items()):
        out = F.when(F.arrays_overlap(found, F.array(*map(F.lit, words.split()))), name).otherwise(out)
    return out


def build_index(chunks: DataFrame, order: tuple[str, ...] = ("kind", "file")) -> dict[str, DataFrame]:
    """Tables of an index over chunks (id, title, tags, body and the order columns): docs (doc, id, dl), postings, df, stats.

    Documents are numbered from 0 in order.
    """
    rows = chunks.select(*order, "id", weighted_tokens(F.col("title"), F.col("tags"), F.col("body")).alias("tokens"))
    rows = numbered(rows, list(order), "doc")
    docs = rows.select("doc", "id", F.size("tokens").alias("dl"))
    found = postings(rows, "doc", "tokens")
    return {"docs": docs, "postings": found, "df": found.groupBy("term").agg(F.count("*").alias("df")), "stats": docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.lit(K1).alias("k1"), F.lit(B).alias("b"))}
