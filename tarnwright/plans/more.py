"""Further named queries: index, corpus checks, relief, receiving ground."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwright.functions import geometry
from tarnwright.operators import flow, quality, raster, retrieval, spatial
from tarnwright.plans import fixtures as fx
from tarnwright.plans.catalogue import TOKENS, TRACE_SQL, _traced, images, query
from tarnwright.sources.tables import read


def tok(column: str) -> str:
    return TOKENS.replace("lower(text)", f"lower({column})")


CHUNK_SQL = f"""ch AS (SELECT doc_id AS id, lang AS kind, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS file, list_concat(list_concat({tok('source')}, list_concat(list_concat({tok('lang')}, {tok('lang')}), {tok('lang')})), {tok('text')}) AS toks FROM documents)"""


def _chunks(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("file"), F.col("source").alias("title"), F.array("lang").alias("tags"), F.col("text").alias("body"))


@query(f"WITH {CHUNK_SQL} SELECT CAST(row_number() OVER (ORDER BY kind, file) - 1 AS BIGINT) AS doc, id, CAST(len(toks) AS INTEGER) AS dl FROM ch")
def index_documents(spark, d):
    return retrieval.build_index(_chunks(spark, d))["docs"]


@query(f"WITH {CHUNK_SQL}, n AS (SELECT CAST(row_number() OVER (ORDER BY kind, file) - 1 AS BIGINT) AS doc, toks FROM ch) SELECT term, doc, count(*) AS tf FROM (SELECT doc, unnest(toks) AS term FROM n) GROUP BY ALL")
def index_postings(spark, d):
    return retrieval.build_index(_chunks(spark, d))["postings"]


@query(
    """WITH h AS (SELECT sha256(doc_id || chr(10) || text) AS d FROM documents), s AS (SELECT count(*) AS n, sum(CAST('0x' || substr(d, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(d, 16, 15) AS BIGINT)) AS b FROM h)
SELECT substr(sha256(n || ',' || a || ',' || b), 1, 8) AS version FROM s"""
)
def content_fingerprint(spark, d):
    return quality.fingerprint(read(spark, d, "documents"), "doc_id", "text")


@query(
    """WITH c AS (SELECT page_id, 'rule.page-' || page_id AS id, CASE page_id % 4 WHEN 0 THEN 'statute' WHEN 1 THEN 'repo-derived' WHEN 2 THEN 'court' ELSE 'editorial' END AS authority,
CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS url, CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 7 = 0 THEN 'x.md#L3' ELSE 'f.md#L' || (page_id % 90) END AS ref FROM pages)
SELECT id, CASE WHEN authority IN ('statute', 'court') THEN 'no link' WHEN ref = '' THEN 'no reference' WHEN ref LIKE 'x.md%' THEN 'no such file' ELSE 'line beyond the end' END AS problem FROM c
WHERE (authority IN ('statute', 'court') AND NOT starts_with(url, 'http')) OR (authority = 'repo-derived' AND (ref = '' OR ref LIKE 'x.md%' OR page_id % 90 > 40))"""
)
def provenance_check(spark, d):
    chunks = read(spark, d, "pages").selectExpr(
        "concat('rule.page-', page_id) AS id", "CASE page_id % 4 WHEN 0 THEN 'statute' WHEN 1 THEN 'repo-derived' WHEN 2 THEN 'court' ELSE 'editorial' END AS authority", "CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS url",
        "CASE WHEN page_id % 5 = 0 THEN '' WHEN page_id % 7 = 0 THEN 'x.md#L3' ELSE concat('f.md#L', page_id % 90) END AS repo_ref",
    )
    return quality.provenance(chunks, spark.createDataFrame([("f.md", 40)], "path string, lines int"))


@query(
    """WITH codes AS (SELECT DISTINCT 'c' || (o_orderkey % 12) AS value FROM orders), m AS (SELECT 'c' || (range + 3) AS code, 'outcome.' || range AS chunk FROM range(12)), k AS (SELECT 'outcome.' || range AS id FROM range(10))
SELECT 'code without chunk' AS problem, value FROM codes WHERE value NOT IN (SELECT code FROM m) UNION ALL SELECT 'mapped but never given', code FROM m WHERE code NOT IN (SELECT value FROM codes) UNION ALL SELECT 'no such chunk', chunk FROM m WHERE chunk NOT IN (SELECT id FROM k)"""
)
def unmapped_codes(spark, d):
    codes = read(spark, d, "orders").selectExpr("concat('c', o_orderkey % 12) AS code")
    mapping = spark.range(12).selectExpr("concat('c', id + 3) AS code", "concat('outcome.', id) AS chunk")
    return quality.unmapped(codes, mapping, spark.range(10).selectExpr("concat('outcome.', id) AS id"))


@query(
    r"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'Rule.x' ELSE 'rule.d' || doc_id END AS id, CASE WHEN doc_id % 8 = 0 THEN 'zone' ELSE 'rule' END AS kind, len(regexp_extract_all(text, '([A-Za-z0-9''’‐-―-]+)')) AS w FROM documents)
SELECT id, 'bad id' AS problem FROM c WHERE doc_id % 9 = 0 UNION ALL SELECT id, 'unknown kind' FROM c WHERE kind = 'zone' UNION ALL SELECT id, 'id is not kind.name' FROM c WHERE id <> kind || '.d' || doc_id UNION ALL SELECT id, 'too long' FROM c WHERE w > 120"""
)
def corpus_faults(spark, d):
    chunks = read(spark, d, "documents").selectExpr(
        "CASE WHEN doc_id % 9 = 0 THEN 'Rule.x' ELSE concat('rule.d', doc_id) END AS id", "CASE WHEN doc_id % 8 = 0 THEN 'zone' ELSE 'rule' END AS kind", "concat('c/d', doc_id, '.md') AS file", "'t' AS title", "text AS body", "array('flood') AS intents"
    )
    return quality.chunk_faults(chunks)


@query(
    """WITH p AS (SELECT conv_id AS query, CASE WHEN conv_id % 2 = 0 THEN 'flood' ELSE 'evidence' END AS intent, CASE turn % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'error' WHEN 2 THEN 'refusal' ELSE 'precedent' END AS kind,
CASE WHEN turn % 4 = 2 THEN 'refusal.not-a-flood-predictor' ELSE 'x.' || turn END AS id, turn % 4 = 3 AS na FROM conversations)
SELECT query, count(*) >= 3 AS enough, bool_or(kind = 'rule') AS rule, bool_or(kind IN ('error', 'limit')) AS "limit", NOT bool_and(na) AS not_alone, intent <> 'flood' OR bool_or(id = 'refusal.not-a-flood-predictor') AS refusal FROM p GROUP BY query, intent"""
)
def pack_rules(spark, d):
    packs = read(spark, d, "conversations").selectExpr(
        "conv_id AS query", "CASE WHEN conv_id % 2 = 0 THEN 'flood' ELSE 'evidence' END AS intent", "CASE turn % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'error' WHEN 2 THEN 'refusal' ELSE 'precedent' END AS kind",
        "CASE WHEN turn % 4 = 2 THEN 'refusal.not-a-flood-predictor' ELSE concat('x.', turn) END AS id", "turn % 4 = 3 AS never_alone",
    )
    return retrieval.pack_rules(packs, "id")


@query(f"WITH {fx.PIXEL_SQL} SELECT y, x, CAST(floor(LEAST(upa - (SELECT min(upa) FROM pxb), 255) + 0.5) AS SMALLINT) AS above_min FROM pxb")
def relief(spark, d):
    return raster.above_minimum(raster.select_bands(fx.pixels(spark, d), "up.*"), "upa").select("y", "x", "above_min")


@query(
    f"""WITH RECURSIVE {TRACE_SQL}, r AS (SELECT trace_id, ix, iy, CAST(upa_code AS DOUBLE) AS upa, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY upa_code DESC, step) AS INTEGER) AS rank FROM told JOIN cells USING (ix, iy))
SELECT trace_id, rank, ix, iy, upa FROM r WHERE rank <= 3"""
)
def receiving_ground(spark, d):
    return flow.receiving(_traced(spark, d), fx.cells(spark, d).select("ix", "iy", F.col("upa_code").cast("double").alias("upa")))


@query(
    """WITH c AS (SELECT c_custkey, (c_custkey * 37 % 1700) / 10.0::DOUBLE - 85 AS lat FROM customer)
SELECT c_custkey, lat, round(1e-4::DOUBLE * 111.320::DOUBLE * 1e-4::DOUBLE * 110.574::DOUBLE * 100 * cos(radians(lat)), 12) * 1e6 AS square_cm FROM c"""
)
def pixel_area(spark, d):
    rows = read(spark, d, "customer").selectExpr("c_custkey", "(c_custkey * 37 % 1700) / 10D - 85 AS lat")
    return rows.select("c_custkey", "lat", (F.round(geometry.pixel_ha(F.col("lat"), 1e-4, 1e-4), 12) * 1e6).alias("square_cm"))


@query(
    """WITH s AS (SELECT c_custkey, round((c_acctbal + 1000) / 11000, 6) AS score FROM customer), r AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, c_custkey) AS INTEGER) AS rank FROM s) SELECT c_custkey, score, rank FROM r WHERE rank <= 25"""
)
def ranked_list(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.round((F.col("c_acctbal") + 1000) / 11000, 6).alias("score"))
    return spatial.ranked(rows, "score", "c_custkey", 25)




EPOCHS = {"before": ("2024-01-01", "2024-01-16"), "after": ("2024-01-16", "2024-02-01")}


@query(
    "SELECT CAST(event_id % 37 AS INTEGER) AS y, CAST(user_id % 64 AS INTEGER) AS x, round(median(value) FILTER (ts < TIMESTAMP '2024-01-16'), 6) AS before, round(median(value) FILTER (ts >= TIMESTAMP '2024-01-16'), 6) AS after FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1, 2"
)
def timeline(spark, d):
    got = raster.timeline(images(spark, d), "value", EPOCHS)
    return got.select("y", "x", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))
