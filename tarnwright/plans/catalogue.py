"""All named queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwright.functions import classes, codecs, geometry, text
from tarnwright.operators import answers, flow, quality, raster, retrieval, screening, spatial, stats, triggers
from tarnwright.plans import fixtures as fx
from tarnwright.sources import manifest
from tarnwright.sources.tables import read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


# Text and retrieval

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TOKENS = f"list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '' AND t NOT IN ({STOP}) AND (length(t) > 1 OR t BETWEEN '0' AND '9'))"
TOK_SQL = f"tok AS (SELECT doc_id, lang, {TOKENS} AS toks FROM documents)"
QUESTIONS = {"q1": "the lake and the reed er ed", "q2": "thetion 5 mente apache license", "q3": "ciónes und enzu that th"}


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "lang", "text", text.tokenize("text").alias("toks"))


@query(f"WITH {TOK_SQL} SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(list_distinct(toks)) AS INTEGER) AS n_distinct FROM tok")
def tokenize_count(spark, d):
    return documents(spark, d).select("doc_id", F.size("toks").alias("n_tokens"), F.size(F.array_distinct("toks")).alias("n_distinct"))


@query(f"WITH {TOK_SQL}, p AS (SELECT doc_id, unnest(toks) AS term FROM tok) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM p GROUP BY term")
def term_stats(spark, d):
    return retrieval.term_stats(documents(spark, d), "doc_id", "toks")


def _questions(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(QUESTIONS.items()), "query string, question string")
    return rows.select("query", F.explode(text.tokenize("question")).alias("term")).distinct()


BM25_SQL = f"""{TOK_SQL}, qs AS (SELECT DISTINCT query, unnest({TOKENS.replace('lower(text)', 'lower(question)')}) AS term
  FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in QUESTIONS.items())}) AS v(query, question)),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tok) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM tok), dfs AS (SELECT term, count(*) AS df FROM p GROUP BY term),
sc AS (SELECT query, p.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avgdl))) AS score
  FROM p JOIN qs USING (term) JOIN dfs USING (term) JOIN tok ON tok.doc_id = p.doc_id, s GROUP BY query, p.doc_id)"""


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(documents(spark, d), _questions(spark), "doc_id", "toks")


@query(
    f"""WITH {BM25_SQL}, r AS (SELECT query, doc_id, round(score, 6) AS score FROM sc),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r) SELECT query, doc_id, score, rank FROM k WHERE rank <= 20"""
)
def bm25_topk(spark, d):
    return retrieval.top(_bm25(spark, d), "doc_id", 20)


TRIGGERED_SQL = "trig AS (SELECT query, doc_id, source = 'src1' AS always FROM (SELECT doc_id, source FROM documents WHERE lang = 'fr'), (SELECT DISTINCT query FROM qs))"


@query(
    f"""WITH {BM25_SQL}, {TRIGGERED_SQL}, b AS (SELECT query, max(score) AS best FROM sc GROUP BY query),
l AS (SELECT query, doc_id, score / best AS lexical FROM sc JOIN b USING (query)),
f AS (SELECT query, doc_id, CASE WHEN always IS NOT NULL THEN 0.65 ELSE 0 END + 0.35 * coalesce(lexical, 0) AS s, always FROM l FULL JOIN trig USING (query, doc_id))
SELECT query, doc_id, round(CASE WHEN always THEN GREATEST(s, 0.2) ELSE s END, 6) AS score FROM f"""
)
def fused_scores(spark, d):
    fired = read(spark, d, "documents").where("lang = 'fr'").select("doc_id", (F.col("source") == "src1").alias("always"))
    triggered = fired.withColumn("query", F.explode(F.array(*map(F.lit, QUESTIONS))))
    return retrieval.fuse(_bm25(spark, d), triggered, "doc_id").select("query", "doc_id", r6("score"))


@query(
    f"""WITH {TOK_SQL}, qs(query, term) AS (VALUES ('q1', 'lake'), ('q1', 'flood'), ('q2', 'buffer'), ('q3', 'accurate')),
syn AS (SELECT head AS term, unnest(string_split(words, ' ')) AS expansion FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in text.SYNONYMS.items())}) AS v(head, words))
SELECT DISTINCT query, term FROM (SELECT query, term FROM qs UNION ALL SELECT query, expansion FROM qs JOIN syn USING (term))"""
)
def synonym_expansion(spark, d):
    rows = spark.createDataFrame([("q1", "lake"), ("q1", "flood"), ("q2", "buffer"), ("q3", "accurate")], "query string, term string")
    return text.expand(rows, text.synonyms(spark))


@query(
    r"""WITH n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(\d+(?:\.\d+)*)', 1)) AS number FROM documents),
dec AS (SELECT unnest(regexp_extract_all(text, '(\d+(?:\.\d+)*)', 1)) AS literal FROM benchmark UNION ALL SELECT '2' UNION ALL SELECT '0'),
v AS (SELECT DISTINCT TRY_CAST(literal AS DOUBLE) AS value FROM dec WHERE TRY_CAST(literal AS DOUBLE) IS NOT NULL)
SELECT doc_id, number FROM n WHERE number NOT IN ('1984', '1999', '2000', '2021') AND number NOT IN (SELECT literal FROM dec)
AND (TRY_CAST(number AS DOUBLE) IS NULL OR TRY_CAST(number AS DOUBLE) NOT IN (SELECT value FROM v))"""
)
def undeclared_numbers(spark, d):
    declared = read(spark, d, "benchmark").select(F.explode(text.numbers("text")).alias("literal")).unionByName(spark.createDataFrame([("2",), ("0",)], "literal string"))
    return quality.undeclared_numbers(read(spark, d, "documents"), declared, "doc_id", "text")


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'token = \"') OR contains(text, 'AKIA')")
def secret_scan(spark, d):
    return quality.secrets(read(spark, d, "documents"), "text", ('token = "', "AKIA")).select("doc_id", "source")


@query(
    f"""WITH {TOK_SQL}, t AS (SELECT DISTINCT lang AS side, unnest(toks) AS term FROM tok WHERE lang IN ('en', 'de')),
e AS (SELECT term FROM t WHERE side = 'en'), g AS (SELECT term FROM t WHERE side = 'de')
SELECT term, 'en' AS side FROM (SELECT term FROM e EXCEPT SELECT term FROM g) UNION ALL SELECT term, 'de' FROM (SELECT term FROM g EXCEPT SELECT term FROM e)"""
)
def vocab_diff(spark, d):
    terms = documents(spark, d).where(F.col("lang").isin("en", "de")).select(F.col("lang").alias("side"), F.explode("toks").alias("term"))
    return quality.vocabulary_difference(terms, "en", "de")


@query(
    r"""WITH w AS (SELECT len(regexp_extract_all(text, '([A-Za-z0-9''’‐-―-]+)')) AS w FROM documents ORDER BY w DESC LIMIT 12), s AS (SELECT CAST(sum(w) AS BIGINT) AS words FROM w)
SELECT words, CAST(floor(words * 1.4::DOUBLE) AS BIGINT) + 400 AS tokens, CAST(floor(words * 1.4::DOUBLE) AS BIGINT) + 400 <= 3000 AS fits FROM s"""
)
def pack_budget(spark, d):
    return retrieval.pack_budget(read(spark, d, "documents"), text.word_count("text"))


@query(
    r"""WITH m AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'GeoJSON' WHEN 1 THEN 'PNG' ELSE '# see' END || ' layer_' || page_id || ': ' || url AS line FROM pages)
SELECT page_id, CASE WHEN regexp_matches(line, 'https://\S+') THEN CASE WHEN page_id % 3 = 0 THEN 'GEOJSON' ELSE 'PNG' END END AS kind, nullif(regexp_extract(line, '([A-Za-z0-9_-]+):\s*https://', 1), '') AS name,
nullif(regexp_extract(line, '(https://\S+)', 1), '') AS url FROM m"""
)
def manifest_parse(spark, d):
    kind = F.when(F.col("page_id") % 3 == 0, "GeoJSON").when(F.col("page_id") % 3 == 1, "PNG").otherwise("# see")
    lines = read(spark, d, "pages").select("page_id", F.concat(kind, F.lit(" layer_"), "page_id", F.lit(": "), "url").alias("line"))
    return lines.select("page_id", *(c.alias(k) for k, c in manifest.fields(F.col("line")).items()))


# Projections and codecs


@query("SELECT l_orderkey, l_linenumber, (l_orderkey & 26) = 0 AS landsat_clear, (l_partkey & 3072) = 0 AS sentinel_clear, round(l_quantity * 0.0000275 - 0.2, 6) AS reflectance FROM lineitem")
def qa_bitmask(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", codecs.bits_clear(F.col("l_orderkey"), 1, 3, 4).alias("landsat_clear"), codecs.bits_clear(F.col("l_partkey"), 10, 11).alias("sentinel_clear"),
        F.round(codecs.reflectance(F.col("l_quantity")), 6).alias("reflectance"),
    )


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice + l_quantity <> 0 THEN round((l_extendedprice - l_quantity) / (l_extendedprice + l_quantity), 6) END AS nd FROM lineitem")
def normalized_difference(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(codecs.normalized_difference(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("nd"))


PACK_SQL = "CAST(floor(log10(1 + LEAST(o_totalprice / 500, 1000)) * (255 / log10(1001.0::DOUBLE)) + 0.5) AS SMALLINT)"


@query(f"SELECT o_orderkey, {PACK_SQL} AS code FROM orders")
def upa_log_pack(spark, d):
    return read(spark, d, "orders").select("o_orderkey", codecs.pack_area(F.col("o_totalprice") / 500).alias("code"))


@query(
    """SELECT event_id, CAST(event_id % 256 AS INTEGER) AS code, CAST(event_id % 256 AS SMALLINT) AS back,
round(pow(10.0::DOUBLE, event_id % 256 * (log10(1001.0::DOUBLE) / 255)) - 1, 6) AS km2 FROM events"""
)
def upa_round_trip(spark, d):
    codes = read(spark, d, "events").select("event_id", (F.col("event_id") % 256).cast("int").alias("code"))
    codes = codes.withColumn("km2", codecs.unpack_area(F.col("code")))
    return codes.select("event_id", "code", r6("km2"), codecs.pack_area(F.col("km2")).alias("back"))


@query(
    """SELECT event_id, event_id % 266 - 10 AS code, CAST(CASE event_id % 266 - 10 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 WHEN 8 THEN 4 WHEN 16 THEN 5 WHEN 32 THEN 6 WHEN 64 THEN 7 WHEN 128 THEN 8 WHEN 0 THEN 9 WHEN -1 THEN 10 ELSE 0 END AS INTEGER) AS d8
FROM events"""
)
def d8_remap(spark, d):
    code = F.col("event_id") % 266 - 10
    return read(spark, d, "events").select("event_id", code.alias("code"), codecs.remap_direction(code).alias("d8"))


@query(
    """WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 11) / 10.0::DOUBLE END AS lost, (c_custkey % 7) / 6.0::DOUBLE AS flow, c_custkey % 50 * 1.0::DOUBLE AS upa, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey % 13) * 1.0::DOUBLE END AS hand FROM customer),
s AS (SELECT c_custkey, lost, flow, GREATEST(coalesce(lost, 0), coalesce(flow, 0)) * log10(upa + 1) / (GREATEST(coalesce(hand, 50), 0) + 1) * 100 AS score FROM b)
SELECT c_custkey, round(score, 6) AS risk_score, CASE WHEN coalesce(lost, 0) > 0.5 THEN 'RED_FORMER_WATER_BODY' WHEN coalesce(flow, 0) > 0.5 THEN 'RED_BLOCKS_DRAINAGE' WHEN GREATEST(coalesce(lost, 0), coalesce(flow, 0)) > 0.15 THEN 'AMBER_PARTIAL' ELSE 'GREEN_CLEAR' END AS verdict
FROM s WHERE score > 1"""
)
def risk_score(spark, d):
    rows = read(spark, d, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE (c_custkey % 11) / 10D END AS lost", "(c_custkey % 7) / 6D AS flow", "c_custkey % 50 * 1D AS upa",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey % 13) * 1D END AS hand",
    )
    c = F.col
    scored = rows.withColumn("risk_score", classes.risk_score(c("lost"), c("flow"), c("upa"), c("hand"))).where("risk_score > 1")
    return scored.select("c_custkey", r6("risk_score"), classes.risk_verdict(c("lost"), c("flow")).alias("verdict"))


@query(
    """WITH c AS (SELECT s_suppkey, 60 + s_suppkey % 40 + 0.25::DOUBLE AS w, 0.125::DOUBLE + (s_suppkey % 7) / 8.0::DOUBLE AS wide,
  s_suppkey % 120 - 60 + 0.5::DOUBLE AS s, 0.0625::DOUBLE + (s_suppkey % 5) / 16.0::DOUBLE AS high FROM supplier)
SELECT s_suppkey, round(wide * 111.320::DOUBLE * cos(radians(s + high / 2)) * high * 110.574::DOUBLE, 6) AS km2 FROM c"""
)
def area_km2(spark, d):
    """The ground of a supplier's area, each somewhere else."""
    boxes = read(spark, d, "supplier").selectExpr(
        "s_suppkey", "60 + s_suppkey % 40 + 0.25D AS west", "s_suppkey % 120 - 60 + 0.5D AS south",
        "0.125D + (s_suppkey % 7) / 8D AS wide", "0.0625D + (s_suppkey % 5) / 16D AS high",
    )
    west, south = F.col("west"), F.col("south")
    return boxes.select("s_suppkey", F.round(geometry.ground_km2(west, south, west + F.col("wide"), south + F.col("high")), 6).alias("km2"))


@query(
    """WITH p AS (SELECT l_orderkey, l_linenumber, 77.63::DOUBLE + ((l_partkey % 2048) + 0.5::DOUBLE) / 2048 * (77.75::DOUBLE - 77.63::DOUBLE) AS lon, 12.97::DOUBLE - ((l_suppkey % 1195) + 0.5::DOUBLE) / 1195 * (12.97::DOUBLE - 12.90::DOUBLE) AS lat FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(round_even(lon / (1 / 1200::DOUBLE), 0) AS BIGINT) AS ix, CAST(round_even(lat / (1 / 1200::DOUBLE), 0) AS BIGINT) AS iy FROM p"""
)
def lattice_index(spark, d):
    a = geometry.AREAS["bengaluru"]
    li = read(spark, d, "lineitem")
    lon, lat = geometry.bin_lon(F.col("l_partkey") % 2048, 2048, a), geometry.bin_lat(F.col("l_suppkey") % 1195, 1195, a)
    return li.select("l_orderkey", "l_linenumber", geometry.lattice(lon).alias("ix"), geometry.lattice(lat).alias("iy"))


# Rasters in time


def images(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events")
    return ev.select((F.col("event_id") % 37).cast("int").alias("y"), (F.col("user_id") % 64).cast("int").alias("x"), "ts", "value", (F.col("event_id") % 4).cast("int").alias("cls"))


IMG_SQL = "img AS (SELECT CAST(event_id % 37 AS INTEGER) AS y, CAST(user_id % 64 AS INTEGER) AS x, ts, value, CAST(event_id % 4 AS INTEGER) AS cls FROM events)"


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE (month(l_shipdate) >= 10 OR month(l_shipdate) <= 1) AND l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'")
def season_filter(spark, d):
    li = read(spark, d, "lineitem")
    return li.where(raster.in_season(F.col("l_shipdate")) & raster.between_dates(F.col("l_shipdate"), "1995-01-01", "1997-01-01")).select("l_orderkey", "l_linenumber", "l_shipdate")


@query(f"WITH {IMG_SQL} SELECT y, x, round(median(value), 6) AS value FROM img GROUP BY y, x")
def median_composite(spark, d):
    return raster.median_composite(images(spark, d), ["value"]).select("y", "x", r6("value"))


@query(f"WITH {IMG_SQL}, n AS (SELECT y, x, cls, count(*) AS n FROM img GROUP BY ALL) SELECT y, x, CAST(arg_min(cls, -n * 100 + cls) AS INTEGER) AS cls FROM n GROUP BY y, x")
def mode_composite(spark, d):
    return raster.mode_composite(images(spark, d), "cls")


@query(f"WITH {IMG_SQL} SELECT y, x, CAST(max(CASE WHEN cls >= 2 THEN year(ts) - 1983 ELSE 0 END) AS INTEGER) AS last_code, CAST(max(CASE WHEN cls >= 2 THEN 1 ELSE 0 END) AS INTEGER) AS any_water FROM img GROUP BY y, x")
def last_event_code(spark, d):
    return raster.last_year_code(images(spark, d), F.col("cls") >= 2, F.year("ts"), codecs.YEAR_EPOCH)


# Masks and neighbourhoods

ERA_SQL = f"""{fx.PIXEL_SQL}, eras AS (SELECT y, x, transition IN (1, 3, 4, 6, 7, 8) AS historic, transition IN (1, 2, 4, 5, 7, 8) AS present,
((transition IN (1, 3, 4, 6, 7, 8) AND transition NOT IN (1, 2, 4, 5, 7, 8)) OR transition IN (3, 6)) AND landcover NOT IN (0, 3) AS lost, landcover FROM pxb),
eras2 AS (SELECT *, lost AND landcover = 6 AS encroached FROM eras)"""


@query(f"WITH {ERA_SQL} SELECT y, x, historic, present, lost, encroached FROM eras2")
def water_eras(spark, d):
    return raster.water_eras(fx.pixels(spark, d)).select("y", "x", "historic", "present", "lost", "encroached")


@query(
    f"""WITH {ERA_SQL}, u AS (UNPIVOT (SELECT count(*) FILTER (historic) AS historic, count(*) FILTER (present) AS present, count(*) FILTER (lost) AS lost, count(*) FILTER (encroached) AS encroached FROM eras2)
ON historic, present, lost, encroached INTO NAME mask VALUE pixels) SELECT mask, pixels, round(pixels * 0.0404496::DOUBLE, 6) AS hectares FROM u"""
)
def mask_area(spark, d):
    return raster.mask_area(raster.water_eras(fx.pixels(spark, d)), ["historic", "present", "lost", "encroached"], 0.0404496).select("mask", "pixels", r6("hectares"))


@query(
    f"""WITH RECURSIVE {fx.PIXEL_SQL}, c AS (SELECT y, x FROM pxb WHERE m), o AS (SELECT a.range AS dy, b.range AS dx FROM range(-1, 2) a, range(-1, 2) b), w AS (SELECT y, x, y AS ry, x AS rx FROM c
UNION SELECT w.y, w.x, c.y, c.x FROM w CROSS JOIN o JOIN c ON c.y = w.ry + o.dy AND c.x = w.rx + o.dx) SELECT y, x FROM w GROUP BY y, x HAVING count(*) >= 4"""
)
def min_patch(spark, d):
    return raster.min_patch(fx.pixels(spark, d).where("m"))


@query(
    f"""WITH {fx.PIXEL_SQL}, c AS (SELECT y, x FROM pxb WHERE m), s(dy, dx) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0))
SELECT c.y, c.x FROM c CROSS JOIN s LEFT JOIN c o ON o.y = c.y + s.dy AND o.x = c.x + s.dx GROUP BY c.y, c.x HAVING count(o.y) < 4"""
)
def mask_edge(spark, d):
    return raster.mask_edge(fx.pixels(spark, d).where("m"))


@query(
    f"""WITH {fx.PIXEL_SQL}, c AS (SELECT y, x FROM pxb WHERE m AND x < 9 AND y % 40 < 12)
SELECT p.y, p.x, CAST(floor(LEAST(sqrt(min((p.y - c.y) * (p.y - c.y) + (p.x - c.x) * (p.x - c.x))) * 10, 255) + 0.5) AS INTEGER) AS metres FROM px p, c GROUP BY p.y, p.x"""
)
def distance_field(spark, d):
    return raster.distance_field(fx.pixels(spark, d).withColumn("near", F.col("m") & (F.col("x") < 9) & (F.col("y") % 40 < 12)), "near")


POSES = ("as_is", "p.y", "p.x"), ("upside_down", "h - p.y", "p.x"), ("mirrored", "p.y", "63 - p.x"), ("turned", "h - p.y", "63 - p.x")


@query(
    f"WITH {fx.PIXEL_SQL}, s AS (SELECT max(y) AS h FROM px), o AS (SELECT y, x, h, ((x * x * 7 + (h - y) * (h - y) * 13 + x * (h - y) * 5) % 23) < 6 AS m FROM px, s) "
    + " UNION ALL ".join(f"SELECT '{n}' AS pose, round(avg(CASE WHEN p.m = o.m THEN 1.0 ELSE 0.0 END), 6) AS match FROM pxb p JOIN o ON o.y = {y} AND o.x = {x}" for n, y, x in POSES)
)
def flip_diagnosis(spark, d):
    px = fx.pixels(spark, d)
    h = px.agg(F.max("y")).first()[0]
    layers = px.withColumn("flipped", F.expr(f"((x * x * 7 + CAST({h} - y AS BIGINT) * ({h} - y) * 13 + x * ({h} - y) * 5) % 23) < 6"))
    return raster.flip_diagnosis(layers, "m", "flipped", h + 1, fx.WIDTH).select("pose", r6("match"))


# Flow

NEXT_X = "CASE d8 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 4 THEN -1 WHEN 5 THEN -1 WHEN 6 THEN -1 WHEN 8 THEN 1 WHEN 3 THEN 0 WHEN 7 THEN 0 END"
NEXT_Y = "CASE d8 WHEN 1 THEN 0 WHEN 2 THEN -1 WHEN 3 THEN -1 WHEN 4 THEN -1 WHEN 5 THEN 0 WHEN 6 THEN 1 WHEN 7 THEN 1 WHEN 8 THEN 1 END"
TRACE_SQL = f"""{fx.CELL_SQL}, walk AS (SELECT iy * 40 + ix AS trace_id, 0 AS step, ix, iy, d8, [iy * 1000 + ix] AS path FROM cells WHERE inside
UNION ALL SELECT trace_id, step + 1, c.ix, c.iy, c.d8, list_append(path, c.iy * 1000 + c.ix) FROM (SELECT *, ix + {NEXT_X} AS nx, iy + {NEXT_Y} AS ny FROM walk) w JOIN cells c ON c.ix = w.nx AND c.iy = w.ny
WHERE c.inside AND step < 199 AND NOT list_contains(path, c.iy * 1000 + c.ix)),
told AS (SELECT trace_id, step, ix, iy, d8, CASE WHEN step = max(step) OVER (PARTITION BY trace_id) THEN CASE WHEN d8 = 9 THEN 'mouth' WHEN d8 = 10 THEN 'depression' WHEN d8 NOT BETWEEN 1 AND 8 THEN 'nodata'
WHEN step >= 199 THEN 'capped' WHEN list_contains(path, (iy + {NEXT_Y}) * 1000 + ix + {NEXT_X}) THEN 'loop' ELSE 'edge' END END AS how FROM walk)"""


def _traced(spark: SparkSession, d: str) -> DataFrame:
    cells = fx.cells(spark, d)
    starts = cells.select((F.col("iy") * 40 + F.col("ix")).alias("trace_id"), "ix", "iy")
    return flow.trace(cells, starts)


@query(f"WITH RECURSIVE {TRACE_SQL} SELECT trace_id, CAST(step AS INTEGER) AS step, ix, iy, how FROM told")
def d8_trace(spark, d):
    return _traced(spark, d).select("trace_id", "step", "ix", "iy", "how")


@query(f"WITH RECURSIVE {TRACE_SQL} SELECT how, count(*) AS routes, CAST(sum(step + 1) AS BIGINT) AS cells FROM told WHERE how IS NOT NULL GROUP BY how")
def route_endings(spark, d):
    return flow.endings(_traced(spark, d))


@query(
    f"""WITH RECURSIVE {fx.CELL_SQL},
st AS (SELECT ix, iy, ix + {NEXT_X} AS nx, iy + {NEXT_Y} AS ny FROM cells WHERE inside AND d8 BETWEEN 1 AND 8),
s AS (
  SELECT c.ix, c.iy, coalesce(t.ix, c.ix) AS nx, coalesce(t.iy, c.iy) AS ny FROM cells c
  LEFT JOIN st ON st.ix = c.ix AND st.iy = c.iy LEFT JOIN cells t ON t.ix = st.nx AND t.iy = st.ny AND t.inside
  WHERE c.inside),
r AS (
  SELECT ix, iy, ix AS tx, iy AS ty FROM s
  UNION SELECT r.ix, r.iy, s.nx, s.ny FROM r JOIN s ON s.ix = r.tx AND s.iy = r.ty),
ends AS (SELECT ix, iy FROM s WHERE nx = ix AND ny = iy),
ring AS (
  SELECT s.ix, s.iy FROM s JOIN r ON r.ix = s.nx AND r.iy = s.ny AND r.tx = s.ix AND r.ty = s.iy
  WHERE s.nx <> s.ix OR s.ny <> s.iy)
SELECT r.ix, r.iy, r.tx, r.ty, false AS looped FROM r JOIN ends e ON e.ix = r.tx AND e.iy = r.ty
UNION ALL
SELECT r.ix, r.iy, arg_min(r.tx, r.ty * 100000 + r.tx), min(r.ty), true
FROM r JOIN ring g ON g.ix = r.tx AND g.iy = r.ty GROUP BY r.ix, r.iy"""
)
def d8_terminal(spark, d):
    return flow.terminals(fx.cells(spark, d))


@query(
    f"""WITH RECURSIVE {TRACE_SQL}, v AS (SELECT t.*, upa_code, lag(upa_code) OVER (PARTITION BY trace_id ORDER BY step) AS b FROM told t JOIN cells USING (ix, iy))
SELECT trace_id, count(*) AS cells, count(b) AS steps, count(*) FILTER (upa_code < b - 1) AS falls, arg_max(upa_code, step) > arg_min(upa_code, step) AS grew, arg_max(upa_code, step) >= arg_min(upa_code, step) AS held
FROM v GROUP BY trace_id HAVING count(*) >= 3"""
)
def route_monotonicity(spark, d):
    valued = _traced(spark, d).join(fx.cells(spark, d).select("ix", "iy", "upa_code"), ["ix", "iy"])
    return flow.monotonicity(valued, "upa_code").select("trace_id", "cells", "steps", "falls", "grew", "held")


# Screening

RULES_SQL = "rules(ruleId, lakeM, drainM) AS (VALUES ('state', 30, 25), ('ngt', 75, 50))"
CLASSED_SQL = f"{fx.SITE_SQL}, classed AS ({fx.classes_sql('sites')})"
CASCADE = (
    ("NOT inAoi", "refer.outside-study-area", "REFER"), ("distPresent = 0", "reject.on-present-water", "REJECT"), ("distHistoric = 0 AND occurrence >= 50", "reject.on-lasting-bed", "REJECT"),
    ("distHistoric = 0 AND encroached > 0.1", "reject.built-on-bed", "REJECT"), ("distPresent + 20 <= lakeM", "reject.inside-buffer", "REJECT"), ("distHistoric = 0 AND handM = 0", "refer.low-bed", "REFER"),
    ("distHistoric = 0", "refer.former-bed", "REFER"), ("distPresent > lakeM AND distHistoric <= lakeM AND retreatM > 30", "refer.shoreline-disagreement", "REFER"),
    ("abs(distPresent - lakeM) <= 20", "refer.within-uncertainty", "REFER"), ("distDrain <= drainM", "refer.drain-buffer", "REFER"), ("handM <= 1", "conditions.low-ground", "CONDITIONS"),
)


def classed(spark: SparkSession, d: str) -> DataFrame:
    return screening.with_classes(fx.sites(read(spark, d, "orders")))


@query(f"WITH {CLASSED_SQL} SELECT site_id, retreatM, handClass, flowClass FROM classed")
def site_classes(spark, d):
    return classed(spark, d).select("site_id", "retreatM", "handClass", "flowClass")


@query(
    f"WITH {CLASSED_SQL}, {RULES_SQL} SELECT site_id, ruleId, CASE {' '.join(f"WHEN {w} THEN '{c}'" for w, c, _ in CASCADE)} ELSE 'none' END AS code, CASE {' '.join(f"WHEN {w} THEN '{v}'" for w, _, v in CASCADE)} ELSE 'NO_OBJECTION' END AS verdict, inAoi AS measured FROM classed JOIN rules USING (ruleId)"
)
def screen_sites(spark, d):
    return screening.screen(classed(spark, d), screening.rulesets(spark)).select("site_id", "ruleId", "code", "verdict", "measured")


@query(
    f"""WITH {fx.SITE_SQL}, v AS (SELECT site_id, plotM * plotM * (60 / 1000::DOUBLE) * 0.55::DOUBLE AS v FROM sites)
SELECT site_id, round(v, 6) AS displaced_m3, round(v * sqrt((24 / 60::DOUBLE) ** 2 + (0.15::DOUBLE / 0.55::DOUBLE) ** 2), 6) AS error_m3,
round(floor(v / pow(10::DOUBLE, floor(log10(v)) - 1) + 0.5) * pow(10::DOUBLE, floor(log10(v)) - 1), 6) AS shown_m3, round(v * 1000 / 6000, 6) AS tankers FROM v"""
)
def runoff_displacement(spark, d):
    return screening.runoff(fx.sites(read(spark, d, "orders"))).select("site_id", *map(r6, ("displaced_m3", "error_m3", "shown_m3", "tankers")))


OPTION_SQL = {o[0]: (o[1], o[2], [(" AND ".join(map(fx.condition_sql, g)), len(g)) for g in sorted(o[3], key=len, reverse=True)]) for o in screening.OPTIONS}


@query(
    f"""WITH {CLASSED_SQL}, s AS (SELECT *, CASE WHEN site_id % 3 = 0 THEN NULL ELSE plotM * 1.0 END AS retentionRequiredM3 FROM classed),
f AS ({' UNION ALL '.join(f"SELECT site_id, '{n}' AS option, {r} AS declared, {str(own).lower()} AS own, CASE {' '.join(f'WHEN {w} THEN {k}' for w, k in gs)} END AS conditions FROM s" for n, (r, own, gs) in OPTION_SQL.items())}),
g AS (SELECT *, bool_or(own) OVER (PARTITION BY site_id) AS any_own FROM f WHERE conditions IS NOT NULL)
SELECT site_id, CAST(row_number() OVER (PARTITION BY site_id ORDER BY conditions DESC, declared) AS INTEGER) AS place, option, CAST(conditions AS INTEGER) AS conditions FROM g WHERE any_own"""
)
def options_panel(spark, d):
    rows = classed(spark, d).withColumn("retentionRequiredM3", F.when(F.col("site_id") % 3 != 0, F.col("plotM") * 1.0))
    return screening.options(rows)


SATURATED = ", ".join(f"CASE WHEN {c} < 255 THEN '\"{c}\":' || {c} END" for c in ("distPresent", "distHistoric", "distDrain"))


@query(
    f"""WITH {CLASSED_SQL}, {RULES_SQL}, s AS (SELECT *, CASE {' '.join(f"WHEN {w} THEN '{c}'" for w, c, _ in CASCADE)} ELSE 'none' END AS code,
  CASE {' '.join(f"WHEN {w} THEN '{v}'" for w, _, v in CASCADE)} ELSE 'NO_OBJECTION' END AS verdict FROM classed JOIN rules USING (ruleId))
SELECT site_id, '{{' || concat_ws(',', '"site_id":' || site_id, '"ruleId":"' || ruleId || '"', '"lakeM":' || lakeM, '"drainM":' || drainM, '"plotM":' || plotM, '"verdict":"' || verdict || '"', '"code":"' || code || '"',
  CASE WHEN inAoi THEN '"measured":{{' || concat_ws(',', {SATURATED}, '"handM":' || handM, '"occurrence":' || occurrence) || '}}' END, '"uncertaintyM":20') || '}}' AS certificate FROM s"""
)
def certificates(spark, d):
    return screening.certificate(screening.screen(classed(spark, d), screening.rulesets(spark)))


HITS_SQL = " || ',' || ".join(f"CASE WHEN {fx.chunk_sql(c)} THEN '{c.id}' ELSE '' END" for c in fx.CHUNKS)


@query(
    f"WITH {CLASSED_SQL}, s AS (SELECT *, true AS hasBuildings, 'flood' AS intent, 'REFER' AS verdict FROM classed), m AS ("
    + " UNION ALL ".join(f"SELECT site_id, '{c.id}' AS chunk_id, '{c.kind}' AS kind FROM s WHERE {fx.chunk_sql(c)}" for c in fx.CHUNKS)
    + ") SELECT site_id, chunk_id, kind FROM m"
)
def trigger_match(spark, d):
    rows = classed(spark, d).withColumns({"hasBuildings": F.lit(True), "intent": F.lit("flood"), "verdict": F.lit("REFER")})
    return triggers.match(rows, fx.CHUNKS).select("site_id", "chunk_id", "kind")


REFUSED = " OR ".join(fx.chunk_sql(c) for c in fx.CHUNKS if c.id == "refusal.not-a-flood-predictor")
KIND_OF = {k: " OR ".join(f"({fx.chunk_sql(c)})" for c in fx.CHUNKS if c.kind in k) for k in (("rule",), ("error", "limit"))}


@query(
    f"""WITH {fx.sweep_sql(table='lineitem')}, k AS ({fx.classes_sql('sweep')}), n AS (SELECT *, {' + '.join(f"CAST({f'({fx.chunk_sql(c)})'} AS INTEGER)" for c in fx.CHUNKS)} AS n FROM k)
SELECT count(*) AS records, CAST(min(n) AS INTEGER) AS least, CAST(max(n) AS INTEGER) AS most, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n < 3) AS too_few, count(*) FILTER (NOT ({KIND_OF[('rule',)]})) AS no_rule,
count(*) FILTER (NOT ({KIND_OF[('error', 'limit')]})) AS no_limit, count(*) FILTER (intent = 'flood' AND NOT ({REFUSED})) AS no_refusal FROM n"""
)
def coverage_sweep(spark, d):
    return triggers.coverage(screening.with_classes(fx.sweep(spark, folder=d)), fx.CHUNKS)


# Parameters and corpus checks

#: A parameter for each part: the first few are ones that have to be there, two parts in a row share a key.
PARAM_KEY = "CASE p_partkey " + " ".join(f"WHEN {3 * i} THEN '{k}'" for i, k in enumerate(quality.REQUIRED_PARAMETERS[:12])) + " ELSE concat('k', CAST(floor(p_partkey / 2) AS BIGINT)) END"
PARAM_SQL = f"p AS (SELECT concat('rule.p', p_partkey) AS id, {PARAM_KEY} AS key, CAST(p_size AS DOUBLE) AS v, p_partkey AS p FROM part)"


def _parameters(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").selectExpr("concat('rule.p', p_partkey) AS id", f"{PARAM_KEY} AS key", "CAST(p_size AS DOUBLE) AS v", "p_partkey AS p")


@query(f"WITH {PARAM_SQL} SELECT key, count(*) AS declared, min(id) AS kept FROM p GROUP BY key HAVING count(*) > 1")
def param_uniqueness(spark, d):
    return quality.repeated_parameters(_parameters(spark, d).select("id", F.create_map("key", F.struct("v")).alias("asserts")))


@query(
    f"""WITH {PARAM_SQL}, o AS (SELECT key, v + CASE WHEN p % 7 = 0 THEN 0.5 ELSE 0 END AS v FROM p WHERE p % 2 = 1)
SELECT p.key, p.v AS one, o.v AS two FROM p JOIN o USING (key) WHERE p.v <> o.v"""
)
def param_drift(spark, d):
    """The odd parts' copy of the values, a third of them under another name, against all."""
    odd = _parameters(spark, d).where("p % 2 = 1")
    other = odd.selectExpr("CASE WHEN p % 3 = 0 THEN concat('also ', key) ELSE key END AS key", "v + CASE WHEN p % 7 = 0 THEN 0.5D ELSE 0D END AS v")
    aliases = odd.where("p % 3 = 0").selectExpr("concat('also ', key) AS alias", "key")
    return quality.drift(_parameters(spark, d), other, aliases)


@query(f"WITH {PARAM_SQL} SELECT key FROM (VALUES {', '.join(f'({k!r})' for k in quality.REQUIRED_PARAMETERS)}) AS v(key) WHERE key NOT IN (SELECT key FROM p)")
def missing_parameters(spark, d):
    return quality.missing_parameters(_parameters(spark, d))


MEASURED_SQL = "m AS (SELECT 'p' || p_partkey AS key, p_retailprice * pow(10.0::DOUBLE, p_partkey % 7 - 5) AS v, (1 + p_size) / 10.0::DOUBLE AS pm FROM part)"


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").selectExpr("concat('p', p_partkey) AS key", "p_retailprice * pow(10D, p_partkey % 7 - 5) AS v", "(1 + p_size) / 10D AS pm")


@query(
    f"""WITH {MEASURED_SQL}, n AS (SELECT *, length(split_part(printf('%g', v), '.', 2)) AS dv, length(split_part(printf('%g', pm), '.', 2)) AS dp FROM m)
SELECT key, v, pm FROM n WHERE NOT abs(v) * 1e-3::DOUBLE > abs(pm) AND dv > dp + 1"""
)
def overprecise_parameters(spark, d):
    return quality.overprecise(_measured(spark, d))


@query("SELECT l_orderkey, l_linenumber, CAST(length(split_part(printf('%g', l_extendedprice * 1.4142135623730951::DOUBLE * pow(10.0::DOUBLE, l_orderkey % 13 - 8)), '.', 2)) AS INTEGER) AS decimals FROM lineitem")
def shown_decimals(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quality.decimals(F.col("l_extendedprice") * 2**0.5 * F.pow(F.lit(10.0), F.col("l_orderkey") % 13 - 8)).alias("decimals"))


#: Numbers of seven figures that end in 5, as near as a double comes.
TIE, TENS = "(1000005 + l_orderkey * 7919 % 900000 * 10)", [f"1e{k}" for k in range(18)]


@query(
    f"""SELECT l_orderkey, l_linenumber, CAST(length(split_part(printf('%g', {TIE} / [{", ".join(f"{k}::DOUBLE" for k in TENS)}][1 + (l_orderkey + l_linenumber) % 18]), '.', 2)) AS INTEGER) AS decimals
FROM lineitem"""
)
def shown_decimals_of_ties(spark, d):
    tie = F.expr(f"{TIE} / get(array({', '.join(f'CAST({k} AS DOUBLE)' for k in TENS)}), CAST((l_orderkey + l_linenumber) % 18 AS INT))")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quality.decimals(tie).alias("decimals"))


# Grids, histograms, scores


@query(
    f"""WITH {IMG_SQL}, c AS (SELECT CAST(x * 16 // 64 AS INTEGER) AS cx, CAST(y * 9 // 37 AS INTEGER) AS cy, count(*) AS px, min(y * 64 + x) AS f FROM img GROUP BY 1, 2 ORDER BY px DESC, f LIMIT 10)
SELECT cx, cy, px, round(77.63::DOUBLE + (cx + 0.5) / 16 * (77.75::DOUBLE - 77.63::DOUBLE), 6) AS lon, round(12.97::DOUBLE - (cy + 0.5) / 9 * (12.97::DOUBLE - 12.90::DOUBLE), 6) AS lat FROM c"""
)
def grid_hotspots(spark, d):
    a = geometry.AREAS["bengaluru"]
    return spatial.hotspots(images(spark, d), 64, 37, 16, geometry.bins_down(a, 16), 10, a).select("cx", "cy", "px", r6("lon"), r6("lat"))


VALUES_SQL = "v AS (SELECT l_orderkey, l_linenumber, l_discount * 20 - 1 AS v FROM lineitem), h AS (SELECT CAST(CASE WHEN v = 1 THEN 255 ELSE floor((v + 1) / 2 * 256) END AS INTEGER) AS bin, count(*) AS n FROM v WHERE v BETWEEN -1 AND 1 GROUP BY 1)"


def _values(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select((F.col("l_discount") * 20 - 1).alias("v"))


@query(f"WITH {VALUES_SQL} SELECT bin, n FROM h")
def histogram_256(spark, d):
    return stats.histogram(_values(spark, d), "v")


@query(
    f"""WITH {VALUES_SQL}, b AS (SELECT CAST(range AS INTEGER) AS bin FROM range(256)), e AS (SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN h USING (bin)),
s AS (SELECT bin, sum(n) OVER w AS w0, sum(n * bin) OVER w AS s0, sum(n) OVER () AS w, sum(n * bin) OVER () AS s FROM e WINDOW w AS (ORDER BY bin)),
t AS (SELECT bin, CAST(w0 AS DOUBLE) * (w - w0) * pow((s0 / GREATEST(w0, 1)::DOUBLE - (s - s0) / GREATEST(w - w0, 1)::DOUBLE) / 128, 2) AS between_ FROM s)
SELECT bin, (bin + 0.5::DOUBLE) / 128 - 1 AS threshold, round(between_, 3) AS "between" FROM t ORDER BY between_ DESC, bin LIMIT 1"""
)
def otsu_threshold(spark, d):
    return stats.otsu(stats.histogram(_values(spark, d), "v")).select("bin", "threshold", F.round("between", 3).alias("between"))


SCORED_SQL = """lab AS (SELECT doc_id, n_chars > 1500 AS predicted, quality = 1 AS truth FROM labels JOIN documents USING (doc_id))"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", (F.col("n_chars") > 1500).alias("predicted"), (F.col("quality") == 1).alias("truth"))


COUNT_SQL = "count(*) FILTER (predicted AND truth) AS tp, count(*) FILTER (predicted AND NOT truth) AS fp, count(*) FILTER (NOT predicted AND truth) AS fn, count(*) FILTER (NOT predicted AND NOT truth) AS tn"
SCORE_SQL = "round(tp / nullif(tp + fp + fn, 0), 6) AS iou, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1"


@query(f"WITH {SCORED_SQL}, c AS (SELECT {COUNT_SQL} FROM lab) SELECT tp, fp, fn, tn, {SCORE_SQL} FROM c")
def confusion_scores(spark, d):
    return stats.confusion(_labelled(spark, d), "predicted", "truth").select("tp", "fp", "fn", "tn", *map(r6, ("iou", "precision", "recall", "f1")))


BLOCK_SQL = f"{IMG_SQL}, blk AS (SELECT CAST((y * 4 // 37) * 6 + x * 6 // 64 AS INTEGER) AS block, value > 50 AS predicted, cls >= 2 AS truth FROM img), bc AS (SELECT block, {COUNT_SQL} FROM blk GROUP BY block)"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    px = images(spark, d)
    return px.select(stats.block_of(F.col("y"), F.col("x"), 37, 64, 6, 4).alias("block"), (F.col("value") > 50).alias("predicted"), (F.col("cls") >= 2).alias("truth"))


@query(f"WITH {BLOCK_SQL} SELECT block, tp, fp, fn, tn, {SCORE_SQL} FROM bc WHERE tp + fp + fn + tn >= 100 AND tp + fn > 0")
def block_scores(spark, d):
    return stats.block_scores(_blocks(spark, d), "predicted", "truth").select("block", "tp", "fp", "fn", "tn", *map(r6, ("iou", "precision", "recall", "f1")))


@query(
    f"""WITH {BLOCK_SQL}, sp AS (SELECT CAST(s.range AS INTEGER) AS seed, CAST(b.range AS INTEGER) AS block FROM range(6) s, range(24) b WHERE (b.range * 7 + s.range * 5) % 3 = 0)
SELECT seed, round(sum(tp) / nullif(sum(tp + fp + fn), 0), 6) AS pooled_iou, round(median(CASE WHEN tp + fp + fn + tn >= 100 AND tp + fn > 0 THEN tp / nullif(tp + fp + fn, 0) END), 6) AS median_block_iou,
count(*) FILTER (tp + fp + fn + tn >= 100 AND tp + fn > 0) AS blocks FROM bc JOIN sp USING (block) GROUP BY seed"""
)
def holdout_spread(spark, d):
    splits = spark.range(6 * 24).selectExpr("CAST(id % 6 AS INT) AS seed", "CAST(id DIV 6 AS INT) AS block").where("(block * 7 + seed * 5) % 3 = 0")
    return stats.holdout_spread(_blocks(spark, d), splits, "predicted", "truth").select("seed", r6("pooled_iou"), r6("median_block_iou"), "blocks")


@query("SELECT o_orderkey FROM orders ORDER BY md5('0:' || o_orderkey), o_orderkey LIMIT 400")
def seeded_sample(spark, d):
    return stats.sample(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 400, 0)


# Spatial joins

ZONE_SQL = "z AS (SELECT s_suppkey AS zone_id, (s_suppkey * 7) % 50 AS x0, s_suppkey * 2 AS y0, 3 + s_suppkey % 9 AS wd, 2 + s_suppkey % 5 AS hg FROM supplier)"


def zones(spark: SparkSession, d: str) -> DataFrame:
    """Triangles and rectangles in turn, one a supplier."""
    rows = read(spark, d, "supplier").selectExpr("s_suppkey AS zone_id", "CAST((s_suppkey * 7) % 50 AS DOUBLE) AS x0", "CAST(s_suppkey * 2 AS DOUBLE) AS y0", "CAST(3 + s_suppkey % 9 AS DOUBLE) AS wd", "CAST(2 + s_suppkey % 5 AS DOUBLE) AS hg")
    p = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    box = F.array(p("x0", "y0"), p("x0 + wd", "y0"), p("x0 + wd", "y0 + hg"), p("x0", "y0 + hg"))
    return rows.select("zone_id", box.alias("ring"))


IN_ZONE = "x + 0.5 > x0 AND x + 0.5 < x0 + wd AND y + 0.5 > y0 AND y + 0.5 < y0 + hg"


@query(f"WITH {fx.PIXEL_SQL}, {ZONE_SQL} SELECT zone_id, count(y) AS pixels, round(avg(hand), 6) AS hand, round(avg(upa), 6) AS upa FROM z LEFT JOIN pxb ON {IN_ZONE} GROUP BY zone_id")
def zonal_mean(spark, d):
    return spatial.zonal_mean(fx.pixels(spark, d), zones(spark, d), ["hand", "upa"]).select("zone_id", "pixels", r6("hand"), r6("upa"))


@query(f"WITH {fx.PIXEL_SQL}, {ZONE_SQL} SELECT DISTINCT zone_id FROM z JOIN pxb ON {IN_ZONE} WHERE hand < 0.5")
def zones_touching(spark, d):
    return spatial.touching(fx.pixels(spark, d).where("hand < 0.5"), zones(spark, d)).select("zone_id")


@query(
    f"""WITH {fx.PIXEL_SQL}, pl AS (SELECT s_suppkey AS plot_id, (s_suppkey * 13) % 64 AS px, s_suppkey * 2 AS py, 1 + s_suppkey % 6 AS radius FROM supplier)
SELECT plot_id, count(*) AS pixels, min(hand) AS min_hand, CAST(max(occurrence) AS INTEGER) AS max_occurrence FROM pl JOIN pxb ON (x - px) * (x - px) + (y - py) * (y - py) <= radius * radius GROUP BY plot_id"""
)
def disc_probe(spark, d):
    plots = read(spark, d, "supplier").selectExpr("s_suppkey AS plot_id", "(s_suppkey * 13) % 64 AS px", "s_suppkey * 2 AS py", "1 + s_suppkey % 6 AS radius")
    return spatial.disc_probe(fx.pixels(spark, d), plots, ["hand"], ["occurrence"])


@query(
    """WITH p AS (SELECT c_custkey AS point_id, (c_custkey * 37) % 3000 * 1.0::DOUBLE AS x, (c_custkey * 53) % 2000 * 1.0::DOUBLE AS y FROM customer),
s AS (SELECT s_suppkey % 5 AS route_id, (s_suppkey * 90) % 3000 * 1.0::DOUBLE AS ax, (s_suppkey * 60) % 2000 * 1.0::DOUBLE AS ay, (s_suppkey * 90) % 3000 + 90.0::DOUBLE AS bx, (s_suppkey * 60) % 2000 + (s_suppkey % 3) * 45.0::DOUBLE AS b_y FROM supplier),
t AS (SELECT route_id, point_id, x, y, ax, ay, bx, b_y, LEAST(GREATEST(((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)), 0), 1) AS t FROM p, s),
d AS (SELECT route_id, point_id, sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (b_y - ay), 2)) AS metres FROM t)
SELECT route_id, point_id, round(min(metres), 6) AS metres FROM d WHERE metres <= 150 GROUP BY ALL"""
)
def corridor_join(spark, d):
    points = read(spark, d, "customer").selectExpr("c_custkey AS point_id", "(c_custkey * 37) % 3000 * 1D AS x", "(c_custkey * 53) % 2000 * 1D AS y")
    segments = read(spark, d, "supplier").selectExpr(
        "s_suppkey % 5 AS route_id", "(s_suppkey * 90) % 3000 * 1D AS ax", "(s_suppkey * 60) % 2000 * 1D AS ay", "(s_suppkey * 90) % 3000 + 90D AS bx", "(s_suppkey * 60) % 2000 + (s_suppkey % 3) * 45D AS by"
    )
    return spatial.corridor(points, segments, 150.0).select("route_id", "point_id", r6("metres"))


@query(
    """WITH s AS (SELECT c_custkey AS site_id, (c_custkey * 37) % 300 * 1.0::DOUBLE AS x, (c_custkey * 53) % 200 * 1.0::DOUBLE AS y FROM customer),
p AS (SELECT s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'water' WHEN 1 THEN 'settlement' ELSE 'road' END AS kind, (s_suppkey * 41) % 300 * 1.0::DOUBLE AS px, (s_suppkey * 29) % 200 * 1.0::DOUBLE AS py FROM supplier),
j AS (SELECT site_id, name, (x - px) * (x - px) + (y - py) * (y - py) AS sq FROM s JOIN p ON kind <> 'water' AND (x - px) * (x - px) + (y - py) * (y - py) <= 2500),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY sq, name) AS k FROM j) SELECT s.site_id, name, round(sqrt(sq), 6) AS distance FROM s LEFT JOIN r ON r.site_id = s.site_id AND k = 1"""
)
def nearest_name(spark, d):
    sites = read(spark, d, "customer").selectExpr("c_custkey AS site_id", "(c_custkey * 37) % 300 * 1D AS x", "(c_custkey * 53) % 200 * 1D AS y")
    places = read(spark, d, "supplier").selectExpr("s_name AS name", "CASE s_suppkey % 3 WHEN 0 THEN 'water' WHEN 1 THEN 'settlement' ELSE 'road' END AS kind", "(s_suppkey * 41) % 300 * 1D AS px", "(s_suppkey * 29) % 200 * 1D AS py")
    return spatial.nearest_name(sites, places, reach=50.0).select("site_id", "name", r6("distance"))


# Answers

ANSWER_SQL = r"""a AS (SELECT conv_id, turn, text, role = 'user' AS flood, [CAST(turn AS VARCHAR), 'x'] AS cited, ['0', '1', '2', '3', 'x'] AS pack FROM conversations)"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    s = F.lit
    return read(spark, d, "conversations").select(
        "conv_id", "turn", "text", s("REFER").alias("verdict"), F.when(F.col("turn") % 5 == 0, "REJECT").otherwise("REFER").alias("screened"), F.array(F.col("turn").cast("string"), s("x")).alias("cited"),
        F.array(*map(s, ("0", "1", "2", "3", "x"))).alias("pack"), F.when(F.col("role") == "user", "flood").otherwise("evidence").alias("intent"), F.when(F.col("turn") % 2 == 0, F.array(s("r"))).otherwise(F.array().cast("array<string>")).alias("refused"),
    )


@query(f"WITH {ANSWER_SQL}, u AS (SELECT conv_id, turn, unnest(cited) AS c, pack FROM a) SELECT conv_id, turn, c AS unknown FROM u WHERE NOT list_contains(pack, c)")
def citation_check(spark, d):
    return _answers(spark, d).select("conv_id", "turn", F.explode(answers.unknown_citations(F.col("cited"), F.col("pack"))).alias("unknown"))


@query(
    rf"""WITH {ANSWER_SQL} SELECT conv_id, turn, concat_ws('; ', CASE WHEN regexp_matches(regexp_replace(regexp_replace(text, '\{{\{{[a-zA-Z0-9_.]+\}}\}}', '', 'g'), '\[[^\]]*\]', '', 'g'), '[0-9]') THEN 'bare digit' END,
CASE WHEN turn % 5 = 0 THEN 'wrong verdict' END, CASE WHEN turn > 3 THEN 'unknown citation' END, CASE WHEN flood AND turn % 2 = 1 THEN 'no refusal' END,
CASE WHEN regexp_matches(lower(text), '{"|".join(answers.BANNED)}') THEN 'banned phrase' END) AS faults FROM a"""
)
def answer_validation(spark, d):
    return answers.validate(_answers(spark, d)).select("conv_id", "turn", F.array_join("faults", "; ").alias("faults"))


@query(
    f"""WITH {BM25_SQL}, r AS (SELECT query, doc_id, round(score, 6) AS score FROM sc), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r), t AS (SELECT * FROM k WHERE rank <= 20)
SELECT query, doc_id, rank FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.query = t.query AND o.rank < t.rank AND abs(o.doc_id - t.doc_id) = 1)"""
)
def conflict_filter(spark, d):
    ranked = retrieval.top(_bm25(spark, d), "doc_id", 20)
    ids = read(spark, d, "documents").select(F.col("doc_id").alias("one"))
    pairs = ranked.select(F.col("doc_id").alias("one")).distinct().join(ids, "one").select("one", (F.col("one") + 1).alias("two"))
    return retrieval.without_conflicts(ranked, pairs, "doc_id").select("query", "doc_id", "rank")


INTENT_CASES = " ".join(f"WHEN list_has_any(toks, [{', '.join(repr(w) for w in ws.split())}]) THEN '{k}'" for k, ws in retrieval.INTENT_WORDS.items())


@query(f"WITH t AS (SELECT conv_id, turn, {TOKENS} AS toks FROM conversations) SELECT conv_id, turn, CASE {INTENT_CASES} ELSE 'feasibility' END AS intent FROM t")
def question_intent(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", retrieval.intent(F.col("text")).alias("intent"))


# Verification

LAYER_SQL = f"{fx.PIXEL_SQL}, l AS (SELECT *, hand < 2 AND upa > 2 AS flow_path, CASE WHEN hand < 2 AND upa > 2 THEN (x % 2) * 5 ELSE 10 + (x * 3 + y) % 240 END AS metres, CAST(floor(log10(1 + upa) * (255 / log10(1001.0::DOUBLE)) + 0.5) AS INTEGER) AS upa_code FROM pxb)"


@query(
    f"""WITH {LAYER_SQL}, r(name, observed, threshold, how) AS (
SELECT 'graded distance field', count(DISTINCT metres) * 1.0::DOUBLE, 30.0::DOUBLE, '>' FROM l UNION ALL SELECT 'distance on own mask at most 10 m', avg(CAST(metres <= 10 AS INTEGER)), 0.95, '>' FROM l WHERE flow_path
UNION ALL SELECT 'distance grows off the mask', avg(metres) FILTER (NOT flow_path) - avg(metres) FILTER (flow_path), 0, '>' FROM l UNION ALL SELECT 'occurrence at most 100', max(occurrence), 100, '<=' FROM l
UNION ALL SELECT 'upstream codes are graded', count(DISTINCT upa_code), 30, '>' FROM l UNION ALL SELECT 'legal direction codes', max(d8), 10, '<=' FROM l UNION ALL SELECT 'most cells flow', avg(CAST(d8 BETWEEN 1 AND 8 AS INTEGER)), 0.5, '>' FROM l)
SELECT name, round(observed, 6) AS observed, threshold, CASE how WHEN '>' THEN observed > threshold ELSE observed <= threshold END AS ok FROM r"""
)
def dq_report(spark, d):
    c = F.col
    px = raster.flow_masks(fx.pixels(spark, d))
    px = px.withColumns({"metres": F.when(c("flow_path"), (c("x") % 2) * 5).otherwise(10 + (c("x") * 3 + c("y")) % 240), "upa_code": codecs.pack_area(c("upa"))})
    return quality.layer_report(px).select("name", r6("observed"), "threshold", "ok")
