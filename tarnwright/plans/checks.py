"""Named queries over bodies of knowledge and their checks, over whole layer sets, and over what surrounds an answer."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

import tarnwright
from tarnwright.functions import classes, codecs, text
from tarnwright.operators import answers, flow, quality, raster, screening, stats, triggers
from tarnwright.plans import fixtures as fx
from tarnwright.plans.catalogue import CLASSED_SQL, IMG_SQL, LAYER_SQL, TRACE_SQL, _blocks, _traced, classed, query, r6
from tarnwright.sources import corpus, manifest, sinks, tables
from tarnwright.sources.tables import read

CORPUS = fx.PARTS_SQL
HAS_ALL = fx.key_sql("asserts")


# Bodies of knowledge


@query(
    f"""WITH {CORPUS} SELECT {fx.key_sql('id')} AS id, {fx.key_sql('kind')} AS kind, {fx.key_sql('authority')} AS authority, CAST(coalesce(json_array_length(nullif({fx.key_sql('tags')}, '')), 0) AS INTEGER) AS tags,
CAST(coalesce(len(json_keys(nullif({HAS_ALL}, ''))), 0) AS INTEGER) AS asserts, {fx.key_sql('always')} = 'true' AS always, CAST(len(regexp_extract_all(body, '([A-Za-z0-9''’‐-―-]+)')) AS INTEGER) AS words FROM halves"""
)
def corpus_chunks(spark, d):
    rows = corpus.parse_chunks(fx.part_files(spark, d))
    return rows.select("id", "kind", "authority", F.size("tags").alias("tags"), F.size("asserts").alias("asserts"), "always", text.word_count("body").alias("words"))


@query(
    f"""WITH {CORPUS}, a AS (SELECT {fx.key_sql('id')} AS chunk_id, {HAS_ALL} AS a FROM halves WHERE {HAS_ALL} <> ''), k AS (SELECT chunk_id, a, unnest(json_keys(a)) AS key FROM a),
f AS (SELECT key, min(chunk_id) AS chunk_id, arg_min(a, chunk_id) AS a FROM k GROUP BY key)
SELECT key, CAST(json_extract(a, '$.' || key || '.v') AS DOUBLE) AS v, json_extract_string(a, '$.' || key || '.u') AS unit, CAST(json_extract(a, '$.' || key || '.pm') AS DOUBLE) AS pm, chunk_id FROM f"""
)
def corpus_parameters(spark, d):
    return corpus.parameters(corpus.parse_chunks(fx.part_files(spark, d))).select("key", "v", "unit", "pm", "chunk_id")


JSON_TEXT = r"""replace(replace(replace(text, chr(10), ' '), '\', '\\'), '"', '\"')"""


@query(f"""SELECT sha256('[' || string_agg('"' || item_id || {JSON_TEXT} || '"', ',' ORDER BY CAST(item_id AS VARCHAR)) || ']')[1:8] AS version FROM benchmark""")
def corpus_version(spark, d):
    return quality.corpus_version(read(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.regexp_replace("text", "\n", " ").alias("body")))


def _compiled(spark) -> list[triggers.Chunk]:
    return corpus.compiled(fx.corpus_table(spark))[0]


def _authored() -> list[triggers.Chunk]:
    """The same triggers for the SQL, read without the engine."""
    import json

    out = []
    for value, _ in fx.corpus_files():
        head = dict(line.split(": ", 1) for line in value.split("\n---\n")[0].split("\n"))
        out.append(triggers.Chunk(head["id"], triggers.normalise(json.loads(head.get("when", "[]"))), head.get("always") == "true"))
    return out


AUTHORED = _authored()
SWEPT_SQL = f"{fx.sweep_sql(table='lineitem')}, k AS (SELECT *, CASE WHEN distHistoric = 0 THEN 2010 END AS lastWaterYear FROM ({fx.classes_sql('sweep')}))"


def _swept(spark, d):
    """The grid's records with classes, and what else a record has."""
    more = {"lastWaterYear": F.when(F.col("distHistoric") == 0, 2010), "upaKm2": F.lit(None).cast("double"), "runoffDisplacedM3": F.lit(30.0), "codes": F.array().cast("array<string>")}
    return screening.with_classes(fx.sweep(spark, folder=d)).withColumns(more)


def _either(chunks, *kinds: str) -> str:
    return " OR ".join(f"({fx.chunk_sql(c)})" for c in chunks if not kinds or c.kind in kinds) or "false"


def _total(chunks) -> str:
    return " + ".join(f"CAST(coalesce({fx.chunk_sql(c)}, false) AS INTEGER)" for c in chunks)


@query(
    f"""WITH {SWEPT_SQL}, n AS (SELECT *, {_total(AUTHORED)} AS n FROM k)
SELECT count(*) AS records, CAST(min(n) AS INTEGER) AS least, CAST(max(n) AS INTEGER) AS most, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n < 3) AS too_few, count(*) FILTER (NOT coalesce({_either(AUTHORED, 'rule')}, false)) AS no_rule,
count(*) FILTER (NOT coalesce({_either(AUTHORED, 'error', 'limit')}, false)) AS no_limit, count(*) FILTER (intent = 'flood' AND NOT ({_either([c for c in AUTHORED if c.id == 'refusal.not-a-flood-predictor'])})) AS no_refusal FROM n"""
)
def corpus_sweep(spark, d):
    return triggers.coverage(_swept(spark, d), _compiled(spark))


#: A part of the knowledge that leaves holes.
HOLED = [c for c in AUTHORED if c.id not in ("error.budget", "limit.small-tanks", "rule.plot-not-point", "hydro.displacement", "refusal.not-a-flood-predictor")]


@query(
    f"""WITH {SWEPT_SQL}, n AS (SELECT *, {_total(HOLED)} AS n FROM k),
p AS (SELECT record, CASE WHEN n < 3 THEN 'too few' WHEN NOT coalesce({_either(HOLED, 'rule')}, false) THEN 'no rule' WHEN NOT coalesce({_either(HOLED, 'error', 'limit')}, false) THEN 'no limit' END AS problem FROM n
UNION ALL SELECT record, 'no refusal' FROM n WHERE intent = 'flood') SELECT record, problem FROM p WHERE problem IS NOT NULL ORDER BY record, problem LIMIT 6"""
)
def coverage_problems(spark, d):
    return triggers.problems(_swept(spark, d), [c for c in _compiled(spark) if c.id in {h.id for h in HOLED}], "record")


SITES_SQL = f"{CLASSED_SQL}, s AS (SELECT *, true AS hasBuildings, 'consequence' AS intent, 'REFER' AS verdict, CASE WHEN occurrence > 5 THEN 1990 + occurrence % 30 END AS lastWaterYear FROM classed)"


def _sites(spark, d):
    more = {"hasBuildings": F.lit(True), "intent": F.lit("consequence"), "verdict": F.lit("REFER"), "lastWaterYear": F.when(F.col("occurrence") > 5, 1990 + F.col("occurrence") % 30)}
    return classed(spark, d).withColumns(more)


@query(f"WITH {SITES_SQL} " + " UNION ALL ".join(f"SELECT site_id, '{c.id}' AS chunk_id, '{c.kind}' AS kind FROM s WHERE {fx.chunk_sql(c)}" for c in AUTHORED))
def corpus_match(spark, d):
    return triggers.match(_sites(spark, d), _compiled(spark)).select("site_id", "chunk_id", "kind")


#: Conditions on unlike types, and what each is in SQL that has types.
TYPED = [
    (("handM", "eq", "3"), "false"), (("handM", "ne", "3"), "true"), (("handM", "in", ["1", 2, "x"]), "handM = 2"), (("handM", "between", ["1", "4"]), "false"), (("handM", "between", [1, 4]), "handM BETWEEN 1 AND 4"),
    (("ruleId", "eq", 1), "false"), (("ruleId", "ne", 1), "true"), (("ruleId", "lt", 5), "false"), (("ruleId", "lt", "ngu"), "ruleId < 'ngu'"), (("ruleId", "in", "state"), "false"), (("ruleId", "in", ["state", 5]), "ruleId = 'state'"),
    (("inAoi", "eq", 1), "inAoi"), (("inAoi", "eq", "true"), "false"), (("inAoi", "ne", True), "NOT inAoi"), (("encroached", "eq", 0), "encroached = 0"), (("lastWaterYear", "ne", 1995), "lastWaterYear <> 1995"),
    (("lastWaterYear", "gte", "1990"), "false"), (("lastWaterYear", "isnull", None), "lastWaterYear IS NULL"), (("codes", "in", "a"), "site_id % 2 = 0"), (("codes", "in", 5), "false"), (("codes", "eq", ["a", "b"]), "site_id % 2 = 0"), (("nothing", "eq", 1), "false"), (("nothing", "isnull", None), "true"),
]


@query(f"WITH {SITES_SQL} " + " UNION ALL ".join(f"SELECT site_id, {i} AS condition FROM s WHERE {sql}" for i, (_, sql) in enumerate(TYPED)))
def trigger_types(spark, d):
    rows = _sites(spark, d).withColumn("codes", F.when(F.col("site_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"))))
    held = F.array_compact(F.array(*(F.when(triggers.condition(c, rows.schema), F.lit(i)) for i, (c, _) in enumerate(TYPED))))
    return rows.select("site_id", F.explode(held).alias("condition"))


@query(
    f"""WITH {CORPUS}, t AS (SELECT {fx.key_sql('id')} AS chunk_id, {fx.key_sql('when')} AS w FROM halves WHERE NOT regexp_matches(head, '(?m)^no colon'))
SELECT chunk_id, json_extract_string(w, '$[0][0]') AS field FROM t
WHERE json_extract_string(w, '$[0][1]') IN ('eq', 'ne', 'lt', 'lte', 'gt', 'gte', 'in', 'between', 'isnull', 'notnull') AND json_extract_string(w, '$[0][0]') <> 'handM'"""
)
def trigger_fields(spark, d):
    conditions = corpus.trigger_rows(corpus.parse_chunks(fx.part_files(spark, d)))
    return triggers.unknown_of(conditions, spark.createDataFrame([(c,) for c in _sites(spark, d).columns], "field string"))


def _inventory(spark):
    """Files that references point into, with their lines."""
    root = Path(tarnwright.__file__).parent
    rows = [(f"tarnwright/{p.relative_to(root)}", len(p.read_text(encoding="utf-8").splitlines())) for p in root.rglob("*.py")]
    return spark.createDataFrame(rows, "path string, lines int")


#: The faults that part's files have, by the remainders that put them there.
REPORT_SQL = f"""q AS (SELECT p_partkey AS p, p_size, {fx.PART_ID} AS id, {fx.PART_FILE} AS file, {fx.PART_AUTHORITY} AS authority, {fx.PART_KEY} AS key, {fx.PART_FIELD} AS field FROM part),
a AS (SELECT key, count(*) AS n, arg_min(p, id) AS first FROM q WHERE p % 3 = 0 GROUP BY key),
src AS (SELECT 'src/' || s_suppkey || '.py' AS path, s_suppkey * 5 AS lines FROM supplier),
faults("check", id, problem) AS (
  SELECT 'parsing', file, 'no key and value: no colon here' FROM q WHERE p % 53 = 9
  UNION ALL SELECT 'triggers', file, 'no condition: [' || chr(39) || field || chr(39) || ', ' || chr(39) || 'like' || chr(39) || ', ' || p % 13 || ']' FROM q WHERE p % 31 = 7 AND p % 53 <> 9
  UNION ALL SELECT 'fields', id, 'no such field: weather' FROM q WHERE p % 41 = 7 AND p % 31 <> 7 AND p % 53 <> 9
  UNION ALL SELECT 'chunks', id, 'unknown authority' FROM q WHERE authority = 'hearsay'
  UNION ALL SELECT 'chunks', id, 'too long' FROM q WHERE p % 59 = 9
  UNION ALL SELECT 'numbers', id, 'undeclared: 4321' FROM q WHERE p % 43 = 0
  UNION ALL SELECT 'provenance', id, 'no link' FROM q WHERE authority = 'statute'
  UNION ALL SELECT 'provenance', id, CASE WHEN lines IS NULL THEN 'no such file' ELSE 'line beyond the end' END
    FROM q LEFT JOIN src ON path = 'src/' || p % 13 || '.py' WHERE authority = 'repo-derived' AND NOT coalesce(p_size <= lines, false)
  UNION ALL SELECT 'parameters', key, 'declared ' || n || ' times' FROM a WHERE n > 1
  UNION ALL SELECT 'parameters', key, 'missing' FROM (VALUES {', '.join(f'({k!r})' for k in quality.REQUIRED_PARAMETERS)}) AS v(key) WHERE key NOT IN (SELECT key FROM a)
  UNION ALL SELECT 'precision', key, 'more digits than its uncertainty supports' FROM a WHERE first % 21 = 3)"""


@query(f'WITH {REPORT_SQL} SELECT "check", id, problem FROM faults')
def corpus_report(spark, d):
    """A body of knowledge with a file for each part, held against the suppliers' sources: every fault is told, and no other."""
    chunks = tables.kept(corpus.parse_chunks(fx.part_files(spark, d)), "knowledge")
    sources = read(spark, d, "supplier").selectExpr("concat('src/', s_suppkey, '.py') AS path", "CAST(s_suppkey * 5 AS INT) AS lines")
    return quality.corpus_report(chunks, _sites(spark, d).columns, sources)


PAGE_NUMBERS = r"regexp_extract_all(coalesce({}, ''), '(\d+(?:\.\d+)*)', 1)"


@query(
    rf"""WITH p AS (SELECT page_id, url, html, CAST(page_id % 60 AS DOUBLE) AS v, CASE WHEN page_id % 2 = 0 THEN 0.5 END AS pm FROM pages),
l AS (SELECT *, list_concat(['1984', '1999', '2000', '2021'], {PAGE_NUMBERS.format("url || ' f' || page_id || '.md#L' || (page_id % 7)")}) AS literals FROM p), n AS (SELECT DISTINCT page_id, literals, v, pm, unnest({PAGE_NUMBERS.format('html')}) AS number FROM l)
SELECT page_id AS id, number FROM n WHERE NOT list_contains(literals, number) AND NOT coalesce(TRY_CAST(number AS DOUBLE) = v, false) AND NOT coalesce(TRY_CAST(number AS DOUBLE) = pm, false)
AND NOT coalesce(list_contains(list_transform(literals, lambda x: TRY_CAST(x AS DOUBLE)), TRY_CAST(number AS DOUBLE)), false)"""
)
def undeclared_by_chunk(spark, d):
    spec = F.struct((F.col("page_id") % 60).cast("double").alias("v"), F.when(F.col("page_id") % 2 == 0, 0.5).alias("pm"), F.lit(None).cast("double").alias("rel"))
    reference = F.concat(F.lit("f"), "page_id", F.lit(".md#L"), F.col("page_id") % 7)
    return quality.undeclared_by_chunk(read(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("").alias("title"), F.col("html").alias("body"), F.create_map(F.lit("a"), spec).alias("asserts"), F.lit("").alias("source"), "url", reference.alias("repo_ref")))


@query("SELECT page_id, unnest(regexp_extract_all(split_part(split_part(html, '<title>', 2), '</title>', 1), '([A-Za-z]+)', 1)) AS item FROM pages")
def scraped_titles(spark, d):
    return quality.scraped(read(spark, d, "pages").select("page_id", "html"), "html", "<title>", "</title>", "([A-Za-z]+)")


PLAIN_TOKENS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: t <> '' AND (length(t) > 1 OR t BETWEEN '0' AND '9'))"
LINE = "CASE WHEN p_partkey % 10 = 0 THEN '# ' ELSE '' END || p_brand || CASE WHEN p_partkey % 7 = 0 THEN ' or more' ELSE '' END || ' -> ' || p_type || ' ' || p_name"


@query(
    f"""WITH l AS (SELECT p_partkey, {LINE} AS line FROM part), s AS (SELECT p_partkey, {PLAIN_TOKENS.format("split_part(line, '->', 1)")} AS head, list_distinct({PLAIN_TOKENS.format("split_part(line, '->', 2)")}) AS words FROM l WHERE NOT starts_with(line, '#'))
SELECT term, expansion, count(*) AS lines FROM (SELECT head[1] AS term, unnest(words) AS expansion FROM s WHERE len(head) = 1) WHERE term <> expansion GROUP BY ALL"""
)
def synonym_lines(spark, d):
    lines = read(spark, d, "part").select(F.expr(LINE).alias("value"))
    return text.parse_synonyms(lines).groupBy("term", "expansion").agg(F.count("*").alias("lines"))


# Layer sets

WHOLE_SQL = f"""{LAYER_SQL}, w AS (SELECT *, CASE WHEN hand < 2 AND upa > 2 THEN greatest(upa_code, 60) ELSE upa_code END AS code, CASE WHEN x = 0 AND y % 300 = 0 THEN 17 ELSE 255 END AS alpha, CASE WHEN m THEN 1 + (x + y) % 38 ELSE 0 END AS year_code,
  m AND occurrence > 20 AS historic, CASE WHEN upa > 10 THEN (x % 3) * 4 ELSE 40 END AS trunk_m, (x + y) % 90 AS above_min FROM l)"""
UPSTREAM = "(pow(10.0::DOUBLE, upa_code * (log10(1001.0::DOUBLE) / 255)) - 1)"
CHECKS = (
    ("graded distance field", "count(DISTINCT metres)", "true", 30, ">"), ("distance on own mask at most 10 m", "avg(CAST(metres <= 10 AS INTEGER))", "flow_path", 0.95, ">"),
    ("distance grows off the mask", "avg(metres) FILTER (NOT flow_path) - avg(metres) FILTER (flow_path)", "true", 0, ">"), ("occurrence at most 100", "max(occurrence)", "true", 100, "<="), ("upstream codes are graded", "count(DISTINCT upa_code)", "true", 30, ">"),
    ("legal direction codes", "max(d8)", "true", 10, "<="), ("most cells flow", "avg(CAST(d8 BETWEEN 1 AND 8 AS INTEGER))", "true", 0.5, ">"), ("alpha is opaque or absent", "avg(CAST(alpha BETWEEN 1 AND 254 AS INTEGER))", "true", 0.01, "<"),
    ("first year of water", "min(year_code) + 1983", "year_code > 0", 1984, ">="), ("last year of water", "max(year_code) + 1983", "year_code > 0", 2021, "<="), ("median occurrence on former water", "median(occurrence)", "historic", 20, ">"),
    ("flow path drains over 2 km2", f"avg(CAST({UPSTREAM} > 2 AS INTEGER))", "flow_path", 0.85, ">"), ("trunk channels are near a trunk", "avg(CAST(trunk_m <= 10 AS INTEGER))", f"{UPSTREAM} > 10", 0.95, ">"), ("lowest ground is at 0", "min(above_min)", "true", 0, "="),
)


def _checks_sql(source: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({v} AS DOUBLE) AS observed, CAST({t} AS DOUBLE) AS threshold, CAST({v} AS DOUBLE) {h} {t} AS ok FROM {source} WHERE {w}" for n, v, w, t, h in CHECKS)
    return f"SELECT name, round(observed, 6) AS observed, threshold, coalesce(ok, false) AS ok FROM ({rows})"


def _layers(spark, d):
    c = F.col
    px = raster.flow_masks(fx.pixels(spark, d))
    px = px.withColumns({"metres": F.when(c("flow_path"), (c("x") % 2) * 5).otherwise(10 + (c("x") * 3 + c("y")) % 240), "upa_code": codecs.pack_area(c("upa"))})
    return px.selectExpr(
        "* EXCEPT (upa_code)", "CASE WHEN flow_path THEN greatest(upa_code, 60) ELSE upa_code END AS upa_code", "CASE WHEN x = 0 AND y % 300 = 0 THEN 17 ELSE 255 END AS alpha", "CASE WHEN m THEN 1 + (x + y) % 38 ELSE 0 END AS year_code",
        "m AND occurrence > 20 AS historic", "CASE WHEN upa > 10 THEN (x % 3) * 4 ELSE 40 END AS trunk_m", "(x + y) % 90 AS above_min",
    )


@query(f"WITH {WHOLE_SQL}, v AS (SELECT * EXCLUDE (upa_code, code), code AS upa_code FROM w) {_checks_sql('v')}")
def layer_checks(spark, d):
    return quality.layer_report(_layers(spark, d)).select("name", r6("observed"), "threshold", "ok")


DAMAGE = {
    "metres": "100 + metres % 5", "occurrence": "occurrence % 20", "upa_code": "3 + x % 2", "d8": "CASE WHEN x % 2 = 0 THEN 12 ELSE 0 END", "alpha": "CASE WHEN x % 9 = 0 THEN 17 ELSE alpha END", "year_code": "CASE WHEN m THEN 39 + x ELSE 0 END",
    "above_min": "above_min + 1",
}


@query(f"WITH {WHOLE_SQL}, v AS (SELECT * EXCLUDE (upa_code, code), code AS upa_code FROM w), dmg AS (SELECT * REPLACE ({', '.join(f'{e} AS {b}' for b, e in DAMAGE.items())}) FROM v) {_checks_sql('dmg')}")
def layer_checks_of_damage(spark, d):
    """The same checks on layers that were collapsed, averaged, shifted or blurred."""
    px = _layers(spark, d)
    return quality.layer_report(px.select(*(F.expr(DAMAGE[c]).alias(c) if c in DAMAGE else F.col(c) for c in px.columns))).select("name", r6("observed"), "threshold", "ok")


SIZES_SQL = "n AS (SELECT 'orders' AS layer, o_orderkey // 64 AS y, o_orderkey % 64 AS x FROM orders UNION ALL SELECT 'customers', c_custkey // 64, c_custkey % 64 FROM customer UNION ALL SELECT 'again', o_orderkey // 64, o_orderkey % 64 FROM orders)"


def _three_layers(spark, d):
    at = lambda t, k, name: read(spark, d, t).select(F.lit(name).alias("layer"), F.expr(f"{k} DIV 64").alias("y"), (F.col(k) % 64).alias("x"))
    return at("orders", "o_orderkey", "orders").unionByName(at("customer", "c_custkey", "customers")).unionByName(at("orders", "o_orderkey", "again"))


@query(f"WITH {SIZES_SQL}, s AS (SELECT layer, max(y) + 1 AS height, max(x) + 1 AS width FROM n GROUP BY layer), f AS (SELECT height AS h, width AS w FROM s ORDER BY layer LIMIT 1) SELECT layer, height, width, height = h AND width = w AS same FROM s, f")
def layer_dimensions(spark, d):
    return raster.dimensions(_three_layers(spark, d))


@query(f"WITH {SIZES_SQL}, s AS (SELECT layer, max(y) AS h FROM n GROUP BY layer) SELECT 'layers of another size' AS name, CAST(count(*) FILTER (h <> (SELECT h FROM s ORDER BY layer LIMIT 1)) AS DOUBLE) AS observed, 0.0::DOUBLE AS threshold, observed = 0 AS ok FROM s")
def size_checks(spark, d):
    return quality.size_report(_three_layers(spark, d))


ROUTES_SQL = f"""{TRACE_SQL}, v AS (SELECT t.*, upa_code, lag(upa_code) OVER (PARTITION BY trace_id ORDER BY step) AS b FROM told t JOIN cells USING (ix, iy)),
g AS (SELECT trace_id, count(b) AS steps, count(*) FILTER (upa_code < b - 1) AS falls, arg_max(upa_code, step) > arg_min(upa_code, step) AS grew FROM v GROUP BY trace_id HAVING count(*) >= 3)"""


@query(
    f"""WITH RECURSIVE {ROUTES_SQL}, r(name, observed, threshold, ok) AS (SELECT 'routes that loop', CAST(count(*) FILTER (how = 'loop') AS DOUBLE), 0.0::DOUBLE, count(*) FILTER (how = 'loop') = 0 FROM told
UNION ALL SELECT 'steps that lose catchment', sum(falls) / sum(steps), 0.05, sum(falls) / sum(steps) < 0.05 FROM g UNION ALL SELECT 'routes that gain catchment', avg(CAST(grew AS INTEGER)), 0.8, avg(CAST(grew AS INTEGER)) > 0.8 FROM g)
SELECT name, round(observed, 6) AS observed, threshold, ok FROM r"""
)
def route_checks(spark, d):
    routes = tables.kept(_traced(spark, d), "routes")
    falls = flow.monotonicity(routes.join(fx.cells(spark, d).select("ix", "iy", "upa_code"), ["ix", "iy"]), "upa_code")
    return quality.route_report(flow.endings(routes), falls).select("name", r6("observed"), "threshold", "ok")


# Agreement of routes with a mask, over several draws

DRAWS_SQL = f"""{TRACE_SQL}, f AS (SELECT iy * 40 + ix AS trace_id FROM cells WHERE inside AND d8 BETWEEN 1 AND 8), dr AS (SELECT seed, trace_id FROM (SELECT s.range AS seed, trace_id, row_number() OVER (PARTITION BY s.range ORDER BY md5(s.range || ':' || trace_id), trace_id) AS k FROM f, range(3) s) WHERE k <= 400),
b AS (SELECT seed, (iy // 10) * 4 + ix // 10 AS block, count(*) AS cells, count(*) FILTER (upa_code % 5 < 2) AS hits FROM dr JOIN told USING (trace_id) JOIN cells USING (ix, iy) GROUP BY ALL)"""


def _agreement(spark, d):
    cells = fx.cells(spark, d)
    starts = cells.where("inside AND d8 BETWEEN 1 AND 8").select((F.col("iy") * 40 + F.col("ix")).alias("trace_id"), "ix", "iy")
    drawn = None
    for seed in range(3):
        some = stats.sample(starts, "trace_id", 400, seed).select(F.lit(seed).cast("bigint").alias("seed"), "trace_id", "ix", "iy")
        drawn = some if drawn is None else drawn.unionByName(some)
    drawn = tables.kept(drawn, "draws")
    routes = flow.trace(cells, drawn.select("trace_id", "ix", "iy").distinct())
    told = routes.join(drawn.select("seed", "trace_id"), "trace_id")
    return flow.agreement(told, cells.select("ix", "iy", F.expr("(iy DIV 10) * 4 + ix DIV 10").alias("block"), (F.col("upa_code") % 5 < 2).alias("on_flow")))


@query(f"WITH RECURSIVE {DRAWS_SQL} SELECT seed, block, cells, hits FROM b")
def route_agreement(spark, d):
    return _agreement(spark, d)


@query(f"WITH RECURSIVE {DRAWS_SQL}, l AS (SELECT *, hits / cells AS share FROM b WHERE cells >= 100) SELECT seed, count(*) AS blocks, CAST(sum(cells) AS BIGINT) AS cells, round(median(share), 6) AS median, round(min(share), 6) AS least, round(max(share), 6) AS most FROM l GROUP BY seed")
def route_agreement_by_draw(spark, d):
    return flow.agreement_summary(_agreement(spark, d)).select("seed", "blocks", "cells", r6("median"), r6("least"), r6("most"))


@query(f"WITH {fx.CELL_SQL} SELECT round(avg(CAST(upa_code % 5 < 2 AS INTEGER)), 6) AS share FROM cells WHERE inside")
def route_baseline(spark, d):
    return quality.share(fx.cells(spark, d), F.col("upa_code") % 5 < 2, F.col("inside")).select(r6("share"))


SPREAD_SQL = f"""{IMG_SQL}, blk AS (SELECT CAST((y * 4 // 37) * 6 + x * 6 // 64 AS INTEGER) AS block, value > 50 AS p, cls >= 2 AS t FROM img), bc AS (SELECT block, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p <> t) AS wrong, count(*) AS n, count(*) FILTER (t) AS water FROM blk GROUP BY block),
h AS (SELECT seed, block FROM (SELECT s.range AS seed, b.range AS block, row_number() OVER (PARTITION BY s.range ORDER BY md5(s.range || ':' || b.range), b.range) AS k FROM range(6) s, range(24) b) WHERE k <= 8),
sc AS (SELECT seed, sum(tp) / nullif(sum(tp + wrong), 0) AS pooled_iou, median(CASE WHEN n >= 100 AND water > 0 THEN tp / nullif(tp + wrong, 0) END) AS median_block_iou FROM bc JOIN h USING (block) GROUP BY seed)"""


@query(
    """WITH b AS (SELECT DISTINCT o_orderkey // 512 AS block FROM orders), r AS (
  SELECT s.range AS seed, block, row_number() OVER (PARTITION BY s.range ORDER BY md5(s.range || ':' || block), block) AS k FROM b, range(6) s)
SELECT CAST(seed AS INTEGER) AS seed, block FROM r WHERE k <= 8"""
)
def held_out_blocks(spark, d):
    """Eight lines of the picture for each seed, of all that have a pixel."""
    blocks = read(spark, d, "orders").selectExpr("o_orderkey DIV 512 AS block").distinct()
    return stats.hold_out_of(blocks, "block", 8, list(range(6)))


@query(
    f"""WITH {SPREAD_SQL}, f AS (UNPIVOT (SELECT pooled_iou, median_block_iou FROM sc) ON pooled_iou, median_block_iou INTO NAME figure VALUE v)
SELECT figure, round(min(v), 6) AS least, round(max(v), 6) AS most, round(median(v), 6) AS median, count(*) AS draws FROM f GROUP BY figure"""
)
def spread_over_draws(spark, d):
    seeds = stats.holdout_spread(_blocks(spark, d), stats.hold_out(spark, 24, 8, list(range(6))), "predicted", "truth")
    return stats.spread(seeds, ["pooled_iou", "median_block_iou"]).select("figure", r6("least"), r6("most"), r6("median"), "draws")


@query(f"WITH {SPREAD_SQL}, i AS (SELECT tp / nullif(tp + wrong, 0) AS iou FROM bc WHERE n >= 100 AND water > 0) SELECT round(median(iou), 6) AS median, round(avg(iou), 6) AS mean, round(stddev_pop(iou), 6) AS sd, count(iou) AS n FROM i")
def block_moments(spark, d):
    return stats.moments(stats.block_scores(_blocks(spark, d), "predicted", "truth"), "iou").select(r6("median"), r6("mean"), r6("sd"), "n")


# Around an answer


@query(
    f"""WITH {CLASSED_SQL} SELECT site_id, 'Outcome ' || CASE WHEN site_id % 2 = 0 THEN 'REFER' ELSE 'REJECT' END || ' under the ' || ruleId || ' rule: ' || CASE WHEN distPresent < 255 THEN distPresent || ' m from water' ELSE 'farther from water than is measured' END
|| ', plus or minus 20 m. Sources: rule.' || ruleId || ', error.budget.' AS text FROM classed"""
)
def composed_answers(spark, d):
    chunks = F.array(F.concat(F.lit("rule."), "ruleId"), F.lit("error.budget"))
    rows = classed(spark, d).withColumns({"verdict": F.when(F.col("site_id") % 2 == 0, "REFER").otherwise("REJECT"), "uncertaintyM": F.lit(classes.UNCERTAINTY_M), "chunks": chunks})
    return answers.compose(rows).select("site_id", "text")


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[0-9]') THEN 'composed ' || conv_id ELSE text END AS shown, CASE WHEN regexp_matches(text, '[0-9]') THEN 'bare digit' END AS reason FROM (SELECT conv_id, turn, regexp_replace(text, '[\\[{}]', '', 'g') AS text FROM conversations)")
def accepted_answers(spark, d):
    rows = read(spark, d, "conversations").withColumn("text", F.regexp_replace("text", r"[\[{}]", ""))
    rows = rows.withColumns({"faults": F.array_compact(F.array(F.when(answers.bare_digit(F.col("text")), "bare digit"))), "tier0": F.concat(F.lit("composed "), "conv_id")})
    return answers.accepted_text(rows).select("conv_id", "turn", "shown", "reason")


@query(
    """SELECT item_id, 'Question: what of ' || item_id || '?' || chr(10) || 'Site: {"id":' || item_id || '}' || chr(10) || 'Facts: ["f' || item_id || '"]' || chr(10) || '[rule.' || item_id || '] ' || CASE WHEN item_id % 2 = 0 THEN '(unverified) ' ELSE '' END || text || chr(10) || '[limit.a] Small tanks.' AS prompt FROM benchmark"""
)
def prompt_text(spark, d):
    chunk = lambda i, b, v: F.struct(i.alias("id"), b.alias("body"), v.alias("verify"))
    rows = read(spark, d, "benchmark").select(
        "item_id", F.concat(F.lit("what of "), "item_id", F.lit("?")).alias("question"), F.struct(F.col("item_id").alias("id")).alias("site"), F.array(F.concat(F.lit("f"), "item_id")).alias("facts"),
        F.array(chunk(F.concat(F.lit("rule."), "item_id"), F.col("text"), F.col("item_id") % 2 == 0), chunk(F.lit("limit.a"), F.lit("Small tanks."), F.lit(False))).alias("chunks"),
    )
    return answers.prompt(rows).select("item_id", "prompt")


@query(f"WITH {CLASSED_SQL}, s AS (SELECT site_id, plotM * 0.25::DOUBLE AS need, CASE WHEN site_id % 3 > 0 THEN CAST(handM * 5 AS DOUBLE) END AS stored FROM classed) SELECT site_id, CASE WHEN stored IS NOT NULL THEN greatest(need - stored, 0) END AS missing FROM s")
def retention_shortfall(spark, d):
    stored = F.when(F.col("site_id") % 3 > 0, (F.col("handM") * 5).cast("double"))
    return classed(spark, d).select("site_id", classes.shortfall(F.col("plotM") * 0.25, stored).alias("missing"))


@query(f"WITH {CLASSED_SQL} SELECT site_id, round(sqrt(15 * 15 + 7 * 7 + 6 * 6 + handM * handM), 6) AS metres FROM classed")
def error_budget(spark, d):
    """The fixed terms and a site's own."""
    terms = [*map(F.lit, classes.ERROR_TERMS), F.col("handM")]
    return classed(spark, d).select("site_id", F.round(classes.error_of(*terms), 6).alias("metres"))


ASKED = """CASE conv_id % 7 WHEN 0 THEN '{"pack":{},"contract":1,"tool":"t"}' WHEN 1 THEN '{"pack":{},"tool":"t"}' WHEN 2 THEN 'not json' WHEN 3 THEN '' WHEN 4 THEN '{"contract":1,"tool":null}' WHEN 5 THEN '{"pack":null,"contract":1,"tool":2}' ELSE {} END"""


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 404 WHEN conv_id % 5 = 0 THEN 503 WHEN conv_id % 7 IN (0, 5) THEN 200 ELSE 400 END AS status, CASE WHEN turn % 3 = 1 THEN 'no such path' WHEN conv_id % 5 = 0 THEN 'no model is configured'
ELSE CASE conv_id % 7 WHEN 1 THEN 'missing contract' WHEN 2 THEN 'unreadable request' WHEN 3 THEN 'bad request size' WHEN 4 THEN 'missing pack' WHEN 6 THEN 'bad request size' END END AS reason FROM conversations"""
)
def request_status(spark, d):
    body = F.expr(ASKED.replace("ELSE {} END", "ELSE concat('\"', repeat('x', 1048576), '\"') END"))
    rows = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, "/other").otherwise("/ask").alias("path"), body.alias("body"), (F.col("conv_id") % 5 != 0).alias("configured"))
    return answers.request_status(rows).select("conv_id", "turn", "status", "reason")


#: Replies of every shape, and what is to be read from each.
REPLIES = [
    ('{"choices":[]}', None, "no choices"), ('{"choices":[{"message":{"content":"{\\"a\\":1}"},"finish_reason":"stop"}]}', '{"a":1}', None), ('{"choices":[{"message":{"content":"{\\"a\\":"},"finish_reason":"length"}]}', None, "the reply was cut off"),
    ('{"choices":[{"message":{"content":"so so"},"finish_reason":"stop"}]}', None, "the reply is no JSON"), ('{"choices":[{"message":{},"finish_reason":"length"}]}', None, "no content, ended by length"),
    ('{"candidates":[],"promptFeedback":{"blockReason":"SAFETY"}}', None, "blocked: SAFETY"), ('{"candidates":[{"content":{"parts":[{"text":"{\\"b\\":2}"}]}}]}', '{"b":2}', None), ('{"candidates":[{"finishReason":"MAX_TOKENS"}]}', None, "no text, ended by MAX_TOKENS"),
    ('{"content":[{"type":"text"},{"type":"tool_use","input":{"c":3}}]}', '{"c":3}', None), ('{"content":[{"type":"text"}],"stop_reason":"refusal"}', None, "no call, ended by refusal, with text"), ('{"content":[]}', None, "no call, ended by unknown, with nothing"),
]
ERRORS = [('{"error":{"message":"too long"}}', "too long"), ('{"error":{"status":"BUSY"}}', "BUSY"), ('{"error":"plain"}', "plain"), ("<html>\n  no </html>", "blocked before it reached the provider (<html> no </html>)"), ("  ", "no detail"), ('{"a":1}', '{"a":1}')]


def _literal(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


@query(f"WITH r(i, answer, reason) AS (VALUES {', '.join(f'({i}, {_literal(a)}, {_literal(w)})' for i, (_, a, w) in enumerate(REPLIES))}) SELECT conv_id, turn, answer, reason FROM conversations JOIN r ON i = (conv_id * 3 + turn) % {len(REPLIES)}")
def reply_extraction(spark, d):
    body = F.get(F.array(*(F.lit(b) for b, _, _ in REPLIES)), ((F.col("conv_id") * 3 + F.col("turn")) % len(REPLIES)).cast("int"))
    return read(spark, d, "conversations").select("conv_id", "turn", answers.structured(body).alias("r")).select("conv_id", "turn", "r.*")


@query(f"WITH r(i, message) AS (VALUES {', '.join(f'({i}, {_literal(m)})' for i, (_, m) in enumerate(ERRORS))}) SELECT conv_id, turn, message FROM conversations JOIN r ON i = (conv_id + turn) % {len(ERRORS)}")
def provider_errors(spark, d):
    detail = F.get(F.array(*(F.lit(b) for b, _ in ERRORS)), ((F.col("conv_id") + F.col("turn")) % len(ERRORS)).cast("int"))
    return read(spark, d, "conversations").select("conv_id", "turn", answers.provider_message(detail).alias("message"))


# Sources and sinks

GEOJSON = '{"type":"FeatureCollection","features":[{"type":"Feature"},{"type":"Feature"}]}'


@query(
    f"""SELECT page_id, page_id % 4 = 0 AS png, CASE page_id % 4 WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 0 END AS features, page_id % 4 <> 3 AS ok FROM pages"""
)
def format_check(spark, d):
    content = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(manifest.PNG_MAGIC), F.encode("html", "UTF-8"))).when(F.col("page_id") % 4 == 1, F.encode(F.lit(GEOJSON), "UTF-8"))
    content = content.when(F.col("page_id") % 4 == 2, F.encode(F.lit('{"type":"FeatureCollection","features":[]}'), "UTF-8")).otherwise(F.encode("html", "UTF-8"))
    files = read(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), content.alias("content"))
    return manifest.usable(files).select(F.col("path").cast("bigint").alias("page_id"), F.coalesce("png", F.lit(False)).alias("png"), F.col("features").cast("double").alias("features"), F.coalesce("ok", F.lit(False)).alias("ok"))


@query("""SELECT p_partkey, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || (77 + p_partkey % 5) || ',' || (12 + p_partkey % 3) || ']},"properties":{"p_partkey":' || p_partkey || ',"p_size":' || p_size || '}}' AS value FROM part""")
def feature_lines(spark, d):
    geo = F.struct(F.lit("Point").alias("type"), F.array(77 + F.col("p_partkey") % 5, 12 + F.col("p_partkey") % 3).alias("coordinates"))
    rows = read(spark, d, "part").select("p_partkey", "p_size", geo.alias("geo"))
    return sinks.features(rows, "geo", ["p_partkey", "p_size"]).select(F.get_json_object("value", "$.properties.p_partkey").cast("bigint").alias("p_partkey"), "value")


@query("SELECT p_partkey, CAST(NULL AS DOUBLE) AS lost_frac, CAST(NULL AS VARCHAR) AS verdict FROM part")
def optional_columns(spark, d):
    return tables.with_optional(read(spark, d, "part").select("p_partkey"), ["p_partkey"], {"lost_frac": "double", "verdict": "string"})


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, CAST(len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS INTEGER) AS written FROM documents")
def text_lines(spark, d):
    rows = F.split("text", "\n", -1)
    return read(spark, d, "documents").select("doc_id", F.size(rows).alias("lines"), F.size(F.filter(rows, lambda x: x != "")).alias("written"))

