"""Inputs of the named queries: the driver's tables as they are, or put on a grid, and tables made from ranges.

Each comes as a DataFrame and as SQL with the same whole-number arithmetic, so that both engines see the same rows.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwright.operators.quality import REQUIRED_PARAMETERS
from tarnwright.operators.triggers import Chunk
from tarnwright.sources import corpus
from tarnwright.sources.tables import read

WIDTH, HEIGHT = 64, 37
SIDE = 40

#: Pixels are the rows of `orders`, 64 to a line, so the picture grows with the tables.
PIXEL_SQL = """px AS (SELECT CAST(o_orderkey // 64 AS INTEGER) AS y, CAST(o_orderkey % 64 AS INTEGER) AS x FROM orders),
pxb AS (SELECT y, x, (x * 7 + y * 13) % 11 AS transition, (x * 5 + y * 3) % 9 AS landcover, ((x * 3 + y * 11) % 60) / 10.0 AS hand,
  ((x * 17 + y * 29) % 400) / 10.0 AS upa, ((x * x * 7 + y * y * 13 + x * y * 5) % 23) < 6 AS m, ((x * 3 + y * 7) % 101) AS occurrence, ((x + y * 5) % 11) AS d8 FROM px)"""


def pixels(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """A pixel for each row of `orders`; without a folder a small picture of fixed size."""
    ids = spark.range(WIDTH * HEIGHT) if folder is None else read(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    px = ids.select(F.expr("CAST(id DIV 64 AS INT)").alias("y"), F.expr("CAST(id % 64 AS INT)").alias("x"))
    return px.selectExpr(
        "y", "x", "(x * 7 + y * 13) % 11 AS transition", "(x * 5 + y * 3) % 9 AS landcover", "CAST((x * 3 + y * 11) % 60 AS DOUBLE) / 10 AS hand", "CAST((x * 17 + y * 29) % 400 AS DOUBLE) / 10 AS upa",
        "((x * x * 7 + CAST(y AS BIGINT) * y * 13 + x * y * 5) % 23) < 6 AS m", "(x * 3 + y * 7) % 101 AS occurrence", "(x + y * 5) % 11 AS d8",
    )


CELL_SQL = """cells AS (SELECT id % 40 AS ix, id // 40 AS iy, CAST(CASE WHEN id % 40 < 20 THEN CASE WHEN id // 40 = 0 THEN 9 WHEN (id % 40) % 3 = 0 THEN 2 ELSE 3 END
  ELSE ((id % 40) * 7 + (id // 40) * 11 + (id % 40) * (id // 40)) % 11 END AS INTEGER) AS d8, NOT ((id % 40) = 0 AND (id // 40) > 35) AS inside,
  CAST(255 - (id // 40) * 6 + (id % 3) AS INTEGER) AS upa_code FROM (SELECT c_custkey AS id FROM customer))"""


def cells(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """A cell for each row of `customer`, 40 to a line; without a folder a square of fixed size."""
    ids = spark.range(SIDE * SIDE) if folder is None else read(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    return ids.selectExpr(
        "id % 40 AS ix", "id DIV 40 AS iy",
        "CAST(CASE WHEN id % 40 < 20 THEN CASE WHEN id DIV 40 = 0 THEN 9 WHEN (id % 40) % 3 = 0 THEN 2 ELSE 3 END ELSE ((id % 40) * 7 + (id DIV 40) * 11 + (id % 40) * (id DIV 40)) % 11 END AS INT) AS d8",
        "NOT ((id % 40) = 0 AND (id DIV 40) > 35) AS inside", "CAST(255 - (id DIV 40) * 6 + (id % 3) AS INT) AS upa_code",
    )


#: The sites of the screening queries: orders as plots, measurements from the order's numbers.
SITE_SQL = """sites AS (SELECT o_orderkey AS site_id, CASE WHEN o_orderkey % 2 = 0 THEN 'state' ELSE 'ngt' END AS ruleId, o_orderkey % 17 <> 0 AS inAoi,
  CAST((o_orderkey * 7) % 256 AS INTEGER) AS distPresent, CAST((o_custkey * 5) % 256 AS INTEGER) * CAST(o_orderkey % 5 <> 0 AS INTEGER) AS distHistoric,
  CAST((o_orderkey * 3 + o_custkey) % 256 AS INTEGER) AS distDrain, CAST((o_custkey * 11) % 9 AS INTEGER) AS handM, CAST((o_orderkey * 13) % 101 AS INTEGER) AS occurrence,
  CAST(o_orderkey % 10 AS DOUBLE) / 10 AS encroached, CAST(20 + o_orderkey % 200 AS INTEGER) AS plotM FROM orders)"""


def sites(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS site_id", "CASE WHEN o_orderkey % 2 = 0 THEN 'state' ELSE 'ngt' END AS ruleId", "o_orderkey % 17 <> 0 AS inAoi", "CAST((o_orderkey * 7) % 256 AS INT) AS distPresent",
        "CAST((o_custkey * 5) % 256 AS INT) * CAST(o_orderkey % 5 <> 0 AS INT) AS distHistoric", "CAST((o_orderkey * 3 + o_custkey) % 256 AS INT) AS distDrain", "CAST((o_custkey * 11) % 9 AS INT) AS handM",
        "CAST((o_orderkey * 13) % 101 AS INT) AS occurrence", "CAST(o_orderkey % 10 AS DOUBLE) / 10 AS encroached", "CAST(20 + o_orderkey % 200 AS INT) AS plotM",
    )


#: The grid of site records that is swept.
GRID = {
    "inAoi": [True, False], "ruleId": ["state", "ngt"], "verdict": ["REJECT", "REFER", "CONDITIONS", "NO_OBJECTION"], "distPresent": [0, 12, 40, 90, 255], "distHistoric": [0, 12, 40, 90, 255],
    "distDrain": [0, 20, 120, 255], "handM": [0, 1, 3, 12], "occurrence": [5, 60], "encroached": [0.0, 0.9], "hasBuildings": [True, False], "plotM": [30, 120],
    "intent": ["flood", "feasibility", "consequence", "procedure", "evidence"],
}


#: Which of the grid's records a row of `lineitem` is: its number, scattered by a prime, so that all fields vary from the start.
RECORD, SCATTER = "(l_orderkey * 8 + l_linenumber)", 7919


def sweep(spark: SparkSession, grid: dict[str, list] = GRID, folder: str | None = None) -> DataFrame:
    """The product of the grid's values (and record, its number), as one narrow pass over a range: no join.

    With a folder, a record of the grid for each row of `lineitem` there, so that the sweep grows with the tables.
    """
    size = 1
    if folder is not None:
        ids = read(spark, folder, "lineitem").selectExpr(f"{RECORD} AS record", f"{RECORD} * {SCATTER} AS id")
        columns = {"record": F.col("record")}
    else:
        columns = {"record": F.col("id")}
        ids = None
    for name, values in grid.items():
        columns[name] = F.get(F.array(*map(F.lit, values)), (F.expr(f"(id DIV {size}) % {len(values)}")).cast("int"))
        size *= len(values)
    return (spark.range(size) if ids is None else ids).select(*(c.alias(n) for n, c in columns.items()))


def sweep_sql(grid: dict[str, list] = GRID, table: str | None = None) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    size, places, values = 1, [], []
    for k, v in grid.items():
        places.append(f"(list_position([{', '.join(map(lit, v))}], {k}) - 1) * {size}")
        values.append(f"[{', '.join(map(lit, v))}][1 + ({RECORD} * {SCATTER}) // {size} % {len(v)}] AS {k}")
        size *= len(v)
    if table is not None:
        return f"sweep AS (SELECT {RECORD} AS record, {', '.join(values)} FROM {table})"
    return f"sweep AS (SELECT *, {' + '.join(places)} AS record FROM " + ", ".join(f"(SELECT unnest([{', '.join(map(lit, v))}]) AS {k})" for k, v in grid.items()) + ")"


#: A small body of knowledge of our own; ids and triggers as the screening's documentation describes them.
CHUNKS = [
    Chunk("error.budget", always=True),
    Chunk("error.absence-is-not-evidence", [[("verdict", "eq", "NO_OBJECTION")]]),
    Chunk("hydro.floodprone", [[("handClass", "in", ["AT_DRAINAGE_LEVEL", "DEEP_IN_A_WATER_PATH", "LOW_GROUND"])]]),
    Chunk("hydro.downstream", [[("flowClass", "in", ["ON_FLOW_PATH", "ADJACENT"])]]),
    Chunk("hydro.displacement", [[("intent", "eq", "flood")]], always=True),
    Chunk("limit.small-tanks", always=True),
    Chunk("limit.no-drain-capacity", [[("intent", "eq", "flood")]]),
    Chunk("method.buildings", [[("hasBuildings", "eq", True)]]),
    Chunk("option.wetland", [[("distHistoric", "eq", 0), ("occurrence", "gte", 50)], [("distHistoric", "eq", 0)]]),
    Chunk("outcome.reject", [[("verdict", "eq", "REJECT")]]),
    Chunk("outcome.refer", [[("verdict", "eq", "REFER")]]),
    Chunk("refusal.not-a-flood-predictor", [[("intent", "eq", "flood")]], always=True),
    Chunk("refusal.outside-study-area", [[("inAoi", "eq", False)]]),
    Chunk("rule.which-shoreline", [[("retreatM", "gt", 30)]]),
    Chunk("rule.state", [[("ruleId", "eq", "state")]]),
    Chunk("rule.ngt", [[("ruleId", "eq", "ngt")]]),
    Chunk("rule.plot-not-point", [[("plotM", "gte", 5)]]),
    Chunk("rule.prospective", [[("encroached", "gt", 0.1)]]),
    Chunk("scope.building-layer-absent", [[("hasBuildings", "eq", False)]]),
]


def condition_sql(c: tuple) -> str:
    name, op, v = c
    lit = lambda x: f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
    if op == "in":
        return f"{name} IN ({', '.join(map(lit, v))})"
    if op in ("isnull", "notnull"):
        return f"{name} IS {'NOT ' if op == 'notnull' else ''}NULL"
    if op == "between":
        return f"{name} BETWEEN {lit(v[0])} AND {lit(v[1])}"
    return f"{name} {({'eq': '=', 'ne': '<>', 'lt': '<', 'lte': '<=', 'gt': '>', 'gte': '>='})[op]} {lit(v)}"


def chunk_sql(c: Chunk) -> str:
    groups = [" AND ".join(map(condition_sql, g)) for g in c.when]
    return "true" if c.always else " OR ".join(f"({g})" for g in groups)


def classes_sql(source: str) -> str:
    return f"""SELECT *, GREATEST(0, distPresent - distHistoric) AS retreatM,
  CASE WHEN handM = 0 THEN 'AT_DRAINAGE_LEVEL' WHEN handM <= 1 THEN 'DEEP_IN_A_WATER_PATH' WHEN handM <= 2 THEN 'LOW_GROUND' WHEN handM <= 5 THEN 'MARGINAL' ELSE 'ELEVATED' END AS handClass,
  CASE WHEN distDrain = 0 THEN 'ON_FLOW_PATH' WHEN distDrain <= 10 THEN 'ADJACENT' WHEN distDrain <= 70 THEN 'NEAR' WHEN distDrain >= 255 THEN 'UNRESOLVED' ELSE 'OFF' END AS flowClass FROM {source}"""


def corpus_files() -> list[tuple[str, str]]:
    """(text, path) of the body of knowledge that comes with the package."""
    root = Path(__file__).parent / "corpus"
    return [(p.read_text(encoding="utf-8"), f"corpus/{p.relative_to(root)}") for p in sorted(root.rglob("*.md"))]


#: Files that have something wrong with them, each in its own way.
DAMAGED_FILES = [
    ("id: rule.twice\ntitle: One\ntitle: Two\nkind: rule\nauthority: editorial\nasserts: {\"lakeM_state\": {\"v\": 31}}\n---\nA buffer of 31 metres, or is it 32?\n", "corpus/rule/twice.md"),
    ("id: rule.unread\ntitle: T\nkind: rule\nauthority: hearsay\nasserts: {broken\nalways: maybe\nno colon here\n---\nBody.\n", "corpus/rule/unread.md"),
    ("id: limit.fields\ntitle: T\nkind: limit\nauthority: statute\nwhen: [[\"weather\", \"eq\", \"wet\"]]\n---\nBody.\n", "corpus/limit/fields.md"),
    ("id: limit.trigger\ntitle: T\nkind: limit\nauthority: editorial\nwhen: [[\"handM\", \"like\", 1]]\n---\nBody.\n", "corpus/limit/trigger.md"),
    ("id: error.exact\ntitle: T\nkind: error\nauthority: repo-derived\nrepo_ref: a.py#L9\nasserts: {\"depthM\": {\"v\": 1.2345, \"pm\": 1}}\n---\n" + "word " * 121 + "\n", "corpus/error/exact.md"),
]


def corpus_table(spark: SparkSession, files: list[tuple[str, str]] | None = None) -> DataFrame:
    return corpus.parse_chunks(spark.createDataFrame(corpus_files() if files is None else files, "value string, file string"))


def corpus_sql(files: list[tuple[str, str]] | None = None) -> str:
    """The same files as rows (text, file, head, body), with a value by key as a macro would give it."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({text(v)}, {text(f)})" for v, f in (corpus_files() if files is None else files))
    return f"""raw(value, file) AS (VALUES {rows}), halves AS (SELECT file, split_part(value, chr(10) || '---' || chr(10), 1) AS head, trim(split_part(value, chr(10) || '---' || chr(10), 2), ' ' || chr(10)) AS body FROM raw)"""


def key_sql(name: str) -> str:
    return f"regexp_extract(head, '(?m)^{name}: *(.*)$', 1)"


#: A file of knowledge for each part, some of them with a fault. One text for both engines.
PART_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'limit' WHEN 2 THEN 'hydro' ELSE 'error' END"
PART_AUTHORITY = """CASE WHEN p_partkey % 37 = 5 THEN 'hearsay' WHEN p_partkey % 47 = 5 THEN 'statute'
  WHEN p_partkey % 61 = 5 THEN 'repo-derived' ELSE 'editorial' END"""
PART_KEY = (
    "CASE p_partkey " + " ".join(f"WHEN {6 * i} THEN '{k}'" for i, k in enumerate(REQUIRED_PARAMETERS[:12]))
    + " ELSE concat('k', CAST(floor(p_partkey / 6) AS BIGINT)) END"
)
PART_NUMBER = "concat(p_size, CASE WHEN p_partkey % 21 = 3 THEN '.1234' ELSE '' END)"
PART_FIELD = "CASE WHEN p_partkey % 41 = 7 THEN 'weather' ELSE 'handM' END"
PART_FILE = f"concat('corpus/', {PART_KIND}, '/p', p_partkey, '.md')"
PART_ID = f"concat({PART_KIND}, '.p', p_partkey)"
PART_TEXT = f"""concat('id: ', {PART_ID}, chr(10), 'title: ', p_name, chr(10), 'kind: ', {PART_KIND}, chr(10),
  'authority: ', {PART_AUTHORITY}, chr(10), 'tags: ["', p_brand, '", "', p_type, '"]', chr(10),
  CASE WHEN p_partkey % 61 = 5 THEN concat('repo_ref: src/', p_partkey % 13, '.py#L', p_size, chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 3 = 0 THEN concat('asserts: {{"', {PART_KEY}, '": {{"v": ', {PART_NUMBER}, ', "u": "m", "pm": ',
    CASE WHEN p_partkey % 21 = 3 THEN '1' ELSE '0.5' END, '}}}}', chr(10)) ELSE '' END,
  'when: [["', {PART_FIELD}, '", "', CASE WHEN p_partkey % 31 = 7 THEN 'like' ELSE 'gte' END, '", ', p_partkey % 13, ']]', chr(10),
  CASE WHEN p_partkey % 11 = 0 THEN concat('always: true', chr(10)) ELSE '' END,
  CASE WHEN p_partkey % 53 = 9 THEN concat('no colon here', chr(10)) ELSE '' END, '---', chr(10), 'What is known of a ', p_name,
  CASE WHEN p_partkey % 3 = 0 THEN concat(': ', {PART_NUMBER}, ' metres') ELSE '' END,
  CASE WHEN p_partkey % 43 = 0 THEN ' or 4321' ELSE '' END, '.',
  CASE WHEN p_partkey % 59 = 9 THEN repeat(' word', 121) ELSE '' END, chr(10))"""
PARTS_SQL = f"""raw AS (SELECT {PART_TEXT} AS value, {PART_FILE} AS file, p_partkey FROM part),
halves AS (SELECT file, p_partkey, split_part(value, chr(10) || '---' || chr(10), 1) AS head,
  trim(split_part(value, chr(10) || '---' || chr(10), 2), ' ' || chr(10)) AS body FROM raw)"""


def part_files(spark: SparkSession, folder: str) -> DataFrame:
    """value, file of a body of knowledge that has a file for each part."""
    return read(spark, folder, "part").selectExpr(f"{PART_TEXT} AS value", f"{PART_FILE} AS file")
