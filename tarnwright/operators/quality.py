"""Verification as queries: each check is a DataFrame of violations, or a row of a report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwright.functions.codecs import YEAR_EPOCH, unpack_area
from tarnwright.functions.text import numbers, word_count
from tarnwright.operators.raster import dimensions

#: Kinds, authorities, intents; parameters that the screening computes with; years that need no declaration.
KINDS = ("error", "hydro", "limit", "method", "option", "outcome", "precedent", "refusal", "rule", "scope")
INTENTS = ("flood", "feasibility", "consequence", "procedure", "evidence")
EXTERNAL = ("statute", "court", "agency-survey", "dataset-doc")
AUTHORITIES = (*EXTERNAL, "repo-derived", "editorial")
REQUIRED_PARAMETERS = (
    "uncertaintyM", "lakeM_state", "drainM_state", "lakeM_ngt", "drainM_ngt",
    "P_mm", "P_annualMm", "C_pre", "C_post", "dC", "tankerL",
    "handAtM", "handDeepM", "handLowM", "handMarginalM",
    "byteCeiling", "mppM", "jrcScaleM", "meritScaleM",
)
FREE_YEARS = ("1984", "1999", "2000", "2021")
MOST_WORDS = 120
ID_GRAMMAR = r"^[a-z]+\.[a-z0-9]+(?:[.-][a-z0-9]+)*$"


def report(checks: list[tuple[str, DataFrame, float, str]]) -> DataFrame:
    """name, observed, threshold, ok from (name, one-row one-column frame, threshold, comparison)."""
    out = None
    for name, frame, bound, how in checks:
        seen = F.col(frame.columns[0]).cast("double")
        ok = {">": seen > bound, ">=": seen >= bound, "<": seen < bound, "<=": seen <= bound, "=": seen == bound}[how]
        row = frame.select(F.lit(name).alias("name"), seen.alias("observed"), F.lit(float(bound)).alias("threshold"), F.coalesce(ok, F.lit(False)).alias("ok"))
        out = row if out is None else out.unionByName(row)
    return out


def share(rows: DataFrame, when: Column, among: Column | None = None) -> DataFrame:
    rows = rows if among is None else rows.where(among)
    return rows.agg(F.avg(when.cast("double")).alias("share"))


def layer_report(pixels: DataFrame, flow: str = "flow_path", metres: str = "metres") -> DataFrame:
    """The checks of a packed layer set, as far as one pixel table shows them; checks whose bands are absent are left out."""
    c, has = F.col, lambda *bands: set(bands) <= set(pixels.columns)
    checks = [
        ("graded distance field", pixels.agg(F.count_distinct(metres).alias("v")), 30, ">"),
        ("distance on own mask at most 10 m", share(pixels, c(metres) <= 10, c(flow)), 0.95, ">"),
        ("distance grows off the mask", pixels.agg((F.avg(F.when(~c(flow), c(metres))) - F.avg(F.when(c(flow), c(metres)))).alias("v")), 0, ">"),
        ("occurrence at most 100", pixels.agg(F.max("occurrence").alias("v")), 100, "<="),
        ("upstream codes are graded", pixels.agg(F.count_distinct("upa_code").alias("v")), 30, ">"),
        ("legal direction codes", pixels.agg(F.max("d8").alias("v")), 10, "<="),
        ("most cells flow", share(pixels, c("d8").between(1, 8)), 0.5, ">"),
    ]
    if has("alpha"):
        checks.append(("alpha is opaque or absent", share(pixels, c("alpha").between(1, 254)), 0.01, "<"))
    if has("year_code"):
        seen = pixels.where(c("year_code") > 0)
        checks += [("first year of water", seen.agg((F.min("year_code") + YEAR_EPOCH).alias("v")), 1984, ">="), ("last year of water", seen.agg((F.max("year_code") + YEAR_EPOCH).alias("v")), 2021, "<=")]
    if has("historic"):
        checks.append(("median occurrence on former water", pixels.where("historic").agg(F.median("occurrence").alias("v")), 20, ">"))
    if has("trunk_m"):
        upstream = unpack_area(c("upa_code"))
        checks.append(("flow path drains over 2 km2", share(pixels, upstream > 2, c(flow)), 0.85, ">"))
        checks.append(("trunk channels are near a trunk", share(pixels, c("trunk_m") <= 10, upstream > 10), 0.95, ">"))
    if has("above_min"):
        checks.append(("lowest ground is at 0", pixels.agg(F.min("above_min").alias("v")), 0, "="))
    return report(checks)


def size_report(layers: DataFrame) -> DataFrame:
    """One row: layers (layer, y, x) whose size is not that of the first."""
    return report([("layers of another size", dimensions(layers).agg(F.count_if(~F.col("same")).alias("v")), 0, "=")])


def route_report(endings: DataFrame, falls: DataFrame) -> DataFrame:
    """The checks of traced routes: endings (how, routes) and monotonicity rows (cells, steps, falls, grew)."""
    return report(
        [
            ("routes that loop", endings.agg(F.coalesce(F.sum(F.when(F.col("how") == "loop", F.col("routes"))), F.lit(0)).alias("v")), 0, "="),
            ("steps that lose catchment", falls.agg(F.try_divide(F.sum("falls"), F.sum("steps")).alias("v")), 0.05, "<"),
            ("routes that gain catchment", share(falls, F.col("grew")), 0.8, ">"),
        ]
    )


def undeclared_numbers(docs: DataFrame, declared: DataFrame, key: str, text: str) -> DataFrame:
    """key, number of the literals that are declared neither as text nor as a number; declared has one column, literal."""
    found = docs.select(key, F.explode(F.array_distinct(numbers(text))).alias("number")).where(~F.col("number").isin(*FREE_YEARS))
    literals = declared.select(F.col("literal").alias("number")).distinct()
    values = declared.select(F.col("literal").try_cast("double").alias("value")).where("value is not null").distinct()
    rest = found.join(literals, "number", "left_anti").withColumn("value", F.col("number").try_cast("double"))
    return rest.join(values, "value", "left_anti").select(key, "number")


def undeclared_by_chunk(chunks: DataFrame) -> DataFrame:
    """id, number: literals in the title and body of a chunk (id, title, body, asserts, source, url, repo_ref) that the
    chunk itself declares neither as text nor as a number: by its asserts (v, pm, rel), by the digits of its source, link
    and reference, or as one of the years that need no declaration. What another chunk declares does not count."""
    asserted = F.flatten(F.transform(F.map_values("asserts"), lambda s: F.array(s["v"], s["pm"], s["rel"])))
    literals = F.array_union(F.array(*map(F.lit, FREE_YEARS)), numbers(F.concat_ws(" ", "source", "url", "repo_ref")))
    values = F.concat(F.array_compact(asserted), F.array_compact(F.transform(literals, lambda t: t.try_cast("double"))))
    rows = chunks.select("id", literals.alias("literals"), values.alias("values"), F.explode(F.array_distinct(numbers(F.concat_ws(" ", "title", "body")))).alias("number"))
    declared = F.array_contains("literals", F.col("number")) | F.coalesce(F.array_contains("values", F.col("number").try_cast("double")), F.lit(False))
    return rows.where(~declared).select("id", "number")


def secrets(files: DataFrame, text: str, marks: tuple[str, ...]) -> DataFrame:
    """The rows whose text holds one of the marks."""
    hit = F.lit(False)
    for m in marks:
        hit = hit | F.contains(F.col(text), F.lit(m))
    return files.where(hit)


#: Folders and endings that a scan for secrets leaves out, and files that it reads all the same.
SKIPPED_FOLDERS, SKIPPED_ENDS, STILL_READ = (".git", "__pycache__"), (".png", ".json"), ("corpus.json",)


def secret_files(spark: SparkSession, folder: str, marks: tuple[str, ...], folders: tuple[str, ...] = SKIPPED_FOLDERS, ends: tuple[str, ...] = SKIPPED_ENDS, still: tuple[str, ...] = STILL_READ) -> DataFrame:
    """path (below folder), lines: the files of a folder and all below it that hold one of the marks, and in how many lines.

    Files are read line by line, so none is held whole; what is skipped is decided by path before anything is read.
    Spark's listing leaves out names that begin with a dot or an underscore, so such files are never seen.
    """
    base = folder.split("://", 1)[-1].rstrip("/")
    whole = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(whole, F.lit(r"^[a-z]*:/*\Q" + base.lstrip("/") + r"\E/"), F.lit(""))
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    skipped = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, folders))) if folders else F.lit(False)
    for end in ends:
        skipped = skipped | (F.endswith(name, F.lit(end)) & ~name.isin(*still))
    lines = spark.read.text(folder, recursiveFileLookup=True)
    return secrets(lines.where(~skipped).select(path.alias("path"), "value"), "value", marks).groupBy("path").agg(F.count("*").alias("lines"))


def vocabulary_difference(terms: DataFrame, one: str, two: str) -> DataFrame:
    """term, side: terms (side, term) of one side only."""
    a, b = (terms.where(F.col("side") == s).select("term") for s in (one, two))
    return a.subtract(b).withColumn("side", F.lit(one)).unionByName(b.subtract(a).withColumn("side", F.lit(two)))


def repeated_parameters(chunks: DataFrame) -> DataFrame:
    """key, declared, kept: keys of chunks (id, asserts) declared more than once; the first id's stays."""
    rows = chunks.select("id", F.explode("asserts").alias("key", "spec"))
    return rows.groupBy("key").agg(F.count("*").alias("declared"), F.min("id").alias("kept")).where("declared > 1")


def missing_parameters(parameters: DataFrame, required: tuple[str, ...] = REQUIRED_PARAMETERS) -> DataFrame:
    spark = parameters.sparkSession
    return spark.createDataFrame([(k,) for k in required], "key string").join(parameters.select("key"), "key", "left_anti")


def drift(one: DataFrame, two: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """key, one, two: values (key, v) that differ between two copies; aliases (alias, key) name the second's keys."""
    other = two.select("key", F.col("v").alias("two"))
    if aliases is not None:
        named = other.join(aliases.select(F.col("alias").alias("key"), F.col("key").alias("_key")), "key", "left")
        other = named.select(F.coalesce("_key", "key").alias("key"), "two")
    return one.select("key", F.col("v").alias("one")).join(other, "key").where(~F.col("one").eqNullSafe(F.col("two")))


def unmapped(codes: DataFrame, mapping: DataFrame, chunks: DataFrame) -> DataFrame:
    """problem, value: codes without a chunk, mapped codes that nothing gives, chunks that do not exist."""
    parts = (
        ("code without chunk", codes.select(F.col("code").alias("value")), mapping.select(F.col("code").alias("value"))),
        ("mapped but never given", mapping.select(F.col("code").alias("value")), codes.select(F.col("code").alias("value"))),
        ("no such chunk", mapping.select(F.col("chunk").alias("value")), chunks.select(F.col("id").alias("value"))),
    )
    out = None
    for problem, a, b in parts:
        rows = a.distinct().join(b, "value", "left_anti").select(F.lit(problem).alias("problem"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def provenance(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """id, problem: external authorities without a link, and references to lines that a file (path, lines) lacks."""
    path, anchor = F.split_part("repo_ref", F.lit("#"), F.lit(1)), F.split_part("repo_ref", F.lit("#"), F.lit(2))
    lines = F.transform(F.regexp_extract_all(anchor, F.lit(r"L(\d+)"), 1), lambda x: x.cast("int"))
    rows = chunks.select("id", "authority", "url", "repo_ref", path.alias("path"), lines.alias("refs")).join(files.withColumnRenamed("lines", "n_lines"), "path", "left")
    own = F.col("authority") == "repo-derived"
    problem = (
        F.when(F.col("authority").isin(*EXTERNAL) & ~F.coalesce(F.col("url").startswith("http"), F.lit(False)), "no link")
        .when(own & (F.coalesce("repo_ref", F.lit("")) == ""), "no reference")
        .when(own & F.col("n_lines").isNull(), "no such file")
        .when(own & (F.size("refs") == 0), "no lines")
        .when(own & (F.array_max("refs") > F.col("n_lines")), "line beyond the end")
    )
    return rows.select("id", problem.alias("problem")).where("problem is not null")


def decimals(value: Column) -> Column:
    """Characters after the point of a number in its shortest form of six figures: 1234.5678 is 1234.57, 2 of them.

    Below 0.0001 and from a million on that form has an exponent, which counts, if there is a point at all. A number
    between two such forms goes to the nearer one by its exact binary value, to the even one if it lies in the middle:
    99999.95 is a little less than it says and becomes 99999.9. (Below 1e-16 and from 1e16 on such a number goes up.)
    """
    return _let(value.cast("double"), lambda v: _let(F.struct(v.alias("v"), F.format_string("%.6e", v).alias("seven"), F.format_string("%.5e", v).alias("shown")), _decimals))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value worked out once: as a column used many times it would be written out as often."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _decimals(n: Column) -> Column:
    """decimals() of a number v with its forms of seven and six figures."""
    half = lambda c, at: F.split_part(c, F.lit("e"), F.lit(at))
    digits = lambda c: F.regexp_replace(half(c, 1), r"[-.]", "")
    parts = F.struct(
        n["v"].alias("v"), half(n["seven"], 2).try_cast("int").alias("place"), digits(n["seven"]).try_cast("bigint").alias("whole"),
        (n["seven"].try_cast("double") == n["v"]).alias("short"), digits(n["shown"]).alias("six"), half(n["shown"], 2).try_cast("int").alias("power"),
    )

    def told(m: Column) -> Column:
        between = (m["whole"] % 10 == 5) & m["short"]
        below = F.floor(m["whole"] / 10)
        beyond = F.when(between, F.when(m["place"].between(-16, 6), _beyond(m)).when(m["place"].between(7, 15), F.lit(0.0)))
        down = (beyond < 0) | ((beyond == 0) & (below % 2 == 0))
        six = F.when(down, below.cast("string")).otherwise(m["six"])
        figures = F.length(F.regexp_replace(six, "0+$", ""))
        return F.struct(m["v"].alias("v"), figures.alias("figures"), F.when(down, m["place"]).otherwise(m["power"]).alias("power"))

    def shown(m: Column) -> Column:
        figures, power = m["figures"], m["power"]
        plain = F.greatest(F.lit(0), figures - 1 - power)
        long = F.when(figures > 1, figures - 1 + F.greatest(F.lit(4), F.length(F.abs(power).cast("string")) + 2)).otherwise(0)
        return F.when(m["v"] == 0, 0).when(power.between(-4, 5), plain).otherwise(long)

    return _let(parts, lambda m: _let(told(m), shown))


def _beyond(m: Column) -> Column:
    """How far a number v is above the seven figures (whole, place) that it says, by sign: the product with a power of
    ten as the sum of two doubles, so without an error."""
    split = lambda v: 134217729.0 * v - (134217729.0 * v - v)

    def product(t: Column) -> Column:
        x, c, xh, ch = t["x"], t["c"], t["xh"], t["ch"]
        xl, cl = x - xh, c - ch
        return (x * c - m["whole"]) + (((xh * ch - x * c) + xh * cl + xl * ch) + xl * cl)

    x, c = F.abs(m["v"]), F.concat(F.lit("1e"), 6 - m["place"]).try_cast("double")
    return _let(F.struct(x.alias("x"), c.alias("c"), split(x).alias("xh"), split(c).alias("ch")), product)


def overprecise(parameters: DataFrame) -> DataFrame:
    """key, v, pm of values quoted with more than one decimal beyond their uncertainty's; coarse against it is fine."""
    c = F.col
    rows = parameters.where("pm is not null and pm <> 0 and v is not null").where(~(F.abs("v") * 1e-3 > F.abs("pm")))
    return rows.where(decimals(c("v")) > decimals(c("pm")) + 1).select("key", "v", "pm")


def chunk_faults(chunks: DataFrame) -> DataFrame:
    """id, problem of chunks (id, kind, file, title, body, intents): grammar, kind, emptiness, length, intents."""
    c = F.col
    name = F.regexp_extract("file", r"([^/]+)\.md$", 1)
    each = {
        "bad id": ~c("id").rlike(ID_GRAMMAR),
        "unknown kind": ~c("kind").isin(*KINDS),
        "id is not kind.name": c("id") != F.concat_ws(".", "kind", name),
        "empty": (F.trim("title") == "") | (F.trim("body") == ""),
        "too long": word_count(c("body")) > MOST_WORDS,
        "unknown intent": F.size(F.array_except("intents", F.array(*map(F.lit, INTENTS)))) > 0,
    }
    if "authority" in chunks.columns:
        each["unknown authority"] = ~c("authority").isin(*AUTHORITIES)
    if "file" in chunks.columns and "errors" in chunks.columns:
        each["kind is not its folder"] = c("kind") != F.regexp_extract("file", r"([^/]+)/[^/]+\.md$", 1)
    return chunks.select("id", F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(k)) for k, bad in each.items())))).alias("problem"))


def fingerprint(rows: DataFrame, key: str, body: str) -> DataFrame:
    """Eight hexadecimal digits that depend on the rows' keys and bodies, not on their order.

    Each row is digested where it is; the digests' halves are summed, so partial sums are all that is shuffled.
    """
    digest = F.sha2(F.concat_ws("\n", F.col(key).cast("string"), body), 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)"))
    sums = rows.agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"))
    return sums.select(F.substring(F.sha2(F.concat_ws(",", F.col("n").cast("string"), F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string")), 256), 1, 8).alias("version"))


def corpus_report(chunks: DataFrame, fields: list[str], files: DataFrame, required: tuple[str, ...] = REQUIRED_PARAMETERS) -> DataFrame:
    """check, id, problem: everything that is wrong with a body of knowledge (as read by the corpus source), in one table.

    files: path, lines, for references to lines. No row means that all checks passed.
    """
    from tarnwright.operators.triggers import unknown_of
    from tarnwright.sources.corpus import parameters, trigger_rows

    spark, conditions = chunks.sparkSession, trigger_rows(chunks)
    words = chunks.select(word_count("body").alias("w")).orderBy(F.col("w").desc()).limit(12).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"))
    tokens = F.floor(F.col("w") * 1.4) + 400
    named = lambda check, df, key, problem: df.select(F.lit(check).alias("check"), F.col(key).cast("string").alias("id"), problem.alias("problem"))
    known = parameters(chunks)
    parts = [
        named("parsing", chunks.select("file", F.explode("errors").alias("e")), "file", F.col("e")),
        named("triggers", conditions.where("fault IS NOT NULL"), "file", F.col("fault")),
        named("fields", unknown_of(conditions, spark.createDataFrame([(f,) for f in fields], "field string")), "chunk_id", F.concat(F.lit("no such field: "), "field")),
        named("chunks", chunk_faults(chunks), "id", F.col("problem")),
        named("numbers", undeclared_by_chunk(chunks), "id", F.concat(F.lit("undeclared: "), "number")),
        named("provenance", provenance(chunks, files), "id", F.col("problem")),
        named("parameters", repeated_parameters(chunks), "key", F.format_string("declared %d times", "declared")),
        named("parameters", missing_parameters(known, required), "key", F.lit("missing")),
        named("precision", overprecise(known), "key", F.lit("more digits than its uncertainty supports")),
        named("budget", words.where(tokens > 3000), "w", F.lit("the worst pack is too long")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scraped(files: DataFrame, text: str, begin: str, end: str, item: str) -> DataFrame:
    """The files' other columns and item: what a pattern finds between the first `begin` and the next `end` of each text.

    For holding two copies of a list against each other when one of them is in source code.
    """
    after = F.when(F.contains(F.col(text), F.lit(begin)), F.substring_index(F.regexp_replace(text, f"(?s)^.*?{_quoted(begin)}", ""), end, 1))
    return files.withColumn("item", F.explode(F.regexp_extract_all(after, F.lit(item), 1))).drop(text)


def _quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E"


def corpus_version(chunks: DataFrame) -> DataFrame:
    """version: eight hexadecimal digits of the JSON list of the chunks' ids and bodies, by id.

    One row holds the whole list, as its digest is defined so; for tables of any size see fingerprint().
    """
    joined = F.transform(F.array_sort(F.collect_list(F.struct("id", "body"))), lambda c: F.concat(c["id"], c["body"]))
    return chunks.agg(F.substring(F.sha2(F.to_json(joined), 256), 1, 8).alias("version"))
