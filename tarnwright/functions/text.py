"""Text as columns: tokens, numbers, words, synonyms. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no content in a question about a site.
STOP_WORDS = (
    "a an the and or of to in on at is are was were be been it its this "
    "that these those for from with as by if then than so such not no "
    "what which who whom whose when where why how "
    "do does did done doing can could will would shall should may might must "
    "have has had having am being "
    "i me my we us our you your he she him her they them their "
    "about into onto over under above below out up down "
    "again more most other some any all both each few own same too very just now "
    "here there thing things okay ok please tell say"
).split()

#: Words that expand a question's.
SYNONYMS = {
    "flood": "flooding inundation inundated waterlogging waterlogged overflow submerge",
    "level": "depth deep height rise stands",
    "build": "construct construction constructing develop development builder",
    "allowed": "allow permitted permission legal lawful sanction sanctioned approve approval feasible",
    "reject": "rejected refuse refused denied",
    "drain": "drainage rajakaluve kaluve channel nala storm",
    "lake": "tank kere waterbody pond reservoir",
    "buffer": "setback margin zone boundary distance",
    "encroach": "encroachment encroached occupied grabbed",
    "runoff": "discharge outflow shed sheds",
    "plot": "site land parcel property khata",
    "accurate": "accuracy reliable confidence trust certainty precision",
    "source": "sources provenance dataset evidence citation",
    "happens": "happen effect effects impact impacts consequence consequences result",
    "downstream": "below downhill receiving neighbour neighbours",
}

NUMBER = r"\d+(?:\.\d+)*"
WORD = "[A-Za-z0-9'’‐-―-]+"


def tokenize(text: Column | str, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-cased runs of a-z and 0-9 without stop words and single letters; single digits stay."""
    parts = F.split(F.lower(F.col(text) if isinstance(text, str) else text), "[^a-z0-9]+")
    return F.filter(parts, lambda t: ~t.isin("", *stop) & ((F.length(t) > 1) | t.between("0", "9")))


def numbers(text: Column | str) -> Column:
    """All number literals, dotted ones whole."""
    return F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1)


def word_count(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1))


def synonyms(spark, table: dict[str, str] = SYNONYMS) -> DataFrame:
    """term, expansion; a head never expands to itself."""
    rows = [(k, e) for k, v in table.items() for e in sorted(set(v.split()) - {k})]
    return spark.createDataFrame(rows, "term string, expansion string")


def parse_synonyms(lines: DataFrame, column: str = "value") -> DataFrame:
    """term, expansion from lines `head -> word ...`; # starts a comment, heads of other than one token are left out."""
    parts = F.split(F.col(column), "->", 2)
    rows = lines.where(~F.trim(column).startswith("#") & F.contains(F.col(column), F.lit("->")))
    rows = rows.select(tokenize(parts[0], []).alias("head"), F.array_distinct(tokenize(parts[1], [])).alias("words")).where(F.size("head") == 1)
    return rows.select(F.col("head")[0].alias("term"), F.explode(F.array_remove("words", F.col("head")[0])).alias("expansion"))


def expand(terms: DataFrame, table: DataFrame) -> DataFrame:
    """terms (query, term) with their expansions as further terms, each once a query."""
    more = terms.join(table, "term").select("query", F.col("expansion").alias("term"))
    return terms.select("query", "term").unionByName(more).distinct()
