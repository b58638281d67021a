"""Link manifests: lines `KIND name: https://...`, as text and as columns; checks of what the links gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINK = r"(https://\S+)"
#: Fixed value: the first bytes of a PNG file.
PNG_MAGIC = bytes.fromhex("89504e470d0a1a0a")


def fields(line: Column) -> dict[str, Column]:
    """kind, name and url of a line; null where it has no link or no name."""
    url = F.nullif(F.regexp_extract(line, LINK, 1), F.lit(""))
    name = F.nullif(F.regexp_extract(line, r"([A-Za-z0-9_-]+):\s*https://", 1), F.lit(""))
    kind = F.when(F.upper(F.regexp_extract(line, r"^\W*(\w+)", 1)) == "GEOJSON", "GEOJSON").otherwise("PNG")
    return {"kind": F.when(url.isNotNull() & name.isNotNull(), kind), "name": name, "url": url}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """kind, name, url of the lines that have a link and a name."""
    rows = spark.read.text(path)
    return rows.select(*(c.alias(k) for k, c in fields(F.col("value")).items())).where("kind is not null")


def usable(files: DataFrame) -> DataFrame:
    """Binary files (path, content) with ok: PNG by its first bytes, GeoJSON by its type and a feature count."""
    doc = F.from_json(F.col("content").cast("string"), "type string, features array<struct<type: string>>")
    png = F.substring("content", 1, 8) == F.lit(PNG_MAGIC)
    return files.select("path", png.alias("png"), F.when(doc["type"] == "FeatureCollection", F.size(doc["features"])).alias("features")).withColumn("ok", F.col("png") | F.col("features").isNotNull())
