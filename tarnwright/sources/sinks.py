"""Sinks: features as JSON lines, ranked rows as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def features(rows: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature a row, as text; the geometry has to be named, like every property."""
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(geometry).alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def write_features(rows: DataFrame, geometry: str, properties: list[str], path: str) -> None:
    features(rows, geometry, properties).write.text(path)


def write_pixels(pixels: DataFrame, path: str, layer: str = "layer") -> None:
    """A pixel table as Parquet, a folder a layer, lines together and in order, so that a reader of some lines reads little.

    Bands are written as they are: nothing is stretched or rescaled.
    """
    pixels.repartitionByRange(layer, "y").sortWithinPartitions(layer, "y", "x").write.partitionBy(layer).parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_index(index: dict[str, DataFrame], folder: str) -> None:
    """The tables of an index, a folder each."""
    for name, table in index.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in any file system that Spark knows; one that is there is replaced."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
