"""Tables in shared storage: reading with defaults for missing columns, staged writing, cutting lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a local one, if driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[0-9*]+(,\s*[0-9]+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tarnwright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again, so that later plans start there. It goes when the process ends."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, for files of any kind; it goes when the process ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    return path


def _remove_all() -> None:
    for spark, path in _written:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may have ended before the process
            return


def with_optional(df: DataFrame, required: list[str], optional: dict[str, str]) -> DataFrame:
    """Raises on a missing required column; a missing optional one is null, so that what needs it is unavailable, not negative."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in optional.items() if c not in df.columns})


def swap_in(df: DataFrame, path: str, least_rows: int = 1) -> bool:
    """Writes beside path, checks, then renames; the old table stays if the new one has too few rows.

    Every rename is looked at: one that fails raises, the old table goes back to its place, and it is deleted only after
    the new one is seen there. Between the two renames there is no table at path; readers that must always find one use
    versions.commit().
    """
    spark = df.sparkSession
    staging, old = f"{path}.staging-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if spark.read.parquet(staging).limit(least_rows).count() < least_rows:
        fs.delete(hadoop(staging), True)
        return False
    there = fs.exists(hadoop(path))
    if there and not renamed(fs, hadoop(path), hadoop(old)):
        fs.delete(hadoop(staging), True)
        raise OSError(f"{path} cannot be moved aside; it stays as it was")
    if not renamed(fs, hadoop(staging), hadoop(path)):
        if there and not renamed(fs, hadoop(old), hadoop(path)):
            raise OSError(f"{path} cannot be replaced; the old table is at {old}, the new one at {staging}")
        raise OSError(f"{path} cannot be replaced; it stays as it was, the new table is at {staging}")
    if there:
        fs.delete(hadoop(old), True)
    return True


def renamed(fs, source, target) -> bool:
    """Whether a rename did what it says: some file systems return false, others do nothing."""
    return bool(fs.rename(source, target)) and fs.exists(target) and not fs.exists(source)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place from 0 in the given (total) order. Sorted by ranges in parallel; only the ranges' counts are summed in one place."""
    ranged = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(name, place).drop("_part", "_before")
