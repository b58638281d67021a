"""Tables in versions: each is a folder of its own, and numbered manifests say which one counts.

    root/data/<unique>/            Parquet files of one version
    root/versions/<number>.json    its manifest: folder, rows, the version it was made from, names of its checks

A commit writes the data first, reads them back for its checks, writes the manifest under another name, and then claims
the next number by a rename that fails where that number exists. That rename is the commit, and the only step that
readers can see: before it they find the old version, after it the new one, and a writer that stops anywhere leaves
nothing but files that no manifest names (`remove_unused`). Of two writers that began from the same version one gets the
number, and the other is refused (`Conflict`). On file systems such as HDFS a rename to a name that exists fails
atomically; on a local disk the look and the rename are two calls of the same process.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwright.sources.sinks import write_bytes


class Conflict(RuntimeError):
    """Another writer committed the version that was to be written."""


class Invalid(ValueError):
    """A new version failed a check; the old one counts on."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def numbers(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, in order."""
    fs, folder = _files(spark, f"{root}/versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{12})\.json", n)))


def manifest(spark: SparkSession, root: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{root}/versions/{number:012d}.json", wholetext=True).first()[0])


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The table as of a version, the last one by default. What is read stays whole while later versions are committed."""
    found = numbers(spark, root)
    if not found or number is not None and number not in found:
        raise FileNotFoundError(f"no version {'' if number is None else number} at {root}")
    return spark.read.parquet(f"{root}/data/{manifest(spark, root, found[-1] if number is None else number)['folder']}")


def stage(df: DataFrame, root: str) -> str:
    """Writes the data of a version that is not committed yet; gives its folder's name."""
    folder = uuid.uuid4().hex
    df.write.parquet(f"{root}/data/{folder}")
    return folder


def commit(df: DataFrame, root: str, checks: dict[str, Callable[[DataFrame], bool]] | None = None, least_rows: int = 1, base: int | None = None) -> int:
    """Writes df as the version after `base` (0 for none; the last one by default) and gives its number.

    checks: by name, what must be true of the data as they were written. Raises Invalid if one is not or if there are
    too few rows, Conflict if another writer was faster; either way the table is as it was.
    """
    spark = df.sparkSession
    base = max(numbers(spark, root), default=0) if base is None else base
    folder = stage(df, root)
    written = spark.read.parquet(f"{root}/data/{folder}")
    rows = written.count()
    failed = [name for name, check in (checks or {}).items() if not check(written)]
    try:
        if rows < least_rows:
            raise Invalid(f"{rows} rows, at least {least_rows} are needed")
        if failed:
            raise Invalid(f"checks failed: {', '.join(failed)}")
        claim(spark, root, base + 1, {"folder": folder, "rows": rows, "base": base, "checks": sorted(checks or {})})
    except (Invalid, Conflict):
        fs, path = _files(spark, f"{root}/data/{folder}")
        fs.delete(path, True)
        raise
    return base + 1


def claim(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Writes a manifest under a name of its own and renames it to its number; fails if that number exists."""
    draft, final = f"{root}/versions/.draft-{uuid.uuid4().hex}", f"{root}/versions/{number:012d}.json"
    write_bytes(spark, draft, json.dumps(content, sort_keys=True).encode())
    fs, path = _files(spark, draft)
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(path, _files(spark, final)[1], options)
    except Exception as e:
        fs.delete(path, False)
        if fs.exists(_files(spark, final)[1]):
            raise Conflict(f"version {number} of {root} exists") from e
        raise


def remove_unused(spark: SparkSession, root: str, keep: int = 2, older_than_ms: int = 24 * 3600 * 1000) -> list[str]:
    """Deletes the data that none of the last `keep` manifests names, if they were last touched so long ago.

    Manifests stay; a version whose data are gone cannot be read. The age spares what other writers have just staged.
    """
    fs, folder = _files(spark, f"{root}/data")
    if not fs.exists(folder):
        return []
    named = {manifest(spark, root, n)["folder"] for n in numbers(spark, root)[-keep:]}
    now = spark._jvm.java.lang.System.currentTimeMillis()
    gone = []
    for s in fs.listStatus(folder):
        if s.getPath().getName() not in named and now - s.getModificationTime() >= older_than_ms:
            fs.delete(s.getPath(), True)
            gone.append(s.getPath().getName())
    return sorted(gone)
