"""What the operators of this subpackage share: tables written to shared storage, Arrow mapping, UTF-8 access."""

from __future__ import annotations

import atexit
import ctypes
import gc
import itertools
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()
_caches: dict[str, Callable[[], object]] = {}
_holder: list[str] = [""]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all run
    in one process (tests). On a cluster an unset folder is an error, as executors would not find each other's tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[0-9*]+(,\s*[0-9]+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tarnwright-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: lineage ends there, lost executors cost nothing.

    Tables stay until the driver's process ends, since lazy results read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may have ended before the process
            return


#: Rows of documents that are handed to a worker at once, and bytes: with Spark's 10000, or its 64 MB, long texts take
#: hundreds of megabytes in the JVM, in the worker and between them. A single longer row still is one batch.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once a session: a cluster's machines need not have it installed.

    Also bounds Arrow batches, unless the session says otherwise.
    """
    context = spark.sparkContext
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if context.getConf().get(f"spark.sql.execution.arrow.{name}") is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="tarnwright-"), "tarnwright.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(out)


def cached_as(name: str, clear: Callable[[], object]) -> None:
    """Says how to empty a cache that outlives a task."""
    _caches[name] = clear


def hold(name: str = "") -> None:
    """Called by a task in its worker: caches of other operators that ran there before are emptied."""
    if _holder[0] == name:
        return
    _holder[0] = name
    for other, clear in _caches.items():
        if other != name:
            clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:  # gives what is free back to the system, where the C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return


def map_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict[str, object] | Iterable[dict[str, object]]]], schema: str, cache: str = "", ends: bool = False
) -> DataFrame:
    """mapInArrow with one state object a task: make() is called in the worker and turns each batch into columns.

    The function may give a dict of columns or several of them (to bound what is held at once). cache names the
    cache that it uses, if any. With ends, it is called with None after the last batch.
    """
    spark = df.sparkSession
    ship(spark)
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in spark.createDataFrame([], schema).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(cache)
        each = make()
        for batch in itertools.chain(batches, [None] if ends else []):
            made = each(batch)
            for columns in [made] if isinstance(made, dict) else made:
                yield pa.RecordBatch.from_arrays([_as_array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _as_array(values: object, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) and values.type == kind else pa.array(values, type=kind)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it: for columns that come and go beside a caller's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings; null reads as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null reads as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
