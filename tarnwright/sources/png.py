"""Pictures as pixel tables, and pixel tables as pictures."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwright.sources import named
from tarnwright.sources.tables import kept

SCHEMA = "layer string, y int, x int, r smallint, g smallint, b smallint, a smallint"
#: Pixels that a strip has at most, unless a line has more; a strip is the work of one task.
STRIP = 1 << 18


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """layer (the file's name), y, x, r, g, b, a of every pixel of the pictures at path.

    Spark's image source gives one row a picture, channels blue first; rows of pixels are made from bands of at most
    64 lines, so a task holds one picture and one band.
    """
    images = spark.read.format("image").load(path).selectExpr(
        "regexp_extract(image.origin, '([^/]+)\\\\.[^.]*$', 1) AS layer", "image.height AS height", "image.width AS width", "image.nChannels AS channels", "image.data AS data"
    )

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h, w, n = row["height"], row["width"], row["channels"]
                data = np.frombuffer(row["data"], np.uint8).reshape(h, w, n).astype(np.int16)
                for top in range(0, h, 64):
                    part = data[top : top + 64].reshape(-1, n)
                    grey = n == 1
                    channel = lambda i: part[:, 0] if grey else part[:, i]  # noqa: B023, E731
                    alpha = part[:, 3] if n == 4 else np.full(len(part), 255, np.int16)
                    y, x = np.divmod(np.arange(len(part)), w)
                    columns = [[row["layer"]] * len(part), (y + top).astype(np.int32), x.astype(np.int32), channel(2), channel(1), channel(0), alpha]
                    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int16()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["layer", "y", "x", "r", "g", "b", "a"])

    return images.mapInArrow(pixels, SCHEMA)


def opaque(pixels: DataFrame, layers: tuple[str, ...] = ("history", "hydro", "routing")) -> DataFrame:
    """Measurement layers without transparency; the others keep theirs."""
    return pixels.withColumn("a", F.when(F.col("layer").isin(*layers), F.lit(255).cast("smallint")).otherwise(F.col("a")))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def strips(pixels: DataFrame, most: int = STRIP) -> DataFrame:
    """path, part, content: the pictures of a pixel table (layer, y, x, r, g, b, a) as parts that make PNG files.

    A layer is as high and wide as its last pixel says; pixels that the table lacks are transparent black. Strips of
    lines are filtered and deflated apart, each ending at a byte, so that they make one stream when joined; the check
    sum of the whole follows from theirs. A pixel that is there twice, or a sample outside 0 to 255, is an error.
    """
    c = F.col
    size = pixels.groupBy("layer").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    lines = F.greatest(F.lit(1), F.floor(F.lit(most) / c("width"))).cast("int")
    size = kept(size.select("layer", "height", "width", lines.alias("lines")), "sizes")
    # Every strip has a row, also where no pixel lies in it.
    every = size.toDF("of", "height", "width", "lines")
    every = every.withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((c("height") - 1) / c("lines")).cast("int"))))
    placed = pixels.join(size.select("layer", "lines"), "layer").withColumn("strip", F.floor(c("y") / c("lines")).cast("int")).drop("lines")
    bands = placed.groupBy("layer", "strip").cogroup(every.groupBy("of", "at"))

    def deflated(held: pd.DataFrame, strip: pd.DataFrame) -> pd.DataFrame:
        one = strip.iloc[0]
        top, width = int(one["at"]) * int(one.lines), int(one.width)
        high = min(int(one.lines), int(one.height) - top)
        data = np.zeros((high * width, 4), np.uint8)
        at = (held["y"].to_numpy() - top).astype(np.int64) * width + held["x"].to_numpy()
        samples = held[["r", "g", "b", "a"]].to_numpy()
        if len(np.unique(at)) < len(at) or (len(at) and (at.min() < 0 or samples.min() < 0 or samples.max() > 255)):
            raise ValueError(f"layer {one.of}: a pixel twice, before the first line or column, or a sample outside 0 to 255")
        data[at] = samples
        picture = data.reshape(high, width, 4)
        filtered = np.empty((high, 1 + width * 4), np.uint8)
        filtered[:, 0] = 1  # each sample as its difference to the pixel on the left
        filtered[:, 1:] = np.diff(picture, axis=1, prepend=np.zeros((high, 1, 4), np.uint8)).reshape(high, -1)
        raw = filtered.tobytes()
        deflater = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflater.compress(raw) + deflater.flush(zlib.Z_FULL_FLUSH)
        row = {"layer": one.of, "strip": int(one["at"]), "height": int(one.height), "width": width, "sum": zlib.adler32(raw), "n": len(raw)}
        return pd.DataFrame([row | {"content": _chunk(b"IDAT", body)}])

    done = bands.applyInPandas(deflated, "layer string, strip int, height int, width int, sum long, n long, content binary")
    done = kept(done, "strips")

    # The check sum of what is joined: a is a sum of bytes, b a sum of the a that were reached.
    def joined(state, s):
        a, b = F.pmod(s["sum"], F.lit(65536)), F.shiftright(s["sum"], 16)
        return F.struct(
            F.pmod(state["a"] + a - 1, F.lit(65521)).alias("a"),
            F.pmod(state["b"] + b + F.pmod(s["n"], F.lit(65521)) * (state["a"] - 1), F.lit(65521)).alias("b"),
        )

    sums = F.array_sort(F.collect_list(F.struct("strip", "sum", "n")))
    none = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    ends = done.groupBy("layer").agg(F.max("strip").alias("last"), F.max("height").alias("height"), F.max("width").alias("width"), F.aggregate(sums, none, joined).alias("s"))

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signature = bytes.fromhex("89504e470d0a1a0a")
        for rows in batches:
            out = []
            for r in rows.itertuples():
                head = _chunk(b"IHDR", struct.pack(">IIBBBBB", r.width, r.height, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", b"\x78\x9c")
                tail = _chunk(b"IDAT", b"\x03\x00" + struct.pack(">HH", r.b, r.a)) + _chunk(b"IEND", b"")
                out += [(r.layer, -1, signature + head), (r.layer, r.last + 1, tail)]
            yield pd.DataFrame(out, columns=["layer", "part", "content"])

    frames = ends.select("layer", "last", "height", "width", "s.a", "s.b").mapInPandas(framed, "layer string, part int, content binary")
    whole = done.select("layer", c("strip").alias("part"), "content").unionByName(frames)
    return whole.select(F.concat("layer", F.lit(".png")).alias("path"), "part", "content")


def write_pictures(pixels: DataFrame, folder: str) -> None:
    """A PNG with eight bits a sample for each layer, named after it. Layers have to be opaque() first, if they are to be."""
    named.write(strips(pixels), folder)
