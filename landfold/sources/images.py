"""Scene images to pixels and back, and the persisted pixel table."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.keys import K
from landfold.tables import written


def read_scene_images(spark: SparkSession, path: str) -> DataFrame:
    """(site_id, scene_id, x, y, r, g, b) of image files named {site}_{scene}.{ending}; formats of Spark's image source.

    A scene may also be stored as several images, bands of rows named {site}_{scene}_{first row}.{ending}, so that
    rasters larger than a task's memory can be read. An image's pixels are dealt out by bands of rows too. A file that
    can't be decoded is an error when its rows are read; ``unreadable_images`` lists such files.
    """
    images = spark.read.format("image").load(path).select("image.*")
    name = F.regexp_extract("origin", r"([^/]+)\.[^.]+$", 1)
    part = F.split(name, "_")
    images = images.select(part[0].cast("long").alias("site_id"), part[1].alias("scene_id"), F.coalesce(F.get(part, F.lit(2)).cast("long"), F.lit(0)).alias("first"), "origin", "width", "height", "nChannels", "data")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for site, scene, first, origin, w, h, c, data in frame.itertuples(index=False):
                if w < 0:
                    raise ValueError(f"no image that can be decoded: {origin}")
                plane = np.frombuffer(data, np.uint8).reshape(h, w, c)
                for y0 in range(0, h, 256):
                    part = plane[y0 : y0 + 256]
                    n = len(part)
                    b, g, r = (part[..., k if c >= 3 else 0].ravel().astype(np.int64) for k in range(3))
                    yield pd.DataFrame({"site_id": site, "scene_id": scene, "x": np.tile(np.arange(w), n), "y": np.repeat(np.arange(first + y0, first + y0 + n), w), "r": r, "g": g, "b": b})

    return images.mapInPandas(run, "site_id long, scene_id string, x long, y long, r long, g long, b long")


def unreadable_images(spark: SparkSession, path: str) -> DataFrame:
    """(file) of the files that Spark's image source can't decode."""
    return spark.read.format("image").load(path).where("image.width < 0").select(F.col("image.origin").alias("file"))


def write_scene_images(px: DataFrame, folder: str, band_rows: int = 256) -> DataFrame:
    """(site_id, scene_id, first, file): 24-bit bitmaps of ``band_rows`` rows each, which ``read_scene_images`` puts together.

    A task holds one band; its files are named {site}_{scene}_{first row}.bmp. Written when the result is consumed.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        site, scene, first = (g[c].iloc[0] for c in (*K, "first"))
        w, h = int(g["x"].max() + 1), int(g["y"].max() - first + 1)
        rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
        plane = np.zeros((h, w, 3), np.uint8)
        plane[g["y"] - first, g["x"]] = g[["b", "g", "r"]]
        rows[:, : w * 3] = plane[::-1].reshape(h, -1)
        head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
        path = f"{folder}/{site}_{scene}_{first}.bmp"
        where, name = fs.FileSystem.from_uri(path)
        where.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with where.open_output_stream(name) as out:
            out.write(head + rows.tobytes())
        return pd.DataFrame({"site_id": [site], "scene_id": [scene], "first": [first], "file": [path]})

    bands = px.select(*K, "x", "y", "r", "g", "b", F.expr(f"y - y % {band_rows}").cast("long").alias("first"))
    return bands.groupBy(*K, "first").applyInPandas(run, "site_id long, scene_id string, first long, file string")


def write_pixels(px: DataFrame, path: str, tile: int = 256) -> None:
    """Parquet by site and scene, pixels of a tile together."""
    order = [*K, F.expr(f"y div {tile}"), F.expr(f"x div {tile}"), "y", "x"]
    px.repartition(*K, F.expr(f"y div {tile}")).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(*K).parquet(path)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    px = spark.read.parquet(path)
    return px.withColumns({"site_id": F.col("site_id").cast("long"), "scene_id": F.col("scene_id").cast("string")})


def regrid_nearest(px: DataFrame, width: int, height: int) -> DataFrame:
    """px of any size on a grid of width x height, by the nearest source pixel.

    A source pixel finds its target columns and rows by arithmetic, so that no grid is made and no pixel meets another;
    it meets one row a scene, the size, which is written first so that Spark knows how small it is.
    """
    size = written(px.groupBy(*K).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h")), "sizes")

    def targets(c: str, n: str, m: int) -> Column:
        source = lambda t: F.least(F.floor((t + 0.5) * F.col(n) / m), F.col(n) - 1)
        bound = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(m - 1)).cast("int")
        # one more on either side than the quotients say; the rule itself decides
        near = F.sequence(bound(F.floor(F.col(c) * m / F.col(n) - 0.5) - 1), bound(F.ceil((F.col(c) + 1) * m / F.col(n) - 0.5) + 1))
        return F.explode(F.filter(near, lambda t: source(t) == F.col(c)))

    rows = px.join(size, K).withColumn("_ty", targets("y", "_h", height)).withColumn("_tx", targets("x", "_w", width))
    return rows.select(*K, F.col("_tx").alias("x"), F.col("_ty").alias("y"), *(c for c in px.columns if c not in (*K, "x", "y")))
