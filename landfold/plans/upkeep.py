"""Incremental upkeep of land cover: a scene is computed once for its pixels and parameters, a site's water mask once.

The state lies in one folder: ``water`` and ``classes`` hold a subfolder a run, ``ledger`` a row for each scene (and for each
site's water) with the key it was computed for and the run that holds it. A run writes its rows first and the ledger
last, so that one that broke off is as if it never was. One run at a time writes to a folder.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.keys import K
from landfold.operators import geometry
from landfold.plans import jobs
from landfold.tables import written

#: What the key of a water mask is made of; scenes are not: a mask stays when scenes arrive later.
WATER = ("min_land_region",)


def _sum(*of: str) -> Column:
    """A number that stands for a set of rows; repeats count."""
    return F.sum(F.xxhash64(*of).cast("decimal(38,0)"))


def scene_keys(bands: DataFrame, scenes: DataFrame, samples: DataFrame, sizes: DataFrame, p: dict) -> DataFrame:
    """(site_id, scene_id, key) of scenes with pixels: a hash of the pixels, the scene's parameters, its circles, the raster's size and p."""
    pixels = bands.groupBy(*K).agg(_sum("x", "y", "lum", "chroma", "green", "blue").alias("_px"), F.count(F.lit(1)).alias("_n"))
    own = scenes.select(*K, F.to_json(F.array_sort(F.map_entries("params"))).alias("_params"))
    circles = geometry.for_scenes(samples, scenes.select(*K)).groupBy(*K).agg(_sum("class", "circle_id", "x", "y", "r").alias("_circles"))
    rows = pixels.join(own, K).join(circles, K, "left").join(sizes.select("site_id", "width", "height"), "site_id", "left")
    return rows.select(*K, F.xxhash64("_px", "_n", "_params", "_circles", "width", "height", F.lit(json.dumps(p, sort_keys=True))).alias("key"))


def ledger(spark: SparkSession, root: str, site: str = "long") -> DataFrame:
    """(site_id, scene_id, key, run) of all that was ever computed, a null scene_id for a site's water mask. site: the type of site_id."""
    schema = f"site_id {site}, scene_id string, key long, run int"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{root}/ledger") if there else spark.createDataFrame([], schema)


def _holding(spark: SparkSession, root: str, name: str, current: DataFrame, on: list[str]) -> DataFrame | None:
    """The stored rows of a table that the current rows (on, run) name, None without any; only their runs' files are read."""
    runs = sorted(r[0] for r in current.select("run").distinct().collect())
    if not runs:
        return None
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(*(f"{root}/{name}/run={r}" for r in runs))
    return rows.join(current, [*on, "run"], "left_semi")


def refreshed_classes(root: str, bands: DataFrame, scenes: DataFrame, samples: DataFrame, sizes: DataFrame, p: dict) -> DataFrame:
    """Classes of every pixel of the given scenes, with ``run``; only scenes without a ledger row for their key are computed.

    bands, scenes(params), samples, sizes and p as for ``jobs.land_cover``. A site's water mask is made from the scenes that are there
    when the site first comes, and read from then on. A scene whose pixels, parameters or circles change gets a new key
    and is computed again; one that is no longer given is left out. Nothing new: nothing is written.
    """
    spark, site = bands.sparkSession, dict(bands.dtypes)["site_id"]
    done = written(ledger(spark, root, site), "ledger")
    keys = written(scene_keys(bands, scenes, samples, sizes, p), "keys")
    run = (done.agg(F.max("run")).first()[0] + 1) if not done.isEmpty() else 0
    wet_key = F.xxhash64(F.lit(json.dumps({n: p[n] for n in WATER})))
    wet = done.where("scene_id is null").where(F.col("key") == wet_key).groupBy("site_id").agg(F.max("run").alias("run"))
    new = written(keys.join(done.where("scene_id is not null"), [*K, "key"], "left_anti"), "new")
    dry = written(new.select("site_id").distinct().join(wet, "site_id", "left_anti"), "dry")
    rows = new.select(*K, "key", F.lit(run).cast("int").alias("run"))
    if not dry.isEmpty():
        jobs.site_water(bands.join(dry, "site_id", "left_semi"), sizes, p).write.mode("overwrite").parquet(f"{root}/water/run={run}")
        # a site without a colour scene has no water mask yet and is asked again
        found = written(spark.read.parquet(f"{root}/water/run={run}").select("site_id", F.lit(run).cast("int").alias("run")).distinct(), "found")
        rows = rows.union(found.select("site_id", F.lit(None).cast("string"), wet_key, "run"))
        wet = written(wet.union(found), "wet")
    if not new.isEmpty():
        sites = new.select("site_id").distinct()
        water = _holding(spark, root, "water", wet.join(sites, "site_id", "left_semi"), ["site_id"])
        water = bands.select("site_id", "x", "y").limit(0).withColumn("water", F.lit(False)) if water is None else water.drop("run")
        only = lambda df: df.join(new.select(*K), K, "left_semi")
        jobs.land_cover(only(bands), only(scenes), samples, sizes, p, water).write.mode("overwrite").parquet(f"{root}/classes/run={run}")
        written(rows, "rows").coalesce(1).write.mode("append").parquet(f"{root}/ledger")
    current = written(ledger(spark, root, site).join(keys, [*K, "key"]).groupBy(*K).agg(F.max("run").alias("run")), "current")
    held = _holding(spark, root, "classes", current, K)
    if held is None:
        raise ValueError("no scene has pixels")
    return held
