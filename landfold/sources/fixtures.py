"""Rasters and companions derived from the given tables with integer arithmetic, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M_PER_PX = 2.0
PX_AREA_HA = M_PER_PX**2 / 10_000

# Scenes, and base colours of the classes forest, sparse, open, built, sea, sand.
SCENES = [("a", 0, 1990), ("b", 1, 1998), ("c", 2, 2005), ("d", 3, 2014), ("e", 4, 2022)]
RED, GREEN, BLUE = [40, 105, 170, 150, 30, 215], [75, 130, 165, 140, 60, 215], [45, 80, 110, 150, 130, 212]

#: class, circle, x, y, r: centres inside the 12-pixel blocks; scene None is shared.
SAMPLES = [
    (None, "forest", "f1", 30.0, 42.0, 4), (None, "forest", "f2", 66.0, 30.0, 4), (None, "open", "o1", 42.0, 6.0, 4), (None, "open", "o2", 90.0, 54.0, 4),
    ("c", "sparse", "s1", 54.0, 30.0, 4), ("d", "sparse", "s2", 30.0, 6.0, None), ("e", "built", "b1", 54.0, 6.0, 4), ("e", "built", "b2", 99.0, 99.0, 4), ("b", "sparse", "s3", 200.0, 200.0, 1),
]

#: kind, polygon, then its vertices.
POLYGONS = [
    ("aoi", "main", [(2.0, 2.0), (97.5, 3.0), (96.0, 95.5), (4.0, 97.0)]),
    ("exclusion", "concave", [(60.0, 60.0), (90.0, 60.0), (75.0, 72.0), (90.0, 90.0), (60.0, 90.0)]),
    ("exclusion", "crossed", [(10.0, 10.0), (40.0, 40.0), (40.0, 10.0), (10.0, 40.0)]),
    ("exclusion", "two", [(1.0, 1.0), (50.0, 50.0)]),
    ("settlement", "yard", [(50.0, 20.0), (52.0, 21.0), (70.0, 22.0), (68.0, 35.0), (51.0, 34.0)]),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scene_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, scene_id, k, year, x, y, cls, r, g, b): five scenes over the events, 10,000 events a site."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "event_id div 10000 AS site_id", "event_id % 100 AS x", "event_id % 10000 div 100 AS y")
    e = e.selectExpr("*", "14 + (y div 10) % 3 AS shore", "x div 12 AS cx", "y div 12 AS cy", "user_id * 7 + event_id * 31 AS drift")
    e = e.withColumn("c0", F.expr("CASE WHEN x < shore THEN 4 WHEN x < shore + 2 THEN 5 ELSE (cx * cx + 3 * cy + cx * cy) % 4 END"))
    # all that does not depend on the scene stands before the explode, so that it is computed once
    scenes = F.array(*(F.struct(F.lit(s).alias("scene_id"), F.lit(k).alias("k"), F.lit(y).alias("year")) for s, k, y in SCENES))
    px = e.select("site_id", "x", "y", F.expr("x % 12").alias("bx"), F.expr("y % 12").alias("by"), "c0", "drift", F.explode(scenes).alias("s"))
    px = px.selectExpr("site_id", "s.scene_id AS scene_id", "s.k AS k", "s.year AS year", "x", "y", "(drift + s.k * 17) % 23 AS noise", "cast(CASE WHEN c0 = 1 AND bx < 2 * s.k THEN 0 WHEN c0 = 2 AND s.k >= 3 AND by < 2 THEN 1 ELSE c0 END AS int) AS cls")
    base = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("rgb", rgb))) for rgb in zip(RED, GREEN, BLUE)))[F.col("cls")]
    px = px.withColumn("base", base).withColumns({"r0": F.expr("base.r + noise"), "g0": F.expr("base.g + noise"), "b0": F.expr("base.b + noise div 2")})
    px = px.withColumn("gray", F.expr("CASE WHEN k = 0 THEN (299 * r0 + 587 * g0 + 114 * b0) div 1000 END"))
    return px.select("site_id", "scene_id", "k", "year", "x", "y", "cls", *(F.coalesce("gray", c + "0").alias(c) for c in "rgb"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense masks of the true classes, so that change and projection stand apart from classification."""
    px = scene_pixels(spark, sf_dir)
    return px.selectExpr(
        "site_id", "scene_id", "year", "x", "y", "cls = 1 AS buffer", "cls = 0 AS forest", "cls IN (2, 3) AS human", "cls = 1 AS sparse", "cls = 2 AS open", "cls = 3 AS built",
        "cls = 4 AS water", "cls = 5 AS coast", "cls < 4 AS land",
    )


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, width, height)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.expr("event_id div 10000").alias("site_id")).agg(F.lit(100).cast("long").alias("width"), (F.max(F.expr("event_id % 10000 div 100")) + 1).alias("height"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.expr("event_id div 10000").alias("site_id")).distinct()


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, scene_id, class, circle_id, x, y, r) for every site; null scene: shared, null r: default."""
    rows = spark.createDataFrame(SAMPLES, "scene_id string, class string, circle_id string, x double, y double, r int")
    return sites(spark, sf_dir).join(F.broadcast(rows))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, kind, poly_id, vertex_no, x, y) for every site."""
    rows = [(kind, name, k, x, y) for kind, name, points in POLYGONS for k, (x, y) in enumerate(points)]
    return sites(spark, sf_dir).join(F.broadcast(spark.createDataFrame(rows, "kind string, poly_id string, vertex_no int, x double, y double")))


def houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, scene_id, house_id, x, y): one a supplier, every sixth shared; site 0."""
    s = table(spark, sf_dir, "supplier")
    scene = F.element_at(F.array(*(F.lit(x[0]) for x in SCENES), F.lit(None).cast("string")), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return s.select(F.lit(0).cast("long").alias("site_id"), scene.alias("scene_id"), F.col("s_suppkey").alias("house_id"), (20 + F.col("s_suppkey") * 7 % 78).cast("double").alias("x"), (F.col("s_suppkey") * 13 % 100).cast("double").alias("y"))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, scene_id, x, y, stroke_no, v): a stroke that forces and one that clears, some pixels get both."""
    px = scene_pixels(spark, sf_dir).withColumn("i", F.expr("y * 100 + x"))
    a = px.where("i % 97 = 0").selectExpr("site_id", "scene_id", "x", "y", "1 AS stroke_no", "1 AS v")
    return a.union(px.where("i % 97 = 1 OR i % 194 = 0").selectExpr("site_id", "scene_id", "x", "y", "2 AS stroke_no", "-1 AS v"))


def area_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, scene_id, year, area_ha) of the true buffer masks."""
    return masks(spark, sf_dir).groupBy("site_id", "scene_id", "year").agg((F.count_if("buffer") * F.lit(PX_AREA_HA)).alias("area_ha"))


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, scene_id, year, area_ha): orders of a year by priority, as another set of series."""
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate")
    return o.groupBy(F.col("o_orderpriority").alias("site_id"), year.alias("year")).agg(F.count(F.lit(1)).cast("double").alias("area_ha")).withColumn("scene_id", F.col("year").cast("string"))


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo_id, site_id, file, lat, lon, alt, taken_at, dir, tag): one a customer."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS photo_id", "0L AS site_id", "concat('IMG_', c_custkey, '.JPG') AS file", "37.46 + (c_custkey % 997) / 50000D AS lat", "137.09 + (c_custkey * 31 % 991) / 50000D AS lon",
        "cast(c_custkey % 300 AS double) AS alt", "concat('2024:05:', lpad(cast(c_custkey % 28 + 1 AS string), 2, '0'), ' 10:00:00') AS taken_at", "cast(c_custkey * 37 % 360 AS double) AS dir",
        "CASE WHEN c_custkey % 15 = 0 THEN 'buffer' WHEN c_custkey % 15 = 7 THEN 'edge' END AS tag",
    )


def exif_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photo and movie files with their tags: suppliers are images, parts movies."""
    images = table(spark, sf_dir, "supplier").selectExpr(
        "concat('P', s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.heic' WHEN 2 THEN '.png' ELSE '.txt' END) AS name", "s_suppkey % 13 <> 0 AS readable",
        "CASE WHEN s_suppkey % 10 <> 0 THEN 37 END AS lat_deg_num", "1 AS lat_deg_den", "s_suppkey % 60 AS lat_min_num", "1 AS lat_min_den", "s_suppkey * 7 % 6000 AS lat_sec_num", "100 AS lat_sec_den",
        "CASE WHEN s_suppkey % 2 = 0 THEN 'N' ELSE 'S' END AS lat_ref",
        "137 AS lon_deg_num", "1 AS lon_deg_den", "s_suppkey * 3 % 60 AS lon_min_num", "1 AS lon_min_den", "s_suppkey * 11 % 6000 AS lon_sec_num", "100 AS lon_sec_den", "CASE WHEN s_suppkey % 3 = 0 THEN 'W' ELSE 'E' END AS lon_ref",
        "s_suppkey * 10 AS alt_num", "CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE 7 END AS alt_den", "cast(s_suppkey % 2 AS string) AS alt_ref",
        "CASE WHEN s_suppkey % 4 <> 0 THEN '2024:05:01 10:00:00' END AS dt_original", "CASE WHEN s_suppkey % 8 <> 0 THEN '2024:06:01 11:00:00' END AS dt_image", "cast(NULL AS string) AS text",
    )
    movies = movie_texts(spark, sf_dir).selectExpr("name", "true AS readable", "text")
    return images.unionByName(movies, allowMissingColumns=True)


def movie_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, text): container text with, without altitude, and without a place."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat('M', p_partkey, '.MOV') AS name",
        "CASE p_partkey % 3 WHEN 0 THEN concat('xx+37.4', p_partkey % 1000, '+137.0', p_partkey * 7 % 1000, '+', p_partkey % 500, '.5/ 2024-01-0', p_partkey % 9 + 1, 'T10:20:30') "
        "WHEN 1 THEN concat('yy-37.4', p_partkey % 1000, '-137.0', p_partkey % 77, '/zz') ELSE concat('no place ', p_partkey) END AS text",
    )


def years(spark: SparkSession, first: float = 1988.0, last: float = 2030.0, step: float = 0.5) -> DataFrame:
    """(t): a half-year grid; a request of bounded size."""
    n = int((last - first) / step)
    return spark.range(n + 1).select((F.lit(float(first)) + F.col("id") * float(step)).alias("t"))


def rle_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scene_pixels(spark, sf_dir).selectExpr("site_id", "scene_id", "x", "y", "cast(cls = 1 AS int) - cast(cls = 0 AS int) AS v")
