"""One query for each operator, over rasters and companions derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landfold.functions import gps
from landfold.keys import K, PIXEL
from landfold.operators import bands as B
from landfold.operators import buffer, change, distance, focal, geometry, landcover, projection, regions, rle, stats, trend, water
from landfold.plans import jobs, upkeep
from landfold.sources import fixtures as X
from landfold.sources import images, settings
from landfold.tables import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
HA = X.PX_AREA_HA
#: Region and distance parameters for the derived raster.
SMALL = {"min_land_region": 300, "min_human": 60, "min_forest": 64, "min_buffer": 30, "min_region": 16, "band": 8.0, "near": 6.0, "coast": 4.0, "adjacent": 3.0}
SHOW = {"sparse": True, "water": True, "forest": True, "built": True, "field": True}
STYLE = {"buffer": (255, 212, 0, 0.6), "lost": (255, 60, 40, 0.5), "band_lost": (180, 60, 160, 0.4), "settlement": (80, 80, 220, 0.5), "excl": (90, 90, 90, 0.4), "field": (250, 240, 160, 0.4), "sparse": (160, 220, 120, 0.4), "water": (40, 120, 220, 0.45), "built": (210, 210, 210, 0.5), "forest": (20, 110, 40, 0.35)}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def bands(spark, sf_dir):
    return B.spectral_bands(X.scene_pixels(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dark-forest area of each scene with its yearly change and the site's trend."""
    area = stats.area_below_otsu(bands(spark, sf_dir), "lum", HA, ["site_id", "scene_id", "year"])
    line = trend.fit_trend(area).select("site_id", "slope", "r2")
    return change.area_change_rate(area).join(line, "site_id").select("site_id", "scene_id", "year", "threshold", *r6("area_ha", "rate", "slope", "r2"))


@query
def forest_area_trend(spark, sf_dir):
    return flagship(spark, sf_dir)


# --- sources and sinks


@query
def read_scene_images(spark, sf_dir):
    folder = new_path(spark, "images")
    images.write_scene_images(X.scene_pixels(spark, sf_dir), folder, 64).count()
    return images.read_scene_images(spark, folder)


@query
def write_and_read_pixels(spark, sf_dir):
    path = new_path(spark, "pixels")
    images.write_pixels(X.scene_pixels(spark, sf_dir), path)
    px = images.read_pixels(spark, path)
    return px.groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("(x + 1) * r + (y + 1) * g + b")).alias("mark"))


@query
def regrid_nearest(spark, sf_dir):
    return images.regrid_nearest(X.scene_pixels(spark, sf_dir), 70, 130).select(*K, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "r", "g", "b")


def catalogue(spark, sf_dir) -> DataFrame:
    px = X.scene_pixels(spark, sf_dir).select("site_id", "scene_id", "k", "year").distinct()
    return px.select("site_id", "scene_id", F.concat("scene_id", F.lit(".png")).alias("file"), F.col("year").cast("double").alias("year"), F.concat(F.lit("scene, "), "scene_id").alias("label"),
                     F.expr("k = 1").alias("estimated"), F.expr("CASE WHEN k % 2 = 1 THEN map('bias', cast(k AS double), 'builtMin', 180D) END").alias("params"))


def circles(spark, sf_dir) -> DataFrame:
    return X.samples(spark, sf_dir)


@query
def read_scene_config(spark, sf_dir):
    path = new_path(spark, "config")
    settings.write_scene_config(catalogue(spark, sf_dir), circles(spark, sf_dir), X.houses(spark, sf_dir), X.polygons(spark, sf_dir), path)
    c = settings.read_scene_config(spark, path)
    part = lambda name, *keys: c[name].select(F.lit(name).alias("what"), "site_id", F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys)).alias("about"))
    return (
        part("scenes", "scene_id", "file", "estimated").union(part("samples", "scene_id", "class", "r")).union(part("houses", "scene_id")).union(part("polygons", "kind", "vertex_no"))
        .groupBy("what", "site_id", "about").agg(F.count(F.lit(1)).alias("n"))
    )


@query
def merge_settings(spark, sf_dir):
    scenes = catalogue(spark, sf_dir)
    saved = scenes.where("scene_id in ('b', 'c')").groupBy("site_id").agg(
        F.expr("array_sort(collect_list(struct(scene_id AS id, year + 1 AS year, concat(label, '!') AS label, true AS estimated, map('bias', 9D) AS params, array(0L, 5L) AS correction)), (p, q) -> CASE WHEN p.id < q.id THEN -1 ELSE 1 END)").alias("scenes")
    )
    path = new_path(spark, "saved")
    saved.select("site_id", F.expr("CASE WHEN site_id % 2 = 0 THEN 3 ELSE 2 END").alias("settingsVersion"), "scenes").write.json(path)
    m = settings.merge_settings(scenes, settings.read_saved_settings(spark, path), 3)
    return m.select("site_id", "scene_id", "year", "label", "estimated", F.try_element_at("params", F.lit("bias")).alias("bias"), F.coalesce(F.array_join(F.col("correction").cast("array<string>"), ","), F.lit("")).alias("correction"), "migrated")


@query
def merge_site_settings(spark, sf_dir):
    """Documents saved under the version in use (3) and under an older one (2), over the same defaults."""
    sites = X.sites(spark, sf_dir)
    base = sites.select("site_id", F.expr("map('opacity', '0.45', 'lostBase', 'all') AS display"), F.expr("map('edgeBandM', 100D, 'forestNearM', 40D) AS buffer"), F.expr("map('thresholdPct', '5', 'seed', '1') AS sim"),
                        F.expr("map('autoM', 0D, 'houseRadiusM', 20D) AS settlement"), F.expr("35D AS coastBandM"), F.expr("named_struct('dxM', 0D, 'dyM', 0D) AS photoOffset"))
    defaults = settings.with_drawn(base, circles(spark, sf_dir).where("scene_id is null"), X.houses(spark, sf_dir).where("house_id % 2 = 0"), X.polygons(spark, sf_dir))
    changed = sites.select("site_id", F.expr("map('opacity', '0.6') AS display"), F.expr("map('edgeBandM', 80D + site_id) AS buffer"), F.expr("map('seed', '7') AS sim"), F.expr("map('autoM', 12D) AS settlement"),
                           F.expr("50D AS coastBandM"), F.expr("named_struct('dxM', 1.5D, 'dyM', cast(NULL AS double)) AS photoOffset"))
    drawn = settings.with_drawn(changed, circles(spark, sf_dir), X.houses(spark, sf_dir), X.polygons(spark, sf_dir).where("kind = 'settlement'"))
    runs = spark.createDataFrame([], "site_id long, scene_id string, runs array<bigint>")
    out = None
    for version in (3, 2):
        path = new_path(spark, "saved")
        settings.export_settings(catalogue(spark, sf_dir), runs, version, drawn).select(F.col("json").alias("value")).write.text(path)
        m = settings.merge_site_settings(defaults, settings.read_saved_settings(spark, path), 3).withColumn("saved_version", F.lit(version))
        out = m if out is None else out.union(m)
    points = lambda kind: F.coalesce(F.expr(f"aggregate(polygons['{kind}'], 0, (n, p) -> n + size(p))"), F.lit(0))
    own = "aggregate(map_values({}), 0, (n, v) -> n + size(v))"
    return out.select(
        "site_id", "saved_version", "migrated", F.expr("display['opacity'] AS opacity"), F.expr("display['lostBase'] AS lost_base"), F.expr("buffer['edgeBandM'] AS edge_band"), F.expr("buffer['forestNearM'] AS forest_near"),
        F.expr("sim['thresholdPct'] AS threshold_pct"), F.expr("sim['seed'] AS seed"), F.expr("settlement['autoM'] AS auto_m"), F.expr("settlement['houseRadiusM'] AS house_radius"), F.col("coastBandM").alias("coast_band"),
        F.col("photoOffset.dxM").alias("dx"), F.col("photoOffset.dyM").alias("dy"), points("aoi").alias("aoi"), points("exclusion").alias("exclusion"), points("settlement").alias("yards"),
        F.expr(f"coalesce({own.format('samples.shared')}, 0) + coalesce(aggregate(map_values(samples.byScene), 0, (n, m) -> n + {own.format('m')}), 0)").alias("circles"),
        F.expr(f"coalesce(size(houses), 0) + coalesce({own.format('housesByScene')}, 0)").alias("houses"),
    )


@query
def resolve_params(spark, sf_dir):
    p = landcover.resolve_params(catalogue(spark, sf_dir), B.grayscale_flag(bands(spark, sf_dir)))
    return p.select(*K, "grayscale", "bias", "builtMin", "builtChromaMax", "strictness", "forestMax")


def photo_document(spark, sf_dir) -> str:
    """The customers as photo lists in the JSON form of the photo source, a list for each nation (folder)."""
    path = new_path(spark, "photos")
    p = X.photos(spark, sf_dir).withColumn("dir_", F.expr("concat('p', photo_id % 25)"))
    lists = p.groupBy(F.col("dir_").alias("dir")).agg(F.collect_list(F.struct("file", "lat", "lon", "alt", F.col("taken_at").alias("time"), "dir", "tag")).alias("photos"))
    tags = F.expr("map('buffer', struct('Buffer zone' AS label, '#ff0' AS color, '' AS note), 'edge', struct('Forest edge' AS label, '#0f0' AS color, '' AS note))")
    lists.select("dir", F.lit("survey").alias("source"), "photos", tags.alias("tags")).repartition(8).write.json(path)
    return path


@query
def read_photos(spark, sf_dir):
    photos, tags = _photos(spark, sf_dir)
    return photos.join(tags, "tag", "left").select("folder", "file", *r6("lat", "lon"), "alt", F.date_format("taken", "yyyy-MM-dd HH:mm:ss").alias("taken"), "tag", "label")


def _photos(spark, sf_dir):
    path = photo_document(spark, sf_dir)
    d = spark.read.schema(settings.PHOTOS).json(path)
    photos = d.select(F.col("dir").alias("folder"), F.explode("photos").alias("p")).select("folder", "p.*").withColumn("taken", F.try_to_timestamp("time", F.lit("yyyy:MM:dd HH:mm:ss")))
    return photos, d.select(F.explode("tags").alias("tag", "t")).select("tag", "t.*").distinct()


def observed(spark, sf_dir) -> DataFrame:
    """Stats of the true masks with year, label, share and rate."""
    px = X.masks(spark, sf_dir).withColumns({"settlement": F.lit(False), "aoi": F.lit(True)})
    s = stats.scene_stats(px, HA).join(px.select(*K, "year").distinct(), K)
    s = change.buffer_share(s).withColumn("area_ha", F.col("buffer")).withColumn("label", F.concat(F.lit("scene, "), "scene_id"))
    return change.area_change_rate(s)


def first_land(s: DataFrame) -> DataFrame:
    return s.groupBy("site_id").agg(F.min_by("land", "year").alias("land_ha"))


@query
def write_area_table(spark, sf_dir):
    s = observed(spark, sf_dir)
    setup = trend.projection_setup(s.select("site_id", "scene_id", "year", "area_ha"))
    path = new_path(spark, "areas")
    settings.write_area_table(settings.area_table(s, trend.forecast_table(setup, first_land(s)), setup.select("site_id", "threshold_ha")), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("site_id").cast("long").alias("site_id"), *(F.coalesce(c, F.lit("")).alias(c) for c in settings.AREA_HEADER))


@query
def write_frame_table(spark, sf_dir):
    path = new_path(spark, "frames")
    settings.write_frame_table(jobs.frames(X.masks(spark, sf_dir), X.years(spark, 1990.0, 2022.0, 4.0), HA), path)
    csv = spark.read.option("header", True).csv(f"{path}/csv")
    full = spark.read.json(f"{path}/json").select(F.col("site_id").cast("string").alias("site_id"), F.col("t").cast("string").alias("year"), F.col("compare_year").cast("long").alias("compare_year"))
    return csv.join(full, ["site_id", "year"]).select("site_id", "year", "mode", "buffer_ha", "lost_ha", "compare_year")


@query
def export_settings(spark, sf_dir):
    runs = rle.rle_encode(X.rle_values(spark, sf_dir), "v")
    out = settings.export_settings(catalogue(spark, sf_dir), runs, 3)
    back = out.select("site_id", F.from_json("json", settings.SAVED).alias("d")).select("site_id", "d.settingsVersion", F.explode("d.scenes").alias("s"))
    return back.select("site_id", F.col("settingsVersion").alias("version"), F.col("s.id").alias("scene_id"), F.col("s.year").alias("year"), F.col("s.label").alias("label"), "s.file", "s.estimated", F.expr("s.params['bias'] AS bias"), F.size("s.correction").alias("n"), F.expr("aggregate(s.correction, 0L, (a, v) -> (a * 31 + v + 7) % 1000003)").alias("mark"))


@query
def write_gps_listing(spark, sf_dir):
    path = new_path(spark, "gps")
    settings.write_gps_listing(gps.gps_listing(X.exif_files(spark, sf_dir)), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "lat", "lon", "alt_m", "taken_at", "note")))


@query
def append_scenes(spark, sf_dir):
    now = catalogue(spark, sf_dir).select("site_id", "scene_id", "year")
    arrivals = F.from_json(F.lit('[{"arrival": 1, "scene_id": "a"}, {"arrival": 2, "scene_id": "new", "year": 2030.0}, {"arrival": 3, "scene_id": "new"}]'), "array<struct<arrival int, scene_id string, year double>>")
    more = X.sites(spark, sf_dir).select("site_id", F.explode(arrivals).alias("s")).select("site_id", "s.*")
    return settings.append_scenes(now, more)


@query
def refreshed_classes(spark, sf_dir):
    """Four scenes are computed; then the last one arrives and is computed alone, with the water mask that is there."""
    root, all_bands, scenes = new_path(spark, "upkeep"), bands(spark, sf_dir), catalogue(spark, sf_dir)
    upkeep.refreshed_classes(root, all_bands.where("scene_id <> 'e'"), scenes.where("scene_id <> 'e'"), circles(spark, sf_dir), X.sizes(spark, sf_dir), SMALL)
    c = upkeep.refreshed_classes(root, all_bands, scenes, circles(spark, sf_dir), X.sizes(spark, sf_dir), SMALL)
    return c.groupBy(*K, "run").agg(*(F.count_if(n).alias(n) for n in ("water", "forest", "sparse", "open", "built")))


# --- expressions on pixels


@query
def spectral_bands(spark, sf_dir):
    return bands(spark, sf_dir).select(*PIXEL, *r6("lum", "chroma", "green", "blue"))


@query
def grayscale_flag(spark, sf_dir):
    return B.grayscale_flag(bands(spark, sf_dir))


@query
def sort_scenes(spark, sf_dir):
    s = catalogue(spark, sf_dir).selectExpr("site_id", "scene_id", "2050 - year AS year", "scene_id <> 'b' AS has_mask", "scene_id = 'd' AS excluded")
    return B.sort_scenes(s).select("site_id", "scene_id", "year", "k")


@query
def land_mask(spark, sf_dir):
    m = X.masks(spark, sf_dir).drop("land")
    both = B.land_mask(m).select(*PIXEL, F.col("land")).join(B.land_mask(m, False).select(*PIXEL, F.col("land").alias("with_coast")), PIXEL)
    return both.groupBy(*K).agg(F.count_if("land").alias("land"), F.count_if("with_coast").alias("with_coast"))


@query
def built_rule(spark, sf_dir):
    b = focal.focal_means(bands(spark, sf_dir), {"sl": "lum", "sc": "chroma"}, 3)
    rule = B.built_rule(F.col("sl"), F.col("sc"), F.lit(145.2), F.lit(24.0))
    return b.groupBy(*K).agg(F.count_if(rule).alias("n"), F.sum(F.when(rule, F.expr("y * 100 + x")).otherwise(0)).alias("mark"))


def aoi(spark, sf_dir) -> DataFrame:
    return geometry.polygon_union_mask(X.polygons(spark, sf_dir), X.sizes(spark, sf_dir), "aoi")


@query
def apply_aoi(spark, sf_dir):
    return B.apply_aoi(X.masks(spark, sf_dir), aoi(spark, sf_dir)).groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.count_if("buffer").alias("buffer"))


def layers(spark, sf_dir) -> DataFrame:
    """Masks with everything that an overlay needs."""
    m = X.masks(spark, sf_dir).withColumn("i", F.expr("y * 100 + x"))
    return m.selectExpr(
        "site_id", "scene_id", "year", "x", "y", "buffer", "forest", "built", "water", "coast", "land", "open", "sparse OR i % 53 = 0 AS sparse", "i % 31 = 0 AS lost", "i % 7 = 0 AS band", "i % 41 = 0 AS settlement", "i % 37 = 0 AS excl", "open AS field", "x > 5 AS aoi"
    )


@query
def pixel_class_label(spark, sf_dir):
    return B.pixel_class_label(layers(spark, sf_dir)).groupBy(*K, "label").agg(F.count(F.lit(1)).alias("n"))


@query
def overlay_layer(spark, sf_dir):
    return B.overlay_layer(layers(spark, sf_dir), SHOW | {"excl": False}).select(*PIXEL, "layer")


@query
def overlay_rgba(spark, sf_dir):
    px = B.overlay_rgba(B.overlay_layer(layers(spark, sf_dir), SHOW), STYLE)
    return px.groupBy(*K, "layer", "rgba").agg(F.count(F.lit(1)).alias("n"))


@query
def crossfade_pixels(spark, sf_dir):
    px = X.scene_pixels(spark, sf_dir)
    return B.crossfade_pixels(px.where("scene_id = 'b'"), px.where("scene_id = 'd'"), 0.25).select("site_id", "x", "y", *r6("r", "g", "b"))


@query
def water_with_coast(spark, sf_dir):
    m = X.masks(spark, sf_dir)
    sea = m.where("scene_id = 'a' and water").select("site_id", "x", "y", "water")
    return B.water_with_coast(m.select(*PIXEL), sea, m.where("coast")).groupBy(*K).agg(F.count_if("wet").alias("wet"))


@query
def override_report(spark, sf_dir):
    return B.override_report(catalogue(spark, sf_dir)).withColumn("overrides", F.coalesce("overrides", F.lit("")))


# --- neighbourhoods


@query
def focal_sum(spark, sf_dir):
    return focal.focal_sum(bands(spark, sf_dir), "lum", 3).select(*PIXEL, *r6("focal"))


@query
def focal_count(spark, sf_dir):
    return focal.focal_count(X.scene_pixels(spark, sf_dir), 4).select(*PIXEL, "n")


@query
def focal_mean(spark, sf_dir):
    return focal.focal_mean(bands(spark, sf_dir), "chroma", 2).select(*PIXEL, *r6("focal"))


@query
def focal_min(spark, sf_dir):
    return focal.focal_min(bands(spark, sf_dir), "lum", 2).select(*PIXEL, *r6("focal"))


@query
def focal_std(spark, sf_dir):
    return focal.focal_std(bands(spark, sf_dir), "lum", 2).select(*PIXEL, *r6("focal"))


@query
def gradient(spark, sf_dir):
    return focal.gradient(bands(spark, sf_dir)).select(*PIXEL, *r6("edge"))


@query
def feature_vector(spark, sf_dir):
    return focal.feature_tiles(bands(spark, sf_dir), X.sizes(spark, sf_dir), tile=48).select(*PIXEL, *r6(*focal.FEATURES))


@query
def dilate(spark, sf_dir):
    return focal.dilate(X.masks(spark, sf_dir), "buffer", 3).where("mask").select(*PIXEL)


@query
def erode(spark, sf_dir):
    return focal.erode(X.masks(spark, sf_dir), "forest", 2).where("mask").select(*PIXEL)


@query
def morph_open(spark, sf_dir):
    return focal.morph_open(X.masks(spark, sf_dir), "forest", 2).where("mask").select(*PIXEL)


@query
def morph_close(spark, sf_dir):
    return focal.morph_close(X.masks(spark, sf_dir), "forest", 2).where("mask").select(*PIXEL)


@query
def majority_filter(spark, sf_dir):
    return focal.majority_filter(X.masks(spark, sf_dir), 2).select(*PIXEL, "forest", "sparse", "built")


# --- regions and distance


@query
def connected_components(spark, sf_dir):
    return regions.connected_components(X.masks(spark, sf_dir), "buffer", 8, 32).select(*PIXEL, "region")


@query
def region_labels(spark, sf_dir):
    return regions.region_labels(X.masks(spark, sf_dir), "forest", 8, 32)


@query
def region_sizes(spark, sf_dir):
    return regions.region_sizes(regions.connected_components(X.masks(spark, sf_dir), "forest", 4, 32)).select(*K, "region", "size")


@query
def remove_small_regions(spark, sf_dir):
    return regions.remove_small_regions(X.masks(spark, sf_dir), "forest", 64, 8, tile=32).where("mask").select(*PIXEL)


@query
def keep_border_regions(spark, sf_dir):
    return regions.keep_border_regions(X.masks(spark, sf_dir), "forest", X.sizes(spark, sf_dir), 4, 2, tile=32).where("mask").select(*PIXEL)


@query
def keep_touching_regions(spark, sf_dir):
    m = X.masks(spark, sf_dir).withColumn("seed", F.expr("x % 29 = 0 and y % 17 = 0"))
    return regions.keep_touching_regions(m, "buffer", "seed", 8, tile=32).where("mask").select(*PIXEL)


@query
def distance_transform(spark, sf_dir):
    return distance.distance_transform(X.masks(spark, sf_dir), "forest")


@query
def within_distance(spark, sf_dir):
    return distance.within_distance(X.masks(spark, sf_dir), "human", 6.0).groupBy(*K).agg(F.count_if("near").alias("near"), F.count_if(F.col("near") & F.col("buffer")).alias("near_buffer"))


# --- thresholds and areas


@query
def upper_median(spark, sf_dir):
    q = stats.upper_median(X.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_quantity").cast("double").alias("value")), "value", ["key"], most=1000)
    b = stats.level_median(bands(spark, sf_dir), "blue").select(F.concat_ws("/", F.col("site_id").cast("string"), "scene_id").alias("key"), "median")
    return q.union(b).select("key", *r6("median"))


@query
def upper_median_of_prices(spark, sf_dir):
    """Free doubles: nearly as many values as rows, so that rounds of narrowing buckets find the place."""
    t = X.table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_extendedprice").cast("double") * (1 - F.col("l_discount").cast("double"))).alias("price"))
    return stats.upper_median(t, "price", ["l_linestatus"], most=1000).select("l_linestatus", *r6("median"))


@query
def histogram256(spark, sf_dir):
    return stats.histogram256(bands(spark, sf_dir), "lum", "x >= 20")


@query
def otsu_threshold(spark, sf_dir):
    p = stats.otsu_threshold(X.table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), "p_size"), "p_size", None, ["key"])
    b = stats.otsu_threshold(bands(spark, sf_dir), "lum").select(F.concat_ws("/", F.col("site_id").cast("string"), "scene_id").alias("key"), "threshold")
    return p.union(b)


@query
def mask_area(spark, sf_dir):
    return stats.mask_area(X.masks(spark, sf_dir), "forest", HA).select(*K, *r6("area_ha"))


@query
def scene_stats(spark, sf_dir):
    px = X.masks(spark, sf_dir).withColumns({"settlement": F.expr("human and x % 3 = 0"), "aoi": F.expr("x > 20")})
    return stats.scene_stats(px, HA).select(*K, *r6("buffer", "settlement", "field", "sparse", "land", "forest", "built"))


@query
def catalogue_counts(spark, sf_dir):
    return stats.catalogue_counts(circles(spark, sf_dir), X.houses(spark, sf_dir), X.polygons(spark, sf_dir))


# --- geometry


@query
def polygon_mask(spark, sf_dir):
    return geometry.polygon_mask(X.polygons(spark, sf_dir), X.sizes(spark, sf_dir)).selectExpr("site_id", "kind", "poly_id", "cast(x AS long) AS x", "cast(y AS long) AS y")


@query
def polygon_union_mask(spark, sf_dir):
    return geometry.polygon_union_mask(X.polygons(spark, sf_dir), X.sizes(spark, sf_dir), "exclusion").selectExpr("site_id", "cast(x AS long) AS x", "cast(y AS long) AS y")


@query
def disc_pixels(spark, sf_dir):
    return geometry.disc_pixels(X.houses(spark, sf_dir), 5.5, X.sizes(spark, sf_dir)).select("site_id", "scene_id", "house_id", F.col("px").cast("long").alias("x"), F.col("py").cast("long").alias("y"))


@query
def settlement_mask(spark, sf_dir):
    m = geometry.settlement_mask(X.polygons(spark, sf_dir), X.houses(spark, sf_dir), X.masks(spark, sf_dir), X.sizes(spark, sf_dir), 4.0, 1)
    return m.selectExpr("site_id", "scene_id", "cast(x AS long) AS x", "cast(y AS long) AS y")


@query
def dedupe_vertices(spark, sf_dir):
    return geometry.dedupe_vertices(X.polygons(spark, sf_dir))


def placed_photos(spark, sf_dir) -> DataFrame:
    return geometry.georeference_points(X.photos(spark, sf_dir), 16, 14777102.08, 6502220.83, 4.0, -6.0, 2.0)


@query
def georeference_points(spark, sf_dir):
    return placed_photos(spark, sf_dir).select("photo_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query
def class_at_points(spark, sf_dir):
    labels = B.pixel_class_label(layers(spark, sf_dir))
    at = X.photos(spark, sf_dir).selectExpr("photo_id", "site_id", "photo_id % 130 * 0.9D - 5.3D AS x", "photo_id * 7 % 117 * 0.9D AS y")
    return geometry.class_at_points(at, labels).select("photo_id", "scene_id", "label")


@query
def nearest_within(spark, sf_dir):
    points = X.houses(spark, sf_dir).select("site_id", F.col("house_id").alias("point_id"), "x", "y")
    at = X.photos(spark, sf_dir).selectExpr("photo_id AS query_id", "site_id", "photo_id % 130 * 0.9D - 5.3D AS x", "photo_id * 7 % 117 * 0.9D AS y")
    return geometry.nearest_within(at, points, 13.0).select("query_id", "point_id", *r6("d"))


@query
def compass8(spark, sf_dir):
    return X.photos(spark, sf_dir).select("photo_id", gps.compass8(F.col("dir")).alias("point"))


@query
def apply_corrections(spark, sf_dir):
    px = geometry.apply_corrections(X.masks(spark, sf_dir), X.corrections(spark, sf_dir))
    return px.where("buffer").select(*PIXEL)


# --- water, land cover, buffer


@query
def water_votes(spark, sf_dir):
    refs = X.masks(spark, sf_dir).select(*K).distinct().where("scene_id in ('c', 'd')")
    return water.water_votes(bands(spark, sf_dir), refs, tex_max=12)


@query
def water_mask(spark, sf_dir):
    return jobs.site_water(bands(spark, sf_dir), X.sizes(spark, sf_dir), SMALL).where("water").select("site_id", "x", "y")


@query
def coastal_zone(spark, sf_dir):
    sea = X.masks(spark, sf_dir).where("scene_id = 'b'").select("site_id", "x", "y", "water")
    return water.coastal_zone(bands(spark, sf_dir), sea, 120, 60).where("coast").select(*PIXEL)


@query
def samples_for_scene(spark, sf_dir):
    return landcover.samples_for_scene(circles(spark, sf_dir), X.masks(spark, sf_dir).select(*K).distinct()).select("site_id", "scene_id", "class", "circle_id", "x", "y", "r")


def trained(spark, sf_dir):
    s = landcover.samples_for_scene(circles(spark, sf_dir), X.masks(spark, sf_dir).select(*K).distinct())
    return landcover.train_from_bands(bands(spark, sf_dir), s, X.sizes(spark, sf_dir))


@query
def train_prototypes(spark, sf_dir):
    p, _ = trained(spark, sf_dir)
    return p.select(*K, "class", "circle_id", "n", *(F.round(F.col("mu")[k], 5).alias(f"mu{k}") for k in range(7)))


@query
def share_variance(spark, sf_dir):
    _, v = trained(spark, sf_dir)
    return landcover.share_variance(v).select(*K, *(F.round(F.col("va")[k], 4).alias(f"va{k}") for k in range(7)))


@query
def prototype_scores(spark, sf_dir):
    p, v = trained(spark, sf_dir)
    return landcover.score_tiles(bands(spark, sf_dir), p, landcover.share_variance(v), X.sizes(spark, sf_dir)).select(*PIXEL, *(F.round(f"score_{c}", 4).alias(f"score_{c}") for c in landcover.CLASSES))


def scored(spark, sf_dir) -> DataFrame:
    """Scores and parameters from integers of the true raster, so that decisions stand apart from training."""
    px = bands(spark, sf_dir)
    near = lambda c, at: f"CASE WHEN cls = {at} THEN -0.5D ELSE -cast((x * 7 + y * 3 + {at} * 5 + {c}) % 11 AS double) END"
    return px.selectExpr(
        *PIXEL, "cls < 4 AS land", "lum AS f_lum", "chroma AS f_chroma", f"{near(1, 0)} AS score_forest", f"CASE WHEN scene_id <> 'a' THEN {near(2, 1)} END AS score_sparse", f"{near(3, 2)} AS score_open",
        f"CASE WHEN scene_id = 'e' THEN {near(4, 3)} END AS score_built", "1D AS bias", "4D AS strictness", "150D AS builtMin", "24D AS builtChromaMax", "cast(CASE WHEN scene_id = 'b' THEN 100 END AS double) AS forestMax",
    )


@query
def decide_class(spark, sf_dir):
    return landcover.decide_class(scored(spark, sf_dir)).select(*PIXEL, "cls")


@query
def threshold_classify(spark, sf_dir):
    px = scored(spark, sf_dir).withColumns({f: F.lit(0.0) for f in focal.FEATURES[2:]}).withColumn("score_built", F.lit(None).cast("double"))
    return landcover.threshold_classify(px).select(*PIXEL, "cls")


@query
def clean_classes(spark, sf_dir):
    px = X.masks(spark, sf_dir).select(*PIXEL, "land", "forest", "sparse", "built")
    c = landcover.clean_classes(px, 2, SMALL["min_region"])
    return c.select(*PIXEL, "forest", "sparse", "open", "built")


def classified(spark, sf_dir) -> DataFrame:
    return jobs.land_cover(bands(spark, sf_dir), catalogue(spark, sf_dir), circles(spark, sf_dir), X.sizes(spark, sf_dir), SMALL)


@query
def classify_scene(spark, sf_dir):
    return classified(spark, sf_dir).select(*PIXEL, "land", "coast", "water", "forest", "sparse", "open", "built", "by_samples")


@query
def human_mask(spark, sf_dir):
    m = X.masks(spark, sf_dir).drop("human")
    return buffer.human_mask(m, geometry.polygon_union_mask(X.polygons(spark, sf_dir), X.sizes(spark, sf_dir), "settlement"), SMALL["min_human"]).where("human").select(*PIXEL)


@query
def buffer_band(spark, sf_dir):
    return buffer.buffer_band(X.masks(spark, sf_dir), SMALL["band"]).select(*PIXEL, "band", "buffer")


def zone(spark, sf_dir) -> DataFrame:
    return jobs.buffer_of(X.masks(spark, sf_dir).drop("human", "buffer"), X.polygons(spark, sf_dir), X.houses(spark, sf_dir), X.corrections(spark, sf_dir), X.sizes(spark, sf_dir), SMALL)


@query
def buffer_zone(spark, sf_dir):
    return zone(spark, sf_dir).select(*PIXEL, "human", "band", "buffer")


@query
def band_forested(spark, sf_dir):
    return buffer.band_forested(buffer.buffer_band(X.masks(spark, sf_dir), SMALL["band"])).groupBy(*K).agg(F.count_if("band_forested").alias("n"))


@query
def buffer_area_per_year(spark, sf_dir):
    """Scenes to land cover to buffer to area and change, end to end."""
    return jobs.areas(bands(spark, sf_dir), catalogue(spark, sf_dir), circles(spark, sf_dir), X.polygons(spark, sf_dir), X.houses(spark, sf_dir), X.corrections(spark, sf_dir), X.sizes(spark, sf_dir), SMALL, HA)


# --- change


@query
def mask_transitions(spark, sf_dir):
    return change.mask_transitions(X.masks(spark, sf_dir)).select("site_id", "k", "y0", "y1", "x", "y", "kind")


@query
def union_past(spark, sf_dir):
    return change.union_past(X.masks(spark, sf_dir), X.years(spark, 1990, 2022, 8)).groupBy("site_id", "t").agg(F.count(F.lit(1)).alias("n"))


def observed_as_current(spark, sf_dir) -> DataFrame:
    return X.masks(spark, sf_dir).where("buffer").select("site_id", F.col("year").cast("double").alias("t"), "x", "y")


def _lost(spark, sf_dir, base):
    years = spark.createDataFrame([(float(y),) for _, _, y in X.SCENES], "t double")
    return change.lost_vs_base(observed_as_current(spark, sf_dir), X.masks(spark, sf_dir), years, base).groupBy("site_id", "t", "compare_year").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("y * 100 + x")).alias("mark"))


@query
def lost_vs_base(spark, sf_dir):
    out = None
    for base in ("all", "prev", "first", "c"):
        part = _lost(spark, sf_dir, base).withColumn("base", F.lit(base))
        out = part if out is None else out.unionByName(part)
    return out


@query
def jitter(spark, sf_dir):
    e = X.table(spark, sf_dir, "events")
    return e.select("event_id", F.round(change.jitter(F.lit(104730), F.col("event_id")), 12).alias("u"))


@query
def priority_order(spark, sf_dir):
    px = X.masks(spark, sf_dir).where("buffer").selectExpr(*PIXEL, "cast((x * 37 + y * 11) % 101 / 7D AS float) AS p")
    return change.priority_order(px, "p", K).select(*PIXEL, "rank")


@query
def build_intervals(spark, sf_dir):
    return change.build_intervals(X.masks(spark, sf_dir), 1, 6.0).select("site_id", "k", "x", "y", "kind", "rank")


@query
def interpolate_mask(spark, sf_dir):
    m = X.masks(spark, sf_dir)
    return change.interpolate_mask(m, change.build_intervals(m, 1, 6.0), X.years(spark, 1988, 2024, 1.5)).groupBy("site_id", "t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("y * 100 + x")).alias("mark"))


@query
def observed_area_at(spark, sf_dir):
    return change.observed_area_at(X.area_series(spark, sf_dir), X.years(spark)).select("site_id", "t", *r6("area_ha"))


@query
def area_change_rate(spark, sf_dir):
    return change.area_change_rate(X.order_series(spark, sf_dir)).select("site_id", "year", "area_ha", *r6("rate"))


@query
def buffer_share(spark, sf_dir):
    s = stats.scene_stats(X.masks(spark, sf_dir).withColumns({"settlement": F.lit(False), "aoi": F.expr("scene_id <> 'e'")}), HA)
    return change.buffer_share(s).select(*K, *r6("share_pct"))


@query
def frame_years(spark, sf_dir):
    s = X.area_series(spark, sf_dir)
    return change.frame_years(s, trend.projection_setup(s), 5)


@query
def frame_summary(spark, sf_dir):
    return jobs.frames(X.masks(spark, sf_dir), X.years(spark, 1988, 2040, 4.0), HA).select("site_id", "t", "mode", *r6("area_ha", "lost_ha"), "compare_year")


#: Options of the sites of ``frame_bases``: base, model, start scene, threshold, protection, manual rate.
FRAME_OPTIONS = [("all", "linear", None, 5.0, 0.0, None), ("prev", "exp", "d", 10.0, None, None), ("first", "last", None, 5.0, 5.0, None), ("c", "manual", "c", None, 0.0, -4.0), ("none", None, "no scene", 5.0, 0.0, None)]


def _optioned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The masks, and a site for each of their sites and sets of options."""
    rows = spark.createDataFrame([(n, *o) for n, o in enumerate(FRAME_OPTIONS)], "n int, base string, model string, start_id string, threshold_pct double, protect_px double, manual_rate_pct double")
    number = (F.col("site_id") * 10 + F.col("n")).alias("site_id")
    m = X.masks(spark, sf_dir).select("site_id", "scene_id", "year", "x", "y", "buffer", "forest", "built")
    return m, X.sites(spark, sf_dir).crossJoin(rows).select(number, F.col("site_id").alias("raster_id"), *(c for c in rows.columns if c != "n"))


@query
def frame_bases(spark, sf_dir):
    """Frames of every year, each site with its own base, model, start, threshold and protection."""
    masks, options = _optioned(spark, sf_dir)
    made = jobs.frames(masks, X.years(spark, 1988, 2040, 1), HA, options=options)
    return made.select("site_id", "t", "mode", *r6("area_ha", "lost_ha"), F.col("compare_year").cast("double").alias("compare_year"), "scene_id")


@query
def frame_pixels(spark, sf_dir):
    """The masks of a few frames: buffer, lost, and forest with what was lost."""
    masks, options = _optioned(spark, sf_dir)
    px = jobs.frame_pixels(masks, X.years(spark, 1988, 2040, 13), HA, options=options)
    flags = {c: F.col(c).cast("long") for c in ("buffer", "lost", "forest")}
    mark = (F.col("y") * 100 + F.col("x")) * (1 + 2 * flags["buffer"] + 3 * flags["lost"] + 5 * flags["forest"])
    return px.groupBy("site_id", "t").agg(*(F.sum(v).alias(c) for c, v in flags.items()), F.sum(mark).alias("mark"))


# --- trend and projection


@query
def fit_trend(spark, sf_dir):
    s = X.order_series(spark, sf_dir).select("site_id", "year", "area_ha")
    out = None
    for model in ("linear", "exp", "last", "manual"):
        part = trend.fit_trend(s, model)
        out = part if out is None else out.unionByName(part)
    return out.select("site_id", "model", "kind", *r6("slope"), F.round("intercept", 4).alias("intercept"), *r6("r2"), "points", "ok")


def setup_of(spark, sf_dir, model="linear") -> DataFrame:
    return trend.projection_setup(X.area_series(spark, sf_dir), None, 5, model)


@query
def area_schedule(spark, sf_dir):
    out = None
    for model in ("linear", "exp", "manual"):
        part = trend.area_schedule(setup_of(spark, sf_dir, model), X.years(spark, 2020, 2060, 2)).withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return out.select("site_id", "model", "t", *r6("area_ha"))


@query
def disappear_year(spark, sf_dir):
    s = setup_of(spark, sf_dir)
    return s.select("site_id", F.explode(F.array(*(F.lit(float(v)) for v in (0, 0.05, 0.2, 0.5, 5)))).alias("target"), "start_year", "a0", "slope", "kind", "ok").select("site_id", "target", F.round(trend.disappear_year(F.col("target")), 6).alias("year"))


@query
def trend_rates(spark, sf_dir):
    return setup_of(spark, sf_dir, "exp").select("site_id", *r6("rate_ha", "rate_pct"))


@query
def removal_order(spark, sf_dir):
    return projection.removal_order(X.masks(spark, sf_dir).where("scene_id = 'e'"), 1, 6.0, 5.0).select("site_id", "x", "y", "rank")


@query
def projected_mask(spark, sf_dir):
    order = projection.removal_order(X.masks(spark, sf_dir).where("scene_id = 'e'"), 1, 6.0, 0)
    schedule = trend.area_schedule(setup_of(spark, sf_dir), X.years(spark, 2020, 2044, 3))
    return projection.projected_mask(order, schedule, HA).groupBy("site_id", "t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("y * 100 + x")).alias("mark"))


@query
def projection_setup(spark, sf_dir):
    return setup_of(spark, sf_dir).select("site_id", "start_year", *r6("a0", "threshold_ha", "disappear_year", "rate_ha", "rate_pct"), "x_min", "x_max", "note")


@query
def forecast_table(spark, sf_dir):
    s = observed(spark, sf_dir)
    return trend.forecast_table(setup_of(spark, sf_dir), first_land(s)).select("site_id", "kind_of_row", *r6("year", "area_ha", "share_pct", "rate_ha"))


@query
def hindcast(spark, sf_dir):
    return trend.hindcast(X.area_series(spark, sf_dir), "c").select("site_id", "scene_id", "year", *r6("area_ha", "predicted_ha", "error_ha"))


# --- coding, text and dates


@query
def rle_encode(spark, sf_dir):
    return rle.rle_encode(X.rle_values(spark, sf_dir), "v").select(*K, F.array_join(F.col("runs").cast("array<string>"), ",").alias("runs"))


@query
def rle_runs(spark, sf_dir):
    """The runs as rows, of values that also run on from row to row."""
    v = X.rle_values(spark, sf_dir).selectExpr(*PIXEL, "CASE WHEN y % 9 < 4 AND x >= y % 9 THEN 0 ELSE v END AS v")
    return rle.rle_runs(v, "v")


@query
def rle_decode(spark, sf_dir):
    return rle.rle_decode(rle.rle_encode(X.rle_values(spark, sf_dir), "v"), X.sizes(spark, sf_dir))


@query
def dms_to_decimal(spark, sf_dir):
    return X.exif_files(spark, sf_dir).where("text is null").select("name", F.round(gps.dms_to_decimal("lat", "S"), 6).alias("lat"), F.round(gps.dms_to_decimal("lon", "W"), 6).alias("lon"))


@query
def gps_altitude(spark, sf_dir):
    return X.exif_files(spark, sf_dir).where("text is null").select("name", F.round(gps.gps_altitude(), 6).alias("alt"))


@query
def photo_datetime(spark, sf_dir):
    return X.exif_files(spark, sf_dir).where("text is null").select("name", gps.photo_datetime().alias("taken_at"), F.date_format(gps.photo_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("taken"))


@query
def parse_iso6709(spark, sf_dir):
    m = gps.parse_iso6709(F.col("text"))
    return X.movie_texts(spark, sf_dir).select("name", *(F.round(m[c], 6).alias(c) for c in ("lat", "lon", "alt")), m["taken_at"].alias("taken_at"))


@query
def gps_listing(spark, sf_dir):
    return gps.gps_listing(X.exif_files(spark, sf_dir)).select("name", *r6("lat", "lon", "alt"), "taken_at", "status")


@query
def photo_paths(spark, sf_dir):
    return X.photos(spark, sf_dir).select("photo_id", *(c.alias(n) for n, c in gps.photo_paths(F.col("file"), "data").items()))


@query
def tag_counts(spark, sf_dir):
    photos, tags = _photos(spark, sf_dir)
    return gps.tag_counts(photos, tags)
