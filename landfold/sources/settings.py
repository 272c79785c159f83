"""Scene catalogue, saved settings, photo lists, and the tables that are handed out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT = "struct<x double,y double>"
CIRCLES = "map<string,array<struct<x double,y double,r int>>>"
#: What a user draws on a site: circles of samples, houses, polygons of each kind.
DRAWN = f"samples struct<shared {CIRCLES}, byScene map<string,{CIRCLES}>>, houses array<{POINT}>, housesByScene map<string,array<{POINT}>>, polygons map<string,array<array<{POINT}>>>"
CONFIG = f"site_id long, scenes array<struct<id string, file string, year double, label string, estimated boolean, params map<string,double>>>, {DRAWN}"
PHOTOS = "dir string, source string, photos array<struct<file string,lat double,lon double,alt double,time string,dir double,tag string>>, tags map<string,struct<label string,color string,note string>>"
SAVED = (
    "site_id long, settingsVersion int, display map<string,string>, buffer map<string,double>, sim map<string,string>, settlement map<string,double>, coastBandM double, photoOffset struct<dxM double,dyM double>, "
    f"scenes array<struct<id string,file string,year double,label string,estimated boolean,params map<string,double>,correction array<bigint>>>, {DRAWN}"
)
#: Columns of a site's settings in tables of one row a site, beside site_id.
SITE = ["display", "buffer", "sim", "settlement", "coastBandM", "photoOffset", "samples", "houses", "housesByScene", "polygons"]



def read_scene_config(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """scenes, samples, houses and polygons of catalogue files (JSON, one document a file or line)."""
    c = spark.read.schema(CONFIG).json(path)
    scenes = c.select("site_id", F.explode("scenes").alias("s")).select("site_id", F.col("s.id").alias("scene_id"), "s.file", "s.year", "s.label", F.coalesce("s.estimated", F.lit(False)).alias("estimated"), "s.params")
    return {"scenes": scenes, **drawn_tables(c)}


def drawn_tables(docs: DataFrame) -> dict[str, DataFrame]:
    """samples, houses and polygons as rows, from a row a site with the columns of DRAWN."""
    per_class = lambda df: df.select("site_id", "scene_id", F.explode("m").alias("class", "circles")).select("site_id", "scene_id", "class", F.posexplode("circles").alias("circle_id", "c")).select("site_id", "scene_id", "class", "circle_id", "c.*")
    shared = docs.select("site_id", F.lit(None).cast("string").alias("scene_id"), F.col("samples.shared").alias("m"))
    own = docs.select("site_id", F.explode("samples.byScene").alias("scene_id", "m"))
    houses = docs.select("site_id", F.lit(None).cast("string").alias("scene_id"), F.explode("houses").alias("h")).union(docs.select("site_id", F.explode("housesByScene").alias("scene_id", "hs")).select("site_id", "scene_id", F.explode("hs")))
    polygons = docs.select("site_id", F.explode("polygons").alias("kind", "ps")).select("site_id", "kind", F.posexplode("ps").alias("poly_id", "p")).select("site_id", "kind", "poly_id", F.posexplode("p").alias("vertex_no", "v")).select("site_id", "kind", "poly_id", "vertex_no", "v.*")
    return {"samples": per_class(shared).union(per_class(own)), "houses": houses.select("site_id", "scene_id", "h.*"), "polygons": polygons}


def with_drawn(sites: DataFrame, samples: DataFrame, houses: DataFrame, polygons: DataFrame) -> DataFrame:
    """sites (a row a site) with the columns of DRAWN; what a site lacks is null."""
    circles = samples.groupBy("site_id", "scene_id", "class").agg(F.array_sort(F.collect_list(F.struct("x", "y", "r"))).alias("circles"))
    by_class = circles.groupBy("site_id", "scene_id").agg(F.map_from_entries(F.collect_list(F.struct("class", "circles"))).alias("m"))
    circle_maps = by_class.groupBy("site_id").agg(
        F.first(F.when(F.col("scene_id").isNull(), F.col("m")), ignorenulls=True).alias("shared"),
        F.map_from_entries(F.collect_list(F.when(F.col("scene_id").isNotNull(), F.struct("scene_id", "m")))).alias("byScene"),
    )
    h = houses.groupBy("site_id", "scene_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("hs"))
    h = h.groupBy("site_id").agg(
        F.first(F.when(F.col("scene_id").isNull(), F.col("hs")), ignorenulls=True).alias("houses"),
        F.map_from_entries(F.collect_list(F.when(F.col("scene_id").isNotNull(), F.struct("scene_id", "hs")))).alias("housesByScene"),
    )
    ring = polygons.groupBy("site_id", "kind", "poly_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vertex_no", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("p"))
    ring = ring.groupBy("site_id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("poly_id", "p"))), lambda r: r["p"]).alias("ps"))
    p = ring.groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "ps"))).alias("polygons"))
    circle_maps = circle_maps.select("site_id", F.struct("shared", "byScene").alias("samples"))
    return sites.join(circle_maps, "site_id", "left").join(h, "site_id", "left").join(p, "site_id", "left")


def _by_id(items: Column) -> Column:
    return F.array_sort(items, lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))


def write_scene_config(scenes: DataFrame, samples: DataFrame, houses: DataFrame, polygons: DataFrame, path: str) -> None:
    """One catalogue document a site."""
    s = scenes.groupBy("site_id").agg(_by_id(F.collect_list(F.struct(F.col("scene_id").alias("id"), "file", "year", "label", "estimated", "params"))).alias("scenes"))
    with_drawn(s, samples, houses, polygons).write.mode("overwrite").json(path)


def read_saved_settings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAVED).json(path)


def merge_settings(defaults: DataFrame, saved: DataFrame, version: int) -> DataFrame:
    """Scene rows (site_id, scene_id, year, label, estimated, params, correction, migrated): saved values over defaults.

    Values saved under another settings version are dropped, but what was drawn (corrections) stays. Saved parameters
    replace the default's as a whole. At most one saved document a site; scenes that only it names are left out.
    """
    s = saved.select("site_id", F.coalesce("settingsVersion", F.lit(0)).alias("_v"), F.explode_outer("scenes").alias("s")).select("site_id", "_v", F.col("s.id").alias("scene_id"), "s.year", "s.label", "s.estimated", "s.params", "s.correction")
    same = F.col("_v") == version
    s = s.select("site_id", "scene_id", *(F.when(same, F.col(c)).alias("_" + c) for c in ("year", "label", "estimated", "params")), "correction")
    old = saved.groupBy("site_id").agg(F.max(F.coalesce("settingsVersion", F.lit(0)) != version).alias("migrated"))
    out = defaults.join(s, ["site_id", "scene_id"], "left").join(old, "site_id", "left")
    return out.select("site_id", "scene_id", *(F.coalesce("_" + c, c).alias(c) for c in ("year", "label", "estimated", "params")), "correction", F.coalesce("migrated", F.lit(False)).alias("migrated"))


def _over(base: Column, top: Column) -> Column:
    """Entries of the map top over those of base; either may be null."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(top), k))
    return F.when(top.isNull(), base).when(base.isNull(), top).otherwise(F.map_concat(kept, top))


def merge_site_settings(defaults: DataFrame, saved: DataFrame, version: int) -> DataFrame:
    """(site_id, the columns of SITE, migrated), a row a site of defaults: saved settings over the default ones.

    defaults: site_id and the columns of SITE; saved: at most one document a site (SAVED). Saved entries of display and
    sim replace default ones, those of buffer and settlement (distances) where they are not null. Saved under another
    version, display, buffer, sim, settlement distances, coast band and area of interest (polygons of kind ``aoi``, part
    of the buffer's settings) are dropped; samples, houses, other polygons and the photo offset stay. Samples and houses
    replace the default's as a whole, polygons kind by kind; an empty list clears. With a saved buffer the area of
    interest is the saved one or none. A missing part of a photo offset is 0.
    """
    s = saved.select("site_id", (F.coalesce("settingsVersion", F.lit(0)) == version).alias("_same"), *(F.col(c).alias("_" + c) for c in SITE))
    d = defaults.join(s, "site_id", "left")
    own = lambda c: F.when(F.col("_same"), F.col("_" + c))
    whole = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    area = F.lit("aoi")
    drawn = F.map_filter("_polygons", lambda k, _: F.col("_same") | (k != area))
    cleared = own("buffer").isNotNull() & ~F.coalesce(F.array_contains(F.map_keys("_polygons"), area), F.lit(False))
    polygons = F.map_filter(_over(F.col("polygons"), drawn), lambda k, _: (k != area) | ~F.coalesce(cleared, F.lit(False)))
    offset = F.struct(*(F.coalesce(f"_photoOffset.{c}", F.lit(0.0)).alias(c) for c in ("dxM", "dyM")))
    return d.select(
        "site_id",
        *(_over(F.col(c), own(c)).alias(c) for c in ("display", "sim")),
        *(_over(F.col(c), whole(own(c))).alias(c) for c in ("buffer", "settlement")),
        F.coalesce(own("coastBandM"), "coastBandM").alias("coastBandM"),
        F.when(F.col("_photoOffset").isNotNull(), offset).otherwise(F.col("photoOffset")).alias("photoOffset"),
        *(F.coalesce("_" + c, c).alias(c) for c in ("samples", "houses", "housesByScene")),
        polygons.alias("polygons"),
        F.coalesce(~F.col("_same"), F.lit(False)).alias("migrated"),
    )


def export_settings(scenes: DataFrame, corrections_rle: DataFrame, version: int, sites: DataFrame | None = None) -> DataFrame:
    """(site_id, json): one settings document a site (SAVED), with run-length coded corrections.

    scenes: with file, year, label, estimated and params; those without a file are not saved. sites: site_id and columns
    of SITE, a row a site; drawn elements that it has as null are written as empty, so that they clear the default's.
    """
    s = scenes.where("file is not null").join(corrections_rle.withColumnRenamed("runs", "correction"), ["site_id", "scene_id"], "left")
    s = s.groupBy("site_id").agg(_by_id(F.collect_list(F.struct(F.col("scene_id").alias("id"), "file", "year", "label", "estimated", "params", "correction"))).alias("scenes"))
    parts = []
    if sites is not None:
        s, parts = sites.join(s, "site_id", "left"), [c for c in SITE if c in sites.columns]
    rings = F.array().cast(f"array<array<{POINT}>>")
    none = {
        "samples": F.struct(F.create_map().cast(CIRCLES).alias("shared"), F.create_map().cast(f"map<string,{CIRCLES}>").alias("byScene")),
        "houses": F.array().cast(f"array<{POINT}>"),
        "housesByScene": F.create_map().cast(f"map<string,array<{POINT}>>"),
    }
    no_polygons = F.create_map(F.lit("settlement"), rings, F.lit("exclusion"), rings)
    value = lambda c: _over(no_polygons, F.col(c)) if c == "polygons" else F.coalesce(c, none[c]) if c in none else F.col(c)
    return s.select("site_id", F.to_json(F.struct(F.lit(version).alias("settingsVersion"), "site_id", "scenes", *(value(c).alias(c) for c in parts))).alias("json"))


def read_photos(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """photos (file, lat, lon, alt, time, dir, tag, folder, taken) and tags (tag, label, color, note)."""
    d = spark.read.schema(PHOTOS).option("multiLine", True).json(path)
    photos = d.select(F.col("dir").alias("folder"), F.explode("photos").alias("p")).select("folder", "p.*").withColumn("taken", F.try_to_timestamp("time", F.lit("yyyy:MM:dd HH:mm:ss")))
    return photos, d.select(F.explode("tags").alias("tag", "t")).select("tag", "t.*").distinct()


def append_scenes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing plus incoming scenes (site_id, scene_id, year, arrival): a missing year is the site's last plus 10 n.

    The first to bring an id that the site lacks keeps it; any other gets the smallest suffix ``_1, _2 ...`` that makes an
    id which neither an existing nor an incoming scene has. ``is_new`` marks the scenes to compute (``plans.upkeep`` computes only those).
    """
    taken = existing.select("site_id", "scene_id").distinct()
    last = existing.groupBy("site_id").agg(F.max("year").alias("_last"))
    n = incoming.withColumn("_n", F.row_number().over(Window.partitionBy("site_id").orderBy("arrival")))
    n = n.join(taken.withColumn("_taken", F.lit(1)), ["site_id", "scene_id"], "left").join(last, "site_id", "left")
    again = F.row_number().over(Window.partitionBy("site_id", "scene_id").orderBy("arrival")) - 1
    n = n.withColumn("_j", again + F.coalesce("_taken", F.lit(0)))  # the j-th of its id that needs a suffix
    names = taken.union(incoming.select("site_id", "scene_id")).distinct()
    used = names.select("site_id", F.regexp_extract("scene_id", "(?s)^(.*)_[1-9][0-9]{0,8}$", 1).alias("scene_id"), F.regexp_extract("scene_id", "_([1-9][0-9]{0,8})$", 1).alias("_m")).where("_m <> ''")
    used = used.groupBy("site_id", "scene_id").agg(F.collect_set(F.col("_m").cast("int")).alias("_used"))
    n = n.join(used, ["site_id", "scene_id"], "left").withColumn("_used", F.coalesce("_used", F.array().cast("array<int>")))
    free = F.expr("filter(sequence(1, _j + size(_used)), v -> not array_contains(_used, v))[_j - 1]")
    n = n.withColumn("scene_id", F.when(F.col("_j") > 0, F.concat_ws("_", "scene_id", free.cast("string"))).otherwise(F.col("scene_id")))
    n = n.withColumn("year", F.coalesce("year", F.col("_last") + 10 * F.col("_n"))).withColumn("is_new", F.lit(True))
    return existing.withColumn("is_new", F.lit(False)).select("site_id", "scene_id", "year", "is_new").unionByName(n.select("site_id", "scene_id", "year", "is_new"))


def decimals(c: str, places: int):
    """Fixed decimals as text, empty for null."""
    return F.when(F.col(c).isNull(), "").otherwise(F.format_string(f"%.{places}f", F.col(c).cast("double")))


AREA_HEADER = ["kind", "id", "year", "label", "land_ha", "buffer_ha", "buffer_land_pct", "forest_ha", "sparse_ha", "field_ha", "built_ha", "settlement_ha", "change_ha_per_year"]


def area_table(observed: DataFrame, forecast: DataFrame, threshold: DataFrame) -> DataFrame:
    """(site_id, 13 text columns): observed scenes, forecast rows, and the row of the disappearance.

    observed: stats with year, label, share_pct and rate; forecast: rows of ``forecast_table``; threshold: site_id, threshold_ha.
    """
    fixed = {"land": ("land_ha", 2), "buffer": ("buffer_ha", 2), "share_pct": ("buffer_land_pct", 1), "forest": ("forest_ha", 2), "sparse": ("sparse_ha", 2), "field": ("field_ha", 2), "built": ("built_ha", 2), "settlement": ("settlement_ha", 2), "rate": ("change_ha_per_year", 3)}
    seen = observed.select("site_id", F.lit("observed").alias("kind"), F.col("scene_id").alias("id"), F.col("year").cast("string").alias("year"), F.replace(F.coalesce("label", F.lit("")), F.lit(","), F.lit(" ")).alias("label"), *(decimals(c, d).alias(n) for c, (n, d) in fixed.items()))
    later = forecast.where("kind_of_row = 'forecast'").select("site_id", F.lit("forecast").alias("kind"), F.col("year").cast("long").cast("string").alias("year"), decimals("area_ha", 2).alias("buffer_ha"), decimals("share_pct", 1).alias("buffer_land_pct"), decimals("rate_ha", 3).alias("change_ha_per_year"))
    gone = forecast.where("kind_of_row = 'gone'").join(threshold, "site_id").select("site_id", F.lit("gone").alias("kind"), decimals("year", 1).alias("year"), F.concat(F.lit("threshold "), decimals("threshold_ha", 2), F.lit(" ha")).alias("label"))
    out = seen.unionByName(later, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
    return out.select("site_id", *(F.coalesce(c, F.lit("")).alias(c) for c in AREA_HEADER))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_area_table(table: DataFrame, path: str) -> None:
    """CSV with a header, a folder a site."""
    table.write.mode("overwrite").option("header", True).option("emptyValue", "").partitionBy("site_id").csv(path)


def write_frame_table(frames: DataFrame, path: str) -> None:
    """{path}/csv: site_id, year, mode, buffer_ha, lost_ha; {path}/json: all columns of the frames."""
    write_csv(frames.select("site_id", F.col("t").alias("year"), "mode", decimals("area_ha", 2).alias("buffer_ha"), decimals("lost_ha", 2).alias("lost_ha")), f"{path}/csv")
    frames.write.mode("overwrite").json(f"{path}/json")


def write_gps_listing(listing: DataFrame, path: str) -> None:
    """CSV sorted by name: 8 decimals for positions, 2 for altitude, empty text for what is missing."""
    rows = listing.select("name", decimals("lat", 8).alias("lat"), decimals("lon", 8).alias("lon"), decimals("alt", 2).alias("alt_m"), "taken_at", F.col("status").alias("note"))
    write_csv(rows.orderBy("name"), path)
