"""Sea mask of a site, and the coast of a scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.keys import K
from landfold.operators import focal, regions
from landfold.operators.bands import grayscale_flag
from landfold.operators.stats import level_median


def water_votes(bands: DataFrame, refs: DataFrame | None = None, abs_min: float = 18, rel_min: float = 10, tex_max: float = 10) -> DataFrame:
    """(site_id, x, y, votes, refs): colour scenes in which the pixel is relatively blue and smooth.

    refs: (site_id, scene_id) to use; None, or a site without a usable one, means all colour scenes.
    """
    colour = bands.join(grayscale_flag(bands).where("not grayscale"), K, "left_semi")
    if refs is not None:
        usable = refs.join(bands.select(*K).distinct(), K, "left_semi")
        chosen = colour.join(usable, K, "left_semi")
        others = colour.join(usable.select("site_id").distinct(), "site_id", "left_anti")
        colour = chosen.unionByName(others)
    limit = level_median(colour, "blue").select(*K, F.greatest(F.lit(float(abs_min)), F.col("median") + rel_min).alias("_limit"))
    seen = focal.tile_stats(colour.select(*K, "x", "y", "lum", "blue"), {"_t": ("std", "lum", 2)}).join(limit, K)
    vote = ((F.col("blue") > F.col("_limit")) & (F.col("_t") < tex_max)).cast("int")
    return seen.groupBy("site_id", "x", "y").agg(F.sum(vote).alias("votes"), F.count(F.lit(1)).alias("refs"))


def water_mask(votes: DataFrame, sizes: DataFrame, min_land_region: int = 1500, close_radius: int = 2, grow: int = 1) -> DataFrame:
    """(site_id, x, y, water) from votes; a site without a colour scene has no rows."""
    px = votes.withColumn("scene_id", F.lit("site")).withColumn("_c", F.col("votes") >= F.expr("refs div 2 + 1"))
    px = focal.morph_close(px, "_c", close_radius, "_sea").withColumn("_dry", ~F.col("_sea"))
    px = regions.remove_small_regions(px.select("site_id", "scene_id", "x", "y", "_dry"), "_dry", min_land_region, 4, "_land").withColumn("_wet", ~F.col("_land"))
    px = focal.morph_close(px, "_wet", close_radius, "_closed")
    px = regions.keep_border_regions(px, "_closed", sizes, 4, close_radius + 1, "_edge")
    return focal.dilate(px, "_edge", grow, "water").select("site_id", "x", "y", "water")


def coastal_zone(bands: DataFrame, water: DataFrame, lum_min: float = 185, chroma_max: float = 30) -> DataFrame:
    """bands with ``water`` and ``coast``: bright unsaturated pixels joined to the water (4-connected)."""
    px = bands.join(water, ["site_id", "x", "y"], "left").withColumn("water", F.coalesce("water", F.lit(False)))
    px = focal.tile_stats(px, {"_l": ("mean", "lum", 1), "_c": ("mean", "chroma", 1)})
    px = px.withColumn("_bright", F.col("water") | ((F.col("_l") > lum_min) & (F.col("_c") < chroma_max)))
    px = regions.keep_touching_regions(px, "_bright", "water", 4, "_hit")
    return px.withColumn("coast", F.col("_hit") & ~F.col("water")).drop("_l", "_c", "_bright", "_hit")
