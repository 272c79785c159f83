"""Bands, class labels and overlay colours: expressions on pixels, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landfold.keys import K, PIXEL


def half_up(c: Column | str) -> Column:
    """floor(c + 0.5), the rounding used everywhere."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c + 0.5)


def spectral_bands(px: DataFrame) -> DataFrame:
    """px with lum, chroma, green and blue (excess over the mean of the other two)."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    return px.withColumns(
        {"lum": 0.299 * r + 0.587 * g + 0.114 * b, "chroma": F.greatest(r, g, b) - F.least(r, g, b), "green": g - (r + b) / 2, "blue": b - (r + g) / 2}
    )


def grayscale_flag(bands: DataFrame, limit: float = 3) -> DataFrame:
    """(site_id, scene_id, grayscale): a scene is monochrome if its mean chroma is below the limit."""
    return bands.groupBy(*K).agg((F.avg("chroma") < limit).alias("grayscale"))


def sort_scenes(scenes: DataFrame) -> DataFrame:
    """Scenes that have a mask and are not excluded, with their 0-based place by year in each site."""
    order = Window.partitionBy("site_id").orderBy("year", "scene_id")
    return scenes.where("has_mask and not excluded").withColumn("k", F.row_number().over(order) - 1)


def land_mask(px: DataFrame, coast_exclude: bool = True) -> DataFrame:
    """px(water, coast) with ``land``: neither water nor, unless switched off, coast."""
    coast = F.coalesce(F.col("coast"), F.lit(False)) if coast_exclude else F.lit(False)
    return px.withColumn("land", ~F.coalesce(F.col("water"), F.lit(False)) & ~coast)


def built_rule(lum: Column, chroma: Column, built_min: Column, built_chroma_max: Column) -> Column:
    """Bright and unsaturated, from smoothed bands."""
    return (lum > built_min) & (chroma < built_chroma_max)


def apply_aoi(df: DataFrame, aoi: DataFrame | None) -> DataFrame:
    """Rows inside the area of interest (site_id, x, y); None means everything."""
    return df if aoi is None else df.join(aoi.select("site_id", "x", "y").distinct(), ["site_id", "x", "y"], "left_semi")


def pixel_class_label(px: DataFrame) -> DataFrame:
    """px with ``label``, the first class that holds."""
    label = F.when(F.col("buffer"), "buffer")
    for name in ("settlement", "open", "built", "sparse", "forest"):
        label = label.when(F.col(name), name)
    return px.withColumn("label", label.when(F.col("water") | F.col("coast"), "water").otherwise("unknown"))


#: Layers by precedence; band_lost is the band that became forest.
LAYERS = ["buffer", "lost", "band_lost", "settlement", "excl", "field", "sparse", "water", "built", "forest"]


def overlay_layer(px: DataFrame, show: dict[str, bool] | None = None, dim: bool = True) -> DataFrame:
    """px with ``layer``: the first shown layer that holds, 'none', or 'dim' outside the area of interest."""
    show = show or {}
    there = px.withColumn("band_lost", F.col("band") & F.col("forest"))
    layer = F.lit("none")
    for name in reversed(LAYERS):
        if name == "buffer" or show.get(name, True):
            layer = F.when(F.col(name), name).otherwise(layer)
    if dim:
        wet = F.col("water") if show.get("water", True) else F.lit(False)
        layer = F.when(~F.col("aoi") & ~wet, "dim").otherwise(layer)
    return there.withColumn("layer", layer).drop("band_lost")


def packed(red: int, green: int, blue: int, alpha: Column) -> Column:
    """32-bit colour, alpha in the highest byte and red in the lowest."""
    return F.shiftleft(alpha.cast("long"), 24).bitwiseOR(F.lit((blue << 16) | (green << 8) | red))


def overlay_rgba(px: DataFrame, style: dict[str, tuple[int, int, int, float]], opacity: float = 0.6, lost_opacity: float = 0.5) -> DataFrame:
    """px(layer) with ``rgba``. style: red, green, blue and opacity of each layer; dim is fixed."""
    rgba = F.when(F.col("layer") == "dim", packed(20, 20, 20, F.lit(110)))
    for name, (r, g, b, o) in style.items():
        o = opacity if name == "buffer" else min(1.0, lost_opacity * (0.5 + opacity)) if name == "lost" else o
        rgba = rgba.when(F.col("layer") == name, packed(r, g, b, half_up(F.lit(255.0 * o))))
    return px.withColumn("rgba", rgba.otherwise(F.lit(0).cast("long")))


def crossfade_pixels(a: DataFrame, b: DataFrame, f: float, switch: bool = False) -> DataFrame:
    """Pixels of two scenes of a site blended by the fraction f, or b from f >= 0.5 when switching."""
    f = (1.0 if f >= 0.5 else 0.0) if switch else f
    both = a.select("site_id", "x", "y", *(F.col(c).alias("a" + c) for c in "rgb")).join(b.select("site_id", "x", "y", *(F.col(c).alias("b" + c) for c in "rgb")), ["site_id", "x", "y"])
    return both.select("site_id", "x", "y", *((F.col("a" + c) * (1 - f) + F.col("b" + c) * f).alias(c) for c in "rgb"))


def water_with_coast(px: DataFrame, water: DataFrame | None, coast: DataFrame | None) -> DataFrame:
    """px with ``wet``: water of the site or coast of the scene; either may be missing."""
    wet = F.lit(False)
    if water is not None:
        px = px.join(water.select("site_id", "x", "y", F.col("water").alias("_w")), ["site_id", "x", "y"], "left")
        wet = wet | F.coalesce("_w", F.lit(False))
    if coast is not None:
        px = px.join(coast.select(*PIXEL, F.col("coast").alias("_c")), PIXEL, "left")
        wet = wet | F.coalesce("_c", F.lit(False))
    return px.withColumn("wet", wet).drop("_w", "_c")


def override_report(scenes: DataFrame) -> DataFrame:
    """(site_id, scene_id, overrides): the parameters that a scene sets itself, as key=value text, and estimated years."""
    own = F.map_filter("params", lambda k, v: v.isNotNull())
    text = F.concat_ws(" ", F.array_sort(F.transform(F.map_entries(own), lambda e: F.concat_ws("=", e["key"], e["value"]))))
    return scenes.select(*K, text.alias("overrides"), F.coalesce("estimated", F.lit(False)).alias("estimated"))
