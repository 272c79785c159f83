"""The buffer zone: sparse land between human land and dense forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.keys import PIXEL
from landfold.operators import distance, geometry, regions


def _flag(px: DataFrame, pixels: DataFrame | None, name: str) -> DataFrame:
    """px with whether the pixel is in a table of pixels, by scene or by site."""
    if pixels is None:
        return px.withColumn(name, F.lit(False))
    on = [c for c in PIXEL if c in pixels.columns]
    return px.join(pixels.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def human_mask(px: DataFrame, settlement: DataFrame | None, min_region_px: float = 400) -> DataFrame:
    """px(land, open, built) with ``human``: settlement, or open and built land in large enough regions."""
    px = _flag(px, settlement, "_set").withColumn("_work", F.expr("land and (open or built)"))
    px = regions.remove_small_regions(px, "_work", min_region_px, 8, "_big")
    return px.withColumn("human", F.expr("land and (_set or _big)")).drop("_set", "_work", "_big")


def buffer_band(px: DataFrame, band_px: float) -> DataFrame:
    """px(land, human, sparse) with ``band`` and ``buffer``; no band width: no band, all sparse land without people."""
    px = px if band_px <= 0 else distance.with_near_distances(px, {"_human": ("human", band_px)})
    return _band(px, band_px).drop("_human")


def _band(px: DataFrame, band_px: float) -> DataFrame:
    if band_px <= 0:
        return px.withColumn("band", F.lit(False)).withColumn("buffer", F.expr("sparse and not human"))
    return px.withColumn("band", F.expr(f"land and not human and coalesce(_human / 3 <= {band_px}, false)")).withColumn("buffer", F.expr("band and sparse"))


def buffer_zone(
    px: DataFrame, settlement: DataFrame | None = None, aoi: DataFrame | None = None, corrections: DataFrame | None = None, exclude: DataFrame | None = None,
    band_px: float = 0, min_human_region_px: float = 400, min_buffer_region_px: float = 130, forest_near_px: float = 0, coast_away_px: float = 0,
    adjacency_px: float = 6, min_forest_region_px: float = 2600, tile: int = distance.TILE,
) -> DataFrame:
    """px(land, forest, sparse, open, built, water, coast) with ``human``, ``band`` and ``buffer``, in pixels.

    Corrections come after the region filters and before the area of interest, which cuts buffer and band only.
    People and dense forest are filtered together, all distances are taken together as far as they are asked for (one
    exchange, a halo of the longest of them), and one labelling of the buffer
    serves its least size and its adjacency (regions leave whole, so that the two tests don't affect each other).
    """
    px = _flag(px, settlement, "_set").withColumn("_work", F.expr("land and (open or built)"))
    large = {"_big": ("_work", [(F.lit(1), min_human_region_px)])}
    if forest_near_px > 0:
        large["_main"] = ("forest", [(F.lit(1), min_forest_region_px)])
    px = regions.keep_regions(px, large).withColumn("human", F.expr("land and (_set or _big)")).drop("_set", "_work", "_big")
    masks = {"_human": ("human", max(band_px, adjacency_px))} if band_px > 0 or adjacency_px > 0 else {}
    masks |= {"_forest": ("_main", forest_near_px)} if forest_near_px > 0 else {}
    masks |= {"_wet": (F.col("water") | F.col("coast"), coast_away_px)} if coast_away_px > 0 else {}
    px = distance.with_near_distances(px, masks, tile) if masks else px
    px = _flag(_band(px, band_px), exclude, "_out")
    near = ["_forest is not null"] if forest_near_px > 0 else []
    away = ["_wet is null"] if coast_away_px > 0 else []
    px = px.withColumn("buffer", F.expr(" and ".join(["buffer", "not _out", *near, *away]))).drop("_out", "_main", "_forest", "_wet")
    tests = [(F.lit(1), min_buffer_region_px)]
    if adjacency_px > 0:
        tests.append((F.expr(f"cast(coalesce(_human / 3 <= {adjacency_px}, false) as int)"), 1))
    px = regions.keep_regions(px, {"_kept": ("buffer", tests)}).withColumn("buffer", F.col("_kept")).drop("_kept")
    px = px.drop("_human")
    if corrections is not None:
        px = geometry.apply_corrections(px, corrections)
    if aoi is not None:
        px = _flag(px, aoi, "_in").withColumns({"buffer": F.expr("buffer and _in"), "band": F.expr("band and _in")}).drop("_in")
    return px


def band_forested(px: DataFrame) -> DataFrame:
    """px with ``band_forested``: the part of the band that became forest."""
    return px.withColumn("band_forested", F.col("band") & F.col("forest"))
