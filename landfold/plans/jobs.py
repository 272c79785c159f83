"""Whole jobs: scenes to areas, masks to frames, areas to projected masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landfold.keys import K
from landfold.operators import buffer, change, geometry, landcover, projection, stats, trend, water
from landfold.operators import frames as frame
from landfold.operators.bands import grayscale_flag
from landfold.tables import written


def site_water(bands: DataFrame, sizes: DataFrame, p: dict) -> DataFrame:
    """(site_id, x, y, water) by votes of all colour scenes."""
    return _water_of(written(bands.select(*K, "x", "y", "lum", "chroma", "blue"), "bands"), sizes, p)


def _water_of(bands: DataFrame, sizes: DataFrame, p: dict) -> DataFrame:
    """The same from bands that are cheap to read again: they feed the flag of colour, the median and the texture."""
    return written(water.water_mask(water.water_votes(bands, tex_max=12), sizes, p["min_land_region"]), "water")


def land_cover(bands: DataFrame, scenes: DataFrame, samples: DataFrame, sizes: DataFrame, p: dict, wet: DataFrame | None = None) -> DataFrame:
    """Classes of every pixel of every scene. The bands feed water, coast and features, so they are written once.

    wet: the sites' water masks (site_id, x, y, water) where they are known; else they are made from these scenes.
    """
    bands = written(bands.select(*K, "x", "y", "lum", "chroma", "green", "blue"), "bands")
    coast = water.coastal_zone(bands, _water_of(bands, sizes, p) if wet is None else wet)
    params = landcover.resolve_params(scenes.select(*K, "params"), grayscale_flag(bands), {**landcover.DEFAULTS, "minRegionPx": p["min_region"]})
    circles = landcover.samples_for_scene(samples, bands.select(*K).distinct())
    classes = landcover.classify_scene(coast, params, circles, sizes)
    return written(classes, "classes")


def buffer_of(classes: DataFrame, polygons: DataFrame, houses: DataFrame, corrections: DataFrame | None, sizes: DataFrame, p: dict, radius_px: float = 4.0) -> DataFrame:
    """classes with human, band and buffer; polygons by kind: aoi, exclusion, settlement."""
    settlement = geometry.settlement_mask(polygons, houses, classes, sizes, radius_px)
    return buffer.buffer_zone(
        classes, settlement, geometry.polygon_union_mask(polygons, sizes, "aoi"), corrections, geometry.polygon_union_mask(polygons, sizes, "exclusion"),
        band_px=p["band"], min_human_region_px=p["min_human"], min_buffer_region_px=p["min_buffer"], forest_near_px=p["near"], coast_away_px=p["coast"],
        adjacency_px=p["adjacent"], min_forest_region_px=p["min_forest"],
    )


def areas(bands: DataFrame, scenes: DataFrame, samples: DataFrame, polygons: DataFrame, houses: DataFrame, corrections: DataFrame | None, sizes: DataFrame, p: dict, px_area_ha: float) -> DataFrame:
    """(site_id, scene_id, year, hectares of each class, rate, share_pct), scenes to areas end to end."""
    px = buffer_of(land_cover(bands, scenes, samples, sizes, p), polygons, houses, corrections, sizes, p)
    inside = geometry.polygon_union_mask(polygons, sizes, "aoi").withColumn("aoi", F.lit(True))
    px = px.join(inside, ["site_id", "x", "y"], "left").withColumns({"aoi": F.coalesce("aoi", F.lit(False)), "settlement": F.col("human") & ~F.col("open") & ~F.col("built")})
    s = stats.scene_stats(px, px_area_ha).join(scenes.select(*K, "year"), K).withColumn("area_ha", F.col("buffer"))
    s = change.buffer_share(change.area_change_rate(s))
    return s.select(*K, "year", *(F.round(c, 6).alias(c) for c in ("land", "buffer", "forest", "sparse", "field", "built", "rate", "share_pct")))


def _frame_parts(masks: DataFrame, years: DataFrame, px_area_ha: float, seed: int, jitter_px: float, options: DataFrame | None) -> tuple[DataFrame, ...]:
    """Scenes, options, setup, plan, intervals and removal order, written; the removal starts at each site's own start. Intervals are of rasters, all else of sites."""
    rasters = written(frame.scene_counts(masks), "scenes")
    own = written(frame.site_options(rasters, options), "options")
    scenes = written(frame.of_sites(rasters, own), "scenes")
    series = scenes.select("site_id", "scene_id", "year", (F.col("n") * F.lit(px_area_ha)).alias("area_ha"))
    setup = written(trend.projection_setups(series, own), "setup")
    plan = written(frame.frame_plan(scenes, setup, years), "plan")
    # pixels are ranked only where a frame's number of changed pixels falls inside a bucket
    asked = plan.where("mode <> 'pred'").join(own.select("site_id", "raster_id"), "site_id").select(F.col("raster_id").alias("site_id"), "k", "f").distinct()
    intervals = written(change.build_intervals(masks, seed, jitter_px, asked), "intervals")
    last = F.max(F.when(F.col("year") <= F.col("start_year"), F.struct("k", "scene_id")))["scene_id"]
    starts = scenes.join(setup.select("site_id", "start_year"), "site_id").groupBy("site_id").agg(last.alias("scene_id")).join(own.select("site_id", "raster_id", "protect_px"), "site_id")
    starts = written(starts, "starts")  # a row a site, which Spark then knows to be small beside the pixels
    cuts = frame.future_cuts(scenes, setup, plan, px_area_ha).select("site_id", "cut")
    first = masks.withColumnRenamed("site_id", "raster_id").join(starts, ["raster_id", "scene_id"])
    order = written(projection.removal_order(first, seed, jitter_px, F.col("protect_px"), cuts=cuts), "order")
    return scenes, own, setup, plan, intervals, order


def frames(masks: DataFrame, years: DataFrame, px_area_ha: float, seed: int = 1, jitter_px: float = 6.0, options: DataFrame | None = None) -> DataFrame:
    """(site_id, t, mode, area_ha, lost_ha, compare_year, base, scene_id, f) of observed, interpolated and projected years.

    masks: dense, with year, buffer, forest, built. options: site_id and any of raster_id, base, model, start_id, threshold_pct,
    protect_px, manual_rate_pct; what a site lacks is as in ``frames.DEFAULTS``: the projection starts at its own last scene.
    raster_id: the site of the masks, if it is another one; masks that several sites use are read and measured once.
    """
    scenes, own, setup, plan, intervals, order = _frame_parts(masks, years, px_area_ha, seed, jitter_px, options)
    return frame.frame_areas(masks, scenes, intervals, order, setup, own, plan, px_area_ha)


def frame_pixels(masks: DataFrame, years: DataFrame, px_area_ha: float, seed: int = 1, jitter_px: float = 6.0, options: DataFrame | None = None) -> DataFrame:
    """(site_id, t, x, y, buffer, lost, forest) of a few years, where any holds: the frame's buffer, what it lost, and the base scene's forest with what was lost."""
    scenes, own, setup, plan, intervals, order = _frame_parts(masks, years, px_area_ha, seed, jitter_px, options)
    asked = plan.select("site_id", "t", "mode")
    past = frame.of_sites(change.interpolate_mask(masks, intervals, years), own).join(asked.where("mode <> 'pred'").select("site_id", "t"), ["site_id", "t"], "left_semi").select("site_id", "t", "x", "y")
    future = projection.projected_mask(order, trend.area_schedule(setup, years), px_area_ha).join(asked.where("mode = 'pred'").select("site_id", "t"), ["site_id", "t"], "left_semi")
    current = written(past.union(future), "current")
    lost = None
    for base in [r[0] for r in own.select("base").distinct().collect()]:  # the kinds of bases that are asked for
        sites = own.where(F.col("base") == base)
        part = change.lost_vs_base(current, frame.of_sites(masks, sites).drop("raster_id"), years, base, starts=setup)
        lost = part if lost is None else lost.union(part)
    flag = lambda df, *names: df.select("site_id", "t", "x", "y", *((F.lit(n in names)).alias(n) for n in ("buffer", "lost", "forest")))
    forest = frame.of_sites(masks.where("forest").select("site_id", "scene_id", "x", "y"), own).drop("raster_id").join(plan.select("site_id", "t", "scene_id"), ["site_id", "scene_id"])
    rows = flag(current, "buffer").union(flag(forest, "forest"))
    rows = rows if lost is None else rows.union(flag(lost, "lost", "forest"))
    return rows.groupBy("site_id", "t", "x", "y").agg(*(F.max(n).alias(n) for n in ("buffer", "lost", "forest")))
