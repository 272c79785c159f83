"""Points, discs and polygons on a raster. Vector tables are small beside pixels; joins are equi-joins on cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landfold.keys import PIXEL
from landfold.tables import joined_by_hot_key, written


def polygon_mask(vertices: DataFrame, sizes: DataFrame) -> DataFrame:
    """(site_id, kind, poly_id, x, y): pixels whose centre is inside by the even-odd rule; fewer than 3 vertices: none.

    vertices: site_id, kind, poly_id, vertex_no, x, y. Each edge is spread over the rows it crosses, crossings are
    paired in order, and pairs become spans.
    """
    ring = ["site_id", "kind", "poly_id"]
    w = Window.partitionBy(*ring)
    order = w.orderBy("vertex_no")
    full = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = (
        vertices.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n >= 3")
        .withColumns({"_px": F.coalesce(F.lag("x").over(order), F.last("x").over(full)), "_py": F.coalesce(F.lag("y").over(order), F.last("y").over(full))})
        .join(sizes, "site_id")
    )
    low, high = F.least("y", "_py"), F.greatest("y", "_py")
    # rows whose centre yc has low <= yc < high
    first, last = F.greatest(F.ceil(low - 0.5), F.lit(0)), F.least(F.ceil(high - 0.5) - 1, F.col("height") - 1)
    rows = edges.withColumns({"_a": first, "_b": last}).where("_a <= _b").withColumn("row", F.explode(F.expr("sequence(_a, _b)")))
    cross = F.col("x") + (F.col("row") + 0.5 - F.col("y")) / (F.col("_py") - F.col("y")) * (F.col("_px") - F.col("x"))
    line = Window.partitionBy(*ring, "row").orderBy("at")
    pairs = rows.withColumn("at", cross).withColumns({"_k": F.row_number().over(line), "_to": F.lead("at").over(line)}).where("_k % 2 = 1 and _to is not null")
    spans = pairs.withColumns({"_a": F.greatest(F.ceil(F.col("at") - 0.5), F.lit(0)), "_b": F.least(F.floor(F.col("_to") - 0.5), F.col("width") - 1)}).where("_a <= _b")
    return spans.select(*ring, F.explode(F.expr("sequence(_a, _b)")).alias("x"), F.col("row").alias("y")).distinct()


def polygon_union_mask(vertices: DataFrame, sizes: DataFrame, kind: str) -> DataFrame:
    """(site_id, x, y) of all polygons of a kind."""
    return polygon_mask(vertices.where(F.col("kind") == kind), sizes).select("site_id", "x", "y").distinct()


def disc_pixels(points: DataFrame, r: Column | float, sizes: DataFrame) -> DataFrame:
    """points with every pixel px, py of the raster within r of the point (x, y)."""
    r = r if isinstance(r, Column) else F.lit(float(r))
    p = points.withColumn("_r", r).join(sizes, "site_id")
    span = lambda c, n: F.sequence(F.greatest(F.floor(F.col(c) - F.col("_r")), F.lit(0)), F.least(F.ceil(F.col(c) + F.col("_r")), F.col(n) - 1))
    some = F.expr("x + _r >= 0 and y + _r >= 0 and x - _r <= width - 1 and y - _r <= height - 1")
    p = p.where(some).withColumn("px", F.explode(span("x", "width"))).withColumn("py", F.explode(span("y", "height")))
    return p.where("(px - x) * (px - x) + (py - y) * (py - y) <= _r * _r").drop("_r", "width", "height")


def for_scenes(rows: DataFrame, scenes: DataFrame) -> DataFrame:
    """Rows of a scene, and shared ones (null scene_id) for every scene of their site."""
    shared = rows.where("scene_id is null").drop("scene_id").join(scenes.select("site_id", "scene_id"), "site_id")
    return rows.where("scene_id is not null").unionByName(shared)


def settlement_mask(polygons: DataFrame, houses: DataFrame, px: DataFrame, sizes: DataFrame, radius_px: float, auto_px: int = 0) -> DataFrame:
    """(site_id, scene_id, x, y): settlement polygons, discs around houses, and built land grown by auto_px.

    px: site_id, scene_id, x, y, built, land. Shared polygons and houses apply to every scene.
    """
    from landfold.operators.focal import dilate

    scenes = px.select("site_id", "scene_id").distinct()
    drawn = polygon_union_mask(polygons, sizes, "settlement").join(scenes, "site_id")
    discs = disc_pixels(for_scenes(houses.select("site_id", "scene_id", "x", "y"), scenes), radius_px, sizes)
    found = drawn.select(*PIXEL).union(discs.select("site_id", "scene_id", F.col("px").alias("x"), F.col("py").alias("y")))
    if auto_px > 0:
        found = found.union(dilate(px, "built", auto_px, "_near").where("_near and land").select(*PIXEL))
    return found.distinct()


def dedupe_vertices(points: DataFrame, least: float = 3) -> DataFrame:
    """Vertices farther than ``least`` pixels from their predecessor in the list as drawn; the first stays."""
    w = Window.partitionBy("site_id", "kind", "poly_id").orderBy("vertex_no")
    p = points.withColumns({"_x": F.lag("x").over(w), "_y": F.lag("y").over(w)})
    return p.where(F.col("_x").isNull() | (F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) > least)).drop("_x", "_y")


def georeference_points(points: DataFrame, zoom: int, origin_x: float, origin_y: float, dx_m: float = 0, dy_m: float = 0, m_per_px: float = 1) -> DataFrame:
    """points(lat, lon) with pixel positions x, y in Web Mercator at a zoom; rows without a finite position go."""
    n = 2.0**zoom * 256
    la = F.radians("lat")
    x = (F.col("lon") + 180) / 360 * n - origin_x + dx_m / m_per_px
    y = (1 - F.log(F.tan(la) + 1 / F.cos(la)) / math.pi) / 2 * n - origin_y + dy_m / m_per_px
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return points.withColumns({"x": x, "y": y}).where(finite("x") & finite("y"))


def class_at_points(points: DataFrame, labels: DataFrame) -> DataFrame:
    """points(site_id, x, y) for every scene with the label of the pixel at the rounded position, or 'outside'."""
    at = points.withColumns({"_x": F.floor(F.col("x") + 0.5), "_y": F.floor(F.col("y") + 0.5)})
    scenes = labels.select("site_id", "scene_id").distinct()
    where = labels.select("site_id", "scene_id", F.col("x").alias("_x"), F.col("y").alias("_y"), "label")
    return at.join(scenes, "site_id").join(where, ["site_id", "scene_id", "_x", "_y"], "left").withColumn("label", F.coalesce("label", F.lit("outside"))).drop("_x", "_y")


#: Places that a cell of the point tree may hold before it is cut in four, and how often a cell may be cut.
LEAF, DEPTH = 64, 40


def point_tree(points: DataFrame, side: float, leaf: int = LEAF) -> list[DataFrame]:
    """Levels of (_cell, _box, _pts): cells of ``side``, those of over ``leaf`` places cut in four until none is left.

    points(site_id, point_id, x, y); equal places are one, with the smallest point_id, and points without a finite
    place are left out. ``_box`` bounds a cell's places; ``_pts`` are the places of a cell that is not cut, else null.
    A cell is cut at most DEPTH times. Each level writes the places that are still to be cut, and nothing else.
    """
    finite = F.greatest(F.abs("x"), F.abs("y")) < float("inf")
    left = points.where(finite & ~F.isnan("x") & ~F.isnan("y") & F.col("site_id").isNotNull()).groupBy("site_id", "x", "y").agg(F.min("point_id").alias("point_id"))
    left, levels = written(left, "places"), []
    for level in range(DEPTH + 1):
        here = left.withColumn("_cell", cell_at(F.col("x"), F.col("y"), side, level))
        box = F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        nodes = written(here.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), box.alias("_box")), "cells")
        cut = (F.col("n") > leaf) & F.lit(level < DEPTH)
        kept = joined_by_hot_key(here, nodes.where(~cut).select("_cell"), "_cell", F.struct("x", "y"), nodes)
        leaves = kept.groupBy("_cell").agg(F.collect_list(F.struct("x", "y", "point_id")).alias("_pts"))
        levels.append(written(nodes.join(leaves, "_cell", "left").select("_cell", "_box", "_pts"), "tree"))
        if not nodes.where(cut).take(1):
            break
        left = written(joined_by_hot_key(here, nodes.where(cut).select("_cell"), "_cell", F.struct("x", "y"), nodes).select(*left.columns), "places")
    return levels


def cell_at(x: Column, y: Column, side: float, level: int) -> Column:
    """The cell of a place: halves of a level's cells are cells of the next."""
    at = lambda c: F.floor(c / side * 2.0**level)
    return F.struct(F.col("site_id").alias("site_id"), at(x).alias("i"), at(y).alias("j"))


def nearest_within(queries: DataFrame, points: DataFrame, max_d: float, leaf: int = LEAF) -> DataFrame:
    """queries(query_id, site_id, x, y) with the nearest point(point_id, site_id, x, y) strictly below max_d, if any.

    The smallest point_id wins ties. Points stand in a tree of cells (``point_tree``). A query looks into its own cell
    of max_d and the eight around; of the cells that it meets on a level those go whose box is farther than the
    nearest place it is sure of, and the others that are cut are followed into their quarters. So a query compares
    itself with the few leaves around its nearest place, however many points share a cell; every join has one row a
    cell on the points' side, and cells with many queries are dealt over many tasks.
    """
    levels = point_tree(points, float(max_d), leaf)
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    now = queries.where("x is not null and y is not null and site_id is not null").select("query_id", F.col("x").alias("_x"), F.col("y").alias("_y"), cell_at(F.col("x"), F.col("y"), float(max_d), 0).alias("_at"), F.lit(float(max_d)).alias("_sure"))
    now = now.withColumn("_di", step).withColumn("_dj", step)
    now = now.select("query_id", "_x", "_y", "_sure", F.struct(F.col("_at.site_id").alias("site_id"), (F.col("_at.i") + F.col("_di")).alias("i"), (F.col("_at.j") + F.col("_dj")).alias("j")).alias("_cell"))
    hits = []
    for k, nodes in enumerate(levels):
        met = joined_by_hot_key(now, nodes, "_cell", F.col("query_id"), now.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")))
        beyond = lambda c, a, b: F.greatest(F.col(a) - F.col(c), F.lit(0.0), F.col(c) - F.col(b))
        across = lambda c, a, b: F.greatest(F.abs(F.col(a) - F.col(c)), F.abs(F.col(b) - F.col(c)))
        far = lambda f: F.hypot(f("_x", "_box.x0", "_box.x1"), f("_y", "_box.y0", "_box.y1"))
        best = F.array_min(F.transform("_pts", lambda p: F.struct(F.hypot(F.col("_x") - p.x, F.col("_y") - p.y).alias("d"), p.point_id.alias("point_id"))))
        met = met.withColumns({"_low": far(beyond), "_hit": best}).withColumn("_high", F.coalesce(F.col("_hit.d"), far(across)))
        met = met.where(F.col("_low") < float(max_d)).withColumn("_sure", F.least("_sure", F.min("_high").over(Window.partitionBy("query_id")))).where("_low <= _sure")
        met = written(met.select("query_id", "_x", "_y", "_sure", "_cell", "_hit"), "met") if k + 1 < len(levels) else met
        hits.append(met.where(F.col("_hit.d") < float(max_d)).select("query_id", "_hit"))
        quarter = F.explode(F.sequence(F.lit(0), F.lit(1)))
        now = met.where("_hit is null").withColumn("_di", quarter).withColumn("_dj", quarter)
        now = now.select("query_id", "_x", "_y", "_sure", F.struct(F.col("_cell.site_id").alias("site_id"), (F.col("_cell.i") * 2 + F.col("_di")).alias("i"), (F.col("_cell.j") * 2 + F.col("_dj")).alias("j")).alias("_cell"))
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    best = found.groupBy("query_id").agg(F.min("_hit").alias("_m"))
    return queries.join(best, "query_id", "left").select(*queries.columns, F.col("_m.point_id").alias("point_id"), F.col("_m.d").alias("d"))


def apply_corrections(px: DataFrame, corrections: DataFrame, col: str = "buffer") -> DataFrame:
    """px with the mask forced on (land only) or off where drawn; of several strokes on a pixel the last counts."""
    last = corrections.groupBy(*PIXEL).agg(F.max_by("v", "stroke_no").alias("_v"))
    px = px.join(last, PIXEL, "left")
    return px.withColumn(col, F.when((F.col("_v") > 0) & F.col("land"), True).when(F.col("_v") < 0, False).otherwise(F.col(col))).drop("_v")
