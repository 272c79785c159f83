"""Connected regions of a mask: labels inside a tile by numpy, tiles joined along their seams by a graph contraction."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from landfold.keys import K, PIXEL
from landfold.tables import components, written

TILE = 256


def label_rows(x: np.ndarray, y: np.ndarray, conn: int) -> np.ndarray:
    """A label for each pixel, equal inside a region: horizontal runs united with the runs they touch in the row above."""
    order = np.lexsort((x, y))
    xs, ys = x[order], y[order]
    first = np.ones(len(xs), bool)
    first[1:] = (ys[1:] != ys[:-1]) | (xs[1:] != xs[:-1] + 1)
    run = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    lo, row = xs[starts], ys[starts]
    hi = xs[np.append(starts[1:], len(xs)) - 1]
    parent = list(range(len(starts)))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    reach = 1 if conn == 8 else 0
    by_row = {r: (a, b) for r, a, b in zip(*np.unique(row, return_index=True), np.append(np.unique(row, return_index=True)[1][1:], len(row)))}
    for r, (a, b) in by_row.items():
        if r - 1 not in by_row:
            continue
        p, q = by_row[r - 1]
        for k in range(a, b):
            while p < q and hi[p] < lo[k] - reach:
                p += 1
            m = p
            while m < q and lo[m] <= hi[k] + reach:
                parent[root(k)] = root(m)
                m += 1
    roots = np.array([root(k) for k in range(len(parent))], dtype=np.int64)
    out = np.empty(len(x), np.int64)
    out[order] = roots[run]
    return out


def label_in_tile(xs: np.ndarray, ys: np.ndarray, on: np.ndarray, tx: int, ty: int, conn: int) -> np.ndarray:
    """Of one tile's pixels the first in raster order of the pixel's region inside the tile; off the mask a negative number of the tile."""
    x, y = xs[on], ys[on]
    local = np.full(len(on), -1 - (ty * 2**31 + tx), np.int64)
    if len(x):
        label = label_rows(x, y, conn)
        first = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, label, y * 2**31 + x)
        local[on] = first[label]
    return local


def label_pixels(px: DataFrame, masks: dict[str, str | Column], conn: int = 8, tile: int = TILE) -> DataFrame:
    """px, all columns kept, with one column for each mask: the first pixel in raster order of the pixel's region inside its tile.

    One exchange for all masks, keyed by tile. Off the mask the value is negative and differs by tile, so that no value
    of (site, scene, value) holds more rows than a tile.
    """
    here = {f"_on{k}": F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(False)) for k, c in enumerate(masks.values())}
    pairs = list(zip(masks, here))
    tiles = px.withColumns({**here, "_tx": F.expr(f"cast(x div {tile} as int)"), "_ty": F.expr(f"cast(y div {tile} as int)")})

    def run(t: pa.Table) -> pa.Table:
        xs, ys = (t.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        place = (t.column("_tx")[0].as_py(), t.column("_ty")[0].as_py())
        out = t.drop_columns([*(mask for _, mask in pairs), "_tx", "_ty"])
        for name, mask in pairs:
            out = out.append_column(name, pa.array(label_in_tile(xs, ys, t.column(mask).to_numpy(), *place, conn)))
        return out

    schema = StructType([StructField(f.name, f.dataType) for f in px.schema.fields] + [StructField(name, LongType()) for name in masks])
    return tiles.groupBy(*K, "_tx", "_ty").applyInArrow(run, schema)


def _roots(labelled: DataFrame, marks: list[str], conn: int, tile: int) -> DataFrame:
    """(site_id, scene_id, _m, _local, root) of the pieces that touch a piece of another tile; _m: the place of the mask in marks."""
    node = F.struct(*K, "_m", F.col("_local").alias("at"))
    steps = [(1, 0), (0, 1)] + ([(1, 1), (-1, 1)] if conn == 8 else [])
    rim = labelled.where(f"x % {tile} in (0, {tile - 1}) or y % {tile} in (0, {tile - 1})")
    seam = reduce(DataFrame.union, (rim.where(f"{c} >= 0").select(*PIXEL, F.lit(k).alias("_m"), F.col(c).alias("_local")) for k, c in enumerate(marks)))
    near = F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps)))
    # only a step into another tile can join two pieces
    ours = seam.select(*K, "_m", near.alias("n"), node.alias("a"), "x", "y").where(f"n.x div {tile} <> x div {tile} or n.y div {tile} <> y div {tile}")
    edges = ours.select(*K, "_m", F.col("n.x").alias("x"), F.col("n.y").alias("y"), "a").join(seam.select(*PIXEL, "_m", node.alias("b")), [*PIXEL, "_m"]).select("a", "b")
    return components(edges).select(*(F.col(f"node.{k}").alias(k) for k in (*K, "_m")), F.col("node.at").alias("_local"), F.col("component.at").alias("root"))


def connected_components(px: DataFrame, col: str | Column, conn: int = 8, tile: int = TILE) -> DataFrame:
    """(site_id, scene_id, x, y, region) for the true pixels; region is a hash-free id: the raster-order smallest pixel.

    ``region`` is ``y * 2**31 + x`` of a region's first pixel in raster order, so that dense ranks of it number
    regions in scan order. Only pixels on the seams between tiles become edges of the graph.
    """
    on = px.where(col if isinstance(col, Column) else F.col(col)).select(*PIXEL)
    labelled = written(label_pixels(on, {"_local": F.lit(True)}, conn, tile), "regions")
    labels = labelled.join(_roots(labelled, ["_local"], conn, tile).drop("_m"), [*K, "_local"], "left")
    return labels.select(*PIXEL, F.coalesce("root", "_local").alias("region"))


def region_labels(px: DataFrame, col: str | Column, conn: int = 8, tile: int = TILE) -> DataFrame:
    """(site_id, scene_id, x, y, label, size) for the true pixels: regions are numbered 1.. in scan order of their first pixels.

    Numbers and sizes are made of the pieces of regions inside tiles: a region is one row there, numbered inside the row of pixels
    that it starts in, after the count of regions that start in rows before. Pixels meet their piece, whose rows a tile bounds.
    """
    on = px.where(col if isinstance(col, Column) else F.col(col)).select(*PIXEL)
    labelled = written(label_pixels(on, {"_local": F.lit(True)}, conn, tile), "regions")
    pieces = labelled.groupBy(*K, "_local").agg(F.count(F.lit(1)).alias("_n")).join(_roots(labelled, ["_local"], conn, tile).drop("_m"), [*K, "_local"], "left")
    pieces = written(pieces.withColumn("root", F.coalesce("root", "_local")), "pieces")
    whole = pieces.groupBy(*K, "root").agg(F.sum("_n").alias("size")).withColumn("_y", F.expr(f"root div {2**31}"))
    rows = whole.groupBy(*K, "_y").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*K).orderBy("_y").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select(*K, "_y", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*K, "_y").orderBy("root"))
    numbered = whole.withColumn("_in", inside).join(rows, [*K, "_y"]).select(*K, "root", (F.col("_before") + F.col("_in")).alias("label"), "size")
    own = pieces.select(*K, "_local", "root").join(numbered, [*K, "root"]).drop("root")
    return labelled.join(own, [*K, "_local"]).select(*PIXEL, "label", "size")


def region_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*K, "region").agg(F.count(F.lit(1)).alias("size"))


def keep_regions(px: DataFrame, rules: dict[str, tuple[str | Column, list[tuple[Column, float | Column]]]], conn: int = 8, tile: int = TILE, labelled_in: dict[str, str] | None = None) -> DataFrame:
    """px with one boolean column for each rule, a mask and tests (weight, least) of its regions.

    The column holds the pixels of those regions of the mask in which every sum of weights is at least its ``least`` (a
    column: equal in a scene). All masks go together: pixels are exchanged once, by tile, and written; weights are summed
    for each piece of a region inside a tile, and only pieces meet other pieces. So px may be read any number of times after.
    labelled_in: columns, one a rule, that label px already as ``label_in_tile`` does, with these tiles; then nothing is exchanged.
    """
    marks = [labelled_in[out] if labelled_in else f"_at{k}" for k, out in enumerate(rules)]
    numbers = {}
    for k, (_, tests) in enumerate(rules.values()):
        for j, (weight, least) in enumerate(tests):
            numbers[f"_w{k}_{j}"] = weight.cast("double")
            if isinstance(least, Column):
                numbers[f"_l{k}_{j}"] = least.cast("double")
    px = px.withColumns(numbers)
    labelled = written(px if labelled_in else label_pixels(px, dict(zip(marks, (mask for mask, _ in rules.values()))), conn, tile), "regions")
    most = max(len(tests) for _, tests in rules.values())

    def pieces(k: int, tests: list) -> DataFrame:
        least = [F.max(f"_l{k}_{j}") if isinstance(v, Column) else F.lit(float(v)) for j, (_, v) in enumerate(tests)]
        sums = [F.coalesce(F.sum(f"_w{k}_{j}"), F.lit(0.0)) for j in range(len(tests))]
        none = [F.lit(0.0)] * (most - len(tests))  # 0 of 0 always holds
        named = [c.alias(f"{n}{j}") for n, cs in (("_sum", sums + none), ("_least", least + none)) for j, c in enumerate(cs)]
        return labelled.where(f"{marks[k]} >= 0").groupBy(*K, F.col(marks[k]).alias("_local")).agg(*named).withColumn("_m", F.lit(k))

    found = reduce(DataFrame.unionByName, (pieces(k, tests) for k, (_, tests) in enumerate(rules.values())))
    found = found.join(_roots(labelled, marks, conn, tile), [*K, "_m", "_local"], "left").withColumn("root", F.coalesce("root", "_local"))
    whole = found.groupBy(*K, "_m", "root").agg(*(F.sum(f"_sum{j}").alias(f"_sum{j}") for j in range(most)), *(F.max(f"_least{j}").alias(f"_least{j}") for j in range(most)))
    whole = whole.where(" and ".join(f"_sum{j} >= _least{j}" for j in range(most))).select(*K, "_m", "root")
    kept = written(found.join(whole, [*K, "_m", "root"], "left_semi").select(*K, "_m", "_local"), "kept")
    px = labelled
    for k, out in enumerate(rules):
        mine = kept.where(f"_m = {k}").select(*K, F.col("_local").alias(marks[k]), F.lit(True).alias("_whole"))
        px = px.join(mine, [*K, marks[k]], "left").withColumn(out, F.coalesce("_whole", F.lit(False))).drop("_whole")
    return px.drop(*marks, *numbers)


def remove_small_regions(px: DataFrame, col: str, min_size: float | Column, conn: int = 8, out: str = "mask", tile: int = TILE) -> DataFrame:
    """px with the mask less its regions of fewer than min_size pixels (a column: of each scene); min_size <= 1 copies."""
    if not isinstance(min_size, Column) and min_size <= 1:
        return px.withColumn(out, F.col(col))
    return keep_regions(px, {out: (col, [(F.lit(1), min_size)])}, conn, tile)


def keep_border_regions(px: DataFrame, col: str, sizes: DataFrame, conn: int = 4, margin: int = 0, out: str = "mask", tile: int = TILE) -> DataFrame:
    """px with the regions that have a pixel within margin of the raster's edge. sizes: site_id, width, height."""
    edge = F.expr(f"x <= {margin} or y <= {margin} or x >= _width - 1 - {margin} or y >= _height - 1 - {margin}")
    px = px.join(sizes.select("site_id", F.col("width").alias("_width"), F.col("height").alias("_height")), "site_id", "left")
    return keep_regions(px, {out: (col, [(edge.cast("int"), 1)])}, conn, tile).drop("_width", "_height")


def keep_touching_regions(px: DataFrame, col: str, seed: str, conn: int = 8, out: str = "mask", tile: int = TILE) -> DataFrame:
    """px with the regions that hold a pixel where the boolean column ``seed`` is true."""
    return keep_regions(px, {out: (col, [(F.col(seed).cast("int"), 1)])}, conn, tile)
