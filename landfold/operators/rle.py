"""Run-length coding of a value raster in raster order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landfold.keys import K
from landfold.tables import written


#: Longest run of the code; longer ones are several.
LONGEST = 1_000_000_000


def rle_runs(px: DataFrame, col: str, band: int = 16, longest: int = LONGEST) -> DataFrame:
    """(site_id, scene_id, start, v, n): one row a run of equal values of a dense raster in raster order; start counts the pixels before.

    Runs are made inside a row, merged inside a band of rows, and then only each band's first and last run meet those of
    the bands beside it: no task holds a scene, and the band's height does not change a result. Nulls make runs of their own.
    """
    row = Window.partitionBy(*K, "y").orderBy("x")
    px = px.select(*K, "x", "y", F.col(col).cast("long").alias("v"))
    new = lambda w: (F.lag(F.lit(1)).over(w).isNull() | ~F.lag("v").over(w).eqNullSafe(F.col("v"))).cast("int")
    short = px.withColumn("_new", new(row)).withColumn("_run", F.sum("_new").over(row)).groupBy(*K, "y", "_run").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(*K, "_band").orderBy("y", "_run")
    inside = short.withColumn("_band", F.expr(f"y div {band}")).withColumn("_new", new(own)).withColumn("_g", F.sum("_new").over(own))
    runs = inside.groupBy(*K, "_band", "_g").agg(F.first("v").alias("v"), F.sum("n").alias("n"))
    whole = Window.partitionBy(*K, "_band")
    runs = runs.withColumns({"_last": F.max("_g").over(whole), "_before": F.sum("n").over(whole.orderBy("_g")) - F.col("n"), "_size": F.sum("n").over(whole)})
    runs = written(runs, "runs")  # read for the bands' edges and for what is inside them
    scene = Window.partitionBy(*K).orderBy("_band", "_g")  # two rows a band
    rim = runs.where("_g = 1 or _g = _last").withColumn("_of", F.sum(F.when(F.col("_g") == 1, F.col("_size")).otherwise(0)).over(scene) - F.col("_size"))
    joins = (F.col("_g") == 1) & (F.lag("_g").over(scene).isNotNull()) & F.lag("v").over(scene).eqNullSafe(F.col("v"))
    rim = rim.withColumn("_k", F.sum((~joins).cast("int")).over(scene)).withColumn("start", F.col("_of") + F.col("_before"))
    ends = rim.groupBy(*K, "_k").agg(F.min("start").alias("start"), F.first("v").alias("v"), F.sum("n").alias("n")).drop("_k")
    places = rim.where("_g = 1").select(*K, "_band", "_of")
    middle = runs.where("_g > 1 and _g < _last").join(places, [*K, "_band"]).select(*K, (F.col("_of") + F.col("_before")).alias("start"), "v", "n")
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {longest}"))).alias("_part")
    return ends.unionByName(middle).select("*", cut).select(*K, (F.col("start") + F.col("_part") * longest).alias("start"), "v", F.least(F.lit(longest).cast("long"), F.col("n") - F.col("_part") * longest).alias("n"))


def rle_encode(px: DataFrame, col: str, band: int = 16) -> DataFrame:
    """(site_id, scene_id, runs array<bigint>): value, length, value, length ... of a dense raster; no row for none.

    The array is what settings store; only here the runs of a scene meet. ``rle_runs`` are the same as rows.
    """
    pairs = F.array_sort(F.collect_list(F.struct("start", "v", "n")))
    return rle_runs(px, col, band).groupBy(*K).agg(F.flatten(F.transform(pairs, lambda p: F.array(p["v"], p["n"]))).alias("runs"))


def rle_decode(runs: DataFrame, sizes: DataFrame, out: str = "v") -> DataFrame:
    """(site_id, scene_id, x, y, v): 0 where no run says otherwise; what goes beyond the raster is cut off."""
    r = runs.join(sizes, "site_id").withColumn("_k", F.explode(F.expr("sequence(0, size(runs) div 2 - 1)")))
    r = r.select(*K, "width", "height", "_k", F.expr("runs[2 * _k]").alias("v"), F.expr("runs[2 * _k + 1]").alias("n"))
    before = Window.partitionBy(*K).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_from", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("_to", F.least(F.col("_from") + F.col("n"), F.col("width") * F.col("height")) - 1)
    on = r.where("v <> 0 and _to >= _from").withColumn("_i", F.explode(F.expr("sequence(_from, _to)")))
    on = on.select(*K, F.expr("_i % width").alias("x"), F.expr("_i div width").alias("y"), F.col("v").alias(out))
    every = runs.select(*K).join(sizes, "site_id").withColumn("y", F.explode(F.expr("sequence(0L, cast(height - 1 as bigint))"))).withColumn("x", F.explode(F.expr("sequence(0L, cast(width - 1 as bigint))")))
    return every.select(*K, "x", "y").join(on, [*K, "x", "y"], "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))
