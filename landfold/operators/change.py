"""Change between the masks of a site's scenes, and masks of any year by ranked reversal of pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landfold.keys import PIXEL
from landfold.operators.bands import half_up
from landfold.operators.distance import with_distances
from landfold.tables import written

#: Fixed values of the counter-based generator (mulberry32).
STEP, MASK32 = 0x6D2B79F5, 0xFFFFFFFF


def _times32(a: Column, b: Column) -> Column:
    """Low 32 bits of a product of two 32-bit numbers, in halves so that 64 bits never overflow."""
    low = a * b.bitwiseAND(F.lit(0xFFFF))
    high = (a * F.shiftrightunsigned(b, 16)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(MASK32))


def jitter(seed: Column, n: Column) -> Column:
    """Draw n (0-based) of the generator with this seed, in [0, 1)."""
    a = (seed.cast("long") + (n.cast("long") + 1) * F.lit(STEP)).bitwiseAND(F.lit(MASK32))
    t = _times32(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    u = _times32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))
    t = ((t + u).bitwiseAND(F.lit(MASK32))).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def numbered_scenes(masks: DataFrame) -> DataFrame:
    """(site_id, scene_id, year, k): scenes by year."""
    scenes = masks.select("site_id", "scene_id", "year").distinct()
    return scenes.withColumn("k", F.row_number().over(Window.partitionBy("site_id").orderBy("year", "scene_id")) - 1)


def _scene_steps(px: DataFrame, col: str) -> DataFrame:
    """px(site_id, k, year, x, y) with y1, the year of the site's next scene, and kind: lost or gained until then, else null."""
    w = Window.partitionBy("site_id", "x", "y").orderBy("k")
    px = px.withColumns({"_next": F.lead(col).over(w), "y1": F.lead("year").over(w)})
    kind = F.when(F.col(col) & ~F.col("_next"), "lost").when(~F.col(col) & F.col("_next"), "gained")
    return px.withColumn("kind", kind).drop("_next")


def mask_transitions(masks: DataFrame, col: str = "buffer") -> DataFrame:
    """(site_id, scene_id, k, y0, y1, x, y, kind): pixels lost and gained between consecutive scenes of dense masks."""
    px = _scene_steps(masks.join(numbered_scenes(masks).drop("year"), ["site_id", "scene_id"]), col)
    return px.where("kind is not null").select("site_id", "scene_id", "k", F.col("year").alias("y0"), "y1", "x", "y", "kind")


def union_past(masks: DataFrame, years: DataFrame, col: str = "buffer") -> DataFrame:
    """(site_id, t, x, y): pixels that held in any scene strictly before t."""
    on = masks.where(col).groupBy("site_id", "x", "y").agg(F.min("year").alias("since"))
    return on.join(F.broadcast(years), F.expr("since < t - 1e-9")).select("site_id", "t", "x", "y")  # years: a request, not data


def compare_scene(masks: DataFrame, years: DataFrame, base: str = "prev", starts: DataFrame | None = None) -> DataFrame:
    """(site_id, t, scene_id, compare_year): the scene that t is compared with, if it has one.

    prev: the scene before an observed year, the interval's left scene between years, the site's start scene when
    predicting (starts: site_id, start_year; else its last scene); first: the earliest; else the scene of that id. It must be earlier than t.
    """
    scenes = numbered_scenes(masks)
    at = scenes.join(F.broadcast(years), F.expr("year < t - 1e-9"))
    if base == "prev":
        # an observed year within 1e-6 is compared with the scene before it, a predicted one with its start
        observed = "abs(year - t) >= 1e-6"
        if starts is not None:
            at = at.join(starts.select("site_id", "start_year"), "site_id").where("t <= start_year + 1e-9 or year <= start_year")
            observed += " or t > start_year + 1e-9"
        at = at.where(observed)
        pick = F.max_by(F.struct("scene_id", "year"), "k")
    elif base == "first":
        pick = F.min_by(F.struct("scene_id", "year"), "k")
    else:
        at = at.where(F.col("scene_id") == base)
        pick = F.min_by(F.struct("scene_id", "year"), "k")
    found = at.groupBy("site_id", "t").agg(pick.alias("s"))
    if base == "first":
        first = scenes.where("k = 0").select("site_id", F.col("year").alias("_y"))
        found = found.join(first, "site_id").where("s.year = _y").drop("_y")
    return found.select("site_id", "t", F.col("s.scene_id").alias("scene_id"), F.col("s.year").alias("compare_year"))


def lost_vs_base(current: DataFrame, masks: DataFrame, years: DataFrame, base: str = "all", col: str = "buffer", starts: DataFrame | None = None) -> DataFrame:
    """(site_id, t, x, y, compare_year): pixels of the base that are not in the current mask (site_id, t, x, y).

    base 'all': pixels of any scene before t, compare_year is the earliest scene's.
    """
    if base == "all":
        first = masks.groupBy("site_id").agg(F.min("year").alias("compare_year"))
        then = union_past(masks, years, col).join(first, "site_id")
    else:
        chosen = compare_scene(masks, years, base, starts)
        then = masks.where(col).select("site_id", "scene_id", "x", "y").join(chosen, ["site_id", "scene_id"]).select("site_id", "t", "x", "y", "compare_year")
    return then.join(current.select("site_id", "t", "x", "y"), ["site_id", "t", "x", "y"], "left_anti")


def raster_number(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """df with its 0-based number in raster order inside the keys: numbers inside a row plus counts of the rows before."""
    rows = df.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(*keys, "y", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "y").orderBy("x")) - 1
    return df.withColumn("_in", inside).join(rows, [*keys, "y"]).withColumn(out, F.col("_before") + F.col("_in")).drop("_before", "_in")


def priority_order(df: DataFrame, priority: str, keys: list[str], out: str = "rank", quant: float = 0.25, cuts: DataFrame | None = None) -> DataFrame:
    """df(x, y, float priority) with its 0-based rank inside the keys: by bucket of the priority, ties in raster order.

    A bucket's rows are numbered by themselves and rank after the counts of the buckets before, so that no window
    holds a whole site. cuts (keys, cut): the only numbers that ranks will be compared with. Then the histogram of
    buckets tells the one that each cut falls in; only those are numbered, and any other pixel gets its bucket's first rank,
    which stands on the same side of every cut as its own.
    """
    top = df.groupBy(*keys).agg(F.greatest(F.max(F.col(priority).cast("double")), F.lit(0.0)).alias("_max"))
    df = df.join(top, keys)
    nb = F.least(F.lit(1 << 20), F.floor(F.col("_max") / quant) + 2)
    df = df.withColumn("_b", F.least(nb - 1, F.floor(F.col(priority).cast("double") * ((nb - 1) / F.greatest("_max", F.lit(1e-9))))))
    sizes = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), "_c")
    if cuts is None:
        df = raster_number(df, [*keys, "_b"], "_n").join(sizes.drop("_c"), [*keys, "_b"])
        return df.withColumn(out, F.col("_before") + F.col("_n")).drop("_max", "_b", "_n", "_before")
    hit = sizes.join(cuts.select(*keys, "cut").distinct(), keys).where("cut > _before and cut < _before + _c").select(*keys, "_b").distinct()
    sizes = written(sizes.select(*keys, "_b", F.col("_before").alias("_start")).join(hit.withColumn("_hit", F.lit(True)), [*keys, "_b"], "left"), "buckets")
    df = df.join(sizes, [*keys, "_b"]).drop("_max")
    plain = df.where("_hit is null").withColumn(out, F.col("_start"))
    cut = raster_number(df.where("_hit"), [*keys, "_b"], "_place").withColumn(out, F.col("_start") + F.col("_place")).drop("_place")
    return plain.unionByName(cut).drop("_b", "_start", "_hit")


def build_intervals(masks: DataFrame, seed: int = 1, jitter_px: float = 0, shares: DataFrame | None = None) -> DataFrame:
    """transitions with ``rank`` inside (site_id, k, kind): lost by distance to the earlier forest, gained to the earlier mask.

    masks: dense, with buffer and forest. Jitter draws count lost pixels first, then gained ones, in raster order.
    shares (site_id, k, f): the only parts of the intervals that are asked for; then only the buckets they cut are ranked.
    """
    scenes = written(numbered_scenes(masks).drop("year"), "scenes")
    px = masks.select(*PIXEL, "year", "buffer", "forest").join(scenes, ["site_id", "scene_id"])
    # pixels are dealt out once by column: the steps between scenes and the distances' way along columns both go there
    px = _scene_steps(px.repartition("site_id", "x"), "buffer")
    far = with_distances(px, {"_f": "forest", "_b": "buffer"}).where("kind is not null").withColumn("_p", (F.when(F.col("kind") == "lost", F.col("_f")).otherwise(F.col("_b")) / 3).cast("float"))
    far = far.select("site_id", "scene_id", "k", F.col("year").alias("y0"), "y1", "x", "y", "kind", "_p")
    moved = written(far, "moved")  # only changed pixels; numbers and ranks read them several times
    if jitter_px > 0:
        jittered = raster_number(moved, ["site_id", "k", "kind"], "_n")
        lost = moved.where("kind = 'lost'").groupBy("site_id", "k").agg(F.count(F.lit(1)).alias("_lost"))
        jittered = jittered.join(lost, ["site_id", "k"], "left").withColumn("_j", F.col("_n") + F.when(F.col("kind") == "gained", F.coalesce("_lost", F.lit(0))).otherwise(0))
        moved = written(jittered.withColumn("_p", (F.col("_p") + jitter(F.lit(seed) + F.col("k") * 7919, F.col("_j")) * jitter_px).cast("float")).drop("_n", "_lost", "_j"), "moved")
    cuts = None
    if shares is not None:
        cuts = moved.groupBy("site_id", "k", "kind").agg(F.count(F.lit(1)).alias("_c")).join(shares, ["site_id", "k"]).withColumn("cut", half_up(F.col("f") * F.col("_c")))
    return priority_order(moved, "_p", ["site_id", "k", "kind"], cuts=cuts).select("site_id", "scene_id", "k", "y0", "y1", "x", "y", "kind", "rank")


def interpolate_mask(masks: DataFrame, intervals: DataFrame, years: DataFrame, col: str = "buffer") -> DataFrame:
    """(site_id, t, x, y) of the mask in each requested year (t); before the first and after the last scene, that scene.

    Inside an interval the first round(f n) lost pixels are off and the first round(f m) gained ones on.
    """
    scenes = numbered_scenes(masks).withColumn("y1", F.lead("year").over(Window.partitionBy("site_id").orderBy("k")))
    ends = scenes.groupBy("site_id").agg(F.min("year").alias("_lo"), F.max("year").alias("_hi"))
    at = scenes.join(ends, "site_id").join(F.broadcast(years), F.expr("(k = 0 and t <= year) or (year = _hi and t >= year and t > _lo) or (t > _lo and t < _hi and t >= year and t < y1)"))
    at = at.withColumn("f", F.when(F.expr("t > _lo and t < _hi"), F.when(F.expr("y1 > year"), F.expr("(t - year) / (y1 - year)")).otherwise(1.0)).otherwise(0.0))
    at = at.groupBy("site_id", "t").agg(F.max(F.struct("k", "scene_id", "f")).alias("a")).select("site_id", "t", "a.*")
    counts = intervals.groupBy("site_id", "k", "kind").agg(F.count(F.lit(1)).alias("_n"))
    moves = intervals.join(counts, ["site_id", "k", "kind"]).join(at.select("site_id", "k", "t", "f"), ["site_id", "k"]).where(F.col("rank") < half_up(F.col("f") * F.col("_n")))
    base = masks.where(col).select("site_id", "scene_id", "x", "y").join(at, ["site_id", "scene_id"]).select("site_id", "t", "x", "y")
    off = moves.where("kind = 'lost'").select("site_id", "t", "x", "y")
    on = moves.where("kind = 'gained'").select("site_id", "t", "x", "y")
    return base.join(off, ["site_id", "t", "x", "y"], "left_anti").union(on)


def observed_area_at(series: DataFrame, years: DataFrame) -> DataFrame:
    """(site_id, t, area_ha): linear between neighbouring observations, level before the first and after the last."""
    w = Window.partitionBy("site_id").orderBy("year")
    s = series.withColumns({"_y1": F.lead("year").over(w), "_a1": F.lead("area_ha").over(w), "_first": F.row_number().over(w) == 1})
    hit = s.join(F.broadcast(years), F.expr("(_first and t <= year) or (t > year and (t <= _y1 or _y1 is null))"))
    f = (F.col("t") - F.col("year")) / F.greatest(F.col("_y1") - F.col("year"), F.lit(1e-9))
    area = F.when((F.col("t") <= F.col("year")) | F.col("_y1").isNull(), F.col("area_ha")).otherwise(F.col("area_ha") + f * (F.col("_a1") - F.col("area_ha")))
    return hit.select("site_id", "t", area.alias("area_ha"))


def area_change_rate(series: DataFrame) -> DataFrame:
    """series with ``rate``, hectares a year since the scene before; null for the first and for equal years."""
    w = Window.partitionBy("site_id").orderBy("year", "scene_id")
    gap = F.col("year") - F.lag("year").over(w)
    return series.withColumn("rate", F.when(gap != 0, (F.col("area_ha") - F.lag("area_ha").over(w)) / gap))


def buffer_share(stats: DataFrame) -> DataFrame:
    """stats with ``share_pct``, buffer by land; null without land."""
    return stats.withColumn("share_pct", F.when(F.col("land") > 0, F.col("buffer") / F.col("land") * 100))


def frame_years(series: DataFrame, horizon: DataFrame, step: int = 5) -> DataFrame:
    """(site_id, t): observed years, multiples of step after the start up to x_max, and the rounded disappearance year."""
    later = horizon.where("x_max >= ceil(start_year / {0}) * {0}".format(step)).select(
        "site_id", F.explode(F.sequence(F.ceil(F.col("start_year") / step), F.floor(F.col("x_max") / step))).alias("m"), "start_year"
    )
    later = later.select("site_id", (F.col("m") * step).cast("double").alias("t"), "start_year").where("t > start_year").drop("start_year")
    gone = horizon.where("disappear_year is not null").select("site_id", half_up("disappear_year").cast("double").alias("t"))
    return series.select("site_id", F.col("year").cast("double").alias("t")).union(later).union(gone).distinct()
