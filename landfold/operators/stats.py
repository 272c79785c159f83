"""Thresholds and areas: histograms first, so that nothing sorts or gathers pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landfold.keys import K
from landfold.tables import written


def level_median(df: DataFrame, col: str, keys: list[str] = K) -> DataFrame:
    """(keys, median) as ``upper_median``, for columns of few distinct values a key, such as those of images."""
    return _counted_median(df.where(F.col(col).isNotNull()).select(*keys, F.col(col).alias("_v")), keys)


def _counted_median(rows: DataFrame, keys: list[str], places: DataFrame | None = None) -> DataFrame:
    """(keys, median) of rows(keys, _v): the value at the key's place, n div 2 or that of places(keys, _place)."""
    hist = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    hist = hist.withColumn("_sum", F.sum("_c").over(w.orderBy("_v")))
    hist = hist.withColumn("_place", F.expr("max(_sum) over (partition by {}) div 2".format(", ".join(f"`{k}`" for k in keys)))) if places is None else hist.join(places, keys)
    return hist.where("_sum > _place").groupBy(*keys).agg(F.min("_v").alias("median"))


#: Buckets that a round of ``upper_median`` cuts a key's values into, and the sketch's exactness as a part of the rows.
MEDIAN_BUCKETS, SKETCH = 200, 4000


def upper_median(df: DataFrame, col: str, keys: list[str] = K, most: int = 1_000_000) -> DataFrame:
    """(keys, median): the value at place n div 2 of the sorted values; nulls don't count, NaN is above all numbers.

    Selection by rounds. A mergeable sketch of each key's values gives the edges of MEDIAN_BUCKETS buckets; the two
    edges around the key's place part its values into those below, at and between the edges and above, which are
    counted exactly, and only the part that holds the place goes on: a few hundredths of the rows, whatever the
    values are, as the edges themselves leave in each round. Keys whose rest has at most ``most`` rows (or, of whole
    numbers beyond 2**53, no longer shrinks) are finished by a count of distinct values. Values are never gathered
    by key before, and what a round keeps is written, so df is read twice by the first round and not again.
    """
    rest = df.where(F.col(col).isNotNull()).select(*keys, F.col(col).alias("_v"))
    kind = rest.schema["_v"].dataType
    broken = F.isnan("_v") if kind.typeName() in ("double", "float") else F.lit(False)
    places = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_n", F.expr("_n div 2").alias("_place"))
    if ((largest := places.agg(F.max("_n")).first()[0]) or 0) <= most:
        return _counted_median(rest, keys)
    places, found, finished = written(places, "median-places"), [], []
    edges = ", ".join(f"{k / MEDIAN_BUCKETS}D" for k in range(MEDIAN_BUCKETS + 1))
    while True:
        sketch = rest.withColumn("_s", F.when(~broken, F.col("_v"))).groupBy(*keys).agg(
            F.expr(f"percentile_approx(_s, array({edges}), {SKETCH})").alias("_e"), F.count("_s").alias("_m")
        )
        at = f"int(least(_place * {MEDIAN_BUCKETS} div greatest(_m, 1), {MEDIAN_BUCKETS}))"
        edge = lambda k: F.expr(f"_e[{k}]") if kind.typeName() not in ("double", "float") else F.expr(f"coalesce(_e[{k}], double('NaN')) + 0D").cast(kind)
        bounds = sketch.join(places, keys).select(*keys, "_place", edge(f"greatest({at} - 1, 0)").alias("_lo"), edge(f"least({at} + 2, {MEDIAN_BUCKETS})").alias("_hi"))
        bounds = written(bounds, "median-bounds")
        part = F.expr("CASE WHEN _v < _lo THEN 0 WHEN _v = _lo THEN 1 WHEN _v < _hi THEN 2 WHEN _v = _hi THEN 3 ELSE 4 END")
        parted = rest.join(bounds, keys).withColumn("_part", part)
        counts = parted.groupBy(*keys, "_place", "_lo", "_hi", "_part").agg(F.count(F.lit(1)).alias("_n"))
        w = Window.partitionBy(*keys).orderBy("_part")
        counts = counts.withColumn("_sum", F.sum("_n").over(w)).where("_sum > _place and _sum - _n <= _place")
        chosen = written(counts.select(*keys, "_part", "_n", "_lo", "_hi", F.expr("_place - (_sum - _n)").alias("_place")), "median-parts")
        found.append(chosen.where("_part in (1, 3)").select(*keys, F.expr("IF(_part = 1, _lo, _hi)").alias("median")))
        open_ = chosen.where("_part in (0, 2, 4)")
        last, largest = largest, open_.agg(F.max("_n")).first()[0] or 0
        rest = written(parted.join(open_.select(*keys, "_part"), [*keys, "_part"], "left_semi").select(*keys, "_v"), "median-rest")
        places = open_.select(*keys, "_n", "_place")
        if largest <= most or largest >= last:
            finished.append(_counted_median(rest, keys, places.select(*keys, "_place")))
            break
    out = finished[0]
    for done in found:
        out = out.unionByName(done)
    return out


def level(col: str) -> Column:
    """A value rounded half-up and clamped to 0..255."""
    return F.least(F.greatest(F.floor(F.col(col) + 0.5), F.lit(0)), F.lit(255)).cast("int")


def histogram256(df: DataFrame, col: str, mask: str | None = None, keys: list[str] = K) -> DataFrame:
    """(keys, bin, n): values rounded half-up and clamped to 0..255."""
    df = df if mask is None else df.where(mask)
    return df.groupBy(*keys, level(col).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def otsu_threshold(df: DataFrame, col: str, mask: str | None = None, keys: list[str] = K) -> DataFrame:
    """(keys, threshold): the first bin that maximises the variance between classes; 128 if empty or never above 0."""
    return _otsu(df.select(*keys).distinct(), histogram256(df, col, mask, keys), keys)


def _otsu(of: DataFrame, h: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    up = w.orderBy("bin")
    h = h.withColumns({"_b": F.sum("n").over(up), "_s": F.sum(F.col("bin") * F.col("n")).over(up), "_n": F.sum("n").over(w), "_t": F.sum(F.col("bin") * F.col("n")).over(w)})
    front = F.col("_n") - F.col("_b")
    gap = F.col("_s") / F.col("_b") - (F.col("_t") - F.col("_s")) / front
    h = h.withColumn("_v", F.when(front > 0, F.col("_b").cast("double") * front * gap * gap))
    best = h.where("_v > 0").groupBy(*keys).agg(F.min_by("bin", F.struct(-F.col("_v"), "bin")).alias("threshold"))
    return of.join(best, keys, "left").withColumn("threshold", F.coalesce("threshold", F.lit(128)))


def area_below_otsu(df: DataFrame, col: str, px_area_ha: float, keys: list[str] = K) -> DataFrame:
    """(keys, threshold, area_ha): Otsu's threshold of not-null values and the area below it, from one histogram.

    Each bin also counts its values below its own number, so that the area is exact: bins below the threshold, and
    that part of the threshold's bin. Pixels are read once.
    """
    h = df.groupBy(*keys, level(col).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(col) < level(col)).alias("low"))
    h = written(h, "histogram")
    limit = _otsu(h.select(*keys).distinct(), h.select(*keys, "bin", "n"), keys)
    below = F.expr("CASE WHEN bin < threshold THEN n WHEN bin = threshold THEN low ELSE 0 END")
    return h.join(limit, keys).groupBy(*keys, "threshold").agg((F.sum(below) * F.lit(px_area_ha)).alias("area_ha"))


def ha(mask: Column | str, px_area_ha: float) -> Column:
    return F.count_if(F.col(mask) if isinstance(mask, str) else mask) * F.lit(px_area_ha)


def mask_area(df: DataFrame, col: str, px_area_ha: float, keys: list[str] = K) -> DataFrame:
    """(keys, area_ha) of the true pixels; restrict df to the area of interest before."""
    return df.groupBy(*keys).agg(ha(col, px_area_ha).alias("area_ha"))


def scene_stats(px: DataFrame, px_area_ha: float) -> DataFrame:
    """Hectares of each class of px(settlement, open, sparse, land, buffer, forest, built, aoi).

    The buffer is counted as it is, the others inside the area of interest; classes may overlap.
    """
    inside = {"settlement": "settlement", "field": "open", "sparse": "sparse", "land": "land", "forest": "forest", "built": "built"}
    return px.groupBy(*K).agg(ha("buffer", px_area_ha).alias("buffer"), *(ha(F.col(c) & F.col("aoi"), px_area_ha).alias(n) for n, c in inside.items()))


def catalogue_counts(samples: DataFrame, houses: DataFrame, polygons: DataFrame) -> DataFrame:
    """(site_id, what, scope, kind, n): circles by class, houses and polygons, shared or of a scene."""
    scope = F.coalesce("scene_id", F.lit("shared"))
    return (
        samples.groupBy("site_id", F.lit("sample").alias("what"), scope.alias("scope"), F.col("class").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
        .unionByName(houses.groupBy("site_id", F.lit("house").alias("what"), scope.alias("scope"), F.lit("house").alias("kind")).agg(F.count(F.lit(1)).alias("n")))
        .unionByName(polygons.groupBy("site_id", F.lit("polygon").alias("what"), F.lit("shared").alias("scope"), "kind").agg(F.countDistinct("poly_id").alias("n")))
    )
