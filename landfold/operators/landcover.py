"""Land cover from a few training circles: nearest prototype under a shared variance, then cleaning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.keys import K, PIXEL
from landfold.operators import focal, regions
from landfold.operators.bands import built_rule, grayscale_flag
from landfold.operators.focal import FEATURES, box_sum, close_open, to_tiles
from landfold.operators.geometry import disc_pixels, for_scenes
from landfold.operators.stats import otsu_threshold
from landfold.tables import written

CLASSES = ["forest", "sparse", "open", "built"]
#: Default parameters; those of GRAY_DEFAULTS depend on whether the scene is monochrome.
DEFAULTS = {"smooth": 3, "texRadius": 2, "bias": 0.0, "clean": 2, "minRegionPx": 80, "varFloor": 9.0, "strictness": 4.0, "majority": 2}
GRAY_DEFAULTS = {"builtMin": (200.0, 190.0), "builtChromaMax": (255.0, 24.0)}


def resolve_params(scenes: DataFrame, gray: DataFrame, defaults: dict[str, float] = DEFAULTS) -> DataFrame:
    """scenes(params map<string,double>) with one column a parameter: the scene's own value or the default."""
    s = scenes.join(gray, K)
    own = lambda name: F.try_element_at("params", F.lit(name))
    plain = {n: F.coalesce(own(n), F.lit(float(v))) for n, v in defaults.items()}
    by_gray = {n: F.coalesce(own(n), F.when(F.col("grayscale"), a).otherwise(b)) for n, (a, b) in GRAY_DEFAULTS.items()}
    return s.withColumns({**plain, **by_gray, "forestMax": own("forestMax"), "coastExclude": F.coalesce(own("coastExclude"), F.lit(1.0))}).drop("params")


def samples_for_scene(samples: DataFrame, scenes: DataFrame) -> DataFrame:
    """Circles of every scene: its own and the shared ones; radius 8 if none is given; without a position they go."""
    s = for_scenes(samples.where("x is not null and y is not null and not isnan(x) and not isnan(y)"), scenes)
    return s.withColumn("r", F.coalesce("r", F.lit(8)))


def _floored(variances: DataFrame, var_floor: float | DataFrame) -> DataFrame:
    """variances(site_id, scene_id, va, ...) with no entry of va below the floor: one number, or (site_id, scene_id, varFloor)."""
    if isinstance(var_floor, DataFrame):
        rows = variances.join(var_floor.select(*K, "varFloor"), K, "left").withColumn("varFloor", F.coalesce("varFloor", F.lit(DEFAULTS["varFloor"])))
    else:
        rows = variances.withColumn("varFloor", F.lit(float(var_floor)))
    return rows.withColumn("va", F.transform("va", lambda v: F.greatest(v, F.col("varFloor")))).drop("varFloor")


def _circle_dots(samples: DataFrame, sizes: DataFrame) -> DataFrame:
    """(site_id, scene_id, class, circle_id, x, y): the pixels of every circle."""
    radius = F.greatest(F.col("r").cast("int"), F.lit(1))
    return disc_pixels(samples.withColumn("r", radius), F.col("r").cast("double"), sizes).select(*K, "class", "circle_id", F.col("px").alias("x"), F.col("py").alias("y"))


def _trained(seen: DataFrame, var_floor: float | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prototypes and variances of circles' pixels with their features."""
    per = seen.groupBy(*K, "class", "circle_id").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(f) for f in FEATURES)).alias("mu"), F.array(*(F.var_pop(f) for f in FEATURES)).alias("_v"))
    per = written(per.where("n >= 4"), "circles")  # a row a circle, read for prototypes and variances
    pooled = [F.sum(F.col("_v")[k] * F.col("n")) / F.sum("n") for k in range(len(FEATURES))]
    return per.drop("_v"), _floored(per.groupBy(*K, "class").agg(F.array(*pooled).alias("va"), F.sum("n").alias("n")), var_floor)


def train_prototypes(features: DataFrame, samples: DataFrame, sizes: DataFrame, var_floor: float | DataFrame = 9.0) -> tuple[DataFrame, DataFrame]:
    """Prototypes (site_id, scene_id, class, circle_id, n, mu) and class variances (site_id, scene_id, class, n, va).

    A circle is a mean of its pixels' features, if it has at least 4; a class's variance is pooled over its circles.
    """
    return _trained(_circle_dots(samples, sizes).join(features, PIXEL), var_floor)


def train_from_bands(bands: DataFrame, samples: DataFrame, sizes: DataFrame, var_floor: float | DataFrame = 9.0, smooth: int = 3, tex_radius: int = 2, tile: int = 256) -> tuple[DataFrame, DataFrame]:
    """The rows of ``train_prototypes`` from bands, by one exchange of pixels.

    A task has a tile of bands with its halo and those pixels of circles that lie in the tile. It makes the features and
    hands on the circles' ones alone, so that no other feature is exchanged or written. The tile's size does not change a result.
    """
    dots = _circle_dots(samples, sizes).where("scene_id is not null").withColumns({"tx": F.expr(f"x div {tile}"), "ty": F.expr(f"y div {tile}")})
    shown = [*K, "class", "circle_id", *FEATURES]

    def run(g: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(of):
            return pd.DataFrame(columns=shown)
        found, at = focal.features_in_tile(g, smooth, tex_radius)
        return of.merge(g[["x", "y"]].assign(**{n: a[at] for n, a in zip(FEATURES, found)}), on=["x", "y"])[shown]

    schema = ", ".join(f"{c} {t}" for c, t in dots.select(*K, "class", "circle_id").dtypes) + "".join(f", {f} double" for f in FEATURES)
    tiles = focal.band_tiles(bands, sizes, smooth, tex_radius, tile).groupBy(*K, "tx", "ty")
    return _trained(tiles.cogroup(dots.groupBy(*K, "tx", "ty")).applyInPandas(run, schema), var_floor)


def share_variance(variances: DataFrame, var_floor: float | DataFrame = 9.0) -> DataFrame:
    """(site_id, scene_id, va): one variance over all classes, weighted by their pixels."""
    shared = [F.sum(F.col("va")[k] * F.col("n")) / F.sum("n") for k in range(len(FEATURES))]
    return _floored(variances.groupBy(*K).agg(F.array(*shared).alias("va")), var_floor)


def _scene_arrays(prototypes: DataFrame, shared: DataFrame) -> DataFrame:
    """One row a scene: arrays of prototypes (_p_forest ...) and va."""
    lists = [F.collect_list(F.when(F.col("class") == c, F.col("mu"))).alias(f"_p_{c}") for c in CLASSES]
    return prototypes.groupBy(*K).agg(*lists).join(shared, K)


def prototype_scores(features: DataFrame, prototypes: DataFrame, shared: DataFrame) -> DataFrame:
    """features with score_forest ... score_built: the best prototype's -0.5 * squared distance; null without one.

    The model is one row a scene (arrays of prototypes), so that the join moves no pixel.
    """
    model = _scene_arrays(prototypes, shared)
    px = features.join(model, K, "left")

    def score(name: str) -> Column:
        def of(mu: Column) -> Column:
            total = F.lit(0.0)
            for k, f in enumerate(FEATURES):
                total = total + (F.col(f) - mu[k]) * (F.col(f) - mu[k]) / F.col("va")[k]
            return -0.5 * total

        return F.array_max(F.transform(f"_p_{name}", of))

    return px.withColumns({f"score_{c}": score(c) for c in CLASSES}).drop("va", *(f"_p_{c}" for c in CLASSES))


def score_tiles(bands: DataFrame, prototypes: DataFrame, shared: DataFrame, sizes: DataFrame, smooth: int = 3, tex_radius: int = 2, tile: int = 256) -> DataFrame:
    """(site_id, scene_id, x, y, score_forest ... score_built): the scores of ``prototype_scores`` from bands, by one exchange of pixels.

    A task has a tile of bands with its halo and its scene's row of prototypes; it makes the features and scores its own
    pixels, so that no feature is exchanged or written. The tile's size does not change a result.
    """
    models = focal.tile_grid(_scene_arrays(prototypes, shared), sizes, tile)
    names = [*PIXEL, *(f"score_{c}" for c in CLASSES)]

    def run(g: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame(columns=names)
        own = ((g["x"] // tile == g["tx"].iloc[0]) & (g["y"] // tile == g["ty"].iloc[0])).to_numpy()
        out = g.loc[own, PIXEL].copy()
        if len(model):
            found, at = focal.features_in_tile(g, smooth, tex_radius)
            f, va = [a[at][own] for a in found], model["va"].iloc[0]
        for c in CLASSES:
            of = model[f"_p_{c}"].iloc[0] if len(model) else []
            out[f"score_{c}"] = np.max([-0.5 * sum((a - m) * (a - m) / v for a, m, v in zip(f, mu, va)) for mu in of], axis=0) if len(of) else np.nan
        return out[names]

    schema = ", ".join(f"{c} {t}" for c, t in bands.select(*PIXEL).dtypes) + "".join(f", {n} double" for n in names[len(PIXEL) :])
    tiles = focal.band_tiles(bands, sizes, smooth, tex_radius, tile).groupBy(*K, "tx", "ty")
    return tiles.cogroup(models.groupBy(*K, "tx", "ty")).applyInPandas(run, schema)


def decide_class(px: DataFrame) -> DataFrame:
    """px with ``cls``: the best class on land, 'open' for what is none of the others, null off land.

    px: land, score_*, f_lum, f_chroma and the parameters bias, strictness, builtMin, builtChromaMax. Without built
    prototypes the bright-and-unsaturated rule makes built certain. A best class that leads by too little is forest.
    """
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    rule = F.when(built_rule(F.col("f_lum"), F.col("f_chroma"), F.col("builtMin"), F.col("builtChromaMax")), high).otherwise(low)
    scores = [
        F.coalesce("score_forest", low),
        F.coalesce(F.col("score_sparse") + F.col("bias") * 0.5, low),
        F.coalesce(F.col("score_open") + F.col("bias"), low),
        F.coalesce("score_built", rule),
    ]
    px = px.withColumn("_s", F.array(*scores))
    ranked = F.sort_array("_s", asc=False)
    px = px.withColumns({"_1": ranked[0], "_2": ranked[1], "_k": F.array_position("_s", ranked[0])})
    finite = lambda c: (F.col(c) > float("-inf")) & (F.col(c) < float("inf"))
    margin = F.when(finite("_1") & finite("_2"), 2 * (F.col("_1") - F.col("_2"))).otherwise(high)
    cls = F.when(F.col("_k") == 4, "built").when(margin < F.col("strictness"), "forest").when(F.col("_k") == 2, "sparse").when(F.col("_k") == 1, "forest").otherwise("open")
    return px.withColumn("cls", F.when(F.col("land"), cls)).drop("_s", "_1", "_2", "_k")


def threshold_classify(px: DataFrame) -> DataFrame:
    """px with ``cls`` where forest or open samples are missing: dark is forest, else built by rule or prototype, else open.

    px: land, f_lum, f_chroma, score_built, forestMax (null: Otsu's threshold of smoothed brightness on land), bias.
    """
    limit = otsu_threshold(px, "f_lum", "land").withColumnRenamed("threshold", "_otsu")
    px = px.join(limit, K).withColumn("_max", F.coalesce("forestMax", F.col("_otsu").cast("double")))
    fixed = F.lit(0.0)
    for k, f in enumerate(FEATURES):
        mean = F.col("_max") + 40 if k == 0 else F.col("_max") + 20 if k == 4 else F.lit(0.0)
        fixed = fixed + (F.col(f) - mean) * (F.col(f) - mean) / 400
    rule = built_rule(F.col("f_lum"), F.col("f_chroma"), F.col("builtMin"), F.col("builtChromaMax"))
    built = F.when(F.col("score_built").isNotNull(), F.col("score_built") > -0.5 * fixed).otherwise(rule)
    cls = F.when(F.col("f_lum") < F.col("_max") - F.col("bias") * 5, "forest").when(built, "built").otherwise("open")
    return px.withColumn("cls", F.when(F.col("land"), cls)).drop("_otsu", "_max")


def clean_forest(px: DataFrame, clean: int = 2) -> DataFrame:
    """px(land, forest, sparse, built) with forest closed and opened on land, where it clears sparse, not built."""
    if clean <= 0:
        return px
    px = focal.mask_steps(px, "forest", [("grow", clean), ("shrink", clean), ("shrink", clean), ("grow", clean)], "_f")
    return px.withColumn("forest", F.col("_f") & F.col("land")).withColumn("sparse", F.col("sparse") & ~F.col("forest")).drop("_f")


def clean_regions(px: DataFrame, min_region_px: int | Column = 80, labelled: str | None = None, tile: int = regions.TILE) -> DataFrame:
    """px(land, forest, sparse, built) with ``open``: small open regions become sparse; then small regions of that sparse become forest.

    labelled: a column that labels the open regions inside tiles of this size already; it goes."""
    own = isinstance(min_region_px, Column)
    px = px.withColumn("open", F.expr("land and not forest and not built and not sparse"))
    if own or min_region_px > 1:
        half = F.greatest(F.floor(min_region_px / 2), F.lit(1)) if own else max(1, min_region_px // 2)
        px = regions.keep_regions(px, {"_o": ("open", [(F.lit(1), min_region_px)])}, 8, tile, {"_o": labelled} if labelled else None)
        px = px.withColumn("sparse", F.expr("sparse or (open and not _o)")).withColumn("open", F.col("_o")).drop("_o")
        px = regions.remove_small_regions(px, "sparse", half, 8, "_s", tile)
        px = px.withColumn("forest", F.expr("forest or (sparse and not _s)")).withColumn("sparse", F.col("_s")).drop("_s")
    return px


def clean_classes(px: DataFrame, clean: int = 2, min_region_px: int = 80) -> DataFrame:
    """px(land, forest, sparse, built) cleaned, with ``open``."""
    return clean_regions(clean_forest(px, clean), min_region_px)


def flags_of(px: DataFrame) -> DataFrame:
    return px.withColumns({c: F.coalesce(F.col("cls") == c, F.lit(False)) for c in ("forest", "sparse", "built")})


def _models(features: DataFrame, params: DataFrame, samples: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row a scene: all its parameters, arrays of prototypes (p_forest ...), va, by_samples. features: of the circles' pixels at least."""
    var_floor = params.select(*K, "varFloor")
    prototypes, variances = train_prototypes(features, samples, sizes, var_floor)
    known = F.count_if(F.col("class") == "forest") * F.count_if(F.col("class") == "open") > 0
    lists = [F.collect_list(F.when(F.col("class") == c, F.col("mu"))).alias(f"p_{c}") for c in CLASSES]
    model = prototypes.groupBy(*K).agg(*lists, known.alias("by_samples")).join(share_variance(variances, var_floor), K)
    wanted = params.select(*K, "bias", "strictness", "builtMin", "builtChromaMax", "forestMax", "majority", "clean", "smooth", "texRadius", "coastExclude", "minRegionPx")
    return wanted.join(model, K, "left").withColumn("by_samples", F.coalesce("by_samples", F.lit(False)))


def scene_models(features: DataFrame, params: DataFrame, samples: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row a scene: arrays of prototypes (p_forest ...), va, its own parameters, by_samples, and Otsu's threshold on land."""
    return _models(features, params, samples, sizes).join(otsu_threshold(features, "f_lum", "land"), K)


def with_land(px: DataFrame) -> DataFrame:
    """px(water, coast, coastExclude) with ``land``; where coastExclude is 0 the coast is land."""
    return px.withColumn("coast", F.expr("coast and coastExclude <> 0")).withColumn("land", F.expr("not water and not coast"))


def models_of_bands(bands: DataFrame, params: DataFrame, samples: DataFrame, sizes: DataFrame, tile: int = 128) -> DataFrame:
    """``scene_models`` from bands with water and coast: features are made only in the small tiles that circles touch, and
    Otsu's threshold only for scenes that need one (no samples and no forestMax); the others have none."""
    windows = params.select(*K, "smooth", "texRadius", "coastExclude")
    circles = disc_pixels(samples.withColumn("r", F.greatest(F.col("r").cast("int"), F.lit(1))), F.col("r").cast("double"), sizes)
    touched = circles.select(*K, F.expr(f"px div {tile}").alias("tx"), F.expr(f"py div {tile}").alias("ty")).distinct()
    models = written(_models(focal.feature_tiles(bands, sizes, tile=tile, windows=windows, only=touched), params, samples, sizes), "models")
    plain = models.where("not by_samples and forestMax is null").select(*K)
    limit = models.select(*K).limit(0).withColumn("threshold", F.lit(0))
    if not plain.isEmpty():
        dark = focal.feature_tiles(bands.join(plain, K, "left_semi"), sizes, carry=("water", "coast"), windows=windows)
        limit = otsu_threshold(with_land(dark), "f_lum", "land")
    return written(models.join(limit, K, "left"), "models")


def _decided(f: dict[str, np.ndarray], m: dict) -> np.ndarray:
    """Place in CLASSES of each land pixel by the model of its scene; the arithmetic of decide_class and threshold_classify."""

    def distance2(mu, va) -> np.ndarray:
        return sum((f[n] - mu[k]) * (f[n] - mu[k]) / va[k] for k, n in enumerate(FEATURES))

    score = {c: np.max([-0.5 * distance2(mu, m["va"]) for mu in m[f"p_{c}"]], axis=0) for c in CLASSES if m[f"p_{c}"] is not None and len(m[f"p_{c}"])}
    rule = (f["f_lum"] > m["builtMin"]) & (f["f_chroma"] < m["builtChromaMax"])
    if not m["by_samples"]:
        limit = m["threshold"] if pd.isna(m["forestMax"]) else m["forestMax"]
        fixed = [limit + 40 if k == 0 else limit + 20 if k == 4 else 0.0 for k in range(len(FEATURES))]
        built = score["built"] > -0.5 * distance2(fixed, [400.0] * len(FEATURES)) if "built" in score else rule
        return np.where(f["f_lum"] < limit - m["bias"] * 5, 0, np.where(built, 3, 2))
    none = np.full(len(rule), -np.inf)
    s = np.stack([score["forest"], score["sparse"] + m["bias"] * 0.5 if "sparse" in score else none, score["open"] + m["bias"], score["built"] if "built" in score else np.where(rule, np.inf, none)])
    best = s.argmax(axis=0)
    two = np.sort(s, axis=0)[-2:]
    sure = ~np.isfinite(two).all(axis=0)
    margin = np.where(sure, np.inf, 2 * (np.where(sure, 0, two[1]) - np.where(sure, 0, two[0])))
    return np.where(best == 3, 3, np.where(margin < m["strictness"], 0, best))


def _cleaned(f: dict[str, np.ndarray], land: np.ndarray, at: tuple[np.ndarray, np.ndarray], m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forest, sparse and built of the pixels at these places of a tile, as arrays, after majority and cleaning."""
    majority, clean = int(m["majority"]), int(m["clean"])
    cls = np.where(land, _decided(f, m), -1)
    planes = np.zeros((4, at[0].max() + 1, at[1].max() + 1), bool)
    planes[(cls[land], *(a[land] for a in at))] = True
    if m["by_samples"] and majority > 0:
        ground = planes.any(axis=0)
        best = np.stack([box_sum(p.astype(np.int64), majority) for p in planes]).argmax(axis=0)
        planes = np.stack([(best == k) & ground for k in range(4)])
    ground = planes.any(axis=0)
    forest, sparse, built = planes[0], planes[1], planes[3]
    if clean > 0:
        forest = close_open(forest, clean) & ground
        sparse = sparse & ~forest
    return forest, sparse, built


def land_tiles(bands: DataFrame, models: DataFrame, sizes: DataFrame, tile: int = regions.TILE) -> DataFrame:
    """(site_id, scene_id, x, y, land, coast, water, by_samples, forest, sparse, built, open, minRegionPx, _at): bands to cleaned classes in one exchange.

    A task has one tile of bands with a halo as wide as all windows in turn (features, majority, cleaning; the widest of
    all scenes) and its scene's row of ``models_of_bands``. It makes the features, decides, cleans, and labels the open
    regions inside the tile (``_at``, as ``regions.label_in_tile``), so that no feature is written or exchanged.
    """
    over = F.max(2 * F.col("texRadius") + 1 + F.greatest("smooth", "texRadius")) + F.max(F.greatest("majority", F.lit(0)) + 4 * F.greatest("clean", F.lit(0)))
    halo = int(models.agg(over).first()[0] or 0)
    dealt = to_tiles(bands.select(*PIXEL, "lum", "chroma", "green", "water", "coast").join(sizes, "site_id"), halo, tile)
    models = focal.tile_grid(models, sizes, tile)
    names = [*PIXEL, "land", "coast", "water", "by_samples", "forest", "sparse", "built", "open", "minRegionPx", "_at"]

    def run(g: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(model):
            return pd.DataFrame(columns=names)
        m = model.iloc[0].to_dict()
        found, at = focal.features_in_tile(g, int(m["smooth"]), int(m["texRadius"]))
        x, y, water, coast = (g[c].to_numpy() for c in ("x", "y", "water", "coast"))
        coast = coast & (m["coastExclude"] != 0)
        land = ~water & ~coast
        planes = _cleaned({n: a[at] for n, a in zip(FEATURES, found)}, land, at, m)
        tx, ty = int(g["tx"].iloc[0]), int(g["ty"].iloc[0])
        own = (x // tile == tx) & (y // tile == ty)
        forest, sparse, built = (a[at][own] for a in planes)
        free = land[own] & ~forest & ~built & ~sparse
        out = g.loc[own, PIXEL].assign(land=land[own], coast=coast[own], water=water[own], by_samples=bool(m["by_samples"]), forest=forest, sparse=sparse, built=built, open=free, minRegionPx=m["minRegionPx"])
        return out.assign(_at=regions.label_in_tile(x[own], y[own], free, tx, ty, 8))[names]

    flags = ", ".join(f"{n} boolean" for n in names[4:12])
    schema = ", ".join(f"{c} {t}" for c, t in bands.select(*PIXEL).dtypes) + f", {flags}, minRegionPx double, _at long"
    return dealt.groupBy(*K, "tx", "ty").cogroup(models.groupBy(*K, "tx", "ty")).applyInPandas(run, schema)


def class_tiles(features: DataFrame, models: DataFrame, sizes: DataFrame, tile: int = 256, carry: tuple[str, ...] = ()) -> DataFrame:
    """(site_id, scene_id, x, y, land, coast, water, carried columns, by_samples, forest, sparse, built): scores, classes, majority and cleaning.

    One exchange of pixels: a task has one tile with a halo as wide as all windows in turn, and its scene's model row,
    with the scene's own radii of majority and cleaning; the halo covers the widest of them. The column form of the
    same steps is ``classes_by_columns``; the tile's size does not change a result.
    """
    px = features.join(sizes, "site_id")
    widest = models.agg(F.max(F.greatest("majority", F.lit(0)) + 4 * F.greatest("clean", F.lit(0)))).first()[0] or 0
    dealt = to_tiles(px, int(widest), tile).drop("width", "height")
    models = focal.tile_grid(models, sizes, tile)
    shown = [*PIXEL, "land", "coast", "water", *carry]

    def run(g: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(model):
            return pd.DataFrame(columns=names)
        m = model.iloc[0].to_dict()
        x, y, land = (g[c].to_numpy() for c in ("x", "y", "land"))
        at = (y - y.min(), x - x.min())
        forest, sparse, built = _cleaned({n: g[n].to_numpy() for n in FEATURES}, land, at, m)
        own = (x // tile == g["tx"].iloc[0]) & (y // tile == g["ty"].iloc[0])
        out = g.loc[own, shown].assign(by_samples=bool(m["by_samples"]))
        for name, a in (("forest", forest), ("sparse", sparse), ("built", built)):
            out[name] = a[at][own]
        return out

    schema = ", ".join(f"{c} {t}" for c, t in features.select(*shown).dtypes) + ", by_samples boolean, forest boolean, sparse boolean, built boolean"
    names = [*shown, "by_samples", "forest", "sparse", "built"]
    return dealt.groupBy(*K, "tx", "ty").cogroup(models.groupBy(*K, "tx", "ty")).applyInPandas(run, schema)


def classes_by_columns(features: DataFrame, params: DataFrame, samples: DataFrame, sizes: DataFrame, clean: int = 2, majority: int = 2, var_floor: float = 9.0) -> DataFrame:
    """The rows of ``class_tiles`` by column functions and windows; the form to check it against."""
    prototypes, variances = train_prototypes(features, samples, sizes, var_floor)
    scored = prototype_scores(features, prototypes, share_variance(variances, var_floor)).join(params, K)
    known = prototypes.where("class in ('forest', 'open')").groupBy(*K).agg((F.countDistinct("class") == 2).alias("by_samples"))
    scored = written(scored.join(known, K, "left").withColumn("by_samples", F.coalesce("by_samples", F.lit(False))), "scored")
    keep = [*PIXEL, "land", "coast", "water", "by_samples", "forest", "sparse", "built"]
    sampled = focal.majority_filter(flags_of(decide_class(scored.where("by_samples"))), majority).select(*keep)
    plain = flags_of(threshold_classify(scored.where("not by_samples"))).select(*keep)
    return clean_forest(sampled.unionByName(plain), clean)


def classify_scene(bands: DataFrame, params: DataFrame, samples: DataFrame, sizes: DataFrame, tile: int = 256) -> DataFrame:
    """(site_id, scene_id, x, y, land, coast, water, forest, sparse, open, built, by_samples): the whole job for all scenes.

    bands: with water and coast; params: as from ``resolve_params``, and every scene goes by its own: windows, floor of
    the variance, bias, cleaning, majority, region sizes and, where coastExclude is 0, with its coast as land. Scenes
    with forest and open samples go by prototypes and majority, the others by threshold.
    """
    params = written(params, "params")  # one row a scene, read several times
    models = models_of_bands(bands, params, samples, sizes, min(tile, 128))
    px = land_tiles(bands, models, sizes, tile)
    return clean_regions(px, F.col("minRegionPx"), "_at", tile).drop("minRegionPx")


def scene_params(bands: DataFrame, scenes: DataFrame) -> DataFrame:
    return resolve_params(scenes, grayscale_flag(bands))
