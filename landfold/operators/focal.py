"""Neighbourhood operators: a square window is a range window along rows and one along columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from landfold.keys import K, PIXEL

FEATURES = ["f_lum", "f_chroma", "f_green", "f_texture", "f_min", "f_wide", "f_edge"]


def _separable(px: DataFrame, pairs: dict[str, Column | str], r: int, agg) -> DataFrame:
    """One row pass and one column pass for all columns together: two shuffles however many there are."""
    across = Window.partitionBy(*K, "y").orderBy("x").rangeBetween(-r, r)
    down = Window.partitionBy(*K, "x").orderBy("y").rangeBetween(-r, r)
    px = px.withColumns({f"_{n}": agg(c).over(across) for n, c in pairs.items()})
    return px.withColumns({n: agg(f"_{n}").over(down) for n in pairs}).drop(*(f"_{n}" for n in pairs))


def focal_sums(px: DataFrame, pairs: dict[str, Column | str], r: int) -> DataFrame:
    return _separable(px, pairs, r, F.sum)


def focal_sum(px: DataFrame, col: str, r: int, out: str = "focal") -> DataFrame:
    """px with the sum over the (2r+1)² window, clipped at the raster's edges."""
    return focal_sums(px, {out: F.col(col)}, r)


def window_pixels(r: int, x: str = "x", y: str = "y", width: str = "width", height: str = "height") -> Column:
    """Pixels of the raster in the window, by arithmetic."""
    side = lambda p, n: F.least(F.col(p) + r, F.col(n) - 1) - F.greatest(F.col(p) - r, F.lit(0)) + 1
    return side(x, width) * side(y, height)


def raster_sizes(px: DataFrame) -> DataFrame:
    return px.groupBy("site_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def focal_count(px: DataFrame, r: int, sizes: DataFrame | None = None, out: str = "n") -> DataFrame:
    """px with the number of raster pixels in the window."""
    sizes = raster_sizes(px) if sizes is None else sizes
    return px.join(sizes, "site_id").withColumn(out, window_pixels(r)).drop("width", "height")


def focal_means(px: DataFrame, pairs: dict[str, Column | str], r: int) -> DataFrame:
    """Means over the window of a dense raster; r <= 0 copies."""
    if r <= 0:
        return px.withColumns({n: (F.col(c) if isinstance(c, str) else c).cast("double") for n, c in pairs.items()})
    px = focal_sums(px, {**pairs, "_n": F.lit(1)}, r)
    return px.withColumns({n: F.col(n) / F.col("_n") for n in pairs}).drop("_n")


def focal_mean(px: DataFrame, col: str, r: int, out: str = "focal") -> DataFrame:
    return focal_means(px, {out: F.col(col)}, r)


def focal_min(px: DataFrame, col: str, r: int, out: str = "focal") -> DataFrame:
    return _separable(px, {out: F.col(col)}, r, F.min)


def focal_std(px: DataFrame, col: str, r: int, out: str = "focal") -> DataFrame:
    """Square root of max(0, E[v²] - E[v]²) over the window."""
    c = F.col(col)
    px = focal_means(px, {"_m": c, "_q": c * c}, r)
    return px.withColumn(out, F.sqrt(F.greatest(F.lit(0.0), F.col("_q") - F.col("_m") * F.col("_m")))).drop("_m", "_q")


def gradient(px: DataFrame, col: str = "lum", out: str = "edge") -> DataFrame:
    """Half the length of the central difference; 0 on the border pixels."""
    across, down = Window.partitionBy(*K, "y").orderBy("x"), Window.partitionBy(*K, "x").orderBy("y")
    px = px.withColumn("_gx", F.lead(col).over(across) - F.lag(col).over(across))
    px = px.withColumn("_gy", F.lead(col).over(down) - F.lag(col).over(down))
    return px.withColumn(out, F.coalesce(0.5 * F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2), F.lit(0.0))).drop("_gx", "_gy")


def feature_vector(bands: DataFrame, smooth: int = 3, tex_radius: int = 2) -> DataFrame:
    """bands with the seven features, by window functions; the form to check ``feature_tiles`` against."""
    df = focal_std(bands, "lum", tex_radius, "_t")
    df = focal_std(df, "lum", 2 * tex_radius + 1, "_w")
    df = focal_min(df, "lum", tex_radius, "_l")
    df = gradient(df, "lum", "_e")
    df = focal_means(df, dict(zip(FEATURES[:5], ["lum", "chroma", "green", "_t", "_l"])), smooth)
    df = focal_means(df, {"f_wide": "_w"}, smooth)
    return focal_means(df, {"f_edge": "_e"}, max(smooth, tex_radius)).drop("_t", "_w", "_l", "_e")


def _running_sum(a: np.ndarray, r: int, axis: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([np.zeros_like(a.take([0], axis)), a], axis), axis)
    n = a.shape[axis]
    hi, lo = np.minimum(np.arange(n) + r + 1, n), np.maximum(np.arange(n) - r, 0)
    return c.take(hi, axis) - c.take(lo, axis)


def box_sum(a: np.ndarray, r: int) -> np.ndarray:
    """Sum over the clipped window, by cumulative sums."""
    return _running_sum(_running_sum(a, r, 0), r, 1)


def _short_sum(a: np.ndarray, r: int, axis: int) -> np.ndarray:
    """The same sums along one axis added up directly: running sums carry the rounding of the whole tile."""
    n = a.shape[axis]
    wide = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)])
    return sum(wide[k : k + n] if axis == 0 else wide[:, k : k + n] for k in range(2 * r + 1))


def _window_total(a: np.ndarray, inside: np.ndarray, r: int) -> np.ndarray:
    """Sums along rows, then those of the raster's own pixels along columns, as window functions make them."""
    for axis in (1, 0):
        a = (_short_sum if r <= 8 else _running_sum)(np.where(inside, a, 0), r, axis)
    return a


def _beside(a: np.ndarray, inside: np.ndarray, axis: int) -> np.ndarray:
    """The next pixel's value less the one's before along an axis; NaN where one of them is missing."""
    n = a.shape[axis]
    place = np.arange(n).reshape((-1, 1) if axis == 0 else (1, -1))
    before = np.maximum.accumulate(np.where(inside, place, -1), axis)
    after = np.flip(np.minimum.accumulate(np.flip(np.where(inside, place, n), axis), axis), axis)
    pad = lambda v, side, fill: np.pad(v, [side if k == axis else (0, 0) for k in (0, 1)], constant_values=fill)
    before = pad(before.take(range(n - 1), axis), (1, 0), -1)
    after = pad(after.take(range(1, n), axis), (0, 1), n)
    step = np.take_along_axis(a, np.minimum(after, n - 1), axis) - np.take_along_axis(a, np.maximum(before, 0), axis)
    return np.where((before >= 0) & (after < n), step, np.nan)


def _tile_features(lum, chroma, green, inside, smooth: int, tex: int) -> list[np.ndarray]:
    """As ``feature_vector``: pixels that the raster lacks don't count, those without a value (NaN) count in means but add nothing."""

    def mean(a: np.ndarray, r: int) -> np.ndarray:
        if r <= 0:
            return a
        known = inside & ~np.isnan(a)
        made = _window_total(np.where(known, a, 0.0), inside, r) / np.maximum(_window_total(inside.astype(np.int64), inside, r), 1)
        return made if (known == inside).all() else np.where(_window_total(known.astype(np.int64), inside, r) > 0, made, np.nan)

    std = lambda a, r: np.sqrt(np.fmax(0, mean(a * a, r) - mean(a, r) ** 2))
    low = np.where(np.isnan(lum), np.inf, lum)
    for axis in (1, 0):
        pad = [(tex, tex) if k == axis else (0, 0) for k in (0, 1)]
        low = np.where(inside, low, np.inf)
        low = np.lib.stride_tricks.sliding_window_view(np.pad(low, pad, constant_values=np.inf), 2 * tex + 1, axis).min(-1)
    edge = np.nan_to_num(0.5 * np.hypot(_beside(lum, inside, 1), _beside(lum, inside, 0)))
    low = np.where(np.isfinite(low), low, np.nan)
    return [mean(a, smooth) for a in (lum, chroma, green, std(lum, tex), low, std(lum, 2 * tex + 1))] + [mean(edge, max(smooth, tex))]


def features_in_tile(g: pd.DataFrame, smooth: int, tex: int) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The seven features of a tile's pixels(x, y, lum, chroma, green) as arrays, and the pixels' places in them."""
    x0, y0 = g["x"].min(), g["y"].min()
    h, w = int(g["y"].max() - y0 + 1), int(g["x"].max() - x0 + 1)
    at = (g["y"].to_numpy() - y0, g["x"].to_numpy() - x0)
    planes = []
    for c in ("lum", "chroma", "green"):
        a = np.zeros((h, w))
        a[at] = g[c]
        planes.append(a)
    inside = np.zeros((h, w), bool)
    inside[at] = True
    return _tile_features(*planes, inside, smooth, tex), at


def band_tiles(bands: DataFrame, sizes: DataFrame, smooth: int, tex_radius: int, tile: int) -> DataFrame:
    """(site_id, scene_id, x, y, lum, chroma, green, tx, ty): what a task needs for the features of its tile, for a grouping by tile."""
    px = bands.select(*PIXEL, "lum", "chroma", "green").join(sizes, "site_id")
    return to_tiles(px, 2 * tex_radius + 1 + max(smooth, tex_radius), tile).drop("width", "height")


def to_tiles(px: DataFrame, halo: int, tile: int) -> DataFrame:
    """px with ``tx, ty``: each pixel once for its own tile and once for each neighbour whose halo it is in."""
    span = lambda c, n: F.sequence(F.floor(F.greatest(F.col(c) - halo, F.lit(0)) / tile), F.floor(F.least(F.col(c) + halo, F.col(n) - 1) / tile))
    return px.withColumn("tx", F.explode(span("x", "width"))).withColumn("ty", F.explode(span("y", "height")))


def tile_grid(rows: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    """rows(site_id, ...) once for every tile of their site's raster."""
    grid = sizes.withColumn("tx", F.explode(F.expr(f"sequence(0L, (width - 1) div {tile})"))).withColumn("ty", F.explode(F.expr(f"sequence(0L, (height - 1) div {tile})")))
    return rows.join(grid.select("site_id", "tx", "ty"), "site_id")


def feature_tiles(bands: DataFrame, sizes: DataFrame, smooth: int = 3, tex_radius: int = 2, tile: int = 256, carry: tuple[str, ...] = (), windows: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(site_id, scene_id, x, y, carried columns without nulls, seven features): the same features in one exchange.

    Each pixel goes to its own tile and, within the halo, to the neighbouring ones; a task computes one tile with
    cumulative sums. The halo covers the widest window, so that the tile's size does not change results.
    ``windows``: one row a scene (site_id, scene_id, smooth, texRadius), with radii of its own; its further columns,
    numbers, are passed on. Scenes without a row take the radii of the call. ``only``: the tiles to compute (site_id, scene_id, tx, ty).
    """
    more, widest = [], (smooth, tex_radius)
    if windows is not None:
        more = [c for c in windows.columns if c not in (*K, "smooth", "texRadius")]
        top = windows.agg(F.max("smooth"), F.max("texRadius")).first()
        widest = tuple(max(int(t or 0), w) for t, w in zip(top, widest))
    halo = 2 * widest[1] + 1 + max(widest)
    dealt = to_tiles(bands.select(*PIXEL, "lum", "chroma", "green", *carry).join(sizes, "site_id"), halo, tile)
    dealt = dealt if only is None else dealt.join(only, [*K, "tx", "ty"], "left_semi")
    names = [*PIXEL, *carry, *FEATURES, *more]

    def made(g: pd.DataFrame, radii: tuple[int, int]) -> pd.DataFrame:
        found, at = features_in_tile(g, *radii)
        tx, ty = (int(g[c].iloc[0]) for c in ("tx", "ty"))
        own = ((g["x"] // tile == tx) & (g["y"] // tile == ty)).to_numpy()
        out = g.loc[own, [*PIXEL, *carry]].copy()
        for name, a in zip(FEATURES, found):
            out[name] = a[at][own]
        return out

    def by_scene(g: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame(columns=names)
        out = made(g, (int(own["smooth"].iloc[0]), int(own["texRadius"].iloc[0])) if len(own) else (smooth, tex_radius))
        return out.assign(**{c: own[c].iloc[0] if len(own) else None for c in more})[names]

    schema = ", ".join(f"{c} {t}" for c, t in dealt.select(*PIXEL, *carry).dtypes) + ", " + ", ".join(f"{f} double" for f in FEATURES)
    tiles = dealt.groupBy(*K, "tx", "ty")
    if windows is None:
        return tiles.applyInPandas(lambda g: made(g, (smooth, tex_radius)), schema)
    schema += "".join(f", {c} {t}" for c, t in windows.select(*more).dtypes)
    return tiles.cogroup(tile_grid(windows, sizes, tile).groupBy(*K, "tx", "ty")).applyInPandas(by_scene, schema)


def tile_stats(px: DataFrame, stats: dict[str, tuple[str, str, int]], tile: int = 256) -> DataFrame:
    """px with one double column for each (kind, column, radius): the mean or std over the square window, clipped at the raster's edges.

    The rows of ``focal_mean`` and ``focal_std`` by one exchange for all of them: a task has a tile with a halo of the widest
    radius. Pixels that the raster lacks don't count.
    """
    halo = max(r for *_, r in stats.values())
    reach = lambda c: F.explode(F.expr(f"sequence(greatest({c} - {halo}, 0) div {tile}, ({c} + {halo}) div {tile})"))
    names = px.columns

    def run(t: pa.Table) -> pa.Table:
        x, y = (t.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        own = (x // tile == t.column("_tx")[0].as_py()) & (y // tile == t.column("_ty")[0].as_py())
        out = t.select(names).filter(pa.array(own))
        at = (y - y.min(), x - x.min())
        here = np.zeros((at[0].max() + 1, at[1].max() + 1))
        here[at] = 1
        for name, (kind, col, r) in stats.items():
            v = np.zeros_like(here)
            v[at] = t.column(col).to_numpy()
            mean = lambda a: box_sum(a, r) / np.maximum(box_sum(here, r), 1)  # noqa: B023, E731
            made = mean(v) if kind == "mean" else np.sqrt(np.maximum(0, mean(v * v) - mean(v) ** 2))
            out = out.append_column(name, pa.array(made[at][own]))
        return out

    schema = StructType([*px.schema.fields, *(StructField(n, DoubleType()) for n in stats)])
    return px.withColumn("_tx", reach("x")).withColumn("_ty", reach("y")).groupBy(*K, "_tx", "_ty").applyInArrow(run, schema)


def close_open(a: np.ndarray, r: int) -> np.ndarray:
    """A closing, then an opening of a mask; outside the array counts as false."""
    full = (2 * r + 1) ** 2
    grow, shrink = (lambda m: box_sum(m.astype(np.int64), r) > 0), (lambda m: box_sum(m.astype(np.int64), r) == full)
    return grow(shrink(shrink(grow(a))))


def mask_steps(px: DataFrame, col: str, steps: list[tuple[str, int]], out: str = "mask", tile: int = 256) -> DataFrame:
    """px with the mask after each step in turn: ("grow", r) or ("shrink", r) by a square window; null counts as false.

    A pixel grows on where any of its window is on; it stays on in shrinking where its whole window is inside the raster
    and on. One exchange for all steps: a task has a tile with a halo as wide as the radii together. A wider halo than
    half a tile would copy most pixels; then each step goes by a window along rows and one along columns (same rows).
    """
    steps = [(kind, r) for kind, r in steps if r > 0]
    px = px.withColumn(out, F.coalesce(F.col(col), F.lit(False)))
    halo = sum(r for _, r in steps)
    if not steps:
        return px
    if 2 * halo > tile:
        for kind, r in steps:
            px = _separable(px, {"_s": F.col(out).cast("int")}, r, F.sum).withColumn(out, F.col("_s") >= (1 if kind == "grow" else (2 * r + 1) ** 2)).drop("_s")
        return px
    reach = lambda c: F.explode(F.expr(f"sequence(greatest({c} - {halo}, 0) div {tile}, ({c} + {halo}) div {tile})"))
    names = px.columns

    def run(t: pa.Table) -> pa.Table:
        x, y = (t.column(c).to_numpy().astype(np.int64) for c in ("x", "y"))
        at = (y - y.min(), x - x.min())
        here = np.zeros((at[0].max() + 1, at[1].max() + 1), bool)
        here[at] = True
        mask = np.zeros_like(here)
        mask[at] = t.column(out).to_numpy()
        for kind, r in steps:
            mask = here & (box_sum(mask.astype(np.int32), r) >= (1 if kind == "grow" else (2 * r + 1) ** 2))
        own = (x // tile == t.column("_tx")[0].as_py()) & (y // tile == t.column("_ty")[0].as_py())
        return t.select(names).set_column(names.index(out), out, pa.array(mask[at])).filter(pa.array(own))

    return px.withColumn("_tx", reach("x")).withColumn("_ty", reach("y")).groupBy(*K, "_tx", "_ty").applyInArrow(run, px.schema)


def dilate(px: DataFrame, col: str, r: int, out: str = "mask") -> DataFrame:
    """True if any pixel of the square window is true; r <= 0 copies."""
    return mask_steps(px, col, [("grow", r)], out)


def erode(px: DataFrame, col: str, r: int, out: str = "mask") -> DataFrame:
    """True if the whole window is inside the raster and true; r <= 0 copies."""
    return mask_steps(px, col, [("shrink", r)], out)


def morph_open(px: DataFrame, col: str, r: int, out: str = "mask") -> DataFrame:
    return mask_steps(px, col, [("shrink", r), ("grow", r)], out)


def morph_close(px: DataFrame, col: str, r: int, out: str = "mask") -> DataFrame:
    """Erosion of the dilation; it clears an r-pixel border too."""
    return mask_steps(px, col, [("grow", r), ("shrink", r)], out)


def majority_filter(px: DataFrame, r: int = 2) -> DataFrame:
    """px(land, forest, sparse, built) with the class most frequent in the window on land; the first wins ties."""
    if r <= 0:
        return px
    flags = {"forest": F.col("forest"), "sparse": F.col("sparse"), "open": F.col("land") & ~F.col("forest") & ~F.col("sparse") & ~F.col("built"), "built": F.col("built")}
    px = focal_sums(px, {f"_{n}": c.cast("int") for n, c in flags.items()}, r)
    top = F.greatest(*(f"_{n}" for n in flags))
    best = F.lit("none")
    for n in reversed(flags):
        best = F.when(F.col(f"_{n}") == top, n).otherwise(best)
    px = px.withColumn("_best", best)
    return px.withColumns({n: F.when(F.col("land"), F.col("_best") == n).otherwise(F.col(n)) for n in ("forest", "sparse", "built")}).drop("_best", *(f"_{n}" for n in flags))
