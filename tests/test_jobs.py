"""Whole jobs on small rasters against the same steps in plain numpy, with parameters that differ by scene."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_rasters import chamfer, flood, window

from landfold.operators import buffer, focal, landcover, water

W, H = 26, 19


def mean(a, r):
    return window(a.astype(float), r, 0.0).sum((2, 3)) / window(np.ones_like(a, float), r, 0.0).sum((2, 3))


def std(a, r):
    return np.sqrt(np.maximum(0, mean(a * a, r) - mean(a, r) ** 2))


def grown(m, r):
    return window(m, r, False).any((2, 3)) if r > 0 else m


def shrunk(m, r):
    return window(m, r, False).all((2, 3)) if r > 0 else m


def closed(m, r):
    return shrunk(grown(m, r), r)


def opened(m, r):
    return grown(shrunk(m, r), r)


def parts(m, conn):
    """The regions of a mask as masks."""
    label = np.full(m.shape, -1, np.int64)
    for (x, y), r in flood(m, conn).items():
        label[y, x] = r
    return [label == r for r in np.unique(label[label >= 0])]


def kept(m, conn, good):
    return np.logical_or.reduce([p for p in parts(m, conn) if good(p)], initial=False) & m


def large(m, least, conn=8):
    return kept(m, conn, lambda p: p.sum() >= least)


def features(lum, chroma, green, smooth, tex):
    edge = np.zeros_like(lum)
    edge[1:-1, 1:-1] = 0.5 * np.hypot(lum[1:-1, 2:] - lum[1:-1, :-2], lum[2:, 1:-1] - lum[:-2, 1:-1])
    low = window(lum, tex, np.inf).min((2, 3))
    return [mean(a, smooth) for a in (lum, chroma, green, std(lum, tex), low, std(lum, 2 * tex + 1))] + [mean(edge, max(smooth, tex))]


def classified(lum, chroma, green, sea, coast, circles, p):
    """land, forest, sparse, open and built of one scene with samples of forest, sparse and open and all parameters given."""
    coast = coast & (p["coastExclude"] != 0)
    land = ~sea & ~coast
    f = np.stack(features(lum, chroma, green, int(p["smooth"]), int(p["texRadius"])), -1)
    y, x = np.mgrid[:H, :W]
    mus, pooled, seen = {}, {}, {}
    for name, cx, cy, r in circles:
        inside = (x - cx) ** 2 + (y - cy) ** 2 <= r * r
        if inside.sum() >= 4:
            mus.setdefault(name, []).append(f[inside].mean(0))
            pooled[name] = pooled.get(name, 0) + f[inside].var(0) * inside.sum()
            seen[name] = seen.get(name, 0) + inside.sum()
    va = {n: np.maximum(p["varFloor"], pooled[n] / seen[n]) for n in mus}
    shared = np.maximum(p["varFloor"], sum(va[n] * seen[n] for n in va) / sum(seen.values()))
    score = {n: np.max([-0.5 * ((f - mu) ** 2 / shared).sum(-1) for mu in mus[n]], axis=0) for n in mus}
    rule = (f[..., 0] > p["builtMin"]) & (f[..., 1] < p["builtChromaMax"])
    cls = np.full((H, W), -1)
    for at in zip(*np.nonzero(land)):
        s = [score["forest"][at], score["sparse"][at] + p["bias"] * 0.5, score["open"][at] + p["bias"], np.inf if rule[at] else -np.inf]
        k = int(np.argmax(s))
        first, second = sorted(s, reverse=True)[:2]
        margin = 2 * (first - second) if np.isfinite(first) and np.isfinite(second) else np.inf
        cls[at] = 3 if k == 3 else 0 if margin < p["strictness"] else k
    if p["majority"] > 0:
        votes = np.stack([window(cls == k, int(p["majority"]), False).sum((2, 3)) for k in range(4)])
        cls = np.where(land, votes.argmax(0), -1)
    forest, sparse, built = cls == 0, cls == 1, cls == 3
    if p["clean"] > 0:
        forest = opened(closed(forest, int(p["clean"])), int(p["clean"])) & land
        sparse = sparse & ~forest
    free = land & ~forest & ~built & ~sparse
    if p["minRegionPx"] > 1:
        whole = large(free, p["minRegionPx"])
        sparse, free = sparse | (free & ~whole), whole
        whole = large(sparse, max(1, p["minRegionPx"] // 2))
        forest, sparse = forest | (sparse & ~whole), whole
    return land, forest, sparse, free, built


OVERRIDES = {
    "plain": {}, "smooth": {"smooth": 1.0, "texRadius": 3.0}, "noise": {"varFloor": 400.0, "strictness": 0.5}, "raw": {"majority": 0.0, "clean": 0.0, "minRegionPx": 1.0}, "coast": {"coastExclude": 0.0, "clean": 1.0},
    "coarse": {"majority": 4.0, "minRegionPx": 60.0, "bias": 3.0}, "dark": {"forestMax": 100.0, "builtMin": 150.0, "builtChromaMax": 40.0, "minRegionPx": 4.0},
}


@pytest.mark.parametrize("tile", [8, 256])
def test_every_scene_is_classified_by_its_own_parameters(spark, tile):
    rnd = np.random.default_rng(7)
    rows, circles, planes = [], [], {}
    for name in OVERRIDES:
        blocks = rnd.choice([40.0, 90.0, 170.0], (5, 7)).repeat(4, 0).repeat(4, 1)[:H, :W]
        lum = blocks + rnd.uniform(-25, 25, (H, W))
        lum[2:7, 2:7], lum[2:7, 10:15], lum[2:7, 18:23] = (v + rnd.uniform(-25, 25, (5, 5)) for v in (40, 90, 170))
        chroma, green = rnd.uniform(0, 60, (H, W)), rnd.uniform(-20, 20, (H, W))
        sea = np.zeros((H, W), bool)
        sea[16:] = True
        coast = np.zeros((H, W), bool)
        coast[14:16] = True
        planes[name] = (lum, chroma, green, sea, coast)
        for y in range(H):
            for x in range(W):
                rows.append((0, name, x, y, *(float(a[y, x]) for a in planes[name][:3]), bool(sea[y, x]), bool(coast[y, x])))
        if name != "dark":
            circles += [(0, name, "forest", "f", 4.0, 4.0, 2), (0, name, "sparse", "s", 12.0, 4.0, 2), (0, name, "open", "o", 20.0, 4.0, 2)]
    px = spark.createDataFrame(rows, "site_id long, scene_id string, x long, y long, lum double, chroma double, green double, water boolean, coast boolean")
    samples = spark.createDataFrame(circles, "site_id long, scene_id string, class string, circle_id string, x double, y double, r int")
    scenes = spark.createDataFrame([(0, n, p) for n, p in OVERRIDES.items()], "site_id long, scene_id string, params map<string,double>")
    gray = scenes.select("site_id", "scene_id", F.lit(False).alias("grayscale"))
    params = landcover.resolve_params(scenes, gray, {**landcover.DEFAULTS, "minRegionPx": 12})
    got = {(r.scene_id, r.x, r.y): r for r in landcover.classify_scene(px, params, samples, focal.raster_sizes(px), tile).collect()}
    own = {r.scene_id: r.asDict() for r in params.collect()}
    for name, given in planes.items():
        drawn = [(c, x, y, r) for _, s, c, _, x, y, r in circles if s == name]
        if drawn:
            want = classified(*given, drawn, own[name])
        else:  # without samples: by threshold, and no majority
            f = np.stack(features(*given[:3], 3, 2), -1)
            land = ~given[3] & ~given[4]
            forest, rule = land & (f[..., 0] < 100.0), (f[..., 0] > 150.0) & (f[..., 1] < 40.0)
            built = land & ~forest & rule
            forest = opened(closed(forest, 2), 2) & land
            free = land & ~forest & ~built
            whole = large(free, 4)
            sparse = free & ~whole
            kept_sparse = large(sparse, 2)
            want = land, forest | (sparse & ~kept_sparse), kept_sparse, whole, built
        for y in range(H):
            for x in range(W):
                r = got[name, x, y]
                assert (r.land, r.forest, r.sparse, r.open, r.built) == tuple(bool(a[y, x]) for a in want), (name, x, y)
    assert len(got) == W * H * len(OVERRIDES)
    different = {name: sum(got[name, x, y].land for y in range(H) for x in range(W)) for name in OVERRIDES}
    assert different["coast"] > different["plain"]


def test_water_mask_equals_plain_steps(spark):
    rnd = random.Random(3)
    votes = [[(3 if x < 9 or (x > 20 and 4 < y < 9) or rnd.random() < 0.08 else 0) if rnd.random() > 0.05 else 1 for x in range(W)] for y in range(H)]
    df = spark.createDataFrame([(0, x, y, votes[y][x], 4) for y in range(H) for x in range(W)], "site_id long, x long, y long, votes int, refs int")
    sizes = spark.createDataFrame([(0, W, H)], "site_id long, width long, height long")
    got = {(r.x, r.y): r.water for r in water.water_mask(df, sizes, min_land_region=6).collect()}
    dry = large(~closed(np.array(votes) >= 3, 2), 6, 4)
    wet = closed(~dry, 2)
    inside = np.zeros_like(wet)
    inside[4 : H - 4, 4 : W - 4] = True
    sea = grown(kept(wet, 4, lambda p: (p & ~inside).any()), 1)
    assert {(x, y): bool(sea[y, x]) for y in range(H) for x in range(W)} == got and 0 < sea.sum() < W * H


@pytest.mark.parametrize("tile", [16, 256])
def test_buffer_zone_equals_plain_steps(spark, tile):
    rnd = np.random.default_rng(5)
    cls = rnd.choice(4, (5, 7), p=[0.35, 0.35, 0.15, 0.15]).repeat(4, 0).repeat(4, 1)[:H, :W]
    cls = np.where(rnd.random((H, W)) < 0.08, 1, cls)
    sea = np.zeros((H, W), bool)
    sea[:2] = True
    land, none = ~sea, np.zeros((H, W), bool)
    forest, sparse, free, built = (land & (cls == k) for k in range(4))
    rows = [(0, "a", x, y, *(bool(a[y, x]) for a in (land, forest, sparse, free, built, sea, none))) for y in range(H) for x in range(W)]
    px = spark.createDataFrame(rows, "site_id long, scene_id string, x long, y long, land boolean, forest boolean, sparse boolean, open boolean, built boolean, water boolean, coast boolean")
    settled, aoi, out = np.zeros((H, W), bool), np.zeros((H, W), bool), np.zeros((H, W), bool)
    settled[10:12, 5:8] = aoi[:, :24] = out[12:, 10:13] = True
    table = lambda m: spark.createDataFrame([(0, int(x), int(y)) for y, x in zip(*np.nonzero(m))], "site_id long, x long, y long")
    strokes = spark.createDataFrame([(0, "a", 3, 3, 1, 1), (0, "a", 4, 3, 1, 1), (0, "a", 4, 3, -1, 2), (0, "a", 1, 0, 1, 1)], "site_id long, scene_id string, x long, y long, v int, stroke_no int")
    made = buffer.buffer_zone(px, table(settled), table(aoi), strokes, table(out), band_px=7, min_human_region_px=9, min_buffer_region_px=5, forest_near_px=4, coast_away_px=1, adjacency_px=3, min_forest_region_px=12, tile=tile)
    got = {(r.x, r.y): (r.human, r.band, r.buffer) for r in made.collect()}
    human = land & (settled | large(land & (free | built), 9))
    far = chamfer(human)
    band = land & ~human & (far / 3 <= 7)
    zone = band & sparse & (chamfer(large(forest, 12)) / 3 <= 4) & (chamfer(sea) / 3 > 1) & ~out
    zone = large(zone, 5)
    zone = kept(zone, 8, lambda p: (p & (far / 3 <= 3)).any())
    zone[3, 3], zone[3, 4] = land[3, 3], False
    want = {(x, y): (bool(human[y, x]), bool((band & aoi)[y, x]), bool((zone & aoi)[y, x])) for y in range(H) for x in range(W)}
    assert got == want and 5 < (zone & aoi).sum() < W * H
