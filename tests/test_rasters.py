"""Operators on small rasters drawn as text, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landfold.operators import bands, change, distance, focal, geometry, landcover, projection, regions, rle, stats, trend
from landfold.plans import jobs
from landfold.sources import images

RING = ["#####", "#...#", "#.#.#", "#...#", "#####"]
CHAIN = ["#....", ".#...", "..#..", "...#.", "....#"]
COMB = ["#.#.#.#.#", "#.#.#.#.#", "#.#.#.#.#", "#########", "........."]
SPIRAL = ["#######", "......#", "#####.#", "#...#.#", "#.###.#", "#.....#", "#######"]
DRAWN = {"ring": RING, "chain": CHAIN, "comb": COMB, "spiral": SPIRAL, "none": ["...", "..."], "all": ["###", "###"], "one": ["#"], "corner": ["#...", "....", "...."]}


def grid(spark, lines):
    rows = [(0, "a", x, y, c == "#") for y, line in enumerate(lines) for x, c in enumerate(line)]
    return spark.createDataFrame(rows, "site_id long, scene_id string, x long, y long, m boolean")


def noise(seed, w, h, share=0.5):
    rnd = random.Random(seed)
    return ["".join("#" if rnd.random() < share else "." for _ in range(w)) for _ in range(h)]


def array(lines):
    return np.array([[c == "#" for c in line] for line in lines])


def window(a, r, outside):
    h, w = a.shape
    p = np.full((h + 2 * r, w + 2 * r), outside, a.dtype)
    p[r : r + h, r : r + w] = a
    return np.lib.stride_tricks.sliding_window_view(p, (2 * r + 1, 2 * r + 1))


def flood(a, conn):
    """Pixel to the first pixel of its region in raster order."""
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    out = {}
    for y, x in zip(*np.nonzero(a)):
        if (y, x) in out:
            continue
        todo = [(y, x)]
        out[y, x] = (y, x)
        while todo:
            v, u = todo.pop()
            for dv, du in steps:
                q = (v + dv, u + du)
                if 0 <= q[0] < a.shape[0] and 0 <= q[1] < a.shape[1] and a[q] and q not in out:
                    out[q] = (y, x)
                    todo.append(q)
    return {(int(x), int(y)): int(r[0]) * 2**31 + int(r[1]) for (y, x), r in out.items()}


def chamfer(a):
    h, w = a.shape
    out = np.full((h, w), 3_000_000)
    for ty, tx in zip(*np.nonzero(a)):
        dy, dx = np.abs(np.arange(h) - ty)[:, None], np.abs(np.arange(w) - tx)[None, :]
        out = np.minimum(out, 3 * np.maximum(dx, dy) + np.minimum(dx, dy))
    return out


@pytest.mark.parametrize("conn", [4, 8])
def test_regions_equal_flood_fill_for_any_tile(spark, conn):
    cases = {**DRAWN, "n1": noise(1, 17, 13, 0.55), "n2": noise(2, 20, 20, 0.45)}
    px = None
    for k, lines in enumerate(cases.values()):
        g = grid(spark, lines).withColumn("site_id", F.lit(k).cast("long"))
        px = g if px is None else px.union(g)
    want = {(k, *at): r for k, lines in enumerate(cases.values()) for at, r in flood(array(lines), conn).items()}
    for tile in (4, 64):
        got = {(r.site_id, r.x, r.y): r.region for r in regions.connected_components(px, "m", conn, tile).collect()}
        assert got == want


@pytest.mark.parametrize("conn", [4, 8])
def test_labels_number_regions_in_scan_order(spark, conn):
    for lines in [*DRAWN.values(), noise(21, 25, 14, 0.45)]:
        first = flood(array(lines), conn)
        number = {r: k + 1 for k, r in enumerate(sorted(set(first.values())))}
        size = {r: list(first.values()).count(r) for r in number}
        for tile in (4, 256):
            got = {(r.x, r.y): (r.label, r.size) for r in regions.region_labels(grid(spark, lines), "m", conn, tile).collect()}
            assert got == {at: (number[r], size[r]) for at, r in first.items()}


def test_region_filters(spark):
    px = grid(spark, SPIRAL).withColumn("seed", F.expr("x = 0 and y = 3"))
    sizes = focal.raster_sizes(px)
    assert regions.remove_small_regions(px, "m", 1).where("mask").count() == sum(line.count("#") for line in SPIRAL)
    small = {(r.x, r.y) for r in regions.remove_small_regions(grid(spark, ["##.#", "....", "#..#", "#..."]), "m", 2, 4).where("mask").collect()}
    assert small == {(0, 0), (1, 0), (0, 2), (0, 3)}
    assert regions.keep_border_regions(grid(spark, [".....", ".#.#.", ".....", "....#"]), "m", focal.raster_sizes(grid(spark, [".....", ".#.#.", ".....", "....#"])), 4, 0).where("mask").count() == 1
    assert regions.keep_touching_regions(px, "m", "seed", 8).where("mask").count() > 0 and sizes.count() == 1


@pytest.mark.parametrize("conn", [4, 8])
def test_several_masks_in_one_labelling(spark, conn):
    a, b = noise(5, 21, 17, 0.5), noise(6, 21, 17, 0.55)
    px = grid(spark, a).join(grid(spark, b).withColumnRenamed("m", "n"), focal.PIXEL).withColumn("seed", F.expr("(x * 7 + y * 5) % 11 = 0"))
    rules = {"big": ("m", [(F.lit(1), 6)]), "hit": ("n", [(F.lit(1), F.col("x") * 0 + 3), (F.col("seed").cast("int"), 2)])}
    want = {}
    for name, lines, good in (("big", a, lambda p: len(p) >= 6), ("hit", b, lambda p: len(p) >= 3 and sum((x * 7 + y * 5) % 11 == 0 for y, x in p) >= 2)):
        parts = {}
        for (x, y), r in flood(array(lines), conn).items():
            parts.setdefault(r, []).append((y, x))
        want[name] = {(x, y) for p in parts.values() if good(p) for y, x in p}
    assert all(want.values())
    for tile in (5, 64):
        got = regions.keep_regions(px, rules, conn, tile).collect()
        assert len(got) == 21 * 17
        for name in want:
            assert {(r.x, r.y) for r in got if r[name]} == want[name]


def test_images_in_bands(spark, tmp_path):
    px = spark.range(30).selectExpr("7L AS site_id", "'s' AS scene_id", "id % 5 AS x", "id div 5 AS y", "id AS r", "id * 2 AS g", "id * 3 AS b")
    made = images.write_scene_images(px, f"{tmp_path}/bands", 4).collect()
    assert sorted(r.first for r in made) == [0, 4]
    assert sorted(map(tuple, images.read_scene_images(spark, f"{tmp_path}/bands").collect())) == sorted(map(tuple, px.collect()))


def test_broken_images_are_not_passed_over(spark, tmp_path):
    px = grid(spark, ["##", ".#"]).selectExpr("site_id", "scene_id", "x", "y", "1L AS r", "2L AS g", "3L AS b")
    images.write_scene_images(px, f"file://{tmp_path}").count()
    (tmp_path / "0_b.png").write_bytes(b"not an image")
    assert [r.file.rsplit("/", 1)[1] for r in images.unreadable_images(spark, f"file://{tmp_path}").collect()] == ["0_b.png"]
    with pytest.raises(Exception, match="0_b.png"):
        images.read_scene_images(spark, f"file://{tmp_path}").collect()
    assert images.read_scene_images(spark, f"file://{tmp_path}/*.bmp").count() == 4


def test_distance_equals_brute_force(spark):
    for lines in [*DRAWN.values(), noise(3, 19, 11, 0.04), noise(4, 7, 30, 0.02)]:
        want = chamfer(array(lines))
        got = distance.distance_transform(grid(spark, lines), "m").collect()
        assert len(got) == want.size and all(r.dist3 == want[r.y, r.x] for r in got)


@pytest.mark.parametrize("seed", range(12))
def test_row_pass_equals_brute_force(seed):
    """Gaps of all kinds, dominated ones too, in narrow and wide rows."""
    rnd = np.random.default_rng(seed)
    rows, width = 7, int(rnd.integers(1, 90))
    gap = rnd.integers(0, (2, 10, 60, 400)[seed % 4], (rows, width))
    gap[rnd.random(gap.shape) < rnd.choice([0, 0.5, 0.95])] = distance.FAR
    gap[0] = distance.FAR
    a = np.abs(np.arange(width)[:, None] - np.arange(width))
    want = np.stack([np.where(g < distance.FAR, np.maximum(3 * a + g, a + 3 * g), distance.FAR).min(axis=1) for g in gap])
    assert (distance.row_pass(gap) == want).all()


def test_distance_takes_time_by_pixels(spark):
    """Tall, wide and far: the nearest true pixel may be over a million thirds away; a window that is run again for each row would take minutes."""
    tall = spark.range(60_000).select(F.lit(0).alias("site_id"), F.lit("a").alias("scene_id"), (F.col("id") % 3).alias("x"), F.expr("id div 3").alias("y"), (F.col("id") == 0).alias("m"))
    assert tall.count() == distance.distance_transform(tall, "m").where("dist3 = 3 * y + x or (y < x and dist3 = 3 * x + y)").count()
    wide = tall.select("site_id", "scene_id", F.col("y").alias("x"), F.col("x").alias("y"), "m").withColumn("m", F.expr("x = 0 and y = 2"))
    assert wide.count() == distance.distance_transform(wide, "m").where("dist3 = 3 * greatest(x, 2 - y) + least(x, 2 - y)").count()
    gap = np.full((1, 1_500_000), distance.FAR)
    gap[0, 7] = 5
    assert distance.row_pass(gap)[0, -1] == 3 * (1_499_999 - 7) + 5


@pytest.mark.parametrize("op", ["<=", "<", ">"])
def test_within_distance_for_any_tile(spark, op):
    """By tiles with a halo, and by the whole distance where the halo is wider than half a tile; nulls, empty masks and gaps in the raster too."""
    for lines in [DRAWN["none"], DRAWN["corner"], noise(3, 23, 17, 0.03)]:
        px = grid(spark, lines).withColumn("m", F.expr("CASE WHEN (x + y) % 7 <> 3 THEN m END")).withColumn("more", F.col("x"))
        seen = array(lines) & ((np.add.outer(np.arange(len(lines)), np.arange(len(lines[0])))) % 7 != 3)
        far = chamfer(seen) / 3
        for d in (0, 7 / 3, 4.5):
            want = {"<=": far <= d, "<": far < d, ">": far > d}[op]
            for tile in (3, 9):
                got = distance.within_distance(px, "m", d, op, tile=tile).collect()
                assert len(got) == want.size and all(r.near == want[r.y, r.x] and r.more == r.x for r in got)
    assert distance.within_distance(px.limit(0), "m", 2).count() == 0


@pytest.mark.parametrize("r", [0, 1, 2])
def test_morphology_edges(spark, r):
    lines = noise(5, 12, 9, 0.7)
    a = array(lines)
    grow = window(a, r, False).any(axis=(2, 3))
    shrink = window(a, r, False).all(axis=(2, 3))
    px = grid(spark, lines)
    both = focal.erode(focal.dilate(px, "m", r, "g"), "m", r, "s").collect()
    assert all(p.g == grow[p.y, p.x] and p.s == shrink[p.y, p.x] for p in both)
    opened = focal.morph_open(px, "m", r, "o")
    again = focal.morph_open(opened, "o", r, "oo").collect()
    assert all(p.o == p.oo for p in again)


@pytest.mark.parametrize("steps", [[("grow", 2), ("shrink", 2), ("shrink", 1), ("grow", 3)], [("shrink", 1)], []])
def test_mask_steps_for_any_tile(spark, steps):
    """Small tiles, one tile and windows (a halo of over half a tile) agree, on a raster with holes and nulls too."""
    px = grid(spark, noise(8, 37, 29, 0.6)).withColumn("m", F.expr("CASE WHEN (x * 7 + y * 3) % 23 <> 0 THEN m END")).withColumn("more", F.expr("concat(x, '-', y)"))
    for some in (px, px.where("(x * 5 + y * 11) % 17 <> 0"), px.limit(0)):
        want, *others = (sorted(map(tuple, focal.mask_steps(some, "m", steps, "o", tile).collect()), key=str) for tile in (4, 20, 256))
        assert len(want) == some.count() and all(o == want for o in others)
    same = focal.mask_steps(px, "m", steps, "m").select("m").collect()
    assert sum(r.m for r in same) == focal.mask_steps(px, "m", steps, "o").where("o").count()


def test_tile_stats_equal_windows_for_any_tile(spark):
    rnd = random.Random(16)
    px = spark.createDataFrame([(0, s, x, y, rnd.random() * 255, s) for s in "ab" for x in range(21) for y in range(13)], "site_id long, scene_id string, x long, y long, v double, more string")
    want = sorted(map(tuple, focal.focal_std(focal.focal_mean(px, "v", 1, "m"), "v", 2, "s").select("scene_id", "x", "y", "more", F.round("m", 6), F.round("s", 6)).collect()))
    for tile in (4, 256):
        got = focal.tile_stats(px, {"m": ("mean", "v", 1), "s": ("std", "v", 2)}, tile)
        assert sorted(map(tuple, got.select("scene_id", "x", "y", "more", F.round("m", 6), F.round("s", 6)).collect())) == want
    assert focal.tile_stats(px.limit(0), {"m": ("mean", "v", 1)}).count() == 0


def test_feature_tiles_equal_windows_for_any_tile(spark):
    rnd = random.Random(6)
    rows = [(0, s, x, y, rnd.randint(0, 255), rnd.randint(0, 255), rnd.randint(0, 255)) for s in "ab" for x in range(23) for y in range(17)]
    b = bands.spectral_bands(spark.createDataFrame(rows, "site_id long, scene_id string, x long, y long, r int, g int, b int"))
    want = {(p.scene_id, p.x, p.y): [p[f] for f in focal.FEATURES] for p in focal.feature_vector(b).collect()}
    for tile in (5, 11, 256):
        got = focal.feature_tiles(b, focal.raster_sizes(b), tile=tile).collect()
        assert len(got) == len(want)
        assert all(np.allclose([p[f] for f in focal.FEATURES], want[p.scene_id, p.x, p.y], atol=1e-6) for p in got)


def test_majority_first_wins_ties(spark):
    rows = [(0, "a", x, 0, True, x == 1, x == 0, False) for x in range(2)]
    px = spark.createDataFrame(rows, "site_id long, scene_id string, x long, y long, land boolean, forest boolean, sparse boolean, built boolean")
    assert all(p.forest and not p.sparse for p in focal.majority_filter(px, 1).collect())


def test_thresholds(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), ("b", 5.0), ("c", 7.0), ("c", 7.0)], "k string, v double")
    assert {r.k: r["median"] for r in stats.upper_median(df, "v", ["k"]).collect()} == {"a": 2.0, "b": 5.0, "c": 7.0}
    assert {r.k: r.threshold for r in stats.otsu_threshold(df, "v", None, ["k"]).collect()} == {"a": 2, "b": 128, "c": 128}


def test_area_below_otsu_is_exact(spark):
    rnd = random.Random(2)
    values = {"a": [rnd.choice([40, 180]) + rnd.randint(-200, 200) / 8 for _ in range(500)], "b": [128.0, 127.5, 128.49], "c": [7.0] * 5, "d": [-3.0, 0.4, 300.0, 254.5]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    want = {r.k: r.threshold for r in stats.otsu_threshold(df, "v", None, ["k"]).collect()}
    got = {r.k: (r.threshold, r.area_ha) for r in stats.area_below_otsu(df, "v", 0.5, ["k"]).collect()}
    assert got == {k: (t, 0.5 * sum(v < t for v in values[k])) for k, t in want.items()}


def test_median_by_rounds(spark):
    rnd = random.Random(5)
    values = {
        "normal": [rnd.gauss(0, 1) for _ in range(4000)], "wide": [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-300, 300) for _ in range(3001)],
        "heavy": [1.0] * 1500 + [2.0] * 1499 + [1 + k / 9999 for k in range(1, 900)], "nan": [float("nan")] * 1600 + [1.0] * 1500, "inf": [float("-inf")] * 900 + [float("inf")] * 800 + [0.5, -0.0],
        "one": [3.25], "few": [2.0, 1.0], "none": [None] * 3, "holes": [None] * 5000 + [float(k) for k in range(1500)],
    }
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double").repartition(7)
    want = {k: s[len(s) // 2] for k, vs in values.items() if (s := sorted((v for v in vs if v is not None), key=lambda v: (v != v, v)))}
    for most in (1, 10_000):
        got = {r.k: r["median"] for r in stats.upper_median(df, "v", ["k"], most).collect()}
        assert got.keys() == want.keys() and all(got[k] == want[k] or got[k] != got[k] and want[k] != want[k] for k in want), most
    big = spark.createDataFrame([("k", 2**60 + v) for v in rnd.sample(range(5000), 999)] + [("l", v) for v in range(999)], "k string, v long")
    got = {r.k: r["median"] for r in stats.upper_median(big, "v", ["k"], 5).collect()}
    assert got == {r.k: r["median"] for r in stats.level_median(big, "v", ["k"]).collect()} and got["l"] == 499
    assert stats.upper_median(df.where("k = 'none'"), "v", ["k"], 1).collect() == []


def test_polygons_and_discs(spark):
    sizes = spark.createDataFrame([(0, 12, 10)], "site_id long, width int, height int")
    rows = [(0, "k", "two", 0, 1.0, 1.0), (0, "k", "two", 1, 8.0, 8.0)] + [(0, "k", "box", k, x, y) for k, (x, y) in enumerate([(2.0, 1.0), (6.0, 1.0), (6.0, 4.0), (2.0, 4.0)])]
    v = spark.createDataFrame(rows, "site_id long, kind string, poly_id string, vertex_no int, x double, y double")
    assert {(r.x, r.y) for r in geometry.polygon_mask(v, sizes).collect()} == {(x, y) for x in range(2, 6) for y in range(1, 4)}
    p = spark.createDataFrame([(0, 0.0, 0.0), (0, 50.0, 50.0)], "site_id long, x double, y double")
    assert {(r.px, r.py) for r in geometry.disc_pixels(p, 1.0, sizes).collect()} == {(0, 0), (1, 0), (0, 1)}


def test_nearest_is_strict_and_first_wins(spark):
    q = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 100.0, 0.0)], "query_id int, site_id long, x double, y double")
    p = spark.createDataFrame([(7, 0, 3.0, 4.0), (5, 0, -3.0, 4.0), (9, 0, 113.0, 0.0)], "point_id int, site_id long, x double, y double")
    assert {r.query_id: (r.point_id, r.d) for r in geometry.nearest_within(q, p, 13.0).collect()} == {1: (5, 5.0), 2: (None, None)}


def test_nearest_in_crowded_cells(spark):
    rnd = random.Random(8)
    p = [(rnd.randrange(9000), 0, 50 + rnd.gauss(0, 0.01), 50 + rnd.gauss(0, 0.01)) for _ in range(1200)] + [(k, 0, 61.0, 50.0) for k in range(300, 200, -1)]
    p += [(9500 + k, rnd.randrange(2), rnd.uniform(-20, 90), rnd.uniform(-20, 90)) for k in range(60)] + [(9700, 0, 50.0, 38.0), (9699, 0, 50.0, 62.0), (9800, 0, None, 1.0), (9801, 0, float("nan"), 1.0), (9802, 0, float("inf"), 1.0)]
    q = [(0, 50.0 + rnd.gauss(0, 0.02), 50.0 + rnd.gauss(0, 0.02)) for _ in range(500)] + [(0, rnd.uniform(-30, 100), rnd.uniform(-30, 100)) for _ in range(300)] + [(1, 50.0, 50.0), (0, 61.0, 50.0), (0, None, 3.0), (7, 1.0, 1.0)]
    points = spark.createDataFrame(p, "point_id long, site_id long, x double, y double")
    asked = spark.createDataFrame([(k, *r) for k, r in enumerate(q)], "query_id long, site_id long, x double, y double")
    want = {}
    for k, (site, x, y) in enumerate(q):
        near = [] if x is None else [(d, i) for i, s, a, b in p if s == site and a is not None and (d := math.hypot(x - a, y - b)) < 13.0]
        want[k] = min(near, default=(None, None))
    for leaf in (16, 5000):
        got = {r.query_id: (r.d, r.point_id) for r in geometry.nearest_within(asked, points, 13.0, leaf).collect()}
        assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and (got[k][0] is None) == (want[k][0] is None) for k in want), leaf
        assert all(d is None or abs(d - want[k][0]) < 1e-12 for k, (d, _) in got.items())
    assert len(geometry.point_tree(points, 13.0, 16)) > 8
    assert geometry.nearest_within(asked, points.limit(0), 13.0).where("d is not null").count() == 0


def mulberry(seed):
    a = seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
        t = ((t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF) ^ t
        yield (t ^ (t >> 14)) / 4294967296


def test_jitter_is_the_sequence(spark):
    want = mulberry(104730)
    got = [r.u for r in spark.range(50).select(change.jitter(F.lit(104730), F.col("id")).alias("u")).collect()]
    assert got == [next(want) for _ in range(50)]
    assert abs(got[0] - 0.509758897125721) < 1e-12


def test_priority_order_is_stable(spark):
    rnd = random.Random(8)
    rows = [(0, x, y, float(rnd.randint(0, 12)) / 3) for y in range(6) for x in range(7)]
    df = spark.createDataFrame(rows, "site_id long, x long, y long, p float")
    top = max(r[3] for r in rows)
    nb = min(1 << 20, int(top / 0.25) + 2)
    bucket = lambda p: min(nb - 1, int(np.float64(np.float32(p)) * ((nb - 1) / max(np.float64(np.float32(top)), 1e-9))))
    want = {(r[1], r[2]): k for k, r in enumerate(sorted(rows, key=lambda r: (bucket(r[3]), r[2], r[1])))}
    assert {(r.x, r.y): r["rank"] for r in change.priority_order(df, "p", ["site_id"]).collect()} == want


def test_ranks_by_selection_stand_right_to_every_cut(spark):
    rnd = random.Random(12)
    rows = [(s, x, y, rnd.choice([0.0, 0.1, 3.3, 3.4, 7.0, 90.0]), f"{x}-{y}") for s in (1, 2) for x in range(15) for y in range(12)]
    px = spark.createDataFrame(rows, "site_id long, x long, y long, p float, more string")
    full = {(r.site_id, r.more): r.rank for r in change.priority_order(px, "p", ["site_id"]).collect()}
    cuts = {1: [0, 17, 60, 61, 180], 2: [90]}
    some = change.priority_order(px, "p", ["site_id"], cuts=spark.createDataFrame([(s, c) for s, cs in cuts.items() for c in cs], "site_id long, cut long")).collect()
    assert len(some) == len(full) and all((r.rank >= c) == (full[r.site_id, r.more] >= c) for r in some for c in cuts[r.site_id])
    assert sum(r.rank != full[r.site_id, r.more] for r in some) > 150  # most buckets are not ranked


def test_run_lengths_round_trip(spark):
    rnd = random.Random(9)
    rows = [(0, "a", x, y, rnd.choice([-1, 0, 0, 1])) for y in range(7) for x in range(5)] + [(1, "a", x, y, 0) for y in range(2) for x in range(2)]
    px = spark.createDataFrame(rows, "site_id long, scene_id string, x long, y long, v int")
    runs = rle.rle_encode(px, "v")
    flat = [v for *_, v in sorted((r[3], r[2], r[4]) for r in rows if r[0] == 0)]
    want = []
    for v in flat:
        if want and want[-2] == v:
            want[-1] += 1
        else:
            want += [v, 1]
    assert {r.site_id: r.runs for r in runs.collect()} == {0: want, 1: [0, 4]}
    back = rle.rle_decode(runs, focal.raster_sizes(px)).collect()
    assert {(r.site_id, r.x, r.y): r.v for r in back} == {(s, x, y): v for s, _, x, y, v in rows}


@pytest.mark.parametrize("band", [1, 3, 100])
def test_runs_for_any_band(spark, band):
    """Runs over many bands, bands of one run, nulls, and runs that are cut as too long."""
    rnd = random.Random(9)
    lines = [[rnd.choice([0, 0, 1, None]) if y in (4, 9) else 7 if y < 4 or 5 < y < 8 else 2 for x in range(6)] for y in range(13)]
    rows = [(0, s, x, y, v) for s in "ab" for y, line in enumerate(lines if s == "a" else [[3] * 6] * 13) for x, v in enumerate(line)]
    px = spark.createDataFrame(rows, "site_id long, scene_id string, x long, y long, v int")
    want, flat = [], [v for line in lines for v in line]
    for k, v in enumerate(flat):
        if k and v == flat[k - 1] and want[-1][2] < 10:
            want[-1][2] += 1
        else:
            want.append([k, v, 1])
    got = sorted((r.scene_id, r.start, r.v, r.n) for r in rle.rle_runs(px, "v", band, 10).collect())
    assert got == [("a", *w) for w in want] + [("b", k, 3, min(10, 78 - k)) for k in range(0, 78, 10)]
    assert rle.rle_runs(px.limit(0), "v", band).count() == 0


def series(spark, by_site):
    return spark.createDataFrame([(s, str(k), float(x), y) for s, points in by_site.items() for k, (x, y) in enumerate(points)], "site_id string, scene_id string, year double, area_ha double")


def test_trend_cases(spark):
    s = series(spark, {"fall": [(1990, 10.0), (2000, 8.0), (2010, 6.0)], "one": [(1990, 3.0)], "same_year": [(2000, 1.0), (2000, 3.0)], "rise": [(1990, 1.0), (2000, 2.0)], "nan": [(1990, float("nan")), (2000, 5.0)]})
    t = {r.site_id: r for r in trend.fit_trend(s).collect()}
    assert abs(t["fall"].slope + 0.2) < 1e-12 and abs(t["fall"].r2 - 1) < 1e-12 and t["fall"].ok
    assert not t["one"].ok and t["same_year"].slope == 0 and not t["nan"].ok and t["nan"].points == 1
    setup = {r.site_id: r for r in trend.projection_setup(s.where("site_id in ('fall', 'rise', 'one')"), None, 50).collect()}
    assert abs(setup["fall"].disappear_year - 2015) < 1e-9 and setup["fall"].x_max == 2020
    assert setup["rise"].disappear_year is None and setup["rise"].x_max == 2100 and setup["one"].note == "no trend"
    exp = trend.fit_trend(series(spark, {"a": [(0, 8.0), (1, 4.0), (2, 2.0), (3, 0.0)]}), "exp").first()
    assert abs(exp.slope - np.log(0.5)) < 1e-12 and exp.points == 4


def test_interpolation_ends_and_halves(spark):
    a, b = ["####"], ["..##"]
    rows = []
    for scene, year, lines in (("a", 2000, a), ("b", 2010, b)):
        rows += [(0, scene, year, x, 0, lines[0][x] == "#", x == 0, False) for x in range(4)]
    m = spark.createDataFrame(rows, "site_id long, scene_id string, year int, x long, y long, buffer boolean, forest boolean, built boolean")
    years = spark.createDataFrame([(1995.0,), (2000.0,), (2005.0,), (2009.9,), (2010.0,), (2020.0,)], "t double")
    got = {}
    for r in change.interpolate_mask(m, change.build_intervals(m), years).collect():
        got.setdefault(r.t, set()).add(r.x)
    assert got == {1995.0: {0, 1, 2, 3}, 2000.0: {0, 1, 2, 3}, 2005.0: {1, 2, 3}, 2009.9: {2, 3}, 2010.0: {2, 3}, 2020.0: {2, 3}}
    order = projection.removal_order(m.where("scene_id = 'b'"))
    assert {r.x: r["rank"] for r in order.collect()} == {2: 0, 3: 1}


def test_small_circles_train_nothing(spark):
    rows = [(0, "a", x, y, *[1.0] * 7) for x in range(5) for y in range(5)]
    f = spark.createDataFrame(rows, "site_id long, scene_id string, x long, y long, " + ", ".join(f"{n} double" for n in focal.FEATURES))
    circles = spark.createDataFrame([(0, "a", "open", "far", 50.0, 50.0, 2), (0, "a", "open", "near", 2.0, 2.0, 1), (0, "a", "forest", "edge", -0.9, 0.0, 1)], "site_id long, scene_id string, class string, circle_id string, x double, y double, r int")
    p, v = landcover.train_prototypes(f, circles, focal.raster_sizes(f))
    assert {r.circle_id: r.n for r in p.collect()} == {"near": 5}
    assert v.first().va == [9.0] * 7


def test_class_tiles_equal_columns_for_any_tile(spark):
    rnd, w, h = random.Random(5), 23, 17
    level = {0: 40.0, 1: 90.0, 2: 160.0}
    rows = []
    for scene in ("a", "b"):
        for y in range(h):
            for x in range(w):
                v = level[(x // 8 + y // 6) % 3]
                rows.append((0, scene, x, y, rnd.random() < 0.1, x < 2, x >= 2 and rnd.random() < 0.1, *(v + rnd.uniform(-30, 30) for _ in range(7))))
    kinds = "site_id long, scene_id string, x long, y long, water boolean, land boolean, coast boolean, " + ", ".join(f"{f} double" for f in focal.FEATURES)
    px = spark.createDataFrame(rows, kinds).withColumn("land", ~F.col("water") & ~F.col("coast"))
    samples = spark.createDataFrame([(0, "a", "forest", "f", 3.0, 2.0, 2), (0, "a", "sparse", "s", 11.0, 2.0, 2), (0, "a", "open", "o", 19.0, 2.0, 2), (0, "b", "built", "u", 19.0, 2.0, 2)], "site_id long, scene_id string, class string, circle_id string, x double, y double, r int")
    scenes = spark.createDataFrame([(0, "a", {"bias": 1.0}, False), (0, "b", {}, True)], "site_id long, scene_id string, params map<string,double>, grayscale boolean")
    params = landcover.resolve_params(scenes.drop("grayscale"), scenes.drop("params"))
    sizes = focal.raster_sizes(px)
    names = ["scene_id", "x", "y", "land", "by_samples", "forest", "sparse", "built"]
    want = sorted(map(tuple, landcover.classes_by_columns(px, params, samples, sizes).select(*names).collect()))
    assert len({r[5:] for r in want}) > 2 and {r[4] for r in want} == {True, False}
    models = landcover.scene_models(px, params, samples, sizes)
    for tile in (7, 256):
        assert sorted(map(tuple, landcover.class_tiles(px, models, sizes, tile=tile).select(*names).collect())) == want


def test_region_and_distance_keep_other_columns(spark):
    px = grid(spark, noise(3, 20, 9)).withColumns({"n": F.when(F.col("x") % 2 == 0, 2**60 + F.col("y")), "s": F.when(F.col("y") > 3, F.lit("ä")), "m": F.when(F.col("x") != 4, F.col("m"))})
    want = sorted(map(tuple, px.select("x", "y", "n", "s").collect()), key=repr)
    assert sorted(map(tuple, regions.remove_small_regions(px, "m", 3, 8, "k", 6).select("x", "y", "n", "s").collect()), key=repr) == want
    assert sorted(map(tuple, distance.with_distance(px, "m", "d").select("x", "y", "n", "s").collect()), key=repr) == want
    assert distance.with_distance(px.limit(0), "m", "d").count() == regions.remove_small_regions(px.limit(0), "m", 3).count() == 0


def test_frames_start_at_each_sites_own_last_scene(spark):
    def site(name, last):
        pixels = lambda year, width: [(name, f"{name}{year}", float(year), x, y, x < width, x >= width, False) for x in range(6) for y in range(6)]
        return pixels(2000, 5) + pixels(last, 4)

    columns = "site_id string, scene_id string, year double, x long, y long, buffer boolean, forest boolean, built boolean"
    years = spark.createDataFrame([(float(t),) for t in (2005, 2010, 2015, 2020, 2025)], "t double")
    frames = lambda rows: sorted(map(tuple, jobs.frames(spark.createDataFrame(rows, columns), years, 1.0).collect()))
    early, late = site("a", 2010), site("b", 2020)
    together = frames(early + late)
    assert together == sorted(frames(early) + frames(late))
    assert [(t, mode, area) for s, t, mode, area, *_ in together if s == "a"][1:] == [(2010.0, "obs", 24.0), (2015.0, "pred", 21.0), (2020.0, "pred", 18.0), (2025.0, "pred", 15.0)]


def test_frames_by_counts_equal_frames_by_pixels(spark):
    """Random masks of sites with scenes, starts, models and bases of their own; years before, at, between and after the scenes."""
    rnd = random.Random(11)
    made, options = [], []
    scenes = {1: [2000, 2003, 2010, 2016], 2: [1995, 2003], 3: [2001], 4: [2000, 2004, 2008, 2012, 2016], 5: [2000, 2010, 2020]}
    for site, years in scenes.items():
        for k, year in enumerate(years):
            made += [(site, f"s{k}", float(year), x, y, rnd.random() < 0.55 - 0.08 * k, rnd.random() < 0.2, rnd.random() < 0.1) for x in range(9) for y in range(7)]
    masks = spark.createDataFrame(made, "site_id long, scene_id string, year double, x long, y long, buffer boolean, forest boolean, built boolean")
    options = [(1, "all", "exp", "s2", 3.0), (2, "prev", "linear", None, 0.0), (3, "first", "linear", None, None), (4, "s1", "last", "s3", 0.0), (5, "prev", "manual", "s1", 2.0)]
    options = spark.createDataFrame(options, "site_id long, base string, model string, start_id string, protect_px double")
    years = spark.createDataFrame([(t,) for t in (1990.0, 2000.0, 2001.5, 2003.0 + 1e-8, 2003.0, 2006.2, 2009.9, 2010.0, 2012.0, 2015.0, 2016.0, 2019.0, 2024.0, 2050.0, 2050.0)], "t double")
    got = {(r.site_id, r.t): (round(r.area_ha), round(r.lost_ha), r.compare_year, r.mode) for r in jobs.frames(masks, years, 1.0, options=options).collect()}
    px = jobs.frame_pixels(masks, years, 1.0, options=options).groupBy("site_id", "t").agg(F.count_if("buffer").alias("b"), F.count_if("lost").alias("l")).collect()
    want = {(r.site_id, r.t): (r.b, r.l) for r in px}
    assert len(got) == 5 * 14 and {k: v[:2] for k, v in got.items() if abs(k[1] - 2003) > 1e-9 or k[1] == 2003} == {k: want.get(k, (0, 0)) for k in got if abs(k[1] - 2003) > 1e-9 or k[1] == 2003}
    assert got[1, 2003.0 + 1e-8][:2] == got[1, 2003.0][:2] and got[1, 2003.0 + 1e-8][3] == "obs"
    assert got[2, 1990.0][2] == 1995 and got[2, 2003.0][2] == 1995 and got[5, 2015.0][2:] == (2010.0, "pred") and got[4, 2003.0][2] is None and got[4, 2050.0][2] == 2004
    assert jobs.frames(masks.limit(0), years, 1.0).count() == 0


def test_regrid_exchanges_no_grid(spark):
    """Grids up and down in size, from rasters of their own size each, by the rule itself; nothing but the scenes' sizes is exchanged."""
    rnd = random.Random(7)
    rasters = {"a": (5, 3), "b": (1, 1), "c": (13, 29), "d": (40, 2)}
    rows = [(0, s, x, y, rnd.randrange(256)) for s, (w, h) in rasters.items() for x in range(w) for y in range(h)]
    values = {(s, x, y): v for _, s, x, y, v in rows}
    px = spark.createDataFrame([*rows, (0, "a", -1, 0, 999), (0, "a", None, 0, 999), (0, None, 0, 0, 999)], "site_id long, scene_id string, x int, y int, v int")
    for width, height in ((7, 13), (1, 1), (29, 40), (3, 100)):
        made = images.regrid_nearest(px, width, height)
        want = {(s, tx, ty): values[s, min(int((tx + 0.5) * w / width), w - 1), min(int((ty + 0.5) * h / height), h - 1)] for s, (w, h) in rasters.items() for tx in range(width) for ty in range(height)}
        got = made.collect()
        assert len(got) == len(want) and {(r.scene_id, r.x, r.y): r.v for r in got} == want
        assert "Exchange hashpartitioning" not in made._jdf.queryExecution().toString()


def _trained_scene(spark, seed):
    """Bands of two scenes with missing pixels, some without a value, and a last row that ends early; circles of which some are too small."""
    rnd = random.Random(seed)
    rows = [(0, s, x, y, None if rnd.random() < 0.02 else rnd.randint(0, 255), rnd.randint(0, 255), rnd.randint(0, 255)) for s in "abc" for x in range(31) for y in range(22) if rnd.random() > 0.03 and (y < 21 or x < 12)]
    b = bands.spectral_bands(spark.createDataFrame(rows, "site_id long, scene_id string, x long, y long, r int, g int, b int"))
    circles = [(0, "a", "forest", "f", 5.0, 4.0, 3), (0, "a", "forest", "g", 12.0, 10.0, 4), (0, "a", "open", "o", 25.0, 20.5, 5), (0, "a", "sparse", "none", 90.0, 4.0, 3), (0, "b", "built", "b", 0.0, 0.0, 2)]
    return b, spark.createDataFrame(circles, "site_id long, scene_id string, class string, circle_id string, x double, y double, r int")


def _near(a, b):
    """Equal rows, where numbers may differ by rounding; lists are compared by place."""
    flat = lambda r: [v for c in r for v in (c if isinstance(c, list) else [c])]
    return len(a) == len(b) and all(u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) < 1e-6) for p, q in zip(a, b) for u, v in zip(flat(p), flat(q)))


def test_scores_by_tiles_equal_columns(spark):
    b, circles = _trained_scene(spark, 12)
    sizes, features = focal.raster_sizes(b), focal.feature_vector(b)
    p, v = landcover.train_prototypes(features, circles, sizes)
    shared = landcover.share_variance(v)
    scores = [f"score_{c}" for c in landcover.CLASSES]
    by_pixel = lambda df: sorted(map(tuple, df.select("scene_id", "x", "y", *scores).collect()), key=lambda r: r[:3])
    want = by_pixel(landcover.prototype_scores(features, p, shared))
    assert {r[0] for r in want if r[3] is not None} == {"a"} and {r[0] for r in want if r[6] is not None} == {"b"}
    for tile in (9, 256):
        made = landcover.score_tiles(b, p, shared, sizes, tile=tile)
        assert _near(by_pixel(made), want)
        assert "Window" not in made._jdf.queryExecution().toString()


def test_training_by_tiles_equals_columns(spark):
    b, circles = _trained_scene(spark, 13)
    sizes = focal.raster_sizes(b)
    rows = lambda df: sorted(map(tuple, df.select("scene_id", "class", "circle_id", "n", "mu").collect()))
    want = rows(landcover.train_prototypes(focal.feature_vector(b), circles, sizes)[0])
    assert {r[2] for r in want} == {"b", "f", "g", "o"}
    for tile in (9, 256):
        assert _near(rows(landcover.train_from_bands(b, circles, sizes, tile=tile)[0]), want)


def test_shared_variance_by_tiles_equals_columns(spark):
    b, circles = _trained_scene(spark, 14)
    sizes = focal.raster_sizes(b)
    rows = lambda df: sorted(map(tuple, landcover.share_variance(df).select("scene_id", "va").collect()))
    want = rows(landcover.train_prototypes(focal.feature_vector(b), circles, sizes)[1])
    assert len(want) == 2 and max(want[0][1]) > 9
    for tile in (9, 256):
        assert _near(rows(landcover.train_from_bands(b, circles, sizes, tile=tile)[1]), want)


def _one_raster_of_many_sites(spark):
    """Masks of two rasters, options of sites over them, and the same with masks copied for each site."""
    rnd = random.Random(17)
    made = [(r, f"s{k}", float(year), x, y, rnd.random() < 0.6 - 0.1 * k, rnd.random() < 0.2, rnd.random() < 0.1) for r, years in ((1, [2000, 2004, 2010]), (2, [1998, 2006])) for k, year in enumerate(years) for x in range(8) for y in range(6)]
    sets = [(10, 1, "all", "linear", None, 0.0), (11, 1, "prev", "exp", "s1", 2.0), (12, 1, "s1", "last", None, None), (20, 2, "first", "linear", None, 0.0), (1, None, "all", "linear", "s1", 3.0), (99, 7, "all", "linear", None, 0.0)]
    columns = "site_id long, scene_id string, year double, x long, y long, buffer boolean, forest boolean, built boolean"
    options = spark.createDataFrame(sets, "site_id long, raster_id long, base string, model string, start_id string, protect_px double")
    copies = [(s, *row[1:]) for s, of, *_ in sets for row in made if row[0] == (of or s)]
    years = spark.createDataFrame([(t,) for t in (1996.0, 1999.0, 2004.0, 2007.3, 2010.0, 2013.0, 2030.0)], "t double")
    return spark.createDataFrame(made, columns), options, spark.createDataFrame(copies, columns), options.drop("raster_id"), years


def test_frames_of_sites_over_one_raster(spark):
    masks, options, copies, own, years = _one_raster_of_many_sites(spark)
    got = sorted(map(tuple, jobs.frames(masks, years, 1.0, options=options).collect()))
    assert {r[0] for r in got} == {1, 10, 11, 12, 20} and got == sorted(map(tuple, jobs.frames(copies, years, 1.0, options=own).collect()))


def test_frame_pixels_of_sites_over_one_raster(spark):
    masks, options, copies, own, years = _one_raster_of_many_sites(spark)
    got = sorted(map(tuple, jobs.frame_pixels(masks, years, 1.0, options=options).collect()))
    assert {r[0] for r in got} == {1, 10, 11, 12, 20} and got == sorted(map(tuple, jobs.frame_pixels(copies, years, 1.0, options=own).collect()))
