"""Scenes that arrive later: only they are computed; ids are distinct."""

import pytest
from pyspark.sql import functions as F

from landfold.plans import queries, upkeep
from landfold.sources import fixtures as X
from landfold.sources import settings

SF = "/root/testdata/sf0.001"


def test_suffixes_are_free(spark):
    have = spark.createDataFrame([(1, "a", 2000.0), (1, "a_1", 2001.0), (1, "b_2", 2003.0), (2, "a", 1990.0)], "site_id long, scene_id string, year double")
    come = [(1, "a", None, 1), (1, "a", 2020.0, 2), (1, "b", None, 3), (1, "b", None, 4), (1, "b", None, 5), (1, "a_3", None, 6), (1, "x_01", None, 7), (2, "a_1", None, 1), (2, "a", None, 2), (2, "a_1", None, 3), (3, "n", None, 1)]
    out = settings.append_scenes(have, spark.createDataFrame(come, "site_id long, scene_id string, year double, arrival int"))
    got = [(r.site_id, r.scene_id, r.year, r.is_new) for r in out.collect()]
    assert len({g[:2] for g in got}) == len(got) == 15
    new = {g[:3] for g in got if g[3]}
    assert new == {(1, "a_2", 2013.0), (1, "a_4", 2020.0), (1, "b", 2033.0), (1, "b_1", 2043.0), (1, "b_3", 2053.0), (1, "a_3", 2063.0), (1, "x_01", 2073.0), (2, "a_1", 2000.0), (2, "a_2", 2010.0), (2, "a_1_1", 2020.0), (3, "n", None)}


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="no tables here")
def test_only_new_scenes_are_computed(spark, tmp_path):
    root, p = str(tmp_path / "state"), queries.SMALL
    bands, scenes, circles, sizes = queries.bands(spark, SF), queries.catalogue(spark, SF), queries.circles(spark, SF), X.sizes(spark, SF)
    runs = lambda: {(r.scene_id, r.run) for r in upkeep.ledger(spark, root).collect()}
    rows = lambda df: sorted(map(tuple, df.drop("run").select("scene_id", "x", "y", "water", "coast", "forest", "sparse", "open", "built").collect()))
    some = "scene_id in ('a', 'b', 'c')"
    first = upkeep.refreshed_classes(root, bands.where(some), scenes.where(some), circles, sizes, p)
    before = rows(first)
    assert runs() == {("a", 0), ("b", 0), ("c", 0), (None, 0)}
    all_of = upkeep.refreshed_classes(root, bands, scenes, circles, sizes, p)
    assert runs() == {("a", 0), ("b", 0), ("c", 0), (None, 0), ("d", 1), ("e", 1)}
    assert [r for r in rows(all_of) if r[0] in "abc"] == before
    # another folder, all at once, with the same water mask: the same classes
    assert rows(all_of) == rows(queries.jobs.land_cover(bands, scenes, circles, sizes, p, spark.read.parquet(f"{root}/water").drop("run")))
    # nothing new; then one scene's parameters change; then a scene is taken away
    assert rows(upkeep.refreshed_classes(root, bands, scenes, circles, sizes, p)) == rows(all_of) and len(runs()) == 6
    changed = scenes.withColumn("params", F.expr("if(scene_id = 'b', map('bias', 2D), params)"))
    upkeep.refreshed_classes(root, bands, changed, circles, sizes, p)
    assert runs() - {("a", 0), ("b", 0), ("c", 0), (None, 0), ("d", 1), ("e", 1)} == {("b", 2)}
    back = upkeep.refreshed_classes(root, bands.where("scene_id <> 'd'"), scenes.where("scene_id <> 'd'"), circles, sizes, p)
    assert len(runs()) == 7 and rows(back) == [r for r in rows(all_of) if r[0] != "d"]
    assert {(r.scene_id, r.run) for r in back.select("scene_id", "run").distinct().collect()} == {("a", 0), ("b", 0), ("c", 0), ("e", 1)}
