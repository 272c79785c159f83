"""Saved settings over default ones: versions, partial documents, and a round trip."""

import json

import pytest

from landfold.sources import settings

RING = [{"x": 1.0, "y": 1.0}, {"x": 5.0, "y": 1.0}, {"x": 5.0, "y": 5.0}]
DEFAULT = {
    "display": {"opacity": "0.45"}, "buffer": {"edgeBandM": 100.0, "forestNearM": 40.0}, "sim": {"seed": "1"}, "settlement": {"autoM": 0.0}, "coastBandM": 35.0, "photoOffset": {"dxM": 0.0, "dyM": 0.0},
    "samples": {"shared": {"forest": [{"x": 1.0, "y": 2.0, "r": 3}]}, "byScene": {}}, "houses": [{"x": 9.0, "y": 9.0}], "housesByScene": {"a": [{"x": 8.0, "y": 8.0}]}, "polygons": {"aoi": [RING], "exclusion": [RING]},
}


def frame(spark, docs):
    return spark.read.schema(settings.SAVED).json(spark.sparkContext.parallelize([json.dumps(d) for d in docs]))


def merged(spark, saved):
    base = frame(spark, [{"site_id": 1, **DEFAULT}, {"site_id": 2, **DEFAULT}]).select("site_id", *settings.SITE)
    rows = settings.merge_site_settings(base, frame(spark, saved), 4).collect()
    return {r["site_id"]: r.asDict(recursive=True) for r in rows}


def test_only_what_is_saved_changes(spark):
    got = merged(spark, [{"site_id": 1, "settingsVersion": 4, "display": {"showLost": "true"}, "houses": [], "photoOffset": {"dyM": 2.0}}])
    assert got[1]["display"] == {"opacity": "0.45", "showLost": "true"} and got[1]["houses"] == [] and got[1]["photoOffset"] == {"dxM": 0.0, "dyM": 2.0}
    for name in ("buffer", "sim", "settlement", "coastBandM", "samples", "housesByScene", "polygons"):
        assert got[1][name] == DEFAULT[name], name
    assert not got[1]["migrated"] and not got[2]["migrated"]
    assert {c: got[2][c] for c in settings.SITE} == DEFAULT


@pytest.mark.parametrize("version", [4, 3, None])
def test_drawn_elements_survive_another_version(spark, version):
    saved = {"site_id": 1, "settingsVersion": version, "buffer": {"edgeBandM": 7.0, "forestNearM": None}, "coastBandM": 1.0, "settlement": {"autoM": 5.0}, "sim": {"seed": None}}
    saved |= {"samples": {"shared": {}, "byScene": {"b": {"open": [{"x": 4.0, "y": 4.0, "r": None}]}}}, "housesByScene": {}, "polygons": {"exclusion": [], "settlement": [RING]}}
    got, same = merged(spark, [saved])[1], version == 4
    assert got["migrated"] is not same
    assert got["buffer"] == {"edgeBandM": 7.0 if same else 100.0, "forestNearM": 40.0}
    assert (got["coastBandM"], got["settlement"], got["sim"]) == ((1.0, {"autoM": 5.0}, {"seed": None}) if same else (35.0, {"autoM": 0.0}, {"seed": "1"}))
    assert got["samples"] == saved["samples"] and got["housesByScene"] == {} and got["houses"] == DEFAULT["houses"]
    assert got["polygons"] == {"exclusion": [], "settlement": [RING], **({} if same else {"aoi": [RING]})}


def test_export_is_read_back_whole(spark):
    """Sites and scenes come back as they were; what a site lacks clears the default's; scenes without a file are left out."""
    scenes = spark.createDataFrame([(1, "a", "a.png", 1990.0, "A", True, {"bias": 2.0}), (1, "b", None, 2000.0, "B", False, None), (2, "a", "a.png", None, None, False, {})], "site_id long, scene_id string, file string, year double, label string, estimated boolean, params map<string,double>")
    runs = spark.createDataFrame([(1, "a", [0, 5, 1, 2])], "site_id long, scene_id string, runs array<bigint>")
    sites = frame(spark, [{"site_id": 1, **DEFAULT}, {"site_id": 2}]).select("site_id", *settings.SITE)
    texts = [r["json"] for r in settings.export_settings(scenes, runs, 4, sites).orderBy("site_id").collect()]
    back = frame(spark, [json.loads(t) for t in texts])
    first, second = (r.asDict(recursive=True) for r in back.orderBy("site_id").collect())
    assert {c: first[c] for c in settings.SITE} == {**DEFAULT, "polygons": {**DEFAULT["polygons"], "settlement": []}}
    assert first["scenes"] == [{"id": "a", "file": "a.png", "year": 1990.0, "label": "A", "estimated": True, "params": {"bias": 2.0}, "correction": [0, 5, 1, 2]}]
    assert [s["id"] for s in second["scenes"]] == ["a"] and second["houses"] == [] and second["polygons"] == {"settlement": [], "exclusion": []}
    scene = {(r.site_id, r.scene_id): r for r in settings.merge_settings(scenes.withColumn("estimated", ~scenes.estimated), back, 4).collect()}
    assert scene[1, "a"].estimated and scene[1, "a"].correction == [0, 5, 1, 2] and scene[1, "b"].estimated and scene[1, "b"].correction is None
    tables = settings.drawn_tables(back)
    assert (tables["samples"].count(), tables["houses"].count(), tables["polygons"].count()) == (1, 2, 6)
