"""Queries against their SQL in DuckDB on the smallest tables. ALL_QUERIES=1 runs every one."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from landfold.plans.oracles import ORACLES
from landfold.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SOME = [
    "forest_area_trend", "read_scene_images", "write_and_read_pixels", "regrid_nearest", "read_scene_config", "merge_settings", "merge_site_settings", "export_settings", "resolve_params", "read_photos", "write_area_table", "write_gps_listing",
    "append_scenes", "overlay_rgba", "focal_std", "morph_close", "remove_small_regions", "distance_transform", "upper_median", "otsu_threshold", "polygon_mask", "settlement_mask", "nearest_within",
    "apply_corrections", "water_votes", "prototype_scores", "decide_class", "clean_classes", "buffer_band", "lost_vs_base", "build_intervals", "frame_summary", "fit_trend", "removal_order", "rle_encode", "gps_listing", "tag_counts",
    "water_mask", "classify_scene", "buffer_zone", "buffer_area_per_year", "within_distance", "region_labels", "rle_runs", "frame_bases",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows(frame: pd.DataFrame) -> list[tuple]:
    plain = lambda v: "~" if v is None or pd.isna(v) is True else round(float(v), 6) if isinstance(v, float) else v
    cells = lambda row: tuple(plain(v.item() if hasattr(v, "item") else v) for v in row)
    return sorted((cells(r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("ALL_QUERIES") else SOME)
def test_equal_rows(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_whole_job_on_ten_rows(spark):
    area = QUERIES["buffer_area_per_year"](spark, SF).toPandas()
    assert len(area) == 5 and (area["land"] > 0).all()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
