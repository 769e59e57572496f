"""Registered queries beside their SQL, on the smallest tables; one of each family here, all of them by verify.py."""

import duckdb
import pytest

import __spark_entry__ as entry
from rasterloom import queries as raster
from verify import TABLES, canon

PICKED = [
    "alpha_stats_event", "analyze_background_scene", "detect_image_type_event", "auto_levels_embed", "feather_alpha_event", "convolution_event", "edge_map_event", "thicken_scene", "decontaminate_scene", "outline_event",
    "restore_color_scene", "resample_bicubic_event", "resize_contain_event", "resize_cover_event", "edge_map_tiles_mosaic", "erode_wide_mosaic", "rotate_tiles_event", "resize_cover_tiles_event", "drop_shadow_tiles_event", "chamfer_tiles_event", "depth_flood_tiles_scene", "live_wire_tiles_event", "trace_rings_scene", "trace_refill_scene", "audit_report", "handle_tap_restore_scene", "restore_color_scaled_event", "critique_fold_several_orders", "edit_text_layers", "polygon_mask_part", "flood_fill_scene", "smart_erase_scene", "enclosed_holes_scene", "erase_region_scene", "click_to_grow_scene", "component_features_scene", "checker_detect",
    "remove_checker", "compose_overlays_event", "enhance_photo_scene", "trainer_pipeline_scene", "critique_parse_documents", "critique_apply_orders", "consensus_preset_lineitem", "preset_parse", "history_push_events", "png_round_trip_event",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", PICKED)
def test_against_sql(spark, sf, duck, name):
    got, want = raster.queries()[name](spark, sf).toPandas(), duck.sql(raster.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5
