"""Pixels are dealt once where an operator needs no more, and what is computed by tiles or images equals the plain form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import aggregate, detect, geometry, graph, kernels, point, window
from rasterloom.plans import pipelines
from rasterloom.sources.fixtures import raster


@pytest.fixture(scope="module")
def image(spark):
    rng = np.random.default_rng(11)
    px = np.where(rng.random((3, 12, 9, 1)) < 0.6, 255, rng.integers(0, 256, (3, 12, 9, 3)))
    rows = [(i, x, y, *map(int, px[i, y, x]), 255) for i in range(3) for y in range(12) for x in range(9)]
    return spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int, a int").localCheckpoint()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def dealt(df):
    """Exchanges by image or polygon."""
    return sum(plan(df).count(f"Exchange hashpartitioning({k}") for k in ("image_id", "poly_id"))


def seeds(df):
    return df.where("r = 255 and image_id <> 1").groupBy("image_id").agg(F.min(F.struct("y", "x")).alias("s")).select("image_id", "s.x", "s.y").toDF("image_id", "sx", "sy")


def test_neighbours_by_tiles(image):
    for out in (window.thicken_lines(image, "#ffffff", 5), window.decontaminate_edges(point.chromakey_global(image, "#ffffff", 12), "#ffffff", 0.35, 1), window.remove_color_global(image, "#ffffff", 3)):
        assert "Window" not in plan(out) and dealt(out) == 1
        assert out.count() == image.count()


def test_one_pass_an_image(image):
    assert dealt(graph.flood_fill(image, "#ffffff", 3, feather=1)) == 1
    assert dealt(graph.smart_erase(image, "#ffffff", 3, 10, 3, 1)) == 1
    finish = {"solid_edges": True, "alpha_threshold": 128, "choke": 1, "despill": True}
    assert dealt(pipelines.trainer_pipeline(image, {"color": "#ffffff", "tolerance": 12, "strategy": "flood", "edge_feather": 1, "finish": finish})) == 2
    known = seeds(image).localCheckpoint().hint("broadcast")
    out = graph.erase_region(image, known, 12, 1)
    assert dealt(out) == 1
    assert out.where("image_id = 1 and a = 0").isEmpty() and out.where("a = 0").select("image_id").distinct().count() == 2


def test_flood_of_a_whole_image_equals_the_steps():
    rng = np.random.default_rng(0)
    for _ in range(100):
        h, w = rng.integers(1, 20, 2)
        tight, fringe, most = rng.random((h, w)) < rng.random(), rng.random((h, w)) < rng.random(), int(rng.integers(0, 4))
        rim = {s: np.zeros(h if s[0] else w, np.int64) for s in ((-1, 0), (1, 0), (0, -1), (0, 1))}
        assert (kernels.flood_depth(tight, fringe, most) == kernels.flood_depth(tight, fringe, most, rim)).all()


def test_polygons_are_dealt_not_places(spark):
    # a bow tie whose spans meet in a place of their own
    pts = [(0, 0), (6, 6), (6, 0), (0, 6)]
    p = spark.createDataFrame([(1, pts), (2, pts[:2]), (3, [(1, 1), (4, 1), (4, 4), (1, 4)])], "poly_id int, points array<struct<x:int,y:int>>")
    out = geometry.polygon_mask(p, 64, 64)
    assert dealt(out.groupBy("poly_id").count()) == 1
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    assert {r for r in rows if r[0] == 1} == {(1, x, y) for y in range(6) for x in range(7) if x <= min(y, 6 - y) or x >= max(y, 6 - y)}
    assert {r[1:] for r in rows if r[0] == 3} == {(x, y) for x in range(1, 5) for y in range(1, 4)}


def test_resampling_deals_pixels_once(image):
    out = geometry.resample(image, (9, 12), (18, 24), "bicubic")
    assert dealt(out) == 1
    assert out.count() == 3 * 18 * 24


def merged(df):
    """Whether pixels meet pixels by sort and merge; a broadcast of them ends the driver, however small their files."""
    return "SortMergeJoin [image_id" in plan(df) and not any("x#" in line for line in plan(df).splitlines() if "BroadcastHashJoin" in line)


@pytest.fixture(scope="module")
def scene(spark, sf):
    return raster(spark, sf, "scene")


def holed(df):
    return df.withColumn("a", F.when(F.col("x") % 2 == 0, 0).otherwise(F.col("a")))


def test_audit_top_broadcasts_no_pixels(scene):
    out = aggregate.audit_top(aggregate.erase_audit(scene, holed(scene)), "edge_frac", 2)
    assert merged(out)
    assert [tuple(r) for r in out.select("image_id", "total_erased", "area").collect()] == [(0, 2048, 4096), (1, 2048, 4096)]


def test_removed_count_broadcasts_no_pixels(scene):
    out = aggregate.removed_count(scene, holed(scene))
    assert merged(out)
    assert {r["removed"] for r in out.collect()} == {2048}


def test_source_type_holds_the_colours(scene):
    d = detect.classified(scene, detect.checker_colours(scene), 576, strict=True)
    joins = [line for line in plan(d).splitlines() if "Join" in line]
    assert "ShuffledHashJoin" in joins[0] and "BuildRight" in joins[0]


def test_erase_audit_broadcasts_no_pixels(scene):
    out = aggregate.erase_audit(scene, scene.withColumn("a", F.when(F.col("x") < 4, 0).otherwise(F.col("a"))))
    assert merged(out)
    assert {(r["total_erased"], r["edge_erased"]) for r in out.collect()} == {(256, 256)}


def test_leakage_broadcasts_no_pixels(scene):
    out = aggregate.leakage(scene, holed(scene))
    assert merged(out)
    white = F.col("r") + F.col("g") + F.col("b") == 765
    want = scene.where(white & (F.col("x") % 2 == 0)).groupBy("image_id").count().collect()
    assert {r["image_id"]: r["removed_bg"] for r in out.collect()} == {r["image_id"]: r["count"] for r in want}


def test_sample_alpha_holds_the_points(spark, scene):
    regions = spark.createDataFrame([("all", 0, 0, 63, 63)], "label string, x0 int, y0 int, x1 int, y1 int")
    out = aggregate.sample_alpha(holed(scene), aggregate.sample_points(scene, regions))
    assert "ShuffledHashJoin [image_id" in plan(out) and not any("x#" in line for line in plan(out).splitlines() if "BroadcastHashJoin" in line)
    assert out.count() == scene.select("image_id").distinct().count()
