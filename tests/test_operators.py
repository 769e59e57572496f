"""Invariants and hand-worked values on small rasters."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import aggregate as A
from rasterloom.operators import geometry as G
from rasterloom.operators import graph as R
from rasterloom.operators import kernels as K
from rasterloom.operators import point as P
from rasterloom.operators import window as N
from rasterloom.sources.fixtures import raster

PIX = ["image_id", "x", "y", "r", "g", "b", "a"]


def make(spark, arrays):
    """Rasters from arrays of (h, w, 4)."""
    rows = [(i, x, y, *map(int, a[y, x])) for i, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int, a int")


def grid(df, col="a", image=0):
    pdf = df.where(F.col("image_id") == image).toPandas()
    out = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1), dtype=int)
    out[pdf["y"], pdf["x"]] = pdf[col]
    return out


def same(a, b):
    key = lambda d: sorted(map(tuple, d.select(*PIX).collect()))
    return key(a) == key(b)


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(3)
    return make(spark, [rng.integers(0, 256, (9, 7, 4)), rng.integers(0, 256, (1, 1, 4))]).cache()


@pytest.fixture(scope="module")
def event(spark, sf):
    return raster(spark, sf, "event")


def test_mirrors_and_rotations_undo(noise):
    assert same(G.mirror_horizontal(G.mirror_horizontal(noise)), noise)
    assert same(G.mirror_vertical(G.mirror_vertical(noise)), noise)
    assert same(G.rotate_ortho(G.rotate_ortho(noise, 90), 270), noise)
    assert same(G.rotate_ortho(G.rotate_ortho(noise, 180), 180), noise)


def test_morphology_order_and_threshold(noise):
    e, d, a = (grid(f) for f in (N.erode_alpha(noise, 1), N.dilate_alpha(noise, 1), noise))
    assert (e <= a).all() and (a <= d).all()
    t = grid(N.alpha_threshold(noise, 128, 1))
    assert set(np.unique(t)) <= {0, 255}


def test_feather_against_numpy(noise):
    a = grid(noise)
    p = np.pad(a, 2, mode="edge")
    want = np.floor(sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(5) for j in range(5)) / 25 + 0.5).astype(int)
    assert (grid(N.feather_alpha(noise, 2)) == want).all()


def test_auto_crop_is_idempotent_and_handles_empty(spark):
    full = np.zeros((5, 6, 4), int)
    full[2:4, 1:3] = (9, 9, 9, 255)
    df = make(spark, [full, np.zeros((3, 3, 4), int)])
    once = G.auto_crop(df)
    assert grid(once).shape == (2, 2) and same(G.auto_crop(once), once)
    assert once.where("image_id = 1").count() == 1


def test_labels_against_search(spark):
    rng = np.random.default_rng(5)
    for _ in range(30):
        m = rng.random((8, 9)) < 0.55
        got = K.label_array(m)
        want = np.full(m.shape, -1)
        for y in range(8):
            for x in range(9):
                if m[y, x] and want[y, x] < 0:
                    todo = [(y, x)]
                    want[y, x] = y * 9 + x
                    while todo:
                        v, u = todo.pop()
                        for b, a in ((v + 1, u), (v - 1, u), (v, u + 1), (v, u - 1)):
                            if 0 <= b < 8 and 0 <= a < 9 and m[b, a] and want[b, a] < 0:
                                want[b, a] = y * 9 + x
                                todo.append((b, a))
        assert (got == want).all()


def test_chamfer_against_formula():
    rng = np.random.default_rng(6)
    s = rng.random((12, 15)) < 0.05
    s[3, 4] = True
    ys, xs = np.nonzero(s)
    y, x = np.indices(s.shape)
    dx, dy = np.abs(x[..., None] - xs), np.abs(y[..., None] - ys)
    want = (3 * (np.maximum(dx, dy) - np.minimum(dx, dy)) + 4 * np.minimum(dx, dy)).min(axis=2) // 3
    assert (K.chamfer(s, 200) == want).all()


def test_depth_flood_without_steps_is_the_tight_flood(event):
    a = R.smart_erase(event, "#ffffff", 40, 40, 0)
    b = R.flood_fill(event, "#ffffff", 40)
    assert same(a, b)


def test_smart_erase_keeps_the_design(spark):
    """White ground, anti-aliased edge, enclosed white: no deep leak, all the design stays."""
    y, x = np.indices((60, 60))
    d = np.hypot(x - 30, y - 30)
    img = np.full((60, 60, 4), 255)
    ring = (d < 22) & (d > 10)
    img[ring] = (200, 40, 90, 255)
    img[(d >= 22) & (d < 23)] = (250, 245, 247, 255)
    df = make(spark, [img])
    out = R.smart_erase(df, "#ffffff", 3, 10, 3)
    r = A.leakage(df, out).first()
    assert r["leaked_deep"] == 0 and r["preserved"] >= 0.99 and r["removed_bg"] > 1500
    assert grid(out)[30, 30] == 255  # the enclosed white stays


def test_enclosed_holes_by_wall(spark, sf):
    rings = raster(spark, sf, "rings")
    gone = {r["image_id"]: r["erased"] for r in R.enclosed_blobs(rings, "#ffffff", 3, 12)[1].collect()}
    assert gone == {6: True, 14: False, 40: False}


def test_mask_algebra(event):
    a, b = event.where("g > 90").select("image_id", "x", "y"), event.where("r > 90").select("image_id", "x", "y")
    n = lambda d: d.count()
    assert n(R.mask_or(a, b)) == n(a) + n(b) - n(R.mask_and(a, b))
    assert n(R.mask_except(a, b)) == n(a) - n(R.mask_and(a, b))


def test_kernel_and_relational_resampling_agree(event):
    a = G.resample(event, (16, 16), (24, 20))
    assert same(a, K.resample_images(event, 24, 20))


def test_identities(event):
    assert P.brightness_contrast(event, 0, 0) is event and P.warmth(event, 0) is event and G.resample(event, (16, 16), (16, 16)) is event
    assert same(P.invert(P.invert(event)), event)


def test_live_wire_prefers_the_cheap_row():
    cost = np.ones((7, 40))
    cost[6] = 0.05
    path = K.live_wire(cost, (0, 0), (39, 0))
    assert path[0] == (0, 0) and path[-1] == (39, 0) and any(y == 6 for _, y in path)
    assert K.live_wire(cost, (2, 2), (2, 2)) == [(2, 2)]


def test_rotation_kernel_agrees_at_right_angles():
    rng = np.random.default_rng(1)
    img = rng.integers(1, 255, (5, 8, 4)).astype(float)
    img[..., 3] = 255
    got = K.rotate_array(img, 90)
    want = np.rot90(img, -1)
    assert np.abs(np.stack([got[c] for c in "rgb"], 2) - want[..., :3]).max() <= 1


def test_shadow_and_resize_shapes():
    img = np.full((6, 4, 4), 255.0)
    s = K.shadow_array(img, 3, -2, 1.5, (0, 0, 0), 0.5)
    assert s["a"].shape == (6 + 2 * 5, 4 + 2 * 6)
    assert K.resize_array(img, 10, 6, "contain").shape == (6, 10, 4)
    assert (K.resize_array(img, 10, 6, "contain")[:, 0, 3] == 0).all() and (K.resize_array(img, 10, 6, "cover")[..., 3] == 255).all()


def test_acrylic_layout_and_paint():
    at = K.acrylic_layout(100, 150)
    assert (at["panel_w"], at["panel_h"], at["out_h"], at["design_w"]) == (576, 864, 864 + 207, 504)
    assert K.acrylic_array(np.full((6, 4, 4), 128.0), out_width=240, padding=12).shape[1] == 240


def test_background_of_an_invisible_image(spark):
    df = make(spark, [np.zeros((2, 2, 4), int)])
    assert A.analyze_background(df).first()["color"] == "#040404"


def test_grow_stops_at_the_limit():
    flat = np.full((5, 5, 3), 9.0)
    one = np.ones((5, 5))
    assert K.grow_from(flat, one * 255, one, (2, 2), 28, 0.55, 4).sum() == 5  # the limit is looked at before each place, not each neighbour
    assert K.grow_from(flat, one * 0, one, (2, 2), 28, 0.55, 99).sum() == 0


def test_debug_overlay(event):
    boxes = event.select("image_id").distinct().select("image_id", F.lit(1).alias("min_x"), F.lit(2).alias("min_y"), F.lit(5).alias("max_x"), F.lit(6).alias("max_y"), F.lit("text").alias("verdict"))
    out = grid(K.debug_overlay(event, boxes), "g")
    assert (out[2, 1:6] == 200).all() and (out[2:7, 1] == 200).all()


def test_rows_pandas_unused():
    assert isinstance(K.rows_of(1, {"v": np.zeros((2, 2))}), pd.DataFrame)


def test_turned_levels_at_a_half_round_as_their_sql_says():
    import numpy as np

    from rasterloom.operators import kernels

    sx, sy = kernels.rotated_from(np.array(3.0), np.array(5.0), 16, 16, 30)
    c, s = np.cos(np.radians(30.0)), np.sin(np.radians(30.0))
    assert sx == (3 + 0.5 - 11) * c + (5 + 0.5 - 11) * s + 7.5 and sy == -(3 + 0.5 - 11) * s + (5 + 0.5 - 11) * c + 7.5


def test_text_colours_deal_only_the_places_of_a_colour(spark):
    from rasterloom import queries
    from rasterloom.operators import detect

    plan = detect.detect_text_colours(queries._ink(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and "strategy=shuffle_hash" in plan
