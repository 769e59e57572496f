"""Packed tiles against the pixel form and the whole-image kernels."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.operators import geometry, graph, kernels, packed, window

W, H = 93, 70


@pytest.fixture(scope="module")
def image(spark):
    rng = np.random.default_rng(5)
    y, x = np.indices((H, W))
    parts = []
    for i in range(2):
        rgb = rng.integers(0, 256, (H // 3 + 1, W // 3 + 1, 3))[y // 3, x // 3]
        a = np.where(rng.random((H, W)) < 0.2, rng.integers(0, 256, (H, W)), np.where((x // 9 + y // 7) % 3 == 0, 0, 255))
        parts.append(pd.DataFrame({"image_id": i, "x": x.ravel(), "y": y.ravel(), "r": rgb[..., 0].ravel(), "g": rgb[..., 1].ravel(), "b": rgb[..., 2].ravel(), "a": a.ravel()}))
    return spark.createDataFrame(pd.concat(parts), "image_id long, x int, y int, r int, g int, b int, a int").cache()


@pytest.fixture(scope="module")
def tiles(image):
    return packed.pack(image, tile=32).cache()


def rows(df, cols=("image_id", "x", "y", "r", "g", "b", "a"), digits=None):
    p = df.select(*cols).toPandas().sort_values(["image_id", "x", "y"])[list(cols)].to_numpy(dtype=float)
    return p if digits is None else p.round(digits)


def same(a, b, digits=None, cols=("image_id", "x", "y", "r", "g", "b", "a")):
    a, b = rows(a, cols, digits), rows(b, cols, digits)
    assert a.shape == b.shape and (a == b).all(), (a != b).sum()


def test_round_trip(image, tiles):
    same(packed.unpack(tiles), image)
    sizes = {(r["tx"], r["ty"]): len(r["data"]) for r in tiles.where("image_id = 0").collect()}
    assert sizes[0, 0] == 32 * 32 * 4 and sizes[2, 2] == (W - 64) * (H - 64) * 4 and len(sizes) == 9


def test_images_are_cut_without_pixels(image, tiles):
    from rasterloom.sources.images import from_pixels

    cut = packed.cut_images(from_pixels(image), 32)
    key = ["image_id", "tx", "ty"]
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, tiles.collect())) and cut.select(*key).distinct().count() == 18


@pytest.mark.parametrize("radius", [1, 5, 31, 40])
def test_minima_and_maxima(image, tiles, radius):
    same(packed.unpack(packed.erode_alpha(tiles, radius)), window.erode_alpha(image, radius))
    same(packed.unpack(packed.dilate_alpha(tiles, radius)), window.dilate_alpha(image, radius))


def test_filters(image, tiles):
    same(packed.unpack(packed.feather_alpha(tiles, 4)), window.feather_alpha(image, 4))
    same(packed.unpack(packed.sharpen(tiles, 0.25)), window.sharpen(image, 0.25))
    same(packed.unpack(packed.edge_map(tiles), ("cost",), "f8", "double"), window.edge_map(image), 12, ("image_id", "x", "y", "cost"))
    same(packed.unpack(packed.edge_aware_sharpen(tiles)), window.edge_aware_sharpen(image))
    flat = packed.pack(image.withColumns({c: F.lit(7) for c in "rgb"}), tile=32)
    assert packed.unpack(packed.edge_map(flat), ("cost",), "f8", "double").where("cost <> 1").count() == 0


def test_chamfer(image, tiles):
    sparse = image.withColumn("a", F.when((F.col("x") == 3) & (F.col("y") == 60), 0).otherwise(255))
    for src, cap in ((image, 20), (sparse, 12), (sparse, 200)):
        got = packed.unpack(packed.chamfer(packed.pack(src, tile=32), lambda px: px[..., 3] == 0, cap), ("dist",), "<i4")
        same(got, graph.chamfer_distance(src, F.col("a") == 0, cap), cols=("image_id", "x", "y", "dist"))


@pytest.mark.parametrize("degrees", [17.5, 90, 133, -45, 270, 359])
def test_rotation(image, tiles, degrees):
    whole = kernels.rotate_degrees(image, degrees) if degrees % 90 else geometry.rotate_ortho(image, degrees)
    got, want = packed.unpack(packed.rotate_degrees(tiles, degrees)), whole
    if degrees % 90 == 0:  # hidden colours go with the premultiplied bytes
        got, want = [d.withColumns({c: F.when(F.col("a") == 0, 0).otherwise(F.col(c)) for c in "rgb"}) for d in (got, want)]
    same(got, want)


@pytest.mark.parametrize(("w", "h", "name"), [(200, 150, "lanczos3"), (40, 31, "lanczos3"), (93, 140, "bicubic"), (7, 9, "bilinear"), (64, 64, "lanczos2")])
def test_resampling(image, tiles, w, h, name):
    same(packed.unpack(packed.resample(tiles, w, h, name)), kernels.resample_images(image, w, h, name))


@pytest.mark.parametrize("fit", ["stretch", "contain", "cover"])
@pytest.mark.parametrize(("w", "h"), [(20, 11), (90, 40), (150, 300), (5, 5)])
def test_resizing(image, tiles, w, h, fit):
    same(packed.unpack(packed.resize(tiles, w, h, fit)), kernels.resize_images(image, w, h, fit))


@pytest.mark.parametrize(("dx", "dy", "blur"), [(3, -4, 5.0), (0, 0, 0.0), (-20.4, 17.6, 9.0)])
def test_shadow(image, tiles, dx, dy, blur):
    same(packed.unpack(packed.drop_shadow(tiles, dx, dy, blur, "#203040", 0.6)), kernels.drop_shadow(image, dx, dy, blur, "#203040", 0.6))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=40), st.integers(0, 50))
def test_running_minimum(values, r):
    a = np.array(values, dtype=np.uint8)
    cut = [a[max(0, i - r) : i + r + 1] for i in range(len(a))]
    assert kernels.running(a, r, 0, np.minimum).tolist() == [int(c.min()) for c in cut]
    assert kernels.running(a, r, 0, np.maximum).tolist() == [int(c.max()) for c in cut]
    assert packed.box_sum(a, r, 0, "constant").tolist() == [int(c.sum()) for c in cut]
    p = np.pad(a, r, mode="edge").astype(int)
    assert packed.box_sum(a, r, 0, "edge").tolist() == [int(p[i : i + 2 * r + 1].sum()) for i in range(len(a))]


def test_resampling_of_low_alpha_equals_the_relational_form(spark):
    """Colours are divided by alpha before they are rounded, in both forms."""
    rng = np.random.default_rng(1)
    y, x = np.indices((16, 16))
    df = pd.DataFrame({"image_id": 1, "x": x.ravel(), "y": y.ravel(), **{c: rng.integers(0, 256, 256) for c in "rgb"}, "a": rng.choice([0, 0, 1, 2, 255], 256)})
    d = spark.createDataFrame(df, "image_id long, x int, y int, r int, g int, b int, a int")
    for n, name in ((40, "bilinear"), (7, "bilinear"), (24, "lanczos2")):
        same(kernels.resample_images(d, n, n, name), geometry.resample(d, (16, 16), (n, n), name))


def test_sums_by_tiles_on_images_whose_checksums_leave_an_int(spark):
    from rasterloom import queries

    far = spark.createDataFrame([(0, 0, 0, 1, 2, 3, 4), (0, 3, 40_000, 255, 255, 255, 255), (0, 2, 39_999, 9, 9, 9, 9)], "image_id int, x int, y int, r int, g int, b int, a int")
    want = {r["band"]: r["checksum"] for r in queries.banded(far).collect()}
    assert want[625] == (3 * 31 + 40_000 * 17 + 1) * 255 * 26 > 2**31
    got = {r["band"]: (r["n"], r["checksum"]) for r in queries.banded_tiles(packed.pack(far, tile=32)).collect()}
    assert {k: v[1] for k, v in got.items() if v[1]} == want and sum(n for n, _ in got.values()) == 4 * 40_001


def test_a_long_image_is_turned_without_its_clear_tiles(spark):
    rows = [(0, x, y, 200, y % 256, x, 255) for y in range(400) for x in range(8)]
    tiles = packed.pack(spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int, a int"), tile=16)
    from rasterloom import queries

    whole, few = packed.rotate_degrees(tiles, 30), packed.rotate_degrees(tiles, 30, sparse=True)
    assert few.count() < whole.count() / 3
    assert sorted(queries.banded_tiles(whole).collect()) == sorted(queries.banded_tiles(few).collect())


def test_a_far_reduction_holds_partial_sums(spark):
    rng = np.random.default_rng(7)
    px = rng.integers(0, 256, (900, 12, 4))
    y, x = np.indices(px.shape[:2])
    df = spark.createDataFrame(pd.DataFrame({"image_id": 0, "x": x.ravel(), "y": y.ravel()} | {c: px[..., i].ravel() for i, c in enumerate("rgba")}), "image_id int, x int, y int, r int, g int, b int, a int")
    tiles = packed.pack(df, tile=16)
    got = packed.unpack(packed.resample(tiles, 7, 5)).toPandas().sort_values(["y", "x"])
    assert (got[list("rgba")].to_numpy().reshape(5, 7, 4) == kernels.resample_array(px.astype(float), 7, 5)).all()


def test_mosaic_tiles_are_those_of_its_pixels(spark, sf):
    from rasterloom.sources import fixtures

    made = fixtures.mosaic_tiles(spark, sf, 64)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, packed.pack(fixtures.raster(spark, sf, "mosaic"), tile=64).collect()))
