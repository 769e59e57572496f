"""Tiles against whole images."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import graph, kernels, point, tiles, window

W, H = 120, 88


@pytest.fixture(scope="module")
def image(spark):
    """Two images of 120 x 88: noise in blocks, a spiral-like comb that winds through every tile, and clear places."""
    rng = np.random.default_rng(3)
    y, x = np.indices((H, W))
    parts = []
    for i in range(2):
        block = rng.integers(0, 256, (H // 4 + 1, W // 4 + 1, 3))[y // 4, x // 4]
        comb = (y % 8 < 2) | ((x < 3) & (y // 8 % 2 == 0)) | ((x > W - 4) & (y // 8 % 2 == 1))
        white = comb if i == 0 else rng.random((H, W)) < 0.55
        rgb = np.where(white[..., None], 255, np.minimum(block, 200))
        a = np.where(rng.random((H, W)) < 0.1, 0, 255)
        parts.append(pd.DataFrame({"image_id": i, "x": x.ravel(), "y": y.ravel(), "r": rgb[..., 0].ravel(), "g": rgb[..., 1].ravel(), "b": rgb[..., 2].ravel(), "a": a.ravel()}))
    df = spark.createDataFrame(pd.concat(parts), "image_id int, x int, y int, r int, g int, b int, a int")
    return df.cache()


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(tuple, df.select(*cols).toPandas()[cols].to_numpy().tolist()))


def test_windows_by_tiles(image):
    cases = [
        (lambda d: window.erode_alpha(d, 3), 3), (lambda d: window.feather_alpha(d, 2), 3), (lambda d: window.sharpen(d, 0.25), 1),
        (lambda d: window.decontaminate_edges(point.chromakey_global(d, "#ffffff", 12), "#ffffff", 0.35, 1), 5),
    ]
    for op, halo in cases:
        # operators may treat the border of an image by itself: a tile inside sees its halo there, and only that
        assert rows(tiles.tiled(image, op, halo, 16).select(image.columns)) == rows(op(image).select(image.columns))


def test_a_halo_that_is_too_small_shows(image):
    op = lambda d: window.erode_alpha(d, 3)
    assert rows(tiles.tiled(image, op, 1, 16).select(image.columns)) != rows(op(image).select(image.columns))


@pytest.mark.parametrize("tile", [16, 64, 1024])
def test_labels_by_tiles(image, tile):
    member = F.col("r") == 255
    assert rows(tiles.label_tiled(image, member, tile)) == rows(kernels.label_components(image, member))


def test_flood_by_tiles(image):
    whole = graph.flood_fill(image, "#ffffff", 3).select(image.columns)
    assert rows(graph.flood_fill(image, "#ffffff", 3, tile=16).select(image.columns)) == rows(whole)


def test_no_members_and_no_images(image):
    assert tiles.label_tiled(image, F.lit(False), 16).count() == 0
    assert tiles.label_tiled(image.limit(0), F.lit(True), 16).count() == 0
