"""What is computed once, and what is not dealt: sums over tiles, an image's greatest gradient, tiles of the scenes."""

import numpy as np

from rasterloom.operators import packed as P
from rasterloom.sources import fixtures as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_take_tiles_to_python_once(spark, sf):
    tiles = P.edge_map(X.tiles(spark, sf, "event", 8))
    sums = P.row_sums(tiles, lambda px, x, y: np.ones(px.shape[:2]), 64, dtype="f8", channels=1)
    assert "MapInArrow" not in plan(sums)  # two of them before: the tiles were computed again for their images' sizes
    assert {tuple(r) for r in sums.select("band", "n", "total").collect()} == {(0, 256, 256)}


def test_greatest_gradient_goes_to_the_regions(spark, sf):
    assert "BroadcastHashJoin" in plan(P._with_top(X.tiles(spark, sf, "event", 8), 1, "edge-regions"))


def test_tiles_come_in_small_batches(spark, sf):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    X.tiles(spark, sf, "event", 16)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"


def test_scene_tiles_are_those_of_the_pixels(spark, sf):
    for tile in (32, 48):
        made = X.scene_tiles(spark, sf, tile)
        assert plan(made).count("Exchange") == 1  # of discs
        got = {tuple(r) for r in made.select(*P.KEYS, "data").collect()}
        assert got == {tuple(r) for r in P.pack(X.raster(spark, sf, "scene"), tile=tile).select(*P.KEYS, "data").collect()}
