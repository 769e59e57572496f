"""Values that spread over tiles against the whole-image kernels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import graph, kernels, packed, relax, window

W, H = 60, 45


@pytest.fixture(scope="module")
def maze(spark):
    """White corridors that wind through every tile, of exact and of nearly white places, and noise."""
    rng = np.random.default_rng(9)
    y, x = np.indices((H, W))
    parts = []
    for i in range(2):
        comb = (y % 6 < 2) | ((x < 3) & (y // 6 % 2 == 0)) | ((x > W - 4) & (y // 6 % 2 == 1)) if i == 0 else rng.random((H, W)) < 0.62
        if i == 0:
            comb[0, :] = comb[:, 0] = comb[-1, :] = comb[:, -1] = False
            comb[1, 0] = True
        soft = rng.random((H, W)) < 0.1
        v = np.where(comb, np.where(soft, 235, 255), 30)
        parts.append(pd.DataFrame({"image_id": i, "x": x.ravel(), "y": y.ravel(), "r": v.ravel(), "g": v.ravel(), "b": v.ravel(), "a": 255}))
    return spark.createDataFrame(pd.concat(parts), "image_id long, x int, y int, r int, g int, b int, a int").cache()


@pytest.mark.parametrize("steps", [0, 3])
def test_depth_flood(maze, steps):
    got = packed.unpack(relax.depth_flood(packed.pack(maze, tile=20), "#ffffff", 3, 12, steps), ("depth",), "<i4").where("depth >= 0")
    want = graph.depth_flood(maze, "#ffffff", 3, 12, steps)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 300


def test_cheapest_paths(spark, maze):
    cost = maze.select("image_id", "x", "y", F.when(F.col("r") > 200, 0.05 + F.col("x") % 3 * 0.1).otherwise(1.0).alias("cost"))
    wants = [(0, 2, 1, 57, 43), (1, 30, 20, 0, 0)]
    req = spark.createDataFrame(wants, "image_id long, sx int, sy int, x int, y int")
    rows = relax.cheapest_paths(packed.pack(cost, ("cost",), "f8", tile=20), req).collect()
    for i, sx, sy, x, y in wants:
        path = [(r["x"], r["y"]) for r in sorted(rows, key=lambda r: -r["step"]) if r["image_id"] == i]
        plane = kernels.dense(cost.where(F.col("image_id") == i).toPandas(), ("cost",))[..., 0]
        assert path == kernels.live_wire(plane, (sx, sy), (x, y))


def test_one_tile_and_no_way(spark):
    d = spark.createDataFrame([(1, x, y, 0.5) for x in range(4) for y in range(3)], "image_id long, x int, y int, cost double")
    req = spark.createDataFrame([(1, 0, 0, 3, 2), (2, 0, 0, 1, 1)], "image_id long, sx int, sy int, x int, y int")
    got = relax.cheapest_paths(packed.pack(d, ("cost",), "f8"), req).orderBy("step").collect()
    assert [(r["x"], r["y"]) for r in got][::-1] == kernels.live_wire(np.full((3, 4), 0.5), (0, 0), (3, 2))


def test_costs_of_an_edge_map(spark, maze):
    """From pixels to a path, all on tiles."""
    tiles = packed.pack(maze, tile=20)
    req = spark.createDataFrame([(0, 5, 5, 50, 40)], "image_id long, sx int, sy int, x int, y int")
    edge = packed.edge_map(tiles)
    got = relax.cheapest_paths(edge, req).collect()
    plane = kernels.dense(window.edge_map(maze).where("image_id = 0").toPandas(), ("cost",))[..., 0]
    want = kernels.live_wire(plane, (5, 5), (50, 40))
    assert [(r["x"], r["y"]) for r in sorted(got, key=lambda r: -r["step"])] == want
