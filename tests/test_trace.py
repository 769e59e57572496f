"""Rings of masks: area and corners of known shapes, refilling of any mask, simplification within a pixel."""

import numpy as np
import pytest

from rasterloom.operators import trace


def mask_of(spark, arrays):
    rows = [(i, int(x), int(y)) for i, a in enumerate(arrays) for y, x in zip(*np.nonzero(a), strict=True)]
    return spark.createDataFrame(rows, "image_id int, x int, y int")


@pytest.fixture(scope="module")
def shapes(spark):
    rng = np.random.default_rng(2)
    y, x = np.indices((40, 50))
    block = np.zeros((40, 50), bool)
    block[3:7, 4:10] = True
    frame = np.zeros((40, 50), bool)
    frame[2:20, 2:30], frame[6:12, 8:20], frame[8:10, 10:12] = True, False, True
    corner = np.zeros((40, 50), bool)
    corner[1:3, 1:3] = corner[3:5, 3:5] = True
    disc = (x - 25) ** 2 + (y - 20) ** 2 <= 15**2
    return [block, frame, corner, disc, rng.random((40, 50)) < 0.5, np.ones((40, 50), bool)]


def test_rings_and_refill(spark, shapes):
    mask = mask_of(spark, shapes)
    rings = trace.rings(mask).cache()
    r = rings.toPandas()
    assert r.groupby("image_id")["area"].sum().to_dict() == {i: int(a.sum()) for i, a in enumerate(shapes)}
    assert sorted(r[r["image_id"] == 0]["points"].iloc[0]) == [(4, 3), (4, 7), (10, 3), (10, 7)] and r[r["image_id"] == 0]["length"].tolist() == [20]
    assert sorted(r[r["image_id"] == 1]["area"]) == [-72, 4, 504]
    assert r[r["image_id"] == 2]["area"].tolist() == [4, 4]  # places that touch at a corner are two rings
    got = sorted(map(tuple, trace.filled(rings).collect()))
    assert got == sorted(map(tuple, mask.collect()))


def test_simplified_within_a_pixel(spark, shapes):
    mask = mask_of(spark, [shapes[3]])
    rings = trace.rings(mask)
    thin = trace.simplified(rings, 0.75).cache()
    assert thin.first()["points"] and len(thin.first()["points"]) < len(rings.first()["points"]) / 2
    out = np.zeros((42, 52), bool)
    for r in trace.filled(thin).collect():
        out[r["y"] + 1, r["x"] + 1] = True
    want = np.pad(shapes[3], 1)
    near = np.zeros_like(want)
    far = np.ones_like(want)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            near |= np.roll(want, (dy, dx), (0, 1))
            far &= np.roll(want, (dy, dx), (0, 1))
    assert not (out & ~near).any() and not (far & ~out).any()


def test_no_places(spark):
    empty = mask_of(spark, [np.zeros((3, 3), bool)])
    assert trace.rings(empty).count() == 0 and trace.filled(trace.rings(empty)).count() == 0


def test_tracer_of_a_colour(spark, sf):
    from rasterloom.plans.pipelines import vectorize_colour
    from rasterloom.sources.fixtures import raster

    d = raster(spark, sf, "scene").where("image_id = 0")
    rings = vectorize_colour(d, "#ffffff", (64, 64), (64, 64), trace.tracer(0.0))
    assert trace.filled(rings).count() == d.where("r = 255 and g = 255 and b = 255").count()


@pytest.mark.parametrize("side", [2, 7, 64])
def test_rings_do_not_depend_on_squares(spark, shapes, side):
    mask = mask_of(spark, [a[:20, :20] for a in shapes])
    same = {(r["image_id"], r["ring"], tuple(map(tuple, r["points"])), r["area"], r["length"]) for r in trace.rings(mask).collect()}
    assert same == {(r["image_id"], r["ring"], tuple(map(tuple, r["points"])), r["area"], r["length"]) for r in trace.rings(mask, side).collect()}


def test_pixels_are_not_dealt_one_by_one(spark, shapes):
    mask = mask_of(spark, shapes)
    plan = trace.chains(mask)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("MapInArrow") > plan.index("Exchange")  # packed before they are dealt
