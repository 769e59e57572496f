"""Connectivity: labels from the per-image kernel, everything else as aggregates and joins over them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from .aggregate import sized, with_size
from .kernels import chamfer, dense, flood_depth, grow_from, label_array, per_image, rows_of, running, walled_blobs
from .tiles import columns_by_image, label_tiled
from .window import dealt, decontaminate_edges, edge_map, feather_alpha

import numpy as np  # noqa: E402

KEY = ["image_id", "x", "y"]


def _erase(df: DataFrame, gone: DataFrame) -> DataFrame:
    """a = 0 at the places of ``gone``."""
    return df.join(gone.select(*KEY).withColumn("gone", F.lit(True)), KEY, "left").withColumn("a", F.when(F.col("gone"), 0).otherwise(F.col("a"))).drop("gone")


def _seen(df: DataFrame, **flags: Column) -> DataFrame:
    """``df`` with flags as columns of 0 and 1 for a kernel."""
    return df.withColumns({f"__{n}": F.coalesce(v.cast("int"), F.lit(0)) for n, v in flags.items()})


def _feathered(a: np.ndarray, radius: float) -> np.ndarray:
    from .packed import box_mean

    r = int(math.floor(radius + 0.5))
    return box_mean(a, r) if radius > 0 else a


def flood_fill(df: DataFrame, color: str, tolerance: float, *, tile: int | None = None, feather: float = 0) -> DataFrame:
    """Erases matching visible pixels that are 4-connected to the border; by tiles of that side, for images too large for a task.

    ``feather`` is the radius of ``feather_alpha`` after it.
    """
    member = (F.col("a") != 0) & (C.dist_sq(color) <= C.max_dist_sq(tolerance))
    if tile is None:

        def run(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
            label = label_array(p["__m"] == 1)
            rim = np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]])
            gone = (label >= 0) & np.isin(label, rim)
            return {"a": _feathered(np.where(gone, 0, p["a"]), feather)}

        return columns_by_image(_seen(df, m=member), ["a", "__m"], ["a"], run).select(df.columns)
    labels = label_tiled(df, member, tile)
    d = labels.join(sized(df), "image_id")
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("w") - 1) | (F.col("y") == F.col("h") - 1)
    touching = d.where(border).select("image_id", "label").distinct()
    out = _erase(df, labels.join(touching, ["image_id", "label"], "left_semi"))
    return feather_alpha(out, feather) if feather > 0 else out


def depth_flood(df: DataFrame, color, tight, fringe, steps: int) -> DataFrame:
    """image_id, x, y, depth of the places that the flood reaches: 0 on tight pixels, parent + 1 on fringe ones."""
    d = df.select(*KEY, (C.dist_sq(color) <= C.max_dist_sq(tight)).cast("int").alias("t"), (C.dist_sq(color) <= C.max_dist_sq(fringe)).cast("int").alias("f"), (F.col("a") != 0).cast("int").alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = dense(pdf, ("t", "f", "v")).astype(bool)
        depth = flood_depth(p[..., 0] & p[..., 1] & p[..., 2], p[..., 1] & p[..., 2], steps)
        out = rows_of(pdf["image_id"].iat[0], {"depth": depth})
        return out[out["depth"] >= 0]

    return per_image(d, run, "image_id long, x int, y int, depth int")


def smart_erase(df: DataFrame, color, tight=3, fringe=10, steps: int = 3, feather: float = 0) -> DataFrame:
    """Erases what ``depth_flood`` reaches; ``feather`` is the radius of ``feather_alpha`` after it."""
    near = C.dist_sq(color) <= C.max_dist_sq(fringe)
    d = _seen(df, t=(F.col("a") != 0) & near & (C.dist_sq(color) <= C.max_dist_sq(tight)), f=(F.col("a") != 0) & near)

    def run(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {"a": _feathered(np.where(flood_depth(p["__t"] == 1, p["__f"] == 1, steps) >= 0, 0, p["a"]), feather)}

    return columns_by_image(d, ["a", "__t", "__f"], ["a"], run).select(df.columns)


def wall_distance(df: DataFrame, cap: int) -> DataFrame:
    """Adds dist: steps to the nearest transparent (a < 128) pixel, null beyond the cap.

    Along a shortest path to the nearest one all pixels are opaque, so the distance is plain L1: nearest in the row
    by windows, then the least of |dy| + row distance in the column.
    """
    from pyspark.sql import Window as W

    from .window import along_x, along_y

    d = dealt(df)
    back, ahead = along_x().rowsBetween(W.unboundedPreceding, 0), along_x().rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col("a") < 128, F.col("x"))
    d = d.withColumns({"l": F.max(at).over(back), "r_": F.min(at).over(ahead)})
    d = d.withColumn("row", F.least(F.col("x") - F.col("l"), F.col("r_") - F.col("x")))
    up, down = along_y().rowsBetween(W.unboundedPreceding, 0), along_y().rowsBetween(0, W.unboundedFollowing)
    d = d.withColumns({"u": F.min(F.col("row") - F.col("y")).over(up) + F.col("y"), "d_": F.min(F.col("row") + F.col("y")).over(down) - F.col("y")})
    d = d.withColumn("dist", F.least("u", "d_"))
    return d.withColumn("dist", F.when(F.col("dist") <= cap, F.col("dist"))).select(*df.columns, "dist")


def enclosed_blobs(df: DataFrame, color: str, tolerance: float = 3, max_wall: int = 12) -> tuple[DataFrame, DataFrame]:
    """(labels of matching pixels, image_id, label, size, wall, erased): a blob goes if its wall is 1..max_wall thick."""
    kind = F.when(F.col("a") < 128, 0).when(C.dist_sq(color) <= C.max_dist_sq(tolerance), 2).otherwise(1)
    labels = walled_blobs(df.select(*KEY, kind.alias("kind")), max_wall + 2)
    blobs = labels.groupBy("image_id", "label").agg(F.count("*").alias("size"), F.min("wall").alias("wall"))
    return labels, blobs.withColumn("erased", (F.col("wall") > 0) & (F.col("wall") <= max_wall))


def remove_enclosed_holes(df: DataFrame, color: str, tolerance: float = 3, max_wall: int = 12, decontaminate: bool = True) -> DataFrame:
    labels, _ = enclosed_blobs(df, color, tolerance, max_wall)
    out = _erase(df, labels.where((F.col("wall") > 0) & (F.col("wall") <= max_wall)))
    return decontaminate_edges(out, color, 0.4, 1, 3) if decontaminate else out


def erase_region(df: DataFrame, seeds: DataFrame, tolerance: float = 12, fringe: int = 1) -> DataFrame:
    """Erases the seed's component of like colour, then near-enough pixels of up to twice the tolerance around it.

    seeds (image_id, sx, sy) has one row an image; without one, or with one that is not visible, an image stays as it is.
    """
    at = seeds.select("image_id", F.col("sx").cast("int").alias("__sx"), F.col("sy").cast("int").alias("__sy"))
    most, wide, r = C.max_dist_sq(tolerance), C.max_dist_sq(tolerance * 2), max(1, int(fringe))

    def run(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        a = p["a"]
        y0, x0 = np.argwhere(p["there"])[0]
        x, y = int(p["__sx"][y0, x0]), int(p["__sy"][y0, x0])
        if not (0 <= y < a.shape[0] and 0 <= x < a.shape[1] and a[y, x]):
            return {"a": a}
        dist = sum((p[c] - p[c][y, x]) ** 2 for c in "rgb")
        label = label_array((a != 0) & (dist <= most))
        gone = label == label[y, x]
        if fringe > 0:
            grown = gone.astype(np.int8)
            near = running(running(grown, r, 1, np.maximum), r, 0, np.maximum) == 1
            gone |= near & (a != 0) & (dist <= wide)
        return {"a": np.where(gone, 0, a)}

    d = df.join(at, "image_id", "left").fillna(-1, ["__sx", "__sy"])
    return columns_by_image(d, [*"rgba", "__sx", "__sy"], ["a"], run).select(df.columns)


def click_to_grow(df: DataFrame, seeds: DataFrame, tolerance: float = 28, edge_stop: float = 0.55, max_pixels: int | None = None) -> DataFrame:
    """image_id, x, y of the region grown from each image's seed; strong edges stop it, the seed itself is exempt."""
    d = df.join(edge_map(df), KEY).join(seeds, "image_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = dense(pdf, ("r", "g", "b", "a", "cost"))
        seed = int(pdf["sx"].iat[0]), int(pdf["sy"].iat[0])
        m = grow_from(p[..., :3], p[..., 3], p[..., 4], seed, tolerance, edge_stop, max_pixels or p.shape[0] * p.shape[1])
        ys, xs = np.nonzero(m)
        return pd.DataFrame({"image_id": pdf["image_id"].iat[0], "x": xs, "y": ys})

    return per_image(d, run, "image_id long, x int, y int")


# -- mask algebra: masks as sets of places ---------------------------------------------------------------


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).intersect(b.select(*KEY))


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).union(b.select(*KEY)).distinct()


def mask_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).join(b.select(*KEY), KEY, "left_anti")


def mask_invert(mask: DataFrame) -> DataFrame:
    return mask.withColumn("m", 1 - F.col("m"))


def mask_clear(mask: DataFrame) -> DataFrame:
    return mask.withColumn("m", F.lit(1))


def paint(mask: DataFrame, strokes: DataFrame) -> DataFrame:
    """strokes (seq, x, y, size, value): a disc each, the last one to cover a place decides; strokes are few."""
    s = F.broadcast(strokes.select("seq", F.col("x").alias("cx"), F.col("y").alias("cy"), "size", "value"))
    inside = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) <= F.col("size") * F.col("size") / 4
    hit = mask.join(s, inside).groupBy(*KEY).agg(F.max_by("value", "seq").alias("v"))
    return mask.join(hit, KEY, "left").withColumn("m", F.coalesce("v", "m")).drop("v")


# -- component features ------------------------------------------------------------------------------------


def component_features(df: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a component: size, box, mean colour, spread, hue coherence, saturated share, fill."""
    d = labels.join(df.select(*KEY, "r", "g", "b"), KEY)
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    chroma = top - low
    raw = F.when(top == F.col("r"), (F.col("g") - F.col("b")) / chroma).when(top == F.col("g"), (F.col("b") - F.col("r")) / chroma + 2).otherwise((F.col("r") - F.col("g")) / chroma + 4)
    sat = (top > 0) & (chroma / top > 0.18)
    hue = F.when(sat, raw * (math.pi / 3))
    f = d.groupBy("image_id", "label").agg(
        F.count("*").alias("count"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        F.avg("r").alias("mean_r"), F.avg("g").alias("mean_g"), F.avg("b").alias("mean_b"),
        ((F.stddev_pop("r") + F.stddev_pop("g") + F.stddev_pop("b")) / 3).alias("colour_variance"),
        F.count_if(sat).alias("sat"), F.avg(F.cos(hue * 2)).alias("c"), F.avg(F.sin(hue * 2)).alias("s"),
    )
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    return f.select(
        "image_id", "label", "count", "min_x", "min_y", "max_x", "max_y", "mean_r", "mean_g", "mean_b", "colour_variance",
        F.when(F.col("sat") >= 12, 1 - F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))).alias("hue_incoherence"),
        (F.col("sat") / F.col("count")).alias("saturated_frac"), (F.col("count") / (w * h)).alias("fill_ratio"),
    )


def raster_order(labels: DataFrame) -> DataFrame:
    """labels with n: 1, 2, ... by first pixel in raster order, as a label map numbers them."""
    from pyspark.sql import Window as W

    return labels.withColumn("n", F.dense_rank().over(W.partitionBy("image_id").orderBy("label")).cast("long"))


def component_heights(labels: DataFrame, least: int = 4) -> DataFrame:
    return labels.groupBy("image_id", "label").agg(F.count("*").alias("n"), (F.max("y") - F.min("y") + 1).alias("height")).where(F.col("n") >= least)


def chamfer_distance(df: DataFrame, seed: Column, cap: int) -> DataFrame:
    """image_id, x, y, dist: 3-4 chamfer distance to the nearest place where ``seed`` holds."""
    d = df.select(*KEY, seed.cast("int").alias("s"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return rows_of(pdf["image_id"].iat[0], {"dist": chamfer(dense(pdf, ("s",))[..., 0] == 1, cap)})

    return per_image(d, run, "image_id long, x int, y int, dist int")


def with_area(df: DataFrame) -> DataFrame:
    return with_size(df)
