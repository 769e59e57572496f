"""Aggregates over the pixels of each image."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color as C
from .point import RGB


def sized(df: DataFrame) -> DataFrame:
    """image_id, w, h of dense rasters."""
    return df.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def with_size(df: DataFrame) -> DataFrame:
    """Adds w and h; one row an image is joined back."""
    return df.join(sized(df), "image_id")


def by_place(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two pixel relations, joined place by place; sorted and merged, as a raster's files are so small for its rows that Spark would broadcast millions of them."""
    return a.join(b.hint("merge"), ["image_id", "x", "y"])


def alpha_stats(df: DataFrame) -> DataFrame:
    semi = F.count_if((F.col("a") != 0) & (F.col("a") != 255))
    return df.groupBy("image_id").agg(
        F.count("*").alias("total_pixels"), F.count_if(F.col("a") == 255).alias("fully_opaque"), F.count_if(F.col("a") == 0).alias("fully_transparent"),
        semi.alias("semi_transparent"), (semi / F.count("*") * 100).alias("semi_transparent_pct"),
    )


def removed_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """image_id, removed: pixels visible before and not after; both relations have the same keys."""
    b = before.select("image_id", "x", "y", F.col("a").alias("a0"))
    return by_place(after, b).groupBy("image_id").agg(F.count_if((F.col("a0") != 0) & (F.col("a") == 0)).alias("removed"))


def analyze_background(df: DataFrame) -> DataFrame:
    """image_id, color, noise: the modal 15-bit colour of a stride sample and the mean difference of what is near it."""
    s = with_size(df).withColumn("stride", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("w") * F.col("h") / 50000)))).where("x % stride = 0 and y % stride = 0")
    bins = s.where("a >= 128").groupBy("image_id", C.bin15().alias("bin")).agg(F.count("*").alias("n"), F.min(F.col("y") * F.col("w") + F.col("x")).alias("pos"))
    # ties go to the bin met first in raster order
    mode = bins.groupBy("image_id").agg(F.max_by("bin", F.struct("n", (-F.col("pos")).alias("p"))).alias("bin"))
    part = {c: F.shiftright(F.coalesce("bin", F.lit(0)), shift).bitwiseAND(31) * 8 + 4 for c, shift in zip(("br", "bg", "bb"), (10, 5, 0), strict=True)}
    near = s.join(mode, "image_id", "left").withColumns(part)
    diff = (F.abs(F.col("r") - F.col("br")) + F.abs(F.col("g") - F.col("bg")) + F.abs(F.col("b") - F.col("bb"))) / 3
    return near.groupBy("image_id", C.rgb_hex(F.col("br"), F.col("bg"), F.col("bb")).alias("color")).agg(F.coalesce(F.avg(F.when(diff <= 30, diff)), F.lit(0.0)).alias("noise"))


def detect_image_type(df: DataFrame) -> DataFrame:
    """image_id, type, confidence, has_transparency, unique_colors, action."""
    s = with_size(df).withColumn("step", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("w") * F.col("h") / 25000)))).where("x % step = 0 and y % step = 0")
    w = W.partitionBy("image_id", "y").orderBy("x")
    edge = sum((F.abs(F.lead(c).over(w) - F.col(c)) for c in RGB), F.lit(0))
    s = s.withColumn("edge", edge).withColumn("lum", F.least(F.lit(31), F.shiftright(F.floor(C.luma601()).cast("int"), 3)))
    main = s.groupBy("image_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("a") < 250).alias("trans"), F.count_distinct(C.bin15()).alias("unique_colors"),
        F.coalesce(F.avg("edge"), F.lit(0.0)).alias("edge"),
    )
    lums = s.groupBy("image_id", "lum").agg(F.count("*").alias("k"))
    active = lums.join(main.select("image_id", "n"), "image_id").groupBy("image_id").agg(F.count_if(F.col("k") >= F.col("n") * 0.005).alias("bins"))
    out = main.join(active, "image_id").withColumn("has_transparency", F.col("trans") / F.col("n") > 0.05)
    u, bins = F.col("unique_colors"), F.col("bins")
    graphic = F.col("has_transparency") | ((u < 250) & (bins < 10)) | ((u < 1500) & (F.col("edge") > 80)) | ((u < 800) & (bins < 12))
    kind = F.when(F.col("has_transparency"), "graphic-with-transparency").when(graphic, "graphic").otherwise("photo")
    action = F.when(F.col("has_transparency"), "ready-to-resize").when(graphic, "remove-bg-color").otherwise("remove-bg-ai")
    sure = F.least(F.lit(1.0), F.abs(1500 - u) / 1500 + F.when(F.col("has_transparency"), 0.2).otherwise(0.0))
    return out.select("image_id", kind.alias("type"), sure.alias("confidence"), "has_transparency", "unique_colors", action.alias("action"))


def level_bounds(df: DataFrame) -> DataFrame:
    """image_id, channel, lo, hi: where half a percent of the pixels is clipped at either end."""
    long = df.select("image_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in RGB])).alias("s")).select("image_id", "s.*")
    hist = long.groupBy("image_id", "channel", "v").agg(F.count("*").alias("n"))
    by = W.partitionBy("image_id", "channel")
    run = hist.withColumn("clip", F.greatest(F.lit(1), C.half_up(F.sum("n").over(by) * 0.005))).withColumn("up", F.sum("n").over(by.orderBy("v"))).withColumn("down", F.sum("n").over(by.orderBy(F.desc("v"))))
    return run.groupBy("image_id", "channel").agg(F.min(F.when(F.col("up") >= F.col("clip"), F.col("v"))).alias("lo"), F.max(F.when(F.col("down") >= F.col("clip"), F.col("v"))).alias("hi"))


def auto_levels(df: DataFrame) -> DataFrame:
    bounds = level_bounds(df).groupBy("image_id").agg(*[F.max(F.when(F.col("channel") == c, F.struct("lo", "hi"))).alias(f"_{c}") for c in RGB])
    out = df.join(bounds, "image_id")
    new = {}
    for c in RGB:
        lo, hi = F.col(f"_{c}.lo"), F.col(f"_{c}.hi")
        new[c] = F.when(hi > lo, C.store((F.col(c) - lo) * (255 / (hi - lo)))).otherwise(F.col(c))
    return out.withColumns(new).select(df.columns)


def leakage(source: DataFrame, out: DataFrame) -> DataFrame:
    """image_id and counts by distance from white in the source: what went (a < 128) and what of the design stayed.

    Up to 30 is background, up to 80 the anti-alias band, up to 150 a light leak, beyond it a deep one.
    """
    s = source.select("image_id", "x", "y", F.sqrt(C.dist_sq("#ffffff").cast("double")).alias("d"))
    both = by_place(s, out.select("image_id", "x", "y", "a"))
    gone, d = F.col("a") < 128, F.col("d")
    design, stays = F.count_if(d > 30), F.count_if((d > 30) & ~gone)
    return both.groupBy("image_id").agg(
        F.count_if(gone & (d <= 30)).alias("removed_bg"), F.count_if(gone & (d > 30) & (d <= 80)).alias("removed_aa"),
        F.count_if(gone & (d > 80) & (d <= 150)).alias("leaked_light"), F.count_if(gone & (d > 150)).alias("leaked_deep"),
        design.alias("design_pixels"), F.when(design == 0, 0.0).otherwise(stays / design).alias("preserved"),
    )


def erase_audit(before: DataFrame, after: DataFrame, margin_x: float = 0.05, margin_y: float = 0.10) -> DataFrame:
    """image_id, total_erased, edge_erased, area, edge_frac, total_frac: what lost its opacity (a 32), and in the margin."""
    b = with_size(before.select("image_id", "x", "y", F.col("a").alias("a0")))
    both = by_place(b, after.select("image_id", "x", "y", "a"))
    w, h = F.col("w"), F.col("h")
    band = (F.col("x") < w * margin_x) | (F.col("x") >= w * (1 - margin_x)) | (F.col("y") < h * margin_y) | (F.col("y") >= h * (1 - margin_y))
    gone = (F.col("a0") >= 32) & (F.col("a") < 32)
    n = both.groupBy("image_id").agg(F.count_if(gone).alias("total_erased"), F.count_if(gone & band).alias("edge_erased"), F.count("*").alias("area"))
    return n.select("*", (F.col("edge_erased") / F.col("area")).alias("edge_frac"), (F.col("total_erased") / F.col("area")).alias("total_frac"))


def audit_top(reports: DataFrame, by: str, n: int) -> DataFrame:
    return reports.orderBy(F.desc(by), "image_id").limit(n)


def sample_points(df: DataFrame, regions: DataFrame) -> DataFrame:
    """image_id, label, x, y: the first opaque near-white pixel of each region in raster order; (0, 0) if none.

    ``regions`` has label, x0, y0, x1, y1 (inclusive) and is a small literal table.
    """
    images = df.select("image_id").distinct()
    near = df.where((F.col("a") >= 200) & (C.dist_sq("#ffffff") < 200))
    hit = near.join(F.broadcast(regions), F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    first = hit.groupBy("image_id", "label").agg(F.min(F.struct("y", "x")).alias("p"))
    every = images.crossJoin(F.broadcast(regions.select("label")))
    return every.join(first, ["image_id", "label"], "left").select("image_id", "label", F.coalesce("p.x", F.lit(0)).alias("x"), F.coalesce("p.y", F.lit(0)).alias("y"))


def sample_alpha(df: DataFrame, points: DataFrame) -> DataFrame:
    """The alpha at each of ``points``; they are few an image and are the side held, not the pixels."""
    return points.hint("shuffle_hash").join(df, ["image_id", "x", "y"]).select("image_id", "label", "a")


def pick_colour(df: DataFrame, x: int, y: int) -> DataFrame:
    """The colour at one place, as hex."""
    return df.where((F.col("x") == x) & (F.col("y") == y)).select("image_id", "x", "y", C.rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


def stride_for(pixels: int, target: int) -> int:
    return max(1, math.floor(math.sqrt(pixels / target)))
