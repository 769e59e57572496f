"""Geometry: index arithmetic on pixel keys, resampling by a weight table, polygons by scanlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color as C
from .aggregate import with_size
from .point import RGB


def mirror_horizontal(df: DataFrame) -> DataFrame:
    return with_size(df).withColumn("x", F.col("w") - 1 - F.col("x")).select(df.columns)


def mirror_vertical(df: DataFrame) -> DataFrame:
    return with_size(df).withColumn("y", F.col("h") - 1 - F.col("y")).select(df.columns)


def rotate_ortho(df: DataFrame, degrees: int) -> DataFrame:
    """Clockwise by 90, 180 or 270: a permutation of the places."""
    d, x, y = with_size(df), F.col("x"), F.col("y")
    places = {90: (F.col("h") - 1 - y, x), 180: (F.col("w") - 1 - x, F.col("h") - 1 - y), 270: (y, F.col("w") - 1 - x)}
    nx, ny = places[degrees % 360]
    return d.withColumns({"x": nx, "y": ny}).select(df.columns)


def crop_to_box(df: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = df.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1))
    return inside.withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def auto_crop(df: DataFrame, alpha_threshold: int = 1, padding: int = 0) -> DataFrame:
    """The box of what is visible, padded within the image; an empty image becomes one transparent pixel."""
    seen = F.col("a") >= alpha_threshold
    box = df.groupBy("image_id").agg(
        (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), *[f(F.when(seen, F.col(c))).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]
    )
    zero = F.lit(0)
    box = box.select(
        "image_id", F.col("lo_x").isNull().alias("empty"),
        F.greatest(zero, F.col("lo_x") - padding).alias("x0"), F.greatest(zero, F.col("lo_y") - padding).alias("y0"),
        F.least(F.col("w") - 1, F.col("hi_x") + padding).alias("x1"), F.least(F.col("h") - 1, F.col("hi_y") + padding).alias("y1"),
    )
    d = df.join(box, "image_id").where((F.col("empty") & (F.col("x") == 0) & (F.col("y") == 0)) | (~F.col("empty") & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))))
    new = {"x": F.col("x") - F.coalesce("x0", zero), "y": F.col("y") - F.coalesce("y0", zero)} | {c: F.when(F.col("empty"), 0).otherwise(F.col(c)) for c in (*RGB, "a")}
    return d.withColumns(new).select(df.columns)


def weight_table(spark, source: int, target: int, name: str = "lanczos3") -> DataFrame:
    """j, k, wt: the share of source place k in target place j; a literal relation of the image's size."""
    scale = source / target
    spread = max(1.0, scale)
    radius = C.FILTER_RADIUS[name] * spread
    t = spark.range(target).select(F.col("id").cast("int").alias("j")).withColumn("centre", (F.col("j") + 0.5) * scale - 0.5)
    t = t.withColumn("k", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(F.col("centre") - radius)).cast("int"), F.least(F.lit(source - 1), F.ceil(F.col("centre") + radius)).cast("int"))))
    t = t.withColumn("wt", C.filter_weight((F.col("k") - F.col("centre")) / spread, name))
    total = F.sum("wt").over(W.partitionBy("j"))
    return t.select("j", "k", F.when(total != 0, F.col("wt") / total).otherwise(F.col("wt")).alias("wt"))


def resample(df: DataFrame, source: tuple[int, int], target: tuple[int, int], name: str = "lanczos3") -> DataFrame:
    """Images of one size to another: premultiplied channels, a pass along x, then one along y.

    Pixels are dealt by image once, as bytes; that partitioning serves the sums of both passes. Each pass is a join with the broadcast weight table (its size depends on the image's side alone) and a sum.
    """
    if source == target:
        return df
    alpha = F.col("a") / 255
    dealt = df.select("image_id", "x", "y", *RGB, "a").repartition("image_id")
    p = dealt.select("image_id", "x", "y", *[(F.col(c) * alpha).alias(c) for c in RGB], F.col("a").cast("double").alias("a"))

    def along(d: DataFrame, axis: str, other: str, n: int, m: int) -> DataFrame:
        t = F.broadcast(weight_table(df.sparkSession, n, m, name))
        sums = [F.sum(F.col(c) * F.col("wt")).alias(c) for c in (*RGB, "a")]
        return d.join(t, d[axis] == t["k"]).groupBy("image_id", other, F.col("j").alias(axis)).agg(*sums)

    d = along(along(p, "x", "y", source[0], target[0]), "y", "x", source[1], target[1])
    # sums of doubles depend on order in the last places: a hair is taken off before the store's rounding
    value = {c: F.when(F.col("a") <= 0, 0).otherwise(C.store(F.round(F.col(c) * (255 / F.col("a")), 6))) for c in RGB}
    return d.select("image_id", "x", "y", *[v.cast("int").alias(c) for c, v in value.items()], F.when(F.col("a") <= 0, 0).otherwise(C.store(F.round("a", 6))).cast("int").alias("a"))


def halve(df: DataFrame) -> DataFrame:
    """Means of 2 x 2 places; a last odd row or column is dropped (an image of one row or column keeps it)."""
    d = with_size(df).withColumns({"nw": F.greatest(F.lit(1), F.floor(F.col("w") / 2)), "nh": F.greatest(F.lit(1), F.floor(F.col("h") / 2))})
    d = d.withColumns({"x": F.floor(F.col("x") / 2).cast("int"), "y": F.floor(F.col("y") / 2).cast("int")}).where("x < nw and y < nh")
    wa = F.sum("a")
    return d.groupBy("image_id", "x", "y").agg(*[F.when(wa == 0, 0).otherwise(C.store(F.sum(F.col(c) * F.col("a")) / wa)).cast("int").alias(c) for c in RGB], C.store(F.avg("a")).alias("a"))


def fit_dims(width, height, target_w: int, target_h: int, fit: str):
    """The drawn width and height, as columns: stretch, contain or cover."""
    if fit == "stretch":
        return F.lit(target_w), F.lit(target_h)
    ratios = [F.lit(target_w) / width, F.lit(target_h) / height]
    scale = F.least(*ratios) if fit == "contain" else F.greatest(*ratios)
    return C.half_up(width * scale), C.half_up(height * scale)


def print_dims(images: DataFrame, sizes: DataFrame, dpi: float) -> DataFrame:
    """images (image_id, width, height) x print sizes (label, width_in, height_in): pixels at a dpi and the source's own dpi."""
    d = images.crossJoin(F.broadcast(sizes))
    whole = (F.col("width_in") == 0) | (F.col("height_in") == 0)
    src, own = F.col("width") / F.col("height"), F.col("width_in") / F.col("height_in")
    w = F.when(src >= own, C.half_up(F.col("width_in") * dpi)).otherwise(C.half_up(C.half_up(F.col("height_in") * dpi) * src))
    h = F.when(src >= own, C.half_up(C.half_up(F.col("width_in") * dpi) / src)).otherwise(C.half_up(F.col("height_in") * dpi))
    d = d.withColumns({"out_w": F.when(whole, F.col("width")).otherwise(w).cast("long"), "out_h": F.when(whole, F.col("height")).otherwise(h).cast("long")})
    return d.select("image_id", "label", "out_w", "out_h", F.when(whole, None).when(src >= own, F.col("width") / F.col("width_in")).otherwise(F.col("height") / F.col("height_in")).alias("source_dpi"))


def polygon_mask(polygons: DataFrame, width: int, height: int) -> DataFrame:
    """polygons (poly_id, points array of (x, y)), one row each, to the set places of an even-odd fill.

    A row of a polygon has its scanline's crossings in order, as an array; they are paired, and a pair is exploded into its places. Only
    polygons are dealt, never places: a span that begins where the one before it ends leaves that place to it, so none comes twice.
    """
    p = polygons.where(F.size("points") >= 3).select("poly_id", "points").repartition("poly_id")
    ends = F.concat(F.slice("points", 2, F.size("points") - 1), F.slice("points", 1, 1))
    edge = F.zip_with("points", ends, lambda s, t: F.struct(*[v[c].cast("double").alias(f"{c}{i}") for i, v in ((1, s), (2, t)) for c in "xy"]))
    e = p.select("poly_id", edge.alias("edges")).select("poly_id", "edges", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    met = F.filter("edges", lambda v: (F.least(v["y1"], v["y2"]) <= F.col("y")) & (F.greatest(v["y1"], v["y2"]) > F.col("y")))
    cross = F.transform(met, lambda v: v["x1"] + (F.col("y") - v["y1"]) / (v["y2"] - v["y1"]) * (v["x2"] - v["x1"]))
    c = e.select("poly_id", "y", F.array_sort(cross).alias("c")).where(F.size("c") >= 2)

    def at(i):
        return F.element_at("c", i.cast("int"))

    def span(k):
        """The k-th pair's first and last place."""
        a = F.greatest(F.lit(0), F.ceil(at(2 * k - 1)), F.when(k > 1, F.floor(at(F.greatest(2 * k - 2, F.lit(1)))) + 1))
        return F.struct(a.cast("int").alias("a"), F.least(F.lit(width - 1), F.floor(at(2 * k))).cast("int").alias("b"))

    pair = c.select("poly_id", "y", F.inline(F.transform(F.sequence(F.lit(1), F.floor(F.size("c") / 2).cast("int")), span)))
    return pair.where("a <= b").select("poly_id", F.explode(F.sequence("a", "b")).alias("x"), "y")
