"""Detectors: checkerboard screenshots, design boxes, text colours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color as C
from .aggregate import sized, with_size
from .graph import KEY, component_heights
from .kernels import label_components
from .window import along_x, along_y, dealt

#: The cell sizes tried.
CELL_SIZES = (6, 8, 10, 12, 14, 16, 18, 20, 22, 24, 26, 30, 36)
SPEC = "image_id, light_r, light_g, light_b, dark_r, dark_g, dark_b, cell_size, confidence"


def _spread():
    return F.greatest("r", "g", "b") - F.least("r", "g", "b")


def checker_colours(df: DataFrame) -> DataFrame:
    """image_id, light_*, dark_*, confidence: the two grey peaks of a luma histogram over the interior, if there are two."""
    d = with_size(df).withColumn("stride", F.greatest(F.lit(2), F.floor(F.least("w", "h") / 250)))
    x0, x1, y0, y1 = F.floor(F.col("w") * 0.05), F.floor(F.col("w") * 0.95), F.floor(F.col("h") * 0.05), F.floor(F.col("h") * 0.95)
    inner = d.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1) & ((F.col("x") - x0) % F.col("stride") == 0) & ((F.col("y") - y0) % F.col("stride") == 0))
    grey = inner.where(_spread() <= 8).withColumn("lum", (F.col("r") + F.col("g") + F.col("b")) / 3).withColumn("bin", F.least(F.lit(63), F.floor(F.col("lum") / 4)).cast("int"))
    total = inner.groupBy("image_id").agg(F.count("*").alias("samples"), F.count_if(_spread() <= 8).alias("greys"))
    enough = total.where((F.col("greys") >= F.col("samples") * 0.08) & (F.col("greys") >= 200)).select("image_id", "greys")
    hist = grey.groupBy("image_id", "bin").agg(F.count("*").alias("n")).join(enough, "image_id")
    # neighbours by bin number, not by row: an absent bin counts 0
    near = W.partitionBy("image_id").orderBy("bin")
    below = F.when(F.lag("bin").over(near) == F.col("bin") - 1, F.lag("n").over(near)).otherwise(0)
    above = F.when(F.lead("bin").over(near) == F.col("bin") + 1, F.lead("n").over(near)).otherwise(0)
    hist = hist.withColumns({"below": below, "above": above}).where("bin >= 20")
    hist = hist.withColumn("rank", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("n"), "bin"))).where("rank <= 12")
    peak = hist.where(((F.col("bin") == 20) | (F.col("n") >= F.col("below"))) & ((F.col("bin") == 63) | (F.col("n") >= F.col("above"))))
    a, b = peak.alias("a"), peak.alias("b")
    gap = F.abs(F.col("a.bin") - F.col("b.bin")) * 4
    pair = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.rank") < F.col("b.rank")) & gap.between(12, 100))
    # the greatest sum; ties go to the pair met first by rank
    best = pair.groupBy(F.col("a.image_id").alias("image_id")).agg(
        F.max_by(F.struct(F.col("a.bin").alias("p"), F.col("a.n").alias("pn"), F.col("b.bin").alias("q"), F.col("b.n").alias("qn"), F.col("a.greys").alias("greys")), F.struct(F.col("a.n") + F.col("b.n"), -F.col("a.rank"), -F.col("b.rank"))).alias("s")
    ).select("image_id", "s.*").where((F.col("pn") >= F.col("greys") * 0.04) & (F.col("qn") >= F.col("greys") * 0.04))
    g = grey.join(best, "image_id")

    def mean(peak_bin: str, c: str):
        near_peak = (F.col("lum") >= (F.col(peak_bin) - 1) * 4) & (F.col("lum") < (F.col(peak_bin) + 2) * 4)
        return C.half_up(F.avg(F.when(near_peak, F.col(c)))).cast("int")

    m = g.groupBy("image_id", F.least(F.lit(1.0), (F.col("pn") + F.col("qn")) / F.greatest(F.lit(1), F.col("greys"))).alias("confidence")).agg(*[mean(p, c).alias(f"{p}_{c}") for p in "pq" for c in "rgb"])
    first = (F.col("p_r") + F.col("p_g") + F.col("p_b")) >= (F.col("q_r") + F.col("q_g") + F.col("q_b"))
    out = {f"light_{c}": F.when(first, F.col(f"p_{c}")).otherwise(F.col(f"q_{c}")) for c in "rgb"} | {f"dark_{c}": F.when(first, F.col(f"q_{c}")).otherwise(F.col(f"p_{c}")) for c in "rgb"}
    return m.select("image_id", *[v.alias(k) for k, v in out.items()], "confidence")


def classified(df: DataFrame, spec: DataFrame, limit: int, *, strict: bool) -> DataFrame:
    """Adds cls: 1 light, 2 dark, 0 neither; strict means a distance below the limit and a spread of at most 12."""
    # the colours are the side held: pixels are not broadcast, however small a compressed raster looks
    d = df.join(spec.hint("shuffle_hash"), "image_id")

    def dist(p: str):
        return sum(((F.col(c) - F.col(f"{p}_{c}")) * (F.col(c) - F.col(f"{p}_{c}")) for c in "rgb"), F.lit(0))

    light, dark = dist("light"), dist("dark")
    near = (lambda v: v < limit) if strict else (lambda v: v <= limit)
    cls = F.when(near(light) & (light <= dark), 1).when(near(dark), 2).otherwise(0)
    return d.withColumn("cls", F.when(_spread() > 12, 0).otherwise(cls) if strict else cls)


def estimate_cell_size(df: DataFrame, spec: DataFrame) -> DataFrame:
    """image_id, cell_size: the size whose four offsets alternate most often; 0 if under 12 in 100 do."""
    d = with_size(classified(df, spec, 576, strict=True).select(*KEY, "cls"))
    d = d.withColumn("stride", F.greatest(F.lit(2), F.floor(F.least("w", "h") / 400)))
    cells = df.sparkSession.createDataFrame([(c,) for c in CELL_SIZES], "cs int")
    sample = d.crossJoin(F.broadcast(cells)).where("cls <> 0 and cs < w and cs < h and x >= cs and x < w - cs and y >= cs and y < h - cs and (x - cs) % stride = 0 and (y - cs) % stride = 0")
    sides = F.array(*[F.struct((F.col("x") + dx * F.col("cs")).alias("nx"), (F.col("y") + dy * F.col("cs")).alias("ny")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    other = d.where("cls <> 0").select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("cls").alias("ncls"))
    around = sample.select("image_id", "x", "y", "cls", "cs", F.explode(sides).alias("o")).select("image_id", "x", "y", "cls", "cs", "o.nx", "o.ny")
    n = around.join(other, ["image_id", "nx", "ny"], "left").groupBy("image_id", "cs", "x", "y").agg(F.count("ncls").alias("nbr"), F.count_if(F.col("ncls") == 3 - F.col("cls")).alias("opp"))
    share = n.groupBy("image_id", "cs").agg((F.count_if((F.col("nbr") >= 2) & (F.col("opp") >= F.ceil(F.col("nbr") * 0.66))) / F.count("*")).alias("score"))
    best = share.groupBy("image_id").agg(F.max(F.struct("score", (-F.col("cs")).alias("neg"))).alias("s"))
    return best.select("image_id", F.when(F.col("s.score") < 0.12, 0).otherwise(-F.col("s.neg")).cast("int").alias("cell_size"))


def detect_checkerboard(df: DataFrame) -> DataFrame:
    """image_id, light_*, dark_*, cell_size, confidence of the images that show a checkerboard."""
    spec = checker_colours(df)
    return spec.join(estimate_cell_size(df, spec), "image_id").where("cell_size > 0").select(*SPEC.split(", "))


def longest_run(counts: DataFrame, gap: int = 4) -> DataFrame:
    """counts (image_id, i, n, thr): lo, hi of the longest run of n >= thr that bridges gaps of up to ``gap``; ties to the first."""
    w = W.partitionBy("image_id").orderBy("i")
    hit = counts.where("n >= thr")
    island = hit.withColumn("new", F.coalesce((F.col("i") - F.lag("i").over(w) > gap + 1).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(w))
    runs = island.groupBy("image_id", "island").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    return runs.groupBy("image_id").agg(F.max_by(F.struct("lo", "hi"), F.struct(F.col("hi") - F.col("lo"), -F.col("lo"))).alias("s")).select("image_id", "s.*")


def design_box(df: DataFrame, spec: DataFrame) -> DataFrame:
    """image_id, x, y, width, height: where rows and columns hold enough of the dark grey; else the whole image."""
    d = with_size(df).join(spec, "image_id")
    dist = sum(((F.col(c) - F.col(f"dark_{c}")) * (F.col(c) - F.col(f"dark_{c}")) for c in "rgb"), F.lit(0))
    d = d.withColumn("near", (dist <= 484).cast("int"))

    def runs(axis: str, across: str) -> DataFrame:
        n = d.groupBy("image_id", F.col(axis).alias("i"), F.greatest(F.lit(6), F.floor(F.col(across) * 0.015)).alias("thr")).agg(F.sum("near").alias("n"))
        return longest_run(n)

    rows, cols = runs("y", "w"), runs("x", "h")
    size = d.select("image_id", "w", "h").distinct()
    j = size.join(rows.select("image_id", F.col("lo").alias("y0"), F.col("hi").alias("y1")), "image_id", "left").join(cols.select("image_id", F.col("lo").alias("x0"), F.col("hi").alias("x1")), "image_id", "left")
    ok = (F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0"))
    return j.select("image_id", F.when(ok, F.col("x0")).otherwise(0).alias("x"), F.when(ok, F.col("y0")).otherwise(0).alias("y"), F.when(ok, F.col("x1") - F.col("x0") + 1).otherwise(F.col("w")).alias("width"), F.when(ok, F.col("y1") - F.col("y0") + 1).otherwise(F.col("h")).alias("height"))


def remove_checkerboard(df: DataFrame, spec: DataFrame) -> DataFrame:
    """a = 0 on checker pixels: classified, alternating at the cell's distance, closed over small gaps.

    The cell size differs by image, so the four far neighbours are equi-joins on computed keys; the closure is a window.
    """
    d = classified(df, spec, 576, strict=False)
    sides = F.array(*[F.struct((F.col("x") + dx * F.col("cell_size")).alias("nx"), (F.col("y") + dy * F.col("cell_size")).alias("ny")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    some = d.where("cls <> 0")
    around = some.select(*KEY, "cls", F.explode(sides).alias("o")).select(*KEY, "cls", "o.nx", "o.ny")
    n = around.join(some.select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("cls").alias("ncls")), ["image_id", "nx", "ny"]).groupBy(*KEY).agg(F.count("*").alias("nbr"), F.count_if(F.col("ncls") == 3 - F.col("cls")).alias("opp"))
    hit = n.where((F.col("nbr") >= 2) & (F.col("opp") >= F.ceil(F.col("nbr") * 0.66))).select(*KEY, F.lit(1).alias("c"))
    g = dealt(with_size(d.join(hit, KEY, "left").withColumn("c", F.coalesce("c", F.lit(0)))))
    g = g.withColumn("row", F.sum("c").over(along_x().rowsBetween(-1, 1))).withColumn("box", F.sum("row").over(along_y().rowsBetween(-1, 1)))
    interior = F.col("x").between(1, F.col("w") - 2) & F.col("y").between(1, F.col("h") - 2)
    gone = (F.col("c") == 1) | (interior & (F.col("cls") != 0) & (F.col("box") >= 3))
    return g.withColumn("a", F.when(gone, 0).otherwise(F.col("a"))).select(df.columns)


def crop_to_boxes(df: DataFrame, boxes: DataFrame) -> DataFrame:
    b = boxes.select("image_id", F.col("x").alias("bx"), F.col("y").alias("by"), "width", "height")
    inside = df.join(b, "image_id").where("x >= bx and x < bx + width and y >= by and y < by + height")
    return inside.withColumns({"x": (F.col("x") - F.col("bx")).cast("int"), "y": (F.col("y") - F.col("by")).cast("int")}).select(df.columns)


def detect_source_type(df: DataFrame) -> DataFrame:
    found = detect_checkerboard(df).select("image_id", F.lit(True).alias("hit"))
    return df.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.when(F.col("hit"), "screenshot").otherwise("graphic").alias("source_type"))


def checker_overlay(df: DataFrame, spec: DataFrame, boxes: DataFrame) -> DataFrame:
    """Checker pixels tinted, the box drawn: a picture of what the detectors saw."""
    erased = remove_checkerboard(df, spec).select(*KEY, (F.col("a") == 0).alias("checker"))
    b = boxes.select("image_id", F.col("x").alias("bx"), F.col("y").alias("by"), "width", "height")
    d = df.join(erased, KEY).join(b, "image_id")
    x1, y1 = F.col("bx") + F.col("width") - 1, F.col("by") + F.col("height") - 1
    upright = ((F.col("x") == F.col("bx")) | (F.col("x") == x1)) & F.col("y").between(F.col("by"), y1)
    level = ((F.col("y") == F.col("by")) | (F.col("y") == y1)) & F.col("x").between(F.col("bx"), x1)
    frame = upright | level
    new = {"r": F.when(frame, 0).when(F.col("checker"), 255).otherwise(F.col("r")), "g": F.when(frame, 200).when(F.col("checker"), F.floor(F.col("g") / 2)).otherwise(F.col("g")).cast("int"), "b": F.when(frame, 0).when(F.col("checker"), 255).otherwise(F.col("b"))}
    return d.withColumns(new).select(df.columns)


# -- text colours ------------------------------------------------------------------------------------------


def colour_candidates(df: DataFrame) -> DataFrame:
    """image_id, rb, gb, bb, n, rank, opaque: 15-bit bins with enough visible pixels, without fringe greys."""
    seen = df.where((F.col("a") >= 128) & ~C.fringe_colour(F.col("r"), F.col("g"), F.col("b")))
    opaque = seen.groupBy("image_id").agg(F.count("*").alias("opaque"))
    bins = seen.groupBy("image_id", C.bin15().alias("bin")).agg(F.count("*").alias("n")).join(opaque, "image_id")
    bins = bins.where(F.col("n") >= F.greatest(F.lit(80), F.floor(F.col("opaque") * 0.003)))
    w = W.partitionBy("image_id")
    bins = bins.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "bin")), "many": F.count("*").over(w)})
    # a colour over 40 in 100 is the ground, not the ink
    bins = bins.where(~((F.col("rank") == 1) & (F.col("many") > 1) & (F.col("n") > F.col("opaque") * 0.4)))
    bins = bins.withColumn("rank", F.row_number().over(w.orderBy("rank")))
    return bins.select("image_id", F.shiftright("bin", 10).alias("rb"), F.shiftright("bin", 5).bitwiseAND(31).alias("gb"), F.col("bin").bitwiseAND(31).alias("bb"), "n", "rank", "opaque")


def suppress_close(candidates: DataFrame, most: int, top: int = 60, distance: int = 28) -> DataFrame:
    """Greedy choice by rank of bins at least ``distance`` apart; sequential, on at most 60 rows an image."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        picked: list = []
        for r in pdf.sort_values("rank").itertuples(index=False):
            if len(picked) >= most:
                break
            if all(64 * ((r.rb - p.rb) ** 2 + (r.gb - p.gb) ** 2 + (r.bb - p.bb) ** 2) >= distance * distance for p in picked):
                picked.append(r)
        return pd.DataFrame(picked, columns=pdf.columns)

    return candidates.where(F.col("rank") <= top).groupBy("image_id").applyInPandas(run, candidates.schema)


def detect_text_colours(df: DataFrame, most: int = 3) -> DataFrame:
    """image_id, rank, hex, pixels, components, median_height, mean_pixels: colours whose components look like letters."""
    picked = suppress_close(colour_candidates(df), most * 6)
    # the colours are the side held: neither they nor pixels are broadcast, however small a compressed raster looks
    colours = picked.select("image_id", "rank", *[(F.col(f"{c}b") * 8 + 4).alias(f"c{c}") for c in "rgb"], "opaque").hint("shuffle_hash")
    d = df.where("a >= 128").select(*KEY, *"rgb").join(colours, "image_id")
    d = d.where(sum(((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "rgb"), F.lit(0)) <= 400)
    stats = d.groupBy("image_id", "rank", "opaque").agg(F.count("*").alias("pixels"), *[C.half_up(F.avg(c)).cast("int").alias(c) for c in "rgb"])
    stats = stats.where((F.col("pixels") >= F.greatest(F.lit(80), F.floor(F.col("opaque") * 0.003))) & ~C.fringe_colour(F.col("r"), F.col("g"), F.col("b")))
    sizes = sized(df)
    # every chosen colour is a raster of its own for the labels; only its places are dealt
    labels = label_components(d.select(*KEY, "rank"), F.lit(True), ("rank",), sizes)
    heights = labels.groupBy("image_id", "rank", "label").agg(F.count("*").alias("n"), (F.max("y") - F.min("y") + 1).alias("height")).where("n >= 4")
    w = W.partitionBy("image_id", "rank")
    heights = heights.withColumns({"i": F.row_number().over(w.orderBy("height", "label")) - 1, "components": F.count("*").over(w)})
    median = heights.where(F.col("i") == F.floor(F.col("components") / 2)).select("image_id", "rank", "components", F.col("height").alias("median_height"))
    c = stats.join(median, ["image_id", "rank"]).join(sizes.select("image_id", "h"), "image_id").withColumn("mean_pixels", F.col("pixels") / F.col("components"))
    c = c.where("mean_pixels >= 25 and median_height >= 6 and median_height <= h * 0.2 and components >= 8 and pixels <= opaque * 0.3")
    dark = 1 - (F.col("r") + F.col("g") + F.col("b")) / 765
    score = F.col("components") * (1 + C.saturation(F.col("r"), F.col("g"), F.col("b")) * 1.5 + F.greatest(F.lit(0.0), dark - 0.3) * 1.2)
    c = c.withColumn("score", score).withColumn("place", F.row_number().over(W.partitionBy("image_id").orderBy(F.desc("score"), "rank"))).where(F.col("place") <= most)
    return c.select("image_id", F.col("place").alias("rank"), C.rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"), "pixels", "components", "median_height", "mean_pixels")


def colour_mask(df: DataFrame, color: str, tolerance: float = 18) -> DataFrame:
    """The binary mask that a tracer would follow: visible pixels within a radius of a colour."""
    return df.select(*KEY, ((F.col("a") >= 128) & (C.dist_sq(color) <= tolerance * tolerance)).cast("int").alias("m"))


def compose_overlays(base: DataFrame, overlays: DataFrame, source: tuple[int, int], target: tuple[int, int], dilate: int = 2, reach: int = 4) -> DataFrame:
    """Overlays (image_id, layer, x, y, r, g, b, a in target places; m, the layer's dense source mask, comes as
    ``sx, sy`` rows with layer and m) are blended in order of layer over the base, within the base's reach.

    ``overlays`` is a pair of DataFrames (pixels, masks).
    """
    from .window import separable

    pixels, masks = overlays
    (sw, sh), (tw, th) = source, target
    grown = dealt(masks)
    for along in ("x", "y"):
        other = "y" if along == "x" else "x"
        grown = grown.withColumn("m", F.max("m").over(W.partitionBy("image_id", "layer", other).orderBy(along).rowsBetween(-dilate, dilate)))
    kept = grown.where("m = 1").select("image_id", "layer", F.col("x").alias("sx"), F.col("y").alias("sy"))
    near = separable(dealt(base.withColumn("near", (F.col("a") >= 16).cast("int"))), "near", reach, F.max)
    keyed = pixels.where("a > 0").withColumns({"sx": F.least(F.lit(sw - 1), F.floor(F.col("x") * sw / tw)).cast("int"), "sy": F.least(F.lit(sh - 1), F.floor(F.col("y") * sh / th)).cast("int")})
    stack = keyed.join(kept, ["image_id", "layer", "sx", "sy"], "left_semi").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("layer", "r", "g", "b", "a"))).alias("stack"))
    d = near.join(stack, KEY, "left")
    start = F.struct(*[F.col(c).alias(c) for c in "rgba"])

    def blend(acc, o):
        k = o["a"] / 255
        return F.struct(*[C.store(o[c] * k + acc[c] * (1 - k)).alias(c) for c in "rgb"], F.greatest(acc["a"], o["a"]).alias("a"))

    out = F.when((F.col("near") == 1) & F.col("stack").isNotNull(), F.aggregate("stack", start, blend)).otherwise(start)
    return d.withColumn("o", out).select(*KEY, "o.r", "o.g", "o.b", "o.a")


def heights_of(df: DataFrame, member) -> DataFrame:
    return component_heights(label_components(df, member))
