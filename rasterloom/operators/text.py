"""Text removal: components scored as letters, rows of letters, and three erasing passes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color as C
from .aggregate import sized
from .graph import KEY, chamfer_distance, component_features
from .kernels import label_components
from .window import dilate_mask4, erode_mask4

OPAQUE = 32


def zone_gate(features: DataFrame, margin_x: float = 0.05, margin_y: float = 0.10) -> Column:
    """Is a component's box inside the text zone? ``features`` carries w and h."""
    return (
        (F.col("min_x") >= F.col("w") * margin_x) & (F.col("max_x") <= F.col("w") * (1 - margin_x)) & (F.col("min_y") >= F.col("h") * margin_y) & (F.col("max_y") <= F.col("h") * (1 - margin_y))
    )


def decoration_tag() -> Column:
    """A component too varied or too large to be lettering; needs w and h."""
    reliable = (F.col("saturated_frac") > 0.20) & F.col("hue_incoherence").isNotNull()
    return (reliable & (F.col("hue_incoherence") > 0.18)) | (~reliable & (F.col("colour_variance") > 65)) | (F.col("count") > F.col("w") * F.col("h") * 0.08)


def _box() -> tuple[Column, Column]:
    return F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1


def text_score(features: DataFrame, *, huge: float = 0.05, spread: float = 28) -> Column:
    """Does a component look like text? The first pass takes (0.05, 28), the second (0.02, 22)."""
    bw, bh = _box()
    tall = F.col("h") * 0.06
    hued = (F.col("saturated_frac") > 0.30) & F.col("hue_incoherence").isNotNull()
    hero = (bw > bh * 1.5) & (F.col("fill_ratio") < 0.32) & (bh < tall * 2) & ((hued & (F.col("hue_incoherence") < 0.18)) | (F.col("colour_variance") < 22))
    calm = F.when(hued, F.col("hue_incoherence") <= 0.30).otherwise(F.col("colour_variance") <= spread)
    return zone_gate(features) & (bh >= F.col("h") * 0.005) & (F.col("count") <= F.col("w") * F.col("h") * huge) & ((bh <= tall) | hero) & calm


def row_clusters(candidates: DataFrame) -> DataFrame:
    """image_id, label, row: boxes joined downwards when they overlap by 0.4 of the lower height.

    The scan only looks forward in the order of the top edge, so groups depend on that order: one small group an image.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["min_y", "label"], kind="stable").reset_index(drop=True)
        top, low = pdf["min_y"].tolist(), pdf["max_y"].tolist()
        row = [0] * len(pdf)
        n = 0
        for i in range(len(pdf)):
            if row[i]:
                continue
            n += 1
            queue = [i]
            while queue:
                k = queue.pop(0)
                if row[k]:
                    continue
                row[k] = n
                height = low[k] - top[k] + 1
                for j in range(k + 1, len(pdf)):
                    if top[j] > low[k] + height * 0.5:
                        break
                    overlap = max(0, min(low[k], low[j]) - max(top[k], top[j]) + 1)
                    if not row[j] and overlap >= min(height, low[j] - top[j] + 1) * 0.4:
                        queue.append(j)
        return pdf[["image_id", "label"]].assign(row=row)

    return candidates.select("image_id", "label", "min_y", "max_y").groupBy("image_id").applyInPandas(run, "image_id long, label long, row int")


def demote_singletons(candidates: DataFrame, rows: DataFrame, *, size: float = 0.001, spread: float = 18) -> DataFrame:
    """The candidates that stay text: in a row of three or more, or a large flat stroke."""
    bw, bh = _box()
    d = candidates.join(rows, ["image_id", "label"]).withColumn("in_row", F.count("*").over(W.partitionBy("image_id", "row")))
    stroke = (F.col("count") > F.col("w") * F.col("h") * size) & (F.col("fill_ratio") < 0.35) & (F.col("colour_variance") < spread) & (bw > bh * 1.5)
    return d.where((F.col("in_row") >= 3) | stroke)


def _mask(df: DataFrame, member: Column) -> DataFrame:
    return df.select(*KEY, member.cast("int").alias("m"))


def _labelled(df: DataFrame, mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, features with w and h) of a dense mask's components."""
    labels = label_components(mask, F.col("m") == 1)
    return labels, component_features(df, labels).join(sized(df), "image_id")


def _erase(df: DataFrame, labels: DataFrame, text: DataFrame, opaque: DataFrame) -> DataFrame:
    """Text components grown by two steps lose what was opaque at the start."""
    core = labels.join(text.select("image_id", "label"), ["image_id", "label"], "left_semi").select(*KEY, F.lit(1).alias("t"))
    dense = opaque.join(core, KEY, "left").select(*KEY, F.col("m").alias("o"), F.coalesce("t", F.lit(0)).alias("m"))
    gone = dilate_mask4(dense, 2).where("m = 1 and o = 1").select(*KEY, F.lit(True).alias("gone"))
    return df.join(gone, KEY, "left").withColumn("a", F.when(F.col("gone"), 0).otherwise(F.col("a"))).drop("gone")


def pass_one(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, text components) of the eroded opaque mask."""
    opaque = _mask(df, F.col("a") >= OPAQUE)
    p_labels, p_features = _labelled(df, opaque)
    decoration = p_features.where(decoration_tag()).select("image_id", F.col("label").alias("parent"), F.lit(True).alias("deco"))
    labels, features = _labelled(df, erode_mask4(opaque))
    seeds = labels.groupBy("image_id", "label").agg(F.min(F.struct("y", "x")).alias("s")).select("image_id", "label", F.col("s.x").alias("x"), F.col("s.y").alias("y"))
    parent = seeds.join(p_labels.withColumnRenamed("label", "parent"), KEY).select("image_id", "label", "parent").join(decoration, ["image_id", "parent"], "left")
    f = features.join(parent, ["image_id", "label"], "left")
    allowed = F.coalesce("deco", F.lit(False)) & (F.col("colour_variance") > 8)
    candidates = f.where(text_score(f) & ~allowed)
    return labels, demote_singletons(candidates, row_clusters(candidates))


def pass_two(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, text components) of the eroded dark ink that is left."""
    dark = _mask(df, (F.col("a") >= OPAQUE) & (C.luma709() < 90))
    labels, f = _labelled(df, erode_mask4(dark))
    candidates = f.where(text_score(f, huge=0.02, spread=22))
    return labels, demote_singletons(candidates, row_clusters(candidates), size=0.0003, spread=14)


def punctuation(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, components) of small flat marks near what was erased."""
    labels, f = _labelled(df, _mask(df, F.col("a") >= OPAQUE))
    bw, bh = _box()
    small = f.where(zone_gate(f) & (F.col("count") <= F.col("w") * F.col("h") * 0.0001) & (bh <= F.col("h") * 0.012) & (bw <= F.col("w") * 0.015) & (F.col("colour_variance") <= 22))
    radius = F.greatest(F.lit(6), C.half_up(F.col("h") * 0.015))
    near = chamfer_distance(df, F.col("a") < OPAQUE, 4096).join(labels, KEY).groupBy("image_id", "label").agg(F.min("dist").alias("nearest"))
    return labels, small.join(near, ["image_id", "label"]).where(F.col("nearest") <= radius)


def remove_text(df: DataFrame, settle=lambda d: d) -> DataFrame:
    """The three passes; ``settle`` may write a pass's result so that the next does not repeat it."""
    opaque = _mask(df, F.col("a") >= OPAQUE)
    labels, text = pass_one(df)
    one = settle(_erase(df, labels, text, opaque))
    labels, text = pass_two(one)
    two = settle(_erase(one, labels, text, opaque))
    # the third pass needs half a percent erased by the first two
    before = df.select(*KEY, F.col("a").alias("a0"))
    done = two.join(before, KEY).groupBy("image_id").agg((F.count_if((F.col("a0") > 0) & (F.col("a") == 0)) / F.count("*")).alias("share")).where("share >= 0.005").select("image_id")
    labels, marks = punctuation(two.join(done, "image_id", "left_semi"))
    gone = labels.join(marks.select("image_id", "label"), ["image_id", "label"], "left_semi").select(*KEY, F.lit(True).alias("gone"))
    return two.join(gone, KEY, "left").withColumn("a", F.when(F.col("gone"), 0).otherwise(F.col("a"))).drop("gone")
