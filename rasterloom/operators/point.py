"""Point operators: one pixel in, one pixel out. Each is a projection; Catalyst merges a chain of them.

Stores into a byte channel round half to even; where a rule rounds by itself it rounds half up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C

RGB = ("r", "g", "b")


def _where_visible(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Changes channels except where a = 0."""
    return df.withColumns({c: F.when(F.col("a") == 0, F.col(c)).otherwise(v) for c, v in new.items()})


def canonicalise(df: DataFrame) -> DataFrame:
    """RGB = 0 where a = 0, as a premultiplied store leaves it."""
    return df.withColumns({c: F.when(F.col("a") == 0, 0).otherwise(F.col(c)) for c in RGB})


def grayscale(df: DataFrame) -> DataFrame:
    lum = C.half_up(C.luma709()).cast("int")
    return _where_visible(df, dict.fromkeys(RGB, lum))


def invert(df: DataFrame) -> DataFrame:
    return _where_visible(df, {c: 255 - F.col(c) for c in RGB})


#: The rows of the sepia matrix.
SEPIA = {"r": (0.393, 0.769, 0.189), "g": (0.349, 0.686, 0.168), "b": (0.272, 0.534, 0.131)}


def sepia(df: DataFrame) -> DataFrame:
    return _where_visible(df, {c: C.store(F.col("r") * x + F.col("g") * y + F.col("b") * z) for c, (x, y, z) in SEPIA.items()})


def replace_color(df: DataFrame, from_color: str, to_color: str, tolerance: float, preserve_luma: bool) -> DataFrame:
    to = C.hex_ints(to_color)
    weights = (0.2126, 0.7152, 0.0722)
    from_luma, to_luma = (sum(w * v for w, v in zip(weights, C.hex_ints(c), strict=True)) for c in (from_color, to_color))
    near = (F.col("a") != 0) & (C.dist_sq(from_color) <= C.max_dist_sq(tolerance))
    shift = C.luma709() - from_luma
    new = {c: C.store(v + shift * (v / max(1, to_luma))) if preserve_luma else F.lit(v) for c, v in zip(RGB, to, strict=True)}
    return df.withColumns({c: F.when(near, v).otherwise(F.col(c)) for c, v in new.items()})


def despill(df: DataFrame, removed_color: str) -> DataFrame:
    """On half-transparent pixels, the removed colour's dominant channel is held to the larger of the other two."""
    v = dict(zip(RGB, C.hex_ints(removed_color), strict=True))
    spill = next((c for c in RGB if all(v[c] > v[o] for o in RGB if o != c)), "g")
    cap = F.greatest(*[F.col(o) for o in RGB if o != spill])
    edge = (F.col("a") > 0) & (F.col("a") < 255) & (F.col(spill) > cap)
    return df.withColumn(spill, F.when(edge, cap).otherwise(F.col(spill)))


def flatten_background(df: DataFrame, color: str) -> DataFrame:
    """Source over an opaque colour."""
    alpha = F.col("a") / 255
    return df.withColumns({c: C.store(F.col(c) * alpha + v * (1 - alpha)) for c, v in zip(RGB, C.hex_ints(color), strict=True)} | {"a": F.lit(255)})


def brightness_contrast(df: DataFrame, brightness: float, contrast: float) -> DataFrame:
    if not brightness and not contrast:
        return df
    factor = ((contrast + 100) / 100) ** 2
    return df.withColumns({c: C.store((F.col(c) + brightness * 1.275 - 128) * factor + 128) for c in RGB})


def saturate(df: DataFrame, amount: float) -> DataFrame:
    if not amount:
        return df
    return df.withColumns({c: C.store(C.luma709() + (F.col(c) - C.luma709()) * (1 + amount / 100)) for c in RGB})


def vibrance(df: DataFrame, amount: float) -> DataFrame:
    if not amount:
        return df
    factor = 1 + amount / 100 * (1 - C.saturation(*map(F.col, RGB)))
    return df.withColumns({c: C.store(C.luma709() + (F.col(c) - C.luma709()) * factor) for c in RGB})


def shadow_highlight(df: DataFrame, shadows: float, highlights: float) -> DataFrame:
    if not shadows and not highlights:
        return df
    lum = C.luma709() / 255
    shift = shadows / 100 * 90 * F.pow(1 - lum, 2) + highlights / 100 * 90 * F.pow(lum, 2)
    return df.withColumns({c: C.store(F.col(c) + shift) for c in RGB})


def warmth(df: DataFrame, amount: float) -> DataFrame:
    if not amount:
        return df
    return df.withColumns({"r": C.store(F.col("r") + amount / 100 * 25), "b": C.store(F.col("b") - amount / 100 * 25)})


def clean_alpha_edges(df: DataFrame, strength: float) -> DataFrame:
    """Alpha saturates outside a band and ramps inside it; strength is 0..1."""
    if strength <= 0:
        return df
    lo, hi = 32 + strength * 64, 224 - strength * 64
    ramp = C.half_up((F.col("a") - lo) / (hi - lo) * 255).cast("int")
    return df.withColumn("a", F.when(F.col("a") <= lo, 0).when(F.col("a") >= hi, 255).otherwise(ramp))


def chromakey_global(df: DataFrame, color: str, tolerance: float) -> DataFrame:
    return df.withColumn("a", F.when(C.dist_sq(color) <= C.max_dist_sq(tolerance), 0).otherwise(F.col("a")))


def hard_alpha(df: DataFrame, threshold: int) -> DataFrame:
    return df.withColumn("a", F.when(F.col("a") >= max(1, min(254, threshold)), 255).otherwise(0))


def apply_mask(df: DataFrame, mask: DataFrame, keep: str = "inside") -> DataFrame:
    """Erases where the mask (image_id, x, y, m) is 0 (keep inside) or 1 (keep outside)."""
    erase = 0 if keep == "inside" else 1
    return df.join(mask, ["image_id", "x", "y"], "left").withColumn("a", F.when(F.col("m") == erase, 0).otherwise(F.col("a"))).drop("m")


def noise_near_white(df: DataFrame, amplitude: int = 6) -> DataFrame:
    """Noise of +-amplitude on near-white pixels, for tests: a hash of the place and channel decides."""
    near = C.dist_sq("#ffffff") < 200
    at = F.col("image_id").cast("long") * 7919 + F.col("x") * 104729 + F.col("y") * 1299709

    def noisy(k: int, c: str):
        step = F.pmod(F.pmod(F.pmod(at + k * 15485863, F.lit(65521)) * 40503, F.lit(65521)), F.lit(2 * amplitude + 1)) - amplitude
        return F.when(near, F.greatest(F.lit(0), F.least(F.lit(255), F.col(c) + step))).otherwise(F.col(c)).cast("int")

    return df.withColumns({c: noisy(k, c) for k, c in enumerate(RGB)})
