"""Colour and scalar functions as Spark columns; all stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Squared distance between black and white in RGB.
FULL = 195075


def hex_channels(color: Column) -> tuple[Column, Column, Column]:
    """r, g, b of '#rrggbb'; literals fold to constants."""
    n = F.conv(F.substring(color, 2, 6), 16, 10).cast("int")
    return F.shiftright(n, 16).bitwiseAND(255), F.shiftright(n, 8).bitwiseAND(255), n.bitwiseAND(255)


def hex_ints(color: str) -> tuple[int, int, int]:
    n = int(color[1:], 16)
    return n >> 16, n >> 8 & 255, n & 255


def channels(color) -> tuple:
    """r, g, b of '#rrggbb', or of a colour that every row has of its own: three columns."""
    return hex_ints(color) if isinstance(color, str) else color


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c)), 2, "0") for c in (r, g, b)])


def dist_sq(color, r="r", g="g", b="b") -> Column:
    """Squared RGB distance from a colour (see ``channels``); alpha is ignored."""
    cr, cg, cb = channels(color)
    dr, dg, db = F.col(r) - cr, F.col(g) - cg, F.col(b) - cb
    return dr * dr + dg * dg + db * db


def max_dist_sq(percent):
    """Tolerance in percent, a number or a column, to a squared distance."""
    return (percent / 100) ** 2 * FULL


def clamp(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), v))


def store(v: Column) -> Column:
    """A value as a clamped byte: held to 0..255, rounded half to even."""
    return F.rint(clamp(v.cast("double"), 0.0, 255.0)).cast("int")


def half_up(v: Column) -> Column:
    return F.floor(v + 0.5)


def luma709(r="r", g="g", b="b") -> Column:
    return 0.2126 * F.col(r) + 0.7152 * F.col(g) + 0.0722 * F.col(b)


def luma601(r="r", g="g", b="b") -> Column:
    return F.col(r) * 0.299 + F.col(g) * 0.587 + F.col(b) * 0.114


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top == 0, 0.0).otherwise((top - F.least(r, g, b)) / top)


def fringe_colour(r: Column, g: Column, b: Column) -> Column:
    """Near-white or light grey that anti-aliasing leaves."""
    top, spread, sat = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b), saturation(r, g, b)
    return ((top > 230) & (spread < 20) & (sat < 0.08)) | ((top > 180) & (top < 230) & (spread < 12) & (sat < 0.06))


def colour_name(color: Column) -> Column:
    """white, black, light gray, dark gray or gray for unsaturated colours; else the upper-case hex."""
    r, g, b = hex_channels(color)
    luma = 0.2126 * r + 0.7152 * g + 0.0722 * b
    grey = F.when(luma > 230, "white").when(luma < 25, "black").when(luma > 180, "light gray").when(luma < 80, "dark gray").otherwise("gray")
    return F.when(saturation(r, g, b) < 0.1, grey).otherwise(F.upper(color))


def restore_mode(color: Column) -> Column:
    r, g, b = hex_channels(color)
    luma = 0.2126 * r + 0.7152 * g + 0.0722 * b
    return F.when((saturation(r, g, b) > 0.55) & (luma > 40) & (luma < 220), "solid").otherwise("original")


def bin15(r="r", g="g", b="b") -> Column:
    """The 15-bit colour bin: five bits a channel."""
    cut = [F.shiftright(c, 3) for c in (r, g, b)]
    return F.shiftleft(cut[0], 10).bitwiseOR(F.shiftleft(cut[1], 5)).bitwiseOR(cut[2])


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    t = (x - lo) / (hi - lo)
    return F.when(x <= lo, 0.0).when(x >= hi, 1.0).otherwise(t * t * (3 - 2 * t))


def sinc(x: Column) -> Column:
    return F.sin(math.pi * x) / (math.pi * x)


#: The support of each resampling filter.
FILTER_RADIUS = {"lanczos3": 3, "lanczos2": 2, "bicubic": 2, "bilinear": 1}


def filter_weight(x: Column, name: str) -> Column:
    """The kernel of a resampling filter at x."""
    ax = F.abs(x)
    if name.startswith("lanczos"):
        lobes = FILTER_RADIUS[name]
        return F.when(ax < 1e-8, 1.0).when(ax >= lobes, 0.0).otherwise(sinc(x) * sinc(x / lobes))
    if name == "bicubic":
        near = 1.5 * ax * ax * ax - 2.5 * ax * ax + 1
        far = -0.5 * ax * ax * ax + 2.5 * ax * ax - 4 * ax + 2
        return F.when(ax < 1, near).when(ax < 2, far).otherwise(0.0)
    if name == "bilinear":
        return F.when(ax < 1, 1 - ax).otherwise(0.0)
    raise ValueError(f"no such filter: {name}")


def gaussian_kernel(sigma: float, half: int) -> Column:
    """Weights at -half..half, not normalised."""
    return F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda i: F.exp(-(i * i) / (2 * sigma * sigma)))


def format_bytes(n: Column, decimals: int = 2) -> Column:
    """'0 B', '1.5 KB', ...: base 1024 up to GB, zeros at the end trimmed."""
    i = F.when(n >= 1024**3, 3).when(n >= 1024**2, 2).when(n >= 1024, 1).otherwise(0)
    shown = F.format_string(f"%.{decimals}f", n / F.pow(F.lit(1024.0), i))
    trimmed = F.regexp_replace(F.regexp_replace(shown, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(n.isNull() | (n == 0), "0 B").otherwise(F.concat_ws(" ", trimmed, F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), i + 1)))


def custom_id(name: Column, when_empty: Column | None = None) -> Column:
    """'custom-' and the name as a slug; an empty slug takes ``when_empty`` (a caller's id)."""
    slug = F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("custom-"), F.when(slug == "", F.lit("unnamed") if when_empty is None else when_empty).otherwise(slug))


def px_to_unit(px: Column, unit: str, dpi: float) -> Column:
    return {"px": px, "in": px / dpi, "cm": px / dpi * 2.54}[unit]


def unit_to_px(v: Column, unit: str, dpi: float) -> Column:
    return {"px": v, "in": v * dpi, "cm": v / 2.54 * dpi}[unit]


def round_unit(v: Column, unit: str) -> Column:
    return half_up(v) if unit == "px" else half_up(v * 100) / 100


def font_shorthand(italic: Column, weight: Column, px: Column, family: Column) -> Column:
    size = F.regexp_replace(F.format_string("%.4f", px.cast("double")), r"\.?0+$", "")
    return F.concat_ws(" ", F.when(italic, "italic").otherwise("normal"), weight.cast("string"), F.concat(size, F.lit("px")), family)
