"""Neighbourhood operators as windows along rows, then along columns.

Pixels are dealt by image once; that partitioning serves the windows along x and those along y, so a separable
filter costs one exchange and two sorts. Rasters are dense: every place of an image has a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color as C
from .aggregate import with_size
from .kernels import running
from .point import RGB, hard_alpha
from .tiles import column_by_tiles, columns_by_tiles


def along_x():
    return W.partitionBy("image_id", "y").orderBy("x")


def along_y():
    return W.partitionBy("image_id", "x").orderBy("y")


def dealt(df: DataFrame) -> DataFrame:
    """One exchange by image; windows by (image, row) and (image, column) need no other."""
    return df.repartition("image_id")


#: Up to this radius Spark's sliding frames are used, whose cost grows with it; beyond it running sums and minima, whose cost does not.
SLIDE = 6


def running_sums(df: DataFrame, cols: dict[str, str], radius: int, along) -> DataFrame:
    """New columns (name: column) with sums over ``radius`` places to both sides, cut at the ends, by differences of running sums."""
    so_far, whole = along.rowsBetween(W.unboundedPreceding, W.currentRow), along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumns({f"__{n}": F.sum(c).over(so_far) for n, c in cols.items()})
    ahead = {n: F.coalesce(F.lead(f"__{n}", radius).over(along), F.last(f"__{n}").over(whole)) for n in cols}
    df = df.withColumns({n: ahead[n] - F.coalesce(F.lag(f"__{n}", radius + 1).over(along), F.lit(0)) for n in cols})
    return df.drop(*[f"__{n}" for n in cols])


def separable(df: DataFrame, col: str, radius: int, how, into: str | None = None) -> DataFrame:
    """``how`` (F.min, F.max, F.sum) over the square of ``radius``, cut at the border; ``df`` is to be dealt by image."""
    into = into or col
    if radius <= SLIDE:
        df = df.withColumn(into, how(col).over(along_x().rowsBetween(-radius, radius)))
        return df.withColumn(into, how(into).over(along_y().rowsBetween(-radius, radius)))
    if how is F.sum:
        return running_sums(running_sums(df, {into: col}, radius, along_x()), {into: into}, radius, along_y())
    extreme = np.minimum if how is F.min else np.maximum
    return column_by_tiles(df, col, into, lambda a: running(running(a, radius, 1, extreme), radius, 0, extreme), radius)


def separable_all(df: DataFrame, cols: list[str], radius: int, how) -> DataFrame:
    """``separable`` for several columns in the same two sorts."""
    if radius > SLIDE and how is F.sum:
        same = {c: c for c in cols}
        return running_sums(running_sums(df, same, radius, along_x()), same, radius, along_y())
    df = df.withColumns({c: how(c).over(along_x().rowsBetween(-radius, radius)) for c in cols})
    return df.withColumns({c: how(c).over(along_y().rowsBetween(-radius, radius)) for c in cols})


def erode_alpha(df: DataFrame, radius: int, *, tiles: bool = False) -> DataFrame:
    """With ``tiles`` a small radius goes by tiles too, which costs less where an image has thousands of places."""
    if tiles:
        return column_by_tiles(df, "a", "a", lambda a: running(running(a, radius, 1, np.minimum), radius, 0, np.minimum), radius)
    return separable(dealt(df) if radius <= SLIDE else df, "a", radius, F.min)


def dilate_alpha(df: DataFrame, radius: int) -> DataFrame:
    return separable(dealt(df) if radius <= SLIDE else df, "a", radius, F.max)


def dilate_mask(mask: DataFrame, radius: int) -> DataFrame:
    """A dense 0/1 mask grown to the square of ``radius``."""
    return separable(dealt(mask), "m", radius, F.max)


def alpha_threshold(df: DataFrame, threshold: int, choke: int = 0, *, tiles: bool = False) -> DataFrame:
    return hard_alpha(erode_alpha(df, choke, tiles=tiles) if choke > 0 else df, threshold)


def _at(col: str | Column, dx: int = 0, dy: int = 0) -> Column:
    """A neighbour along one axis; null outside."""
    if dx:
        return (F.lead(col, dx) if dx > 0 else F.lag(col, -dx)).over(along_x())
    if dy:
        return (F.lead(col, dy) if dy > 0 else F.lag(col, -dy)).over(along_y())
    return F.col(col) if isinstance(col, str) else col


def erode_mask4(mask: DataFrame) -> DataFrame:
    """The cross must be set; the border never is."""
    around = [F.coalesce(_at("m", dx, dy), F.lit(0)) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    return dealt(mask).withColumn("m", F.least("m", *around))


def dilate_mask4(mask: DataFrame, n: int) -> DataFrame:
    """n steps of the cross, that is a Manhattan ball: set places are spread over its offsets, clipped by the join."""
    ball = [(dx, dy) for dx in range(-n, n + 1) for dy in range(abs(dx) - n, n - abs(dx) + 1)]
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ball])
    hit = mask.where("m = 1").select("image_id", "x", "y", F.explode(offsets).alias("o")).select("image_id", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y")).distinct()
    return mask.drop("m").join(hit.withColumn("m", F.lit(1)), ["image_id", "x", "y"], "left").withColumn("m", F.coalesce("m", F.lit(0)))


def feather_alpha(df: DataFrame, radius: float) -> DataFrame:
    """Box mean with the border repeated: a cut window sum plus the border value as often as it is repeated."""
    r = int(math.floor(radius + 0.5))
    if radius <= 0:
        return df
    if r > SLIDE:  # by tiles: an image may be larger than a task
        from .packed import box_mean

        return column_by_tiles(df, "a", "a", lambda a: box_mean(a, r), r).select(df.columns)

    def pass_(d: DataFrame, along, pos: str, last: str) -> DataFrame:
        whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        inner = F.sum("s").over(along.rowsBetween(-r, r))
        low = F.greatest(F.lit(0), r - F.col(pos)) * F.first("s").over(whole)
        high = F.greatest(F.lit(0), F.col(pos) + r - (F.col(last) - 1)) * F.last("s").over(whole)
        return d.withColumn("s", inner + low + high)

    d = dealt(with_size(df)).withColumn("s", F.col("a").cast("long"))
    d = pass_(pass_(d, along_x(), "x", "w"), along_y(), "y", "h")
    return d.withColumn("a", C.half_up(F.col("s") / (2 * r + 1) ** 2).cast("int")).select(df.columns)


def sharpen(df: DataFrame, amount: float) -> DataFrame:
    """Cross kernel with centre 1 + 4 amount and sides -amount; the border is repeated."""
    def side(c: str, dx: int, dy: int) -> Column:
        return F.coalesce(_at(c, dx, dy), F.col(c))

    new = {c: C.store(F.col(c) * (1 + 4 * amount) - (side(c, -1, 0) + side(c, 1, 0) + side(c, 0, -1) + side(c, 0, 1)) * amount) for c in RGB}
    return dealt(df).withColumns(new)


def convolve(df: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """Any square kernel, border repeated: rows are summed by windows along x, then the row sums along y."""
    half = len(kernel) // 2
    d = dealt(with_size(df))

    def shifted(col: str, k: int, along, edge_lo: str, edge_hi: str) -> Column:
        if not k:
            return F.col(col)
        return F.coalesce((F.lead(col, k) if k > 0 else F.lag(col, -k)).over(along), F.col(edge_hi if k > 0 else edge_lo))

    whole_x = along_x().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    whole_y = along_y().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    for c in RGB:
        d = d.withColumns({f"{c}_lo": F.first(c).over(whole_x), f"{c}_hi": F.last(c).over(whole_x)})
        rows = {f"{c}_{j}": sum((shifted(c, i - half, along_x(), f"{c}_lo", f"{c}_hi") * float(kernel[j][i]) for i in range(len(kernel))), F.lit(0.0)) for j in range(len(kernel))}
        d = d.withColumns(rows)
        d = d.withColumns({f"{c}_{j}_{e}": f(f"{c}_{j}").over(whole_y) for j in range(len(kernel)) for e, f in (("lo", F.first), ("hi", F.last))})
        d = d.withColumn(f"{c}_out", C.store(sum((shifted(f"{c}_{j}", j - half, along_y(), f"{c}_{j}_lo", f"{c}_{j}_hi") for j in range(len(kernel))), F.lit(0.0))))
    return d.select(*[F.col(f"{c}_out").alias(c) if c in RGB else F.col(c) for c in df.columns])


def _sobel(df: DataFrame, value: Column) -> DataFrame:
    """Adds grad: the gradient's length, 0 on the border."""
    d = dealt(with_size(df)).withColumn("lum", value)
    d = d.withColumns({"row_diff": _at("lum", 1) - _at("lum", -1), "row_sum": _at("lum", -1) + 2 * F.col("lum") + _at("lum", 1)})
    gx = _at("row_diff", 0, -1) + 2 * F.col("row_diff") + _at("row_diff", 0, 1)
    gy = _at("row_sum", 0, 1) - _at("row_sum", 0, -1)
    return d.withColumn("grad", F.coalesce(F.sqrt(gx * gx + gy * gy), F.lit(0.0)))


def edge_map(df: DataFrame) -> DataFrame:
    """image_id, x, y, cost: low on edges; 1 everywhere in a flat image."""
    d = _sobel(df, C.luma601()).withColumn("top", F.max("grad").over(W.partitionBy("image_id")))
    cost = F.when(F.col("top") == 0, 1.0).otherwise(F.greatest(F.lit(0.05), 1 - F.sqrt(F.col("grad") / F.col("top"))))
    return d.select("image_id", "x", "y", cost.alias("cost"))


def edge_aware_sharpen(df: DataFrame, amount: float = 0.5, radius: float = 1.2, threshold: float = 0.08) -> DataFrame:
    """Unsharp mask weighted by edge strength; the blur drops what lies outside and divides by the weights within."""
    if amount <= 0:
        return df
    d = _sobel(df, C.luma601()).withColumn("top", F.max("grad").over(W.partitionBy("image_id")))
    d = d.withColumn("e", F.when(F.col("top") > 0, F.col("grad") / F.col("top")).otherwise(0.0))
    half = max(1, math.ceil(radius * 2))
    taps = {k: math.exp(-(k * k) / (2 * radius * radius)) for k in range(-half, half + 1)}

    def blur(d: DataFrame, cols: dict[str, str], along: str) -> DataFrame:
        at = (lambda c, k: _at(c, k)) if along == "x" else (lambda c, k: _at(c, 0, k))
        pos, last = ("x", "w") if along == "x" else ("y", "h")
        total = sum((F.when((F.col(pos) + k >= 0) & (F.col(pos) + k < F.col(last)), t).otherwise(0.0) for k, t in taps.items()), F.lit(0.0))
        return d.withColumns({new: sum((F.coalesce(at(c, k), F.lit(0.0)) * t for k, t in taps.items()), F.lit(0.0)) / total for c, new in cols.items()})

    d = d.withColumns({f"{c}_f": F.col(c).cast("double") for c in RGB})
    d = blur(d, {f"{c}_f": f"{c}_h" for c in RGB}, "x")
    d = blur(d, {f"{c}_h": f"{c}_v" for c in RGB}, "y")
    boost = C.smoothstep(threshold, threshold + 0.08, F.col("e")) * amount
    return d.withColumns({c: C.store(F.round(F.col(c) + boost * (F.col(c) - F.col(f"{c}_v")), 6)) for c in RGB}).select(df.columns)


_AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]


def _ground(df: DataFrame, color) -> tuple[DataFrame, list[str], Callable[[dict[str, np.ndarray]], list]]:
    """``df`` with the columns that hold ``color`` if each row has its own, their names, and what gives its channels from planes."""
    if isinstance(color, str):
        known = list(C.hex_ints(color))
        return df, [], lambda p: known
    names = [f"__ground_{c}" for c in RGB]
    return df.withColumns(dict(zip(names, (c.cast("int") for c in color), strict=True))), names, lambda p: [p[c] for c in names]


def thicken_lines(df: DataFrame, color: str, tolerance: float = 5, passes: int = 1) -> DataFrame:
    """A background pixel takes the colour of its visible neighbour farthest from the background; ties in raster order. By tiles."""
    passes, most = max(1, passes), C.max_dist_sq(tolerance)
    d, own, ground = _ground(df, color)

    def run(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        px, a = [p[c] for c in RGB], p["a"]
        h, w = a.shape
        for _ in range(passes):
            dist = sum((c - k) * (c - k) for c, k in zip(px, ground(p), strict=True))
            shown = p["there"] & (a != 0)
            bg = shown & (dist <= most)
            far = np.pad(np.where(shown & ~bg, dist, -1), 1, constant_values=-1)
            near = np.stack([far[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dx, dy in _AROUND])
            y, x = np.nonzero(bg & (near.max(axis=0) >= 0))
            dx, dy = np.array(_AROUND)[near[:, y, x].argmax(axis=0)].T  # the first of equals
            px, a = [c.copy() for c in px], a.copy()
            for c, new in zip(px, [c[y + dy, x + dx] for c in px], strict=True):
                c[y, x] = new
            a[y, x] = 255
        return dict(zip((*RGB, "a"), (*px, a), strict=True))

    return columns_by_tiles(d, [*RGB, "a", *own], [*RGB, "a"], run, passes).select(df.columns)


def decontaminated(p: dict[str, np.ndarray], ground: list, drop: float, iterations: int, inner: int) -> dict[str, np.ndarray]:
    """The planes r, g, b, a of ``decontaminate_edges``; it looks (inner + 1) * iterations places away."""
    from .packed import box_sum

    px, a = [p[c].astype(np.int64) for c in RGB], p["a"].copy()
    for _ in range(iterations):
        o = p["there"] & (a == 255)
        beside = np.pad(o | ~p["there"], 1, constant_values=True)
        fringe = o & ~(beside[1:-1, :-2] & beside[1:-1, 2:] & beside[:-2, 1:-1] & beside[2:, 1:-1])
        within = o & ~fringe
        if not (fringe.any() and within.any()):
            break
        n, *sums = (box_sum(box_sum(v, inner, 1, "constant"), inner, 0, "constant") for v in (within, *(c * within for c in px)))
        at = np.nonzero(fringe & (n > 0))
        fg = [s[at] / n[at] for s in sums]
        bg = [k if np.isscalar(k) else k[at] for k in ground]
        span = sum((f - k) * (f - k) for f, k in zip(fg, bg, strict=True))
        along = sum((c[at] - k) * (f - k) for c, f, k in zip(px, fg, bg, strict=True))
        t = np.clip(along / np.where(span > 0, span, 1.0), 0.0, 1.0)
        lost, kept = (span >= 8) & (t < drop), (span >= 8) & (t >= drop)
        for c, f in zip(px, fg, strict=True):
            c[at[0][kept], at[1][kept]] = np.floor(f[kept] + 0.5)
        a[at[0][lost], at[1][lost]] = 0
    return dict(zip((*RGB, "a"), (*px, a), strict=True))


def decontaminate_edges(df: DataFrame, color, drop: float = 0.35, iterations: int = 2, inner: int = 3) -> DataFrame:
    """Opaque pixels beside others are unmixed from the background by the mean of inner pixels around them. By tiles."""
    d, own, ground = _ground(df, color)
    out = columns_by_tiles(d, [*RGB, "a", *own], [*RGB, "a"], lambda p: decontaminated(p, ground(p), drop, iterations, inner), (inner + 1) * iterations)
    return out.select(df.columns)


def remove_color_global(df: DataFrame, color: str, tolerance: float = 3, decontaminate: bool = True) -> DataFrame:
    out = df.withColumn("a", F.when((F.col("a") != 0) & (C.dist_sq(color) <= C.max_dist_sq(tolerance)), 0).otherwise(F.col("a")))
    return decontaminate_edges(out, color, 0.4, 1, 3) if decontaminate else out


def outline(df: DataFrame, width: float, color: str) -> DataFrame:
    """A ring of ``width`` in one colour behind the design, on a canvas padded by it."""
    r = max(1, int(width))
    cr, cg, cb = C.hex_ints(color)
    moved = df.withColumns({"x": F.col("x") + r, "y": F.col("y") + r})
    size = with_size(df).select("image_id", (F.col("w") + 2 * r).alias("w"), (F.col("h") + 2 * r).alias("h")).distinct()
    grid = size.select("image_id", "h", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x")).select("image_id", "x", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    d = grid.join(moved, ["image_id", "x", "y"], "left").withColumn("a0", F.coalesce("a", F.lit(0)))
    d = separable(dealt(d), "a0", r, F.max, "ring").withColumns({"sa": F.coalesce("a", F.lit(0)) / 255, "ra": F.col("ring") / 255})
    alpha = F.col("sa") + F.col("ra") * (1 - F.col("sa"))
    def over(c: str, v: int) -> Column:
        mixed = (F.coalesce(c, F.lit(0)) * F.col("sa") + v * F.col("ra") * (1 - F.col("sa"))) / alpha
        return F.when(alpha == 0, 0).otherwise(C.store(mixed)).cast("int")

    return d.select("image_id", "x", "y", over("r", cr).alias("r"), over("g", cg).alias("g"), over("b", cb).alias("b"), C.store(alpha * 255).alias("a"))


def restore_color(current: DataFrame, original: DataFrame, color: str, tolerance: float, padding: int, search_radius: int, mode: str) -> DataFrame:
    """``current`` with restored: pixels near what is left whose original colour matches come back, with padding."""
    o = original.select("image_id", "x", "y", *[F.col(c).alias(f"o{c}") for c in RGB])
    d = dealt(current.join(o, ["image_id", "x", "y"]))
    d = d.withColumn("near", (F.col("a") > 0).cast("int") if search_radius > 0 else F.lit(1))
    if search_radius > 0:
        d = separable(d, "near", search_radius, F.max)
    hit = (F.col("near") == 1) & (F.col("a") != 255) & (C.dist_sq(color, "or", "og", "ob") <= C.max_dist_sq(tolerance))
    d = d.withColumn("m", hit.cast("int"))
    if padding > 0:
        d = separable(d, "m", padding, F.max)
    back = (F.col("m") == 1) & (F.col("a") != 255)
    solid = dict(zip(RGB, C.hex_ints(color), strict=True))
    d = d.withColumn("restored", back)
    new = {c: F.when(F.col("restored"), F.lit(solid[c]) if mode == "solid" else F.col(f"o{c}")).otherwise(F.col(c)) for c in RGB}
    return d.withColumns(new | {"a": F.when(F.col("restored"), 255).otherwise(F.col("a"))}).select(*current.columns, "restored")
