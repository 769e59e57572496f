"""Per-image NumPy kernels for what has no practical relational form; one image is one group.

Images are independent, so the parallelism is the number of images; a kernel's memory is one image. Images too
large for a worker are to be tiled with a halo before they come here.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense(pdf: pd.DataFrame, cols: tuple[str, ...]) -> np.ndarray:
    """(h, w, columns) of a dense group."""
    h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
    out = np.zeros((h, w, len(cols)), dtype=np.float64)
    out[pdf["y"], pdf["x"]] = pdf[list(cols)].to_numpy()
    return out


def rows_of(image_id, planes: dict[str, np.ndarray]) -> pd.DataFrame:
    first = next(iter(planes.values()))
    y, x = np.indices(first.shape)
    return pd.DataFrame({"image_id": image_id, "x": x.ravel(), "y": y.ravel()} | {k: v.ravel() for k, v in planes.items()})


def per_image(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, by=("image_id",)) -> DataFrame:
    return df.groupBy(*by).applyInPandas(fn, schema)


def running(a: np.ndarray, radius: int, axis: int, how: np.ufunc) -> np.ndarray:
    """Minimum or maximum over ``radius`` places to both sides, cut at the ends: forward and backward runs within blocks of the
    window's length, so the cost does not depend on the radius."""
    if radius <= 0:
        return a
    a = np.moveaxis(a, axis, -1)
    n, k = a.shape[-1], 2 * radius + 1
    info = np.iinfo(a.dtype)
    rest = -(n + 2 * radius) % k
    p = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(radius, radius + rest)], constant_values=info.max if how is np.minimum else info.min)
    blocks = p.reshape(*p.shape[:-1], -1, k)
    ahead = how.accumulate(blocks, axis=-1).reshape(p.shape)
    back = how.accumulate(blocks[..., ::-1], axis=-1)[..., ::-1].reshape(p.shape)
    return np.moveaxis(how(back[..., :n], ahead[..., 2 * radius : 2 * radius + n]), -1, axis)


# -- components --------------------------------------------------------------------------------------


def label_array(member: np.ndarray) -> np.ndarray:
    """4-connected components of a boolean raster: each member gets the smallest y * w + x of its component.

    Horizontal runs are the nodes of a union-find; runs of neighbouring rows that overlap are joined.
    """
    h, w = member.shape
    out = np.full((h, w), -1, dtype=np.int64)
    edge = np.zeros((h, w + 2), dtype=np.int8)
    edge[:, 1:-1] = member
    step = np.diff(edge, axis=1)
    ys, starts = np.nonzero(step == 1)
    _, ends = np.nonzero(step == -1)
    up = list(range(len(ys)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(ys, np.arange(h + 1))
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        i_end, j_end = int(first[y]), int(first[y + 1])
        while i < i_end and j < j_end:
            if starts[i] < ends[j] and starts[j] < ends[i]:
                a, b = find(i), find(j)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if ends[i] <= ends[j]:
                i += 1
            else:
                j += 1
    for k in range(len(ys)):
        r = find(k)
        out[ys[k], starts[k] : ends[k]] = ys[r] * w + starts[r]
    return out


def label_components(df: DataFrame, member, by: tuple[str, ...] = (), sizes: DataFrame | None = None) -> DataFrame:
    """image_id, x, y, label of the places where the column ``member`` holds; ``by`` adds grouping columns; ``sizes`` (image_id, w, h) is for a ``df`` that is not dense."""
    sizes = df.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")) if sizes is None else sizes
    only = df.where(member).select("image_id", *by, "x", "y").join(sizes, "image_id")
    types = dict(df.dtypes)
    keys = ("image_id", *by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(pdf["h"].iat[0]), int(pdf["w"].iat[0])), dtype=bool)
        m[pdf["y"], pdf["x"]] = True
        return pdf[[*keys, "x", "y"]].assign(label=label_array(m)[pdf["y"], pdf["x"]])

    return per_image(only, run, ", ".join(f"{k} {types[k]}" for k in keys) + ", x int, y int, label long", keys)


def steps_to(member: np.ndarray) -> np.ndarray:
    """Steps along rows and columns from each place to the nearest member; very many if there is none."""
    d = np.where(member, 0, 1 << 30)
    for axis in (1, 0):
        ramp = np.arange(member.shape[axis]).reshape((1, -1) if axis else (-1, 1))
        ahead = np.minimum.accumulate(d - ramp, axis=axis) + ramp
        back = np.flip(np.minimum.accumulate(np.flip(d + ramp, axis), axis=axis), axis) - ramp
        d = np.minimum(ahead, back)
    return d


def walled_blobs(df: DataFrame, cap: int) -> DataFrame:
    """image_id, x, y, label, wall of the places of ``kind`` 2; ``kind`` is 0 on clear places and 1 on others.

    wall is the least thickness of what surrounds a component: steps from a neighbour of kind 1 to a clear place, 0 beside
    one, 65535 beyond ``cap``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = dense(pdf, ("kind",))[..., 0].astype(np.int8)
        label = label_array(kind == 2)
        steps = steps_to(kind == 0)
        thick = np.where(steps <= cap, steps, 65535)
        least = np.full(kind.size, 65535)
        for own, beside in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            for a, b in ((own, beside), (beside, own)):
                rim = (kind[a] == 2) & (kind[b] != 2)
                np.minimum.at(least, label[a][rim], thick[b][rim])
        y, x = np.nonzero(kind == 2)
        return pd.DataFrame({"image_id": pdf["image_id"].iat[0], "x": x, "y": y, "label": label[y, x], "wall": least[label[y, x]]})

    return per_image(df, run, "image_id long, x int, y int, label long, wall int")


def _beside(m: np.ndarray, rim: bool = False) -> np.ndarray:
    """Places with a neighbour in ``m``; with ``rim`` also those at the border."""
    p = np.pad(m, 1, constant_values=rim)
    return p[1:-1, :-2] | p[1:-1, 2:] | p[:-2, 1:-1] | p[2:, 1:-1]


def _flood_whole(tight: np.ndarray, fringe: np.ndarray, most: int) -> np.ndarray:
    """``flood_depth`` of a whole image: tight components are reached as one, fringe places by steps."""
    tight = tight & fringe
    best = np.full(tight.shape, most + 1, dtype=np.int64)
    label, loose = label_array(tight), fringe & ~tight
    while True:
        met = tight & (best > 0) & _beside(best <= most, True)
        if met.any():
            best[np.isin(label, label[met]) & tight] = 0
        before = best.copy()
        for d in range(1, most + 1):
            best[loose & (best > d) & _beside(best < d, d == 1)] = d
        if (best == before).all():
            return np.where(best <= most, best, -1)


def flood_depth(tight: np.ndarray, fringe: np.ndarray, most: int, rim: dict[tuple[int, int], np.ndarray] | None = None) -> np.ndarray:
    """Least depth of each place reached from the border, -1 elsewhere: 0 on tight places, one more on each fringe step.

    ``rim`` has the depths just outside by side, (-1, 0) left to (0, 1) below, beyond ``most`` where the flood is not; they are 0 if none is given.
    """
    if rim is None:
        return _flood_whole(tight, fringe, most)
    h, w = tight.shape
    best = np.full((h, w), most + 1, dtype=np.int64)
    todo: list[tuple[int, int, int]] = []

    def offer(y: int, x: int, parent: int) -> None:
        if not fringe[y, x] or parent > most:
            return
        d = 0 if tight[y, x] else parent + 1
        if d <= most and d < best[y, x]:
            best[y, x] = d
            todo.append((d, y, x))

    for x in range(w):
        offer(0, x, int(rim[0, -1][x]))
        offer(h - 1, x, int(rim[0, 1][x]))
    for y in range(h):
        offer(y, 0, int(rim[-1, 0][y]))
        offer(y, w - 1, int(rim[1, 0][y]))
    while todo:
        d, y, x = todo.pop()
        if d > best[y, x]:
            continue
        if x:
            offer(y, x - 1, d)
        if x < w - 1:
            offer(y, x + 1, d)
        if y:
            offer(y - 1, x, d)
        if y < h - 1:
            offer(y + 1, x, d)
    return np.where(best <= most, best, -1)


def grow_from(colour: np.ndarray, alpha: np.ndarray, cost: np.ndarray, seed: tuple[int, int], tolerance: float, edge_stop: float, most: int) -> np.ndarray:
    """Breadth-first region from (x, y): right, left, down, up; stops at ``most`` places."""
    h, w = alpha.shape
    x0, y0 = seed
    out = np.zeros((h, w), dtype=bool)
    if not (0 <= x0 < w and 0 <= y0 < h) or alpha[y0, x0] == 0:
        return out
    near = ((colour - colour[y0, x0]) ** 2).sum(axis=2) <= tolerance**2
    may = near & (alpha != 0) & (cost >= 1 - edge_stop)
    out[y0, x0] = True
    queue, at = [(y0, x0)], 0
    while at < len(queue) and len(queue) < most:
        y, x = queue[at]
        at += 1
        for ny, nx in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
            if 0 <= ny < h and 0 <= nx < w and may[ny, nx] and not out[ny, nx]:
                out[ny, nx] = True
                queue.append((ny, nx))
    return out


# -- distances and paths -----------------------------------------------------------------------------


def chamfer(seeds: np.ndarray, cap: int) -> np.ndarray:
    """3-4 chamfer distance to the nearest seed, divided by 3 and cut; places without a seed near stay at the cap."""
    h, w = seeds.shape
    d = np.where(seeds, 0, cap * 3 + 100).astype(np.int64)
    ramp = 3 * np.arange(w)
    for rows, back in ((range(h), -1), (range(h - 1, -1, -1), 1)):
        for y in rows:
            row = d[y]
            p = y + back
            if 0 <= p < h:
                row = np.minimum(row, d[p] + 3)
                row[1:] = np.minimum(row[1:], d[p][:-1] + 4)
                row[:-1] = np.minimum(row[:-1], d[p][1:] + 4)
            # along the row in both senses: a running minimum of d - 3x
            row = np.minimum.accumulate(row - ramp) + ramp
            if back == 1:
                row = (np.minimum.accumulate((row + ramp)[::-1])[::-1]) - ramp
            d[y] = row
    return d // 3


def live_wire(cost: np.ndarray, seed: tuple[int, int], target: tuple[int, int], pad: int = 80) -> list[tuple[int, int]]:
    """Cheapest 8-connected path from seed to target, as (x, y); a step costs the mean of its ends times its length."""
    h, w = cost.shape
    (sx, sy), (tx, ty) = seed, target
    if seed == target:
        return [target]
    x0, x1 = max(0, min(sx, tx) - pad), min(w - 1, max(sx, tx) + pad)
    y0, y1 = max(0, min(sy, ty) - pad), min(h - 1, max(sy, ty) + pad)
    best = {(sx, sy): 0.0}
    came: dict[tuple[int, int], tuple[int, int]] = {}
    heap = [(0.0, sy * w + sx)]
    steps = [(dx, dy, math.hypot(dx, dy)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
    while heap:
        d, i = heapq.heappop(heap)
        u = (i % w, i // w)
        if d > best[u]:
            continue
        if u == (tx, ty):
            break
        for dx, dy, length in steps:
            v = (u[0] + dx, u[1] + dy)
            if x0 <= v[0] <= x1 and y0 <= v[1] <= y1:
                nd = d + (cost[u[1], u[0]] + cost[v[1], v[0]]) / 2 * length
                if nd < best.get(v, math.inf):
                    best[v], came[v] = nd, u
                    heapq.heappush(heap, (nd, v[1] * w + v[0]))
    path, at = [], (tx, ty)
    if at not in came:
        return []
    while at != (sx, sy):
        path.append(at)
        at = came[at]
    return [(sx, sy), *reversed(path)]


def live_wire_paths(cost: DataFrame, requests: DataFrame) -> DataFrame:
    """cost (image_id, x, y, cost) and requests (image_id, seed_x, seed_y, x, y) to image_id, seed, target and path."""
    schema = "image_id long, seed_x int, seed_y int, x int, y int, path array<struct<x:int,y:int>>"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            plane = dense(left, ("cost",))[:, :, 0]
            for r in right.itertuples(index=False):
                path = live_wire(plane, (int(r.seed_x), int(r.seed_y)), (int(r.x), int(r.y)))
                out.append((r.image_id, r.seed_x, r.seed_y, r.x, r.y, [{"x": int(x), "y": int(y)} for x, y in path]))
        return pd.DataFrame(out, columns=["image_id", "seed_x", "seed_y", "x", "y", "path"])

    requests = requests.select(*[F.col(c).alias(c) for c in requests.columns])  # it may stem from cost
    return cost.groupBy("image_id").cogroup(requests.groupBy("image_id")).applyInPandas(run, schema)


# -- smooth geometry ---------------------------------------------------------------------------------


def byte(v: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(v, 0, 255)).astype(np.int64)


def _premultiplied(rgba: np.ndarray) -> np.ndarray:
    out = rgba.copy()
    out[..., :3] *= rgba[..., 3:] / 255
    return out


def _plain(rgba: np.ndarray, places: int | None = None) -> dict[str, np.ndarray]:
    """Bytes of premultiplied planes; ``places`` rounds the plain values before the store, as sums in another order need."""
    a = rgba[..., 3]
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        rgb = np.where(a[..., None] > 0, rgba[..., :3] * (255 / a)[..., None], 0)
    if places is not None:
        rgb, a = np.round(rgb, places), np.round(a, places)
    planes = {c: byte(rgb[..., i]) for i, c in enumerate("rgb")}
    planes["a"] = byte(a)
    return planes


def rotated_size(w: int, h: int, degrees: float) -> tuple[int, int]:
    rad = math.radians(degrees % 360)
    return math.ceil(w * abs(math.cos(rad)) + h * abs(math.sin(rad)) - 1e-9), math.ceil(w * abs(math.sin(rad)) + h * abs(math.cos(rad)) - 1e-9)


def rotated_from(x: np.ndarray, y: np.ndarray, w: int, h: int, degrees: float) -> tuple[np.ndarray, np.ndarray]:
    """Where in the source the places (x, y) of the turned image come from."""
    rad = math.radians(degrees % 360)
    nw, nh = rotated_size(w, h, degrees)
    dx, dy = x + 0.5 - nw / 2, y + 0.5 - nh / 2
    return dx * math.cos(rad) + dy * math.sin(rad) + (w / 2 - 0.5), -dx * math.sin(rad) + dy * math.cos(rad) + (h / 2 - 0.5)


def rotate_region(region: np.ndarray, at: tuple[int, int, int, int], size: tuple[int, int], out: tuple[int, int, int, int], degrees: float) -> dict[str, np.ndarray]:
    """The box ``out`` of the turned image, from the box ``at`` of the source; beyond the source all is transparent."""
    y, x = np.indices((out[3] - out[1], out[2] - out[0])).astype(float)
    sx, sy = rotated_from(x + out[0], y + out[1], *size, degrees)
    h, w, _ = region.shape
    p = np.zeros((h + 2, w + 2, 4))
    p[1:-1, 1:-1] = _premultiplied(region)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]

    def of(yy, xx):
        return p[np.clip(yy - at[1] + 1, 0, h + 1), np.clip(xx - at[0] + 1, 0, w + 1)]

    # summed as the SQL sums, or halves of a level would round the other way
    return _plain(of(y0, x0) * ((1 - fx) * (1 - fy)) + of(y0, x0 + 1) * (fx * (1 - fy)) + of(y0 + 1, x0) * ((1 - fx) * fy) + of(y0 + 1, x0 + 1) * (fx * fy))


def rotate_array(rgba: np.ndarray, degrees: float) -> dict[str, np.ndarray]:
    """Clockwise by any angle: the box grows, places are mapped back and interpolated bilinearly."""
    h, w, _ = rgba.shape
    return rotate_region(rgba, (0, 0, w, h), (w, h), (0, 0, *rotated_size(w, h, degrees)), degrees)


RGBA = "image_id long, x int, y int, r int, g int, b int, a int"


def rotate_degrees(df: DataFrame, degrees: float) -> DataFrame:
    from .geometry import rotate_ortho

    if degrees % 360 == 0:
        return df
    if degrees % 90 == 0:
        return rotate_ortho(df, int(degrees) % 360)
    return per_image(df, lambda pdf: rows_of(pdf["image_id"].iat[0], rotate_array(dense(pdf, tuple("rgba")), degrees)), RGBA)


def blur_plane(a: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return a
    half = max(1, math.ceil(3 * sigma))
    k = np.exp(-(np.arange(-half, half + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        a = np.apply_along_axis(lambda v: np.convolve(v, k, mode="same") if len(v) >= len(k) else np.convolve(v, k)[half : half + len(v)], axis, a)
    return a


def shadow_array(rgba: np.ndarray, dx: float, dy: float, blur: float, color: tuple[int, int, int], opacity: float) -> dict[str, np.ndarray]:
    """The design over its own shifted, blurred alpha in one colour (sigma = blur / 2), on a padded canvas."""
    px, py = math.ceil(abs(dx) + blur * 2), math.ceil(abs(dy) + blur * 2)
    h, w, _ = rgba.shape
    big = np.zeros((h + 2 * py, w + 2 * px, 4))
    big[py : py + h, px : px + w] = rgba
    return shadow_over(big, dx, dy, blur, color, opacity)


def shadow_over(rgba: np.ndarray, dx: float, dy: float, blur: float, color: tuple[int, int, int], opacity: float) -> dict[str, np.ndarray]:
    """The shadow on a canvas that has room for it."""
    big = _premultiplied(rgba)
    cast = np.roll(big[..., 3], (round(dy), round(dx)), axis=(0, 1))
    alpha = blur_plane(cast, blur / 2) * opacity
    under = np.concatenate([np.array(color)[None, None] * (alpha / 255)[..., None], alpha[..., None]], axis=2)
    return _plain(big + under * (1 - big[..., 3:] / 255))


def drop_shadow(df: DataFrame, dx: float, dy: float, blur: float, color: str, opacity: float) -> DataFrame:
    from ..functions.color import hex_ints

    rgb = hex_ints(color)
    return per_image(df, lambda pdf: rows_of(pdf["image_id"].iat[0], shadow_array(dense(pdf, tuple("rgba")), dx, dy, blur, rgb, opacity)), RGBA)


RADIUS = {"lanczos3": 3, "lanczos2": 2, "bicubic": 2, "bilinear": 1}


def _filter(source: int, target: int, name: str, k: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The filter at the source places k for the target places j, not yet of sum 1."""
    scale = source / target
    x = (k - ((j + 0.5) * scale - 0.5)) / max(1.0, scale)
    ax = np.abs(x)
    if name == "bilinear":
        return np.where(ax < 1, 1 - ax, 0)
    if name == "bicubic":
        return np.where(ax < 1, 1.5 * ax**3 - 2.5 * ax**2 + 1, np.where(ax < 2, -0.5 * ax**3 + 2.5 * ax**2 - 4 * ax + 2, 0))
    n = RADIUS[name]
    return np.where(ax < n, np.sinc(x) * np.sinc(x / n), 0)


def weights(source: int, target: int, name: str, k: tuple[int, int] | None = None, j: tuple[int, int] | None = None, *, own: bool = False) -> np.ndarray:
    """(target, source) resampling matrix, or its rows j and columns k, which must hold all that these rows draw on; with ``own`` any columns."""
    j = np.arange(*(j or (0, target)))
    wt = _filter(source, target, name, np.arange(*(k or (0, source)))[None, :], j[:, None])
    if not own:
        return wt / wt.sum(axis=1, keepdims=True)
    # a row's sum is over all of the source that it draws on, row by row: their reach may be most of the image
    scale = source / target
    reach = RADIUS[name] * max(1.0, scale)
    total = np.empty((len(j), 1))
    for n, at in enumerate(j):
        c = (at + 0.5) * scale - 0.5
        total[n] = _filter(source, target, name, np.arange(max(0, math.floor(c - reach)), min(source, math.ceil(c + reach) + 1)), at).sum()
    return wt / total


def resample_region(rgba: np.ndarray, source: tuple[int, int], target: tuple[int, int], name: str, at: tuple[int, int, int, int], out: tuple[int, int, int, int]) -> np.ndarray:
    """The box ``out`` of the resampling from size ``source`` to ``target``, from the source's box ``at``; (height, width, 4) of bytes."""
    wx = weights(source[0], target[0], name, (at[0], at[2]), (out[0], out[2]))
    wy = weights(source[1], target[1], name, (at[1], at[3]), (out[1], out[3]))
    p = _premultiplied(rgba)
    rows = np.stack([p[..., c] @ wx.T for c in range(4)], axis=2)
    planes = _plain(np.stack([wy @ rows[..., c] for c in range(4)], axis=2), 6)
    return np.stack([planes[c] for c in "rgba"], axis=2)


def resample_array(rgba: np.ndarray, width: int, height: int, name: str = "lanczos3") -> np.ndarray:
    """The resampling of ``geometry.resample`` as two matrix products; (height, width, 4) of bytes."""
    h, w, _ = rgba.shape
    return resample_region(rgba, (w, h), (width, height), name, (0, 0, w, h), (0, 0, width, height))


def fitted(w: int, h: int, width: int, height: int, fit: str) -> tuple[int, int, int, int]:
    """The drawn width and height of stretch, contain or cover, and where they begin on the canvas."""
    scale = {"stretch": None, "contain": min(width / w, height / h), "cover": max(width / w, height / h)}[fit]
    dw, dh = (width, height) if scale is None else (max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5)))
    return dw, dh, int((width - dw) / 2 + 0.5) if dw <= width else -int((dw - width) / 2), int((height - dh) / 2 + 0.5) if dh <= height else -int((dh - height) / 2)


def halved(rgba: np.ndarray, times: int) -> np.ndarray:
    """Means of 2 x 2 premultiplied places, ``times`` over, as bytes again; a last odd row or column is dropped."""
    p = _premultiplied(rgba.astype(float))
    for _ in range(times):
        hh, ww = max(1, p.shape[0] // 2), max(1, p.shape[1] // 2)
        p = p[: 2 * hh, : 2 * ww].reshape(hh, 2, ww, 2, 4).mean(axis=(1, 3))
    planes = _plain(p)
    return np.stack([planes[c] for c in "rgba"], axis=2).astype(float)


def resize_array(rgba: np.ndarray, width: int, height: int, fit: str = "stretch") -> np.ndarray:
    """stretch, contain or cover; halves while both sides are over twice the target, then resamples and centres."""
    h, w, _ = rgba.shape
    dw, dh, ox, oy = fitted(w, h, width, height, fit)
    times = 0
    while w >> times > 2 * dw and h >> times > 2 * dh:
        times += 1
    small = resample_array(halved(rgba, times), dw, dh, "bilinear")
    if (dw, dh) == (width, height):
        return small
    out = np.zeros((height, width, 4), dtype=small.dtype)
    src = small[max(0, -oy) : max(0, -oy) + height, max(0, -ox) : max(0, -ox) + width]
    out[max(0, oy) : max(0, oy) + src.shape[0], max(0, ox) : max(0, ox) + src.shape[1]] = src[: height - max(0, oy), : width - max(0, ox)]
    return out


def resize_images(df: DataFrame, width: int, height: int, fit: str = "stretch") -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = resize_array(dense(pdf, tuple("rgba")), width, height, fit)
        return rows_of(pdf["image_id"].iat[0], {c: out[..., i] for i, c in enumerate("rgba")})

    return per_image(df, run, RGBA)


def resample_images(df: DataFrame, width: int, height: int, name: str = "lanczos3") -> DataFrame:
    """The kernel form of resampling: the default for images of any size."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = resample_array(dense(pdf, tuple("rgba")), width, height, name)
        return rows_of(pdf["image_id"].iat[0], {c: out[..., i] for i, c in enumerate("rgba")})

    return per_image(df, run, RGBA)


# -- acrylic preview ---------------------------------------------------------------------------------


def rounded_rect(h: int, w: int, x: float, y: float, width: float, height: float, radius: float) -> np.ndarray:
    """Which places' centres lie in a rounded rectangle."""
    yy, xx = np.indices((h, w)) + 0.5
    r = min(radius, width / 2, height / 2)
    dx = np.maximum(np.maximum(x + r - xx, xx - (x + width - r)), 0)
    dy = np.maximum(np.maximum(y + r - yy, yy - (y + height - r)), 0)
    return (dx * dx + dy * dy <= r * r) & (xx >= x) & (xx <= x + width) & (yy >= y) & (yy <= y + height)


def acrylic_layout(width: int, height: int, out_width: int = 720, padding: int = 36) -> dict[str, float]:
    """Where the panel and the design stand in a preview."""
    aspect = height / max(1, width)
    pw = out_width - padding * 4
    ph = int(pw * aspect + 0.5)
    oh = ph + int(pw * 0.36 + 0.5)
    py = (oh - ph) / 2 - int(pw * 0.04 + 0.5)
    dw = pw - padding * 2
    return {
        "out_w": out_width, "out_h": oh, "panel_x": (out_width - pw) / 2, "panel_y": py, "panel_w": pw, "panel_h": ph, "radius": int(pw * 0.025 + 0.5),
        "design_x": (out_width - pw) / 2 + padding, "design_y": py + (ph - dw * aspect) / 2, "design_w": dw, "design_h": dw * aspect, "shadow_y": py + ph + 14,
    }


def acrylic_array(rgba: np.ndarray, *, out_width: int = 720, padding: int = 36, tint=(232, 220, 204), show_ink: bool = True) -> np.ndarray:
    """Gradient ground, soft shadow, translucent panel, white ink and the design: our own painting of the layout."""
    h, w, _ = rgba.shape
    at = acrylic_layout(w, h, out_width, padding)
    oh, ow = int(at["out_h"]), int(at["out_w"])
    t = np.linspace(0, 1, oh)[:, None, None]
    top, low = np.minimum(255, np.array(tint) + (12, 8, 4)), np.maximum(0, np.array(tint) - (18, 22, 28))
    out = np.broadcast_to(top * (1 - t) + low * t, (oh, ow, 3)).copy()
    yy, xx = np.indices((oh, ow)) + 0.5
    d = np.hypot(xx - ow / 2, (yy - at["shadow_y"]) / 0.18)
    alpha = 0.55 * np.clip(1 - (d - at["panel_w"] * 0.08) / (at["panel_w"] * 0.47), 0, 1)[..., None]
    out = out * (1 - alpha) + np.array([20, 14, 10]) * alpha
    panel = rounded_rect(oh, ow, at["panel_x"], at["panel_y"], at["panel_w"], at["panel_h"], at["radius"])
    p = np.clip((yy - at["panel_y"]) / at["panel_h"], 0, 1)[..., None]
    glass = np.array([248, 250, 252]) * (1 - p) + np.array([228, 232, 238]) * p
    out = np.where(panel[..., None], out * 0.45 + glass * 0.55, out)
    dw, dh = max(1, round(at["design_w"])), max(1, round(at["design_h"]))
    x0, y0 = int(round(at["design_x"])), int(round(at["design_y"]))
    if show_ink:
        ink = (xx > x0 - 2) & (xx < x0 + dw + 2) & (yy > y0 - 2) & (yy < y0 + dh + 2)
        out = np.where(ink[..., None], out * 0.08 + np.array([252, 252, 250]) * 0.92, out)
    art = resize_array(rgba, dw, dh)
    ys, xs = slice(max(0, y0), min(oh, y0 + dh)), slice(max(0, x0), min(ow, x0 + dw))
    part = art[ys.start - y0 : ys.stop - y0, xs.start - x0 : xs.stop - x0]
    a = part[..., 3:] / 255
    out[ys, xs] = out[ys, xs] * (1 - a) + part[..., :3] * a
    return byte(out)


def acrylic_preview(df: DataFrame, out_width: int = 720, padding: int = 36, show_ink: bool = True) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = acrylic_array(dense(pdf, tuple("rgba")), out_width=out_width, padding=padding, show_ink=show_ink)
        planes = {c: out[..., i] for i, c in enumerate("rgb")}
        return rows_of(pdf["image_id"].iat[0], planes | {"a": np.full(out.shape[:2], 255)})

    return per_image(df, run, RGBA)


def debug_overlay(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """Box frames over the pixels: red for kept, green for text; boxes has image_id, min_x.. max_y and verdict."""
    sides = boxes.select("image_id", "min_x", "max_x", "min_y", "max_y", "verdict")
    b = df.join(sides, "image_id", "left").where(
        (((F.col("x") == F.col("min_x")) | (F.col("x") == F.col("max_x"))) & F.col("y").between(F.col("min_y"), F.col("max_y")))
        | (((F.col("y") == F.col("min_y")) | (F.col("y") == F.col("max_y"))) & F.col("x").between(F.col("min_x"), F.col("max_x")))
    )
    frame = b.groupBy("image_id", "x", "y").agg(F.max(F.col("verdict") == "text").alias("text"))
    hit = F.col("text").isNotNull()
    new = {"r": F.when(F.col("text"), 0).otherwise(255), "g": F.when(F.col("text"), 200).otherwise(0), "b": F.lit(0), "a": F.lit(255)}
    return df.join(frame, ["image_id", "x", "y"], "left").withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).drop("text")
