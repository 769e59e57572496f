"""Packed tiles: one row for a square of an image instead of one for each pixel, for images of any size.

A tile relation is (image_id, w, h, tile, tx, ty, data): the image's size, the tile's side and place, and its pixels row by row, channels
interleaved. An operator is a ``Warp``: which part of the source an output tile needs, and a NumPy kernel over that part. Source
tiles send each output tile only the part that it needs (the strips of a halo, the mapped box of a rotation), one shuffle brings
the parts together, and each output tile is computed alone, so a task holds one tile and its surroundings whatever the image's size. A part is
cut at the image's border and nowhere else, so kernels treat their edges as an image's; what they give at an edge that is
not the image's lies in the halo and is dropped.

Chains of filters cost one shuffle if they run in one kernel under the sum of their halos. Where a figure of the whole image is needed (the
greatest gradient), the parts are written once, the figure is an aggregate over tiles, and a second pass reads both.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import settled
from . import kernels as K
from .aggregate import with_size

TILE = 512
ROWS = 1 << 16
#: Output tiles whose partial sums a task of ``resample`` holds: 24 of 512 x 512 take 200 MB.
HELD = 24
#: Rows of a broadcast side, of an image's number and a figure.
IMAGES = 100_000
Box = tuple[int, int, int, int]  # x0, y0, x1, y1; the ends do not belong to it
KEYS = ["image_id", "w", "h", "tile", "tx", "ty"]


def schema(df: DataFrame) -> str:
    return f"image_id {dict(df.dtypes)['image_id']}, w int, h int, tile int, tx int, ty int, data binary"


def _row(image, w: int, h: int, tile: int, tx: int, ty: int, data: bytes) -> list:
    return [image, w, h, tile, tx, ty, data]


def _batch(rows: list[list], like: pa.DataType, names: list[str] | None = None) -> pa.RecordBatch:
    names = names or [*KEYS, "data"]
    types = [like if n == "image_id" else pa.binary() if n == "data" else pa.float64() if n == "value" else pa.int32() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def tile_box(w: int, h: int, tile: int, tx: int, ty: int) -> Box:
    return tx * tile, ty * tile, min(w, (tx + 1) * tile), min(h, (ty + 1) * tile)


def pack(df: DataFrame, cols: str = "rgba", dtype: str = "u1", tile: int = TILE) -> DataFrame:
    """Dense pixels to tiles of the columns ``cols``; places without a row are 0."""
    d = with_size(df.select("image_id", "x", "y", *cols)).withColumns({"tx": F.floor(F.col("x") / tile).cast("int"), "ty": F.floor(F.col("y") / tile).cast("int")})

    def run(t: pa.Table) -> pa.Table:
        first = {c: t[c][0].as_py() for c in ("image_id", "w", "h", "tx", "ty")}
        x0, y0, x1, y1 = tile_box(first["w"], first["h"], tile, first["tx"], first["ty"])
        out = np.zeros((y1 - y0, x1 - x0, len(cols)), dtype)
        x, y = t["x"].to_numpy() - x0, t["y"].to_numpy() - y0
        for i, c in enumerate(cols):
            out[y, x, i] = t[c].to_numpy()
        return pa.Table.from_batches([_batch([_row(first["image_id"], first["w"], first["h"], tile, first["tx"], first["ty"], out.tobytes())], t.schema.field("image_id").type)])

    return d.groupBy("image_id", "tx", "ty").applyInArrow(run, schema(df))


def cut_images(images: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of the rows of ``sources.images`` (whole images as bytes), without a pixel relation and without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, h, data in zip(*[b.column(c) for c in ("image_id", "width", "height", "data")], strict=True):
                w, h = w.as_py(), h.as_py()
                px = np.frombuffer(data.as_py(), np.uint8).reshape(h, w, 4)
                for ty in range(-(-h // tile)):
                    x = [(tx, tile_box(w, h, tile, tx, ty)) for tx in range(-(-w // tile))]
                    yield _batch([_row(i.as_py(), w, h, tile, tx, ty, px[y0:y1, x0:x1].tobytes()) for tx, (x0, y0, x1, y1) in x], b.schema.field("image_id").type)

    return images.select("image_id", "width", "height", "data").mapInArrow(run, schema(images))


def unpack(tiles: DataFrame, cols: str | tuple[str, ...] = "rgba", dtype: str = "u1", kind: str = "int") -> DataFrame:
    """image_id, x, y and ``cols``, a row for each pixel, in batches of bounded size."""
    image = dict(tiles.dtypes)["image_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *key, data in zip(*[b.column(c) for c in (*KEYS, "data")], strict=True):
                i, w, h, tile, tx, ty = [k.as_py() for k in key]
                x0, y0, x1, y1 = tile_box(w, h, tile, tx, ty)
                px = np.frombuffer(data.as_py(), dtype).reshape(-1, len(cols))
                for at in range(0, len(px), ROWS):
                    place = np.arange(at, min(len(px), at + ROWS))
                    own = [pa.array([i], b.schema.field("image_id").type).take(pa.array(np.zeros(len(place), np.int64)))]
                    own += [pa.array((place % (x1 - x0) + x0).astype(np.int32)), pa.array((place // (x1 - x0) + y0).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(own + [pa.array(px[at : at + ROWS, k].astype({"int": np.int32, "double": np.float64}[kind])) for k in range(len(cols))], names=["image_id", "x", "y", *cols])

    return tiles.mapInArrow(run, f"image_id {image}, x int, y int, " + ", ".join(f"{c} {kind}" for c in cols))


# -- warps ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Warp:
    """The same size; each place looks ``halo`` places around. Subclasses move places."""

    halo: int = 0

    def size(self, w: int, h: int) -> tuple[int, int]:
        return w, h

    def source(self, w: int, h: int, out: Box) -> Box:
        """What the output box needs of the source; may reach beyond the image."""
        return out[0] - self.halo, out[1] - self.halo, out[2] + self.halo, out[3] + self.halo

    def reach(self, w: int, h: int, box: Box) -> Box:
        """Where the source box may be needed: at least all output places that need it."""
        return box[0] - self.halo, box[1] - self.halo, box[2] + self.halo, box[3] + self.halo

    def finish(self, region: np.ndarray, at: Box, w: int, h: int, out: Box) -> np.ndarray:
        """The output box from the source region at ``at`` (its box, cut at the image); here: the box itself."""
        return region[out[1] - at[1] : out[3] - at[1], out[0] - at[0] : out[2] - at[0]]


def clip(box: Box, w: int, h: int) -> Box:
    x0, y0 = min(max(box[0], 0), w), min(max(box[1], 0), h)
    return x0, y0, max(x0, min(box[2], w)), max(y0, min(box[3], h))


def _empty(b: Box) -> bool:
    return b[0] >= b[2] or b[1] >= b[3]


PART = ["image_id", "w", "h", "tile", "tx", "ty", "x0", "y0", "x1", "y1", "data"]


def gather(tiles: DataFrame, warp: Warp, kernel: Callable[[np.ndarray], np.ndarray] | None = None, *, dtype: str = "u1", channels: int = 4, whole: bool = False, sparse: bool = False) -> DataFrame:
    """Output tiles of ``warp``; ``kernel`` is applied to each region before it is finished. With ``whole``, tx and ty are those of the
    output tile but data is its whole region, for passes that need more than one look. With ``sparse``, output tiles that need no
    place of the source are left out."""
    size = np.dtype(dtype).itemsize * channels

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like = b.schema.field("image_id").type
            for *key, data in zip(*[b.column(c) for c in (*KEYS, "data")], strict=True):
                i, w, h, tile, tx, ty = [k.as_py() for k in key]
                box = tile_box(w, h, tile, tx, ty)
                px = np.frombuffer(data.as_py(), np.uint8).reshape(box[3] - box[1], box[2] - box[0], size)
                ow, oh = warp.size(w, h)
                to = clip(warp.reach(w, h, box), ow, oh)
                rows = []
                # the first tile also tells output tiles that need no source that they exist
                first = tx == ty == 0 and not sparse
                over = (0, 0, ow, oh) if first else to
                for oy in range(over[1] // tile, -(-over[3] // tile)):
                    for ox in range(over[0] // tile, -(-over[2] // tile)):
                        need = clip(warp.source(w, h, tile_box(ow, oh, tile, ox, oy)), w, h)
                        part = max(need[0], box[0]), max(need[1], box[1]), min(need[2], box[2]), min(need[3], box[3])
                        if not _empty(need) and not _empty(part):
                            rows.append([i, w, h, tile, ox, oy, *part, px[part[1] - box[1] : part[3] - box[1], part[0] - box[0] : part[2] - box[0]].tobytes()])
                        elif first and _empty(need):
                            rows.append([i, w, h, tile, ox, oy, 0, 0, 0, 0, b""])
                        if len(rows) >= 64:
                            yield _batch(rows, like, PART)
                            rows = []
                if rows:
                    yield _batch(rows, like, PART)

    def meet(t: pa.Table) -> pa.Table:
        i, w, h, tile, tx, ty = [t[c][0].as_py() for c in KEYS]
        ow, oh = warp.size(w, h)
        out = tile_box(ow, oh, tile, tx, ty)
        at = clip(warp.source(w, h, out), w, h)
        region = np.zeros((at[3] - at[1], at[2] - at[0], size), np.uint8)
        for x0, y0, x1, y1, data in zip(*[t[c] for c in PART[6:]], strict=True):
            x0, y0, x1, y1 = x0.as_py(), y0.as_py(), x1.as_py(), y1.as_py()
            if x1 > x0:
                region[y0 - at[1] : y1 - at[1], x0 - at[0] : x1 - at[0]] = np.frombuffer(data.as_py(), np.uint8).reshape(y1 - y0, x1 - x0, size)
        px = np.frombuffer(region.tobytes(), dtype).reshape(*region.shape[:2], channels)
        if not whole:
            px = warp.finish(kernel(px) if kernel else px, at, w, h, out)
        return pa.Table.from_batches([_batch([_row(i, ow, oh, tile, tx, ty, np.ascontiguousarray(px).tobytes())], t.schema.field("image_id").type)])

    kind = dict(tiles.dtypes)["image_id"]
    parts = tiles.mapInArrow(send, f"image_id {kind}, w int, h int, tile int, tx int, ty int, x0 int, y0 int, x1 int, y1 int, data binary")
    return parts.groupBy("image_id", "tx", "ty").applyInArrow(meet, schema(tiles))


def each(tiles: DataFrame, fn: Callable[[np.ndarray, Box, tuple[int, int], float], np.ndarray], *, halo: int = 0, dtype: str = "u1", channels: int = 4, with_value: bool = False) -> DataFrame:
    """``fn(region, own box within it, image size, value)`` on tiles or, with ``halo``, on the regions that ``gather(whole=True)`` gave."""
    names = [*KEYS, "data", *(["value"] if with_value else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*[b.column(c) for c in names], strict=True):
                i, w, h, tile, tx, ty, data, *value = [v.as_py() for v in row]
                out = tile_box(w, h, tile, tx, ty)
                at = clip((out[0] - halo, out[1] - halo, out[2] + halo, out[3] + halo), w, h)
                px = np.frombuffer(data, dtype).reshape(at[3] - at[1], at[2] - at[0], channels)
                done = fn(px, (out[0] - at[0], out[1] - at[1], out[2] - at[0], out[3] - at[1]), (w, h), value[0] if value else 0.0)
                yield _batch([_row(i, w, h, tile, tx, ty, np.ascontiguousarray(done).tobytes())], b.schema.field("image_id").type)

    return tiles.select(*names).mapInArrow(run, schema(tiles))


def per_tile(tiles: DataFrame, fn: Callable[[np.ndarray, Box], float], *, halo: int = 0, dtype: str = "u1", channels: int = 4) -> DataFrame:
    """image_id, value: one figure for each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *key, data in zip(*[b.column(c) for c in (*KEYS, "data")], strict=True):
                i, w, h, tile, tx, ty = [k.as_py() for k in key]
                out = tile_box(w, h, tile, tx, ty)
                at = clip((out[0] - halo, out[1] - halo, out[2] + halo, out[3] + halo), w, h)
                px = np.frombuffer(data.as_py(), dtype).reshape(at[3] - at[1], at[2] - at[0], channels)
                yield _batch([[i, float(fn(px, (out[0] - at[0], out[1] - at[1], out[2] - at[0], out[3] - at[1])))]], b.schema.field("image_id").type, ["image_id", "value"])

    return tiles.select(*KEYS, "data").mapInArrow(run, f"image_id {dict(tiles.dtypes)['image_id']}, value double")


def row_sums(tiles: DataFrame, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], band: int, *, dtype: str = "u1", channels: int = 4) -> DataFrame:
    """image_id, band, n, total: over each ``band`` rows of an image the count of its places and the sum of ``fn(px, x, y)`` (integers), tile by tile.

    Tiles that are left out count as places of sum 0. The tiles are computed once: the sums, which are few, are written and looked at twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *key, data in zip(*[b.column(c) for c in (*KEYS, "data")], strict=True):
                i, w, h, tile, tx, ty = [k.as_py() for k in key]
                x0, y0, x1, y1 = tile_box(w, h, tile, tx, ty)
                y, x = np.ogrid[y0:y1, x0:x1]
                sums = fn(np.frombuffer(data.as_py(), dtype).reshape(y1 - y0, x1 - x0, channels), x, y).astype(np.int64).sum(axis=1)
                own, total = np.unique(y[:, 0] // band, return_inverse=True)
                out = np.zeros(len(own), np.int64)
                np.add.at(out, total, sums)
                like = b.schema.field("image_id").type
                size = [pa.array(np.full(len(own), v)) for v in (w, h)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(own), like), pa.array(own.astype(np.int64)), pa.array(out), *size], names=["image_id", "band", "total", "w", "h"])

    kind = dict(tiles.dtypes)["image_id"]
    sums = tiles.select(*KEYS, "data").mapInArrow(run, f"image_id {kind}, band long, total long, w long, h long")
    sums = settled(sums.groupBy("image_id", "band").agg(F.sum("total").alias("total"), F.max("w").alias("w"), F.max("h").alias("h")), "row-sums")
    every = sums.groupBy("image_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    every = every.select("image_id", "w", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("h") - 1) / band))).alias("band"))
    n = F.col("w") * F.least(F.lit(band), F.col("h") - F.col("band") * band)
    return every.join(sums.select("image_id", "band", "total"), ["image_id", "band"], "left").select("image_id", "band", n.alias("n"), F.coalesce("total", F.lit(0).cast("long")).alias("total"))


# -- filters -----------------------------------------------------------------------------------------------------------


def box_sum(a: np.ndarray, radius: int, axis: int, mode: str) -> np.ndarray:
    """Sums over ``radius`` places to both sides by differences of running sums; ``mode`` edge repeats the border, constant drops it."""
    a = np.moveaxis(a.astype(np.int64), axis, -1)
    p = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(radius + 1, radius)], mode=mode)
    p[..., 0] = 0
    c = np.cumsum(p, axis=-1)
    return np.moveaxis(c[..., 2 * radius + 1 :] - c[..., : -(2 * radius + 1)], -1, axis)


def box_mean(a: np.ndarray, r: int) -> np.ndarray:
    return np.floor(box_sum(box_sum(a, r, 1, "edge"), r, 0, "edge") / (2 * r + 1) ** 2 + 0.5)


def with_alpha(px: np.ndarray, a: np.ndarray) -> np.ndarray:
    out = px.copy()
    out[..., 3] = a
    return out


def erode_alpha(tiles: DataFrame, radius: int, how: np.ufunc = np.minimum) -> DataFrame:
    return gather(tiles, Warp(radius), lambda px: with_alpha(px, K.running(K.running(px[..., 3], radius, 1, how), radius, 0, how)))


def dilate_alpha(tiles: DataFrame, radius: int) -> DataFrame:
    return erode_alpha(tiles, radius, np.maximum)


def feather_alpha(tiles: DataFrame, radius: float) -> DataFrame:
    r = int(math.floor(radius + 0.5))

    return gather(tiles, Warp(r), lambda px: with_alpha(px, box_mean(px[..., 3], r))) if radius > 0 else tiles


def sharpen(tiles: DataFrame, amount: float) -> DataFrame:
    def run(px: np.ndarray) -> np.ndarray:
        p = np.pad(px[..., :3].astype(np.float64), ((1, 1), (1, 1), (0, 0)), mode="edge")
        new = p[1:-1, 1:-1] * (1 + 4 * amount) - (p[1:-1, :-2] + p[1:-1, 2:] + p[:-2, 1:-1] + p[2:, 1:-1]) * amount
        return np.concatenate([K.byte(new).astype(np.uint8), px[..., 3:]], axis=2)

    return gather(tiles, Warp(1), run)


def gradient(px: np.ndarray) -> np.ndarray:
    """Length of the Sobel gradient of the luma, 0 on the border."""
    r, g, b = (px[..., k].astype(np.float64) for k in range(3))
    lum = r * 0.299 + g * 0.587 + b * 0.114
    out = np.zeros(lum.shape)
    if min(lum.shape) > 2:
        diff, total = lum[:, 2:] - lum[:, :-2], lum[:, :-2] + 2 * lum[:, 1:-1] + lum[:, 2:]
        gx, gy = diff[:-2] + 2 * diff[1:-1] + diff[2:], total[2:] - total[:-2]
        out[1:-1, 1:-1] = np.sqrt(gx * gx + gy * gy)
    return out


def own(a: np.ndarray, box: Box) -> np.ndarray:
    return a[box[1] : box[3], box[0] : box[2]]


def _with_top(tiles: DataFrame, halo: int, label: str) -> DataFrame:
    """The regions of ``tiles``, written once, with value: the image's greatest gradient."""
    regions = settled(gather(tiles, Warp(halo), whole=True), label)
    top = per_tile(regions, lambda px, box: own(gradient(px), box).max(initial=0.0), halo=halo).groupBy("image_id").agg(F.max("value").alias("value"))
    # a row an image: of few images it goes to the regions, which then stay where they are
    top = settled(top, label + "-top")
    return regions.join(F.broadcast(top) if top.limit(IMAGES + 1).count() <= IMAGES else top, "image_id")


def edge_map(tiles: DataFrame) -> DataFrame:
    """Tiles of one double a place: as ``window.edge_map``; ``unpack(..., ("cost",), "f8", "double")`` gives its rows."""

    def run(px: np.ndarray, box: Box, size: tuple[int, int], top: float) -> np.ndarray:
        grad = own(gradient(px), box)
        return np.ones(grad.shape) if top == 0 else np.maximum(0.05, 1 - np.sqrt(grad / top))

    return each(_with_top(tiles, 1, "edge-regions"), run, halo=1, with_value=True)


def edge_aware_sharpen(tiles: DataFrame, amount: float = 0.5, radius: float = 1.2, threshold: float = 0.08) -> DataFrame:
    if amount <= 0:
        return tiles
    half = max(1, math.ceil(radius * 2))
    taps = {k: math.exp(-(k * k) / (2 * radius * radius)) for k in range(-half, half + 1)}

    def blur(a: np.ndarray, axis: int) -> np.ndarray:
        n = a.shape[axis]
        p = np.pad(a, [(half, half) if d == axis else (0, 0) for d in range(a.ndim)])
        inside = np.pad(np.ones(n), half)
        at = [slice(None)] * a.ndim
        total, weight = np.zeros(a.shape), np.zeros(n)
        for k, t in taps.items():
            at[axis] = slice(half + k, half + k + n)
            total = total + p[tuple(at)] * t
            weight = weight + inside[half + k : half + k + n] * t
        shape = [1] * a.ndim
        shape[axis] = n
        return total / weight.reshape(shape)

    def run(px: np.ndarray, box: Box, size: tuple[int, int], top: float) -> np.ndarray:
        e = own(gradient(px), box) / top if top > 0 else np.zeros((box[3] - box[1], box[2] - box[0]))
        u = np.clip((e - threshold) / 0.08, 0, 1)
        boost = (u * u * (3 - 2 * u) * amount)[..., None]
        rgb = px[..., :3].astype(np.float64)
        soft, mine = own(blur(blur(rgb, 1), 0), box), own(rgb, box)
        new = K.byte(np.round(mine + boost * (mine - soft), 6)).astype(np.uint8)
        return np.concatenate([new, own(px, box)[..., 3:]], axis=2)

    return each(_with_top(tiles, half, "sharpen-regions"), run, halo=half, with_value=True)


def chamfer(tiles: DataFrame, seed: Callable[[np.ndarray], np.ndarray], cap: int) -> DataFrame:
    """Tiles of one int32 a place: 3-4 chamfer distance to the nearest place where ``seed`` of the pixels holds.

    The kernel cuts at ``cap * 3 + 100`` thirds, so nothing farther than that many places can matter: a halo of it is exact.
    """
    halo = (cap * 3 + 100) // 3 + 1
    return gather(tiles, Warp(halo), lambda px: K.chamfer(seed(px), cap)[..., None].astype("<i4"))


# -- moved places ------------------------------------------------------------------------------------------------------


def _bytes_of(planes: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([planes[c] for c in "rgba"], axis=2).astype(np.uint8)


@dataclass(frozen=True)
class Rotate(Warp):
    degrees: float = 0.0

    def size(self, w: int, h: int) -> tuple[int, int]:
        return K.rotated_size(w, h, self.degrees)

    def _box(self, corners: list[tuple[float, float]], margin: int) -> Box:
        xs, ys = [c[0] for c in corners], [c[1] for c in corners]
        return math.floor(min(xs)) - margin, math.floor(min(ys)) - margin, math.ceil(max(xs)) + margin + 1, math.ceil(max(ys)) + margin + 1

    def source(self, w: int, h: int, out: Box) -> Box:
        ends = [(x, y) for x in (out[0], out[2] - 1) for y in (out[1], out[3] - 1)]
        found = [K.rotated_from(np.array(float(x)), np.array(float(y)), w, h, self.degrees) for x, y in ends]
        return self._box([(float(x), float(y)) for x, y in found], 1)

    def reach(self, w: int, h: int, box: Box) -> Box:
        nw, nh = self.size(w, h)
        c, s = math.cos(math.radians(self.degrees % 360)), math.sin(math.radians(self.degrees % 360))
        ends = [(x + 0.5 - w / 2, y + 0.5 - h / 2) for x in (box[0] - 2, box[2] + 1) for y in (box[1] - 2, box[3] + 1)]
        return self._box([(x * c - y * s + nw / 2 - 0.5, x * s + y * c + nh / 2 - 0.5) for x, y in ends], 2)

    def finish(self, region: np.ndarray, at: Box, w: int, h: int, out: Box) -> np.ndarray:
        return _bytes_of(K.rotate_region(region.astype(np.float64), at, (w, h), out, self.degrees))


def rotate_degrees(tiles: DataFrame, degrees: float, *, sparse: bool = False) -> DataFrame:
    """Clockwise by any angle, right angles too: as ``kernels.rotate_degrees``. The turned box of a long image is mostly clear and
    grows with the square of its length; ``sparse`` leaves out tiles that are wholly outside the image."""
    return tiles if degrees % 360 == 0 else gather(tiles, Rotate(degrees=degrees), sparse=sparse)


def _taps(source: int, target: int, name: str, j0: int, j1: int) -> tuple[int, int]:
    """The source places that the targets j0 to j1 - 1 draw on; may reach beyond the source."""
    scale = source / target
    radius = K.RADIUS[name] * max(1.0, scale)
    return math.floor((j0 + 0.5) * scale - 0.5 - radius), math.ceil((j1 - 0.5) * scale - 0.5 + radius) + 1


def _draws(source: int, target: int, name: str, k0: int, k1: int) -> tuple[int, int]:
    """The targets that may draw on the source places k0 to k1 - 1."""
    scale = source / target
    radius = K.RADIUS[name] * max(1.0, scale) + 1
    return math.floor((k0 - radius + 0.5) / scale - 0.5) - 1, math.ceil((k1 - 1 + radius + 0.5) / scale - 0.5) + 2


@dataclass(frozen=True)
class Resize(Warp):
    """Stretch, contain or cover with halving while both sides are over twice the target, then a filter; ``halving`` False only filters."""

    width: int = 1
    height: int = 1
    name: str = "bilinear"
    fit: str = "stretch"
    halving: bool = True

    def size(self, w: int, h: int) -> tuple[int, int]:
        return self.width, self.height

    def plan(self, w: int, h: int) -> tuple[int, int, int, int, int, int, int]:
        """Drawn width and height, offset, halvings, halved width and height."""
        dw, dh, ox, oy = K.fitted(w, h, self.width, self.height, self.fit)
        n, cw, ch = 0, w, h
        while self.halving and cw > 2 * dw and ch > 2 * dh:
            n, cw, ch = n + 1, max(1, cw // 2), max(1, ch // 2)
        return dw, dh, ox, oy, n, cw, ch

    def _drawn(self, out: Box, dw: int, dh: int, ox: int, oy: int) -> Box:
        return clip((out[0] - ox, out[1] - oy, out[2] - ox, out[3] - oy), dw, dh)

    def _halved(self, d: Box, dw: int, dh: int, cw: int, ch: int) -> Box:
        x, y = _taps(cw, dw, self.name, d[0], d[2]), _taps(ch, dh, self.name, d[1], d[3])
        return clip((x[0], y[0], x[1], y[1]), cw, ch)

    def source(self, w: int, h: int, out: Box) -> Box:
        dw, dh, ox, oy, n, cw, ch = self.plan(w, h)
        d = self._drawn(out, dw, dh, ox, oy)
        if _empty(d):
            return 0, 0, 0, 0
        return tuple(v << n for v in self._halved(d, dw, dh, cw, ch))

    def reach(self, w: int, h: int, box: Box) -> Box:
        dw, dh, ox, oy, n, cw, ch = self.plan(w, h)
        x, y = _draws(cw, dw, self.name, box[0] >> n, (box[2] >> n) + 1), _draws(ch, dh, self.name, box[1] >> n, (box[3] >> n) + 1)
        return x[0] + ox, y[0] + oy, x[1] + ox, y[1] + oy

    def finish(self, region: np.ndarray, at: Box, w: int, h: int, out: Box) -> np.ndarray:
        dw, dh, ox, oy, n, cw, ch = self.plan(w, h)
        done = np.zeros((out[3] - out[1], out[2] - out[0], 4), np.uint8)
        d = self._drawn(out, dw, dh, ox, oy)
        if not _empty(d):
            k = self._halved(d, dw, dh, cw, ch)
            p = K.halved(region.astype(np.float64), n) if self.halving else region.astype(np.float64)
            small = K.resample_region(p, (cw, ch), (dw, dh), self.name, k, d)
            done[d[1] + oy - out[1] : d[3] + oy - out[1], d[0] + ox - out[0] : d[2] + ox - out[0]] = small
        return done


def resample(tiles: DataFrame, width: int, height: int, name: str = "lanczos3") -> DataFrame:
    """As ``kernels.resample_images``.

    Both passes are sums, so each source tile adds its share to the output places that draw on it: a task holds partial sums of output
    tiles, however many source places one of them draws on.
    """
    names = ["image_id", "w", "h", "tile", "tx", "ty", "data"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        like = None

        def flush() -> Iterator[pa.RecordBatch]:
            for k in list(held):
                yield _batch([[*k, held.pop(k).tobytes()]], like, names)

        for b in batches:
            like = b.schema.field("image_id").type
            for *key, data in zip(*[b.column(c) for c in (*KEYS, "data")], strict=True):
                i, w, h, tile, tx, ty = [k.as_py() for k in key]
                x0, y0, x1, y1 = box = tile_box(w, h, tile, tx, ty)
                px = K._premultiplied(np.frombuffer(data.as_py(), np.uint8).reshape(y1 - y0, x1 - x0, 4).astype(np.float64))
                jx, jy = _draws(w, width, name, box[0], box[2]), _draws(h, height, name, box[1], box[3])
                to = clip((jx[0], jy[0], jx[1], jy[1]), width, height)
                if _empty(to):
                    continue
                wx, wy = (K.weights(s, t, name, (k0, k1), (j0, j1), own=True) for s, t, k0, k1, j0, j1 in ((w, width, x0, x1, to[0], to[2]), (h, height, y0, y1, to[1], to[3])))
                rows = np.stack([px[..., c] @ wx.T for c in range(4)], axis=2)
                part = np.stack([wy @ rows[..., c] for c in range(4)], axis=2)
                for oy in range(to[1] // tile, -(-to[3] // tile)):
                    for ox in range(to[0] // tile, -(-to[2] // tile)):
                        out = tile_box(width, height, tile, ox, oy)
                        both = max(out[0], to[0]), max(out[1], to[1]), min(out[2], to[2]), min(out[3], to[3])
                        k = (i, w, h, tile, ox, oy)
                        if k not in held:
                            if len(held) >= HELD:
                                yield from flush()
                            held[k] = np.zeros((out[3] - out[1], out[2] - out[0], 4))
                        held[k][both[1] - out[1] : both[3] - out[1], both[0] - out[0] : both[2] - out[0]] += part[both[1] - to[1] : both[3] - to[1], both[0] - to[0] : both[2] - to[0]]
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = None, None
        for b in batches:
            for *k, data in zip(*[b.column(c) for c in names], strict=True):
                at = at or ([v.as_py() for v in k], b.schema.field("image_id").type)
                part = np.frombuffer(data.as_py(), np.float64)
                total = part.copy() if total is None else total + part
        (i, _, _, tile, tx, ty), like = at
        x0, y0, x1, y1 = tile_box(width, height, tile, tx, ty)
        planes = K._plain(total.reshape(y1 - y0, x1 - x0, 4), 6)
        yield _batch([_row(i, width, height, tile, tx, ty, _bytes_of(planes).tobytes())], like)

    return tiles.mapInArrow(add, schema(tiles)).groupBy("image_id", "tx", "ty").applyInArrow(meet, schema(tiles))


def resize(tiles: DataFrame, width: int, height: int, fit: str = "stretch") -> DataFrame:
    """As ``kernels.resize_images``."""
    return gather(tiles, Resize(width=width, height=height, fit=fit))


@dataclass(frozen=True)
class Shadow(Warp):
    dx: float = 0.0
    dy: float = 0.0
    blur: float = 0.0
    color: tuple[int, int, int] = (0, 0, 0)
    opacity: float = 1.0

    def _pad(self) -> tuple[int, int]:
        return math.ceil(abs(self.dx) + self.blur * 2), math.ceil(abs(self.dy) + self.blur * 2)

    def _margin(self) -> tuple[int, int]:
        half = max(1, math.ceil(3 * self.blur / 2)) if self.blur > 0 else 0
        return abs(round(self.dx)) + half, abs(round(self.dy)) + half

    def size(self, w: int, h: int) -> tuple[int, int]:
        px, py = self._pad()
        return w + 2 * px, h + 2 * py

    def source(self, w: int, h: int, out: Box) -> Box:
        (px, py), (mx, my) = self._pad(), self._margin()
        return out[0] - px - mx, out[1] - py - my, out[2] - px + mx, out[3] - py + my

    def reach(self, w: int, h: int, box: Box) -> Box:
        (px, py), (mx, my) = self._pad(), self._margin()
        return box[0] + px - mx, box[1] + py - my, box[2] + px + mx, box[3] + py + my

    def finish(self, region: np.ndarray, at: Box, w: int, h: int, out: Box) -> np.ndarray:
        x0, y0, x1, y1 = self.source(w, h, out)
        big = np.zeros((y1 - y0, x1 - x0, 4))
        big[at[1] - y0 : at[3] - y0, at[0] - x0 : at[2] - x0] = region
        (mx, my) = self._margin()
        planes = K.shadow_over(big, self.dx, self.dy, self.blur, self.color, self.opacity)
        return _bytes_of({k: v[my : my + out[3] - out[1], mx : mx + out[2] - out[0]] for k, v in planes.items()})


def drop_shadow(tiles: DataFrame, dx: float, dy: float, blur: float, color: str, opacity: float) -> DataFrame:
    """As ``kernels.drop_shadow``."""
    from ..functions.color import hex_ints

    return gather(tiles, Shadow(dx=dx, dy=dy, blur=blur, color=hex_ints(color), opacity=opacity))
