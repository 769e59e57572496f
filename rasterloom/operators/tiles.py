"""Images larger than a task: tiles with a halo for windows, labels of tiles merged over their seams.

``tiled`` runs a window operator on every tile as if it were an image: a tile has the pixels of its own square and of
``halo`` places around it, and only its own are kept, so that an operator which looks at most ``halo`` places away gives what
it gives on the whole image. Tiles of one image go to different tasks.

``label_tiled`` labels each tile by the kernel, finds which labels meet across the tiles' borders, and merges them by rounds of
large and small stars. Only labels at a border take part. The result equals that of the whole image.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import settled
from .kernels import label_array, per_image

#: Side of a tile: a million places, of which a kernel holds a few tens of megabytes.
TILE = 1024


def _span(v: str, halo: int, tile: int) -> Column:
    """The tiles that a place belongs to, its halo included."""
    return F.sequence(F.greatest(F.floor((F.col(v) - halo) / tile), F.lit(0)).cast("int"), F.floor((F.col(v) + halo) / tile).cast("int"))


def with_halo(df: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """``df`` with a row for each tile that a pixel is seen by; image_id becomes (image_id, tx, ty)."""
    d = df.withColumn("tx", F.explode(_span("x", halo, tile))).withColumn("ty", F.explode(_span("y", halo, tile)))
    return d.withColumn("image_id", F.struct("image_id", "tx", "ty")).drop("tx", "ty")


def tiled(df: DataFrame, op: Callable[[DataFrame], DataFrame], halo: int, tile: int = TILE) -> DataFrame:
    """``op`` by tiles; it keeps image_id, x and y, and looks at most ``halo`` places away."""
    out = op(with_halo(df, halo, tile))
    own = (F.floor(F.col("x") / tile) == F.col("image_id.tx")) & (F.floor(F.col("y") / tile) == F.col("image_id.ty"))
    return out.where(own).withColumn("image_id", F.col("image_id.image_id"))


def planes_of(t: pa.Table, cols: list[str], x0: int, y0: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The columns of a group of pixels as planes whose corner is (x0, y0) and ``there``, where it has pixels; each pixel's row and column in them."""
    x, y = t["x"].to_numpy() - x0, t["y"].to_numpy() - y0
    planes = {}
    for c in ("there", *cols):
        planes[c] = np.zeros((y.max() + 1, x.max() + 1), np.bool_ if c == "there" else np.int32)
        planes[c][y, x] = True if c == "there" else t[c].to_numpy()
    return planes, y, x


#: Takes planes by column and there, gives those that change.
Kernel = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def _kept(col: pa.ChunkedArray) -> pa.ChunkedArray:
    """A column as a result's schema has it: fields of a struct (the image_id of ``with_halo``) may be null there."""
    return col.cast(pa.struct([f.with_nullable(True) for f in col.type])) if pa.types.is_struct(col.type) else col


def _changed(t: pa.Table, kinds: dict[str, str], into: list[str], new: dict[str, np.ndarray], y: np.ndarray, x: np.ndarray) -> pa.Table:
    return pa.table({c: pa.array(new[c][y, x].astype(np.int32)) if c in into else _kept(t[c]) for c in kinds})


def columns_by_tiles(df: DataFrame, cols: list[str], into: list[str], kernel: Kernel, halo: int, tile: int = TILE) -> DataFrame:
    """``df`` with the columns ``into`` (int): ``kernel`` of the planes of ``cols``, tile by tile; it looks at most ``halo`` places away."""
    kinds = dict(df.dtypes) | {c: "int" for c in into}
    d = df.withColumn("__tx", F.explode(_span("x", halo, tile))).withColumn("__ty", F.explode(_span("y", halo, tile)))

    def run(t: pa.Table) -> pa.Table:
        tx, ty = t["__tx"][0].as_py(), t["__ty"][0].as_py()
        x0, y0 = t["x"].to_numpy().min(), t["y"].to_numpy().min()
        planes, y, x = planes_of(t, cols, x0, y0)
        own = ((x + x0) // tile == tx) & ((y + y0) // tile == ty)
        out = _changed(t, kinds, into, kernel(planes), y, x)
        return out if own.all() else out.filter(pa.array(own))

    return d.groupBy("image_id", "__tx", "__ty").applyInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def column_by_tiles(df: DataFrame, col: str, into: str, kernel: Callable[[np.ndarray], np.ndarray], halo: int, tile: int = TILE) -> DataFrame:
    """``columns_by_tiles`` of one plane."""
    return columns_by_tiles(df, [col], [into], lambda p: {into: kernel(p[col])}, halo, tile)


def columns_by_image(df: DataFrame, cols: list[str], into: list[str], kernel: Kernel) -> DataFrame:
    """``df`` with the columns ``into`` (int): ``kernel`` of the planes of ``cols``, an image at a time, for what looks at a whole image."""
    kinds = dict(df.dtypes) | {c: "int" for c in into}

    def run(t: pa.Table) -> pa.Table:
        planes, y, x = planes_of(t, cols, 0, 0)
        return _changed(t, kinds, into, kernel(planes), y, x)

    return df.groupBy("image_id").applyInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def merged(edges: DataFrame) -> DataFrame:
    """image_id, label, root (least label): the connected components of edges (image_id, u, v) between labels."""
    ends = ["image_id", "u", "v"]

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("image_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def step(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), ["image_id", "u"]).where("v > u").select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = least(large)
        small = large.join(low, ["image_id", "u"]).select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("image_id", "u", F.col("m").alias("v")))
        return small.where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64(*ends).cast("decimal(38,0)"))).first())

    e = settled(edges.select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "seams")
    seen = mark(e)
    while seen[0]:
        e = settled(step(e), "seams")
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select("image_id", F.col("u").alias("label"), F.col("v").alias("root"))


def label_tiled(df: DataFrame, member: Column, tile: int = TILE) -> DataFrame:
    """image_id, x, y, label of the places where ``member`` holds: as ``label_components``, a tile at a time."""
    kind = dict(df.dtypes)["image_id"]
    tx, ty = F.floor(F.col("x") / tile).cast("int").alias("tx"), F.floor(F.col("y") / tile).cast("int").alias("ty")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["ty"].iat[0]) * tile, int(pdf["tx"].iat[0]) * tile
        m = np.zeros((tile, tile), dtype=bool)
        m[pdf["y"] - y0, pdf["x"] - x0] = True
        own = label_array(m)[pdf["y"] - y0, pdf["x"] - x0]
        # the component's first place, row by row, as row << 32 | column of the image
        return pdf[["image_id", "x", "y"]].assign(label=(own // tile + y0) << 32 | own % tile + x0)

    only = df.where(member).select("image_id", "x", "y", tx, ty)
    labels = settled(per_image(only, run, f"image_id {kind}, x int, y int, label long", ("image_id", "tx", "ty")), "tile-labels")
    last = tile - 1
    seams = None
    for v, dx, dy in (("x", 1, 0), ("y", 0, 1)):
        here = labels.where(F.col(v) % tile == last).select("image_id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col("label").alias("u"))
        met = here.join(labels.where(F.col(v) % tile == 0).withColumnRenamed("label", "v"), ["image_id", "x", "y"]).select("image_id", "u", "v")
        seams = met if seams is None else seams.unionByName(met)
    roots = merged(seams)
    width = df.groupBy("image_id").agg((F.max("x") + 1).cast("long").alias("w"))
    root = F.coalesce("root", "label")
    out = labels.join(roots, ["image_id", "label"], "left").join(width, "image_id")
    return out.select("image_id", "x", "y", (F.shiftright(root, 32) * F.col("w") + root.bitwiseAND((1 << 32) - 1)).alias("label"))
