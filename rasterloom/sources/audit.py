"""The audit of a folder of processed images beside their originals.

Names and sizes are compared first: a file's size stands in its first 33 bytes, so the join moves headers, not images. Only pairs of
equal size are decoded, as packed tiles, and a pair's tiles meet by place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed import KEYS, cut_images, tile_box
from . import images as I

HEADER = 33


def headers(files: DataFrame) -> DataFrame:
    """path, w, h (null if it is no PNG) from the first bytes of files (path, content)."""
    head = F.substring("content", 1, HEADER)
    def number(at: int):
        return F.conv(F.hex(F.substring(head, at, 4)), 16, 10).cast("long")

    fits = (F.length(head) == HEADER) & (F.substring(head, 1, 8) == F.lit(I.SIGNATURE)) & (F.substring(head, 13, 4) == F.lit(b"IHDR"))
    return files.select("path", F.when(fits, number(17)).alias("w"), F.when(fits, number(21)).alias("h"))


def pairs(files: DataFrame) -> DataFrame:
    """path, original, w, h, status of each processed file: ok, no original, size differs or not readable."""
    h = headers(files)
    done = h.where(F.col("path").endswith(I.PROCESSED)).withColumn("original", F.expr(f"concat(substring(path, 1, length(path) - {len(I.PROCESSED)}), '.png')"))
    first = h.select(F.col("path").alias("original"), F.col("w").alias("ow"), F.col("h").alias("oh"), F.lit(True).alias("there"))
    d = done.join(first, "original", "left")
    status = F.when(F.col("there").isNull(), "no original").when(F.col("w").isNull() | F.col("ow").isNull(), "not readable").when((F.col("w") != F.col("ow")) | (F.col("h") != F.col("oh")), "size differs").otherwise("ok")
    return d.select("path", "original", "w", "h", status.alias("status"))


def _erased(margin_x: float, margin_y: float):
    names = [*KEYS[:1], "n", "total", "edge"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for *key, data, was in zip(*[b.column(c) for c in (*KEYS, "data", "was")], strict=True):
                i, w, h, tile, tx, ty = [k.as_py() for k in key]
                x0, y0, x1, y1 = tile_box(w, h, tile, tx, ty)
                now, before = (np.frombuffer(v.as_py(), np.uint8).reshape(y1 - y0, x1 - x0, 4)[..., 3] for v in (data, was))
                gone = (before >= 32) & (now < 32)
                x, y = np.arange(x0, x1), np.arange(y0, y1)
                band = ((y < h * margin_y) | (y >= h * (1 - margin_y)))[:, None] | ((x < w * margin_x) | (x >= w * (1 - margin_x)))[None, :]
                rows.append((i, gone.size, int(gone.sum()), int((gone & band).sum())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def audit_report(spark: SparkSession, folder: str, margin_x: float = 0.05, margin_y: float = 0.10) -> DataFrame:
    """name, status, total_erased, edge_erased, edge_frac, total_frac: one row for each processed file of the folder.

    Files that have no original, another size, no header or no pixels that can be read are counted by their status and have no figures.
    """
    files = I.scan(spark, folder)
    p = pairs(files)
    good = p.where("status = 'ok'")
    path_of = files.select("path", "content")
    now = I.decode(path_of.join(good.select("path"), "path", "left_semi"), errors="rows")
    was = I.decode(path_of.join(good.select(F.col("original").alias("path")), "path", "left_semi"), errors="rows")
    ids = good.select(F.xxhash64("path").alias("image_id"), F.xxhash64("original").alias("original_id"))
    place = ["image_id", "tx", "ty"]
    before = cut_images(was.where("status = 'ok'")).withColumnRenamed("image_id", "original_id").join(ids, "original_id").select(*place, F.col("data").alias("was"))
    both = cut_images(now.where("status = 'ok'")).join(before, place)
    sums = both.select(*KEYS, "data", "was").mapInArrow(_erased(margin_x, margin_y), "image_id long, n long, total long, edge long")
    n = sums.groupBy("image_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total_erased"), F.sum("edge").alias("edge_erased"))
    out = p.withColumn("image_id", F.xxhash64("path")).join(n, "image_id", "left")
    status = F.when((F.col("status") == "ok") & F.col("n").isNull(), "not readable").otherwise(F.col("status"))
    return out.select(F.element_at(F.split("path", "/"), -1).alias("name"), status.alias("status"), "total_erased", "edge_erased", (F.col("edge_erased") / F.col("n")).alias("edge_frac"), (F.col("total_erased") / F.col("n")).alias("total_frac"))
