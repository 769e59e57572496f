"""Image files: PNG in and out, packing between images and pixels, folder scans and sinks.

PNG is decoded here in all its colour types and depths and encoded as 8-bit RGBA. JPEG is read by Spark's own ``image`` source; other
formats raise, or give a status row where the caller asks for it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import IMAGES
from .sink import save_images

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(png: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(offset, type, payload) of each chunk; stops at a cut end."""
    at = len(SIGNATURE)
    while at + 12 <= len(png):
        (n,) = struct.unpack(">I", png[at : at + 4])
        if at + 12 + n > len(png):
            return
        yield at, png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        at += 12 + n


def chunk(kind: bytes, payload: bytes) -> bytes:
    return struct.pack(">I", len(payload)) + kind + payload + struct.pack(">I", zlib.crc32(kind + payload))


def remove_chunk(png: bytes, kind: bytes) -> bytes:
    """Without the first chunk of a type."""
    for at, k, payload in chunks(png):
        if k == kind:
            return png[:at] + png[at + 12 + len(payload) :]
    return png


def set_png_dpi(png: bytes, dpi: float) -> bytes:
    """With a pHYs chunk right after the header, in place of the first one there was; other bytes pass unchanged."""
    if not png.startswith(SIGNATURE):
        return png
    per_metre = int(dpi * 39.3701 + 0.5)
    png = remove_chunk(png, b"pHYs")
    return png[:33] + chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)) + png[33:]


def png_dpi(png: bytes) -> float | None:
    for _, kind, payload in chunks(png):
        if kind == b"pHYs" and payload[8] == 1:
            return struct.unpack(">I", payload[:4])[0] / 39.3701
    return None


def encode_png(rgba: bytes, width: int, height: int) -> bytes:
    rows = np.frombuffer(rgba, dtype=np.uint8).reshape(height, width * 4)
    raw = np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes()
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes without their filters; ``raw`` has each row's filter type first, ``step`` is a pixel's bytes.

    Rows that look to the left or up alone are rebuilt whole. If any takes means or Paeth's predictor, all rows go by diagonals: what
    a byte needs lies on the two diagonals before its own.
    """
    h, stride = raw.shape[0], raw.shape[1] - 1
    kinds, rows = raw[:, 0], raw[:, 1:]
    if kinds.max(initial=0) > 4:
        raise ValueError(f"unknown filter {kinds.max()}")
    n = stride // step
    out = np.zeros((h + 1, n + 1, step), np.uint8)
    px = rows.reshape(h, n, step)
    if not (kinds > 2).any():
        for y in range(h):
            out[y + 1, 1:] = px[y] if kinds[y] == 0 else np.cumsum(px[y], axis=0, dtype=np.uint8) if kinds[y] == 1 else px[y] + out[y, 1:]
        return out[1:, 1:].reshape(h, stride)
    for t in range(h + n - 1):
        y = np.arange(max(0, t - n + 1), min(h, t + 1))
        x = t - y
        left, up, corner = (v.astype(np.int16) for v in (out[y + 1, x], out[y, x + 1], out[y, x]))
        pa_, pb, pc = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, up, corner))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, (left + up) // 2, paeth])
        out[y + 1, x + 1] = px[y, x] + guess.astype(np.uint8)
    return out[1:, 1:].reshape(h, stride)


#: The seven passes of an interlaced file: first column and row, steps between them. Fixed values.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _samples(data: bytes, w: int, h: int, depth: int, n: int) -> tuple[np.ndarray, int]:
    """(h, w, n) samples at their own depth from filtered rows, and the bytes that these took."""
    stride = (w * n * depth + 7) // 8
    size = h * (1 + stride)
    if len(data) < size:
        raise ValueError("image data end early")
    rows = unfiltered(np.frombuffer(data[:size], np.uint8).reshape(h, 1 + stride), max(1, n * depth // 8))
    if depth == 16:
        return np.ascontiguousarray(rows).view(">u2").reshape(h, w, n).astype(np.uint16), size
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)[:, : w * n]
    return rows.reshape(h, w, n).astype(np.uint16), size


def decode_png(png: bytes) -> tuple[int, int, bytes]:
    """(width, height, RGBA bytes) of any colour type and depth, interlaced or not; of 16-bit samples the upper byte."""
    if not png.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    parts, palette, alpha, head = [], b"", b"", None
    for _, kind, payload in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", payload)
        elif kind == b"PLTE":
            palette = payload
        elif kind == b"tRNS":
            alpha = payload
        elif kind == b"IDAT":
            parts.append(payload)
    if head is None:
        raise ValueError("no header")
    w, h, depth, kind, _, _, interlaced = head
    if kind not in CHANNELS or depth not in {0: (1, 2, 4, 8, 16), 3: (1, 2, 4, 8)}.get(kind, (8, 16)) or interlaced > 1 or not w or not h:
        raise ValueError(f"unsupported PNG: depth {depth}, colour type {kind}, interlace {interlaced}")
    n = CHANNELS[kind]
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(f"image data: {e}") from e
    if interlaced:
        px, at = np.zeros((h, w, n), np.uint16), 0
        for x0, y0, dx, dy in PASSES:
            pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
            if pw > 0 and ph > 0:
                px[y0::dy, x0::dx], size = _samples(raw[at:], pw, ph, depth, n)
                at += size
    else:
        px, _ = _samples(raw, w, h, depth, n)
    full = np.full((h, w, 4), 255, dtype=np.uint8)
    if kind == 3:
        table = np.frombuffer(palette, dtype=np.uint8).reshape(-1, 3)
        if px.max(initial=0) >= len(table):
            raise ValueError("a colour beyond the palette")
        full[..., :3] = table[px[..., 0]]
        a = np.full(len(table), 255, dtype=np.uint8)
        a[: len(alpha)] = np.frombuffer(alpha, dtype=np.uint8)[: len(table)]
        full[..., 3] = a[px[..., 0]]
        return w, h, full.tobytes()
    byte = (px >> 8 if depth == 16 else px * (255 // ((1 << depth) - 1))).astype(np.uint8)
    colours = 1 if kind in (0, 4) else 3
    full[..., :3] = byte[..., :colours]
    if kind in (4, 6):
        full[..., 3] = byte[..., colours]
    elif len(alpha) >= 2 * colours:  # one colour that is clear
        clear = np.frombuffer(alpha[: 2 * colours], ">u2")
        full[..., 3] = np.where((px == clear).all(axis=2), 0, 255)
    return w, h, full.tobytes()


# -- between files, images and pixels ----------------------------------------------------------------------------


def scan(spark: SparkSession, path: str, pattern: str = "*.png", most_bytes: int | None = None) -> DataFrame:
    """Files of a folder, recursively: path, modificationTime, length, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= most_bytes) if most_bytes else files


def decode(files: DataFrame, errors: str = "raise") -> DataFrame:
    """images from rows with path and content; image_id is the hash of the path.

    A file that cannot be decoded raises; with ``errors`` "rows" it gives a row without pixels whose status says why (others say ok), with "skip" none.
    """
    names = ["image_id", "name", "width", "height", "data", "status"]

    def one(content: bytes | None) -> tuple:
        try:
            return (*decode_png(content or b""), "ok")
        except (ValueError, struct.error) as e:
            if errors == "raise":
                raise
            return None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [one(c.as_py()) for c in b.column("content")]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), b.column("name"), *[pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]], names=names)

    given = files.select(F.xxhash64("path").alias("image_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    out = given.mapInArrow(run, IMAGES + ", status string")
    return out if errors == "rows" else (out.where("status = 'ok'") if errors == "skip" else out).drop("status")


def load_jpegs(spark: SparkSession, path: str) -> DataFrame:
    """images of a folder's JPEG files, decoded on the JVM by Spark's image source; a file that it cannot read has no pixels and a status."""
    d = spark.read.format("image").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").option("recursiveFileLookup", "true").load(path).select("image.*")
    names = ["image_id", "name", "width", "height", "data", "status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, name, w, h, n, data in zip(*[b.column(c) for c in ("image_id", "name", "width", "height", "nChannels", "data")], strict=True):
                w, h, n = w.as_py(), h.as_py(), n.as_py()
                if w <= 0 or n not in (1, 3, 4):
                    rows.append((i.as_py(), name.as_py(), None, None, None, "not an image"))
                    continue
                px = np.frombuffer(data.as_py(), np.uint8).reshape(h, w, n)
                full = np.full((h, w, 4), 255, np.uint8)
                full[..., :3] = px[..., :3][..., ::-1] if n > 1 else px
                if n == 4:
                    full[..., 3] = px[..., 3]
                rows.append((i.as_py(), name.as_py(), w, h, full.tobytes(), "ok"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=names)

    given = d.select(F.xxhash64("origin").alias("image_id"), F.element_at(F.split("origin", "/"), -1).alias("name"), "width", "height", "nChannels", "data")
    return given.mapInArrow(run, IMAGES + ", status string")


def load_images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    return decode(scan(spark, path, pattern))


def to_pixels(images: DataFrame) -> DataFrame:
    """One row a pixel, in Arrow batches of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w, h, data in zip(*(b.column(c).to_pylist() for c in ("image_id", "width", "height", "data")), strict=True):
                px = np.frombuffer(data, dtype=np.uint8).reshape(h * w, 4).astype(np.int32)
                place = np.arange(h * w)
                for lo in range(0, h * w, 65_536):
                    s = slice(lo, lo + 65_536)
                    cols = [np.full(len(place[s]), i), (place[s] % w).astype(np.int32), (place[s] // w).astype(np.int32), *px[s].T]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["image_id", "x", "y", "r", "g", "b", "a"])

    return images.select("image_id", "width", "height", "data").mapInArrow(run, "image_id long, x int, y int, r int, g int, b int, a int")


def from_pixels(pixels: DataFrame) -> DataFrame:
    """image_id, name, width, height, data: dense pixels packed row-major, one image a group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["x"].max()) + 1, int(pdf["y"].max()) + 1
        out = np.zeros((h, w, 4), dtype=np.uint8)
        out[pdf["y"], pdf["x"]] = pdf[["r", "g", "b", "a"]].to_numpy()
        i = int(pdf["image_id"].iat[0])
        return pd.DataFrame([(i, str(i), w, h, out.tobytes())], columns=["image_id", "name", "width", "height", "data"])

    return pixels.groupBy("image_id").applyInPandas(run, IMAGES)


def encode(images: DataFrame, kind: str = "png", dpi: float | None = None) -> DataFrame:
    """image_id, name, content; only PNG is built in."""
    if kind != "png":
        raise NotImplementedError(f"no encoder for {kind}: pass the rows to one of your own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [encode_png(d, w, h) for w, h, d in zip(*(b.column(c).to_pylist() for c in ("width", "height", "data")), strict=True)]
            if dpi:
                done = [set_png_dpi(d, dpi) for d in done]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), b.column("name"), pa.array(done, pa.binary())], names=["image_id", "name", "content"])

    return images.select("image_id", "name", "width", "height", "data").mapInArrow(run, "image_id long, name string, content binary")


def write_files(encoded: DataFrame, folder: str) -> DataFrame:
    """Writes <folder>/<name>.png for every row or, if anything fails, for none (``sources.sink``); returns path and bytes of the names written."""
    save_images(encoded, folder)
    spark = encoded.sparkSession
    names = encoded.select(F.concat(F.lit("/"), "name", F.when(F.lower("name").endswith(".png"), "").otherwise(".png")).alias("end")).distinct()
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))
    inside = F.concat(F.lit("/"), F.substring_index("path", folder.rstrip("/").rpartition("/")[-1] + "/", -1))
    return there.withColumn("end", inside).join(names, "end", "left_semi").drop("end")


PROCESSED = " - text removed.png"


def output_name(path):
    return F.regexp_replace(path, r"(?i)\.png$", PROCESSED)


def audit_pairs(files: DataFrame) -> DataFrame:
    """path, original, content, original_content: processed files beside the ones they were made from."""
    done = files.where(F.col("path").endswith(PROCESSED)).select("path", "content", F.expr(f"concat(substring(path, 1, length(path) - {len(PROCESSED)}), '.png')").alias("original"))
    return done.join(files.select(F.col("path").alias("original"), F.col("content").alias("original_content")), "original")
