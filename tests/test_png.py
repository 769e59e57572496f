"""PNG of every colour type, depth, filter and interlacing, and files that are broken."""

import itertools
import struct
import zlib

import numpy as np
import pytest

from rasterloom.sources import images as I

KINDS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def packed_rows(px, depth):
    h = px.shape[0]
    flat = px.reshape(h, -1)
    if depth == 16:
        return np.frombuffer(flat.astype(">u2").tobytes(), np.uint8).reshape(h, -1)
    if depth == 8:
        return flat.astype(np.uint8)
    bits = (flat[..., None] >> np.arange(depth - 1, -1, -1)) & 1
    return np.packbits(bits.reshape(h, -1).astype(np.uint8), axis=1)


def filtered(rows, step, modes):
    """Each row under its filter, by the definitions, byte by byte."""
    out = bytearray()
    for y, row in enumerate(rows.tolist()):
        up = rows[y - 1].tolist() if y else [0] * len(row)
        mode = modes[y % len(modes)]
        out.append(mode)
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((v - [0, a, b, (a + b) // 2, paeth][mode]) & 255)
    return bytes(out)


def encoded(px, kind, depth, modes, interlaced, extra=b""):
    h, w, n = px.shape
    step = max(1, n * depth // 8)
    parts = [px] if not interlaced else [px[y::dy, x::dx] for x, y, dx, dy in I.PASSES]
    data = b"".join(filtered(packed_rows(p, depth), step, modes) for p in parts if p.size)
    return I.SIGNATURE + I.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, interlaced)) + extra + I.chunk(b"IDAT", zlib.compress(data)) + I.chunk(b"IEND", b"")


def expected(px, kind, depth, palette, clear):
    out = np.full((*px.shape[:2], 4), 255, np.uint8)
    if kind == 3:
        out[..., :3] = palette[px[..., 0]]
        out[..., 3] = np.where(px[..., 0] == 0, 9, 255) if clear else 255
        return out
    byte = px >> 8 if depth == 16 else px * (255 // (2**depth - 1))
    out[..., :3] = byte[..., : 1 if kind in (0, 4) else 3]
    if kind in (4, 6):
        out[..., 3] = byte[..., -1]
    elif clear:
        out[..., 3] = np.where((px == px[0, 0]).all(axis=2), 0, 255)
    return out


@pytest.mark.parametrize(("kind", "depth", "interlaced", "clear"), [(k, d, i, c) for k, ds in KINDS.items() for d, i, c in itertools.product(ds, (0, 1), (0, 1)) if not (c and k in (4, 6))])
def test_every_kind(kind, depth, interlaced, clear):
    rng = np.random.default_rng(kind * 100 + depth)
    for (w, h), modes in itertools.product([(13, 11), (1, 1), (3, 9), (16, 8)], [(0,), (1, 2), (3,), (4,), (0, 1, 2, 3, 4)]):
        px = rng.integers(0, min(2**depth, 2**16), (h, w, I.CHANNELS[kind]))
        palette = rng.integers(0, 256, (2**min(depth, 8), 3)).astype(np.uint8)
        extra = I.chunk(b"PLTE", palette.tobytes()) if kind == 3 else b""
        if clear:
            extra += I.chunk(b"tRNS", b"\x09" if kind == 3 else px[0, 0].astype(">u2").tobytes())
        got = I.decode_png(encoded(px, kind, depth, modes, interlaced, extra))
        assert got[:2] == (w, h) and got[2] == expected(px, kind, depth, palette, clear).tobytes()


def test_broken_files_have_a_row(spark):
    good = encoded(np.full((2, 3, 4), 7), 6, 8, (0,), 0)
    cut = I.SIGNATURE + I.chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 6, 0, 0, 0)) + I.chunk(b"IDAT", zlib.compress(b"\0" * 5))
    odd = I.SIGNATURE + I.chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 5, 6, 0, 0, 0)) + I.chunk(b"IDAT", b"xx")
    beyond = encoded(np.full((1, 1, 1), 3), 3, 8, (0,), 0, I.chunk(b"PLTE", b"\0\0\0"))
    files = [("/f/good.png", good), ("/f/cut.png", cut), ("/f/odd.png", odd), ("/f/beyond.png", beyond), ("/f/text.png", b"hello"), ("/f/none.png", None), ("/f/end.png", good[:40]), ("/f/zlib.png", good.replace(b"IDAT", b"IDAX"))]
    d = spark.createDataFrame(files, "path string, content binary").repartition(3)
    got = {r["name"]: r for r in I.decode(d, errors="rows").collect()}
    assert len(got) == len(files) and [n for n, r in got.items() if r["status"] == "ok"] == ["good.png"] and got["good.png"]["data"] == b"\7" * 24
    assert all(r["data"] is None and r["status"] for n, r in got.items() if n != "good.png")
    assert I.decode(d, errors="skip").count() == 1
    with pytest.raises(Exception, match="PNG|early|header|palette|data"):
        I.decode(d).collect()


def test_jpegs_by_the_image_source(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    img = jvm.java.awt.image.BufferedImage(16, 8, 1)
    for x in range(16):
        for y in range(8):
            img.setRGB(x, y, 0xC81E3C)
    jvm.javax.imageio.ImageIO.write(img, "jpg", jvm.java.io.File(str(tmp_path / "a.jpg")))
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    got = {r["name"]: r for r in I.load_jpegs(spark, str(tmp_path)).collect()}
    assert got["bad.jpg"]["data"] is None and got["bad.jpg"]["status"] != "ok"
    px = np.frombuffer(got["a.jpg"]["data"], np.uint8).reshape(8, 16, 4)
    assert (got["a.jpg"]["width"], got["a.jpg"]["height"]) == (16, 8) and np.abs(px.astype(int) - [200, 30, 60, 255]).max() <= 4
