"""Outlines of masks: boundary edges as a successor relation, followed square by square, rings by pointer doubling, simplified, and filled again.

A set place has an edge on each side that is not set; edges run clockwise around what is set, counter-clockwise around holes. Which edge
follows depends on two neighbours alone (set places that touch at a corner only are not joined). An image is cut into squares: a square's
places, and those one place around it, come as one row a batch, so that pixels are not dealt one by one. Within a square edges are followed
by NumPy; rings that lie in one square are done, others leave chains from border to border. Chains are put together by pointer doubling, log2 of
their number in a ring rounds of joins, whatever the image's size. A ring is one row with its corners; simplification takes rings one by
one, filling is a scan of crossings by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import settled

#: By side, top, right, bottom, left: where its edge runs to, and what lies beyond it.
ALONG = [(1, 0), (0, 1), (-1, 0), (0, -1)]
BEYOND = [(0, -1), (1, 0), (0, 1), (-1, 0)]
#: Where the edge of a side begins, from the place's upper left corner.
BEGIN = [(0, 0), (1, 0), (1, 1), (0, 1)]


#: Side of the squares in which edges are followed.
SQUARE = 256
CORNER = "array<struct<id:long,x:int,y:int>>"
_NONE = np.iinfo(np.int64).max


def _number(x: np.ndarray, y: np.ndarray, side: np.ndarray) -> np.ndarray:
    """An edge as a number, in order of row, column and side of its place."""
    return (y.astype(np.int64) << 33) + (x.astype(np.int64) << 2) + side


def _packed(side: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places to one row a square and batch: places of the square and around it, row by row in a square of side + 2, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            images = b.column("image_id").dictionary_encode()
            image, x, y = (v.to_numpy(zero_copy_only=False).astype(np.int64) for v in (images.indices, b.column("x"), b.column("y")))
            parts = []
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):  # a place is seen by its own square and by those it touches
                    tx, ty = (x + dx) // side, (y + dy) // side
                    seen = ((tx != x // side) | (dx == 0)) & ((ty != y // side) | (dy == 0))
                    at = (y - ty * side + 1) * (side + 2) + x - tx * side + 1
                    parts.append(np.stack([image, tx, ty, at])[:, seen])
            image, tx, ty, at = np.concatenate(parts, axis=1)
            order = np.lexsort((tx, ty, image))
            keys = np.stack([image, tx, ty])[:, order]
            first = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            blocks = np.split(at[order].astype("<i4"), first[1:])
            cols = [images.dictionary.take(pa.array(keys[0, first])), *(pa.array(k[first].astype(np.int32)) for k in keys[1:]), pa.array([v.tobytes() for v in blocks], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["image_id", "tx", "ty", "places"])

    return run


def _followed(back: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For edges whose predecessors are ``back`` (-1: none): the first one, the steps from it, and the least ``number`` on the way."""
    to = np.where(back < 0, np.arange(len(back)), back)
    steps, low = (back >= 0).astype(np.int64), number.copy()
    for _ in range(len(back).bit_length()):
        steps += steps[to]
        low = np.minimum(low, low[to])
        to = to[to]
    return to, steps, low


def _chains(m: np.ndarray, x0: int, y0: int) -> list[tuple[int, int | None, int, list[dict]]]:
    """id, next, length, corners of the chains of edges of ``m``, a square with one place around it; the square begins at (x0, y0).

    id is a chain's first edge, next the edge that follows in another square, or None of a whole ring, which begins with its least corner.
    """
    h, w = m.shape[0] - 2, m.shape[1] - 2
    own = m[1:-1, 1:-1]
    k, y, x = np.nonzero(np.stack([own & ~m[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dx, dy in BEYOND]))
    if not len(k):
        return []
    (ax, ay), (bx, by), (cx, cy) = (np.array(v).T[:, k] for v in (ALONG, BEYOND, BEGIN))
    outside = m[1 + y + ay + by, 1 + x + ax + bx]
    turn = np.where(~m[1 + y + ay, 1 + x + ax], 1, np.where(~outside, 0, -1))
    nx, ny, nk = x + np.where(turn == 1, 0, ax) + np.where(turn == -1, bx, 0), y + np.where(turn == 1, 0, ay) + np.where(turn == -1, by, 0), (k + turn) % 4
    straight = m[1 + y - ay, 1 + x - ax] & ~m[1 + y - ay + by, 1 + x - ax + bx]  # the edge before runs the same way
    at = np.full((4, h, w), -1)
    at[k, y, x] = np.arange(len(k))
    inside = (nx >= 0) & (nx < w) & (ny >= 0) & (ny < h)
    back = np.full(len(k), -1)
    back[at[nk[inside], ny[inside], nx[inside]]] = np.flatnonzero(inside)
    number = _number(x + x0, y + y0, k)
    corner = np.where(straight, _NONE, number)
    head, steps, low = _followed(back, corner)
    whole = back[head] >= 0  # a ring has no first edge: it begins with its least corner
    if whole.any():
        back[whole & (number == low)] = -1
        head, steps, _ = _followed(back, corner)
    order = np.lexsort((steps, head))
    first = np.flatnonzero(steps[order] == 0)
    last = np.append(first[1:], len(order)) - 1
    follows = _number(nx + x0, ny + y0, nk)
    turns = order[~straight[order]]
    corners = [{"id": i, "x": u, "y": v} for i, u, v in zip(number[turns].tolist(), (x + cx + x0)[turns].tolist(), (y + cy + y0)[turns].tolist(), strict=True)]
    ends = np.append(0, np.cumsum(~straight[order]))
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        e = order[a]
        out.append((int(number[e]), None if whole[e] else int(follows[order[b]]), b - a + 1, corners[ends[a] : ends[b + 1]]))
    return out


def chains(mask: DataFrame, side: int = SQUARE) -> DataFrame:
    """image_id, id, next, length, corners: edges of the places of ``mask`` (image_id, x, y), followed within squares."""
    kind = dict(mask.dtypes)["image_id"]

    def run(t: pa.Table) -> pa.Table:
        tx, ty = t["tx"][0].as_py(), t["ty"][0].as_py()
        m = np.zeros((side + 2) ** 2, bool)
        for places in t["places"]:
            m[np.frombuffer(places.as_py(), "<i4")] = True
        found = _chains(m.reshape(side + 2, side + 2), tx * side, ty * side)
        like = t.schema.field("image_id").type
        corner = pa.list_(pa.struct([("id", pa.int64()), ("x", pa.int32()), ("y", pa.int32())]))
        cols = [pa.array([c[i] for c in found], k) for i, k in enumerate([pa.int64(), pa.int64(), pa.int64(), corner])]
        return pa.table([pa.array([t["image_id"][0].as_py()] * len(found), like), *cols], names=["image_id", "id", "next", "length", "corners"])

    packed = mask.select("image_id", "x", "y").mapInArrow(_packed(side), f"image_id {kind}, tx int, ty int, places binary")
    return packed.groupBy("image_id", "tx", "ty").applyInArrow(run, f"image_id {kind}, id long, next long, length long, corners {CORNER}")


def rings(mask: DataFrame, side: int = SQUARE) -> DataFrame:
    """image_id, ring (its least id), points (corners in order), area (of what lies to the right: holes are negative), length."""
    found = settled(chains(mask, side), "trace-chains")
    whole = found.where("next is null").select("image_id", "corners", "length")
    cut = found.where("next is not null")
    if not cut.isEmpty():
        whole = whole.unionByName(_joined(cut))
    c = whole.select("image_id", F.col("corners")[0]["id"].alias("ring"), F.transform("corners", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"), "length")
    nxt = F.concat(F.slice("points", 2, F.size("points") - 1), F.slice("points", 1, 1))
    doubled = F.aggregate(F.zip_with("points", nxt, lambda p, q: p["x"].cast("long") * q["y"] - q["x"].cast("long") * p["y"]), F.lit(0).cast("long"), lambda a, v: a + v)
    return c.select("image_id", "ring", "points", (doubled / 2).cast("long").alias("area"), "length")


def _joined(cut: DataFrame) -> DataFrame:
    """image_id, corners, length of the rings that chains make together, from the least corner on."""
    at = ["image_id", "id"]

    def hop(d: DataFrame, cols: dict) -> DataFrame:
        """One doubling: ``cols`` of each row and of the row that ``to`` names (n_...)."""
        there = d.select("image_id", F.col("id").alias("to"), *[F.col(c).alias(f"n_{c}") for c in d.columns if c not in at])
        return settled(d.join(there, ["image_id", "to"], "left").select(*at, *[v.alias(c) for c, v in cols.items()]), "trace-hop")

    low = cut.select(*at, F.col("next").alias("to"), F.col("id").alias("ring"))
    while True:
        low = hop(low, {"to": F.col("n_to"), "ring": F.least("ring", "n_ring"), "fell": F.col("n_ring") < F.col("ring")})
        if low.where("fell").isEmpty():
            break
        low = low.drop("fell")
    # the ring's order: steps that are left until the one before its least chain
    rank = cut.select(*at, "next").join(low.select(*at, "ring"), at)
    first = F.col("next") == F.col("ring")
    rank = settled(rank.select(*at, "ring", F.when(~first, F.col("next")).alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("left")), "trace-rank")
    while not rank.where("to is not null").isEmpty():
        rank = hop(rank, {"ring": F.col("ring"), "to": F.col("n_to"), "left": F.col("left") + F.coalesce("n_left", F.lit(0))})
    parts = cut.join(rank.select(*at, "ring", "left"), at)
    ring = parts.groupBy("image_id", "ring").agg(F.sort_array(F.collect_list(F.struct((-F.col("left")).alias("n"), "corners"))).alias("c"), F.sum("length").alias("length"))
    ring = ring.select("image_id", F.flatten(F.col("c.corners")).alias("c"), "length")
    begin = F.array_position(F.col("c.id"), F.array_min("c.id")).cast("int")
    turned = F.concat(F.slice("c", F.col("begin"), F.size("c")), F.slice("c", F.lit(1), F.col("begin") - 1))
    return ring.withColumn("begin", begin).select("image_id", turned.alias("corners"), "length")


def thinned(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which corners of a ring stay: Douglas-Peucker on the two halves between its first corner and the one farthest from it."""
    n = len(points)
    keep = np.zeros(n + 1, dtype=bool)
    p = np.vstack([points, points[:1]]).astype(float)
    far = int(((p - p[0]) ** 2).sum(axis=1).argmax())
    keep[[0, far, n]] = True
    todo = [(0, far), (far, n)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, q = p[b] - p[a], p[a + 1 : b] - p[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / length if length else np.hypot(q[:, 0], q[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep[:n]


def simplified(rings: DataFrame, tolerance: float) -> DataFrame:
    """``rings`` with the points that Douglas-Peucker keeps; a ring left with fewer than three keeps all of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column("points"):
                pts = v.as_py()
                keep = thinned(np.array([(q["x"], q["y"]) for q in pts]), tolerance)
                out.append([q for q, k in zip(pts, keep, strict=True) if k] if keep.sum() > 2 else pts)
            at = b.schema.get_field_index("points")
            yield b.set_column(at, "points", pa.array(out, b.schema.field(at).type))

    return rings.mapInArrow(run, rings.schema)


def filled(rings: DataFrame) -> DataFrame:
    """image_id, x, y of the places whose centre has a winding number other than 0."""
    p = rings.select("image_id", "ring", "points", F.posexplode("points").alias("i", "p"))
    q = F.col("points")[F.pmod(F.col("i") + 1, F.size("points"))]
    e = p.select("image_id", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")).where("y1 <> y2")
    e = e.withColumn("y", F.explode(F.sequence(F.least("y1", "y2"), F.greatest("y1", "y2") - 1)))
    cross = e.select("image_id", "y", (F.col("x1") + (F.col("y") + 0.5 - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))).alias("cx"), F.when(F.col("y2") > F.col("y1"), 1).otherwise(-1).alias("turn"))
    w = W.partitionBy("image_id", "y").orderBy("cx")
    spans = cross.groupBy("image_id", "y", "cx").agg(F.sum("turn").alias("turn"))
    spans = spans.select("image_id", "y", "cx", F.sum("turn").over(w).alias("wind"), F.lead("cx").over(w).alias("to")).where("wind <> 0 and to is not null")
    a, b = F.ceil(F.col("cx") - 0.5).cast("int"), (F.ceil(F.col("to") - 0.5) - 1).cast("int")
    return spans.where(a <= b).select("image_id", F.explode(F.sequence(a, b)).alias("x"), "y")


def tracer(tolerance: float = 0.75) -> Callable[[DataFrame], DataFrame]:
    """A tracer for ``plans.pipelines.vectorize_colour``: rings of the mask (image_id, x, y, m), simplified."""
    return lambda mask: simplified(rings(mask.where("m = 1")), tolerance)


