"""Least values that spread over an image of any size: each tile is solved alone, and what leaves its border is exchanged by rounds.

A tile is solved from what its neighbours have sent so far (their border values). What it would send is compared with what it has sent, and
only neighbours that get something new are solved again; when nothing is new, every tile is solved once more and gives its plane. Values
only fall, so the rounds end, and the result is the one of the whole image. Between rounds there are border rows alone; tiles stay where they were
written, and a round takes only those that have something to do to Python. A path that winds through n tiles takes n rounds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..scratch import settled
from . import packed as P
from .kernels import flood_depth

#: The neighbour that a border goes to, and the place of what comes from there.
SIDES = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]
AT = ["image_id", "tx", "ty"]

#: (tile's bytes, its row as a dictionary, received borders by side) to the plane of values.
Solve = Callable[[bytes, dict, dict[tuple[int, int], np.ndarray]], np.ndarray]


def border(plane: np.ndarray, side: tuple[int, int]) -> np.ndarray:
    """The values of ``plane`` that its neighbour at ``side`` sees: a row, a column or a corner."""
    dx, dy = side
    rows = plane if not dy else plane[:1] if dy < 0 else plane[-1:]
    return (rows if not dx else rows[:, :1] if dx < 0 else rows[:, -1:]).ravel()


def _solved(tiles: DataFrame, rims: DataFrame | None, solve: Solve, dtype: str, sides: list[tuple[int, int]], extra: list[str]) -> tuple[Callable, DataFrame]:
    names = [*P.KEYS, "data", *extra]
    t = tiles.select(*names)
    if rims is not None:
        got = rims.groupBy(*AT).agg(F.collect_list(F.struct("dx", "dy", "data")).alias("got"))
        t = t.join(got, AT, "left")

    def plane_of(b: pa.RecordBatch, k: int) -> tuple[dict, np.ndarray]:
        row = {c: b[c][k].as_py() for c in b.schema.names if c not in ("data", "got")}
        got = (b["got"][k].as_py() or []) if "got" in b.schema.names else []
        return row, solve(b["data"][k].as_py(), row, {(g["dx"], g["dy"]): np.frombuffer(g["data"], dtype) for g in got})

    return plane_of, t


def relax(tiles: DataFrame, solve: Solve, dtype: str, nothing: float, *, corners: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Tiles of one ``dtype`` a place; ``nothing`` is the value of places that are not reached. ``extra`` columns of ``tiles`` go to ``solve``."""
    image = dict(tiles.dtypes)["image_id"]
    sides = [s for s in SIDES if corners or 0 in s]
    keys = f"image_id {image}, tx int, ty int, dx int, dy int, data binary"

    def sends(plane_of: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    row, plane = plane_of(b, k)
                    nx, ny = -(-row["w"] // row["tile"]), -(-row["h"] // row["tile"])
                    out = []
                    for dx, dy in sides:
                        x, y = row["tx"] + dx, row["ty"] + dy
                        edge = border(plane, (dx, dy))
                        if 0 <= x < nx and 0 <= y < ny and (edge != nothing).any():
                            out.append([row["image_id"], x, y, -dx, -dy, edge.astype(dtype).tobytes()])
                    if out:
                        yield P._batch(out, b.schema.field("image_id").type, [*AT, "dx", "dy", "data"])

        return run

    plane_of, t = _solved(tiles, None, solve, dtype, sides, list(extra))
    new = settled(t.mapInArrow(sends(plane_of), keys), "relax")
    rims = new
    while not new.isEmpty():
        todo = new.select(*AT).distinct()
        plane_of, t = _solved(tiles.join(todo, AT, "left_semi"), rims.join(todo, AT, "left_semi"), solve, dtype, sides, list(extra))
        sent = t.mapInArrow(sends(plane_of), keys)
        side = [*AT, "dx", "dy"]
        new = settled(sent.join(rims.withColumnRenamed("data", "was"), side, "left").where("was is null or was <> data").drop("was"), "relax")
        rims = settled(rims.join(new.select(*side), side, "left_anti").unionByName(new), "relax-rims")
    plane_of, t = _solved(tiles, rims, solve, dtype, sides, list(extra))

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row, plane = plane_of(b, k)
                yield P._batch([[*[row[c] for c in P.KEYS], np.ascontiguousarray(plane.astype(dtype)).tobytes()]], b.schema.field("image_id").type)

    return t.mapInArrow(planes, P.schema(tiles))


def _shape(row: dict) -> tuple[int, int]:
    x0, y0, x1, y1 = P.tile_box(row["w"], row["h"], row["tile"], row["tx"], row["ty"])
    return y1 - y0, x1 - x0


def depth_flood(tiles: DataFrame, color: str, tight: float, fringe: float, steps: int) -> DataFrame:
    """Tiles of one int32 a place, -1 where the flood does not come: as ``graph.depth_flood``."""
    r, g, b = C.hex_ints(color)
    near, far, none = C.max_dist_sq(tight), C.max_dist_sq(fringe), steps + 1

    def solve(data: bytes, row: dict, got: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        h, w = _shape(row)
        px = np.frombuffer(data, np.uint8).reshape(h, w, 4).astype(np.int64)
        d = (px[..., 0] - r) ** 2 + (px[..., 1] - g) ** 2 + (px[..., 2] - b) ** 2
        seen = px[..., 3] != 0
        edge = {(-1, 0): row["tx"] == 0, (1, 0): (row["tx"] + 1) * row["tile"] >= row["w"], (0, -1): row["ty"] == 0, (0, 1): (row["ty"] + 1) * row["tile"] >= row["h"]}
        rim = {s: np.zeros(h if s[0] else w, np.int64) if outer else got.get(s, np.full(h if s[0] else w, none)) for s, outer in edge.items()}
        depth = flood_depth(seen & (d <= near) & (d <= far), seen & (d <= far), steps, rim)
        return np.where(depth < 0, none, depth)

    found = relax(settled(tiles, "flood-tiles"), solve, "<i4", none)
    return P.each(found, lambda px, box, size, v: np.where(px == none, -1, px), dtype="<i4", channels=1)


# -- cheapest paths -----------------------------------------------------------------------------------------------------

STEPS = [(dx, dy, math.hypot(dx, dy)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]


def _region(row: dict) -> tuple[P.Box, P.Box]:
    """The tile's own box, and the box with one place around it within the image."""
    box = P.tile_box(row["w"], row["h"], row["tile"], row["tx"], row["ty"])
    return box, P.clip((box[0] - 1, box[1] - 1, box[2] + 1, box[3] + 1), row["w"], row["h"])


def spread_costs(cost: np.ndarray, start: dict[tuple[int, int], float]) -> np.ndarray:
    """Least cost of each place from the starts (y, x: cost); a step costs the mean of its ends times its length."""
    h, w = cost.shape
    best = np.full((h, w), np.inf)
    heap = []
    for (y, x), d in start.items():
        best[y, x] = d
        heap.append((d, y, x))
    heapq.heapify(heap)
    while heap:
        d, y, x = heapq.heappop(heap)
        if d > best[y, x]:
            continue
        for dx, dy, length in STEPS:
            v, u = y + dy, x + dx
            if 0 <= v < h and 0 <= u < w:
                nd = d + (cost[y, x] + cost[v, u]) / 2 * length
                if nd < best[v, u]:
                    best[v, u] = nd
                    heapq.heappush(heap, (nd, v, u))
    return best


def least_costs(cost: DataFrame, seeds: DataFrame) -> DataFrame:
    """Tiles of one double a place from tiles of costs (doubles) and seeds (image_id, sx, sy): the cost of the cheapest 8-connected path."""
    regions = settled(P.gather(cost, P.Warp(1), dtype="f8", channels=1, whole=True).join(seeds.select("image_id", "sx", "sy"), "image_id"), "wire-tiles")

    def solve(data: bytes, row: dict, got: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
        box, at = _region(row)
        plane = np.frombuffer(data, "f8").reshape(at[3] - at[1], at[2] - at[0])
        h, w = box[3] - box[1], box[2] - box[0]
        oy, ox = box[1] - at[1], box[0] - at[0]
        start = {}
        for (dx, dy), values in got.items():
            ys = [oy - 1] if dy < 0 else [oy + h] if dy > 0 else range(oy, oy + h)
            xs = [ox - 1] if dx < 0 else [ox + w] if dx > 0 else range(ox, ox + w)
            start |= {p: v for p, v in zip([(y, x) for y in ys for x in xs], values.tolist(), strict=True) if v < math.inf}
        if box[0] <= row["sx"] < box[2] and box[1] <= row["sy"] < box[3]:
            start[row["sy"] - at[1], row["sx"] - at[0]] = 0.0
        return spread_costs(plane, start)[oy : oy + h, ox : ox + w]

    return relax(regions, solve, "f8", math.inf, corners=True, extra=("sx", "sy"))


def cheapest_paths(cost: DataFrame, requests: DataFrame) -> DataFrame:
    """image_id, step, x, y, cost: the cheapest path from (sx, sy) to (x, y) for requests (image_id, sx, sy, x, y), one an image; step 0 is the target.

    Of equal ways the one whose earlier place is cheaper, then first row by row, which is the order in which the whole-image search settles
    places. Each round walks back within one tile.
    """
    dist = least_costs(cost, requests)
    both = P.gather(cost, P.Warp(1), dtype="f8", channels=1, whole=True).select(*P.KEYS, F.col("data").alias("cost"))
    both = settled(both.join(P.gather(dist, P.Warp(1), dtype="f8", channels=1, whole=True).select(*AT, F.col("data").alias("dist")), AT), "wire-planes")
    image = dict(cost.dtypes)["image_id"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b[c][k].as_py() for c in b.schema.names if c not in ("cost", "dist")}
                box, at = _region(row)
                cost_, dist_ = (np.frombuffer(b[c][k].as_py(), "f8").reshape(at[3] - at[1], at[2] - at[0]) for c in ("cost", "dist"))
                x, y, step, out = row["x"], row["y"], row["step"], []
                while box[0] <= x < box[2] and box[1] <= y < box[3]:
                    here = dist_[y - at[1], x - at[0]]
                    if here == math.inf:
                        break
                    out.append([row["image_id"], step, x, y, here])
                    if (x, y) == (row["sx"], row["sy"]):
                        break
                    ways = []
                    for dx, dy, length in STEPS:
                        u, v = x + dx - at[0], y + dy - at[1]
                        if 0 <= u < at[2] - at[0] and 0 <= v < at[3] - at[1] and dist_[v, u] + (cost_[v, u] + cost_[y - at[1], x - at[0]]) / 2 * length == here:
                            ways.append((dist_[v, u], v, u))
                    _, v, u = min(ways)
                    x, y, step = u + at[0], v + at[1], step + 1
                else:  # the walk goes on in another tile
                    out.append([row["image_id"], step, x, y, -1.0])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [b.schema.field("image_id").type, pa.int32(), pa.int32(), pa.int32(), pa.float64()], strict=True)], names=["image_id", "step", "x", "y", "cost"])

    ends = settled(requests.select("image_id", "sx", "sy", "x", "y", F.lit(0).alias("step")), "wire-ends")
    done: DataFrame | None = None
    while not ends.isEmpty():
        t = both.join(ends, "image_id").where((F.floor(F.col("x") / F.col("tile")) == F.col("tx")) & (F.floor(F.col("y") / F.col("tile")) == F.col("ty")))
        part = settled(t.mapInArrow(walk, f"image_id {image}, step int, x int, y int, cost double"), "wire-path")
        found = part.where("cost >= 0")
        done = found if done is None else done.unionByName(found)
        ends = settled(part.where("cost < 0").drop("cost").join(requests.select("image_id", "sx", "sy"), "image_id"), "wire-ends")
    return done if done is not None else requests.select("image_id", F.lit(0).alias("step"), "x", "y", F.lit(0.0).alias("cost")).limit(0)
