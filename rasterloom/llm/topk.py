"""Exact top-k search: tiled products of integer vectors, a partial selection for each tile, merged in a tree.

Vectors become floor(256 * x). Queries are cut into tiles of at most ``tile_bytes``; each tile goes, as one
broadcast of that bound, past every shard of the candidates, which stay where the scan put them. A task keeps
one k-best list a query while its batches pass and emits that list alone; the lists are merged by
groups of shards first, then by query. Products of integers below 2^53 in float64 are exact; vectors whose
products could pass that bound are multiplied as 64-bit integers.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; vectors of another
length than the query's are no candidates of it; an empty table gives no rows; a query's own row (same vec_id)
is no candidate, nor are its repeats, and repeated candidate rows count once each; ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settled

SCALE = 256


def integer_vector(col: str = "embedding") -> Column:
    return F.transform(F.col(col), lambda x: F.floor(x.cast("double") * SCALE))


def usable(col: str = "embedding") -> Column:
    """True for a vector without null, NaN or infinite components."""
    bad = F.exists(F.col(col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.col(col).isNotNull() & ~bad


def _select(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by score falling and id rising."""
    n = score.shape[1]
    if n > 4 * k:
        floor = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]  # the k-th score: all ties with it stay
        rows, cols = np.nonzero(score >= floor)
    else:
        rows, cols = np.nonzero(np.ones_like(score, dtype=bool))
    s, i = score[rows, cols], ids[rows, cols] if ids.ndim == 2 else ids[cols]
    order = np.lexsort((i, -s, rows))
    rows, s, i = rows[order], s[order], i[order]
    start = np.searchsorted(rows, np.arange(score.shape[0]))
    rank = np.arange(len(rows)) - start[rows]
    out_s, out_i = np.full((score.shape[0], k), LOWEST), np.full((score.shape[0], k), -1)
    own = rank < k
    out_s[rows[own], rank[own]], out_i[rows[own], rank[own]] = s[own], i[own]
    return out_s, out_i


LOWEST = np.iinfo(np.int64).min + 1


def best_of_tile(candidates: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score, shard: the k best of every shard for a tile of queries of one length."""
    shared = candidates.sparkSession.sparkContext.broadcast((q_ids, q))
    width = q.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_q, mat = shared.value
        peak = int(np.abs(mat).max(initial=0))
        best_s, best_i = np.full((len(ids_q), k), LOWEST), np.full((len(ids_q), k), -1)
        shard = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            shard = int(batch.column("shard")[0].as_py())
            small = peak * int(np.abs(x).max(initial=0)) * width < 2**53
            for a in range(0, len(ids), 4096):
                part, part_ids = x[a : a + 4096], ids[a : a + 4096]
                for b in range(0, len(ids_q), 512):
                    tile = mat[b : b + 512]
                    s = (tile.astype(np.float64) @ part.astype(np.float64).T).astype(np.int64) if small else tile @ part.T
                    s[ids_q[b : b + 512, None] == part_ids[None, :]] = LOWEST
                    s1, i1 = _select(s, part_ids, k)
                    i1[s1 == LOWEST] = -1
                    best_s[b : b + 512], best_i[b : b + 512] = _select(np.hstack([best_s[b : b + 512], s1]), np.hstack([best_i[b : b + 512], i1]), k)
        rows, cols = np.nonzero(best_s > LOWEST)
        out = [pa.array(ids_q[rows]), pa.array(best_i[rows, cols]), pa.array(best_s[rows, cols]), pa.array(np.full(len(rows), shard, np.int64))]
        yield pa.RecordBatch.from_arrays(out, names=["query_id", "vec_id", "score", "shard"])

    chosen = candidates.where(F.size("v") == width).select("vec_id", "v", F.spark_partition_id().cast("long").alias("shard"))
    return chosen.mapInArrow(run, "query_id long, vec_id long, score long, shard long")


def merge(lists: DataFrame, k: int, *by: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, tile_bytes=32 << 20, fan_in=16) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer products of each query with every other row."""
    rows = settled(vectors.where(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector().alias("v")), "op3-vectors")
    queries = settled(rows.where(is_query).dropDuplicates(["vec_id", "v"]), "op3-queries")
    widths = [(r["w"], r["n"]) for r in queries.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy("w").collect()]
    lists = None
    for width, n in widths:
        tiles = max(1, -(-n * 8 * max(width, 1) // tile_bytes))
        own = queries.where(F.size("v") == width)
        for t in range(tiles):
            pdf = (own if tiles == 1 else own.where(F.pmod(F.xxhash64("vec_id"), F.lit(tiles)) == t)).toPandas()
            if not len(pdf):
                continue
            q = np.array(pdf["v"].tolist(), dtype=np.int64).reshape(len(pdf), width)
            tile = best_of_tile(rows, pdf["vec_id"].to_numpy(np.int64), q, k)
            if tiles > 1:  # one tile's lists at a time are in flight
                tile = settled(tile, "op3-tile")
            lists = tile if lists is None else lists.unionByName(tile)
    if lists is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    part = merge(lists.withColumn("group", F.floor(F.col("shard") / fan_in)), k, "query_id", "group").drop("rank")
    return merge(part, k, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
