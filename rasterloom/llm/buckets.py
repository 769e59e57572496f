"""From sketches to classes: bucket stars, verification, the rest of unsettled buckets, distributed union-find.

Items have 64-bit ids (hashes of their content, so equal items are one). Each item has bucket keys; similar items
share one with high probability. A bucket is never expanded into its pairs: its items are linked to its smallest
id, first inside the chunk that made the sketches (so a hot bucket reaches the shuffle as one row a
chunk), then over the whole table, part by part of the keys. Links are verified on the items themselves. If all links of
a bucket hold, its items are one class and no other pair of it can matter. A large bucket else tries a few links
to other items of its largest class. If it is not one class then, it is settled
exactly: its items are cut into blocks and every two blocks meet in one task, which compares only items
that are not in one class yet. So no link between items of a bucket is lost, whatever the bucket's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, dealt_join, settled, small_side, tidy

#: Items of a block of an open bucket, and bytes of their texts; an item beyond them is a block of its own.
BLOCK, BLOCK_BYTES = 200, 8 << 20
#: Times that the classes of an open bucket of more than a block meet its largest class by one item each, before it is cut into blocks.
TURNS = 3
#: Bytes of texts whose sets are made at once.
SET_BYTES = 1 << 20
#: Parts compared as bits at a time: 400 items take 50 MB.
BITS = 1 << 20
#: Pairs (key, id) of a part, 16 bytes each: what one task holds.
PART_PAIRS = 2_000_000
#: Rows of a broadcast side of one integer.
FEW = 100_000
#: Edges that one task's union-find takes at most (about 100 MB).
LOCAL_EDGES = 500_000
SKETCH = "bands array<long>, links array<struct<bh:long,lead:long>>"


def chunk_stars(ids: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The columns bands and links of a chunk of distinct ids; keys are concatenated, counts[i] of them for item i."""
    owner = np.repeat(np.arange(len(ids)), counts)
    order = np.lexsort((ids[owner], keys))
    k, o = keys[order], owner[order]
    head = np.ones(len(k), dtype=bool)
    head[1:] = k[1:] != k[:-1]
    lead = np.empty(len(k), dtype=np.int64)
    lead[order] = ids[o[head]][np.cumsum(head) - 1]
    own = lead == ids[owner]

    def offsets(mask):
        return pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[mask], minlength=len(ids)))]).astype(np.int32))

    bands = pa.ListArray.from_arrays(offsets(own), pa.array(keys[own]))
    pairs = pa.StructArray.from_arrays([pa.array(keys[~own]), pa.array(lead[~own])], names=["bh", "lead"])
    return bands, pa.ListArray.from_arrays(offsets(~own), pairs)


def _packed(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, bands) to one row a part and batch: the batch's (key, id) pairs of that part, as bytes.

    Narrow rows by the ten million cost the shuffle far more than their bytes do; a block of them is one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column("bands")
            keys = bands.flatten().to_numpy(zero_copy_only=False)
            offsets = bands.offsets.to_numpy()
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), np.diff(offsets))
            part = (keys.view(np.uint64) >> np.uint64(17)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            pairs = np.stack([keys[order], ids[order]], axis=1)
            own, at = np.unique(part[order], return_index=True)
            edges = [*at.tolist(), len(pairs)]
            blocks = [pairs[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(blocks, pa.binary())], names=["part", "pairs"])

    return run


def _part_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by part to rows (bh, lead, id), id not the lead; one part's pairs at a time are in memory."""
    part, blocks = None, []

    def flush() -> pa.RecordBatch:
        pairs = np.concatenate(blocks) if blocks else np.zeros((0, 2), np.int64)
        bh, ids = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].T
        head = np.ones(len(bh), dtype=bool)
        head[1:] = bh[1:] != bh[:-1]
        leads = ids[head][np.cumsum(head) - 1] if len(bh) else ids
        again = np.zeros(len(bh), dtype=bool)
        again[1:] = (ids[1:] == ids[:-1]) & ~head[1:]
        keep = (ids != leads) & ~again
        return pa.RecordBatch.from_arrays([pa.array(bh[keep]), pa.array(leads[keep]), pa.array(ids[keep])], names=["bh", "lead", "id"])

    for batch in batches:
        for p, block in zip(batch.column("part").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            if p != part:
                if blocks:
                    yield flush()
                part, blocks = p, []
            blocks.append(np.frombuffer(block, dtype=np.int64).reshape(-1, 2))
    if blocks:
        yield flush()


def members(sketches: DataFrame) -> DataFrame:
    """bh, lead, id: every item of every bucket of two or more, but the leads, linked to a lead.

    Keys are dealt by hash to as many parts as keep a part's pairs under PART_PAIRS, so memory does not grow with
    the table.
    """
    reps = sketches.select("id", "bands").where(F.size("bands") > 0)
    pairs = reps.agg(F.sum(F.size("bands"))).first()[0] or 0
    parts = max(64, -(-pairs // PART_PAIRS))
    packed = reps.mapInArrow(_packed(parts), "part long, pairs binary")
    far = packed.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(_part_stars), "bh long, lead long, id long")
    near = sketches.select(F.explode("links").alias("l"), "id").select("l.bh", "l.lead", "id")
    return far.unionByName(near)


@dataclass(frozen=True)
class Likeness:
    """How two items compare.

    prepare(text, names) gives (what alike needs, the item's distinct parts as numbers, ...), numbered by means of the shared
    dictionary names; alike(x, y) judges two prepared items; least(n, m) is the overlap of part sets of those sizes
    below which no two items are alike (arrays in, array out). If the number of parts that two items share settles the matter, sets gives
    the sorted distinct parts of each of many texts, as numbers for this call, and enough(both, n, m) judges two items of n and m parts.
    """

    prepare: Callable[[str, dict], tuple]
    alike: Callable[[tuple, tuple], bool]
    least: Callable[[np.ndarray, np.ndarray], np.ndarray]
    sets: Callable[[list[str]], list[np.ndarray]] | None = None
    enough: Callable[[int, int, int], bool] | None = None

    def met(self, x: np.ndarray, y: np.ndarray) -> bool:
        """Whether two items are alike, by their sets."""
        return self.enough(min(len(x), len(y)), len(x), len(y)) and self.enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))


def verified(pairs: DataFrame, payload: DataFrame, like: Likeness) -> DataFrame:
    """a, b, ok for the pairs (a, b); payload has id and text. A lead with very many pairs is dealt to several tasks."""
    a = payload.select(F.col("id").alias("a"), F.col("text").alias("ta")).join(pairs.groupBy("a").agg(F.count("*").alias("n")), "a")
    b = payload.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead, names = None, None, {}  # pairs of one lead mostly follow each other
        for whole in batches if like.sets else ():
            rows = max(1, whole.num_rows * SET_BYTES // max(1, whole.nbytes))
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                a, first, which = np.unique(batch.column("a").to_numpy(), return_index=True, return_inverse=True)
                sets = like.sets(batch.column("ta").take(pa.array(first)).to_pylist() + batch.column("tb").to_pylist())
                ok = [like.met(sets[i], x) for i, x in zip(which.tolist(), sets[len(a) :], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])
        for batch in batches:
            ok = []
            for i, x, y in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                if i != at:
                    at, names = i, {}
                    lead = like.prepare(x.as_py(), names)
                ok.append(like.alike(lead, like.prepare(y.as_py(), names)))
                if len(names) > 2_000_000:
                    at = None
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return dealt_join(pairs.join(b, "b"), a, "a", "b").select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long, ok boolean")


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition to stars of its own components; flushed at a bound, which only costs rounds."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while up.get(root, root) != root:
            root = up[root]
        while up.get(x, x) != root:
            up[x], x = root, up[x]
        return root

    def flush() -> pa.RecordBatch:
        rows = [(x, find(x)) for x in list(up)]
        out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows if r[0] != r[1]], pa.int64()) for i in (0, 1)], names=["u", "v"])
        up.clear()
        return out

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > 2 * LOCAL_EDGES:
            yield flush()
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """id, root: connected components by union-find in tasks, then alternating large and small stars; only nodes
    that have an edge.

    Tasks of at most LOCAL_EDGES edges first shrink them to stars of their own; if there is one such task, these are
    the components. Else rounds of one job each follow: a node's least neighbour is a partial minimum, joined back
    to its edges by a join that deals the edges of such a node to several tasks.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))

    def round_(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = dealt_join(both, settled(least(both), "least"), "u", "v").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = settled(large.dropDuplicates(["u", "v"]), "large")
        low = settled(least(large), "least")
        small = dealt_join(large, low, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return small.where("u <> v").dropDuplicates(["u", "v"])

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    tasks = max(1, -(-e.count() // LOCAL_EDGES))
    e = settled(e.coalesce(tasks).mapInArrow(_local_stars, "u long, v long"), "edges")
    seen = mark(e) if tasks > 1 else (0,)
    while seen[0]:
        e = settled(round_(e), "round")
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def bit_sets(items: list[np.ndarray], width: int) -> np.ndarray:
    """Sets of numbers below ``width`` as rows of bits, 64 to a word."""
    bits = np.zeros((len(items), -(-max(width, 1) // 64)), dtype=np.uint64)
    for i, at in enumerate(items):
        np.bitwise_or.at(bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return bits


def shared_parts(parts: list[np.ndarray], pairs: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """For each (i, others) the number of parts that item i shares with each of the others; BITS parts at a time are bits."""
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    width = int((times > 1).sum())
    dense = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[number]  # a part of one item is shared by none
    cut = np.split(dense, np.cumsum([len(p) for p in parts])[:-1])
    cut = [np.sort(c[c >= 0]) for c in cut]
    out = [np.zeros(len(others), np.int64) for _, others in pairs]
    for start in range(0, width, BITS):
        bits = bit_sets([c[np.searchsorted(c, start) : np.searchsorted(c, start + BITS)] - start for c in cut], min(BITS, width - start))
        for (i, others), n in zip(pairs, out, strict=True):
            n += np.bitwise_count(bits[others] & bits[i]).sum(axis=1, dtype=np.int64)
    return out


def _tiles(rest: DataFrame, payload: DataFrame, like: Likeness) -> DataFrame:
    """a, b: links between items of one bucket that are not in one class yet; rest has bh, id, root, members (of the bucket).

    A bucket is cut into blocks by its items and by the bytes of their texts, whichever asks for more. A class that fills more than one
    block has blocks of its own, no two of which meet, so that the items of a large class go to the blocks of the others alone.
    """
    need = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    place = F.xxhash64("bh", "root")
    sizes = payload.select("id", F.octet_length("text").alias("bytes"))
    parts = rest.join(sizes, "id").groupBy("bh", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("members").alias("members"))
    parts = settled(parts.select(place.alias("part"), "bh", "root", "n", "bytes", "members", need.alias("own")), "parts")
    mixed = parts.where("own = 1").groupBy("bh").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("rows"), F.max("members").alias("members"))
    mixed = settled(mixed.select("bh", F.col("rows").alias("n"), "members", need.alias("mixed")), "mixed")
    parts = settled(dealt_join(parts, mixed.select("bh", "n", "mixed"), "bh", "part", "left"), "parts")
    alone, blocks = F.col("own") > 1, F.when(F.col("own") > 1, F.col("own")).otherwise(F.col("mixed"))

    def block(i):
        return F.when(alone, F.xxhash64("root", i)).otherwise(i.cast("long"))

    listed = parts.where(alone).select("bh", "members", "root", "own", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"))
    listed = listed.select("bh", "members", F.struct(block(F.col("i")).alias("block"), F.col("root").alias("of")).alias("b"))
    shared = mixed.select("bh", "members", F.explode(F.sequence(F.lit(0), F.col("mixed") - 1)).alias("i"))
    listed = listed.unionByName(shared.select("bh", "members", F.struct(F.col("i").cast("long").alias("block"), F.lit(None).cast("long").alias("of")).alias("b")))
    listed = settled(listed.groupBy("bh").agg(F.max("members").alias("n"), F.collect_list("b").alias("all")), "blocks")
    cut = dealt_join(rest.withColumn("part", place).select("part", "bh", "id", "root"), parts.select("part", "n", "own", "mixed"), "part", "id")
    cut = cut.select("bh", "id", "root", block(F.pmod(F.xxhash64("id"), blocks).cast("int")).alias("own"), F.when(alone, F.col("root")).alias("of"))
    met = F.filter("all", lambda b: F.col("of").isNull() | b["of"].isNull() | (b["of"] != F.col("of")))["block"]
    dealt = dealt_join(cut, listed, "bh", "id").select("bh", "own", "id", "root", F.explode(met).alias("other"))
    dealt = dealt.select("bh", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "root")

    def settle(rows: list[tuple], same: bool) -> list[tuple[int, int]]:
        """The links of one pair of blocks; rows are (own, id, root, text), same if the two blocks are one."""
        own, ids, roots, texts = zip(*rows, strict=True)
        if len(set(roots)) == 1:  # one class already
            return []
        names: dict = {}
        first = min(own)
        left = [i for i, o in enumerate(own) if o == first]
        right = left if same else [i for i, o in enumerate(own) if o != first]
        up: dict[int, int] = {}
        out = []

        def find(r):
            while r in up:
                r = up[r]
            return r

        def compare(i: int, j: int, alike: Callable[[int, int], bool]) -> None:
            if (not same or i < j) and (a := find(roots[i])) != (b := find(roots[j])) and alike(i, j):
                out.append((ids[i], ids[j]))
                up[a] = b

        if like.sets and len(left) * len(right) <= 400:
            sets = like.sets(list(texts))
            for i in left:
                for j in right:
                    compare(i, j, lambda i, j: like.met(sets[i], sets[j]))
            return out
        if len(left) * len(right) <= 400:
            seen: dict[int, object] = {}  # items of a class that meet no other need no look

            def item(i: int) -> object:
                if i not in seen:
                    seen[i] = like.prepare(texts[i], names)
                return seen[i]

            for i in left:
                for j in right:
                    compare(i, j, lambda i, j: like.alike(item(i), item(j)))
            return out
        items = [] if like.sets else [like.prepare(t, names) for t in texts]
        parts = like.sets(list(texts)) if like.sets else [np.fromiter(x[1], dtype=np.int64, count=len(x[1])) for x in items]
        size, root, other = np.array([len(x) for x in parts]), np.array(roots), np.array(right)
        pairs = []
        for i in left:
            apart = other[root[other] != root[i]]  # of a large class only the few others are looked at
            if same:
                apart = apart[apart > i]
            pairs.append((i, apart[np.minimum(size[apart], size[i]) >= like.least(size[i], size[apart])]))
        for (i, apart), both in zip(pairs, shared_parts(parts, pairs), strict=True):
            near = both >= like.least(size[i], size[apart])
            for j, n in zip(apart[near].tolist(), both[near].tolist(), strict=True):
                compare(i, j, lambda i, j, n=n: like.enough(n, len(parts[i]), len(parts[j])) if like.sets else like.alike(items[i], items[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (bh, x, y): one such group at a time is in memory, at most two blocks."""
        key, rows = None, []

        def flush() -> pa.RecordBatch:
            links = settle(rows, key[1] == key[2]) if len({r[0] for r in rows}) == 1 + (key[1] != key[2]) else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bh", "x", "y", "own", "id", "root")]
            for bh, x, y, own, i, root, text in zip(*cols, batch.column("text"), strict=True):
                if (bh, x, y) != key:
                    if rows:
                        yield flush()
                    key, rows = (bh, x, y), []
                rows.append((own, i, root, text.as_py()))
        if rows:
            yield flush()

    grouped = dealt.join(payload, "id").repartition("bh", "x", "y").sortWithinPartitions("bh", "x", "y")
    return grouped.select("bh", "x", "y", "own", "id", "root", "text").mapInArrow(tidy(run), "a long, b long")


def classes(found: DataFrame, payload: DataFrame, like: Likeness) -> DataFrame:
    """id, root of all items in a class of two or more.

    found is settled members; payload has id and text for their ids. Texts are dealt by id once, into buckets; then they are shuffled to
    the other text of a pair, and to pairs of blocks, alone.
    """
    payload = bucketed(payload, "id", "payload")
    pairs = settled(found.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).dropDuplicates(["a", "b"]), "pairs")
    judged = settled(verified(pairs, payload, like), "verified")
    links = judged.where("ok").select("a", "b")
    roots = settled(components(links), "roots")
    failed = judged.where("not ok").select("a", "b")
    star = found.withColumn("a", F.least("lead", "id")).withColumn("b", F.greatest("lead", "id"))
    # buckets of three or more with a link that did not hold
    open_ = star.join(small_side(failed.withColumn("bad", F.lit(1))), ["a", "b"], "left").groupBy("bh").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).where("n > 1 and bad > 0")
    open_ = settled(open_.select("bh", "n"), "open")
    # few of them go to the buckets' rows, of which most are in none
    inside = star.join(F.broadcast(open_.select("bh")), "bh", "left_semi") if open_.count() <= FEW else dealt_join(star, open_, "bh", "id", "left_semi")
    inside = inside.select("bh", "id").unionByName(inside.select("bh", F.col("lead").alias("id"))).dropDuplicates(["bh", "id"])
    inside = settled(inside.join(small_side(roots), "id", "left").select("bh", "id", F.coalesce("root", "id").alias("root")), "inside")
    rest, more = _still_open(inside), None
    for turn in range(TURNS):
        met = _met_anew(rest.where(F.col("members") > BLOCK), payload, like, turn)
        if met is None:
            break
        more = met.select("a", "b") if more is None else more.unionByName(met.select("a", "b"))
        up = components(met.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("id").alias("root"), F.col("root").alias("to"))
        up = settled(up.join(rest.groupBy("root").agg(F.count("*").alias("n")), "root"), "up")
        rest = _still_open(dealt_join(rest.select("bh", "id", "root"), up, "root", "id", "left").select("bh", "id", F.coalesce("to", "root").alias("root")))
    if not rest.isEmpty():
        last = settled(_tiles(rest, payload, like), "more")
        more = last if more is None else more.unionByName(last)
    return roots if more is None or more.isEmpty() else settled(components(links.unionByName(more)), "roots2")


def _still_open(inside: DataFrame) -> DataFrame:
    """bh, id, root, members of the buckets (bh, id, root) of three or more items that are not one class."""
    size = inside.groupBy("bh").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    size = settled(size.where("n > 2 and lo <> hi").select("bh", "n", F.col("n").alias("members")), "sizes")
    return settled(dealt_join(inside, size, "bh", "id"), "rest")


def _met_anew(rest: DataFrame, payload: DataFrame, like: Likeness, turn: int) -> DataFrame | None:
    """a, b, ra, rb: links that hold of an item of each class of a bucket to one of the bucket's largest class, which differs by turn; None without any.

    Most of a large class's outsiders are unlike its least item alone, and a bucket that becomes one class this way need not be cut into blocks.
    """
    if rest.isEmpty():
        return None
    sides = rest.groupBy("bh", "root").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", "bh", F.lit(turn))).alias("id"))
    sides = settled(sides, "sides")
    largest = sides.groupBy("bh").agg(F.max(F.struct("n", "root", "id")).alias("top"), F.count("*").alias("n"))
    pairs = dealt_join(sides.drop("n"), settled(largest, "largest"), "bh", "root").where(F.col("root") != F.col("top.root"))
    pairs = pairs.select(F.least("id", "top.id").alias("a"), F.greatest("id", "top.id").alias("b"), F.least("root", "top.root").alias("ra"), F.greatest("root", "top.root").alias("rb"))
    pairs = settled(pairs.dropDuplicates(["a", "b"]), "anew")
    met = settled(verified(pairs.select("a", "b"), payload, like).where("ok").join(pairs, ["a", "b"]).select("a", "b", "ra", "rb"), "met")
    return None if met.isEmpty() else met
