"""MinHash near-dedup: Order MinHash sketches, verified by a banded alignment of the words.

A document is its lower-cased words; its k-mers are its runs of ``K`` = 5 words, each labelled with its
occurrence number, so that repeats count. A sketch element takes, under one hash function, the ``PICK`` smallest
labelled k-mers and keeps them in text order: two documents share it only if the same k-mers are minimal and stand
in the same order, which makes it sensitive to edit similarity. ``ELEMENTS`` such elements are the bucket keys.

Candidates are verified by an alignment of their words in order, the longest common subsequence: two documents of n and m words are linked if
aligned / (n + m - aligned) >= 0.8. The alignment is exact whatever the length: bit vectors run over blocks of ``WIDTH`` words, within the band of
diagonals that an alignment of that similarity can reach. Its upper bound, the words in common with their occurrence numbers, is looked at first.

If s of u k-mers are common and in order, an element is shared with odds s (s - 1) / (u (u - 1)), so pairs meet with probability
1 - (1 - those odds) ** ELEMENTS: of pairs that align at 0.8 with one word in ten replaced, dropped or added at random, more than 0.93 from 20 words on, and
0.98 and more with one in 20. A pair without two k-mers in common never meets by itself: edits spread evenly over a text of ten words leave none.
Inside a bucket that is settled, every two items are compared. Classes come from the distributed
union-find and keep the row with the smallest doc_id (nulls last, then any one of equal rows).

Defined cases: a null text is empty; texts equal in lower-cased words, those without words among them,
are copies; texts of fewer than 6 words have one k-mer, all their words or those five, so they meet equal copies alone; repeated rows are copies, of which one
row stays; an empty table gives no rows. Texts are told apart by 64-bit hashes (BLAKE2b).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets
from .common import bucketed, dealt_join, fresh, settled, small_batches, text_or_empty, tidy

K = 5
ELEMENTS, PICK = 32, 2
#: Least similarity of the words in order.
THRESHOLD = 0.8
#: Words in a block of the alignment: bits of a vector.
WIDTH = 16_384
CHUNK = 1 << 21

_RNG = np.random.default_rng(5)
_WORD = (_RNG.integers(0, 2**62, K, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MUL = (_RNG.integers(0, 2**62, ELEMENTS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, ELEMENTS, dtype=np.uint64)
_PLACE = (_RNG.integers(0, 2**62, PICK, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def common_words(a: list[int], b: list[int], ahead: int | None = None, behind: int | None = None) -> int:
    """Words of a and b in one order, the longest common subsequence, by Hyyrö's bit vectors.

    An alignment that pairs a[i] with b[j] only for -behind <= i - j <= ahead is found whole; without bounds every one is.
    b is cut into blocks, from each to the next of which a row hands one bit.
    """
    ahead, behind = len(a) if ahead is None else ahead, len(b) if behind is None else behind
    carry = bytearray(len(a))
    total = 0
    for start in range(0, len(b), WIDTH):
        block = b[start : start + WIDTH]
        at: dict[int, int] = {}
        for j, w in enumerate(block):
            at[w] = at.get(w, 0) | 1 << j
        full = (1 << len(block)) - 1
        v = full
        # before the band nothing of this block is aligned yet: a row's bit passes through; behind it no bits come
        for i in range(max(0, start - behind), min(len(a), start + len(block) + ahead)):
            u = v & at.get(a[i], 0)
            if u or carry[i]:
                s = v + u + carry[i]
                carry[i] = s > full
                v = (s | v - u) & full
        total += len(block) - v.bit_count()
    return total


def least_overlap(n, m):
    """The words that two linked texts of n and m words align at least."""
    return np.ceil(THRESHOLD / (1 + THRESHOLD) * (n + m) - 1e-9)


def prepare(text: str, names: dict) -> tuple[np.ndarray, np.ndarray]:
    """The words as numbers by ``names``, in order, and sorted with each one's occurrence number."""
    words = words_of(text)
    w = np.fromiter((names.setdefault(x, len(names)) for x in words), dtype=np.int64, count=len(words))
    ranked = np.sort(w)
    return w.astype(np.int32), (ranked << 32) + np.arange(len(w)) - np.searchsorted(ranked, ranked)


def alike(x: tuple, y: tuple) -> bool:
    """Whether two prepared texts are linked."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    a, b = x[0], y[0]
    n, m = len(a), len(b)
    if n == m and np.array_equal(a, b):
        return True
    least = int(least_overlap(n, m))
    if n < least or len(np.intersect1d(x[1], y[1], assume_unique=True)) < least:
        return False
    # equal ends are aligned in some longest alignment
    differ = np.flatnonzero(a != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[head:][::-1] != b[m - n + head :][::-1])
    tail = int(differ[0]) if len(differ) else n - head
    # an alignment of `least` words leaves n - least and m - least alone, which bounds its shift
    return head + tail + common_words(a[head : n - tail].tolist(), b[head : m - tail].tolist(), n - least, m - least) >= least


def similar(x: str, y: str) -> bool:
    names: dict = {}
    return alike(prepare(x, names), prepare(y, names))


LIKENESS = buckets.Likeness(prepare, alike, least_overlap)


def element_keys(words: list[bytes]) -> np.ndarray:
    """The sketch of a text with words: ELEMENTS bucket keys."""
    w = np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))
    w ^= np.fromiter(map(len, words), dtype=np.uint64, count=len(words)) << np.uint64(32)
    n = max(1, len(w) - K + 1)
    g = np.zeros(n, dtype=np.uint64)
    for j in range(min(K, len(w))):
        g += (w[j : j + n] + np.uint64(1)) * _WORD[j]
        g ^= g >> np.uint64(31)
    g *= np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    if same.any():  # occurrence labels
        run = np.concatenate([[0], np.cumsum(~same)])
        nth = np.arange(n) - np.searchsorted(run, run)
        label = np.empty(n, dtype=np.uint64)
        label[order] = nth
        g = g + label * np.uint64(0xD6E8FEB86659FD93)
    out = np.zeros(ELEMENTS, dtype=np.uint64)
    slab = max(1, CHUNK // 8 // n)  # elements at a time
    for e in range(0, ELEMENTS, slab):
        h = g[None, :] * _MUL[e : e + slab, None] + _ADD[e : e + slab, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        rows = np.arange(len(h))
        at = np.empty((len(h), min(PICK, n)), dtype=np.int64)
        kept = np.empty(at.shape, dtype=np.uint64)
        for p in range(at.shape[1]):
            at[:, p] = h.argmin(axis=1)
            kept[:, p] = h[rows, at[:, p]]
            h[rows, at[:, p]] = np.uint64(2**64 - 1)
        kept = np.take_along_axis(kept, np.argsort(at, axis=1), axis=1)
        out[e : e + slab] = (kept * _PLACE[: at.shape[1]]).sum(axis=1, dtype=np.uint64)
    out ^= np.arange(ELEMENTS, dtype=np.uint64)
    out ^= out >> np.uint64(33)
    return (out * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def text_id(words: list[bytes]) -> int:
    return int.from_bytes(blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def sketch(docs: DataFrame) -> DataFrame:
    """row, doc_id, id, bands, links; the sketch stands with the first row of each text in a chunk."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        keys: list[np.ndarray] = []
        seen: set[int] = set()
        none = np.zeros(0, np.int64)
        size = 0

        def flush():
            r, d, i = zip(*rows, strict=True)
            ids = np.array(i, dtype=np.int64)
            bands, links = buckets.chunk_stars(ids, np.concatenate(keys), np.array([len(k) for k in keys]))
            out = pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(d), pa.array(ids), bands, links], names=["row", "doc_id", "id", "bands", "links"])
            rows.clear()
            keys.clear()
            seen.clear()
            return out

        for batch in batches:
            doc_ids = batch.column("doc_id")
            for row, doc, text in zip(batch.column("row").to_pylist(), doc_ids.to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                i = text_id(words)
                rows.append((row, doc, i))
                keys.append(element_keys(words) if words and i not in seen else none)
                seen.add(i)
                size += sum(map(len, words))
                if size >= CHUNK:
                    yield _typed(flush(), doc_ids.type)
                    size = 0
            kind_of = doc_ids.type
        if rows:
            yield _typed(flush(), kind_of)

    return small_batches(docs).select("row", "doc_id", text_or_empty().alias("text")).mapInArrow(tidy(run), f"row long, doc_id {kind}, id long, {buckets.SKETCH}")


def _typed(batch: pa.RecordBatch, kind: pa.DataType) -> pa.RecordBatch:
    return batch.set_column(1, "doc_id", batch.column(1).cast(kind))


def near_classes(docs: DataFrame, row: str = "row") -> DataFrame:
    """row, doc_id, class_id, kept, n_rows of the class: one row for each row of ``docs``.

    ``docs`` has a column ``row``, unique to the row and the same whenever the table is read.
    """
    docs = docs.select(F.col(row).alias("row"), "doc_id", "text")
    rows = settled(sketch(docs), "op5-rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    found = settled(buckets.members(rows.select("id", "bands", "links")), "op5-members")
    near = found.select("id").unionByName(found.select(F.col("lead").alias("id"))).distinct()
    texts = settled(rows.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n")), "op5-texts")
    wanted = settled(texts.join(near, "id").select("id", F.col("first.row").alias("row")), "op5-wanted")
    payload = docs.select("row", text_or_empty().alias("text")).join(wanted.hint("shuffle_hash"), "row").select("id", "text")
    roots = buckets.classes(found, payload, LIKENESS)
    named = settled(texts.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "op5-named")
    lead = named.groupBy("root").agg(F.min("first").alias("lead"), F.sum("n").alias("n_rows"), F.count("*").alias("n")).where("n_rows > 1")
    verdict = dealt_join(named.select("id", "root", F.col("n").alias("copies")), settled(lead, "op5-lead"), "root", "id")
    verdict = settled(verdict.select("id", "lead", "n_rows", F.col("copies").alias("n")), "op5-verdict")
    out = dealt_join(rows.select("row", "doc_id", "id"), verdict, "id", "row", "left")
    alone = F.col("lead").isNull()
    return out.select(
        "row", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("class_id"),
        F.when(alone, True).otherwise(F.col("row") == F.col("lead.row")).alias("kept"), F.coalesce("n_rows", F.lit(1)).cast("long").alias("n_rows"),
    )


def numbered(docs: DataFrame, row: str = "row") -> DataFrame:
    """A copy on the shared folder with the column ``row``, dealt by it into buckets: a reread gives the same numbers, and texts are shuffled once at any size."""
    return bucketed(docs.withColumn(row, F.monotonically_increasing_id()), row, "op5-docs")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of ``docs``."""
    row = fresh("row", docs.columns)
    plain = numbered(docs, row)
    lost = settled(near_classes(plain, row).where(~F.col("kept")).select(F.col("row").alias(row)), "op5-lost")
    return plain.join(lost.hint("shuffle_hash"), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
