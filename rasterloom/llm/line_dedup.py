"""Line dedup: of lines that are equal or nearly equal anywhere in the corpus, one stays.

Lines are normalised (case folded, white space runs to one space). Every distinct line of at least one visible
character gets MinHash values over its shingles of ``SHINGLE`` characters; ``BANDS`` bands of ``ROWS`` values
bring pairs of similarity 0.8 together with probability 0.995 (0.9999 at 0.87). Candidates are verified by the
exact Jaccard similarity of their shingle sets, and classes come from the distributed union-find. A class keeps
its first line by (doc_id, text hash, line number, row), nulls last. Lines shorter than a shingle match when equal.

Rows are numbered and dealt by their number into buckets of a table on the shared folder: texts are shuffled there, once. A pass over it turns texts
into hashes, a second one takes the lines to compare, a third one drops the lost lines; of the last two, only line numbers
are shuffled to the buckets. Nothing depends on a size.

Lines are told apart by 64-bit hashes (BLAKE2b). Defined cases: a null text stays null; blank lines stay as they
are; of rows equal in doc_id and text, or in text without a doc_id, one keeps the lines; a text whose lines all go becomes
empty and its row stays; n_chars, if there, is set to the new length; n_lines and n_lost, if there, are replaced; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets
from .common import bucketed, dealt_join, fresh, settled, small_batches, tidy

SHINGLE = 8
BANDS, ROWS = 10, 4
THRESHOLD = 0.8
CHUNK = 1 << 21
#: Lines hashed at once.
SLAB = 200

_RNG = np.random.default_rng(4)
_MUL = (_RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ROLL = (_RNG.integers(0, 2**31, SHINGLE, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_FOLD = (_RNG.integers(0, 2**62, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def normal(line: str) -> str:
    return " ".join(line.casefold().split())


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(x: set, y: set) -> bool:
    """Exact Jaccard similarity of at least 0.8."""
    if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    both = len(x & y)
    return both >= THRESHOLD * (len(x) + len(y) - both)


def similar(a: str, b: str) -> bool:
    return jaccard(shingles(a), shingles(b))


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each line as sorted numbers, equal for equal shingles of these lines alone.

    With at most 256 characters in use a shingle is one in 64 bits; else, or with a line shorter than a shingle, a dictionary gives the numbers.
    """
    size = np.array([len(x) for x in lines], dtype=np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = np.arange(256)
    if len(codes) and codes.max() > 255:
        kinds, codes = np.unique(codes, return_inverse=True)
    if not len(lines) or size.min() < SHINGLE or len(kinds) > 256:
        names: dict = {}
        return [np.unique(np.array([names.setdefault(g, len(names)) for g in shingles(x)], dtype=np.uint64)) for x in lines]
    n, codes = len(codes) - SHINGLE + 1, codes.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        h <<= np.uint64(8)
        h |= codes[j : j + n]
    first = np.cumsum(size) - size
    out = []
    for a, k in zip(first.tolist(), size.tolist(), strict=True):
        x = np.sort(h[a : a + k - SHINGLE + 1])
        again = x[1:] == x[:-1]
        out.append(x[np.flatnonzero(np.concatenate([[True], ~again]))] if again.any() else x)
    return out


LIKENESS = buckets.Likeness(
    lambda line, names: (None, frozenset(names.setdefault(g, len(names)) for g in shingles(line))),
    lambda x, y: jaccard(x[1], y[1]),
    lambda n, m: np.ceil(THRESHOLD / (1 + THRESHOLD) * (n + m) - 1e-9),
    shingle_sets,
    lambda both, n, m: both >= THRESHOLD * (n + m - both),
)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    return h


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) bucket keys of normalised lines of SHINGLE characters or more."""
    size = np.array([len(x) for x in lines])
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), dtype=np.uint32)
    n = len(codes) - SHINGLE + 1
    h = np.zeros(n, dtype=np.uint32)
    for j in range(SHINGLE):
        h += codes[j : j + n] * _ROLL[j]
    _mix(h)
    # shingles that run over a line's end are no one's: the highest hash never is a minimum
    first = np.cumsum(size) - size
    inner = np.repeat(first + size - SHINGLE, size)[: n] >= np.arange(n)
    out = np.zeros((len(lines), BANDS), dtype=np.uint64)
    block = np.empty(n, dtype=np.uint32)
    over = np.flatnonzero(~inner)
    for i in range(BANDS * ROWS):
        np.multiply(h, _MUL[i], out=block)  # h is mixed: products by odd numbers order it anew
        block[over] = 0xFFFFFFFF
        out[:, i // ROWS] += np.minimum.reduceat(block, first).astype(np.uint64) * _FOLD[i // ROWS, i % ROWS]
        out[:, i // ROWS] ^= out[:, i // ROWS] >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= (np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[None, :]
    return out.view(np.int64)


def line_id(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8"), digest_size=8).digest(), "little", signed=True)


def _chunk(where: list[tuple], lines: list[str], ids: np.ndarray) -> pa.RecordBatch:
    """One row for each line of each document; sketches stand with the first row of each distinct line."""
    row, doc, key, no = zip(*where, strict=True)
    _, at = np.unique(ids, return_index=True)
    at.sort()
    firsts = [i for i in at.tolist() if len(lines[i]) >= SHINGLE]
    keys = np.concatenate([band_keys([lines[i] for i in firsts[a : a + SLAB]]) for a in range(0, len(firsts), SLAB)]) if firsts else np.zeros((0, BANDS), np.int64)
    counts = np.zeros(len(lines), np.int64)
    counts[firsts] = BANDS
    bands, links = buckets.chunk_stars(ids, keys.reshape(-1), counts)
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(doc), pa.array(key, pa.int64()), pa.array(no, pa.int32()), pa.array(ids), bands, links], names=["row", "doc_id", "th", "line", "id", "bands", "links"])


def sketch_lines(docs: DataFrame) -> DataFrame:
    """row, doc_id, th (hash of the text), line, id, bands, links for every line that is not blank; ``docs`` has row, doc_id, text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: list[tuple] = []
        lines: list[str] = []
        size, kept = 0, None

        def flush():
            out = _chunk(where, lines, np.array([line_id(x) for x in lines], dtype=np.int64))
            where.clear()
            lines.clear()
            return out.set_column(1, "doc_id", out.column("doc_id").cast(kept))

        for batch in batches:
            kept = batch.column("doc_id").type
            for row, doc, th, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "th")), batch.column("text"), strict=True):
                for no, line in enumerate(text.as_py().split("\n")):
                    if line := normal(line):
                        where.append((row, doc, th, no))
                        lines.append(line)
                        size += len(line)
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if lines:
            yield flush()

    rows = small_batches(docs).where(F.col("text").isNotNull()).select("row", "doc_id", F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(tidy(run), f"row long, doc_id {kind}, th long, line int, id long, {buckets.SKETCH}")


def _fetch(docs: DataFrame, places: DataFrame) -> DataFrame:
    """id, text: the normalised lines at the places (row, line, id); a bucket's places are the side held, its texts pass."""
    wanted = places.groupBy("row").agg(F.collect_list(F.struct("line", "id")).alias("want"))
    rows = docs.select("row", "text").join(wanted.hint("shuffle_hash"), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for text, want in zip(batch.column("text"), batch.column("want").to_pylist(), strict=True):
                lines = text.as_py().split("\n")
                for w in want:
                    ids.append(w["id"])
                    out.append(normal(lines[w["line"]]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "text"])

    return rows.select("text", "want").mapInArrow(tidy(run), "id long, text string")


def lost_lines(docs: DataFrame) -> DataFrame:
    """row, lost: sorted numbers of the lines that go, for each row that loses any; ``docs`` has row, doc_id, text and is bucketed by row."""
    rows = settled(sketch_lines(docs), "op4-lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "line", "row")
    found = settled(buckets.members(rows.select("id", "bands", "links")), "op4-members")
    near = settled(found.select("id").unionByName(found.select(F.col("lead").alias("id"))).distinct().withColumn("near", F.lit(True)), "op4-near")
    # only lines that stand twice or have a neighbour matter from here on
    times = rows.groupBy("id").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    firsts = settled(times.join(near, "id", "left").where("n > 1 or near"), "op4-firsts")
    payload = _fetch(docs, firsts.where("near").select("first.row", "first.line", "id"))
    roots = buckets.classes(found, payload, LIKENESS)
    named = settled(firsts.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"), "first", F.col("n").alias("times")), "op4-named")
    stays = named.groupBy("root").agg(F.min("first").alias("stays"), F.sum("times").alias("lines"), F.count("*").alias("n")).where("lines > 1")
    verdict = dealt_join(named.select("id", "root", "times"), settled(stays.select("root", "n", "stays.row", "stays.line"), "op4-stays"), "root", "id")
    verdict = settled(verdict.select("id", F.col("times").alias("n"), F.col("row").alias("at_row"), F.col("line").alias("at_line")), "op4-verdict")
    gone = dealt_join(rows.select("id", "row", "line"), verdict, "id", "row").where("row <> at_row or line <> at_line")
    return gone.groupBy("row").agg(F.array_sort(F.collect_list("line")).alias("lost"))


def dedup_lines(docs: DataFrame, *, counts: bool = True) -> DataFrame:
    """``docs`` with deduplicated text, and with ``counts`` the columns n_lines and n_lost (int)."""
    row, lost, made = fresh("row", docs.columns), fresh("lost", docs.columns), ("n_lines", "n_lost") if counts else ()
    plain = bucketed(docs.withColumn(row, F.monotonically_increasing_id()), row, "op4-docs")
    gone = settled(lost_lines(plain.select(F.col(row).alias("row"), "doc_id", "text")), "op4-lost").select(F.col("row").alias(row), F.col("lost").alias(lost))
    rows = plain.join(gone.hint("shuffle_hash"), row, "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col(lost).isNull(), F.col("text")).otherwise(
        F.concat_ws("\n", F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(lost, i), x)), lambda x: x.isNotNull()))
    )
    types = dict(docs.dtypes)
    out = [kept.alias("text") if c == "text" else F.length(kept).cast(types[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns if c not in made]
    if counts:
        n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0))
        out += [n_lines.alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).alias("n_lost")]
    return rows.select(*out)
