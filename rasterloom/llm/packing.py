"""Harmonic packing of documents into sequences of a fixed capacity.

Lengths fall into classes by the reciprocals of the capacity: class k holds pieces of capacity / k tokens, and a bin of class k is full with k of them.
A document is cut so that every piece fits its class exactly: whole bins first, then the rest by halves (the capacity is a power of two, and so
are the classes), which gives a document at most one piece in each class above the first. So a full bin has no gap, and holds pieces
of k different documents. Each task fills its own bins and needs no other; when it ends, the fewer than k pieces left in class k form
sequences of 2^j pieces, whose lengths are powers of two and need no padding either.

A task holds at most one capacity of tokens for each class, whatever its input. There is no shuffle; pieces come out sequence by
sequence, in order, and ``sequences`` joins them. Texts are split by the public pattern, and the tokenizer's model merges each piece once while a
worker remembers it (two generations of ``KNOWN`` pieces, so that common ones stay); a text with characters that Python's Unicode tables lack, over whose
class the splitters may disagree, goes to the tokenizer whole. Sequence numbers are (partition, count), so a task that runs again gives the same ones.

Defined cases: a null text is empty; an empty text is its end token alone; each row is a document, equal rows and null ids too; no documents
give no rows; very long texts are encoded in parts, cut where the tokenizer splits anyway; other columns are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, tidy

PART = 1 << 20
#: A single space between word characters: the tokenizer's own pattern splits before it.
GAP = re.compile(r"(?<=\w) (?=\w)")
ROWS = 1 << 14
KNOWN = 400_000
LONG = 100


@cache
def _tokenizer(path: str):
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True  # a special token's string in a text is ordinary text
    return out


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: visible Latin-1 ones for themselves, the others numbered from 256."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Pieces(dict):
    """The ids of pieces, as bytes; the last KNOWN pieces met, and of those before them the ones met again."""

    def __init__(self, model) -> None:
        self.tokenize, self.letters, self.before = model.tokenize, _byte_letters(), {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = array("I", [t.id for t in self.tokenize(piece.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(piece) <= LONG:
            if len(self) >= KNOWN:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def narrow(pattern: str) -> str:
    """``pattern`` with its classes written out for Latin-1 texts, for the faster splitter of the standard library."""
    every = [chr(c) for c in range(256)]
    s, letters, digits = ["".join(map(re.escape, filter(regex.compile(k).match, every))) for k in (r"\s", r"\p{L}", r"\p{N}")]
    for k, v in ((r"[^\s\p{L}\p{N}]", f"[^{s}{letters}{digits}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{digits}]"), (r"\S", f"[^{s}]"), (r"\s", f"[{s}]")):
        pattern = pattern.replace(k, v)
    return pattern


@cache
def encoder(path: str, pattern: str = public_tokenizers.PATTERN):
    """A function from a text to its ids as unsigned 32-bit little-endian bytes, equal to the tokenizer's own."""
    tokenizer = _tokenizer(path)
    wide, latin, known = regex.compile(pattern).findall, re.compile(narrow(pattern)).findall, Pieces(tokenizer.model)

    def one(text: str) -> bytes:
        if not text or max(text) <= "\xff":
            return b"".join(map(known.__getitem__, latin(text)))
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(known.__getitem__, wide(text)))

    return lambda text: b"".join(map(one, parts(text)))


def parts(text: str) -> list[str]:
    """``text`` in parts of about PART characters whose ids are those of the whole."""
    out, at = [], 0
    while len(text) - at > PART:
        cut = GAP.search(text, at + PART)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def cuts(n: int, capacity: int) -> list[int]:
    """The lengths of a document's pieces: whole bins, then the powers of two in what is left, largest first."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << b for b in range(capacity.bit_length() - 2, -1, -1) if rest >> b & 1]


def filled(docs: Iterator[tuple[object, np.ndarray]], capacity: int) -> Iterator[list[tuple[object, int, np.ndarray, int]]]:
    """Sequences, as lists of pieces (id, start, ids, tokens of the document), from documents (id, ids)."""
    bins: dict[int, list] = {}
    for key, ids in docs:
        at = 0
        for n in cuts(len(ids), capacity):
            bin_ = bins.setdefault(n, [])
            bin_.append((key, at, ids[at : at + n], len(ids)))
            at += n
            if len(bin_) * n == capacity:
                yield bins.pop(n)
    for bin_ in bins.values():
        while bin_:
            size = 1 << (len(bin_).bit_length() - 1)
            yield bin_[:size]
            del bin_[:size]


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 0, key: str = "doc_id") -> DataFrame:
    """key, start, length, ids, doc_tokens, sequence_id, offset: one row for each piece; ids is the piece's ids as unsigned 32-bit
    little-endian numbers, each document's followed by ``end_id``."""
    if capacity & (capacity - 1) or capacity < 2:
        raise ValueError("the capacity must be a power of two")
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        encode = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        types: list[pa.DataType] = []

        def encoded() -> Iterator[tuple[object, np.ndarray]]:
            for batch in batches:
                types[:] = [batch.schema.field(0).type]
                for name, text in zip(batch.column(0), batch.column(1), strict=True):
                    yield name.as_py(), np.frombuffer(encode(text.as_py()) + end, "<u4")

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], types[0]), *[pa.array(c, t) for c, t in zip(cols[1:], [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()], strict=True)]], names=[key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        rows: list[tuple] = []
        for k, pieces in enumerate(filled(encoded(), capacity)):
            at = 0
            for name, start, ids, total in pieces:
                rows.append((name, start, len(ids), ids.tobytes(), total, first | k, at))
                at += len(ids)
            if len(rows) >= ROWS:
                yield flush(rows)
                rows = []
        if rows:
            yield flush(rows)

    given = small_batches(docs).select(key, text_or_empty().alias("__text"))
    return given.mapInArrow(tidy(run), f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """sequence_id, ids (binary), length, padded (the length to pad to: its own if a power of two, else the capacity)."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    out = pieces.groupBy("sequence_id").agg(F.aggregate(rows, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.sum("length").alias("length"))
    return out.withColumn("padded", F.when(F.col("length").bitwiseAND(F.col("length") - 1) == 0, F.col("length")).otherwise(F.lit(capacity).cast("long")))
