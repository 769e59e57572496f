"""Statistics of whole texts, one Arrow-batched pass, for the two quality operators.

Every figure is exact. A null text counts as empty. Memory is bounded by one batch of texts and the
windows of the longest one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, tidy

#: The symbols counted by ``n_symbols``.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "n_lines",
    "n_upper", "n_lower", "n_digits", "n_marks", "n_exclaim", "n_distinct", "n_runs", "longest",
)

_ODD = np.array([int(x) for x in np.random.default_rng(8).integers(1, 2**62, WINDOW)], dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_window_words(words: list[bytes]) -> int:
    """Words that lie in a window of 8 words found twice or more in the text, the first one included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.uint64, count=n)
    if len(seen) == n:
        return 0
    m = n - WINDOW + 1
    h = np.zeros(m, dtype=np.uint64)
    for j in range(WINDOW):
        h += (ids[j : j + m] + np.uint64(1)) * _ODD[j]
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    # exact: equal hashes count only if the eight words are equal too
    a, b = order[:-1][same], order[1:][same]
    for j in range(WINDOW):
        if not np.array_equal(ids[a + j], ids[b + j]):
            groups: dict[tuple, list[int]] = {}
            for i in range(m):
                groups.setdefault(tuple(ids[i : i + WINDOW]), []).append(i)
            starts = np.array([i for g in groups.values() if len(g) > 1 for i in g], dtype=np.int64)
            break
    else:
        starts = np.unique(np.concatenate([a, b]))
    cover = np.zeros(n + 1, dtype=np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(cover[:n])))


def stats_of(text: str) -> tuple[int, ...]:
    """The figures of COUNTS for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    lines = text.split("\n")
    filled = [x for x in (line.strip(" \t\x0b\x0c\r") and line for line in lines) if x]
    codes = np.frombuffer(raw, dtype=np.uint8)
    per_byte = np.bincount(codes, minlength=128) if len(raw) else np.zeros(128, dtype=np.int64)
    letters = per_byte[97:123].sum()
    upper = per_byte[65:91].sum()
    runs = sum(map(bytes.__eq__, words, words[1:]))
    return (
        len(words), len(text) - blanks, int(sum(per_byte[ord(c)] for c in SYMBOLS)), len(filled) - len(set(filled)),
        repeated_window_words(words), len(text), len(filled), int(upper), int(letters), int(per_byte[48:58].sum()),
        int(per_byte[33:48].sum() + per_byte[58:65].sum() + per_byte[91:97].sum() + per_byte[123:127].sum()),
        int(per_byte[33]), len(set(words)), runs, max(map(len, words), default=0),
    )


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [stats_of(t.as_py()) for t in batch.column("__text")]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in COUNTS]
        kept = batch.drop_columns(["__text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(c, pa.int64()) for c in cols]], names=[*kept.schema.names, *COUNTS])


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the COUNTS (long) of every row's text."""
    types = dict(docs.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + [f"{c} long" for c in COUNTS])
    return small_batches(docs).select(*keep, text_or_empty().alias("__text")).mapInArrow(tidy(_batches), schema)


#: Features by name, as SQL over COUNTS; all are ratios, so that a text's length alone says little.
FEATURES = {
    "symbol_share": "n_symbols / greatest(n_chars_all, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_upper + n_lower, 1)",
    "exclaims_a_word": "n_exclaim / greatest(n_words, 1)",
    "marks_a_word": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(n_chars_all, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / sqrt(greatest(n_words, 1))",
    "run_share": "n_runs / greatest(n_words, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
    "longest": "least(longest, 1000)",
    "n_words": "least(n_words, 100000)",
}


def with_features(stats: DataFrame, names=tuple(FEATURES)) -> DataFrame:
    return stats.select("*", *[F.expr(f"cast({FEATURES[n]} as double)").alias(f"f_{n}") for n in names])
