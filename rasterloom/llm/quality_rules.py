"""Quality rules: boosted trees over document statistics, scored as flat numpy node arrays.

Fixed base rules come first (too few words, too much repeated text); what passes them is judged by a
gradient-boosted model whose chosen features may only lower the score as they rise (symbols, repeats,
duplicate lines, capitals). One pass over the texts yields the statistics; the model sees only those.

The model is fitted on at most ``sample_rows`` labelled rows (those with the smallest hash of the id);
statistics and verdicts cover every row. Defined cases: a null or empty text has no words and fails the base
rules; repeated rows each get a verdict; with no labels, or one class, the verdict is that of the base rules;
a null label takes no part; rows that repeat a labelled id count once, by the mean label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import hashed_sample, settled
from .textstats import FEATURES, text_stats, with_features

NAMES = tuple(FEATURES)
#: Features whose rise may only lower the score.
FALLING = ("symbol_share", "symbols_a_word", "upper_share", "exclaims_a_word", "dup_line_share", "repeat_share", "run_share")
MONOTONE = {NAMES.index(n): -1 for n in FALLING}


def labelled_sample(stats: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of at most ``sample_rows`` rows: the smallest by hash of the id."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("y"))
    )
    joined = stats.where(F.col("doc_id").isNotNull()).join(known, "doc_id")
    rows = with_features(hashed_sample(joined, sample_rows, "doc_id")).select("y", *[f"f_{n}" for n in NAMES]).toPandas()
    return rows[[f"f_{n}" for n in NAMES]].to_numpy(np.float64), rows["y"].to_numpy(np.float64)


def fit_rules(stats: DataFrame, labels: DataFrame, *, label="quality", sample_rows=20_000) -> trees.Trees:
    x, y = labelled_sample(stats, labels, label, sample_rows)
    return trees.fit(x, y, rounds=60, depth=3, monotone=MONOTONE)


def score_column(df: DataFrame, model: trees.Trees, into: str) -> DataFrame:
    """``df`` with the model's probability; ``df`` has the columns f_*, which are dropped."""
    keep = [c for c in df.columns if not c.startswith("f_")]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", `{into}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(f"f_{n}").to_numpy(zero_copy_only=False) for n in NAMES], axis=1)
            out = [batch.column(c) for c in keep] + [pa.array(model.probability(x), pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, into])

    return df.mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, *, min_words=20, max_repeat_percent=30, threshold=0.5, sample_rows=20_000) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    stats = settled(text_stats(docs, "doc_id"), "op7-stats")
    model = fit_rules(stats, labels, sample_rows=sample_rows)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = score_column(with_features(stats).select(*base, *[f"f_{n}" for n in NAMES]), model, "score")
    kept = ~failed & (F.col("score") >= threshold) if len(model.roots) else ~failed
    return scored.select(*base, failed.alias("base_failed"), "score", kept.alias("kept"))
