"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Boosted trees over text statistics give candidate rules: every path from a root is a conjunction of
threshold conditions. A lasso-penalised logistic regression over the rules' 0/1 outcomes keeps a few of them,
and each kept rule becomes part of one Catalyst expression, so scoring is a projection over the statistics.

Learning uses rows whose crc32(doc_id as text) mod 4 is not 2, at most ``sample_rows`` of them (smallest hash
of the id first); every row is scored. Inputs of a score are statistics of the text alone. Defined cases: null
and empty texts have all statistics 0 and get that vector's score; with no labels or one class all rows get the
constant rate of the labels seen; null labels are ignored; repeated rows each get the same score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trees
from .common import fold_of, hashed_sample, settled, text_or_empty
from .quality_rules import NAMES, labelled_sample
from .textstats import text_stats, with_features

HELD_OUT = (4, 2)
THRESHOLD = 0.7


@dataclass
class RuleEnsemble:
    """sigmoid(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]]

    def column(self) -> Column:
        margin = F.lit(self.bias)
        for path, weight in self.rules:
            holds = F.lit(True)
            for j, below, threshold in path:
                x = F.col(f"f_{NAMES[j]}")
                holds = holds & ((x <= threshold) if below else (x > threshold))
            margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{NAMES[j]} {'<=' if below else '>'} {t:.6g}" for j, below, t in path) for path, w in self.rules]


def rule_matrix(x: np.ndarray, paths) -> np.ndarray:
    out = np.ones((len(x), len(paths)), dtype=bool)
    for k, path in enumerate(paths):
        for j, below, t in path:
            out[:, k] &= (x[:, j] <= t) if below else (x[:, j] > t)
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps=400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the intercept is not penalised."""
    n = len(y)
    a = np.hstack([np.ones((n, 1)), a.astype(np.float64)])
    w, z, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
    size = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -50, 50)))
        step = z - size * (a.T @ (p - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - size * penalty, 0)
        new[0] = step[0]
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit_ensemble(x: np.ndarray, y: np.ndarray, *, rounds=25, depth=3, penalty=0.0008) -> RuleEnsemble:
    model = trees.fit(x, y, rounds=rounds, depth=depth, rate=0.3)
    if not len(model.roots):
        return RuleEnsemble(model.bias, [])
    paths = model.paths()
    a = rule_matrix(x, paths)
    # rules that hold on the same rows are one rule
    first: dict[bytes, int] = {}
    for k in range(a.shape[1]):
        if 0 < a[:, k].sum() < len(a):
            first.setdefault(np.packbits(a[:, k]).tobytes(), k)
    kept = sorted(first.values())
    bias, w = lasso_logistic(a[:, kept], y, penalty)
    return RuleEnsemble(bias, [(paths[k], float(c)) for k, c in zip(kept, w, strict=True) if abs(c) > 1e-6])


def _held_out():
    return fold_of("doc_id", HELD_OUT[0]) == HELD_OUT[1]


def quality_scores(docs: DataFrame, labels: DataFrame, *, sample_rows=20_000) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``; without labels nothing speaks against a document, and its score is 1."""
    stats = settled(text_stats(docs, "doc_id"), "op6-stats")
    x, y = labelled_sample(stats.where(~_held_out()), labels, "quality", sample_rows)
    scored = with_features(stats).withColumn("score", fit_ensemble(x, y).column() if len(y) else F.lit(1.0))
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, sample_rows=20_000) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns; all of them if no label is there to learn from, as ``quality_scores`` has it.

    Texts pass through once more unshuffled.
    """
    ids = labels.where(F.col("quality").isNotNull() & ~_held_out()).select("doc_id").distinct()
    ids = hashed_sample(ids, sample_rows, "doc_id")
    stats = text_stats(docs.where(~_held_out()).join(F.broadcast(ids), "doc_id", "left_semi"), "doc_id")
    x, y = labelled_sample(stats, labels, "quality", sample_rows)
    if not len(y):
        return docs
    # the statistics stand beside the columns of the caller, under names that cannot clash
    given = docs.select(F.struct("*").alias("__row"), text_or_empty().alias("text"))
    scored = with_features(text_stats(given, "__row")).withColumn("__score", fit_ensemble(x, y).column())
    return scored.where(F.col("__score") >= THRESHOLD).select("__row.*")
