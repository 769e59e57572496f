"""URL filters: host/path rules, then the ratio of two character language models.

The rules label URLs. Two variable-order Markov models, one of accepted and one of rejected URLs, are counted
over all labelled URLs of the training fold: character counts after each context of 0 to ``MAX_ORDER``
characters, interpolated by Witten-Bell weights, so that a long context is trusted as far as it was seen.
A URL without a rule is allowed if its log-likelihood difference, divided by its length, reaches a threshold
calibrated on the other fold of labelled URLs (least balanced error).

Counts are aggregated by Spark, and no context is dropped. Executors get those of the ``max_contexts`` contexts
of order 1 or more seen most often, of both kinds; URLs are cut into chunks, and the other contexts of a chunk's
URLs, each once a chunk, are joined with the full counts, so verdicts do not depend on ``max_contexts``.

Defined cases: a null URL, or one without "://", has empty host and path, no rule, and is blocked; without
labelled URLs of both kinds, the threshold is 0 and both models are uniform, so other URLs are allowed;
repeated rows get equal verdicts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, heaviest, settled

#: The rules as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MAX_ORDER = 5
ALPHABET = 256
START = "\x02"
HISTOGRAM = 400
#: Characters of the URLs of a chunk.
CHUNK = 40_000
FOLDS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict; the longest rule that fits wins."""
    df = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush():
        keys = list(counts)
        out = [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys]), pa.array([counts[k] for k in keys], pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(out, names=["kind", "context", "next", "n"])

    for batch in batches:
        for kind, s in zip(batch.column("kind").to_pylist(), batch.column("s").to_pylist(), strict=True):
            s = START + s
            for i in range(1, len(s)):
                for k in range(min(MAX_ORDER, i) + 1):
                    counts[kind, s[i - k : i], s[i]] += 1
            if len(counts) > 400_000:
                yield flush()
    yield flush()


def weighted(counts: dict[str, int]) -> tuple[int, int, dict[str, int]]:
    """What a context's counts weigh: (total with back-off weight, back-off weight, counts)."""
    return sum(counts.values()) + len(counts), len(counts), counts


class CharModel:
    """Witten-Bell interpolation over the contexts at hand; the empty context falls back on a uniform alphabet."""

    def __init__(self, rows: list[tuple[str, str, int]]) -> None:
        by: dict[str, dict[str, int]] = defaultdict(dict)
        for context, char, n in rows:
            by[context][char] = n
        self.at = {c: weighted(d) for c, d in by.items()}

    def probability(self, context: str, char: str, more: dict | None = None) -> float:
        """``more`` has contexts that the model itself does not hold."""
        p = 1.0 / ALPHABET
        for k in range(len(context) + 1):
            own = context[len(context) - k :]
            found = self.at.get(own) or (more.get(own) if more else None)
            if found is None:
                break
            total, kinds, counts = found
            p = (counts.get(char, 0) + kinds * p) / total
        return p

    def log_likelihood(self, s: str, more: dict | None = None) -> float:
        s = START + s
        return float(np.log([self.probability(s[max(0, i - MAX_ORDER) : i], s[i], more) for i in range(1, len(s))]).sum())


@dataclass
class Models:
    """The head contexts of both kinds, and kind, context, next, n of all others (None if there are none)."""

    allow: CharModel
    block: CharModel
    rest: DataFrame | None


def train(labelled: DataFrame, max_contexts: int) -> Models:
    """Both models from the columns kind (allow, block) and s."""
    grams = settled(
        labelled.select("kind", "s").mapInArrow(_grams, "kind string, context string, next string, n long").groupBy("kind", "context", "next").agg(F.sum("n").alias("n")),
        "op9-grams",
    )
    long = F.length("context") > 0
    seen = settled(grams.where(long).groupBy("context").agg(F.sum("n").alias("seen")), "op9-contexts")
    top = heaviest(seen, "seen", max_contexts).select("context")
    kept = grams.where(long).join(top, "context", "left_semi").unionByName(grams.where(~long).select("context", "kind", "next", "n"))
    rows = kept.select("kind", "context", "next", "n").toPandas()
    rest = settled(grams.where(long).join(top, "context", "left_anti"), "op9-rest") if seen.count() > max_contexts else None
    allow, block = (CharModel(list(rows.loc[rows["kind"] == k, ["context", "next", "n"]].itertuples(index=False, name=None))) for k in ("allow", "block"))
    return Models(allow, block, rest)


def ratio(df: DataFrame, models: Models) -> DataFrame:
    """Adds ratio: the difference of the log-likelihoods of column s, divided by its length (0 if empty)."""
    shared = df.sparkSession.sparkContext.broadcast((models.allow, models.block))
    types, names = dict(df.dtypes), df.columns
    given = ", ".join(f"`{c}` {types[c]}" for c in names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = shared.value
        for batch in batches:
            r = [(good.log_likelihood(s) - bad.log_likelihood(s)) / max(len(s), 1) for s in batch.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r, pa.float64())], names=[*batch.schema.names, "ratio"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the chunk, and with the first row of a chunk that needs it each context that is not at hand."""
        good, bad = shared.value
        chunk, size, asked = TaskContext.get().partitionId() << 32, 0, set()
        for batch in batches:
            own, needed = [], []
            for s in batch.column("s").to_pylist():
                if size >= CHUNK:
                    chunk, size, asked = chunk + 1, 0, set()
                size += len(s)
                s = START + s
                new = {s[i - k : i] for i in range(1, len(s)) for k in range(1, min(MAX_ORDER, i) + 1)} - asked
                new = {c for c in new if c not in good.at and c not in bad.at}
                asked |= new
                own.append(chunk)
                needed.append(list(new))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64()), pa.array(needed, pa.list_(pa.string()))], names=[*batch.schema.names, "__chunk", "__needed"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by chunk, its counts before its URLs; one chunk's counts at a time are in memory."""
        good, bad = shared.value
        at, counts, more = None, {}, None
        for batch in batches:
            urls = batch.column("url").filter(batch.column("url").is_valid())
            strings, r = iter(urls.field("s").to_pylist()), []
            for chunk, gram in zip(batch.column("chunk").to_pylist(), batch.column("gram").to_pylist(), strict=True):
                if chunk != at:
                    at, counts, more = chunk, {"allow": defaultdict(dict), "block": defaultdict(dict)}, None
                if gram is not None:
                    counts[gram["kind"]][gram["context"]][gram["next"]] = gram["n"]
                    continue
                if more is None:
                    more = {k: {c: weighted(d) for c, d in by.items()} for k, by in counts.items()}
                s = next(strings)
                r.append((good.log_likelihood(s, more["allow"]) - bad.log_likelihood(s, more["block"])) / max(len(s), 1))
            yield pa.RecordBatch.from_arrays([*urls.flatten(), pa.array(r, pa.float64())], names=[*names, "ratio"])

    if models.rest is None:
        return df.mapInArrow(whole, f"{given}, ratio double")
    dealt = settled(df.mapInArrow(chunks, f"{given}, __chunk long, __needed array<string>"), "op9-chunks")
    asked = dealt.select(F.col("__chunk").alias("chunk"), F.explode("__needed").alias("context"))
    found = asked.join(models.rest, "context").select("chunk", F.struct("kind", "context", "next", "n").alias("gram"))
    urls = dealt.select(F.col("__chunk").alias("chunk"), F.struct(*names).alias("url"))
    rows = found.unionByName(urls, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", F.col("url").isNotNull())
    return rows.select("chunk", "gram", "url").mapInArrow(joined, f"{given}, ratio double")


def calibrate(scored: DataFrame) -> float:
    """The threshold of least balanced error, from a histogram of ratios in [-8, 8)."""
    bin_ = F.least(F.greatest(F.floor((F.col("ratio") + 8) * (HISTOGRAM / 16)), F.lit(0)), F.lit(HISTOGRAM - 1)).cast("int")
    rows = scored.groupBy("kind", bin_.alias("b")).count().collect()  # at most 800 rows
    good, bad = np.zeros(HISTOGRAM), np.zeros(HISTOGRAM)
    for r in rows:
        (good if r["kind"] == "allow" else bad)[r["b"]] = r["count"]
    if not good.sum() or not bad.sum():
        return 0.0
    missed = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    passed = 1 - np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    best = np.flatnonzero((missed + passed) <= (missed + passed).min() + 1e-12)
    return float(best[len(best) // 2] * 16 / HISTOGRAM - 8)


def url_verdicts(pages: DataFrame, *, rules=RULES, max_contexts=150_000) -> DataFrame:
    """page_id, host, path, rule, verdict, ratio (null where a rule decided)."""
    df = settled(with_rule(pages.select("page_id", F.col("url").cast("string").alias("url")), rules), "op9-rules")
    df = df.withColumn("s", F.concat("host", "path")).withColumn("kind", F.col("rule_verdict"))
    held = fold_of("page_id", FOLDS) == 0
    labelled = df.where(F.col("kind").isNotNull())
    models = train(labelled.where(~held), max_contexts)
    threshold = calibrate(ratio(labelled.where(held).select("kind", "s"), models))
    out = ["page_id", "host", "path", "rule"]
    ruled = df.where(F.col("rule").isNotNull()).select(*out, F.col("rule_verdict").alias("verdict"), F.lit(None).cast("double").alias("ratio"))
    scored = ratio(df.where(F.col("rule").isNull()).select(*out, "s"), models)
    verdict = F.when((F.col("s") != "") & (F.col("ratio") >= threshold), "allow").otherwise("block")
    return ruled.unionByName(scored.select(*out, verdict.alias("verdict"), "ratio"))
