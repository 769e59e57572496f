"""Token counts: rollups by source, language and tokenizer version, kept up by signed deltas.

A change batch holds rows (source, lang, version, sign, documents, tokens): an insert has sign +1, a delete -1, and
a revised count is the old row with -1 and the new one with +1. A batch is reduced to additive deltas
(documents, tokens) by key with map-side partial sums, so a hot source is summed before it moves, and
is written to ``deltas/batch=<id>`` of the ledger: first under a name of its own, then by one rename. A batch
whose folder exists is not applied again, whether the rerun comes from a retry or from a driver that died
between write and rename. Totals are the sums over all committed batches; ``compact`` folds them.

Counts: ``words-1`` counts runs of other than ASCII white space; ``bpe-50k`` counts the tokens of the public
byte-level BPE vocabulary. Defined cases: a null text has 0 tokens under either; null source or language is a
key of its own; repeated rows count each; an empty batch commits and changes nothing; a key whose documents and
tokens fall to 0 leaves the totals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, drop_path, scratch_path, settled, text_or_empty

KEYS = ("source", "lang", "version")
DELTA = "source string, lang string, version string, documents long, tokens long"


class Ledger:
    """The committed batches under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def batches(self) -> list[str]:
        fs, path = self._fs(f"{self.path}/deltas")
        return sorted(s.getPath().getName().removeprefix("batch=") for s in fs.listStatus(path)) if fs.exists(path) else []

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before."""
        if not re.fullmatch(r"[\w.-]+", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        fs, final = self._fs(f"{self.path}/deltas/batch={batch_id}")
        if fs.exists(final):
            return False
        own = scratch_path(self.spark, "op8-batch")
        deltas(changes).write.parquet(own)
        fs.mkdirs(final.getParent())
        moved = fs.rename(self._fs(own)[1], final)
        # a rename into a folder that a rival made meanwhile would nest: take it out again
        nested = self._fs(f"{self.path}/deltas/batch={batch_id}/{own.rpartition('/')[2]}")[1]
        if not moved or fs.exists(nested):
            fs.delete(nested, True)
            drop_path(self.spark, own)
            return False
        return True

    def totals(self) -> DataFrame:
        found = self.batches()
        if not found:
            return self.spark.createDataFrame([], DELTA)
        paths = [f"{self.path}/deltas/batch={b}" for b in found]
        rows = self.spark.read.schema(DELTA).parquet(*paths).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return rows.where((F.col("documents") != 0) | (F.col("tokens") != 0))

    def compact(self, into: Ledger, as_batch: str) -> bool:
        """Fold all batches into one of another ledger."""
        t = self.totals()
        return into.commit(as_batch, t.select(*KEYS, F.lit(1).alias("sign"), "documents", "tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum(F.col("sign") * F.col("documents")).cast("long").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).cast("long").alias("tokens"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


_encoders: dict = {}


def _encoder(path: str, pattern: str):
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


#: Longest text given to the tokenizer whole; longer ones are cut where the pattern splits in any case.
PIECE = 1 << 16


def pieces(text: str) -> Iterator[str]:
    """Cuts before a space that stands between two visible characters: the pattern always splits there."""
    at = 0
    while len(text) - at > PIECE:
        cut = re.compile(r"(?<=\S) (?=\S)").search(text, at + PIECE)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def counted(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, source, lang, words, bpe, text_key for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, pattern)
        for batch in batches:
            n = [sum(len(enc.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "bpe"])

    types = dict(docs.dtypes)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), word_count(text_or_empty()).alias("words"), F.sha2(text_or_empty(), 256).alias("text_key"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {types['doc_id']}, source string, lang string, words long, text_key string, bpe long")


def changes(rows: DataFrame, version: str, tokens: str, sign: int, documents: str = "n") -> DataFrame:
    """Signed rows for ``documents`` documents of ``tokens`` tokens each."""
    return rows.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).alias("sign"), F.col(documents).alias("documents"), (F.col(documents) * F.col(tokens)).alias("tokens"))


def corpus_rollup(docs: DataFrame, vocabulary: str, pattern: str, path: str | None = None) -> DataFrame:
    """The rollup after four batches over a whole corpus; every batch is sent twice and applied once.

    ``load`` inserts every document under words-1; ``count-bpe`` inserts all under bpe-50k; ``copies`` deletes, under
    both, each later copy of a text (all rows but the one with the smallest doc_id); ``blank`` revises what is left
    without words: its words-1 rows are withdrawn and its bpe-50k rows revised to 0 tokens.
    Returns source, lang, version, documents, tokens.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, path or scratch_path(spark, "op8-ledger"))
    rows = counted(docs, vocabulary, pattern)
    # one row for a text in a source and language: copies meet as partial counts, never as a group
    groups = settled(
        rows.groupBy("text_key", "source", "lang").agg(
            F.count("*").alias("n"), F.first("words").alias("words"), F.first("bpe").alias("bpe"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("id")
        ),
        "op8-groups",
    )
    place = F.struct("id", "source", "lang")
    lead = groups.groupBy("text_key").agg(F.min(place).alias("lead"))
    marked = groups.join(lead, "text_key").withColumn("one", place.eqNullSafe(F.col("lead")).cast("long")).withColumn("extra", F.col("n") - F.col("one")).withColumn("zero", F.lit(0).cast("long"))
    extra, blank = marked.where("extra > 0"), marked.where("one = 1 and words = 0")
    batches = {
        "load": changes(groups, "words-1", "words", 1),
        "count-bpe": changes(groups, "bpe-50k", "bpe", 1),
        "copies": changes(extra, "words-1", "words", -1, "extra").unionByName(changes(extra, "bpe-50k", "bpe", -1, "extra")),
        "blank": changes(blank, "words-1", "words", -1, "one").unionByName(changes(blank, "bpe-50k", "bpe", -1, "one")).unionByName(changes(blank, "bpe-50k", "zero", 1, "one")),
    }
    for _ in range(2):
        for name, rows_of in batches.items():
            ledger.commit(name, rows_of)
    return ledger.totals().select(*KEYS, "documents", "tokens")
