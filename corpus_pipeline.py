"""A training corpus from raw documents: quality, line dedup, near-dedup, mixing, encoding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over what its predecessor kept; all but the last return
the columns of ``docs``. ``run`` writes each stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, line_dedup, mixing, near_dedup, quality_classifier
from rasterloom.llm.common import settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null text is judged as the empty one; equal texts get equal verdicts; a score of exactly 0.7 is accepted; without labels
    all stay. Columns of any name beside those of documents stay, here and in the next three stages; an empty table gives no rows.
    """
    return quality_classifier.keep_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand elsewhere; every document stays, n_chars follows its text.

    A null text stays null, blank lines stay; of equal lines the first by doc_id (nulls last), text hash, line and row stays, so of repeated
    rows one keeps its lines and the others become empty.
    """
    return line_dedup.dedup_lines(docs, counts=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest doc_id, nulls last, then the first row.

    Texts without words, null ones among them, are copies of each other.
    """
    return near_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, up to three times, or not at all.

    Documents without words count nothing: they come as often as their source's whole copies. A null source is a source, the last one.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decoded_sha256 of each text in the mix; a null text is empty and has no ids."""
    coded = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("mixing", mix), ("bpe", encode)]

#: SQL expresses neither the fitted rules nor MinHash candidates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
