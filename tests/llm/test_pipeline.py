"""The pipeline's stages on the smallest tables: columns, whole inputs, decisions that take effect."""

from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import common, line_dedup, near_dedup, quality_classifier
from rasterloom.llm.token_counts import _encoder


@pytest.fixture(scope="module")
def results(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        done = common.settled(stage(spark, docs, sf), "stage")
        out.append((name, docs, done))
        docs = done
    return out


def test_stages_return_documents(results):
    assert [n for n, _, _ in results] == ["quality classifier", "line dedup", "near-dedup", "mixing", "bpe"]
    for _, before, after in results[:-1]:
        assert after.columns == before.columns and dict(after.dtypes) == dict(before.dtypes)


def test_quality_takes_effect_and_keeps_clean_documents(results, spark, sf):
    _, before, after = results[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    left = {r["doc_id"] for r in after.collect()}
    score = quality_classifier.quality_scores(before, labels).join(labels, "doc_id").toPandas()
    clean = score[score["quality"] == 1]["doc_id"]
    assert sum(i in left for i in clean) >= 0.97 * len(clean)
    poor = score[score["quality"] == 0]["doc_id"]
    assert sum(i in left for i in poor) <= 0.1 * len(poor)


def test_lines_and_documents(results):
    _, before, after = results[1]
    assert before.count() == after.count()
    seen = Counter(n for r in after.collect() for x in r["text"].split("\n") if (n := line_dedup.normal(x)))
    assert max(seen.values()) == 1
    assert after.where(F.col("n_chars") != F.length("text")).count() == 0
    _, before, after = results[2]
    texts = [r["text"] for r in after.collect()]
    prepared = [near_dedup.prepare(t, names) for names in [{}] for t in texts]
    assert not any(near_dedup.alike(prepared[i], prepared[j]) for i in range(len(texts)) for j in range(i))
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}


def test_mix_repeats_at_most_three_times(results):
    _, before, after = results[3]
    n = Counter(r["doc_id"] for r in after.collect())
    assert set(n) <= {r["doc_id"] for r in before.collect()} and max(n.values()) <= 3


def test_encoding_of_the_mix(results):
    _, before, after = results[4]
    enc = _encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    want = Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"]))) for r in before.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in after.collect()) == want


def test_run_equals_the_stages(spark, sf, results):
    assert corpus_pipeline.run(spark, sf).count() == results[4][2].count()


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(f"word{i % 997}" for i in range(40_000))
    rows = [
        (1, "a clean line of plain words here\nanother one", "en", "s1", 44), (1, "a clean line of plain words here\nanother one", "en", "s1", 44), (None, "no id at all in this row", None, None, None),
        (None, None, None, None, None), (2, "", "fr", "s2", 0), (3, " \n\t", "fr", None, 3), (4, long, "en", "s1", len(long)), (5, long + " end", "en", "s2", len(long) + 4),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: F.lit(i) for i, c in enumerate(["row", "ROW_", "size", "n_lost", "n_lines", "lost", "key", "u", "q", "cell", "copies", "taken", "score", "n_words", "id", "root"])}
    return docs.withColumns(clash)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_documents(spark, sf, empty):
    docs = odd_documents(spark)
    docs = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        out = common.settled(stage(spark, docs, sf), "odd")
        if name != "bpe":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        rows = out.collect()
        assert not empty or not rows
        if name == "line dedup" and not empty:
            assert len(rows) == 8 and sum("another one" in (r["text"] or "") for r in rows) == 1
        if name == "near-dedup" and not empty:
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 1), (False, 2), (False, 4), (True, 0)]
        if name == "bpe" and not empty:
            assert len(rows) == 8 and sum(r["n_tokens"] == 0 for r in rows) == 2


def test_quality_without_labels_keeps_all(spark, sf):
    docs = odd_documents(spark)
    labels = spark.read.parquet(f"{sf}/labels.parquet").limit(0)
    assert quality_classifier.keep_quality(docs, labels).count() == docs.count()
