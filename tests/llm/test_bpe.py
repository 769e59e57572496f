import hashlib

import public_tokenizers as P
import pytest

from rasterloom.llm import bpe
from rasterloom.llm.token_counts import _encoder, pieces

PATH = P.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "\n\n  x", "aaaaaaaaa", "a" * 3001 + " " + "ab" * 500, "日本語テキスト " * 20, "naïve café's 123 ***", "x" * 70_000 + " y", "😀🎉 don't", "\t\ta  b", "<|endoftext|>"]


@pytest.fixture(scope="module")
def reference():
    return _encoder(PATH, P.PATTERN)


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library_and_decode_back(reference, text):
    v = bpe.Vocabulary(PATH, P.PATTERN)
    (shown, ids), = v.encode([text])
    assert list(ids) == reference.encode_ordinary(text) and shown == " ".join(map(str, ids))
    assert v.decode([ids]) == [text.encode()]


def test_pieces_do_not_change_ids(reference):
    text = "word another  third\n" * 9000
    assert "".join(pieces(text)) == text
    assert [i for p in pieces(text) for i in reference.encode_ordinary(p)] == reference.encode_ordinary(text)


def test_documents(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (-1, "x"), (-1, "x")], docs.schema)
    rows = docs.unionByName(extra)
    got = bpe.encode_documents(rows, PATH, P.PATTERN, digests=True).collect()
    want = []
    for r in rows.collect():
        ids = reference.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    key = lambda t: (t[0] is None, t[0] or 0, t[1:])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got), key=key) == sorted(want, key=key)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "old")], "doc_id long, text string, ids string")
    r = bpe.encode_documents(docs, PATH, P.PATTERN).first()
    assert bytes(r["decoded"]) == b"a b" and len(r["ids"]) == 2
    assert bpe.encode_documents(docs.limit(0), PATH, P.PATTERN).count() == 0
