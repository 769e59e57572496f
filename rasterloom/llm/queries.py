"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hmm, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, source_audit, spelling, token_counts, topk, url_filter
from .common import table

BPE_RANKS = "byte_bpe_50k.tiktoken"
BPE_JSON = "byte_bpe_50k.json"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, digests=True)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_lost", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = near_dedup.numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near_dedup.near_classes(docs).select("doc_id", "class_id", "kept", "n_rows")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.corpus_rollup(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(BPE_JSON))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_byte_bpe, op3_exact_topk, op4_line_dedup, op5_near_dedup, op6_quality_classifier, op7_quality_rules, op8_token_counts, op9_url_filter, op10_mixing, op11_source_divergence, op12_packing, op13_spelling_variants)}


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""

OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents
), by_source AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (WHERE size > 0) AS n FROM sized GROUP BY key),
ranked AS (SELECT *, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS BIGINT)] AS w FROM by_source),
level AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0) AS left_words, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_w
  FROM ranked WINDOW before AS (ORDER BY source_size / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (SELECT source_size / w AS r, key AS k, left_words, left_w FROM level WHERE w * left_words <= 3 * source_size * left_w ORDER BY r, k LIMIT 1),
plan AS (
  SELECT key, source_size, n, CASE WHEN k IS NULL OR (source_size / w, key) < (r, k) THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(w * water.left_words AS DOUBLE) / CAST(water.left_w AS DOUBLE) END AS target
  FROM level LEFT JOIN water ON true
), goal AS (
  SELECT *, CAST(least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + 1e-9), 3) AS BIGINT) AS whole FROM plan
), odds AS (
  SELECT *, greatest(target - whole * source_size, 0.0) AS rest,
    rest / greatest(source_size - rest, 1e-9) * n / greatest(source_size, 1) AS odds  -- of inclusion, for each word
  FROM goal
), ranked_docs AS (
  SELECT doc_id, key, size, source_size, target, whole, rest, (u / (1 - u)) / greatest(odds * size, 1e-300) AS q FROM sized JOIN odds USING (key)
), drawn AS (
  SELECT *, sum(size) OVER (PARTITION BY key ORDER BY q, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM ranked_docs
)
SELECT doc_id, size, source_size, target,
  CAST(least(whole + CASE WHEN size > 0 AND rest > 0 AND coalesce(upto, 0) + size / 2 <= rest THEN 1 ELSE 0 END, 3) * size AS BIGINT) AS taken
FROM drawn
"""


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), t AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(own.n, 0) AS n FROM grp g JOIN kept k USING (lang) LEFT JOIN own USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS p FROM cells WINDOW w AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS q FROM kept WINDOW w AS (PARTITION BY lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(k AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM rows) WHERE part = 'pair' OR k <= 200
"""

OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(i))
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
  ) GROUP BY ALL
), bytes AS (
  SELECT run, n, list_transform(string_split(regexp_replace(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '(..)', '\1 ', 'g'), ' '), lambda x: TRY_CAST('0x' || x AS BIGINT)) AS b
  FROM runs WHERE length(run) >= 6
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b[:-2]), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM words, range(1, length(word) + 1) r(i)),
near AS (
  SELECT a.word, b.word AS v, b.n AS vn FROM gone a JOIN gone b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.less = b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN gone b ON b.less = a.word
), forms AS (
  SELECT word, any_value(words.n) AS n, count(v) AS n_near, CASE WHEN max(vn) >= 5 * any_value(words.n) THEN max(vn) END AS form_n,
    CASE WHEN max(vn) >= 5 * any_value(words.n) THEN (list(v ORDER BY vn DESC, v))[1] END AS form
  FROM words LEFT JOIN near USING (word) GROUP BY word
), paths AS (
  SELECT word, word AS z FROM forms
  UNION ALL SELECT paths.word, f.form FROM paths JOIN forms f ON f.word = paths.z WHERE f.form IS NOT NULL
)
SELECT forms.word, form, z AS root, n, n_near, form_n FROM forms JOIN paths USING (word) JOIN (SELECT word AS last FROM forms WHERE form IS NULL) ON last = z
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": OP3_SQL, "op10_mixing": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_spelling_variants": OP13_SQL}
