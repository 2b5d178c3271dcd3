"""Registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, html_diff, license_scan, line_dedup, media, mixing, order_minhash, quality, spelling, token_counts, topk, toxicity
from .common import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def graded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table tells two grades, 0 not toxic and 1 toxic; toxicity.fit() takes any number."""
    return read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic").isin(0, 1), F.col("toxic")).alias("grade"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "class_id", "n_links", "n_lines", "n_kept", "text")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_docs(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).drop("text")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract_pages(read(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read(spark, sf_dir, "documents"))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.transform("phrases", lambda x: x["label"])
    exact = F.when(F.size("phrases") > 0, 1.0).otherwise(0.0)
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(F.transform("phrases", lambda x: x["word"])).alias("first_word"), F.array_max(F.transform("phrases", lambda x: x["word"])).alias("last_word"),
        names(base).alias("base_labels"), names(F.concat(base, F.transform("spans", lambda x: x["label"]))).alias("labels"),
        F.greatest(exact, F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))).alias("score"), F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["label"], x["errors"])).cast("string").alias("spans"),
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.document_sizes(read(spark, sf_dir, "documents"))
    out = mixing.mix(sizes, mixing.source_targets(sizes))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, graded_labels(spark, sf_dir), 1))
    return scored.select("doc_id", "p_toxic", "severity", (F.col("p_toxic") >= toxicity.REJECT).cast("int").alias("toxic"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"), arrays=False)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    histogram = token_counts.length_histogram(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return token_counts.context_limits(histogram)


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("id % 20 = 0"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_byte_bpe, op3_html_extraction, op4_license_scan, op5_mixing, op6_toxicity, op7_media, op8_token_counts, op9_order_minhash, op10_topk, op11_divergence, op12_spelling_variants, op13_quality)
}

ORACLE_SQL = {
    "op5_mixing": r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        greatest(CASE WHEN length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) > 0 THEN
          1 - (length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) - length(regexp_replace(text, '[\x09-\x0D\x20-\x40\x5B-\x60\x7B-\x7E]', '', 'g')))
            / CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS DOUBLE) ELSE 0.0 END, 0.05) AS weight FROM t),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM r),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
      FROM c WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT coalesce((SELECT level FROM l WHERE level < ratio ORDER BY ratio, level LIMIT 1), (SELECT max(ratio) FROM l)) AS level),
g AS (SELECT source, source_size, least(cap, v.level * w) AS target FROM l, v),
k AS (SELECT d.*, g.source_size, g.target,
        -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text))), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / greatest(weight, 1e-6) AS key
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(size, greatest(floor(target - epochs * source_size) - before, 0)) AS BIGINT) AS taken FROM p""",
    "op10_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS size, count(*) OVER (PARTITION BY lang, source) AS terms, sum(total) OVER (PARTITION BY lang, source) AS all_size FROM f),
p AS (SELECT lang, source, term, n, CAST(1 + 1000000000::HUGEINT * (n + 5) // (size + 5 * terms) AS BIGINT) AS p, CAST(1 + 1000000000::HUGEINT * (total + 5) // (all_size + 5 * terms) AS BIGINT) AS q FROM s),
m AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(m.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50""",
}
