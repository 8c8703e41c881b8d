"""The digest queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langmodel, language, media, mixing, packing, quality, rans, simhash, substring, toxicity
from .common import documents, fold


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"), ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify(docs, language.fit(language.training_rows(docs)))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score_documents(documents(spark, sf_dir))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.store_media(documents(spark, sf_dir)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_digests(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encode_documents(documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, model)


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_simhash_near_dedup, op3_language_id, op4_lm_scoring, op5_media_columns, op6_mixing,
        op7_substring_dedup, op8_toxicity, op9_token_files, op10_quality_rules,
    )
}

_OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '') || '/mix-1'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
f AS (
  SELECT *, source_size / w AS lim,
    (3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER m, 0))::DOUBLE
    / (2 * (sum(w) OVER () - coalesce(sum(w) OVER m, 0)))::DOUBLE AS factor
  FROM w WINDOW m AS (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT min_by(factor, lim) FILTER (WHERE factor * w <= 2 * source_size) AS factor FROM f),
t AS (
  SELECT source, source_size, least(2 * source_size::DOUBLE, coalesce(c.factor * w, 2 * source_size::DOUBLE)) AS target FROM f, c),
r AS (
  SELECT d.doc_id, d.size, d.source, t.source_size, t.target, u,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS certain
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, target - certain * source_size AS rest,
    (sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM r)
SELECT doc_id, size, source_size, target,
  (certain + CASE WHEN rest > 0 AND (run < rest OR (run - size < rest AND run - size + run <= 2 * rest)) THEN 1 ELSE 0 END) * size AS taken
FROM k
"""

_OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
g AS (SELECT r, k, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT r, k, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
f AS (SELECT g, min(k) AS least FROM g GROUP BY g),
c AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM (SELECT r, i FROM g JOIN f USING (g) WHERE least < k)),
v AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
s AS (
  SELECT v.r, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY v.p) FILTER (WHERE c.p IS NULL) AS kept
  FROM v LEFT JOIN c ON v.r = c.r AND v.p = c.p GROUP BY v.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.r = s.r
"""

ORACLE_SQL = {"op6_mixing": _OP6_SQL, "op7_substring_dedup": _OP7_SQL}
