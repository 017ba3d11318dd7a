"""The registered queries of the training-data operators, with production
parameters, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, jaccard_join, language_id, lm_score, merkle, mixing, pii_crf, quality_mil, sharding, substring_dedup, token_align
from .common import benchmark, documents, held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@register("op4_extendible_hash_dedup", r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
""")
def op4_extendible_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op5_source_mix", r"""
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source
), f AS (
  SELECT *, row_number() OVER w AS fill,
         (sum(source_size) OVER () - coalesce(sum(most) OVER p, 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::DOUBLE AS level
  FROM s WINDOW w AS (ORDER BY most::DOUBLE / weight, place),
                p AS (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (SELECT arg_min(level, fill) FROM f WHERE weight * level < most) AS water FROM f
), t AS (
  SELECT *, coalesce(least(most::DOUBLE, weight * water), most::DOUBLE) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0e0 END AS rate,
         ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':7:' || md5(coalesce(d.text, ''))), 1, 8))::BIGINT / 4294967296e0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
""")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mixing.repetitions(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return r.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                    F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


@register("op7_perspective_rotation", chat.CHAT_SQL)
def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))


@register("op8_stratified_interleave")
def op8_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(sharding.measured(documents(spark, sf_dir).select("doc_id", "text", "source")))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op9_superkmer_dedup")
def op9_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op1_stupid_backoff")
def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(documents(spark, sf_dir), order=lm_score.QUERY_ORDER)


@register("op10_ngram_jaccard_join")
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@register("op6_bm25_wand_decontamination")
def op6_bm25_wand_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), benchmark(spark, sf_dir))


@register("op3_nearest_centroid_language")
def op3_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.fit(language_id.training_rows(docs))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@register("op2_attention_mil_quality")
def op2_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = quality_mil.fit(docs, quality_mil.training_labels(labels))
    scored = quality_mil.score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages")


@register("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(documents(spark, sf_dir))


@register("op12_skip_chain_crf_pii")
def op12_skip_chain_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii_crf.find(docs, pii_crf.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


@register("op13_merkle_manifest", merkle.audit_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(documents(spark, sf_dir))
