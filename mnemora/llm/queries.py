"""The operators' queries over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemora.llm import bpe, forest, langid, minmax, packing, quality_model, quality_rules, token_counts, token_store, toxicity
from mnemora.llm.runtime import Fn, new_path, tokenizer_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_check(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs, held_out=1, modulus=3), held_out=1, modulus=3)


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), held_out=0, modulus=5, threshold=0.5)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts twice on one cache: the second time all digests are stored, and the rows come from there."""
    docs, tokenizer, cache = table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), new_path(spark, "token-counts")
    token_counts.count_tokens(docs, tokenizer, cache)
    return token_counts.count_tokens(docs, tokenizer, cache, limit=1024)


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")), held_out=0, modulus=5, threshold=0.3)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op9_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Fn]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_token_store": op2_token_store,
        "op3_language_id": op3_language_id,
        "op4_near_vectors": op4_near_vectors,
        "op5_toxicity": op5_toxicity,
        "op6_token_counts": op6_token_counts,
        "op7_quality_model": op7_quality_model,
        "op8_quality_rules": op8_quality_rules,
        "op9_near_documents": op9_near_documents,
        "op10_packing": op10_packing,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_rules": quality_rules.sql(), "op4_near_vectors": forest_sql()}


def forest_sql() -> str:
    """All pairs of a label, and the smallest id reached."""
    return """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a AS n, a AS m FROM p UNION SELECT r.n, p.b FROM r JOIN p ON r.m = p.a),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n),
l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(l.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN l ON l.a = e.vec_id LEFT JOIN c ON c.n = e.vec_id"""
