"""A training corpus in four stages: toxicity, quality, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import minmax, packing, quality_model, toxicity
from mnemora.llm.runtime import numbered, position, tokenizer_path, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity stays under 0.5; the lexicon is learned from the labelled rows of docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels), threshold=0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality reaches 0.3; the model is learned from the labelled rows of docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.reject(docs, quality_model.fit(docs, labels), threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more; of wholly repeated rows one stays."""
    found = written(minmax.near_duplicates(docs, size=5, percent=80), "near")
    key = ["doc_id", "text_hash"]
    gone = found.where(~F.col("kept")).select(key).distinct()
    again = written(found.where("kept").groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated")
    plain = numbered(docs)  # c0, c1, ...: names of the input clash with none here
    left = plain.select("*", F.col(f"c{position(docs, 'doc_id')}").alias("doc_id"), F.xxhash64(f"c{position(docs, 'text')}").alias("text_hash")).join(gone, key, "left_anti")
    if not again.isEmpty():
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        marks = again.toDF(*[f"_{k}" for k in key])
        once = left.join(marks, same, "left_semi").groupBy(key).agg(F.first(F.struct(*plain.columns)).alias("row")).select("row.*")
        left = left.join(marks, same, "left_anti").select(plain.columns).unionByName(once)
    return left.select(plain.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_copies), ("packing", pack)]
#: No stage but the rules of length is SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
