"""Operator 6: token counts through a digest cache.

Each text has a digest of its normalised content (null is the empty text; no
other change, as any could change the count).  The cache is a Parquet table of
(tokenizer digest, content digest, count) in the shared folder.  Distinct digests
that it lacks are encoded once each and appended.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
each get their row; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.library import encoder
from mnemora.llm.runtime import BROADCAST_IDS, join_hot, new_path, only, row_blocks, written

CACHE = "version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's definition."""
    if path.endswith(".json"):
        with open(path) as f:
            raw = json.dumps(json.load(f), sort_keys=True).encode()
    else:
        with open(path, "rb") as f:
            raw = f.read()
    return hashlib.sha256(raw).hexdigest()


def _count(path: str, texts: list[str]) -> list[int]:
    if path.endswith(".json"):
        return encoder(path).encode_flat(texts)[1].tolist()
    return [len(x) for x in _pieces(path).encode(texts, num_threads=1)]


_models: dict[str, object] = {}


def _pieces(path: str):
    if path not in _models:
        from sentencepiece import SentencePieceProcessor

        _models[path] = SentencePieceProcessor(model_file=path)
    return _models[path]


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit.  cache: the cache's path; without one this call has its own."""
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-counts")
    version = tokenizer_version(tokenizer)
    texts_of = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = written(texts_of.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    total = rows.count()
    # copies meet before the shuffle
    asked = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "asked")

    def known() -> DataFrame | None:
        try:
            return spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version).select("digest", "n_tokens")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":  # no cache yet
                return None
            raise

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in row_blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(texts), pa.string()), part.column("digest"), pa.array(_count(tokenizer, texts), pa.int64())], names=["version", "digest", "n_tokens"])

    stored = known()
    # the join to stored counts takes digests alone; texts move only for misses
    missing = None if stored is None else written(asked.join(stored, "digest", "left_anti").select("digest"), "misses")
    if missing is None or not missing.isEmpty():
        if missing is not None and missing.count() <= BROADCAST_IDS:
            texts_of = texts_of.join(F.broadcast(missing), "digest", "left_semi")
        # first() has a partial form, so a text of a third of all rows is one row a task
        distinct = texts_of.groupBy("digest").agg(F.first("text").alias("text"))
        if missing is not None:
            distinct = distinct.join(missing, "digest", "left_semi")
        distinct.mapInArrow(run, CACHE).write.mode("append").parquet(cache)
    # two runs at once may both have added a digest; their counts are equal
    counts = written(asked.join(known().dropDuplicates(["digest"]), "digest"), "counts")
    return join_hot(rows, counts, "digest", "copies", total).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
