"""Bounded samples of labelled documents, for fitting only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.runtime import only, written


def crc_of(id_column: str):
    return F.crc32(F.col(id_column).cast("string"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: int, modulus: int, per_class: dict[int, int], keep_text: bool = True) -> DataFrame:
    """doc_id, text, label, weight of at most per_class[c] training documents of each class c, by the order of a hash.

    Training documents are those whose crc32 of doc_id as text leaves another
    remainder than held_out.  The bound is the sum of per_class rows; only their
    ids are broadcast.  A doc_id with several labels counts as the largest.
    A row's weight is the training labels of its class over those taken, so
    weighted rows have the shares that the classes have among all labels.
    """
    known = only(labels, doc_id="doc_id", label=label).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (crc_of("doc_id") % modulus != held_out))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.where(F.col("label").isin(*per_class)).groupBy("label").count().collect()}
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).withColumn("weight", F.lit(max(1.0, sizes.get(c, 0) / n))) for c, n in per_class.items()]
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.unionByName(p)
    texts = only(docs, doc_id="doc_id", text="text").join(F.broadcast(ids), "doc_id")
    return written(texts, "sample") if keep_text else texts
