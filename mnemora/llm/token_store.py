"""Operator 2: token ids in Parquet list columns.

Texts are dealt by ranges of doc_id and sorted, encoded, and written with
dictionary or delta encoded id lists, bounded row groups and pages; Parquet's
page indexes let a reader skip to the rows and columns it wants.  `metadata`
reads no ids; `read_tokens` reads the ids of a range of documents.

Defined results: a null or empty text has the end id alone; equal doc_ids stand
in the order of their texts (null first); null doc_ids stand first; an empty
table gives an empty store; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mnemora.llm.library import encoder
from mnemora.llm.runtime import new_path, only, row_blocks
from mnemora.llm.words import with_end

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
ENCODINGS = {"dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)}, "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"}}


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 500, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents' ids, each list with the end id, in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(tokenizer)
        part, total = TaskContext.get().partitionId(), 0
        for rows, texts in row_blocks(batches):
            ids, sizes = with_end(*lib.encode_flat(texts), end_id)
            ends = np.cumsum(sizes)
            places = np.concatenate([[0], ends]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(places), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.full(len(sizes), part, np.int32)), pa.array(total + ends - sizes), pa.array(sizes), lists], names=["doc_id", "part", "local_start", "n_tokens", "ids"])
            total += int(ends[-1])

    ordered = only(docs, doc_id=id_col, text=text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    options = {"compression": "zstd", "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows)} | ENCODINGS[encoding]
    ordered.mapInArrow(run, SCHEMA).write.options(**options).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """part, base: the ids before each range of documents.  Reads two number columns and no ids."""
    sums = _stored(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents first to last; row groups and pages outside are skipped."""
    rows = _stored(spark, path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    # one row for each range of documents: as many as write tasks
    based = rows.join(F.broadcast(metadata(spark, path)), "part")
    return based.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from rows of read_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column("ids")
            places = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(places, places[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("start"), rows.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, T._parse_datatype_string("doc_id long, start long, n_tokens long, ids_crc32 long"))


def store_and_check(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_store(docs, path, tokenizer, end_id)
    return checksums(read_tokens(spark, path))
