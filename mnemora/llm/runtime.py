"""What the training-data operators share: the shared folder, written tables, text blocks."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that a Python worker handles at a time; longer texts go through in segments.
BLOCK_CHARS = 500_000
#: Bytes of rows that Spark hands to a Python worker at a time, unless the session says otherwise; a longer row goes alone.
BATCH_BYTES = 8 << 20
#: So many rows of a few numbers may be broadcast, once counted: by a join that would else shuffle keys, and by one that would else shuffle texts.
BROADCAST_ROWS, BROADCAST_IDS = 10_000, 500_000

_written: list[tuple[SparkSession, str]] = []


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it.

    Only a local session without the setting gets a folder of its own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints"


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/mnemora/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder's owner cleans up then
            return


def written(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of texts, which else hold 10,000 rows whatever their length; a setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # Spark's default
        spark.conf.set(key, str(BATCH_BYTES))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, renamed as the operator knows them.

    Other columns don't matter, not even those whose names differ in case alone: the
    name in its exact case is meant, or else the only one without regard to case.
    """
    small_batches(df.sparkSession)
    picked = [(position(df, source), name) for name, source in columns.items()]
    if len({c.lower() for c in df.columns}) < len(df.columns):  # names that clash can't be told apart by Spark's resolver
        return numbered(df).select(*[F.col(f"c{i}").alias(name) for i, name in picked])
    return df.select(*[F.col("`" + df.columns[i].replace("`", "``") + "`").alias(name) for i, name in picked])


def position(df: DataFrame, source: str) -> int:
    exact = [i for i, c in enumerate(df.columns) if c == source]
    near = exact or [i for i, c in enumerate(df.columns) if c.lower() == source.lower()]
    if len(near) != 1:
        raise ValueError(f"{source}: {len(near)} columns of that name")
    return near[0]


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1 and so on, which clash with nothing."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def keep_rows(docs: DataFrame, keep: Callable[[list[str]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose texts (null: empty) `keep` holds for; it gets blocks of texts."""
    small_batches(docs.sparkSession)
    plain, column = numbered(docs), f"c{position(docs, text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_blocks(batches, column):
            yield rows.filter(pa.array(keep(texts), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def give_back() -> None:
    """Returns what a reused worker still holds from earlier tasks to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def row_blocks(batches: Iterable[pa.RecordBatch], text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about `chars` bytes of text each, and their texts (null: empty)."""
    import numpy as np
    import pyarrow.compute as pc

    give_back()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + chars, "right")))
            part = batch.slice(at, to - at)
            yield part, [x or "" for x in part.column(text).to_pylist()]
            at = to


def join_hot(left: DataFrame, right: DataFrame, on: str | list[str], n: str, total: int) -> DataFrame:
    """left joined with the one row of right for its key (inner), where right.n bounds the left rows of a key and these make up `total`.

    Keys with over a thousandth of all rows, of which there are under a thousand,
    are broadcast, so that no key fills a task; all others are shuffled.  A right
    side of up to BROADCAST_ROWS counted rows is broadcast whole.  Both sides
    should be written tables: they are read twice.
    """
    on = [on] if isinstance(on, str) else on
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on)
    hot = right.where(F.col(n) * 1000 > total)
    rest = right.where(F.col(n) * 1000 <= total)
    return left.join(F.broadcast(hot), on).unionByName(left.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest, on))


Fn = Callable[[SparkSession, str], DataFrame]
