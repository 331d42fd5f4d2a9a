"""The change log as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators.filters import WatchFilter
from mnemora.schemas import LOG


def stream(spark: SparkSession, log_dir: str, collective_id: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    """Visible log rows as they are appended; back-pressure by files per trigger, no loss."""
    rows = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(log_dir).where("visible")
    return rows if collective_id is None else rows.where(F.col("collective_id") == collective_id)


def watch(spark: SparkSession, log_dir: str, collective_id: str | None, filter: WatchFilter) -> DataFrame:
    """Experience events with their row (none for deletions); the filter runs before any sink."""
    full = stream(spark, log_dir, collective_id).where("entity_type = 'Experience'").withColumnRenamed("experience", "row")
    inner = full.select("seq", "entity_id", "event_type", F.col("ts_ms").alias("event_ms"), "row", "row.*").drop("ts_ms")
    return inner.where((F.col("event_type") == "Deleted") | filter.column()).select("seq", "entity_id", "event_type", F.col("event_ms").alias("ts_ms"), "row")


def start(df: DataFrame, handle, checkpoint: str, once: bool = True):
    """A subscriber: `handle(batch, id)` for each batch; its checkpoint is its own cursor."""
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def drain(spark: SparkSession, events_path: str) -> DataFrame:
    """Streams a table of events to the end: event_type, n."""
    schema = spark.read.parquet(events_path).schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(events_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(path).isDirectory():
        events = reader.parquet(events_path)
    else:  # a stream reads folders
        events = reader.option("pathGlobFilter", path.getName()).parquet(str(path.getParent()))
    name = f"watch_{uuid.uuid4().hex}"
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    q = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
