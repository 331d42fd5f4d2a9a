"""Stores for queries that change something: one loaded from the driver's tables, and forks of it."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.schemas import RELATION_TYPES
from mnemora.sources import adapters as A
from mnemora.sources.files import Files
from mnemora.sources.store import Engine

_bases: dict[tuple[str, str], Engine] = {}
_roots: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only a local session without the setting gets one of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "/tmp/checkpoints"


def _new_root(spark: SparkSession) -> str:
    root = f"{shared_folder(spark)}/mnemora-stores/{uuid.uuid4().hex}"
    _roots.append((spark, root))
    return root


@atexit.register
def _drop_all() -> None:
    for spark, root in _roots:
        try:
            Files(spark, root).delete("")
        except Exception:  # noqa: BLE001  the session may be gone; the folder's owner cleans up then
            return


def text(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def relation_rows(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges as the engine holds them, in the collective of their source."""
    of = rows.select(F.col("id").alias("source_id"), text("collective_id"))
    kind = F.element_at(F.array(*map(F.lit, RELATION_TYPES)), (F.col("relation_type") + 1).cast("int")).alias("relation_type")
    return edges.join(of, "source_id").select(text("id"), text("source_id"), text("target_id"), kind, "strength", F.lit(A.T0).alias("created_at_ms"), "collective_id")


def base(spark: SparkSession, sf_dir: str) -> Engine:
    """A store with the projected tables, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _bases:
        engine = Engine(spark, _new_root(spark), dimension=64, instance_id="base", clock=lambda: A.NOW)
        exp = A.experiences(spark, sf_dir)
        engine.load("Collective", A.collectives(spark, sf_dir).select(text("id"), "name", "owner_id", "embedding_dimension"))
        engine.load("Experience", exp.withColumn("id", text("id")).withColumn("collective_id", text("collective_id")).withColumn("source_agent", F.lit("agent")).withColumn("related_files", F.array().cast("array<string>")))
        engine.load("Relation", relation_rows(A.relations(spark, sf_dir), A.vectors(spark, sf_dir)))
        engine.load("Insight", A.insights(spark, sf_dir).select(text("id"), text("collective_id"), "embedding"))
        acts = A.activities(spark, sf_dir)
        engine.load("Collective", acts.select(F.col("collective_id").alias("id"), F.col("collective_id").alias("name"), F.lit("events").alias("owner_id"), F.lit(64).alias("embedding_dimension")).distinct())
        engine.load("Activity", acts.select(text("agent_id"), "collective_id", "started_at_ms", "last_heartbeat_ms"))
        engine.merge()
        _bases[key] = engine
    return _bases[key]


def store(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """A fork of it to be changed."""
    return base(spark, sf_dir).fork(_new_root(spark), **options)
