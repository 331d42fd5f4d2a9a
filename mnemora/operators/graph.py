"""One hop along typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _hop(edges: DataFrame, rows: DataFrame, near: str, far: str, direction: str) -> DataFrame:
    e = edges.select(F.col(near).alias("anchor"), F.col(far).alias("id"), F.col("id").alias("relation_id"), "relation_type", "strength")
    return e.join(rows, "id").withColumn("direction", F.lit(direction))


def outgoing(edges: DataFrame, rows: DataFrame) -> DataFrame:
    return _hop(edges, rows, "source_id", "target_id", "Outgoing")


def incoming(edges: DataFrame, rows: DataFrame) -> DataFrame:
    return _hop(edges, rows, "target_id", "source_id", "Incoming")


def related(edges: DataFrame, rows: DataFrame, direction: str = "Both", relation_type: str | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """Neighbours with the edge that leads there; both directions are a bag union, outgoing first."""
    if relation_type is not None:
        edges = edges.where(F.col("relation_type") == relation_type)
    parts = []
    if direction in ("Outgoing", "Both"):
        own = edges if anchors is None else edges.join(anchors.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        parts.append(outgoing(own, rows))
    if direction in ("Incoming", "Both"):
        own = edges if anchors is None else edges.join(anchors.select(F.col("id").alias("target_id")), "target_id", "left_semi")
        parts.append(incoming(own, rows))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end among ids, each once."""
    out = edges.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    into = edges.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return out.unionByName(into).dropDuplicates(["id"])


def context_relations(edges: DataFrame, ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges with an end among ids whose two ends exist."""
    near = touching(edges, ids)
    for end in ("source_id", "target_id"):
        near = near.join(rows.select(F.col("id").alias(end)), end, "left_semi")
    return near


def duplicates(new: DataFrame, edges: DataFrame) -> DataFrame:
    return new.join(edges, ["source_id", "target_id", "relation_type"], "left_semi")


def with_collectives(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges with the collectives of both ends (null: no such row)."""
    s = rows.select(F.col("id").alias("source_id"), F.col("collective_id").alias("source_collective"))
    t = rows.select(F.col("id").alias("target_id"), F.col("collective_id").alias("target_collective"))
    return edges.join(s, "source_id", "left").join(t, "target_id", "left")


def cascade(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return touching(edges, gone).select("id").distinct()


def source_violations(insights: DataFrame, rows: DataFrame) -> DataFrame:
    """Sources of insights that don't exist or belong elsewhere."""
    s = insights.select(F.col("id").alias("insight_id"), "collective_id", F.explode("source_experience_ids").alias("source_id"))
    have = rows.select(F.col("id").alias("source_id"), F.col("collective_id").alias("of"))
    reason = F.when(F.col("of").isNull(), "missing").when(F.col("of") != F.col("collective_id"), "foreign")
    return s.join(have, "source_id", "left").withColumn("reason", reason).where(F.col("reason").isNotNull()).select("insight_id", "source_id", "reason")
