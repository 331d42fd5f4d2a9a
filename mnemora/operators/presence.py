"""Agent presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active(activities: DataFrame, now: DataFrame, stale_seconds: float) -> DataFrame:
    """Activities with a heartbeat within the threshold before `now` (one row, now_ms), latest first."""
    near = activities.crossJoin(F.broadcast(now.select("now_ms").limit(1)))
    return near.where(F.col("last_heartbeat_ms") >= F.col("now_ms") - int(stale_seconds * 1000)).drop("now_ms").orderBy(F.desc("last_heartbeat_ms"), "agent_id", "collective_id")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Runs of an agent's events (agent_id, ts) with less than `gap` between neighbours."""
    s = events.groupBy("agent_id", F.session_window("ts", gap)).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("events"))
    return s.select("agent_id", F.unix_millis("a").alias("started_ms"), F.unix_millis("b").alias("ended_ms"), "events")
