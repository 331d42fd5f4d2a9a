"""One call for what an agent should know: five lazy tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.functions.scoring import DecayConfig
from mnemora.operators import graph, recall
from mnemora.operators.filters import SearchFilter
from mnemora.operators.presence import active
from mnemora.schemas import STALE_SECONDS


@dataclass(frozen=True)
class ContextRequest:
    max_similar: int = 20
    max_recent: int = 10
    include_insights: bool = True
    include_relations: bool = True
    include_active_agents: bool = True
    filter: SearchFilter = SearchFilter()
    weights: tuple[float, float] | None = None


@dataclass
class ContextCandidates:
    similar: DataFrame
    recent: DataFrame
    insights: DataFrame | None
    relations: DataFrame | None
    active_agents: DataFrame | None

    def tagged(self) -> DataFrame:
        """section, id, score; an agent's id is its name."""
        none = F.lit(None).cast("double")
        parts = [self.similar.select(F.lit("similar").alias("section"), "id", F.col("similarity").alias("score")), self.recent.select(F.lit("recent").alias("section"), "id", none.alias("score"))]
        if self.insights is not None:
            parts.append(self.insights.select(F.lit("insight").alias("section"), "id", F.col("similarity").alias("score")))
        if self.relations is not None:
            parts.append(self.relations.select(F.lit("relation").alias("section"), "id", none.alias("score")))
        if self.active_agents is not None:
            parts.append(self.active_agents.select(F.lit("agent").alias("section"), F.col("agent_id").alias("id"), none.alias("score")))
        return reduce(DataFrame.unionByName, parts)


def candidates(request: ContextRequest, rows: DataFrame, query: DataFrame, insights: DataFrame | None, edges: DataFrame | None, activities: DataFrame | None, now_ms: int, config: DecayConfig, stale_seconds: float = STALE_SECONDS) -> ContextCandidates:
    recall.check_k(request.max_similar, "max_similar")
    recall.check_k(request.max_recent, "max_recent")
    similar = recall.search(rows, query, request.max_similar, request.filter, request.weights, config, now_ms)
    recent = recall.recent(rows, request.max_recent, request.filter)
    ids = similar.select("id").union(recent.select("id")).distinct()
    agents = None
    if request.include_active_agents and activities is not None:
        now = activities.sparkSession.range(1).select(F.lit(now_ms).alias("now_ms"))
        agents = active(activities, now, stale_seconds)
    return ContextCandidates(
        similar,
        recent,
        recall.insights_like(insights, query, request.max_similar) if request.include_insights and insights is not None else None,
        graph.context_relations(edges, ids, rows) if request.include_relations and edges is not None else None,
        agents,
    )
