"""Search, weighted search, recent, cold and paged listings.

`mode="reference"` filters after a bounded candidate fetch, so a selective
filter can return fewer than k rows; `mode="exhaustive"` filters first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.errors import ValidationError
from mnemora.functions.scoring import DecayConfig, blend, energy, is_plain, resolve_weights
from mnemora.functions.vectors import similarity, top, top_per
from mnemora.operators.filters import SearchFilter
from mnemora.schemas import MAX_K

CAP = 2 * MAX_K


def check_k(k: int, name: str = "k") -> int:
    if not 1 <= k <= MAX_K:
        raise ValidationError("InvalidField", f"{name} must be from 1 to {MAX_K}")
    return k


def scored(rows: DataFrame, query: DataFrame) -> DataFrame:
    """Every row with its similarity to the one row of `query` (column q): one broadcast row, so no literals in the plan."""
    near = rows.crossJoin(F.broadcast(query.select("q").limit(1)))
    return near.withColumn("similarity", similarity(F.col("embedding"), F.col("q"))).drop("q")


def candidates(rows: DataFrame, query: DataFrame, m: int) -> DataFrame:
    return top(scored(rows, query), m, F.desc("similarity"), F.asc("id"))


def search_filtered(rows: DataFrame, query: DataFrame, k: int, filter: SearchFilter = SearchFilter(), mode: str = "reference") -> DataFrame:
    check_k(k)
    found = candidates(rows, query, min(2 * k, CAP)).where(filter.column()) if mode == "reference" else scored(rows.where(filter.column()), query)
    return top(found, k, F.desc("similarity"), F.asc("id"))


def row_energy(now_ms: int, config: DecayConfig) -> Column:
    return energy(F.col("importance"), F.col("n_applications"), F.col("last_reinforced_ms"), now_ms, config.half_life_s, config.freq_weight)


def search_weighted(rows: DataFrame, query: DataFrame, k: int, weights: tuple[float, float], now_ms: int, config: DecayConfig, filter: SearchFilter = SearchFilter(), mode: str = "reference") -> DataFrame:
    """Candidates by similarity, then by the blend with energy; ties keep candidate order.  `similarity` stays the cosine."""
    check_k(k)
    m = min(max(4 * k, k + 16), CAP)
    found = candidates(rows, query, m).where(filter.column()) if mode == "reference" else scored(rows.where(filter.column()), query)
    found = found.withColumn("energy", row_energy(now_ms, config))
    return top(found.withColumn("score", blend(F.col("similarity"), F.col("energy"), *weights)), k, F.desc("score"), F.desc("similarity"), F.asc("id"))


def search(rows: DataFrame, query: DataFrame, k: int = 10, filter: SearchFilter = SearchFilter(), weights: tuple[float, float] | None = None, config: DecayConfig = DecayConfig(), now_ms: int = 0, mode: str = "reference") -> DataFrame:
    w = resolve_weights(weights, config.weights)
    if is_plain(w):
        return search_filtered(rows, query, k, filter, mode)
    return search_weighted(rows, query, k, w, now_ms, config, filter, mode)


def recent(rows: DataFrame, limit: int, filter: SearchFilter = SearchFilter(), mode: str = "reference") -> DataFrame:
    check_k(limit, "limit")
    order = (F.desc("ts_ms"), F.desc("id"))
    found = top(rows, min(2 * limit, CAP), *order).where(filter.column()) if mode == "reference" else rows.where(filter.column())
    return top(found, limit, *order)


def cold(rows: DataFrame, below: float, limit: int, now_ms: int, config: DecayConfig) -> DataFrame:
    check_k(limit, "limit")
    if not 0 <= below <= 1:
        raise ValidationError("InvalidField", "below must be from 0 to 1")
    scored_rows = rows.where(~F.col("archived")).withColumn("energy", row_energy(now_ms, config)).where(F.col("energy") < below)
    return top(scored_rows, limit, F.asc("energy"), F.asc("ts_ms"), F.asc("id")).select("id", "energy")


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def insights_like(insights: DataFrame, query: DataFrame, k: int) -> DataFrame:
    check_k(k)
    return candidates(insights, query, k)


def batch_top(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top k for many queries by an equi-join on the collective."""
    pairs = rows.join(queries.select("query_id", "collective_id", F.col("embedding").alias("q")), "collective_id")
    return top_per(pairs.select("query_id", "id", similarity(F.col("embedding"), F.col("q")).alias("similarity")), ["query_id"], k, F.desc("similarity"), F.asc("id"))
