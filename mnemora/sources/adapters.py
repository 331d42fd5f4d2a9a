"""The driver's tables as engine tables: deterministic projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions.vectors import mean_vector

T0 = 1704067200000
NOW = 1706745600000
HOUR, DAY = 3_600_000, 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiences without content and tags: `documents` isn't read."""
    i = F.col("id")
    ts = F.lit(T0) + i * HOUR
    a, b = (i % 4).cast("long"), (i % 3).cast("long")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("collective_id"), "embedding").select(
        "id", "collective_id", "embedding", (i % 9).alias("type_tag"), ((i * 37 % 101).cast("double") / 100).alias("importance"), ((i * 53 % 101).cast("double") / 100).alias("confidence"),
        (i % 11 == 0).alias("archived"), ts.alias("ts_ms"), (ts + i % 5 * DAY).alias("last_reinforced_ms"),
        F.create_map(F.lit("A"), a, F.lit("B"), b).alias("applications"), (a + b).alias("n_applications"),
    )


def experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.array("lang", "source").alias("tags"))
    return vectors(spark, sf_dir).join(d, "id", "left").withColumn("content", F.coalesce("text", F.lit(""))).withColumn("domain", F.coalesce("tags", F.array().cast("array<string>"))).drop("text", "tags")


def collectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("id")).distinct()
    return e.select("id", F.concat(F.lit("collective-"), F.col("id").cast("string")).alias("name"), (F.col("id") % 3).cast("string").alias("owner_id"), F.lit(64).alias("embedding_dimension"))


def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    return e.select(i.alias("id"), i.alias("source_id"), ((i * 7 + 3) % 500).alias("target_id"), (i % 6).alias("relation_type"), ((i % 101).cast("double") / 100).alias("strength")).where("source_id <> target_id")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges within a collective."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("label"))
    s = e.select(F.col("vec_id").alias("source_id"), F.col("label").alias("ls"))
    t = e.select(F.col("vec_id").alias("target_id"), F.col("label").alias("lt"))
    return all_edges(spark, sf_dir).join(s, "source_id").join(t, "target_id").where("ls = lt").select("id", "source_id", "target_id", "relation_type", "strength")


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each collective: its mean vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("collective_id"), "embedding", "vec_id")
    return mean_vector(e, ["collective_id"]).select(F.col("collective_id").alias("id"), "collective_id", "embedding")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("agent_id"), F.col("event_type").alias("collective_id")).agg(F.min(ms).alias("started_at_ms"), F.max(ms).alias("last_heartbeat_ms"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "Created").when(F.col("event_type").isin("click", "view"), "Updated").when(F.col("event_type") == "error", "Archived").otherwise("Deleted")
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (i + 1).alias("seq"), F.col("user_id").alias("entity_id"), (F.col("user_id") % 10).alias("collective_id"), kind.alias("event_type"),
        F.element_at(F.array(*map(F.lit, ["Experience", "Relation", "Insight", "Collective"])), (i % 4 + 1).cast("int")).alias("entity_type"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.when(i % 2 == 0, "A").otherwise("B").alias("origin"), "value",
    )


def replica_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    return log.groupBy(F.col("entity_id").alias("id"), F.col("origin").alias("instance")).agg(F.count(F.lit(1)).alias("n"), F.max("ts_ms").alias("last_ms"))


#: The same projections in DuckDB's SQL.
SQL = f"""
exp AS (SELECT e.vec_id AS id, e.label::BIGINT AS collective_id, coalesce(d.text, '') AS content, e.embedding::DOUBLE[] AS embedding,
  CASE WHEN d.doc_id IS NULL THEN []::VARCHAR[] ELSE [d.lang, d.source] END AS domain, e.vec_id % 9 AS type_tag,
  (e.vec_id * 37 % 101)::DOUBLE / 100 AS importance, (e.vec_id * 53 % 101)::DOUBLE / 100 AS confidence, e.vec_id % 11 = 0 AS archived,
  {T0} + e.vec_id * {HOUR} AS ts_ms, {T0} + e.vec_id * {HOUR} + e.vec_id % 5 * {DAY} AS last_reinforced_ms,
  e.vec_id % 4 AS app_a, e.vec_id % 3 AS app_b, e.vec_id % 4 + e.vec_id % 3 AS n_applications
  FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id),
coll AS (SELECT DISTINCT label::BIGINT AS id, 'collective-' || label AS name, (label % 3)::VARCHAR AS owner_id, 64 AS embedding_dimension FROM embeddings),
edges AS (SELECT vec_id AS id, vec_id AS source_id, (vec_id * 7 + 3) % 500 AS target_id, vec_id % 6 AS relation_type, (vec_id % 101)::DOUBLE / 100 AS strength FROM embeddings WHERE vec_id <> (vec_id * 7 + 3) % 500),
rel AS (SELECT g.* FROM edges g JOIN exp s ON s.id = source_id JOIN exp t ON t.id = target_id WHERE s.collective_id = t.collective_id),
parts AS (SELECT label::BIGINT AS collective_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT collective_id, pos, avg(x) AS x FROM parts GROUP BY ALL),
ins AS (SELECT collective_id AS id, collective_id, list(x ORDER BY pos) AS embedding FROM means GROUP BY collective_id),
act AS (SELECT user_id AS agent_id, event_type AS collective_id, min((epoch_us(ts) // 1000)) AS started_at_ms, max((epoch_us(ts) // 1000)) AS last_heartbeat_ms FROM events GROUP BY ALL),
log AS (SELECT event_id + 1 AS seq, user_id AS entity_id, user_id % 10 AS collective_id,
  CASE event_type WHEN 'signup' THEN 'Created' WHEN 'click' THEN 'Updated' WHEN 'view' THEN 'Updated' WHEN 'error' THEN 'Archived' ELSE 'Deleted' END AS event_type,
  ['Experience', 'Relation', 'Insight', 'Collective'][event_id % 4 + 1] AS entity_type, (epoch_us(ts) // 1000) AS ts_ms, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS origin, value FROM events),
cnt AS (SELECT entity_id AS id, origin AS instance, count(*) AS n, max(ts_ms) AS last_ms FROM log GROUP BY ALL),
q0 AS (SELECT embedding AS q, collective_id AS qc FROM exp WHERE id = 0),
sim AS (SELECT exp.*, list_cosine_similarity(embedding, q) AS similarity FROM exp, q0),
nrg AS (SELECT exp.*, least(greatest(importance * (1 + 0.3 * ln(1 + n_applications)) * exp(-ln(2) / 1209600.0 * (greatest({NOW} - last_reinforced_ms, 0) / 1000.0)), 0), 1) AS energy FROM exp)
"""
