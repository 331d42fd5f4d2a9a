"""One query for each operator over the projected tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import scoring as S
from mnemora.functions import vectors as V
from mnemora.operators import graph, log as L, recall as R, validation
from mnemora.operators.filters import SearchFilter, WatchFilter, fresh, one_of, overlap
from mnemora.schemas import EXPERIENCE as S_EXPERIENCE, EXPERIENCE_TYPES, LEGACY_BUCKET, U32_MAX
from mnemora.plans.scratch import relation_rows, store, text
from mnemora.sources import adapters as A

NOW, DAY = A.NOW, A.DAY
CONFIG = S.DecayConfig()
_made: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None, tables: bool = True):
    def keep(f: Callable) -> Callable:
        _made[f.__name__] = (f, sql and (f"WITH {A.SQL} {sql}" if tables else sql))
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _made.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _made.items() if s}


def _q0(exp: DataFrame) -> DataFrame:
    return exp.where("id = 0").select(F.col("embedding").alias("q"))


def _hits(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", F.round("similarity", 6).alias("similarity"), *more)


def r6(c) -> F.Column:
    return F.round(c, 6)


# search


def _search(name: str, k: int, where: str, flt: SearchFilter, mode: str = "reference") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        exp = (A.vectors if flt.domains is None else A.experiences)(spark, sf_dir)
        return _hits(R.search_filtered(exp, _q0(exp), k, flt, mode))

    run.__name__ = name
    source = f"(SELECT * FROM sim ORDER BY similarity DESC, id LIMIT {min(2 * k, 2000)})" if mode == "reference" else "sim"
    query(f"SELECT id, round(similarity, 6) AS similarity FROM {source} WHERE {where} ORDER BY similarity DESC, id LIMIT {k}")(run)


_search("search_similar_k20", 20, "NOT archived", SearchFilter())
_search("search_filtered_domain", 20, "NOT archived AND list_has_any(domain, ['en', 'src3'])", SearchFilter(domains=("en", "src3")))
_search("search_filtered_type", 20, "NOT archived AND type_tag IN (1, 4, 7)", SearchFilter(types=(1, 4, 7)))
_search("search_filtered_importance", 20, "NOT archived AND importance >= 0.5", SearchFilter(min_importance=0.5))
_search("search_filtered_confidence", 20, "NOT archived AND confidence >= 0.4", SearchFilter(min_confidence=0.4))
_search("search_filtered_since", 20, f"NOT archived AND ts_ms >= {A.T0 + 100 * A.HOUR}", SearchFilter(since_ms=A.T0 + 100 * A.HOUR))
_search("search_include_archived", 20, "true", SearchFilter(exclude_archived=False))
_search("search_overfetch_window", 10, "NOT archived AND importance >= 0.9", SearchFilter(min_importance=0.9))
_search("search_exhaustive", 10, "NOT archived AND importance >= 0.9", SearchFilter(min_importance=0.9), "exhaustive")
_search("search_similar_filtered_all", 50, f"NOT archived AND list_has_any(domain, ['en', 'de']) AND type_tag IN (0, 1, 2, 3, 4) AND importance >= 0.2 AND confidence >= 0.1 AND ts_ms >= {A.T0}", SearchFilter(("en", "de"), (0, 1, 2, 3, 4), 0.2, 0.1, A.T0))
_search("soft_delete_exclusion", 500, "NOT archived", SearchFilter(), "exhaustive")
_search("topk_distance_asc", 1000, "true", SearchFilter(exclude_archived=False))


def _weighted_sql(a: float, b: float, k: int) -> str:
    m = min(max(4 * k, k + 16), 2000)
    return f"""SELECT c.id, round(c.similarity, 6) AS similarity, round({a} * least(greatest(c.similarity, 0), 1) + {b} * n.energy, 6) AS score
      FROM (SELECT * FROM sim ORDER BY similarity DESC, id LIMIT {m}) c JOIN nrg n ON n.id = c.id WHERE NOT c.archived
      ORDER BY {a} * least(greatest(c.similarity, 0), 1) + {b} * n.energy DESC, c.similarity DESC, c.id LIMIT {k}"""


@query(_weighted_sql(0.7, 0.3, 10))
def search_weighted(spark, sf_dir):
    exp = A.vectors(spark, sf_dir)
    return _hits(R.search_weighted(exp, _q0(exp), 10, (0.7, 0.3), NOW, CONFIG).withColumn("score", r6("score")), "score")


@query(_weighted_sql(0.5, 0.5, 20))
def search_dispatch(spark, sf_dir):
    exp = A.vectors(spark, sf_dir)
    return _hits(R.search(exp, _q0(exp), 20, weights=(0.5, 0.5), config=CONFIG, now_ms=NOW).withColumn("score", r6("score")), "score")


@query("SELECT id, round(similarity, 6) AS similarity FROM (SELECT * FROM sim ORDER BY similarity DESC, id LIMIT 40) WHERE NOT archived ORDER BY similarity DESC, id LIMIT 20")
def search_beta_zero_equals_similar(spark, sf_dir):
    exp = A.vectors(spark, sf_dir)
    return _hits(R.search(exp, _q0(exp), 20, weights=(1.0, 0.0), config=CONFIG, now_ms=NOW))


@query("SELECT id, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY score DESC, similarity DESC, id) AS rank FROM (SELECT c.id, c.similarity, 0.2 * least(greatest(c.similarity, 0), 1) + 0.8 * round(n.energy, 1) AS score FROM (SELECT * FROM sim ORDER BY similarity DESC, id LIMIT 64) c JOIN nrg n ON n.id = c.id) ORDER BY rank LIMIT 16")
def rerank_tie_order(spark, sf_dir):
    exp = A.vectors(spark, sf_dir)
    c = R.candidates(exp, _q0(exp), 64).withColumn("score", S.blend(F.col("similarity"), F.round(R.row_energy(NOW, CONFIG), 1), 0.2, 0.8)).withColumn("all", F.lit(1))
    return _hits(V.top_per(c, ["all"], 16, F.desc("score"), F.desc("similarity"), F.asc("id")), F.col("rank").cast("long").alias("rank"))


@query("SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS similarity FROM exp a JOIN exp b ON a.collective_id = b.collective_id AND a.id < b.id")
def cosine_matrix(spark, sf_dir):
    return V.block_products(A.vectors(spark, sf_dir).select("id", "collective_id", "embedding")).select("a", "b", r6("similarity").alias("similarity"))


@query("SELECT id, round(similarity, 6) AS similarity, importance, archived FROM sim ORDER BY sim.similarity DESC, id LIMIT 100")
def scored_candidates(spark, sf_dir):
    exp = A.vectors(spark, sf_dir)
    return _hits(R.candidates(exp, _q0(exp), 100), "importance", "archived")


@query("SELECT c.id, content, round(c.similarity, 6) AS similarity FROM (SELECT id, similarity FROM sim ORDER BY similarity DESC, id LIMIT 30) c JOIN exp ON exp.id = c.id")
def hits_hydrated(spark, sf_dir):
    exp = A.experiences(spark, sf_dir)
    hits = R.candidates(exp.select("id", "embedding"), _q0(exp), 30).select("id", "similarity")  # ids first, wide columns after
    return hits.join(exp.select("id", "content"), "id").select("id", "content", r6("similarity").alias("similarity"))


@query("SELECT i.id, round(list_cosine_similarity(i.embedding, q), 6) AS similarity FROM ins i, q0 ORDER BY list_cosine_similarity(i.embedding, q) DESC, i.id LIMIT 5")
def insights_topk(spark, sf_dir):
    return _hits(R.insights_like(A.insights(spark, sf_dir), _q0(A.vectors(spark, sf_dir)), 5))


def _batch(exp: DataFrame) -> DataFrame:
    """The stated batch of query vectors: every id divisible by 20."""
    return exp.where("id % 20 = 0").select(F.col("id").alias("query_id"), "collective_id", "embedding")


def _batch_sql(k: int, more: str = "") -> str:
    return f"""SELECT query_id, id, round(similarity, 6) AS similarity, rank{more} FROM (SELECT a.id AS query_id, b.id, list_cosine_similarity(b.embedding, a.embedding) AS similarity,
      row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(b.embedding, a.embedding) DESC, b.id) AS rank FROM exp a JOIN exp b ON a.collective_id = b.collective_id WHERE a.id % 20 = 0) WHERE rank <= {k}"""


@query(_batch_sql(5))
def search_batch_stated(spark, sf_dir):
    exp = A.vectors(spark, sf_dir)
    return V.nearest(_batch(exp), exp, 5).select("query_id", "id", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(_batch_sql(10, ", (count(*) OVER (PARTITION BY query_id)) / 10.0::DOUBLE AS recall"))
def recall_neighbours(spark, sf_dir):
    """The neighbours found, and the share of those that the block path finds among them: the SQL computes the neighbours too."""
    exp = A.vectors(spark, sf_dir).select("id", "collective_id", "embedding")
    found = V.nearest(_batch(exp), exp, 10)
    share = V.recall_at(found, V.nearest(_batch(exp), exp, 10, blocks=True), "query_id", 10)
    return found.join(share, "query_id").select("query_id", "id", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"), "recall")


@query("SELECT quantile_disc(round(similarity, 6), 0.5) AS p50, quantile_disc(round(similarity, 6), 0.95) AS p95, quantile_disc(round(similarity, 6), 0.99) AS p99 FROM sim")
def percentiles(spark, sf_dir):
    exp = A.vectors(spark, sf_dir)
    s = R.scored(exp, _q0(exp)).select(r6("similarity").alias("s"))
    return s.agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY s)").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


# energy and weights


@query("SELECT id, round(energy, 6) AS energy FROM nrg")
def energy_all(spark, sf_dir):
    return A.vectors(spark, sf_dir).select("id", r6(R.row_energy(NOW, CONFIG)).alias("energy"))


@query("SELECT id, round(energy, 6) AS energy FROM nrg WHERE id = 42")
def energy_single(spark, sf_dir):
    return A.vectors(spark, sf_dir).where("id = 42").select("id", r6(R.row_energy(NOW, CONFIG)).alias("energy"))


def _configs(spark):
    return spark.createDataFrame([(1, 86400.0, 0.0), (2, 604800.0, 1.0), (3, 2592000.0, 0.5)], "collective_id long, half_life_s double, freq_weight double")


_CONFIG_SQL = "cfg AS (SELECT * FROM (VALUES (1, 86400.0, 0.0), (2, 604800.0, 1.0), (3, 2592000.0, 0.5)) v(collective_id, half_life_s, freq_weight))"


@query(f", {_CONFIG_SQL} SELECT e.id, round(least(greatest(importance * (1 + coalesce(freq_weight, 0.3)::DOUBLE * ln(1 + n_applications)) * exp(-ln(2) / coalesce(half_life_s, 1209600.0)::DOUBLE * (greatest({NOW} - last_reinforced_ms, 0) / 1000.0)), 0), 1), 6) AS energy FROM exp e LEFT JOIN cfg USING (collective_id)")
def energy_by_collective_config(spark, sf_dir):
    e = A.vectors(spark, sf_dir).join(F.broadcast(_configs(spark)), "collective_id", "left")
    half, freq = F.coalesce("half_life_s", F.lit(CONFIG.half_life_s)), F.coalesce("freq_weight", F.lit(CONFIG.freq_weight))
    return e.select("id", r6(S.energy(F.col("importance"), F.col("n_applications"), F.col("last_reinforced_ms"), NOW, half, freq)).alias("energy"))


@query(f", {_CONFIG_SQL} SELECT c.id AS collective_id, coalesce(half_life_s, 1209600.0)::DOUBLE AS half_life_s, coalesce(freq_weight, 0.3)::DOUBLE AS freq_weight FROM coll c LEFT JOIN cfg ON cfg.collective_id = c.id")
def decay_config_lookup(spark, sf_dir):
    c = A.collectives(spark, sf_dir).withColumnRenamed("id", "collective_id").join(F.broadcast(_configs(spark)), "collective_id", "left")
    return c.select("collective_id", F.coalesce("half_life_s", F.lit(CONFIG.half_life_s)).alias("half_life_s"), F.coalesce("freq_weight", F.lit(CONFIG.freq_weight)).alias("freq_weight"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 0.5 WHEN id % 2 = 0 THEN 0.7 END::DOUBLE AS w_similarity, CASE WHEN id % 3 = 0 THEN 0.5 WHEN id % 2 = 0 THEN 0.3 END::DOUBLE AS w_energy, id % 3 <> 0 AND id % 2 <> 0 AS plain FROM exp")
def weights_resolution(spark, sf_dir):
    i = F.col("id")
    req_a, req_b = F.when(i % 3 == 0, 0.5), F.when(i % 3 == 0, 0.5)
    def_a, def_b = F.when(i % 2 == 0, 0.7).otherwise(0.9), F.when(i % 2 == 0, 0.3).otherwise(0.9)
    ok = S.weights_valid(def_a, def_b)
    out = A.vectors(spark, sf_dir).select("id", F.coalesce(req_a, F.when(ok, def_a)).alias("w_similarity"), F.coalesce(req_b, F.when(ok, def_b)).alias("w_energy"))
    return out.withColumn("plain", F.coalesce(F.col("w_energy") == 0, F.lit(True)))


@query("SELECT id, least(greatest((id % 7 - 3)::DOUBLE / 2, 0), 1)::DOUBLE AS x FROM exp")
def clamp01(spark, sf_dir):
    return A.vectors(spark, sf_dir).select("id", S.clamp01((F.col("id") % 7 - 3).cast("double") / 2).alias("x"))


@query("SELECT n.id, round(0.6 * least(greatest(s.similarity, 0), 1) + 0.4 * n.energy, 6) AS score FROM nrg n JOIN sim s ON s.id = n.id")
def blend_score(spark, sf_dir):
    exp = A.vectors(spark, sf_dir)
    return R.scored(exp, _q0(exp)).select("id", r6(S.blend(F.col("similarity"), R.row_energy(NOW, CONFIG), 0.6, 0.4)).alias("score"))


@query("SELECT id, least(app_a + app_b, 4294967295)::BIGINT AS applications FROM exp")
def applications_total(spark, sf_dir):
    return A.vectors(spark, sf_dir).select("id", S.total_applications(F.col("applications")).alias("applications"))


@query("SELECT id, least(app_a * 4294967295 + app_b, 4294967295)::BIGINT AS n, greatest(ts_ms - last_reinforced_ms, 0)::BIGINT AS idle FROM exp")
def saturating_sum(spark, sf_dir):
    m = F.transform_values("applications", lambda k, v: F.when(k == "A", v * U32_MAX).otherwise(v))
    return A.vectors(spark, sf_dir).select("id", S.total_applications(m).alias("n"), F.greatest(F.col("ts_ms") - F.col("last_reinforced_ms"), F.lit(0).cast("long")).alias("idle"))


@query("SELECT i AS attempt, least(500.0 * pow(2, i - 1), 30000)::DOUBLE AS wait_ms FROM range(1, 11) t(i)", tables=False)
def backoff_schedule(spark, sf_dir):
    return spark.range(1, 11).select(F.col("id").alias("attempt"), S.backoff_ms(F.col("id")).alias("wait_ms"))


@query(f"SELECT id, round(energy, 6) AS energy FROM nrg WHERE NOT archived AND energy < 0.2 ORDER BY nrg.energy, ts_ms, id LIMIT 50")
def list_cold(spark, sf_dir):
    return R.cold(A.vectors(spark, sf_dir), 0.2, 50, NOW, CONFIG).select("id", r6("energy").alias("energy"))


@query("SELECT id FROM nrg WHERE NOT archived AND energy < 0.05")
def cold_filter(spark, sf_dir):
    return A.vectors(spark, sf_dir).where(~F.col("archived") & (R.row_energy(NOW, CONFIG) < 0.05)).select("id")


# listings, lookups


@query("SELECT id, ts_ms FROM (SELECT * FROM exp ORDER BY ts_ms DESC, id DESC LIMIT 40) WHERE NOT archived ORDER BY ts_ms DESC, id DESC LIMIT 20")
def recent(spark, sf_dir):
    return R.recent(A.vectors(spark, sf_dir), 20).select("id", "ts_ms")


@query("SELECT id, ts_ms FROM (SELECT * FROM exp WHERE collective_id = 3 ORDER BY ts_ms DESC, id DESC LIMIT 20) WHERE NOT archived AND importance >= 0.3 AND list_has_any(domain, ['en']) ORDER BY ts_ms DESC, id DESC LIMIT 10")
def recent_filtered(spark, sf_dir):
    return R.recent(A.experiences(spark, sf_dir).where("collective_id = 3"), 10, SearchFilter(domains=("en",), min_importance=0.3)).select("id", "ts_ms")


@query("SELECT id, ts_ms FROM exp WHERE collective_id = 2 ORDER BY ts_ms, id LIMIT 15 OFFSET 10")
def list_experiences_page(spark, sf_dir):
    return R.page(A.vectors(spark, sf_dir).where("collective_id = 2"), 15, 10, F.asc("ts_ms"), F.asc("id")).select("id", "ts_ms")


@query("SELECT rel.id, source_id, target_id FROM rel JOIN exp ON exp.id = source_id WHERE collective_id < 5 ORDER BY ts_ms, exp.id, rel.id LIMIT 10 OFFSET 5")
def list_relations_page(spark, sf_dir):
    s = A.vectors(spark, sf_dir).where("collective_id < 5").select(F.col("id").alias("source_id"), "ts_ms")
    return R.page(A.relations(spark, sf_dir).join(s, "source_id"), 10, 5, F.asc("ts_ms"), F.asc("source_id"), F.asc("id")).select("id", "source_id", "target_id")


@query("SELECT id, collective_id FROM ins ORDER BY id LIMIT 4 OFFSET 3")
def list_insights_page(spark, sf_dir):
    return R.page(A.insights(spark, sf_dir), 4, 3, F.asc("id")).select("id", "collective_id")


@query("SELECT id FROM exp ORDER BY id LIMIT 25 OFFSET 100")
def paginate(spark, sf_dir):
    return R.page(A.vectors(spark, sf_dir), 25, 100, F.asc("id")).select("id")


@query("SELECT id, content, importance FROM exp WHERE id = 17")
def point_lookup(spark, sf_dir):
    return A.experiences(spark, sf_dir).where("id = 17").select("id", "content", "importance")


@query("SELECT id, name, owner_id FROM coll WHERE id = 3")
def get_collective_by_id(spark, sf_dir):
    return A.collectives(spark, sf_dir).where("id = 3").select("id", "name", "owner_id")


@query("SELECT * FROM act WHERE agent_id = 7 AND collective_id = 'click'")
def get_activity(spark, sf_dir):
    return A.activities(spark, sf_dir).where("agent_id = 7 AND collective_id = 'click'")


@query("SELECT id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM exp WHERE id = 5")
def get_embedding(spark, sf_dir):
    return A.vectors(spark, sf_dir).where("id = 5").select("id", F.posexplode("embedding").alias("pos", "x")).select("id", F.col("x").cast("double").alias("x"), F.col("pos").cast("long").alias("pos"))


@query("SELECT id, name, owner_id FROM coll ORDER BY id")
def list_collectives(spark, sf_dir):
    return A.collectives(spark, sf_dir).orderBy("id").select("id", "name", "owner_id")


@query("SELECT id, name FROM coll WHERE owner_id = '1'")
def collectives_by_owner(spark, sf_dir):
    return A.collectives(spark, sf_dir).where(F.col("owner_id") == "1").select("id", "name")


@query("SELECT id, ts_ms FROM exp WHERE collective_id = 1 ORDER BY ts_ms, id")
def experience_ids_in_order(spark, sf_dir):
    return A.vectors(spark, sf_dir).where("collective_id = 1").orderBy("ts_ms", "id").select("id", "ts_ms")


@query("SELECT id FROM ins WHERE collective_id = 4 ORDER BY id")
def insight_ids_in_order(spark, sf_dir):
    return A.insights(spark, sf_dir).where("collective_id = 4").orderBy("id").select("id")


@query("SELECT id, target_id FROM edges WHERE source_id IN (1, 2, 3)")
def edges_by_source(spark, sf_dir):
    return A.all_edges(spark, sf_dir).where(F.col("source_id").isin(1, 2, 3)).select("id", "target_id")


@query("SELECT id, source_id FROM edges WHERE target_id IN (10, 17, 24)")
def edges_by_target(spark, sf_dir):
    return A.all_edges(spark, sf_dir).where(F.col("target_id").isin(10, 17, 24)).select("id", "source_id")


@query("SELECT agent_id, last_heartbeat_ms FROM act WHERE collective_id = 'view'")
def activities_of_collective(spark, sf_dir):
    return A.activities(spark, sf_dir).where("collective_id = 'view'").select("agent_id", "last_heartbeat_ms")


@query("SELECT collective_id, count(*) AS n FROM exp GROUP BY 1")
def count_per_collective(spark, sf_dir):
    return A.vectors(spark, sf_dir).groupBy("collective_id").agg(F.count(F.lit(1)).alias("n"))


_STATS = "SELECT collective_id, count(*) AS n, sum(octet_length(encode(content)))::BIGINT AS content_bytes, min(ts_ms) AS oldest_ms, max(ts_ms) AS newest_ms FROM exp GROUP BY 1"


@query(_STATS)
def collective_stats(spark, sf_dir):
    return A.experiences(spark, sf_dir).groupBy("collective_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).cast("long").alias("content_bytes"), F.min("ts_ms").alias("oldest_ms"), F.max("ts_ms").alias("newest_ms"))


@query("SELECT owner_id, count(DISTINCT c.id) AS collectives, count(exp.id) AS experiences FROM coll c LEFT JOIN exp ON exp.collective_id = c.id GROUP BY 1")
def stats_and_owner(spark, sf_dir):
    n = A.vectors(spark, sf_dir).groupBy(F.col("collective_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return A.collectives(spark, sf_dir).join(n, "id", "left").groupBy("owner_id").agg(F.count(F.lit(1)).alias("collectives"), F.sum(F.coalesce("n", F.lit(0))).alias("experiences"))


@query("SELECT id, len(embedding)::BIGINT AS dimension FROM exp")
def experience_with_embedding(spark, sf_dir):
    exp = A.vectors(spark, sf_dir)
    return exp.select("id").join(exp.select("id", "embedding"), "id", "left").select("id", F.size("embedding").cast("long").alias("dimension"))


@query("SELECT type_tag, ['" + "', '".join(EXPERIENCE_TYPES) + "'][type_tag + 1] AS type_name, count(*) AS n FROM exp GROUP BY 1, 2")
def type_tag_counts(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, EXPERIENCE_TYPES)), (F.col("type_tag") + 1).cast("int"))
    return A.vectors(spark, sf_dir).groupBy("type_tag", name.alias("type_name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id FROM exp WHERE list_has_any(domain, ['es', 'src1'])")
def tag_overlap(spark, sf_dir):
    return A.experiences(spark, sf_dir).where(overlap(F.col("domain"), ["es", "src1"])).select("id")


@query("SELECT id FROM exp WHERE archived = false")
def active_minus_deleted(spark, sf_dir):
    exp = A.vectors(spark, sf_dir)
    return exp.select("id").join(exp.where("archived").select("id"), "id", "left_anti")


@query("SELECT id FROM (SELECT id FROM sim ORDER BY similarity DESC, id LIMIT 20) UNION SELECT id FROM (SELECT id FROM exp ORDER BY ts_ms DESC, id DESC LIMIT 20)")
def union_ids(spark, sf_dir):
    exp = A.vectors(spark, sf_dir)
    return R.candidates(exp, _q0(exp), 20).select("id").union(exp.orderBy(F.desc("ts_ms"), F.desc("id")).limit(20).select("id")).distinct()


@query("SELECT id, name FROM coll UNION ALL SELECT 100 + id, 'new-' || id FROM coll WHERE id % 2 = 0")
def idempotent_insert(spark, sf_dir):
    c = A.collectives(spark, sf_dir).select("id", "name")
    new = c.where("id % 2 = 0").select((F.col("id") + 100).alias("id"), F.concat(F.lit("new-"), F.col("id").cast("string")).alias("name")).union(c)
    return L.insert_new(c, new)


@query("SELECT id, unnest(list_transform(embedding, lambda x: round(x / sqrt(list_sum(list_transform(embedding, lambda y: y * y))), 6))) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM exp")
def normalize_vectors(spark, sf_dir):
    return A.vectors(spark, sf_dir).select("id", F.posexplode(V.normalize(F.col("embedding"))).alias("pos", "x")).select("id", r6("x").alias("x"), F.col("pos").cast("long").alias("pos"))


@query("SELECT collective_id, pos - 1 AS pos, round(x, 6) AS x FROM means")
def mean_pool(spark, sf_dir):
    return A.insights(spark, sf_dir).select("collective_id", F.posexplode("embedding").alias("pos", "x")).select("collective_id", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


@query("SELECT event_id, (epoch_us(ts) // 1000) AS ms, epoch_us(make_timestamp(epoch_us(ts) // 1000 * 1000)) // 1000 = epoch_us(ts) // 1000 AS same FROM events", tables=False)
def timestamp_roundtrip(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return A.table(spark, sf_dir, "events").select("event_id", ms.alias("ms"), (F.unix_millis(F.timestamp_millis(ms)) == ms).alias("same"))


@query("SELECT doc_id, substring(sha256(text), 1, 16) AS digest FROM documents", tables=False)
def sha256_prefix(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("digest"))


@query(f"SELECT id, '{LEGACY_BUCKET}' AS instance, n_applications AS n, ts_ms AS last_reinforced_ms FROM exp")
def schema_v2_to_v3(spark, sf_dir):
    from mnemora.sources.store import upgrade_v2

    old = A.vectors(spark, sf_dir).select("id", F.col("n_applications").alias("applications"), "ts_ms")
    return upgrade_v2(old).select("id", F.explode("applications").alias("instance", "n"), "last_reinforced_ms")


# graph


def _edge_sql(near: str, far: str, direction: str, where: str = "") -> str:
    return f"SELECT {near} AS anchor, exp.id, rel.id AS relation_id, rel.relation_type, importance, '{direction}' AS direction FROM rel JOIN exp ON exp.id = {far} {where}"


def _related(spark, sf_dir, *args):
    return graph.related(A.relations(spark, sf_dir), A.vectors(spark, sf_dir), *args).select("anchor", "id", "relation_id", "relation_type", "importance", "direction")


@query(_edge_sql("source_id", "target_id", "Outgoing"))
def related_outgoing(spark, sf_dir):
    return _related(spark, sf_dir, "Outgoing")


@query(_edge_sql("target_id", "source_id", "Incoming"))
def related_incoming(spark, sf_dir):
    return _related(spark, sf_dir, "Incoming")


@query(_edge_sql("source_id", "target_id", "Outgoing") + " UNION ALL " + _edge_sql("target_id", "source_id", "Incoming"))
def related_both(spark, sf_dir):
    return _related(spark, sf_dir, "Both")


@query(_edge_sql("source_id", "target_id", "Outgoing", "WHERE relation_type = 2") + " UNION ALL " + _edge_sql("target_id", "source_id", "Incoming", "WHERE relation_type = 2"))
def related_typed(spark, sf_dir):
    return _related(spark, sf_dir, "Both", 2)


_NEAR = "near AS (SELECT id FROM (SELECT id FROM sim ORDER BY similarity DESC, id LIMIT 100) UNION SELECT id FROM (SELECT id FROM exp ORDER BY ts_ms DESC, id DESC LIMIT 100))"


@query(f", {_NEAR} SELECT DISTINCT r.id, source_id, target_id FROM edges r WHERE (source_id IN (SELECT id FROM near) OR target_id IN (SELECT id FROM near)) AND source_id IN (SELECT id FROM exp) AND target_id IN (SELECT id FROM exp)")
def context_relations(spark, sf_dir):
    exp = A.vectors(spark, sf_dir)
    ids = R.candidates(exp, _q0(exp), 100).select("id").union(exp.orderBy(F.desc("ts_ms"), F.desc("id")).limit(100).select("id")).distinct()
    return graph.context_relations(A.all_edges(spark, sf_dir), ids, exp).select("id", "source_id", "target_id")


@query("SELECT n.id FROM edges n WHERE EXISTS (SELECT 1 FROM rel r WHERE r.source_id = n.source_id AND r.target_id = n.target_id AND r.relation_type = n.relation_type)")
def duplicate_edges(spark, sf_dir):
    return graph.duplicates(A.all_edges(spark, sf_dir), A.relations(spark, sf_dir)).select("id")


@query("SELECT g.id, s.collective_id AS source_collective, t.collective_id AS target_collective FROM edges g LEFT JOIN exp s ON s.id = source_id LEFT JOIN exp t ON t.id = target_id WHERE s.collective_id <> t.collective_id")
def cross_collective_edges(spark, sf_dir):
    return graph.with_collectives(A.all_edges(spark, sf_dir), A.vectors(spark, sf_dir)).where("source_collective <> target_collective").select("id", "source_collective", "target_collective")


@query("SELECT rel.id, s.collective_id FROM rel JOIN exp s ON s.id = source_id")
def relation_collective(spark, sf_dir):
    return graph.with_collectives(A.relations(spark, sf_dir), A.vectors(spark, sf_dir)).select("id", F.col("source_collective").alias("collective_id"))


@query("SELECT DISTINCT g.id FROM edges g WHERE source_id % 11 = 0 OR target_id % 11 = 0")
def cascade_delete_set(spark, sf_dir):
    return graph.cascade(A.all_edges(spark, sf_dir), A.vectors(spark, sf_dir).where("archived").select("id"))


_LIVE = "(SELECT id FROM exp WHERE NOT archived)"


@query(f"SELECT DISTINCT id FROM (SELECT id FROM edges WHERE source_id IN {_LIVE} UNION ALL SELECT id FROM edges WHERE target_id IN {_LIVE})")
def distinct_relations_live(spark, sf_dir):
    return graph.touching(A.all_edges(spark, sf_dir), A.vectors(spark, sf_dir).where(~F.col("archived")).select("id")).select("id")


@query("SELECT i.id AS insight_id, s AS source_id, CASE WHEN e.id IS NULL THEN 'missing' ELSE 'foreign' END AS reason FROM (SELECT id, collective_id, unnest([id, id + 1, id + 1000000]) AS s FROM ins) i LEFT JOIN exp e ON e.id = s WHERE e.id IS NULL OR e.collective_id <> i.collective_id")
def insight_source_violations(spark, sf_dir):
    i = F.col("id")
    ins = A.insights(spark, sf_dir).withColumn("source_experience_ids", F.array(i, i + 1, i + 1_000_000))
    return graph.source_violations(ins, A.vectors(spark, sf_dir))


@query("SELECT s AS id FROM (SELECT id * 3 AS s FROM exp) WHERE s NOT IN (SELECT id FROM exp)")
def missing_reference_check(spark, sf_dir):
    exp = A.vectors(spark, sf_dir).select("id")
    return exp.select((F.col("id") * 3).alias("id")).join(exp, "id", "left_anti")


# presence

_LATEST_HB = "(SELECT max(last_heartbeat_ms) FROM act)"


@query(f"SELECT agent_id, collective_id, last_heartbeat_ms FROM act WHERE last_heartbeat_ms >= {_LATEST_HB} - {DAY} ORDER BY last_heartbeat_ms DESC, agent_id, collective_id")
def active_agents(spark, sf_dir):
    from mnemora.operators.presence import active

    act = A.activities(spark, sf_dir)
    return active(act, act.agg(F.max("last_heartbeat_ms").alias("now_ms")), 86_400).select("agent_id", "collective_id", "last_heartbeat_ms")


@query(f"SELECT agent_id, collective_id, last_heartbeat_ms >= {A.T0 + 20 * DAY} - 300000 AS fresh FROM act")
def staleness_filter(spark, sf_dir):
    return A.activities(spark, sf_dir).select("agent_id", "collective_id", fresh(F.lit(A.T0 + 20 * DAY), 300).alias("fresh"))


@query("SELECT user_id AS agent_id, event_type AS collective_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL", tables=False)
def agent_latest(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("agent_id"), F.col("event_type").alias("collective_id"), "event_id", "value", F.col("event_id").alias("o"))
    return L.latest(e, ["agent_id", "collective_id"], "o").drop("o")


@query("SELECT agent_id, min(ts) AS started_ms, max(ts) AS ended_ms, count(*) AS events FROM (SELECT user_id AS agent_id, (epoch_us(ts) // 1000) AS ts, sum(CASE WHEN gap IS NULL OR gap >= 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY agent_id, s", tables=False)
def presence_sessions(spark, sf_dir):
    from mnemora.operators.presence import sessions

    e = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("agent_id"), F.col("ts").cast("timestamp").alias("ts"))
    return sessions(e, "6 hours")


# log and replication


@query("SELECT seq, entity_id, event_type FROM (SELECT * FROM log WHERE seq > 500 ORDER BY seq LIMIT 1000) WHERE entity_type = 'Experience'")
def poll_changes(spark, sf_dir):
    return L.poll(A.change_log(spark, sf_dir), 500).select("seq", "entity_id", "event_type")


@query("SELECT seq, entity_id, event_type FROM (SELECT * FROM log WHERE seq > 100 ORDER BY seq LIMIT 50) WHERE entity_type = 'Experience'")
def poll_changes_batch(spark, sf_dir):
    return L.poll(A.change_log(spark, sf_dir), 100, 50).select("seq", "entity_id", "event_type")


@query("SELECT seq, entity_id, entity_type, event_type FROM log WHERE seq > 200 ORDER BY seq LIMIT 300")
def poll_sync_events(spark, sf_dir):
    return L.scan(A.change_log(spark, sf_dir), 200, 300).select("seq", "entity_id", "entity_type", "event_type")


@query("SELECT seq, entity_id FROM log WHERE seq > 50 ORDER BY seq LIMIT 25")
def log_range_scan(spark, sf_dir):
    return L.scan(A.change_log(spark, sf_dir), 50, 25).select("seq", "entity_id")


@query("SELECT count(*) AS n FROM (SELECT * FROM log WHERE seq > 0 ORDER BY seq LIMIT 400) WHERE entity_type = 'Experience'")
def poll_filter_after_limit(spark, sf_dir):
    return L.poll(A.change_log(spark, sf_dir), 0, 400).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT seq, row_number() OVER (ORDER BY seq) AS place FROM log ORDER BY seq")
def log_order_whole(spark, sf_dir):
    return L.numbered(A.change_log(spark, sf_dir)).select("seq", "place")


@query("SELECT entity_id, arg_max(event_type, seq) AS event_type, max(seq) AS seq FROM log GROUP BY 1 HAVING arg_max(event_type, seq) <> 'Deleted'")
def current_state(spark, sf_dir):
    return L.current(A.change_log(spark, sf_dir).withColumn("o", F.col("seq")), ["entity_id"], "o").select("entity_id", "event_type", "seq")


@query("SELECT max(seq) AS seq FROM log")
def current_sequence(spark, sf_dir):
    return A.change_log(spark, sf_dir).agg(F.max("seq").alias("seq"))


def _cursors(spark):
    return spark.createDataFrame([("p1", "push", 700), ("p2", "push", 450), ("p3", "push", 900)], "peer_id string, direction string, last_sequence long")


@query("SELECT 450::BIGINT AS low", tables=False)
def min_cursor(spark, sf_dir):
    return _cursors(spark).agg(F.min("last_sequence").alias("low"))


@query("SELECT seq FROM log WHERE seq > 450")
def compact_min_cursor(spark, sf_dir):
    return L.compact(A.change_log(spark, sf_dir), _cursors(spark)).select("seq")


@query("SELECT max(seq) AS ack FROM (SELECT seq FROM log WHERE seq > 300 ORDER BY seq LIMIT 100)")
def push_ack_max_seq(spark, sf_dir):
    return L.scan(A.change_log(spark, sf_dir), 300, 100).agg(F.max("seq").alias("ack"))


@query("SELECT seq, entity_type FROM log WHERE collective_id IN (1, 3, 5) AND entity_type <> 'Insight'")
def sync_allowlist(spark, sf_dir):
    return A.change_log(spark, sf_dir).where(one_of(F.col("collective_id"), [1, 3, 5]) & (F.col("entity_type") != "Insight")).select("seq", "entity_type")


@query("SELECT seq, entity_id FROM log WHERE origin = 'A'")
def echo_filter(spark, sf_dir):
    return A.change_log(spark, sf_dir).where(F.col("origin") == "A").select("seq", "entity_id")


@query("SELECT seq, entity_id, event_type, importance FROM log LEFT JOIN exp ON exp.id = entity_id AND NOT archived WHERE exp.id IS NOT NULL OR event_type IN ('Archived', 'Deleted')")
def push_hydrated(spark, sf_dir):
    rows = A.vectors(spark, sf_dir).where(~F.col("archived")).select(F.col("id").alias("entity_id"), "importance", F.lit(True).alias("found"))
    return L.hydrate(A.change_log(spark, sf_dir), rows).select("seq", "entity_id", "event_type", "importance")


@query("SELECT seq, entity_id, importance FROM (SELECT * FROM log WHERE seq > 100 ORDER BY seq LIMIT 200) l JOIN exp ON exp.id = entity_id WHERE l.collective_id IN (2, 4)")
def pull_page(spark, sf_dir):
    page = L.scan(A.change_log(spark, sf_dir), 100, 200).where(F.col("collective_id").isin(2, 4))
    rows = A.vectors(spark, sf_dir).select(F.col("id").alias("entity_id"), "importance", F.lit(True).alias("found"))
    return L.hydrate(page, rows).where("found").select("seq", "entity_id", "importance")


@query("SELECT id, instance, max(n) AS n FROM (SELECT id, instance, n FROM cnt UNION ALL SELECT id, instance, n + id % 3 - 1 FROM cnt) GROUP BY 1, 2")
def gcounter_merge(spark, sf_dir):
    c = A.replica_counts(spark, sf_dir).select("id", "instance", "n")
    both = c.unionByName(c.withColumn("n", F.col("n") + F.col("id") % 3 - 1))
    return L.gcounter(both, "id").select("id", F.explode("applications").alias("instance", "n"))


@query("SELECT id, max(last_ms) AS last_reinforced_ms FROM cnt GROUP BY 1")
def last_reinforced_merge(spark, sf_dir):
    return A.replica_counts(spark, sf_dir).groupBy("id").agg(F.max("last_ms").alias("last_reinforced_ms"))


def _two_replicas(spark, sf_dir):
    exp = A.vectors(spark, sf_dir).select("id", "applications", "last_reinforced_ms")
    mine = exp.where("id % 3 <> 0")
    theirs = exp.where("id % 2 = 0").select("id", F.create_map(F.lit("A"), F.col("id") % 5, F.lit("C"), F.col("id") % 2 + 1).alias("applications"), (F.col("last_reinforced_ms") + F.col("id") % 7 - 3).alias("last_reinforced_ms"))
    return mine, theirs


_REPLICAS = "mine AS (SELECT * FROM exp WHERE id % 3 <> 0), theirs AS (SELECT id, id % 5 AS a, id % 2 + 1 AS c, last_reinforced_ms + id % 7 - 3 AS t FROM exp WHERE id % 2 = 0), met AS (SELECT coalesce(m.id, h.id) AS id, m.id AS mid, h.id AS hid, greatest(coalesce(app_a, 0), coalesce(a, 0)) AS a, app_b AS b, c, greatest(m.last_reinforced_ms, h.t) AS t FROM mine m FULL JOIN theirs h ON m.id = h.id)"


@query(f", {_REPLICAS} SELECT id, a AS n_a, coalesce(b, 0) AS n_b, coalesce(c, 0) AS n_c, t AS last_reinforced_ms, CASE WHEN mid IS NULL THEN 'inserted' WHEN hid IS NULL THEN 'kept' ELSE 'merged' END AS outcome FROM met")
def apply_created(spark, sf_dir):
    got = L.merge_state(*_two_replicas(spark, sf_dir))
    n = lambda k: F.coalesce(F.try_element_at("applications", F.lit(k)), F.lit(0).cast("long")).alias(f"n_{k.lower()}")
    return got.select("id", n("A"), n("B"), n("C"), "last_reinforced_ms", "outcome")


@query(f", {_REPLICAS} SELECT CASE WHEN mid IS NULL THEN 'inserted' WHEN hid IS NULL THEN 'kept' ELSE 'merged' END AS outcome, count(*) AS n FROM met GROUP BY 1")
def apply_outcomes(spark, sf_dir):
    return L.merge_state(*_two_replicas(spark, sf_dir)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _update_sql(cond: str) -> str:
    return f"SELECT id, CASE WHEN id % 4 = 0 AND {cond} THEN 0.25 ELSE importance END AS importance, CASE WHEN id % 2 = 0 AND {cond} THEN 0.75 ELSE confidence END AS confidence FROM exp"


def _rows(exp: DataFrame) -> DataFrame:
    """Projected experiences as the engine holds them."""
    have = set(exp.columns)
    kinds = {c.split()[0]: c.split()[1] for c in S_EXPERIENCE.split(", ")}
    return exp.select(*[(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _events(rows: DataFrame, kind, ts_ms=None) -> DataFrame:
    """A peer's events with these rows."""
    body = [c.split()[0] for c in S_EXPERIENCE.split(", ")]
    return rows.select(F.lit(1).cast("long").alias("seq"), kind.alias("event_type"), F.col("id").alias("entity_id"), "collective_id", (F.col("ts_ms") if ts_ms is None else ts_ms).alias("ts_ms"), F.lit("peer").alias("origin"), F.struct(*body).alias("experience"))


def _applied(spark, sf_dir, last_write_wins: bool) -> DataFrame:
    own = _rows(A.vectors(spark, sf_dir))
    i = F.col("id").cast("long")
    patch = own.where(i % 2 == 0).withColumn("importance", F.when(i % 4 == 0, 0.25).otherwise(F.col("importance"))).withColumn("confidence", F.lit(0.75))
    got = L.fold_experiences(own, _events(patch, F.lit("Updated"), F.col("ts_ms") + i % 5 - 2), last_write_wins)
    new = got.where("outcome = 'updated'").select("id", "row.importance", "row.confidence")
    return L.without(own, new).select("id", "importance", "confidence").unionByName(new).select(F.col("id").cast("long").alias("id"), "importance", "confidence")


@query(_update_sql("true"))
def apply_server_wins(spark, sf_dir):
    return _applied(spark, sf_dir, False)


@query(_update_sql("id % 5 >= 2"))
def apply_lww(spark, sf_dir):
    return _applied(spark, sf_dir, True)


@query("SELECT id, archived OR id % 4 = 0 AS archived FROM exp WHERE id % 6 <> 1")
def apply_archived_deleted(spark, sf_dir):
    """Archivings of ids that are twice another's, some of which aren't there, and deletions."""
    own = _rows(A.vectors(spark, sf_dir))
    i = F.col("id").cast("long")
    put = own.where(i % 2 == 0).withColumn("id", (i * 2).cast("string")).withColumn("archived", F.lit(True))
    page = _events(put, F.lit("Archived")).unionByName(_events(own.where(i % 6 == 1), F.lit("Deleted")))
    got = L.fold_experiences(own, page, False)
    new = got.where("outcome = 'updated'").select("id", "row.archived")
    left = L.without(own, got.where("outcome IN ('updated', 'deleted')").select("id")).select("id", "archived")
    return left.unionByName(new).select(F.col("id").cast("long").alias("id"), "archived")


@query("SELECT id, source_id FROM rel UNION SELECT id, source_id FROM edges WHERE id % 2 = 0")
def apply_relation_idempotent(spark, sf_dir):
    own = A.relations(spark, sf_dir).select("id", "source_id")
    new = A.all_edges(spark, sf_dir).where("id % 2 = 0").select("id", "source_id")
    page = new.select(F.lit(1).alias("seq"), F.lit("Created").alias("event_type"), F.col("id").alias("entity_id"), F.lit("c").alias("collective_id"), F.lit("peer").alias("origin"), F.struct("id", "source_id").alias("relation"))
    return own.unionByName(L.fold_others(own, page, "relation").where("outcome = 'inserted'").select("row.id", "row.source_id"))


@query("SELECT id FROM exp WHERE importance >= 0.6 AND list_has_any(domain, ['en', 'fr']) AND type_tag IN (0, 2, 4, 6, 8)")
def watch_filter(spark, sf_dir):
    return A.experiences(spark, sf_dir).where(WatchFilter(("en", "fr"), (0, 2, 4, 6, 8), 0.6).column()).select("id")


# validation and composite


@query("""SELECT id, violations FROM (SELECT id, list_filter([CASE WHEN content = '' THEN 'content_empty' END, CASE WHEN octet_length(encode(content)) > 102400 THEN 'content_too_large' END,
  CASE WHEN imp < 0 OR imp > 1 THEN 'importance_range' END, CASE WHEN id % 10 = 0 THEN 'dimension_mismatch' END, CASE WHEN id % 13 = 0 THEN 'agent_empty' END], lambda x: x IS NOT NULL) AS v,
  array_to_string(v, ',') AS violations FROM (SELECT *, importance * 1.25 AS imp FROM exp)) WHERE len(v) > 0""")
def validation_violations(spark, sf_dir):
    i = F.col("id")
    exp = A.experiences(spark, sf_dir).withColumn("importance", F.col("importance") * 1.25).withColumn("related_files", F.array().cast("array<string>")).withColumn("source_agent", F.when(i % 13 == 0, "").otherwise("agent"))
    exp = exp.withColumn("embedding", F.when(i % 10 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")))
    _, bad = validation.split(exp, validation.experience_rules(64))
    return bad.select("id", F.array_join("violations", ",").alias("violations"))


@query(f""", near AS (SELECT id, similarity FROM (SELECT * FROM sim WHERE collective_id = (SELECT qc FROM q0) ORDER BY similarity DESC, id LIMIT 40) WHERE NOT archived ORDER BY similarity DESC, id LIMIT 20),
rec AS (SELECT id FROM (SELECT * FROM exp WHERE collective_id = (SELECT qc FROM q0) ORDER BY ts_ms DESC, id DESC LIMIT 20) WHERE NOT archived ORDER BY ts_ms DESC, id DESC LIMIT 10)
SELECT 'similar' AS section, id, round(similarity, 6) AS score FROM near UNION ALL SELECT 'recent', id, NULL FROM rec
UNION ALL SELECT 'insight', id, round(s, 6) FROM (SELECT i.id, list_cosine_similarity(i.embedding, q) AS s FROM ins i, q0 WHERE i.collective_id = qc)
UNION ALL SELECT DISTINCT 'relation', rel.id, NULL::DOUBLE FROM rel WHERE source_id IN (SELECT id FROM near UNION SELECT id FROM rec) OR target_id IN (SELECT id FROM near UNION SELECT id FROM rec)""")
def context_candidates(spark, sf_dir):
    from mnemora.operators.context import ContextRequest, candidates

    exp = A.vectors(spark, sf_dir)
    own = exp.join(F.broadcast(exp.where("id = 0").select("collective_id")), "collective_id", "left_semi")
    ins = A.insights(spark, sf_dir).join(F.broadcast(exp.where("id = 0").select("collective_id")), "collective_id", "left_semi")
    c = candidates(ContextRequest(20, 10), own, _q0(exp), ins, A.relations(spark, sf_dir), None, now_ms=NOW, config=CONFIG)
    return c.tagged().select("section", "id", r6("score").alias("score"))


@query(f""", near AS (SELECT id, similarity FROM (SELECT * FROM sim WHERE collective_id = (SELECT qc FROM q0) ORDER BY similarity DESC, id LIMIT 40) WHERE NOT archived ORDER BY similarity DESC, id LIMIT 20),
rec AS (SELECT id FROM (SELECT * FROM exp WHERE collective_id = (SELECT qc FROM q0) ORDER BY ts_ms DESC, id DESC LIMIT 20) WHERE NOT archived ORDER BY ts_ms DESC, id DESC LIMIT 10),
seen AS (SELECT user_id, max(epoch_us(ts) // 1000) AS ms FROM events GROUP BY 1)
SELECT 'similar' AS section, id, round(similarity, 6) AS score FROM near UNION ALL SELECT 'recent', id, NULL FROM rec
UNION ALL SELECT 'agent', user_id, NULL FROM seen WHERE user_id % 10 = (SELECT qc FROM q0) AND ms >= {NOW} - 5 * {DAY}""")
def context_with_agents(spark, sf_dir):
    """All sections that are asked for, presence among them."""
    from mnemora.operators.context import ContextRequest, candidates

    exp = A.vectors(spark, sf_dir)
    of = F.broadcast(exp.where("id = 0").select("collective_id"))
    seen = A.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("agent_id")).agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_heartbeat_ms")).withColumn("collective_id", F.col("agent_id") % 10)
    request = ContextRequest(20, 10, include_insights=False, include_relations=False)
    c = candidates(request, exp.join(of, "collective_id", "left_semi"), _q0(exp), None, None, seen.join(of, "collective_id", "left_semi"), now_ms=NOW, config=CONFIG, stale_seconds=5 * 86_400)
    return c.tagged().select("section", "id", r6("score").alias("score"))


@query("SELECT exp.id, len(v.embedding)::BIGINT AS dimension FROM exp LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 3 <> 0) v ON v.vec_id = exp.id")
def experience_with_any_embedding(spark, sf_dir):
    """Experiences of which some have no vector."""
    have = A.table(spark, sf_dir, "embeddings").where("vec_id % 3 <> 0").select(F.col("vec_id").alias("id"), "embedding")
    return A.vectors(spark, sf_dir).select("id").join(have, "id", "left").select("id", F.size("embedding").cast("long").alias("dimension"))


@query("SELECT min(n) AS low FROM (SELECT user_id % 7 AS peer, max(event_id + 1) AS n FROM events GROUP BY 1)", tables=False)
def min_cursor_of_peers(spark, sf_dir):
    peers = A.change_log(spark, sf_dir).groupBy((F.col("entity_id") % 7).alias("peer_id")).agg(F.max("seq").alias("last_sequence"))
    return peers.agg(F.min("last_sequence").alias("low"))


# state after a change: the engine's own methods on a fork of a store with the projected tables


def _long(column: str) -> F.Column:
    return F.expr(f"try_cast({column} AS bigint)").alias(column)


@query("SELECT id, importance FROM exp UNION ALL SELECT 1000000, 0.5")
def after_record(spark, sf_dir):
    e = store(spark, sf_dir)
    new = e.record_experience("3", "fresh", [0.1] * 64, importance=0.5)
    return e.table("Experience").select(F.when(F.col("id") == new, 1_000_000).otherwise(_long("id")).alias("id"), "importance")


@query("SELECT id, CASE WHEN id = 5 THEN 0.9 ELSE importance END AS importance, CASE WHEN id = 5 THEN 'x' ELSE array_to_string(domain, ',') END AS domain FROM exp")
def after_update_patch(spark, sf_dir):
    e = store(spark, sf_dir)
    e.update_experience("5", importance=0.9, domain=["x"])
    return e.table("Experience").select(_long("id"), "importance", F.array_join("domain", ",").alias("domain"))


@query("SELECT id, archived OR id IN (1, 2, 3) AS archived FROM exp")
def after_archive(spark, sf_dir):
    e = store(spark, sf_dir)
    for i in ("1", "2", "3"):
        e.archive_experience(i)
    return e.table("Experience").select(_long("id"), "archived")


@query("SELECT 'experience' AS kind, id FROM exp WHERE id NOT IN (3, 24) UNION ALL SELECT 'relation', id FROM edges WHERE source_id NOT IN (3, 24) AND target_id NOT IN (3, 24)")
def after_delete_cascade(spark, sf_dir):
    """With edges between collectives too, which go with either end."""
    e = store(spark, sf_dir)
    rest = A.all_edges(spark, sf_dir).join(A.relations(spark, sf_dir).select("id"), "id", "left_anti")
    e.load("Relation", relation_rows(rest, A.vectors(spark, sf_dir)))
    for i in ("3", "24"):
        e.delete_experience(i)
    return e.table("Experience").select(F.lit("experience").alias("kind"), _long("id")).unionByName(e.table("Relation").select(F.lit("relation").alias("kind"), _long("id")))


@query(f"SELECT id, app_a + CASE WHEN id = 8 THEN 1 ELSE 0 END + app_b AS n, CASE WHEN id = 8 THEN {NOW} ELSE last_reinforced_ms END AS last_reinforced_ms FROM exp")
def after_reinforce(spark, sf_dir):
    e = store(spark, sf_dir, instance_id="A")
    e.reinforce_experience("8")
    return e.table("Experience").select(_long("id"), S.total_applications(F.col("applications")).alias("n"), "last_reinforced_ms")


@query("SELECT id, source_id, target_id FROM rel UNION ALL SELECT 100000 + g.id, g.source_id, g.target_id FROM edges g JOIN exp s ON s.id = source_id JOIN exp t ON t.id = target_id WHERE s.collective_id = t.collective_id AND NOT EXISTS (SELECT 1 FROM rel r WHERE r.source_id = g.source_id AND r.target_id = g.target_id AND r.relation_type = (g.relation_type + 1) % 6)")
def after_store_relation(spark, sf_dir):
    """New relations have ids of their own in the store: 100000 + id, as the SQL numbers them, may be an old one's."""
    e = store(spark, sf_dir)
    new = A.all_edges(spark, sf_dir).withColumn("relation_type", (F.col("relation_type") + 1) % 6)
    e.store_relations(relation_rows(new, A.vectors(spark, sf_dir)).withColumn("id", F.concat(F.lit("new-"), "id")))
    number = F.when(F.col("id").startswith("new-"), F.expr("substr(id, 5)").cast("long") + 100_000).otherwise(_long("id"))
    return e.table("Relation").select(number.alias("id"), _long("source_id"), _long("target_id"))


@query("SELECT id FROM rel WHERE id % 2 <> 0")
def after_delete_relation(spark, sf_dir):
    e = store(spark, sf_dir)
    e.delete_relations(e.table("Relation").where(_long("id") % 2 == 0))
    return e.table("Relation").select(_long("id"))


@query("SELECT id, collective_id FROM ins UNION ALL SELECT 1000 + id, collective_id FROM ins WHERE id % 2 = 0")
def after_store_insight(spark, sf_dir):
    e = store(spark, sf_dir)
    sources = A.vectors(spark, sf_dir).groupBy("collective_id").agg(F.array(F.min("id").cast("string")).alias("source_experience_ids"))
    new = A.insights(spark, sf_dir).where("id % 2 = 0").join(sources, "collective_id").select((F.col("id") + 1000).cast("string").alias("id"), text("collective_id"), F.lit("mean").alias("content"), "embedding", "source_experience_ids", F.lit("Pattern").alias("insight_type"), F.lit(0.5).alias("confidence"))
    e.store_insights(new)
    return e.table("Insight").select(_long("id"), _long("collective_id"))


@query("SELECT id FROM ins WHERE id <> 4")
def after_delete_insight(spark, sf_dir):
    e = store(spark, sf_dir)
    e.delete_insight("4")
    return e.table("Insight").select(_long("id"))


def _presence(spark, sf_dir, change: str):
    """What a change by agent 7, in each of its collectives, leaves."""
    e = store(spark, sf_dir)
    for r in e.table("Activity").where("agent_id = '7'").select("collective_id").collect():  # one agent's
        getattr(e, change)("7", r["collective_id"])
    return e.table("Activity").withColumn("agent_id", _long("agent_id"))


@query(f"SELECT agent_id, collective_id, CASE WHEN agent_id = 7 THEN {NOW} ELSE started_at_ms END AS started_at_ms, CASE WHEN agent_id = 7 THEN {NOW} ELSE last_heartbeat_ms END AS last_heartbeat_ms FROM act")
def after_register_activity(spark, sf_dir):
    return _presence(spark, sf_dir, "register_activity").select("agent_id", "collective_id", "started_at_ms", "last_heartbeat_ms")


@query(f"SELECT agent_id, collective_id, started_at_ms, CASE WHEN agent_id = 7 THEN {NOW} ELSE last_heartbeat_ms END AS last_heartbeat_ms FROM act")
def after_heartbeat(spark, sf_dir):
    return _presence(spark, sf_dir, "update_heartbeat").select("agent_id", "collective_id", "started_at_ms", "last_heartbeat_ms")


@query("SELECT agent_id, collective_id FROM act WHERE agent_id <> 7")
def after_end_activity(spark, sf_dir):
    return _presence(spark, sf_dir, "end_activity").select("agent_id", "collective_id")


@query("SELECT id, name, owner_id FROM coll UNION ALL SELECT 50, 'fresh', 'me'")
def after_create_collective(spark, sf_dir):
    e = store(spark, sf_dir)
    new = e.create_collective_with_owner("fresh", "me")
    return e.table("Collective").where("owner_id <> 'events'").select(F.when(F.col("id") == new, 50).otherwise(_long("id")).alias("id"), "name", "owner_id")


@query("SELECT id, name FROM coll UNION ALL SELECT 51, 'fresh'")
def get_or_create(spark, sf_dir):
    e = store(spark, sf_dir)
    assert e.get_or_create_collective("collective-3") == "3"
    new = e.get_or_create_collective("fresh")
    return e.table("Collective").where("owner_id <> 'events' OR owner_id IS NULL").select(F.when(F.col("id") == new, 51).otherwise(_long("id")).alias("id"), "name")


@query("SELECT 'collective' AS kind, id FROM coll WHERE id <> 2 UNION ALL SELECT 'experience', id FROM exp WHERE collective_id <> 2 UNION ALL SELECT 'relation', rel.id FROM rel JOIN exp ON exp.id = source_id WHERE collective_id <> 2 UNION ALL SELECT 'insight', id FROM ins WHERE collective_id <> 2")
def after_delete_collective(spark, sf_dir):
    e = store(spark, sf_dir)
    e.delete_collective("2")
    out = e.table("Collective").where("owner_id <> 'events'").select(F.lit("collective").alias("kind"), _long("id"))
    for kind in ("Experience", "Relation", "Insight"):
        out = out.unionByName(e.table(kind).select(F.lit(kind.lower()).alias("kind"), _long("id")))
    return out


@query("SELECT id, CASE WHEN id = 5 THEN 0.9 ELSE importance END AS importance, app_a + app_b + CASE WHEN id = 8 THEN 2 ELSE 0 END AS n, archived OR id = 12 AS archived FROM exp WHERE id <> 24")
def after_sync(spark, sf_dir):
    """Two stores that both change, and one exchange: the other store's rows."""
    from mnemora.sources.replicate import InMemorySyncTransport, SyncManager, SyncServer

    a, b = store(spark, sf_dir, instance_id="A"), store(spark, sf_dir, instance_id="B")
    a.update_experience("5", importance=0.9)
    a.archive_experience("12")
    a.delete_experience("24")
    a.reinforce_experience("8")
    b.reinforce_experience("8")
    SyncManager(a, InMemorySyncTransport(SyncServer(b))).sync_once()
    return b.table("Experience").select(_long("id"), "importance", S.total_applications(F.col("applications")).alias("n"), "archived")


@query("SELECT 1000000 + id AS id, 'Created' AS event_type, importance FROM exp WHERE collective_id = 3 AND importance >= 0.6 UNION ALL SELECT 3, 'Deleted', NULL")
def watch_events(spark, sf_dir):
    """What a filtered stream of a collective's changes gives: many created at once, and one deleted."""
    from mnemora.streaming.watch import start

    e = store(spark, sf_dir)
    rows = _rows(A.vectors(spark, sf_dir)).withColumn("id", (F.col("id").cast("long") + 1_000_000).cast("string")).withColumn("content", F.lit("copy")).withColumn("source_agent", F.lit("agent"))
    e.record_experiences(rows)
    # of every collective's rows one goes, by its id; only the watched collective's is seen
    gone = e.table("Experience", "3").select(F.min(_long("id"))).first()[0]
    e.delete_experience(str(gone))
    seen = f"{e.root}/seen"
    start(e.watch_experiences("3", WatchFilter(min_importance=0.6)), lambda df, _: df.write.mode("append").parquet(seen), f"{e.root}/checkpoint").awaitTermination()
    return spark.read.parquet(seen).select(F.when(F.col("event_type") == "Deleted", 3).otherwise(F.col("entity_id").cast("long")).cast("long").alias("id"), "event_type", "row.importance")


# rows only


@query()
def approximate_neighbours(spark, sf_dir):
    """The stated batch's ten neighbours by cells, with the share of the true ones among them."""
    exp = A.vectors(spark, sf_dir).select("id", "collective_id", "embedding")
    found = V.Cells(exp, cell_rows=64).nearest(_batch(exp), 10)
    share = V.recall_at(found, V.nearest(_batch(exp), exp, 10), "query_id", 10)
    return found.join(share, "query_id").select("query_id", "id", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"), "recall")


@query()
def watch_stream(spark, sf_dir):
    """Experience events of a streamed log, by type."""
    from mnemora.streaming.watch import drain

    return drain(spark, f"{sf_dir}/events.parquet")


@query()
def embed_udf(spark, sf_dir):
    from mnemora.functions.embedding import HashEmbedder, embed_column

    return A.table(spark, sf_dir, "documents").select("doc_id", embed_column(HashEmbedder(64))(F.col("text")).alias("embedding"))
