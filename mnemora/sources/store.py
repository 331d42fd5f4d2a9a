"""The engine: what the API answers from an append-only log and the state merged from it.

Each change is one folder of typed log rows; entity tables are the newest merged
state with the changes since then over it (see `tables`).  Log rows that only
carry state that peers and watchers never see have visible = false.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora import schemas as S
from mnemora.errors import ConfigError, NotFoundError, ReadOnlyError, ValidationError
from mnemora.functions.embedding import EmbeddingService, ExternalEmbedder, ProviderIdentity, embed_column
from mnemora.functions.scoring import DecayConfig, energy, total_applications
from mnemora.operators import graph, log as L, presence, recall, validation
from mnemora.operators.context import ContextCandidates, ContextRequest, candidates
from mnemora.operators.filters import SearchFilter, WatchFilter
from mnemora.sources.files import Files
from mnemora.sources.tables import MERGE_EVERY, Storage, Tables, typed
from mnemora.streaming import watch as W


def upgrade_v2(rows: DataFrame) -> DataFrame:
    """Rows with a scalar counter (applications) as rows with a counter map and a reinforcement time."""
    return rows.withColumn("applications", F.map_from_arrays(F.array(F.lit(S.LEGACY_BUCKET)), F.array(F.col("applications").cast("long")))).withColumn("last_reinforced_ms", F.col("ts_ms"))


def new_id() -> str:
    """A time-ordered identifier (version 7)."""
    bits = (int(time.time() * 1000) << 80) | (7 << 76) | ((uuid.uuid4().int >> 52) & 0xFFF) << 64 | (2 << 62) | (uuid.uuid4().int & ((1 << 62) - 1))
    return str(uuid.UUID(int=bits))


def mutates(f: Callable) -> Callable:
    @wraps(f)
    def guarded(self, *args, **kwargs):
        if self.read_only:
            raise ReadOnlyError("the store is open for reading only")
        return f(self, *args, **kwargs)

    return guarded


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        dimension: int = 384,
        read_only: bool = False,
        embedder: EmbeddingService | None = None,
        decay: DecayConfig = DecayConfig(),
        instance_id: str | None = None,
        stale_seconds: float = S.STALE_SECONDS,
        clock: Callable[[], int] | None = None,
        watch_enabled: bool = True,
        merge_every: int = MERGE_EVERY,
        tables: Storage | None = None,
    ):
        if not 1 <= dimension <= S.MAX_DIMENSION:
            raise ConfigError("dimension must be from 1 to 4096")
        if stale_seconds <= 0:
            raise ConfigError("the stale threshold must be above 0")
        self.spark, self.root, self.read_only, self.decay = spark, root.rstrip("/"), read_only, decay.validate()
        self.tables = tables or Tables(spark, self.root, merge_every)
        self.embedder = embedder or ExternalEmbedder(dimension)
        self.dimension, self.stale_seconds, self.watch_enabled = self.embedder.dimension(), stale_seconds, watch_enabled
        self.clock = clock or (lambda: int(time.time() * 1000))
        mine = self.embedder.identity()
        files = self.files = Files(spark, self.root)
        if not files.exists("meta.json"):
            if read_only and embedder is not None:
                raise ReadOnlyError("no embedder is stamped yet")
            if not read_only:
                files.make("log")  # so that it can be watched from the start
                files.create("meta.json", {"instance_id": instance_id or new_id(), "provider": mine.provider, "model_id": mine.model_id, "dimension": self.dimension, "schema_version": S.SCHEMA_VERSION, "created_at_ms": self.clock()})
        stamp = self.metadata()
        if stamp and (stamp["provider"], stamp["model_id"]) != (mine.provider, mine.model_id):
            raise ConfigError(f"the store was written with {stamp['provider']}/{stamp['model_id']}")
        # the store's own, so that changes are known as its own after reopening
        self.instance_id = instance_id or stamp.get("instance_id") or new_id()

    # the log

    @property
    def log_path(self) -> str:
        return self.tables.log_path

    def log(self, since: int = 0) -> DataFrame:
        return self.tables.log(since)

    def _append(self, rows: list[tuple], origin: str | None = None) -> int:
        """rows: entity type, event type, id, collective, the entity's row, visible.  One change; returns its last number."""
        place = {k: i for i, k in enumerate(S.TABLES)}
        data = []
        for kind, event, key, coll, body, visible in rows:
            own: list = [None] * len(place)
            own[place[kind]] = body
            data.append((kind, event, key, coll, self.clock(), origin or self.instance_id, visible, *own))
        last = self.tables.put(data)
        self.tables.merge_if_long()
        return last

    def _append_table(self, kind: str, rows: DataFrame, event: str | Column, body: str | Column | None, visible: bool = True, origin: Column | None = None) -> DataFrame:
        """Log rows of one kind from a table with entity_id and collective_id."""
        head = [F.lit(kind).alias("entity_type"), (F.lit(event) if isinstance(event, str) else event).alias("event_type"), "entity_id", "collective_id", F.lit(self.clock()).cast("long").alias("ts_ms"), (F.lit(self.instance_id) if origin is None else origin).alias("origin"), F.lit(visible).alias("visible")]
        return rows.select(*head, *typed(kind, body))

    def _commit(self, *parts: DataFrame) -> int:
        """Tables of log rows as one change; returns how many rows."""
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        n = self.tables.append(out)
        self.tables.merge_if_long()
        return n

    def table(self, kind: str, collective_id: str | None = None) -> DataFrame:
        return self.tables.state(kind, collective_id).select(S.names_of(kind))

    def _one(self, kind: str, key: str) -> dict | None:
        rows = self.tables.state(kind, key=key).select(S.names_of(kind)).limit(1).collect()
        return rows[0].asDict(True) if rows else None

    def _need(self, kind: str, key: str) -> dict:
        got = self._one(kind, key)
        if got is None:
            raise NotFoundError(kind, key)
        return got

    def _check(self, body: dict, schema: str, rules: dict) -> None:
        df = self.spark.createDataFrame([body], schema)
        bad = df.select(validation.violations(rules)).first()[0]
        if bad:
            raise ValidationError(bad[0], ", ".join(bad))

    def merge(self) -> int:
        """Lays the changes so far into a new state; happens by itself after `merge_every` changes."""
        if self.read_only:
            raise ReadOnlyError("the store is open for reading only")
        return self.tables.merge()

    def fork(self, root: str, **options) -> Engine:
        """A store of its own that starts with everything in this one."""
        if not isinstance(self.tables, Tables):
            raise ConfigError("only a store in folders can be forked")
        self.tables.fork(root)
        return Engine(self.spark, root, **({"dimension": self.dimension, "embedder": self.embedder, "decay": self.decay, "clock": self.clock, "stale_seconds": self.stale_seconds} | options))

    # store

    def close(self) -> None:
        self.spark.catalog.clearCache()

    def metadata(self) -> dict:
        """The stamp that the first writer left; empty where there is none."""
        return self.files.read("meta.json") if self.files.exists("meta.json") else {}

    def config(self) -> dict:
        return {"dimension": self.dimension, "read_only": self.read_only, "decay": self.decay, "stale_seconds": self.stale_seconds}

    def embedding_dimension(self) -> int:
        return self.dimension

    def provider_identity(self) -> ProviderIdentity:
        m = self.metadata()
        return ProviderIdentity(m["provider"], m["model_id"])

    def is_read_only(self) -> bool:
        return self.read_only

    # collectives

    @mutates
    def create_collective(self, name: str, owner_id: str | None = None) -> str:
        now = self.clock()
        body = {"id": new_id(), "name": name, "owner_id": owner_id, "embedding_dimension": self.dimension, "created_at_ms": now, "updated_at_ms": now}
        self._check(body, S.COLLECTIVE, validation.collective_rules())
        self._append([("Collective", "Created", body["id"], body["id"], body, True)])
        return body["id"]

    def create_collective_with_owner(self, name: str, owner_id: str) -> str:
        return self.create_collective(name, owner_id)

    def get_or_create_collective(self, name: str) -> str:
        found = self.table("Collective").where(F.col("name") == name).orderBy("id").limit(1).collect()
        return found[0]["id"] if found else self.create_collective(name)

    def get_collective(self, id: str) -> dict | None:
        return self._one("Collective", id)

    def list_collectives(self) -> DataFrame:
        return self.table("Collective").orderBy("id")

    def list_collectives_by_owner(self, owner_id: str) -> DataFrame:
        return self.table("Collective").where(F.col("owner_id") == owner_id).orderBy("id")

    def get_collective_stats(self, id: str) -> dict:
        self._need("Collective", id)
        return self._experiences(id).agg(F.count(F.lit(1)).alias("experience_count"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("storage_bytes"), F.min("ts_ms").alias("oldest_ms"), F.max("ts_ms").alias("newest_ms")).first().asDict()

    @mutates
    def delete_collective(self, id: str) -> None:
        """With everything in it, as one change; ids never leave the executors."""
        self._need("Collective", id)
        parts = []
        for kind in ("Collective", "Experience", "Relation", "Insight", "Activity", "Decay"):
            keys = self.tables.state(kind, id).select("entity_id", F.lit(id).alias("collective_id"))
            parts.append(self._append_table(kind, keys, "Deleted", None, False))
        self._commit(*parts)

    @mutates
    def set_decay_config(self, collective_id: str, config: DecayConfig) -> None:
        config.validate()
        w = config.weights or (None, None)
        self._append([("Decay", "Updated", collective_id, collective_id, {"collective_id": collective_id, "half_life_s": config.half_life_s, "freq_weight": config.freq_weight, "floor": config.floor, "w_similarity": w[0], "w_energy": w[1]}, False)])

    def decay_config(self, collective_id: str) -> DecayConfig:
        d = self._one("Decay", collective_id)
        return DecayConfig(d["half_life_s"], d["freq_weight"], d["floor"], None if d["w_similarity"] is None else (d["w_similarity"], d["w_energy"])) if d else self.decay

    # experiences

    def _experiences(self, collective_id: str) -> DataFrame:
        return self.table("Experience", collective_id).withColumn("n_applications", total_applications(F.col("applications")))

    @mutates
    def record_experience(self, collective_id: str, content: str, embedding: list[float] | None = None, type_tag: int = 8, type_payload: str | None = None, importance: float = 0.5, confidence: float = 0.5, domain: list[str] = (), related_files: list[str] = (), source_agent: str = "agent", source_task: str | None = None) -> str:
        coll = self._need("Collective", collective_id)
        vector = self.embedder.embed(content) if embedding is None else list(map(float, embedding))
        now = self.clock()
        body = {"id": new_id(), "collective_id": collective_id, "content": content, "embedding": vector, "type_tag": type_tag, "type_payload": type_payload, "importance": float(importance), "confidence": float(confidence), "applications": {}, "domain": list(domain), "related_files": list(related_files), "source_agent": source_agent, "source_task": source_task, "ts_ms": now, "last_reinforced_ms": now, "archived": False}
        self._check(body, S.EXPERIENCE, validation.experience_rules(coll["embedding_dimension"]))
        self._append([("Experience", "Created", body["id"], collective_id, body, True)])
        return body["id"]

    @mutates
    def record_experiences(self, rows: DataFrame) -> DataFrame:
        """Many at once: one change with the valid rows; returns the rejected ones with their codes.

        A collective that isn't there is a code too.  Rows without an id get one, rows
        without a vector get the embedder's, in Arrow batches.
        """
        rows = rows.withColumn("id", F.coalesce("id", F.expr("uuid()"))) if "id" in rows.columns else rows.withColumn("id", F.expr("uuid()"))
        if not isinstance(self.embedder, ExternalEmbedder):
            rows = rows.where(F.col("embedding").isNotNull()).unionByName(rows.where(F.col("embedding").isNull()).withColumn("embedding", embed_column(self.embedder)(F.col("content"))))
        known = self.table("Collective").select(F.col("id").alias("collective_id"), F.col("embedding_dimension").alias("_dimension"))
        marked = rows.join(known, "collective_id", "left").withColumn("violations", validation.violations(validation.experience_rules(F.coalesce("_dimension", F.lit(self.dimension))) | {"collective_missing": F.col("_dimension").isNull()})).drop("_dimension")
        good = marked.where(F.size("violations") == 0).select(F.col("id").alias("entity_id"), "collective_id", F.struct(*S.names_of("Experience")).alias("body"))
        self._commit(self._append_table("Experience", good, "Created", "body"))
        return marked.where(F.size("violations") > 0).select(*rows.columns, "violations")

    @mutates
    def load(self, kind: str, rows: DataFrame) -> int:
        """Rows of any kind as they are, as one change that watchers and peers don't see; returns how many."""
        key = {"Activity": F.concat_ws("/", "collective_id", "agent_id"), "Decay": F.col("collective_id")}.get(kind, F.col("id") if "id" in rows.columns else F.lit(None))
        own = F.col("id") if kind == "Collective" else F.col("collective_id")
        body = F.struct(*[(F.col(c) if c in rows.columns else F.lit(None)).alias(c) for c in S.names_of(kind)])
        return self._commit(self._append_table(kind, rows.select(key.alias("entity_id"), own.alias("collective_id"), body.alias("body")), "Created", "body", False))

    def get_experience(self, id: str) -> dict | None:
        return self._one("Experience", id)

    @mutates
    def update_experience(self, id: str, **patch) -> None:
        allowed = {"importance", "confidence", "domain", "related_files", "archived"}
        if set(patch) - allowed:
            raise ValidationError("InvalidField", str(set(patch) - allowed))
        body = self._need("Experience", id) | {k: v for k, v in patch.items() if v is not None}
        self._check(body, S.EXPERIENCE, {k: c for k, c in validation.experience_rules(len(body["embedding"])).items() if k in validation.OF_UPDATES})
        self._append([("Experience", "Archived" if patch.get("archived") else "Updated", id, body["collective_id"], body, True)])

    def archive_experience(self, id: str) -> None:
        self.update_experience(id, archived=True)

    def unarchive_experience(self, id: str) -> None:
        self.update_experience(id, archived=False)

    @mutates
    def delete_experience(self, id: str) -> None:
        coll = self._need("Experience", id)["collective_id"]
        gone = self.spark.createDataFrame([(id,)], "id string")
        edges = graph.touching(self.table("Relation"), F.broadcast(gone)).select(F.col("id").alias("entity_id"), "collective_id")
        own = gone.select(F.col("id").alias("entity_id"), F.lit(coll).alias("collective_id"))
        self._commit(self._append_table("Experience", own, "Deleted", None), self._append_table("Relation", edges, "Deleted", None, False))

    @mutates
    def reinforce_experience(self, id: str) -> int:
        body = self._need("Experience", id)
        counters = body["applications"]
        counters[self.instance_id] = min(counters.get(self.instance_id, 0) + 1, S.U32_MAX)
        body["last_reinforced_ms"] = self.clock()
        self._append([("Experience", "Updated", id, body["collective_id"], body, True)])
        return min(sum(counters.values()), S.U32_MAX)

    def energy(self, id: str) -> float:
        body = self._need("Experience", id)
        c = self.decay_config(body["collective_id"])
        row = self._experiences(body["collective_id"]).where(F.col("id") == id)
        return row.select(energy(F.col("importance"), F.col("n_applications"), F.col("last_reinforced_ms"), self.clock(), c.half_life_s, c.freq_weight)).first()[0]

    def list_experiences(self, collective_id: str, limit: int, offset: int = 0) -> DataFrame:
        return recall.page(self._experiences(collective_id), limit, offset, F.asc("ts_ms"), F.asc("id"))

    def get_recent_experiences(self, collective_id: str, limit: int, filter: SearchFilter = SearchFilter()) -> DataFrame:
        recall.check_k(limit, "limit")
        self._need("Collective", collective_id)
        return recall.recent(self._experiences(collective_id), limit, filter)

    get_recent_experiences_filtered = get_recent_experiences

    def list_cold_experiences(self, collective_id: str, below: float, limit: int) -> DataFrame:
        self._need("Collective", collective_id)
        return recall.cold(self._experiences(collective_id), below, limit, self.clock(), self.decay_config(collective_id))

    # search

    def _query(self, collective_id: str, vector: list[float]) -> DataFrame:
        if len(vector) != self._need("Collective", collective_id)["embedding_dimension"]:
            raise ValidationError("DimensionMismatch", str(len(vector)))
        return self.spark.createDataFrame([(list(map(float, vector)),)], "q array<double>")

    def search_similar(self, collective_id: str, query: list[float], k: int, filter: SearchFilter = SearchFilter()) -> DataFrame:
        recall.check_k(k)
        return recall.search_filtered(self._experiences(collective_id), self._query(collective_id, query), k, filter)

    search_similar_filtered = search_similar

    def search(self, collective_id: str, query: list[float], k: int = 10, filter: SearchFilter = SearchFilter(), weights: tuple[float, float] | None = None) -> DataFrame:
        recall.check_k(k)
        return recall.search(self._experiences(collective_id), self._query(collective_id, query), k, filter, weights, self.decay_config(collective_id), self.clock())

    def with_vector_index(self, collective_id: str, query: list[float], f: Callable[[DataFrame], object]) -> object:
        """f over every row with its similarity."""
        return f(recall.scored(self._experiences(collective_id), self._query(collective_id, query)))

    # relations

    @mutates
    def store_relation(self, source_id: str, target_id: str, relation_type: str, strength: float = 1.0, metadata: str | None = None) -> str:
        if relation_type not in S.RELATION_TYPES:
            raise ValidationError("InvalidField", relation_type)
        body = {"id": new_id(), "source_id": source_id, "target_id": target_id, "relation_type": relation_type, "strength": float(strength), "metadata": metadata, "created_at_ms": self.clock(), "collective_id": None}
        self._check(body, S.RELATION, validation.relation_rules())
        a, b = self._need("Experience", source_id), self._need("Experience", target_id)
        if a["collective_id"] != b["collective_id"]:
            raise ValidationError("InvalidField", "both ends must be of one collective")
        same = self.table("Relation", a["collective_id"]).where((F.col("source_id") == source_id) & (F.col("target_id") == target_id) & (F.col("relation_type") == relation_type))
        if not same.isEmpty():
            raise ValidationError("InvalidField", "the relation exists")
        body["collective_id"] = a["collective_id"]
        self._append([("Relation", "Created", body["id"], a["collective_id"], body, True)])
        return body["id"]

    @mutates
    def store_relations(self, rows: DataFrame) -> DataFrame:
        """Many at once (id, source_id, target_id, relation_type, strength, metadata): one change with the valid ones; returns the others with their codes."""
        have = set(rows.columns)
        rows = rows.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("id", "source_id", "target_id", "relation_type", "strength", "metadata")])
        ends = self.table("Experience").select("id", "collective_id")
        joined = graph.with_collectives(rows, ends)
        held = self.table("Relation").select("source_id", "target_id", "relation_type").withColumn("_held", F.lit(True))
        # of equal new ones the first by id
        first = rows.groupBy("source_id", "target_id", "relation_type").agg(F.min("id").alias("_first"))
        key = ["source_id", "target_id", "relation_type"]
        # a row under an id that is held would replace the other relation; of new ones of one id the first by key
        taken = self.table("Relation").select("id").withColumn("_taken", F.lit(True))
        own = rows.groupBy("id").agg(F.min(F.struct(*key)).alias("_own"))
        rules = validation.relation_rules() | {
            "type_unknown": ~F.coalesce(F.col("relation_type").isin(*S.RELATION_TYPES), F.lit(False)),
            "end_missing": F.col("source_collective").isNull() | F.col("target_collective").isNull(),
            "collectives_differ": F.col("source_collective") != F.col("target_collective"),
            "relation_exists": F.col("_held").isNotNull() | (F.col("id") != F.col("_first")),
            "id_exists": F.col("_taken").isNotNull() | (F.struct(*key) != F.col("_own")),
        }
        marked = joined.join(held, key, "left").join(first, key, "left").join(taken, "id", "left").join(own, "id", "left").withColumn("violations", validation.violations(rules)).withColumn("created_at_ms", F.lit(self.clock())).withColumn("collective_id", F.col("source_collective"))
        good = marked.where(F.size("violations") == 0).select(F.col("id").alias("entity_id"), "collective_id", F.struct(*S.names_of("Relation")).alias("body"))
        self._commit(self._append_table("Relation", good, "Created", "body"))
        return marked.where(F.size("violations") > 0).select(*rows.columns, "violations")

    @mutates
    def delete_relations(self, ids: DataFrame) -> int:
        """Many at once (id); returns how many there were."""
        gone = self.table("Relation").select("id", "collective_id").join(ids.select("id").distinct(), "id", "left_semi")
        return self._commit(self._append_table("Relation", gone.withColumnRenamed("id", "entity_id"), "Deleted", None))

    def get_relation(self, id: str) -> dict | None:
        return self._one("Relation", id)

    @mutates
    def delete_relation(self, id: str) -> None:
        self._append([("Relation", "Deleted", id, self._need("Relation", id)["collective_id"], None, True)])

    def get_related_experiences(self, experience_id: str, direction: str = "Both", relation_type: str | None = None) -> DataFrame:
        anchor = self.spark.createDataFrame([(experience_id,)], "id string")
        coll = (self._one("Experience", experience_id) or {}).get("collective_id", "")  # both ends are of one collective
        return graph.related(self.table("Relation", coll).drop("collective_id"), self.table("Experience", coll), direction, relation_type, anchor)

    get_related_experiences_filtered = get_related_experiences

    def list_relations(self, collective_id: str, limit: int, offset: int = 0) -> DataFrame:
        s = self._experiences(collective_id).select(F.col("id").alias("source_id"), F.col("ts_ms").alias("o"))
        return recall.page(self.table("Relation", collective_id).join(s, "source_id"), limit, offset, F.asc("o"), F.asc("source_id"), F.asc("id")).drop("o")

    # insights

    @mutates
    def store_insight(self, collective_id: str, content: str, source_experience_ids: list[str], embedding: list[float] | None = None, insight_type: str = "Pattern", confidence: float = 0.5, domain: list[str] = ()) -> str:
        dimension = self._need("Collective", collective_id)["embedding_dimension"]
        now = self.clock()
        body = {"id": new_id(), "collective_id": collective_id, "content": content, "embedding": self.embedder.embed(content) if embedding is None else list(map(float, embedding)), "source_experience_ids": list(source_experience_ids), "insight_type": insight_type, "confidence": float(confidence), "domain": list(domain), "created_at_ms": now, "updated_at_ms": now}
        self._check(body, S.INSIGHT, validation.insight_rules(dimension))
        bad = graph.source_violations(self.spark.createDataFrame([body], S.INSIGHT), self.table("Experience")).collect()  # at most 100 sources
        if any(r["reason"] == "missing" for r in bad):
            raise NotFoundError("Experience", bad[0]["source_id"])
        if bad:
            raise ValidationError("InvalidField", "sources must be of the collective")
        self._append([("Insight", "Created", body["id"], collective_id, body, True)])
        return body["id"]

    @mutates
    def store_insights(self, rows: DataFrame) -> DataFrame:
        """Many at once, as `store_insight` has them: one change with the valid ones; returns the others with their codes."""
        known = self.table("Collective").select(F.col("id").alias("collective_id"), F.col("embedding_dimension").alias("_dimension"))
        wrong = graph.source_violations(rows, self.table("Experience")).groupBy(F.col("insight_id").alias("id")).agg(F.max("reason").alias("_source"))
        now = F.lit(self.clock())
        rules = validation.insight_rules(F.coalesce("_dimension", F.lit(self.dimension))) | {"collective_missing": F.col("_dimension").isNull(), "source_wrong": F.col("_source").isNotNull()}
        marked = rows.join(known, "collective_id", "left").join(wrong, "id", "left").withColumn("violations", validation.violations(rules)).withColumn("created_at_ms", now).withColumn("updated_at_ms", now)
        body = F.struct(*[F.col(c) if c in marked.columns else F.lit(None).alias(c) for c in S.names_of("Insight")])
        good = marked.where(F.size("violations") == 0).select(F.col("id").alias("entity_id"), "collective_id", body.alias("body"))
        self._commit(self._append_table("Insight", good, "Created", "body"))
        return marked.where(F.size("violations") > 0).select(*rows.columns, "violations")

    def get_insight(self, id: str) -> dict | None:
        return self._one("Insight", id)

    def get_insights(self, collective_id: str, query: list[float], k: int) -> DataFrame:
        return recall.insights_like(self.table("Insight", collective_id), self._query(collective_id, query), k)

    def list_insights(self, collective_id: str, limit: int, offset: int = 0) -> DataFrame:
        return recall.page(self.table("Insight", collective_id), limit, offset, F.asc("id"))

    @mutates
    def delete_insight(self, id: str) -> None:
        self._append([("Insight", "Deleted", id, self._need("Insight", id)["collective_id"], None, True)])

    # presence

    @mutates
    def register_activity(self, agent_id: str, collective_id: str, current_task: str | None = None, context_summary: str | None = None) -> None:
        self._need("Collective", collective_id)
        now = self.clock()
        body = {"agent_id": agent_id, "collective_id": collective_id, "current_task": current_task, "context_summary": context_summary, "started_at_ms": now, "last_heartbeat_ms": now}
        self._check(body, S.ACTIVITY, validation.activity_rules())
        self._append([("Activity", "Updated", f"{collective_id}/{agent_id}", collective_id, body, False)])

    @mutates
    def update_heartbeat(self, agent_id: str, collective_id: str) -> None:
        body = self._need("Activity", f"{collective_id}/{agent_id}") | {"last_heartbeat_ms": self.clock()}
        self._append([("Activity", "Updated", f"{collective_id}/{agent_id}", collective_id, body, False)])

    @mutates
    def end_activity(self, agent_id: str, collective_id: str) -> None:
        self._need("Activity", f"{collective_id}/{agent_id}")
        self._append([("Activity", "Deleted", f"{collective_id}/{agent_id}", collective_id, None, False)])

    def get_active_agents(self, collective_id: str) -> DataFrame:
        self._need("Collective", collective_id)
        now = self.spark.range(1).select(F.lit(self.clock()).alias("now_ms"))
        return presence.active(self.table("Activity", collective_id), now, self.stale_seconds)

    def get_context_candidates(self, collective_id: str, query: list[float], request: ContextRequest = ContextRequest()) -> ContextCandidates:
        own = [self.table(kind, collective_id) for kind in ("Insight", "Relation", "Activity")]
        return candidates(request, self._experiences(collective_id), self._query(collective_id, query), *own, self.clock(), self.decay_config(collective_id), self.stale_seconds)

    # the log's readers

    def watch_experiences(self, collective_id: str, filter: WatchFilter = WatchFilter()) -> DataFrame:
        """A stream of experience events; one that stays silent where watching is switched off."""
        rows = W.watch(self.spark, self.log_path, collective_id, filter)
        return rows if self.watch_enabled else rows.where(F.lit(False))

    watch_experiences_filtered = watch_experiences

    def get_current_sequence(self) -> int:
        return self.tables.last_seq()

    def visible_log(self, since: int = 0) -> DataFrame:
        return self.log(since).where("visible")

    def page(self, since: int, limit: int) -> DataFrame:
        """The next `limit` visible log rows: as much of the log is read as holds them."""
        rows, end = limit, self.tables.last_seq()
        while True:
            page = L.scan(self.tables.log(since, rows).where("visible"), since, limit)
            if since + rows >= end or page.count() >= limit:
                return page
            rows *= 4  # many rows there are invisible

    def poll_changes(self, since: int, limit: int = 1000) -> tuple[DataFrame, int]:
        """Experience events of the next `limit` log rows, and the sequence to go on from."""
        page = self.page(since, limit)
        return page.where(F.col("entity_type") == "Experience"), page.agg(F.max("seq")).first()[0] or since

    poll_changes_batch = poll_changes

    @mutates
    def save_cursor(self, peer_id: str, direction: str, last_sequence: int) -> None:
        self._append([("Cursor", "Updated", f"{peer_id}/{direction}", None, {"peer_id": peer_id, "direction": direction, "last_sequence": last_sequence}, False)])

    def load_cursor(self, peer_id: str, direction: str) -> int:
        c = self._one("Cursor", f"{peer_id}/{direction}")
        return c["last_sequence"] if c else 0

    def list_cursors(self) -> DataFrame:
        return self.table("Cursor").orderBy("peer_id", "direction")

    @mutates
    def compact_wal(self) -> int:
        """Drops changes that every peer has been sent; returns their rows.  Without a peer none go, nor with one that was never sent any.

        The state is merged first, so nothing but history is lost.  Files go whole, so
        readers, pollers and streams that have read them are not disturbed.
        """
        sent = self.table("Cursor").groupBy("peer_id").agg(F.max(F.when(F.col("direction") == "push", F.col("last_sequence"))).alias("n"))
        low = sent.agg(F.min(F.coalesce("n", F.lit(0)))).first()[0] or 0
        if not low or self.log().where(F.col("seq") <= low).isEmpty():
            return 0
        self.tables.merge()
        return self.tables.drop_log(low)

    # changes from peers: no validation, not offered to peers again

    @mutates
    def apply_synced(self, kind: str, event: str, id: str, collective_id: str | None, body: dict | None, origin: str) -> None:
        self._append([(kind, event, id, collective_id, body, True)], origin)

    def apply_synced_experience(self, body: dict, origin: str = "peer") -> None:
        self.apply_synced("Experience", "Created", body["id"], body["collective_id"], body, origin)

    def apply_synced_experience_update(self, id: str, patch: dict, origin: str = "peer") -> None:
        body = self._need("Experience", id) | patch
        self.apply_synced("Experience", "Updated", id, body["collective_id"], body, origin)

    def apply_synced_experience_delete(self, id: str, origin: str = "peer") -> None:
        self.apply_synced("Experience", "Deleted", id, self._need("Experience", id)["collective_id"], None, origin)

    def apply_synced_relation(self, body: dict, origin: str = "peer") -> None:
        self.apply_synced("Relation", "Created", body["id"], body["collective_id"], body, origin)

    def apply_synced_relation_delete(self, id: str, origin: str = "peer") -> None:
        self.apply_synced("Relation", "Deleted", id, self._need("Relation", id)["collective_id"], None, origin)

    def apply_synced_insight(self, body: dict, origin: str = "peer") -> None:
        self.apply_synced("Insight", "Created", body["id"], body["collective_id"], body, origin)

    def apply_synced_insight_delete(self, id: str, origin: str = "peer") -> None:
        self.apply_synced("Insight", "Deleted", id, self._need("Insight", id)["collective_id"], None, origin)

    def apply_synced_collective(self, body: dict, origin: str = "peer") -> None:
        self.apply_synced("Collective", "Created", body["id"], body["id"], body, origin)


class ChangePoller:
    """A cursor of its own over the log."""

    def __init__(self, since: int = 0, limit: int = 1000):
        self.last_sequence, self.limit = since, limit

    @classmethod
    def from_sequence(cls, seq: int) -> ChangePoller:
        return cls(seq)

    def with_batch_limit(self, limit: int) -> ChangePoller:
        self.limit = limit
        return self

    def poll(self, engine: Engine) -> list:
        rows, self.last_sequence = engine.poll_changes(self.last_sequence, self.limit)
        return rows.orderBy("seq").collect()  # at most `limit` rows

    def poll_sync_events(self, engine: Engine) -> list:
        rows = engine.page(self.last_sequence, self.limit).orderBy("seq").collect()
        self.last_sequence = rows[-1]["seq"] if rows else self.last_sequence
        return rows
