"""Storage, replication, the provider, indexes and the lock."""

import asyncio
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemora import schemas as S
from mnemora.errors import ConfigError, MnemoraError, ReadOnlyError, StorageError, SyncError, ValidationError
from mnemora.functions import vectors
from mnemora.functions.embedding import HashEmbedder, OnnxEmbedder, create_embedding_service, validate_embedding
from mnemora.functions.scoring import DecayConfig
from mnemora.operators.context import ContextRequest
from mnemora.operators.filters import SearchFilter
from mnemora.operators.index import ApproximateIndex, ExactIndex
from mnemora.provider import EngineProvider, MemoryProvider
from mnemora.sources.lock import WriterLock
from mnemora.sources.replicate import DirectorySyncTransport, InMemorySyncTransport, SyncConfig, SyncManager, SyncServer, apply_changes
from mnemora.sources.store import ChangePoller, Engine
from mnemora.streaming import watch
from tests.test_engine import Clock, ids, planar


def opened(spark, tmp_path, name="a", **more):
    return Engine(spark, f"file://{tmp_path}/{name}", **({"dimension": 4, "clock": Clock()} | more))


def everything(engine):
    return {k: sorted(map(str, (r.asDict(True) for r in engine.table(k).collect()))) for k in S.TABLES}


def test_merged_state_equals_the_log(spark, tmp_path):
    e = opened(spark, tmp_path)
    c, d = e.create_collective("one", "me"), e.create_collective("two/ü =")
    a, b, g = (e.record_experience(k, t, planar(0.9), domain=["x"]) for k, t in ((c, "a"), (c, "b"), (d, "g")))
    e.store_relation(a, b, "Supports")
    e.register_activity("bot", d)
    e.set_decay_config(c, DecayConfig(half_life_s=60.0))
    before, log = everything(e), e.log().count()
    seq = e.merge()
    assert seq == e.get_current_sequence() and everything(e) == before and e.log().count() == log and e.merge() == seq
    e.update_experience(a, importance=0.25)
    e.delete_experience(b)
    e.reinforce_experience(g)
    e.delete_collective(d)
    e.record_experience(c, "new", planar(0.5))
    before = everything(e)
    assert [len(before[k]) for k in ("Collective", "Experience", "Relation", "Activity")] == [1, 2, 0, 0]
    again = opened(spark, tmp_path)
    assert everything(again) == before and again.instance_id == e.instance_id
    e.merge()
    assert everything(again) == everything(e) == before
    fork = e.fork(f"file://{tmp_path}/fork")
    fork.delete_experience(a)
    assert len(everything(fork)["Experience"]) == 1 and everything(e) == before and fork.instance_id != e.instance_id


def test_merges_by_itself(spark, tmp_path):
    e = opened(spark, tmp_path, merge_every=3)
    c = e.create_collective("one")
    a = [e.record_experience(c, str(i), planar(0.9)) for i in range(5)]
    assert 0 < e.tables.pointer()["seq"] < e.get_current_sequence() and sorted(ids(e.list_experiences(c, 9))) == sorted(a)


def test_a_storage_of_ones_own(spark, tmp_path):
    from mnemora.sources.tables import Tables

    class Counting(Tables):
        written = 0

        def put(self, rows):
            self.written += len(rows)
            return super().put(rows)

    own = Counting(spark, f"file://{tmp_path}/a")
    e = opened(spark, tmp_path, tables=own)
    c = e.create_collective("one")
    x = e.record_experience(c, "x", planar(0.9))
    assert own.written == 2 and e.get_experience(x)["content"] == "x" and e.close() is None
    assert e.metadata()["schema_version"] == 3 and e.config()["dimension"] == e.embedding_dimension() == 4 and not e.is_read_only()
    assert e.provider_identity().provider == "external"


def test_search_prunes_by_collective(spark, tmp_path):
    e = opened(spark, tmp_path)
    c = e.create_collective("one")
    e.record_experience(c, "a", planar(0.9))
    e.merge()
    plan = e.search_similar(c, planar(1.0), 3)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert f"PartitionFilters: [isnotnull(_collective" in physical and c in physical and "json" not in physical.lower()
    e.update_experience(c and ids(e.list_experiences(c, 1))[0], importance=0.1)
    plan = e.search_similar(c, planar(1.0), 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_collective" in plan and "json" not in plan[plan.index("== Physical Plan ==") :].lower()


def test_writers_get_numbers_of_their_own(spark, tmp_path):
    a, b = opened(spark, tmp_path), opened(spark, tmp_path)
    for k in range(3):
        a.create_collective(f"a{k}")
        b.create_collective(f"b{k}")
    a.merge()
    b.create_collective("late")
    seqs = [r["seq"] for r in a.log().collect()]
    assert sorted(seqs) == list(range(1, 8)) and a.get_current_sequence() == b.get_current_sequence() == 7
    assert a.list_collectives().count() == 7


def test_read_only_refuses_every_change(spark, tmp_path):
    e = opened(spark, tmp_path, embedder=HashEmbedder(8))
    c = e.create_collective("one")
    x, y = e.record_experience(c, "x"), e.record_experience(c, "y")
    r, i = e.store_relation(x, y, "Supports"), e.store_insight(c, "i", [x])
    e.register_activity("bot", c)
    ro = opened(spark, tmp_path, embedder=HashEmbedder(8), read_only=True)
    rows, page = e.table("Experience"), e.log()
    n = e.log().count()
    for change in (
        lambda: ro.create_collective("x"), lambda: ro.get_or_create_collective("x"), lambda: ro.delete_collective(c), lambda: ro.set_decay_config(c, DecayConfig()),
        lambda: ro.record_experience(c, "x"), lambda: ro.record_experiences(rows), lambda: ro.update_experience(x, importance=0.1), lambda: ro.archive_experience(x),
        lambda: ro.unarchive_experience(x), lambda: ro.delete_experience(x), lambda: ro.reinforce_experience(x), lambda: ro.store_relation(y, x, "Supports"),
        lambda: ro.store_relations(e.table("Relation")), lambda: ro.delete_relation(r), lambda: ro.delete_relations(e.table("Relation")), lambda: ro.store_insight(c, "x", [x]),
        lambda: ro.store_insights(e.table("Insight")), lambda: ro.delete_insight(i), lambda: ro.register_activity("a", c), lambda: ro.update_heartbeat("bot", c),
        lambda: ro.end_activity("bot", c), lambda: ro.save_cursor("p", "push", 3), lambda: ro.compact_wal(), lambda: ro.merge(), lambda: ro.load("Experience", rows),
        lambda: ro.apply_synced("Insight", "Deleted", i, c, None, "p"), lambda: ro.apply_synced_experience(ro.get_experience(x)), lambda: ro.apply_synced_experience_update(x, {}),
        lambda: ro.apply_synced_experience_delete(x), lambda: ro.apply_synced_relation_delete(r), lambda: ro.apply_synced_insight_delete(i), lambda: apply_changes(ro, page, SyncConfig()),
    ):
        with pytest.raises(ReadOnlyError):
            change()
    assert e.log().count() == n and ro.get_current_sequence() == n


def test_compaction_and_a_watcher_across_it(spark, tmp_path):
    e = opened(spark, tmp_path)
    c = e.create_collective("one")
    a = e.record_experience(c, "a", planar(0.9))
    got = []

    def look():
        q = watch.start(e.watch_experiences(c), lambda df, _: got.extend(r["seq"] for r in df.collect()), f"file://{tmp_path}/cp")
        q.awaitTermination()

    look()
    e.update_experience(a, importance=0.25)
    look()
    assert got == [2, 3]
    e.save_cursor("p", "pull", 9)
    assert e.compact_wal() == 0  # a peer that was never sent any
    e.save_cursor("p", "push", 2)
    e.save_cursor("q", "push", 3)
    before = everything(e)
    assert e.compact_wal() == 2 and e.compact_wal() == 0 and everything(e) == before
    assert min(r["seq"] for r in e.log().collect()) == 3 and e.get_current_sequence() == 6
    look()
    b = e.record_experience(c, "b", planar(0.8))
    look()
    assert got == [2, 3, 7] and e.get_experience(b)["content"] == "b"
    assert [(r["peer_id"], r["direction"], r["last_sequence"]) for r in e.list_cursors().collect()] == [("p", "pull", 9), ("p", "push", 2), ("q", "push", 3)]
    silent = opened(spark, tmp_path, watch_enabled=False)
    q = watch.start(silent.watch_experiences(c), lambda df, _: got.extend(df.collect()), f"file://{tmp_path}/cp2")
    q.awaitTermination()
    assert got == [2, 3, 7]


def test_reopened_stores_push_their_changes(spark, tmp_path):
    a = opened(spark, tmp_path, "a")
    c = a.create_collective("one")
    x = a.record_experience(c, "x", planar(0.9))
    a.close()
    a, b = opened(spark, tmp_path, "a"), opened(spark, tmp_path, "b")
    SyncManager(a, InMemorySyncTransport(SyncServer(b))).sync_once()
    assert b.get_experience(x)["content"] == "x" and b.get_collective(c) is not None
    there, _ = InMemorySyncTransport.pair(a, b)
    assert there.instance_id == b.instance_id


def test_conflicts(spark, tmp_path):
    clock = Clock()
    a, b = opened(spark, tmp_path, "a", clock=clock), opened(spark, tmp_path, "b", clock=clock)
    c = a.create_collective("one")
    x = a.record_experience(c, "x", planar(0.9), importance=0.5)
    m = SyncManager(a, InMemorySyncTransport(SyncServer(b)), SyncConfig(direction="PushOnly"))
    m.sync_once()
    a.update_experience(x, importance=0.25, domain=["new"])
    a.reinforce_experience(x)
    page = a.visible_log(2)
    local = b.table("Experience")
    b.apply_synced("Experience", "Updated", x, c, b.get_experience(x) | {"ts_ms": clock.now + 10_000}, "test")  # the local row is later
    got = apply_changes(b, page, SyncConfig(conflict="LastWriteWins"))
    now = b.get_experience(x)
    assert got == {"applied": 1, "skipped": 0, "conflicts": 1} and now["importance"] == 0.5 and now["applications"] == {a.instance_id: 1}
    assert apply_changes(b, page, SyncConfig(conflict="LastWriteWins"))["applied"] == 0  # merged already
    got = apply_changes(b, page, SyncConfig())
    assert got == {"applied": 1, "skipped": 0, "conflicts": 0} and b.get_experience(x)["importance"] == 0.25 and b.get_experience(x)["domain"] == ["new"]
    assert local.count() == 1
    a.delete_experience(x)
    y = a.record_experience(c, "y", planar(0.5))
    a.update_experience(y, importance=0.75)
    m.sync_once()
    assert b.get_experience(x) is None and b.get_experience(y)["importance"] == 0.75
    n = b.get_current_sequence()
    gone = a.log().where((F.col("event_type") != "Created") & (F.col("entity_id") == x))
    assert apply_changes(b, gone, SyncConfig())["skipped"] == 1 and b.get_current_sequence() == n


def test_too_many_counters_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("mnemora.operators.log.MAX_COUNTER_BUCKETS", 2)
    a, b = opened(spark, tmp_path, "a"), opened(spark, tmp_path, "b")
    c = a.create_collective("one")
    x = a.record_experience(c, "x", planar(0.9))
    a.apply_synced("Experience", "Created", x, c, a.get_experience(x) | {"applications": {"i": 1, "j": 2, "k": 3}}, a.instance_id)
    apply_changes(b, a.log().where("seq > 2"), SyncConfig())
    assert b.get_experience(x) is None


def test_relations_and_insights_replicate(spark, tmp_path):
    a, b = opened(spark, tmp_path, "a"), opened(spark, tmp_path, "b")
    c = a.create_collective("one")
    x, y = a.record_experience(c, "x", planar(0.9)), a.record_experience(c, "y", planar(0.8))
    r, i = a.store_relation(x, y, "Implies", 0.5), a.store_insight(c, "i", [x], planar(1.0))
    SyncManager(a, InMemorySyncTransport(SyncServer(b)), SyncConfig(insights=False)).sync_once()
    assert b.get_relation(r)["strength"] == 0.5 and b.get_insight(i) is None
    assert apply_changes(b, a.log(), SyncConfig()) == {"applied": 1, "skipped": 4, "conflicts": 0} and b.get_insight(i)["content"] == "i"
    a.delete_insight(i)
    a.delete_experience(x)
    SyncManager(a, InMemorySyncTransport(SyncServer(b))).sync_once()
    assert b.get_insight(i) is None and b.get_relation(r) is None  # a deleted experience takes its edges along
    fresh = opened(spark, tmp_path, "c")
    with pytest.raises(SyncError):
        SyncServer(fresh).handle_handshake({"protocol": 1, "instance_id": "x"})


def test_directory_transport_and_loop(spark, tmp_path):
    a, b = opened(spark, tmp_path, "a"), opened(spark, tmp_path, "b")
    c = a.create_collective("one")
    x = a.record_experience(c, "x", planar(0.9))
    folder, end = f"file://{tmp_path}/exchange", threading.Event()

    def serve():
        while not end.is_set():
            DirectorySyncTransport.serve(SyncServer(b), folder)
            end.wait(0.05)

    t = threading.Thread(target=serve)
    t.start()
    try:
        m = SyncManager(a, DirectorySyncTransport(spark, folder), SyncConfig(push_interval_ms=50, pull_interval_ms=50))
        assert m.transport.health()
        m.start()
        with pytest.raises(SyncError):
            m.start()
        for _ in range(400):
            if b.get_experience(x) is not None:
                break
            end.wait(0.1)
        y = b.record_experience(c, "y", planar(0.5))
        for _ in range(400):
            if a.get_experience(y) is not None:
                break
            end.wait(0.1)
        m.stop()
        assert a.get_experience(y)["content"] == "y" and m.status in ("Idle", "Syncing")
    finally:
        end.set()
        t.join()
    lost = SyncManager(a, DirectorySyncTransport(spark, folder, timeout_s=0.1), SyncConfig(max_retries=1))
    waits = []
    lost.run(3, waits.append)
    assert lost.status.startswith("Error") and waits == [0.5, 30.0, 30.0] and not lost.transport.health()
    with pytest.raises(ConfigError):
        SyncConfig(push_interval_ms=0).validate()


def test_provider(spark, tmp_path):
    p = EngineProvider(opened(spark, tmp_path), poll_s=0.05)

    async def use():
        c = await p.create_collective("one")
        assert await p.get_or_create_collective("one") == c and [r["id"] for r in await p.list_collectives()] == [c]
        seen = []

        async def listen():
            async for event in p.watch(c):
                seen.append((event["event_type"], event["entity_id"]))
                if len(seen) == 2:
                    return

        listener = asyncio.create_task(listen())
        await asyncio.sleep(0.5)
        a = await p.store_experience(c, "a", embedding=planar(0.9))
        b = await p.store_experience(c, "b", embedding=planar(0.5))
        await asyncio.wait_for(listener, 60)
        assert seen == [("Created", a), ("Created", b)]
        assert (await p.get_experience(a))["content"] == "a" and await p.reinforce_experience(a) == 1 and 0 < await p.energy(a) <= 1
        found = await p.search_similar(c, planar(1.0), 2)
        assert [r["id"] for r, _ in found] == [a, b] and found[0][1] == pytest.approx(0.9)
        assert [r["id"] for r in await p.get_recent(c, 5)] == [b, a]
        r = await p.store_relation(a, b, "Supports")
        assert [(x["id"], e["relation_id"]) for x, e in await p.get_related(a)] == [(b, r)]
        i = await p.store_insight(c, "i", [a], embedding=planar(1.0))
        assert [x["id"] for x, _ in await p.get_insights(c, planar(1.0), 3)] == [i]
        p.engine.register_activity("bot", c)
        assert [x["agent_id"] for x in await p.get_activities(c)] == ["bot"]
        context = await p.get_context_candidates(c, planar(1.0), ContextRequest(5, 5))
        assert [x["id"] for x in context["similar"]] == [a, b] and len(context["relations"]) == len(context["insights"]) == len(context["active_agents"]) == 1
        assert [len(await f(c, 9)) for f in (p.list_experiences, p.list_relations, p.list_insights)] == [2, 1, 1]
        assert [x for x, _ in await p.list_cold_experiences(c, 1.0, 9)] and p.engine.close() is None

    asyncio.run(use())

    async def bare():
        m = MemoryProvider()
        assert await m.list_experiences("c", 1) == await m.list_relations("c", 1) == await m.list_insights("c", 1) == []
        for call in (m.reinforce_experience("x"), m.energy("x"), m.list_cold_experiences("c", 0.1, 1)):
            with pytest.raises(MnemoraError):
                await call

    asyncio.run(bare())


def test_bulk_writes(spark, tmp_path):
    e = opened(spark, tmp_path, embedder=HashEmbedder(4))
    c = e.create_collective("one")
    rows = spark.createDataFrame([(c if i % 3 else "none", f"text {i}", None if i % 2 else planar(0.5), 0.5 if i != 7 else 2.0) for i in range(30)], "collective_id string, content string, embedding array<float>, importance double").repartition(3)
    rows = rows.selectExpr("*", "8 AS type_tag", "cast(null as string) AS type_payload", "0.5D AS confidence", "cast(map() as map<string,bigint>) AS applications", "cast(array() as array<string>) AS domain", "cast(array() as array<string>) AS related_files", "'me' AS source_agent", "cast(null as string) AS source_task", "1L AS ts_ms", "1L AS last_reinforced_ms", "false AS archived")
    bad = e.record_experiences(rows).collect()
    assert sorted(v for r in bad for v in r["violations"]) == ["collective_missing"] * 10 + ["importance_range"]
    got = e.table("Experience").collect()
    assert len(got) == 19 and all(len(r["embedding"]) == 4 for r in got) and len({r["id"] for r in got}) == 19
    assert sorted(r["seq"] for r in e.log().collect()) == list(range(1, 21))
    two = sorted(r["id"] for r in got)[:2]
    new = spark.createDataFrame([("r1", two[0], two[1], "Supports"), ("r2", two[0], two[1], "Supports"), ("r3", two[0], two[0], "Supports"), ("r4", two[0], "none", "Implies"), ("r5", two[1], two[0], "Knows")], "id string, source_id string, target_id string, relation_type string").withColumn("strength", F.lit(0.5))
    assert {r["id"]: r["violations"] for r in e.store_relations(new).collect()} == {"r2": ["relation_exists"], "r3": ["self_relation"], "r4": ["end_missing"], "r5": ["type_unknown"]}
    assert {r["id"] for r in e.store_relations(new.where("id = 'r1'")).collect()} == {"r1"} and ids(e.table("Relation")) == ["r1"]
    assert e.delete_relations(new) == 1 and e.table("Relation").count() == 0
    ins = spark.createDataFrame([("i1", c, [two[0]]), ("i2", c, ["none"]), ("i3", "none", [two[0]])], "id string, collective_id string, source_experience_ids array<string>").selectExpr("*", "'text' AS content", "array(1.0F, 0F, 0F, 0F) AS embedding", "'Pattern' AS insight_type", "0.5D AS confidence")
    assert {r["id"]: r["violations"] for r in e.store_insights(ins).collect()} == {"i2": ["source_wrong"], "i3": ["collective_missing", "source_wrong"]}
    poller, seen = ChangePoller().with_batch_limit(7), []
    while page := poller.poll_sync_events(e):
        seen += [r["seq"] for r in page]
    assert seen == sorted(seen) and len(seen) == len(set(seen)) == e.get_current_sequence()


def test_bulk_relations_replace_none(spark, tmp_path):
    e = opened(spark, tmp_path)
    c = e.create_collective("one")
    x, y = (e.record_experience(c, t, planar(0.5)) for t in "xy")
    rows = lambda *r: spark.createDataFrame([(i, *((x, y) if d else (y, x)), t, 0.5) for i, d, t in r], "id string, source_id string, target_id string, relation_type string, strength double")
    kinds = lambda: {r["id"]: (r["source_id"], r["relation_type"]) for r in e.table("Relation").collect()}
    assert e.store_relations(rows(("r1", True, "Supports"))).isEmpty()
    bad = e.store_relations(rows(("r1", False, "Implies"), ("r2", True, "Implies"), ("r2", True, "RelatedTo"))).collect()
    assert sorted((r["id"], r["relation_type"], *r["violations"]) for r in bad) == [("r1", "Implies", "id_exists"), ("r2", "RelatedTo", "id_exists")]
    assert kinds() == {"r1": (x, "Supports"), "r2": (x, "Implies")} and e.get_current_sequence() == 5
    e.delete_relations(rows(("r1", True, "Supports")))
    assert e.store_relations(rows(("r1", False, "Implies"))).isEmpty() and kinds()["r1"] == (y, "Implies")


@pytest.mark.parametrize("kind", [ExactIndex, ApproximateIndex])
def test_index(spark, tmp_path, kind):
    index = kind(spark, f"file://{tmp_path}/i", 4)
    index.insert("a", planar(0.9))
    index.insert_batch(spark.createDataFrame([("b", planar(0.7)), ("c", planar(0.1)), ("a", planar(0.9))], "id string, embedding array<double>"))
    with pytest.raises(ValidationError):
        index.insert("d", [1.0])
    assert len(index) == index.total_count() == 3 and index.contains("a") and not index.contains("z")
    assert [r["id"] for r in index.search(planar(1.0), 2).collect()] == ["a", "b"] and index.search(planar(1.0), 1).first()["distance"] == pytest.approx(0.1)
    assert [r["id"] for r in index.search_filtered(planar(1.0), 2, F.col("id") != "a").collect()] == ["b", "c"]
    index.delete("a")
    index.delete("nothing")
    assert index.is_deleted("a") and not index.is_deleted("b") and len(index) == 2 and index.total_count() == 3
    assert [r["id"] for r in index.search(planar(1.0), 2).collect()] == ["b", "c"]
    index.save(f"file://{tmp_path}/j")
    other = kind(spark, f"file://{tmp_path}/j", 4)
    assert other.is_deleted("a") and other.active_count() == 2 and ids(other.deleted_ids()) == ["a"]
    other.restore_deleted(spark.createDataFrame([("b",)], "id string"))
    assert [r["id"] for r in other.search(planar(1.0), 2).collect()] == ["c"]
    other.insert("a", planar(1.0))
    assert other.search(planar(1.0), 1).first()["id"] == "a"
    other.remove_files()
    assert len(other) == 0


def test_approximate_recall(spark):
    """Ten neighbours among rows spread around many centres, for every row whose id is divisible by 20."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 24)) * 0.6
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, collective_id long, embedding array<double>").repartition(4).cache()
    q = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    truth = vectors.nearest(q, rows, 10)
    share = vectors.recall_at(vectors.Cells(rows, cell_rows=64).nearest(q, 10, probes=8), truth, "query_id", 10).agg(F.avg("recall"), F.count(F.lit(1))).first()
    assert share[0] >= 0.95 and share[1] == 200
    half = vectors.Cells(rows, cell_rows=64).nearest(q, 10, probes=1).count()
    assert 0 < half <= 2000
    rows.unpersist()


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6))
    x[100:140], x[7] = x[0], 0
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, collective_id long, embedding array<double>").repartition(3)
    q = rows.where("id % 4 = 0 OR id = 7").withColumnRenamed("id", "query_id").unionByName(spark.createDataFrame([(900, 9, [1.0] * 6)], "query_id long, collective_id long, embedding array<double>"))
    table = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in df.collect())
    whole = table(vectors.nearest(q, rows, 5))
    for name, n in (("BROADCAST_NUMBERS", 0), ("QUERY_BLOCK", 7), ("ROW_BLOCK", 11)):
        monkeypatch.setattr(vectors, name, n)
    assert table(vectors.nearest(q, rows, 5)) == whole and len(whole) == 5 * 76


def test_block_products(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    x[7] = 0
    rows = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "id long, collective_id long, embedding array<double>").repartition(3)
    got = {(r["a"], r["b"]): r["similarity"] for r in vectors.block_products(rows, block_rows=8).collect()}
    assert set(got) == {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2}
    for (a, b), s in got.items():
        assert s is None if 7 in (a, b) else s == pytest.approx(x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]))


def test_filters_in_hand_and_as_columns(spark):
    rows = [{"id": i, "archived": i % 5 == 0, "domain": [None, ["x", None], ["y"], []][i % 4], "type_tag": i % 3, "importance": i / 40, "confidence": 1 - i / 40, "ts_ms": i} for i in range(40)]
    df = spark.createDataFrame(rows, "id int, archived boolean, domain array<string>, type_tag int, importance double, confidence double, ts_ms long")
    for f in (SearchFilter(), SearchFilter(exclude_archived=False), SearchFilter(("x", "z")), SearchFilter(()), SearchFilter(types=(1, 2)), SearchFilter(types=()), SearchFilter(min_importance=0.5, min_confidence=0.2), SearchFilter(("y",), (0, 2), 0.1, 0.1, 7)):
        assert sorted(ids(df.where(f.column()))) == [r["id"] for r in rows if f.matches(r)]


def test_embedding_services():
    assert create_embedding_service("hash", dimension=8).dimension() == len(create_embedding_service("hash", dimension=8).embed("a b")) == 8
    assert create_embedding_service(dimension=4).identity().provider == "external"
    with pytest.raises(ConfigError):
        create_embedding_service("other")
    with pytest.raises(ValidationError):
        validate_embedding(create_embedding_service(dimension=4), [1.0])


def test_lock(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    with WriterLock.acquire_exclusive(spark, root) as lock:
        assert WriterLock.is_writer_active(spark, root) and lock.path.startswith(root)
        assert WriterLock.try_exclusive(spark, root) is None
        with pytest.raises(StorageError):
            WriterLock.acquire_shared(spark, root, timeout_s=0.1)
    a, b = (WriterLock.acquire_shared(spark, root) for _ in range(2))
    assert not WriterLock.is_writer_active(spark, root) and WriterLock.try_exclusive(spark, root) is None
    a.release()
    b.release()
    assert WriterLock.try_exclusive(spark, root) is not None
    WriterLock.break_lock(spark, root)
    assert not WriterLock.is_writer_active(spark, root)


def _field(number, wire, payload):
    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if wire == 0:
        return varint(number << 3) + varint(payload)
    payload = payload.encode() if isinstance(payload, str) else payload
    return varint(number << 3 | 2) + varint(len(payload)) + payload


def tiny_onnx(table):
    """A model that looks token vectors up: Gather(table, input_ids)."""
    shape = lambda *names: _field(2, 2, b"".join(_field(1, 2, _field(2, 2, n)) for n in names))
    value = lambda name, kind, *dims: _field(1, 2, name) + _field(2, 2, _field(1, 2, _field(1, 0, kind) + shape(*dims)))
    weights = b"".join(_field(1, 0, d) for d in table.shape) + _field(2, 0, 1) + _field(8, 2, "table") + _field(9, 2, struct.pack(f"<{table.size}f", *table.ravel()))
    node = _field(1, 2, "table") + _field(1, 2, "input_ids") + _field(2, 2, "out") + _field(4, 2, "Gather")
    graph = _field(1, 2, node) + _field(2, 2, "g") + _field(5, 2, weights) + _field(11, 2, value("input_ids", 7, "b", "s")) + _field(12, 2, value("out", 1, "b", "s", "d"))
    return _field(1, 0, 8) + _field(7, 2, graph) + _field(8, 2, _field(2, 0, 13))


def test_onnx_embedder(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = {"[PAD]": 0, "red": 1, "green": 2, "blue": 3}
    t = Tokenizer(models.WordLevel(words, unk_token="[PAD]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(f"{tmp_path}/t.json")
    table = np.array([[9, 9, 9, 9], [1, 0, 0, 0], [0, 2, 0, 0], [0, 0, 0, 4]], np.float32)
    (tmp_path / "m.onnx").write_bytes(tiny_onnx(table))
    own = OnnxEmbedder(f"{tmp_path}/m.onnx", f"{tmp_path}/t.json", 4)
    got = own.embed_batch(["red", "red green", "blue blue red"])  # padded to the longest, and padding doesn't count
    want = [table[1], (table[1] + table[2]) / 2, (2 * table[3] + table[1]) / 3]
    assert np.allclose(got, [v / np.linalg.norm(v) for v in want], atol=1e-6)
    assert own.identity().provider == "onnx" and len(own.embed("red " * 2000)) == 4
    e = opened(spark, tmp_path, "onnx", embedder=own)
    c = e.create_collective("one")
    x = e.record_experience(c, "green")
    assert np.allclose(e.get_experience(x)["embedding"], [0, 1, 0, 0])
