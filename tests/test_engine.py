import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemora.errors import ConfigError, NotFoundError, ReadOnlyError, ValidationError
from mnemora.functions import scoring, vectors
from mnemora.functions.embedding import ExternalEmbedder, HashEmbedder
from mnemora.operators import log as L, recall
from mnemora.operators.context import ContextRequest
from mnemora.operators.filters import SearchFilter, WatchFilter, overlap
from mnemora.sources.replicate import InMemorySyncTransport, SyncConfig, SyncManager, SyncServer
from mnemora.sources.store import ChangePoller, Engine, new_id, upgrade_v2
from mnemora.streaming import watch

DAY = 86_400_000


class Clock:
    def __init__(self):
        self.now = 1_700_000_000_000

    def __call__(self):
        self.now += 1
        return self.now


def planar(c):
    return [float(c), math.sqrt(1 - c * c), 0.0, 0.0]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/a", dimension=4, clock=Clock())


def ids(df):
    return [r["id"] for r in df.collect()]


def test_search_filters_and_lifecycle(engine):
    c = engine.create_collective("one", "me")
    a = engine.record_experience(c, "a", planar(0.9), importance=0.9, domain=["x"])
    b = engine.record_experience(c, "b", planar(0.7), importance=0.2, type_tag=2)
    other = engine.create_collective("two")
    engine.record_experience(other, "z", planar(1.0))
    assert ids(engine.search_similar(c, planar(1.0), 5)) == [a, b]
    assert ids(engine.search_similar(c, planar(1.0), 5, SearchFilter(min_importance=0.5))) == [a]
    assert ids(engine.search_similar(c, planar(1.0), 5, SearchFilter(domains=()))) == []
    assert ids(engine.search_similar(c, planar(1.0), 5, SearchFilter(types=(2,)))) == [b]
    engine.archive_experience(a)
    assert ids(engine.search_similar(c, planar(1.0), 5)) == [b]
    engine.unarchive_experience(a)
    assert ids(engine.get_recent_experiences(c, 5)) == [b, a]
    assert engine.get_collective_stats(c)["experience_count"] == 2
    assert [r["name"] for r in engine.list_collectives_by_owner("me").collect()] == ["one"]
    assert engine.get_or_create_collective("one") == c
    engine.delete_collective(c)
    assert engine.get_collective(c) is None and engine.get_experience(a) is None
    with pytest.raises(NotFoundError):
        engine.get_recent_experiences(c, 5)


def test_validation(engine):
    c = engine.create_collective("one")
    for k in (0, 1001):
        with pytest.raises(ValidationError):
            engine.search_similar(c, planar(1.0), k)
    with pytest.raises(ValidationError):
        engine.search_similar(c, [1.0], 3)
    with pytest.raises(ValidationError):
        engine.record_experience(c, "", planar(1))
    with pytest.raises(ValidationError):
        engine.record_experience(c, "x", planar(1), importance=1.1)
    with pytest.raises(ValidationError):
        engine.record_experience(c, "x", planar(1), domain=["t" * 101])
    with pytest.raises(ValidationError):
        engine.create_collective("  ")
    with pytest.raises(NotFoundError):
        engine.record_experience("none", "x", planar(1))


def test_stale_against_fresh(engine):
    c = engine.create_collective("one")
    old = engine.record_experience(c, "old", planar(0.9), importance=0.9)
    engine.clock.now += 365 * DAY
    new = engine.record_experience(c, "new", planar(0.7), importance=0.7)
    assert engine.reinforce_experience(new) == 1
    assert ids(engine.search(c, planar(1.0), 2)) == [old, new]
    for w in ((0.6, 0.4), (0.7, 0.3), (0.5, 0.5)):
        assert ids(engine.search(c, planar(1.0), 2, weights=w)) == [new, old]
    assert engine.energy(old) < 0.001 and engine.energy(new) > 0.8
    assert ids(engine.list_cold_experiences(c, 0.05, 10)) == [old]
    with pytest.raises(ValidationError):
        engine.search(c, planar(1.0), 2, weights=(0.9, 0.9))


def test_graph_insights_context(engine):
    c = engine.create_collective("one")
    a, b = engine.record_experience(c, "a", planar(0.9)), engine.record_experience(c, "b", planar(0.8))
    r = engine.store_relation(a, b, "Supports", 0.5)
    for bad in ((a, a), (a, b)):
        with pytest.raises(ValidationError):
            engine.store_relation(*bad, "Supports")
    assert ids(engine.get_related_experiences(a, "Outgoing")) == [b] and ids(engine.get_related_experiences(b, "Incoming")) == [a]
    assert ids(engine.get_related_experiences(a, "Both", "Implies")) == []
    i = engine.store_insight(c, "both", [a, b], planar(1.0))
    with pytest.raises(NotFoundError):
        engine.store_insight(c, "none", ["missing"], planar(1.0))
    with pytest.raises(ValidationError):
        engine.store_insight(c, "none", [], planar(1.0))
    engine.register_activity("bot", c)
    got = engine.get_context_candidates(c, planar(1.0), ContextRequest(5, 5))
    assert (ids(got.similar), ids(got.relations), ids(got.insights)) == ([a, b], [r], [i]) and got.active_agents.count() == 1
    engine.clock.now += 301_000
    assert engine.get_active_agents(c).count() == 0
    engine.update_heartbeat("bot", c)
    assert engine.get_active_agents(c).count() == 1
    engine.end_activity("bot", c)
    with pytest.raises(NotFoundError):
        engine.update_heartbeat("bot", c)
    engine.delete_experience(a)
    assert engine.get_relation(r) is None
    engine.delete_insight(i)
    assert engine.list_insights(c, 5).count() == 0


def test_log_polling_watch_compaction(engine, spark, tmp_path):
    c = engine.create_collective("one")
    a = engine.record_experience(c, "a", planar(0.9), importance=0.9, domain=["x"])
    b = engine.record_experience(c, "b", planar(0.8), importance=0.1)
    engine.update_experience(a, importance=0.8)
    engine.archive_experience(b)
    engine.delete_experience(b)
    p = ChangePoller().with_batch_limit(3)
    seen = []
    while rows := p.poll(engine):
        seen += [r["event_type"] for r in rows]
    assert seen == ["Created", "Created", "Updated", "Archived", "Deleted"]
    seqs = [r["seq"] for r in engine.log().orderBy("seq").collect()]
    assert seqs == list(range(1, len(seqs) + 1)) and engine.get_current_sequence() == seqs[-1]
    got = []
    for _ in range(2):  # the second run goes on from the checkpoint: nothing is new
        q = watch.start(engine.watch_experiences(c, WatchFilter(min_importance=0.5)), lambda df, _: got.extend(df.collect()), f"file://{tmp_path}/cp")
        q.awaitTermination()
    assert sorted(r["event_type"] for r in got) == ["Created", "Deleted", "Updated"]
    assert engine.compact_wal() == 0
    engine.save_cursor("p", "push", engine.get_current_sequence())
    assert engine.compact_wal() > 0 and engine.compact_wal() == 0
    assert engine.get_experience(a)["importance"] == 0.8 and engine.get_experience(b) is None


def test_read_only_and_identity(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    Engine(spark, root, embedder=HashEmbedder(8)).create_collective("c")
    ro = Engine(spark, root, embedder=HashEmbedder(8), read_only=True)
    assert ro.is_read_only() and ro.list_collectives().count() == 1
    for f in (lambda: ro.create_collective("x"), lambda: ro.register_activity("a", "c"), lambda: ro.end_activity("a", "c")):
        with pytest.raises(ReadOnlyError):
            f()
    with pytest.raises(ConfigError):
        Engine(spark, root, embedder=HashEmbedder(16))
    with pytest.raises(Exception):
        ExternalEmbedder(4).embed("x")


def test_replication(spark, tmp_path):
    clock = Clock()
    a, b = (Engine(spark, f"file://{tmp_path}/{n}", dimension=4, clock=clock, instance_id=n) for n in "ab")
    c = a.create_collective("one")
    x = a.record_experience(c, "x", planar(0.9))
    m = SyncManager(a, InMemorySyncTransport(SyncServer(b)), SyncConfig())
    m.sync_once()
    assert b.get_experience(x)["content"] == "x"
    a.reinforce_experience(x)
    b.reinforce_experience(x)
    b.reinforce_experience(x)
    for _ in range(2):
        m.sync_once()
    assert a.get_experience(x)["applications"] == b.get_experience(x)["applications"] == {"a": 1, "b": 2}
    n = a.get_current_sequence(), b.get_current_sequence()
    m.sync_once()
    assert a.get_experience(x)["applications"] == {"a": 1, "b": 2} and b.get_current_sequence() == n[1]  # nothing echoes
    fresh = Engine(spark, f"file://{tmp_path}/c", dimension=4, clock=clock, instance_id="c")
    steps = []
    SyncManager(fresh, InMemorySyncTransport(SyncServer(a, SyncConfig(batch_size=2)))).initial_sync(lambda *s: steps.append(s))
    assert fresh.get_experience(x) is not None and steps
    assert [SyncConfig().backoff(k) for k in (1, 2, 7, 8)] == [500, 1000, 30000, 30000]


def test_batch_and_upgrade(engine, spark):
    c = engine.create_collective("one")
    from mnemora.schemas import EXPERIENCE

    row = lambda i, v: (i, c, "t", v, 8, None, 0.5, 0.5, {}, [], [], "ag", None, 1, 1, False)
    bad = engine.record_experiences(spark.createDataFrame([row("e1", planar(1)), row("e2", [1.0]), row("e3", planar(0.5))], EXPERIENCE))
    assert [(r["id"], r["violations"]) for r in bad.collect()] == [("e2", ["dimension_mismatch"])]
    assert sorted(ids(engine.list_experiences(c, 9))) == ["e1", "e3"] and engine.list_experiences(c, 0).count() == 0
    up = upgrade_v2(spark.createDataFrame([("a", 3, 7)], "id string, applications int, ts_ms long")).first()
    assert list(up["applications"].values()) == [3] and up["last_reinforced_ms"] == 7
    assert len({new_id() for _ in range(1000)}) == 1000


def test_nearest_agrees_with_join(spark):
    import random

    random.seed(2)
    rows = spark.createDataFrame([(i, i % 3, [random.gauss(0, 1) for _ in range(8)]) for i in range(300)], "id long, collective_id long, embedding array<double>")
    q = rows.where("id < 30").withColumnRenamed("id", "query_id")
    exact = {(r["query_id"], r["id"]) for r in recall.batch_top(rows, q, 5).collect()}
    assert {(r["query_id"], r["id"]) for r in vectors.nearest(q, rows, 5).collect()} == exact
    lsh = {(r["query_id"], r["id"]) for r in vectors.lsh_candidates(q, rows, 5, tables=12, bucket=2.0).collect()}
    assert len(lsh & exact) >= 0.95 * len(exact)


def test_nearest_breaks_ties_by_id(spark):
    x = [0.1, 0.7, 0.3]
    copies = [(i, 1, x) for i in range(200, 0, -1)] + [(0, 1, [0.0, 0.0, 0.0]), (201, 1, [1.0, 0.0, 0.0])]
    rows = spark.createDataFrame(copies, "id long, collective_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(7, 1, x), (8, 1, [0.0, 0.0, 0.0])], "query_id long, collective_id long, embedding array<double>")
    table = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in df.collect())
    got = table(vectors.nearest(q, rows, 5))
    assert [r[2] for r in got] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4]
    assert got == table(recall.batch_top(rows, q, 5))


def test_nulls_and_latest(spark):
    df = spark.createDataFrame([(1, [None, "a"]), (2, None), (3, ["b"])], "id int, domain array<string>")
    assert ids(df.where(overlap(F.col("domain"), ["b"]))) == [3]
    log = spark.createDataFrame([(1, "e", "Created"), (2, "e", "Deleted"), (3, "f", "Created")], "seq int, entity_id string, event_type string").withColumn("o", F.col("seq"))
    assert [r["entity_id"] for r in L.current(log, ["entity_id"], "o").collect()] == ["f"]


def energy_of(spark, rows):
    df = spark.createDataFrame(rows, "k int, i double, n long, last long, now long")
    return [r[1] for r in df.select("k", scoring.energy(F.col("i"), F.col("n"), F.col("last"), F.col("now"), 1209600.0, 0.3)).orderBy("k").collect()]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(-4, 4), st.integers(0, 2**32 - 1), st.integers(0, 180 * DAY)), min_size=1, max_size=30))
def test_energy_properties(spark, cases):
    base = energy_of(spark, [(k, i, n, 0, t) for k, (i, n, t) in enumerate(cases)])
    later = energy_of(spark, [(k, i, n, 0, t + DAY) for k, (i, n, t) in enumerate(cases)])
    used = energy_of(spark, [(k, abs(i), n + 1, 0, t) for k, (i, n, t) in enumerate(cases)])
    before = energy_of(spark, [(k, abs(i), n, 0, t) for k, (i, n, t) in enumerate(cases)])
    assert all(0 <= e <= 1 for e in base) and all(a >= b for a, b in zip(base, later)) and all(b >= a - 1e-12 for a, b in zip(before, used))
    assert energy_of(spark, [(0, 0.42, 0, 5, 1)]) == pytest.approx([0.42])  # a time in the future counts as now
