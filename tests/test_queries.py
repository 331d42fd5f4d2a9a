"""Every query of the engine's own against its SQL."""

import math

import duckdb
import pytest

from mnemora.operators import log as L
from mnemora.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df, rel = core.queries()[name](spark, SF), duck.sql(core.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    table = lambda cols, rows: sorted((tuple(norm(r[i]) for i in sorted(range(len(cols)), key=lambda i: cols[i])) for r in rows), key=repr)
    assert table(df.columns, df.collect()) == table(rel.columns, rel.fetchall())


def test_new_relations_under_numbers_of_old_ones(spark, tmp_path):
    """As from 100,000 experiences on: the SQL numbers a new relation 100000 + id, which an old one has."""
    for t in set(TABLES) - {"embeddings"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    e.union(e.selectExpr("vec_id + 100000", "embedding", "label")).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet{'/*.parquet' if t == 'embeddings' else ''}'")
    df = core.queries()["after_store_relation"](spark, f"file://{tmp_path}").select("id", "source_id", "target_id")
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(c.sql(f"select id, source_id, target_id from ({core.oracle_sql()['after_store_relation']})").fetchall())
    assert len({r[0] for r in got}) < len(got) == len(set(got))


def test_every_stated_query_is_searched(spark):
    stated = set(range(0, 500, 20))
    for name in ("search_batch_stated", "recall_neighbours"):
        assert {r["query_id"] for r in core.queries()[name](spark, SF).collect()} == stated


def test_whole_log_in_order(spark, monkeypatch):
    monkeypatch.setattr("mnemora.operators.log.RANGE_NUMBERS", 64)
    rows = core.queries()["log_order_whole"](spark, SF).collect()
    assert [(r["seq"], r["place"]) for r in rows] == [(i, i) for i in range(1, 1001)]
    gaps = spark.createDataFrame([(i * i,) for i in range(300, 0, -1)], "seq long")
    assert [(r["seq"], r["place"]) for r in L.numbered(gaps).collect()] == [(i * i, i) for i in range(1, 301)]


def test_relations_of_late_experiences(spark):
    got = {r["id"] for r in core.queries()["distinct_relations_live"](spark, SF).collect()}
    assert got == {i for i in range(500) if i % 11 or (i * 7 + 3) % 500 % 11} and 406 in got


def test_rows_only(spark):
    assert core.queries()["watch_stream"](spark, SF).count() == 5
    assert core.queries()["embed_udf"](spark, SF).count() == 200


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
