"""Odd cases: repeated and null ids, clashing names, wide types, hot keys, pages that are skipped."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemora.llm import bpe, forest, langid, minmax, packing, quality_model, quality_rules, runtime, token_counts, token_store, toxicity
from mnemora.llm.runtime import tokenizer_path
from tests.llm.brute import Forest

JSON, RANKS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")


def plain_links(rows, threshold=0.98):
    """n_links and component of (vec_id, vector, label) rows, each row a vertex that its vec_id names."""
    n, f = [0] * len(rows), Forest()
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(len(rows)):
        f.root(k)
        for j in np.flatnonzero(x @ x[k] >= threshold):
            if j != k and rows[j][2] == rows[k][2]:
                n[k] += 1
                f.join(k, int(j))
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[f.root(k)] = min(least.get(f.root(k), i), i)
    return [(i, n[k], least[f.root(k)]) for k, (i, _, _) in enumerate(rows)]


def test_near_vectors_types_and_ids(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 8))
    x[50:100] = x[:50] + rng.normal(size=(50, 8)) * 0.05
    x[100:] = x[0]
    rows = [(i % 120, v.tolist(), 2**40 + i % 2) for i, v in enumerate(x)]
    want = sorted(plain_links(rows))
    df = spark.createDataFrame([(*r, "c") for r in rows] + [(None, rows[0][1], 2**40, "c")], "vec_id long, embedding array<double>, label long, Label2 string")
    for leaf_rows in (8, 4096):
        got = forest.near_vectors(df, leaf_rows=leaf_rows).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None) == want
        assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, True)]
    words = df.withColumn("label", F.concat(F.lit("x"), F.col("label").cast("string"))).withColumn("embedding", F.col("embedding").cast("array<decimal(38,18)>"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in forest.near_vectors(words.where("vec_id is not null")).collect()) == want


def test_forest_recall_on_large_labels(spark):
    """5,000 vectors a label through several leaves: links of every id divisible by 20 against all rows."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = rng.integers(0, 5000, 5000)
    step = rng.normal(size=(5000, 64))
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    x[5000:] = x[near] + step * rng.uniform(0.02, 0.22, (5000, 1))  # cosines from 0.976 up
    label = np.concatenate([np.arange(5000) % 2, near % 2])
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in forest.near_vectors(df).collect()}
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    true = found = 0
    for i in range(0, 10_000, 20):
        n = int(((y @ y[i] >= 0.98) & (label == label[i])).sum()) - 1
        assert got[i] <= n
        true, found = true + n, found + got[i]
    assert true > 200 and found >= 0.99 * true


def test_large_leaves_split_again_and_dense_ones_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    x[600:] = x[0] + rng.normal(size=(300, 8)) * 1e-4  # no hyperplane parts them
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    want = sorted(plain_links(rows))
    monkeypatch.setattr(forest, "TASK_ROWS", 64)
    placed = forest._leaves(forest._classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))[1], forest.Forest(3, 4, 200, 0.01)).cache()
    leaves = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect()
    assert max(r["count"] for r in leaves) >= 300 and len(leaves) > 50
    got = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), trees=6, leaf_rows=4, sample_rows=200)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == want
    placed.unpersist()


def test_near_documents_with_repeated_ids(spark):
    v = " ".join(f"v{i}" for i in range(40))
    w = " ".join(f"w{i}" for i in range(40))
    rows = [(1, w), (1, v), (3, v + " more"), (4, w), (4, w), (None, v), (None, None), (5, None)]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect())
    assert got == sorted([(1, 39, 1, True), (1, 39, 1, True), (3, 40, 1, False), (4, 39, 1, False), (4, 39, 1, False), (0, 39, 0, True), (0, 0, 0, True), (5, 0, 5, True)])
    left = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([(1, w), (1, v), (3, v + " more"), (7, "a b"), (7, "a b"), (8, None), (8, None)], "doc_id long, text string"), "")
    assert sorted((r["doc_id"], r["text"] or "") for r in left.collect()) == sorted([(1, w), (1, v), (7, "a b"), (8, "")])


def test_short_sets_and_all_pairs(spark):
    """Pairs at the threshold among short texts, which long bands would miss now and then."""
    rng = random.Random(11)
    texts = []
    for k in range(400):
        words = [f"{k}x{i}" for i in range(5)]
        texts += [" ".join(words), " ".join(words + [f"{k}y"])]  # 4 shared of 5 pairs of words
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for deviations in (6.0, None):
        assert minmax.near_duplicates(df, size=2, deviations=deviations).where("kept").count() == 400


def test_hot_keys(spark, monkeypatch):
    """Keys that hold a third of the rows, with the bounds set low enough to take every branch."""
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 2)
    for module in (minmax, token_counts):
        monkeypatch.setattr(module, "BROADCAST_IDS", 2)
    monkeypatch.setattr(minmax, "BLOCK_ROWS", 8)
    monkeypatch.setattr(minmax, "PAIRS_OF_A_PIVOT", 4)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 60
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(60)] = f"v{rng.random()}"
        texts.append(" ".join(w))
    texts += [" ".join(f"u{rng.randrange(99)}" for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    f = Forest()
    for a in range(180):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                f.join(a, b)
    got = {r["doc_id"]: r["component_id"] for r in minmax.near_duplicates(df, size=2).collect()}
    assert got == {i: f.root(i) for i in range(180)}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, JSON).collect()}
    from mnemora.llm.library import encoder

    assert counts == dict(enumerate(encoder(JSON).encode_flat(texts)[1].tolist()))


def test_second_count_comes_from_the_cache(spark, tmp_path, monkeypatch):
    cache = f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b"), (4, "c")], "doc_id long, text string")
    first = sorted(map(tuple, token_counts.count_tokens(df, JSON, cache).collect()))
    spark.createDataFrame([(token_counts.tokenizer_version(JSON), b"other", 5)], token_counts.CACHE).write.mode("append").parquet(cache)
    files = sorted(p.name for p in (tmp_path / "cache").glob("*.parquet"))
    again = sorted(map(tuple, token_counts.count_tokens(df, JSON, cache).collect()))
    assert again == first and sorted(p.name for p in (tmp_path / "cache").glob("*.parquet")) == files  # nothing was encoded
    more = sorted(map(tuple, token_counts.count_tokens(df.unionByName(spark.createDataFrame([(9, "d e f")], df.schema)), JSON, cache).collect()))
    assert more[:-1] == first and spark.read.parquet(cache).count() == 5
    import sentencepiece

    piece = tokenizer_path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=piece)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, piece).collect()} == {1: len(own.encode("a b")), 2: 0, 3: len(own.encode("a b")), 4: len(own.encode("c"))}


def scanned(df):
    """Rows that a plan's scans gave."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_selective_reads_skip_pages(spark, tmp_path, encoding):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(50, 400)))) for i in range(2000)], "doc_id long, text string")
    path = f"file://{tmp_path}/{encoding}"
    token_store.write_store(df, path, JSON, 2, encoding, row_group_bytes=64 << 10, page_bytes=4 << 10, page_rows=50)
    files = list((tmp_path / encoding).glob("*.parquet"))
    groups = [pq.ParquetFile(p).metadata for p in files]
    ids = groups[0].row_group(0).column(groups[0].num_columns - 1)
    assert sum(g.num_row_groups for g in groups) > 2 * len(files) and ids.has_column_index or ids.has_offset_index
    assert ("RLE_DICTIONARY" in ids.encodings or "PLAIN_DICTIONARY" in ids.encodings) == (encoding == "dictionary") and any("DELTA" in e for e in ids.encodings) == (encoding == "delta")
    whole, part = token_store._stored(spark, path).where("doc_id >= 0"), token_store._stored(spark, path).where("doc_id >= 700 AND doc_id <= 705")
    assert scanned(whole) == 2000 and scanned(part) <= 400
    plan = token_store.metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.replace("doc_ids", "")  # counts are read without ids


CLASH = "doc_id long, text string, lang string, Text string, DOC_ID string, Lang int, label int, digest int, key string, cid string, leaves string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, k, "no", "no", 0, 1, 2, "k", "c", "l") for i, t, k in rows], CLASH)


def test_names_that_clash(spark):
    rows = [(i, f"the house number {i % 7} stands by the river and so on", "en") for i in range(30)] + [(30, None, None), (31, "", "en")]
    df = clashing(spark, rows)
    usual = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0, "x") for i in range(30)], "doc_id long, quality int, toxic boolean, Quality string").withColumn("toxic", F.col("toxic").cast("int"))
    plain = labels.toDF("doc_id", "quality", "toxic", "q").drop("q")

    def both(f):
        a, b = (sorted(map(str, f(d, y).collect())) for d, y in ((df, labels), (usual, plain)))
        assert a == b and a

    both(lambda d, _: bpe.roundtrip_digests(d, RANKS))
    both(lambda d, _: token_store.store_and_check(d, JSON))
    both(lambda d, _: langid.predict(d, langid.fit(d)))
    both(lambda d, y: toxicity.score(d, toxicity.fit(d, y)))
    both(lambda d, _: token_counts.count_tokens(d, JSON))
    both(lambda d, y: quality_model.score(d, quality_model.fit(d, y)))
    both(lambda d, _: quality_rules.apply_rules(d))
    both(lambda d, _: minmax.near_duplicates(d))
    both(lambda d, _: packing.pack(d, JSON).select("doc_id", "piece", "length", "ids_crc32"))


def test_learned_operators_without_rows_or_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert langid.predict(none, langid.fit(none)).count() == toxicity.score(none, toxicity.fit(none, labels)).count() == quality_model.score(none, quality_model.fit(none, labels)).count() == 0
    odd = spark.createDataFrame([(None, "the text", "en"), (1, None, None), (2, "x" * 300_000, "en"), (2, "x" * 300_000, "en")], "doc_id long, text string, lang string")
    for f in (lambda d: langid.predict(d, langid.fit(d)), lambda d: toxicity.score(d, toxicity.fit(d, labels)), lambda d: quality_model.score(d, quality_model.fit(d, labels))):
        got = f(odd).collect()
        assert len(got) == 4 and all(r["held_out"] is not None and 0 <= r["score"] <= 1 for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert {r["score"] for r in toxicity.score(odd, toxicity.fit(odd, labels)).collect()} == {0.0}


def tables(spark, tmp_path, docs, labels):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_pipeline_on_odd_tables(spark, tmp_path):
    rng = random.Random(3)
    text = lambda k: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(50)}" for _ in range(k))
    same, long = text(30), text(9000)
    rows = [(1, same), (1, same), (2, same), (3, None), (3, None), (4, ""), (None, text(20)), (None, None), (5, long), (6, long + " end"), (7, text(12))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "X") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, Source2 string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = corpus_pipeline.run(spark, tables(spark, tmp_path / "odd", docs, labels)).collect()
    of = {}
    for r in out:
        of.setdefault(r["doc_id"], set()).add(r["piece"])
    assert set(of) == {1, 3, 4, 5, 7, None} and sum(r["piece"] == 0 for r in out) == 7  # the two without an id both stay
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 2048 and [o for o, _ in sorted(b)] == np.cumsum([0, *[n for _, n in sorted(b)]])[:-1].tolist() for b in bins.values())
    none = corpus_pipeline.run(spark, tables(spark, tmp_path / "none", docs.limit(0), labels))
    assert none.count() == 0 and "sequence_id" in none.columns


def test_pipeline_keeps_every_column(spark, tmp_path):
    rows = [(i, f"text number {i} of a few that differ much {i * 37 % 11} {i * 53 % 13}", "en") for i in range(20)]
    docs, labels = clashing(spark, rows), spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    sf = tables(spark, tmp_path / "l", spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels)
    for _, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and got.count() == 20
    assert corpus_pipeline.pack(spark, docs, sf).count() == 20
