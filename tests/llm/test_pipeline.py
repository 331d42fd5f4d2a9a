"""The corpus pipeline against its operators done by hand."""

import corpus_pipeline
from mnemora.llm import quality_model, toxicity
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    lexicon = toxicity.fit(docs, labels)
    left = {i: t for i, t in left.items() if lexicon.score(t or "") < 0.5}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:2]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
        if name == "toxicity":
            assert {r["doc_id"] for r in now.collect()} == set(left)
            model = quality_model.fit(now, labels)
            left = {i: t for i, t in left.items() if model.score([quality_model.statistics(t or "")])[0] >= 0.3}
    assert {r["doc_id"] for r in now.collect()} == set(left)
    sets = {}
    for i, t in left.items():
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = brute_components(sets)
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in out.collect()} == {i for i in root if root[i] == i}
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
