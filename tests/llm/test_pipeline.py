"""The pipeline against its stages done one by one by other means."""

import os

import pytest

import corpus_pipeline
from quillstone.llm import neardup, packing, quality, rules, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near duplicates", "secrets", "packing"]


def test_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in rules.assess(docs).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    field = quality.learned(docs, labels)
    texts = {k: t for k, t in texts.items() if quality.document_scores(field, [t])[0][0] >= quality.THRESHOLD}
    h, n = neardup.distinct(*neardup.shingles(list(texts.values())))
    sig, ids = neardup.signatures(h, n, len(texts)), list(texts)
    sets = [set(h[n == k].tolist()) for k in range(len(texts))]
    group = {k: k for k in ids}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, a in enumerate(ids):
        for j in range(i):
            if len(sets[i] & sets[j]) >= neardup.THRESHOLD * len(sets[i] | sets[j]) and (sig[i].reshape(neardup.BANDS, -1) == sig[j].reshape(neardup.BANDS, -1)).all(axis=1).any():
                x, y = sorted((root(a), root(ids[j])))
                group[y] = x
    left = {k: secrets.redact_text(texts[k]) for k in ids if root(k) == k}
    df = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    columns = ["doc_id", "length", "bucket", "bound", "batch", "place"]
    want = sorted(map(tuple, packing.pack(df).select(columns).collect()))
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select(columns).collect())) == want and len(want) > 100
    assert {r["doc_id"]: r["text"] for r in got.collect()} == left and {"lang", "source", "n_chars"} < set(got.columns)


def test_stages_return_the_columns_of_documents(spark, hard, tmp_path):
    extra = hard
    for d in ("documents", "labels"):
        (extra if d == "documents" else spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int")).write.parquet(f"{tmp_path}/{d}.parquet")
    for start in (extra, extra.limit(0)):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == extra.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
