import itertools
import os

import numpy as np
import pytest

from quillstone.llm import crf, quality

from .conftest import HARD

SF = "/root/testdata/sf0.01"


def brute(scores, moves):
    n, k = scores.shape
    paths = list(itertools.product(range(k), repeat=n))
    value = [sum(scores[i, p[i]] for i in range(n)) + sum(moves[p[i], p[i + 1]] for i in range(n - 1)) for p in paths]
    weight = np.exp(np.array(value) - max(value))
    marginal = np.array([[sum(w for p, w in zip(paths, weight) if p[i] == y) for y in range(k)] for i in range(n)]) / weight.sum()
    return marginal, list(paths[int(np.argmax(value))]), max(value) + np.log(weight.sum())


def test_messages_against_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 0, 5, 3, 2])
    x = rng.normal(size=(11, 4))
    model = crf.Crf(rng.normal(size=(5, 2)), rng.normal(size=(2, 2)), np.zeros(4), np.ones(4))
    marginals, best = model.marginals(x, lengths), model.viterbi(x, lengths)
    _, _, z = crf.messages(model.scores(x), model.moves, lengths)
    at = 0
    for n, zz in zip(lengths, z):
        if n:
            m, path, total = brute(model.scores(x[at : at + n]), model.moves)
            assert np.allclose(marginals[at : at + n], m) and best[at : at + n].tolist() == path and np.isclose(zz, total)
        at += n


@pytest.fixture(scope="module")
def model(spark):
    good = ["The house is in the valley and it has a garden with many old trees.\nIn the morning the light comes from the east." for _ in range(40)]
    bad = ["$$$ @@@ ### !!! 111\n@@@ @@@ 999 ### ###" for _ in range(40)]
    return quality.fit(good + bad, [1] * 40 + [0] * 40)


def test_hard_rows(model, hard, none):
    rows = quality.classify(hard, model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(HARD) and all((by[k]["quality"], by[k]["lines"], by[k]["kept"]) == (0.0, 0, False) for k in (2, 3, 5)) and by[1]["kept"]
    assert by[11]["lines"] == 4
    kept = quality.kept(hard, model)
    assert kept.columns == hard.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality.classify(none, model).count() == 0 and quality.kept(none, model).count() == 0


def test_scores_do_not_depend_on_the_batch(model):
    texts = [t for _, t in HARD if t and len(t) < 1000]
    together = quality.document_scores(model, texts)[0]
    assert np.allclose(together, [quality.document_scores(model, [t])[0][0] for t in texts])


def test_one_class_only(spark, hard):
    labels = spark.createDataFrame([(1, 1), (7, 1), (None, 0)], "doc_id long, quality int")
    assert quality.classify(hard, quality.learned(hard, labels)).where("lines > 0 and not kept").count() == 0
    assert quality.classify(hard, quality.learned(hard, labels.limit(0))).count() == len(HARD)


def test_what_the_driver_gets_is_bounded(spark, monkeypatch):
    """Repeated ids and long texts don't make the sample larger; at 0.5 GB of texts of 1 MB its collection failed by spark.driver.maxResultSize."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels: seen.append((texts, labels)))
    rows = [(k, "a line of some words\n" * (10 if k % 2 else 20_000)) for k in range(12)]
    docs, labels = spark.createDataFrame(rows * 5 + [(1, None)], "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    quality.learned(docs, labels)
    texts, told = seen.pop()
    assert len(texts) == 12 and max(map(len, texts)) == quality.EXCERPT and all((len(t) < 1000) == bool(k) for t, k in zip(texts, told))
    monkeypatch.setattr(quality, "SAMPLE_COST", 2 * quality.EXCERPT)
    quality.learned(docs, labels)
    texts, told = seen.pop()
    assert told.count(1) == 6 and told.count(0) < 3 and 0 in told


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    field = quality.learned(docs, labels.where("doc_id % 2 = 0"))
    told = quality.classify(docs.join(labels.where("doc_id % 2 = 1"), "doc_id").withColumnRenamed("quality", "truth"), field)
    both = told.join(labels.withColumnRenamed("quality", "truth"), "doc_id").select("truth", "kept").collect()
    assert len(both) > 100 and sum(r["kept"] == bool(r["truth"]) for r in both) >= 0.93 * len(both)
