import math
import random
from collections import Counter

import numpy as np
import pytest

from quillstone.llm import search


def brute(docs, queries, k):
    have = [(i, search.words(t)) for i, t in docs if t is not None]
    n, mean = len(have), max(1e-9, sum(len(w) for _, w in have) / max(1, len(have)))
    df = Counter(w for _, ws in have for w in set(ws))
    out = []
    for q, t in queries:
        best = []
        for i, ws in have:
            tf = Counter(ws)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(search.words(t or "")) if tf[w])
            if any(tf[w] for w in set(search.words(t or ""))):
                best.append((-round(s, 6), i is None, i or 0, i))
        out += [(q, r, b[3], -b[0]) for r, b in enumerate(sorted(best, key=lambda b: b[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(150)] + [(500 + i, "w1 w2 w2") for i in range(15)] + [(None, "w3 w4"), (900, None), (901, "")]
    queries = [(i, text(rng.randint(1, 12))) for i in range(20)] + [(99, ""), (98, None), (97, "unheard of"), (0, text(3))]
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string"), 7)
    want = brute(docs, queries, 7)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert [r[:3] for r in rows] == [w[:3] for w in want] and np.allclose([r[3] for r in rows], [w[3] for w in want], atol=2e-6)


def test_blocks_and_shards_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3}") for i in range(60)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, f"w{i} w1") for i in range(6)], "item_id long, text string")
    want = sorted(map(tuple, search.search(docs, queries, 5).collect()))
    monkeypatch.setattr(search, "QUERY_CHARS", 8)
    assert sorted(map(tuple, search.search(docs, queries, 5).collect())) == want


def test_hard_rows(spark, hard, none):
    q = spark.createDataFrame([(1, "the word"), (2, "same text"), (2, "same text")], "item_id long, text string")
    rows = search.search(hard, q, 3).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in rows if r["item_id"] == 2) == sorted([(1, 7), (2, 7), (3, 8)] * 2)
    assert search.search(none, q).count() == 0 and search.search(hard, q.limit(0)).count() == 0
