import itertools
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.llm import packing

from .conftest import HARD

SF = "/root/testdata/sf0.001"


def padding(lengths, counts, tops):
    return sum(c * (min(t for t in tops if t >= n) - n) for n, c in zip(lengths, counts))


@pytest.mark.parametrize("seed", range(12))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 200), rng.randint(1, 11)))
    counts = [rng.randint(1, 30) for _ in lengths]
    for k in (1, 2, 3, 4):
        tops = packing.bounds(lengths, counts, k)
        best = min(padding(lengths, counts, (*c, lengths[-1])) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
        assert len(tops) <= k and tops[-1] == lengths[-1] and padding(lengths, counts, tops) == best


def test_batches(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(["w"] * rng.randint(0, 60))) for i in range(400)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), length=F.size(F.filter(F.split("text", " "), lambda w: w != "")), buckets=4, budget=100).collect()
    assert len(rows) == 400
    batches = {}
    for r in rows:
        assert r["length"] == len(dict(docs)[r["doc_id"]].split())
        if r["length"]:
            assert r["length"] <= r["bound"]
            batches.setdefault((r["bucket"], r["batch"]), []).append(r)
        else:
            assert r["bucket"] is None and r["batch"] is None
    for b in batches.values():
        assert len(b) * b[0]["bound"] <= max(100, b[0]["bound"]) and sorted(r["place"] for r in b) == list(range(len(b)))
    for k in range(4):  # every batch of a bucket but the last is full
        sizes = [len(b) for (bucket, _), b in sorted(batches.items()) if bucket == k]
        assert len(set(sizes[:-1])) <= 1


def test_hard_rows(hard, none):
    rows = packing.pack(hard).collect()
    assert len(rows) == len(HARD)
    assert all((r["bucket"] is None) == (r["length"] == 0) for r in rows) and {r["doc_id"]: r["length"] for r in rows if r["doc_id"] in (2, 3, 5)} == {2: 0, 3: 0, 5: 4}
    assert max(r["length"] for r in rows) == 160_001
    kept = packing.pack(hard, keep=True)
    assert set(hard.columns) - {"length", "bucket", "bound", "batch", "place"} | {"length_", "bucket_", "bound_", "batch_", "place_"} < set(kept.columns) and len(kept.columns) == len(hard.columns) + 5
    assert sorted(str((r["doc_id"], r["text"], r["length_"], r["length"])) for r in kept.collect()) == sorted(str((r["doc_id"], t, "mine length", r["length"])) for r in rows for i, t in [next(x for x in HARD if x[0] == r["doc_id"])])
    assert packing.pack(none).count() == 0 and packing.bounds([], []) == []


@pytest.mark.skipif(not os.path.exists(f"{SF}/documents.parquet"), reason="the driver's tables aren't here")
def test_same_as_sql_over_the_same_lengths(spark):
    """The query against the packing of the same token counts in SQL; those are checked against the library elsewhere."""
    import duckdb

    import check_sql
    from quillstone.llm import counts, queries

    lengths = counts.count_tokens(spark.read.parquet(f"{SF}/documents.parquet")).selectExpr("doc_id", "cast(coalesce(n_tokens, 0) AS int) AS length").toPandas()
    assert len(lengths) > 100
    want = duckdb.sql(packing.sql("lengths")).df()
    assert check_sql.canonical(queries.QUERIES["op4_packing"](spark, SF).toPandas()) == check_sql.canonical(want)


def test_hot_lengths_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 50)
    docs = spark.createDataFrame([(i, 7 if i % 3 else 3 + i % 5) for i in range(600)], "doc_id long, n int")
    rows = packing.pack(docs, length=F.col("n"), buckets=2, budget=70).collect()
    taken = [(r["bucket"], r["batch"], r["place"]) for r in rows]
    assert len(rows) == len(set(taken)) == 600 and all(r["place"] < 70 // r["bound"] for r in rows)
    assert pd.Series([b for b, *_ in set((r["bucket"], r["batch"]) for r in rows)]).value_counts().sum() <= 600 / (70 // 7) + 2
