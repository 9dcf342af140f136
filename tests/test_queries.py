"""Every registered query of the engine itself against its SQL, on the smallest tables."""

import os

import pytest

import check_sql
from quillstone.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    ok, said = check_sql.compare(spark, name, queries.QUERIES[name], queries.SQL.get(name), SF)
    assert ok, said


def test_graph_queries(spark, tmp_path):
    """Against brute force over a small table: all parts are roots, and all the large ones starts."""
    n = 60
    spark.createDataFrame([(k, k * 7 % 50 + 1) for k in range(1, n + 1)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    up = {(k, "up", k * 3) for k in range(1, n // 3 + 1)}
    edges = up | {(k, "down", k // 2) for k in range(4, n + 1, 4)}
    large = {k for k in range(1, n + 1) if k * 7 % 50 + 1 > 40}

    def reach(start, links):
        seen, todo = set(), list(start)
        while todo:
            near = {d for s, _, d in links if s == todo[-1]} - seen
            todo.pop()
            seen |= near
            todo += near
        return seen

    under = {k: reach({k}, up) for k in range(1, n + 1)}
    kept = large | reach(large, up)
    want = {
        "related_closure": {(k,) for k in reach(large, edges)}, "children_recursive": {(k, d) for k in under for d in under[k]}, "cut_children": {e for e in edges if e[0] in kept and e[2] in kept},
        "split_graphs": {(k, *e) for k in under for e in edges if {e[0], e[2]} <= under[k] | {k}},
        "reachable_units": {(("mm", "g", "s")[(k * 7 % 50 + 1) % 3],) for k in reach(large, edges)},
    }
    for name, rows in want.items():
        assert sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(rows), name


def test_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from quillstone.functions.codecs import codec
    from quillstone.schema import Attribute, Model
    from quillstone.streaming import validate

    spark.createDataFrame([(1, "a"), (2, "zz"), (2, "zz")], "k int, v string").withColumn("ts", F.lit("2020-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, v string, ts timestamp").parquet(str(tmp_path / "in"))
    model = Model("m", {"v": Attribute("v", codec("Enum", choices=["a", "b"]))})
    for name, df, rows in (("r", validate.stream_rules(stream, model), 2), ("f", validate.first_seen(stream, "k", "ts"), 2), ("s", validate.stream_references(stream, "v", spark.createDataFrame([("a",)], "id string"), "id", "m"), 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == rows
