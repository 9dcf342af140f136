import pytest

from quillstone.functions.codecs import codec
from quillstone.operators import compare, graph, migrate, relate, select, validate
from quillstone.schema import Attribute, Catalog, Model, Relation, SchemaError


def family():
    key = {"primary": True, "unique": True}
    return Catalog({
        "Parent": Model("Parent", {"id": Attribute("id", codec("Slug"), **key), "age": Attribute("age", codec("PositiveInteger"))}),
        "Child": Model("Child", {"id": Attribute("id", codec("Slug"), **key)}, {"parent": Relation("parent", "N-1", "Parent", "children", 1, None, 1, 2)}),
    }).inherit()


def found(df):
    return [(r["model"], r["pk"], r["attr"], r["value"]) for r in df.collect()]


def test_validate_everything(spark):
    parents = spark.createDataFrame([("a", "30"), ("b", "-1"), ("b", "x"), ("d", "")], "id string, age string")
    children = spark.createDataFrame([("k1", "a"), ("k2", "a"), ("k3", "a"), ("k4", "zz"), ("k5", None)], "id string, parent string")
    got = found(validate.validate({"Parent": parents, "Child": children}, family(), text=True))
    assert sorted(got, key=str) == sorted([
        ("Parent", "b", "age", "x"), ("Parent", "b", "age", "-1"), ("Parent", None, "id", "b"), ("Child", "k4", "parent", "zz"), ("Child", "k5", "parent", "0"),
        ("Parent", "a", "children", "3"), ("Parent", "b", "children", "0"), ("Parent", "b", "children", "0"), ("Parent", "d", "children", "0"),
    ], key=str)


def test_valid_data_has_no_violations(spark):
    parents = spark.createDataFrame([("a", 30)], "id string, age bigint")
    children = spark.createDataFrame([("k", "a")], "id string, parent string")
    assert validate.validate({"Parent": parents, "Child": children}, family()).count() == 0
    assert validate.report(validate.rules(parents, family()["Parent"])) == ""


def test_nulls_count_as_equal(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",)], "v string")
    assert [(r["v"], r["times"]) for r in validate.repeated(df, ["v"]).collect()] == [(None, 2)]
    assert validate.repeated_texts(spark.createDataFrame([("x",), ("x",), ("y",)], "v string"), "v").collect()[0]["times"] == 2


def test_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k int, v string")
    assert select.one(df, v=None)["k"] == 3 and select.one(df, v="z") is None
    with pytest.raises(select.SeveralMatches):
        select.one(df, v="a")
    with pytest.raises(KeyError):
        select.where(df, nothing=1)
    assert select.only_matches(df, ["v"]).count() == 0  # a null key matches nothing


def test_paths(spark):
    parents = spark.createDataFrame([("a", 30)], "id string, age bigint")
    children = spark.createDataFrame([("k", "a"), ("l", None)], "id string, parent string")
    data = {"Parent": parents, "Child": children}
    assert sorted((r["pk"], r["value"]) for r in select.follow(data, family(), "Child", ["parent", "age"]).where("value is not null").collect()) == [("k", 30)]
    assert [(r["pk"], r["value"]) for r in select.follow(data, family(), "Parent", ["children"]).collect()] == [("a", "k")]
    with pytest.raises(SchemaError):
        select.follow(data, family(), "Parent", ["nothing"])


def test_link_does_not_repeat_rows(spark):
    left = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "k int, r string")
    right = spark.createDataFrame([("a",), ("a",)], "id string")
    assert sorted((r["k"], r["found"]) for r in relate.link(left, "r", right, "id").collect()) == [(1, True), (2, False), (3, None)]


def test_assign(spark):
    e = spark.createDataFrame([("a", "x"), ("b", "y")], "src_pk string, dst_pk string")
    new = spark.createDataFrame([("a", "y")], "src_pk string, dst_pk string")
    pairs = lambda kind: sorted(map(tuple, relate.assign(e, new, kind).collect()))
    assert pairs("1-1") == [("a", "y")]
    assert pairs("N-1") == [("a", "y"), ("b", "y")]
    assert pairs("1-N") == [("a", "x"), ("a", "y")]
    assert len(pairs("N-M")) == 3


def test_diff_and_equal(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", float("nan")), (3, None, 0.0)], "k int, s string, f double")
    b = spark.createDataFrame([(1, "x", 1.001), (2, "z", float("nan")), (4, None, 0.0)], "k int, s string, f double")
    got = sorted((r["k"], r["status"], r["attr"]) for r in compare.diff(a, b, ["k"], 0.01).collect())
    assert got == [(2, "changed", "s"), (3, "left_only", ""), (4, "right_only", "")]
    assert compare.is_equal(a, a, ["k"]) and not compare.is_equal(a, b, ["k"])


def test_merge(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "p")], "k int, s string, r string")
    b = spark.createDataFrame([(1, "x", "q"), (3, "z", None)], "k int, s string, r string")
    assert sorted(map(tuple, compare.merge(a, b, ["k"], ["r"]).collect())) == [(1, "x", "q"), (2, "y", "p"), (3, "z", None)]
    with pytest.raises(compare.MergeConflict):
        compare.merge(a, spark.createDataFrame([(2, "other", "p")], "k int, s string, r string"), ["k"], ["r"])
    assert compare.merge_conflicts(a, b, ["k"], append=True).count() == 1
    e = spark.createDataFrame([("p", "c")], "src_pk string, dst_pk string")
    with pytest.raises(compare.MergeConflict):
        compare.merge_edges(e, spark.createDataFrame([("q", "c")], "src_pk string, dst_pk string"), one_parent=True)


def test_closure_of_a_cycle(spark):
    e = spark.createDataFrame([(1, "n", 2), (2, "n", 3), (3, "n", 1), (4, "n", 5), (9, "n", 9)], "src int, attr string, dst int")
    start = lambda *n: spark.createDataFrame([(x,) for x in n], "node int")
    nodes = lambda df: sorted(r["node"] for r in df.collect())
    assert nodes(graph.closure(e, start(1))) == [1, 2, 3]
    assert nodes(graph.closure(e, start(4))) == [5]
    assert nodes(graph.closure(e, start(5))) == []
    assert nodes(graph.closure(e, start(5), both=True)) == [4, 5]
    assert nodes(graph.children(e, start(1), recursive=False)) == [2]
    assert sorted(map(tuple, graph.cut(e, start(1, 2)).select("src", "dst").collect())) == [(1, 2)]
    assert {tuple(r) for r in graph.split(e, start(4))[1].collect()} == {(4, 4, "n", 5)}


def test_migration_inconsistencies():
    old = family()
    new = Catalog({"Parent": Model("Parent", {"id": Attribute("id", codec("Integer"), primary=True)})})
    with pytest.raises(SchemaError, match="type changes"):
        migrate.plan(old, new, migrate.Changes())
    with pytest.raises(SchemaError, match="isn't in the new schema"):
        migrate.plan(old, new, migrate.Changes([("Parent", "Gone")]))


def test_migrate(spark):
    old = family()
    new = Catalog({"Person": Model("Person", {"name": Attribute("name", codec("Slug"), primary=True), "age": Attribute("age", codec("PositiveInteger")), "tag": Attribute("tag", codec("String", default="t"))})})
    changes = migrate.Changes([("Parent", "Person")], [(("Parent", "id"), ("Person", "name"))])
    out = migrate.migrate({"Parent": spark.createDataFrame([("a", 3)], "id string, age bigint")}, old, new, changes)
    assert [tuple(r) for r in out["Person"].collect()] == [("a", 3, "t")]


def test_errors_of_what_is_related(spark):
    parents = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, age string")
    children = spark.createDataFrame([("k", "a")], "id string, parent string")
    start = spark.createDataFrame([("Child", "k")], "type string, pk string")
    tables = {"Parent": parents, "Child": children}
    assert found(graph.related_errors(tables, family(), start, text=True)) == [("Parent", "a", "age", "x")]
    rows = {r["pk"]: r["json"] for r in graph.objects(tables, family()).collect()}
    assert rows["k"] == '{"__type":"Child","__id":"Child:k","id":"k","parent":{"__type":"Parent","__id":"Parent:a"}}'


def test_objects_with_lists(spark):
    c = Catalog({
        "P": Model("P", {"id": Attribute("id", codec("Slug"), primary=True, unique=True)}),
        "C": Model("C", {"id": Attribute("id", codec("Slug"), primary=True, unique=True)}, {"ps": Relation("ps", "N-M", "P", "cs")}),
    })
    df = spark.createDataFrame([("k", "a, b"), ("l", None)], "id string, ps string")
    rows = {r["pk"]: r["json"] for r in graph.objects({"C": df}, c).collect()}
    assert rows["k"] == '{"__type":"C","__id":"C:k","id":"k","ps":[{"__type":"P","__id":"P:a"},{"__type":"P","__id":"P:b"}]}'
    assert sorted((r["src_pk"], r["dst_pk"]) for r in relate.all_edges({"C": df}, c).collect()) == [("k", "a"), ("k", "b")]


def test_closure_of_many_rounds(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)], "src int, dst int")
    got = graph.closure(e, spark.createDataFrame([(0,)], "node int"))
    assert sorted(r["node"] for r in got.collect()) == list(range(1, 21))


def test_tasks_of_validation_are_bounded(spark, monkeypatch):
    """Few rows in a task whatever the table's size and the settings; the same violations."""
    from quillstone.operators import validate
    from quillstone.plans.catalog import catalog

    n = 3000
    customers = spark.range(n).selectExpr("id % 2990 AS c_custkey", "'Customer' AS c_name", "CAST(id - 10 AS double) AS c_acctbal", "'BUILDING' AS c_mktsegment", "CAST(nullif(id % 7, 6) AS long) AS c_nationkey")
    orders = spark.range(n).selectExpr("id AS o_orderkey", "'F' AS o_orderstatus", "1.0D AS o_totalprice", "TIMESTAMP '2000-01-01' AS o_orderdate", "'2-HIGH' AS o_orderpriority", "id + 100 AS o_custkey")
    nations = spark.range(5).selectExpr("id AS n_nationkey", "concat('n', id) AS n_name", "id AS n_regionkey")
    data = {"customer": customers, "orders": orders, "nation": nations}
    seen = []
    for rows in (1 << 40, 200):
        monkeypatch.setattr(validate, "ROWS", rows, raising=False)
        monkeypatch.setattr(validate, "KEYS", 10, raising=False)
        seen.append(sorted(map(str, validate.validate(data, catalog()).collect())))
        once = validate.repeated(customers, ["c_custkey"])
    assert seen[0] == seen[1] and len(seen[0]) > 500
    assert validate._spread(orders, ["o_orderkey"], n).rdd.getNumPartitions() == 15
    lost = validate.foreign_keys(orders, "o_custkey", customers, "c_custkey")
    for df in (once, lost, validate.cardinality(customers, "c_custkey", orders, "o_custkey", 1)):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString() and df.count() > 0
