import duckdb
import pandas as pd

import check_sql
from quillstone.llm import rules

from .conftest import HARD


def test_same_as_sql(spark, hard):
    got = rules.assess(hard.where("doc_id is not null and doc_id not in (9)")).toPandas()
    docs = pd.DataFrame([r for r in HARD if r[0] not in (None, 9)], columns=["doc_id", "text"])  # noqa: F841 - read by the SQL
    want = duckdb.sql(rules.sql("docs")).df()
    assert check_sql.canonical(got) == check_sql.canonical(want)


def test_rules_fire(spark):
    texts = {"symbols": "this is ### $$$ %%% and &&& the *** end of it @@@", "capitals": "ALL OF THIS IS SHOUTED AT YOU BY THE WRITER", "variety": "spam " * 50, "repeated_lines": "the same line\n" * 6 + "another line", "some_words": "..."}
    rows = {r["doc_id"]: r["failed"].split(",") for r in rules.assess(spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id string, text string")).collect()}
    assert all(k in rows[k] for k in texts)
    assert rules.assess(spark.createDataFrame([("ok", "A plain sentence about the weather in the north of the country.")], "doc_id string, text string")).first()["kept"]


def test_kept_are_those_assessed_so(hard, none):
    want = sorted(str(r["doc_id"]) for r in rules.assess(hard).where("kept").collect())
    got = rules.kept(hard)
    assert got.columns == hard.columns and sorted(str(r["doc_id"]) for r in got.collect()) == want
    by = {r["doc_id"]: r for r in rules.assess(hard).collect()}
    assert by[3]["failed"] == by[2]["failed"] == "some_words" and not by[3]["kept"] and by[3]["chars"] == 0
    assert rules.assess(none).count() == 0 and rules.kept(none).count() == 0


def test_many_distinct_words(spark):
    """The square of a long text's distinct words is beyond 32 bits."""
    docs = spark.createDataFrame([(1, " ".join(f"the w{k}" for k in range(50_000)))], "doc_id long, text string")
    got = rules.assess(docs).first()
    assert (got["distinct_words"], got["failed"]) == (50_001, "") and rules.kept(docs).count() == 1
    want = _connected(docs).sql(rules.sql("docs")).df()
    assert check_sql.canonical(rules.assess(docs).toPandas()) == check_sql.canonical(want)


def _connected(docs):
    con = duckdb.connect()
    con.register("docs", docs.toPandas())
    return con
