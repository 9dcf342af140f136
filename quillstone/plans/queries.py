"""One query for each operator over the driver's tables, with the same query in SQL."""

from __future__ import annotations

import csv
import os
import shutil
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.cluster import shared_dir
from quillstone.functions import expressions
from quillstone.functions import text as T
from quillstone.functions.codecs import codec
from quillstone.functions.expressions import coefficients, compile_column, compile_nested, linear_values, parse
from quillstone.operators import compare, graph, migrate, relate, select, validate
from quillstone.plans.catalog import catalog
from quillstone.schema import Attribute, Catalog, Model, compile_table, schema_rows
from quillstone.sources import read as sources
from quillstone.sources import write as writing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- scans, projections, filters, lookups


@query("SELECT attr, message, count(*) AS n FROM (SELECT 'o_orderstatus' AS attr, 'value isn''t one of the choices' AS message FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'o_totalprice', 'value must be at most 400000' FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT 'o_totalprice', 'value must be positive' FROM orders WHERE o_totalprice <= 0 UNION ALL SELECT 'o_orderpriority', 'value isn''t one of the choices' FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')) GROUP BY ALL")
def validate_orders(t):
    """The flagship: all rules of orders in one pass, counted."""
    return validate.rules(t("orders"), catalog()["orders"]).groupBy("attr", "message").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders")
def scan_project(t):
    names = select.attributes(catalog()["orders"], related=False)
    return sources.bulk_columns(t("orders"), catalog()["orders"]).select(*names).withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def filter_attr_vals(t):
    return select.where(t("orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey", "o_custkey")


@query("SELECT 'supplier' AS type, s_suppkey AS key, s_name AS name FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'customer', c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def filter_type_union(t):
    both = select.superclass({"customer": t("customer").selectExpr("c_custkey AS key", "c_name AS name", "c_nationkey AS nation"), "supplier": t("supplier").selectExpr("s_suppkey AS key", "s_name AS name", "s_nationkey AS nation")}, ["key", "name", "nation"])
    return select.where(both, ["supplier", "customer"], nation=3).select(F.col("__type").alias("type"), "key", "name")


@query("SELECT any_value(p_partkey) AS p_partkey, p_brand, p_size FROM part GROUP BY p_brand, p_size HAVING count(*) = 1")
def get_one_unique(t):
    return select.only_matches(t("part"), ["p_brand", "p_size"]).select("p_partkey", "p_brand", "p_size")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)")
def lookup_batch(t):
    keys = t("customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return select.lookup(t("orders"), keys, ["o_custkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey::VARCHAR AS pk, r_name AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def nested_path(t):
    data = {n: t(n) for n in ("orders", "customer", "nation", "region")}
    return select.follow(data, catalog(), "orders", ["o_custkey", "c_nationkey", "n_regionkey", "r_name"]).select(F.col("pk").cast("string").alias("pk"), "value")


@query("SELECT c_custkey AS pk, o_orderkey AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'")
def nested_path_filtered(t):
    return select.follow({"customer": t("customer"), "orders": t("orders")}, catalog(), "customer", [("orders", {"o_orderpriority": "1-URGENT"})])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'balance,' ELSE '' END || CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment,' ELSE '' END AS attrs FROM customer")
def empty_attrs(t):
    rows = t("customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).otherwise(float("nan")).alias("balance"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("segment"))
    return select.empty_attributes(rows, "c_custkey", ["balance", "segment"]).select("c_custkey", F.concat_ws("", F.transform("attrs", lambda x: F.concat(x, F.lit(",")))).alias("attrs"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', '1-URGENT') THEN 'o_orderstatus,' ELSE '' END || CASE WHEN o_orderpriority IN ('F', '1-URGENT') THEN 'o_orderpriority,' ELSE '' END AS attrs FROM orders")
def attrs_by_value(t):
    found = select.attributes_by_value(t("orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"], include=["F", "1-URGENT"])
    return found.select("o_orderkey", F.concat_ws("", F.transform("attrs", lambda x: F.concat(x, F.lit(",")))).alias("attrs"))


@query("SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY regexp_extract(p_brand, '[0-9]+')::INT DESC, p_partkey) - 1 AS position FROM part")
def sort_natural(t):
    rows = t("part").withColumn("n", F.col("p_partkey").cast("string"))
    return select.numbered(rows, ["p_type"], ["-p_brand", "n"]).select("p_partkey", "p_type", "position")


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 0.0 ELSE p_retailprice END AS price FROM part")
def set_value_where(t):
    rows = t("part").select("p_partkey", F.col("p_retailprice").alias("price"), (F.col("p_size") > 40).alias("large"))
    return select.set_where(rows, "price", 0.0, large=True).select("p_partkey", "price")


def _letters_sql(n: str, levels: int = 6) -> str:
    steps = [f"{n} AS n0"] + [f"CASE WHEN n{k} > 0 THEN (n{k} - 1) // 26 ELSE 0 END AS n{k + 1}" for k in range(levels)]
    signs = [f"CASE WHEN n{k} > 0 THEN chr((65 + (n{k} - 1) % 26)::INT) ELSE '' END" for k in range(levels)]
    return f"{', '.join(steps)}, nullif({' || '.join(reversed(signs))}, '') AS letters"


@query(f"SELECT p_partkey, letters FROM (SELECT p_partkey, {_letters_sql('p_partkey')} FROM part)")
def cell_columns(t):
    return t("part").select("p_partkey", T.cell_column(F.col("p_partkey")).alias("letters"))


# -- relations


@query("SELECT c_nationkey AS nation, string_agg(c_custkey::VARCHAR, ', ' ORDER BY c_custkey) AS customers FROM customer GROUP BY c_nationkey")
def reverse_related(t):
    return relate.serialize_related(t("customer"), "c_nationkey", "c_custkey", "customers").withColumnRenamed("c_nationkey", "nation")


@query("SELECT o_orderkey, o_custkey, c_name AS name, c_custkey IS NOT NULL AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def link_many_to_one(t):
    out = relate.link(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", t("customer").where("c_acctbal > 0"), "c_custkey", ["c_name"])
    return out.withColumnRenamed("o_custkey_c_name", "name")


@query("WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), p AS (SELECT p_partkey FROM part WHERE p_size > 20) SELECT l_orderkey, coalesce(string_agg(CASE WHEN p_partkey IS NOT NULL THEN l_partkey::VARCHAR END, ',' ORDER BY l_partkey::VARCHAR), '') AS linked, coalesce(string_agg(CASE WHEN p_partkey IS NULL THEN l_partkey::VARCHAR END, ',' ORDER BY l_partkey::VARCHAR), '') AS missing FROM e LEFT JOIN p ON l_partkey = p_partkey GROUP BY l_orderkey")
def link_to_many_list(t):
    lists = relate.serialize_related(t("lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", "parts")
    out = relate.link_list(lists, "l_orderkey", "parts", t("part").where("p_size > 20"), "p_partkey")
    return out.select("l_orderkey", F.array_join("linked", ",").alias("linked"), F.array_join("missing", ",").alias("missing"))


@query("SELECT 'l_orderkey' AS attr, l_orderkey::VARCHAR AS value, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def foreign_keys(t):
    lost = validate.foreign_keys(t("lineitem"), "l_orderkey", t("orders").where("o_orderstatus = 'F'"), "o_orderkey")
    return lost.groupBy("attr", "value").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_orderkey) < 8 OR count(o_orderkey) > 12")
def cardinality_violations(t):
    return validate.cardinality(t("customer"), "c_custkey", t("orders"), "o_custkey", 8, 12)


@query("SELECT s_nationkey, count(*) AS times, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS keys FROM supplier GROUP BY s_nationkey HAVING count(*) > 1")
def one_to_one_conflicts(t):
    return validate.taken_twice(t("supplier"), "s_suppkey", "s_nationkey").select("s_nationkey", "times", F.array_join("keys", ",").alias("keys"))


@query("WITH m AS (SELECT o_custkey, max(o_orderkey) AS last FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) SELECT o_orderkey AS src_pk, CASE WHEN o_orderkey = last THEN -o_custkey ELSE o_custkey END AS dst_pk FROM orders LEFT JOIN m USING (o_custkey)")
def assign_references(t):
    """Many-to-one references set anew: the latest open order of each customer is moved to another partner."""
    edges = t("orders").select(F.col("o_orderkey").alias("src_pk"), F.col("o_custkey").alias("dst_pk"))
    last = t("orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max("o_orderkey").alias("src_pk"))
    return relate.assign(edges, last.select("src_pk", (-F.col("o_custkey")).alias("dst_pk")), "N-1")


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def related_cells(t):
    """Related rows into a JSON cell and back; equal rows of a cell are one."""
    cells = relate.to_cell(t("lineitem"), "l_orderkey", ["l_linenumber", "l_quantity"])
    return relate.from_cell(cells, "l_orderkey", "cell", "l_linenumber: int, l_quantity: double")


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def related_cells_csv(t):
    cells = relate.to_cell(t("lineitem"), "l_orderkey", ["l_linenumber", "l_quantity"], "csv")
    return relate.from_cell(cells, "l_orderkey", "cell", "l_linenumber: int, l_quantity: double", "csv")


@query("SELECT 'customer' AS src_type, 'c_nationkey' AS attr, 'nation' AS dst_type, c_custkey::VARCHAR AS src_pk, c_nationkey::VARCHAR AS dst_pk FROM customer UNION ALL SELECT 'nation', 'n_regionkey', 'region', n_nationkey::VARCHAR, n_regionkey::VARCHAR FROM nation UNION ALL SELECT 'orders', 'o_custkey', 'customer', o_orderkey::VARCHAR, o_custkey::VARCHAR FROM orders")
def edge_table(t):
    return relate.all_edges({n: t(n) for n in ("region", "nation", "customer", "orders")}, catalog())


@query("SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 4 <> 0 THEN c_nationkey END, 7) AS nation FROM customer")
def default_references(t):
    rows = t("customer").select("c_custkey", F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey")).alias("nation"))
    return relate.with_default(rows, "nation", 7)


@query("SELECT dst AS src_pk, src AS dst_pk FROM (SELECT o_orderkey::VARCHAR AS src, o_custkey::VARCHAR AS dst FROM orders)")
def inverse_edges(t):
    return relate.inverse(relate.edges(t("orders"), "orders", "o_orderkey", "o_custkey", "customer"), "orders").select("src_pk", "dst_pk")


def _part_sets(t):
    rows = t("lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    part = lambda flag, name: F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_partkey")))).alias(name)
    return rows.groupBy("l_suppkey").agg(part("A", "a"), part("R", "b"))


def _set_sql(op: str) -> str:
    a, b = (f"(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = '{f}')" for f in "AR")
    return {"union": f"SELECT * FROM {a} UNION SELECT * FROM {b}", "intersection": f"SELECT * FROM {a} INTERSECT SELECT * FROM {b}", "difference": f"SELECT * FROM {a} EXCEPT SELECT * FROM {b}", "symmetric": f"(SELECT * FROM {a} EXCEPT SELECT * FROM {b}) UNION ALL (SELECT * FROM {b} EXCEPT SELECT * FROM {a})"}[op]


@query(_set_sql("union"))
def set_union(t):
    return _part_sets(t).select("l_suppkey", F.explode(relate.union(F.col("a"), F.col("b"))).alias("l_partkey"))


@query(_set_sql("intersection"))
def set_intersection(t):
    return _part_sets(t).select("l_suppkey", F.explode(relate.intersection(F.col("a"), F.col("b"))).alias("l_partkey"))


@query(_set_sql("difference"))
def set_difference(t):
    return _part_sets(t).select("l_suppkey", F.explode(relate.difference(F.col("a"), F.col("b"))).alias("l_partkey"))


@query(_set_sql("symmetric"))
def set_symmetric_difference(t):
    return _part_sets(t).select("l_suppkey", F.explode(relate.symmetric_difference(F.col("a"), F.col("b"))).alias("l_partkey"))


@query("SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT DISTINCT c_nationkey + 20, 'new' FROM customer WHERE c_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)")
def get_or_create(t):
    have = t("nation").selectExpr("n_nationkey AS key", "n_name AS name")
    return select.insert_missing(have, t("customer").selectExpr("c_nationkey + 20 AS key", "'new' AS name"), ["key"])


# -- uniqueness and validation


@query("SELECT md5(text) AS text, count(*) AS times FROM documents GROUP BY text HAVING count(*) > 1")
def unique_violations(t):
    return validate.repeated_texts(t("documents"), "text").select(F.md5("text").alias("text"), "times")


@query("SELECT lower(p_type) AS kind, count(*) AS times FROM part GROUP BY lower(p_type) HAVING count(*) > 1")
def unique_case_insensitive(t):
    k = codec("Regex", pattern=".", ignore_case=True)
    return validate.repeated(t("part").select(F.when(F.col("p_size") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type")).alias("kind")), ["kind"], {"kind": k})


@query("SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_together(t):
    return validate.repeated(t("lineitem"), ["l_orderkey", "l_linenumber"])


def _rules(t, table: str, key: str, column: str, kind: str, expr: str | None = None, **options) -> DataFrame:
    rows = t(table).select(F.col(key), (F.expr(expr) if expr else F.col(column)).alias(column))
    model = Model(table, {column: Attribute(column, codec(kind, **options))})
    return validate.rules(rows, model, F.col(key)).select("pk", "message")


@query("SELECT c_custkey::VARCHAR AS pk, 'value isn''t one of the choices' AS message FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def validate_enum(t):
    return _rules(t, "customer", "c_custkey", "c_mktsegment", "Enum", choices=["BUILDING", "MACHINERY"])


@query("SELECT c_custkey::VARCHAR AS pk, 'value must be at least 0' AS message FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey::VARCHAR, 'value must be at most 9000' FROM customer WHERE c_acctbal > 9000")
def validate_float_bounds(t):
    return _rules(t, "customer", "c_custkey", "c_acctbal", "Float", min=0.0, max=9000.0)


@query("SELECT p_partkey::VARCHAR AS pk, 'value must be positive' AS message FROM part WHERE p_size <= 10 UNION ALL SELECT p_partkey::VARCHAR, 'value must be at most 30' FROM part WHERE p_size - 10 > 30")
def validate_positive_integer(t):
    return _rules(t, "part", "p_partkey", "p_size", "PositiveInteger", "cast(p_size - 10 AS bigint)", max=30)


@query("SELECT doc_id::VARCHAR AS pk, 'value must have at least 100 characters' AS message FROM documents WHERE length(text) < 100 UNION ALL SELECT doc_id::VARCHAR, 'value must have at most 5000 characters' FROM documents WHERE length(text) > 5000")
def validate_string(t):
    return _rules(t, "documents", "doc_id", "text", "String", min_length=100, max_length=5000)


@query("SELECT c_custkey::VARCHAR AS pk, 'value must be a slug' AS message FROM customer WHERE c_custkey % 3 = 0 OR NOT regexp_full_match(CASE WHEN c_custkey % 3 = 1 THEN c_name ELSE replace(c_name, '#', '_') END, '[A-Za-z0-9_]{1,200}')")
def validate_slug(t):
    return _rules(t, "customer", "c_custkey", "c_name", "Slug", "CASE WHEN c_custkey % 3 = 0 THEN cast(c_custkey AS string) WHEN c_custkey % 3 = 1 THEN c_name ELSE replace(c_name, '#', '_') END")


@query("SELECT page_id::VARCHAR AS pk, 'value must be a URL' AS message FROM pages WHERE page_id % 5 = 0")
def validate_url(t):
    return _rules(t, "pages", "page_id", "url", "Url", "CASE WHEN page_id % 5 = 0 THEN concat('no ', url) ELSE url END")


@query("SELECT p_partkey::VARCHAR AS pk, 'value doesn''t match the pattern' AS message FROM part WHERE NOT regexp_matches(p_brand, '#[1-3]')")
def validate_regex(t):
    return _rules(t, "part", "p_partkey", "p_brand", "Regex", pattern="#[1-3]")


@query("SELECT o_orderkey::VARCHAR AS pk, 'year must be from 1900 to 10000' AS message FROM orders WHERE year(o_orderdate) < 1997")
def validate_date(t):
    return _rules(t, "orders", "o_orderkey", "day", "Date", "CASE WHEN year(o_orderdate) < 1997 THEN add_months(to_date(o_orderdate), -1200) ELSE to_date(o_orderdate) END")


@query("""SELECT 'customer' AS model, 'c_acctbal' AS attr, 'value must be at least 0' AS message, count(*) AS n FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0
UNION ALL SELECT 'orders', 'o_orderstatus', 'value isn''t one of the choices', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') HAVING count(*) > 0
UNION ALL SELECT 'orders', 'o_orderpriority', 'value isn''t one of the choices', count(*) FROM orders WHERE o_orderpriority = '5-LOW' HAVING count(*) > 0
UNION ALL SELECT 'orders', 'o_totalprice', 'value must be at most 400000', count(*) FROM orders WHERE o_totalprice > 400000 HAVING count(*) > 0
UNION ALL SELECT 'part', 'p_size', 'value must be at most 45', count(*) FROM part WHERE p_size > 45 HAVING count(*) > 0
UNION ALL SELECT 'lineitem', 'l_orderkey, l_linenumber', 'values must be unique together', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) HAVING count(*) > 0""")
def validator_report(t):
    """The whole dataset against its catalog: rules, uniqueness, references."""
    return validate.by_model(validate.validate({n: t(n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}, catalog()))


# -- codecs


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS value, c_custkey % 5 = 4 AS bad FROM customer")
def clean_bool(t):
    k, c = codec("Boolean"), F.get(F.array(*map(F.lit, ("TRUE", "0", "1.0", "", "maybe"))), (F.col("c_custkey") % 5).cast("int"))
    return t("customer").select("c_custkey", k.clean(c).alias("value"), k.bad(c).alias("bad"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN (p_size / 2)::BIGINT END AS value, p_size % 2 = 1 AS bad FROM part")
def clean_int(t):
    k, c = codec("Integer"), (F.col("p_size") / 2).cast("string")
    return t("part").select("p_partkey", k.clean(c).alias("value"), k.bad(c).alias("bad"))


@query("SELECT p_partkey, strftime(DATE '1900-01-01' + (p_size * 700)::INT, '%Y-%m-%d') AS value FROM part")
def clean_date_serial(t):
    k = codec("Date")
    return t("part").select("p_partkey", k.serialize(k.clean((F.col("p_size") * 700 + 1).cast("string"))).alias("value"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp, (p * 3600)::INT AS time FROM (SELECT *, o_orderkey % 24 AS p FROM orders)")
def clean_datetime(t):
    d, s = codec("DateTime"), codec("Time")
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return t("orders").select("o_orderkey", d.serialize(d.clean(text)).alias("stamp"), s.clean(F.concat(F.col("o_orderkey") % 24, F.lit(":00"))).alias("time"))


@query("SELECT p_partkey, p_size::DOUBLE AS lo, CASE WHEN p_size % 2 = 0 THEN p_size + 5 ELSE p_size END::DOUBLE AS hi FROM part")
def clean_range(t):
    c = F.when(F.col("p_size") % 2 == 0, F.concat("p_size", F.lit(" - "), F.col("p_size") + 5)).otherwise(F.col("p_size").cast("string"))
    return t("part").select("p_partkey", codec("Range").clean(c).alias("r")).select("p_partkey", F.col("r.min").alias("lo"), F.col("r.max").alias("hi"))


@query("SELECT p_partkey, p_name AS first, p_brand AS second, 3 AS n FROM part")
def clean_list(t):
    """A list joined (with an item that holds quotes and commas) and split again."""
    k = codec("List")
    c = k.clean(k.serialize(F.array("p_name", "p_brand", F.concat(F.lit('a "b", '), "p_type"))))
    return t("part").select("p_partkey", c[0].alias("first"), c[1].alias("second"), F.size(c).alias("n"))


@query("SELECT c_custkey, c_mktsegment AS by_name, list_extract(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], (c_custkey % 5 + 1)::INT) AS by_number FROM customer")
def clean_enum(t):
    k = codec("Enum", choices=["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    return t("customer").select("c_custkey", k.clean(F.col("c_mktsegment")).alias("by_name"), k.clean((F.col("c_custkey") % 5 + 1).cast("string")).alias("by_number"))


@query("SELECT p_partkey, p_size / 1000.0 AS metres, p_size < 20 AS short FROM part")
def quantities(t):
    """Quantities read, brought to base units and compared."""
    k = codec("Quantity")
    q = k.clean(F.concat("p_size", F.lit(" mm")))
    rows = t("part").select("p_partkey", q.alias("q"))
    m = F.col("q.magnitude") * F.col("q.unit.scale")
    return rows.select("p_partkey", F.round(m, 9).alias("metres"), (F.round(m, 9) < 0.02).alias("short"))


@query("SELECT p_partkey, p_size::DOUBLE AS c, (2 * p_size)::DOUBLE AS h, 'C' || CASE WHEN p_size = 1 THEN '' ELSE p_size::VARCHAR END || 'H' || (2 * p_size)::VARCHAR || 'O' AS formula FROM part")
def formulas(t):
    k = codec("chem.ChemicalFormula")
    f = k.clean(F.concat(F.lit("C"), "p_size", F.lit("OH"), F.col("p_size") * 2))
    return t("part").select("p_partkey", f.alias("f")).select("p_partkey", F.col("f")["C"].alias("c"), F.col("f")["H"].alias("h"), k.serialize(F.col("f")).alias("formula"))


@query("SELECT p_partkey, '[c]: (' || p_size + 1 || ') a + b <=> d' AS text, 3 AS n FROM part")
def reactions(t):
    k = codec("chem.ReactionEquation")
    r = k.clean(F.concat(F.lit("[c]: ("), F.col("p_size") + 1, F.lit(") a + b <=> d")))
    return t("part").select("p_partkey", r.alias("r")).select("p_partkey", k.serialize(F.col("r")).alias("text"), F.size("r").alias("n"))


@query("SELECT p_partkey, 'brand''s' AS namespace, p_brand AS id, 'https://identifiers.org/brand''s/' || p_brand AS url FROM part")
def identifiers(t):
    from quillstone.functions.domain import identifier_url

    k = codec("refs.Identifier")
    i = k.clean(k.serialize(F.struct(F.lit("brand's").alias("namespace"), F.col("p_brand").alias("id"))))
    return t("part").select("p_partkey", i.alias("i")).select("p_partkey", "i.namespace", "i.id", identifier_url(F.col("i")).alias("url"))


@query("SELECT p_partkey, p_retailprice AS nominal, p_size::DOUBLE AS dev FROM part")
def uncertain_numbers(t):
    k = codec("sci.UncertainFloat")
    u = k.clean(F.concat(F.col("p_retailprice").cast("string"), F.lit(" ± "), "p_size"))
    return t("part").select("p_partkey", u.alias("u")).select("p_partkey", F.col("u.nominal_value").alias("nominal"), F.col("u.std_dev").alias("dev"))


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, event_id % 5 = 0 AS bad FROM events")
def json_attr(t):
    """JSON that can be read, and, for every fifth event, text that can't."""
    k = codec("Json")
    rows = t("events").select("event_id", k.clean(F.col("props")).alias("j"), k.bad(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))).alias("bad"))
    return rows.select("event_id", F.from_json("j", "k bigint")["k"].alias("k"), "bad")


@query("SELECT vec_id::VARCHAR AS pk, 'array must have at most 63 items' AS message FROM embeddings WHERE len(embedding) > 63")
def array_attr(t):
    return _rules(t, "embeddings", "vec_id", "embedding", "Array", "cast(embedding AS array<double>)", min_length=1, max_length=63)


# -- normalize, diff, merge


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def normalize_collections(t):
    rows = t("orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("orders"))
    return compare.normalize(rows, "o_custkey", ["orders"]).select("o_custkey", F.array_join("orders", ",").alias("orders"))


def _two_parts(t):
    part = t("part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    left = part.where("p_partkey % 11 != 0")
    right = part.where("p_partkey % 13 != 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), (F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)).alias("p_size"), (F.col("p_retailprice") * F.when(F.col("p_partkey") % 3 == 0, 1.0001).otherwise(1.0)).alias("p_retailprice"))
    return left, right


_L, _R = "(SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_partkey % 11 <> 0)", "(SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS p_name, p_size + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS p_size, p_retailprice * CASE WHEN p_partkey % 3 = 0 THEN 1.0001 ELSE 1.0 END AS p_retailprice FROM part WHERE p_partkey % 13 <> 0)"


@query(f"SELECT coalesce(l.p_partkey, r.p_partkey) AS p_partkey, CASE WHEN r.p_partkey IS NULL THEN 'left_only' WHEN l.p_partkey IS NULL THEN 'right_only' ELSE 'changed' END AS status FROM {_L} l FULL JOIN {_R} r ON l.p_partkey = r.p_partkey WHERE l.p_partkey IS NULL OR r.p_partkey IS NULL OR l.p_name <> r.p_name OR l.p_size <> r.p_size")
def diff_workbooks(t):
    return compare.diff(*_two_parts(t), ["p_partkey"], tol=0.01).select("p_partkey", "status").distinct()


@query(f"SELECT p_partkey, 'p_name' AS attr, l.p_name AS \"left\", r.p_name AS \"right\" FROM {_L} l JOIN {_R} r USING (p_partkey) WHERE l.p_name <> r.p_name UNION ALL SELECT p_partkey, 'p_size', l.p_size::VARCHAR, r.p_size::VARCHAR FROM {_L} l JOIN {_R} r USING (p_partkey) WHERE l.p_size <> r.p_size")
def diff_attributes(t):
    return compare.diff(*_two_parts(t), ["p_partkey"], tol=0.01).where("status = 'changed'").drop("status")


@query(f"SELECT count(*) FILTER (WHERE abs((l.p_retailprice - r.p_retailprice) / l.p_retailprice) >= 0.00005) AS strict, count(*) FILTER (WHERE abs((l.p_retailprice - r.p_retailprice) / l.p_retailprice) >= 0.001) AS loose FROM {_L} l JOIN {_R} r USING (p_partkey)")
def is_equal_tol(t):
    left, right = (d.select("p_partkey", "p_retailprice") for d in _two_parts(t))
    n = lambda tol: compare.diff(left, right, ["p_partkey"], tol).where("status = 'changed'").agg(F.count("*").alias("strict" if tol < 0.0005 else "loose"))
    return n(0.00005).crossJoin(n(0.001))


@query("SELECT l_suppkey, 'left_only' AS kind, l_partkey::VARCHAR AS item FROM ((SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A') EXCEPT (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')) JOIN (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_partkey END) = count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END)) USING (l_suppkey) UNION ALL SELECT l_suppkey, 'length', count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_partkey END) || ' != ' || count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END) FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_partkey END) <> count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_partkey END)")
def diff_collections(t):
    s = _part_sets(t)
    return compare.collection_diff(s.select("l_suppkey", "a"), s.select("l_suppkey", F.col("b").alias("a")), "l_suppkey", "a")


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 <> 0 OR p_partkey % 2 = 0 THEN p_brand END AS p_brand FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 5 <> 0")
def merge_datasets(t):
    part = t("part")
    left = part.where("p_partkey % 2 = 0").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))).alias("p_brand"))
    right = part.where("p_partkey % 5 != 0").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("p_brand"))
    return compare.merge(left, right, ["p_partkey"], ["p_brand"])


@query("SELECT p_partkey, 'p_size' AS attr FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'p_name' FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 5 = 0")
def merge_conflicts(t):
    left, right = (d.drop("p_retailprice") for d in _two_parts(t))
    return compare.merge_conflicts(left, right, ["p_partkey"]).select("p_partkey", "attr")


@query("SELECT p_partkey, p_partkey % 11 <> 0 AS in_left FROM part WHERE p_partkey % 13 <> 0")
def merge_map(t):
    return compare.merge_map(*_two_parts(t), ["p_partkey"])


@query("SELECT p_partkey, 'changed' AS status, 'p_size' AS attr, p_size::VARCHAR AS \"left\", (p_size + 1)::VARCHAR AS \"right\" FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT NULL, 'changed', 'p_size', '1', '2'")
def diff_null_keys(t):
    """All columns of the table, with a row without a key on both sides, which is the same row; other columns are called as the engine's own."""
    part = t("part").withColumns({"l": F.lit("x"), "r": F.lit("y")})
    none = part.limit(1).select(*[F.lit(1).cast(f.dataType).alias(f.name) if f.name == "p_size" else F.lit(None).cast(f.dataType).alias(f.name) for f in part.schema])
    changed = part.withColumn("p_size", (F.col("p_size") + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)).cast(part.schema["p_size"].dataType))
    return compare.diff(part.union(none), changed.union(none.withColumn("p_size", (F.col("p_size") + 1).cast(part.schema["p_size"].dataType))), ["p_partkey"], strict=True)


@query("SELECT s_nationkey AS dst_pk, s_suppkey AS src_pk FROM supplier UNION SELECT c_nationkey, c_custkey FROM customer")
def merge_edge_tables(t):
    side = lambda name, k: t(name).select(F.col(f"{k}_nationkey").alias("dst_pk"), F.col(f"{k}_{'supp' if k == 's' else 'cust'}key").alias("src_pk"))
    return compare.merge_edges(side("supplier", "s"), side("customer", "c"))


@query("SELECT n_name AS name FROM nation ORDER BY n_name")
def normal_keys(t):
    """The nations in their canonical order, that of the first unique attribute by name."""
    return t("nation").orderBy(*compare.normal_key(catalog()["nation"])).select(F.col(compare.normal_key(catalog()["nation"])[0]).alias("k"), F.col("n_name").alias("name")).drop("k")


# -- graphs


def _links(t):
    """Each part leads to that of thrice its number and, for every fourth, back to its half: sparse, with cycles."""
    ids = t("part").select(F.col("p_partkey").alias("src"))
    return ids.select("src", F.lit("up").alias("attr"), (F.col("src") * 3).alias("dst")).union(ids.where("src % 4 = 0").select("src", F.lit("down"), (F.col("src") / 2).cast("bigint"))).join(t("part").select(F.col("p_partkey").alias("dst")), "dst", "left_semi").select("src", "attr", "dst")


_E = "(SELECT p.p_partkey AS src, 'up' AS attr, q.p_partkey AS dst FROM part p JOIN part q ON q.p_partkey = p.p_partkey * 3 UNION ALL SELECT p_partkey, 'down', p_partkey // 2 FROM part WHERE p_partkey % 4 = 0)"


@query(f"SELECT src, attr, dst FROM {_E} WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 10) AND dst IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def cut_subgraph(t):
    return graph.cut(_links(t), t("part").where("p_size > 10").select(F.col("p_partkey").alias("node")))


@query("SELECT c_custkey::VARCHAR AS pk, 'nation:' || c_nationkey AS nation, c_mktsegment AS segment FROM customer")
def objects_json(t):
    made = graph.objects({"customer": t("customer")}, catalog())
    return made.select("pk", F.get_json_object("json", "$.c_nationkey.__id").alias("nation"), F.get_json_object("json", "$.c_mktsegment").alias("segment"))


@query(f"WITH RECURSIVE e AS {_E}, r AS (SELECT dst AS node FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 40) UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def related_closure(t):
    return graph.closure(_links(t), _large(t))


@query(f"WITH RECURSIVE e AS {_E}, r AS (SELECT src AS root, dst AS node FROM e WHERE attr = 'up' UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.node AND attr = 'up') SELECT root, node FROM r")
def children_recursive(t):
    return graph.children(_links(t), t("part").select(F.col("p_partkey").alias("node")), ["up"], carry=True)


@query(f"WITH RECURSIVE e AS {_E}, r AS (SELECT p_partkey AS node FROM part WHERE p_size > 40 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node AND attr = 'up') SELECT src, attr, dst FROM e WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)")
def cut_children(t):
    return graph.cut_from(_links(t), _large(t), ["up"])


@query(f"WITH RECURSIVE e AS {_E}, r AS (SELECT p_partkey AS root, p_partkey AS node FROM part UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.node AND attr = 'up') SELECT a.root, src, attr, dst FROM e JOIN r a ON a.node = src JOIN r b ON b.node = dst AND a.root = b.root")
def split_graphs(t):
    return graph.split(_links(t), t("part").select(F.col("p_partkey").alias("node")), ["up"])[1]


@query(f"WITH RECURSIVE e AS {_E}, r AS (SELECT dst AS node FROM e WHERE src IN (SELECT p_partkey FROM part WHERE p_size > 40) UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN 'mm' WHEN p_size % 3 = 1 THEN 'g' ELSE 's' END AS unit FROM r JOIN part ON p_partkey = node")
def reachable_units(t):
    parts = t("part").join(graph.closure(_links(t), _large(t)), F.col("p_partkey") == F.col("node"), "left_semi")
    unit = codec("Unit").clean(F.when(F.col("p_size") % 3 == 0, "mm").when(F.col("p_size") % 3 == 1, "g").otherwise("s"))
    return parts.select(unit.alias("u")).select(F.col("u.text").alias("unit")).distinct()


def _large(t):
    return t("part").where("p_size > 40").select(F.col("p_partkey").alias("node"))


@query("SELECT o_orderkey, len(lines)::INT AS lines, list_sum(list_transform(lines, lambda x: x.q)) AS quantity FROM (SELECT l_orderkey AS o_orderkey, list({'q': l_quantity}) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey)")
def to_dict_json(t):
    made = graph.to_json(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", t("lineitem"), "l_orderkey", ["l_linenumber", "l_quantity"], "orders", "lineitem")
    back = made.select("o_orderkey", F.from_json("json", "children array<struct<l_quantity:double>>")["children"].alias("c")).where("size(c) > 0")
    return back.select("o_orderkey", F.size("c").alias("lines"), F.aggregate("c", F.lit(0.0), lambda a, x: a + x["l_quantity"]).alias("quantity"))


# -- contents, expressions, migration, layouts


@query(" UNION ALL ".join(f"SELECT '{n}' AS model, count(*) AS objects FROM {n}" for n in ("region", "nation", "customer", "orders", "lineitem")))
def toc_counts(t):
    from quillstone.sources.write import contents

    return contents({n: t(n) for n in ("region", "nation", "customer", "orders", "lineitem")}, catalog()).select("model", "objects")


_KNOWN = {"line": ["price", "discount", "tax", "quantity[c]"]}
_VALUES = {"price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "quantity[c]": "l_quantity"}


@query("SELECT l_orderkey, sum(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) / greatest(l_quantity, 1) * 1000)::BIGINT)::BIGINT AS mills FROM lineitem GROUP BY l_orderkey")
def expr_eval(t):
    p = parse("price * (1 - line.discount) * (1 + tax) / max(quantity[c], 1)", _KNOWN)
    value = compile_column(p, [F.col(_VALUES[i]) for _, i in p.terms])
    return t("lineitem").select("l_orderkey", F.floor(value * 1000).alias("v")).groupBy("l_orderkey").agg(F.sum("v").alias("mills"))


@query("SELECT l_orderkey, sum(2 * l_quantity - 3 * l_linenumber)::DOUBLE AS value FROM lineitem GROUP BY l_orderkey")
def expr_linear(t):
    p = parse("2 * quantity - 3 * number", {"line": ["quantity", "number"]})
    spark = t("lineitem").sparkSession
    coeffs = spark.createDataFrame([(i, c) for (_, i), c in coefficients(p).items()], "term string, coefficient double")
    pairs = F.array(F.struct(F.lit("quantity").alias("term"), F.col("l_quantity").alias("value")), F.struct(F.lit("number").alias("term"), F.col("l_linenumber").cast("double").alias("value")))
    sums = t("lineitem").select("l_orderkey", F.explode(pairs).alias("x")).groupBy("l_orderkey", "x.term").agg(F.sum("x.value").alias("value"))
    keys = t("lineitem").select(F.col("l_orderkey").alias("expr")).distinct().crossJoin(F.broadcast(coeffs))
    values = sums.select(F.concat_ws(":", "l_orderkey", "term").alias("term"), "value")
    return linear_values(keys.select("expr", F.concat_ws(":", "expr", "term").alias("term"), "coefficient"), values).withColumnRenamed("expr", "l_orderkey")


@query("SELECT l_orderkey, sum(floor(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::BIGINT AS net, sum(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100)::BIGINT)::BIGINT AS gross FROM lineitem GROUP BY l_orderkey")
def expr_nested(t):
    """Formulas that refer to formulas."""
    known = {"line": ["price", "discount", "tax"], "sum": ["net", "gross"]}
    made = compile_nested({("sum", "gross"): "net * (1 + tax)", ("sum", "net"): "price * (1 - discount)"}, known, {("line", i): F.col(_VALUES[i]) for i in known["line"]})
    rows = t("lineitem").select("l_orderkey", *[F.floor(c * 100).alias(n) for (_, n), c in made.items()])
    return rows.groupBy("l_orderkey").agg(F.sum("net").alias("net"), F.sum("gross").alias("gross"))


def _versions() -> tuple[Catalog, Catalog, migrate.Changes]:
    old = catalog()
    text, number = lambda n, **k: Attribute(n, codec("String"), **k), lambda n, **k: Attribute(n, codec("Integer"), **k)
    new = Catalog({"client": Model("client", {"key": number("key", primary=True, unique=True), "c_name": text("c_name"), "note": Attribute("note", codec("String", default="none"))})}, "next")
    return old, new, migrate.Changes([("customer", "client")], [(("customer", "c_custkey"), ("client", "key"))])


@query("SELECT c_custkey AS key, c_name, 'none' AS note FROM customer")
def migrate_rename(t):
    old, new, changes = _versions()
    return migrate.migrate({"customer": t("customer"), "orders": t("orders")}, old, new, changes)["client"]


@query("SELECT 'c_mktsegment' AS attr, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS defaults, count(*) AS rows FROM customer UNION ALL SELECT 'c_name', 0, count(*) FROM customer")
def migrate_unused(t):
    model = Model("customer", {"c_mktsegment": Attribute("c_mktsegment", codec("String", default="BUILDING")), "c_name": Attribute("c_name", codec("String"))})
    return migrate.unused({"customer": t("customer")}, Catalog({"customer": model})).select("attr", "defaults", "rows")


@query("SELECT c_nationkey::VARCHAR AS file, c_custkey AS n, sum(CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS \"table\" FROM customer")
def multi_table_split(t):
    """Lines of files with several tables, each with the number of its table."""
    lines = t("customer").select(F.col("c_nationkey").cast("string").alias("file"), F.col("c_custkey").alias("n"), F.when(F.col("c_custkey") % 7 == 0, "!!Tables type='Data'").otherwise(F.col("c_name")).alias("line"))
    return sources.segments(lines).select("file", "n", "table")


@query("SELECT p_partkey, 'a.csv:part:' || CASE WHEN p_size <= 26 THEN chr(64 + p_size) ELSE chr(64 + (p_size - 1) // 26) || chr(65 + (p_size - 1) % 26) END || p_partkey AS source FROM part")
def source_cells(t):
    return t("part").select("p_partkey", T.source_cell(F.lit("a.csv"), F.lit("part"), F.col("p_partkey"), F.col("p_size")).alias("source"))


@query("SELECT p_partkey, p_brand AS species, n FROM (SELECT p_partkey, p_brand, unnest(generate_series(1, 1 + p_size % 3)) AS n FROM part)")
def grammar_cells(t):
    from quillstone.functions.grammar import parse_cells

    cells = t("part").select("p_partkey", F.concat_ws("; ", F.transform(F.sequence(F.lit(1), 1 + F.col("p_size") % 3), lambda k: F.concat(k, F.lit(" "), F.col("p_brand")))).alias("cell"))

    def parser(text: str):
        for part in text.split(";"):
            n, name = part.split()
            yield name, int(n)

    return parse_cells(cells, "p_partkey", "cell", parser, "species string, n bigint").select("p_partkey", "species", "n")



# -- files: what is written is read again


def _folder(spark: SparkSession) -> str:
    """A new folder that the driver can open, in the shared one: files in spreadsheet layouts are for one machine."""
    at = shared_dir(spark)
    if not at.startswith(("file:/", "/")):
        raise ValueError(f"files in spreadsheet layouts can't be written to {at}")
    path = f"/{at.removeprefix('file:').lstrip('/')}/files-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


_TRIP = ("region", "nation", "supplier", "customer")
_TRIP_SQL = "SELECT 'region' AS model, r_regionkey AS key, r_name AS name, NULL::DOUBLE AS amount, NULL::BIGINT AS ref FROM region UNION ALL SELECT 'nation', n_nationkey, n_name, NULL, n_regionkey FROM nation UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal, s_nationkey FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name, c_acctbal, c_nationkey FROM customer"
_LOOSE = sources.Strictness(ignore_missing_models=True)


def _owned(t) -> dict[str, DataFrame]:
    return {n: sources.bulk_columns(t(n), catalog()[n]) for n in _TRIP}


def _flat(tables: dict[str, DataFrame]) -> DataFrame:
    """All objects as (model, key, name, amount, ref)."""
    parts = []
    for n in _TRIP:
        m, x = catalog()[n], n[0]
        amount = F.col(f"{x}_acctbal") if f"{x}_acctbal" in m.attributes else F.lit(None)
        ref = F.col(next(iter(m.relations))) if m.relations else F.lit(None)
        parts.append(tables[n].select(F.lit(n).alias("model"), F.col(m.primary).cast("bigint").alias("key"), F.col(f"{x}_name").alias("name"), amount.cast("double").alias("amount"), ref.cast("bigint").alias("ref")))
    return reduce(DataFrame.unionByName, parts)


def _cleaned(data: sources.Dataset) -> dict[str, DataFrame]:
    return {n: validate.clean(d, catalog()[n], catalog=catalog()) for n, d in data.tables.items()}


def _trip(t, name: str, **how) -> DataFrame:
    """The tables after they were written to a file and read from it."""
    tables = _owned(t)
    spark = tables["region"].sparkSession
    at = _folder(spark)
    try:
        writing.write(f"{at}/{name}", tables, catalog(), {"about": "it's a test"}, **how)
        data = sources.read(spark, f"{at}/{name}", catalog(), _LOOSE)
        if data.document.get("about") != "it's a test":
            raise ValueError("the document's metadata is lost")
        return _flat(_cleaned(data))
    finally:
        shutil.rmtree(at)


@query(_TRIP_SQL)
def files_csv(t):
    """A file with all tables, with contents and schema before them."""
    return _trip(t, "all.csv", toc=True, schema=True)


@query(_TRIP_SQL)
def files_tsv(t):
    return _trip(t, "all.tsv")


@query(_TRIP_SQL)
def files_many_csv(t):
    """A file for each table."""
    return _trip(t, "part-*.csv")


@query(_TRIP_SQL)
def files_xlsx(t):
    return _trip(t, "all.xlsx", toc=True, schema=True)


@query(_TRIP_SQL)
def files_json(t):
    return _trip(t, "all.json")


@query(_TRIP_SQL)
def files_yaml(t):
    return _trip(t, "all.yaml")


@query(_TRIP_SQL)
def files_convert(t):
    """From text to JSON to a workbook and back to tables."""
    tables = _owned(t)
    spark = tables["region"].sparkSession
    at = _folder(spark)
    try:
        writing.write(f"{at}/a.csv", tables, catalog())
        for x, y in (("a.csv", "b.json"), ("b.json", "c.xlsx")):
            writing.convert(spark, f"{at}/{x}", f"{at}/{y}", catalog(), _LOOSE)
        return _flat(_cleaned(sources.read(spark, f"{at}/c.xlsx", catalog(), _LOOSE)))
    finally:
        shutil.rmtree(at)


@query(_TRIP_SQL)
def files_bulk(t):
    """Tables written and read in parallel."""
    tables = _owned(t)
    spark = tables["region"].sparkSession
    to = f"{shared_dir(spark)}/bulk-{uuid.uuid4().hex}"
    for n, d in tables.items():
        writing.bulk(d, f"{to}/{n}")
    return _flat({n: sources.bulk(spark, f"{to}/{n}", catalog()[n]) for n in tables})


@query(_TRIP_SQL)
def files_pandas(t):
    """Serialized tables on the driver and back."""
    tables = _owned(t)
    made = writing.to_pandas(tables, catalog())
    spark = tables["region"].sparkSession
    return _flat({n: validate.clean(spark.createDataFrame(d.astype(str)), catalog()[n], catalog=catalog()) for n, d in made.items()})


@query("SELECT c_custkey AS key, row_number() OVER (ORDER BY c_custkey) + 2 AS line FROM customer")
def files_lines(t):
    """Where each row of a table stands in its file."""
    tables = {"customer": _owned(t)["customer"]}
    spark = tables["customer"].sparkSession
    at = _folder(spark)
    try:
        writing.write(f"{at}/c.csv", tables, catalog())
        return sources.read(spark, f"{at}/c.csv", catalog(), _LOOSE).tables["customer"].select(F.col("c_custkey").cast("bigint").alias("key"), F.col("__row").cast("bigint").alias("line"))
    finally:
        shutil.rmtree(at)


@query("SELECT s_suppkey AS key, s_name AS name, s_nationkey AS ref FROM supplier")
def files_source(t):
    """The data source over a file of several tables."""
    from quillstone.sources.datasource import register

    tables = _owned(t)
    spark = tables["region"].sparkSession
    register(spark)
    at = _folder(spark)
    writing.write(f"{at}/a.csv", tables, catalog())
    with open(f"{at}/schema.csv", "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows([["!Name", "!Type", "!Parent", "!Format", "!Verbose name", "!Description"], *[r for r in schema_rows(catalog()) if "supplier" in (r[0], r[2]) or "nation" in (r[0], r[2]) or "region" in (r[0], r[2])]])
    rows = spark.read.format("tables").option("schema", f"{at}/schema.csv").option("model", "supplier").load(f"{at}/a.csv")
    return rows.select(F.col("s_suppkey").cast("bigint").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("bigint").alias("ref"))


@query("SELECT * FROM (VALUES ('customer', 5, 0), ('lineitem', 4, 0), ('nation', 3, 0), ('orders', 6, 0), ('part', 6, 0), ('region', 2, 0), ('supplier', 4, 0)) v(model, columns, rows)")
def files_template(t):
    """A file to be filled in: headings and no rows."""
    spark = t("region").sparkSession
    at = _folder(spark)
    try:
        writing.template(f"{at}/t.xlsx", spark, catalog())
        data = sources.read(spark, f"{at}/t.xlsx", catalog())
        return spark.createDataFrame([(n, len(d.columns) - 2, d.count()) for n, d in sorted(data.tables.items())], "model string, columns int, rows int")
    finally:
        shutil.rmtree(at)


@query("SELECT * FROM (VALUES ('customer', 4, 1), ('lineitem', 3, 1), ('nation', 2, 1), ('orders', 5, 1), ('part', 6, 0), ('region', 2, 0), ('supplier', 3, 1)) v(model, literals, relations)")
def schema_table(t):
    """The catalog written as a table and compiled from it."""
    names = ("Name", "Type", "Parent", "Format", "Verbose name", "Description")
    again = compile_table([dict(zip(names, r)) for r in schema_rows(catalog())])
    return t("region").sparkSession.createDataFrame([(m.name, len(m.attributes), len(m.relations)) for m in again.models.values()], "model string, literals int, relations int")


@query("SELECT * FROM (VALUES ('customer'), ('lineitem'), ('nation'), ('orders'), ('supplier')) v(model)")
def schema_related(t):
    """Models that regions are related to over any number of relations."""
    return t("region").sparkSession.createDataFrame([(m,) for m in catalog().related_models("region")], "model string")


@query("SELECT * FROM (VALUES ('o_orderkey', 'Integer', '', '', ''), ('o_orderstatus', 'Enum', '', '', 'F, O'), ('o_totalprice', 'PositiveFloat', '', '400000.0', ''), ('o_orderdate', 'DateTime', '', '', ''), ('o_orderpriority', 'Enum', '', '', '1-URGENT, 2-HIGH, 3-MEDIUM, 4-NOT SPECIFIED'), ('o_custkey', 'N-1', '1', '', 'customer.c_custkey')) v(attr, kind, low, high, choices)")
def cell_rules(t):
    """What spreadsheets check in the cells of orders."""
    rows = [r[1:] for r in writing.cell_rules(catalog()) if r[0] == "orders"]
    return t("region").sparkSession.createDataFrame(rows, "attr string, kind string, low string, high string, choices string")


# -- more of relations, lookups and graphs


@query("SELECT s_suppkey AS src_pk, CASE WHEN s_suppkey % 10 = 1 AND s_suppkey + 1 <= (SELECT max(s_suppkey) FROM supplier) THEN s_suppkey + 1 ELSE s_suppkey END AS dst_pk FROM supplier WHERE s_suppkey % 10 <> 2 OR s_suppkey - 1 NOT IN (SELECT s_suppkey FROM supplier)")
def assign_one_to_one(t):
    """One-to-one partners set anew: who held the partner before has none."""
    own = t("supplier").select(F.col("s_suppkey").alias("src_pk"), F.col("s_suppkey").alias("dst_pk"))
    new = own.where("src_pk % 10 = 1").select("src_pk", (F.col("dst_pk") + 1).alias("dst_pk")).join(own.select("dst_pk"), "dst_pk", "left_semi").select("src_pk", "dst_pk")
    return relate.assign(own, new, "1-1")


@query("SELECT l_suppkey, max(l_partkey) AS last, count(DISTINCT l_partkey) - 1 AS rest, count(DISTINCT CASE WHEN l_partkey <> 1 THEN l_partkey END) AS others FROM lineitem GROUP BY l_suppkey")
def set_pop_discard(t):
    """The last item of a collection and the number of the others; the number without item 1."""
    sets = t("lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("a"))
    last, rest = relate.pop(F.col("a"))
    return sets.select("l_suppkey", last.alias("last"), F.size(rest).cast("bigint").alias("rest"), F.size(relate.discard(F.col("a"), F.lit(1).cast("bigint"))).cast("bigint").alias("others"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS n, sum(DISTINCT l_partkey)::BIGINT AS total FROM lineitem GROUP BY l_suppkey")
def set_shuffled(t):
    """A collection in random order keeps its items."""
    sets = t("lineitem").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("a")).select("l_suppkey", relate.shuffled(F.col("a")).alias("a"))
    return sets.select("l_suppkey", F.size("a").cast("bigint").alias("n"), F.aggregate("a", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("total"))


@query(f"SELECT DISTINCT src AS root, dst AS node FROM {_E} WHERE attr = 'up'")
def children_immediate(t):
    return graph.children(_links(t), t("part").select(F.col("p_partkey").alias("node")), ["up"], recursive=False, carry=True)


@query("SELECT model, attr, message, count(*) AS n FROM (SELECT 'customer' AS model, 'c_acctbal' AS attr, 'value must be at least 0' AS message FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 AND n_regionkey = 1) GROUP BY ALL")
def related_errors(t):
    """The violations among all objects that refer, directly or not, to the second region."""
    tables = {n: sources.bulk_columns(t(n), catalog()[n]) for n in ("region", "nation", "customer")}
    rows = tables["region"].where("r_regionkey = 1")
    start = rows.select(F.lit("region").alias("type"), F.col("r_regionkey").cast("string").alias("pk"))
    return validate.by_model(graph.related_errors(tables, catalog(), start))


@query("SELECT 'customer' AS model, c_custkey::VARCHAR AS pk, 'c_acctbal: value must be at least 0 (' || c_acctbal::VARCHAR || ')' AS line FROM customer WHERE c_acctbal < 0")
def report_lines(t):
    bad = validate.rules(t("customer").withColumn("c_acctbal", F.col("c_acctbal")), catalog()["customer"])
    return validate.report_rows(bad).withColumn("pk", F.col("pk").cast("string"))


@query("SELECT 'customer' AS type, c_custkey + 1000000 AS pk, c_nationkey + 1000000 AS ref FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def copied_graph(t):
    """A copy of all that is related to the third region, under new keys, its references among itself."""
    tables = {n: sources.bulk_columns(t(n), catalog()[n]) for n in ("region", "nation", "customer")}
    start = tables["region"].where("r_regionkey = 2").select(F.lit("region").alias("type"), F.col("r_regionkey").cast("string").alias("pk"))
    made = graph.copied(tables, catalog(), start, lambda m, k: k.cast("bigint") + 1_000_000)["customer"]
    return made.select(F.lit("customer").alias("type"), F.col("c_custkey").cast("bigint").alias("pk"), F.col("c_nationkey").cast("bigint").alias("ref"))


@query("SELECT 'supplier' AS type, s_suppkey::VARCHAR AS pk, 'supplier: ' || s_suppkey || chr(10) || '  s_suppkey: ' || s_suppkey || chr(10) || '  s_name: ' || s_name || chr(10) || '  s_nationkey: ' || s_nationkey AS text FROM supplier")
def described_objects(t):
    rows = sources.bulk_columns(t("supplier"), catalog()["supplier"]).drop("s_acctbal")
    return graph.described({"supplier": rows}, catalog())


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000) THEN 'seen' ELSE n_name END AS n_name FROM nation")
def set_path(t):
    """An attribute at the end of a path: the nations of the richest builders get a new name, which all their customers see."""
    rich = t("customer").where("c_acctbal > 9000")
    data = {"customer": rich, "nation": t("nation")}
    return select.set_path(data, catalog(), "customer", ["c_nationkey", "n_name"], "seen", c_mktsegment="BUILDING")["nation"].select("n_nationkey", "n_name")


@query("SELECT n_nationkey + 20 AS key, n_name AS name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20")
def upsert_rows(t):
    have = t("nation").selectExpr("n_nationkey AS key", "n_name AS name")
    return select.upsert(have, t("nation").selectExpr("n_nationkey + 20 AS key", "n_name AS name"), ["key"])


@query("SELECT l_suppkey, list_position(a, 3) - 1 AS at FROM (SELECT l_suppkey, list_sort(list(DISTINCT l_linenumber)) AS a FROM lineitem GROUP BY l_suppkey)")
def item_position(t):
    sets = t("lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set(F.col("l_linenumber").cast("int"))).alias("a"))
    return sets.select("l_suppkey", select.position(sets, "a", 3).alias("at"))


@query("SELECT 'supplier' AS type, s_suppkey AS key FROM supplier UNION ALL SELECT 'customer', c_custkey FROM customer")
def grouped_by_type(t):
    both = select.superclass({n: t(n).selectExpr(f"{k} AS key") for n, k in (("supplier", "s_suppkey"), ("customer", "c_custkey"))}, ["key"])
    parts = select.by_type(both.union(both), ["supplier", "customer"])
    return reduce(DataFrame.unionByName, [d.select(F.lit(n).alias("type"), "key") for n, d in parts.items()])


# -- more of codecs: text cleaned, checked and written again


def _codec_rows(t, kind: str, key: str, table: str, text, **options) -> DataFrame:
    """(key, bad, broken, text): whether the text can't be read, whether the value breaks a rule, and how it is written."""
    k = codec(kind, **options)
    rows = t(table).select(key, text.alias("x"))
    v = k.clean(F.col("x"))
    broken = reduce(lambda a, b: a | b, [F.coalesce(bad, F.lit(False)) for _, bad in k.checks(v)], F.lit(False))
    return rows.select(key, k.bad(F.col("x")).alias("bad"), broken.alias("broken"), k.serialize(v).alias("text"))


def _third(good: str, other: str, key: str) -> str:
    return f"CASE WHEN {key} % 3 = 0 THEN {other} ELSE {good} END"


def _register_codec(name: str, kind: str, good: str, other: str, bad: bool, written: str | None = None, **options) -> None:
    """A query that reads good text for two thirds of parts and, for every third, other text, which is unreadable (bad) or breaks a rule. Texts are SQL over part that both engines read."""
    key = "p_partkey"
    text = _third(written or good, "''" if bad else other, key)

    def run(t):
        return _codec_rows(t, kind, key, "part", F.expr(_third(good, other, key).replace("::VARCHAR", "")), **options)

    QUERIES[name] = lambda spark, d: run(lambda table: spark.read.parquet(f"{d}/{table}.parquet"))
    SQL[name] = f"SELECT {key}, {key} % 3 = 0 AND {str(bad).lower()} AS bad, {key} % 3 = 0 AND {str(not bad).lower()} AS broken, {text} AS text FROM part"


for _name, _kind, _good, _other, _bad, _more in (
    ("email", "Email", "concat('p', p_partkey, '@example.com')", "concat('p', p_partkey, 'example.com')", False, {}),
    ("long_string", "LongString", "repeat('a', 300)", "''", False, {"none": False}),
    ("local_path", "LocalPath", "concat('/data/', p_partkey, '.csv')", "''", False, {"none": False}),
    ("doi", "refs.Doi", "concat('10.1000/p', p_partkey)", "concat('11.1000/p', p_partkey)", False, {}),
    ("dois", "refs.Dois", "concat('10.1000/p', p_partkey, ', 10.1000/x')", "concat('10.1000/p', p_partkey, ', x')", False, {}),
    ("pubmed_id", "refs.PubMedId", "concat(p_partkey, '')", "concat('-', p_partkey + 1)", False, {}),
    ("pubmed_ids", "refs.PubMedIds", "concat(p_partkey, ', 7')", "concat(p_partkey, ', -7')", False, {}),
    ("identifiers_list", "refs.Identifiers", "concat(chr(39), 'id', p_partkey, chr(39), ' @ ', chr(39), 'ns', chr(39))", "concat('id', p_partkey)", True, {}),
    ("positive_float", "PositiveFloat", "concat(p_partkey, '.5')", "concat('-', p_partkey, '.5')", False, {}),
    ("structure", "chem.ChemicalStructure", "concat('smiles: C', p_partkey)", "concat('odd: C', p_partkey)", True, {}),
    ("feature_loc", "bio.FeatureLoc", "concat(p_partkey, ',', p_partkey + 5, ',1')", "concat(p_partkey, ',', p_partkey - 5, ',1')", False, {}),
    ("dna", "bio.DnaSeq", "repeat('ACGT', p_size)", "repeat('ACGQ', p_size)", False, {}),
    ("rna", "bio.RnaSeq", "repeat('ACGU', p_size)", "repeat('ACGT', p_size)", False, {}),
    ("protein", "bio.ProteinSeq", "repeat('MKV', p_size)", "repeat('MKJ', p_size)", False, {}),
    ("sequence", "bio.Seq", "repeat('AC-', p_size)", "repeat('A1', p_size)", False, {}),
    ("term", "onto.OntoTerm", "concat('GO:', lpad(concat(p_partkey, ''), 7, '0'))", "''", False, {"none": False}),
    ("symbolic", "math.Basic", "concat('x + ', p_partkey)", "''", False, {"none": False}),
    ("symbol", "math.Symbol", "concat('x', p_partkey)", "''", False, {"none": False}),
    ("symbolic_expr", "math.Expr", "concat('sin(x', p_partkey, ')')", "''", False, {"none": False}),
):
    _register_codec(f"codec_{_name}", _kind, _good, _other, _bad, **_more)


@query("SELECT p_partkey, p_size::DOUBLE AS a, 2.0 * p_size AS b FROM part")
def codec_table(t):
    k = codec("Table")
    v = k.clean(F.concat(F.lit('{"a": {"0": '), "p_size", F.lit('}, "b": {"0": '), F.col("p_size") * 2, F.lit("}}")))
    return t("part").select("p_partkey", v.alias("v")).select("p_partkey", F.col("v")["a"]["0"].alias("a"), F.col("v")["b"]["0"].alias("b"))


@query("SELECT p_partkey, p_size::DOUBLE AS a, 1.0::DOUBLE AS c FROM part")
def codec_matrix(t):
    """Counts of letters by position."""
    k = codec("bio.FreqPosMatrix")
    v = k.clean(F.concat(F.lit('{"_alphabet": "AC", "A": ['), "p_size", F.lit(", 2], \"C\": [1, 3]}")))
    return t("part").select("p_partkey", v.alias("v")).select("p_partkey", F.col("v")["A"][0].alias("a"), F.col("v")["C"][0].alias("c"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def codec_date_forms(t):
    """Dates as people and programs write them, a different way for each of eight orders."""
    k, d = codec("Date"), F.col("o_orderdate")
    forms = ("yyyy-MM-dd", "yyyy-MM-dd'T'00:00:00'Z'", "yyyy-MM-dd 00:00:00.000", "MMM d yyyy", "d MMMM yyyy", "yyyyMMdd", "M/d/yyyy", "EEEE, MMMM d, yyyy")
    text = F.get(F.array(*[F.date_format(d, f) for f in forms]), (F.col("o_orderkey") % 8).cast("int"))
    return t("orders").select("o_orderkey", k.serialize(k.clean(text)).alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' 15:04:05' AS stamp FROM orders")
def codec_datetime_forms(t):
    k, d = codec("DateTime"), F.col("o_orderdate")
    forms = ("yyyy-MM-dd'T'15:04:05'Z'", "yyyy-MM-dd'T'16:04:05+01:00", "yyyy-MM-dd 15:04:05.000000", "MMM d, yyyy 3:04:05 'pm'", "yyyyMMdd'T'150405", "d-MMM-yyyy 15:04:05")
    text = F.get(F.array(*[F.date_format(d, f) for f in forms]), (F.col("o_orderkey") % 6).cast("int"))
    return t("orders").select("o_orderkey", k.serialize(k.clean(text)).alias("stamp"))


@query("SELECT p_partkey, upper(p_brand) AS text, p_partkey % 3 = 0 AS broken FROM part")
def custom_codec(t):
    """A type of the user's own: text in capitals that may not be empty."""
    from quillstone.functions.codecs import REGISTRY, StringCodec

    if "Shout" not in REGISTRY:

        class ShoutCodec(StringCodec):
            def clean(self, c):
                return F.upper(c)

            def checks(self, c):
                return [("value must be said aloud", c.endswith("?"))]

    k = codec("Shout")
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("?"))).otherwise(F.col("p_brand"))
    return t("part").select("p_partkey", F.rtrim(k.clean(text), F.lit("?")).alias("text"), k.checks(k.clean(text))[0][1].alias("broken"))


# -- more of formulas and migration


_F = "p_size / 7.0"
_CALLS = {
    "float(x)": "x", "fabs(-x)": "x", "abs(-x)": "x", "ceil(x)": "ceil(x)", "floor(x)": "floor(x)", "exp(x / 10)": "exp(x / 10)", "expm1(x / 10)": "exp(x / 10) - 1", "pow(x, 2)": "x * x", "sqrt(x)": "sqrt(x)", "log(x)": "ln(x)", "log(x, 2)": "ln(x) / ln(2)",
    "log1p(x)": "ln(1 + x)", "log10(x)": "log10(x)", "log2(x)": "ln(x) / ln(2)", "factorial(3) * x": "6 * x", "sin(x)": "sin(x)", "cos(x)": "cos(x)", "tan(x / 100)": "tan(x / 100)", "acos(x / 10)": "acos(x / 10)", "asin(x / 10)": "asin(x / 10)", "atan(x)": "atan(x)",
    "atan2(x, 2)": "atan2(x, 2)", "hypot(x, 2)": "sqrt(x * x + 4)", "degrees(x)": "degrees(x)", "radians(x)": "radians(x)", "min(x, 3)": "least(x, 3)", "max(x, 3)": "greatest(x, 3)", "round(2.5) + x": "2 + x", "x // 2": "floor(x / 2)", "x % 2": "x - floor(x / 2) * 2", "x ** 2": "x * x",
    "(x > 3) and not (x > 5)": "CASE WHEN x > 3 AND NOT x > 5 THEN 1 ELSE 0 END",
}


@query("SELECT k, sum(round(v * 1000))::BIGINT AS total FROM (SELECT " + ", ".join(f"({v})::DOUBLE AS c{i}" for i, v in enumerate(_CALLS.values())) + f" FROM (SELECT ({_F})::DOUBLE AS x FROM part)) UNPIVOT (v FOR k IN ({', '.join(f'c{i}' for i in range(len(_CALLS)))})) GROUP BY k")
def expr_functions(t):
    """Every function and operator that formulas may use, over all parts."""
    x = F.col("p_size") / 7.0
    made = []
    for i, text in enumerate(_CALLS):
        p = parse(text, {"part": ["x"]})
        made.append(F.sum(F.round(compile_column(p, [x] * len(p.terms)).cast("double") * 1000)).cast("bigint").alias(f"c{i}"))
    sums = t("part").agg(*made)
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f"c{i}").alias("k"), F.col(f"c{i}").alias("total")) for i in range(len(_CALLS))])).alias("s")).select("s.*")


@query("SELECT p_partkey, 'size' AS id, true AS linear FROM part WHERE p_partkey % 3 <> 2 UNION ALL SELECT p_partkey, 'price', p_partkey % 3 = 0 FROM part WHERE p_partkey % 3 <> 2 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_partkey % 3 = 2" .replace("'size' AS id, true AS linear", "'size' AS id, p_partkey % 3 = 0 AS linear"))
def expr_terms(t):
    """What the formulas of a column refer to; every third can't be read."""
    text = F.when(F.col("p_partkey") % 3 == 0, "2 * size - price").when(F.col("p_partkey") % 3 == 1, "size * price").otherwise("size +* unknown")
    return expressions.terms(t("part").select("p_partkey", text.alias("f")), "p_partkey", "f", {"part": ["size", "price"]}).select("p_partkey", "id", "linear")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'B.x + C.y * ' || p_size ELSE 'C.x - D.A.x + max(B.z, 1)' END AS f FROM part")
def migrate_expressions(t):
    """References follow a chain of renames: A becomes B, and what was B becomes C."""
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("A.x + B.y * "), "p_size")).otherwise("B.x - D.A.x + max(A.z, 1)")
    return migrate.rename_references(t("part").select("p_partkey", text.alias("f")), "f", {("A", ""): ("B", ""), ("B", ""): ("C", "")})


@query("SELECT c_custkey AS key, upper(c_name) AS c_name, 'none' AS note, 1 AS version FROM customer WHERE c_acctbal >= 0")
def migrate_sequence(t):
    """Two migrations, one after another, with functions before and after them."""
    old, new, changes = _versions()
    changes.before = lambda data: data | {"customer": data["customer"].where("c_acctbal >= 0")}
    m = new["client"]
    last = Catalog({"client": Model("client", dict(m.attributes) | {"version": Attribute("version", codec("Integer", default=1))})}, "last")
    after = migrate.Changes(after=lambda data: data | {"client": data["client"].withColumn("c_name", F.upper("c_name"))})
    out = migrate.over_sequence({"customer": t("customer")}, [(old, new, changes), (new, last, after)])["client"]
    return out.select("key", "c_name", "note", F.col("version").cast("int").alias("version"))


@query("SELECT c_custkey AS key, c_name, 'none' AS note FROM customer")
def migrate_files(t):
    """A file of the old schema into one of the new schema."""
    old, new, changes = _versions()
    spark = t("customer").sparkSession
    at = _folder(spark)
    try:
        writing.write(f"{at}/old.csv", {"customer": _owned(t)["customer"]}, old)
        migrate.migrate_file(spark, f"{at}/old.csv", f"{at}/new.json", old, new, changes, _LOOSE)
        return validate.clean(sources.read(spark, f"{at}/new.json", new).tables["client"], new["client"]).select("key", "c_name", "note")
    finally:
        shutil.rmtree(at)


@query("SELECT DISTINCT p_brand AS species, 1 AS known FROM part")
def grammar_related(t):
    """Rows that parsed cells refer to, those added that weren't there yet."""
    from quillstone.functions.grammar import parse_cells, related_rows

    cells = t("part").select("p_partkey", F.concat_ws(" ", F.lit("2"), "p_brand").alias("cell"))
    parsed = parse_cells(cells, "p_partkey", "cell", lambda text: [(text.split()[1],)], "species string")
    have = t("part").where("p_size > 40").select(F.col("p_brand").alias("species")).distinct().withColumn("id", F.md5("species"))
    rows, edges = related_rows(parsed, "p_partkey", have, ["species"], lambda: F.md5("species"))
    return rows.join(edges.select("id").distinct(), "id").select("species", F.lit(1).alias("known"))
