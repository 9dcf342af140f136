"""Relations as edges: linking references, inverses, collections, related rows in a cell, set operations on collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import join_list, natural_key, split_list
from quillstone.schema import Catalog


def link(df: DataFrame, column: str, to: DataFrame, key: str, bring: list[str] | None = None) -> DataFrame:
    """Each row with what its reference leads to, and `found`: whether it did (null where there is no reference).

    Repeated keys of the other side are made one first, so that no row is repeated.
    """
    bring = bring or []
    ids = to.select(F.col(f"`{key}`").alias("__key"), *[F.col(f"`{c}`").alias(f"{column}_{c}") for c in bring])
    ids = ids.groupBy("__key").agg(*[F.max(f"{column}_{c}").alias(f"{column}_{c}") for c in bring], F.count("*").alias("__times"))
    c = F.col(f"`{column}`")
    out = df.join(ids, c == F.col("__key"), "left")
    return out.withColumn("found", F.when(c.isNotNull(), F.col("__key").isNotNull())).drop("__key", "__times")


def link_list(df: DataFrame, key: str, column: str, to: DataFrame, to_key: str, separator: str = ",") -> DataFrame:
    """(key, linked, missing): the sorted references of a separated list that are found, and those that aren't. Malformed and blank lists have none of either."""
    items = df.select(F.col(f"`{key}`"), F.explode_outer(split_list(F.col(f"`{column}`"), separator)).alias("__item"))
    ids = to.select(F.col(f"`{to_key}`").cast("string").alias("__to")).distinct()
    both = items.join(ids, F.col("__item") == F.col("__to"), "left")
    found = F.collect_set(F.when(F.col("__to").isNotNull(), F.col("__item")))
    lost = F.collect_set(F.when(F.col("__to").isNull(), F.col("__item")))
    return both.groupBy(f"`{key}`").agg(F.sort_array(found).alias("linked"), F.sort_array(lost).alias("missing"))


def edges(df: DataFrame, model: str, key: str, relation: str, to: str, many: bool = False) -> DataFrame:
    """(src_type, src_pk, attr, dst_type, dst_pk) of one relation."""
    ref = F.col(f"`{relation}`")
    rows = df.select(F.col(f"`{key}`").cast("string").alias("src_pk"), (F.explode(split_list(ref)) if many else ref.cast("string")).alias("dst_pk"))
    return rows.where("dst_pk is not null and dst_pk != ''").select(F.lit(model).alias("src_type"), "src_pk", F.lit(relation).alias("attr"), F.lit(to).alias("dst_type"), "dst_pk")


def all_edges(tables: dict[str, DataFrame], catalog: Catalog) -> DataFrame | None:
    """The edges of every relation of a dataset: one pass over each table and relation; None where there is no relation."""
    out = None
    for name, df in tables.items():
        model = catalog[name]
        for r in model.relations.values():
            if r.name in df.columns and model.primary:
                e = edges(df, name, model.primary, r.name, r.to, r.many)
                out = e if out is None else out.unionByName(e)
    return out


def with_default(df: DataFrame, column: str, default) -> DataFrame:
    """References that are missing take the default before they are linked."""
    c = F.col(f"`{column}`")
    return df.withColumn(column, F.coalesce(c, F.lit(default).cast(df.schema[column].dataType)))


def inverse(e: DataFrame, back: str) -> DataFrame:
    """The edges seen from the other side."""
    return e.select(F.col("dst_type").alias("src_type"), F.col("dst_pk").alias("src_pk"), F.lit(back).alias("attr"), F.col("src_type").alias("dst_type"), F.col("src_pk").alias("dst_pk"))


def related(children: DataFrame, reference: str, key: str, name: str = "related") -> DataFrame:
    """(reference, related): the sorted keys of the rows that refer to it. What a collection is takes memory in its one row, as in any store of collections."""
    return children.where(F.col(f"`{reference}`").isNotNull()).groupBy(f"`{reference}`").agg(F.sort_array(F.collect_set(F.col(f"`{key}`"))).alias(name))


def serialize_related(children: DataFrame, reference: str, key: str, name: str = "related") -> DataFrame:
    """(reference, text): the keys in natural order as a separated list."""
    item = F.struct(natural_key(F.col(f"`{key}`")).alias("k"), F.col(f"`{key}`").cast("string").alias("v"))
    rows = children.where(F.col(f"`{reference}`").isNotNull()).groupBy(f"`{reference}`").agg(F.array_sort(F.collect_set(item)).alias("__items"))
    return rows.select(f"`{reference}`", join_list(F.transform("__items", lambda x: x["v"])).alias(name))


def to_cell(children: DataFrame, reference: str, columns: list[str], dialect: str = "json", name: str = "cell") -> DataFrame:
    """(reference, cell): the related rows in a cell, as JSON or separated text, ordered by their values."""
    item = F.struct(*[F.col(f"`{c}`") for c in columns])
    rows = children.groupBy(f"`{reference}`").agg(F.array_sort(F.collect_set(item)).alias("__items"))
    if dialect == "json":
        return rows.select(f"`{reference}`", F.to_json("__items").alias(name))
    sep = "\t" if dialect == "tsv" else ","
    cell = lambda x: F.array_join(F.array(*[_quoted(F.coalesce(x[c].cast("string"), F.lit("")), sep) for c in columns]), sep)
    return rows.select(f"`{reference}`", F.concat(F.lit(sep.join(columns) + "\n"), F.array_join(F.transform("__items", cell), "\n")).alias(name))


def _quoted(c: Column, sep: str) -> Column:
    """A value of a separated text: in quotes, with its own doubled, where it holds a separator, a quote or a line break."""
    return F.when(c.rlike(f'[{sep}"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _unquoted(x: Column) -> Column:
    return F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)


def from_cell(df: DataFrame, key: str, cell: str, schema: str, dialect: str = "json") -> DataFrame:
    """(key and the columns of schema): the rows inside cells, equal ones of a cell made one. Inverse of to_cell."""
    c = F.col(f"`{cell}`")
    if dialect == "json":
        items = F.from_json(c, f"array<struct<{schema}>>")
    else:
        sep = "\t" if dialect == "tsv" else ","
        names = [x.split(":")[0].strip() for x in schema.split(",")]
        kinds = [x.split(":")[1].strip() for x in schema.split(",")]
        value = rf'(?:"(?:[^"]|"")*"|[^"{sep}\n][^{sep}\n]*|)'
        line = rf"{value}(?:{sep}{value})*"
        lines = F.slice(F.regexp_extract_all(F.concat(c, F.lit("\n")), F.lit(rf"({line})\n"), F.lit(1)), F.lit(2), F.lit(1 << 30))
        cells = lambda x: F.transform(F.regexp_extract_all(F.concat(x, F.lit(sep)), F.lit(rf"({value}){sep}"), F.lit(1)), _unquoted)
        items = F.transform(lines, lambda x: F.struct(*[F.get(cells(x), k).try_cast(t).alias(n) for k, (n, t) in enumerate(zip(names, kinds))]))
    return df.select(F.col(f"`{key}`"), F.explode(F.array_distinct(items)).alias("__x")).select(f"`{key}`", "__x.*")


def assign(e: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """The edges (src_pk, dst_pk) after new ones were set: where a side can have only one partner the newest edge wins, on both sides for 1-1."""
    both = e.select("src_pk", "dst_pk", F.lit(0).alias("__new")).unionByName(new.select("src_pk", "dst_pk", F.lit(1).alias("__new")))
    if kind == "N-M":
        return both.select("src_pk", "dst_pk").distinct()
    for side in {"N-1": ["src_pk"], "1-N": ["dst_pk"], "1-1": ["src_pk", "dst_pk"]}[kind]:
        other = "dst_pk" if side == "src_pk" else "src_pk"
        both = both.withColumn("__r", F.row_number().over(Window.partitionBy(side).orderBy(F.desc("__new"), other))).where("__r = 1").drop("__r")
    return both.select("src_pk", "dst_pk")


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def discard(a: Column, value) -> Column:
    return F.array_remove(a, value)


def pop(a: Column) -> tuple[Column, Column]:
    """The last item and the rest."""
    return F.try_element_at(a, F.lit(-1)), F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)


def shuffled(a: Column) -> Column:
    """The collection in random order."""
    return F.shuffle(a)
