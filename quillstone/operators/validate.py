"""Cleaning and validation: every rule's violations as one DataFrame (model, pk, attr, message, value)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.codecs import Codec, StringCodec
from quillstone.functions.text import join_list, natural_key, split_list
from quillstone.schema import Catalog, Model

ROWS = 500_000  # of a table in a task that groups or joins it, but where more have one key
KEYS = 100_000  # of a table that are sent to all tasks
VIOLATION = "model string, pk string, attr string, message string, value string"


def reference(c: Column, to: Codec) -> Column:
    """The text of a reference as its object's key is written: `7.0` and `7` mean the same whole number. What isn't a key stays as it is."""
    return F.when(c.isNull() | (F.trim(c) == ""), c).otherwise(F.coalesce(to.clean(c).cast("string"), c))


def _references_of(c: Column, to: Codec) -> Column:
    return F.transform(split_list(c), lambda x: reference(x, to))


def clean(df: DataFrame, model: Model, text: bool = True, catalog: Catalog | None = None) -> DataFrame:
    """Text columns as typed values. Columns that the model doesn't have are dropped, those that are missing are null. With the
    catalog, references are written as the keys that they refer to."""
    out = []
    for n in model.columns():
        if n in model.attributes:
            codec = model.attributes[n].codec
            out.append((codec.clean(df[f"`{n}`"]) if text else df[f"`{n}`"]).alias(n) if n in df.columns else F.lit(None).cast(codec.spark_type).alias(n))
        elif n not in df.columns:
            out.append(F.lit(None).cast("string").alias(n))
        else:
            r, c = model.relations[n], df[f"`{n}`"]
            key = catalog[r.to].primary if text and catalog is not None else None
            if key and not r.many:
                c = reference(c, catalog[r.to].attributes[key].codec)
            elif key and not isinstance(catalog[r.to].attributes[key].codec, StringCodec):
                c = F.coalesce(join_list(_references_of(c, catalog[r.to].attributes[key].codec)), c)
            out.append(c.alias(n))
    return df.select(*out)


def _explode(df: DataFrame, model: str, pk: Column, found: list[Column]) -> DataFrame:
    """One pass over df: each column of `found` is a (attr, message, value) or null."""
    if not found:
        return df.sparkSession.createDataFrame([], VIOLATION)
    rows = df.select(F.lit(model).alias("model"), pk.cast("string").alias("pk"), F.explode(F.array_compact(F.array(*found))).alias("v"))
    return rows.select("model", "pk", "v.attr", "v.message", "v.value")


def _fault(attr: str, message: str, bad: Column, value: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(attr).alias("attr"), F.lit(message).alias("message"), value.cast("string").alias("value")))


def clean_errors(df: DataFrame, model: Model, pk: Column | None = None) -> DataFrame:
    """Cells whose text can't be cleaned."""
    key = pk if pk is not None else (F.col(model.primary) if model.primary in df.columns else F.lit(None))
    return _explode(df, model.name, key, [_fault(a.name, f"value can't be read as {a.codec.kind}", a.codec.bad(F.col(f"`{a.name}`")), F.col(f"`{a.name}`")) for a in model.attributes.values() if a.name in df.columns])


def rules(df: DataFrame, model: Model, pk: Column | None = None) -> DataFrame:
    """Violations of the attributes' constraints in typed columns: one select, no shuffle."""
    key = pk if pk is not None else (F.col(f"`{model.primary}`") if model.primary else F.lit(None))
    found = [_fault(a.name, message, bad, a.codec.serialize(F.col(f"`{a.name}`"))) for a in model.attributes.values() if a.name in df.columns for message, bad in a.codec.checks(F.col(f"`{a.name}`"))]
    if model.primary and model.primary in df.columns:
        p = model.attributes[model.primary].codec
        found.append(_fault(model.primary, "primary attribute can't be blank", p.empty(F.col(f"`{model.primary}`")), F.lit("")))
    return _explode(df, model.name, key, found)


def _rows(df: DataFrame, rows: int | None) -> int:
    return 0 if df.isStreaming else df.count() if rows is None else rows


def _spread(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """A table of so many rows by the columns' hash in partitions of ROWS, however many there are by the settings, so that what a task groups or sorts doesn't grow
    with the table. Grouped before the shuffle, keys that don't repeat would only fill memory: a group for each row of a split."""
    return df.repartition(-(-rows // ROWS), *[F.col(f"`{c}`") for c in columns]) if rows > ROWS else df


def repeated(df: DataFrame, columns: list[str], keys: dict[str, Codec] | None = None, rows: int | None = None) -> DataFrame:
    """(the columns, times) of values that occur more than once; nulls count as equal. rows: how many df has, counted where it isn't told. Of few rows partial counts come before the shuffle."""
    keys = keys or {}
    named = [(keys[c].key(F.col(f"`{c}`")) if c in keys else F.col(f"`{c}`")).alias(c) for c in columns]
    return _spread(df.select(*named), columns, _rows(df, rows)).groupBy(*[f"`{c}`" for c in columns]).agg(F.count("*").alias("times")).where("times > 1")


def repeated_texts(df: DataFrame, column: str) -> DataFrame:
    """repeated() for long texts: only their 64-bit hash is shuffled first; the texts of repeated hashes alone are then compared."""
    c = F.col(f"`{column}`")
    twice = _spread(df.select(F.xxhash64(c).alias("h")), ["h"], _rows(df, None)).groupBy("h").count().where("count > 1").select("h")
    return repeated(df.select(c.alias(column), F.xxhash64(c).alias("h")).join(twice, "h", "left_semi"), [column], rows=0)


def uniqueness(df: DataFrame, model: Model, rows: int | None = None) -> DataFrame:
    """Violations of unique attributes and of tuples that must be unique together."""
    out = []
    rows = _rows(df, rows) if model.unique_together or any(a.unique for a in model.attributes.values()) else 0
    for columns in [*([a.name] for a in model.attributes.values() if a.unique and a.name in df.columns), *map(list, model.unique_together)]:
        again = repeated(df, columns, {n: a.codec for n, a in model.attributes.items()}, rows)
        value = F.concat_ws(", ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
        message = "value must be unique" if len(columns) == 1 else "values must be unique together"
        out.append(again.select(F.lit(model.name).alias("model"), F.lit(None).cast("string").alias("pk"), F.lit(", ".join(columns)).alias("attr"), F.lit(message).alias("message"), value.alias("value")))
    return reduce(DataFrame.unionByName, out) if out else df.sparkSession.createDataFrame([], VIOLATION)


def foreign_keys(df: DataFrame, column: str, to: DataFrame, key: str, model: str = "", pk: str | None = None, rows: int | None = None, keys: int | None = None) -> DataFrame:
    """Violations: rows whose reference isn't blank and isn't found. An anti join; the planner picks broadcast by the tables' sizes, and KEYS keys or fewer are always sent. rows, keys: how many df and `to` have, counted where they aren't told."""
    c = F.col(f"`{column}`")
    rows, keys = _rows(df, rows), _rows(to, keys)
    named, have = df.where(c.isNotNull() & (c.cast("string") != "")), to.select(to[f"`{key}`"].alias("__key"))
    kinds = {df.schema[column].dataType, to.schema[key].dataType}
    if max(rows, keys) > ROWS and keys > KEYS and len(kinds) == 1:
        named, have = _spread(named, [column], max(rows, keys)), _spread(have, ["__key"], max(rows, keys))
    have = have.distinct()
    lost = named.join(F.broadcast(have) if rows > ROWS and keys <= KEYS else have, c == F.col("__key"), "left_anti")
    return lost.select(F.lit(model).alias("model"), (F.col(f"`{pk}`") if pk else F.lit(None)).cast("string").alias("pk"), F.lit(column).alias("attr"), F.lit("no such object").alias("message"), c.cast("string").alias("value"))


def cardinality(parents: DataFrame, key: str, children: DataFrame, reference: str, least: int = 0, most: int | None = None, rows: int | None = None) -> DataFrame:
    """(key, n) of parents with too few or too many children. Children are counted before they are joined. rows: how many the longer table has, counted where it isn't told."""
    rows = max(_rows(parents, None), _rows(children, None)) if rows is None else rows
    own, refs = parents.select(F.col(f"`{key}`")), children.where(F.col(f"`{reference}`").isNotNull()).select(F.col(f"`{reference}`").alias("__ref"))
    if own.schema[0].dataType == refs.schema[0].dataType:
        own, refs = _spread(own, [key], rows), _spread(refs, ["__ref"], rows)
    n = refs.groupBy("__ref").agg(F.count("*").alias("n"))
    counted = own.join(n, F.col(f"`{key}`") == F.col("__ref"), "left").select(F.col(f"`{key}`"), F.coalesce("n", F.lit(0)).alias("n"))
    bad = F.col("n") < least
    return counted.where(bad | (F.col("n") > most) if most is not None else bad)


def taken_twice(df: DataFrame, key: str, reference: str) -> DataFrame:
    """(reference, times, keys) of partners of a one-to-one relation that more than one row claims."""
    rows = df.where(F.col(f"`{reference}`").isNotNull()).groupBy(f"`{reference}`")
    return rows.agg(F.count("*").alias("times"), F.sort_array(F.collect_list(F.col(f"`{key}`"))).alias("keys")).where("times > 1")


def validate(data: dict[str, DataFrame], catalog: Catalog, text: bool = False) -> DataFrame:
    """All violations of a dataset: of cleaning where the tables are text, then, for those models that are clean, of rules,
    uniqueness at every level of inheritance, references and cardinalities. Empty where all is well."""
    parts, typed = [], {}
    rows = {name: _rows(df, None) for name, df in data.items()}
    for name, df in data.items():
        model = catalog[name]
        if text:
            parts.append(clean_errors(df, model))
        typed[name] = clean(df, model, text, catalog)
        parts.append(rules(typed[name], model))
    for name in catalog.models:
        have = [typed[s] for s in catalog.subclasses(name) if s in typed]
        if have:
            model = catalog[name]
            columns = [n for n in model.attributes]
            parts.append(uniqueness(reduce(DataFrame.unionByName, [d.select(*[f"`{c}`" for c in columns], *[f"`{c}`" for u in model.unique_together for c in u if c not in columns]) for d in have]), model, sum(rows[s] for s in catalog.subclasses(name) if s in typed)))
    for name, df in typed.items():
        model = catalog[name]
        for r in model.relations.values():
            targets = [(typed[s], catalog[s].primary) for s in catalog.subclasses(r.to) if s in typed and catalog[s].primary]
            if not targets or r.name not in data[name].columns:
                continue
            to = reduce(DataFrame.unionByName, [d.select(F.col(f"`{p}`").cast("string").alias("__to")) for d, p in targets])
            edges = _references(df, model.primary, r.name, r.many)
            keys = sum(rows[s] for s in catalog.subclasses(r.to) if s in typed and catalog[s].primary)
            links = _rows(edges, None) if r.many else rows[name]
            if not model.primary and r.least and not r.many:
                blank = F.coalesce(F.col(f"`{r.name}`").cast("string"), F.lit("")) == ""
                parts.append(_explode(df, name, F.lit(None), [_fault(r.name, "number of related objects is out of bounds", blank, F.lit("0"))]))
            parts.append(foreign_keys(edges.withColumnRenamed("ref", r.name), r.name, to, "__to", name, "pk", links, keys))
            if model.primary and (r.least or r.most is not None):
                own = df.select(F.col(f"`{model.primary}`").cast("string").alias("pk"))
                parts.append(_counted(cardinality(own, "pk", edges, "pk", r.least, r.most, max(rows[name], links)), name, r.name))
            limit = r.most_back if r.most_back is not None else 1 if r.kind in ("1-1", "1-N") else None
            if r.least_back or limit is not None:
                parts.append(_counted(cardinality(to.withColumnRenamed("__to", "pk"), "pk", edges, "ref", r.least_back, limit, max(keys, links)), r.to, r.back or r.name))
    return reduce(DataFrame.unionByName, parts)


def _references(df: DataFrame, key: str | None, column: str, many: bool) -> DataFrame:
    """(pk, ref): a row for each reference, from a key column or a separated list."""
    c = F.col(f"`{column}`").cast("string")
    pk = (F.col(f"`{key}`") if key else F.lit(None)).cast("string").alias("pk")
    if many:
        return df.select(pk, F.explode(split_list(c)).alias("ref"))
    return df.where(c.isNotNull() & (c != "")).select(pk, c.alias("ref"))


def _counted(bad: DataFrame, model: str, attr: str) -> DataFrame:
    return bad.select(F.lit(model).alias("model"), F.col("pk"), F.lit(attr).alias("attr"), F.lit("number of related objects is out of bounds").alias("message"), F.col("n").cast("string").alias("value"))


def by_model(violations: DataFrame) -> DataFrame:
    """(model, attr, message, n): the violations counted."""
    return violations.groupBy("model", "attr", "message").agg(F.count("*").alias("n"))


def report_lines(violations: DataFrame) -> Iterator[str]:
    """Lines of an indented report of all violations, in natural order, for people to read; partition by partition, so that the driver holds few of them."""
    at: tuple = (None, None)
    for r in violations.orderBy("model", natural_key(F.coalesce("pk", F.lit(""))), "attr", "message", "value").toLocalIterator():
        if r["model"] != at[0]:
            yield f"{r['model']}:"
        if (r["model"], r["pk"]) != at:
            yield f"  {r['pk'] if r['pk'] is not None else 'all objects'}:"
        at = (r["model"], r["pk"])
        yield f"    {r['attr']}: {r['message']} ({r['value']!r})"


def report(violations: DataFrame) -> str:
    """The whole report as one text."""
    return "\n".join(report_lines(violations))


def report_rows(violations: DataFrame) -> DataFrame:
    """(model, pk, line): a line of the report for each violation, made in parallel."""
    line = F.concat(F.col("attr"), F.lit(": "), F.col("message"), F.lit(" ("), F.coalesce("value", F.lit("")), F.lit(")"))
    return violations.select("model", F.coalesce("pk", F.lit("all objects")).alias("pk"), line.alias("line"))
