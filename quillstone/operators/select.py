"""Lookups, attribute paths, selection of attributes and sorting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import natural_key
from quillstone.schema import Catalog, Model


class SeveralMatches(ValueError):
    """One row was asked for and more were found."""


def where(df: DataFrame, kind: str | list[str] | None = None, **values) -> DataFrame:
    """Rows whose attributes equal all the values (None matches null) and, if asked, whose `__type` is one of `kind`. Pushed down to the scan."""
    unknown = [k for k in values if k not in df.columns]
    if unknown:
        raise KeyError(f"no attributes {unknown}")
    tests = [F.col(f"`{k}`").eqNullSafe(F.lit(v)) if v is None else F.col(f"`{k}`") == F.lit(v) for k, v in values.items()]
    if kind is not None:
        tests.append(F.col("__type").isin(kind if isinstance(kind, list) else [kind]))
    return reduce(DataFrame.where, tests, df)


def one(df: DataFrame, kind: str | None = None, **values):
    """The only row that matches, None where there is none; more are an error. At most two rows reach the driver."""
    rows = where(df, kind, **values).limit(2).collect()
    if len(rows) > 1:
        raise SeveralMatches(f"several rows match {values}")
    return rows[0] if rows else None


def lookup(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows for a batch of keys: a semi join, so repeated keys don't repeat rows."""
    return df.join(keys.select(*[f"`{c}`" for c in on]), on, "left_semi")


def only_matches(df: DataFrame, on: list[str]) -> DataFrame:
    """Rows of keys that occur once: what `one` gives for every key at the same time, without a window over the rows."""
    once = df.groupBy(*on).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
    return df.join(once, on, "left_semi")


def insert_missing(df: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """The rows and those new ones whose key isn't there yet (get or create)."""
    return df.unionByName(new.dropDuplicates(on).join(df.select(*on), on, "left_anti"), allowMissingColumns=True)


def superclass(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Several models as one: the columns they share, and `__type`."""
    return reduce(DataFrame.unionByName, [d.select(F.lit(name).alias("__type"), *[f"`{c}`" for c in columns]) for name, d in tables.items()])


def by_type(df: DataFrame, kinds: list[str]) -> dict[str, DataFrame]:
    """A mixed table split by `__type`, each without repeated rows."""
    return {k: df.where(F.col("__type") == k).drop("__type").distinct() for k in kinds}


def follow(data: dict[str, DataFrame], catalog: Catalog, model: str, path: list[str | tuple[str, dict]], alias: str = "value") -> DataFrame:
    """(pk, value) at the end of an attribute path. A step may carry a filter: (name, {attribute: value}). To-one steps are left
    joins; to-many ones give a row for each match. A row whose chain breaks has a null value."""
    names = [p if isinstance(p, str) else p[0] for p in path]
    filters = [{} if isinstance(p, str) else p[1] for p in path]
    steps = catalog.path(model, names)
    start = catalog[model].primary
    at, out = model, data[model]
    out = out.select(F.col(f"`{start}`").alias("pk"), *[F.col(f"`{c}`").alias(f"__0_{c}") for c in out.columns])
    for i, ((_, name, backwards), keep) in enumerate(zip(steps, filters), 1):
        m = catalog[at]
        if name in m.attributes and not backwards:
            return out.select("pk", F.col(f"`__{i - 1}_{name}`").alias(alias))
        if backwards:
            owner = next(x for x in catalog.models.values() for r in x.relations.values() if r.to in catalog.lineage(at) and r.back == name)
            relation = next(r for r in owner.relations.values() if r.back == name)
            target, left, right = owner.name, m.primary, relation.name
        else:
            target, left, right = m.relations[name].to, name, catalog[m.relations[name].to].primary
        near = where(data[target], **keep)
        near = near.select(*[F.col(f"`{c}`").alias(f"__{i}_{c}") for c in near.columns])
        out = out.join(near, F.col(f"`__{i - 1}_{left}`") == F.col(f"`__{i}_{right}`"), "left")
        out = out.select("pk", *[c for c in near.columns])
        at = target
    return out.select("pk", F.col(f"`__{len(steps)}_{catalog[at].primary}`").alias(alias))


def set_where(df: DataFrame, column: str, value, **match) -> DataFrame:
    """The column set to a value where the attributes match."""
    hit = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.lit(v) for k, v in match.items()], F.lit(True))
    return df.withColumn(column, F.when(F.coalesce(hit, F.lit(False)), F.lit(value)).otherwise(F.col(f"`{column}`")))


def steps_of(path: str | list | tuple) -> list[tuple[str, dict]]:
    """An attribute path in its one normal form: (name, filter) pairs, from `a.b`, ["a", "b"] or [("a", {...}), ["b"]]. Two paths are the same where these are equal."""
    parts = path.split(".") if isinstance(path, str) else list(path)
    if not parts or any(not p for p in parts):
        raise ValueError("an attribute path needs names")
    return [(p, {}) if isinstance(p, str) else (p[0], dict(p[1]) if len(p) > 1 else {}) for p in parts]


def set_path(data: dict[str, DataFrame], catalog: Catalog, model: str, path: str | list, value, **match) -> dict[str, DataFrame]:
    """The dataset after the attribute at the end of a path was set for the rows of a model that match. What leads there may be shared: whoever refers to
    the same object sees the new value. One table changes: a join with the keys that the path leads to."""
    *way, (last, own) = steps_of(path)
    if own:
        raise ValueError("the last step of a path that is set can't have a filter")
    at = model
    for _, name, backwards in catalog.path(model, [n for n, _ in way]):
        at = next(x.name for x in catalog.models.values() for r in x.relations.values() if r.to in catalog.lineage(at) and r.back == name) if backwards else catalog[at].relations[name].to
    if last not in catalog[at].columns():
        raise KeyError(f"{at} has no attribute {last}")
    rows = where(data[model], **match)
    keys = follow(data | {model: rows}, catalog, model, [*way], "__to").select("__to") if way else rows.select(F.col(f"`{catalog[model].primary}`").alias("__to"))
    keys = keys.where("__to is not null").distinct().withColumn("__hit", F.lit(True))
    df, kind = data[at], data[at].schema[last].dataType
    c = F.when(F.col("__hit"), F.lit(value).cast(kind)).otherwise(F.col(f"`{last}`"))
    out = df.join(keys, F.col(f"`{catalog[at].primary}`") == F.col("__to"), "left").withColumn(last, c).select(*[F.col(f"`{x}`") for x in df.columns])
    return data | {at: out}


def upsert(df: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """The rows with those of `new` in place of rows of the same key, and its other rows added; of several new rows of a key any one is taken. Null keys equal each other."""
    fresh = new.dropDuplicates(on).select(*[F.col(f"`{c}`") if c in new.columns else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    keys = fresh.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in on])
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in on])
    return df.join(keys, same, "left_anti").unionByName(fresh)


def attributes(model: Model, kind: str | None = None, literal: bool = True, related: bool = True) -> list[str]:
    """Names of a model's attributes, of one kind of codec or relation if asked."""
    own = [a.name for a in model.attributes.values() if literal and kind in (None, a.codec.kind)]
    return own + [r.name for r in model.relations.values() if related and kind in (None, r.kind)]


def _is_empty(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    col = F.col(f"`{c}`")
    if kind in ("double", "float"):
        return col.isNull() | F.isnan(col)
    if kind == "string":
        return col.isNull() | (col == "")
    return col.isNull() | (F.size(col) == 0) if kind.startswith("array") else col.isNull()


def empty_attributes(df: DataFrame, key: str, columns: list[str], empty: bool = True) -> DataFrame:
    """(key, attrs): names of the columns that are empty (null, NaN, '' or without items), or of those that aren't."""
    names = [F.when(_is_empty(df, c) if empty else ~_is_empty(df, c), F.lit(c)) for c in columns]
    return df.select(F.col(f"`{key}`"), F.array_compact(F.array(*names)).alias("attrs"))


def attributes_by_value(df: DataFrame, key: str, columns: list[str], include: list | None = None, exclude: list | None = None) -> DataFrame:
    """(key, attrs): names of the columns whose value is in `include`, or isn't in `exclude`; NaN equals NaN."""
    def any_of(c: str, values: list) -> Column:
        return reduce(lambda a, b: a | b, [F.col(f"`{c}`").eqNullSafe(F.lit(v)) for v in values], F.lit(False))

    test = lambda c: (any_of(c, include) if include is not None else F.lit(True)) & (~any_of(c, exclude) if exclude is not None else F.lit(True))
    return df.select(F.col(f"`{key}`"), F.array_compact(F.array(*[F.when(test(c), F.lit(c)) for c in columns])).alias("attrs"))


def order(ordering: list[str]) -> list[Column]:
    """Sort keys of an ordering: natural and case-insensitive, `-` for descending."""
    return [natural_key(F.col(f"`{n.lstrip('-')}`")).desc() if n.startswith("-") else natural_key(F.col(f"`{n}`")).asc() for n in ordering]


def sort(df: DataFrame, model: Model) -> DataFrame:
    """The rows in the model's order: a range-partitioned sort."""
    return df.orderBy(*order(model.ordering)) if model.ordering else df


def numbered(df: DataFrame, by: list[str], ordering: list[str], name: str = "position") -> DataFrame:
    """Each row's place, from 0, within its group in natural order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order(ordering))) - 1)


def position(df: DataFrame, array: str, value) -> Column:
    """The place, from 0, of the only item equal to value; null where there is none or there are several."""
    c = F.col(f"`{array}`")
    return F.when(F.size(F.filter(c, lambda x: x == F.lit(value))) == 1, F.array_position(c, F.lit(value)) - 1)
