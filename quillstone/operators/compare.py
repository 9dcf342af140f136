"""Normalizing, comparing, diffing and merging datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.codecs import Codec, codec
from quillstone.schema import Model


def normal_key(model: Model) -> list[str]:
    """The columns of the canonical order: the first unique attribute by name, else the shortest tuple that is unique together, else all."""
    unique = sorted(a.name for a in model.attributes.values() if a.unique)
    if unique:
        return unique[:1]
    if model.unique_together:
        return list(min(model.unique_together, key=lambda u: (len(u), u)))
    return sorted(model.attributes)


def normalize(df: DataFrame, key: str, children: list[str]) -> DataFrame:
    """Collections in plain (not natural) ascending order, without repeated items; nulls first."""
    return df.select(F.col(f"`{key}`"), *[F.sort_array(F.array_distinct(F.col(f"`{c}`"))).alias(c) if c in children else F.col(f"`{c}`") for c in df.columns if c != key])


def _codec(kind: str) -> Codec:
    return codec("Float") if kind in ("double", "float") else Codec()


def _pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows (l, r) of equal keys, or with a null for the side that lacks one. Null keys equal each other; whatever the columns are called, they are inside l and r."""
    l = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("l"))
    r = right.select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("r"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in on])
    return l.join(r, same, "full_outer")


def _keys(on: list[str]) -> list[Column]:
    if bad := {"status", "attr", "left", "right", "in_left"} & set(on):
        raise ValueError(f"keys can't be called {sorted(bad)}")
    return [F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")).alias(k) for k in on]


def diff(left: DataFrame, right: DataFrame, on: list[str], tol: float = 0.0, codecs: dict[str, Codec] | None = None, strict: bool = False) -> DataFrame:
    """One row for each difference: (keys, status, attr, left, right). status is left_only, right_only or changed.

    One full outer join on the keys, which must be unique on each side (null keys equal each other); tolerances are relative to the left value.
    Columns that only one side has are compared with nulls where `strict`, and otherwise left out.
    """
    if strict:
        left = left.withColumns({c: F.lit(None).cast(right.schema[c].dataType) for c in right.columns if c not in left.columns})
        right = right.withColumns({c: F.lit(None).cast(left.schema[c].dataType) for c in left.columns if c not in right.columns})
    kinds = dict(left.dtypes)
    shared = [c for c in left.columns if c in right.columns and c not in on]
    row = lambda a, x, y: F.struct(F.lit(a).alias("attr"), x.cast("string").alias("left"), y.cast("string").alias("right"))

    def changed(c: str) -> Column:
        a, b = F.col(f"l.`{c}`"), F.col(f"r.`{c}`")
        k = (codecs or {}).get(c) or _codec(kinds[c])
        return F.when(~k.equal(a, b, tol), row(c, a, b))

    pairs = _pairs(left, right, on)
    none = row("", F.lit(None), F.lit(None))
    found = F.when(F.col("r").isNull() | F.col("l").isNull(), F.array(none)).otherwise(F.array_compact(F.array(*map(changed, shared))) if shared else F.array().cast("array<struct<attr:string,left:string,right:string>>"))
    status = F.when(F.col("r").isNull(), "left_only").when(F.col("l").isNull(), "right_only").otherwise("changed")
    keys = [F.col(f"`{k}`") for k in on]
    return pairs.select(*_keys(on), status.alias("status"), F.explode(found).alias("d")).select(*keys, "status", "d.attr", "d.left", "d.right")


def is_equal(left: DataFrame, right: DataFrame, on: list[str], tol: float = 0.0) -> bool:
    """Whether there is no difference; stops at the first."""
    return diff(left, right, on, tol).limit(1).count() == 0


def collection_diff(left: DataFrame, right: DataFrame, key: str, column: str, symmetric: bool = False) -> DataFrame:
    """(key, kind, item) of to-many collections: of different length (`length`, "a != b"), else items only on the left (and, if
    symmetric, only on the right)."""
    side = lambda d, k, c: d.select(F.col(f"`{key}`").alias(k), F.col(f"`{column}`").alias(c))
    pairs = side(left, "__k", "a").join(side(right, "__j", "b"), F.col("__k").eqNullSafe(F.col("__j")))
    one = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("item"))
    lost = lambda kind, x, y: F.transform(F.array_except(x, y), lambda i: one(kind, i))
    a, b = F.col("a"), F.col("b")
    same = F.concat(lost("left_only", a, b), lost("right_only", b, a)) if symmetric else lost("left_only", a, b)
    length = F.array(one("length", F.concat_ws(" != ", F.size(a), F.size(b))))
    return pairs.select("__k", F.explode(F.when(F.size(a) != F.size(b), length).otherwise(same)).alias("d")).select(F.col("__k").alias(key), "d.kind", "d.item")


class MergeConflict(ValueError):
    """Two datasets that can't be merged; the message shows the first conflicts."""


def merge_conflicts(left: DataFrame, right: DataFrame, on: list[str], references: list[str] | None = None, append: bool = False) -> DataFrame:
    """(keys, attr, left, right) of what stands against a merge: literals that differ and references to two different objects.

    Null-safe: NaN equals NaN; a blank reference takes the other's. append: no row may be on both sides.
    """
    if append:
        both = _pairs(left, right, on).where("l is not null and r is not null")
        return both.select(*_keys(on), F.lit("__type").alias("attr"), F.lit("both").alias("left"), F.lit("both").alias("right"))
    references = references or []
    bad = diff(left, right, on).where("status = 'changed'").drop("status")
    return bad.where(~F.col("attr").isin(references) | (F.col("left").isNotNull() & F.col("right").isNotNull())) if references else bad


def merge(left: DataFrame, right: DataFrame, on: list[str], references: list[str] | None = None, check: bool = True) -> DataFrame:
    """The rows of both: left's, right's, and joined ones, whose blank references take the other side's value. Conflicts raise."""
    if check:
        bad = merge_conflicts(left, right, on, references).limit(5).collect()
        if bad:
            raise MergeConflict("; ".join(f"{[r[k] for k in on]} {r['attr']}: {r['left']} != {r['right']}" for r in bad))
    columns = [*left.columns, *[c for c in right.columns if c not in left.columns]]

    def both(c: str) -> Column:
        sides = [F.col(f"{s}.`{c}`") for s, d in (("l", left), ("r", right)) if c in d.columns]
        return F.coalesce(*sides).alias(c)

    return _pairs(left, right, on).select(*[both(c) for c in columns])


def merge_edges(left: DataFrame, right: DataFrame, one_parent: bool = False, check: bool = True) -> DataFrame:
    """The union of two edge tables (src_pk, dst_pk). one_parent: a child with two parents is a conflict."""
    out = left.unionByName(right).distinct()
    if one_parent and check:
        bad = out.groupBy("dst_pk").agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
        if bad:
            raise MergeConflict(f"children with several parents: {[r['dst_pk'] for r in bad]}")
    return out


def merge_map(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(keys, in_left) of every row of right. Keys must be unique on either side."""
    names = [F.col(f"`{k}`") for k in on]
    pairs = _pairs(left.select(*names).distinct(), right.select(*names), on)
    return pairs.where("r is not null").select(*_keys(on), F.col("l").isNotNull().alias("in_left"))
