"""Reachability over edges, children, cutting and splitting of datasets, nested JSON of an object graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.cluster import cut as cut_lineage
from quillstone.functions.text import join_list, split_list
from quillstone.operators.relate import all_edges
from quillstone.operators.validate import validate
from quillstone.schema import Catalog


def closure(edges: DataFrame, start: DataFrame, rounds: int | None = None, both: bool = False, carry: bool = False) -> DataFrame:
    """Nodes that edges (src, dst) lead to from the start nodes (node), the start among them only where it lies on a cycle or, with `carry`, (root, node) of each start.

    Breadth first: each round joins the frontier with the edges and drops what was seen (anti join); it ends when the
    frontier is empty, so cycles are no trouble. Each frontier is cut in the shared folder.
    """
    e = edges.select("src", "dst")
    if both:
        e = e.union(e.select("dst", "src").toDF("src", "dst"))
    e = cut_lineage(e.distinct())
    keys = ["root", "node"] if carry else ["node"]
    frontier = start.select(F.col("node").alias("root"), "node") if carry else start.select("node")
    frontier = cut_lineage(frontier.distinct())
    seen, n = None, 0
    while rounds is None or n < rounds:
        near = frontier.join(e, F.col("node") == F.col("src")).select(*[k for k in keys if k != "node"], F.col("dst").alias("node")).distinct()
        near = cut_lineage(near if seen is None else near.join(seen, keys, "left_anti"))
        if near.isEmpty():
            break
        seen = near if seen is None else seen.union(near)
        frontier, n = near, n + 1
        if n % 8 == 0:  # its parts are cut already; this keeps their number small
            seen = cut_lineage(seen)
    return seen if seen is not None else frontier.limit(0)


def children(edges: DataFrame, start: DataFrame, attrs: list[str] | None = None, recursive: bool = True, carry: bool = False) -> DataFrame:
    """closure() over edges (src, attr, dst) of these attributes only, or the immediate children."""
    allowed = edges if attrs is None else edges.where(F.col("attr").isin(attrs))
    return closure(allowed, start, None if recursive else 1, carry=carry)


def cut(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The edges whose both ends are among the kept nodes (node): two semi joins."""
    k = keep.select(F.col("node")).distinct()
    return edges.join(k, F.col("src") == k["node"], "left_semi").join(k, F.col("dst") == k["node"], "left_semi")


def cut_from(edges: DataFrame, start: DataFrame, attrs: list[str] | None = None) -> DataFrame:
    """The edges among the start nodes and their children; those that lead out are gone."""
    return cut(edges, children(edges, start, attrs).select("node").union(start.select("node")))


def reached(tables: dict[str, DataFrame], catalog: Catalog, start: DataFrame, both: bool = True) -> dict[str, DataFrame]:
    """Of each table the rows that relations lead to from the start objects (type, pk), those themselves included."""
    e = all_edges(tables, catalog)
    name = lambda t, p: F.concat_ws("\x1f", t, p)
    nodes = start.select(name("type", "pk").alias("node"))
    if e is not None:
        links = e.select(name("src_type", "src_pk").alias("src"), name("dst_type", "dst_pk").alias("dst"))
        nodes = closure(links, nodes, both=both).union(nodes).distinct()
    out = {}
    for t, df in tables.items():
        p = catalog[t].primary
        if p:
            out[t] = df.join(nodes, F.concat_ws("\x1f", F.lit(t), F.col(f"`{p}`").cast("string")) == F.col("node"), "left_semi")
    return out


def copied(tables: dict[str, DataFrame], catalog: Catalog, start: DataFrame, name: Callable[[str, Column], Column]) -> dict[str, DataFrame]:
    """Copies of everything that relations lead to from the start objects (type, pk), under new keys: name(model, key) gives the new key of an old one. References among
    the copies lead to the copies, so that they share nothing with what was copied."""
    out = {}
    for t, df in reached(tables, catalog, start).items():
        m = catalog[t]
        made = {m.primary: name(t, F.col(f"`{m.primary}`"))}
        for r in m.relations.values():
            if r.name in df.columns:
                c = F.col(f"`{r.name}`")
                made[r.name] = join_list(F.transform(split_list(c), lambda x, to=r.to: name(to, x).cast("string"))) if r.many else F.when(c.isNotNull(), name(r.to, c))
        out[t] = df.select(*[(made[c].cast(df.schema[c].dataType) if c in made else F.col(f"`{c}`")).alias(c) for c in df.columns])
    return out


def described(tables: dict[str, DataFrame], catalog: Catalog) -> DataFrame:
    """(type, pk, text): every object as lines of text for people, its attributes in the order of display; references by their keys."""
    out = None
    for t, df in tables.items():
        m = catalog[t]
        line = lambda c: F.concat(F.lit(f"  {c}: "), F.coalesce((m.attributes[c].codec.serialize(F.col(f"`{c}`")) if c in m.attributes else F.col(f"`{c}`").cast("string")), F.lit("")))  # noqa: E731, B023
        pk = F.col(f"`{m.primary}`").cast("string") if m.primary else F.lit(None).cast("string")
        rows = df.select(F.lit(t).alias("type"), pk.alias("pk"), F.concat_ws("\n", F.concat(F.lit(f"{t}: "), F.coalesce(pk, F.lit(""))), *[line(c) for c in m.columns() if c in df.columns]).alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def related_errors(tables: dict[str, DataFrame], catalog: Catalog, start: DataFrame, text: bool = False) -> DataFrame:
    """The violations of everything that is related to the start objects."""
    return validate(reached(tables, catalog, start), catalog, text)


def _many(ref, to: str, c: Column) -> Column:
    return F.transform(split_list(c), lambda x: ref(to, x))


def objects(tables: dict[str, DataFrame], catalog: Catalog) -> DataFrame:
    """(type, pk, json): every object as JSON with `__type` and `__id`; references are objects with those two and nothing else, so that circles end."""
    out = None
    for t, df in tables.items():
        m = catalog[t]
        key = F.col(f"`{m.primary}`").cast("string")
        ref = lambda to, pk: F.struct(F.lit(to).alias("__type"), F.concat_ws(":", F.lit(to), pk).alias("__id"))
        own = [F.col(f"`{a}`") for a in m.attributes if a in df.columns]
        for r in m.relations.values():
            if r.name in df.columns:
                c = F.col(f"`{r.name}`").cast("string")
                own.append((_many(ref, r.to, c) if r.many else F.when(c.isNotNull() & (c != ""), ref(r.to, c))).alias(r.name))
        rows = df.select(F.lit(t).alias("type"), key.alias("pk"), F.to_json(F.struct(F.lit(t).alias("__type"), F.concat_ws(":", F.lit(t), key).alias("__id"), *own)).alias("json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def split(edges: DataFrame, roots: DataFrame, attrs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A dataset for each root: its nodes (root, node), and its edges (root, src, attr, dst) inside them. Nodes may be in several."""
    under = children(edges, roots, attrs, carry=True)
    nodes = under.union(roots.select(F.col("node").alias("root"), "node")).distinct()
    a, b = nodes.toDF("root", "src"), nodes.toDF("root", "dst")
    return nodes, edges.join(a, "src").join(b, ["root", "dst"]).select("root", "src", "attr", "dst")


def to_json(parents: DataFrame, key: str, children_: DataFrame, reference: str, columns: list[str], kind: str, child_kind: str, name: str = "json") -> DataFrame:
    """(key, json): each parent with its children nested, in order, typed by `__type`."""
    item = F.struct(*[F.col(f"`{c}`") for c in columns])
    nested = children_.groupBy(F.col(f"`{reference}`").alias("__ref")).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    both = parents.join(nested, F.col(f"`{key}`") == F.col("__ref"), "left")
    typed = F.transform(F.coalesce("__items", F.array().cast(nested.schema["__items"].dataType)), lambda x: F.struct(F.lit(child_kind).alias("__type"), *[x[c].alias(c) for c in columns]))
    own = [F.col(f"`{c}`") for c in parents.columns]
    return both.select(F.col(f"`{key}`"), F.to_json(F.struct(F.lit(kind).alias("__type"), *own, typed.alias("children"))).alias(name))
