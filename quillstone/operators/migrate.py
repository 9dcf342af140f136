"""Moving data from one version of a schema to the next: lazily, so that a chain of migrations is one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.schema import Attribute, Catalog, SchemaError


def _mapping(path: str) -> dict:
    import json

    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


@dataclass
class Changes:
    """What names alone don't tell: renamed models (old, new) and attributes ((old model, old), (new model, new)); before and after: functions over the tables."""

    renamed_models: list[tuple[str, str]] = field(default_factory=list)
    renamed_attributes: list[tuple[tuple[str, str], tuple[str, str]]] = field(default_factory=list)
    before: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None
    after: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None

    @classmethod
    def load(cls, path: str) -> Changes:
        """From a JSON or YAML file with renamed_models and renamed_attributes; other keys are an error."""
        data = _mapping(path)
        if bad := set(data) - {"renamed_models", "renamed_attributes"}:
            raise SchemaError(f"unknown keys {sorted(bad)} in {path}")
        pair = lambda x: (str(x[0]), str(x[1]))
        try:
            return cls([pair(x) for x in data.get("renamed_models") or []], [(pair(a), pair(b)) for a, b in data.get("renamed_attributes") or []])
        except (TypeError, ValueError, IndexError):
            raise SchemaError(f"{path}: renames must be pairs") from None


def plan(old: Catalog, new: Catalog, changes: Changes) -> dict[str, tuple[str, dict[str, str]]]:
    """old model -> (new model, {old column: new column}). Unlisted items of equal names map to themselves, the rest are dropped. Raises with all inconsistencies."""
    wrong = []
    models = dict(changes.renamed_models)
    if len(set(models.values())) < len(models) or len(models) < len(changes.renamed_models):
        wrong.append("a model is renamed twice")
    wrong += [f"renamed model {a} isn't in the old schema" for a in models if a not in old.models]
    wrong += [f"renamed model {b} isn't in the new schema" for b in models.values() if b not in new.models]
    for m in old.models:
        if m in new.models and m not in models and m not in models.values():
            models[m] = m
    renamed = {a: b for a, b in changes.renamed_attributes}
    if len(set(renamed.values())) < len(renamed):
        wrong.append("an attribute is renamed twice")
    for (m, a), (n, b) in renamed.items():
        if m not in models or models[m] != n:
            wrong.append(f"{m}.{a} is renamed into another model, {n}")
        elif a not in old[m].columns() or b not in new[n].columns():
            wrong.append(f"{m}.{a} -> {n}.{b}: no such attribute")
    out = {}
    for m, n in models.items():
        if m not in old.models or n not in new.models:
            continue
        to, columns = new[n], {}
        for c in old[m].columns():
            d = renamed.get((m, c), (n, c))[1] if (m, c) in renamed else c
            if d not in to.columns() or (m, c) not in renamed and any(b == (n, d) for b in renamed.values()):
                continue
            x, y = (old[m].attributes.get(c) or old[m].relations[c]), (to.attributes.get(d) or to.relations[d])
            if type(x) is not type(y):
                wrong.append(f"{m}.{c}: a literal can't become a relation, or the reverse")
            elif isinstance(x, Attribute) and x.codec.kind != y.codec.kind:
                wrong.append(f"{m}.{c}: type changes from {x.codec.kind} to {y.codec.kind}")
            elif not isinstance(x, Attribute) and (x.kind != y.kind or models.get(x.to) != y.to):
                wrong.append(f"{m}.{c}: relation changes from {x.kind} {x.to} to {y.kind} {y.to}")
            columns[c] = d
        out[m] = (n, columns)
    if wrong:
        raise SchemaError("\n".join(wrong))
    return out


def migrate(data: dict[str, DataFrame], old: Catalog, new: Catalog, changes: Changes | None = None) -> dict[str, DataFrame]:
    """The tables under the new schema: columns renamed, dropped and added with their defaults; new models are empty only where they are asked for."""
    changes = changes or Changes()
    if changes.before:
        data = changes.before(data)
    out = {}
    for m, (n, columns) in plan(old, new, changes).items():
        if m not in data:
            continue
        df, back = data[m], {d: c for c, d in columns.items()}
        made = []
        for c in new[n].columns():
            if c in back and back[c] in df.columns:
                made.append(F.col(f"`{back[c]}`").alias(c))
            else:
                a = new[n].attributes.get(c)
                made.append((F.lit(a.codec.default).cast(a.codec.spark_type) if a else F.lit(None).cast("string")).alias(c))
        out[n] = df.select(*made)
    return changes.after(out) if changes.after else out


def over_sequence(data: dict[str, DataFrame], steps: list[tuple[Catalog, Catalog, Changes]]) -> dict[str, DataFrame]:
    """Several migrations, one after another."""
    for old, new, changes in steps:
        data = migrate(data, old, new, changes)
    return data


def order(old: Catalog, new: Catalog, changes: Changes | None = None) -> list[str]:
    """The new schema's models as files have them: those that the old one had in its order, under their new names, then the added ones by name."""
    kept = [n for n, _ in plan(old, new, changes or Changes()).values()]
    return [*kept, *sorted(n for n in new.models if n not in kept)]


def migrate_file(spark: SparkSession, source: str, to: str, old: Catalog, new: Catalog, changes: Changes | None = None, strict=None, expressions: dict[str, list[str]] | None = None, **how) -> None:
    """A dataset's file under the new schema, its models in their old order. expressions: old model -> its columns that hold formulas, whose references follow the renames. how: as in write()."""
    from quillstone.operators.validate import clean
    from quillstone.sources.read import read
    from quillstone.sources.write import write

    changes = changes or Changes()
    data = read(spark, source, old, strict)
    tables = {n: clean(d, old[n], catalog=old) for n, d in data.tables.items()}
    renames = {(a, ""): (b, "") for a, b in changes.renamed_models}
    for m, columns in (expressions or {}).items():
        for c in columns:
            tables[m] = rename_references(tables[m], c, renames)
    made = migrate(tables, old, new, changes)
    write(to, {n: made[n] for n in order(old, new, changes) if n in made}, new, data.document, **how)


@dataclass
class Spec:
    """A migration of files over a sequence of schemas: schemas[i] to schemas[i + 1] by changes[i]; each file goes to the place of the same number in `to`, or over itself."""

    schemas: list[str]
    changes: list[str | None]
    files: list[str]
    to: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Spec:
        """From JSON or YAML with these four keys; inconsistencies are errors."""
        data = _mapping(path)
        if bad := set(data) - {"schemas", "changes", "files", "to"}:
            raise SchemaError(f"unknown keys {sorted(bad)} in {path}")
        spec = cls(data.get("schemas") or [], data.get("changes") or [None] * (len(data.get("schemas") or []) - 1), data.get("files") or [], data.get("to") or [])
        if len(spec.schemas) < 2 or len(spec.changes) != len(spec.schemas) - 1 or not spec.files or spec.to and len(spec.to) != len(spec.files):
            raise SchemaError(f"{path}: two schemas at least, changes for each step and files are needed")
        return spec

    def run(self, spark: SparkSession) -> list[str]:
        """Migrates every file; the places of the results."""
        from quillstone.operators.validate import clean
        from quillstone.schema import read_schema
        from quillstone.sources.read import read
        from quillstone.sources.write import write

        catalogs = [read_schema(s) for s in self.schemas]
        steps = [(a, b, Changes.load(c) if c else Changes()) for a, b, c in zip(catalogs, catalogs[1:], self.changes)]
        out = self.to or self.files
        for source, to in zip(self.files, out):
            data = read(spark, source, catalogs[0])
            made = over_sequence({n: clean(d, catalogs[0][n], catalog=catalogs[0]) for n, d in data.tables.items()}, steps)
            write(to, {n: made[n] for n in order(*steps[-1]) if n in made}, catalogs[-1], data.document)
        return out


def unused(data: dict[str, DataFrame], catalog: Catalog) -> DataFrame | None:
    """(model, attr, defaults, rows): in how many rows each attribute still has its default; one pass over each table."""
    parts = []
    for name, df in data.items():
        own = [a for a in catalog[name].attributes.values() if a.name in df.columns]
        if not own:
            continue
        counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"`{a.name}`").eqNullSafe(F.lit(a.codec.default).cast(a.codec.spark_type)) | a.codec.empty(F.col(f"`{a.name}`"))).alias(f"__{a.name}") for a in own])
        pairs = F.explode(F.array(*[F.struct(F.lit(a.name).alias("attr"), F.col(f"`__{a.name}`").alias("defaults")) for a in own]))
        parts.append(counts.select(F.lit(name).alias("model"), "rows", pairs.alias("x")).select("model", "x.attr", "x.defaults", "rows"))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def rename_references(expressions: DataFrame, column: str, renames: dict[tuple[str, str], tuple[str, str]]) -> DataFrame:
    """Formulas whose `Model.id` references of renamed models are written anew: all names in one pass, so that chains and swaps of names don't meet."""
    names = {m: n for (m, _), (n, _) in renames.items() if m != n}
    if not names:
        return expressions
    new = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    parts = F.regexp_extract_all(F.col(f"`{column}`"), F.lit(r"([A-Za-z_]\w*|[^A-Za-z_]+)"), F.lit(1))
    near = lambda i: F.coalesce(F.get(F.col("__parts"), i), F.lit(""))
    is_model = lambda i: near(i + 1).startswith(".") & ~near(i - 1).endswith(".")  # noqa: E731 - not an id inside a longer path
    made = F.transform("__parts", lambda x, i: F.when(is_model(i), F.coalesce(F.try_element_at(new, x), x)).otherwise(x))
    return expressions.withColumn("__parts", parts).withColumn(column, F.array_join(made, "")).drop("__parts")
