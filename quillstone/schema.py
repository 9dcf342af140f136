"""Catalogs: models, their attributes and relations, as plain data on the driver."""

from __future__ import annotations

import ast
import csv
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from quillstone.functions.codecs import Codec, codec
from quillstone.functions.text import snake

RELATIONS = {"OneToOne": "1-1", "ManyToOne": "N-1", "OneToMany": "1-N", "ManyToMany": "N-M", "ManyToOneExpression": "N-1", "OneToOneExpression": "1-1", "ManyToManyGrammar": "N-M", "OneToManyGrammar": "1-N"}
FORMATS = ("row", "column", "cell", "multiple_cells")


@dataclass
class Attribute:
    """A literal attribute: a column with a codec."""

    name: str
    codec: Codec
    primary: bool = False
    unique: bool = False
    verbose: str = ""
    description: str = ""
    spec: str = ""


@dataclass
class Relation:
    """kind: 1-1, N-1, 1-N or N-M, seen from the model that has it. least, most and least_back, most_back: cardinalities on either side."""

    name: str
    kind: str
    to: str
    back: str = ""
    least: int = 0
    most: int | None = None
    least_back: int = 0
    most_back: int | None = None
    verbose: str = ""
    description: str = ""
    spec: str = ""

    @property
    def many(self) -> bool:
        return self.kind in ("1-N", "N-M")


@dataclass
class Model:
    name: str
    attributes: dict[str, Attribute] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)
    parent: str | None = None
    format: str = "row"
    verbose: str = ""
    verbose_plural: str = ""
    description: str = ""
    order: list[str] = field(default_factory=list)
    ordering: list[str] = field(default_factory=list)
    unique_together: list[tuple[str, ...]] = field(default_factory=list)
    children: dict[str, list[str]] = field(default_factory=dict)
    merge: str = "join"

    @property
    def primary(self) -> str | None:
        return next((a.name for a in self.attributes.values() if a.primary), None)

    def columns(self) -> list[str]:
        """Names in the order of display: `order`, then the others as declared."""
        rest = [n for n in (*self.attributes, *self.relations) if n not in self.order]
        return [*self.order, *rest]

    def heading(self, name: str) -> str:
        x = self.attributes.get(name) or self.relations[name]
        return x.verbose or x.name

    def by_heading(self, heading: str) -> str | None:
        """The column of a heading: by name, by verbose name, whatever the case, then by its words."""
        low = heading.lower()
        for same in (lambda n: n.lower() == low, lambda n: self.heading(n).lower() == low, lambda n: n == snake(heading)):
            if found := next(filter(same, self.columns()), None):
                return found
        return None


class SchemaError(ValueError):
    """A schema that contradicts itself; the message lists everything that is wrong."""


@dataclass
class Catalog:
    models: dict[str, Model] = field(default_factory=dict)
    name: str = ""

    def __getitem__(self, name: str) -> Model:
        return self.models[name]

    def lineage(self, name: str) -> list[str]:
        """The model and its superclasses, nearest first."""
        out = []
        at: str | None = name
        while at is not None and at not in out:
            out.append(at)
            at = self.models[at].parent if at in self.models else None
        return out

    def subclasses(self, name: str) -> list[str]:
        """The model and all that inherit from it."""
        return [m for m in self.models if name in self.lineage(m)]

    def related_models(self, name: str, including: bool = False) -> list[str]:
        """Models that relations lead to from here, in either direction and over any number of steps."""
        seen, work = {name}, [name]
        while work:
            at = work.pop()
            near = [r.to for r in self.models[at].relations.values()]
            near += [m.name for m in self.models.values() if any(r.to == at for r in m.relations.values())]
            for x in near:
                if x not in seen:
                    seen.add(x)
                    work.append(x)
        return sorted(seen if including else seen - {name})

    def path(self, model: str, path: list[str]) -> list[tuple[str, str, bool]]:
        """The steps of an attribute path as (model, name, whether the relation is followed backwards)."""
        out, at = [], model
        for step in path:
            m = self.models[at]
            if step in m.attributes:
                out.append((at, step, False))
            elif step in m.relations:
                out.append((at, step, False))
                at = m.relations[step].to
            else:
                found = [(x.name, r.name) for x in self.models.values() for r in x.relations.values() if r.to in self.lineage(at) and r.back == step]
                if not found:
                    raise SchemaError(f"{at} has no attribute {step}")
                out.append((at, step, True))
                at = found[0][0]
        return out

    def inherit(self) -> Catalog:
        """The same catalog with what each model takes from its superclasses written out."""
        for m in self.models.values():
            for up in self.lineage(m.name)[1:]:
                for n, a in self.models[up].attributes.items():
                    m.attributes.setdefault(n, a)
                for n, r in self.models[up].relations.items():
                    m.relations.setdefault(n, r)
        for m in self.models.values():
            if not m.ordering and m.primary:
                m.ordering = [m.primary]
        return self

    def check(self) -> Catalog:
        """Raises SchemaError with every contradiction."""
        wrong = []
        for m in self.models.values():
            if not re.fullmatch(r"[A-Za-z_]\w*", m.name):
                wrong.append(f"{m.name!r} can't be a model's name")
            if m.format not in FORMATS:
                wrong.append(f"{m.name}: no table format {m.format!r}")
            if m.parent is not None and m.parent not in self.models:
                wrong.append(f"{m.name}: superclass {m.parent} isn't defined")
            if m.parent is not None and m.name in self.lineage(m.parent) if m.parent in self.models else False:
                wrong.append(f"{m.name}: inheritance goes round in a circle")
            if sum(a.primary for a in m.attributes.values()) > 1:
                wrong.append(f"{m.name}: more than one primary attribute")
            wrong += [f"{m.name}.{n}: reserved name" for n in (*m.attributes, *m.relations) if n in ("__type", "__id", "attribute_order")]
            wrong += [f"{m.name}: {what} names {n}, which it doesn't have" for what, names in (("attribute order", m.order), ("ordering", [x.lstrip("-") for x in m.ordering]), *(("unique together", u) for u in m.unique_together)) for n in names if n not in m.attributes and n not in m.relations]
            backs: dict[tuple[str, str], str] = {}
            for r in m.relations.values():
                if r.to not in self.models:
                    wrong.append(f"{m.name}.{r.name}: related model {r.to} isn't defined")
                elif r.back:
                    to = self.models[r.to]
                    if r.back in to.attributes or r.back in to.relations or (r.to, r.back) in backs:
                        wrong.append(f"{m.name}.{r.name}: {r.to} already has {r.back}")
                    backs[r.to, r.back] = r.name
        if wrong:
            raise SchemaError("\n".join(wrong))
        return self

    def serializable(self) -> list[str]:
        """What stands in the way of writing references as text: related models without a unique key."""
        out = []
        for m in self.models.values():
            for r in m.relations.values():
                to = self.models[r.to]
                p = to.primary
                if to.format not in ("cell", "multiple_cells") and not (p and to.attributes[p].unique) and not to.unique_together:
                    out.append(f"{m.name}.{r.name}: {r.to} has no unique primary attribute")
        return out


def _call(spec: str) -> tuple[str, list, dict]:
    """Name and literal arguments of a type such as `Enum(['a'], default='a')`; nothing in it is evaluated."""
    tree = ast.parse(spec.strip(), mode="eval").body
    name = lambda f: f"{name(f.value)}.{f.attr}" if isinstance(f, ast.Attribute) else f.id
    if isinstance(tree, ast.Call):
        return name(tree.func), [ast.literal_eval(a) for a in tree.args], {k.arg: ast.literal_eval(k.value) for k in tree.keywords}
    return name(tree), [], {}


def attribute(name: str, spec: str, verbose: str = "", description: str = "") -> Attribute | Relation:
    """An attribute or relation from the text of its type."""
    kind, args, kw = _call(spec)
    short = kind.rsplit(".", 1)[-1]
    if short in RELATIONS:
        to = args[0] if args else kw["related_class"]
        return Relation(name, RELATIONS[short], to, kw.get("related_name", ""), kw.get("min_related", 0), kw.get("max_related"), kw.get("min_related_rev", 0), kw.get("max_related_rev"), verbose, description, spec)
    first = {"Enum": "choices", "Regex": "pattern", "Float": "min", "Integer": "min", "PositiveFloat": "max", "PositiveInteger": "max", "String": "min_length", "Unit": "registry", "List": "type"}.get(short)
    if args and first:
        kw.setdefault(first, args[0])
    default = kw.pop("default", None)
    cleaned = kw.pop("default_cleaned_value", default)
    slug = short == "Slug"
    return Attribute(name, codec(kind, default=cleaned, **kw), kw.get("primary", slug), kw.get("unique", slug), verbose, description, spec)


def compile_table(rows: Iterable[dict[str, str]], name: str = "") -> Catalog:
    """The catalog that a table of !Name, !Type, !Parent, !Format and, if they are there, verbose names and descriptions declares."""
    rows = [{k.lstrip("!"): (v or "").strip() for k, v in r.items()} for r in rows]
    known = {"Name", "Type", "Parent", "Format", "Verbose name", "Verbose name plural", "Description"}
    if rows and (bad := set(rows[0]) - known):
        raise SchemaError(f"unknown columns {sorted(bad)}")
    if rows and (gone := {"Name", "Type", "Parent", "Format"} - set(rows[0])):
        raise SchemaError(f"missing columns {sorted(gone)}")
    out = Catalog(name=name)
    for r in rows:
        if r["Type"] == "Class":
            if r["Name"] in out.models and out.models[r["Name"]].format:
                raise SchemaError(f"class {r['Name']} is defined twice")
            m = out.models.setdefault(r["Name"], Model(r["Name"]))
            m.parent, m.format = r["Parent"] or None, r["Format"] or "row"
            m.verbose, m.verbose_plural, m.description = r.get("Verbose name", "") or r["Name"], r.get("Verbose name plural", ""), r.get("Description", "")
        elif r["Type"] == "Attribute":
            m = out.models.setdefault(r["Parent"], Model(r["Parent"], format=""))
            key = snake(r["Name"])
            if key in m.attributes or key in m.relations:
                raise SchemaError(f"{r['Parent']}.{key} is defined twice")
            verbose = r.get("Verbose name") or (r["Name"] if r["Name"] != key else key.replace("_", " ").capitalize())
            a = attribute(key, r["Format"], verbose, r.get("Description", ""))
            (m.relations if isinstance(a, Relation) else m.attributes)[key] = a
            m.order.append(key)
        elif r["Type"]:
            raise SchemaError(f"{r['Type']!r} is neither Class nor Attribute")
    for m in out.models.values():
        m.format = m.format or "row"
    return out.check().inherit()


def read_schema(path: str, name: str = "") -> Catalog:
    """A schema file (.csv or .tsv): heading lines that begin with `!!` and blank lines are passed over."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        lines = [x for x in csv.reader(f, delimiter="\t" if path.endswith(".tsv") else ",") if any(x) and not x[0].startswith("!!") and not x[0].startswith("%/")]
    head, *body = lines
    return compile_table([dict(zip(head, [*r, *[""] * len(head)])) for r in body], name)


def schema_rows(catalog: Catalog) -> list[tuple[str, str, str, str, str, str]]:
    """The table that declares a catalog: (name, type, parent, format, verbose name, description)."""
    out = []
    for m in sorted(catalog.models.values(), key=lambda m: m.name):
        out.append((m.name, "Class", m.parent or "", m.format, m.verbose, m.description))
        for n in m.columns():
            x = m.attributes.get(n) or m.relations[n]
            spec = x.spec or (x.codec.kind if isinstance(x, Attribute) else f"{next(k for k, v in RELATIONS.items() if v == x.kind)}('{x.to}', related_name='{x.back}')")
            out.append((n, "Attribute", m.name, spec, x.verbose, x.description))
    return out


def diagram(catalog: Catalog) -> str:
    """The models and their relations in the DOT language."""
    lines = ["digraph schema {", "  node [shape=record];"]
    for m in sorted(catalog.models.values(), key=lambda m: m.name):
        own = "".join(f"{a.name}: {a.codec.kind}\\l" for a in m.attributes.values())
        lines.append(f'  {m.name} [label="{{{m.name}|{own}}}"];')
        if m.parent:
            lines.append(f"  {m.name} -> {m.parent} [arrowhead=empty];")
        lines += [f'  {m.name} -> {r.to} [label="{r.name} ({r.kind})"];' for r in m.relations.values()]
    return "\n".join([*lines, "}"])
