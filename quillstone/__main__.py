"""python -m quillstone COMMAND: convert, diff, init-schema, migrate, normalize, template, validate and viz-schema on the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from quillstone.operators import compare, validate
from quillstone.operators.migrate import Changes, migrate_file
from quillstone.schema import Catalog, diagram, read_schema
from quillstone.sources.read import Dataset, Strictness, read
from quillstone.sources.write import convert, template, write

#: Tables may be split and tables and columns missing; those that the schema doesn't know are errors.
USUAL = Strictness(allow_several_sheets=True, ignore_missing_models=True, ignore_missing_attributes=True)


def _clean(data: Dataset, catalog: Catalog) -> dict[str, DataFrame]:
    return {n: validate.clean(d, catalog[n], catalog=catalog) for n, d in data.tables.items()}


def run(args: list[str], spark: SparkSession | None = None) -> int:
    """0 where all is well, 1 where files differ or don't validate."""
    p = argparse.ArgumentParser(prog="quillstone", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name, names in {"convert": ["schema", "source", "to"], "diff": ["schema", "model", "left", "right"], "migrate": ["schema", "source", "new_schema", "changes", "to"], "init-schema": ["schema"], "normalize": ["schema", "source", "to"], "template": ["schema", "to"], "validate": ["schema", "source"], "viz-schema": ["schema", "to"]}.items():
        c = commands.add_parser(name)
        for n in names:
            c.add_argument(n)
        if "to" in names and name != "viz-schema":
            for flag, told in (("--write-toc", "add a table of contents"), ("--write-schema", "add the schema"), ("--unprotected", "leave sheets of workbooks unprotected")):
                c.add_argument(flag, action="store_true", help=told)
    a = p.parse_args(args)
    catalog = read_schema(a.schema)
    if a.command == "init-schema":
        print("\n".join(f"{m.name}: {', '.join(m.columns())}" for m in catalog.models.values()))
        return 0
    if a.command == "viz-schema":
        with open(a.to, "w", encoding="utf-8") as f:
            f.write(diagram(catalog))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    how = {"toc": a.write_toc, "schema": a.write_schema, "protected": not a.unprotected} if hasattr(a, "write_toc") else {}
    if a.command == "convert":
        convert(spark, a.source, a.to, catalog, USUAL, **how)
    elif a.command == "template":
        template(a.to, spark, catalog, **how)
    elif a.command == "migrate":
        migrate_file(spark, a.source, a.to, catalog, read_schema(a.new_schema), Changes.load(a.changes), USUAL, **how)
    elif a.command == "normalize":
        data = read(spark, a.source, catalog, USUAL)
        write(a.to, {n: d.orderBy(*compare.normal_key(catalog[n])) for n, d in _clean(data, catalog).items()}, catalog, data.document, **how)
    elif a.command == "validate":
        n = 0
        for n, line in enumerate(validate.report_lines(validate.validate(read(spark, a.source, catalog, USUAL).tables, catalog, text=True)), 1):
            print(line)
        if not n:
            print("Dataset is valid")
        return int(bool(n))
    else:
        left, right = (_clean(read(spark, x, catalog, USUAL), catalog)[a.model] for x in (a.left, a.right))
        key = catalog[a.model].primary
        codecs = {n: x.codec for n, x in catalog[a.model].attributes.items()}
        n = 0
        for n, r in enumerate(compare.diff(left, right, [key] if key else compare.normal_key(catalog[a.model]), codecs=codecs).toLocalIterator(), 1):
            print(*["" if v is None else v for v in r], sep="\t")
        return int(bool(n))
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
