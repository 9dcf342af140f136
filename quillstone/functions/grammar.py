"""Cells that a user's grammar parses into several related rows: a table function over any parser."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.cluster import ship


def related_rows(cells: DataFrame, key: str, have: DataFrame, on: list[str], name: Callable[[], Column]) -> tuple[DataFrame, DataFrame]:
    """What parsed cells (key, columns of the related model, error) refer to: the related rows, with those added that weren't there yet (their key `id` made by
    name(), a function of the other columns), and the edges (key, id). on: the columns by which a row is known. Rows of cells in error are left out."""
    good = cells.where("error is null").drop("error")
    new = good.drop(key).dropDuplicates(on).join(have.select(*on), on, "left_anti").withColumn("id", name())
    rows = have.unionByName(new, allowMissingColumns=True)
    return rows, good.select(key, *on).join(rows.select("id", *on), on).select(key, "id").distinct()


def parse_cells(df: DataFrame, key: str, cell: str, parser: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """(key, columns of schema, error): parser(text) gives the rows of each distinct text of a batch; a ValueError becomes the error. Blank cells have no rows, equal rows of a cell are one."""
    ship(df.sparkSession)
    columns = StructType.fromDDL(schema)
    out = StructType().add("__key", df.schema[key].dataType)
    for f in columns:
        out = out.add(f)
    out = out.add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            known: dict[str, tuple[list[tuple], str | None]] = {}
            rows, made = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is None or not text.strip():
                    continue
                if text not in known:
                    try:
                        known[text] = list(dict.fromkeys(map(tuple, parser(text)))), None
                    except ValueError as e:
                        known[text] = [(None,) * len(columns)], str(e)
                found, error = known[text]
                rows += [i] * len(found)
                made += [(*r, error) for r in found]
            cols = list(zip(*made)) if made else [()] * (len(columns) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, type=pa.int64())), *(pa.array(c, type=f.type) for c, f in zip(cols, list(arrow)[1:]))], schema=arrow)

    picked = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{cell}`").cast("string").alias("t"))
    return picked.mapInArrow(run, out).withColumnRenamed("__key", key)
