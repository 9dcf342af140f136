"""Files in the layouts as a Spark data source: spark.read.format("tables").option("schema", ...).option("model", ...).load(files)."""

from __future__ import annotations

import glob
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from quillstone.cluster import ship
from quillstone.schema import read_schema


class TablesSource(DataSource):
    """One model's rows, as text, of every file that the path matches, those among the cells of other models' tables too; files are read in parallel.

    Columns that the schema doesn't know are errors unless the option ignoreExtraAttributes is true.
    """

    @classmethod
    def name(cls) -> str:
        return "tables"

    def schema(self) -> StructType:
        model = read_schema(self.options["schema"])[self.options["model"]]
        return StructType([StructField(c, StringType()) for c in model.columns()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.file, self.model = options["path"], options["schema"], options["model"]
        self.lenient = str(options.get("ignoreExtraAttributes", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from quillstone.sources import layout, xlsx
        from quillstone.sources.read import ReadError, Strictness, _rows, model_of

        if partition is None or partition.value is None:
            return
        catalog, path = read_schema(self.file), partition.value
        strict = Strictness(allow_several_sheets=True, ignore_missing_models=True, ignore_extra_models=True, ignore_missing_attributes=True, ignore_extra_attributes=self.lenient)
        wrong: list[str] = []
        found: dict[str, dict] = {}

        def extra(to: str, cells: dict[str, str]) -> None:
            if to == self.model:
                found[json.dumps(cells, sort_keys=True)] = cells

        sheets = (rows for _, rows in xlsx.read(path)) if path.endswith(".xlsx") else [layout.cells(path)]
        for rows in sheets:
            for sheet in layout.tables(rows)[1]:
                owner = model_of(catalog, sheet.model) if sheet.meta.get("type", "Data") == "Data" else None
                if owner == self.model or owner and any(r.to == self.model for r in catalog[owner].relations.values()):
                    made = _rows(catalog, catalog[owner], path, sheet, strict, wrong, extra)
                    if wrong:
                        raise ReadError("\n".join(wrong))
                    for r in made:
                        if owner == self.model:
                            yield tuple(r[:-2])
        for cells in found.values():  # rows of the model in groups of cells of other tables
            yield tuple(cells.get(c) for c in catalog[self.model].columns())


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(TablesSource)
