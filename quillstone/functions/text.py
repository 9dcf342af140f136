"""Text helpers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ITEM = r'"(?:\\.|[^"\\])*"'


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def natural_key(c: Column) -> Column:
    """Orders text case-insensitively with its numbers by value: runs of digits are padded, after their leading zeros are gone."""
    parts = F.regexp_extract_all(F.lower(c.cast("string")), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = lambda x: F.when(x.rlike(r"^\d"), F.lpad(F.regexp_replace(x, r"^0+(?=\d)", ""), 20, "0")).otherwise(x)
    return F.transform(parts, padded)


def split_list(c: Column, separator: str = ",") -> Column:
    """Items of a separated list: quoted items may hold separators and escaped quotes, others are trimmed. Blank: no items; malformed: null."""
    sep = re.escape(separator)
    item = rf'\s*(?:{_ITEM}|[^"{sep}]*?)\s*'
    whole = rf"^{item}(?:{sep}{item})*$"
    raw = F.regexp_extract_all(F.concat(c, F.lit(separator)), F.lit(rf"({item}){sep}"), F.lit(1))
    bare = F.transform(F.transform(raw, lambda x: F.trim(x)), lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, r'^"|"$', ""), r"\\(.)", "$1")).otherwise(x))
    return F.when(blank(c), F.array().cast("array<string>")).when(c.rlike(whole), bare)


def join_list(c: Column, separator: str = ",") -> Column:
    """Inverse of split_list. Items with the separator are quoted too, so every list comes back as it was."""
    sep = re.escape(separator)
    quoted = lambda x: F.when(x.rlike(rf'[,"{sep}]|^\s|\s$'), F.concat(F.lit('"'), F.regexp_replace(x, r'(["\\])', r"\\$1"), F.lit('"'))).otherwise(x)
    return F.array_join(F.transform(c, quoted), separator + " ")


def cell_column(number: Column) -> Column:
    """Spreadsheet letters of a 1-based column number; null where it isn't positive."""
    n = number.cast("bigint")
    step = lambda x, _: F.struct(F.floor((x["n"] - 1) / 26).cast("bigint").alias("n"), F.concat(F.char(F.lit(65) + F.pmod(x["n"] - 1, F.lit(26))), x["s"]).alias("s"))
    begin = F.struct(n.alias("n"), F.lit("").alias("s"))
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(10)), begin, lambda x, i: F.when(x["n"] > 0, step(x, i)).otherwise(x))
    return F.when(n >= 1, folded["s"])


def source_cell(file: Column, sheet: Column, row: Column, column: Column, transposed: bool = False, spreadsheet: bool = True) -> Column:
    """Provenance of a value, `file:sheet:A1`, or `file:sheet:row,column` for text tables. Transposed tables swap the two."""
    r, c = (column, row) if transposed else (row, column)
    at = F.concat(cell_column(c), r.cast("string")) if spreadsheet else F.concat_ws(",", r.cast("string"), c.cast("string"))
    return F.concat_ws(":", file, sheet, at)


def snake(name: str) -> str:
    """Attribute name from a heading: word characters, lower case, underscores between words."""
    words = re.sub(r"[^0-9A-Za-z_]+", "_", name.strip())
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", words).strip("_").lower()
