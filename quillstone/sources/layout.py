"""The layout of tables in text files: metadata headings, comments, group headings, transposed tables.

A table begins with `!!Name key='value' ...`; a document may begin with `!!!Name key='value' ...`. Headings are cells that begin with `!`;
cells like `%/ ... /%` alone in their row are comments. Tables of format `column` have their headings in the first column.
"""

from __future__ import annotations

import csv
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice, zip_longest

_PAIR = re.compile(r" +(\S+?)=('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")")
MARK = "Tables"


class LayoutError(ValueError):
    """A file whose layout can't be read."""


def metadata(heading: str) -> dict[str, str]:
    """The key-value pairs of a heading; a repeated key is an error."""
    out: dict[str, str] = {}
    for key, value in _PAIR.findall(heading):
        if key in out:
            raise LayoutError(f"metadata {key!r} is repeated")
        out[key] = re.sub(r"\\(.)", r"\1", value[1:-1])
    return out


def heading(level: str, pairs: dict[str, str], mark: str = MARK) -> str:
    quote = lambda v: "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{level}{mark}" + "".join(f" {k}={quote(v)}" for k, v in pairs.items())


@dataclass
class Sheet:
    """One table: headings as (group, name), and its rows of cells, each with its 1-based line in the file. Rows are read as they are asked for, and before the next table."""

    meta: dict[str, str]
    headings: list[tuple[str, str]]
    rows: Iterator[tuple[list[str], int]]
    comments: list[str] = field(default_factory=list)

    @property
    def model(self) -> str:
        return self.meta.get("class", "") or self.meta.get("id", "")


def cells(path: str) -> Iterator[list[str]]:
    with open(path, encoding="utf-8-sig", newline="") as f:
        yield from csv.reader(f, delimiter="\t" if path.lower().endswith(".tsv") else ",")


def tables(rows: Iterable[list[str]]) -> tuple[dict[str, str], Iterator[Sheet]]:
    """The document's metadata, whole once all tables were read, and its tables. Documents that contradict themselves are an error."""
    document: dict[str, str] = {}
    return document, _tables(enumerate(rows, 1), document)


def _tables(rows: Iterator[tuple[int, list[str]]], document: dict[str, str]) -> Iterator[Sheet]:
    head: list[str] | None = None

    def body() -> Iterator[tuple[int, list[str]]]:
        """The rows before the next table's heading."""
        nonlocal head
        for n, r in rows:
            first = r[0] if r else ""
            if first.startswith("!!!"):
                for k, v in metadata(first).items():
                    if document.setdefault(k, v) != v:
                        raise LayoutError(f"the document has two values of {k!r}")
            elif first.startswith("!!"):
                head = r
                return
            else:
                yield n, r

    deque(body(), 0)
    while head is not None:
        own, head, rest = head, None, body()
        yield _sheet(metadata(own[0]), rest)
        deque(rest, 0)


def _sheet(meta: dict[str, str], body: Iterator[tuple[int, list[str]]]) -> Sheet:
    comments: list[str] = []

    def filled() -> Iterator[tuple[int, list[str]]]:
        for n, r in body:
            full = [c for c in r if c != ""]
            if len(full) == 1 and (m := re.fullmatch(r"%/(.*)/%", r[0].strip(), re.S)):
                comments.append(m[1].strip())
            elif full:
                yield n, r

    lines = filled()
    if meta.get("tableFormat") == "column":  # a line has a cell of each object, so these are read whole
        grid = [r for _, r in lines]
        width = max(map(len, grid), default=0)
        grid = [[*r, *[""] * (width - len(r))] for r in grid]
        deep = 2 if any(r[1].startswith("!") for r in grid if len(r) > 1) else 1
        heads = [((r[0] if deep == 2 else ""), r[deep - 1]) for r in grid]
        lines = enumerate((list(x) for x in zip(*[r[deep:] for r in grid])), deep + 1)
    else:
        top = list(islice(lines, 2))
        deep = 2 if len(top) > 1 and any(c.startswith("!") for c in top[1][1]) else 1
        above = [r for _, r in top[:deep]]
        heads = list(zip_longest(*(above if deep == 2 else [[], *above]), fillvalue="")) if above else []
        lines = chain(top[deep:], lines)
    keep = [k for k, (_, h) in enumerate(heads) if h.startswith("!")]

    def kept() -> Iterator[tuple[list[str], int]]:
        for n, r in lines:
            row = [r[k] if k < len(r) else "" for k in keep]
            if any(row):
                yield row, n

    return Sheet(meta, [(heads[k][0].lstrip("!"), heads[k][1].lstrip("!")) for k in keep], kept(), comments)
