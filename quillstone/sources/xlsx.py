"""Workbooks by the standard library: worksheets as rows of text, and back."""

from __future__ import annotations

import os
import re
import tempfile
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from typing import IO
from xml.sax.saxutils import escape

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_M = f"{{{_NS['m']}}}"
_TOP = 5  # rows of a sheet among which its headings are
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def letters(n: int) -> str:
    """Spreadsheet letters of a 1-based column number."""
    if n < 1:
        raise ValueError(f"{n} isn't a column number")
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def _number(cell: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", cell)[0]:
        n = n * 26 + ord(c) - 64
    return n


def read(path: str) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """The name and the rows of each worksheet, read as they are asked for; numbers as their shortest text, booleans as true and false. The table of shared texts is held."""
    with zipfile.ZipFile(path) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as f:
                shared = ["".join(t.text or "" for t in s.iter(f"{_M}t")) for s in _each(f, f"{_M}si", f"{_M}sst")]
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = targets[s.get(_REL)].lstrip("/")
            with z.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                yield s.get("name"), _rows(f, shared)


def _each(f: IO[bytes], tag: str, parent: str) -> Iterator[ET.Element]:
    """The elements of a tag one by one; what was read is let go."""
    above = None
    for event, e in ET.iterparse(f, events=("start", "end")):
        if event == "end":
            if e.tag == tag:
                yield e
                above.clear()
        elif e.tag == parent:
            above = e


def _rows(f: IO[bytes], shared: list[str]) -> Iterator[list[str]]:
    done = 0
    for r in _each(f, f"{_M}row", f"{_M}sheetData"):
        while done < int(r.get("r", done + 1)) - 1:
            yield []
            done += 1
        row: list[str] = []
        for c in r:
            if c.tag != f"{_M}c":
                continue
            k = _number(c.get("r")) if c.get("r") else len(row) + 1
            if len(row) < k - 1:
                row += [""] * (k - 1 - len(row))
            kind = c.get("t")
            if kind == "inlineStr":
                text = "".join([t.text or "" for t in c.iter(f"{_M}t")])
            else:
                v = c.find(f"{_M}v")
                text = (v.text or "") if v is not None else ""
                if kind == "s":
                    text = shared[int(text)]
                elif kind == "b":
                    text = "true" if text == "1" else "false"
                elif text and re.fullmatch(r"-?\d+\.0+", text):
                    text = text.split(".")[0]
            row.append(text)
        yield row
        done += 1


def _validation(rows: list[list[str]], rules: dict[str, tuple]) -> tuple[int, str]:
    """The number of rows above the data, and what spreadsheets check in the cells below each heading: choices, bounds of numbers and of lengths."""
    top = next((i for i, r in enumerate(rows, 1) if any(str(v).startswith("!") and not str(v).startswith("!!") for v in r)), 0)
    if not top:
        return 0, ""
    if top < len(rows) and any(str(v).startswith("!") for v in rows[top]):
        top += 1
    made = []
    for j, head in enumerate(rows[top - 1], 1):
        kind, low, high, values = rules.get(head, ("", "", "", ""))
        at = f"{letters(j)}{top + 1}:{letters(j)}1048576"
        if kind == "Enum" and values and len(values) < 250:
            made.append(f'<dataValidation type="list" allowBlank="1" showErrorMessage="1" sqref="{at}"><formula1>{escape(chr(34) + values.replace(", ", ",") + chr(34))}</formula1></dataValidation>')
        elif kind.endswith(("Float", "Integer")) and (low or high):
            made.append(_between("whole" if kind.endswith("Integer") else "decimal", low, high, at))
        elif kind in ("String", "Regex", "Url", "Email", "Slug") and high:
            made.append(_between("textLength", low or "0", high, at))
    return top, f'<dataValidations count="{len(made)}">{"".join(made)}</dataValidations>' if made else ""


def _between(kind: str, low: str, high: str, at: str) -> str:
    how = ' operator="greaterThanOrEqual"' if not high else ' operator="lessThanOrEqual"' if not low else ""
    second = f"<formula2>{high}</formula2>" if low and high else ""
    return f'<dataValidation type="{kind}"{how} allowBlank="1" showErrorMessage="1" sqref="{at}"><formula1>{low or high}</formula1>{second}</dataValidation>'


def write(path: str, sheets: dict[str, Iterable[list[str]]], rules: dict[str, dict[str, tuple]] | None = None, protected: bool = False) -> None:
    """A workbook of text cells, names cut to the 31 characters that the format allows; headings are frozen, data can be filtered, cells are checked by
    rules (sheet -> heading -> (type, least, most, choices)), and protected sheets still let cells be filled in and formatted. Rows are written as they come."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{over}</Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {main} xmlns:r="{rel}"><sheets>{"".join(f"""<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>""" for k, n in enumerate(sheets, 1))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(f"""<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>""" for k in range(1, len(sheets) + 1))}<Relationship Id="s1" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<?xml version="1.0"?><styleSheet {main}><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf applyProtection="1"><protection locked="0"/></xf></cellXfs></styleSheet>')
        for k, (name, rows) in enumerate(sheets.items(), 1):
            rows = iter(rows)
            above = list(islice(rows, _TOP))
            top, checks = _validation(above, (rules or {}).get(name, {}))
            pane = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{top}" topLeftCell="A{top + 1}" state="frozen"/></sheetView></sheetViews>' if top else ""
            lock = '<sheetProtection sheet="1" formatCells="0" formatColumns="0" formatRows="0" insertRows="0" deleteRows="0" sort="0" autoFilter="0"/>' if protected else ""
            open_ = ' s="1"' if protected else ""
            last = wide = 0
            heads: list[str] = []
            with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=os.path.dirname(os.path.abspath(path)), suffix=".xml", delete_on_close=False) as f:  # the archive's header needs the size
                f.write(f'<?xml version="1.0"?><worksheet {main}>{pane}<sheetData>')
                for last, r in enumerate(chain(above, rows), 1):
                    wide = max(wide, len(r))
                    heads += [letters(j) for j in range(len(heads) + 1, wide + 1)]
                    style = open_ if last > top else ""
                    made = "".join([f'<c r="{at}{last}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for at, v in zip(heads, r) if v not in ("", None)])
                    f.write(f'<row r="{last}">{made}</row>')
                find = f'<autoFilter ref="A{top}:{letters(wide or 1)}{max(last, top)}"/>' if top else ""
                f.write(f"</sheetData>{lock}{find}{checks}</worksheet>")
                f.close()
                z.write(f.name, f"xl/worksheets/sheet{k}.xml")
