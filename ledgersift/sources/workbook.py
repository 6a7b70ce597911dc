"""Cells of a workbook (Office Open XML), read as a stream with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa

ROWS = 5000
#: Numbers of built-in formats that show a date or a time.
DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _text(e) -> str:
    """The runs of a text; phonetic notes are none."""
    return "".join(t.text or "" for part in e for t in ([part] if _tag(part) == "t" else part.iter() if _tag(part) == "r" else ()) if _tag(t) == "t")


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        return [_text(e) for _, e in ElementTree.iterparse(f) if _tag(e) == "si"]


def _dated(book: zipfile.ZipFile) -> list[bool]:
    """Of each cell style, whether it shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", e.get("formatCode", "")) for e in root.iter() if _tag(e) == "numFmt"}
    formats = [int(x.get("numFmtId", 0)) for e in root if _tag(e) == "cellXfs" for x in e]
    return [n in DATES or bool(re.search("[ymdhs]", own.get(n, ""), re.I)) for n in formats]


def _sheet(book: zipfile.ZipFile, name: str | None) -> str | None:
    """The file of the named sheet, or of the first."""
    links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _tag(e) == "sheet" and name in (None, e.get("name")):
            target = links[next(v for k, v in e.items() if k.rpartition("}")[2] == "id" and "}" in k)]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return None


def _place(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _cell(e, strings: list[str], dated: list[bool]) -> str | None:
    kind, value = e.get("t"), next((x for x in e if _tag(x) in ("v", "is")), None)
    if value is None:
        return None
    text = _text(value) if _tag(value) == "is" else value.text or ""
    if kind == "s":
        text = strings[int(text)]
    elif kind == "b":
        text = "TRUE" if text == "1" else "FALSE"
    elif kind in (None, "n") and text and int(e.get("s", 0)) < len(dated) and dated[int(e.get("s", 0))]:
        day = datetime(1899, 12, 30) + timedelta(seconds=round(float(text) * 86400))
        text = day.isoformat(sep=" ") if float(text) % 1 else day.date().isoformat()
    return text if text.strip() else None


def rows(data: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of cells as they are shown in the file: numbers as written, dates as ISO text; blank cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        file = _sheet(book, sheet)
        if file is None:
            return
        strings, dated = _strings(book), _dated(book)
        with book.open(file) as f:
            for _, e in ElementTree.iterparse(f):
                if _tag(e) == "row":
                    out: list[str | None] = []
                    for c in e:
                        at = _place(c.get("r", "")) if c.get("r") else len(out)
                        out += [None] * (at + 1 - len(out))
                        out[at] = _cell(c, strings, dated)
                    yield out
                    e.clear()


def batches(data: bytes, sheet: str | None, head_only: bool) -> Iterator[pa.RecordBatch]:
    """The header alone, or all rows after it with their numbers; wholly blank rows are left out."""
    held, number, head = [], 0, None
    schema = pa.schema([("cells", pa.list_(pa.string())), ("_row_no", pa.int64())])
    for row in rows(data, sheet):
        if not any(x is not None for x in row):
            continue
        if head is None:
            head = row
            if head_only:
                yield pa.RecordBatch.from_pylist([{"cells": head, "_row_no": 0}], schema)
                return
            continue
        number += 1
        held.append({"cells": row, "_row_no": number})
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
