"""Workbooks without a library: sheets are XML in a zip file, parsed on an executor, all cells as text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.session import cut
from concord.sources.files import unique_names

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
ROWS = 4096


def _column(ref: str) -> int:
    """Place of a cell from its reference, ``AB7`` to 27."""
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _sheet_path(book: zipfile.ZipFile, sheet: str | int) -> str:
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{_MAIN}sheets/{_MAIN}sheet")
    own = sheets[sheet] if isinstance(sheet, int) else next(s for s in sheets if s.get("name") == sheet)
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == own.get(f"{_REL}id"))
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def cells(content: bytes, sheet: str | int) -> Iterator[list[str | None]]:
    """Rows of a sheet, gaps as nulls; numbers as they are written, so ids kept as text keep their digits."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        with book.open(_sheet_path(book, sheet)) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                out: list[str | None] = []
                for i, cell in enumerate(row.iter(f"{_MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else i
                    out += [None] * (at + 1 - len(out))
                    value = cell.find(f"{_MAIN}v")
                    if cell.get("t") == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                    elif value is not None and value.text is not None:
                        out[at] = shared[int(value.text)] if cell.get("t") == "s" else value.text
                yield out
                row.clear()


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, header: bool = True) -> DataFrame:
    """A sheet, by name or place, as text columns: the first row's names, or ``_1``, ``_2`` and so on by position."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                held, first = [], 0
                for row in cells(content, sheet):
                    held.append(row)
                    if len(held) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.list_(pa.string()))], names=["n", "cells"])
                        held, first = [], first + len(held)
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(held)), pa.int64()), pa.array(held, pa.list_(pa.string()))], names=["n", "cells"])

    rows = cut(spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "n long, cells array<string>"), "sheet")
    head = rows.where("n = 0").first()
    wide = len(head["cells"]) if head and header else (rows.agg(F.max(F.size("cells"))).first()[0] or 0)
    names = unique_names([(c or "").strip() or f"Unnamed: {i}" for i, c in enumerate(head["cells"])]) if head and header else [f"_{i + 1}" for i in range(wide)]
    body = rows.where("n > 0") if header else rows
    return body.select(*[F.nullif(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])
