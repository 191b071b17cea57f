"""Spreadsheet workbooks as a table.

Workbooks are read as binary files, so any file system Spark knows will do, and
parsed inside tasks: one workbook is one record, bounded by the row limit of the
format, and many workbooks are read in parallel.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import check_value, option, relative_path, under_root
from ..errors import ConfigError, DataError, SchemaError
from ..session import scratch_path
from ..table import HIDDEN, OrderKey, Table, col

BATCH_ROWS = 8192

CELLS = "file string, row long, header boolean, cells array<string>"
_CELL_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("row", pa.int64()),
        ("header", pa.bool_()),
        ("cells", pa.list_(pa.string())),
    ]
)


@dataclass(frozen=True)
class WorkbookSource:
    """Read one sheet, named or first, of every workbook at a path.

    All workbooks must have the same columns.  Columns without a name are called
    `column_1`, `column_2` and so on; empty cells are null and empty rows are left
    out.  A column is a number, a boolean or a datetime if all its cells are; text
    cells stay text even if they spell a number.
    """

    source_path: str = option("text", key="sourcePath")
    sheet_name: str | None = option("text", key="sheetName", default=None)
    has_header: bool = option("boolean", key="hasHeader", default=True)

    def __post_init__(self) -> None:
        relative_path(self.source_path)
        check_value("boolean", "hasHeader", self.has_header)
        if self.sheet_name is not None and (
            not isinstance(self.sheet_name, str) or not self.sheet_name.strip()
        ):
            raise ConfigError("sheetName must not be empty.")

    def __call__(self, spark: SparkSession, root: str) -> Table:
        path = under_root(root, relative_path(self.source_path))
        try:
            files = spark.read.format("binaryFile").load(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error.getCondition()):
                raise DataError("The workbook source is not available.") from None
            raise
        return self.read(files)

    def read(self, workbooks: DataFrame) -> Table:
        """Parse a frame with the columns `path` and `content`.

        The cells are written to the shared folder, so that every workbook is parsed
        once; names and types are then found in that table (three actions).
        """
        spark = workbooks.sparkSession
        files = workbooks.select("path", "content")
        parsed = files.mapInArrow(_sheet_reader(self.sheet_name, self.has_header), CELLS)
        path = scratch_path(spark, "cells")
        parsed.write.parquet(path)
        cells = spark.read.parquet(path)
        # A header row holds the names and, as its number, the width of the sheet.
        # Names differ only if workbooks do, so their distinct lists are one row.
        widths = cells.where("header").groupBy("cells").agg(F.max("row").alias("width"))
        headers = widths.limit(2).collect()
        if len(headers) != 1:
            reason = "have different columns" if headers else "hold no rows"
            raise SchemaError(f"The workbooks {reason}.")
        given = dict(enumerate(headers[0]["cells"]))
        names = [(given.get(i) or f"tcolumn_{i + 1}")[1:] for i in range(headers[0]["width"])]
        if len(set(names)) != len(names):
            raise SchemaError("A workbook has two columns of one name.")
        rows = cells.where("NOT header")
        marked = rows.select(
            *[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)],
            F.col("file").alias(f"{HIDDEN}0"),
            F.col("row").alias(f"{HIDDEN}1"),
        )
        columns = [_typed(n, t).alias(n) for n, t in _cell_types(marked, names).items()]
        order = (OrderKey(f"{HIDDEN}0"), OrderKey(f"{HIDDEN}1"))
        return Table(marked.select(*columns, *[k.column for k in order]), order)


def _cell_types(marked: DataFrame, names: list[str]) -> dict[str, str]:
    """A column has the type all its filled cells share, and is text otherwise."""
    counts = []
    for i, name in enumerate(names):
        mark = F.left(col(name), F.lit(1))
        number = _content(name).try_cast("double")
        whole = (mark == "n") & (number == F.floor(number)) & (F.abs(number) < 2.0**63)
        tests = {"filled": mark.isNotNull(), "whole": whole}
        tests |= {kind: mark == kind for kind in ("n", "b", "d")}
        counts += [F.count_if(test).alias(f"{kind}_{i}") for kind, test in tests.items()]
    row = marked.agg(*counts).first()
    types = {}
    for i, name in enumerate(names):
        filled = row[f"filled_{i}"]
        kinds = {"whole": "bigint", "n": "double", "b": "boolean", "d": "timestamp_ntz"}
        shared = (t for kind, t in kinds.items() if filled and row[f"{kind}_{i}"] == filled)
        types[name] = next(shared, "string")
    return types


def _content(name: str) -> Column:
    """The text of a cell without its leading kind mark."""
    return F.substring(col(name), 2, 2**31 - 1)


def _typed(name: str, type_name: str) -> Column:
    content = _content(name)
    if type_name == "string":
        return content
    if type_name == "bigint":
        return content.try_cast("double").cast("bigint")
    return content.try_cast(type_name)


def _sheet_reader(sheet_name: str | None, has_header: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                part: list[tuple] = []
                for item in _numbered(content.as_py(), sheet_name, has_header):
                    part.append((path.as_py(), *item))
                    if len(part) == BATCH_ROWS:
                        yield _packed(part)
                        part = []
                if part:
                    yield _packed(part)

    return read


def _packed(part: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(v, type=f.type) for v, f in zip(zip(*part), _CELL_ARROW)]
    return pa.RecordBatch.from_arrays(arrays, schema=_CELL_ARROW)


def _numbered(
    content: bytes, sheet_name: str | None, has_header: bool
) -> Iterator[tuple[int, bool, list[str | None]]]:
    """The data rows of a sheet and, last, its header row without trailing gaps."""
    header: list[str | None] | None = None
    width = number = 0
    for row in sheet_rows(content, sheet_name):
        while row and row[-1] is None:
            row.pop()
        if not row:
            continue
        width = max(width, len(row))
        if header is None:
            header = row if has_header else []
            if has_header:
                continue
        number += 1
        yield number, False, row
    if header is not None:
        yield width, True, header


# The parts and namespaces of the workbook format, and the number
# formats that show a date or time.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_DOC_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_WORKBOOK = "xl/workbook.xml"
_LINKS = "xl/_rels/workbook.xml.rels"
_SHARED = "xl/sharedStrings.xml"
_STYLES = "xl/styles.xml"
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_DATE_LETTERS = re.compile(r"[dmyhs]", re.IGNORECASE)
_QUOTED_FORMAT = re.compile(r'"[^"]*"|\\.|_.|\[[^\]]*\]')
_EPOCHS = {False: dt.datetime(1899, 12, 30), True: dt.datetime(1904, 1, 1)}


@dataclass(frozen=True)
class _Book:
    """What cells refer to: shared texts, date styles and the first day."""

    shared: list[str]
    date_styles: set[int]
    epoch: dt.datetime


def sheet_rows(content: bytes, sheet_name: str | None) -> Iterator[list[str | None]]:
    """The rows of one sheet, streamed; a cell is its kind mark and its text.

    Marks: `n` number, `b` boolean, `d` datetime, `t` text.
    """
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        workbook = ElementTree.fromstring(archive.read(_WORKBOOK))
        places = {s.get("name"): s.get(_DOC_REL) for s in workbook.iter(f"{_MAIN}sheet")}
        wanted = sheet_name if sheet_name is not None else next(iter(places))
        if wanted not in places:
            raise DataError("A workbook has no sheet of the configured name.")
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(archive.read(_LINKS))}
        target = links[places[wanted]]
        part = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
        properties = workbook.find(f"{_MAIN}workbookPr")
        late = properties is not None and properties.get("date1904") in ("1", "true")
        book = _Book(_shared_strings(archive), _date_styles(archive), _EPOCHS[late])
        with archive.open(posixpath.normpath(part)) as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if element.tag == f"{_MAIN}row":
                    yield _cells(element, book)
                    element.clear()
    except (zipfile.BadZipFile, ElementTree.ParseError, LookupError, ValueError, OverflowError):
        raise DataError("A workbook could not be read.") from None


def _shared_strings(archive: zipfile.ZipFile) -> list[str]:
    if _SHARED not in archive.namelist():
        return []
    items = ElementTree.fromstring(archive.read(_SHARED)).iter(f"{_MAIN}si")
    return [_plain_text(item) for item in items]


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """The cell styles whose number format shows a date or time."""
    if _STYLES not in archive.namelist():
        return set()
    styles = ElementTree.fromstring(archive.read(_STYLES))
    dates = set(_DATE_FORMATS)
    for own in styles.iter(f"{_MAIN}numFmt"):
        if _DATE_LETTERS.search(_QUOTED_FORMAT.sub("", own.get("formatCode", ""))):
            dates.add(int(own.get("numFmtId")))
    cells = styles.find(f"{_MAIN}cellXfs")
    formats = [int(xf.get("numFmtId", 0)) for xf in cells] if cells is not None else []
    return {style for style, number in enumerate(formats) if number in dates}


def _plain_text(item: ElementTree.Element) -> str:
    """Text of a string item: its own or its runs', without phonetic hints."""
    parts = [t.text or "" for t in item.findall(f"{_MAIN}t")]
    parts += [t.text or "" for t in item.findall(f"{_MAIN}r/{_MAIN}t")]
    return "".join(parts)


def _cells(row: ElementTree.Element, book: _Book) -> list[str | None]:
    cells: list[str | None] = []
    for cell in row.iter(f"{_MAIN}c"):
        reference = re.match(r"[A-Z]+", cell.get("r") or "")
        place = _column_index(reference.group()) if reference else len(cells)
        cells += [None] * (place + 1 - len(cells))
        cells[place] = _cell(cell, book)
    return cells


def _column_index(letters: str) -> int:
    index = 0
    for letter in letters:
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _cell(cell: ElementTree.Element, book: _Book) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = cell.find(f"{_MAIN}is")
        return "t" + _plain_text(inline) if inline is not None else None
    value = cell.findtext(f"{_MAIN}v")
    if not value or kind == "e":
        return None
    if kind == "s":
        return "t" + book.shared[int(value)]
    if kind == "b":
        return "btrue" if value == "1" else "bfalse"
    if kind == "d":
        return "d" + value
    if kind != "n":
        return "t" + value
    if int(cell.get("s", 0)) in book.date_styles:
        moment = book.epoch + dt.timedelta(milliseconds=round(float(value) * 86_400_000))
        return "d" + moment.isoformat(sep=" ")
    return "n" + value
