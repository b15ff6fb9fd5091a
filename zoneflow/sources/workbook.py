"""Sheets of .xlsx workbooks as a Spark data source.

A workbook is a zip of XML parts; a sheet holds 1,048,576 rows at most, so each workbook is one split, its rows are parsed as a stream
and leave in batches. Rows come as text cells by position: `file, row, cells`. Writing makes one workbook a task.
"""

from __future__ import annotations

import io
import re
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from zoneflow.sources import files

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Fixed values of the format: name spaces, rows and letters of a sheet's last column.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
BATCH_ROWS = 5_000
SCHEMA = "file string, row bigint, cells array<string>"


def column_number(reference: str) -> int:
    """Position of a cell from 0 by the letters of its reference."""
    number = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    if number > MOST_COLUMNS:
        raise ValueError(f"no cell {reference!r}")
    return number - 1


def column_letters(number: int) -> str:
    letters = ""
    number += 1
    while number:
        number, rest = divmod(number - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def text_of(element: ElementTree.Element) -> str:
    """All text runs of a string item, without phonetic readings."""
    runs = [element.find(f"{MAIN}t"), *(r.find(f"{MAIN}t") for r in element.findall(f"{MAIN}r"))]
    return "".join(t.text or "" for t in runs if t is not None)


def sheets_of(book: zipfile.ZipFile) -> dict[str, str]:
    """Part of each sheet, by its name, in order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = {}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = targets[sheet.get(RELATION)]
        found[sheet.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return found


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    strings = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, item in ElementTree.iterparse(part):
            if item.tag == f"{MAIN}si":
                strings.append(text_of(item))
                item.clear()
    return strings


def cell_text(cell: ElementTree.Element, strings: list[str]) -> str | None:
    kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        inline = cell.find(f"{MAIN}is")
        return None if inline is None else text_of(inline)
    if value is None or kind == "e":
        return None
    return strings[int(value)] if kind == "s" else value


def rows_of(book: zipfile.ZipFile, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
    """Row number from 1 and cells by position, of every row that has any."""
    parts = sheets_of(book)
    if sheet.startswith("#"):
        names = list(parts)
        if int(sheet[1:]) >= len(names):
            return
        sheet = names[int(sheet[1:])]
    if sheet not in parts:
        return
    strings, number = shared_strings(book), 0
    with book.open(parts[sheet]) as part:
        for _, row in ElementTree.iterparse(part):
            if row.tag != f"{MAIN}row":
                continue
            number, cells = int(row.get("r", number + 1)), []
            for cell in row.iter(f"{MAIN}c"):
                at = column_number(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = cell_text(cell, strings)
            row.clear()
            if any(c is not None for c in cells):
                yield number, cells


@dataclass
class Book(InputPartition):
    path: str


class WorkbookReader(DataSourceReader):
    def __init__(self, root: str, sheet: str):
        self.root, self.sheet = root, sheet

    def partitions(self) -> list[Book]:
        return [Book(path) for path in files.listed(self.root, ".xlsx")]

    def read(self, split: Book) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            numbers, cells = zip(*rows, strict=True)
            columns = [pa.array([split.path] * len(rows)), pa.array(numbers, pa.int64()), pa.array(cells, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["file", "row", "cells"])

        held = []
        with files.located(self.root)[0].open_input_file(split.path) as file, zipfile.ZipFile(file) as book:
            for row in rows_of(book, self.sheet):
                held.append(row)
                if len(held) >= BATCH_ROWS:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)


@dataclass
class Written(WriterCommitMessage):
    staged: list[str]


class WorkbookWriter(DataSourceWriter):
    def __init__(self, root: str, sheet: str, names: list[str], numbers: list[bool]):
        self.root, self.sheet, self.names, self.numbers = root, sheet, names, numbers

    def write(self, rows: Iterator) -> Written:
        folder = files.located(self.root)[1].rstrip("/")
        name = f"{folder}/_staging/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.xlsx"
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as book:
            for part, text in fixed_parts(self.sheet).items():
                book.writestr(part, text)
            with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                sheet.write(f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                sheet.write(row_xml(1, self.names, [False] * len(self.names)))
                for number, row in enumerate(rows, 2):
                    if number > MOST_ROWS:
                        raise ValueError(f"a sheet holds {MOST_ROWS} rows at most; write more, smaller partitions")
                    sheet.write(row_xml(number, row, self.numbers))
                sheet.write(b"</sheetData></worksheet>")
        files.write_whole(self.root, name, data.getvalue())
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        files.publish(self.root, [name for m in messages if m for name in m.staged], files.located(self.root)[1].rstrip("/"))

    def abort(self, messages: list[Written | None]) -> None:
        files.withdraw(self.root, files.located(self.root)[1].rstrip("/"))


def row_xml(number: int, values: list, numbers: list[bool]) -> bytes:
    cells = []
    for i, (value, is_number) in enumerate(zip(values, numbers, strict=True)):
        at = f"{column_letters(i)}{number}"
        if value is not None and is_number:
            cells.append(f'<c r="{at}"><v>{value!r}</v></c>')
        elif value is not None:
            cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'.encode()


def fixed_parts(sheet: str) -> dict[str, str]:
    """The parts besides the sheet that every workbook needs."""
    package, office = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    name = escape(sheet, {'"': "&quot;"})
    return {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}/relationships"><sheets><sheet name="{name}" sheetId="1" r:id="r1"/></sheets></workbook>',
    }


class Workbooks(DataSource):
    """Format `workbook`: an .xlsx file or a folder of them. Options: path, sheet (its name, or `#` and its position from 0; default `#0`)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self.options.get("sheet", "#0"))

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        numbers = [isinstance(f.dataType, (T.IntegralType, T.DoubleType)) for f in schema]
        return WorkbookWriter(self.options["path"], self.options.get("sheet", "Sheet1"), schema.names, numbers)
