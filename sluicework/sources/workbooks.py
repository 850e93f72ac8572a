"""Workbooks as a data source of their own: cells of all sheets, or the rows of one sheet under a schema; and a sink.

    workbooks.register(spark)
    spark.read.format("workbook").load(folder).where("sheet = 'Items'")                     # cells
    spark.read.format("workbook").schema("Code string, Qty double, _line int").option("sheet", "Items").load(folder)
    df.write.format("workbook").option("sheet", "Items").mode("append").save(folder)        # a workbook a task

Each sheet of each workbook is a partition of its own. Filters on `sheet` are pushed down: other sheets are not opened, and where sheets are named, workbooks are opened by tasks
alone. A schema names the headers that are read; other columns are passed over. Sheets are read and written row by row, so that a task holds a row and the
workbook's shared texts. Files are opened through the Arrow file systems, so that nothing passes the driver but names.

Defined results under a schema: the first row is the header; a sheet that is missing or has no rows, a header that is missing or repeated, a formula or error in a
column that is read stop the query, with the workbook, the sheet and the row; rows without any value are skipped; a cell that is no number is null in a
column of numbers; `_line` is the row's number in the file and `_path` the workbook. Reading a folder without workbooks gives no rows. Written texts keep
characters that XML has no place for (as _xHHHH_); null and NaN leave a cell out; a sheet that is full goes on in another workbook.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.shipping import ship
from .xlsx import _MAIN, _REL, _cell, column_letters, column_number

CELLS = "path string, sheet string, row int, column int, value string, kind string"
#: Rows of a batch that a reader hands on, and data rows of a sheet, which has one row for the header (the format's limit: a fixed value).
BATCH, SHEET_ROWS = 2_000, 1_048_575
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_ILLEGAL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\r]|_(?=x[0-9A-Fa-f]{4}_)")


def _text(value: str | None) -> str | None:
    return value and _ESCAPED.sub(lambda m: chr(int(m[1], 16)), value)


def _elements(file, parent: str, child: str) -> Iterator[ElementTree.Element]:
    """The children of an element one by one; what has been seen is let go."""
    held = None
    for event, e in ElementTree.iterparse(file, events=("start", "end")):
        if event == "start" and e.tag == f"{_MAIN}{parent}":
            held = e
        elif event == "end" and e.tag == f"{_MAIN}{child}" and held is not None:
            yield e
            held.clear()


class _Book:
    """A workbook's sheets, opened one at a time."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.path, self.zip = path, zipfile.ZipFile(fs.open_input_file(name))
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        found = [(s.get("name"), targets[s.get(f"{_REL}id")]) for s in ElementTree.fromstring(self.zip.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        self.sheets = {n: t if t.startswith("xl/") else f"xl/{t}" for n, t in found}

    def rows(self, sheet: str) -> Iterator[tuple[int, list[tuple[int, str | None, str]]]]:
        """(row from 1, its cells: column from 0, value, kind n, s, b, e or f) one by one."""
        shared: list[str] = []
        if "xl/sharedStrings.xml" in self.zip.namelist():
            shared = [_text("".join(t.text or "" for t in e.iter(f"{_MAIN}t"))) for e in _elements(self.zip.open("xl/sharedStrings.xml"), "sst", "si")]
        at = 0
        for row in _elements(self.zip.open(self.sheets[sheet]), "sheetData", "row"):
            at = int(row.get("r") or at + 1)
            found, column = [], -1
            for c in row:
                column = column_number(c.get("r")) if c.get("r") else column + 1
                kind, v = c.get("t", "n"), c.find(f"{_MAIN}v")
                value = v.text if v is not None else None
                if kind == "inlineStr":
                    value, kind = _text("".join(t.text or "" for t in c.iter(f"{_MAIN}t"))), "s"
                elif kind == "s":
                    value = shared[int(value)] if value is not None else None
                elif kind == "str":
                    value, kind = _text(value), "s"
                found.append((column, value, "f" if c.find(f"{_MAIN}f") is not None else kind))
            yield at, found


def sheets_of(path: str) -> list[str]:
    return list(_Book(path).sheets)


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self.options.get("sheet"), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        if overwrite:
            raise ValueError("workbooks are added to a folder, never written over")
        return WorkbookWriter(self.options["path"], self.options.get("sheet", "Sheet1"), schema.names, int(self.options.get("sheetRows", SHEET_ROWS)))


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, schema: StructType):
        self.path, self.sheet, self.schema = path, sheet, schema
        self.cells = schema.names == [c.split(" ")[0] for c in CELLS.split(", ")]
        if not self.cells and sheet is None:
            raise ValueError("a schema asks for the option `sheet`")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if self.cells and isinstance(f, EqualTo) and f.attribute == ("sheet",) and self.sheet in (None, f.value):
                self.sheet = f.value
            else:
                yield f

    def partitions(self) -> list[Sheet]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        prefix = self.path.removesuffix(root)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        books = sorted(prefix + i.path for i in found if i.is_file and i.base_name.lower().endswith(".xlsx") and i.base_name[0] not in "._~")
        if self.sheet is not None:
            return [Sheet(b, self.sheet) for b in books] or [Sheet("", "")]
        with ThreadPoolExecutor(16) as pool:
            return [Sheet(b, s) for b, names in zip(books, pool.map(sheets_of, books), strict=True) for s in names] or [Sheet("", "")]

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        held: list[tuple] = []
        for row in self._rows(partition) if partition.path else ():
            held.append(row)
            if len(held) == BATCH:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    def _rows(self, at: Sheet) -> Iterator[tuple]:
        book = _Book(at.path)
        if self.cells:
            for n, row in book.rows(at.sheet) if at.sheet in book.sheets else ():
                yield from ((at.path, at.sheet, n, *c) for c in row)
            return
        if at.sheet not in book.sheets:
            raise ValueError(f"{at.path}: no sheet {at.sheet!r}")
        rows = book.rows(at.sheet)
        head = [(c, (v or "").strip()) for c, v, _ in next(rows, (1, []))[1]]
        wanted = [f for f in self.schema.fields if f.name not in ("_line", "_path")]
        for f in wanted:
            if (n := sum(v == f.name for _, v in head)) != 1:
                raise ValueError(f"{at.path}, sheet {at.sheet!r}: column {f.name!r} {'is missing' if not n else 'is repeated'}")
        place = {v: c for c, v in head}
        casts = {f.name: _CASTS.get(f.dataType.simpleString(), _text_of) for f in wanted}
        empty = True
        for n, row in rows:
            by = {c: (v, k) for c, v, k in row if v is not None or k in ("f", "e")}
            if not by:
                continue
            empty = False
            got = {name: by.get(place[name], (None, "n")) for name in casts}
            if any(k in ("f", "e") for _, k in got.values()):
                raise ValueError(f"{at.path}, sheet {at.sheet!r}, row {n}: formula or error")
            own = {name: casts[name](v, k) for name, (v, k) in got.items()} | {"_line": n, "_path": at.path}
            yield tuple(own[name] for name in self.schema.names)
        if empty:
            raise ValueError(f"{at.path}, sheet {at.sheet!r} is empty")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _text_of(value: str | None, kind: str) -> str | None:
    return {"0": "FALSE", "1": "TRUE"}.get(value, value) if kind == "b" else value


def _real(value: str | None, kind: str) -> float | None:
    try:
        return float(value) if value is not None and "_" not in value and kind != "b" else None
    except ValueError:
        return None


def _whole(value: str | None, kind: str) -> int | None:
    if value is not None and re.fullmatch(r"\s*[+-]?[0-9]+\s*", value) and kind != "b":
        return int(value)
    number = _real(value, kind)
    return int(number) if number is not None and number == number and abs(number) < 2**53 and number == int(number) else None


_CASTS = {"double": _real, "bigint": _whole, "int": _whole, "boolean": lambda v, k: {"1": True, "0": False}.get(v) if k == "b" else None}


class WorkbookWriter(DataSourceArrowWriter):
    """A task's rows as workbooks of one sheet, under hidden names until all tasks are done."""

    def __init__(self, path: str, sheet: str, names: list[str], rows: int):
        self.path, self.sheet, self.names, self.rows = path, sheet, names, rows
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        rows = (r for b in iterator for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made: list[str] = []
        first = next(rows, None)
        while first is not None:
            made.append(f"part-{self.job}-{uuid.uuid4().hex}.xlsx")
            first = self._book(made[-1], first, rows)
        return Written(made)

    def _book(self, name: str, first: tuple, rows: Iterator[tuple]) -> tuple | None:
        """One workbook from the first row on; the row that it has no room for."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        main, rel = _MAIN.strip("{}"), _REL.strip("{}")
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        package = "http://schemas.openxmlformats.org/package/2006"
        with fs.open_output_stream(f"{root}/._{name}", compression=None) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>')
            z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name={quoteattr(self.sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
            with z.open("xl/worksheets/sheet1.xml", "w") as body:
                body.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                body.write(_row(1, self.names))
                at: tuple | None = first
                for n in range(2, self.rows + 2):
                    body.write(_row(n, at))
                    at = next(rows, None)
                    if at is None:
                        break
                body.write(b"</sheetData></worksheet>")
        return at

    def commit(self, messages: list[Written]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{root}/._{name}", f"{root}/{name}")
        self.abort(messages)  # what other attempts have left

    def abort(self, messages: list[Written]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if i.base_name.startswith(f"._part-{self.job}-"):
                fs.delete_file(i.path)


def _row(n: int, values: Iterable) -> bytes:
    legal = (_ILLEGAL.sub(lambda m: f"_x{ord(m[0]):04X}_", v) if isinstance(v, str) else v for v in values)
    return f'<row r="{n}">{"".join(_cell(f"{column_letters(k)}{n}", v) for k, v in enumerate(legal))}</row>'.encode()


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets its filters be pushed down."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
