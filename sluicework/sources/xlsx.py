"""Workbooks as rows: whole files read in tasks, and a sink for reports and for a template's cells. `workbooks` is the data source.

Only the standard library is used. A sheet's row number in the file is kept, since order there has a meaning.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def cells(content: bytes) -> Iterator[tuple[str, int, int, str | None, str]]:
    """(sheet, row from 1, column from 0, value, kind: n, s, b, e or f for a formula)."""
    z = zipfile.ZipFile(BytesIO(content))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si"):
            shared.append("".join(t.text or "" for t in si.iter(f"{_MAIN}t")))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(f"{_REL}id")].lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        for row in ElementTree.fromstring(z.read(path)).iter(f"{_MAIN}row"):
            for c in row.iter(f"{_MAIN}c"):
                kind = c.get("t", "n")
                v = c.find(f"{_MAIN}v")
                text = v.text if v is not None else None
                if kind == "s" and text is not None:
                    text, kind = shared[int(text)], "s"
                elif kind == "inlineStr":
                    text, kind = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")), "s"
                elif kind == "str":
                    kind = "s"
                if c.find(f"{_MAIN}f") is not None:
                    kind = "f"
                yield sheet.get("name"), int(row.get("r")), column_number(c.get("r")), text, kind


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, column, value, kind) of every workbook that the path names; files are spread over tasks."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = [(p, *c) for c in cells(content)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["path", "sheet", "row", "column", "value", "kind"])

    from ..functions.shipping import ship

    ship(spark)
    return files.mapInArrow(run, "path string, sheet string, row int, column int, value string, kind string")


def read_sheet(spark: SparkSession, path: str, sheet: str, required: list[str]) -> DataFrame:
    """The sheet's rows with `required` columns as strings and `_line`, the row's number in the file.

    The first row is the header. Errors: a sheet that is missing or has no rows, a required header that is missing or repeated, a formula or error in a required column. Rows without any value are skipped.
    """
    found = read_cells(spark, path).where(F.col("sheet") == sheet)
    head = found.where("row = 1 and value is not null").select("column", F.trim("value").alias("name")).collect()  # a header
    if not head:
        raise ValueError(f"no sheet {sheet!r}")
    names = [r.name for r in head]
    for r in required:
        if names.count(r) != 1:
            raise ValueError(f"sheet {sheet!r}: column {r!r} {'is missing' if r not in names else 'is repeated'}")
    at = {r.name: r.column for r in head}
    body = found.where("row > 1")
    wrong = body.where(F.col("column").isin([at[r] for r in required]) & F.col("kind").isin("f", "e")).select("row").first()
    if wrong:
        raise ValueError(f"sheet {sheet!r}, row {wrong.row}: formula or error")
    rows = body.groupBy("path", F.col("row").alias("_line")).agg(*(F.max(F.when(F.col("column") == at[r], F.col("value"))).alias(r) for r in required))
    rows = rows.where(F.coalesce(*(F.col(f"`{r}`") for r in required)).isNotNull()).drop("path")
    if rows.isEmpty():
        raise ValueError(f"sheet {sheet!r} is empty")
    return rows


#: Sheets of a bank, the columns that its units, curves and a sheet of cases must have, and those that cases may have (fixed values).
BANK = ("Metadata", "Curves")
UNIT_COLUMNS = ["ID", "manufacturer", "model", "poles", "baseSpeedRPM", "baseFreq", "motorEfficiency", "motorPowerKW", "minSubmergenceMM", "impellerAxisMM", "voltageV", "massKG", "Qbep", "Hbep", "Eta1bep", "NPSHbep"]
CURVE_COLUMNS = ["ID", "Q", "H", "Eta1", "NPSH"]
CASE_COLUMNS = {"Name": "name", "Q_Lps": "flow", "StaticHeadMin_m": "static_min", "StaticHeadMax_m": "static_max", "HeadMin_m": "head_min", "HeadMax_m": "head_max", "Altitude_m": "altitude", "Mode": "mode"}
CASE_MORE = {"Temperature_C": "temperature", "SuctionLoss_m": "suction_loss", "VaporHead_m": "vapor_head", "ManualIDs": "ids"}


def read_bank(spark: SparkSession, path: str, unit_columns: list[str] | None = None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(units, curves, abacus grids by maker) of a bank's workbook: both sheets must be there; sheets `Abacus_<maker>` are grids.

    Units are texts by column and `_line`; curves are (unit_id, i, q, h, eta, npsh), numbers that are none being null.
    """
    names = [r.sheet for r in read_cells(spark, path).select("sheet").distinct().collect()]  # a workbook's sheets
    missing = sorted(set(BANK) - set(names))
    if missing:
        raise ValueError("missing sheets: " + ", ".join(missing))
    units = read_sheet(spark, path, BANK[0], unit_columns or UNIT_COLUMNS)
    rows = read_sheet(spark, path, BANK[1], CURVE_COLUMNS)
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    curves = rows.select(F.trim("ID").alias("unit_id"), F.col("_line").alias("i"), number("Q").alias("q"), number("H").alias("h"), number("Eta1").alias("eta"), number("NPSH").alias("npsh"))
    return units, curves, {n.removeprefix("Abacus_"): melt_grid(spark, path, n) for n in sorted(names) if n.startswith("Abacus_")}


def read_cases(spark: SparkSession, path: str, sheet: str = "Cases") -> DataFrame:
    """A sheet of cases in order of `line`: numbers, modes and lists of ids read, what is empty or has no column by default."""
    from ..operators import validation

    head = read_cells(spark, path).where((F.col("sheet") == sheet) & (F.col("row") == 1)).select(F.trim("value").alias("name")).collect()
    more = {k: v for k, v in CASE_MORE.items() if k in {r.name for r in head}}
    rows = read_sheet(spark, path, sheet, [*CASE_COLUMNS, *more]).withColumnsRenamed({**CASE_COLUMNS, **more, "_line": "line"})
    numbers = [v for v in CASE_COLUMNS.values() if v not in ("name", "mode")]
    rows = rows.withColumns({v: F.expr(f"try_cast(`{v}` AS DOUBLE)") for v in numbers} | {v: F.lit(None).cast("string") for k, v in CASE_MORE.items() if k not in more})
    return validation.cases(rows)


def sheet_names(wanted: list[str], reserved: tuple[str, ...] = ("history",)) -> list[str]:
    """Legal names of at most 31 characters, unique whatever the case."""
    used = {r.lower() for r in reserved}
    out = []
    for w in wanted:
        base = re.sub(r"[\[\]:*?/\\]", "_", w)[:31] or "Sheet"
        name, k = base, 0
        while name.lower() in used:
            k += 1
            name = base[: 31 - len(f"_{k}")] + f"_{k}"
        used.add(name.lower())
        out.append(name)
    return out


def _cell(ref: str, v) -> str:
    if v is None or v != v:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def write_workbook(path: str, sheets: dict[str, tuple[list[str], list[tuple]]]) -> list[str]:
    """A workbook of reports, each (headers, rows) small enough to be read by people; nulls and NaN are left out. Returns the names used."""
    names = sheet_names(list(sheets))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        for i, (headers, rows) in enumerate(sheets.values(), 1):
            lines = "".join(f'<row r="{r}">' + "".join(_cell(f"{column_letters(k)}{r}", v) for k, v in enumerate(row)) + "</row>" for r, row in enumerate([tuple(headers), *rows], 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{lines}</sheetData></worksheet>')
    return names


def melt_grid(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A two-way sheet long: (head, flow, unit_id, row_pos, col_pos); headers that are no numbers and blank cells are skipped."""
    found = read_cells(spark, path).where(F.col("sheet") == sheet)
    flows = found.where("row = 1 and column > 0").select(F.col("column").alias("c"), F.expr("try_cast(value AS DOUBLE)").alias("flow")).where("flow is not null")
    heads = found.where("row > 1 and column = 0").select(F.col("row").alias("r"), F.expr("try_cast(value AS DOUBLE)").alias("head")).where("head is not null")
    body = found.where("row > 1 and column > 0 and trim(coalesce(value, '')) != ''")
    return body.join(flows, F.col("column") == F.col("c")).join(heads, F.col("row") == F.col("r")).select("head", "flow", F.trim("value").alias("unit_id"), F.col("row").alias("row_pos"), F.col("column").alias("col_pos"))
