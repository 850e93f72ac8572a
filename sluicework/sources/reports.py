"""Reports: Markdown of verdicts, LaTeX of material lists, cell maps of selections, manifests as delimited text."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable
from io import BytesIO
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import text as tx

SEVERITY = {"reprovado": 0, "revisar": 1, "aprovado": 2}


def verdict_lines(rows: DataFrame) -> DataFrame:
    """(part, place, line) of a report: counts by verdict, a table by severity and id, a bullet for each reason. rows: id, verdict, rejects, reviews (arrays)."""
    rank = F.coalesce(*(F.when(F.col("verdict") == v, k) for v, k in SEVERITY.items()), F.lit(9))
    counts = rows.groupBy("verdict").agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), F.struct(rank.alias("a"), F.lit("").alias("b"), F.lit(0).alias("c")).alias("place"), F.concat(F.lit("- "), "verdict", F.lit(": "), F.col("n").cast("string")).alias("line"))
    table = rows.select(F.lit(1).alias("part"), F.struct(rank.alias("a"), F.col("id").alias("b"), F.lit(0).alias("c")).alias("place"), F.concat(F.lit("| "), "id", F.lit(" | "), "verdict", F.lit(" | "), F.size("rejects").cast("string"), F.lit(" | "), F.size("reviews").cast("string"), F.lit(" |")).alias("line"))
    reasons = rows.select(rank.alias("r"), "id", F.posexplode(F.concat("rejects", "reviews")).alias("k", "reason")).select(F.lit(2).alias("part"), F.struct(F.col("r").alias("a"), F.col("id").alias("b"), F.col("k").alias("c")).alias("place"), F.concat(F.lit("- "), "id", F.lit(": "), "reason").alias("line"))
    return counts.unionByName(table).unionByName(reasons)


def family_tables(families: DataFrame) -> DataFrame:
    """(material, type, family, tex): a family's rows as a LaTeX table. families: material, type, family, image, rows (array of code, title, quantity in order)."""
    line = lambda r: F.concat(tx.latex_escape(r["code"]), F.lit(" & "), tx.latex_escape(r["title"]), F.lit(" & "), tx.quantity(r["quantity"]), F.lit(r" \\"))
    head = F.concat(F.lit(r"\section*{"), tx.latex_escape(F.col("family")), F.lit(r"}\label{"), tx.anchor_id("fam", F.col("family")), F.lit("}\n"))
    picture = F.coalesce(F.concat(F.lit(r"\includegraphics{"), "image", F.lit("}\n")), F.lit("% no picture\n"))
    body = F.concat(F.lit("\\begin{tabular}{llr}\n"), F.array_join(F.transform("rows", line), "\n"), F.lit("\n\\end{tabular}\n"))
    return families.select("material", "type", "family", F.concat(head, picture, body).alias("tex"))


def issue_lines(fields: dict[str, str], commands: dict[str, str], page: int, revisions: Iterable[dict[str, str]], columns: Iterable[str]) -> list[str]:
    """LaTeX commands of an issue: a command for each field, the first page, and the revisions as rows of a table."""
    told = lambda v: "".join(tx.LATEX.get(c, c) for c in v)
    rows = [" & ".join(told(r[c]) for c in columns) + r" \\ \hline" for r in revisions]
    return [f"\\newcommand{{\\{commands[f]}}}{{{told(v)}}}" for f, v in fields.items() if f in commands] + [f"\\newcommand{{\\FirstPage}}{{{page}}}", "\\newcommand{\\Revisions}{\n" + "\n".join(rows) + "\n}"]


def warnings_log(families: DataFrame) -> DataFrame:
    """(line): families that have no picture, in order. families: family, warned."""
    return families.where("warned").select(F.concat("family", F.lit(": no picture; the placeholder stands for it")).alias("line")).distinct().orderBy("line")


def _ref(column: Column, row: Column) -> Column:
    """A cell's name; columns count from 0 and stay below 26 * 26."""
    letters = F.when(column < 26, F.char(65 + column)).otherwise(F.concat(F.char(64 + F.floor(column / 26)), F.char(65 + column % 26)))
    return F.concat(letters, row.cast("string"))


def _sheet(sheet: str | Column) -> Column:
    """A sheet's name: one for all rows, or a column, so that many sheets are laid out in one pass."""
    return (F.lit(sheet) if isinstance(sheet, str) else sheet).alias("sheet")


def block(rows: DataFrame, sheet: str | Column, order: str, columns: list[str], row0: int = 1, column0: int = 0) -> DataFrame:
    """(sheet, ref, value): a table laid out row by row from a corner; `order` numbers a sheet's rows from 0. Nulls are no cells."""
    cells = F.array(*(F.struct(F.lit(column0 + k).alias("c"), F.col(c).cast("string").alias("value")) for k, c in enumerate(columns)))
    each = rows.select(_sheet(sheet), F.col(order).alias("r"), F.explode(cells).alias("x")).where("x.value is not null")
    return each.select("sheet", _ref(F.col("x.c"), F.col("r") + row0).alias("ref"), "x.value")


#: Corners of a report's blocks: where a unit's curve, a system's samples and a candidate's figures stand (fixed values of the template).
CURVE_HEAD, CURVE_ROW, SAMPLE_ROW, SAMPLES = 18, 21, 2, 61
BLOCKS = {"technical": 13, "performance": 23, "cavitation": 36}
FIGURES = {
    "technical": ("maker", "model", "motor_kw", "poles", "mass", "voltage", "submergence_mm"),
    "performance": ("maker", "model", "qref", "href", "eta_op", "speed", "power", "motor_eff", "electric", "margin"),
    "cavitation": ("maker", "model", "suction_head", "loss", "npsh_avail", "npsh_req", "npsh_ratio", "npsh_margin"),
}
UNKNOWN = "not stated"


def _value(c: Column) -> Column:
    return c.cast("string")


def candidate_cells(chosen: DataFrame, sheet: str | Column) -> DataFrame:
    """(sheet, ref, value): figures of the chosen units, a column each from C on in order of rank (three at most); what a maker does not state is said so. chosen: rank and FIGURES."""
    cells = [
        F.struct(F.lit(row + k).alias("row"), _value(F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) if c in ("mass", "npsh_req") else F.col(c)).alias("value"))
        for block_, row in BLOCKS.items() for k, c in enumerate(FIGURES[block_]) if c in chosen.columns
    ]
    each = chosen.where(F.col("rank") <= 3).select(_sheet(sheet), "rank", F.explode(F.array(*cells)).alias("x")).where("x.value is not null")
    return each.select("sheet", _ref(F.col("rank") + 1, F.col("x.row")).alias("ref"), "x.value")


def curve_cells(points: DataFrame, state: DataFrame, sheet: str | Column, column: int) -> DataFrame:
    """(sheet, ref, value): a curve's speed, frequency, synchronous speed and slip in a row, its points below, from a column on. points: i, q, h, eta, npsh; state: speed, frequency, synchronous, slip."""
    head = state.select(_sheet(sheet), F.explode(F.array(*(F.struct(F.lit(column + k).alias("c"), _value(F.col(n)).alias("value")) for k, n in enumerate(("speed", "frequency", "synchronous", "slip"))))).alias("x"))
    top = head.select("sheet", _ref(F.col("x.c"), F.lit(CURVE_HEAD)).alias("ref"), "x.value")
    return top.unionByName(block(points, sheet, "i", ["q", "h", "eta", "npsh"], CURVE_ROW, column))


def system_cells(least: tuple[float, float, float], most: tuple[float, float, float], reach: DataFrame, sheet: str) -> DataFrame:
    """(sheet, ref, value): two systems (flow, head, static head) sampled from no flow to half beyond their own, or to the farthest point of any curve. reach: q, the ends of the curves."""
    from ..operators import hydraulics as hy

    limit = F.greatest(F.coalesce(F.max("q"), F.lit(0.0)), F.lit(1.5 * least[0]), F.lit(1.5 * most[0]))
    rows = reach.agg(limit.alias("m")).select(F.col("m"), F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))).alias("i")).select("i", (F.col("i") * F.col("m") / (SAMPLES - 1)).alias("q"))
    head = lambda s: hy.system_head(F.col("q"), *map(F.lit, s))
    return block(rows.select("i", "q", head(least).alias("a"), head(most).alias("b")), sheet, "i", ["q", "a", "b"], SAMPLE_ROW)


def patch_book(xml: str, hidden: set[str]) -> str:
    """A workbook's list of sheets with some hidden and the others shown; the first one shown is the active one."""
    names: list[tuple[str, bool]] = []

    def put(m: re.Match) -> str:
        tag = re.sub(r'\s+state="[^"]*"', "", m[0])
        name = re.search(r'name="([^"]*)"', tag)[1]
        names.append((name, name in hidden))
        return tag.replace("<sheet ", '<sheet state="hidden" ', 1) if name in hidden else tag

    out = re.sub(r"<sheet [^>]*?/?>", put, xml)
    if missing := hidden - {n for n, _ in names}:
        raise ValueError(f"no sheet {sorted(missing)[0]!r}")
    first = next((i for i, (_, h) in enumerate(names) if not h), None)
    if first is None:
        raise ValueError("no sheet is left to show")
    return re.sub(r'activeTab="\d+"', f'activeTab="{first}"', out)


def patch_title(xml: str, title: str) -> str:
    """The document properties with a title."""
    new = f"<dc:title>{escape(title)}</dc:title>"
    return re.sub(r"<dc:title\s*/>|<dc:title>.*?</dc:title>", lambda _: new, xml, count=1, flags=re.S) if "<dc:title" in xml else xml.replace("</cp:coreProperties>", new + "</cp:coreProperties>", 1)


def patch_sheet(xml: str, updates: dict[str, str | float | None]) -> str:
    """A sheet's XML with the values of cells that it already has; others stay byte for byte. Numbers must be finite; unknown cells are an error."""
    for ref, v in updates.items():
        found = re.search(rf'<c r="{ref}"((?:\s+[a-z]+="[^"]*")*)\s*(?:/>|>.*?</c>)', xml, re.S)
        if not found:
            raise ValueError(f"no cell {ref}")
        style = "".join(re.findall(r'\s+s="[^"]*"', found[1]))
        if v is None:
            new = f'<c r="{ref}"{style}/>'
        elif isinstance(v, str):
            new = f'<c r="{ref}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        else:
            if v != v or v in (float("inf"), float("-inf")):
                raise ValueError(f"{ref}: not finite")
            new = f'<c r="{ref}"{style}><v>{v!r}</v></c>'
        xml = xml[: found.start()] + new + xml[found.end() :]
    return xml


def patch_workbook(template: bytes, updates: dict[str, dict[str, str | float | None]], hidden: set[str] = frozenset(), title: str | None = None) -> bytes:
    """A copy of a workbook with cells patched, by the part's path, sheets hidden and a title set; parts without changes are the same bytes."""
    out = BytesIO()
    with zipfile.ZipFile(BytesIO(template)) as a, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as b:
        missing = set(updates) - set(a.namelist())
        if missing:
            raise ValueError(f"no part {sorted(missing)[0]}")
        for info in a.infolist():
            data = a.read(info)
            if info.filename in updates:
                data = patch_sheet(data.decode(), updates[info.filename]).encode()
            elif hidden and info.filename == "xl/workbook.xml":
                data = patch_book(data.decode(), set(hidden)).encode()
            elif title is not None and info.filename == "docProps/core.xml":
                data = patch_title(data.decode(), title).encode()
            b.writestr(info, data)
    return out.getvalue()


def manifest_text(rows: Iterable[dict], columns: list[str]) -> bytes:
    """A manifest as text with a byte-order mark and CRLF, by file, then id."""
    quote = lambda v: '"' + v.replace('"', '""') + '"' if re.search('[",\r\n]', v) else v
    lines = [",".join(columns)] + [",".join(quote(str(r.get(c) or "")) for c in columns) for r in sorted(rows, key=lambda r: (str(r.get("arquivo_origem", "")).lower(), r.get("id", "")))]
    return ("﻿" + "\r\n".join(lines) + "\r\n").encode()
