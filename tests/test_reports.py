"""Issues, overrides, archives, reports."""

import json

import pytest
from pyspark.sql import functions as F

from sluicework.sources import archives, config, reports, xlsx

REV = {"revision": "1", "date": "d", "description": "x", "author": "a", "checker": "b", "approver": "c"}
ISSUE = {"document": "DOC-1", "title": " t ", "project": "p", "client": "c", "area": "a", "revision": "1", "date": "d", "page": 2, "revisions": [{**REV, "revision": "0"}, REV], "catalog": "c.xlsx"}


def test_issue():
    i = config.issue(b"\xef\xbb\xbf" + json.dumps(ISSUE).encode(), "/d")
    assert i.fields["title"] == "t" and i.page == 2 and i.paths == {"catalog": "/d/c.xlsx"} and len(i.revisions) == 2
    for wrong in ({"document": "con"}, {"document": "a b"}, {"title": " "}, {"page": 0}, {"page": True}, {"revisions": []}, {"revision": "9"}, {"revisions": [{**REV, "author": ""}]}):
        with pytest.raises(ValueError):
            config.issue(json.dumps({**ISSUE, **wrong}))


def test_overrides(spark):
    rows, warnings = config.overrides(spark, '["A-1"]\nrota = "C"\nextras = ["F"]\nidioma_ocr = "por+eng"\nmine = 1\n')
    assert [tuple(r) for r in rows.collect()] == [("A-1", "C", "F", "por+eng", "")] and warnings == ["A-1.mine: unknown key"]
    with pytest.raises(ValueError, match="route.*language"):
        config.overrides(spark, '[a]\nrota = "Z"\n[b]\nidioma_ocr = "pt"\n')


def test_settings_and_paths():
    s = config.merge({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 9}, "x": 5})
    assert s == {"a": {"b": 9, "c": 2}, "d": [1], "x": 5}
    assert config.check_settings(s, {"a.b": (0, 5)}, {"x": (5,)}, ("d",)) == ["a.b is out of range"]
    config.safe_output("/a/b", "/a/c")
    with pytest.raises(ValueError):
        config.safe_output("/a/b", "/a/b/c")


def test_project_round_trip():
    p = {"curves": [{"id": "1", "name": "n", "points": [[1, 2]], "axes": [[0] * 4] * 3, "locked": True, "page": "p"}], "main": "1", "pages": {"p": b"png"}}
    assert archives.load_project(archives.save_project(p)) == p
    with pytest.raises(ValueError, match="locked"):
        archives.save_project({"curves": [{"locked": False}]})
    with pytest.raises(ValueError, match="main"):
        archives.load_project(archives.save_project({**p, "main": "9"}))


def test_extractions_are_appended():
    one = archives.append_extractions(None, b"page", [{"name": "a"}])
    two = archives.append_extractions(one, b"page", [{"name": "b"}])
    import io
    import zipfile

    names = zipfile.ZipFile(io.BytesIO(two)).namelist()
    assert sum(n.startswith("pages/") for n in names) == 1 and sum(n.startswith("curves/") for n in names) == 2
    assert archives.archive_name("Ação 1/2", "0123456789abcdef") == "Ação_1_2_0123456789ab.zip"


def test_verdict_report(spark):
    df = spark.createDataFrame([("b", "aprovado", [], []), ("a", "reprovado", ["x"], ["y"]), ("c", "revisar", [], ["z"])], "id string, verdict string, rejects array<string>, reviews array<string>")
    lines = [r.line for r in reports.verdict_lines(df).orderBy("part", "place").collect()]
    assert lines == ["- reprovado: 1", "- revisar: 1", "- aprovado: 1", "| a | reprovado | 1 | 1 |", "| c | revisar | 0 | 1 |", "| b | aprovado | 0 | 0 |", "- a: x", "- a: y", "- c: z"]


def test_family_table(spark):
    df = spark.createDataFrame([("M", "T", "F_1", None, [("A&B", "50%", 12.5)])], "material string, type string, family string, image string, rows array<struct<code:string,title:string,quantity:double>>")
    tex = reports.family_tables(df).first().tex
    assert r"A\&B & 50\% & 12,5 \\" in tex and "% no picture" in tex and r"\section*{F\_1}\label{fam-" in tex


def test_cells_and_template(spark, tmp_path):
    df = spark.createDataFrame([(0, "x", 1.5), (1, None, 2.0)], "i int, a string, b double")
    got = {(r.sheet, r.ref): r.value for r in reports.block(df, "S", "i", ["a", "b"], 4, 25).collect()}
    assert got == {("S", "Z4"): "x", ("S", "AA4"): "1.5", ("S", "AA5"): "2.0"}
    p = tmp_path / "t.xlsx"
    xlsx.write_workbook(str(p), {"S": (["h"], [("old",), (1,)]), "T": (["k"], [])})
    new = reports.patch_workbook(p.read_bytes(), {"xl/worksheets/sheet1.xml": {"A2": "a<b", "A3": 2.5}})
    q = tmp_path / "u.xlsx"
    q.write_bytes(new)
    rows = xlsx.read_cells(spark, str(q)).where(F.col("sheet") == "S").orderBy("row").collect()
    assert [r.value for r in rows] == ["h", "a<b", "2.5"]
    with pytest.raises(ValueError, match="finite"):
        reports.patch_workbook(p.read_bytes(), {"xl/worksheets/sheet1.xml": {"A2": float("nan")}})
    with pytest.raises(ValueError, match="no cell"):
        reports.patch_workbook(p.read_bytes(), {"xl/worksheets/sheet1.xml": {"Z9": 1}})


def test_manifest_text():
    out = reports.manifest_text([{"id": "b", "arquivo_origem": "Z"}, {"id": "a", "arquivo_origem": 'y,"q"'}], ["id", "arquivo_origem"])
    assert out == '﻿id,arquivo_origem\r\na,"y,""q"""\r\nb,Z\r\n'.encode()
