"""Workbooks, delimited files, profiles and streams."""

import pytest
from pyspark.sql import functions as F

from sluicework.sources import files, profiles, xlsx
from sluicework.streaming import capture, inventory


def test_workbook_round_trip(spark, tmp_path):
    p = str(tmp_path / "b.xlsx")
    names = xlsx.write_workbook(p, {"Cases": (["Name", "Q", "Note"], [("a", 1.5, "x & <y>"), ("b", None, float("nan")), (None, None, None), ("c", 3, "z")]), "cases": (["A"], [(True,)]), "history": (["A"], [])})
    assert names == ["Cases", "cases_1", "history_1"]
    rows = xlsx.read_sheet(spark, p, "Cases", ["Name", "Q", "Note"]).orderBy("_line").collect()
    assert [(r._line, r.Name, r.Q, r.Note) for r in rows] == [(2, "a", "1.5", "x & <y>"), (3, "b", None, None), (5, "c", "3", "z")]
    with pytest.raises(ValueError, match="missing"):
        xlsx.read_sheet(spark, p, "Cases", ["Nope"])
    with pytest.raises(ValueError, match="no sheet"):
        xlsx.read_sheet(spark, p, "Other", ["Name"])


def test_grid_is_melted(spark, tmp_path):
    p = str(tmp_path / "g.xlsx")
    xlsx.write_workbook(p, {"Abacus_X": (["H\\Q", "3", "x", "5"], [(40, "A", "B", None), (20, " ", "C", "D")])})
    got = {(r.head, r.flow): r.unit_id for r in xlsx.melt_grid(spark, p, "Abacus_X").collect()}
    assert got == {(40.0, 3.0): "A", (20.0, 5.0): "D"}


def test_curve_files(spark, tmp_path):
    (tmp_path / "P1.csv").write_text("Q,H,Eta1,NPSH\n2,8,70,\n1,9,60,2.5\n")
    rows = files.curves(spark, str(tmp_path / "P1.csv")).orderBy("q").collect()
    assert [(r.unit, r.q, r.npsh) for r in rows] == [("P1", 1.0, 2.5), ("P1", 2.0, None)]
    (tmp_path / "P2.csv").write_text("Q,H\n1,2\n")
    with pytest.raises(ValueError, match="Eta1, NPSH"):
        files.curves(spark, str(tmp_path / "P2.csv"))


def test_rename_map(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿De;Para\na.pdf;B.pdf\n;\n")
    assert [(r.source, r.target) for r in files.rename_map(spark, str(tmp_path / "m.csv")).collect()] == [("a.pdf", "B.pdf")]
    (tmp_path / "o.csv").write_text("Nome Atual\tnovo\tpasta_destino\nb\tB\tx/\na\tA\t\n")
    assert [(r.source, r.target) for r in files.rename_map(spark, str(tmp_path / "o.csv")).orderBy("pos").collect()] == [("b", "x/B"), ("a", "A")]
    (tmp_path / "n.csv").write_text("from,to\n../a,b\n")
    with pytest.raises(ValueError, match="unsafe"):
        files.rename_map(spark, str(tmp_path / "n.csv"))


def test_manifest_fills_and_keeps(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿id,mine\nx,1\n")
    r = files.manifest(spark, str(tmp_path / "m.csv")).first()
    assert r.id == "x" and r.qa == "" and r.mine == "1" and len(r) == len(files.MANIFEST) + 1


def test_profiles_inherit():
    texts = {"a": "lines = ['1']\nflag = true\n[qa]\nblock = ['x']", "b": "herda = 'a'\nlines = ['2']\nflag = false\n[qa]\nblock = ['y']", "c": "herda = 'c'"}
    assert files.profile(texts.__getitem__, "b") == {"lines": ["1", "2"], "flag": False, "qa": {"block": ["x", "y"]}}
    with pytest.raises(ValueError, match="circle"):
        files.profile(texts.__getitem__, "c")


def test_profile_numbers(spark):
    got = spark.createDataFrame([(1.0,), (0.5,), (1e8,), (float("nan"),), (None,), (-2.25,), (1e-11,), (1.5e-4,), (1.25e17,), (123456789.125,)], "x double").select(profiles.number(F.col("x"), ",").alias("v")).collect()
    assert [r.v for r in got] == ["1,0", "0,5", "100000000,0", "", "", "-2,25", "1e-11", "0,00015", "1,25e+17", "123456789,125"]


def test_inventory_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for rows in ([("a", "1"), ("b", "1")], [("b", "2"), ("c", "1")]):
        spark.createDataFrame(rows, "id string, sha string").coalesce(1).write.mode("append").parquet(src)
        inventory.maintain(spark.readStream.schema("id string, sha string").parquet(src), out, ck).awaitTermination()
    got = {r.id: (r.sha, r.status) for r in inventory.latest(spark, out).collect()}
    assert got == {"a": ("1", "new"), "b": ("2", "changed"), "c": ("1", "new")}


def test_capture_stream_ends_as_the_batch(spark, tmp_path):
    src = str(tmp_path / "ev")
    rows = [(1, i, float(i), k) for i, k in enumerate(["click", "click", "view", "purchase", "view", "click"])] + [(2, 9, 0.0, "error")]
    df = spark.createDataFrame(rows, "session long, seq int, at double, kind string")
    df.coalesce(1).write.parquet(src)
    capture.stream(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("cap").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    key = lambda r: tuple(r)
    assert sorted(map(key, spark.table("cap").collect())) == sorted(map(key, capture.fold(df).collect()))
