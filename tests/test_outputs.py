"""Sinks, layouts, renames, banks, cases and layered configuration."""

import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from sluicework.operators import curves, manifest as mf, quality as qa, validation as val
from sluicework.sources import config, profiles, reports, sinks, xlsx
from sluicework.streaming import capture, inventory


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_atomic_write(spark, tmp_path):
    p = str(tmp_path / "a.md")
    for content in (b"one", b"two"):
        sinks.write_atomic(spark, p, content)
    assert (tmp_path / "a.md").read_bytes() == b"two" and not [f for f in tmp_path.iterdir() if f.name.endswith(".part")]


def test_raw_export(spark, tmp_path):
    pts = spark.createDataFrame([("0123456789", "Curva 1", i, 10.0 * i, 5.0) for i in range(3)], "curve string, name string, i int, px double, py double")
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    k = curves.affine([lit(0, 0, 0, 0), lit(10, 0, 1, 0), lit(0, 10, 0, 1)])
    raw = sinks.raw_points(pts, k)
    assert [(r.X, r.Y) for r in raw.orderBy("i").collect()] == [(0.0, 0.5), (1.0, 0.5), (2.0, 0.5)]
    sinks.write_raw(raw, str(tmp_path / "out"), profiles.Profile(("px", "py", "X", "Y"), delimiter=";", decimal=","))
    folder = tmp_path / "out" / "file=Curva_1_01234567_raw"
    text = "".join(f.read_text() for f in folder.glob("*.csv"))
    assert text == "px;py;X;Y\n0,0;5,0;0,0;0,5\n10,0;5,0;1,0;0,5\n20,0;5,0;2,0;0,5\n"
    assert sinks.planned_paths("/d/t.csv", [("0123456789", "Curva 1")], "both", raw=True) == ["/d/t.csv", "/d/t_Curva_1_01234567_raw.csv", "/d/t.xlsx"]
    assert sinks.planned_paths("t", [("1", "é")], "CSV", raw_only=True) == ["t_é_1_raw.csv"]
    for wrong in (("/d/", "CSV"), ("t", "PDF")):
        with pytest.raises(ValueError):
            sinks.planned_paths(wrong[0], [], wrong[1])


def test_common_table(spark):
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 4.0), ("a", 4.0, 8.0), ("b", 1.0, 10.0), ("b", 3.0, 30.0)], "curve string, x double, y double")
    t = curves.common_table(pts, "a", ["a", "b"])
    assert [tuple(r) for r in t.orderBy("x").collect()] == [(0.0, 0.0, None), (2.0, 4.0, 20.0), (4.0, 8.0, None)]
    assert [r.x for r in curves.common_table(pts, "b", ["a", "b"], 3).orderBy("x").collect()] == [1.0, 2.0, 3.0]
    r = curves.incomplete(t, ["a", "b"]).first()
    assert (r["rows"], r["columns"]) == (2, ["b"])
    for wrong in (("z", None), ("a", 1)):
        with pytest.raises(ValueError):
            curves.common_table(pts, wrong[0], ["a", "b"], wrong[1])


def test_renames_are_followed(spark):
    plan = spark.createDataFrame([(1, "a.pdf", "x/B.pdf", "PRONTO", "s1"), (2, "c.pdf", "D.pdf", "PRONTO", "s2"), (3, "e.pdf", "e.pdf", "JA_NO_PADRAO", "")], "pos int, source string, target string, status string, sha string")
    done = mf.renamed(plan, spark.createDataFrame([("c.pdf", "in use")], "source string, reason string"))
    assert {r.source: r.status for r in done.collect()} == {"a.pdf": "RENOMEADO", "c.pdf": "FALHOU: in use", "e.pdf": "JA_NO_PADRAO"}
    rows = spark.createDataFrame([("a", "a.pdf", "s0", "mine", "ok"), ("B", "B.pdf", "s9", "", "ok"), ("q", "q.pdf", "s3", "", "ok")], "id string, file string, sha string, note string, st_ocr string")
    moves = spark.createDataFrame([("a", "B", "a.pdf", "x/B.pdf", "s1"), ("q", "q", "q.pdf", "q.pdf", "s3")], "old_id string, new_id string, source string, target string, sha string")
    got = {r.id: tuple(r) for r in mf.follow(rows, moves).collect()}
    assert got == {"B": ("B", "x/B.pdf", "s1", "mine | [renomear] renomeado de a.pdf", "pendente"), "q": ("q", "q.pdf", "s3", "", "ok")}
    files = spark.createDataFrame([("d/x.PDF.part",), ("d/y.pdf",)], "path string")
    aside = mf.set_aside(files)
    assert [tuple(r) for r in aside.collect()] == [("d/x.PDF.part", "_descartar/x.PDF.part")]
    log = [r.line for r in sinks.rename_log(done, aside).orderBy("place").collect()]
    assert log[0].startswith("status,") and log[1] == '"RENOMEADO","a.pdf","x/B.pdf",s1' and log[-1].startswith('"DOWNLOAD_PARCIAL"') and len(log) == 5


def test_triage_again(spark):
    again = lambda route, found, integrity, verifier=True, forced=False: one(spark, mf.needs_triage(F.lit(route), F.lit(found).cast("int"), 1, F.lit(integrity), verifier, forced))
    assert not again("A", 1, "ok") and again("A", 1, "ok", forced=True) and again("", 1, "ok") and again("ERRO", 1, "ok") and again("A", None, "ok") and again("A", 2, "ok")
    assert again("A", 1, "nao_verificado") and not again("A", 1, "nao_verificado", verifier=False)
    rows = spark.createDataFrame([("2", "b.pdf"), ("1", "B.pdf"), ("3", "a.pdf")], "id string, arquivo_origem string")
    assert [r.id for r in mf.in_order(rows).collect()] == ["3", "1", "2"]


def test_integrity(spark):
    said = "checking\nWARNING: object 12\nWARNING: object 13"
    for code, text, want in ((0, "", "ok"), (3, said, "avisos: WARNING: object 12 (+1 avisos)"), (2, "x error: bad xref", "erro: x error: bad xref"), (2, "", "erro: rc=2"), (None, None, "nao_verificado")):
        assert one(spark, qa.integrity(F.lit(code).cast("int"), F.lit(text).cast("string"))) == want


def test_small_set_operations(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "key string, pos int, v string")
    assert val.first_of(df, "key", "pos", "v").first().v == "a"
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, val.distinct_in_order(a("b", "a", "b"))) == ["b", "a"] and one(spark, val.shared(a(".PDF", ".x"), a(".pdf", ".y"))) == [".pdf"]
    assert [r.key for r in val.subset(df, df.where("false"), "key").collect()] == ["k"] and val.subset(df, df, "key").isEmpty()


def test_report_cells(spark):
    chosen = spark.createDataFrame([(1, "M", "X", 5.5, None, 3.0), (4, "N", "Y", 1.0, 2.0, 1.0)], "rank int, maker string, model string, motor_kw double, mass double, qref double")
    got = {r.ref: r.value for r in reports.candidate_cells(chosen, "S").collect()}
    assert got["C13"] == "M" and got["C15"] == "5.5" and got["C17"] == reports.UNKNOWN and got["C25"] == "3.0" and not any(k.startswith("F") for k in got)
    pts = spark.createDataFrame([(0, 0.0, 9.0, 0.0, None), (1, 1.0, 8.0, 0.5, 2.0)], "i int, q double, h double, eta double, npsh double")
    state = spark.createDataFrame([(1750.0, 60.0, 1800.0, 0.03)], "speed double, frequency double, synchronous double, slip double")
    got = {r.ref: r.value for r in reports.curve_cells(pts, state, "S", 6).collect()}
    assert got["G18"] == "1750.0" and got["J18"] == "0.03" and got["G22"] == "1.0" and "J21" not in got and got["J22"] == "2.0"
    reach = spark.createDataFrame([(50.0,), (12.0,)], "q double")
    got = {r.ref: float(r.value) for r in reports.system_cells((10.0, 20.0, 5.0), (20.0, 30.0, 5.0), reach, "S").collect()}
    assert len(got) == 3 * 61 and got["A2"] == 0 and got["A62"] == 50 and got["B2"] == 5 and got["C62"] == pytest.approx(5 + 25 * (50 / 20) ** 2)


def test_workbook_template(tmp_path):
    book = '<workbook><bookViews><workbookView activeTab="0"/></bookViews><sheets><sheet name="A" sheetId="1"/><sheet name="B" sheetId="2" state="hidden"/><sheet name="C" sheetId="3"/></sheets></workbook>'
    buffer = BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", book)
        z.writestr("docProps/core.xml", "<cp:coreProperties><dc:title>old</dc:title></cp:coreProperties>")
        z.writestr("xl/charts/chart1.xml", "<c/>")
    out = zipfile.ZipFile(BytesIO(reports.patch_workbook(buffer.getvalue(), {}, {"A"}, "T & <u>")))
    made = out.read("xl/workbook.xml").decode()
    assert '<sheet state="hidden" name="A"' in made and made.count("hidden") == 1 and 'activeTab="1"' in made
    assert "<dc:title>T &amp; &lt;u&gt;</dc:title>" in out.read("docProps/core.xml").decode() and out.read("xl/charts/chart1.xml") == b"<c/>"
    with pytest.raises(ValueError):
        reports.patch_book(book, {"Z"})
    with pytest.raises(ValueError):
        reports.patch_book(book, {"A", "B", "C"})


def test_issue_lines(spark):
    lines = reports.issue_lines({"title": "A & B", "other": "x"}, {"title": "Titulo"}, 3, [{"r": "0", "d": "50%"}], ["r", "d"])
    assert lines == [r"\newcommand{\Titulo}{A \& B}", r"\newcommand{\FirstPage}{3}", "\\newcommand{\\Revisions}{\n0 & 50\\% \\\\ \\hline\n}"]
    log = reports.warnings_log(spark.createDataFrame([("b", True), ("a", True), ("c", False)], "family string, warned boolean"))
    assert [r.line[:2] for r in log.collect()] == ["a:", "b:"]


def test_bank_workbook(spark, tmp_path):
    p = str(tmp_path / "bank.xlsx")
    unit = ["U1", "M", "X", 4, 1750, 60, 0.9, 5.5, 200, 100, "380/660", None, 10, 20, 0.7, None]
    xlsx.write_workbook(p, {"Metadata": (xlsx.UNIT_COLUMNS, [tuple(unit)]), "Curves": (xlsx.CURVE_COLUMNS, [(" U1", 0, 30, 0.1, None), ("U1", 10, 20, 0.7, 2.5)]), "Abacus_M": (["H/Q", "5"], [(20, "U1")])})
    units, points, grids = xlsx.read_bank(spark, p)
    r = units.first()
    assert r.voltageV == "380/660" and r.massKG is None and [(x.unit_id, x.q, x.npsh) for x in points.orderBy("i").collect()] == [("U1", 0.0, None), ("U1", 10.0, 2.5)]
    assert list(grids) == ["M"] and grids["M"].first().unit_id == "U1"
    xlsx.write_workbook(str(tmp_path / "no.xlsx"), {"Curves": (xlsx.CURVE_COLUMNS, [])})
    with pytest.raises(ValueError, match="Metadata"):
        xlsx.read_bank(spark, str(tmp_path / "no.xlsx"))


def test_cases_workbook(spark, tmp_path):
    p = str(tmp_path / "c.xlsx")
    xlsx.write_workbook(p, {"Cases": ([*xlsx.CASE_COLUMNS, "ManualIDs", "Temperature_C"], [("one", 12, 1, 2, 3, 4, 100, " Manual ", "A; B;", None), ("two", 5, 1, 2, 3, 4, 0, "abacus", None, 30)])})
    a, b = xlsx.read_cases(spark, p).orderBy("line").collect()
    assert (a.name, a.flow, a["mode"], a.ids, a.temperature, a.vapor_head) == ("one", 12.0, "manual", ["A", "B"], 20.0, 0.26) and (b.ids, b.temperature, b.problem) == ([], 30.0, None)
    xlsx.write_workbook(str(tmp_path / "d.xlsx"), {"Cases": (["Name"], [("x",)])})
    with pytest.raises(ValueError, match="missing"):
        xlsx.read_cases(spark, str(tmp_path / "d.xlsx"))


def test_layered_configuration():
    text = '[paths]\ninput = "in"\noutput = "/o"\n[run]\njobs = 4\nextensions = [".PDF"]\n'
    c = config.layered(text, "/base", {"run": {"jobs": 2, "timeout": None}}, nearby=(("in/a.toml",), ("overrides-x.toml",)))
    assert c["paths"] == {"input": "/base/in", "output": "/o", "overrides": "overrides-x.toml"} and c["run"]["jobs"] == 2 and c["run"]["timeout"] == 300 and c["run"]["extensions"] == [".pdf"]
    for wrong in (("", {}), (text.replace('"/o"', '"in/x"'), {}), (text, {"run": {"device": "tpu"}})):
        with pytest.raises(ValueError):
            config.layered(wrong[0], "/base", wrong[1])
    with pytest.raises(ValueError, match="several"):
        config.layered(text, "/base", nearby=(("overrides.toml", "overrides2.toml"),))


def test_snapshot_parts(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for rows in ([(str(i), "1") for i in range(20)], [("3", "2"), ("x", "1")]):
        spark.createDataFrame(rows, "id string, sha string").coalesce(1).write.mode("append").parquet(src)
        inventory.maintain(spark.readStream.schema("id string, sha string").parquet(src), out, ck, parts=8).awaitTermination()
    got = {r.id: (r.sha, r.status) for r in inventory.latest(spark, out).collect()}
    assert len(got) == 21 and got["3"] == ("2", "changed") and got["x"] == ("1", "new") and got["4"] == ("1", "new")
    assert len(list((tmp_path / "out" / "rows" / "1").glob("part=*"))) <= 2  # only what the second batch touched


def test_capture_stages(spark):
    f = capture.Flow()
    for e in [("start",), ("advance",), ("axis", 0, 0, 1.0, 2.0), ("advance",), ("axis", 10, 0, 5.0), ("advance",), ("axis", 20, 0, 9.0), ("advance",), ("axis", 0, 10, 7.0), ("advance",), ("point", 1, 1), ("point", 2, 2), ("undo",), ("redo",), ("undo",), ("point", 3, 3), ("redo",), ("advance",), ("point", 9, 9)]:
        f.take(*e)
    assert f.errors == ["no point", "degenerate"] and f.stage == 0 and f.points == []
    assert f.locked == [([(0, 0, 1.0, 2.0), (10, 0, 5.0, 2.0), (0, 10, 1.0, 7.0)], [(1, 1), (3, 3)])]
    f.take("duplicate")
    assert f.stage == 4 and len(f.axes) == 3
    f.take("discard")
    assert f.stage == 0
    f.take("free")
    f.take("axis", 0, 0, 1.0, 2.0)
    f.take("advance")
    f.take("axis", 5, 5, 8.0, 9.0)
    assert f.pending == (5, 5, 8.0, 9.0)
    rows = [(1, i, *e, *[None] * (5 - len(e))) for i, e in enumerate([("start",), ("axis", 0.0, 0.0, 1.0, 2.0), ("advance",)])] + [(2, 0, "discard", None, None, None, None)]
    df = spark.createDataFrame(rows, "session long, seq int, kind string, x double, y double, a double, b double")
    assert sorted(tuple(r) for r in capture.sessions(df).collect()) == [(1, 2, 1, 0, 0, ""), (2, 0, 0, 0, 0, "")]


def test_results_keep_blanks_quotes_and_nulls(spark, tmp_path):
    sinks.write_result(spark.createDataFrame([(1, ' a "b", '), (2, None)], "n int, t string").coalesce(1), str(tmp_path / "r"))
    (part,) = (tmp_path / "r").glob("part-*.csv")
    assert part.read_text().splitlines() == ["n,t", '1," a ""b"", "', "2,"]


def test_cells_of_many_sheets_at_once(spark):
    pts = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), ("b", 1, None)], "u string, i int, q double")
    got = {(r.sheet, r.ref, r.value) for r in reports.block(pts, F.upper("u"), "i", ["q"], 4, 25).collect()}
    assert got == {("A", "Z4", "1.0"), ("B", "Z4", "2.0")}


def test_curves_are_written_by_the_stated_number_of_tasks(spark, sf_dir, monkeypatch):
    from pathlib import Path

    from sluicework.plans import document_queries as dq, output_queries as oq
    from sluicework.sources import files

    seen = {}
    write, read = oq.profiles.write_csv, files.curves
    monkeypatch.setattr(oq.profiles, "write_csv", lambda df, path, p: (seen.update(parts=df.rdd.getNumPartitions()), write(df, path, p))[1])
    monkeypatch.setattr(files, "curves", lambda s, path: (seen.update(path=path), read(s, path))[1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert oq.q_profile_file(spark, sf_dir).count() == dq.view(spark, sf_dir, "curve_pt").count() and seen["parts"] == 3
        dq.q_scan_curves(spark, sf_dir)
        tasks = {f.name[:10] for f in Path(seen["path"]).rglob("part-*.csv")}
        assert tasks <= {"part-00000", "part-00001", "part-00002"} and len(tasks) > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_curves_are_scanned_a_lot_of_folders_at_a_time(spark, sf_dir, monkeypatch, tmp_path):
    from pathlib import Path

    from sluicework.plans import document_queries as dq
    from sluicework.sources import files

    whole = sorted(dq.q_scan_curves(spark, sf_dir).collect())
    folders, read = [], files.curves
    monkeypatch.setattr(files, "LOT", 3)
    monkeypatch.setattr(files, "curves", lambda s, path: (folders.append({f.name for f in Path(path).glob("unit=*")}), read(s, path))[1])
    kept = ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.hive.filesourcePartitionFileCacheSize")
    set_before = [spark.conf.get(name) for name in kept]
    assert sorted(dq.q_scan_curves(spark, sf_dir).collect()) == whole
    assert 1 < len(folders) <= -(-len(whole) // 3) and max(map(len, folders)) < len(whole)  # no reading lists all folders
    assert sorted(n for lot in folders for n in lot) == sorted(f"unit={r.unit}" for r in whole)  # each folder is read, once
    assert [spark.conf.get(name) for name in kept] == set_before
    spark.read.parquet(f"{sf_dir}/supplier.parquet").where("false").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    assert dq.q_scan_curves(spark, str(tmp_path)).collect() == []
