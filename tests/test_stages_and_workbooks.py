"""The stage runner, workbooks as a data source, the section tree, and rules under Unicode white space and overlapping patterns."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sluicework.operators import quality, stages
from sluicework.operators import text as tx
from sluicework.sources import workbooks, xlsx

ROW = "id string, sha string, route string, st_ocr string, st_estrutura string, st_tabelas string, st_limpeza string, st_metadados string, versions string, note string, qa string, text string"


def row(name, text="abc", state="pendente", versions="ocr=1;tabelas=3", note="livre", sha="s"):
    return (name, sha, "B", "ok", state, "ok", "ok", "ok", versions, note, "aprovado", text)


def judge():
    def judged(r):  # sent by value: workers do not have this module
        if r["text"] is None:
            raise KeyError("x" * 1000)
        known = {"skip": stages.Done("pulado"), "wait": stages.Done("pendente", "espera"), "odd": stages.Done("talvez"), "few": stages.Done("ok", "feito", ("limpeza",))}
        return known.get(r["text"], stages.Done("ok"))

    return judged


def test_a_stage_ages_records_and_isolates(spark):
    rows = [row("a"), row("b", "skip"), row("c", "wait"), row("d", "odd"), row("e", "few", note="[estrutura] velho | livre"), row("f", None), row("g", state="ok", versions="estrutura=2"), row("h", state="ok", versions="estrutura=1")]
    got = {r.id: r for r in stages.run_stage(spark.createDataFrame(rows, ROW), "estrutura", 2, judge(), ["text"]).collect()}
    assert [got[i].ran for i in "abcdefgh"] == [True] * 6 + [False, True]
    assert [got[i].st_estrutura for i in "abcdefgh"] == ["ok", "pulado", "pendente", "falhou", "ok", "falhou", "ok", "ok"]
    assert (got["a"].st_tabelas, got["a"].st_limpeza, got["a"].st_metadados, got["a"].st_ocr, got["a"].versions, got["a"].qa) == ("pendente", "pendente", "pendente", "ok", "estrutura=2;ocr=1", "")
    assert (got["b"].st_tabelas, got["b"].versions, got["b"].qa) == ("ok", "estrutura=2;ocr=1;tabelas=3", "aprovado")
    assert (got["c"].versions, got["c"].note) == ("ocr=1;tabelas=3", "livre | [estrutura] espera")
    assert got["d"].note == "livre | [estrutura] ValueError: no state 'talvez'"
    assert (got["e"].st_limpeza, got["e"].st_metadados, got["e"].versions, got["e"].note) == ("pendente", "ok", "estrutura=2;ocr=1;tabelas=3", "livre | [estrutura] feito")
    assert got["f"].note.startswith("livre | [estrutura] KeyError: 'xxx") and len(got["f"].note) == len("livre | [estrutura] ") + stages.NOTE
    assert (got["g"].versions, got["g"].qa) == ("estrutura=2", "aprovado")
    forced = stages.run_stage(spark.createDataFrame(rows, ROW), "estrutura", 2, judge(), ["text"], forced=True)
    assert forced.where("not ran").isEmpty()
    assert stages.run_stage(spark.createDataFrame([], ROW), "estrutura", 2, judge(), ["text"]).isEmpty()


def test_origins_are_checked_first(spark):
    rows = spark.createDataFrame([row(f"d{i:02}", sha=f"s{i}") for i in range(60)], ROW)
    now = spark.createDataFrame([(f"d{i:02}", f"s{i}" if i % 2 else "other") for i in range(50)] + [("d03", "twice")], "id string, sha string")
    assert {(r.id, r.problem) for r in stages.origin_problems(rows, now).collect()} == {(f"d{i:02}", "mudou") for i in range(0, 50, 2)} | {(f"d{i}", "ausente") for i in range(50, 60)}
    with pytest.raises(ValueError, match=r"d00 \(mudou\), d02 \(mudou\).*\(\+15\)$"):
        stages.check_origins(rows, now)
    stages.check_origins(rows.where("id = 'd01'"), now)
    with pytest.raises(ValueError, match="no document"):
        stages.chosen(rows, routes=["A"])
    assert stages.chosen(rows, routes=["B"], ids=["d01", "d02", "nowhere"]).count() == 2


def test_a_run_in_parts_goes_on_after_a_crash(spark, tmp_path):
    rows = spark.createDataFrame([row(f"d{i}", str(i)) for i in range(200)], ROW)
    gate, log = str(tmp_path / "gate"), str(tmp_path / "log")
    os.makedirs(log)

    def crashing(r):
        open(f"{log}/{r['id']}-{random.getrandbits(60)}", "w").close()
        if r["id"] == "d77" and not os.path.exists(gate):
            os._exit(1)  # the worker is lost, not the row
        if int(r["text"]) % 10 == 3:
            raise OSError(r["text"])
        return stages.Done("ok")

    with pytest.raises(Exception):  # noqa: B017
        stages.run_in_parts(rows, "estrutura", 2, crashing, ["id", "text"], str(tmp_path / "run"), parts=6)
    done = {p.name for p in (tmp_path / "run" / "done").glob("part=*") if (p / "_SUCCESS").exists()}
    before = {n.split("-")[0] for n in os.listdir(log)}
    open(gate, "w").close()
    got = stages.run_in_parts(rows, "estrutura", 2, crashing, ["id", "text"], str(tmp_path / "run"), parts=6).collect()
    assert len(got) == 200 and {r.id for r in got if r.st_estrutura == "falhou"} == {f"d{i}" for i in range(3, 200, 10)}
    assert len(done) < 6 and before
    part_of = {r.id: f"part={r.p}" for r in rows.select("id", F.pmod(F.xxhash64("id"), F.lit(6)).alias("p")).collect()}
    runs = [n.split("-")[0] for n in os.listdir(log)]
    assert all(runs.count(i) == 1 for i in part_of if part_of[i] in done)  # what was committed did not run again


# ---- workbooks ----


def test_what_is_written_is_read(spark, tmp_path):
    workbooks.register(spark)
    texts = ["plain", "", None, " blanks ", "a\r\nb", "\x00\x07_x0041_ _x", "<&>\"'", "日本 é", "x" * 5000, "1e5", "TRUE"]
    rows = [(i, t, i / 7, i % 2 == 0) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "n int, t string, x double, yes boolean")
    df.repartition(3).write.format("workbook").option("sheet", "Folha 1").option("sheetRows", 4).mode("append").save(str(tmp_path / "w"))
    assert len(list((tmp_path / "w").iterdir())) == 9  # 11 rows a task, 4 a workbook; nothing hidden is left
    read = spark.read.format("workbook").schema("t string, n bigint, yes boolean, x double, _line int, _path string").option("sheet", "Folha 1").load(str(tmp_path / "w"))
    assert sorted((r.n, r.t, r.x, r.yes) for r in read.collect()) == sorted(rows, key=lambda r: r[0])
    assert read.rdd.getNumPartitions() == 9 and {r["_line"] for r in read.collect()} <= {2, 3, 4, 5}
    df.limit(1).write.format("workbook").option("sheet", "Folha 1").mode("append").save(str(tmp_path / "w"))
    assert read.count() == 33 and spark.read.format("workbook").schema("n int").option("sheet", "Folha 1").load(str(tmp_path / "w")).count() == 34


def test_cells_of_all_sheets_and_of_one(spark, tmp_path):
    workbooks.register(spark)
    (tmp_path / "sub").mkdir()
    for p in (tmp_path / "a.xlsx", tmp_path / "sub" / "b.xlsx"):
        xlsx.write_workbook(str(p), {"One": (["k", "v"], [("a", 1), ("b", None)]), "Two": (["k"], [("c",)])})
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    df = spark.read.format("workbook").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 4 and df.count() == 2 * (5 + 2)
    one = df.where("sheet = 'Two'")
    assert one.rdd.getNumPartitions() == 2 and {(r.row, r.column, r.value, r.kind) for r in one.collect()} == {(1, 0, "k", "s"), (2, 0, "c", "s")}
    old = xlsx.read_cells(spark, str(tmp_path / "a.xlsx")).select("sheet", "row", "column", "value", "kind")
    assert {tuple(r) for r in old.collect()} == {tuple(r) for r in df.where("path like '%a.xlsx'").select("sheet", "row", "column", "value", "kind").collect()}
    assert spark.read.format("workbook").load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(("rows", "told"), [([], "is empty"), ([(None, None)], "is empty"), ([("a", 1)], "column 'w' is missing")])
def test_strict_sheets(spark, tmp_path, rows, told):
    workbooks.register(spark)
    xlsx.write_workbook(str(tmp_path / "a.xlsx"), {"S": (["k", "v"], rows)})
    schema = "k string, w string" if rows and rows[0][0] else "k string"
    with pytest.raises(Exception, match=told):
        spark.read.format("workbook").schema(schema).option("sheet", "S").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="no sheet"):
        spark.read.format("workbook").schema("k string").option("sheet", "T").load(str(tmp_path)).collect()
    xlsx.write_workbook(str(tmp_path / "a.xlsx"), {"S": (["k", "k"], [("a", "b")])})
    with pytest.raises(Exception, match="is repeated"):
        spark.read.format("workbook").schema("k string").option("sheet", "S").load(str(tmp_path)).collect()


# ---- sections and rules ----


def plain_tree(levels):
    stack, out = [], []
    for n, level in levels:
        while stack and stack[-1][1] >= level:
            stack.pop()
        out.append((n, level, stack[-1][0] if stack else None))
        stack.append((n, level))
    return out


def test_sections_are_those_of_a_stack(spark):
    r = random.Random(3)
    docs = {d: [(n, r.randint(1, 6)) for n in sorted(r.sample(range(200), 60))] for d in range(20)}
    lines = [(d, n, "#" * k + " Title") for d, found in docs.items() for n, k in found] + [(0, 500, "no # heading"), (0, 501, "####### seven"), (0, 502, "#"), (1, 503, None)]
    got = tx.sections(spark.createDataFrame(lines, "doc_id int, line_no int, line string").repartition(4)).collect()
    assert sorted((tuple(x) for x in got), key=lambda x: x[:2]) == sorted(((d, *t) for d, found in docs.items() for t in plain_tree(found)), key=lambda x: x[:2])


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize("blank", [" ", " ", " ", "\t", "　"])
def test_items_are_found_behind_any_blank(spark, blank):
    line = F.lit(f"4.1{blank}Escopo geral")
    assert one(spark, quality.items(line)) == ["4.1"] and one(spark, tx.item(line)) == "4.1"
    assert one(spark, quality.lost_items(F.lit(f"## 4.1{blank}Escopo"), F.lit("4.1 Escopo geral"))) == []
    assert one(spark, quality.lost_items(F.lit(f"{blank}| 4.1 celula"), F.lit("4.1 Escopo geral"))) == ["4.1"]
    assert one(spark, tx.heading(F.lit(f"4.1{blank}Escopo"))) == "### 4.1 Escopo"
    assert one(spark, tx.squeeze(F.lit(f"{blank}\na{blank}\n"))) == "a\n"


def test_spans_are_counted_on_what_is_left(spark):
    m = quality.cleaned(F.lit("a secret token here\nsecret token, token"), [], ["secret token", "token"])
    assert one(spark, m["spans"]) == 3 and one(spark, m["text"]) == "a  here\n,\n".replace("a  here", "a here")


def test_recognition_warns_of_control_characters_and_confidence_alone(spark):
    rows = spark.createDataFrame([(49.9, 0.5, 10.0), (50.0, 0.01, 85.0), (60.0, 0.011, None), (99.0, 0.0, 84.9), (99.0, 0.5, None)], "n double, c double, k double")
    state, look = quality.recognition_state(F.col("n"), F.col("c"), F.col("k"))
    assert [tuple(r) for r in rows.select(state, look).collect()] == [("falhou", False), ("ok", False), ("ok", True), ("ok", True), ("ok", True)]
