"""What is kept between runs (extracted curves, curves of other frequencies), moved files, unique names, decomposed characters, manifests in parts, messages of the verdict."""

import csv
import io
import random
import sys
import unicodedata
import uuid

import pytest
from pyspark.sql import functions as F

from sluicework.functions.decomposed import ascii_folded
from sluicework.operators import kept_curves, names, quality as qa, text as tx
from sluicework.sources import extractions, moves, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


# --- characters ------------------------------------------------------------------------------------


def test_decomposition_of_all_characters(spark):
    chars = [chr(n) for n in range(1, sys.maxunicode + 1) if not 0xD800 <= n <= 0xDFFF]
    texts = ["".join(chars[i : i + 500]) for i in range(0, len(chars), 500)] + ["", "cafe\u0301 ﬁm", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8)
    got = dict(rows.select("i", ascii_folded(F.col("t")).alias("f")).collect())
    assert [got[i] for i in range(len(texts))] == [t and unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]


def test_names_of_files(spark):
    told = {"Relatório nº 1/2": "Relatorio-no-1-2", "--_a_--": "a", "日本": "selecao", "": "selecao", "½ ﬁm.x": "12-fim.x", "..a..": "..a.."}
    for name, want in told.items():
        assert one(spark, tx.safe_name(F.lit(name))) == want
    assert one(spark, tx.slug(F.lit("Norma Ⅳ: ação.."))) == "Norma-IV-acao"


# --- unique names ----------------------------------------------------------------------------------


def in_turn(rows, most):
    """One after the other, as a reader of the rules would."""
    used, out = set(), {}
    for pos, name in rows:
        base = (name or "").translate({ord(c): "_" for c in "[]:*?/\\"}).strip("'")[:most] or names.DEFAULT
        title, k = base, 0
        while title.lower() in used or title.lower() in names.RESERVED:
            k += 1
            title = base[: most - len(f"_{k}")] + f"_{k}"
        used.add(title.lower())
        out[pos] = title
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_are_those_taken_in_turn(spark, tmp_path, seed):
    rnd = random.Random(seed)
    pool = ["a", "A", "a_1", "a_2", "A_1_1", "abcdefgh", "abcdefgh_1", "abcdef_1", "History", "history_1", "", None, "x/y", "x?y", "'q'", "a_10"]
    rows = [(g, i, rnd.choice(pool)) for g in range(4) for i in range(40 if g else 0)] + [(9, i, "same") for i in range(120)]
    df = spark.createDataFrame(rows, "book int, pos int, name string")
    got = {(r.book, r.pos): r.unique_name for r in names.unique(df, ["book"], ["pos"], "name", str(tmp_path / "n"), most=8).collect()}
    want = {(g, p): t for g in {r[0] for r in rows} for p, t in in_turn([(i, n) for b, i, n in rows if b == g], 8).items()}
    assert got == want
    assert names.unique(df.limit(0), ["book"], ["pos"], "name", str(tmp_path / "none")).isEmpty()


# --- extracted curves ------------------------------------------------------------------------------


def batch(spark, shas, picture=b"p", pages=(0, 1), curves=3, origin="in/a b.pdf"):
    docs = spark.createDataFrame([(s, origin, 2, "1") for s in shas], extractions.DOCUMENTS)
    shown = spark.createDataFrame([(s, p, picture + str(p).encode(), 10, 10, 300) for s in shas for p in pages], extractions.PAGES)
    rows = spark.createDataFrame([(s, k % 2, f"c{k}", [[1.0, float(k)]], None) for s in shas for k in range(curves)], "sha string, page int, curve string, points array<array<double>>, note string")
    return docs, shown, rows


def test_extractions_are_added_once(spark, tmp_path):
    folder, a, b = str(tmp_path / "x"), "a" * 64, "b" * 64
    assert extractions.read(spark, folder, "pages") is None
    docs, shown, rows = batch(spark, [a])
    assert extractions.append(spark, folder, "b-1", docs, shown, rows.unionByName(rows))  # repeated rows are one record
    assert not extractions.append(spark, folder, "b-1", docs, shown, rows)
    count = lambda t: extractions.read(spark, folder, t).count()
    assert (count("documents"), count("pages"), count("records")) == (1, 2, 3)
    assert extractions.append(spark, folder, "b-2", *batch(spark, [a, b], curves=1))  # the second page is shown by no curve of b
    assert (count("documents"), count("pages"), count("records")) == (2, 3, 5)
    assert extractions.append(spark, folder, "b-3", docs, shown, rows.limit(0)) and count("records") == 5
    assert {r.name for r in extractions.read(spark, folder, "documents").collect()} == {f"a_b_{a[:12]}", f"a_b_{b[:12]}"}


def test_conflicts_stop_a_batch(spark, tmp_path):
    folder, a = str(tmp_path / "x"), "a" * 64
    docs, shown, rows = batch(spark, [a])
    extractions.append(spark, folder, "one", docs, shown, rows)
    with pytest.raises(ValueError, match=f"picture {a}:0, picture {a}:1"):
        extractions.append(spark, folder, "two", *batch(spark, [a], picture=b"other"))
    with pytest.raises(ValueError, match="document a_b_aaaaaaaaaaaa"):
        extractions.append(spark, folder, "three", *batch(spark, ["a" * 63 + "b"]))
    with pytest.raises(ValueError, match=f"no page {a}:1"):
        extractions.append(spark, folder, "four", docs, shown.where("page = 0"), rows)
    with pytest.raises(ValueError, match="no document"):
        extractions.append(spark, folder, "five", docs.limit(0), shown, rows)
    with pytest.raises(ValueError, match="no name"):
        extractions.append(spark, folder, "a/b", docs, shown, rows)
    assert extractions.committed(spark, folder).count() == 1


def test_a_broken_off_batch_is_not_read(spark, tmp_path):
    folder, a, b = str(tmp_path / "x"), "a" * 64, "b" * 64
    extractions.append(spark, folder, "one", *batch(spark, [a]))
    docs, shown, rows = batch(spark, [b])
    shown.withColumn("digest", F.lit("half")).write.parquet(f"{folder}/pages/batch=two")  # as far as it came
    assert extractions.read(spark, folder, "pages").count() == 2
    assert extractions.append(spark, folder, "two", docs, shown, rows)
    assert extractions.read(spark, folder, "pages").where("digest = 'half'").isEmpty() and extractions.read(spark, folder, "pages").count() == 4


# --- kept curves -----------------------------------------------------------------------------------


@pytest.fixture
def store(spark, tmp_path):
    units = spark.createDataFrame([(u, 2, 60.0, 3505.0) for u in (1, 2)], "unit_id int, poles int, base_freq double, base_speed double")
    points = spark.createDataFrame([(u, i, float(i), 10.0 - i, 0.1 * i, None) for u in (1, 2) for i in range(4)], "unit_id int, i int, q double, h double, eta double, npsh double")
    return kept_curves.create(spark, f"t_{uuid.uuid4().hex}", str(tmp_path / "store"), points, units, buckets=4)


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "unit_id int, frequency double")


def test_curves_are_made_once(spark, store):
    first = kept_curves.at(store, asked(spark, (1, 50.0), (1, 50.00000001), (1, 60.0)), 1)
    assert {(r.frequency, r.made) for r in first.collect()} == {(50.0, True), (60.0, False)} and first.count() == 8
    again = kept_curves.at(store, asked(spark, (1, 50.0), (2, 50.0)), 2)
    assert {(r.unit_id, r.made) for r in again.collect()} == {(1, False), (2, True)}
    kept_curves.at(store, asked(spark, (1, 50.0), (2, 50.0)), 2)  # a turn that runs again
    assert kept_curves.current(store).count() == 16
    slip = 1 - 3505.0 * 2 / (120 * 60)
    r = (50 / 60) / (1 - slip + 50 / 60 * slip)
    got = kept_curves.current(store).where("unit_id = 2 and frequency = 50 and i = 3").first()
    assert (got.q, got.h) == pytest.approx((3 * r, 7 * r * r), rel=1e-12) and got.npsh is None


def test_curves_are_removed_but_for_the_base(spark, store):
    kept_curves.at(store, asked(spark, (1, 50.0), (2, 50.0)), 1)
    kept_curves.remove(store, asked(spark, (1, 50.0000000001)), 2)
    assert {(r.unit_id, r.frequency) for r in kept_curves.current(store).collect()} == {(1, 60.0), (2, 60.0), (2, 50.0)}
    with pytest.raises(ValueError, match="base curve stays: 2 at 60.0"):
        kept_curves.remove(store, asked(spark, (2, 50.0), (2, 60.0)), 3)
    with pytest.raises(ValueError, match="not kept: 1 at 50.0"):
        kept_curves.remove(store, asked(spark, (1, 50.0), (2, 50.0)), 3)
    assert kept_curves.at(store, asked(spark, (1, 50.0)), 4).where("not made").isEmpty()
    for bad in ((1, 0.0), (1, None), (None, 50.0), (1, float("nan"))):
        with pytest.raises(ValueError, match="no frequency"):
            kept_curves.at(store, asked(spark, bad), 5)
    with pytest.raises(ValueError, match="no unit"):
        kept_curves.at(store, asked(spark, (7, 50.0)), 5)


def test_curves_meet_without_a_shuffle(spark, store):
    kept_curves.at(store, asked(spark, (1, 50.0), (2, 45.0)), 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kept_curves.current(store)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning" not in plan


# --- moves -----------------------------------------------------------------------------------------


def test_files_are_moved_once(spark, tmp_path):
    import hashlib

    root = tmp_path / "in"
    root.mkdir()
    for name in ("a", "b", "d", "taken"):
        (root / name).write_text(name)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    (root / "moved").mkdir()
    (root / "moved" / "before").write_text("c")  # an attempt before had moved c
    plan = [
        (1, "a", "new/deep/a", "PRONTO", sha("a")), (2, "b", "taken", "PRONTO", sha("b")), (3, "c", "moved/before", "PRONTO", sha("c")), (4, "gone", "x", "PRONTO", sha("z")),
        (5, "d", "../out", "PRONTO", sha("d")), (6, "d", "d2", "DESTINO_DUPLICADO", None), (7, None, "d3", "PRONTO", None),
    ]
    df = spark.createDataFrame(plan, "pos long, source string, target string, status string, sha string")
    done = moves.carry_out(df, str(root), str(tmp_path / "log"))
    got = {r.pos: r.status for r in done.collect()}
    assert (got[1], got[3], got[6]) == ("RENOMEADO", "RENOMEADO", "DESTINO_DUPLICADO")
    assert got[2] == "FALHOU: target exists: taken" and got[4] == "FALHOU: no source: gone" and got[5] == "FALHOU: unsafe path: ../out" and got[7].startswith("FALHOU: unsafe")
    assert (root / "new" / "deep" / "a").read_text() == "a" and (root / "b").exists() and (root / "taken").read_text() == "taken" and not (tmp_path / "out").exists()
    again = {r.pos: r.status for r in moves.carry_out(df, str(root), str(tmp_path / "log2")).collect()}
    assert again == got
    assert moves.carry_out(df.limit(0), str(root), str(tmp_path / "log3")).isEmpty()


# --- manifests and texts ---------------------------------------------------------------------------


def test_a_manifest_in_parts_is_one_file(spark, tmp_path):
    rows = [(f"id{i}", f"{'B' if i % 2 else 'b'}{i % 7}.pdf", 'say "x", y' if i % 3 else "line\r\nbreak", None if i % 5 else "é") for i in range(200)] + [("z", None, "", " s ")]
    df = spark.createDataFrame(rows, "id string, arquivo_origem string, observacao string, `mine,` string").repartition(7)
    sinks.write_manifest(df, str(tmp_path / "m"), parts=4)
    got = b"".join(p.read_bytes() for p in sorted((tmp_path / "m").glob("part-*")))
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\r\n")
    w.writerow(df.columns)
    w.writerows(sorted(([x or "" for x in r] for r in rows), key=lambda r: (r[1].lower(), r[0])))
    assert got == out.getvalue().encode("utf-8-sig") and len(list((tmp_path / "m").glob("part-*"))) > 1
    sinks.write_manifest(df.limit(0), str(tmp_path / "none"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "none").glob("part-*"))) == '\ufeffid,arquivo_origem,observacao,"mine,"\r\n'.encode()


def test_a_verifier_is_quoted_without_the_path(spark):
    said = "WARNING: /x/a+b(1).pdf: (object 12 0): bad\nWARNING: more"
    assert one(spark, qa.integrity(F.lit(3), F.lit(said), F.lit("/x/a+b(1).pdf"))) == "avisos: WARNING: (object 12 0): bad (+1 avisos)"
    assert one(spark, qa.integrity(F.lit(2), F.lit(r"error C:\Ex\E.pdf bad"), F.lit(r"C:\Ex\E.pdf"))) == "erro: error bad"
    assert one(spark, qa.integrity(F.lit(2), F.lit("error x"), F.lit(None).cast("string"))) == "erro: error x"


def test_texts_on_a_line(spark):
    same = ["NBR 8883", "9ab2", "0123456789", "a:b", "a#b", "2ED x", "B16.5", "1.5.2", "x - y", "é"]
    quoted = ["", "1999", "91.5", "yes", "null", "a: b", "a #b", "- a", "#x", "x ", "2001-01-01", "'q", "@x", "a:", "0x1F", "1_000", "~", "[a]"]
    for t in same:
        assert one(spark, qa.yaml_text(F.lit(t))) == t
    for t in quoted:
        assert one(spark, qa.yaml_text(F.lit(t))) == "'" + t.replace("'", "''") + "'"
    assert one(spark, qa.yaml_text(F.lit("a\nb"))) == '"a\\nb"' and one(spark, qa.yaml_text(F.lit(None).cast("string"))) == "null"


def test_messages_count_and_show_the_first(spark):
    items = [f"4.{k} Titulo da parte {k}" for k in range(1, 13)]
    front = "---\nemissor: X\nano: 1\nstatus: v\nidioma: en\ntitulo: T\nrota: A\npaginas: 5\n---\n"
    md = front + "<!-- p.1 -->\n5.1 Texto desta parte\n5.2 Texto desta parte\n5.9 Texto desta parte\n<!-- formula -->\n`a b =`\n<!-- formula -->\n![formula](x)\n`a = b`\nproibido 'x'\n"
    row = (1, md, "\n".join(items), "A", "F", 5, "80.4", "ok", "2", [f"t{k}" for k in range(7)], 3, "")
    kinds = "doc_id int, md string, source string, route string, extras string, pages int, confidence string, table_state string, tables string, low_tables array<string>, layout_tables int, status string"
    got = qa.judge(spark.createDataFrame([row, (2, *row[1:3], "C", *row[4:])], kinds), blocks=[r"proibido '\w'"], messages=True).orderBy("doc_id").collect()
    lost = "12 item(ns) do PDF ausentes no corpus: 4.1, 4.2, 4.3, 4.4, 4.5, 4.6, 4.7, 4.8 ..."
    assert [n for n in got[0].reject_notes if not n.startswith("cobertura")] == [lost, "texto bloqueado no corpus: \"proibido 'x'\"", "front-matter incompleto: origem_sha256, confianca_ocr"]
    assert got[0].review_notes == [
        "6 lacuna(s) na numeracao do corpus: 5.3, 5.4, 5.5, 5.6, 5.7, 5.8", "1 de 2 formulas sem recorte fiel", "1 de 2 formulas com ordem de leitura suspeita (50%): confira pelos recortes", "4 pagina(s) sem ancora",
        "front-matter sem codigo: preencha no override", "7 tabela(s) com acuracia < 80: t0, t1, t2, t3, t4", "Docling viu 3 tabelas, o Camelot extraiu 2", "status do documento nao declarado no override",
    ]
    assert lost in got[1].review_notes and "confianca media de OCR 80 < 85" in got[1].review_notes
    assert len(got[0].rejects) == len(got[0].reject_notes) and len(got[1].reviews) == len(got[1].review_notes)
    assert qa.judge(spark.createDataFrame([row], kinds).limit(0), messages=True).isEmpty()
    empty = qa.judge(spark.createDataFrame([(3, None, None, None, None, None, None, None, None, None, None, None)], kinds), messages=True).first()
    assert empty.verdict in ("reprovado", "revisar")
