"""Known values and edge cases of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from sluicework.operators import curves, hydraulics as hy, manifest as mf, materials as bom, quality as qa, selection as sel, text as tx, validation as val
from sluicework.streaming import capture


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_crossing_of_a_simple_curve(spark):
    """A straight pump curve and a system through (10, 20)."""
    pts = spark.createDataFrame([(1, 0.0, 30.0, 0.1, None), (1, 10.0, 20.0, 0.8, 2.0), (1, 20.0, 0.0, 0.1, 4.0)], "u int, q double, h double, eta double, npsh double")
    d = pts.withColumn("diff", F.col("h") - hy.system_head(F.col("q"), F.lit(10.0), F.lit(20.0), F.lit(0.0)))
    r = curves.first_crossing(d, ["u"], "q", "diff", ["eta", "npsh"]).first()
    assert r.found and r.q == 10 and r.eta == 0.8
    assert r.crossings == 2  # a point that lies on the system makes two changes of sign
    pairs = sel.as_arrays(pts.withColumnRenamed("u", "unit_id")).withColumns({"s": F.lit(0.0), "k": F.lit(0.2)})
    e = curves.exact_crossings(pairs, "s", "k").first()
    assert e.q == pytest.approx(10) and e.crossings == 1 and e.head == pytest.approx(20) and e.eta == pytest.approx(0.8) and e.npsh == pytest.approx(2) and e.note == ""
    none = curves.exact_crossings(pairs.withColumn("s", F.lit(99.0)), "s", "k").first()
    assert not none.found and none.q is None and none.crossings == 0 and none.note
    level = curves.exact_crossings(pairs.withColumns({"s": F.lit(25.0), "k": F.lit(0.0)}), "s", "k").first()  # a system without friction
    assert level.q == pytest.approx(5)


def test_no_crossing(spark):
    pts = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0)], "u int, q double, diff double")
    r = curves.first_crossing(pts, ["u"], "q", "diff", []).first()
    assert not r.found and r.crossings == 0 and r.q is None


def test_interpolation_holds_knots_and_ends(spark):
    pts = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, None), (1, 3.0, 6.0)], "u int, x double, y double")
    ask = spark.createDataFrame([(1, v) for v in (-1.0, 1.0, 1.5, 3.0, 4.0)], "u int, x double")
    got = {r.x: r.y for r in curves.interpolate(pts, ask, ["u"], "x", ["y"]).collect()}
    assert got == {-1.0: None, 1.0: 2.0, 1.5: None, 3.0: 6.0, 4.0: None}
    clamped = {r.x: r.y for r in curves.interpolate(pts, ask, ["u"], "x", ["y"], "clamp").collect()}
    assert clamped[-1.0] == 2.0 and clamped[4.0] == 6.0


def test_monotone_cubic_known_values(spark):
    pts = spark.createDataFrame([(1, x, y) for x, y in ((0.0, 30.0), (10.0, 28.0), (20.0, 20.0), (30.0, 0.0))], "u int, x double, y double")
    ask = spark.createDataFrame([(1, v) for v in (5.0, 15.0, 25.0, 31.0)], "u int, x double")
    got = {r.x: r.y for r in curves.resample_pchip(pts, ask, ["u"], "x", "y").collect()}
    assert got[5.0] == pytest.approx(29.4) and got[15.0] == pytest.approx(25.02857143) and got[25.0] == pytest.approx(11.82142857) and got[31.0] is None


@pytest.mark.parametrize(("xs", "direction", "offending"), [([0, 1, 2], 1, None), ([2, 1, 0], -1, None), ([0, 2, 1], 0, 3), ([0, 0, 2], 0, 2)])
def test_monotone(spark, xs, direction, offending):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(xs)], "u int, i int, x double")
    r = curves.monotone(df, ["u"], "i", "x").first()
    assert (r.direction, r.offending) == (direction, offending)


def test_affine_round_trip_and_degenerate(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    k = curves.affine([lit(10, 400, 1, 1), lit(600, 410, 1000, 1), lit(12, 20, 1, 100)], True, True)
    x, y = curves.to_real(F.lit(300.0), F.lit(200.0), k, True, True)
    u, v = curves.to_pixel(x, y, k, True, True)
    assert one(spark, u) == pytest.approx(300) and one(spark, v) == pytest.approx(200)
    flat = curves.affine([lit(0, 0, 0, 0), lit(1, 1, 1, 1), lit(2, 2, 2, 2)])
    assert one(spark, flat["a"]) is None


def test_hydraulics(spark):
    for altitude, head in ((0, 10.355056), (50, 10.294833), (80, 10.258820), (120, 10.210943)):
        assert one(spark, hy.atmospheric_head(F.lit(float(altitude)))) == pytest.approx(head, abs=1e-6)
    assert one(spark, hy.atmospheric_head(F.lit(1e6))) is None
    assert one(spark, hy.scaled_efficiency(F.lit(0.0), F.lit(0.5))) == 0
    s = hy.slip(F.lit(4), F.lit(60.0), F.lit(1750.0))
    r = hy.ratio_of_frequency(F.lit(45.0), F.lit(60.0), s)
    assert one(spark, hy.frequency_of_ratio(r, F.lit(4), F.lit(1750.0), s)) == pytest.approx(45)
    assert one(spark, hy.npsh_status(F.lit(None).cast("double"), F.lit(9.0))) == "not_available"
    assert one(spark, hy.npsh_status(F.lit(0.0), F.lit(9.0))) == "approved"
    assert one(spark, hy.npsh_status(F.lit(8.0), F.lit(9.0))) == "rejected"


def test_criteria_are_checked():
    with pytest.raises(ValueError):
        sel.Criteria(min_frequency=70)
    with pytest.raises(ValueError):
        sel.Criteria(missing_npsh="?")


def test_text(spark):
    assert one(spark, tx.slug(F.lit("Ação  de.. vento--x."))) == "Acao-de.-vento-x"
    assert one(spark, tx.latex_escape(F.lit("a&b_{c}\\"))) == r"a\&b\_\{c\}\textbackslash{}"
    assert one(spark, tx.quantity(F.lit("12.500"))) == "12,5" and one(spark, tx.quantity(F.lit("100"))) == "100"
    assert one(spark, tx.dehyphenate(F.lit("supor-\n tar Item-\nB"))) == "suportar Item-\nB"
    assert one(spark, tx.heading(F.lit("4.1 Escopo"))) == "### 4.1 Escopo"
    for n, pages in ((1, [1]), (2, [1, 2]), (7, [1, 2, 4, 6, 7]), (10, [1, 3, 6, 8, 10]), (36, [1, 10, 18, 27, 36])):
        assert one(spark, tx.page_sample(F.lit(n))) == pages
    assert one(spark, tx.page_ranges(F.lit("2-4, 3,9"), F.lit(5))) == [2, 3, 4]
    assert one(spark, tx.page_ranges(F.lit("all"), F.lit(0))) == [1]
    assert one(spark, tx.page_ranges(F.lit("x"), F.lit(5))) is None
    for line, found in (("4.3 Criterios gerais", "4.3"), ("20.6 MPa limite", None), ("3.6 B8T codigo", None), ("8.2 Estado geral ....... 30", None), ("| 4.1 Escopo geral", None)):
        assert one(spark, tx.item(F.lit(line))) == found


def test_manifest(spark):
    prev = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("e", "5")], "id string, sha string")
    now = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "3"), ("f", "3")], "id string, sha string")
    got = {r.id: (r.status, r.old_id) for r in mf.reconcile(prev, now).collect()}
    assert got == {"a": ("unchanged", None), "b": ("changed", None), "d": ("renamed", "c"), "f": ("new", None), "e": ("removed", None)}
    assert one(spark, mf.version(F.lit("triagem=1;ocr=2"), "ocr")) == 2
    assert one(spark, mf.upsert_note(F.lit("manual | [ocr] old"), "ocr", F.lit("new"))) == "manual | [ocr] new"


def test_materials_in_catalogue_order(spark):
    cat = spark.createDataFrame([(1, "F1", "B", "T", 1), (2, "F1", "B", "T", 2), (3, "F2", "A", "T", 3)], "code int, family string, material string, type string, line int")
    items = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 2.0), (9, 1.0)], "code int, quantity double")
    rows = bom.ordered(bom.select(cat, items)).orderBy("m_line", F.lower("type"), "place").collect()
    assert [r.code for r in rows] == [2, 3]
    assert [r.code for r in bom.unknown(cat, items).collect()] == [9]


def test_capture_fold_is_the_state_machine(spark):
    kinds = ["click", "click", "view", "purchase", "view", "view", "view", "click", "error", "click", "signup", "click"]
    df = spark.createDataFrame([(1, i, float(i), k) for i, k in enumerate(kinds)], "session long, seq int, at double, kind string")
    state = ([], [], False)
    for i, k in enumerate(kinds):
        state = capture.apply(*state, k, i)
    r = capture.fold(df).first()
    assert (r.points, r.undone, r.locked, r.last) == (len(state[0]), len(state[1]), state[2], state[0][-1] if state[0] else -1)
    assert r.locked and r.points == 1 and not math.isnan(r.points)


def test_crossing_twice_takes_the_least_flow(spark):
    pts = spark.createDataFrame([(1, 0.0, 10.0, 0.1, None), (1, 5.0, 30.0, 0.5, None), (1, 10.0, 0.0, 0.1, None)], "unit_id int, q double, h double, eta double, npsh double")
    r = curves.exact_crossings(sel.as_arrays(pts).withColumns({"s": F.lit(20.0), "k": F.lit(0.0)}), "s", "k").first()
    assert r.crossings == 2 and r.q == pytest.approx(2.5) and r.npsh is None and r.note.startswith("2 crossings")


def test_ways_to_an_operating_point(spark):
    pts = spark.createDataFrame([("a", q, 30 - 0.1 * q * q, 0.6, 1.0) for q in (0.0, 2.0, 4.0, 6.0, 8.0, 10.0)], "unit_id string, q double, h double, eta double, npsh double")
    units = spark.createDataFrame([("a", 4, 60.0, 1750.0, 5.0, 0.9)], "unit_id string, poles int, base_freq double, base_speed double, motor_kw double, motor_eff double")
    ask = [(1, "a", 5.0, None, 60.0, None, None, None), (2, "a", 5.0, None, None, 1750.0, None, None), (3, "a", 5.0, None, 60.0, 1000.0, None, None), (4, "a", 5.0, 27.0, None, None, None, None), (5, "a", None, None, 60.0, None, 1.1, 0.0), (6, "a", 5.0, None, None, None, None, None), (7, "a", 50.0, None, 60.0, None, None, None)]
    asked = spark.createDataFrame(ask, "ask_id int, unit_id string, q double, head double, frequency double, speed double, k double, hstat double")
    got = {r.ask_id: r for r in sel.set_points(pts, units, asked).collect()}
    assert got[1].head == pytest.approx(got[2].head) and got[1].ratio == pytest.approx(1) and got[2].frequency == pytest.approx(60)
    assert got[3].failure == "inconsistent" and got[6].failure == "nothing_given" and got[7].failure == "outside"
    assert got[4].head == 27.0 and got[4].ratio == pytest.approx(1.0, abs=0.03)
    assert got[5].q == pytest.approx(5.0, abs=0.1) and got[5].head == pytest.approx(1.1 * got[5].q ** 2)


def test_nearest_cell_skips_blank_rows(spark):
    cells = spark.createDataFrame([("m", 40.0, 3.0, "A"), ("m", 20.0, 3.0, "B"), ("m", 20.0, 9.0, "C")], "maker string, head double, flow double, unit_id string")
    asked = spark.createDataFrame([(1, 31.0, 3.0), (2, 29.0, 6.0), (3, 30.0, 6.0)], "req_id int, href double, qref double")
    assert {r.req_id: r.unit_id for r in sel.nearest(cells, asked).collect()} == {1: "A", 2: "B", 3: "B"}


FRONT = "---\nemissor: ABNT\ncodigo: 'NBR 1'\nano: 1999\nstatus: vigente\nidioma: pt-BR\ntitulo: Obras\nrota: A\norigem_sha256: ab\npaginas: 1\nconfianca_ocr: 'n/a'\n---\n"


def judged(spark, md, source="4.1 Escopo geral\n4.2 Premissas gerais", **more):
    row = {"id": 1, "md": md, "source": source, "route": "A", "extras": "", "pages": 1, "confidence": "", "table_state": "", "tables": "", "low_tables": [], "layout_tables": 0, "status": "vigente", **more}
    schema = "id int, md string, source string, route string, extras string, pages int, confidence string, table_state string, tables string, low_tables array<string>, layout_tables int, status string"
    return qa.judge(spark.createDataFrame([tuple(row.values())], schema), ["^Footer"], [r"\d{3}\.\d{3}\.\d{3}-\d{2}"]).first()


def test_verdicts(spark):
    good = FRONT + "\n<!-- p.1 -->\n## 4.1 Escopo geral\n## 4.2 Premissas gerais\n"
    r = judged(spark, good)
    assert (r.verdict, r.rejects, r.reviews) == ("aprovado", [], [])
    assert judged(spark, good, source="4.1 Escopo geral\n4.9 Perdido item aqui").rejects == ["lost_items"]
    assert judged(spark, good, source="4.1 Escopo geral\n4.9 Perdido item aqui", route="C").reviews == ["lost_items"]
    assert judged(spark, good + "| 4.9 Perdido |\n", source="4.9 Perdido item aqui").rejects == ["lost_items"]  # a table does not count
    assert judged(spark, good + "como no item 4.9: acima\n", source="4.9 Perdido item aqui").rejects == []
    assert judged(spark, good + "123.456.789-00").rejects == ["blocked"]
    assert "no_anchor" in judged(spark, good.replace("<!-- p.1 -->", "")).rejects
    assert judged(spark, good.replace(FRONT, "")).rejects == ["front_matter"]
    assert judged(spark, good.replace("codigo: 'NBR 1'", "codigo: ''")).reviews == ["uncurated"]
    assert judged(spark, "x", source="").rejects[0] == "no_source" and "coverage" in judged(spark, good, source="palavra " * 500).rejects
    assert judged(spark, good, source="Footer " * 500 + "\n4.1 Escopo geral").rejects == []  # what cleaning removes is not asked for
    assert judged(spark, good, route="D", confidence="84.9").reviews == ["confidence"] and judged(spark, good, route="A", confidence="10").reviews == []
    assert judged(spark, good, extras="G+F").rejects == ["no_tables"] and judged(spark, good, extras="F", table_state="ok", tables="2", low_tables=["t"]).reviews == ["low_tables"]
    assert judged(spark, good, table_state="ok", tables="1", layout_tables=3).reviews == ["fewer_tables"] and judged(spark, good, status="nao_declarado").reviews == ["no_status"]
    assert judged(spark, good + "4.4 Outro item aqui\n").reviews == ["gaps"] and judged(spark, good, pages=3).reviews == ["anchors"]
    assert judged(spark, good + "<!-- formula 1 -->\n`2 s q =`\n").reviews == ["unpictured", "scrambled"]


def test_numbers_are_ordered_by_parts(spark):
    md = F.lit("\n".join(f"4.{n} Titulo de secao" for n in (1, 2, 8, 12)) + "\n5.1 Titulo de secao\n5.9 Titulo de secao")
    assert one(spark, qa.missing_numbers(qa.items(md))) == ["4.3", "4.4", "4.5", "4.6", "4.7", "4.9", "4.10", "4.11"]
    assert one(spark, qa.shown(F.array(*map(F.lit, "abc")), 2)) == "a, b ..." and one(spark, qa.shown(F.array(F.lit("a")), 2)) == "a"


def test_page_figures(spark):
    pages = [(1, i, t) for i, t in enumerate(["x" * 100, "\t \n", "y" * 500, " \x0c"])] + [(2, 0, ""), (3, 0, "z" * 79)]
    got = {r.doc: r for r in qa.page_figures(spark.createDataFrame(pages, "doc int, page int, text string")).collect()}
    assert (got[1].pages, got[1].blank, got[1].poor, got[1].with_text, got[1].per_page) == (3, 1, 1, 0.67, 200)
    assert (got[2].pages, got[2].blank, got[2].with_text) == (1, 1, 0.0) and got[3].blank == 1


def test_triage_rounds_before_it_compares(spark):
    text = "\x01" * 204 + "palavra e outra coisa mais que isso " * 272  # 2.04 percent control characters
    m = qa.text_figures(F.lit(text + "x" * (10_000 - len(text))))
    assert one(spark, m["ctrl"]) == 0.02
    route = tx.route(F.lit(1.0), m["ctrl"], F.lit(0.0), F.lit(10), F.lit(0.5), F.lit(100), F.lit(0.0))
    assert one(spark, route) == "A"
    sus = lambda producer, layer=False, images=0.0, dirty=0.04: one(spark, qa.suspected(F.lit(dirty), F.lit(images), F.lit(layer), F.lit(producer)))
    assert sus("ACROBAT 5.0") and sus("x", True) and sus("x", images=0.95) and not sus("x") and not sus("Acrobat 4.0", dirty=0.03)


def test_image_coverage(spark):
    images = spark.createDataFrame([(1, 1, 612.0, 792.0, 72.0, 72.0), (1, 2, 9999.0, 9999.0, 72.0, 72.0), (1, 5, 306.0, 792.0, 0.0, 72.0)], "doc int, page int, width double, height double, x_ppi double, y_ppi double")
    sizes = spark.createDataFrame([(1, 9, 612.0, 792.0), (2, 3, 612.0, 792.0)], "doc int, pages int, page_width double, page_height double")
    assert {r.doc: r.images for r in qa.image_coverage(images, sizes).collect()} == {1: 1.0, 2: 0.0}  # page 2 is not sampled


def test_cleaning(spark):
    text = "Footer a\n<!-- p.1 --> Footer\n\tFooter b\nkeep  this CONFIDENTIAL  \n\n\n\nsupor-\ntar\n|  a   b |"
    m = qa.cleaned(F.lit(text), ["^Footer"], ["CONFIDENTIAL"])
    row = spark.range(1).select(*(v.alias(k) for k, v in m.items())).first()
    assert row.text == "<!-- p.1 --> Footer\nkeep this\n\nsuportar\n|  a   b |\n" and (row.lines, row.removed, row.spans) == (10, 2, 1)


def test_layout_redaction_and_rescue(spark):
    layout = F.from_json(F.lit('[{"text": "a 12", "orig": "x", "layer": "body"}, {"text": "", "orig": "b 34", "layer": "body"}, {"text": "4.1 Titulo", "orig": "c", "layer": "furniture"}]'), "array<struct<text:string,orig:string,layer:string>>")
    got = one(spark, qa.redacted_layout(layout, [r"\d{2}"]))
    assert [(r.text, r.orig) for r in got] == [(qa.REDACTED, qa.REDACTED), ("", qa.REDACTED), ("4.1 Titulo", "c")]
    assert one(spark, qa.rescued_titles(layout)) == ["## 4.1 Titulo"]


def test_front_matter_reads_what_it_writes(spark):
    fields = {"emissor": F.lit("DIN"), "titulo": F.lit("It's: a"), "ano": F.lit("1999"), "codigo": F.lit(None).cast("string"), "x": F.lit("no")}
    block = one(spark, qa.front_matter(fields))
    assert block == "---\nemissor: DIN\ntitulo: 'It''s: a'\nano: 1999\ncodigo: null\nx: 'no'\n---\n"
    assert one(spark, qa.front_missing(F.lit(block), ("emissor", "titulo", "codigo", "paginas"))) == ["codigo", "paginas"]
    assert one(spark, qa.front_missing(F.lit("text"), ("a", "b"))) == ["a", "b"]


def test_catalogue_and_quantities(spark):
    cat = [(2, "1", "c1", "F1", "M", "T", "t", "r", "d"), (3, "1", "c1", "F1", "M", "U", " ", "r", "d"), (4, "3", "c3", "#F", "M", "T", "t", "", "d")]
    got = {tuple(r) for r in val.catalogue(spark.createDataFrame(cat, "line int, code string, client string, family string, material string, type string, title string, ref string, descr string"), ("code", "title"), "code", "client", "family", ("material", "type", "title", "ref", "descr")).collect()}
    assert got == {("blank", "title", "3"), ("duplicate", "code", "1"), ("duplicate", "client", "c1"), ("inconsistent", "type", "F1"), ("inconsistent", "title", "F1"), ("illegal", "family", "#F")}
    cells = [(2, "a", "n", "1"), (3, "b", "s", "1"), (4, "c", "b", "1"), (5, "d", "n", None), (6, "e", "n", "NaN"), (7, "f", "n", "-Infinity"), (8, "g", "n", "-0.5"), (9, " ", "n", "1"), (10, "a", "n", "0")]
    found = {tuple(r) for r in val.quantities(spark.createDataFrame(cells, "line int, code string, kind string, value string")).collect()}
    assert found == {("not_numeric", "quantity", k) for k in "bcd"} | {("not_finite", "quantity", "e"), ("not_finite", "quantity", "f"), ("negative", "quantity", "g"), ("blank", "quantity", "9"), ("duplicate", "quantity", "a")}


def test_cases(spark):
    rows = spark.createDataFrame([(2, "a", " Manual", "x;; y ;", None, None), (3, "b", "best", None, "25", "2")], "line int, name string, mode string, ids string, temperature string, top_n string")
    got = val.cases(rows).orderBy("line").collect()
    assert (got[0]["mode"], got[0].ids, got[0].temperature, got[0].top_n, got[0].problem) == ("manual", ["x", "y"], 20.0, 3.0, None) and (got[1].problem, got[1].ids, got[1].temperature) == ("mode", [], 25.0)
    assert val.pick_cases(rows, None).count() == 2 and val.pick_cases(rows, 2).first().name == "b" and val.pick_cases(rows, "a").first().line == 2
    for wrong in (3, "c", 0):
        with pytest.raises(ValueError):
            val.pick_cases(rows, wrong)
    listed = spark.createDataFrame([(1, "u"), (1, "u"), (2, "u")], "req_id int, unit_id string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "req_id int")
    assert {tuple(r) for r in val.manual_lists(asked, listed).collect()} == {(1, "duplicate"), (3, "empty")}


def test_all_curves_at_all_values_as_by_pairs(spark):
    from pyspark.sql import functions as F

    pts = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, None), (1, 2.0, 4.0), (1, 4.0, 1.0), (2, 1.0, 7.0), (3, None, 2.0), (3, 1.0, 3.0), (3, 3.0, 6.0)], "u int, x double, y double")
    at = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 9.0, None)], "x double")
    pairs = pts.select("u").distinct().crossJoin(at)
    fine = pts.where("x is not null")
    told = lambda df: sorted(map(tuple, df.where("x is not null").collect()), key=str)
    for outside in ("null", "clamp", "flag"):
        want = told(curves.interpolate(fine, pairs, ["u"], "x", ["y"], outside))
        for sent in (100, 3):  # sent to all tasks, and dealt to buckets
            found = curves.interpolate_all(pts, at, ["u"], "x", ["y"], outside, sent)
            assert told(found) == want and len(want) == 27
    full = fine.where("u <> 1 or x <> 1").withColumn("y", F.coalesce("y", F.lit(0.0)))
    assert told(curves.resample_pchip_all(full, at, ["u"], "x", "y")) == told(curves.resample_pchip(full, pairs, ["u"], "x", "y"))


def test_interpolation_sorts_no_pairs(spark, sf_dir):
    from sluicework.plans import curve_queries as cq

    for q in (cq.q_interp_linear, cq.q_interp_strict, cq.q_resample_pchip):
        plan = q(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan and plan.index("Join") < plan.index("Window")  # windows are over curves alone, below the join
