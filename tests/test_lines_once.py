"""Rules over a text's lines: each costly step stands once in its expression, and reads as the SQL does."""

from pyspark.sql import functions as F

from sluicework.operators import quality as qa, text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def times(spark, column, what):
    """How often a function stands in the plan of a column over a text."""
    return spark.createDataFrame([("a",)], "t string").select(column.alias("x"))._jdf.queryExecution().analyzed().toString().count(what)


def test_white_space_is_unicodes(spark):
    every = [chr(n) for n in range(0x3100) if one_is_white(chr(n))]
    rows = spark.createDataFrame([(c,) for c in every], "c string").select(tx.strip(F.concat("c", F.lit("a"), "c", F.lit("b"), "c")).alias("x"), "c").collect()
    assert all(r.x == f"a{r.c}b" for r in rows) and len(rows) == len(tx.WHITE)
    assert one(spark, tx.strip(F.lit("​x᠎"))) == "​x᠎"


def one_is_white(c: str) -> bool:
    return c.isspace()  # Python's white space is Unicode's with the four separators of information


def test_text_is_cut_once(spark):
    assert times(spark, qa.lines_of(F.col("t")), "split(") == 1
    assert [one(spark, qa.lines_of(F.lit(t).cast("string"))) for t in ("", "a", "a\n", "a\r\nb", "\n\n", None)] == [[], ["a"], ["a"], ["a", "b"], ["", ""], None]


def test_items_after_any_blank(spark):
    text = "4.1\x1fEscopo geral\r\n## 4.2 Premissas x 4.3 Nada disso\x0b- 4.4 Criterios\n\n4.5 MPa limite"
    assert one(spark, qa.items(F.lit(text))) == ["4.1", "4.2", "4.4"]
    assert one(spark, qa.lost_items(F.lit("ver 4.1, 4.2\n\x1f| 4.4 |\n`4.4` 4.2"), F.lit(text))) == ["4.1", "4.4"]


def test_characters_beyond_the_first_plane(spark):
    for text in ("", "aé_9 - ½ß", "\U00010400\U0001d7d8\U0001f600 x́"):
        want = sum(c == "_" or c.isalpha() or c.isnumeric() for c in text)
        assert one(spark, qa.characters(F.lit(text))) == want


def test_cleaning_in_one_pass(spark):
    text = "The end\n  \nword-\n  part  of\tit \n1.2 Title  here\n| a  b |\nThe <!-- p.1 --> stays\x1f\n\n\n\nx supor y\n"
    rows = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    parts = qa.cleaned(F.col("t"), ("^The ",), ("supor",))
    told = [tuple(r) for r in rows.select("t", *(v.alias(k) for k, v in parts.items())).collect()]
    assert [tuple(r) for r in qa.with_cleaned(rows, "t", ("^The ",), ("supor",)).collect()] == told
    assert told[0][1:] == ("wordpart of\tit\n### 1.2 Title here\n| a  b |\nThe <!-- p.1 --> stays\n\nx y\n", 11, 1, 1)
    plan = qa.with_cleaned(rows, "t", ("^The ",))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 3  # the text, what stays of it, and the number of a title


def test_names_of_files(spark):
    name = lambda t: one(spark, F.struct(tx.file_slug(F.lit(t).cast("string")).alias("a"), tx.safe_name(F.lit(t).cast("string")).alias("b"), tx.slug(F.lit(t).cast("string")).alias("c")))
    assert tuple(name("¿½ ﬁm… Ωé—ﬀ?")) == ("½_ﬁm_Ωé_ﬀ", "12-fim...-eff", "12-fim.-eff")
    assert tuple(name(None)) == ("file", "selecao", None) and tuple(name(" ?! ")) == ("file", "selecao", "")
    long = "ab " * 30 + "! " * 2000
    assert name(long)["a"] == ("ab_" * 27)[:80] and name("a" + " _" * 900)["a"] == "a" and name("a" + "_" * 3000 + "b")["a"] == "a" + "_" * 79
    assert name("? " * 900 + "end")["a"] == "end" and name("\U00010400" * 90)["a"] == "\U00010400" * 80
    assert spark.range(1).select(tx.safe_name(F.lit("é")).alias("x"))._jdf.queryExecution().analyzed().toString().count("translate(") == 2  # the exchange, and the look for characters that become several


def test_raw_folders_are_put_in_place_by_tasks(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    from sluicework.sources import profiles, sinks

    asked, options = {}, DataFrameWriter.options
    monkeypatch.setattr(DataFrameWriter, "options", lambda self, **o: (asked.update(o), options(self, **o))[1])
    rows = spark.createDataFrame([(c, f"C {c}", i, 1.0 * i, 2.0, 3.0, 4.0) for c in ("a", "b", "c") for i in range(2)], "curve string, name string, i int, px double, py double, X double, Y double")
    sinks.write_raw(rows, str(tmp_path / "out"), profiles.Profile(("px", "py", "X", "Y")))
    assert asked["mapreduce.fileoutputcommitter.algorithm.version"] == "2" and (tmp_path / "out" / "_SUCCESS").exists()
    assert sorted(f.name for f in (tmp_path / "out").iterdir() if f.is_dir()) == [f"file=C_{c}_{c}_raw" for c in "abc"]
