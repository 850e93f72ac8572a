"""Crossings with segments as rows against the form over arrays, and requests sent against requests in buckets."""

import random

import pytest
from pyspark.sql import functions as F

from sluicework.operators import curves, quality, selection


@pytest.fixture(scope="module")
def curve_rows(spark):
    r = random.Random(4)
    rows = []
    for u in range(8):
        q, h = 0.0, 40.0
        for _ in range(r.randint(1, 12)):
            rows.append((u, q, h, r.random(), None if u == 3 else r.random()))
            q, h = q + r.choice((0.5, 1.0, 2.0)), h + r.choice((-6.0, -3.0, 2.0, 0.0))
    return spark.createDataFrame(rows, "unit_id int, q double, h double, eta double, npsh double")


@pytest.fixture(scope="module")
def requests(spark):
    r = random.Random(5)
    rows = [(i, float(r.randint(0, 45)), r.choice((0.0, 0.1, 0.5, 2.0, -0.3))) for i in range(60)] + [(60, None, 0.1), (61, 40.0, 0.0)]
    return spark.createDataFrame(rows, "req_id int, s double, k double")


@pytest.mark.parametrize("sent", [20_000, 7])
def test_both_forms_agree(spark, curve_rows, requests, sent):
    names = ["unit_id", "req_id", "found", "crossings", "q", "head", "eta", "npsh", "note"]
    rounded = [F.round(n, 6).alias(n) if n in ("q", "head", "eta", "npsh") else F.col(n) for n in names]
    got = {(r.unit_id, r.req_id): r for r in selection.exact_crossings(curve_rows, requests, "s", "k", sent=sent).select(*rounded).collect()}
    several = curve_rows.groupBy("unit_id").count().where("count > 1").select("unit_id")
    pairs = selection.paired(selection.as_arrays(curve_rows.join(several, "unit_id")), requests.where("k >= 0"), "req_id")
    want = curves.exact_crossings(pairs, "s", "k").select(*rounded).collect()
    assert len(got) == curve_rows.select("unit_id").distinct().count() * requests.count() and sum(r.found for r in want) > 50
    for r in want:
        assert got[r.unit_id, r.req_id] == r


def test_buckets_follow_the_count(spark):
    a, b = spark.range(3).select(F.col("id").alias("u")), spark.range(500).select(F.col("id").alias("req_id"))
    assert selection.paired(a, b, "req_id", 3).count() == selection.paired(a, b, "req_id").count() == 1500
    assert selection.against(a, b, "req_id", F.lit(True), 100).distinct().count() == 1500


def test_front_matter_without_values(spark):
    one = lambda md, names: spark.range(1).select(quality.front_missing(F.lit(md), names).alias("x")).first().x
    md = "---\na: 1\nb: null\nc: ''\nd: 'x: y'\ne:   \n---\nf: 1\n"
    assert one(md, list("abcdef")) == ["b", "c", "e", "f"] and one("text", ["a"]) == ["a"]
    assert spark.range(1).select(quality.front_values(F.lit(md), ["a", "d", "e"]).alias("x")).first().x == {"a": "1", "d": "x: y", "e": None}
