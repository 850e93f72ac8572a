"""The synthetic bank through the three selection modes, against values evaluated from the formulas by hand."""

import pytest
from pyspark.sql import functions as F

from sluicework.operators import selection as sel
from sluicework.plans import bank


@pytest.fixture(scope="module")
def evaluated(spark):
    u = bank.units(spark).cache()
    p = bank.points(u).cache()
    req = spark.createDataFrame([(1, 12.0, 24.0, 5.0, 120.0, 0.35), (2, 20.0, 22.0, 4.5, 80.0, 0.25), (3, 7.0, 20.0, 3.0, 50.0, 0.20)], "req_id int, qref double, href double, hstat double, altitude double, loss double")
    return sel.evaluate(sel.operating_state(p, u, req, sel.Criteria()), sel.Criteria()).cache()


def test_bank(spark):
    u = bank.units(spark)
    assert u.count() == 21 and bank.points(u).count() == 651
    assert {r[0] for r in bank.points(u).where("npsh is null").select("unit_id").distinct().collect()} == set(bank.WITHOUT_NPSH)


def test_optimize(evaluated):
    one = evaluated.where("req_id = 1")
    assert one.count() == 21 and one.where("feasible").count() == 11
    failed = one.where("failure is not null").collect()  # they stay, with an infinite score and that as their only reason
    assert len(failed) == 4 and all(r.score == float("inf") and r.reasons == [r.failure] and not r.feasible and r.power is None for r in failed)
    best = sel.optimize(one).orderBy("rank").collect()
    assert [r.unit_id for r in best] == ["FX-003", "HV-003", "HV-004"]
    assert [r.score for r in best] == pytest.approx([4.834609, 4.956615, 5.103029], abs=2e-6)
    f = best[0]
    assert (f.frequency, f.ratio, f.eta_op, f.power, f.npsh_avail) == pytest.approx((56.9111, 0.949469, 0.672879, 4.18812, 9.69844), abs=1e-4)


def test_manual_keeps_order_and_warns(spark, evaluated):
    wanted = spark.createDataFrame([(3, "AN-002", 1), (3, "HV-002", 2), (3, "FX-002", 3)], "req_id int, unit_id string, pos int")
    rows = sel.manual(evaluated, wanted).orderBy("rank").collect()
    assert [r.unit_id for r in rows] == ["AN-002", "HV-002", "FX-002"] and all(r.feasible for r in rows)
    assert [r.score for r in rows] == pytest.approx([2.888947, 2.737995, 2.642842], abs=2e-6)
    assert rows[0].warnings == ["npsh_not_verified"] and rows[0].npsh_status == "not_available"


def test_manual_keeps_what_has_no_operating_point(spark, evaluated):
    failed = evaluated.where("req_id = 1 and failure is not null").orderBy("unit_id").first().unit_id
    wanted = spark.createDataFrame([(1, failed, 1), (1, "FX-003", 2)], "req_id int, unit_id string, pos int")
    rows = sel.manual(evaluated, wanted).orderBy("rank").collect()
    assert [(r.unit_id, r.feasible) for r in rows] == [(failed, False), ("FX-003", True)]


def test_abacus_picks_one_a_maker(spark, evaluated):
    req = spark.createDataFrame([(2, 20.0, 22.0)], "req_id int, qref double, href double")
    u = bank.units(spark)
    grid = bank.abacus(u, bank.points(u), sel.Criteria())
    filled = {r.maker: r.n for r in grid.groupBy("maker").agg(F.count("*").alias("n")).collect()}
    assert filled == {"AquaNova": 33, "Fluxora": 30, "HidroVale": 32}
    chosen = sel.nearest(grid, req).select("req_id", "unit_id")
    assert {r.unit_id for r in chosen.collect()} == {"AN-004", "FX-004", "HV-004"}
    best = sel.optimize(evaluated.join(chosen, ["req_id", "unit_id"], "left_semi")).orderBy("rank").collect()
    assert [r.unit_id for r in best] == ["FX-004", "HV-004", "AN-004"] and [r.score for r in best] == pytest.approx([6.726280, 6.882354, 7.151166], abs=2e-6)


def test_missing_npsh_can_reject(evaluated):
    c = sel.Criteria(missing_npsh="reject", min_bep=0.5, max_bep=1.5)
    again = sel.evaluate(evaluated.drop("reasons", "warnings", "feasible", "score", "npsh_status"), c)
    r = again.where("unit_id = 'AN-002' and req_id = 3").first()
    assert not r.feasible and "npsh_missing" in r.reasons and r.warnings == []


def test_a_bank_of_any_makers(spark):
    of = spark.createDataFrame([("X", "S1", 1), ("Y", "S2", 1), ("X", "S3", 0)], "maker string, prefix string, m int")
    rows = {r.unit_id: r for r in bank.units(spark, of).collect()}
    fixed = {r.unit_id: r for r in bank.units(spark).collect()}
    assert len(rows) == 21 and rows["S1-004"].maker == "X"
    assert all(rows[f"S2-00{k}"][2:] == fixed[f"HV-00{k}"][2:] and rows[f"S3-00{k}"][2:] == fixed[f"AN-00{k}"][2:] for k in range(1, 8))


def test_points_are_summed_with_their_units(spark, sf_dir):
    from sluicework.plans import curve_queries as cq

    rows = cq.q_synth_bank(spark, sf_dir)
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()  # points that go through the driver grow with the makers
    u = bank.units(spark)
    held = bank.points(u, also=("maker", "size"))
    assert held.columns == ["unit_id", "maker", "size", "i", "q", "h", "eta", "npsh"] and held.join(u, ["unit_id", "maker", "size"]).count() == 651
