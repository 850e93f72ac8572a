"""Feasibility, ranking and the three selection modes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import curves, hydraulics as hy
from .curves import SENT_REQUESTS, against


@dataclass(frozen=True)
class Criteria:
    min_frequency: float = 30.0
    max_frequency: float = 60.0
    min_margin: float = 0.05
    min_npsh: float = 0.6
    min_npsh_ratio: float = 1.25
    missing_npsh: str = "allow_with_warning"
    min_bep: float | None = None
    max_bep: float | None = None
    vapor_head: float = 0.26

    def __post_init__(self) -> None:
        if self.min_frequency <= 0 or self.max_frequency < self.min_frequency:
            raise ValueError("invalid frequency range")
        if self.missing_npsh not in ("allow_with_warning", "reject"):
            raise ValueError("missing_npsh must be 'allow_with_warning' or 'reject'")


#: Buckets over which pairs are spread at least.
SPREAD = 32
#: A failure of an operating point is one of these; all numbers are null then.
FAILURES = ("unreachable", "tangent", "invalid_speed", "no_efficiency", "inconsistent", "outside", "nothing_given", "no_crossing")


#: Rows of b in a bucket, about.
BUCKET_ROWS = 4_096


def paired(a: DataFrame, b: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """Every row of a with every row of b, by an equi-join: a is copied to each bucket and b, dealt by its key, stands in one, so that work is spread evenly and no loop is nested. The buckets follow the count of b."""
    buckets = buckets or max(SPREAD, -(-b.count() // BUCKET_ROWS))
    left = a.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return left.join(b.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), "_bucket").drop("_bucket")


def exact_crossings(points: DataFrame, requests: DataFrame, static: str, k: str, tolerance: float = 1e-9, sent: int = SENT_REQUESTS) -> DataFrame:
    """(unit_id, the requests' columns, found, crossings, q: the least, head, eta, npsh, note) for each unit and request: where the curve's segments meet static + k q^2, each within a tolerance of its segment.

    Segments are rows, dealt by unit once. Few of them can hold a root of a request: those over which the difference changes its sign, or turns; the others are left out as the pairs are made, but for
    a unit's first, which stands for pairs without a root. Roots are at most two a segment; of a quadratic's roots the larger in size comes from the sum that loses no digits, the other
    from their product. What belongs to a pair is in one task already, so that nothing is shuffled by pair. A unit of one point has no crossings; null statics have none either.
    """
    spark, c = points.sparkSession, F.col
    names = ("q", "h", "eta", "npsh")
    own = points.select("unit_id", *(c(n).cast("double").alias(n) for n in names)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit_id")
    slope = (c("h1") - c("h")) / F.nullif(c("q1") - c("q"), F.lit(0.0))
    segs = curves.segments(own, ["unit_id"], "q", names[1:]).where("q1 is not null or seg = 1").withColumn("_m", slope).withColumn("_c", c("h") - c("_m") * c("q"))
    asked = requests.withColumns({"_static": c(static).cast("double"), "_k": c(k).cast("double")})
    lo, hi, m, kk = c("q") - tolerance, c("q1") + tolerance, c("_m"), c("_k")
    away = lambda x: F.signum(c("_static") + kk * x * x - c("_c") - m * x)
    turns = (m - 2 * kk * lo) * (m - 2 * kk * hi) <= 0
    pairs = against(segs, asked, "req_id", (c("seg") == 1) | (away(lo) * away(hi) <= 0) | turns, sent)
    const = c("_static") - c("_c")
    disc = m * m - 4 * kk * const
    w = F.when(disc >= 0, (m + F.when(m < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(disc, F.lit(0.0)))) / 2)
    flat = F.abs(kk) < 1e-14
    first = F.when(flat, F.when(F.abs(m) >= 1e-14, const / F.nullif(m, F.lit(0.0)))).otherwise(w / F.when(~flat, kk))
    other = F.when(~flat, const / F.nullif(w, F.lit(0.0)))
    rows = pairs.withColumns({"_first": first, "_other": other})
    inside = lambda r: F.when((c(r) >= lo) & (c(r) <= hi), F.round(c(r), 10))
    keep = ["unit_id", *requests.columns, "_static", "_k", *names, *(f"{n}1" for n in names)]
    rows = rows.select(*keep, inside("_first").alias("_r1"), inside("_other").alias("_r2"))
    rows = rows.select(*keep, F.explode(F.array("_r1", "_r2")).alias("_x"))
    z = F.least(F.greatest(c("_x"), c("q")), c("q1"))
    at = lambda y: curves.lerp(z, c("q"), c("q1"), c(y), c(f"{y}1")).alias(y)
    hit = F.when(c("_x").isNotNull(), F.struct(c("_x").alias("x"), c("q").alias("q"), at("eta"), at("npsh")))
    told = rows.groupBy("unit_id", *requests.columns, "_static", "_k").agg(F.count_distinct("_x").alias("n"), F.min(hit).alias("hit"))
    note = F.when(c("n") == 0, "no crossing within the curve").when(c("n") > 1, F.concat(c("n").cast("string"), F.lit(" crossings; the one with the least flow"))).otherwise("")
    return told.select("unit_id", *requests.columns, (c("n") > 0).alias("found"), c("n").alias("crossings"), c("hit.x").alias("q"), curves.system_head(c("hit.x"), c("_static"), kk).alias("head"), c("hit.eta").alias("eta"), c("hit.npsh").alias("npsh"), note.alias("note"))


def as_arrays(points: DataFrame) -> DataFrame:
    """(unit_id, pts, segs): a curve as one row, its points in order and its segments as pairs a, b of them; a curve has some dozens."""
    rows = points.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in ("q", "h", "eta", "npsh"))))).alias("pts"))
    pair = lambda i: F.struct(F.get("pts", i - 1).alias("a"), F.get("pts", i).alias("b"))
    return curves.held(rows, segs=F.when(F.size("pts") >= 2, F.transform(F.sequence(F.lit(1), F.size("pts") - 1), pair)))


def _duties(points: DataFrame, units: DataFrame | None, requests: DataFrame, sent: int = SENT_REQUESTS) -> DataFrame:
    """Each unit's and each request's columns with _s: the first segment (a, b) over which the request's parabola through the origin crosses the unit's curve; null without one.

    The segments are rows, dealt by unit once; those that the parabola crosses are found as pairs are made, and the first of a pair by its number. A unit's first segment
    stands for pairs without one. Curves and units join by unit, where the pairs are already; requests are sent while they are few.
    """
    c = F.col
    own = points.select("unit_id", *(c(n).cast("double").alias(n) for n in ("q", "h"))).repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit_id")
    segs = curves.segments(own, ["unit_id"], "q", ["h"]).where("q1 is not null or seg = 1")
    asked = requests.select("req_id", (c("href") / (c("qref") * c("qref"))).alias("_c"))
    side = lambda q, h: F.signum(c(h) - c("_c") * c(q) * c(q))
    crossed = F.coalesce(side("q", "h") != side("q1", "h1"), F.lit(False))
    pairs = against(segs, asked, "req_id", (c("seg") == 1) | crossed, sent).groupBy("unit_id", "req_id").agg(F.min(F.when(crossed, c("seg"))).alias("_seg"))
    arrays = as_arrays(points)
    curves_ = arrays.join(units, "unit_id") if units is not None else arrays
    rows = pairs.join(curves_, "unit_id").join(F.broadcast(requests) if requests.count() <= sent else requests, "req_id")
    return curves.held(rows, _s=F.get("segs", c("_seg") - 1)).drop("_seg", "pts", "segs")


def _duty(rows: DataFrame) -> DataFrame:
    """rows (segs, qref, href) with p0, p1: the first segment over which the duty's parabola through the origin crosses the curve; null without one."""
    rows = curves.held(rows, _c=F.col("href") / (F.col("qref") * F.col("qref")))
    side = lambda p: F.signum(p["h"] - F.col("_c") * p["q"] * p["q"])
    return _met(curves.held(rows, _s=F.get(F.filter("segs", lambda s: side(s["a"]) != side(s["b"])), F.lit(0))).drop("_c"))


def _met(found: DataFrame) -> DataFrame:
    """rows (_s, qref, href) with p0, p1, q_base and the failure."""
    found = found.withColumns({"p0": F.col("_s.a"), "p1": F.col("_s.b")})
    away = lambda p: F.col(f"{p}.h") - F.col("href") * F.pow(F.col(f"{p}.q") / F.col("qref"), F.lit(2.0))
    d0, d1, width = away("p0"), away("p1"), F.col("p1.q") - F.col("p0.q")
    found = curves.held(found, q_base=F.col("p0.q") + width * F.try_divide(d0, d0 - d1), _slope=F.abs(F.try_divide(d0 - d1, width)))
    failure = F.when(F.col("p0").isNull(), "unreachable").when(F.coalesce(F.col("_slope"), F.lit(0.0)) < 1e-14, "tangent").when(F.col("q_base") <= 0, "invalid_speed")
    return found.withColumn("failure", failure).drop("_slope", "_s")


def required_ratio(points: DataFrame, requests: DataFrame) -> DataFrame:
    """(unit_id, req_id, ratio, q_base, failure): the speed at which each unit passes through each request's duty, or why none does.

    A curve is one row, so that units and requests are paired once each and nothing is shuffled by pair.
    """
    rows = _met(_duties(points, None, requests.select("req_id", "qref", "href")))
    fine = F.col("failure").isNull()
    return rows.select("unit_id", "req_id", F.when(fine, F.col("qref") / F.col("q_base")).alias("ratio"), F.when(fine, F.col("q_base")).alias("q_base"), "failure")


def _at(rows: DataFrame) -> tuple[Column, Column, Column]:
    """(head, efficiency, cavitation) of the curve at `ratio` times its speed, at q_base of the base curve, between p0 and p1."""
    c, r = F.col, F.col("ratio")
    t = (c("q_base") - c("p0.q")) / (c("p1.q") - c("p0.q"))
    e0, e1 = hy.scaled_efficiency(c("p0.eta"), r), hy.scaled_efficiency(c("p1.eta"), r)
    npsh = F.when(c("q_base") == c("p0.q"), c("p0.npsh")).when(c("q_base") == c("p1.q"), c("p1.npsh")).otherwise(c("p0.npsh") + (c("p1.npsh") - c("p0.npsh")) * t) * r * r
    return (c("p0.h") + (c("p1.h") - c("p0.h")) * t) * r * r, e0 + (e1 - e0) * t, npsh


def operating_state(points: DataFrame, units: DataFrame, requests: DataFrame, criteria: Criteria) -> DataFrame:
    """Each unit at each request: speed, frequency, efficiency, powers, cavitation and flow against the best point; `failure` where it has no operating point, numbers being null then."""
    rows = _met(_duties(points, units, requests))
    rows = curves.held(rows, ratio=F.when(F.col("failure").isNull(), F.col("qref") / F.col("q_base")))
    s, r = hy.slip(F.col("poles"), F.col("base_freq"), F.col("base_speed")), F.col("ratio")
    _, eta, npsh = _at(rows)
    rows = curves.held(rows, eta_op=eta, npsh_req=npsh)
    rows = curves.held(rows, failure= F.coalesce("failure", F.when(1 - s * r <= 0, "invalid_speed"), F.when(F.coalesce(F.col("eta_op") <= 0, F.lit(True)), "no_efficiency")))
    fine = lambda c: F.when(F.col("failure").isNull(), c)
    power = hy.shaft_power(F.col("qref"), F.col("href"), F.col("eta_op"))
    available = hy.atmospheric_head(F.col("altitude")) + (F.col("submergence_mm") - F.col("axis_mm")) * 1e-3 - F.col("loss") - criteria.vapor_head
    told = curves.held(
        rows, ratio=fine(r), frequency=fine(hy.frequency_of_ratio(r, F.col("poles"), F.col("base_speed"), s)), eta_op=fine(F.col("eta_op")), power=fine(power), margin=fine(1 - power / F.col("motor_kw")),
        electric=fine(power / F.col("motor_eff")), npsh_req=fine(F.col("npsh_req")), npsh_avail=available, bep_ratio=fine(F.col("qref") / (F.col("qbep") * r)),
    )
    return told.select("unit_id", "req_id", "maker", "failure", "ratio", "qref", "href", "frequency", "eta_op", "power", "margin", "electric", "npsh_req", "npsh_avail", "bep_ratio")


def set_points(points: DataFrame, units: DataFrame, asked: DataFrame) -> DataFrame:
    """Operating points as asked for: (ask_id, unit_id, failure, q, head, ratio, speed, frequency, slip, eta, power, margin, electric, npsh_req).

    asked: ask_id, unit_id, q, head, frequency, speed, k, hstat. With k and hstat (a system) the first crossing of the curve at the frequency gives flow and head; else a head gives
    the speed; else speed or frequency does, which must agree within a millionth if both are given.
    """
    c = F.col
    rows = asked.withColumnsRenamed({"q": "qref", "head": "href"}).join(as_arrays(points), "unit_id").join(units.select("unit_id", "poles", "base_freq", "base_speed", "motor_kw", "motor_eff"), "unit_id")
    s = hy.slip(c("poles"), c("base_freq"), c("base_speed"))
    of_speed, of_frequency = c("speed") / c("base_speed"), hy.ratio_of_frequency(c("frequency"), c("base_freq"), s)
    system = c("k").isNotNull()
    rows = rows.withColumn("_r", F.when(system, of_frequency).when(c("href").isNotNull(), F.lit(None).cast("double")).when(c("speed").isNotNull(), of_speed).otherwise(of_frequency))
    faster = lambda p: F.struct((p["q"] * c("_r")).alias("q"), (p["h"] * c("_r") * c("_r")).alias("h"))
    scaled = F.transform("segs", lambda x: F.struct(faster(x["a"]).alias("a"), faster(x["b"]).alias("b")))
    rows = curves.held(curves.held(rows, _scaled=scaled), _roots=F.when(system & c("_r").isNotNull(), curves.exact_roots(c("_scaled"), c("hstat"), c("k"))))
    rows = curves.held(rows, qref=F.when(system, F.get("_roots", F.lit(0))).otherwise(c("qref")))
    by_head = _duty(rows)
    q_base = F.when(system | c("href").isNull(), c("qref") / c("_r")).otherwise(c("q_base"))
    rows = curves.held(by_head.withColumns({"_by_head": ~system & c("href").isNotNull(), "_first": c("failure")}), q_base=q_base)
    holds = F.get(F.filter("segs", lambda x: (c("q_base") <= x["b"]["q"] + 1e-12) & (c("q_base") >= x["a"]["q"] - 1e-12)), F.lit(0))
    rows = curves.held(rows, _s=holds)
    rows = curves.held(rows, **{n: F.when(c("_by_head"), c(n)).otherwise(c(f"_s.{k}")) for k, n in (("a", "p0"), ("b", "p1"))})
    rows = rows.withColumn("ratio", F.when(c("_by_head"), c("qref") / c("q_base")).otherwise(c("_r")))
    derived = hy.frequency_of_ratio(c("ratio"), c("poles"), c("base_speed"), s)
    frequency = F.when(~c("_by_head") & c("speed").isNull(), c("frequency")).otherwise(derived)
    apart = F.abs(c("frequency") - derived) > 1e-6 * F.greatest(F.abs(c("frequency")), F.abs(derived), F.lit(1.0))
    head, eta, npsh = _at(rows)
    rows = rows.withColumns({"_head": F.when(system, curves.system_head(c("qref"), c("hstat"), c("k"))).when(c("_by_head"), c("href")).otherwise(head), "_eta": eta, "_npsh": npsh, "_frequency": frequency})
    failure = (
        F.when(c("_by_head") & c("_first").isNotNull(), c("_first"))
        .when(~c("_by_head") & c("speed").isNull() & c("frequency").isNull(), "nothing_given")
        .when(~system & ~c("_by_head") & c("speed").isNotNull() & apart, "inconsistent")
        .when(c("ratio").isNull() & ~system | (1 - s * c("ratio") <= 0), "invalid_speed")
        .when(system & c("qref").isNull(), "no_crossing")
        .when(c("p0").isNull(), "outside")
        .when(F.coalesce(c("_eta") <= 0, F.lit(True)), "no_efficiency")
    )
    rows = rows.withColumn("failure", failure)
    fine = lambda x: F.when(c("failure").isNull(), x)
    power = hy.shaft_power(c("qref"), c("_head"), c("_eta"))
    synchronous = 120 * c("_frequency") / c("poles")
    return rows.select(
        "ask_id", "unit_id", "failure", fine(c("qref")).alias("q"), fine(c("_head")).alias("head"), fine(c("ratio")).alias("ratio"), fine(c("base_speed") * c("ratio")).alias("speed"), fine(c("_frequency")).alias("frequency"),
        fine((synchronous - c("base_speed") * c("ratio")) / synchronous).alias("slip"), fine(c("_eta")).alias("eta"), fine(power).alias("power"), fine(1 - power / c("motor_kw")).alias("margin"),
        fine(power / c("motor_eff")).alias("electric"), fine(c("_npsh")).alias("npsh_req"),
    )


def evaluate(states: DataFrame, c: Criteria) -> DataFrame:
    """States with npsh_status, all rejection reasons, warnings, feasible and score. A unit without an operating point stays, with that as its only reason and an infinite score."""
    failed = F.col("failure").isNotNull()
    status = F.when(~failed, hy.npsh_status(F.col("npsh_req"), F.col("npsh_avail"), c.min_npsh, c.min_npsh_ratio))
    rejects = c.missing_npsh == "reject"

    def reason(test: Column, name: str) -> Column:
        return F.when(test, F.lit(name))

    tests = [
        reason(F.col("frequency") < c.min_frequency, "frequency_low"), reason(F.col("frequency") > c.max_frequency, "frequency_high"), reason(F.col("margin") < c.min_margin, "motor_margin"),
        reason(F.col("npsh_status") == "rejected", "npsh"), reason((F.col("npsh_status") == "not_available") & F.lit(rejects), "npsh_missing"),
    ]
    if c.min_bep is not None:
        tests.append(reason(F.col("bep_ratio") < c.min_bep, "bep_low"))
    if c.max_bep is not None:
        tests.append(reason(F.col("bep_ratio") > c.max_bep, "bep_high"))
    score = F.coalesce(F.col("electric") * (1 + 0.02 * F.abs(F.col("bep_ratio") - 1)), F.lit(float("inf")))
    rows = curves.held(curves.held(states, npsh_status=status), reasons=F.when(failed, F.array("failure")).otherwise(F.array_compact(F.array(*tests))))
    return rows.withColumns({"warnings": F.array_compact(F.array(reason((F.col("npsh_status") == "not_available") & F.lit(not rejects), "npsh_not_verified"))), "feasible": F.size("reasons") == 0, "score": score})


def rank(evaluated: DataFrame, by: str = "req_id") -> DataFrame:
    """Rank from 1 by feasible first, score, then id."""
    return evaluated.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("feasible"), "score", "unit_id")))


def optimize(evaluated: DataFrame, top: int = 3) -> DataFrame:
    return rank(evaluated.where("feasible")).where(F.col("rank") <= top)


def manual(evaluated: DataFrame, wanted: DataFrame, top: int = 3) -> DataFrame:
    """wanted: req_id, unit_id, pos. Input order; infeasible ones and those without an operating point keep their place. `validation.manual_lists` finds lists that are empty or repeat an id."""
    met = evaluated.join(wanted, ["req_id", "unit_id"])
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("req_id").orderBy("pos"))).where(F.col("rank") <= top)


def build_abacus(evaluated: DataFrame) -> DataFrame:
    """The best feasible unit of each maker at each grid cell (req_id)."""
    w = Window.partitionBy("maker", "req_id").orderBy("score", "unit_id")
    return evaluated.where("feasible").withColumn("n", F.row_number().over(w)).where("n = 1").select("maker", F.col("href").alias("head"), F.col("qref").alias("flow"), "unit_id", "req_id")


def sheets(abacus: DataFrame) -> DataFrame:
    """(maker, sheet): each maker's cells by head, then flow; a sheet is one that people read."""
    rows = abacus.groupBy("maker", "head").agg(F.array_sort(F.collect_list(F.struct("flow", "unit_id"))).alias("cells"))
    return rows.groupBy("maker").agg(F.array_sort(F.collect_list(F.struct("head", "cells"))).alias("sheet"))


def nearest(abacus: DataFrame, requests: DataFrame) -> DataFrame:
    """Each maker's unit for each request: the nearest head row with any unit, then the nearest flow in it; ties in sheet order.

    A maker's sheet is one row, searched by head first and then along one row of it, so that cells are never paired with requests.
    """
    asked = requests.select("req_id", F.col("href").alias("_h"), F.col("qref").alias("_q"))
    rows = paired(sheets(abacus), asked, "req_id")
    near = F.array_min(F.transform("sheet", lambda r: F.struct(F.abs(r["head"] - F.col("_h")).alias("d"), r["head"].alias("head"), r["cells"].alias("cells"))))
    rows = curves.held(rows, row=near)
    cell = F.array_min(F.transform("row.cells", lambda x: F.struct(F.abs(x["flow"] - F.col("_q")).alias("d"), x["flow"].alias("flow"), x["unit_id"].alias("unit_id"))))
    return curves.held(rows, cell=cell).select("maker", "req_id", "row.head", "cell.flow", "cell.unit_id")
