"""Queries of the curve, hydraulic and selection families, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curves, hydraulics as hy, selection as sel, validation as val
from . import bank
from .adapters import ETA_SHIFTS, ETAS, FLOW_SCALES, FLOWS, HEAD_SCALES, HEADS, frame, ladder, pick, view, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with the oracle's SQL over the views."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views("duckdb", sql)
        return f

    return put


def _r(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _against_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, systems = view(spark, sf_dir, "curve_pt"), view(spark, sf_dir, "system")
    pairs = points.crossJoin(F.broadcast(systems))  # three systems of each region: five regions
    return pairs.withColumn("diff", F.col("h") - hy.system_head(F.col("q"), F.col("qnom"), F.col("amt"), F.col("dg")))


_DIFF = """WITH d AS (SELECT unit_id, sys_id, q, eta, npsh, h - (dg + (amt - dg) * pow(q / qnom, 2)) AS diff FROM curve_pt CROSS JOIN system),
 s AS (SELECT *, lead(q) OVER w AS q1, lead(diff) OVER w AS d1, lead(eta) OVER w AS eta1, lead(npsh) OVER w AS npsh1 FROM d WINDOW w AS (PARTITION BY unit_id, sys_id ORDER BY q)),
 c AS (SELECT *, q1 IS NOT NULL AND sign(diff) <> sign(d1) AS hit, q + (q1 - q) * (diff / (diff - d1)) AS qx FROM s) """


@query(_DIFF + """, n AS (SELECT *, row_number() OVER (PARTITION BY unit_id, sys_id ORDER BY CASE WHEN hit THEN 0 ELSE 1 END, q) AS rn, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id, sys_id) AS k FROM c)
 SELECT unit_id, sys_id, hit AS found, CAST(k AS BIGINT) AS crossings, round(CASE WHEN hit THEN qx END, 6) AS q, round(CASE WHEN hit THEN dg + (amt - dg) * pow(qx / qnom, 2) END, 6) AS h,
 round(CASE WHEN hit THEN CASE WHEN qx = q THEN eta WHEN qx = q1 THEN eta1 ELSE eta + (eta1 - eta) * ((qx - q) / (q1 - q)) END END, 6) AS eta,
 round(CASE WHEN hit THEN CASE WHEN qx = q THEN npsh WHEN qx = q1 THEN npsh1 ELSE npsh + (npsh1 - npsh) * ((qx - q) / (q1 - q)) END END, 6) AS npsh FROM n JOIN system USING (sys_id) WHERE rn = 1""")
def q_operating_points(spark, sf_dir):
    """Where each unit's curve first meets each system's, both linear within a segment."""
    hit = curves.first_crossing(_against_systems(spark, sf_dir), ["unit_id", "sys_id"], "q", "diff", ["eta", "npsh"])
    rows = hit.join(F.broadcast(view(spark, sf_dir, "system")), "sys_id").withColumn("h", hy.system_head(F.col("q"), F.col("qnom"), F.col("amt"), F.col("dg")))
    return _r(rows.select("unit_id", "sys_id", "found", "crossings", "q", "h", "eta", "npsh"), "q", "h", "eta", "npsh")


@query(_DIFF + "SELECT unit_id, sys_id, CAST(count(*) AS BIGINT) AS changes, round(min(q), 6) AS first_q FROM c WHERE hit GROUP BY unit_id, sys_id")
def q_sign_changes(spark, sf_dir):
    found = curves.sign_changes(_against_systems(spark, sf_dir), ["unit_id", "sys_id"], "q", "diff")
    return _r(found.groupBy("unit_id", "sys_id").agg(F.count("*").alias("changes"), F.min("q").alias("first_q")), "first_q")


@query("""WITH p AS (SELECT unit_id, req_id, q, h, eta, npsh, hstat, (href - hstat) / pow(qref, 2) AS k FROM curve_pt CROSS JOIN request),
 s AS (SELECT *, lead(q) OVER w AS q1, lead(h) OVER w AS h1, lead(eta) OVER w AS eta1, lead(npsh) OVER w AS npsh1 FROM p WINDOW w AS (PARTITION BY unit_id, req_id ORDER BY q)),
 m AS (SELECT *, (h1 - h) / (q1 - q) AS m FROM s WHERE q1 IS NOT NULL), c AS (SELECT *, hstat - (h - m * q) AS c FROM m), e AS (SELECT *, m * m - 4e0 * k * c AS disc FROM c),
 w AS (SELECT *, CASE WHEN disc >= 0 THEN (m + CASE WHEN m < 0 THEN -1e0 ELSE 1e0 END * sqrt(greatest(disc, 0e0))) / 2e0 END AS w FROM e),
 r AS (SELECT *, w / k AS r FROM w UNION ALL SELECT *, CASE WHEN w <> 0 THEN c / w END FROM w),
 i AS (SELECT *, round(r, 10) AS x, least(greatest(r, q), q1) AS z FROM r WHERE r >= q - 1e-9 AND r <= q1 + 1e-9),
 b AS (SELECT unit_id, req_id, count(DISTINCT x) AS n, min(x) AS x, arg_min(eta + (eta1 - eta) * ((z - q) / (q1 - q)), (x, q)) AS eta, min_by(npsh + (npsh1 - npsh) * ((z - q) / (q1 - q)), (x, q)) AS npsh FROM i GROUP BY unit_id, req_id)
 SELECT unit_id, req_id, x IS NOT NULL AS found, CAST(coalesce(n, 0) AS BIGINT) AS crossings, round(x, 6) AS q, round(hstat + (href - hstat) * pow(x / qref, 2), 6) AS head, round(b.eta, 6) AS eta, round(b.npsh, 6) AS npsh,
 CASE WHEN n IS NULL THEN 'no crossing within the curve' WHEN n > 1 THEN concat(n, ' crossings; the one with the least flow') ELSE '' END AS note FROM unit CROSS JOIN request LEFT JOIN b USING (unit_id, req_id)""")
def q_exact_intersections(spark, sf_dir):
    """Roots of segment = system, for each unit and request; segments are rows, and nothing is shuffled by pair."""
    req = view(spark, sf_dir, "request").select("req_id", "hstat", ((F.col("href") - F.col("hstat")) / F.pow("qref", F.lit(2.0))).alias("k"))
    found = sel.exact_crossings(view(spark, sf_dir, "curve_pt"), req, "hstat", "k")
    return _r(found.select("unit_id", "req_id", "found", "crossings", "q", "head", "eta", "npsh", "note"), "q", "head", "eta", "npsh")


@query("SELECT req_id, round(hstat + (href - hstat) * pow(0.5e0, 2), 6) AS half, round(hstat, 6) AS zero, round(href, 6) AS full FROM request")
def q_system_head(spark, sf_dir):
    at = lambda f: F.round(hy.system_head(F.col("qref") * f, F.col("qref"), F.col("href"), F.col("hstat")), 6)
    return view(spark, sf_dir, "request").select("req_id", at(0.5).alias("half"), at(0.0).alias("zero"), at(1.0).alias("full"))


@query("SELECT req_id, i, round(2e0 * qref * i / 60e0, 6) AS q, round(hstat + (href - hstat) * pow(2e0 * i / 60e0, 2), 6) AS h FROM request CROSS JOIN (SELECT unnest(range(61))::INT AS i)")
def q_system_grid(spark, sf_dir):
    req = view(spark, sf_dir, "request").withColumns({"low": F.lit(0.0), "high": 2 * F.col("qref")})
    rows = curves.grid(req, ["req_id", "qref", "href", "hstat"], "low", "high", 61, "q")
    return _r(rows.withColumn("h", hy.system_head(F.col("q"), F.col("qref"), F.col("href"), F.col("hstat"))).select("req_id", "i", "q", "h"), "q", "h")


_SEG = """WITH s AS (SELECT unit_id, q, eta, npsh, h, lead(q) OVER w AS q1, lead(eta) OVER w AS eta1, lead(npsh) OVER w AS npsh1, lead(h) OVER w AS h1, max(q) OVER (PARTITION BY unit_id) AS qmax, min(q) OVER (PARTITION BY unit_id) AS qmin FROM curve_pt WINDOW w AS (PARTITION BY unit_id ORDER BY q)),
 a AS (SELECT unit_id, req_id, qref AS x FROM unit CROSS JOIN request) """


def _ask(spark, sf_dir):
    """The flow of each request, one row a request."""
    return view(spark, sf_dir, "request").select(F.col("qref").alias("q"))


@query(_SEG + """SELECT a.unit_id, round(x, 6) AS q, round(h + CASE WHEN x = q OR q1 IS NULL THEN 0e0 ELSE (h1 - h) * ((x - q) / (q1 - q)) END, 6) AS h, round(CASE WHEN x = q OR q1 IS NULL THEN npsh ELSE npsh + (npsh1 - npsh) * ((x - q) / (q1 - q)) END, 6) AS npsh
 FROM a JOIN s ON a.unit_id = s.unit_id AND x >= q AND (x < q1 OR q1 IS NULL)""")
def q_interp_linear(spark, sf_dir):
    """Values at each request's flow, held at the ends."""
    return _r(curves.interpolate_all(view(spark, sf_dir, "curve_pt"), _ask(spark, sf_dir), ["unit_id"], "q", ["h", "npsh"], "clamp"), "q", "h", "npsh")


@query(_SEG + """SELECT a.unit_id, round(x, 6) AS q, round(CASE WHEN x > qmax THEN NULL WHEN x = q THEN h ELSE h + (h1 - h) * ((x - q) / (q1 - q)) END, 6) AS h, x > qmax AS outside FROM a JOIN s ON a.unit_id = s.unit_id AND x >= q AND (x < q1 OR q1 IS NULL)""")
def q_interp_strict(spark, sf_dir):
    return _r(curves.interpolate_all(view(spark, sf_dir, "curve_pt"), _ask(spark, sf_dir), ["unit_id"], "q", ["h"], "flag"), "q", "h")


_SERIES = """WITH pts AS (SELECT curve, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM series WINDOW w AS (PARTITION BY curve ORDER BY x)),
 lim AS (SELECT min(x) AS lo, max(x) AS hi FROM series), g AS (SELECT i, lo + i * ((hi - lo) / 24e0) AS gx FROM lim CROSS JOIN (SELECT unnest(range(25))::INT AS i)),
 v AS (SELECT c.curve, i, gx, CASE WHEN gx = x THEN y ELSE y + (y1 - y) * ((gx - x) / (x1 - x)) END AS y FROM (SELECT DISTINCT curve FROM series) c CROSS JOIN g LEFT JOIN pts ON pts.curve = c.curve AND gx >= x AND (gx < x1 OR gx = x)) """


def _common(spark, sf_dir) -> DataFrame:
    points = view(spark, sf_dir, "series")
    lim = points.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    g = curves.grid(lim, [], "lo", "hi", 25, "x")
    asked = points.select("curve").distinct().crossJoin(F.broadcast(g))  # 25 rows
    return curves.interpolate(points, asked, ["curve"], "x", ["y"])


@query(_SERIES + "SELECT curve, round(gx, 6) AS x, round(y, 6) AS y FROM v")
def q_resample_linear(spark, sf_dir):
    return _r(_common(spark, sf_dir), "x", "y")


@query(_SERIES + "SELECT round(gx, 6) AS x, CAST(count(*) AS BIGINT) AS curves, CAST(count(y) AS BIGINT) AS known, round(sum(y), 4) AS total FROM v GROUP BY 1")
def q_common_grid(spark, sf_dir):
    return _r(_common(spark, sf_dir).withColumn("x", F.round("x", 6)).groupBy("x").agg(F.count("*").alias("curves"), F.count("y").alias("known"), F.sum("y").alias("total")), "total", digits=4)


@query(_SERIES + "SELECT curve, CAST(sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, bool_or(y IS NULL) AS incomplete FROM v GROUP BY curve")
def q_grid_incomplete(spark, sf_dir):
    return _common(spark, sf_dir).groupBy("curve").agg(F.count_if(F.col("y").isNull()).alias("missing"), F.bool_or(F.col("y").isNull()).alias("incomplete"))


@query("""WITH p AS (SELECT unit_id, q AS x, h AS y, lag(q) OVER w AS xp, lag(h) OVER w AS yp, lead(q) OVER w AS xn, lead(h) OVER w AS yn, lag(q, 2) OVER w AS xp2, lag(h, 2) OVER w AS yp2, lead(q, 2) OVER w AS xn2, lead(h, 2) OVER w AS yn2 FROM curve_pt WINDOW w AS (PARTITION BY unit_id ORDER BY q)),
 s AS (SELECT *, x - xp AS hp, xn - x AS hn, (y - yp) / (x - xp) AS sp, (yn - y) / (xn - x) AS sn, xp - xp2 AS hp2, (yp - yp2) / (xp - xp2) AS sp2, xn2 - xn AS hn2, (yn2 - yn) / (xn2 - xn) AS sn2 FROM p),
 e AS (SELECT *, ((2e0 * hn + hn2) * sn - hn * sn2) / (hn + hn2) AS el, ((2e0 * hp + hp2) * sp - hp * sp2) / (hp + hp2) AS er FROM s),
 d AS (SELECT unit_id, x, y, CASE WHEN sp IS NULL THEN CASE WHEN sign(el) <> sign(sn) THEN 0e0 WHEN sign(sn) <> sign(sn2) AND abs(el) > 3e0 * abs(sn) THEN 3e0 * sn ELSE el END
   WHEN sn IS NULL THEN CASE WHEN sign(er) <> sign(sp) THEN 0e0 WHEN sign(sp) <> sign(sp2) AND abs(er) > 3e0 * abs(sp) THEN 3e0 * sp ELSE er END
   WHEN sign(sp) <> sign(sn) OR sp = 0 OR sn = 0 THEN 0e0 ELSE (3e0 * hn + 3e0 * hp) / ((2e0 * hn + hp) / sp + (hn + 2e0 * hp) / sn) END AS d FROM e),
 k AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(d) OVER w AS d1 FROM d WINDOW w AS (PARTITION BY unit_id ORDER BY x)), a AS (SELECT unit_id, qref AS q FROM unit CROSS JOIN request),
 m AS (SELECT a.unit_id, q, k.x, k.y, k.d, x1, y1, d1, x1 - x AS h, (q - x) / (x1 - x) AS t FROM a LEFT JOIN k ON a.unit_id = k.unit_id AND q >= x AND q < x1)
 SELECT unit_id, round(q, 6) AS q, round((1e0 + 2e0 * t) * pow(1e0 - t, 2) * y + t * pow(1e0 - t, 2) * h * d + t * t * (3e0 - 2e0 * t) * y1 + t * t * (t - 1e0) * h * d1, 6) AS h FROM m""")
def q_resample_pchip(spark, sf_dir):
    """Heads at each request's flow by the monotone cubic."""
    return _r(curves.resample_pchip_all(view(spark, sf_dir, "curve_pt"), _ask(spark, sf_dir), ["unit_id"], "q", "h"), "q", "h")


_SCALE = "least(1e0, greatest(0e0, 1e0 - (1e0 - eta) * pow(0.8e0, -0.1e0)))"


@query(f"SELECT unit_id, i, round(q * 0.8e0, 6) AS q, round(h * 0.8e0 * 0.8e0, 6) AS h, round(npsh * 0.8e0 * 0.8e0, 6) AS npsh, round(CASE WHEN eta = 0 THEN 0e0 ELSE {_SCALE} END, 6) AS eta FROM curve_pt")
def q_affinity_scale(spark, sf_dir):
    r = F.lit(0.8)
    rows = view(spark, sf_dir, "curve_pt").select("unit_id", "i", (F.col("q") * r).alias("q"), (F.col("h") * r * r).alias("h"), (F.col("npsh") * r * r).alias("npsh"), hy.scaled_efficiency(F.col("eta"), r).alias("eta"))
    return _r(rows, "q", "h", "npsh", "eta")


@query("""WITH s AS (SELECT *, 1e0 - base_speed * poles / (120e0 * base_freq) AS s FROM unit), r AS (SELECT *, (45e0 / base_freq) / (1e0 - s + 45e0 / base_freq * s) AS r FROM s)
 SELECT unit_id, round(s, 6) AS slip, round(r, 6) AS ratio, round(base_speed * r / (1e0 - s * r) * poles / 120e0, 6) AS frequency FROM r""")
def q_speed_frequency(spark, sf_dir):
    u = view(spark, sf_dir, "unit").withColumn("slip", hy.slip(F.col("poles"), F.col("base_freq"), F.col("base_speed")))
    u = u.withColumn("ratio", hy.ratio_of_frequency(F.lit(45.0), F.col("base_freq"), F.col("slip")))
    return _r(u.select("unit_id", "slip", "ratio", hy.frequency_of_ratio(F.col("ratio"), F.col("poles"), F.col("base_speed"), F.col("slip")).alias("frequency")), "slip", "ratio", "frequency")


@query("SELECT req_id, round(101325e0 / (9.80665e0 * 997.8e0) * pow(1e0 - 9.80665e0 * altitude / (1004.68506e0 * 293.15e0), 1004.68506e0 * 0.02896968e0 / 8.314462618e0), 6) AS head FROM request")
def q_atm_head(spark, sf_dir):
    return view(spark, sf_dir, "request").select("req_id", F.round(hy.atmospheric_head(F.col("altitude")), 6).alias("head"))


@query("""WITH v AS (SELECT req_id, qref / 1000e0 / (pi() * 0.15e0 * 0.15e0 / 4e0) AS v FROM request)
 SELECT req_id, round(v, 6) AS velocity, round(0.25e0 / pow(log10(0.26e-3 / (3.7e0 * 0.15e0) + 5.74e0 / pow(v * 0.15e0 / 1e-6, 0.9e0)), 2) / 0.15e0 * v * v / (2e0 * 9.80665e0) * 100e0, 6) AS loss FROM v""")
def q_head_loss(spark, sf_dir):
    v, loss = hy.head_loss(F.col("qref"), F.lit(0.15))
    return _r(view(spark, sf_dir, "request").select("req_id", v.alias("velocity"), loss.alias("loss")), "velocity", "loss")


#: The whole evaluation as SQL: crossing with the duty's parabola, scaled efficiency at the segment, state, reasons, score.
_EVAL = """WITH p AS (SELECT c.unit_id, req_id, q, eta, npsh, i, qref, h - href * pow(q / qref, 2) AS diff FROM curve_pt c CROSS JOIN request),
 s AS (SELECT *, lead(q) OVER w AS q1, lead(diff) OVER w AS d1, lead(eta) OVER w AS eta1, lead(npsh) OVER w AS npsh1 FROM p WINDOW w AS (PARTITION BY unit_id, req_id ORDER BY q)),
 x AS (SELECT *, q + (q1 - q) * (diff / (diff - d1)) AS qb, row_number() OVER (PARTITION BY unit_id, req_id ORDER BY q) AS rn FROM s WHERE q1 IS NOT NULL AND sign(diff) <> sign(d1)),
 f AS (SELECT unit.unit_id, request.req_id, request.qref AS duty, q, q1, diff, d1, eta, eta1, x.npsh, npsh1, qb, CASE WHEN qb IS NULL THEN 'unreachable' WHEN abs((diff - d1) / (q1 - q)) < 1e-14 THEN 'tangent' WHEN qb <= 0 THEN 'invalid_speed' END AS f0
   FROM unit CROSS JOIN request LEFT JOIN x ON x.unit_id = unit.unit_id AND x.req_id = request.req_id AND rn = 1),
 r AS (SELECT *, CASE WHEN f0 IS NULL THEN duty / qb END AS ratio, (qb - q) / (q1 - q) AS t FROM f),
 e AS (SELECT *, CASE WHEN eta = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, 1e0 - (1e0 - eta) * pow(ratio, -0.1e0))) END AS e0, CASE WHEN eta1 = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, 1e0 - (1e0 - eta1) * pow(ratio, -0.1e0))) END AS e1 FROM r),
 o AS (SELECT unit_id, req_id, f0, ratio AS ratio0, CASE WHEN ratio IS NOT NULL THEN e0 + (e1 - e0) * t END AS eta0, (npsh + (npsh1 - npsh) * t) * ratio * ratio AS npsh0 FROM e),
 w AS (SELECT o.*, maker, qbep, poles, base_freq, base_speed, motor_kw, motor_eff, request.qref, href, 1e0 - base_speed * poles / (120e0 * base_freq) AS slip,
   coalesce(f0, CASE WHEN 1e0 - (1e0 - base_speed * poles / (120e0 * base_freq)) * ratio0 <= 0 THEN 'invalid_speed' WHEN eta0 <= 0 THEN 'no_efficiency' END) AS failure,
   101325e0 / (9.80665e0 * 997.8e0) * pow(1e0 - 9.80665e0 * altitude / (1004.68506e0 * 293.15e0), 1004.68506e0 * 0.02896968e0 / 8.314462618e0) + (submergence_mm - axis_mm) * 1e-3 - loss - 0.26e0 AS npsh_avail
   FROM o JOIN unit USING (unit_id) JOIN request USING (req_id)),
 v AS (SELECT *, CASE WHEN failure IS NULL THEN ratio0 END AS ratio, CASE WHEN failure IS NULL THEN eta0 END AS eta_op, CASE WHEN failure IS NULL THEN npsh0 END AS npsh_req, CASE WHEN failure IS NULL THEN 1e-3 * qref * 0.9978e0 * 9.80665e0 * href / eta0 END AS power FROM w),
 st AS (SELECT *, base_speed * ratio / (1e0 - slip * ratio) * poles / 120e0 AS frequency, 1e0 - power / motor_kw AS margin, power / motor_eff AS electric, qref / (qbep * ratio) AS bep_ratio,
   CASE WHEN failure IS NOT NULL THEN NULL WHEN npsh_req IS NULL THEN 'not_available' WHEN npsh_avail - npsh_req >= 0.6e0 AND (npsh_req = 0 OR npsh_avail / npsh_req >= 1.25e0) THEN 'approved' ELSE 'rejected' END AS npsh_status FROM v),
 ev AS (SELECT *, CASE WHEN failure IS NOT NULL THEN failure ELSE concat_ws(';', CASE WHEN frequency < 30 THEN 'frequency_low' END, CASE WHEN frequency > 60 THEN 'frequency_high' END, CASE WHEN margin < 0.05e0 THEN 'motor_margin' END, CASE WHEN npsh_status = 'rejected' THEN 'npsh' END) END AS reasons,
   coalesce(electric * (1e0 + 0.02e0 * abs(bep_ratio - 1e0)), CAST('Infinity' AS DOUBLE)) AS score FROM st),
 rk AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY CASE WHEN reasons = '' THEN 0 ELSE 1 END, score, unit_id) AS rank FROM ev) """


def _states(spark, sf_dir, c=sel.Criteria()) -> DataFrame:
    return sel.operating_state(view(spark, sf_dir, "curve_pt"), view(spark, sf_dir, "unit"), view(spark, sf_dir, "request"), c)


def _evaluated(spark, sf_dir, c=sel.Criteria()) -> DataFrame:
    return sel.evaluate(_states(spark, sf_dir, c), c)


@query(_EVAL + "SELECT unit_id, req_id, round(ratio, 6) AS ratio, f0 AS failure FROM r")
def q_required_ratio(spark, sf_dir):
    return _r(sel.required_ratio(view(spark, sf_dir, "curve_pt"), view(spark, sf_dir, "request")).select("unit_id", "req_id", "ratio", "failure"), "ratio")


@query(_EVAL + "SELECT unit_id, req_id, failure, round(frequency, 5) AS frequency, round(eta_op, 6) AS eta_op, round(power, 5) AS power, round(margin, 5) AS margin, round(electric, 5) AS electric, round(bep_ratio, 6) AS bep_ratio FROM st")
def q_operating_state(spark, sf_dir):
    s = _r(_states(spark, sf_dir), "eta_op", "bep_ratio")
    return _r(s, "frequency", "power", "margin", "electric", digits=5).select("unit_id", "req_id", "failure", "frequency", "eta_op", "power", "margin", "electric", "bep_ratio")


_MODES = """SELECT unit_id * 10 + m AS ask_id, unit_id, CAST(qbep * (0.6e0 + 0.1e0 * (unit_id % 5)) AS DOUBLE) AS q, CASE WHEN m = 4 THEN hbep * 0.8e0 END AS head, CASE WHEN m IN (0, 2, 3, 5) THEN 45e0 END AS frequency,
 CASE WHEN m = 1 THEN base_speed * 0.9e0 WHEN m = 2 THEN base_speed * 0.5e0 END AS speed, CASE WHEN m = 5 THEN 0.4e0 * hbep / (qbep * qbep) END AS k, CASE WHEN m = 5 THEN 0.2e0 * hbep END AS hstat
 FROM unit CROSS JOIN (SELECT 0 AS m UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) AS modes"""


@query(f"""WITH a AS ({_MODES}), u AS (SELECT a.*, poles, base_freq, base_speed, motor_kw, motor_eff, 1e0 - base_speed * poles / (120e0 * base_freq) AS s FROM a JOIN unit USING (unit_id)),
 d AS (SELECT u.ask_id, c.q, h - u.head * pow(c.q / u.q, 2) AS diff, lead(c.q) OVER w AS q1, lead(h - u.head * pow(c.q / u.q, 2)) OVER w AS d1 FROM u JOIN curve_pt c USING (unit_id) WHERE u.head IS NOT NULL AND k IS NULL WINDOW w AS (PARTITION BY ask_id ORDER BY c.q)),
 b AS (SELECT ask_id, arg_min(q + (q1 - q) * (diff / (diff - d1)), q) AS qb FROM d WHERE q1 IS NOT NULL AND sign(diff) <> sign(d1) GROUP BY ask_id),
 f AS (SELECT u.*, qb, CASE WHEN u.head IS NOT NULL AND k IS NULL THEN u.q / qb WHEN k IS NULL AND speed IS NOT NULL THEN speed / base_speed ELSE (frequency / base_freq) / (1e0 - s + frequency / base_freq * s) END AS r FROM u LEFT JOIN b USING (ask_id)),
 p AS (SELECT f.ask_id, f.hstat, f.k, f.r, c.q * f.r AS q, c.h * f.r * f.r AS h, lead(c.q * f.r) OVER w AS q1, lead(c.h * f.r * f.r) OVER w AS h1 FROM f JOIN curve_pt c USING (unit_id) WHERE f.k IS NOT NULL WINDOW w AS (PARTITION BY ask_id ORDER BY c.q)),
 m AS (SELECT *, (h1 - h) / (q1 - q) AS m, hstat - (h - (h1 - h) / (q1 - q) * q) AS c FROM p WHERE q1 IS NOT NULL),
 x AS (SELECT ask_id, q, q1, unnest([(m - sqrt(m * m - 4e0 * k * c)) / (2e0 * k), (m + sqrt(m * m - 4e0 * k * c)) / (2e0 * k)]) AS x FROM m WHERE m * m - 4e0 * k * c >= 0),
 y AS (SELECT ask_id, min(round(x, 10)) AS qx FROM x WHERE x >= q - 1e-9 AND x <= q1 + 1e-9 GROUP BY ask_id),
 g AS (SELECT f.*, CASE WHEN k IS NOT NULL THEN qx ELSE f.q END AS qq, CASE WHEN f.head IS NOT NULL AND k IS NULL THEN qb WHEN k IS NOT NULL THEN qx / r ELSE f.q / r END AS base FROM f LEFT JOIN y USING (ask_id)),
 z AS (SELECT unit_id, q, h, eta, npsh, lead(q) OVER w AS q1, lead(h) OVER w AS h1, lead(eta) OVER w AS eta1, lead(npsh) OVER w AS npsh1 FROM curve_pt WINDOW w AS (PARTITION BY unit_id ORDER BY q)),
 j AS (SELECT g.*, z.q AS x0, z.q1 AS x1, z.h, z.h1, (base - z.q) / (z.q1 - z.q) AS t, CASE WHEN z.eta = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, 1e0 - (1e0 - z.eta) * pow(r, -0.1e0))) END AS e0, CASE WHEN z.eta1 = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, 1e0 - (1e0 - z.eta1) * pow(r, -0.1e0))) END AS e1 FROM g LEFT JOIN z ON g.unit_id = z.unit_id AND z.q1 IS NOT NULL AND base > z.q AND base <= z.q1),
 l AS (SELECT *, CASE WHEN k IS NOT NULL THEN hstat + k * qq * qq WHEN head IS NOT NULL THEN head ELSE (h + (h1 - h) * t) * r * r END AS hh, e0 + (e1 - e0) * t AS ee, base_speed * r / (1e0 - s * r) * poles / 120e0 AS derived FROM j),
 n AS (SELECT *, CASE WHEN head IS NOT NULL AND k IS NULL AND qb IS NULL THEN 'unreachable' WHEN head IS NULL AND k IS NULL AND speed IS NULL AND frequency IS NULL THEN 'nothing_given' WHEN k IS NULL AND head IS NULL AND speed IS NOT NULL AND frequency IS NOT NULL AND abs(frequency - derived) > 1e-6 * greatest(abs(frequency), abs(derived), 1e0) THEN 'inconsistent'
   WHEN k IS NOT NULL AND qq IS NULL THEN 'no_crossing' WHEN x0 IS NULL THEN 'outside' WHEN ee <= 0 THEN 'no_efficiency' END AS failure FROM l)
 SELECT ask_id, unit_id, failure, round(CASE WHEN failure IS NULL THEN qq END, 5) AS q, round(CASE WHEN failure IS NULL THEN hh END, 5) AS head, round(CASE WHEN failure IS NULL THEN r END, 6) AS ratio, round(CASE WHEN failure IS NULL THEN derived END, 4) AS frequency, round(CASE WHEN failure IS NULL THEN ee END, 6) AS eta,
 round(CASE WHEN failure IS NULL THEN 1e-3 * qq * 0.9978e0 * 9.80665e0 * hh / ee END, 5) AS power FROM n""")
def q_operating_modes(spark, sf_dir):
    """Operating points from a frequency, a speed, both, a head, a system, and nothing."""
    found = sel.set_points(view(spark, sf_dir, "curve_pt"), view(spark, sf_dir, "unit"), frame(spark, sf_dir, _MODES))
    rows = _r(found.select("ask_id", "unit_id", "failure", "q", "head", "ratio", "frequency", "eta", "power"), "ratio", "eta")
    return _r(_r(rows, "q", "head", "power", digits=5), "frequency", digits=4)


@query(_EVAL + "SELECT unit_id, req_id, npsh_status, round(npsh_req, 6) AS npsh_req, round(npsh_avail, 6) AS npsh_avail FROM st")
def q_npsh_status(spark, sf_dir):
    return _r(_evaluated(spark, sf_dir).select("unit_id", "req_id", "npsh_status", "npsh_req", "npsh_avail"), "npsh_req", "npsh_avail")


@query(_EVAL + "SELECT unit_id, req_id, reasons = '' AND coalesce(npsh_status, '') <> 'not_available' AS feasible FROM ev")
def q_npsh_policy(spark, sf_dir):
    return _evaluated(spark, sf_dir, sel.Criteria(missing_npsh="reject")).select("unit_id", "req_id", "feasible")


@query(_EVAL + "SELECT unit_id, req_id, reasons, CASE WHEN npsh_status = 'not_available' THEN 'npsh_not_verified' ELSE '' END AS warnings, reasons = '' AS feasible FROM ev")
def q_eval_reasons(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("unit_id", "req_id", F.array_join("reasons", ";").alias("reasons"), F.array_join("warnings", ";").alias("warnings"), "feasible")


@query(_EVAL + "SELECT req_id, unit_id, CAST(rank AS INT) AS rank, round(score, 5) AS score FROM rk")
def q_rank(spark, sf_dir):
    return _r(sel.rank(_evaluated(spark, sf_dir)).select("req_id", "unit_id", "rank", "score"), "score", digits=5)


@query(_EVAL + "SELECT req_id, unit_id, CAST(rank AS INT) AS rank, round(score, 5) AS score FROM rk WHERE reasons = '' AND rank <= 3")
def q_select_optimize(spark, sf_dir):
    return _r(sel.optimize(_evaluated(spark, sf_dir)).select("req_id", "unit_id", "rank", "score"), "score", digits=5)


_WANTED = "SELECT req_id, unit_id, (unit_id * 7) % 101 AS pos FROM request CROSS JOIN unit WHERE (unit_id + req_id) % 9 = 0"


@query(_EVAL + f", wanted AS ({_WANTED}), m AS (SELECT ev.*, row_number() OVER (PARTITION BY req_id ORDER BY pos, unit_id) AS rank FROM ev JOIN wanted USING (req_id, unit_id)) SELECT req_id, unit_id, CAST(rank AS INT) AS rank, reasons = '' AS feasible FROM m WHERE rank <= 3")
def q_select_manual(spark, sf_dir):
    wanted = _wanted(spark, sf_dir).withColumn("pos", F.struct("pos", "unit_id"))
    return sel.manual(_evaluated(spark, sf_dir), wanted).select("req_id", "unit_id", "rank", "feasible")


def _wanted(spark, sf_dir) -> DataFrame:
    rows = sel.paired(view(spark, sf_dir, "unit").select("unit_id"), view(spark, sf_dir, "request").select("req_id"), "req_id")
    return rows.where((F.col("unit_id") + F.col("req_id")) % 9 == 0).select("req_id", "unit_id", (F.col("unit_id") * 7 % 101).alias("pos"))


_LISTED = "SELECT CASE WHEN r.req_id % 50 = 0 THEN NULL ELSE r.req_id END AS req_id, s_suppkey AS unit_id FROM request r JOIN supplier ON s_suppkey % 20 = r.req_id % 20 UNION ALL SELECT req_id, req_id % 20 FROM request WHERE req_id % 7 = 0"


@query(f"WITH l AS ({_LISTED}), g AS (SELECT req_id, count(*) AS n, count(DISTINCT unit_id) AS d FROM l GROUP BY req_id) SELECT request.req_id, CASE WHEN n IS NULL THEN 'empty' ELSE 'duplicate' END AS problem FROM request LEFT JOIN g USING (req_id) WHERE n IS NULL OR n > d")
def q_manual_lists(spark, sf_dir):
    """Lists of ids that are empty or repeat one."""
    return val.manual_lists(view(spark, sf_dir, "request"), frame(spark, sf_dir, _LISTED))


_CELL = ", b AS (SELECT maker, href AS head, qref AS flow, unit_id, req_id, row_number() OVER (PARTITION BY maker, req_id ORDER BY score, unit_id) AS n FROM ev WHERE reasons = ''), ab AS (SELECT * FROM b WHERE n = 1)"
_NEAR = _CELL + ", duty AS (SELECT req_id, href + 0.3e0 AS h, qref * 1.1e0 AS q FROM request), nr AS (SELECT maker, duty.req_id, head, flow, unit_id, row_number() OVER (PARTITION BY maker, duty.req_id ORDER BY abs(head - h), head, abs(flow - q), flow, unit_id) AS k FROM ab CROSS JOIN duty)"


@query(_EVAL + _CELL + " SELECT maker, req_id, round(head, 6) AS head, round(flow, 6) AS flow, unit_id FROM ab")
def q_build_abacus(spark, sf_dir):
    return _r(sel.build_abacus(_evaluated(spark, sf_dir)).select("maker", "req_id", "head", "flow", "unit_id"), "head", "flow")


@query(_EVAL + _NEAR + " SELECT maker, req_id, round(head, 6) AS head, round(flow, 6) AS flow, unit_id FROM nr WHERE k = 1")
def q_abacus_nearest(spark, sf_dir):
    duty = view(spark, sf_dir, "request").select("req_id", (F.col("href") + 0.3).alias("href"), (F.col("qref") * 1.1).alias("qref"))
    return _r(sel.nearest(sel.build_abacus(_evaluated(spark, sf_dir)), duty).select("maker", "req_id", "head", "flow", "unit_id"), "head", "flow")


@query(_EVAL + _NEAR + ", cand AS (SELECT DISTINCT req_id, unit_id FROM nr WHERE k = 1), z AS (SELECT ev.req_id, ev.unit_id, score, row_number() OVER (PARTITION BY ev.req_id ORDER BY score, ev.unit_id) AS rank FROM ev JOIN cand USING (req_id, unit_id) WHERE reasons = '') SELECT req_id, unit_id, CAST(rank AS INT) AS rank, round(score, 5) AS score FROM z WHERE rank <= 3")
def q_select_abacus(spark, sf_dir):
    """One candidate of each maker from the abacus, then ranked."""
    evaluated = _evaluated(spark, sf_dir)
    duty = view(spark, sf_dir, "request").select("req_id", (F.col("href") + 0.3).alias("href"), (F.col("qref") * 1.1).alias("qref"))
    chosen = sel.nearest(sel.build_abacus(evaluated), duty).select("req_id", "unit_id").distinct()
    return _r(sel.optimize(evaluated.join(chosen, ["req_id", "unit_id"], "left_semi")).select("req_id", "unit_id", "rank", "score"), "score", digits=5)


@query("WITH m AS (SELECT unit_id, q, h, eta, row_number() OVER (PARTITION BY unit_id ORDER BY eta DESC, i) AS n FROM curve_pt) SELECT unit_id, round(q, 6) AS q, round(h, 6) AS h, round(eta, 6) AS eta FROM m WHERE n = 1")
def q_bep(spark, sf_dir):
    best = view(spark, sf_dir, "curve_pt").groupBy("unit_id").agg(F.max_by(F.struct("q", "h", "eta"), F.struct(F.col("eta"), -F.col("i"))).alias("b"))
    return _r(best.select("unit_id", "b.*"), "q", "h", "eta")


@query("SELECT curve, CAST(count(*) AS BIGINT) AS points, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM series GROUP BY curve")
def q_series_domain(spark, sf_dir):
    return _r(view(spark, sf_dir, "series").groupBy("curve").agg(F.count("*").alias("points"), F.min("x").alias("lo"), F.max("x").alias("hi")), "lo", "hi")


@query("""WITH s AS (SELECT curve, row_number() OVER w AS n, sign(y - lag(y) OVER w) AS s FROM series WINDOW w AS (PARTITION BY curve ORDER BY x)), f AS (SELECT *, max(CASE WHEN n = 2 THEN s END) OVER (PARTITION BY curve) AS s0 FROM s),
 o AS (SELECT curve, count(*) AS points, min(CASE WHEN n > 1 AND (s <> s0 OR s = 0) THEN n END) AS bad, max(s0) AS s0 FROM f GROUP BY curve)
 SELECT curve, CAST(points AS BIGINT) AS points, CAST(CASE WHEN bad IS NULL THEN coalesce(s0, 0) ELSE 0 END AS INT) AS direction, CAST(bad AS INT) AS offending FROM o""")
def q_series_monotone(spark, sf_dir):
    return curves.monotone(view(spark, sf_dir, "series"), ["curve"], "x", "y")


_DIMS = "SELECT vec_id, CAST(embedding[{0}] AS DOUBLE) * 100e0 AS px, CAST(embedding[{1}] AS DOUBLE) * 100e0 AS py FROM embeddings"


def _pixels(spark, sf_dir, log=False) -> tuple[DataFrame, dict]:
    rows = frame(spark, sf_dir, _DIMS.format(0, 1))
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    k = curves.affine([lit(10, 400, 1, 1), lit(600, 410, 1000, 1), lit(12, 20, 1, 100)], x_log=True, y_log=True) if log else curves.affine([lit(10, 400, 0, 0), lit(600, 410, 50, 0), lit(12, 20, 0, 30)])
    return rows, k


_AFF = """WITH p AS (""" + _DIMS.format(1, 2) + """), k AS (SELECT (600e0 - 10e0) * (20e0 - 400e0) - (12e0 - 10e0) * (410e0 - 400e0) AS det),
 c AS (SELECT (50e0 * (20e0 - 400e0)) / det AS a, (-(12e0 - 10e0) * 50e0) / det AS b, (-(30e0) * (410e0 - 400e0)) / det AS d, ((600e0 - 10e0) * 30e0) / det AS e FROM k),
 f AS (SELECT *, 0e0 - a * 10e0 - b * 400e0 AS cc, 0e0 - d * 10e0 - e * 400e0 AS ff FROM c) """


@query(_AFF + "SELECT vec_id, round(a * px + b * py + cc, 6) AS x, round(d * px + e * py + ff, 6) AS y FROM p CROSS JOIN f")
def q_affine_to_real(spark, sf_dir):
    rows, k = _pixels(spark, sf_dir)
    x, y = curves.to_real(F.col("px"), F.col("py"), k)
    return _r(rows.select("vec_id", x.alias("x"), y.alias("y")), "x", "y")


@query("WITH p AS (" + _DIMS.format(1, 2) + ") SELECT vec_id, round(px, 4) AS px, round(py, 4) AS py FROM p")
def q_affine_roundtrip(spark, sf_dir):
    """Pixels through logarithmic axes and back."""
    rows, k = _pixels(spark, sf_dir, log=True)
    x, y = curves.to_real(F.col("px"), F.col("py"), k, True, True)
    u, v = curves.to_pixel(F.col("x"), F.col("y"), k, True, True)
    return _r(rows.select("vec_id", x.alias("x"), y.alias("y")).select("vec_id", u.alias("px"), v.alias("py")), "px", "py", digits=4)


@query("""WITH c AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS x2 FROM embeddings)
 SELECT vec_id, abs((a) * (CASE WHEN vec_id % 5 = 0 THEN 0e0 ELSE b END) ) <= 1e-12 AS degenerate, x2 <= 0 AS log_invalid FROM c""")
def q_affine_lint(spark, sf_dir):
    """Calibrations from three points: degenerate ones, and those whose logarithmic axis has a value that is not positive."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = frame(spark, sf_dir, "SELECT * FROM embeddings")
    zero, one = F.lit(0.0), F.lit(1.0)
    k = curves.affine([(zero, zero, one, one), (e(0), zero, F.lit(10.0), one), (zero, F.when(F.col("vec_id") % 5 == 0, zero).otherwise(e(1)), e(2), F.lit(10.0))], x_log=True)
    return rows.select("vec_id", (F.abs(k["det"]) <= 1e-12).alias("degenerate"), (e(2) <= 0).alias("log_invalid"))


@query("SELECT unit_id, round(max(CASE WHEN i = 0 THEN h END), 6) AS h_first, round(max(CASE WHEN i = 30 THEN h END), 6) AS h_last, CAST(count(*) AS BIGINT) AS n, CAST(count(npsh) AS BIGINT) AS n_npsh FROM curve_pt GROUP BY unit_id")
def q_profile_export(spark, sf_dir):
    """The fixed headers of a profile pivoted from long series; a series without a mapping is all null."""
    from ..sources import profiles

    rows = view(spark, sf_dir, "curve_pt")
    long = rows.select("unit_id", "i", F.explode(F.create_map(F.lit("Q"), F.col("q"), F.lit("H"), F.col("h"), F.lit("NPSH"), F.col("npsh"))).alias("series", "value"))
    wide = profiles.table(long, ["unit_id", "i"], "series", "value", ["Q", "H", "Eta1", "NPSH"])
    out = wide.groupBy("unit_id").agg(F.max(F.when(F.col("i") == 0, F.col("H"))).alias("h_first"), F.max(F.when(F.col("i") == 30, F.col("H"))).alias("h_last"), F.count("*").alias("n"), F.count("NPSH").alias("n_npsh"))
    return _r(out, "h_first", "h_last")


@query("SELECT u.unit_id, n_name AS maker, CAST(count(*) AS BIGINT) AS points, round(max(h), 6) AS shutoff FROM curve_pt u JOIN supplier ON unit_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY u.unit_id, n_name")
def q_unit_join(spark, sf_dir):
    return _r(view(spark, sf_dir, "curve_pt").join(view(spark, sf_dir, "unit").select("unit_id", "maker"), "unit_id").groupBy("unit_id", "maker").agg(F.count("*").alias("points"), F.max("h").alias("shutoff")), "shutoff")


#: Suppliers as makers, each with the scales of one of the fixed three.
_MAKERS = "SELECT s_name AS maker, concat('S', CAST(s_suppkey AS VARCHAR(12))) AS prefix, CAST(s_suppkey % 3 AS INT) AS m FROM supplier"
_BANK = (
    f"WITH m AS ({_MAKERS}), z AS (SELECT unnest(range(7)) AS k), "
    + f"b AS (SELECT concat(prefix, '-00', k + 1) AS unit_id, maker, k, {pick('k', FLOWS)} * {pick('m', FLOW_SCALES)} AS qbep, {pick('k', HEADS)} * {pick('m', HEAD_SCALES)} AS hbep, least(0.86e0, {pick('k', ETAS)} + {pick('m', ETA_SHIFTS)}) AS etabep, {pick('m', ETA_SHIFTS)} AS shift FROM m CROSS JOIN z), "
    + f"u AS (SELECT *, {ladder('(1e-3 * qbep * 0.9978e0 * 9.80665e0 * hbep / etabep)')} AS motor_kw, round(least(0.95e0, 0.8e0 + (k + 1) * 0.018e0 + shift / 2e0), 4) AS motor_eff FROM b), "
    + "p AS (SELECT unit_id, round(qbep * (i * 0.05e0), 6) AS q, round(hbep * (1.35e0 - 0.35e0 * (i * 0.05e0) * (i * 0.05e0)), 6) AS h, etabep * greatest(0e0, 1e0 - (i * 0.05e0 - 1e0) * (i * 0.05e0 - 1e0)) AS eta FROM u CROSS JOIN (SELECT unnest(range(31)) AS i)) "
)


@query(_BANK + "SELECT u.unit_id, maker, round(motor_kw, 4) AS motor_kw, round(motor_eff, 3) AS motor_eff, CAST(count(*) AS BIGINT) AS points, round(sum(q), 3) AS q, round(sum(h), 3) AS h, round(max(eta), 6) AS eta FROM u JOIN p USING (unit_id) GROUP BY ALL")
def q_synth_bank(spark, sf_dir):
    """The bank generated for all suppliers: every unit's motor and curve. Units are dealt to all tasks before their points are made, and summed where they are."""
    u = bank.units(spark, frame(spark, sf_dir, _MAKERS)).withColumns({"motor_kw": F.round("motor_kw", 4), "motor_eff": F.round("motor_eff", 3)})
    dealt = u.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit_id")
    rows = bank.points(dealt, also=("maker", "motor_kw", "motor_eff")).groupBy("unit_id", "maker", "motor_kw", "motor_eff")
    return _r(_r(rows.agg(F.count("*").alias("points"), F.sum("q").alias("q"), F.sum("h").alias("h"), F.max("eta").alias("eta")), "q", "h", digits=3), "eta")


@query("SELECT DISTINCT maker FROM unit")
def q_manufacturers(spark, sf_dir):
    return view(spark, sf_dir, "unit").select("maker").distinct()


_LINT = "SELECT unit_id, i, CASE WHEN unit_id % 17 = 0 AND i = 4 THEN q - 1000e0 ELSE q END AS q, CASE WHEN unit_id % 19 = 0 AND i = 2 THEN 1.5e0 ELSE eta END AS eta, CASE WHEN unit_id % 23 = 0 AND i = 9 THEN -1e0 WHEN unit_id % 21 = 0 AND i = 5 THEN CAST('NaN' AS DOUBLE) WHEN unit_id % 22 = 0 AND i = 5 THEN NULL ELSE h END AS h FROM curve_pt WHERE NOT (unit_id % 29 = 0 AND i > 0)"


@query(f"WITH b AS ({_LINT}), d AS (SELECT *, lag(q) OVER (PARTITION BY unit_id ORDER BY i) AS qp FROM b) SELECT unit_id, concat_ws(';', CASE WHEN count(*) < 2 THEN 'too_short' END, CASE WHEN bool_or(q IS NULL OR h IS NULL OR isnan(h) OR eta IS NULL) THEN 'not_finite' END, CASE WHEN bool_or(coalesce(q <= qp, false)) THEN 'not_increasing' END, CASE WHEN bool_or(eta < 0 OR eta > 1) THEN 'eta_range' END, CASE WHEN bool_or(h < 0) THEN 'negative_head' END, CASE WHEN bool_or(q < 0) THEN 'negative_flow' END) AS problems FROM d GROUP BY unit_id")
def q_curve_lint(spark, sf_dir):
    return val.curve_points(frame(spark, sf_dir, _LINT)).select("unit_id", F.array_join("problems", ";").alias("problems"))
