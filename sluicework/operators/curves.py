"""Piecewise curves as long tables: crossings, interpolation, resampling and calibration.

A curve is the rows of its key columns, ordered by x. Consecutive points become segments by `lead`; nothing is
joined to itself, and every partition holds one curve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Requests, counted, that are sent to every task as they are; beyond, they are dealt to buckets of about so many.
SENT_REQUESTS = 20_000


def against(rows: DataFrame, requests: DataFrame, key: str, condition: Column, sent: int = SENT_REQUESTS) -> DataFrame:
    """The pairs of rows and requests that meet a condition. Rows stay where they are dealt while the requests are few enough to be sent to all tasks; else both meet in buckets of requests, whose number follows their count."""
    n = requests.count()
    if n <= sent:
        return rows.join(F.broadcast(requests), condition)
    buckets = -(-n // sent)
    left = rows.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    right = requests.withColumn("_of", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    return left.join(right, (F.col("_bucket") == F.col("_of")) & condition).drop("_bucket", "_of")


def segments(points: DataFrame, keys: Sequence[str], x: str, ys: Sequence[str]) -> DataFrame:
    """Each point with the next one's values as <name>1 and its index as seg; the last point's are null."""
    w = Window.partitionBy(*keys).orderBy(x)
    return points.select("*", *(F.lead(c).over(w).alias(f"{c}1") for c in (x, *ys)), F.row_number().over(w).alias("seg"))


def lerp(x: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Linear between two points; the knot's own value at a knot, null if an interior neighbour is null."""
    return F.when(x == x0, y0).when(x == x1, y1).otherwise(y0 + (y1 - y0) * ((x - x0) / (x1 - x0)))


def sign_changes(points: DataFrame, keys: Sequence[str], x: str, difference: str) -> DataFrame:
    """Segments over which the sign of a difference changes; a point on zero makes two."""
    seg = segments(points, keys, x, [difference])
    return seg.where(F.col(f"{x}1").isNotNull() & (F.signum(difference) != F.signum(f"{difference}1")))


def first_crossing(points: DataFrame, keys: Sequence[str], x: str, difference: str, ys: Sequence[str]) -> DataFrame:
    """Per curve: found, crossings, and x and ys at the first crossing, both sides taken linear within the segment."""
    seg = segments(points, keys, x, [difference, *ys])
    changes = F.col(f"{x}1").isNotNull() & (F.signum(difference) != F.signum(f"{difference}1"))
    d0, d1 = F.col(difference), F.col(f"{difference}1")
    at = F.col(x) + (F.col(f"{x}1") - F.col(x)) * (d0 / (d0 - d1))
    hit = F.when(changes, F.struct(F.col("seg").alias("seg"), at.alias("x"), *(lerp(at, F.col(x), F.col(f"{x}1"), F.col(y), F.col(f"{y}1")).alias(y) for y in ys)))
    out = seg.groupBy(*keys).agg(F.count_if(changes).alias("crossings"), F.min(hit).alias("hit"))
    return out.select(*keys, (F.col("crossings") > 0).alias("found"), "crossings", F.col("hit.x").alias(x), *(F.col(f"hit.{y}").alias(y) for y in ys))


def held(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with columns that are computed once: neither projections nor filters are merged across a generator, so that a costly expression is not copied to each place that reads it."""
    made = F.struct(*(v.alias(k) for k, v in values.items()))
    out = rows.select("*", F.explode(F.array(made)).alias("_held"))
    return out.select(*(c for c in rows.columns if c not in values), *(F.col(f"_held.{k}").alias(k) for k in values))


def system_head(q: Column, static: Column, k: Column) -> Column:
    return static + k * q * q


def exact_roots(segs: Column, static: Column, k: Column, tolerance: float = 1e-9) -> Column:
    """The distinct flows (ten places, in order) at which a curve's segments (array of struct<a, b>, points with q and h) meet static + k q^2, each within a tolerance of its segment.

    Few segments can hold a root: those over which the difference changes its sign, or turns. Only they are solved; of a quadratic's
    roots the larger in size comes from the sum that loses no digits, the other from their product.
    """
    slope = lambda s: (s["b"]["h"] - s["a"]["h"]) / (s["b"]["q"] - s["a"]["q"])

    def near(s: Column) -> Column:
        lo, hi = s["a"]["q"] - tolerance, s["b"]["q"] + tolerance
        m = slope(s)
        away = lambda q: F.signum(static + k * q * q - s["a"]["h"] - m * (q - s["a"]["q"]))
        return (away(lo) * away(hi) <= 0) | (m >= 2 * k * lo) & (m <= 2 * k * hi)

    def of(s: Column) -> Column:
        m = slope(s)
        c = static - (s["a"]["h"] - m * s["a"]["q"])
        disc = m * m - 4 * k * c
        w = F.when(disc >= 0, (m + F.when(m < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(disc, F.lit(0.0)))) / 2)
        found = F.when(F.abs(k) < 1e-14, F.array(F.when(F.abs(m) >= 1e-14, c / m))).otherwise(F.array(w / F.when(F.abs(k) >= 1e-14, k), c / F.when(w != 0, w)))
        return F.filter(found, lambda r: (r >= s["a"]["q"] - tolerance) & (r <= s["b"]["q"] + tolerance))

    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(F.filter(segs, near), of)), lambda r: F.round(r, 10))))


def segment_at(segs: Column, q: Column) -> Column:
    """The segment that holds a flow; the last one beyond the curve's end."""
    return F.when(q.isNotNull(), F.coalesce(F.get(F.filter(segs, lambda s: q <= s["b"]["q"]), F.lit(0)), F.get(segs, F.size(segs) - 1)))


def exact_crossings(pairs: DataFrame, static: str, k: str) -> DataFrame:
    """pairs (with pts and segs) and: found, crossings, q (the least), head (the system's), eta, npsh, note."""
    rows = held(pairs, _roots=exact_roots(F.col("segs"), F.col(static), F.col(k)))
    rows = held(rows, q=F.get("_roots", F.lit(0)), _n=F.coalesce(F.size("_roots"), F.lit(0)))
    rows = held(rows, _s=segment_at(F.col("segs"), F.col("q")))
    x = F.least(F.greatest("q", "_s.a.q"), "_s.b.q")
    value = lambda y: lerp(x, F.col("_s.a.q"), F.col("_s.b.q"), F.col(f"_s.a.{y}"), F.col(f"_s.b.{y}"))
    n = F.greatest(F.col("_n"), F.lit(0))
    note = F.when(n == 0, "no crossing within the curve").when(n > 1, F.concat(n.cast("string"), F.lit(" crossings; the one with the least flow"))).otherwise("")
    more = {"found": n > 0, "crossings": n.cast("long"), "head": system_head(F.col("q"), F.col(static), F.col(k)), "eta": value("eta"), "npsh": value("npsh"), "note": note}
    return held(rows, **more).drop("_roots", "_n", "_s", "pts", "segs")


def _enclosed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, query, lo, hi): each query with the last point at or before it and the first at or after. rows: keys, at, p (points), query.

    Both frames grow from an end: one that reached from a row to the curve's end would be gone through anew for each row.
    """
    back, ahead = (Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, 0) for at in (F.asc("at"), F.desc("at")))
    return rows.select(*keys, "query", F.last("p", ignorenulls=True).over(back).alias("lo"), F.last("p", ignorenulls=True).over(ahead).alias("hi")).where("query is not null")


def interpolate(points: DataFrame, queries: DataFrame, keys: Sequence[str], x: str, ys: Sequence[str], outside: str = "null") -> DataFrame:
    """ys at each query's x. outside: `null`, `clamp` to the end's value, or `flag` (null, with an `outside` column).

    Points and queries are merged in one sort per curve; the segment that holds a query is the last point at or before it and the first at
    or after, so that no range join is needed.
    """
    tagged = points.select(*keys, F.col(x).alias("at"), F.struct(F.col(x).alias("x"), *(F.col(y).alias(y) for y in ys)).alias("p"), F.lit(None).cast("double").alias("query"))
    asked = queries.select(*keys, F.col(x).alias("at"), F.lit(None).cast(tagged.schema["p"].dataType).alias("p"), F.col(x).alias("query"))
    both = _enclosed(tagged.unionByName(asked), keys)
    q = F.col("query")

    def value(y: str) -> Column:
        inner = lerp(q, F.col("lo.x"), F.col("hi.x"), F.col(f"lo.{y}"), F.col(f"hi.{y}"))
        known = F.when(F.col("lo.x").isNotNull() & F.col("hi.x").isNotNull(), inner)
        return F.when(F.col("lo.x").isNull(), F.col(f"hi.{y}")).when(F.col("hi.x").isNull(), F.col(f"lo.{y}")).otherwise(known) if outside == "clamp" else known

    flag = [(F.col("lo.x").isNull() | F.col("hi.x").isNull()).alias("outside")] if outside == "flag" else []
    return both.select(*keys, q.alias(x), *(value(y).alias(y) for y in ys), *flag)


def pchip_slopes(points: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Points with monotone slopes `d`: weighted harmonic means inside, one-sided three-point formulas at the ends."""
    w = Window.partitionBy(*keys).orderBy("x")
    at = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    rows = points.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    for name, k in (("p2", -2), ("p1", -1), ("n1", 1), ("n2", 2)):
        rows = rows.withColumns({f"x_{name}": at("x", k), f"y_{name}": at("y", k)})
    c = F.col
    hp, hn, hp2, hn2 = c("x") - c("x_p1"), c("x_n1") - c("x"), c("x_p1") - c("x_p2"), c("x_n2") - c("x_n1")
    sp, sn, sp2, sn2 = (c("y") - c("y_p1")) / hp, (c("y_n1") - c("y")) / hn, (c("y_p1") - c("y_p2")) / hp2, (c("y_n2") - c("y_n1")) / hn2

    def end(h0: Column, h1: Column, s0: Column, s1: Column) -> Column:
        d = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        return F.when(s1.isNull(), s0).when(F.signum(d) != F.signum(s0), F.lit(0.0)).when((F.signum(s0) != F.signum(s1)) & (F.abs(d) > 3 * F.abs(s0)), 3 * s0).otherwise(d)

    w1, w2 = 2 * hn + hp, hn + 2 * hp
    inner = F.when((F.signum(sp) != F.signum(sn)) | (sp == 0) | (sn == 0), F.lit(0.0)).otherwise((w1 + w2) / (w1 / sp + w2 / sn))
    slope = F.when(sp.isNull() & sn.isNull(), F.lit(None).cast("double")).when(sp.isNull(), end(hn, hn2, sn, sn2)).when(sn.isNull(), end(hp, hp2, sp, sp2)).otherwise(inner)
    return rows.select(*keys, c("x").alias(x), c("y").alias(y), slope.alias("d"))


def _hermite(q: Column, x0: Column, x1: Column, y0: Column, y1: Column, d0: Column, d1: Column) -> Column:
    h = x1 - x0
    t = (q - x0) / h
    return (1 + 2 * t) * F.pow(1 - t, F.lit(2.0)) * y0 + t * F.pow(1 - t, F.lit(2.0)) * h * d0 + t * t * (3 - 2 * t) * y1 + t * t * (t - 1) * h * d1


def resample_pchip(points: DataFrame, queries: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """y at each query's x by the monotone cubic; null outside."""
    knots = pchip_slopes(points, keys, x, y)
    tagged = knots.select(*keys, F.col(x).alias("at"), F.struct(F.col(x).alias("x"), F.col(y).alias("y"), "d").alias("p"), F.lit(None).cast("double").alias("query"))
    asked = queries.select(*keys, F.col(x).alias("at"), F.lit(None).cast(tagged.schema["p"].dataType).alias("p"), F.col(x).alias("query"))
    both = _enclosed(tagged.unionByName(asked), keys)
    hermite = _hermite(F.col("query"), *(F.col(n) for n in ("lo.x", "hi.x", "lo.y", "hi.y", "lo.d", "hi.d")))
    return both.select(*keys, F.col("query").alias(x), F.when(F.col("hi.x") == F.col("lo.x"), F.col("lo.y")).otherwise(hermite).alias(y))


def _over_all(points: DataFrame, asked: DataFrame, keys: Sequence[str], x: str, ys: Sequence[str], sent: int) -> DataFrame:
    """(keys, query, first, x, ys, x1, ys1): each curve's segment for each asked x, the last one open and the first one for what lies before it too; x1 is null at the last point.

    Segments are rows, where points are dealt, and meet the asked values there: nothing is sorted or shuffled by pair.
    """
    c = F.col
    segs = segments(points.select(*keys, x, *ys), keys, x, ys)
    query = asked.where(c(x).isNotNull()).select(c(x).alias("query"))
    return against(segs, query, "query", ((c("seg") == 1) | (c("query") >= c(x))) & (c(f"{x}1").isNull() | (c("query") < c(f"{x}1"))), sent)


def _dealt(points: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Points with an x, dealt by curve to a stated number of tasks: they are few, and what is made of them is not."""
    return points.where(F.col(x).isNotNull()).repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def interpolate_all(points: DataFrame, asked: DataFrame, keys: Sequence[str], x: str, ys: Sequence[str], outside: str = "null", sent: int = SENT_REQUESTS) -> DataFrame:
    """ys of every curve at every x of `asked` (x), as `interpolate` gives them for these pairs."""
    rows = _over_all(_dealt(points, keys, x), asked, keys, x, ys, sent)
    q, x0, x1 = F.col("query"), F.col(x), F.col(f"{x}1")
    before, beyond = q < x0, x1.isNull() & (q > x0)

    def value(y: str) -> Column:
        y0, y1 = F.col(y), F.col(f"{y}1")
        end = y0 if outside == "clamp" else F.lit(None).cast("double")
        return F.when(before | beyond, end).when(x1.isNull(), y0).otherwise(lerp(q, x0, x1, y0, y1))

    flag = [(before | beyond).alias("outside")] if outside == "flag" else []
    return rows.select(*keys, q.alias(x), *(value(y).alias(y) for y in ys), *flag)


def resample_pchip_all(points: DataFrame, asked: DataFrame, keys: Sequence[str], x: str, y: str, sent: int = SENT_REQUESTS) -> DataFrame:
    """y of every curve at every x of `asked` (x) by the monotone cubic, as `resample_pchip` gives it for these pairs."""
    rows = _over_all(pchip_slopes(_dealt(points, keys, x), keys, x, y), asked, keys, x, [y, "d"], sent)
    q, x0, x1, y0 = F.col("query"), F.col(x), F.col(f"{x}1"), F.col(y)
    return rows.select(*keys, q.alias(x), F.when(q == x0, y0).when((q > x0) & x1.isNotNull(), _hermite(q, x0, x1, y0, F.col(f"{y}1"), F.col("d"), F.col("d1"))).alias(y))


def grid(bounds: DataFrame, keys: Sequence[str], low: str, high: str, count: int, x: str) -> DataFrame:
    """`count` evenly spaced x from low to high of each row."""
    step = (F.col(high) - F.col(low)) / (count - 1)
    return bounds.select(*keys, F.col(low).alias("_low"), step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i")).select(*keys, "i", (F.col("_low") + F.col("i") * F.col("_step")).alias(x))


def common_table(points: DataFrame, main: str, names: Sequence[str], count: int | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """(x, one column for each name): every curve at the main curve's x, or at so many evenly spaced over its domain; null where a curve does not reach. points: curve, x, y.

    The columns are named beforehand, so that no scan looks for them. The grid is one curve's, and copied to the others by name.
    """
    if main not in names:
        raise ValueError(f"no main curve {main!r}")
    if count is not None and count < 2:
        raise ValueError("a grid has two points or more")
    own = points.where(F.col("curve") == main)
    at = own.select(F.col(x).alias("x")) if count is None else grid(own.agg(F.min(x).alias("lo"), F.max(x).alias("hi")), [], "lo", "hi", count, "x").select("x")
    asked = at.select(F.explode(F.array(*map(F.lit, names))).alias("curve"), "x")
    rows = interpolate(points.select("curve", F.col(x).alias("x"), F.col(y).alias("y")), asked, ["curve"], "x", ["y"])
    return rows.groupBy("x").agg(*(F.max(F.when(F.col("curve") == n, F.col("y"))).alias(n) for n in names))


def incomplete(table: DataFrame, names: Sequence[str]) -> DataFrame:
    """(rows, columns): how many rows of a common table lack a value, and which columns do."""
    lacks = {n: F.col(f"`{n}`").isNull() for n in names}
    some = F.array_contains(F.array(*lacks.values()), True)
    made = table.agg(F.count_if(some).alias("rows"), *(F.bool_or(v).alias(f"_{i}") for i, v in enumerate(lacks.values())))
    return made.select("rows", F.array_compact(F.array(*(F.when(F.col(f"_{i}"), F.lit(n)) for i, n in enumerate(lacks)))).alias("columns"))


def monotone(points: DataFrame, keys: Sequence[str], order: str, x: str) -> DataFrame:
    """Per series: points, direction (1, -1, or 0 if not strict), and the first offending point, from 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.signum(F.col(x) - F.lag(x).over(w))
    rows = points.select(*keys, F.row_number().over(w).alias("n"), step.alias("s")).withColumn("s0", F.max(F.when(F.col("n") == 2, F.col("s"))).over(Window.partitionBy(*keys)))
    wrong = (F.col("n") > 1) & ((F.col("s") != F.col("s0")) | (F.col("s") == 0))
    return rows.groupBy(*keys).agg(F.count("*").alias("points"), F.min(F.when(wrong, F.col("n"))).alias("offending"), F.max("s0").alias("s0")).select(*keys, "points", F.when(F.col("offending").isNull(), F.coalesce(F.col("s0"), F.lit(0.0))).otherwise(0.0).cast("int").alias("direction"), "offending")


def affine(points: Sequence[tuple[Column, Column, Column, Column]], x_log: bool = False, y_log: bool = False) -> dict[str, Column]:
    """Coefficients a..f of X = a px + b py + c, Y = d px + e py + f from three (px, py, vx, vy), and their determinant; null if degenerate."""
    (p0, q0, u0, v0), (p1, q1, u1, v1), (p2, q2, u2, v2) = points
    if x_log:
        u0, u1, u2 = (F.when(u > 0, F.log10(u)) for u in (u0, u1, u2))
    if y_log:
        v0, v1, v2 = (F.when(v > 0, F.log10(v)) for v in (v0, v1, v2))
    det = (p1 - p0) * (q2 - q0) - (p2 - p0) * (q1 - q0)
    safe = F.when(F.abs(det) > 1e-12, det)

    def solve(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
        m = ((b - a) * (q2 - q0) - (c - a) * (q1 - q0)) / safe
        n = ((p1 - p0) * (c - a) - (p2 - p0) * (b - a)) / safe
        return m, n, a - m * p0 - n * q0

    (a, b, c), (d, e, f) = solve(u0, u1, u2), solve(v0, v1, v2)
    return {"a": a, "b": b, "c": c, "d": d, "e": e, "f": f, "det": det}


def to_real(px: Column, py: Column, k: dict[str, Column], x_log: bool = False, y_log: bool = False) -> tuple[Column, Column]:
    u, v = k["a"] * px + k["b"] * py + k["c"], k["d"] * px + k["e"] * py + k["f"]
    return F.pow(F.lit(10.0), u) if x_log else u, F.pow(F.lit(10.0), v) if y_log else v


def to_pixel(vx: Column, vy: Column, k: dict[str, Column], x_log: bool = False, y_log: bool = False) -> tuple[Column, Column]:
    u, v = (F.log10(vx) if x_log else vx) - k["c"], (F.log10(vy) if y_log else vy) - k["f"]
    det = k["a"] * k["e"] - k["b"] * k["d"]
    return (u * k["e"] - k["b"] * v) / det, (k["a"] * v - k["d"] * u) / det
