"""Checks of tables: every fault of a row or group is reported at once, by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Routes, extras and modes that may be named (fixed values).
ROUTES, EXTRAS, MODES = ("A", "B", "C", "D", "E"), ("F", "G"), ("manual", "abacus", "optimize")


def faults(tests: dict[str, Column]) -> Column:
    """Names of the tests that hold, in order; a null is no fault."""
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(key, n): values that occur more than once."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def one_sided(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """(key, side): values that only one side has, by one full outer join."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer").where("_a is null or _b is null")
    return both.select(key, F.when(F.col("_b").isNull(), left_name).otherwise(right_name).alias("side"))


def subset(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """Values of rows that the other table lacks; none if rows are a subset."""
    return rows.select(key).distinct().join(of.select(key).distinct(), key, "left_anti")


def first_of(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, value): of each key the value that comes first."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def distinct_in_order(items: Column) -> Column:
    """An array's values, each where it stands first."""
    return F.array_distinct(items)


def shared(a: Column, b: Column) -> Column:
    """What two arrays have in common whatever the case, in order of letters."""
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    return F.array_sort(F.array_intersect(low(a), low(b)))


def metadata(units: DataFrame) -> DataFrame:
    """(unit_id, problems): domains of a unit's data. A number that must be there and is null or not finite is a fault; what may be absent is not."""
    c = F.col
    absent = lambda n: c(n).isNull() | F.isnan(c(n).cast("double"))
    tests = {
        "poles": absent("poles") | (c("poles") <= 0) | (c("poles") % 2 != 0),
        "frequency": absent("base_freq") | (c("base_freq") <= 0),
        "speed": absent("base_speed") | (c("base_speed") <= 0) | (c("base_speed") >= 120 * c("base_freq") / c("poles")),
        "efficiency": absent("motor_eff") | (c("motor_eff") <= 0) | (c("motor_eff") > 1),
        "power": absent("motor_kw") | (c("motor_kw") <= 0),
        "flow": absent("qbep") | (c("qbep") <= 0),
        "npsh": c("npsh_bep") < 0,
    }
    return units.select("unit_id", faults(tests).alias("problems"))


def curve_points(points: DataFrame, order: str = "i") -> DataFrame:
    """(unit_id, problems): what is wrong with each curve. points: unit_id, an order, q, h, eta, npsh."""
    before = F.lag("q").over(Window.partitionBy("unit_id").orderBy(order))
    finite = lambda n: F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(F.col(n)) < float("inf"))
    rows = points.withColumn("_before", before)
    some = lambda t: F.coalesce(F.bool_or(t), F.lit(False))
    made = rows.groupBy("unit_id").agg(
        F.count("*").alias("n"), some(F.col("q") <= F.col("_before")).alias("order"), some((F.col("eta") < 0) | (F.col("eta") > 1)).alias("eta"), some(F.col("h") < 0).alias("head"), some(F.col("q") < 0).alias("flow"),
        some(~(finite("q") & finite("h") & finite("eta"))).alias("finite"),
    )
    c = F.col
    return made.select("unit_id", faults({"too_short": c("n") < 2, "not_finite": c("finite"), "not_increasing": c("order"), "eta_range": c("eta"), "negative_head": c("head"), "negative_flow": c("flow")}).alias("problems"))


def overrides(rows: DataFrame) -> DataFrame:
    """(id, problems): curated decisions whose route, extras or languages are none. rows: id, route, extras (array), language (array)."""
    wrong = lambda c, known: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: ~x.isin(*known))
    tests = {
        "extra": wrong(F.col("extras"), EXTRAS),
        "language": F.exists(F.coalesce("language", F.array().cast("array<string>")), lambda x: ~F.regexp_like(x, F.lit("^[a-z]{3}$"))),
        "route": ~F.coalesce(F.col("route"), F.lit("")).isin("", *ROUTES),
    }
    return rows.select("id", faults(tests).alias("problems"))


def catalogue(rows: DataFrame, required: Sequence[str], code: str, client: str, family: str, shared: Sequence[str]) -> DataFrame:
    """(problem, field, key): blank required fields, repeated codes, illegal families, and what differs within a family. rows: strings, and `line`.

    What differs is counted for all shared fields in one aggregation, not one for each.
    """
    text = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in {*required, code, client, family, *shared}}
    clean = rows.select("line", *(v.alias(k) for k, v in text.items()))
    blank = clean.select("line", F.explode(F.array_compact(F.array(*(F.when(F.col(c) == "", F.lit(c)) for c in required)))).alias("field")).select(F.lit("blank").alias("problem"), "field", F.col("line").cast("string").alias("key"))
    twice = [clean.where(F.col(c) != "").groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("problem"), F.lit(c).alias("field"), "key") for c in (code, client)]
    by_family = clean.groupBy(F.col(family).alias("key")).agg(*(F.min(c).alias(f"{c}_lo") for c in shared), *(F.max(c).alias(f"{c}_hi") for c in shared))
    differs = by_family.select("key", F.explode(F.array_compact(F.array(*(F.when(F.col(f"{c}_lo") != F.col(f"{c}_hi"), F.lit(c)) for c in shared)))).alias("field")).select(F.lit("inconsistent").alias("problem"), "field", "key")
    illegal = by_family.where(~F.regexp_like("key", F.lit("^[A-Za-z0-9][A-Za-z0-9_-]*$"))).select(F.lit("illegal").alias("problem"), F.lit(family).alias("field"), "key")
    return blank.unionByName(twice[0]).unionByName(twice[1]).unionByName(differs).unionByName(illegal)


def quantities(cells: DataFrame) -> DataFrame:
    """(problem, field, key): quantities that are no filled numeric cell, not finite or negative, and codes that are blank or repeat. cells: line, code, kind (n: a number), value."""
    code = F.trim(F.coalesce(F.col("code").cast("string"), F.lit("")))
    n = F.expr("try_cast(value AS DOUBLE)")
    numeric = (F.col("kind") == "n") & n.isNotNull()
    infinite = F.isnan(n) | (F.abs(n) == float("inf"))
    tests = {"blank": code == "", "not_numeric": ~F.coalesce(numeric, F.lit(False)), "not_finite": numeric & infinite, "negative": numeric & ~infinite & (n < 0)}
    each = cells.select(code.alias("code"), F.col("line").cast("string").alias("line"), F.explode(faults(tests)).alias("problem"))
    single = each.select("problem", F.lit("quantity").alias("field"), F.when(F.col("problem") == "blank", F.col("line")).otherwise(F.col("code")).alias("key"))
    twice = cells.where(code != "").groupBy(code.alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("problem"), F.lit("quantity").alias("field"), "key")
    return single.unionByName(twice)


# --- cases ------------------------------------------------------------------------------------------

#: Columns of a case's sheet that may be empty, and what they are then (fixed values).
CASE_DEFAULTS = {"temperature": 20.0, "suction_loss": 0.0, "vapor_head": 0.26, "top_n": 3.0}


def cases(rows: DataFrame) -> DataFrame:
    """rows with defaults, modes in lower case and lists of ids; `problem` names a mode that is none. rows: name, mode, ids (joined by semicolons) and numbers."""
    filled = {c: F.coalesce(F.expr(f"try_cast(`{c}` AS DOUBLE)"), F.lit(v)) for c, v in CASE_DEFAULTS.items() if c in rows.columns}
    mode = F.lower(F.trim("mode"))
    ids = F.filter(F.transform(F.split(F.coalesce("ids", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumns({**filled, "mode": mode, "ids": ids, "problem": F.when(~F.coalesce(mode.isin(*MODES), F.lit(False)), F.lit("mode"))})


def pick_cases(rows: DataFrame, wanted: int | str | None, order: str = "line", name: str = "name") -> DataFrame:
    """All cases, the one at a place (from 1, in order), or the one with a name; none is an error. Places are found by a top-k, not a window over all."""
    if wanted is None:
        return rows
    if isinstance(wanted, str):
        found = rows.where(F.col(name) == wanted)
    elif wanted < 1:
        raise ValueError("places of cases begin at 1")
    else:
        first = rows.orderBy(order).limit(wanted)
        found = first.orderBy(F.desc(order)).limit(1) if first.count() == wanted else rows.where("false")
    if found.isEmpty():
        raise ValueError(f"no case {wanted!r}")
    return found


def manual_lists(requests: DataFrame, wanted: DataFrame) -> DataFrame:
    """(req_id, problem): requests without any id, or with one listed twice."""
    n = wanted.groupBy("req_id").agg(F.count("*").alias("n"), F.count_distinct("unit_id").alias("d"))
    rows = requests.select("req_id").join(n, "req_id", "left")
    return rows.select("req_id", F.when(F.col("n").isNull(), "empty").when(F.col("n") > F.col("d"), "duplicate").alias("problem")).where("problem is not null")
