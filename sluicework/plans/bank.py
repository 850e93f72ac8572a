"""The synthetic bank of units: makers (three fixed ones, or those of a table) by seven sizes, each a curve of 31 points, generated by formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import ETA_SHIFTS, ETAS, FLOW_SCALES, FLOWS, HEAD_SCALES, HEADS, SPEED_SHIFTS, ladder, pick

#: Makers in order, and the units that have no cavitation data (fixed values).
MAKERS = (("AquaNova", "AN"), ("HidroVale", "HV"), ("Fluxora", "FX"))
WITHOUT_NPSH = ("AN-002", "FX-006")


def makers(spark: SparkSession) -> DataFrame:
    """(maker, prefix, m) of the three fixed makers; m picks a maker's scales."""
    return spark.createDataFrame([(name, prefix, m) for m, (name, prefix) in enumerate(MAKERS)], "maker string, prefix string, m int")


def units(spark: SparkSession, of: DataFrame | None = None) -> DataFrame:
    """One row for each unit, in the columns that the selection takes: seven sizes of each maker of `of` (maker, prefix, m), the three fixed ones if none are given."""
    sized = (makers(spark) if of is None else of).select("maker", "prefix", "m", F.explode(F.sequence(F.lit(1), F.lit(len(FLOWS)))).alias("size"))
    value = lambda by_size, by_maker, op: F.expr(f"({pick('size - 1', by_size)}) {op} ({pick('m', by_maker)})")
    base = sized.select(
        F.concat("prefix", F.lit("-"), F.lpad(F.col("size").cast("string"), 3, "0")).alias("unit_id"), "maker", "size", value(FLOWS, FLOW_SCALES, "*").alias("qbep"), value(HEADS, HEAD_SCALES, "*").alias("hbep"),
        F.least(F.lit(0.86), value(ETAS, ETA_SHIFTS, "+")).alias("etabep"), F.expr(pick("m", ETA_SHIFTS)).alias("eta_shift"), F.expr(pick("m", SPEED_SHIFTS)).alias("speed_shift"),
    )
    poles = F.when(F.col("size") <= 2, 2).otherwise(4)
    power = "(1e-3 * qbep * 0.9978e0 * 9.80665e0 * hbep / etabep)"
    return base.select(
        "unit_id", "maker", "size", "qbep", "hbep", "etabep", poles.alias("poles"), F.lit(60.0).alias("base_freq"),
        (F.when(F.col("size") <= 2, 3600 - 95).otherwise(1800 - 45) + F.col("speed_shift")).alias("base_speed"),
        F.round(F.least(F.lit(0.95), 0.80 + F.col("size") * 0.018 + F.col("eta_shift") / 2), 4).alias("motor_eff"),
        F.expr(ladder(power)).alias("motor_kw"),
        F.round(210 + F.col("qbep") * 2.1 + F.col("size") * 5, 1).alias("submergence_mm"), F.round(145 + F.col("qbep") * 0.7, 1).alias("axis_mm"),
    )


def points(units_: DataFrame, steps: int = 31, also: tuple[str, ...] = ()) -> DataFrame:
    """(unit_id, i, q, h, eta, npsh) of each unit, and those of its columns that are named, so that no join brings them back."""
    x = F.col("i") * 0.05
    rows = units_.select("unit_id", *also, "qbep", "hbep", "etabep", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    npsh = F.when(~F.col("unit_id").isin(*WITHOUT_NPSH), F.round(0.35 + 0.75 * x + 1.10 * x * x, 6))
    return rows.select("unit_id", *also, "i", F.round(F.col("qbep") * x, 6).alias("q"), F.round(F.col("hbep") * (1.35 - 0.35 * x * x), 6).alias("h"), F.round(F.col("etabep") * F.greatest(F.lit(0.0), 1 - (x - 1) * (x - 1)), 9).alias("eta"), npsh.alias("npsh"))


def abacus(units_: DataFrame, pts: DataFrame, criteria, flows=(3, 5, 8, 12, 20, 35, 60, 90), heads=(40, 35, 30, 25, 20, 15, 10)) -> DataFrame:
    """The best feasible unit of each maker in each cell of a grid of duties."""
    from ..operators import selection

    spark = units_.sparkSession
    cells = spark.createDataFrame([(r * 100 + c, float(q), float(h), 0.2 * h, 0.0, 0.0) for r, h in enumerate(heads) for c, q in enumerate(flows)], "req_id int, qref double, href double, hstat double, altitude double, loss double")
    return selection.build_abacus(selection.evaluate(selection.operating_state(pts, units_, cells, criteria), criteria))
