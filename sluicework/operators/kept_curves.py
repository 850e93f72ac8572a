"""Curves of other frequencies, made once and kept: a table bucketed by unit and frequency, to which turns add curves and from which they are taken away.

    store = kept_curves.create(spark, "curves", folder, points, units)
    kept_curves.at(store, asked, 1)             # makes what is not kept: (unit_id, frequency)
    kept_curves.remove(store, unwanted, 2)      # the curve of the base frequency is refused
    kept_curves.current(store)

A turn is a number that the caller counts up; each turn is a partition, so that a turn that runs again after a crash writes the same rows in the same
place. A curve counts if it was made after the last turn that removed it. Curves and removals have the same buckets, and frequencies are
decimals, so that they meet without a shuffle of the curves.

Defined results: frequencies are one if they are equal to six places; a frequency that is null, not finite or not positive, a unit that is not known and a ratio of
speeds that the slip does not allow stop the turn, naming the first; a curve is scaled by the frequency asked for first in order, as it was given; removing a curve that is
not kept or that is the base's stops the turn and removes nothing; repeated requests are one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hydraulics as hy
from .stages import SHOWN, shown

#: Places to which frequencies are compared (fixed value).
PLACES = 6
POINTS = ("q", "h", "eta", "npsh")
KEY = ("unit_id", "frequency")


@dataclass(frozen=True)
class Store:
    """Names of the tables of a store."""

    spark: SparkSession
    name: str

    def table(self, kind: str) -> DataFrame:
        self.spark.catalog.refreshTable(f"{self.name}_{kind}")
        return self.spark.table(f"{self.name}_{kind}")


def key(frequency: Column) -> Column:
    return F.bround(frequency.cast("double"), PLACES).try_cast(f"decimal(18,{PLACES})")


def create(spark: SparkSession, name: str, folder: str, points: DataFrame, units: DataFrame, buckets: int = 64) -> Store:
    """A store whose curves are those of the base frequencies. points: unit_id, i, POINTS; units: unit_id, poles, base_freq, base_speed."""
    base = points.join(units.select("unit_id", key(F.col("base_freq")).alias("frequency")), "unit_id")
    kept = base.select("unit_id", "i", *POINTS, "frequency", F.lit(0).cast("long").alias("turn"))
    gone = units.select("unit_id", key(F.col("base_freq")).alias("frequency"), F.lit(0).cast("long").alias("turn")).where(F.lit(False))

    def put(rows: DataFrame, kind: str, *cut: str) -> None:
        ready = rows.repartition(buckets, *KEY) if cut else rows
        writer = ready.write.mode("overwrite").option("path", f"{folder}/{kind}")
        (writer.bucketBy(buckets, *KEY).sortBy(*KEY).partitionBy(*cut) if cut else writer).saveAsTable(f"{name}_{kind}")

    put(kept, "curves", "turn")
    put(gone, "removed", "turn")
    put(units.select("unit_id", "poles", "base_freq", "base_speed"), "units")
    return Store(spark, name)


def _put(store: Store, kind: str, rows: DataFrame, turn: int) -> None:
    """One turn's partition, whatever was in it."""
    whole = store.table(kind)
    buckets = int(next(r.data_type for r in store.spark.sql(f"DESCRIBE EXTENDED {store.name}_{kind}").collect() if r.col_name == "Num Buckets"))
    ready = rows.withColumn("turn", F.lit(turn).cast("long")).select(*whole.columns).repartition(buckets, *KEY)
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = store.spark.conf.get(mode)
    store.spark.conf.set(mode, "dynamic")  # an option of the writer does not reach tables
    try:
        ready.write.insertInto(f"{store.name}_{kind}", overwrite=True)
    finally:
        store.spark.conf.set(mode, before)


def current(store: Store, before: int | None = None) -> DataFrame:
    """(unit_id, i, POINTS, frequency, turn) of the curves that count (before a turn)."""
    earlier = F.lit(True) if before is None else F.col("turn") < before
    gone = store.table("removed").where(earlier).groupBy(*KEY).agg(F.max("turn").alias("_gone"))
    rows = store.table("curves").where(earlier).join(gone, list(KEY), "left")
    return rows.where("_gone is null or turn > _gone").select("unit_id", "i", *POINTS, "frequency", "turn")


def _stop(found: DataFrame, what: str) -> None:
    first = found.orderBy("unit_id", "frequency").limit(SHOWN).collect()
    if first:
        raise ValueError(f"{what}: " + shown([f"{r.unit_id} at {r.frequency if r.frequency is None else float(r.frequency)}" for r in first], found.count()))


def _asked(rows: DataFrame) -> DataFrame:
    asked = rows.select("unit_id", F.col("frequency").cast("double").alias("given"), key(F.col("frequency")).alias("frequency"))
    _stop(asked.where("unit_id is null or frequency is null or frequency <= 0"), "no frequency")
    return asked.groupBy("unit_id", "frequency").agg(F.min("given").alias("given"))


def at(store: Store, asked: DataFrame, turn: int) -> DataFrame:
    """The curves asked for, with `made` where this turn made them; those that were not kept are added. asked: unit_id, frequency."""
    wanted = _asked(asked)
    units = store.table("units")
    kept = current(store, turn)
    _stop(wanted.join(units, "unit_id", "left_anti"), "no unit")
    fresh = wanted.join(kept.select("unit_id", "frequency"), list(KEY), "left_anti").join(units, "unit_id")
    ratio = hy.ratio_of_frequency(F.col("given"), F.col("base_freq"), hy.slip(F.col("poles"), F.col("base_freq"), F.col("base_speed")))
    fresh = fresh.withColumns({"r": ratio, "base": key(F.col("base_freq"))})
    _stop(fresh.where("r is null or r <= 0"), "no ratio of speeds")
    base = kept.select("unit_id", "i", *POINTS, F.col("frequency").alias("base"))
    r, c = F.col("r"), F.col
    made = fresh.select("unit_id", "frequency", "r", "base").join(base, ["unit_id", "base"])
    made = made.select("unit_id", "i", (c("q") * r).alias("q"), (c("h") * r * r).alias("h"), hy.scaled_efficiency(c("eta"), r).alias("eta"), (c("npsh") * r * r).alias("npsh"), "frequency")
    _put(store, "curves", made, turn)
    rows = current(store, turn + 1).join(wanted.select("unit_id", "frequency"), list(KEY), "left_semi")
    return rows.withColumn("made", F.col("turn") == turn)


def remove(store: Store, unwanted: DataFrame, turn: int) -> None:
    """Takes curves away. unwanted: unit_id, frequency."""
    wanted = _asked(unwanted).select("unit_id", "frequency")
    _stop(wanted.join(store.table("units").select("unit_id", key(F.col("base_freq")).alias("frequency")), list(KEY), "left_semi"), "the base curve stays")
    _stop(wanted.join(current(store, turn).select("unit_id", "frequency"), list(KEY), "left_anti"), "not kept")
    _put(store, "removed", wanted, turn)
