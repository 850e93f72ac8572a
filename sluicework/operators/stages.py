"""Runs a stage of the manifest by a processor that the user brings.

A processor takes a row as a dict and returns `Done`; it runs in the tasks, a row at a time, and what it raises fails its row alone. The row travels
with its result, so that nothing is joined back. Origins are compared with the manifest before anything runs. A run in parts
commits each part by itself: after a crash the parts that are there stay, and only the others run.

Defined results: a state that is none of STATES fails the row; a failure's note has the exception's type and message, cut to NOTE characters; only `ok` ages what depends
on the stage; only `ok` and `pulado` record the version; rows that need no run stay as they are; an empty manifest gives no rows; repeated ids are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.shipping import ship
from . import manifest

#: States of a stage: done, not applicable, waiting for another stage, failed (fixed values).
STATES = ("ok", "pulado", "pendente", "falhou")
#: Characters of a failure's note (fixed value).
NOTE = 300
#: Names that a message shows before it counts the rest.
SHOWN = 20


class Done(NamedTuple):
    """What a processor says of a row: its state, a note, and which stages are to run again (None: all that depend on this one)."""

    state: str
    note: str = ""
    ages: tuple[str, ...] | None = None


def shown(names: Sequence[str], total: int | None = None, most: int = SHOWN) -> str:
    """The first names, and how many more there are."""
    total = len(names) if total is None else total
    return ", ".join(names[:most]) + (f" (+{total - most})" if total > most else "")


def origin_problems(rows: DataFrame, now: DataFrame) -> DataFrame:
    """(id, problem): `ausente` where the source is gone, `mudou` where it has another hash. rows and now: id, sha; of several sources with one id any may be the right one."""
    there = now.groupBy("id").agg(F.collect_set(F.coalesce("sha", F.lit(""))).alias("_there"))
    found = rows.select("id", "sha").join(there, "id", "left")
    problem = F.when(F.col("_there").isNull(), "ausente").when(~F.array_contains("_there", F.coalesce("sha", F.lit(""))), "mudou")
    return found.select("id", problem.alias("problem")).where("problem is not null")


def check_origins(rows: DataFrame, now: DataFrame) -> None:
    """Stops a run whose sources are not those of the manifest, naming the first."""
    problems = origin_problems(rows, now)
    first = problems.orderBy("id", "problem").limit(SHOWN).collect()
    if first:
        raise ValueError("sources differ from the manifest: " + shown([f"{r.id} ({r.problem})" for r in first], problems.count()))


def chosen(rows: DataFrame, routes: Sequence[str] = (), ids: Sequence[str] = ()) -> DataFrame:
    """Rows of the routes and of the documents named (none named: all); an error where none is left."""
    kept = rows.where((F.col("route").isin(*routes) if routes else F.lit(True)) & (F.col("id").isin(*ids) if ids else F.lit(True)))
    if (routes or ids) and kept.isEmpty():
        raise ValueError("no document of the manifest is chosen")
    return kept


def _apply(process: Callable[[dict], Done], row: dict) -> Done:
    try:
        done = process(row)
        if done.state not in STATES:
            raise ValueError(f"no state {done.state!r}")
        return done
    except Exception as e:  # a row's failure is its own
        return Done("falhou", f"{type(e).__name__}: {e}"[:NOTE])


def run_stage(rows: DataFrame, stage: str, version: int, process: Callable[[dict], Done], columns: Sequence[str], forced: bool = False) -> DataFrame:
    """rows after the stage, and `ran`. rows: id, st_ of all stages, versions, note, and the columns that the processor reads; a column qa is emptied where something ages."""
    ship(rows.sparkSession)
    runs = manifest.needs_run(F.col(f"st_{stage}"), manifest.version(F.col("versions"), stage), version, forced)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [_apply(process, r) for r in b.select(list(columns)).to_pylist()]
            told = [pa.array([d.state for d in done], pa.string()), pa.array([d.note for d in done], pa.string()), pa.array([None if d.ages is None else list(d.ages) for d in done], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *told], names=[*names, "_state", "_note", "_ages"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    done = rows.where(runs).mapInArrow(run, f"{kinds}, _state string, _note string, _ages array<string>")
    ages = F.when(F.col("_state") == "ok", F.coalesce("_ages", F.array(*map(F.lit, manifest.DEPENDENTS[stage])).cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    own = F.when(F.col("_state").isin("ok", "pulado"), F.array(F.lit(f"{stage}={version}"))).otherwise(F.array().cast("array<string>"))
    others = F.filter(F.split("versions", ";"), lambda p: (p != "") & ~F.array_contains(F.concat(F.array(F.lit(stage)), ages), F.split(p, "=")[0]))
    after: dict[str, Column] = {f"st_{s}": F.when(F.array_contains(ages, s), "pendente").otherwise(F.col(f"st_{s}")) for s in manifest.STAGES if s != stage}
    after |= {f"st_{stage}": F.col("_state"), "versions": F.array_join(F.array_sort(F.concat(others, own)), ";"), "note": manifest.upsert_note(F.col("note"), stage, F.col("_note"))}
    if "qa" in names:
        after["qa"] = F.when(F.col("_state") == "ok", "").otherwise(F.col("qa"))
    told = done.select(*(after.get(n, F.col(n)).alias(n) for n in names), F.lit(True).alias("ran"))
    return told.unionByName(rows.where(~runs).withColumn("ran", F.lit(False)))


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_in_parts(rows: DataFrame, stage: str, version: int, process: Callable[[dict], Done], columns: Sequence[str], folder: str, parts: int = 16, forced: bool = False) -> DataFrame:
    """run_stage over parts of the rows (by a hash of the id), each written to the folder and committed before the next one starts.

    Rows are laid out by part once, so that a part reads its own; a run that begins again in the same folder goes on with what it
    has laid out and runs the parts that are not committed.
    """
    spark = rows.sparkSession
    laid = f"{folder}/rows"
    if not _there(spark, laid):
        rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).write.mode("overwrite").partitionBy("part").parquet(laid)
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType())])
    for k in range(parts):
        if not _there(spark, f"{folder}/done/part={k}"):
            own = spark.read.schema(schema).parquet(laid).where(F.col("part") == k).drop("part")
            run_stage(own, stage, version, process, columns, forced).write.mode("overwrite").parquet(f"{folder}/done/part={k}")
    return spark.read.parquet(*(f"{folder}/done/part={k}" for k in range(parts))).select(*rows.columns, "ran")
