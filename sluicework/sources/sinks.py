"""Files that results become: delimited text, raw and common tables, logs, and single files put in place as a whole."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curves, text as tx
from . import profiles


def write_atomic(spark: SparkSession, path: str, content: bytes) -> None:
    """One file, written beside its place and then moved there, so that no reader sees a part of it; for reports and logs that people read."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"._{target.getName()}.part")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    over = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(over, 1)
    how[0] = over.OVERWRITE  # in one step: there is no time without a file
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(beside), fs.makeQualified(target), how)


def write_result(df: DataFrame, path: str) -> None:
    """A table as delimited files with a header each, quotes within cells doubled and blanks at their ends kept; Spark's commit puts them in place."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def raw_points(points: DataFrame, calibration: dict[str, Column], x_log: bool = False, y_log: bool = False) -> DataFrame:
    """(curve, name, i, px, py, X, Y): captured points in pixels and in units. points: curve, name, i, px, py and what the calibration reads."""
    x, y = curves.to_real(F.col("px"), F.col("py"), calibration, x_log, y_log)
    return points.select("curve", "name", "i", "px", "py", x.alias("X"), y.alias("Y"))


def planned_paths(stem: str, curves_: Sequence[tuple[str, str]], kind: str, raw: bool = False, raw_only: bool = False) -> list[str]:
    """Paths that an export will write; curves_: (id, name). kind: CSV, XLSX or both."""
    folder, name = posixpath.split(stem)
    if name in ("", ".", ".."):
        raise ValueError("no destination")
    if kind not in ("CSV", "XLSX", "both"):
        raise ValueError(f"no format {kind!r}")
    base = posixpath.splitext(name)[0]
    out = []
    if kind != "XLSX":
        out += [] if raw_only else [posixpath.join(folder, f"{base}.csv")]
        out += [posixpath.join(folder, f"{base}_{_file_slug(n)}_{i[:8]}_raw.csv") for i, n in curves_] if raw or raw_only else []
    return out + ([posixpath.join(folder, f"{base}.xlsx")] if kind != "CSV" else [])


def _file_slug(name: str) -> str:
    import re

    return re.sub(r"^_+|_+$", "", re.sub(r"[^\w-]+", "_", name))[:80] or "file"


def write_raw(points: DataFrame, folder: str, p: profiles.Profile) -> None:
    """Raw points (`raw_points`), a folder a curve, in the marks of a profile. They are whole once the folder has its `_SUCCESS`."""
    cells = [profiles.number(F.col(c), p.decimal).alias(c) for c in ("px", "py", "X", "Y")]
    named = F.concat_ws("_", tx.file_slug(F.col("name")), F.left(F.col("curve").cast("string"), F.lit(8)), F.lit("raw"))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number is not lowered where rows are few: opening files is what takes the time
    rows = points.select(named.alias("file"), "i", *cells).repartition(tasks, "file").sortWithinPartitions("file", "i").drop("i")
    moved = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}  # tasks put their own folders in place; else the driver moves all of them, one after the other, at the end
    rows.write.mode("overwrite").options(**moved).partitionBy("file").option("header", True).option("sep", p.delimiter).option("emptyValue", "").csv(folder)


def rename_log(plan: DataFrame, partial: DataFrame) -> DataFrame:
    """(place, line) of a log of renames and of downloads set aside. plan: pos, source, target, status, sha; partial: path, target."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    row = lambda status, a, b, sha: F.concat_ws(",", quoted(status), quoted(a), quoted(b), F.coalesce(sha, F.lit("")))
    c = F.col
    head = plan.sparkSession.createDataFrame([("status,source,target,sha256",)], "line string").select(F.struct(F.lit(0).alias("part"), F.lit("").alias("at")).alias("place"), "line")
    moved = plan.select(F.struct(F.lit(1).alias("part"), F.lpad(c("pos").cast("string"), 20, "0").alias("at")).alias("place"), row(c("status"), c("source"), c("target"), c("sha")).alias("line"))
    aside = partial.select(F.struct(F.lit(2).alias("part"), c("path").alias("at")).alias("place"), row(F.lit("DOWNLOAD_PARCIAL"), c("path"), c("target"), F.lit("")).alias("line"))
    return head.unionByName(moved).unionByName(aside)


def _cell(c: Column) -> Column:
    """A cell of a delimited file: between quotes where it holds a comma, a quote or a break."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.regexp_like(text, F.lit('[,"\r\n]')), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_manifest(rows: DataFrame, folder: str, file: str = "arquivo_origem", key: str = "id", parts: int | None = None) -> None:
    """A manifest as one file cut into parts: put one behind the other in order of names, they are a delimited file with a mark, one header and CRLF, by file whatever its case, then id.

    Rows are cut by ranges and sorted within them; the header is the least row, so that it begins the first part. A manifest without rows is its header.
    """
    header = "\ufeff" + ",".join('"' + n.replace('"', '""') + '"' if any(x in n for x in ',"\r\n') else n for n in rows.columns)
    # the files' lower case, as the order of Unicode has it, is that of its bytes
    lines = rows.select(F.lit(1).alias("part"), F.lower(F.coalesce(F.col(file), F.lit(""))).alias("at"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.concat_ws(",", *(_cell(F.col(f"`{n}`")) for n in rows.columns)).alias("value"))
    first = rows.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("at"), F.lit("").alias("key"), F.lit(header).alias("value"))
    ordered = first.unionByName(lines).repartitionByRange(*([parts] if parts else []), "part", "at", "key").sortWithinPartitions("part", "at", "key")
    ordered.select("value").write.mode("overwrite").option("lineSep", "\r\n").text(folder)
