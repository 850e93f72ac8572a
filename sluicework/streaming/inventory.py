"""The manifest kept up to date from a stream of (id, sha) rows: each batch is reconciled with the parts of a snapshot that it touches.

A snapshot is cut into parts by a hash of the id. A batch writes anew only the parts that its ids fall into; an index says which
batch wrote each part last. Parts and indexes are never changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, sha string, status string"
#: Parts of a snapshot.
PARTS = 64


def _part(parts: int):
    return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _index(spark: SparkSession, folder: str, below: int | None = None) -> dict[int, int]:
    """Part -> the batch that wrote it, of the last whole index (before a batch)."""
    path, fs = _fs(spark, f"{folder}/index")
    if not fs.exists(path):
        return {}
    jvm = spark.sparkContext._jvm
    found = [int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    found = [n for n in found if below is None or n < below]
    return {r.part: r.batch for r in spark.read.parquet(f"{folder}/index/{max(found)}").collect()} if found else {}  # one row a part


def _read(spark: SparkSession, folder: str, index: dict[int, int]) -> DataFrame:
    paths = [f"{folder}/rows/{b}/part={p}" for p, b in index.items()]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last whole snapshot; empty if there is none."""
    return _read(spark, folder, _index(spark, folder))


def merge(snapshot: DataFrame, arrived: DataFrame) -> DataFrame:
    """Rows of both: what arrived is new, changed or unchanged; the rest stays. Of several arrivals of an id the greatest sha counts."""
    last = arrived.groupBy("id").agg(F.max("sha").alias("new_sha"))
    both = snapshot.select("id", "sha", "status").join(last, "id", "full_outer")
    status = F.when(F.col("new_sha").isNull(), F.col("status")).when(F.col("sha").isNull(), "new").when(F.col("sha") != F.col("new_sha"), "changed").otherwise("unchanged")
    return both.select("id", F.coalesce("new_sha", "sha").alias("sha"), status.alias("status"))


def maintain(arrivals: DataFrame, folder: str, checkpoint: str, parts: int = PARTS):
    """A query that brings the snapshot in a folder up to date with all that has arrived, and ends. A batch that is run again starts from the index before it, and writes the same parts again."""

    def batch(rows: DataFrame, n: int) -> None:
        s = rows.sparkSession
        index = _index(s, folder, n)
        touched = [r.part for r in rows.select(_part(parts).alias("part")).distinct().collect()]  # at most `parts`
        before = _read(s, folder, {p: b for p, b in index.items() if p in touched})
        merge(before, rows).withColumn("part", _part(parts)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows/{n}")
        s.createDataFrame(sorted({**index, **dict.fromkeys(touched, n)}.items()), "part int, batch int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/index/{n}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
