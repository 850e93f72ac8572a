"""Extracted curves with their pages, kept as tables to which batches are added.

Three tables below a folder, each cut by batch: `documents`, `pages` (a page's picture once, whatever the number of curves or batches that show it) and
`records` (one row an extracted curve, under an id made of its content and batch). A batch counts from the moment its name stands
in `batches`; what a broken-off batch has left is not read, and is overwritten when the batch runs again. A batch that is there already is passed over.

Defined results: a document is its sha; documents of one archive name (`name_of`) and different sha are a conflict, as are different
pictures of one page, within a batch or against what is kept; a curve whose page or document is not given is one too, and so is a row without sha or page.
A conflict stops the batch before anything is written, naming the first. Only pages and documents that curves show are kept; rows of a batch that are equal in all columns
are one record, those of another batch another; an empty batch is committed and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import text as tx
from ..operators.stages import SHOWN, shown

DOCUMENTS = "sha string, origin string, page_count int, app_version string"
PAGES = "sha string, page int, picture binary, width int, height int, dpi int"
#: Columns that a curve must have; others travel with it.
CURVES = ("sha", "page", "curve")


def name_of(origin: Column, sha: Column) -> Column:
    """The archive's name of a document: its file's name without its ending (`clipboard` if none), and the sha's first twelve digits."""
    stem = F.regexp_replace(F.regexp_extract(origin, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.concat_ws("_", tx.file_slug(F.coalesce(F.nullif(stem, F.lit("")), F.lit("clipboard"))), F.left(sha, F.lit(12)))


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """(batch) of the batches that count."""
    schema = "batch string, at timestamp"
    return (spark.read.schema(schema).parquet(f"{folder}/batches/*") if _there(spark, f"{folder}/batches") else spark.createDataFrame([], schema)).select("batch")


def read(spark: SparkSession, folder: str, table: str, schema: StructType | str | None = None) -> DataFrame | None:
    """A table's rows of the batches that count, with `batch`; None where nothing has been added yet."""
    if not _there(spark, f"{folder}/{table}"):
        return None
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)
    rows = reader.parquet(f"{folder}/{table}")
    return rows.withColumn("batch", F.col("batch").cast("string")).join(committed(spark, folder), "batch", "left_semi")


def _problems(documents: DataFrame, pages: DataFrame, curves: DataFrame, kept_documents: DataFrame | None, kept_pages: DataFrame | None) -> DataFrame:
    """(problem, item) of a batch against itself and what is kept. Pictures are compared by their digests."""
    used, known = curves.select("sha", "page").distinct(), documents.select("sha").distinct()
    digests = pages.select("sha", "page", "digest")
    names = documents.join(used, "sha", "left_semi").select(name_of(F.col("origin"), F.col("sha")).alias("item"), "sha")
    if kept_pages is not None:
        digests = digests.unionByName(kept_pages.select("sha", "page", "digest").join(used, ["sha", "page"], "left_semi"))
    if kept_documents is not None:
        names = names.unionByName(kept_documents.select(F.col("name").alias("item"), "sha"))
    at = F.concat_ws(":", "sha", "page")
    told = lambda rows, problem, item: rows.select(F.lit(problem).alias("problem"), item.alias("item"))
    return (
        told(names.groupBy("item").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).where("a <> b"), "document", F.col("item"))
        .unionByName(told(digests.groupBy("sha", "page").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b"), "picture", at))
        .unionByName(told(used.join(pages.select("sha", "page"), ["sha", "page"], "left_anti"), "no page", at))
        .unionByName(told(used.select("sha").distinct().join(known, "sha", "left_anti"), "no document", F.coalesce("sha", F.lit("null"))))
    )


def append(spark: SparkSession, folder: str, batch: str, documents: DataFrame, pages: DataFrame, curves: DataFrame) -> bool:
    """Adds a batch, and says whether it was new. documents: DOCUMENTS; pages: PAGES; curves: CURVES and any others.

    Keys and digests are compared; only pictures that are not kept yet are moved. Inputs must read the same rows each time they are read.
    """
    if not batch or not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"no name of a batch: {batch!r}")
    mark = f"{folder}/batches/{batch}"
    if _there(spark, f"{mark}/_SUCCESS"):
        return False
    missing = sorted(set(CURVES) - set(curves.columns))
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    pages = pages.withColumn("digest", F.sha2("picture", 256))
    kept_documents, kept_pages = read(spark, folder, "documents"), read(spark, folder, "pages")
    problems = _problems(documents, pages, curves, kept_documents, kept_pages)
    first = problems.orderBy("problem", "item").limit(SHOWN).collect()
    if first:
        raise ValueError("conflicts: " + shown([f"{r.problem} {r.item}" for r in first], problems.count()))

    used = curves.select("sha", "page").distinct()
    fresh = used if kept_pages is None else used.join(kept_pages.select("sha", "page"), ["sha", "page"], "left_anti")
    put = lambda rows, table: rows.write.mode("overwrite").parquet(f"{folder}/{table}/batch={batch}")
    put(pages.join(fresh, ["sha", "page"], "left_semi").dropDuplicates(["sha", "page"]), "pages")
    first_seen = documents.join(used.select("sha"), "sha", "left_semi")
    if kept_documents is not None:
        first_seen = first_seen.join(kept_documents.select("sha"), "sha", "left_anti")
    put(first_seen.dropDuplicates(["sha"]).withColumn("name", name_of(F.col("origin"), F.col("sha"))), "documents")
    content = F.to_json(F.struct(*sorted(curves.columns)), {"ignoreNullFields": "false"})
    record = F.sha2(F.concat_ws("\n", F.lit(batch), content), 256)
    put(curves.withColumn("record", record).dropDuplicates(["record"]), "records")
    spark.range(1).select(F.lit(batch).alias("batch"), F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").parquet(mark)
    return True
