"""Bills of materials: checks, selection and grouping in catalogue order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select(catalog: DataFrame, items: DataFrame) -> DataFrame:
    """Catalogue rows with a quantity above zero."""
    return catalog.join(items, "code").where(F.col("quantity") > 0)


def unknown(catalog: DataFrame, items: DataFrame) -> DataFrame:
    return items.join(catalog.select("code"), "code", "left_anti")


def ordered(chosen: DataFrame) -> DataFrame:
    """Rows with `place` and `type_key`: materials and families by first appearance among the chosen rows, types by their letters whatever the case, then as they are, rows by line.

    First lines are aggregates joined back, so that no window gathers the whole catalogue.
    """
    m = chosen.groupBy("material").agg(F.min("line").alias("m_line"))
    f = chosen.groupBy("material", "type", "family").agg(F.min("line").alias("f_line"))
    rows = chosen.join(m, "material").join(f, ["material", "type", "family"])
    w = Window.partitionBy("material", "type").orderBy("f_line", "line")
    return rows.withColumns({"place": F.row_number().over(w), "type_key": F.struct(F.lower("type").alias("low"), F.col("type").alias("raw"))})


def families(chosen: DataFrame) -> DataFrame:
    """One row for each family with its codes in catalogue order."""
    return chosen.groupBy("material", "type", "family").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "code"))), lambda r: r["code"].cast("string")), ",").alias("codes"))


#: Kinds of pictures, the preferred first (fixed values), and what stands where none is.
PICTURES, PLACEHOLDER = ("pdf", "png", "jpg", "jpeg"), "imgs/handler.jpg"


def pick_images(files: DataFrame) -> DataFrame:
    """(stem in lower case, path): of the pictures of one name the first by kind, then by name. files: path. One aggregation, no window."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    place = F.array_position(F.array(*map(F.lit, PICTURES)), kind)
    stem = F.lower(F.regexp_replace("path", r"\.[^./]+$", ""))
    found = files.where(kind.isin(*PICTURES)).groupBy(stem.alias("stem")).agg(F.min(F.struct(place.alias("kind"), F.lower("path").alias("low"), "path")).alias("best"))
    return found.select("stem", "best.path")


def pictures(families: DataFrame, images: DataFrame) -> DataFrame:
    """(family, image, warned): each family's picture, or the placeholder with a warning. images: stem, path."""
    rows = families.join(images.select("stem", "path"), F.lower("family") == F.col("stem"), "left")
    return rows.select("family", F.coalesce("path", F.lit(PLACEHOLDER)).alias("image"), F.col("path").isNull().alias("warned"))
