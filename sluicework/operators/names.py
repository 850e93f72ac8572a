"""Names that are told apart by numbers, as sheets of a workbook are: in order, each takes the first of `name`, `name_1`, `name_2`, ... that is free.

The order decides who has a name, whatever the name was made from (`a`, `a`, `a_1` become `a`, `a_1`, `a_1_1`). Rows ask for names in rounds: of those that ask for
one name the first in order has it, and the others ask for their next. As all names prefer the first in order, the rounds end where taking the rows one by one would. Rows
of one base ask for different numbers from the start, so that the rounds follow how often bases meet, not how many rows share one.

Defined results: names are compared whatever their case; they are cut so that the number fits; characters that a sheet's name cannot have become `_`, and quotes at
the ends go; null, blank and empty names are the default; no rows give none. The order must tell the rows of a group apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest name, what a name cannot be, and what stands for none (fixed values).
MOST, RESERVED, DEFAULT = 31, ("history",), "Curva"


def base_of(name: Column, most: int = MOST, default: str = DEFAULT) -> Column:
    s = F.left(F.regexp_replace(F.regexp_replace(name, r"[\[\]:*?/\\]", "_"), r"^'+|'+$", ""), F.lit(most))
    return F.when(F.coalesce(s, F.lit("")) == "", default).otherwise(s)


def numbered(base: Column, k: Column, most: int = MOST) -> Column:
    """The k-th name that a base asks for; the 0-th is the base itself."""
    end = F.concat(F.lit("_"), k.cast("string"))
    return F.when(k == 0, base).otherwise(F.concat(F.left(base, F.lit(most) - F.length(end)), end))


def unique(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str, folder: str, most: int = MOST, reserved: Sequence[str] = RESERVED, default: str = DEFAULT) -> DataFrame:
    """rows with `unique_name`. group: within which names are told apart; folder: where the rounds are written."""
    spark = rows.sparkSession
    c = F.col
    begun = rows.withColumn("_base", base_of(c(name), most, default)).withColumn("_like", F.lower("_base"))
    same = Window.partitionBy(*group, "_like").orderBy(*order)
    asked = begun.withColumn("_k", F.row_number().over(same).cast("long") - 1).withColumn("_n", c("_k"))
    turn = 0
    while True:
        title = numbered(c("_base"), c("_k"), most)
        told = asked.withColumn("unique_name", title).withColumn("_title", F.lower(title))
        first = F.row_number().over(Window.partitionBy(*group, "_title").orderBy(*order))
        refused = c("_title").isin(*reserved) | (first > 1)
        told.withColumn("_refused", refused).write.mode("overwrite").parquet(f"{folder}/{turn}")
        done = spark.read.parquet(f"{folder}/{turn}")
        if done.where("_refused").isEmpty():
            return done.select(*rows.columns, "unique_name")
        # a refused row asks for its next; those of its base behind it stay behind it
        ahead = F.max(c("_k") + F.when(c("_refused"), 1).otherwise(0) - c("_n")).over(same)
        asked = done.withColumn("_k", ahead + c("_n")).select(*rows.columns, "_base", "_like", "_k", "_n")
        turn += 1
