"""Export profiles: fixed headers from long series, and delimited text with a profile's marks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    headers: tuple[str, ...]
    delimiter: str = ","
    decimal: str = "."
    newline: str = "\n"
    bom: bool = False


def table(rows: DataFrame, keys: Sequence[str], name: str, value: str, headers: Sequence[str]) -> DataFrame:
    """One column for each header, null throughout where no series has its name. Conditional sums in one pass, in place of a pivot's scan for names."""
    return rows.groupBy(*keys).agg(*(F.max(F.when(F.col(name) == h, F.col(value))).alias(h) for h in headers))


def number(c: Column, decimal: str = ".") -> Column:
    """A number with all its digits as most languages print it: plain from 1e-4 to below 1e16, with a two-digit exponent beyond; null and NaN are empty."""
    x = c.cast("double")
    s = x.cast("string")
    mantissa, power = F.regexp_replace(F.regexp_extract(s, r"^(-?[\d.]+)E(-?\d+)$", 1), r"\.0$", ""), F.regexp_extract(s, r"^(-?[\d.]+)E(-?\d+)$", 2).try_cast("int")
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,20)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    long_exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))
    shown = F.when(power.isNull(), s).when((power >= -4) & (power < 16), plain).otherwise(F.concat(mantissa, F.lit("e"), F.when(F.abs(power) < 10, exponent).otherwise(long_exponent)))
    return F.when(x.isNull() | F.isnan(x), "").otherwise(F.replace(shown, F.lit("."), F.lit(decimal)))


def lines(df: DataFrame, p: Profile) -> DataFrame:
    """(value): each row as a line of the profile. The header is the sink's."""
    if len(df.columns) != len(p.headers):
        raise ValueError("headers and columns differ in number")
    return df.select(F.concat_ws(p.delimiter, *(number(F.col(c), p.decimal) for c in df.columns)).alias("value"))


def write_csv(df: DataFrame, path: str, p: Profile) -> None:
    """Part files of the profile's lines, each with the header."""
    df.select(*(number(F.col(c), p.decimal).alias(h) for c, h in zip(df.columns, p.headers, strict=True))).write.mode("overwrite").option("header", True).option("sep", p.delimiter).option("emptyValue", "").option("lineSep", p.newline).csv(path)
