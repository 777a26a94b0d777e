"""From raw daily rows to complete water years, and runs of consecutive rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floored, null_if_nan, require_columns, water_year, water_year_start


def load_daily(df: DataFrame) -> DataFrame:
    """site, d, q: dates as days without zone, bad dates dropped, NaN as null."""
    require_columns(df, "site", "d", "q")
    day = F.to_date(F.col("d")) if dict(df.dtypes)["d"] != "string" else F.to_date(F.try_to_timestamp("d"))
    return df.select("site", day.alias("d"), null_if_nan(F.col("q").cast("double")).alias("q")).filter("d is not null")


def exclude(df: DataFrame, ranges: Iterable[tuple[str, str]]) -> DataFrame:
    """Rows outside all of the inclusive date ranges."""
    for first, last in ranges:
        df = df.filter(~F.col("d").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return df


def duplicate_days(df: DataFrame) -> DataFrame:
    """site, d, n of days that occur more than once; complete_years() takes it that there are none."""
    return df.groupBy("site", "d").agg(F.count("*").alias("n")).filter("n > 1")


def calendar_filled(df: DataFrame, start_month: int = 10) -> DataFrame:
    """site, wy, d, q with a row for each day of each water year that has any; n_missing days without q in the year."""
    wy = df.withColumn("wy", water_year(F.col("d"), start_month))
    first = water_year_start(F.col("wy"), start_month)
    days = wy.select("site", "wy").distinct().withColumn("d", F.explode(F.sequence(first, F.date_sub(F.add_months(first, 12), 1))))
    joined = days.join(wy, ["site", "wy", "d"], "left")
    return joined.withColumn("n_missing", F.count_if(F.col("q").isNull()).over(Window.partitionBy("site", "wy")))


def complete_years(df: DataFrame, start_month: int = 10, least: float = 1e-6) -> DataFrame:
    """site, wy, d, q of water years with at most one day missing, which takes the value of the day before.

    A missing first day of a year has no day before it in the year and stays null.
    """
    full = calendar_filled(df.withColumn("q", floored(F.col("q"), least)), start_month).filter("n_missing <= 1")
    order = Window.partitionBy("site", "wy").orderBy("d")
    return full.select("site", "wy", "d", F.last("q", ignorenulls=True).over(order).alias("q"))


def scoped(years: DataFrame) -> DataFrame:
    """Every row twice: under its water year and under all_years, so that one code path serves both."""
    twice = years.withColumn("scope", F.explode(F.array(F.col("wy").cast("string"), F.lit("all_years"))))
    return twice.select("site", "scope", "d", "q")


def runs(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Consecutive rows with flag: keys, first and last of order, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_n", F.row_number().over(w))
    on = marked.filter("_f").withColumn("_g", F.col("_n") - F.row_number().over(w))
    return on.groupBy(*keys, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_g")


def missing_ranges(df: DataFrame, start_month: int = 10) -> DataFrame:
    """site, wy, first, last, n: runs of missing days in the years that complete_years() leaves out."""
    return runs(calendar_filled(df, start_month).filter("n_missing > 1"), ["site", "wy"], "d", F.col("q").isNull())
