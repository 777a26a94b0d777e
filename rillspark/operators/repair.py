"""Gaps in series: inventory, interpolation, carrying, differencing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prepare import runs

#: A gap that starts in these months is of the short season.
SPRING = (3, 7)


def _order(*keys: str) -> Window:
    return Window.partitionBy("site", *keys).orderBy("d")


def fill_dates(df: DataFrame) -> DataFrame:
    """site, d, q for every day from each site's first to its last; q is null where there was no row."""
    span = df.groupBy("site").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return span.select("site", F.explode(F.sequence("a", "b")).alias("d")).join(df.select("site", "d", "q"), ["site", "d"], "left")


def gaps(df: DataFrame, min_days: int = 0) -> DataFrame:
    """site, first, last (as text), n: runs of days without a value that are longer than min_days."""
    found = runs(fill_dates(df), ["site"], "d", F.col("q").isNull()).filter(F.col("n") > min_days)
    return found.select("site", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "n")


def with_neighbours(filled: DataFrame) -> DataFrame:
    """For each row the nearest values before and after, with their rows' places."""
    df = filled.withColumn("i", F.row_number().over(_order()))
    have = F.when(F.col("q").isNotNull(), F.col("i"))
    ahead = _order().rowsBetween(0, Window.unboundedFollowing)
    for name, w, f in (("before", _order(), F.last), ("after", ahead, F.first)):
        df = df.withColumn(f"i_{name}", f(have, ignorenulls=True).over(w)).withColumn(f"q_{name}", f("q", ignorenulls=True).over(w))
    return df


def straight(q: Column) -> Column:
    """The value on the line between the neighbours; null at the ends."""
    share = (F.col("i") - F.col("i_before")) / F.nullif(F.col("i_after") - F.col("i_before"), F.lit(0))
    return F.coalesce(q, F.col("q_before") + (F.col("q_after") - F.col("q_before")) * share)


def interpolate(df: DataFrame, spring_gap: int = 7, other_gap: int = 22, scope: str = "series") -> DataFrame:
    """site, d, q, filled: interior gaps on straight lines.

    A gap may have so many days, by the month in which it starts. With scope "gap" only such gaps are filled; with
    "series", all interior gaps of a site that has one such gap.
    """
    if scope not in ("series", "gap"):
        raise ValueError(f"unknown scope: {scope}")
    near = with_neighbours(fill_dates(df))
    missing = F.col("q").isNull()
    # rows of a gap share the neighbour before; a gap at the start has none
    gap = Window.partitionBy("site", F.coalesce("i_before", F.lit(0)), missing)
    near = near.withColumn("days", F.when(missing, F.count("*").over(gap))).withColumn("month", F.when(missing, F.month(F.min("d").over(gap))))
    fits = missing & (F.col("days") <= F.when(F.col("month").between(*SPRING), spring_gap).otherwise(other_gap))
    near = near.withColumn("fits", fits)
    wanted = F.col("fits") if scope == "gap" else F.max("fits").over(Window.partitionBy("site"))
    value = F.when(missing & wanted, straight(F.col("q"))).otherwise(F.col("q"))
    return near.select("site", "d", value.alias("q"), (missing & value.isNotNull()).alias("filled"))


def gap_overlay(df: DataFrame, spring_gap: int = 7, other_gap: int = 22, scope: str = "series") -> DataFrame:
    """site, d, observed, overlay: what a plot of filled gaps draws; overlay runs from the day before a gap to the day after."""
    filled = interpolate(df, spring_gap, other_gap, scope)
    missing = F.col("filled") | F.col("q").isNull()
    beside = lambda f: F.coalesce(f(missing).over(_order()), F.lit(False))
    return filled.select("site", "d", F.when(~missing, F.col("q")).alias("observed"), F.when(missing | beside(F.lag) | beside(F.lead), F.col("q")).alias("overlay"))


def resampled(df: DataFrame) -> DataFrame:
    """site, ts, v at the most frequent step of each site (the smallest of several), from its first to its last time."""
    seconds = F.unix_timestamp("ts")
    steps = df.withColumn("step", seconds - F.lag(seconds).over(Window.partitionBy("site").orderBy("ts"))).filter("step > 0")
    steps = steps.groupBy("site", "step").count().groupBy("site").agg(F.max_by("step", F.struct("count", -F.col("step"))).alias("step"))
    span = df.groupBy("site").agg(F.min(seconds).alias("a"), F.max(seconds).alias("b")).join(steps, "site")
    grid = span.select("site", F.explode(F.sequence("a", "b", "step")).alias("s")).select("site", F.timestamp_seconds("s").alias("ts"))
    return grid.join(df.select("site", F.col("ts").cast("timestamp").alias("ts"), "v"), ["site", "ts"], "left")


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; for a day in both, that of old."""
    return old.unionByName(new.join(old.select("site", "d"), ["site", "d"], "left_anti"))


def updated(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the values that new has for its days."""
    return old.join(new.select("site", "d", F.col("q").alias("_new")), ["site", "d"], "left").select("site", "d", F.coalesce("_new", "q").alias("q"))


def differenced(df: DataFrame, times: int = 1) -> DataFrame:
    """The series' differences of the given order; rows at the start that have none are left out."""
    for _ in range(times):
        df = df.withColumn("q", F.col("q") - F.lag("q").over(_order()))
        df = df.withColumn("_k", F.row_number().over(_order())).filter("_k > 1").drop("_k")
    return df


def undifferenced(df: DataFrame, last: DataFrame) -> DataFrame:
    """Sums of first differences on from each site's last known value (site, q)."""
    total = F.sum("q").over(_order())
    return df.join(last.select("site", F.col("q").alias("_q0")), "site").select("site", "d", (F.col("_q0") + total).alias("q"))


def month_value(df: DataFrame, column: str) -> DataFrame:
    """Adds end_of_month, the first value of column that the day's month has, and end_of_last_month, that of the month before.

    A month without a value gives null to the next; no older month stands in for it.
    """
    month = F.trunc("d", "month")
    values = df.filter(F.col(column).isNotNull()).groupBy("site", month.alias("_m")).agg(F.min_by(column, "d").alias("_v"))
    out = df.withColumn("_m", month).join(values.withColumnRenamed("_v", "end_of_month"), ["site", "_m"], "left")
    later = values.select("site", F.add_months("_m", 1).alias("_m"), F.col("_v").alias("end_of_last_month"))
    return out.join(later, ["site", "_m"], "left").drop("_m")


def parsed(text: Column) -> Column:
    """A timestamp from text with a +00:00 zone, or without zone."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ssXXX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def joined(q: DataFrame, p: DataFrame) -> DataFrame:
    """q's rows with p's columns of the day, null where p has none."""
    return q.join(p, ["site", "d"], "left")
