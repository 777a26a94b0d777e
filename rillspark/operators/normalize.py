"""Scalings, day-of-year climatologies, smoothing and cluster mean hydrographs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import not_leap_day, ratio, water_year

METHODS = ("min_max", "mean_variance", "z_score", "flow_index", "annual_flow_index")


def normalized(df: DataFrame, method: str, log: bool = True, water: bool = True) -> DataFrame:
    """site, d, q scaled over each site's series (over each year's for annual_flow_index).

    log takes log1p before the scaling; the flow indices take it after, always. A constant series gives null.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    w, q = Window.partitionBy("site"), F.col("q")
    if method.endswith("flow_index"):
        year = water_year(F.col("d")) if water else F.year("d")
        over = Window.partitionBy("site", year) if method == "annual_flow_index" else w
        return df.select("site", "d", F.log1p(ratio(q, F.avg(q).over(over))).alias("q"))
    if log:
        df = df.withColumn("q", F.log1p("q"))
    low, high, mean = F.min(q).over(w), F.max(q).over(w), F.avg(q).over(w)
    value = {"min_max": ratio(q - low, high - low), "mean_variance": ratio(q - mean, F.stddev_pop(q).over(w)), "z_score": ratio(q - mean, F.stddev_samp(q).over(w))}[method]
    return df.select("site", "d", value.alias("q"))


def annualized(df: DataFrame, middle: str = "median", water: bool = True) -> DataFrame:
    """site, day, q: mean or median per day of the water year (or of the year), without 29 February.

    Days of a leap year aren't moved, so later days of it are numbered one higher and bins go to 366.
    """
    start = F.make_date(water_year(F.col("d")) - 1, F.lit(10), F.lit(1))
    day = F.datediff("d", start) + 1 if water else F.dayofyear("d")
    f = {"median": F.median, "mean": F.avg}[middle]
    return df.filter(not_leap_day(F.col("d"))).groupBy("site", day.alias("day")).agg(f("q").alias("q"))


def smoothed(df: DataFrame, order: str = "day", half: int = 3) -> DataFrame:
    """q as the centred mean of seven rows, fewer at the ends."""
    w = Window.partitionBy("site").orderBy(order).rowsBetween(-half, half)
    return df.withColumn("q", F.avg("q").over(w))


def cluster_hydrograph(climatology: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, day, q (mean over sites), n_sites, label (a date of a model year); sites without a cluster are left out."""
    mean = climatology.join(clusters.select("site", "cluster"), "site").groupBy("cluster", "day").agg(F.avg("q").alias("q"), F.count("q").alias("n_sites"))
    return mean.withColumn("label", F.date_add(F.lit("1999-10-01").cast("date"), F.col("day") - 1))


def cluster_monthly(hydrograph: DataFrame) -> DataFrame:
    """cluster, month, q: means of the hydrograph's days by label month."""
    return hydrograph.groupBy("cluster", F.month("label").alias("month")).agg(F.avg("q").alias("q"))


def cluster_months(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, month, q, n_sites of daily series (site, d, q): the mean over a cluster's sites of each site's mean by month."""
    monthly = df.join(clusters.select("site", "cluster"), "site").groupBy("cluster", "site", F.month("d").alias("month")).agg(F.avg("q").alias("q"))
    return monthly.groupBy("cluster", "month").agg(F.avg("q").alias("q"), F.count("q").alias("n_sites"))
