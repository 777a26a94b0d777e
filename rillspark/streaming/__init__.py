"""Daily series from a stream of timed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """site, d, q: sums per site and day of (site, ts, value) rows; a day ends when rows are later by the given time.

    On a stream, write it in append mode; rows behind the watermark are left out. A batch gives all days.
    """
    timed = stream.select("site", F.col("ts").cast("timestamp").alias("ts"), "value")
    timed = timed.withWatermark("ts", late) if stream.isStreaming else timed
    sums = timed.groupBy("site", F.window("ts", "1 day").alias("w")).agg(F.sum("value").alias("q"))
    return sums.select("site", F.to_date("w.start").alias("d"), "q")
