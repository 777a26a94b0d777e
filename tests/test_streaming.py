"""The stream of daily sums against the batch."""

from pyspark.sql import functions as F

from rillspark.streaming import daily

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_ends_all_days_but_the_last(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    batch.select(F.col("event_type").alias("site"), F.col("ts").cast("timestamp").alias("ts"), "value").write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = daily(stream, "0 seconds").writeStream.format("memory").queryName("daily_sums").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda df: {(r["site"], r["d"]): round(r["q"], 6) for r in df.collect()}
    got, want = key(spark.table("daily_sums")), key(daily(rows))
    last = max(d for _, d in want)
    assert got == {k: v for k, v in want.items() if k[1] < last}
