"""Views of the supplied tables that stand in for flow records, networks and zones, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(spark: SparkSession, sf_dir: str, site: Column) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(site.alias("site"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("q"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir, F.col("l_returnflag"))


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir, (F.col("l_suppkey") % 5).cast("string"))


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("site"), F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("q"))


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.complete_years(daily(spark, sf_dir))


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey") + 1
    up = F.expr("(c_custkey + 1) div 2")
    return table(spark, sf_dir, "customer").select(
        i.alias("comid"), F.nullif(up, F.lit(0)).alias("tocomid"), i.alias("fromnode"), up.alias("tonode"),
        F.when(i % 7 == 0, 2).when(i % 7 == 1, 1).otherwise(0).alias("divergence"), F.expr("(c_custkey + 1) div 16").alias("huc12"),
        F.when(i % 2 == 0, 1).otherwise(0).alias("ismainstem"), (i % 5 + 1).alias("streamorde"), (i % 3 + 1).alias("streamcalc"), i.alias("hydroseq"), (i % 50).alias("levelpathi"),
    )


def hucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = network(spark, sf_dir).select("huc12").distinct().filter("huc12 > 0")
    return h.select("huc12", F.nullif(F.expr("huc12 div 2"), F.lit(0)).alias("tohuc"))


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = network(spark, sf_dir).select("comid")
    one = n.select(F.col("comid").alias("a"), (F.col("comid") + 1).alias("b"), (1 + F.col("comid") % 5).alias("shared_len"))
    return one.unionByName(n.select(F.col("comid").alias("a"), (F.col("comid") + 2).alias("b"), (1 + F.col("comid") % 3).alias("shared_len")))


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """zone, src, area, value, with every seventh value missing."""
    value = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("zone"), F.col("l_partkey").alias("src"), F.col("l_quantity").alias("area"), value.alias("value"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("zone"), F.col("p_retailprice").alias("value"))


SQL_DAILY = "daily AS (SELECT l_returnflag AS site, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"
SQL_GAPPY = "gappy AS (SELECT CAST(l_suppkey % 5 AS VARCHAR) AS site, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"
SQL_ORDERS = "od AS (SELECT o_orderpriority AS site, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS q FROM orders GROUP BY 1, 2)"


def sql_full(source: str) -> str:
    return f"""wy AS (SELECT site, d, greatest(q, 1e-6) AS q, year(d) + (month(d) >= 10)::INT AS wy FROM {source}),
spine AS (SELECT site, wy, unnest(generate_series(make_date(wy - 1, 10, 1), make_date(wy, 9, 30), INTERVAL 1 DAY))::DATE AS d FROM (SELECT DISTINCT site, wy FROM wy)),
whole AS (SELECT s.site, s.wy, s.d, w.q, count(*) FILTER (w.q IS NULL) OVER (PARTITION BY s.site, s.wy) AS n_missing FROM spine s LEFT JOIN wy w USING (site, wy, d))"""


SQL_YEARS = f"""{SQL_DAILY}, {sql_full("daily")},
years AS (SELECT site, wy, d, last_value(q IGNORE NULLS) OVER (PARTITION BY site, wy ORDER BY d ROWS UNBOUNDED PRECEDING) AS q FROM whole WHERE n_missing <= 1)"""
SQL_SCOPED = f"""{SQL_YEARS},
sc0 AS (SELECT site, unnest([wy::VARCHAR, 'all_years']) AS scope, d, q FROM years),
sc AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY site, scope) AS n, lag(q) OVER w AS before, q - lag(q) OVER w AS diff,
  avg(q) OVER (PARTITION BY site, scope) AS mean, quantile_cont(q, 0.25) OVER (PARTITION BY site, scope) AS p25, quantile_cont(q, 0.5) OVER (PARTITION BY site, scope) AS p50, quantile_cont(q, 0.75) OVER (PARTITION BY site, scope) AS p75
  FROM sc0 WINDOW w AS (PARTITION BY site, scope ORDER BY d))"""
SQL_NETWORK = """net AS (SELECT c_custkey + 1 AS comid, nullif((c_custkey + 1) // 2, 0) AS tocomid, c_custkey + 1 AS fromnode, (c_custkey + 1) // 2 AS tonode,
  CASE (c_custkey + 1) % 7 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS divergence, (c_custkey + 1) // 16 AS huc12, CASE WHEN (c_custkey + 1) % 2 = 0 THEN 1 ELSE 0 END AS ismainstem,
  (c_custkey + 1) % 5 + 1 AS streamorde, (c_custkey + 1) % 3 + 1 AS streamcalc, c_custkey + 1 AS hydroseq, (c_custkey + 1) % 50 AS levelpathi FROM customer)"""
SQL_HUCS = "hucs AS (SELECT DISTINCT huc12, nullif(huc12 // 2, 0) AS tohuc FROM net WHERE huc12 > 0)"
SQL_ADJACENCY = "adj AS (SELECT comid AS a, comid + 1 AS b, 1 + comid % 5 AS shared_len FROM net UNION ALL SELECT comid, comid + 2, 1 + comid % 3 FROM net)"
SQL_OVERLAY = "overlay AS (SELECT l_suppkey AS zone, l_partkey AS src, l_quantity AS area, CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice END AS value FROM lineitem)"
