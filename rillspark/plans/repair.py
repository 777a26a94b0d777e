"""Queries on gaps, imputation, normalization and hydrographs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import impute, normalize, repair
from ..operators.prepare import runs
from . import proxies as px
from .registry import query

_SPAN = "sp AS (SELECT site, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM gappy GROUP BY 1), fd AS (SELECT sp.site, sp.d, g.q FROM sp LEFT JOIN gappy g USING (site, d))"
_FD = f"{px.SQL_GAPPY}, {_SPAN}"
query("ts1_fill_dates", f"WITH {_FD} SELECT site, d, q FROM fd")(lambda s, d: repair.fill_dates(px.gappy(s, d)))
_GAPS = f"WITH {_FD} SELECT site, min(d)::VARCHAR AS first, max(d)::VARCHAR AS last, count(*) AS n FROM (SELECT site, d, d - row_number() OVER (PARTITION BY site ORDER BY d)::INT AS g FROM fd WHERE q IS NULL) GROUP BY site, g"
query("ts2_gaps", _GAPS)(lambda s, d: repair.gaps(px.gappy(s, d)))
query("ts2_gaps_over_two_days", _GAPS.replace("GROUP BY site, g", "GROUP BY site, g HAVING count(*) > 2").replace("gappy", "od").replace(px.SQL_GAPPY.replace("gappy", "od"), px.SQL_ORDERS))(lambda s, d: repair.gaps(px.orders_daily(s, d), 2))
_NEAR = """nb AS (SELECT *, row_number() OVER w AS i FROM fd WINDOW w AS (PARTITION BY site ORDER BY d)),
n2 AS (SELECT *, last_value(CASE WHEN q IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ib, last_value(q IGNORE NULLS) OVER b AS qb, first_value(CASE WHEN q IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ia, first_value(q IGNORE NULLS) OVER a AS qa
  FROM nb WINDOW b AS (PARTITION BY site ORDER BY d ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY site ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
n3 AS (SELECT *, q IS NULL AS missing, count(*) OVER g AS days, month(min(d) OVER g) AS mo FROM n2 WINDOW g AS (PARTITION BY site, coalesce(ib, 0), q IS NULL)),
n4 AS (SELECT *, missing AND days <= CASE WHEN mo BETWEEN 3 AND 7 THEN 7 ELSE 22 END AS fits, qb + (qa - qb) * (i - ib) / nullif(ia - ib, 0) AS line FROM n3)"""
for _scope, _want in (("gap", "fits"), ("series", "bool_or(fits) OVER (PARTITION BY site)")):
    query(
        f"ts3_interpolate_{_scope}",
        f"WITH {_FD}, {_NEAR}, n5 AS (SELECT site, d, missing, CASE WHEN missing AND {_want} THEN line ELSE q END AS v FROM n4) SELECT site, d, round(v, 6) + 0.0 AS q, missing AND v IS NOT NULL AS filled FROM n5",
    )(lambda s, d, scope=_scope: rounded(repair.interpolate(px.gappy(s, d), 7, 22, scope)))
query(
    "io18_gap_overlay",
    f"WITH {_FD}, {_NEAR}, n5 AS (SELECT site, d, q, missing, CASE WHEN missing AND bool_or(fits) OVER (PARTITION BY site) THEN line ELSE q END AS v FROM n4), n6 AS (SELECT *, lag(missing, 1, false) OVER w OR lead(missing, 1, false) OVER w AS beside FROM n5 WINDOW w AS (PARTITION BY site ORDER BY d)) "
    "SELECT site, d, round(q, 6) + 0.0 AS observed, round(CASE WHEN missing OR beside THEN v END, 6) + 0.0 AS overlay FROM n6",
)(lambda s, d: rounded(repair.gap_overlay(px.gappy(s, d))))
query("ts11_straight_lines", f"WITH {_FD}, {_NEAR} SELECT site, d, round(coalesce(q, line), 6) + 0.0 AS q FROM n4")(
    lambda s, d: rounded(repair.with_neighbours(repair.fill_dates(px.gappy(s, d))).select("site", "d", repair.straight(F.col("q")).alias("q")))
)
_HOURS = "ev AS (SELECT event_type AS site, date_trunc('hour', ts) AS ts, sum(value) AS v FROM events GROUP BY 1, 2)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("site"), F.date_trunc("hour", "ts").alias("ts")).agg(F.sum("value").alias("v"))


@query(
    "ts4_resample",
    f"""WITH {_HOURS}, st AS (SELECT site, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER (PARTITION BY site ORDER BY ts) AS step FROM ev),
m AS (SELECT site, arg_max(step, {{'a': k, 'b': -step}}) AS step FROM (SELECT site, step, count(*) AS k FROM st WHERE step > 0 GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT e.site, unnest(range(min(epoch(ts)::BIGINT), max(epoch(ts)::BIGINT) + 1, any_value(step))) AS sec FROM ev e JOIN m USING (site) GROUP BY 1)
SELECT g.site, g.sec, round(v, 6) + 0.0 AS v FROM g LEFT JOIN ev ON ev.site = g.site AND epoch(ev.ts)::BIGINT = g.sec""",
)
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(repair.resampled(hourly(spark, sf_dir)).select("site", F.unix_timestamp("ts").alias("sec"), "v"))


@query("ts5_missing_hours", f"""WITH {_HOURS}, g AS (SELECT site, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM ev GROUP BY 1),
n AS (SELECT g.site, epoch(g.ts)::BIGINT AS sec FROM g LEFT JOIN ev USING (site, ts) WHERE v IS NULL)
SELECT site, min(sec) AS first, max(sec) AS last, count(*) AS n FROM (SELECT *, sec - 3600 * row_number() OVER (PARTITION BY site ORDER BY sec) AS k FROM n) GROUP BY site, k""")
def missing_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    regular = repair.resampled(hourly(spark, sf_dir)).withColumn("sec", F.unix_timestamp("ts"))
    return runs(regular, ["site"], "sec", F.col("v").isNull())


_HALVES = f"{px.SQL_GAPPY}, lo AS (SELECT * FROM gappy WHERE d < DATE '1998-07-01'), hi AS (SELECT site, d, q * 2 AS q FROM gappy WHERE d >= DATE '1998-01-01')"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = px.gappy(spark, sf_dir)
    return g.filter("d < date '1998-07-01'"), g.filter("d >= date '1998-01-01'").withColumn("q", F.col("q") * 2)


query("ts6_append", f"WITH {_HALVES} SELECT site, d, q FROM lo UNION ALL SELECT site, d, q FROM hi ANTI JOIN lo USING (site, d)")(lambda s, d: repair.appended(*_halves(s, d)))
query("ts6_update", f"WITH {_HALVES} SELECT lo.site, lo.d, coalesce(hi.q, lo.q) AS q FROM lo LEFT JOIN hi USING (site, d)")(lambda s, d: repair.updated(*_halves(s, d)))
_DIFF = f"{px.SQL_GAPPY}, d1 AS (SELECT site, d, q - lag(q) OVER (PARTITION BY site ORDER BY d) AS q, row_number() OVER (PARTITION BY site ORDER BY d) AS k FROM gappy)"
query("ts7_difference", f"WITH {_DIFF} SELECT site, d, round(q, 6) + 0.0 AS q FROM d1 WHERE k > 1")(lambda s, d: rounded(repair.differenced(px.gappy(s, d))))
query("ts7_difference_twice", f"WITH {_DIFF}, d2 AS (SELECT site, d, q - lag(q) OVER (PARTITION BY site ORDER BY d) AS q, row_number() OVER (PARTITION BY site ORDER BY d) AS k FROM d1 WHERE k > 1) SELECT site, d, round(q, 6) + 0.0 AS q FROM d2 WHERE k > 1")(
    lambda s, d: rounded(repair.differenced(px.gappy(s, d), 2))
)


@query("ts7_undifference", f"WITH {px.SQL_GAPPY} SELECT site, d, round(q, 6) + 0.0 AS q FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d) AS k FROM gappy) WHERE k > 1")
def undifference(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = px.gappy(spark, sf_dir)
    return rounded(repair.undifferenced(repair.differenced(g), g.groupBy("site").agg(F.min_by("q", "d").alias("q"))))


@query("ts13_linar")
def linar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(impute.linar(px.gappy(spark, sf_dir)))


@query("ts14_chained_equations")
def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five datasets, completed in five iterations."""
    return rounded(impute.chained_fill(px.gappy(spark, sf_dir)))


@query("ts14_forest_mean")
def forest_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the five completed datasets."""
    full = impute.chained_fill(px.gappy(spark, sf_dir))
    return rounded(full.groupBy("site", "d", "filled").agg(F.avg("q").alias("q")).select("site", "d", "q", "filled"))


@query("ts15_forest")
def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(impute.forest_fill(px.gappy(spark, sf_dir)))


@query("ts16_join", f"WITH {px.SQL_GAPPY}, p AS (SELECT CAST(o_orderkey % 5 AS VARCHAR) AS site, CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS p FROM orders GROUP BY 1, 2) SELECT site, d, q, round(p, 4) + 0.0 AS p FROM gappy LEFT JOIN p USING (site, d)")
def join_precipitation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = px.table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 5).cast("string").alias("site"), F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("p"))
    return rounded(repair.joined(px.gappy(spark, sf_dir), p), 4)


@query("ts17_month_values", f"""WITH {px.SQL_GAPPY}, e AS (SELECT *, CASE WHEN day(d) >= 28 AND month(d) % 5 <> 0 THEN q END AS v FROM gappy),
m AS (SELECT site, date_trunc('month', d)::DATE AS m, arg_min(v, d) AS v FROM e WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT e.site, e.d, e.q, e.v, a.v AS end_of_month, b.v AS end_of_last_month FROM e LEFT JOIN m a ON a.site = e.site AND a.m = date_trunc('month', e.d) LEFT JOIN m b ON b.site = e.site AND b.m + INTERVAL 1 MONTH = date_trunc('month', e.d)""")
def month_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = px.gappy(spark, sf_dir).withColumn("v", F.when((F.dayofmonth("d") >= 28) & (F.month("d") % 5 != 0), F.col("q")))
    return repair.month_value(g, "v")


@query("ts18_two_formats", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS sec FROM orders")
def two_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(text, F.lit("+00:00"))).otherwise(text)
    return px.table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(repair.parsed(text)).alias("sec"))


_METHODS = {
    "min_max": "(x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0)", "mean_variance": "(x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0)",
    "z_score": "(x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0)", "flow_index": "ln(1 + q / avg(q) OVER w)", "annual_flow_index": "ln(1 + q / avg(q) OVER (PARTITION BY site, year(d) + (month(d) >= 10)::INT))",
}
for _m, _e in _METHODS.items():
    query(f"nm_{_m}", f"WITH {px.SQL_DAILY} SELECT site, d, round({_e}, 6) + 0.0 AS q FROM (SELECT *, ln(1 + q) AS x FROM daily) WINDOW w AS (PARTITION BY site)")(lambda s, d, m=_m: rounded(normalize.normalized(px.daily(s, d), m)))
_Z = f"{px.SQL_DAILY}, z AS (SELECT site, d, {_METHODS['z_score']} AS q FROM (SELECT *, ln(1 + q) AS x FROM daily) WINDOW w AS (PARTITION BY site))"
_WDAY = "d - make_date(year(d) + (month(d) >= 10)::INT - 1, 10, 1) + 1"
for _mid in ("median", "mean"):
    _f = "avg" if _mid == "mean" else "median"
    query(f"nm8_annualize_{_mid}", f"WITH {_Z} SELECT site, ({_WDAY})::INTEGER AS day, round({_f}(q), 6) + 0.0 AS q FROM z WHERE NOT (month(d) = 2 AND day(d) = 29) GROUP BY 1, 2")(
        lambda s, d, mid=_mid: rounded(normalize.annualized(normalize.normalized(px.daily(s, d), "z_score"), mid))
    )
query("nm8_annualize_calendar", f"WITH {_Z} SELECT site, dayofyear(d)::INTEGER AS day, round(median(q), 6) + 0.0 AS q FROM z WHERE NOT (month(d) = 2 AND day(d) = 29) GROUP BY 1, 2")(
    lambda s, d: rounded(normalize.annualized(normalize.normalized(px.daily(s, d), "z_score"), "median", water=False))
)
_CLIM = f"{_Z}, cl AS (SELECT site, ({_WDAY})::INTEGER AS day, median(q) AS q FROM z WHERE NOT (month(d) = 2 AND day(d) = 29) GROUP BY 1, 2)"


@query("nm9_smooth", f"WITH {_CLIM} SELECT site, day, round(avg(q) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) + 0.0 AS q FROM cl")
def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalize.smoothed(normalize.annualized(normalize.normalized(px.daily(spark, sf_dir), "z_score"))))


_SUPP = f"sd AS (SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), sc AS (SELECT site, ({_WDAY})::INTEGER AS day, median(q) AS q FROM sd WHERE NOT (month(d) = 2 AND day(d) = 29) GROUP BY 1, 2), hy AS (SELECT site % 4 AS cluster, day, avg(q) AS q, count(q) AS n_sites FROM sc WHERE site % 4 < 3 GROUP BY 1, 2)"


def hydrograph(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = px.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("q"))
    clusters = px.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), (F.col("s_suppkey") % 4).alias("cluster")).filter("cluster < 3")
    return normalize.cluster_hydrograph(normalize.annualized(s), clusters)


query("nm10_cluster_hydrograph", f"WITH {_SUPP} SELECT cluster, day, round(q, 6) + 0.0 AS q, n_sites, DATE '1999-10-01' + (day - 1) AS label FROM hy")(lambda s, d: rounded(hydrograph(s, d)))
query("nm10_cluster_monthly", f"WITH {_SUPP} SELECT cluster, month(DATE '1999-10-01' + (day - 1))::INTEGER AS month, round(avg(q), 6) + 0.0 AS q FROM hy GROUP BY 1, 2")(lambda s, d: rounded(normalize.cluster_monthly(hydrograph(s, d))))
query("ts8_stationarity")(lambda s, d: rounded(impute.stationarity(px.gappy(s, d))))


@query("io18_cluster_months", """WITH r AS (SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), m AS (SELECT site % 4 AS cluster, site, month(d) AS month, avg(q) AS q FROM r JOIN supplier ON s_suppkey = site WHERE site % 4 < 3 GROUP BY ALL)
SELECT cluster, month::INTEGER AS month, round(avg(q), 6) + 0.0 AS q, count(q) AS n_sites FROM m GROUP BY 1, 2""")
def cluster_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly means by cluster of raw series, as plotted."""
    daily = px.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("q"))
    clusters = px.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), (F.col("s_suppkey") % 4).alias("cluster")).filter("cluster < 3")
    return rounded(normalize.cluster_months(daily, clusters))
