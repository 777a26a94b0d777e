"""Queries on sources, projections, joins, aggregates, windows and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import in_clause, not_leap_day, ratio, rounded, to_id, to_number, water_year
from ..operators import flowstats as fs
from ..operators.graph import shared_folder
from ..operators.prepare import runs
from ..operators.routing import unique_filler
from . import proxies as px
from .registry import query


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/rillspark-io/{uuid.uuid4().hex}"


def _written(spark: SparkSession, df: DataFrame, fmt: str, **options: object) -> str:
    path = _folder(spark) + "/t"
    df.write.format(fmt).options(**options).save(path)
    return path


_CUST = "SELECT c_custkey, c_nationkey, c_acctbal FROM customer"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")


@query("io1_csv", _CUST)
def csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read_csv(spark, _written(spark, _customers(spark, sf_dir), "csv", header=True), "c_custkey long, c_nationkey int, c_acctbal double")


def _site_files(spark: SparkSession, sf_dir: str, sep: str = ",") -> str:
    """A folder with one file per site, named interpolated_<site>.csv."""
    path = _folder(spark) + "/sites"
    px.daily(spark, sf_dir).select(F.col("d").cast("string").alias("datetime"), "q", "site").repartition("site").write.partitionBy("site").option("header", True).option("sep", sep).csv(path)
    fs_ = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    for folder in fs_.listStatus(new(path)):
        name = folder.getPath().getName()
        if name.startswith("site="):
            part = next(f.getPath() for f in fs_.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
            fs_.rename(part, new(f"{path}/interpolated_{name[5:]}.csv"))
            fs_.delete(folder.getPath(), True)
    return path


query("io10_site_files", f"WITH {px.SQL_DAILY} SELECT site, d, q FROM daily")(lambda s, d: sources.read_sites(s, _site_files(s, d), prefix="interpolated_"))
query("io2_date_index", f"WITH {px.SQL_DAILY} SELECT 'interpolated_' || site AS site, d, q FROM daily")(lambda s, d: sources.read_sites(s, _site_files(s, d)))
query("io3_separator", f"WITH {px.SQL_DAILY} SELECT site, d, q FROM daily")(lambda s, d: sources.read_sites(s, _site_files(s, d, ";"), sep=";", prefix="interpolated_"))
query("io16_stems", "SELECT DISTINCT l_returnflag AS name FROM lineitem")(lambda s, d: sources.stems(s, _site_files(s, d), "interpolated_"))
@query("io4_workbooks", "SELECT n_nationkey::DOUBLE AS n_nationkey, n_name, n_regionkey::DOUBLE AS n_regionkey, CASE WHEN n_nationkey % 4 <> 0 THEN n_name || ' & <' || n_nationkey || '>' END AS note FROM nation")
def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each region, written and read back."""
    note = F.when(F.col("n_nationkey") % 4 != 0, F.concat("n_name", F.lit(" & <"), "n_nationkey", F.lit(">")))
    folder = _folder(spark) + "/books"
    sources.write_workbooks(px.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey", note.alias("note")), folder, "n_regionkey").count()
    return sources.read_workbooks(spark, folder)


query("io5_parquet", "SELECT * FROM nation")(lambda s, d: sources.read_table(s, f"{d}/nation.parquet"))
query("io8_large_scan", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 45")(lambda s, d: px.table(s, d, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_partkey"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("io9_catalog", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table that the catalog lists under the given names, with its rows counted."""
    for name in _TABLES:
        px.table(spark, sf_dir, name).createOrReplaceTempView(name)
    out = None
    for name in sources.tables(spark):
        if name in _TABLES:
            one = spark.table(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
            out = one if out is None else out.unionByName(one)
    return out


@query("io11_csv_sink", _CUST)
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) + "/out"
    sources.write_csv(_customers(spark, sf_dir), path)
    return sources.read_csv(spark, path, "c_custkey long, c_nationkey int, c_acctbal double")


@query("io12_parquet_sink", "SELECT c_custkey, c_mktsegment FROM customer")
def parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) + "/out"
    sources.write_columns(px.table(spark, sf_dir, "customer"), path, "c_custkey", "c_mktsegment", "not_there")
    return spark.read.parquet(path)


@query("io14_compiled", f"WITH {px.SQL_SCOPED} SELECT site AS site_name, round(avg(q), 6) + 0.0 AS mean_q FROM sc WHERE scope = 'all_years' GROUP BY 1")
def compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = fs.gathered(px.years(spark, sf_dir), [F.avg("q").alias("mean_q")])
    return rounded(sources.write_sites(stats, _folder(spark) + "/sites"))


@query("io15_cleaned_series", f"WITH {px.SQL_YEARS} SELECT site, d, round(q, 6) + 0.0 AS q FROM years")
def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, px.years(spark, sf_dir).select("site", "d", "q"), "csv", header=True)
    return rounded(sources.read_csv(spark, path, "site string, d date, q double"))


@query("io17_copy_listed", f"WITH {px.SQL_DAILY} SELECT site, d, q FROM daily WHERE site IN ('A', 'R')")
def copy_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark) + "/listed"
    sources.copy_listed(px.daily(spark, sf_dir), ["A", "R", "Z"], path)
    return spark.read.schema("d date, q double, site string").option("header", True).csv(path).select("site", "d", "q")


_C = "customer"
query("pf1_prune", "SELECT c_custkey, c_name FROM customer")(lambda s, d: px.table(s, d, _C).select("c_custkey", "c_name"))
query("pf2_optional_columns", "SELECT c_custkey, c_acctbal FROM customer")(lambda s, d: (lambda t: t.select(*[c for c in ("c_custkey", "absent", "c_acctbal") if c in t.columns]))(px.table(s, d, _C)))
query("pf3_headers", "SELECT c_custkey AS custkey, c_name AS name FROM customer")(
    lambda s, d: (lambda t: t.toDF(*[c.strip().lower() for c in t.columns]))(px.table(s, d, _C).select(F.col("c_custkey").alias(" CustKey "), F.col("c_name").alias("NAME")))
)
query("pf4_numbers", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_retailprice END AS price, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS id FROM part")(
    lambda s, d: px.table(s, d, "part").select(
        "p_partkey", to_number(F.when(F.col("p_partkey") % 3 == 0, "bad").otherwise(F.col("p_retailprice").cast("string"))).alias("price"),
        to_id(F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(".0")))).alias("id"),
    )
)


@query("pf5_clean_vaa", f"""WITH {px.SQL_NETWORK}, r AS (SELECT comid, CASE WHEN comid % 4 <> 0 THEN hydroseq END AS h, CASE WHEN comid % 6 <> 0 THEN divergence END AS v FROM net)
SELECT comid, coalesce(v, 0) AS divergence, (coalesce(h, (SELECT max(h) FROM r) + row_number() OVER (PARTITION BY h IS NULL ORDER BY comid)))::BIGINT AS hydroseq FROM r""")
def clean_vaa(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = px.network(spark, sf_dir).select("comid", F.when(F.col("comid") % 4 != 0, F.col("hydroseq")).alias("hydroseq"), F.when(F.col("comid") % 6 != 0, F.col("divergence")).alias("divergence"))
    return unique_filler(r, "hydroseq", "comid").withColumn("divergence", F.coalesce("divergence", F.lit(0)))


query("pf6_ranges", "SELECT o_orderkey FROM orders WHERE NOT CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'")(
    lambda s, d: px.table(s, d, "orders").filter(~F.to_date("o_orderdate").between(F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"))).select("o_orderkey")
)
query("pf7_leap_days", "SELECT o_orderkey FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)")(lambda s, d: px.table(s, d, "orders").filter(not_leap_day(F.col("o_orderdate"))).select("o_orderkey"))
query("pf8_floor", "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN greatest(c_acctbal, 1e-6) END AS v FROM customer")(
    lambda s, d: px.table(s, d, _C).select("c_custkey", F.when((F.col("c_custkey") % 5 != 0), F.greatest("c_acctbal", F.lit(1e-6))).alias("v"))
)
query("pf9_filters", f"WITH {px.SQL_NETWORK} SELECT comid FROM net WHERE ismainstem = 1 AND divergence <> 2 AND streamorde IN (2, 3) AND tocomid IS NOT NULL")(
    lambda s, d: px.network(s, d).filter((F.col("ismainstem") == 1) & (F.col("divergence") != 2) & F.col("streamorde").isin(2, 3) & F.col("tocomid").isNotNull()).select("comid")
)
query("pf10_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'O''NEILL', 'MACHINERY') AND c_nationkey IN (1, 5, 9)")(
    lambda s, d: px.table(s, d, _C).filter(in_clause("c_mktsegment", ["BUILDING", "O'NEILL", "MACHINERY"])).filter(in_clause("c_nationkey", [1, 5, 9])).select("c_custkey", "c_mktsegment")
)
query("pf11_sentinels", f"WITH {px.SQL_NETWORK} SELECT a.comid, b.comid AS tocomid FROM net a LEFT JOIN (SELECT comid FROM net WHERE comid % 10 <> 0) b ON a.tocomid = b.comid")(
    lambda s, d: (lambda n: n.select("comid", "tocomid").join(n.filter("comid % 10 <> 0").select(F.col("comid").alias("in")), F.col("tocomid") == F.col("in"), "left").select("comid", F.col("in").alias("tocomid")))(px.network(s, d))
)
query("pf14_head", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")(lambda s, d: px.table(s, d, _C).orderBy("c_custkey").limit(10).select("c_custkey", "c_name"))
for _sm in (10, 1):
    query(f"pf15_water_year_{_sm}", f"SELECT o_orderkey, (year(o_orderdate) + (month(o_orderdate) >= {_sm})::INT)::INTEGER AS wy FROM orders")(lambda s, d, sm=_sm: px.table(s, d, "orders").select("o_orderkey", water_year(F.col("o_orderdate"), sm).alias("wy")))

_O = "orders"
query("j1_left", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 = 0")(
    lambda s, d: px.table(s, d, _O).join(px.table(s, d, _C).filter("c_custkey % 3 = 0"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")
)
query("j2_left_suffix", "SELECT s_suppkey, s_nationkey, n_nationkey AS nationkey_vaa, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")(
    lambda s, d: px.table(s, d, "supplier").join(px.table(s, d, "nation").withColumnRenamed("n_nationkey", "nationkey_vaa"), F.col("s_nationkey") == F.col("nationkey_vaa"), "left").select("s_suppkey", "s_nationkey", "nationkey_vaa", "n_name")
)
query("j3_aligned", f"WITH {px.SQL_DAILY}, p AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS k FROM orders GROUP BY 1) SELECT site, d, q, k FROM daily LEFT JOIN p USING (d)")(
    lambda s, d: px.daily(s, d).join(px.table(s, d, _O).groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("k")), "d", "left").select("site", "d", "q", "k")
)
query("j4_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")(
    lambda s, d: px.table(s, d, "lineitem").join(px.table(s, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")
)
query("j5_semi_duplicates", "SELECT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")(
    lambda s, d: px.table(s, d, _O).join(px.table(s, d, _C).filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_custkey")
)
query("j6_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda s, d: px.table(s, d, _C).join(px.table(s, d, _O).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey"))
query("j7_lookup_first", f"WITH {px.SQL_NETWORK}, l AS (SELECT c_nationkey % 20 AS h, arg_min(c_acctbal, c_custkey) AS v FROM customer GROUP BY 1) SELECT comid, coalesce(v, -1.0) AS v FROM net LEFT JOIN l ON huc12 % 50 = h")(
    lambda s, d: px.network(s, d).select("comid", (F.col("huc12") % 50).alias("h")).join(px.table(s, d, _C).groupBy((F.col("c_nationkey") % 20).alias("h")).agg(F.min_by("c_acctbal", "c_custkey").alias("v")), "h", "left").select("comid", F.coalesce("v", F.lit(-1.0)).alias("v"))
)
query("j12_conditional", "SELECT p_partkey, CASE WHEN p_size > 25 THEN up ELSE lo END AS v FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS up FROM lineitem GROUP BY 1) ON p_partkey = l_partkey LEFT JOIN (SELECT l_partkey AS k, min(l_quantity) AS lo FROM lineitem GROUP BY 1) ON p_partkey = k")(
    lambda s, d: px.table(s, d, "part").join(px.table(s, d, "lineitem").groupBy("l_partkey").agg(F.max("l_quantity").alias("up"), F.min("l_quantity").alias("lo")), F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.when(F.col("p_size") > 25, F.col("up")).otherwise(F.col("lo")).alias("v"))
)
query("j15_padded_keys", "SELECT p_partkey, lpad(p_partkey::VARCHAR, 12, '0') AS k FROM part")(
    lambda s, d: px.table(s, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("k")).withColumn("k", F.when(F.col("k").rlike("^[0-9]{1,11}$"), F.lpad("k", 12, "0")).otherwise(F.col("k")))
)
query("j16_field", "SELECT s_suppkey, round(m, 6) + 0.0 AS mean_q FROM supplier LEFT JOIN (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey")(
    lambda s, d: rounded(px.table(s, d, "supplier").join(px.table(s, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("mean_q")), F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "mean_q"))
)

_L = "lineitem"
query("ag1_groups", "SELECT l_returnflag, round(avg(l_quantity), 6) + 0.0 AS mean, round(median(l_extendedprice), 6) + 0.0 AS median, max(l_tax) AS max, count(*) AS n, min(l_shipdate)::DATE AS first FROM lineitem GROUP BY 1")(
    lambda s, d: rounded(px.table(s, d, _L).groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean"), F.median("l_extendedprice").alias("median"), F.max("l_tax").alias("max"), F.count("*").alias("n"), F.to_date(F.min("l_shipdate")).alias("first")))
)
query("ag2_several_targets", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1 HAVING n > 1")(lambda s, d: px.table(s, d, _O).groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("n")).filter("n > 1"))
query("ag3_value_counts", "SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1")(lambda s, d: px.table(s, d, _O).groupBy(F.col("o_orderpriority").alias("v")).agg(F.count("*").alias("n")))
query("ag4_keep_largest", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")(lambda s, d: px.table(s, d, _O).groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")))
query("ag5_dedupe", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")(
    lambda s, d: px.table(s, d, _O).groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.min_by("o_totalprice", "o_orderkey").alias("o_totalprice"))
)
query("ag6_duplicates", "SELECT count(*) - count(DISTINCT o_custkey) AS n FROM orders")(lambda s, d: px.table(s, d, _O).agg((F.count("*") - F.count_distinct("o_custkey")).alias("n")))
query("ag7_percentiles", "SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1")(
    lambda s, d: rounded(px.table(s, d, _L).groupBy("l_linestatus").agg(F.percentile("l_extendedprice", 0.25).alias("p25"), F.percentile("l_extendedprice", 0.9).alias("p90")))
)
query("ag8_deviations", "SELECT l_suppkey, round(stddev_samp(l_quantity), 6) AS s, round(stddev_pop(l_quantity), 6) AS p FROM lineitem GROUP BY 1")(
    lambda s, d: rounded(px.table(s, d, _L).groupBy("l_suppkey").agg(F.stddev_samp("l_quantity").alias("s"), F.stddev_pop("l_quantity").alias("p")))
)
query("ag9_crosstab", "SELECT month(l_shipdate)::INTEGER AS m, floor(l_quantity / 10)::BIGINT AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")(
    lambda s, d: px.table(s, d, _L).groupBy(F.month("l_shipdate").alias("m"), F.floor(F.col("l_quantity") / 10).alias("b")).agg(F.count("*").alias("n"))
)
query("ag10_weighted", "SELECT l_partkey, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 4) + 0.0 AS m FROM lineitem GROUP BY 1")(
    lambda s, d: rounded(px.table(s, d, _L).groupBy("l_partkey").agg(ratio(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), F.sum("l_quantity")).alias("m")), 4)
)
query("ag12_years_and_total", f"WITH {px.SQL_DAILY} SELECT site, year(d)::INTEGER AS y, sum(q) AS q FROM daily GROUP BY GROUPING SETS ((site, year(d)), (site))")(
    lambda s, d: (lambda t: t.groupingSets([["site", "y"], ["site"]], "site", "y").agg(F.sum("q").alias("q")))(px.daily(s, d).withColumn("y", F.year("d")))
)
query("ag13_second_level", f"WITH {px.SQL_DAILY} SELECT site, round(avg(m), 6) AS mean, round(median(m), 6) AS median FROM (SELECT site, year(d), max(q) AS m FROM daily GROUP BY 1, 2) GROUP BY 1")(
    lambda s, d: rounded(px.daily(s, d).groupBy("site", F.year("d").alias("y")).agg(F.max("q").alias("m")).groupBy("site").agg(F.avg("m").alias("mean"), F.median("m").alias("median")))
)
query("ag14_first_extreme", f"WITH {px.SQL_DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY q DESC, d) AS a, row_number() OVER (PARTITION BY site ORDER BY q, d) AS b FROM daily) SELECT site, max(d) FILTER (a = 1) AS top, max(d) FILTER (b = 1) AS low FROM r GROUP BY 1")(
    lambda s, d: px.daily(s, d).groupBy("site").agg(F.max_by("d", F.struct("q", F.datediff(F.lit("2100-01-01").cast("date"), "d"))).alias("top"), F.min_by("d", F.struct("q", "d")).alias("low"))
)
query("ag15_row_means", f"WITH {px.SQL_GAPPY} SELECT d, round(avg(q), 6) AS q FROM gappy GROUP BY 1")(lambda s, d: rounded(px.gappy(s, d).groupBy("d").agg(F.avg("q").alias("q"))))
query("ag16_lists", "SELECT n_regionkey, list_sort(list(n_nationkey))::VARCHAR AS nations FROM nation GROUP BY 1")(lambda s, d: px.table(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).cast("string").alias("nations")))
query("ag18_zones", "SELECT p_brand, round(avg(p_retailprice), 6) + 0.0 AS mean, round(median(p_retailprice), 6) AS median FROM part GROUP BY 1")(
    lambda s, d: rounded(px.table(s, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean"), F.median("p_retailprice").alias("median")))
)



def _sw() -> Window:
    return Window.partitionBy("site").orderBy("d")


_OVER = "OVER (PARTITION BY site ORDER BY d"
for _n in (3, 30):
    query(f"w1_rolling_{_n}", f"WITH {px.SQL_DAILY} SELECT site, d, round(CASE WHEN count(q) {_OVER} ROWS {_n - 1} PRECEDING) = {_n} THEN avg(q) {_OVER} ROWS {_n - 1} PRECEDING) END, 6) + 0.0 AS r FROM daily")(
        lambda s, d, n=_n: rounded(px.daily(s, d).select("site", "d", F.when(F.count("q").over(_sw().rowsBetween(1 - n, 0)) == n, F.avg("q").over(_sw().rowsBetween(1 - n, 0))).alias("r")))
    )
query("w2_rolling_partial", f"WITH {px.SQL_DAILY} SELECT site, d, round(avg(q) {_OVER} ROWS 6 PRECEDING), 6) + 0.0 AS r FROM daily")(lambda s, d: rounded(px.daily(s, d).select("site", "d", F.avg("q").over(_sw().rowsBetween(-6, 0)).alias("r"))))
query("w3_centred", f"WITH {px.SQL_DAILY} SELECT site, d, round(avg(q) {_OVER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) + 0.0 AS r FROM daily")(lambda s, d: rounded(px.daily(s, d).select("site", "d", F.avg("q").over(_sw().rowsBetween(-3, 3)).alias("r"))))
query("w4_difference", f"WITH {px.SQL_DAILY} SELECT site, d, q - lag(q) {_OVER}) AS x FROM daily")(lambda s, d: px.daily(s, d).select("site", "d", (F.col("q") - F.lag("q").over(_sw())).alias("x")))
query("w5_lags", f"WITH {px.SQL_DAILY} SELECT site, d, lag(q, 1) {_OVER}) AS a, lag(q, 2) {_OVER}) AS b, lead(q, 1) {_OVER}) AS c, lead(q, 2) {_OVER}) AS e FROM daily")(
    lambda s, d: px.daily(s, d).select("site", "d", F.lag("q", 1).over(_sw()).alias("a"), F.lag("q", 2).over(_sw()).alias("b"), F.lead("q", 1).over(_sw()).alias("c"), F.lead("q", 2).over(_sw()).alias("e"))
)
query("w6_turns", f"WITH {px.SQL_DAILY}, x AS (SELECT site, d, sign(q - lag(q) {_OVER})) AS s FROM daily), y AS (SELECT site, s * lag(s) {_OVER}) AS p FROM x) SELECT site, count(*) FILTER (p < 0) AS n FROM y GROUP BY 1")(
    lambda s, d: px.daily(s, d).withColumn("s", F.signum(F.col("q") - F.lag("q").over(_sw()))).withColumn("p", F.col("s") * F.lag("s").over(_sw())).groupBy("site").agg(F.count_if(F.col("p") < 0).alias("n"))
)


@query("w7_islands", f"WITH {px.SQL_DAILY}, x AS (SELECT site, d, q, row_number() {_OVER}) AS k FROM daily), y AS (SELECT *, k - row_number() {_OVER}) AS g FROM x WHERE q > 250) SELECT site, min(d) AS first, max(d) AS last, count(*) AS n FROM y GROUP BY site, g")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(px.daily(spark, sf_dir), ["site"], "d", F.col("q") > 250)


query("w8_run_ids", f"WITH {px.SQL_DAILY}, x AS (SELECT site, d, q > 250 AS f, lag(q > 250) {_OVER}) AS g FROM daily) SELECT site, d, sum(CASE WHEN g IS NULL OR f <> g THEN 1 ELSE 0 END) {_OVER})::BIGINT AS run FROM x")(
    lambda s, d: px.daily(s, d).withColumn("f", F.col("q") > 250).withColumn("c", (~F.col("f").eqNullSafe(F.lag("f").over(_sw()))).cast("long")).select("site", "d", F.sum("c").over(_sw()).alias("run"))
)
query("w9_forward_fill", f"WITH {px.SQL_DAILY}, x AS (SELECT site, d, CASE WHEN day(d) % 4 <> 0 THEN q END AS q FROM daily) SELECT site, d, last_value(q IGNORE NULLS) OVER (PARTITION BY site, year(d) ORDER BY d) AS q FROM x")(
    lambda s, d: px.daily(s, d).withColumn("q", F.when(F.dayofmonth("d") % 4 != 0, F.col("q"))).select("site", "d", F.last("q", ignorenulls=True).over(Window.partitionBy("site", F.year("d")).orderBy("d")).alias("q"))
)
query("w10_index_in_year", f"WITH {px.SQL_DAILY} SELECT site, d, (row_number() OVER (PARTITION BY site, year(d) ORDER BY d))::INTEGER AS k FROM daily")(lambda s, d: px.daily(s, d).select("site", "d", F.row_number().over(Window.partitionBy("site", F.year("d")).orderBy("d")).alias("k")))
query("w11_partition_mean", f"WITH {px.SQL_DAILY} SELECT site, d, round(q / avg(q) OVER (PARTITION BY site, year(d)), 6) + 0.0 AS x FROM daily")(lambda s, d: rounded(px.daily(s, d).select("site", "d", (F.col("q") / F.avg("q").over(Window.partitionBy("site", F.year("d")))).alias("x"))))
query("w12_ranks", f"WITH {px.SQL_DAILY} SELECT site, d, (row_number() OVER (PARTITION BY site ORDER BY q, d))::INTEGER AS k FROM daily")(lambda s, d: px.daily(s, d).select("site", "d", F.row_number().over(Window.partitionBy("site").orderBy("q", "d")).alias("k")))
query("s1_sort", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey")(lambda s, d: px.table(s, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey"))
query("s2_total_first", f"WITH {px.SQL_SCOPED} SELECT site, scope, count(*) AS n FROM sc GROUP BY 1, 2 ORDER BY site, scope = 'all_years' DESC, scope")(
    lambda s, d: fs.gathered(px.years(s, d), [F.count("*").alias("n")]).orderBy("site", F.desc(F.col("scope") == "all_years"), "scope")
)
_PINNED = "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7 <> 3, c_custkey)"
query("s3_pinned_first", f"SELECT c_nationkey, c_custkey, ({_PINNED})::INTEGER AS place, first_value(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7 <> 3, c_custkey) AS name FROM customer ORDER BY c_nationkey, place")(
    lambda s, d: (lambda w: px.table(s, d, _C).select("c_nationkey", "c_custkey", F.row_number().over(w).alias("place"), F.first("c_name").over(w).alias("name")).orderBy("c_nationkey", "place"))(
        Window.partitionBy("c_nationkey").orderBy(F.col("c_custkey") % 7 != 3, "c_custkey")
    )
)
query("u1_union_all", "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")(
    lambda s, d: px.table(s, d, _C).select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")).unionByName(px.table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), allowMissingColumns=True)
)
query("u2_union_distinct", "SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier")(lambda s, d: px.table(s, d, _C).select(F.col("c_custkey").alias("k")).union(px.table(s, d, "supplier").select("s_suppkey")).distinct())
query("u3_intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")(lambda s, d: px.table(s, d, _C).select(F.col("c_custkey").alias("k")).intersect(px.table(s, d, _O).select("o_custkey")))
query("u4_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")(lambda s, d: px.table(s, d, _C).select(F.col("c_custkey").alias("k")).subtract(px.table(s, d, _O).select("o_custkey")))
query("u5_fallback", f"WITH {px.SQL_NETWORK} SELECT comid, coalesce(CASE WHEN comid % 5 = 0 THEN tocomid END, CASE WHEN comid % 3 = 0 THEN 0 END, CASE WHEN comid % 2 = 0 THEN huc12 END, -1) AS target FROM net")(
    lambda s, d: px.network(s, d).select("comid", F.coalesce(F.when(F.col("comid") % 5 == 0, F.col("tocomid")), F.when(F.col("comid") % 3 == 0, F.lit(0)), F.when(F.col("comid") % 2 == 0, F.col("huc12")), F.lit(-1)).alias("target"))
)
