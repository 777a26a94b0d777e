"""Queries on basin attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import basin, repair
from . import proxies as px
from .registry import query

query("ba2_shape", "SELECT p_partkey, round(p_retailprice * 1000 / 1e6, 6) + 0.0 AS area_km2, round(p_size * 10.0 / 1e3, 6) + 0.0 AS perimeter_km, round(4 * pi() * p_retailprice * 1000 / nullif(p_size * 10.0 * p_size * 10.0, 0), 6) + 0.0 AS compactness FROM part")(
    lambda s, d: rounded(px.table(s, d, "part").select("p_partkey", *basin.shape(F.col("p_retailprice") * 1000, F.col("p_size") * F.lit(10.0))))
)
query("ba3_merge_named", "SELECT 'HUC_' || c_custkey AS name, c_custkey::VARCHAR AS huc12 FROM customer UNION ALL SELECT 'HUC_' || s_suppkey, s_suppkey::VARCHAR FROM supplier")(
    lambda s, d: px.table(s, d, "customer").select(F.concat(F.lit("HUC_"), "c_custkey").alias("name")).unionByName(px.table(s, d, "supplier").select(F.concat(F.lit("HUC_"), "s_suppkey").alias("name"))).withColumn("huc12", F.split("name", "_")[1])
)
for _m, _f in (("mean", "avg"), ("median", "median")):
    query(f"ba5_zonal_{_m}", f"SELECT p_brand AS zone, round({_f}(p_retailprice), 6) + 0.0 AS value, count(p_retailprice) AS n FROM part GROUP BY 1")(lambda s, d, m=_m: rounded(basin.zonal(px.pixels(s, d), m)))


@query("ba6_transfer", f"WITH {px.SQL_NETWORK} SELECT comid, coalesce(s_acctbal, -1.0) AS v, s_suppkey IS NOT NULL AS updated FROM net LEFT JOIN supplier ON s_suppkey = huc12 AND s_suppkey % 2 = 0")
def transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = px.network(spark, sf_dir).select("comid", "huc12", F.lit(-1.0).alias("v"))
    values = px.table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("huc12"), F.col("s_acctbal").alias("v"))
    return basin.transferred(rows, values, "huc12", "v").select("comid", "v", "updated")


@query("ba7_keys", """WITH a AS (SELECT DISTINCT lpad(c_custkey::VARCHAR, 12, '0') AS key FROM customer), b AS (SELECT DISTINCT lpad((2 * p_partkey)::VARCHAR, 12, '0') AS key FROM part)
SELECT key, 'left' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'right' FROM b WHERE key NOT IN (SELECT key FROM a)""")
def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = px.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    b = px.table(spark, sf_dir, "part").select(F.lpad((2 * F.col("p_partkey")).cast("string"), 12, "0").alias("k"))
    return basin.keys_diagnosis(a, b, "k")


_MAIN = """tp AS (SELECT huc12, levelpathi, count(*) AS k FROM net n WHERE streamorde = (SELECT max(streamorde) FROM net m WHERE m.huc12 = n.huc12) GROUP BY 1, 2),
mn AS (SELECT huc12, arg_max(levelpathi, {'a': k, 'b': -levelpathi}) AS main FROM tp GROUP BY 1), ms AS (SELECT n.comid, n.huc12, (n.levelpathi = main)::INT AS ismainstem FROM net n JOIN mn USING (huc12))"""
query("ba8_mainstem", f"WITH {px.SQL_NETWORK}, {_MAIN} SELECT comid, huc12, ismainstem::INTEGER AS ismainstem FROM ms")(lambda s, d: basin.mainstem(px.network(s, d).drop("ismainstem")).select("comid", "huc12", "ismainstem"))
query("ag11_mode_of_top", f"WITH {px.SQL_NETWORK}, {_MAIN} SELECT huc12, main FROM mn")(
    lambda s, d: basin.mainstem(px.network(s, d).drop("ismainstem")).filter("ismainstem = 1").groupBy("huc12").agg(F.first("levelpathi").alias("main"))
)


def _values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reaches with an old value, values above reaches, local values of HUCs."""
    master = px.network(spark, sf_dir).select("comid", "huc12", "ismainstem", (F.col("comid") % 10).cast("double").alias("v"))
    up = px.table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select((F.col("c_custkey") + 1).alias("comid"), F.round(F.col("c_acctbal") / 1000, 0).alias("v"))
    local = px.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("huc12"), (F.col("s_suppkey") % 10).cast("double").alias("v"))
    return master, up, local


_VALUES = f"""{px.SQL_NETWORK}, ma AS (SELECT comid, huc12, ismainstem, (comid % 10)::DOUBLE AS v FROM net),
ups AS (SELECT c_custkey + 1 AS comid, round(c_acctbal / 1000, 0) AS v FROM customer WHERE c_custkey % 4 <> 0), lo AS (SELECT s_suppkey AS huc12, (s_suppkey % 10)::DOUBLE AS v FROM supplier)"""
query("ba9_local_values", f"WITH {_VALUES} SELECT comid, CASE WHEN ismainstem <> 1 AND lo.v IS NOT NULL THEN lo.v ELSE ma.v END AS v FROM ma LEFT JOIN lo USING (huc12)")(
    lambda s, d: (lambda m, u, lo: basin.local_for_tributaries(m, lo, "v").select("comid", "v"))(*_values(s, d))
)
for _name, _subset in (("ba12_zonal_all", None), ("ba12_zonal_subset", [1, 2, 3, 5, 8])):
    _case = "n" if _subset is None else "CASE WHEN zone IN (1, 2, 3, 5, 8) THEN coalesce(n, v) ELSE v END"
    query(_name, f"WITH z AS (SELECT s_suppkey AS zone, s_acctbal AS v FROM supplier), t AS (SELECT l_suppkey AS zone, round(avg(l_quantity), 6) AS n FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1) SELECT zone, {_case} AS v FROM z LEFT JOIN t USING (zone)")(
        lambda s, d, subset=_subset: basin.zonal_update(
            px.table(s, d, "supplier").select(F.col("s_suppkey").alias("zone"), F.col("s_acctbal").alias("v")),
            rounded(px.table(s, d, "lineitem").filter("l_suppkey % 2 = 0").groupBy(F.col("l_suppkey").alias("zone")).agg(F.avg("l_quantity").alias("value"))), "v", subset,
        )
    )
query("ba11_recalculate", "SELECT p_brand AS zone, round(avg(p_retailprice), 6) + 0.0 AS value FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') GROUP BY 1")(
    lambda s, d: rounded(basin.zonal(px.pixels(s, d).filter(F.col("zone").isin("Brand#11", "Brand#22", "Brand#33"))).select("zone", "value"))
)
query("ba13_area_weighted", f"WITH {px.SQL_OVERLAY} SELECT zone, round(sum(value * area) / sum(area) FILTER (value IS NOT NULL), 4) + 0.0 AS value FROM overlay GROUP BY 1")(lambda s, d: rounded(basin.area_weighted(px.overlay(s, d), "value"), 4))
query("j11_overlay", f"WITH {px.SQL_OVERLAY} SELECT zone, p_brand AS class, sum(area) AS area, round(sum(area * p_retailprice) / sum(area), 4) + 0.0 AS price FROM overlay JOIN part ON p_partkey = src GROUP BY 1, 2")(
    lambda s, d: rounded(px.overlay(s, d).join(px.table(s, d, "part"), F.col("src") == F.col("p_partkey")).groupBy("zone", F.col("p_brand").alias("class")).agg(F.sum("area").alias("area"), (F.sum(F.col("area") * F.col("p_retailprice")) / F.sum("area")).alias("price")), 4)
)


@query("ba14_same_geometry", "SELECT s_suppkey AS zone, s_acctbal AS v FROM supplier")
def same_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = px.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("zone"), F.col("s_acctbal").alias("v"), F.when(F.col("s_suppkey") % 3 == 0, 3).otherwise(6).alias("kind"), F.lit(5070).alias("crs"))
    return basin.direct_transfer(shapes.drop("v"), shapes, "zone", "v").select("zone", "v")


_NEEDED = {"customer": ["c_custkey", "C_ACCTBAL"], "part": ["p_size"], "lineitem": ["l_shipdate", "l_quantity"]}
query("ba10_discovery", " UNION ALL ".join(f"SELECT '{t}' AS source, '{f}' AS field, count({f}) AS n FROM {t}" for t, fields in _NEEDED.items() for f in fields))(lambda s, d: basin.discovered({t: px.table(s, d, t) for t in _NEEDED}, _NEEDED))
_SAFE = "regexp_replace(o_orderpriority || o_orderkey, '[^A-Za-z0-9]', '_', 'g')"
query("ba16_field_names", f"SELECT o_orderkey, CASE WHEN regexp_matches({_SAFE}, '^[A-Za-z]') THEN {_SAFE} ELSE 'f_' || {_SAFE} END AS name FROM orders")(
    lambda s, d: px.table(s, d, "orders").select("o_orderkey", basin.field_names(F.concat("o_orderpriority", "o_orderkey")).alias("name"))
)
_PUSH = f"WITH {_VALUES}, pu AS (SELECT ma.comid, ma.huc12, ma.v AS old, CASE WHEN ismainstem = 1 THEN ups.v ELSE lo.v END AS new FROM ma LEFT JOIN ups USING (comid) LEFT JOIN lo ON lo.huc12 = ma.huc12)"
query("ba15_push", f"{_PUSH} SELECT comid, huc12, old, new + 0.0 AS new FROM pu WHERE old IS DISTINCT FROM new")(lambda s, d: rounded(basin.pushed(*_values(s, d), "v")))
query("ba15_dry_run", f"{_PUSH} SELECT huc12, count(*) AS n FROM pu WHERE old IS DISTINCT FROM new GROUP BY 1")(lambda s, d: basin.dry_run(basin.pushed(*_values(s, d), "v")))
_MONTH_CTE = "m AS (SELECT site, date_trunc('month', d)::DATE AS m, min_by(q, d) AS v FROM gappy WHERE q IS NOT NULL GROUP BY 1, 2)"
query("j13_month_lookup", f"WITH {px.SQL_GAPPY}, {_MONTH_CTE} SELECT g.site, g.d, m.v AS end_of_month FROM gappy g LEFT JOIN m ON m.site = g.site AND m.m = date_trunc('month', g.d)")(lambda s, d: repair.month_value(px.gappy(s, d), "q").select("site", "d", "end_of_month"))
query("j14_last_month_lookup", f"WITH {px.SQL_GAPPY}, {_MONTH_CTE} SELECT g.site, g.d, m.v AS end_of_last_month FROM gappy g LEFT JOIN m ON m.site = g.site AND m.m + INTERVAL 1 MONTH = date_trunc('month', g.d)")(
    lambda s, d: repair.month_value(px.gappy(s, d), "q").select("site", "d", "end_of_last_month")
)


@query("ba16_zone_field", """SELECT 'candidate' AS source, 'P_Brand' AS field, p_brand AS zone, round(avg(p_retailprice), 6) + 0.0 AS value FROM part GROUP BY p_brand UNION ALL SELECT 'usual', 'VALUE', p_brand, round(avg(p_retailprice), 6) + 0.0 FROM part GROUP BY p_brand
UNION ALL SELECT 'first', 'of_brand', p_brand, round(avg(p_retailprice), 6) + 0.0 FROM part GROUP BY p_brand""")
def zone_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zonal tables whose zones come back under another case, a usual name, and neither."""
    zonal, out = basin.zonal(px.pixels(spark, sf_dir)), None
    for source, columns in (("candidate", ("value as mean", "zone as P_Brand")), ("usual", ("n as COUNT", "value as mean", "zone as VALUE")), ("first", ("value as mean", "zone as of_brand", "n as cells"))):
        given = zonal.selectExpr(*columns)
        field = basin.zone_field(given, "p_brand")
        part = given.select(F.lit(source).alias("source"), F.lit(field).alias("field"), F.col(field).alias("zone"), F.col("mean").alias("value"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)
