"""Queries on clustering and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import cart, cluster, tiles
from . import proxies as px
from .registry import query


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, v: mean quantity by month of each supplier, zero where there is none."""
    monthly = px.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.month("l_shipdate").alias("m")).agg(F.avg("l_quantity").alias("x"))
    slots = F.array(*[F.coalesce(F.max(F.when(F.col("m") == m, F.col("x"))), F.lit(0.0)) for m in range(1, 13)])
    return monthly.groupBy("site").agg(slots.alias("v"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).withColumn("cluster", (F.col("site") % 4).cast("int"))


_SQL = """f AS (SELECT s.site, m, coalesce(x, 0) AS x, s.site % 4 AS c FROM (SELECT DISTINCT l_suppkey AS site FROM lineitem) s CROSS JOIN range(1, 13) t(m)
  LEFT JOIN (SELECT l_suppkey AS site, month(l_shipdate) AS m, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2) USING (site, m)),
mid AS (SELECT c, m, avg(x) AS g, count(*) AS n FROM f GROUP BY 1, 2)"""

query("cl1_kmeans")(lambda s, d: cluster.fit(features(s, d), "kmeans", 4))
query("cl2_agglomerative")(lambda s, d: cluster.fit(features(s, d), "agglomerative", 4))
query("cl3_spectral")(lambda s, d: cluster.fit(features(s, d), "spectral", 3))
query("cl5_pca")(lambda s, d: rounded(cluster.pca(features(s, d))[0], 4))
query("cl6_gap_statistic")(lambda s, d: cluster.gap_statistic(features(s, d)))
query("cl7_sweep")(lambda s, d: rounded(cluster.sweep(features(s, d))))
query("cl8_silhouette", f"""WITH {_SQL}, dd AS (SELECT a.site AS a, b.site AS b, a.c AS ca, b.c AS cb, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM f a JOIN f b ON a.m = b.m AND a.site <> b.site GROUP BY ALL),
mm AS (SELECT a, ca, cb, avg(d) AS d FROM dd GROUP BY ALL), pp AS (SELECT a, max(d) FILTER (ca = cb) AS own, min(d) FILTER (ca <> cb) AS other FROM mm GROUP BY 1)
SELECT round(avg(CASE WHEN own IS NULL THEN 0 ELSE coalesce((other - own) / nullif(greatest(own, other), 0), 0) END), 6) + 0.0 AS silhouette FROM pp""")(lambda s, d: rounded(tiles.silhouettes(labelled(s, d).select("site", "cluster"), features(s, d))))
query("cl8_davies_bouldin", f"""WITH {_SQL}, sp AS (SELECT c, avg(e) AS s FROM (SELECT f.c, site, sqrt(sum((x - g) * (x - g))) AS e FROM f JOIN mid ON f.c = mid.c AND f.m = mid.m GROUP BY 1, 2) GROUP BY 1),
cd AS (SELECT a.c AS ca, b.c AS cb, sqrt(sum((a.g - b.g) * (a.g - b.g))) AS d FROM mid a JOIN mid b ON a.m = b.m AND a.c <> b.c GROUP BY 1, 2)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT ca, max((x.s + y.s) / d) AS r FROM cd JOIN sp x ON x.c = ca JOIN sp y ON y.c = cb GROUP BY 1)""")(lambda s, d: rounded(cluster.davies_bouldin(labelled(s, d))))
query("cl8_calinski_harabasz", f"""WITH {_SQL}, g AS (SELECT m, avg(x) AS z FROM f GROUP BY 1), b AS (SELECT sum(n * (mid.g - z) * (mid.g - z)) AS b, count(DISTINCT c) AS k FROM mid JOIN g USING (m)),
w AS (SELECT sum((x - g) * (x - g)) AS w, count(DISTINCT site) AS n FROM f JOIN mid ON f.c = mid.c AND f.m = mid.m) SELECT round(b * (n - k) / (w * (k - 1)), 6) AS calinski_harabasz FROM b, w""")(lambda s, d: rounded(cluster.calinski_harabasz(labelled(s, d))))
query("cl9_dtw_matrix", """WITH RECURSIVE f AS (SELECT s.site, list(coalesce(x, 0) ORDER BY m) AS v FROM (SELECT DISTINCT l_suppkey AS site FROM lineitem) s CROSS JOIN range(1, 13) t(m)
  LEFT JOIN (SELECT l_suppkey AS site, month(l_shipdate) AS m, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2) USING (site, m) GROUP BY 1),
p AS (SELECT a.site AS a, b.site AS b, a.v AS x, b.v AS y FROM f a JOIN f b ON a.site < b.site),
w AS (SELECT a, b, x, y, 0 AS k, list_transform(range(12), lambda i: CASE WHEN i = 0 THEN (x[1] - y[1]) * (x[1] - y[1]) ELSE 'inf'::DOUBLE END) AS one, list_transform(range(12), lambda i: 'inf'::DOUBLE) AS two FROM p
  UNION ALL SELECT a, b, x, y, k + 1, list_transform(range(12), lambda i: CASE WHEN k + 1 - i BETWEEN 0 AND 11
    THEN (x[i + 1] - y[k + 2 - i]) * (x[i + 1] - y[k + 2 - i]) + least(one[i + 1], CASE WHEN i > 0 THEN one[i] ELSE 'inf'::DOUBLE END, CASE WHEN i > 0 THEN two[i] ELSE 'inf'::DOUBLE END) ELSE 'inf'::DOUBLE END), one FROM w WHERE k < 22)
SELECT a, b, round(sqrt(one[12]), 6) + 0.0 AS distance FROM w WHERE k = 22""")(lambda s, d: rounded(cluster.dtw_matrix(features(s, d))))
query("cl10_dtw_kmeans")(lambda s, d: cluster.dtw_clusterings(features(s, d)))


def year_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, v: mean quantity by day of the year of each supplier, 365 points, zero where there is none."""
    daily = px.table(spark, sf_dir, "lineitem").withColumn("day", F.dayofyear("l_shipdate")).filter("day <= 365").groupBy(F.col("l_suppkey").alias("site"), "day").agg(F.avg("l_quantity").alias("x"))
    known = daily.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("day", "x"))).alias("m"))
    return known.select("site", F.transform(F.sequence(F.lit(1), F.lit(365)), lambda day: F.coalesce(F.try_element_at("m", day), F.lit(0.0))).alias("v"))


query("cl9_dtw_year")(lambda s, d: rounded(cluster.dtw_matrix(year_features(s, d))))
query("cl11_year")(lambda s, d: rounded(cluster.time_warp(year_features(s, d).withColumn("variant", F.lit("raw")), range(2, 5))[0]))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant, site, v: each supplier's months as they are, as z-scores, and as shares of their sum."""
    f = features(spark, sf_dir)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    mean = total / F.size("v")
    wide = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (F.size("v") - 1))
    z = F.transform("v", lambda x: F.coalesce(F.try_divide(x - mean, wide), F.lit(0.0)))
    share = F.transform("v", lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0)))
    return f.select(F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), "site", v.alias("v")) for n, v in (("raw", F.col("v")), ("z_score", z), ("share", share))])).alias("x")).select("x.*")


query("cl11_time_warp")(lambda s, d: rounded(cluster.time_warp(variants(s, d).filter("variant = 'raw'"))[0]))
query("cl11_assignments")(lambda s, d: cluster.time_warp(variants(s, d).filter("variant = 'raw'"))[1])
query("cl11_means")(lambda s, d: (lambda m: m.select("variant", "k", "cluster", "n", F.posexplode("m").alias("i", "x")))(cluster.time_warp(variants(s, d).filter("variant = 'raw'"))[2]).withColumn("x", F.round("x", 6)))
query("cl12_time_warp_variants")(lambda s, d: rounded(cluster.time_warp(variants(s, d))[0]))


def tree(spark: SparkSession, sf_dir: str) -> cart.Tree:
    c = px.table(spark, sf_dir, "customer")
    spent = px.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"), F.count("*").alias("n_orders"))
    rows = c.join(spent, "c_custkey", "left").na.fill(0.0, ["spent"]).na.fill(0, ["n_orders"])
    rows = rows.withColumn("class", F.when(F.col("c_custkey") % 9 == 0, "busy").when(F.col("c_acctbal") > 4000, "high").when(F.col("n_orders") > 10, "busy").otherwise("low"))
    return cart.cart(rows, "class", ["c_acctbal", "spent", "n_orders", "c_nationkey"], F.col("c_custkey") % 10 >= 7)


_CLASSES, _FEATURES = ("busy", "high", "low"), ("c_acctbal", "spent", "n_orders", "c_nationkey")


def _sql_split(i: int) -> str:
    """CTEs that find the best split of every node of level i of q{i} and lead its rows on to q{i + 1}."""
    k = range(len(_CLASSES))
    left, right = " + ".join(f"l{c}" for c in k), " + ".join(f"(t{c} - l{c})" for c in k)
    score = f"({' + '.join(f'l{c} * l{c}' for c in k)})::DOUBLE / ({left}) + ({' + '.join(f'(t{c} - l{c}) * (t{c} - l{c})' for c in k)})::DOUBLE / ({right})"
    return f"""
n{i} AS (SELECT node, {", ".join(f"count(*) FILTER (y = {c}) AS t{c}" for c in k)} FROM q{i} WHERE NOT test AND node >= {2**i} GROUP BY 1 HAVING count(DISTINCT y) > 1),
i{i} AS (SELECT node, f, v, {", ".join(f"count(*) FILTER (y = {c}) AS c{c}" for c in k)} FROM (SELECT node, y, unnest([{", ".join(str(f) for f in range(len(_FEATURES)))}]) AS f, unnest([{", ".join(_FEATURES)}]) AS v FROM q{i} WHERE NOT test) GROUP BY ALL),
p{i} AS (SELECT node, f, v, lead(v) OVER w AS after, {", ".join(f"sum(c{c}) OVER w AS l{c}" for c in k)} FROM i{i} WINDOW w AS (PARTITION BY node, f ORDER BY v)),
b{i} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {score} DESC, f, v) AS place FROM p{i} JOIN n{i} USING (node) WHERE after IS NOT NULL AND {left} >= 5 AND {right} >= 5) WHERE place = 1),
q{i + 1} AS MATERIALIZED (SELECT q.* REPLACE (CASE WHEN b.node IS NULL THEN q.node WHEN [{", ".join(f"q.{f}" for f in _FEATURES)}][b.f + 1] <= b.v / 2 + b.after / 2 THEN 2 * q.node ELSE 2 * q.node + 1 END AS node) FROM q{i} q LEFT JOIN b{i} b ON b.node = q.node)"""


_TREE = f"""WITH o AS (SELECT o_custkey AS c_custkey, sum(o_totalprice)::DOUBLE AS spent, count(*)::DOUBLE AS n_orders FROM orders GROUP BY 1),
c AS (SELECT c_custkey, c_acctbal::DOUBLE AS c_acctbal, coalesce(spent, 0)::DOUBLE AS spent, coalesce(n_orders, 0)::DOUBLE AS n_orders, c_nationkey::DOUBLE AS c_nationkey FROM customer LEFT JOIN o USING (c_custkey)),
q0 AS MATERIALIZED (SELECT 1 AS node, c_custkey % 10 >= 7 AS test, CASE WHEN c_custkey % 9 = 0 THEN 0 WHEN c_acctbal > 4000 THEN 1 WHEN n_orders > 10 THEN 0 ELSE 2 END AS y, {", ".join(_FEATURES)} FROM c),{",".join(_sql_split(i) for i in range(5))}"""
_NAMES = f"[{', '.join(repr(c) for c in _CLASSES)}]"
_COUNTS = ", ".join(f"count(*) FILTER (y = {c}) AS c{c}" for c in range(len(_CLASSES)))
query("ct1_tree_predictions", f"""{_TREE}, lf AS (SELECT node, {_COUNTS} FROM q5 WHERE NOT test GROUP BY 1)
SELECT {_NAMES}[y + 1] AS label, CASE WHEN c0 >= c1 AND c0 >= c2 THEN 'busy' WHEN c1 >= c2 THEN 'high' ELSE 'low' END AS predicted FROM q5 JOIN lf USING (node) WHERE test""")(lambda s, d: tree(s, d).predictions)
query("ct1_first_split", f"{_TREE} SELECT {list(_FEATURES)!r}[f + 1] AS feature, round(v / 2 + after / 2, 6) + 0.0 AS threshold FROM b0")(lambda s, d: first_split(s, d))
query("io19_tree_text")(lambda s, d: s.createDataFrame([*enumerate(tree(s, d).text().splitlines())], "line int, text string"))
_GAIN = "(t0 + t1 + t2) * (1 - (t0 * t0 + t1 * t1 + t2 * t2)::DOUBLE / ((t0 + t1 + t2) * (t0 + t1 + t2))) - (l0 + l1 + l2) * (1 - (l0 * l0 + l1 * l1 + l2 * l2)::DOUBLE / ((l0 + l1 + l2) * (l0 + l1 + l2)))"
_GAIN += " - (r0 + r1 + r2) * (1 - (r0 * r0 + r1 * r1 + r2 * r2)::DOUBLE / ((r0 + r1 + r2) * (r0 + r1 + r2)))"
query("ct3_importances", f"""{_TREE}, a AS (SELECT f, l0, l1, l2, t0, t1, t2, t0 - l0 AS r0, t1 - l1 AS r1, t2 - l2 AS r2 FROM ({" UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(5))})),
g AS (SELECT f, sum({_GAIN}) AS g FROM a GROUP BY 1) SELECT name AS feature, round(coalesce(g, 0) / (SELECT sum(g) FROM g), 6) + 0.0 AS importance FROM (SELECT unnest(range(4)) AS i, unnest({list(_FEATURES)!r}) AS name) LEFT JOIN g ON g.f = i""")(lambda s, d: rounded(tree(s, d).importances))


def first_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, threshold of the root."""
    found = tree(spark, sf_dir)
    root = found.nodes[1]
    return rounded(spark.createDataFrame([(found.features[root.feature], root.threshold)], "feature string, threshold double"))


_GUESS = "g AS (SELECT CASE WHEN c_acctbal > 4000 THEN 'high' ELSE 'low' END AS label, CASE WHEN c_custkey % 5 = 0 THEN 'low' WHEN c_acctbal > 3000 THEN 'high' ELSE 'low' END AS predicted FROM customer)"


def guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("c_acctbal") > 4000, "high").otherwise("low")
    return px.table(spark, sf_dir, "customer").select(label.alias("label"), F.when(F.col("c_custkey") % 5 == 0, "low").when(F.col("c_acctbal") > 3000, "high").otherwise("low").alias("predicted"))


query("ct2_confusion", f"WITH {_GUESS} SELECT label, predicted, count(*) AS n FROM g GROUP BY 1, 2")(lambda s, d: cart.confusion(guesses(s, d)))
query("ct2_report", f"""WITH {_GUESS}, a AS (SELECT label, count(*) AS support, count(*) FILTER (label = predicted) AS hit FROM g GROUP BY 1), b AS (SELECT predicted AS label, count(*) AS guessed FROM g GROUP BY 1)
SELECT label, round(hit / guessed, 6) + 0.0 AS precision, round(hit / support, 6) + 0.0 AS recall, round(2.0 * (hit / guessed) * (hit / support) / (hit / guessed + hit / support), 6) + 0.0 AS f1, support FROM a JOIN b USING (label)""")(
    lambda s, d: rounded(cart.report(guesses(s, d)))
)
