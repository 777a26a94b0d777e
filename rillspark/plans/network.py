"""Queries on routing and upstream traversal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, routing
from . import proxies as px
from .registry import query

_NET = px.SQL_NETWORK
_VALID = "valid AS (SELECT comid AS id FROM net WHERE comid % 3 <> 0)"


def _walk(start: str, valid: str, most: int, name: str = "walk") -> str:
    """id, target, hops of a bounded walk; start and valid are SQL for sets of id. pos is tested at hops 0 to most - 1."""
    return f"""{name}0 AS (SELECT s.id, n.tocomid AS pos, 0 AS hops FROM ({start}) s LEFT JOIN net n ON n.comid = s.id
  UNION ALL SELECT w.id, n.tocomid, w.hops + 1 FROM {name}0 w LEFT JOIN net n ON n.comid = w.pos WHERE w.pos IS NOT NULL AND w.hops < {most} - 1 AND w.pos NOT IN ({valid})),
{name}1 AS (SELECT id, max(CASE WHEN pos IN ({valid}) THEN pos END) AS target, max(CASE WHEN pos IN ({valid}) THEN hops END) AS found, max(CASE WHEN pos IS NULL THEN CASE WHEN hops = 0 THEN -1 ELSE hops END END) AS left_at FROM {name}0 GROUP BY 1),
{name} AS (SELECT id, target, coalesce(found, left_at, {most}) AS hops FROM {name}1)"""


@query("nr9_hop_walk", f"WITH RECURSIVE {_NET}, {_VALID}, {_walk('SELECT comid AS id FROM net', 'SELECT id FROM valid', 15)} SELECT id, coalesce(target, -1) AS target, hops::INTEGER AS hops FROM walk")
def hop_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = px.network(spark, sf_dir)
    ids = n.select(F.col("comid").alias("id"))
    return graph.hop_walk(ids, n, ids.filter("id % 3 <> 0"))


@query("nr9_hop_walk_short", f"WITH RECURSIVE {_NET}, {_walk('SELECT comid AS id FROM net', 'SELECT comid FROM net WHERE comid < 4', 3)} SELECT id, target, hops::INTEGER AS hops FROM walk")
def hop_walk_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = px.network(spark, sf_dir)
    ids = n.select(F.col("comid").alias("id"))
    return graph.hop_walk(ids, n, ids.filter("id < 4"), 3, None)


@query("nr1_merge_regions", "SELECT c_custkey AS comid, n_name AS name, r.c_custkey % 2 AS region FROM customer r JOIN nation ON n_nationkey = c_nationkey")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = px.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("comid"), "c_nationkey")
    names = px.table(spark, sf_dir, "nation")
    parts = [c.filter(F.col("comid") % 2 == k) for k in (0, 1)]
    more = [p.join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("comid", F.col("n_name").alias("name"), F.lit(k).cast("long").alias("region")) for k, p in enumerate(parts)]
    return routing.merge_regions([p.select("comid") for p in parts], more)


query("nr3_split", f"WITH {_NET} SELECT comid, divergence = 2 AS divergent FROM net")(
    lambda s, d: (lambda a, b: a.select("comid", F.lit(False).alias("divergent")).unionByName(b.select("comid", F.lit(True).alias("divergent"))))(*routing.split_divergent(px.network(s, d)))
)
#: Nodes shared by pairs of reaches, so that a node has something to choose.
_PAIRED = f"""{_NET.replace("net AS", "raw AS", 1)}, net AS (SELECT comid, tocomid, comid // 2 AS fromnode, comid // 4 AS tonode, divergence, streamorde, streamcalc, hydroseq FROM raw)"""
_BACKBONE = """bb0 AS (SELECT comid, fromnode, tonode, row_number() OVER (PARTITION BY fromnode ORDER BY streamcalc * 1000 + streamorde * 100 - hydroseq / 1e9 DESC, comid) AS k FROM net WHERE divergence <> 2),
bb AS (SELECT a.comid, a.fromnode, a.tonode, b.comid AS tocomid FROM bb0 a LEFT JOIN bb0 b ON b.fromnode = a.tonode AND b.k = 1 WHERE a.k = 1)"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.network(spark, sf_dir).withColumn("fromnode", F.expr("comid div 2")).withColumn("tonode", F.expr("comid div 4"))


query("nr5_backbone", f"WITH {_PAIRED}, {_BACKBONE} SELECT comid, fromnode, tonode, tocomid FROM bb")(lambda s, d: routing.backbone(paired(s, d)))
query("j8_node_join", f"WITH {_PAIRED} SELECT fromnode AS tonode, arg_min(comid, {{'a': hydroseq, 'b': comid}}) AS target FROM net GROUP BY 1")(lambda s, d: routing.node_map(paired(s, d)))


@query("nr6_patch", f"WITH {_PAIRED}, m AS (SELECT fromnode, arg_min(comid, {{'a': hydroseq, 'b': comid}}) AS target FROM net GROUP BY 1) SELECT comid, coalesce(CASE WHEN comid % 3 <> 0 THEN tocomid END, target) AS tocomid FROM net LEFT JOIN m ON m.fromnode = net.tonode")
def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = paired(spark, sf_dir)
    return routing.patched(n.select("comid", F.when(F.col("comid") % 3 != 0, F.col("tocomid")).alias("tocomid")), n)


_ASIDE = "SELECT comid AS id FROM net WHERE divergence = 2 AND comid NOT IN (SELECT comid FROM bb)"
_DIVERGENT = f"""{_walk(_ASIDE, "SELECT comid FROM bb", 20)},
dv AS (SELECT n.comid, coalesce(b.comid, w.target) AS tocomid FROM net n JOIN walk w ON w.id = n.comid LEFT JOIN bb b ON b.fromnode = n.tonode)"""


@query("nr7_divergent_targets", f"WITH RECURSIVE {_PAIRED}, {_BACKBONE}, {_DIVERGENT} SELECT comid, tocomid FROM dv")
def divergent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = paired(spark, sf_dir)
    return routing.divergent_targets(n, routing.backbone(n))


_DENDRITIC = f"WITH RECURSIVE {_PAIRED}, {_BACKBONE}, {_DIVERGENT}, de AS (SELECT comid, tocomid, false AS divergent FROM bb UNION ALL SELECT comid, tocomid, true FROM dv)"
query("nr8_dendritic", f"{_DENDRITIC} SELECT comid, tocomid, divergent, tocomid IS NULL AS terminal FROM de")(lambda s, d: routing.dendritic(paired(s, d)))
query("nr8_terminal_list", f"{_DENDRITIC} SELECT comid FROM de WHERE tocomid IS NULL")(lambda s, d: routing.dendritic(paired(s, d)).filter("terminal").select("comid"))

def catchment_sql(more: str, catchments: str, near: str) -> str:
    """CTEs up to rt, the routed catchments: more holds what the sets of id and of a, b, shared_len read."""
    return f"""WITH RECURSIVE {_NET}, {more}, cat AS ({catchments}),
en AS (SELECT comid AS id FROM net WHERE comid % 97 = 0), {_walk("SELECT id FROM cat", "SELECT id FROM cat", 15)},
b0 AS (SELECT c.id, n.comid IS NOT NULL AS known, n.tocomid, en.id IS NOT NULL AS ended, w.target, w.hops FROM cat c LEFT JOIN net n ON n.comid = c.id LEFT JOIN en ON en.id = c.id JOIN walk w ON w.id = c.id),
b1 AS (SELECT *, CASE WHEN ended OR (known AND tocomid IS NULL) THEN 'terminal' WHEN target IS NOT NULL THEN 'routed' WHEN known THEN 'unresolved' END AS status FROM b0),
b2 AS (SELECT id, CASE WHEN status = 'terminal' THEN 0 ELSE coalesce(target, -1) END AS target, CASE WHEN ended THEN -1 WHEN status = 'terminal' THEN 0 WHEN known THEN hops END AS hops, status FROM b1),
a0 AS ({near}), a2 AS (SELECT * FROM a0 UNION ALL SELECT b, a, shared_len FROM a0),
nr AS (SELECT a.a AS id, max(shared_len) AS longest, arg_max(d.target, {{'a': shared_len, 'b': -a.b}}) AS given FROM a2 a JOIN b2 d ON d.id = a.b AND d.status IN ('routed', 'terminal') GROUP BY 1),
rt AS (SELECT b2.id AS featureid, CASE WHEN status IS NULL AND longest > 0 THEN given ELSE target END AS target, hops, coalesce(status, CASE WHEN longest IS NULL THEN 'no_candidates' WHEN longest <= 0 THEN 'no_shared_boundary' ELSE 'resolved' END) AS status FROM b2 LEFT JOIN nr USING (id))"""


_CATCH = catchment_sql(px.SQL_ADJACENCY, "SELECT comid AS id FROM net WHERE comid % 3 <> 0 UNION ALL SELECT -comid FROM net WHERE comid % 11 = 0", "SELECT -a AS a, b, shared_len FROM adj WHERE a % 11 = 0 AND a % 2 = 0")


@query("nr10_nr11_catchments", f"{_CATCH} SELECT featureid, target, hops::INTEGER AS hops, status FROM rt")
def catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = px.network(spark, sf_dir)
    c = n.filter("comid % 3 <> 0").select(F.col("comid").alias("featureid")).unionByName(n.filter("comid % 11 = 0").select((-F.col("comid")).alias("featureid")))
    near = px.adjacency(spark, sf_dir).filter("a % 11 = 0 and a % 2 = 0").withColumn("a", -F.col("a"))
    return routing.route_catchments(c, n, n.filter("comid % 97 = 0"), near)


query("ag17_route_summary", f"{_CATCH} SELECT status, hops::INTEGER AS hops, count(*) AS n FROM rt GROUP BY 1, 2")(lambda s, d: routing.summary(catchments(s, d)))
query("j10_longest_boundary", f"WITH {_NET}, {px.SQL_ADJACENCY} SELECT a, arg_max(b, {{'a': shared_len, 'b': -b}}) AS b, max(shared_len) AS shared_len FROM adj GROUP BY 1")(
    lambda s, d: px.adjacency(s, d).groupBy("a").agg(F.max_by("b", F.struct("shared_len", -F.col("b"))).alias("b"), F.max("shared_len").alias("shared_len"))
)

_FLOW = """fl AS (SELECT comid AS nhdplusid, CASE WHEN comid % 9 <> 0 THEN 1 ELSE 0 END AS innetwork, divergence FROM net WHERE comid % 13 <> 0),
fw AS (SELECT comid AS f, coalesce(tocomid, 0) AS t FROM net UNION ALL SELECT comid, comid // 3 FROM net WHERE comid % 4 = 0),
be AS (SELECT f, max(t) AS t FROM fw WHERE f IN (SELECT nhdplusid FROM fl) GROUP BY 1),
hr AS (SELECT a.nhdplusid, b.nhdplusid AS tonhdplusid, CASE WHEN a.innetwork = 1 AND a.divergence <> 2 THEN 'backbone' ELSE 'orphan' END AS source FROM fl a LEFT JOIN be ON be.f = a.nhdplusid LEFT JOIN fl b ON b.nhdplusid = be.t)"""


def _high_resolution(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = px.network(spark, sf_dir)
    lines = n.filter("comid % 13 <> 0").select(F.col("comid").alias("nhdplusid"), F.when(F.col("comid") % 9 != 0, 1).otherwise(0).alias("innetwork"), "divergence")
    flow = n.select(F.col("comid").alias("fromnhdpid"), F.coalesce("tocomid", F.lit(0)).alias("tonhdpid"))
    return lines, flow.unionByName(n.filter("comid % 4 = 0").select(F.col("comid").alias("fromnhdpid"), F.expr("comid div 3").alias("tonhdpid")))


query("nr12_nr13_high_resolution", f"WITH {_NET}, {_FLOW} SELECT nhdplusid, tonhdplusid, source FROM hr")(lambda s, d: routing.high_resolution(*_high_resolution(s, d)))
query("nr13_orphans", f"WITH {_NET}, {_FLOW} SELECT nhdplusid, tonhdplusid FROM hr WHERE source = 'orphan'")(lambda s, d: routing.high_resolution(*_high_resolution(s, d)).filter("source = 'orphan'").drop("source"))
query("nr14_coverage", f"WITH {_NET}, {_FLOW} SELECT comid, comid IN (SELECT nhdplusid FROM hr) AS routed FROM net")(
    lambda s, d: px.network(s, d).select("comid").join(routing.high_resolution(*_high_resolution(s, d)).select(F.col("nhdplusid").alias("_r")).distinct(), F.col("comid") == F.col("_r"), "left").select("comid", F.col("_r").isNotNull().alias("routed"))
)
query("nr15_local_flow", f"WITH {_NET}, {_FLOW} SELECT f AS fromnhdpid, t AS tonhdpid FROM fw WHERE f IN (SELECT nhdplusid FROM fl)")(
    lambda s, d: (lambda lines, flow: flow.join(lines.select(F.col("nhdplusid").alias("fromnhdpid")), "fromnhdpid", "left_semi"))(*_high_resolution(s, d))
)

_CLOSURE = "cl AS (SELECT comid AS target, comid AS up FROM net UNION ALL SELECT cl.target, n.comid FROM cl JOIN net n ON n.tocomid = cl.up)"
_HCLOSURE = "hc AS (SELECT huc12 AS target, huc12 AS up FROM hucs UNION ALL SELECT hc.target, h.huc12 FROM hc JOIN hucs h ON h.tohuc = hc.up)"


@query("up1_upstream", f"WITH RECURSIVE {_NET}, {_CLOSURE} SELECT target, up FROM cl WHERE target IN (3, 10, 700) AND target <> up")
def upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = px.network(spark, sf_dir)
    return graph.upstream(n, n.filter("comid in (3, 10, 700)").select(F.col("comid").alias("id")))


@query("up2_upstream_hucs", f"WITH RECURSIVE {_NET}, {px.SQL_HUCS}, {_HCLOSURE} SELECT target, up FROM hc WHERE target = 2 AND target <> up")
def upstream_hucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = px.hucs(spark, sf_dir).select(F.col("huc12").alias("comid"), F.col("tohuc").alias("tocomid"))
    return graph.upstream(h, h.filter("comid = 2").select(F.col("comid").alias("id")))


_ROUTE_MAIN = "r AS (SELECT 'catchment' AS kind, up AS id FROM cl JOIN net n ON n.comid = cl.up WHERE target = 36 AND up <> target AND huc12 = 36 // 16 UNION ALL SELECT 'huc12', up FROM hc WHERE target = 36 // 16 AND up <> target)"
query("up3_route_mainstem", f"WITH RECURSIVE {_NET}, {px.SQL_HUCS}, {_CLOSURE}, {_HCLOSURE}, {_ROUTE_MAIN} SELECT kind, id FROM r")(lambda s, d: graph.route(36, px.network(s, d), px.hucs(s, d)))
query("up3_route_tributary", f"WITH RECURSIVE {_NET}, {_CLOSURE} SELECT 'catchment' AS kind, up AS id FROM cl WHERE target = 37 AND up <> target")(lambda s, d: graph.route(37, px.network(s, d), px.hucs(s, d)))
query("up5_route_catchments", f"WITH RECURSIVE {_NET}, {px.SQL_HUCS}, {_CLOSURE}, {_HCLOSURE}, {_ROUTE_MAIN} SELECT comid FROM net WHERE huc12 IN (SELECT id FROM r WHERE kind = 'huc12') UNION SELECT id FROM r WHERE kind = 'catchment'")(
    lambda s, d: graph.route_catchments(36, px.network(s, d), px.hucs(s, d))
)


@query("up7_basins", f"WITH RECURSIVE {_NET}, {_CLOSURE} SELECT target AS comid, list(up ORDER BY up <> target, up)::VARCHAR AS basin FROM cl GROUP BY 1")
def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.basins(px.network(spark, sf_dir)).withColumn("basin", F.col("basin").cast("string"))


@query("up9_upstream_with_self", f"WITH RECURSIVE {_NET}, {px.SQL_HUCS}, {_HCLOSURE} SELECT target, up FROM hc")
def upstream_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = px.hucs(spark, sf_dir).select(F.col("huc12").alias("comid"), F.col("tohuc").alias("tocomid"))
    return graph.upstream(h, h.select(F.col("comid").alias("id")), include_self=True)


@query("up10_resume", f"WITH {_NET}, {px.SQL_HUCS} SELECT huc12 FROM hucs WHERE huc12 % 3 <> 0")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = px.hucs(spark, sf_dir).select("huc12")
    return h.join(h.filter("huc12 % 3 = 0"), "huc12", "left_anti")


@query("s4_depth", f"WITH RECURSIVE {_NET}, dp AS (SELECT comid, comid AS outlet, 0::BIGINT AS depth FROM net WHERE tocomid IS NULL UNION ALL SELECT n.comid, dp.outlet, dp.depth + 1 FROM dp JOIN net n ON n.tocomid = dp.comid) SELECT comid, outlet, depth FROM dp")
def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depth_to_outlet(px.network(spark, sf_dir))

_BOXES = """l AS (SELECT comid, comid * 37 % 1000 AS minx, comid * 91 % 1000 AS miny, comid * 37 % 1000 + comid % 5 AS maxx, comid * 91 % 1000 + comid % 3 AS maxy FROM net),
b AS (SELECT s_suppkey * 53 % 1000 AS minx, s_suppkey * 17 % 1000 AS miny, s_suppkey * 53 % 1000 + 20 AS maxx, s_suppkey * 17 % 1000 + 20 AS maxy FROM supplier)"""


@query("nr2_clip", f"WITH {_NET}, {_BOXES} SELECT comid, minx, miny FROM l WHERE EXISTS (SELECT 1 FROM b WHERE l.minx <= b.maxx AND b.minx <= l.maxx AND l.miny <= b.maxy AND b.miny <= l.maxy)")
def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = F.col("comid"), F.col("s_suppkey")
    lines = px.network(spark, sf_dir).select("comid", (c * 37 % 1000).alias("minx"), (c * 91 % 1000).alias("miny"), (c * 37 % 1000 + c % 5).alias("maxx"), (c * 91 % 1000 + c % 3).alias("maxy"))
    bounds = px.table(spark, sf_dir, "supplier").select((k * 53 % 1000).alias("minx"), (k * 17 % 1000).alias("miny"), (k * 53 % 1000 + 20).alias("maxx"), (k * 17 % 1000 + 20).alias("maxy"))
    return routing.clip(lines, bounds, 20).select("comid", "minx", "miny")


@query("up6_route_exports", f"WITH RECURSIVE {_NET}, {px.SQL_HUCS}, {_CLOSURE}, {_HCLOSURE}, {_ROUTE_MAIN} SELECT kind, id, CASE WHEN kind = 'huc12' THEN 'H' ELSE 'C' END || id AS geometry FROM r")
def route_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, h = px.network(spark, sf_dir).withColumn("geometry", F.concat(F.lit("C"), "comid")), px.hucs(spark, sf_dir).withColumn("geometry", F.concat(F.lit("H"), "huc12"))
    out = None
    for path in graph.export_route(graph.route(36, n, h), n, h, f"{graph.shared_folder(spark)}/rillspark-io/{uuid.uuid4().hex}"):
        kind = path.rsplit("/", 1)[1]
        part = spark.read.parquet(path).select(F.lit(kind).alias("kind"), F.col("comid" if kind == "catchment" else "huc12").alias("id"), "geometry")
        out = part if out is None else out.unionByName(part)
    return out
