"""Queries on geometries: parcels of each part, and lines of each customer, as well-known binary of both byte orders.

Parcels are squares laid like bricks, so corners of one row lie within sides of the next; some are in two halves, some have
a hole with an island in it, some are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import rounded
from ..operators import basin, geometry, routing
from ..operators.graph import cut, shuffled
from . import proxies as px
from .network import catchment_sql
from .registry import query

_POINT = "struct<x:double,y:double>"


def _ring(points: list[tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def _box(x: Column, y: Column, w: int, h: int) -> Column:
    return _ring([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, geometry."""
    k = F.col("p_partkey")
    row = F.expr("p_partkey div 50")
    x, y = k % 50 * 100 + row % 2 * 50, row * 100
    empty = F.array().cast(f"array<array<array<{_POINT}>>>")
    halves, holed = k % 5 == 0, (k % 7 == 0) & (k % 5 != 0)
    one = F.when(k % 97 == 0, empty).when(halves, F.array(F.array(_box(x, y, 50, 100)), F.array(_box(x + 50, y, 50, 100))))
    one = one.when(holed, F.array(F.array(_box(x, y, 100, 100), _box(x + 30, y + 30, 30, 30)))).otherwise(F.array(F.array(_box(x, y, 100, 100))))
    part = px.table(spark, sf_dir, "part")
    whole = part.select(k.alias("id"), F.when(halves & (k % 97 != 0), 6).otherwise(3).alias("kind"), one.alias("parts"), (k % 2 == 1).alias("big"))
    island = part.filter(holed & (k % 97 != 0)).select((-k - 1).alias("id"), F.lit(3).alias("kind"), F.array(F.array(_box(x + 30, y + 30, 30, 30))).alias("parts"), (k % 2 == 0).alias("big"))
    return geometry.encoded(whole.unionByName(island), "id", "kind", "parts", "big")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, geometry: points, lines, lines in two parts, and triangles."""
    k = F.col("c_custkey")
    x, y, dx, dy = k * 37 % 5000, k * 91 % 3000, (k % 13 - 6) * 9 + 1, (k % 11 - 5) * 7
    shapes = [
        (k % 4 == 0, 1, F.array(F.array(_ring([(x, y)])))), (k % 4 == 1, 2, F.array(F.array(_ring([(x, y), (x + dx, y + dy), (x + 2 * dx, y + dy)])))),
        (k % 4 == 2, 5, F.array(F.array(_ring([(x, y), (x + dx, y + dy)])), F.array(_ring([(x + 40, y), (x + 40 + dx, y + dy + 3)])))), (k % 4 == 3, 3, F.array(F.array(_ring([(x, y), (x + 9, y), (x, y + 9), (x, y)])))),
    ]
    kind, parts = F.lit(None).cast("int"), F.lit(None).cast(f"array<array<array<{_POINT}>>>")
    for of, number, made in shapes:
        kind, parts = F.when(of, number).otherwise(kind), F.when(of, made).otherwise(parts)
    return geometry.encoded(px.table(spark, sf_dir, "customer").select(k.alias("id"), kind.alias("kind"), parts.alias("parts"), (k % 3 == 0).alias("big")), "id", "kind", "parts", "big")


def sheds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, geometry: a triangle for each supplier, every second one with a hole."""
    k = F.col("s_suppkey")
    x, y = k * 53 % 5000, k * 17 % 3000
    outer, hole = _ring([(x, y), (x + 150, y + 20), (x + 60, y + 170), (x, y)]), _ring([(x + 60, y + 50), (x + 90, y + 55), (x + 70, y + 90), (x + 60, y + 50)])
    made = px.table(spark, sf_dir, "supplier").select(k.alias("id"), F.lit(3).alias("kind"), F.when(k % 2 == 0, F.array(F.array(outer, hole))).otherwise(F.array(F.array(outer))).alias("parts"), (k % 3 == 1).alias("big"))
    return geometry.encoded(made, "id", "kind", "parts", "big")


_BOXES = """pk AS (SELECT p_partkey AS k, p_partkey % 50 * 100 + (p_partkey // 50) % 2 * 50 AS x, p_partkey // 50 * 100 AS y FROM part WHERE p_partkey % 97 <> 0),
bx AS (SELECT k AS id, 0 AS part, 0 AS ring, x, y, 100 AS w, 100 AS h FROM pk WHERE k % 5 <> 0 UNION ALL SELECT k, 0, 1, x + 30, y + 30, 30, 30 FROM pk WHERE k % 5 <> 0 AND k % 7 = 0
  UNION ALL SELECT k, 0, 0, x, y, 50, 100 FROM pk WHERE k % 5 = 0 UNION ALL SELECT k, 1, 0, x + 50, y, 50, 100 FROM pk WHERE k % 5 = 0
  UNION ALL SELECT -k - 1, 0, 0, x + 30, y + 30, 30, 30 FROM pk WHERE k % 5 <> 0 AND k % 7 = 0)"""
_SIDES = f"""{_BOXES}, hz AS (SELECT DISTINCT id, unnest([y, y + h]) AS at, x AS a, x + w AS b FROM bx), vt AS (SELECT DISTINCT id, unnest([x, x + w]) AS at, y AS a, y + h AS b FROM bx),
sh AS (SELECT p.id AS a, q.id AS b, least(p.b, q.b) - greatest(p.a, q.a) AS n FROM hz p JOIN hz q ON p.at = q.at AND p.id <> q.id AND p.a < q.b AND q.a < p.b
  UNION ALL SELECT p.id, q.id, least(p.b, q.b) - greatest(p.a, q.a) FROM vt p JOIN vt q ON p.at = q.at AND p.id <> q.id AND p.a < q.b AND q.a < p.b),
pairs AS (SELECT a, b, sum(n)::DOUBLE AS shared_len FROM sh GROUP BY 1, 2),
env AS (SELECT id, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM bx GROUP BY 1),
meet AS (SELECT p.id AS a, q.id AS b FROM env p JOIN env q ON p.id <> q.id AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1)"""
_POINTS = f"""{_BOXES}, pt AS (SELECT id, part, ring, unnest([{{'i': 0, 'x': x, 'y': y}}, {{'i': 1, 'x': x + w, 'y': y}}, {{'i': 2, 'x': x + w, 'y': y + h}}, {{'i': 3, 'x': x, 'y': y + h}}, {{'i': 4, 'x': x, 'y': y}}], recursive := true) FROM bx),
st AS (SELECT id, part, ring, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pt WINDOW w AS (PARTITION BY id, part, ring ORDER BY i)),
rg AS (SELECT id, part, ring, abs(sum(x * y2 - x2 * y)) / 2.0 AS area, sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) AS long FROM st WHERE x2 IS NOT NULL GROUP BY 1, 2, 3),
ms AS (SELECT id, sum(CASE WHEN ring = 0 THEN area ELSE -area END) AS a, sum(long) AS p FROM rg GROUP BY 1)"""


@query("ba2_ring_shape", f"WITH {_POINTS} SELECT id, round(a / 1e6, 6) + 0.0 AS area_km2, round(p / 1e3, 6) + 0.0 AS perimeter_km, round(4 * pi() * a / nullif(p * p, 0), 6) + 0.0 AS compactness FROM ms")
def ring_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, perimeter and compactness of parcels, from their rings."""
    sizes = geometry.measured(geometry.rings(parcels(spark, sf_dir), "id"), "id")
    return rounded(sizes.select("id", *basin.shape(F.col("area"), F.col("perimeter"))))


@query("j10_shared_boundaries", f"WITH {_SIDES} SELECT a, b, shared_len FROM pairs")
def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every two parcels share, from their rings."""
    p = parcels(spark, sf_dir)
    return geometry.shared_lengths(p, p)


@query("j10_longest_by_geometry", f"WITH {_SIDES} SELECT a, arg_max(b, {{'a': shared_len, 'b': -b}}) AS b, max(shared_len) AS shared_len FROM (SELECT a, b, coalesce(shared_len, 0.0) AS shared_len FROM meet LEFT JOIN pairs USING (a, b)) WHERE a < 0 OR a % 4 = 0 GROUP BY 1")
def longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbour with the longest shared boundary; of equal ones the smallest."""
    p = parcels(spark, sf_dir)
    near = geometry.neighbours(p.filter("id < 0 or id % 4 = 0"), p)
    return near.groupBy("a").agg(F.max_by("b", F.struct("shared_len", -F.col("b"))).alias("b"), F.max("shared_len").alias("shared_len"))


_ROUTED = catchment_sql(_SIDES, "SELECT DISTINCT id FROM bx WHERE id % 13 <> 5", "SELECT meet.a, meet.b, coalesce(shared_len, 0.0) AS shared_len FROM meet LEFT JOIN pairs USING (a, b) WHERE meet.a NOT IN (SELECT comid FROM net)")


@query("nr11_orphans_by_geometry", f"{_ROUTED} SELECT featureid, target, hops::INTEGER AS hops, status FROM rt")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels as catchments: those that aren't in the network take the target of the neighbour with the longest shared boundary."""
    n, p = px.network(spark, sf_dir), parcels(spark, sf_dir)
    p = cut(p.join(shuffled(geometry.bounds(geometry.rings(p, "id"), "id").select("id")), "id", "left_semi"))  # not the empty ones
    apart = p.join(shuffled(n.select(F.col("comid").alias("id"))), "id", "left_anti")
    return routing.route_catchments(p.filter("id % 13 <> 5").select(F.col("id").alias("featureid")), n, n.filter("comid % 97 = 0"), geometry.neighbours(apart, p))


_LINES = """lk AS (SELECT c_custkey AS k, c_custkey * 37 % 5000 AS x, c_custkey * 91 % 3000 AS y, (c_custkey % 13 - 6) * 9 + 1 AS dx, (c_custkey % 11 - 5) * 7 AS dy FROM customer),
lp AS (SELECT k AS id, 0 AS part, 0 AS i, x, y FROM lk WHERE k % 4 IN (1, 2) UNION ALL SELECT k, 0, 1, x + dx, y + dy FROM lk WHERE k % 4 IN (1, 2) UNION ALL SELECT k, 0, 2, x + 2 * dx, y + dy FROM lk WHERE k % 4 = 1
  UNION ALL SELECT k, 1, 0, x + 40, y FROM lk WHERE k % 4 = 2 UNION ALL SELECT k, 1, 1, x + 40 + dx, y + dy + 3 FROM lk WHERE k % 4 = 2)"""


def _exploded(df: DataFrame) -> DataFrame:
    """id, part, i, x, y of all points."""
    return geometry.rings(df, "id").select("id", "part", F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p")).select("id", "part", "i", F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))


@query("pf12_lines", f"WITH {_LINES} SELECT id, part, i, x::DOUBLE AS x, y::DOUBLE AS y FROM lp")
def only_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and lines in parts, of geometries of all types, with their points."""
    all_ = lines(spark, sf_dir)
    return _exploded(all_.filter(sources.geometry_type(F.col("geometry")).isin(sources.LINE, sources.MULTI_LINE)))


@query("pf13_multi", f"WITH {_LINES} SELECT lk.k AS id, CASE k % 4 WHEN 0 THEN 1 WHEN 3 THEN 3 ELSE 5 END AS kind, CASE k % 4 WHEN 0 THEN 21 WHEN 1 THEN 66 WHEN 2 THEN 91 ELSE 77 END AS size, CASE WHEN k % 4 = 2 THEN 2 ELSE 1 END AS parts, CASE k % 4 WHEN 0 THEN x WHEN 3 THEN 4 * x + 9 WHEN 1 THEN 3 * x + 3 * dx ELSE 4 * x + 80 + 2 * dx END::DOUBLE AS total_x FROM lk")
def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as multi-lines, read back."""
    made = lines(spark, sf_dir).select("id", sources.promoted(F.col("geometry")).alias("geometry"))
    read = _exploded(made).groupBy("id").agg(F.count_distinct("part").cast("int").alias("parts"), F.sum("x").alias("total_x"))
    return made.select("id", sources.geometry_type(F.col("geometry")).alias("kind"), F.length("geometry").alias("size")).join(read, "id")


_CLIP = f"""{_LINES}, sk AS (SELECT s_suppkey AS s, s_suppkey * 53 % 5000 AS x, s_suppkey * 17 % 3000 AS y FROM supplier),
w AS (SELECT s, unnest([{{'x1': x, 'y1': y, 'x2': x + 150, 'y2': y + 20}}, {{'x1': x + 150, 'y1': y + 20, 'x2': x + 60, 'y2': y + 170}}, {{'x1': x + 60, 'y1': y + 170, 'x2': x, 'y2': y}}], recursive := true) FROM sk
  UNION ALL SELECT s, unnest([{{'x1': x + 60, 'y1': y + 50, 'x2': x + 90, 'y2': y + 55}}, {{'x1': x + 90, 'y1': y + 55, 'x2': x + 70, 'y2': y + 90}}, {{'x1': x + 70, 'y1': y + 90, 'x2': x + 60, 'y2': y + 50}}], recursive := true) FROM sk WHERE s % 2 = 0),
g AS (SELECT id, x AS px, y AS py, lead(x) OVER v AS qx, lead(y) OVER v AS qy FROM lp WINDOW v AS (PARTITION BY id, part ORDER BY i)),
cr AS (SELECT DISTINCT id FROM g JOIN w ON least(px, qx) <= greatest(x1, x2) AND least(x1, x2) <= greatest(px, qx) AND least(py, qy) <= greatest(y1, y2) AND least(y1, y2) <= greatest(py, qy)
  AND ((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)) * ((x2 - x1) * (qy - y1) - (y2 - y1) * (qx - x1)) <= 0 AND ((qx - px) * (y1 - py) - (qy - py) * (x1 - px)) * ((qx - px) * (y2 - py) - (qy - py) * (x2 - px)) <= 0 WHERE qx IS NOT NULL),
ins AS (SELECT id, part, s FROM lp JOIN w ON i = 0 AND (y1 > y) <> (y2 > y) AND x < x1 + (x2 - x1) * ((y - y1) / (y2 - y1)) GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query("nr2_clip_shapes", f"WITH {_CLIP} SELECT id FROM cr UNION SELECT id FROM ins")
def clip_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that meet a shape, exactly: not those that only meet its envelope or lie in its hole."""
    return geometry.meeting_shapes(lines(spark, sf_dir), sheds(spark, sf_dir))


@query("io18_terminal_map", f"WITH {px.SQL_NETWORK}, {_LINES} SELECT id, part, i, x::DOUBLE AS x, y::DOUBLE AS y, tocomid IS NULL OR comid % 10 = 3 AS terminal FROM lp JOIN net ON comid = id")
def terminal_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn network: points of each reach's line, and whether the reach is terminal."""
    reaches = px.network(spark, sf_dir).select(F.col("comid").alias("id"), F.when(F.col("comid") % 10 != 3, F.col("tocomid")).alias("to"))
    return _exploded(lines(spark, sf_dir).filter(sources.geometry_type(F.col("geometry")).isin(sources.LINE, sources.MULTI_LINE))).join(reaches.select("id", F.col("to").isNull().alias("terminal")), "id")
