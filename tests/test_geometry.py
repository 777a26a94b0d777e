"""Geometries against plain loops over their coordinates."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from rillspark import sources
from rillspark.operators import geometry

PARTS = "id long, kind int, parts array<array<array<struct<x:double,y:double>>>>, big boolean"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def path(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def frame(spark, rows):
    return geometry.encoded(spark.createDataFrame(rows, PARTS).repartition(3), "id", "kind", "parts", "big")


def raw(spark, *data):
    return spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "id long, geometry binary")


def test_reader_takes_both_orders_more_dimensions_and_nested_geometries(spark):
    line = lambda o, code, *xs: (b"\x01" if o == "<" else b"\x00") + struct.pack(f"{o}II", code, 2) + struct.pack(f"{o}{len(xs)}d", *xs)
    flat = line("<", 2, 1, 2, 3, 4)
    data = [
        flat, line(">", 2, 1, 2, 3, 4), line("<", 1002, 1, 2, 9, 3, 4, 9), line(">", 2002, 1, 2, 9, 3, 4, 9), line("<", 3002, 1, 2, 8, 9, 3, 4, 8, 9), line("<", 0x80000002, 1, 2, 9, 3, 4, 9),
        b"\x01" + struct.pack("<III", 0x20000002, 5070, 2) + struct.pack("<4d", 1, 2, 3, 4), b"\x00" + struct.pack(">II", 7, 2) + flat + b"\x01" + struct.pack("<II", 5, 1) + line(">", 2, 5, 6, 7, 8), b"\x01" + struct.pack("<II", 3, 0), b"",
    ]
    got = sorted(map(tuple, geometry.rings(raw(spark, *data), "id").collect()))
    assert got == [(i, 2, 0, 0, [1.0, 3.0], [2.0, 4.0]) for i in range(8)] + [(7, 2, 1, 0, [5.0, 7.0], [6.0, 8.0])]
    kinds = [r[0] for r in raw(spark, *data).orderBy("id").select(sources.geometry_type(F.col("geometry"))).collect()]
    assert kinds == [2] * 7 + [7, 3, None]
    multi = raw(spark, *data).select("id", sources.promoted(F.col("geometry")).alias("geometry"))
    assert [r[0] for r in multi.orderBy("id").select(sources.geometry_type(F.col("geometry"))).collect()] == [5] * 7 + [7, 3, None]
    assert sorted(map(tuple, geometry.rings(multi, "id").collect())) == got
    with pytest.raises(Exception, match="geometry type 99"):
        geometry.rings(raw(spark, b"\x01" + struct.pack("<I", 99)), "id").collect()


def test_sizes_of_holes_parts_and_empty_geometries(spark):
    square = lambda x, y, w: ring([(x, y), (x + w, y), (x + w, y + w), (x, y + w)])
    far = 1e8
    rows = [(1, 3, [[square(far, far, 10), square(far + 2, far + 2, 3)]], True), (2, 6, [[square(0, 0, 1)], [square(5, 5, 2), square(5.5, 5.5, 1)]], False), (3, 3, [], False), (4, 3, None, False), (5, 3, [[ring([(0, 0), (4, 0), (0, 3)])[::-1]]], True), (6, 1, [], False), (7, 6, [], True)]
    ring_ = geometry.rings(frame(spark, rows), "id")
    assert sorted(map(tuple, geometry.measured(ring_, "id").collect())) == [(1, 91.0, 52.0), (2, 4.0, 16.0), (5, 6.0, 12.0)]
    assert tuple(geometry.bounds(ring_.filter("id = 2"), "id").first()) == (2, 0.0, 0.0, 7.0, 7.0)
    assert geometry.measured(ring_.limit(0), "id").count() == 0


def coverage(rng, n=6):
    """Polygons of a jittered grid; sides have corners in the middle that only one neighbour has; one polygon is an island."""
    at = {(i, j): (100 * i + 2 * rng.randrange(-20, 21), 100 * j + 2 * rng.randrange(-20, 21)) for i in range(n + 1) for j in range(n + 1)}
    out = {}
    for i in range(n):
        for j in range(n):
            corners = [at[i, j], at[i + 1, j], at[i + 1, j + 1], at[i, j + 1]]
            points = []
            for p, q in zip(corners, corners[1:] + corners[:1], strict=True):
                points.append(p)
                if rng.random() < 0.4:
                    points.append(((p[0] + q[0]) // 2, (p[1] + q[1]) // 2))
            out[i * n + j] = [points if rng.random() < 0.5 else points[::-1]]
    i, j = n // 2, n // 2
    x, y = (sum(at[i + a, j + b][k] for a in (0, 1) for b in (0, 1)) // 4 for k in (0, 1))
    island = [(x - 10, y - 10), (x + 10, y - 8), (x, y + 12)]
    out[i * n + j].append(island)
    out[999] = [island[::-1]]
    return out


def sides(polygon):
    return [(p, q) for points in polygon for p, q in zip(points, points[1:] + points[:1], strict=True)]


def overlap(a, b):
    """Length that two segments with whole coordinates have in common, if they are on one line."""
    (p, q), (r, s) = a, b
    cross = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
    if cross(p, q, r) or cross(p, q, s):
        return 0.0
    long = math.dist(p, q)
    along = lambda v: ((v[0] - p[0]) * (q[0] - p[0]) + (v[1] - p[1]) * (q[1] - p[1])) / long
    return max(0.0, min(long, max(along(r), along(s))) - max(0.0, min(along(r), along(s))))


@pytest.mark.parametrize("cell", [None, 7.0, 1000.0])
def test_shared_boundaries_against_a_double_loop(spark, cell):
    rng = random.Random(11)
    polygons = coverage(rng)
    rows = [(i, 3, [[ring(p) for p in rings]], rng.random() < 0.5) for i, rings in polygons.items()]
    rows += [(5000, 3, [], False), (5001, 3, [[ring([(9000, 0), (9010, 0), (9000, 10)])]], True)]
    table = frame(spark, rows)
    got = {(r["a"], r["b"]): r["shared_len"] for r in geometry.shared_lengths(table, table, cell).collect()}
    want = {}
    for a, pa in polygons.items():
        for b, pb in polygons.items():
            if a != b and (long := sum(overlap(s, t) for s in sides(pa) for t in sides(pb))) > 0:
                want[a, b] = long
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    if cell is None:
        near = geometry.neighbours(table.filter("id in (0, 999, 5000, 5001)"), table).collect()
        assert {r["a"] for r in near} == {0, 999} and all(abs(r["shared_len"] - want.get((r["a"], r["b"]), 0.0)) < 1e-6 for r in near)
        box = lambda p: [f(v[k] for v in p[0]) for k in (0, 1) for f in (min, max)]
        meet = {(a, b) for a in (0, 999) for b in polygons if a != b and box(polygons[a])[0] <= box(polygons[b])[1] and box(polygons[b])[0] <= box(polygons[a])[1] and box(polygons[a])[2] <= box(polygons[b])[3] and box(polygons[b])[2] <= box(polygons[a])[3]}
        assert {(r["a"], r["b"]) for r in near} == meet


def inside(point, polygon):
    n = 0
    for (x1, y1), (x2, y2) in sides(polygon):
        if (y1 > point[1]) != (y2 > point[1]) and point[0] < x1 + (x2 - x1) * (point[1] - y1) / (y2 - y1):
            n += 1
    return n % 2 == 1


def cross_each_other(a, b):
    side = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
    (p, q), (r, s) = a, b
    near = all(min(p[k], q[k]) <= max(r[k], s[k]) and min(r[k], s[k]) <= max(p[k], q[k]) for k in (0, 1))
    return near and side(r, s, p) * side(r, s, q) <= 0 and side(p, q, r) * side(p, q, s) <= 0


@pytest.mark.parametrize("cell", [None, 5.0])
def test_lines_that_meet_shapes_against_a_double_loop(spark, cell):
    rng = random.Random(2)
    shapes = {i: [[(x, y), (x + 60, y + 5), (x + 20, y + 70)], [(x + 15, y + 10), (x + 35, y + 12), (x + 22, y + 30)]] for i, (x, y) in enumerate((rng.randrange(1000), rng.randrange(1000)) for _ in range(25))}
    lines = {}
    for i in range(300):
        x, y = rng.randrange(1050), rng.randrange(1050)
        lines[i] = [[(x, y), (x + rng.randrange(-9, 10), y + rng.randrange(1, 9)), (x + rng.randrange(-30, 31), y + rng.randrange(-30, 31))] for x, y in [(x, y), (rng.randrange(1050), rng.randrange(1050))][: 1 + i % 2]]
    x, y = shapes[0][0][0]
    lines[900] = [[(x + 20, y + 14), (x + 22, y + 18)]]  # in a hole
    lines[901] = [[(x + 55, y + 60), (x + 58, y + 65)]]  # in the envelope alone
    lines[902] = [[(x + 5, y + 3), (x + 6, y + 4)]]  # within
    lines[903] = [[(x - 10, y), (x, y)]]  # touches a corner
    table = frame(spark, [(i, 2 if len(parts) == 1 else 5, [[path(p)] for p in parts], i % 3 == 0) for i, parts in lines.items()])
    areas = frame(spark, [(i, 3, [[ring(p) for p in rings]], i % 2 == 0) for i, rings in shapes.items()])
    want = set()
    for i, parts in lines.items():
        for shape in shapes.values():
            if any(inside(p[0], shape) for p in parts) or any(cross_each_other((p, q), s) for part in parts for p, q in zip(part, part[1:]) for s in sides(shape)):
                want.add(i)
    got = [r["id"] for r in geometry.meeting_shapes(table, areas, cell).collect()]
    assert sorted(got) == sorted(want) and {902, 903} <= want and len(want) > 20
    assert geometry.meeting_shapes(table.limit(0), areas).count() == geometry.meeting_shapes(table, areas.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["j10_shared_boundaries", "j10_longest_by_geometry", "nr11_orphans_by_geometry"])
def test_no_join_of_parcels_goes_through_the_driver(spark, name):
    """Cut tables are taken for as small as the file of keys that they come from."""
    from rillspark import plans

    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_a_table_with_itself_shares_what_two_copies_share(spark):
    from rillspark.plans import geometries

    p = geometries.parcels(spark, "/root/testdata/sf0.001")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(geometry.shared_lengths(p, p)) == rows(geometry.shared_lengths(p, p.select("*")))
