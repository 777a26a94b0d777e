"""Geometries as data: well-known binary in batches, rings, areas, shared boundaries, lines that meet shapes.

Python only takes bytes apart (or puts them together) in Arrow batches; rings are rows with arrays of coordinates, and all
that follows is column arithmetic and equality joins. Segments meet in the cells of a grid that they cross, never pair by
pair. Coordinates are planar, in one system for all tables; a third or fourth dimension is read and left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut, shuffled

#: Types of well-known binary (fixed values); multi-parts are three above their parts.
POINT, LINE, POLYGON, COLLECTION = 1, 2, 3, 7

Part = tuple[int, list[np.ndarray]]


def _parts(data: bytes, at: int = 0) -> tuple[list[Part], int]:
    """(type, rings as arrays of points) of all simple parts of the geometry at a position, and the position behind it.

    Each geometry has a byte order of its own; types may be of the ISO form (thousands tell the dimensions) or carry flags.
    """
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 9 if code & 0x20000000 else 5  # with a reference system's number, or without
    thousands, kind = divmod(code & 0x0FFFFFFF, 1000)
    wide = 2 + (bool(code & 0x80000000) or thousands in (1, 3)) + (bool(code & 0x40000000) or thousands in (2, 3))

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(f"{order}I", data, at - 4)[0]

    def points(n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, f"{order}f8", n * wide, at).reshape(n, wide)[:, :2].astype(float)
        at += 8 * n * wide
        return out

    if kind == POINT:
        one = points(1)
        return [(POINT, [] if np.isnan(one).any() else [one])], at
    if kind == LINE:
        return [(LINE, [points(count())])], at
    if kind == POLYGON:
        return [(POLYGON, [points(count()) for _ in range(count())])], at
    if kind <= COLLECTION:
        out = []
        for _ in range(count()):
            more, at = _parts(data, at)
            out += more
        return out, at
    raise ValueError(f"geometry type {code}")


_RINGS = "kind int, part int, ring int, xs array<double>, ys array<double>"


def rings(df: DataFrame, key: str, geometry: str = "geometry") -> DataFrame:
    """key, kind (1 point, 2 line, 3 polygon), part, ring (0: the outer one), xs, ys of every ring of every part.

    Points and lines have one ring a part. Null and empty geometries have no rows. Bytes that aren't a geometry are an error.
    """
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, kinds, numbers, ring, xs, ys = [], [], [], [], [], []
            for i, data in enumerate(batch[1].to_pylist()):
                for p, (k, found) in enumerate(_parts(data)[0] if data else []):
                    for r, xy in enumerate(found):
                        if len(xy):
                            for held, x in zip((row, kinds, numbers, ring, xs, ys), (i, k, p, r, xy[:, 0], xy[:, 1]), strict=True):
                                held.append(x)
            ints = [pa.array(x, pa.int32()) for x in (kinds, numbers, ring)]
            lists = [pa.array(x, pa.list_(pa.float64())) for x in (xs, ys)]
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(row, pa.int64())), *ints, *lists], names=[key, "kind", "part", "ring", "xs", "ys"])

    return df.select(key, geometry).mapInArrow(run, f"`{key}` {kind}, {_RINGS}")


def encoded(df: DataFrame, key: str, kind: str, parts: str, big: str) -> DataFrame:
    """key, geometry: well-known binary of parts (an array of parts, of rings, of points (x, y)).

    kind is the type, of the whole (1 to 6); big tells whether a row is written with the high byte first. Null parts give null.
    """
    type_ = df.select(key).schema[0].dataType.simpleString()

    def one(kind: int, parts: list, order: str) -> bytes:
        head = lambda k: (b"\x01" if order == "<" else b"\x00") + struct.pack(f"{order}I", k)
        number = lambda n: struct.pack(f"{order}I", n)
        points = lambda ring: np.array([(p["x"], p["y"]) for p in ring], f"{order}f8").tobytes()

        def simple(k: int, rings: list) -> bytes:
            if k == POINT:
                return head(k) + (points(rings[0]) if rings else np.array([np.nan] * 2, f"{order}f8").tobytes())
            counted = [number(len(r)) + points(r) for r in rings]
            return head(k) + (number(len(rings)) if k == POLYGON else b"" if rings else number(0)) + b"".join(counted)

        if kind <= POLYGON:
            return simple(kind, parts[0] if parts else [])
        return head(kind) + number(len(parts)) + b"".join(simple(kind - 3, p) for p in parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if p is None else one(k, p, ">" if b else "<") for k, p, b in zip(batch[1].to_pylist(), batch[2].to_pylist(), batch[3].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(made, pa.binary())], names=[key, "geometry"])

    # dealt out, as a few MB of a compressed table are one task
    return df.select(key, F.col(kind).cast("int").alias("_kind"), F.col(parts).alias("_parts"), F.col(big).alias("_big")).repartition(F.col(key)).mapInArrow(run, f"`{key}` {type_}, geometry binary")


def _paired(f) -> Column:
    """f(x1, y1, x2, y2) of each pair of neighbouring points of a ring, as an array."""
    n = F.greatest(F.size("xs") - 1, F.lit(0))
    first, second = (F.arrays_zip(F.slice("xs", at, n).alias("x"), F.slice("ys", at, n).alias("y")) for at in (1, 2))
    return F.zip_with(first, second, lambda a, b: f(a["x"], a["y"], b["x"], b["y"]))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def measured(ring: DataFrame, key: str) -> DataFrame:
    """key, area, perimeter of polygons by their rings: holes lessen the area and lengthen the perimeter.

    Shoelace sums start at each ring's first point, so they don't lose digits far from the origin. Lines and points have no area.
    """
    x0, y0 = F.get("xs", F.lit(0)), F.get("ys", F.lit(0))
    twice = _total(_paired(lambda x1, y1, x2, y2: (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)))
    length = _total(_paired(lambda x1, y1, x2, y2: F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))
    area = F.when(F.col("kind") == POLYGON, F.abs(twice) / 2 * F.when(F.col("ring") == 0, 1).otherwise(-1)).otherwise(0.0)
    return ring.select(key, area.alias("area"), length.alias("perimeter")).groupBy(key).agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"))


def bounds(ring: DataFrame, key: str) -> DataFrame:
    """key, minx, miny, maxx, maxy."""
    sides = [f(g(c)).alias(n) for n, c, f, g in (("minx", "xs", F.min, F.array_min), ("miny", "ys", F.min, F.array_min), ("maxx", "xs", F.max, F.array_max), ("maxy", "ys", F.max, F.array_max))]
    return ring.groupBy(key).agg(*sides)


def segments(ring: DataFrame, key: str) -> DataFrame:
    """key, part, x1, y1, x2, y2 of every stretch between neighbouring points; the lesser end comes first, no ends are equal."""
    apart = F.explode(_paired(lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))))
    s = ring.select(key, "part", apart.alias("s")).select(key, "part", "s.*").filter("x1 <> x2 or y1 <> y2")
    swap = "(x1 > x2 or (x1 = x2 and y1 > y2))"
    return s.select(key, "part", *[F.expr(f"if({swap}, {b}, {a})").alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])


def fitting_cell(ring: DataFrame) -> float:
    """A grid's cell about twice as wide as the mean segment is long."""
    side = _paired(lambda x1, y1, x2, y2: F.greatest(F.abs(x2 - x1), F.abs(y2 - y1)))
    sums = ring.agg(F.sum(_total(side)).alias("long"), F.sum(F.greatest(F.size("xs") - 1, F.lit(0))).alias("n")).first()
    return 2 * sums["long"] / sums["n"] if sums["long"] else 1.0


def _cells(s: DataFrame, cell: float) -> DataFrame:
    """Segments (lesser end first) with every cell (cx, cy) that they cross or touch, column by column; a hair of width makes
    sure that rounding loses none."""
    hair, width = 1e-9 * cell, F.lit(cell)
    columns = s.withColumn("cx", F.explode(F.sequence(F.floor((F.col("x1") - hair) / width), F.floor((F.col("x2") + hair) / width))))
    dx = F.col("x2") - F.col("x1")
    y_at = lambda x: F.when(dx == 0, F.col("y1")).otherwise(F.col("y1") + (F.col("y2") - F.col("y1")) * ((x - F.col("x1")) / F.nullif(dx, F.lit(0.0))))
    enter = F.when(dx <= hair, F.col("y1")).otherwise(y_at(F.greatest("x1", F.least("x2", F.col("cx") * width - hair))))
    leave = F.when(dx <= hair, F.col("y2")).otherwise(y_at(F.greatest("x1", F.least("x2", (F.col("cx") + 1) * width + hair))))
    low, high = F.floor((F.least(enter, leave) - hair) / width), F.floor((F.greatest(enter, leave) + hair) / width)
    return columns.withColumn("cy", F.explode(F.sequence(low, high)))


def noded(s: DataFrame, points: DataFrame, key: str, cell: float, tolerance: float) -> DataFrame:
    """key, x1, y1, x2, y2: segments cut at the points (x, y) that lie on them, ends excepted."""
    at = points.select("x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    ends = [key, "x1", "y1", "x2", "y2"]
    own = s.select(*ends).distinct()
    along = (F.col("x2") - F.col("x1")) * (F.col("x") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y") - F.col("y1"))
    aside = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x") - F.col("x1"))
    long2 = (F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1"))
    inside = (F.abs(aside) <= tolerance * F.sqrt(long2)) & (along > tolerance * F.sqrt(long2)) & (along < long2 - tolerance * F.sqrt(long2))
    on = _cells(own, cell).join(shuffled(at), ["cx", "cy"]).filter(inside).select(*ends, F.struct(along.alias("t"), "x", "y").alias("p"))
    stops = own.join(shuffled(on.groupBy(*ends).agg(F.array_sort(F.collect_set("p")).alias("p"))), ends, "left")
    end = lambda x, y: F.struct(F.lit(0.0).alias("t"), F.col(x).alias("x"), F.col(y).alias("y"))
    way = F.concat(F.array(end("x1", "y1")), F.coalesce("p", F.array().cast("array<struct<t:double,x:double,y:double>>")), F.array(end("x2", "y2")))
    steps = F.zip_with(F.slice("way", 1, F.size("way") - 1), F.slice("way", 2, F.size("way") - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    cut_ = stops.select(key, way.alias("way")).select(key, F.explode(steps).alias("s")).select(key, "s.*")
    lesser = F.expr("x1 < x2 or (x1 = x2 and y1 <= y2)")
    return cut_.select(key, *[F.when(lesser, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))])


def shared_lengths(left: DataFrame, right: DataFrame, cell: float | None = None, tolerance: float = 1e-9) -> DataFrame:
    """a, b, shared_len: the length of the boundary that each polygon of left (id, geometry) has in common with one of right.

    An edge index: segments are cut at all corners on them, so a corner that only one neighbour has doesn't hide what they
    share; pieces then meet by their two end points in an equality join. Pairs of equal ids and pairs that share nothing
    aren't there. Polygons that overlap count what their boundaries share, not their common area.
    """
    of = lambda df: cut(rings(df, "id").filter(F.col("kind") == POLYGON))
    a = of(left)
    b = a if left is right else of(right)
    whole = a if left is right else a.unionByName(b)
    cell = cell or fitting_cell(whole)
    corners = lambda ring: ring.select(F.explode(F.arrays_zip("xs", "ys")).alias("p")).select(F.col("p.xs").alias("x"), F.col("p.ys").alias("y")).distinct()
    at = cut(corners(whole))  # of both tables, for both: what they share is cut alike
    pieces = lambda ring: noded(segments(ring, "id"), at, "id", cell, tolerance).distinct()
    own = cut(pieces(a)) if left is right else pieces(a)
    other = (own if left is right else pieces(b)).withColumnRenamed("id", "b")
    own = own.withColumnRenamed("id", "a")
    long = F.sqrt((F.col("x2") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y2") - F.col("y1")) * (F.col("y2") - F.col("y1")))
    return own.join(shuffled(other), ["x1", "y1", "x2", "y2"]).filter("a <> b").groupBy("a", "b").agg(F.sum(long).alias("shared_len"))


def boxes_meet(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """a, b: rows of left (a, minx to maxy) and right (b, minx to maxy) whose envelopes meet, each pair once, in cells of a grid."""

    def dealt(df: DataFrame, key: str) -> DataFrame:
        span = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
        named = df.select(key, *[F.col(c).alias(f"{key}_{c}") for c in ("minx", "miny", "maxx", "maxy")])
        return named.withColumn("cx", F.explode(span(f"{key}_minx", f"{key}_maxx"))).withColumn("cy", F.explode(span(f"{key}_miny", f"{key}_maxy")))

    meet = F.expr("a_minx <= b_maxx and b_minx <= a_maxx and a_miny <= b_maxy and b_miny <= a_maxy")
    # of the cells that both touch, the one with the corner of what they have in common counts
    first = (F.floor(F.greatest("a_minx", "b_minx") / cell) == F.col("cx")) & (F.floor(F.greatest("a_miny", "b_miny") / cell) == F.col("cy"))
    return dealt(left, "a").join(shuffled(dealt(right, "b")), ["cx", "cy"]).filter(meet & first).select("a", "b")


def neighbours(orphans: DataFrame, others: DataFrame, cell: float | None = None, tolerance: float = 1e-9) -> DataFrame:
    """a, b, shared_len of all orphans (id, geometry) with the others whose envelopes meet theirs; 0 where no boundary is shared.

    This is the adjacency that route_catchments() takes.
    """
    a, b = bounds(rings(orphans, "id"), "id").withColumnRenamed("id", "a"), bounds(rings(others, "id"), "id").withColumnRenamed("id", "b")
    wide = a.select(F.avg(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))).first()[0]
    pairs = boxes_meet(a, b, wide or 1.0).filter("a <> b")
    return pairs.join(shuffled(shared_lengths(orphans, others, cell, tolerance)), ["a", "b"], "left").select("a", "b", F.coalesce("shared_len", F.lit(0.0)).alias("shared_len"))


def _cross(x1: str, y1: str, x2: str, y2: str, x: str, y: str) -> Column:
    """Which side of a line a point is on."""
    c = F.col
    return (c(x2) - c(x1)) * (c(y) - c(y1)) - (c(y2) - c(y1)) * (c(x) - c(x1))


def meeting_shapes(lines: DataFrame, shapes: DataFrame, cell: float | None = None) -> DataFrame:
    """id of every line (id, geometry) that crosses, touches or lies in a polygon (id, geometry), each once; holes are outside.

    Segments of both that share a cell of a grid are tested by which side each one's ends are on of the other. Parts of lines
    that cross no boundary lie in a polygon as a whole or not at all: one point of each is held against the polygons whose
    envelope it is in, by counting boundaries to its right, joined by polygon and row of the grid.
    """
    line, shape = cut(rings(lines, "id").filter(F.col("kind") == LINE)), cut(rings(shapes, "id").filter(F.col("kind") == POLYGON))
    cell = cell or fitting_cell(line.unionByName(shape))
    named = lambda s, p: s.select(F.col("id").alias(f"{p}id"), F.col("part").alias(f"{p}part"), *[F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")], "cx", "cy")
    a, b = named(_cells(segments(line, "id"), cell), "a"), named(_cells(segments(shape, "id"), cell), "b")
    one = _cross("bx1", "by1", "bx2", "by2", "ax1", "ay1") * _cross("bx1", "by1", "bx2", "by2", "ax2", "ay2") <= 0
    two = _cross("ax1", "ay1", "ax2", "ay2", "bx1", "by1") * _cross("ax1", "ay1", "ax2", "ay2", "bx2", "by2") <= 0
    near = F.expr("ax1 <= bx2 and bx1 <= ax2 and least(ay1, ay2) <= greatest(by1, by2) and least(by1, by2) <= greatest(ay1, ay2)")
    crossing = cut(a.join(shuffled(b), (a["cx"] == b["cx"]) & (a["cy"] == b["cy"]) & near & one & two, "left_semi").select(F.col("aid").alias("id")).distinct())
    rest = line.join(shuffled(crossing), "id", "left_anti").select("id", "part", F.get("xs", F.lit(0)).alias("x"), F.get("ys", F.lit(0)).alias("y"))
    box = bounds(shape, "id")
    wide = box.select(F.avg(F.greatest(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))).first()[0] or 1.0
    point = rest.select(F.struct("id", "part", "x", "y").alias("a"), F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"))
    pairs = boxes_meet(point, box.withColumnRenamed("id", "b"), wide).select("a.*", "b").withColumn("row", F.floor(F.col("y") / cell))
    rows = F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))
    walls = segments(shape, "id").select(F.col("id").alias("b"), "x1", "y1", "x2", "y2", F.explode(rows).alias("row"))
    beyond = F.expr("(y1 > y) <> (y2 > y) and x < x1 + (x2 - x1) * ((y - y1) / nullif(y2 - y1, 0))")
    inside = pairs.join(shuffled(walls), ["b", "row"]).groupBy("id", "part", "b").agg(F.count_if(beyond).alias("n")).filter("n % 2 = 1")
    return crossing.union(inside.select("id")).distinct()
