"""All pairs of sites in tiles, and nearest neighbours among blocks that can hold them.

Sites are dealt into blocks of bounded size. A tile is two blocks in one task, whose kernel goes through them in strips and
sends on sums, not pairs; so what is shuffled grows with sites x blocks. There are as many blocks as give every core some
tiles, and more only where a block would be too large to hold, so their number doesn't grow with the sites before that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .warping import crossed

#: Sites in a block, where a result has a row for each pair of its sites; the bytes that a kernel's temporary arrays may take.
BLOCK, BYTES = 512, 32 << 20
#: Tiles for each core, the fewest sites of a block that is cut off for them, the bytes of a block's numbers, the most tasks.
SHARE, LEAST, HELD, TASKS = 8, 16, 16 << 20, 4096


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of x from rows of y, from differences (no cancelling)."""
    out = np.empty((len(x), len(y)))
    step = max(1, BYTES // (8 * max(1, y.size)))
    for at in range(0, len(x), step):
        off = x[at : at + step, None, :] - y[None, :, :]
        out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", off, off))
    return out


def warping(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Warping distances of rows of x from rows of y."""
    return np.sqrt(crossed(x, y))


METRICS = {"euclidean": euclidean, "warping": warping}


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def strips(n: int, width: int) -> Iterator[slice]:
    """Stretches of n rows; a matrix of one and width columns stays within BYTES."""
    step = max(1, BYTES // (8 * max(1, width)))
    for at in range(0, n, step):
        yield slice(at, min(n, at + step))


def block_size(most: int, numbers: int, cores: int, size: int | None = None) -> int:
    """Sites in a block of a table with so many sites and numbers a site: SHARE tiles for each core, of bounded bytes; at most size."""
    fit = max(LEAST, math.ceil(most / math.ceil(math.sqrt(2 * SHARE * cores))))
    return max(1, min(fit, HELD // (8 * max(1, numbers)), size or fit))


def tiles(rows: DataFrame, kernel: Callable[[pa.Table, pa.Table | None], Iterator[pa.Table]], schema: str, within: tuple[str, ...] = (), size: int | None = None) -> DataFrame:
    """kernel's rows of all tiles of rows (within, site, v, ...); within names columns that keep tables apart.

    kernel gets two blocks of a table, or one and None for the pairs inside a block; each pair of sites is in one tile. size
    is the most sites in a block. Tiles are dealt to tasks by their number, as what a tile takes isn't told by its bytes.
    """
    counts = rows.groupBy(*within).agg(F.count("*").alias("n"), F.max(F.size("v")).alias("wide"))
    top = counts.agg(F.max("n").alias("most"), F.count("*").alias("tables"), F.max("wide").alias("wide")).first()
    most = top["most"] or 1
    arrays = sum(kind.startswith("array") for _, kind in rows.dtypes)
    n = math.ceil(most / block_size(most, (top["wide"] or 1) * arrays, rows.sparkSession.sparkContext.defaultParallelism, size))
    block = F.pmod(F.xxhash64("site"), F.lit(n)).cast("int")
    dealt = rows.withColumn("_b", block)
    left = dealt.select("*", F.col("_b").alias("_i"), F.explode(F.sequence("_b", F.lit(n - 1))).alias("_j"), F.lit(0).alias("_side"))
    right = dealt.filter("_b > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_i"), F.col("_b").alias("_j"), F.lit(1).alias("_side"))
    tasks = min(TASKS, max(1, top["tables"] * n * (n + 1) // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        one = table["_i"][0].as_py() == table["_j"][0].as_py()
        side = np.asarray(table["_side"])
        if not one and (side == side[0]).all():  # a smaller table of several has no sites in one of the blocks
            return
        for made in kernel(table, None) if one else kernel(table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))):
            yield from made.combine_chunks().to_batches()

    return left.unionByName(right).repartition(tasks, *within, "_i", "_j").groupBy(*within, "_i", "_j").applyInArrow(run, schema)


def all_distances(features: DataFrame, metric: str = "euclidean", within: tuple[str, ...] = (), size: int = BLOCK) -> DataFrame:
    """within, a, b, distance of all pairs of sites a < b."""
    far, kinds = METRICS[metric], dict(features.dtypes)
    columns = features.select(*within, "site", "v")

    def kernel(x: pa.Table, y: pa.Table | None) -> Iterator[pa.Table]:
        other = x if y is None else y
        left, right, p, q = x["site"].combine_chunks(), other["site"].combine_chunks(), matrix(x["v"]), matrix(other["v"])
        for part in strips(len(x), 8 * len(other)):
            d = far(p[part], q).ravel()
            i, j = np.indices((part.stop - part.start, len(other))).reshape(2, -1)
            i += part.start
            if y is None:
                i, j, d = i[i < j], j[i < j], d[i < j]
            a, b = left.take(pa.array(i)), right.take(pa.array(j))
            swap = pa.compute.greater(a, b)
            ends = [pa.compute.if_else(swap, b, a), pa.compute.if_else(swap, a, b)]
            yield pa.table([*(x[c].combine_chunks().take(pa.array(np.zeros(len(d), np.int64))) for c in within), *ends, pa.array(d)], names=[*within, "a", "b", "distance"])

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in within), f"a {kinds['site']}, b {kinds['site']}, distance double"])
    return tiles(columns, kernel, schema, within, size)


def silhouettes(labels: DataFrame, features: DataFrame, run: str | None = None, within: tuple[str, ...] = (), metric: str = "euclidean", size: int | None = None) -> DataFrame:
    """within, run, silhouette: the mean silhouette of clusterings (within, run, site, cluster) of features (within, site, v).

    Distances of a tile are computed once for all runs; a tile sends on a sum for each site, run and cluster of the other
    block. A site alone in its cluster counts 0; so does one in the only cluster.
    """
    far, kinds = METRICS[metric], dict(features.dtypes)
    number = F.col(run).cast("int") if run else F.lit(0)
    flat = cut(labels.select(*within, number.alias("run"), "site", F.col("cluster").cast("int").alias("cluster")))
    wide = flat.groupBy(*within, "site").agg(F.array_sort(F.collect_list(F.struct("run", "cluster"))).alias("l"))
    rows = wide.join(features.select(*within, "site", "v"), [*within, "site"]).select(*within, "site", "v", F.col("l.run").alias("runs"), F.col("l.cluster").alias("clusters"))

    def hot(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For clusterings (columns) of rows: a column for each cluster, 1 where a row is in it; each one's run and cluster."""
        found = [np.unique(c, return_inverse=True) for c in of.T]
        out, at = np.zeros((len(of), sum(len(f) for f, _ in found))), 0
        for f, place in found:
            out[np.arange(len(of)), at + place] = 1
            at += len(f)
        return out, np.repeat(np.arange(len(found)), [len(f) for f, _ in found]), np.concatenate([f for f, _ in found])

    def sums(x: pa.Table, part: slice, total: np.ndarray, run_of: np.ndarray, cluster: np.ndarray) -> pa.Table:
        site = x["site"].combine_chunks().slice(part.start, len(total))
        again = pa.array(np.repeat(np.arange(len(total)), total.shape[1]))
        named = [x[c].combine_chunks().slice(0, 1).take(pa.array(np.zeros(total.size, np.int64))) for c in within]
        return pa.table([*named, pa.array(np.tile(run_of, len(total)).astype(np.int32)), site.take(again), pa.array(np.tile(cluster, len(total)).astype(np.int32)), pa.array(total.ravel())], names=[*within, "run", "site", "cluster", "total"])

    def kernel(x: pa.Table, y: pa.Table | None) -> Iterator[pa.Table]:
        other = x if y is None else y
        runs, p, q = matrix(x["runs"])[0].astype(int), matrix(x["v"]), matrix(other["v"])
        (mine, my_run, my_cluster), (theirs, their_run, their_cluster) = (hot(matrix(t["clusters"]).astype(int)) for t in (x, other))
        back = np.zeros((len(other), mine.shape[1]))
        for part in strips(len(x), max(len(other), 4 * theirs.shape[1])):
            d = far(p[part], q)
            yield sums(x, part, d @ theirs, runs[their_run], their_cluster)
            if y is not None:
                back += d.T @ mine[part]
        if y is not None:
            for part in strips(len(y), 4 * mine.shape[1]):
                yield sums(y, part, back[part], runs[my_run], my_cluster)

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in within), f"run int, site {kinds['site']}, cluster int, total double"])
    by = [*within, "run"]
    total = tiles(rows, kernel, schema, within, size).groupBy(*by, "site", "cluster").agg(F.sum("total").alias("total"))
    sizes = flat.groupBy(*by, "cluster").agg(F.count("*").alias("n"))
    own = flat.select(*by, "site", F.col("cluster").alias("own"))
    means = total.join(sizes, [*by, "cluster"]).join(own, [*by, "site"])
    same = F.col("cluster") == F.col("own")
    mean = F.when(same, F.try_divide(F.col("total"), F.col("n") - 1)).otherwise(F.col("total") / F.col("n"))
    per = means.groupBy(*by, "site").agg(F.max(F.when(same & (F.col("n") > 1), mean)).alias("a"), F.min(F.when(~same, mean)).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    out = per.groupBy(*by).agg(F.avg(s).alias("silhouette"))
    return out.withColumnRenamed("run", run) if run else out.drop("run")
