"""Spectral embedding on a sparse graph of nearest neighbours.

The graph has each site's k nearest, both ways, with Gaussian weights. The leading eigenvectors of its normalised adjacency
(the lowest of the normalised Laplacian) come from blocks of a power iteration: a step multiplies a few columns by the matrix
in one join, in a recurrence that keeps powers apart, and sums the products of all columns (a small matrix) to turn them into
eigenvectors. No table has more rows than the graph has edges.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lloyd
from .graph import removed, stored
from .neighbours import nearest
from .tiles import BLOCK, matrix

#: Neighbours of a site, columns beyond the wanted ones, powers in a block, blocks, and the residual that ends them.
NEIGHBOURS, BESIDE, POWERS, BLOCKS, RESIDUAL = 10, 4, 4, 40, 1e-5


def affinity(features: DataFrame, neighbours: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """src, dst, w of features (site long, v), both ways: exp(-d2 / mean d2) over the neighbours' squared distances d2."""
    rows = stored(features.select(F.col("site").alias("c"), "v", F.lit(1.0).alias("n"), F.lit(True).alias("open")), "spectral-rows")
    near = stored(nearest(rows, neighbours, block).select("c", "b", (2 * F.col("h")).alias("d2")), "spectral-near")
    width = near.agg(F.avg("d2")).first()[0] or 1.0
    both = near.select(F.col("c").alias("src"), F.col("b").alias("dst"), "d2").union(near.select("b", "c", "d2"))
    return both.groupBy("src", "dst").agg(F.exp(-F.min("d2") / width).alias("w"))


def _products(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over rows of all products of two columns."""
    total = None
    for part in parts:
        z = matrix(part[0])
        total = z.T @ z if total is None else total + z.T @ z
    if total is not None:
        i, j = np.indices(total.shape, np.int32)
        yield pa.RecordBatch.from_pydict({"i": i.ravel(), "j": j.ravel(), "p": total.ravel()})


def _times(z: DataFrame, edges: DataFrame, at: int, columns: int) -> DataFrame:
    """c, y: the matrix times the columns of z (c, z) from position at on."""
    parts = z.select(F.col("c").alias("dst"), *[F.get("z", F.lit(at + i)).alias(f"x{i}") for i in range(columns)])
    sums = edges.join(parts, "dst").groupBy("src").agg(*[F.sum(F.col("w") * F.col(f"x{i}")).alias(f"x{i}") for i in range(columns)])
    return sums.select(F.col("src").alias("c"), F.array(*[f"x{i}" for i in range(columns)]).alias("y"))


def embedding(edges: DataFrame, wanted: int, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """c, x (so many coordinates) of the nodes of a symmetric graph (src, dst, w), and the normalised Laplacian's lowest
    eigenvalues, rising. Coordinates are eigenvectors over the root of the degree, of length 1 before that."""
    edges = stored(edges, "spectral-edges")
    degree = stored(edges.groupBy(F.col("src").alias("c")).agg(F.sum("w").alias("degree")), "spectral-degree")
    far = degree.select(F.col("c").alias("dst"), F.col("degree").alias("d2"))
    scaled = stored(edges.join(degree.withColumnRenamed("c", "src"), "src").join(far, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("degree") * F.col("d2"))).alias("w")), "spectral-scaled")
    n = degree.count()
    wanted = min(wanted, n)
    r = min(n, wanted + BESIDE)
    z = degree.select("c", F.array(F.sqrt("degree"), *[lloyd.uniform(F.col("c"), seed, i) - 0.5 for i in range(1, r)]).alias("z"))
    held = None

    def kept(z: DataFrame) -> DataFrame:
        """z as a table in place of the one that it was made of."""
        nonlocal held
        new = stored(z, "spectral-z")
        if held is not None:
            removed(held)
        held = new
        return new

    for block in range(BLOCKS):
        z = kept(z)
        for m in range(POWERS):
            y = _times(z, scaled, m * r, r)
            more = F.col("y") if m == 0 else F.zip_with("y", F.slice("z", (m - 1) * r + 1, r), lambda a, b: 2 * a - b)
            zero = F.array(*[F.lit(0.0)] * r)
            z = kept(z.join(y, "c", "left").withColumn("y", F.coalesce("y", zero)).select("c", F.concat("z", more).alias("z")))
        width = (POWERS + 1) * r
        gram = np.zeros((width, width))
        for x in z.select("z").mapInArrow(_products, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect():  # a row for each cell of the small matrix
            gram[x["i"], x["j"]] = x["p"]
        # the matrix times each column of the recurrence, in terms of its columns
        times = np.zeros((width, POWERS * r))
        for m in range(POWERS):
            for i in range(r):
                if m == 0:
                    times[r + i, i] = 1
                else:
                    times[(m + 1) * r + i, m * r + i] = times[(m - 1) * r + i, m * r + i] = 0.5
        inner = POWERS * r
        own = gram[:inner, :inner]
        size, turn = np.linalg.eigh(own)
        keep = size > 1e-13 * size[-1]
        white = turn[:, keep] / np.sqrt(size[keep])
        small = white.T @ (gram[:inner] @ times) @ white
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:r], (white @ vectors[:, ::-1])[:, :r]
        left = times @ vectors
        left[:inner] -= vectors * values
        residual = np.sqrt(np.maximum(np.einsum("ij,ij->j", left, gram @ left), 0))[:wanted]
        if vectors.shape[1] < r:  # fewer directions than columns
            vectors = np.pad(vectors, ((0, 0), (0, r - vectors.shape[1])))

        def turned(parts: Iterable[pa.RecordBatch], vectors: np.ndarray = vectors, inner: int = inner) -> Iterator[pa.RecordBatch]:
            for part in parts:
                made = matrix(part[1])[:, :inner] @ vectors
                yield pa.RecordBatch.from_arrays([part[0], pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), made.shape[1]).cast(pa.list_(pa.float64()))], names=["c", "z"])

        z = z.mapInArrow(turned, "c long, z array<double>")
        if (residual <= RESIDUAL).all():
            break
    out = z.join(degree, "c").select("c", F.transform(F.slice("z", 1, wanted), lambda x: x / F.sqrt("degree")).alias("x"))
    return out, [float(1 - v) for v in values[:wanted]]


def clustered(features: DataFrame, k: int, neighbours: int = NEIGHBOURS, seed: int = 42) -> DataFrame:
    """site, cluster: k-means on the first k coordinates of the embedding. A table with one site is one cluster."""
    rows = stored(features.select(F.col("site").cast("long").alias("site"), "v"), "spectral-sites")
    if rows.count() < 2:
        return rows.select("site", F.lit(0).alias("cluster"))
    at = stored(embedding(affinity(rows, neighbours), k, seed)[0].select(F.lit(0).alias("t"), F.col("c").alias("site"), F.col("x").alias("v")), "spectral-at")
    runs, _ = lloyd.fits(at, lloyd.starts(at, [k], seed))
    return lloyd.assigned(at, runs).select("site", "cluster")
