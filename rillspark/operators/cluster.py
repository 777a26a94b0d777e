"""Clustering of sites and scores of clusterings.

Feature tables are (site, v array<double>). What takes all pairs of sites (silhouettes, warping distances) runs in tiles that
send on sums; only a distance matrix that is asked for has a row for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lloyd, spectral, tiles, ward, warping
from .graph import cut, stored

METHODS = ("kmeans", "agglomerative", "spectral")


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def kmeans(features: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """site, cluster."""
    return fitted(features, k, seed)[0]


def fitted(features: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, float]:
    """site, cluster of k-means, and its inertia."""
    data = features.select("site", array_to_vector("v").alias("features"))
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(data)
    return model.transform(data).select("site", "cluster"), model.summary.trainingCost


def inertia(features: DataFrame, k: int, seed: int = 42) -> float:
    return KMeans(k=k, seed=seed).fit(features.select(array_to_vector("v").alias("features"))).summary.trainingCost


def agglomerative(features: DataFrame, k: int) -> DataFrame:
    """site, cluster by Ward's criterion: the tree cut after its n - k lowest joins."""
    features = stored(features.select("site", "v"), "features")
    return ward.labels(features, ward.tree(features), k)


def fit(features: DataFrame, method: str = "kmeans", k: int = 4) -> DataFrame:
    if method not in METHODS:
        raise NotImplementedError(method)
    return {"kmeans": kmeans, "agglomerative": agglomerative, "spectral": spectral.clustered}[method](features, k)


def pca(features: DataFrame, components: int | float | None = 0.95) -> tuple[DataFrame, list[float]]:
    """site and PC1.. of centred features, and the explained shares; a fraction takes as many as reach it, None all."""
    data = features.select("site", array_to_vector("v").alias("x"))
    data = StandardScaler(inputCol="x", outputCol="c", withMean=True, withStd=False).fit(data).transform(data)
    width = len(features.first()["v"])
    model = PCA(k=width if not isinstance(components, int) else components, inputCol="c", outputCol="p").fit(data)
    share = list(model.explainedVariance)
    k = len(share) if components is None or isinstance(components, int) else int(np.searchsorted(np.cumsum(share), components - 1e-12) + 1)
    p = vector_to_array("p")
    return model.transform(data).select("site", *[p[i].alias(f"PC{i + 1}") for i in range(k)]), share[:k]


def gap_statistic(features: DataFrame, ks: range = range(2, 13), references: int = 10, seed: int = 42) -> DataFrame:
    """k, gap: mean log inertia of uniform references in the features' box, less the log inertia of the features.

    All numbers of clusters and all references are fitted together, a job a round.
    """
    data = stored(tables(features, references, seed), "gap")
    _, costs = lloyd.fits(data, lloyd.starts(data, ks, seed))
    logs = {key: np.log(max(c, 1e-300)) for key, c in costs.items()}
    rows = [(k, float(np.mean([logs[t, k] for t in range(1, references + 1)]) - logs[0, k])) for k in ks] if logs else []
    return features.sparkSession.createDataFrame(rows, "k int, gap double")


def tables(features: DataFrame, references: int, seed: int) -> DataFrame:
    """t, site, v: the features as table 0, and for each a uniform point of their box in tables 1 to references."""
    features = features.select("site", "v")
    first = features.first()
    box = features.agg(*[f(F.col("v")[i]) for i in range(len(first["v"]) if first else 0) for f in (F.min, F.max)] or [F.lit(0)]).first()
    point = F.array(*[F.lit(low) + lloyd.uniform(F.col("t"), F.col("site"), seed, i, 7) * (high - low) for i, (low, high) in enumerate(zip(box[::2], box[1::2], strict=False))])
    made = features.select(F.explode(F.sequence(F.lit(1), F.lit(references))).alias("t"), "site").select("t", "site", point.cast("array<double>").alias("v"))
    return features.select(F.lit(0).alias("t"), "site", "v").unionByName(made)


def centroids(labelled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, cluster, n, m (mean array) of site, cluster, v; by names columns that tell clusterings apart."""
    items = labelled.select(*by, "cluster", F.posexplode("v").alias("i", "x")).groupBy(*by, "cluster", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return items.groupBy(*by, "cluster").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))


def davies_bouldin(labelled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    mid, keys = centroids(labelled, by), [*by, "cluster"]
    spread = labelled.join(mid, keys).groupBy(*keys).agg(F.avg(F.sqrt(squared(F.col("v"), F.col("m")))).alias("s")).join(mid, keys)
    a, b = (spread.select(*[F.col(c).alias(f"{c}_{x}") for c in by], F.col("cluster").alias(f"c{x}"), F.col("s").alias(f"s{x}"), F.col("m").alias(f"m{x}")) for x in "ab")
    other = F.col("ca") != F.col("cb")
    for c in by:
        other &= F.col(f"{c}_a") == F.col(f"{c}_b")
    worst = a.join(b, other).groupBy(*[F.col(f"{c}_a").alias(c) for c in by], "ca").agg(F.max(F.try_divide(F.col("sa") + F.col("sb"), F.sqrt(squared(F.col("ma"), F.col("mb"))))).alias("r"))
    return worst.groupBy(*by).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(labelled: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    one = labelled if by else labelled.withColumn("_one", F.lit(1))
    by_ = by or ("_one",)
    mid = centroids(one, by_)
    whole = centroids(one.withColumn("cluster", F.lit(0)), by_).select(*by_, F.col("m").alias("g"), F.col("n").alias("total"))
    between = mid.join(whole, [*by_]).groupBy(*by_).agg(F.sum(F.col("n") * squared(F.col("m"), F.col("g"))).alias("b"), F.count("*").alias("k_"), F.max("total").alias("n"))
    within = one.join(mid.select(*by_, "cluster", "m"), [*by_, "cluster"]).groupBy(*by_).agg(F.sum(squared(F.col("v"), F.col("m"))).alias("w"))
    return between.join(within, [*by_]).select(*by, F.try_divide(F.col("b") * (F.col("n") - F.col("k_")), F.col("w") * (F.col("k_") - 1)).alias("calinski_harabasz"))


def distances(features: DataFrame) -> DataFrame:
    """a, b, distance for all pairs of sites a < b."""
    return tiles.all_distances(features)


def silhouette(labels: DataFrame, apart: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean silhouette of site, cluster by given distances of pairs (a, b, distance); a site alone in its cluster counts 0.

    Distances don't depend on the clustering: they're computed once, whatever the number of clusterings.
    """
    both = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    own = labels.select(*by, F.col("site").alias("a"), F.col("cluster").alias("ca"))
    other = labels.select(*by, F.col("site").alias("b"), F.col("cluster").alias("cb"))
    means = both.join(own, "a").join(other, [*by, "b"]).groupBy(*by, "a", "ca", "cb").agg(F.avg("distance").alias("d"))
    per = means.groupBy(*by, "a").agg(F.max(F.when(F.col("ca") == F.col("cb"), F.col("d"))).alias("own"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("d"))).alias("other"))
    s = F.when(F.col("own").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")), F.lit(0.0)))
    return per.groupBy(*by).agg(F.avg(s).alias("silhouette"))


def sweep(features: DataFrame, ks: range = range(2, 13), seed: int = 42) -> DataFrame:
    """k, inertia, silhouette, davies_bouldin of k-means for each k, scored on the features; all k are fitted together."""
    features = stored(features.select("site", "v"), "sweep")
    data = features.select(F.lit(0).alias("t"), "site", "v")
    runs, costs = lloyd.fits(data, lloyd.starts(data, ks, seed))
    labels = stored(lloyd.assigned(features, runs), "sweep-labels")
    costs = features.sparkSession.createDataFrame([(k, c) for (_, k), c in costs.items()], "k int, inertia double")
    return costs.join(tiles.silhouettes(labels, features, "k"), "k").join(davies_bouldin(labels.join(features, "site"), ("k",)), "k")


def dtw_matrix(features: DataFrame) -> DataFrame:
    """a, b, distance for all pairs a < b: the root of the summed squared cost along the best warping path."""
    return tiles.all_distances(features, "warping")


#: Series that starting centres are drawn from, an expected number; all series take part in every round.
SAMPLE = 256
#: Points of series that a task of a round takes, and the most tasks.
POINTS, TASKS = 1 << 15, 1024

Runs = dict[tuple[str, int, int], np.ndarray]


def _spread(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k series, each drawn in proportion to its cost of warping to those drawn before."""
    chosen = [int(rng.integers(len(sample)))]
    every = np.arange(len(sample))
    cost = np.full(len(sample), np.inf)
    while len(chosen) < k:
        cost = np.minimum(cost, warping.warped(sample, sample, every, np.full(len(sample), chosen[-1])))
        chosen.append(int(rng.choice(len(sample), p=cost / cost.sum())) if cost.sum() > 0 else int(rng.integers(len(sample))))
    return sample[chosen]


def _starts(keyed: DataFrame, ks: range, starts: int, seed: int) -> Runs:
    sizes = {r["key"]: r["count"] for r in keyed.groupBy("key").count().collect()}  # a row for each variant
    share = F.element_at(F.create_map(*[x for key, n in sizes.items() for x in (F.lit(key), F.lit(SAMPLE / n))]), F.col("key")) if sizes else F.lit(0.0)
    out: Runs = {}
    for s in range(starts):
        chance = lloyd.uniform(F.col("key"), F.col("site"), seed, s)
        # about SAMPLE rows of each variant, and the one with the least chance of all in any case
        drawn = keyed.filter(chance < share).select("key", "site", "v").union(keyed.groupBy("key").agg(F.min_by(F.struct("site", "v"), F.struct(chance, "site")).alias("r")).select("key", "r.site", "r.v"))
        rows = sorted(set((r["key"], r["site"], tuple(r["v"])) for r in drawn.collect()))
        for key in sorted(sizes):
            order = _spread(np.array([v for x, _, v in rows if x == key], float), max(ks), np.random.default_rng(seed + s))
            out |= {(key, k, s): order[:k].copy() for k in ks}
    return out


def _series(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame, np.ndarray]]:
    for part in parts:
        for key, own in part.groupby("key", sort=True):
            yield key, own, np.stack(own["v"].to_list())


def _round(runs: Runs):
    """Sums over a batch of what aligns with each point of each run's centres, and the runs' costs (at point -1)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, _, series in _series(parts):
            for (of, k, s), centres in runs.items():
                if of != key:
                    continue
                best, cost = warping.nearest(series, centres)
                width, total, n = centres.shape[1], np.zeros(centres.size), np.zeros(centres.size, np.int64)
                for row, at, point, _, _ in warping.paths(series, centres[best]):
                    cell = best[row] * width + point
                    total += np.bincount(cell, series[row, at], centres.size)
                    n += np.bincount(cell, minlength=centres.size)
                some = np.flatnonzero(n)
                yield pd.DataFrame({"key": key, "k": k, "s": s, "cluster": np.append(some // width, 0), "i": np.append(some % width, -1), "x": np.append(total[some], cost.sum()), "n": np.append(n[some], len(series))})

    return run


def _labels(runs: Runs):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, own, series in _series(parts):
            for (of, k, _), centres in runs.items():
                if of == key:
                    yield pd.DataFrame({"key": key, "k": k, "site": own["site"], "cluster": warping.nearest(series, centres)[0]})

    return run


def dtw_clusterings(features: DataFrame, ks: range = range(2, 13), rounds: int = 10, starts: int = 2, seed: int = 42, by: str | None = None) -> DataFrame:
    """by, k, site, cluster by warping distance, for each k the best of several starts; by names a column of variants that are
    clustered apart (none: one variant). Centres are barycentres of what aligns.

    A round aligns every series with its nearest centre of all runs of all variants in one pass, summed before the shuffle;
    the driver holds the centres alone. A cluster that loses all its series keeps its centre.
    """
    key = F.col(by).cast("string") if by else F.lit("")
    keyed = stored(features.select(key.alias("key"), F.col("site").cast("long").alias("site"), "v"), "warping")
    points = keyed.agg(F.sum(F.size("v"))).first()[0] or 0
    # dealt by what a round takes, not by bytes: a few MB of series are minutes of work
    keyed = stored(keyed.repartition(min(TASKS, max(1, math.ceil(points / POINTS))), "key", "site"), "warping")
    runs = _starts(keyed, ks, starts, seed)
    costs = dict.fromkeys(runs, np.inf)
    for left in range(rounds, -1, -1):
        if not runs:
            break
        made = keyed.mapInPandas(_round(runs), "key string, k int, s int, cluster int, i int, x double, n long").groupBy("key", "k", "s", "cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # a row for each point of each centre
        new = {run: c.copy() for run, c in runs.items()}
        for r in made:
            run = r["key"], r["k"], r["s"]
            if r["i"] < 0:
                costs[run] = r["x"]
            else:
                new[run][r["cluster"], r["i"]] = r["x"] / r["n"]
        if left == 0 or all(np.allclose(new[run], runs[run]) for run in runs):
            break  # costs are those of the centres
        runs = new
    best: Runs = {}
    for run in sorted(runs, key=lambda r: (costs[r], r[2])):
        if not any(run[:2] == other[:2] for other in best):
            best[run] = runs[run]
    found = keyed.mapInPandas(_labels(best), "key string, k int, site long, cluster int")
    return found.withColumn("key", F.col("key").cast(dict(features.dtypes)[by])).withColumnRenamed("key", by) if by else found.drop("key")


def dtw_kmeans(features: DataFrame, k: int, rounds: int = 10, starts: int = 2, seed: int = 42) -> DataFrame:
    """site, cluster of dtw_clusterings() for one k."""
    return dtw_clusterings(features, range(k, k + 1), rounds, starts, seed).select("site", "cluster")


def time_warp(variants: DataFrame, ks: range = range(2, 13), rounds: int = 10, starts: int = 2, seed: int = 42, include_index: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Warping clusterings of several normalizations (variant, site, v) of the same series for each k.

    Scores: variant, k, silhouette (on warping distances), davies_bouldin, calinski_harabasz. Assignments: variant, k,
    site, cluster. Means: variant, k, cluster, n, m (mean series). All variants are fitted and scored together; an empty table
    gives none. include_index puts each point's number, from 1, before it, as readers that flatten two columns do.
    """
    v = F.flatten(F.transform("v", lambda x, i: F.array((i + 1).cast("double"), x))) if include_index else F.col("v")
    variants = stored(variants.select("variant", F.col("site").cast("long").alias("site"), v.alias("v")), "time-warp")
    by = ("variant", "k")
    labels = stored(dtw_clusterings(variants, ks, rounds, starts, seed, "variant").select(*by, "site", "cluster"), "time-warp-labels")
    labelled = labels.join(variants, ["variant", "site"])
    sil = tiles.silhouettes(labels, variants, "k", ("variant",), "warping")
    return sil.join(davies_bouldin(labelled, by), [*by]).join(calinski_harabasz(labelled, by), [*by]), labels, centroids(labelled, by)
