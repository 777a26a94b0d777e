"""Ward's tree by mutual nearest neighbours.

Clusters that are each other's nearest join, all such pairs of a round at once; this makes the same tree as joining the
nearest pair each time. A join can't bring anything nearer than its parts were, so only clusters that joined, or whose
neighbour did, look for a new neighbour, and they read the blocks that can hold it, not all clusters. The last few hundred
clusters, a bounded number, are joined in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut, depth_to_outlet, shared_folder, stored
from .neighbours import gaps, nearest
from .tiles import BLOCK

#: Clusters that one task joins to the end.
LAST = 1024


def _to_the_end(names: np.ndarray, x: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """The joins of few clusters, nearest pair first; names rise, so the first of equal pairs has the least names."""
    x, n = x.copy(), n.astype(float).copy()
    h = gaps(x, n, x, n)
    np.fill_diagonal(h, np.inf)
    for _ in range(len(names) - 1):
        i = int(h.min(1).argmin())
        j = int(h[i].argmin())
        i, j = min(i, j), max(i, j)
        yield int(names[i]), int(names[j]), float(h[i, j])
        x[i] = (n[i] * x[i] + n[j] * x[j]) / (n[i] + n[j])
        n[i] += n[j]
        alive = np.isfinite(h.min(1))
        alive[[i, j]] = False
        h[j], h[:, j] = np.inf, np.inf
        new = np.where(alive, gaps(x[[i]], n[[i]], x, n)[0], np.inf)
        h[i], h[:, i] = new, new


def tree(features: DataFrame, last: int = LAST, block: int = BLOCK) -> DataFrame:
    """a, b, h: the joins of Ward's tree of features (site, v), a < b; a joined cluster has its least site's name.

    Equal points join first, at height 0. A table with one distinct point or none joins nothing else.
    """
    spark = features.sparkSession
    points = stored(features.groupBy("v").agg(F.min("site").alias("c"), F.count("*").cast("double").alias("n")), "ward")
    same = features.join(points.filter("n > 1").select("v", "c"), "v").filter("site <> c").select(F.col("c").cast("long").alias("a"), F.col("site").cast("long").alias("b"), F.lit(0.0).alias("h"))
    folder = f"{shared_folder(spark)}/ward-{uuid.uuid4().hex}"
    same.write.parquet(f"{folder}/same")
    state = stored(points.select(F.col("c").cast("long").alias("c"), "v", "n", F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("h")), "ward")
    rounds = 0
    while (left := state.count()) > last:
        asked = nearest(state.select("c", "v", "n", F.col("b").isNull().alias("open")), 1, block, rounds)
        state = stored(state.select("c", "v", "n", F.col("b").alias("_b"), F.col("h").alias("_h")).join(asked, "c", "left").select("c", "v", "n", F.coalesce("_b", "b").alias("b"), F.coalesce("_h", "h").alias("h")), "ward")
        back = state.select(F.col("c").alias("b"), F.col("b").alias("c"))
        pairs = stored(state.filter("c < b").join(back, ["c", "b"]).select(F.col("c").alias("a"), "b", "h"), "ward-pairs")
        if pairs.isEmpty():  # rounding made a circle of neighbours: the nearest pair goes on
            pairs = stored(state.orderBy("h", F.least("c", "b"), F.greatest("c", "b")).limit(1).select(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b"), "h"), "ward-pairs")
        pairs.write.parquet(f"{folder}/{rounds}")
        part = lambda name: state.select(F.col("c").alias(name), F.col("v").alias(f"v{name}"), F.col("n").alias(f"n{name}"))
        mean = F.zip_with("va", "vb", lambda x, y: (F.col("na") * x + F.col("nb") * y) / (F.col("na") + F.col("nb")))
        joined = pairs.select("a", "b").join(part("a"), "a").join(part("b"), "b").select(F.col("a").alias("c"), mean.alias("v"), (F.col("na") + F.col("nb")).alias("n"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("h"))
        gone = stored(pairs.select(F.explode(F.array("a", "b")).alias("g")), "ward-gone")
        rest = state.join(gone, F.col("c") == F.col("g"), "left_anti").join(gone, F.col("b") == F.col("g"), "left")
        rest = rest.select("c", "v", "n", F.when(F.col("g").isNull(), F.col("b")).alias("b"), F.when(F.col("g").isNull(), F.col("h")).alias("h"))
        state = stored(joined.unionByName(rest), "ward")
        rounds += 1

    def end(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("c")
        return pd.DataFrame(list(_to_the_end(part["c"].to_numpy(), np.stack(part["v"].to_list()), part["n"].to_numpy())), columns=["a", "b", "h"])

    if left > 1:
        state.groupBy().applyInPandas(end, "a long, b long, h double").write.parquet(f"{folder}/end")
    return spark.read.schema("a long, b long, h double").option("recursiveFileLookup", True).parquet(folder)


def labels(features: DataFrame, joins: DataFrame, k: int) -> DataFrame:
    """site, cluster: the tree cut into k; clusters are numbered by their least site. Fewer sites than k are a cluster each."""
    sites = features.select(F.col("site").cast("long").alias("c"), "site")
    low = joins.orderBy("h", "a", "b").limit(max(0, sites.count() - k)).select(F.col("b").alias("comid"), F.col("a").alias("tocomid"))
    ends = depth_to_outlet(cut(sites.select(F.col("c").alias("comid")).join(low, "comid", "left")))
    named = stored(sites.join(ends, F.col("c") == F.col("comid")).select("site", F.col("outlet").alias("o")), "ward-labels")
    names = named.groupBy("o").agg(F.min("site").alias("first"))  # k rows
    ranks = names.join(names.select(F.col("first").alias("other")), F.col("other") < F.col("first"), "left").groupBy("o").agg(F.count("other").cast("int").alias("cluster"))
    return named.join(ranks, "o").select("site", "cluster")
