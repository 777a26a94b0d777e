"""Many k-means fits in one pass: every round assigns each row for all runs at once and sends on sums.

A run is a table (t) and a number of clusters (k). Starts are those of k-means||: rows are taken with a chance in
proportion to their cost, in a few passes for all tables together, weighted by the rows nearest to each, and reduced to k
centres on the driver, which never holds more than those candidates and the centres.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import euclidean, matrix

#: Passes that take candidates, candidates a pass as a multiple of the largest k, rounds on the driver that reduce them.
PASSES, OVERSAMPLE, LOCAL = 2, 2, 30
#: Rounds over the rows, and the distance that a centre must move for another one.
ROUNDS, MOVED = 20, 1e-4

Runs = dict[tuple[int, int], np.ndarray]


def uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) that depends on nothing but these columns."""
    return F.pmod(F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 52)) / float(1 << 52)


def _by_table(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    for part in parts:
        t = np.asarray(part[0])
        for one in np.unique(t):
            at = np.flatnonzero(t == one)
            some = part.take(pa.array(at))
            yield int(one), some, matrix(some[1])


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = euclidean(x, centres)
    return d * d


def _sums(runs: Runs) -> Callable:
    """t, k, cluster, i, x: sums of coordinates i of the rows of each cluster; i = -1 is their number, -2 their cost."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for t, _, x in _by_table(parts):
            for key, centres in runs.items():
                if key[0] != t:
                    continue
                d = _squares(x, centres)
                near = d.argmin(1)
                total = held.setdefault(key, np.zeros((len(centres), x.shape[1] + 2)))
                np.add.at(total, near, np.column_stack([d[np.arange(len(x)), near], np.ones(len(x)), x]))
        for (t, k), total in held.items():
            c, i = np.indices(total.shape)
            yield pa.RecordBatch.from_pydict({"t": np.full(c.size, t, np.int32), "k": np.full(c.size, k, np.int32), "cluster": c.ravel().astype(np.int32), "i": (i.ravel() - 2).astype(np.int32), "x": total.ravel()})

    return run


def _gathered(data: DataFrame, runs: Runs) -> dict[tuple[int, int], np.ndarray]:
    made = data.select("t", "v").mapInArrow(_sums(runs), "t int, k int, cluster int, i int, x double").groupBy("t", "k", "cluster", "i").agg(F.sum("x").alias("x"))
    out = {key: np.zeros((len(c), c.shape[1] + 2)) for key, c in runs.items()}
    for r in made.collect():  # a row for each coordinate of each centre
        out[r["t"], r["k"]][r["cluster"], r["i"] + 2] = r["x"]
    return out


def _reduced(x: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of weighted candidates: k-means++ draws, then a few rounds."""
    first = rng.choice(len(x), p=weights / weights.sum())
    chosen, cost = [first], _squares(x, x[[first]])[:, 0]
    for _ in range(1, min(k, len(x))):
        chance = weights * cost
        new = int(rng.choice(len(x), p=chance / chance.sum())) if chance.sum() > 0 else int(rng.integers(len(x)))
        chosen.append(new)
        cost = np.minimum(cost, _squares(x, x[[new]])[:, 0])
    centres = x[chosen].copy()
    for _ in range(LOCAL):
        near = _squares(x, centres).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x * weights[:, None])
        n = np.bincount(near, weights, len(centres))
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1e-300)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres if len(centres) == k else np.concatenate([centres, centres[[0] * (k - len(centres))]])


def starts(data: DataFrame, ks: Iterable[int], seed: int = 42) -> Runs:
    """Starting centres of every run of data (t, site, v); fewer distinct rows than k repeat a centre."""
    most = max(ks)
    chance = lambda r: uniform(F.col("t"), F.col("site"), seed, r)
    first = data.groupBy("t").agg(F.min_by("v", F.struct(chance(0).alias("u"), "site")).alias("v")).collect()  # one row of each table
    found = {r["t"]: np.array([r["v"]], float) for r in first}
    for r in range(1, PASSES + 1):
        whole = _gathered(data, {(t, 1): c for t, c in found.items()})
        share = {t: OVERSAMPLE * most / s[:, 0].sum() if s[:, 0].sum() > 0 else 0.0 for (t, _), s in whole.items()}
        before = dict(found)

        def drawn(parts: Iterable[pa.RecordBatch], before: dict = before, share: dict = share) -> Iterator[pa.RecordBatch]:
            for t, part, x in _by_table(parts):
                take = np.flatnonzero(np.asarray(part[2]) < share[t] * _squares(x, before[t]).min(1))
                yield part.select(["t", "v"]).take(pa.array(take))

        # expected: OVERSAMPLE x most rows of each table
        new = data.select("t", F.col("v").cast("array<double>").alias("v"), chance(r).alias("u")).mapInArrow(drawn, "t int, v array<double>").collect()
        for t in found:
            found[t] = np.unique(np.concatenate([found[t], *[np.array([x["v"]], float) for x in new if x["t"] == t]]), axis=0)
    weights = {t: s[:, 1] for (t, _), s in _gathered(data, {(t, 1): c for t, c in found.items()}).items()}
    rng = np.random.default_rng(seed)
    return {(t, k): _reduced(found[t], np.maximum(weights[t], 1e-9), k, rng) for t in sorted(found) for k in ks}


def fits(data: DataFrame, runs: Runs, rounds: int = ROUNDS) -> tuple[Runs, dict[tuple[int, int], float]]:
    """Centres and costs of all runs from their starting centres, one job a round; runs that stand still leave the rounds."""
    runs, going = dict(runs), dict(runs)
    for _ in range(rounds):
        if not going:
            break
        sums = _gathered(data, going)
        for key, total in sums.items():
            n = total[:, 1:2]
            new = np.where(n > 0, total[:, 2:] / np.maximum(n, 1), runs[key])
            if (np.linalg.norm(new - runs[key], axis=1) <= MOVED).all():
                del going[key]
            else:
                going[key] = new
            runs[key] = new
    return runs, {key: float(total[:, 0].sum()) for key, total in _gathered(data, runs).items()}


def assigned(features: DataFrame, runs: Runs) -> DataFrame:
    """k, site, cluster of features (site, v) for the runs of table 0."""
    kind = dict(features.dtypes)["site"]

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = matrix(part[1])
            for (_, k), centres in runs.items():
                near = _squares(x, centres).argmin(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), part[0], pa.array(near)], names=["k", "site", "cluster"])

    return features.select("site", "v").mapInArrow(run, f"k int, site {kind}, cluster int")
