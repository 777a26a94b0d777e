"""Exact Gini trees against a plain recursion over sorted values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.operators import cart


def gini(y, k):
    n = np.bincount(y, minlength=k)
    return 1 - (n * n).sum() / len(y) ** 2


def plain(x, y, k, depth, leaf, at=1):
    """{node: (counts, feature, threshold)}."""
    out = {at: (np.bincount(y, minlength=k).tolist(), None, None)}
    best = None
    if depth and gini(y, k) > 0:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for v, after in zip(values, values[1:]):
                low = x[:, f] <= v
                if low.sum() < leaf or (~low).sum() < leaf:
                    continue
                a, b = np.bincount(y[low], minlength=k), np.bincount(y[~low], minlength=k)
                score = (a * a).sum() / a.sum() + (b * b).sum() / b.sum()
                if best is None or score > best[0]:
                    best = (score, f, v / 2 + after / 2)
    if best:
        _, f, t = best
        out[at] = (out[at][0], f, t)
        low = x[:, f] <= t
        out |= plain(x[low], y[low], k, depth - 1, leaf, 2 * at) | plain(x[~low], y[~low], k, depth - 1, leaf, 2 * at + 1)
    return out


@pytest.mark.parametrize(("n", "depth", "leaf", "ranges"), [(400, 5, 5, 4), (150, 3, 1, 40), (60, 6, 20, 4)])
def test_trees_against_a_plain_recursion(spark, n, depth, leaf, ranges):
    rng = np.random.default_rng(n)
    x = np.column_stack([rng.normal(size=n).round(1), rng.integers(0, 4, n), rng.normal(size=n)]).astype(float)
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] == 2) + (rng.random(n) < 0.15)) % 3
    test = rng.random(n) < 0.3
    rows = [(f"c{c}", *map(float, v), bool(t)) for c, v, t in zip(y, x, test)] + [("c0", None, 1.0, 1.0, False), (None, 1.0, 1.0, 1.0, False), ("c1", float("nan"), 1.0, 1.0, True)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        tree = cart.cart(spark.createDataFrame(rows, "k string, a double, b double, c double, t boolean").repartition(3), "k", ["a", "b", "c"], F.col("t"), depth, leaf)
        want = plain(x[~test], y[~test], 3, depth, leaf)
        assert {i: (node.counts, node.feature, node.threshold) for i, node in tree.nodes.items()} == want
        gain = dict.fromkeys("abc", 0.0)
        for i, (counts, f, _) in want.items():
            if f is not None:
                impure = lambda c: sum(c) - sum(v * v for v in c) / sum(c)
                gain["abc"[f]] += impure(counts) - impure(want[2 * i][0]) - impure(want[2 * i + 1][0])
        assert {r["feature"]: r["importance"] for r in tree.importances.collect()} == {f: pytest.approx(g / sum(gain.values())) for f, g in gain.items()}

        def guess(v, at=1):
            counts, f, t = want[at]
            return f"c{counts.index(max(counts))}" if f is None else guess(v, 2 * at if v[f] <= t else 2 * at + 1)

        assert sorted(map(tuple, tree.predictions.collect())) == sorted((f"c{c}", guess(v)) for c, v in zip(y[test], x[test]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tree.text().count("class:") == sum(f is None for _, f, _ in want.values())


def test_trees_without_training_rows_or_splits(spark):
    rows = spark.createDataFrame([("a", 1.0, False), ("a", 2.0, False), ("a", 3.0, True)], "k string, x double, t boolean")
    one = cart.cart(rows, "k", ["x"], F.col("t"))
    assert one.predictions.collect() == [("a", "a")] and one.text() == "|--- class: a" and one.importances.collect() == [("x", 0.0)]
    none = cart.cart(rows.filter("t"), "k", ["x"], F.col("t"))
    assert none.predictions.count() == 0 and none.text() == ""
