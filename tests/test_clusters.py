"""Tiles, pruned neighbours, Ward trees, spectral embeddings, k-means runs and bounded warping against plain NumPy."""

import subprocess
import sys

import numpy as np
import pytest

from rillspark.operators import cluster, lloyd, neighbours, spectral, tiles, ward, warping
from rillspark.operators.graph import stored

from .test_operators import blobs, plain_dtw

RNG = np.random.default_rng(9)


def table(spark, x, **more):
    names = "".join(f", {k} {'string' if isinstance(v, str) else 'int'}" for k, v in more.items())
    return spark.createDataFrame([(i, [float(c) for c in v], *more.values()) for i, v in enumerate(x)], f"site long, v array<double>{names}").repartition(3)


@pytest.mark.parametrize(("p", "q"), [(1, 1), (1, 5), (12, 12), (7, 13), (40, 9)])
def test_warping_against_the_whole_table(p, q):
    x, y = RNG.normal(size=(9, p)), RNG.normal(size=(9, q))
    i, j = np.divmod(np.arange(81), 9)
    want = np.array([plain_dtw(x[a], y[b])[-1, -1] for a, b in zip(i, j)])
    assert np.allclose(warping.warped(x, y, i, j), want, rtol=1e-12)
    limit = np.full(81, np.median(want))
    assert np.array_equal(warping.warped(x, y, i, j, limit), np.where(warping.warped(x, y, i, j) <= limit, warping.warped(x, y, i, j), np.inf))
    assert (warping.lower_bounds(x, y).ravel() <= want + 1e-12).all()
    best, cost = warping.nearest(x, y[:4])
    assert best.tolist() == want.reshape(9, 9)[:, :4].argmin(1).tolist() and np.allclose(cost, want.reshape(9, 9)[:, :4].min(1))


def test_warping_limits_drop_pairs_midway_and_ties_take_the_first():
    x = RNG.normal(size=(20, 150)).cumsum(1)
    i, j = np.divmod(np.arange(400), 20)
    whole = warping.warped(x, x, i, j)
    assert np.array_equal(warping.warped(x, x, i, j, np.full(400, 5.0)), np.where(whole <= 5, whole, np.inf))
    assert warping.nearest(x, np.concatenate([x[:3], x[:3]]))[0][:3].tolist() == [0, 1, 2]


def test_paths_against_steps_taken_one_at_a_time(monkeypatch):
    x, y = RNG.normal(size=(9, 6)), RNG.normal(size=(9, 6))
    for size in (1, 48 << 20):
        monkeypatch.setattr(warping, "BYTES", size)
        seen = 0
        for row, i, j, rows, cost in warping.paths(x, y):
            for k in rows.tolist():
                whole, a, b, path = plain_dtw(x[k], y[k]), 6, 6, []
                while a and b:
                    path.append((a - 1, b - 1))
                    a, b = min(((a - 1, b - 1), (a - 1, b), (a, b - 1)), key=lambda s: whole[s])
                assert sorted(zip(i[row == k].tolist(), j[row == k].tolist())) == sorted(path) and cost[k - rows[0]] == pytest.approx(whole[-1, -1])
                seen += 1
        assert seen == 9


def test_year_long_series_stay_in_bounded_memory():
    """10,000 pairs of 365 points, and their paths, in a process of its own."""
    code = """
import numpy as np, resource
from rillspark.operators import warping
x = np.random.default_rng(0).normal(size=(200, 365)).cumsum(1)
i, j = np.divmod(np.arange(10_000), 100)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
warping.warped(x, x, i, j)
best, _ = warping.nearest(x, x[:12])
n = sum(len(p[0]) for p in warping.paths(x, x[best]))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tiles.__file__.rsplit("/", 3)[0])
    assert float(out.stdout) < 500, out.stderr


def plain_silhouette(d, labels):
    s = []
    for i in range(len(d)):
        own = [d[i, j] for j in range(len(d)) if j != i and labels[j] == labels[i]]
        others = [d[i][labels == c].mean() for c in set(labels.tolist()) if c != labels[i]]
        s.append((min(others) - np.mean(own)) / max(min(others), np.mean(own)) if own and others else 0.0)
    return float(np.mean(s))


@pytest.mark.parametrize(("metric", "size"), [("euclidean", 7), ("euclidean", 512), ("warping", 11)])
def test_tiles_against_all_pairs(spark, metric, size):
    x = RNG.normal(size=(45, 5))
    y = x[:20] * 2 + 1
    both = table(spark, x, variant="x").unionByName(table(spark, y, variant="y"))
    far = {"x": tiles.METRICS[metric](x, x), "y": tiles.METRICS[metric](y, y)}
    got = {(r["variant"], r["a"], r["b"]): r["distance"] for r in tiles.all_distances(both, metric, ("variant",), size).collect()}
    assert len(got) == 45 * 44 // 2 + 190 and all(a < b and d == pytest.approx(far[v][a, b], rel=1e-12) for (v, a, b), d in got.items())
    of = {("x", 2): np.arange(45) % 2, ("x", 5): np.minimum(np.arange(45), 4), ("y", 2): np.arange(20) // 12, ("y", 5): np.zeros(20, int)}
    labels = spark.createDataFrame([(v, k, i, int(c)) for (v, k), cs in of.items() for i, c in enumerate(cs)], "variant string, k int, site long, cluster int")
    scores = {(r["variant"], r["k"]): r["silhouette"] for r in tiles.silhouettes(labels, both, "k", ("variant",), metric, size).collect()}
    assert scores.keys() == of.keys() and all(scores[key] == pytest.approx(plain_silhouette(far[key[0]], of[key]), abs=1e-12) for key in of)
    assert tiles.silhouettes(labels.limit(0), both, "k", ("variant",)).count() == 0


def test_nearest_neighbours_against_all_pairs(spark):
    x = np.concatenate([RNG.normal(c, 0.5, (60, 3)) for c in ((0, 0, 0), (9, 0, 1), (0, 9, 2))])
    x[5] = x[6] = x[170]
    n = RNG.integers(1, 5, len(x)).astype(float)
    rows = stored(spark.createDataFrame([(i, v.tolist(), float(m), i % 3 > 0) for i, (v, m) in enumerate(zip(x, n))], "c long, v array<double>, n double, open boolean"), "test")
    h = neighbours.gaps(x, n, x, n)
    for k, block in ((1, 16), (4, 25), (4, 500), (200, 40)):
        got = {}
        for r in neighbours.nearest(rows, k, block).collect():
            got.setdefault(r["c"], []).append((r["h"], min(r["c"], r["b"]), max(r["c"], r["b"])))
        for c in range(len(x)):
            want = sorted((h[c, b], min(c, b), max(c, b)) for b in range(len(x)) if b != c)[:k] if c % 3 else []
            assert [g[1:] for g in sorted(got.get(c, []))] == [w[1:] for w in want]
    assert neighbours.nearest(stored(rows.limit(0), "test")).count() == 0


def plain_ward(x):
    """Partitions for every k, by joining the nearest pair each time."""
    groups, out = {i: [i] for i in range(len(x))}, {}
    while True:
        out[len(groups)] = {frozenset(g) for g in groups.values()}
        if len(groups) == 1:
            return out
        cost = lambda a, b: len(groups[a]) * len(groups[b]) / (len(groups[a]) + len(groups[b])) * ((x[groups[a]].mean(0) - x[groups[b]].mean(0)) ** 2).sum()
        names = sorted(groups)
        _, a, b = min((cost(a, b), a, b) for i, a in enumerate(names) for b in names[i + 1 :])
        groups[a] = groups[a] + groups.pop(b)


@pytest.mark.parametrize(("last", "block"), [(1024, 512), (6, 10)])
def test_ward_trees_give_the_plain_partition_for_every_k(spark, last, block):
    x = np.concatenate([RNG.normal(c, 0.6, (16, 2)) for c in ((0, 0), (4, 0), (0, 5))])
    x[3] = x[20] = x[40]
    joins = [tuple(r) for r in ward.tree(table(spark, x), last, block).collect()]
    assert len(joins) == len(x) - 1 and all(a < b for a, b, _ in joins)
    want = plain_ward(x)
    for k in range(1, len(x) - 2):
        lead = list(range(len(x)))

        def top(i, lead=lead):
            while lead[i] != i:
                i = lead[i]
            return i

        for a, b, _ in sorted(joins, key=lambda j: (j[2], j[0], j[1]))[: len(x) - k]:
            lead[top(b)] = top(a)
        assert {frozenset(i for i in range(len(x)) if top(i) == r) for r in {top(i) for i in range(len(x))}} == want[k]
    if last == 1024:
        for k in (1, 3, 10, 48, 99):
            labels = {r["site"]: r["cluster"] for r in cluster.agglomerative(table(spark, x), k).collect()}
            groups = {frozenset(i for i in labels if labels[i] == c) for c in set(labels.values())}
            assert groups == (want[k] if k < 46 else {frozenset([i]) for i in range(len(x))} if k >= 48 else groups)
            assert set(labels.values()) == set(range(len(groups)))
        assert cluster.agglomerative(table(spark, x).limit(0), 2).count() == 0


def test_spectral_eigenvalues_against_a_dense_solver(spark):
    x = RNG.normal(size=(120, 3))
    edges = stored(spectral.affinity(table(spark, x), 8, 40), "test")
    w = np.zeros((120, 120))
    for r in edges.collect():
        w[r["src"], r["dst"]] = r["w"]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.zeros((120, 120), bool)
    for i in range(120):
        near[i, np.argsort(d[i])[:8]] = True
    width = d[near].mean()
    assert np.allclose(w, np.where(near | near.T, np.exp(-d / width), 0), rtol=1e-12)
    degree = w.sum(1)
    laplacian = np.eye(120) - w / np.sqrt(np.outer(degree, degree))
    want = np.linalg.eigvalsh(laplacian)[:4]
    at, values = spectral.embedding(edges, 4)
    assert np.abs(np.array(values) - want).max() < 1e-6
    z = np.array([r["x"] for r in at.orderBy("c").collect()]) * np.sqrt(degree)[:, None]
    assert np.abs(z.T @ z - np.eye(4)).max() < 1e-8 and np.abs(laplacian @ z - z * values).max() < 1e-4
    assert spectral.clustered(table(spark, x).limit(1), 3).collect()[0]["cluster"] == 0


def test_runs_in_one_pass_against_single_fits(spark):
    x, features = blobs(spark)
    data = stored(cluster.tables(features, 2, 42), "test")
    rows = {}
    for r in data.orderBy("t", "site").collect():
        rows.setdefault(r["t"], []).append(r["v"])
    assert np.allclose(rows[0], x) and all((np.array(rows[t]) >= x.min(0)).all() and (np.array(rows[t]) <= x.max(0)).all() for t in (1, 2)) and not np.allclose(rows[1], rows[2])
    first = lloyd.starts(data, range(2, 5))
    runs, costs = lloyd.fits(data, first)
    for (t, k), centres in first.items():
        y, c = np.array(rows[t]), centres.copy()
        for _ in range(lloyd.ROUNDS):
            near = ((y[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([y[near == i].mean(0) if (near == i).any() else c[i] for i in range(k)])
            still = (np.linalg.norm(new - c, axis=1) <= lloyd.MOVED).all()
            c = new
            if still:
                break
        assert np.allclose(runs[t, k], c) and costs[t, k] == pytest.approx(((y[:, None] - c[None]) ** 2).sum(2).min(1).sum())
    gaps = {r["k"]: r["gap"] for r in cluster.gap_statistic(features, range(2, 5), 2).collect()}
    assert gaps == {k: pytest.approx(np.mean([np.log(costs[t, k]) for t in (1, 2)]) - np.log(costs[0, k])) for k in range(2, 5)}
    assert cluster.gap_statistic(features.limit(0), range(2, 4), 2).count() == 0


def test_time_warp_with_numbers_of_points(spark):
    x = RNG.normal(size=(6, 4))
    one = cluster.time_warp(table(spark, x, variant="raw"), range(2, 3), include_index=True)[2].collect()
    assert {len(r["m"]) for r in one} == {8} and all(r["m"][0::2] == pytest.approx([1, 2, 3, 4]) for r in one)


def test_all_pairs_by_rows_are_the_pairs_one_by_one(monkeypatch):
    x, y = RNG.normal(size=(23, 9)), RNG.normal(size=(17, 14))
    i, j = np.divmod(np.arange(23 * 17), 17)
    want = warping.warped(x, y, i, j).reshape(23, 17)
    for wide in (5, 17, 40, 4096):  # blocks of y, and of x, with a rest
        monkeypatch.setattr(warping, "_wide", lambda p, wide=wide: wide)
        assert np.array_equal(warping.crossed(x, y), want)


def test_tiles_of_few_long_series_are_dealt_to_many_tasks(spark):
    from pyspark import TaskContext

    def kernel(x, y):
        import pyarrow as pa

        yield pa.table({"task": [TaskContext.get().partitionId()], "n": [len(x) * (len(x) - 1) // 2 if y is None else len(x) * len(y)]})

    made = tiles.tiles(table(spark, np.zeros((400, 365))), kernel, "task long, n long").collect()
    assert sum(r["n"] for r in made) == 400 * 399 // 2 and len({r["task"] for r in made}) > 8


def test_blocks_stay_as_many_when_sites_grow():
    """What is shuffled grows with sites x blocks."""
    assert [-(-n // tiles.block_size(n, 34, 6)) for n in (6_000, 60_000, 360_000)] == [10, 10, 10]
    assert -(-3_600_000 // tiles.block_size(3_600_000, 34, 6)) == 59 and tiles.block_size(360_000, 12, 6, 512) == 512


def test_random_points_ask_few_blocks(spark, monkeypatch):
    """Bounds exclude little among them: what is asked grows with rows x blocks, so the number of blocks is bounded."""
    x = RNG.normal(size=(400, 12))
    rows = stored(table(spark, x).selectExpr("site c", "v", "1D n", "true open"), "test")
    asked = []
    monkeypatch.setattr(neighbours, "stored", lambda df, name: asked.append(out := stored(df, name)) or out if name == "near-asked" else stored(df, name))
    monkeypatch.setattr(neighbours, "BLOCKS", 4)
    got = {(r["c"], r["b"]) for r in neighbours.nearest(rows, 3, 10).collect()}
    far = ((x[:, None] - x[None]) ** 2).sum(-1) + np.diag(np.full(400, np.inf))
    assert got == {(i, int(j)) for i in range(400) for j in far[i].argsort()[:3]}
    assert asked[0].count() <= 400 * 8  # 400 rows x 40 blocks before


def test_power_steps_leave_one_table(spark, tmp_path, monkeypatch):
    from rillspark.operators import graph

    monkeypatch.setattr(graph, "shared_folder", lambda spark: f"file://{tmp_path}")
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(8) for j in range(8) if abs(i - j) == 1], "src long, dst long, w double")
    out, values = spectral.embedding(edges, 2)
    assert out.count() == 8 and abs(values[0]) < 1e-6 and len(list(tmp_path.glob("spectral-z-*"))) == 1
