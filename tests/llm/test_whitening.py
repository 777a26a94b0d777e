"""Rank-one updates against a dense solver, and whitened rows against one."""

import math

import numpy as np
import pytest

from rillspark.llm import whitening

RNG = np.random.default_rng(4)
CASES = {
    "full": RNG.normal(size=(200, 12)), "ties": RNG.integers(-2, 3, (200, 5)).astype(float), "low rank": np.repeat(RNG.normal(size=(30, 3)), 4, 0) @ RNG.normal(size=(3, 15)),
    "graded": RNG.normal(size=(200, 20)) * np.logspace(0, -6, 20), "unit": np.eye(9) * 3, "constant": np.ones((20, 4)), "one": RNG.normal(size=(1, 6)), "single": RNG.normal(size=(50, 1)),
}


def scatter(x):
    return (x - x.mean(0)).T @ (x - x.mean(0))


def near(s, x):
    want = scatter(x)
    top = max(np.abs(want).max(), 1.0)
    assert np.abs((s.vectors * s.values) @ s.vectors.T - want).max() < 1e-12 * top
    assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-12
    assert (np.diff(s.values) >= 0).all() and s.n == len(x) and np.allclose(s.mean, x.mean(0))


@pytest.mark.parametrize("name", CASES)
def test_updates_and_combination(name):
    x = CASES[name]
    parts = [whitening.Spectrum(x.shape[1]) for _ in range(3)]
    for i, row in enumerate(x):
        parts[i * 2 // len(x)].add(row)  # the third stays empty
    for p in parts[1:]:
        parts[0].combine(p)
    near(parts[0], x)


def test_secular_roots_are_roots():
    for n in (1, 2, 7, 40):
        d, z2 = np.sort(RNG.normal(size=n)), RNG.uniform(1e-12, 1, n)
        pole, off = whitening.secular_roots(d, z2)
        want = np.linalg.eigvalsh(np.diag(d) + np.sqrt(np.outer(z2, z2)))
        assert np.abs(d[pole] + off - want).max() < 1e-13 * max(1, np.abs(want).max())


SCHEMA = "vec_id long, embedding array<float>, n string, x int"


@pytest.mark.parametrize("task_rows", [4096, 11])
def test_whitened_rows(spark, monkeypatch, task_rows):
    monkeypatch.setattr(whitening, "TASK_ROWS", task_rows)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(RNG.normal(size=(300, 20)))]
    odd = [(900, None), (901, [1.0] * 19), (902, [None] * 20), (903, [math.nan] + [0.0] * 19), (904, [math.inf] + [0.0] * 19), (905, []), (906, [3e37] + [0.0] * 19)]
    copies = [(None, rows[3][1]), (3, rows[3][1]), *((1000 + i, rows[5][1]) for i in range(200))]
    table = spark.createDataFrame([(i, v, "q", 1) for i, v in rows + odd + copies], SCHEMA).repartition(5)
    got = whitening.whiten(table).toPandas()
    kept = rows + copies
    assert len(got) == 16 * len(kept)
    grid = lambda v: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique([grid(v) for _, v in kept], axis=0)
    n, total = len(fit), fit.sum(0)
    covariance = (fit - total / n).T @ (fit - total / n) / n
    e, basis = np.linalg.eigh(covariance)
    e, basis = e[::-1][:16], basis[:, ::-1][:, :16]
    assert (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert sorted(got["vec_id"].fillna(-1)) == sorted(x for i, _ in kept for x in [-1 if i is None else i] * 16)
    one = got[got["vec_id"] < 300].drop_duplicates(["vec_id", "component"]).sort_values(["vec_id", "component"])
    x = np.array([grid(v) for _, v in rows])
    want = (x - total / n) @ basis / np.sqrt(e)
    own = one["whitened"].to_numpy().reshape(-1, 16)
    assert np.abs(own * np.sign((own * want).sum(0)) - want).max() < 1e-9
    assert one["deviation"].to_numpy()[::16].tolist() == [int(sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, total, strict=True))) for r in x]
    assert np.allclose(one["explained"].to_numpy()[:16], e / np.trace(covariance), rtol=1e-12)
    assert got[(got["vec_id"] == 3) & (got["component"] == 2)]["whitened"].nunique() == 1


@pytest.mark.parametrize("count", [0, 1, 2])
def test_few_vectors(spark, count):
    table = spark.createDataFrame([(i, [float(i), 1.0, 2.0], "q", 1) for i in range(count)], SCHEMA)
    got = whitening.whiten(table).orderBy("vec_id", "component").collect()
    assert len(got) == 3 * count
    varies = [r["whitened"] is not None for r in got]
    assert varies == ([True, False, False] * 2 if count == 2 else [False] * len(got))
    assert all(r["explained"] == (1.0 if v else 0.0) for r, v in zip(got, varies, strict=True))


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 50, 5], [3, 4]])
    assert whitening.deviation(x, 1000, np.array([7, 8], object)) == [None, (3000 - 7) ** 2 + (4000 - 8) ** 2]
