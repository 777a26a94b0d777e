"""Autoregressive and forest imputation of single series.

The autoregressive fill goes from gap to gap, each fit using earlier fills, so a site is one group: its series bounds the
memory. Sites are independent and are dealt out by Spark. The forest fills train Spark ML forests over all sites; chained
equations draw what they fill in from the values of days with similar predictions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored
from .lloyd import uniform
from .repair import fill_dates


@dataclass(frozen=True)
class LinarOptions:
    learn: int = 100
    max_lags: int = 10
    max_linear: int = 14
    max_linar: int = 14
    adf_level: float = 0.01
    f_level: float = 0.01
    differences: int = 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * h / a


def f_test(x: np.ndarray) -> float:
    """p of equal variances in both parts of a series; 1 where neither varies.

    The first part has half the values, a half rounded to even; if it is the longer one it loses its first value.
    """
    split = round(len(x) / 2)
    a, b = x[max(0, 2 * split - len(x)) : split], x[split:]
    if min(len(a), len(b)) < 2:
        return 1.0
    va, vb = np.var(a, ddof=1), np.var(b, ddof=1)
    if min(va, vb) == 0:
        return float(va == vb)
    f, da, db = max(va, vb) / min(va, vb), len(a) - 1, len(b) - 1
    return 1 - incomplete_beta(da / 2, db / 2, da * f / (da * f + db))


def _least_squares(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return beta, float(((y - x @ beta) ** 2).sum())


def _lags(x: np.ndarray, lags: int, start: int) -> np.ndarray:
    return np.column_stack([np.ones(len(x) - start), *[x[start - k : len(x) - k] for k in range(1, lags + 1)]])


def adf_p(x: np.ndarray) -> float:
    """p of a unit root by the augmented Dickey-Fuller test with a constant; lags by AIC, up to 12 (n / 100) ** 0.25."""
    d = np.diff(x)
    most = max(0, min(int(math.ceil(12 * (len(x) / 100) ** 0.25)), len(d) // 2 - 2))
    if len(d) < 6 or np.ptp(x) == 0:
        return 1.0

    def fit(lags: int, start: int) -> tuple[float, float]:
        cols = np.column_stack([np.ones(len(d) - start), x[start:-1], *[d[start - k : len(d) - k] for k in range(1, lags + 1)]])
        y = d[start:]
        beta, rss = _least_squares(y, cols)
        n, k = len(y), cols.shape[1]
        if rss <= 0 or n <= k:
            return -math.inf, -math.inf
        error = math.sqrt(rss / (n - k) * np.linalg.pinv(cols.T @ cols)[1, 1])
        return beta[1] / error, n * math.log(rss / n) + 2 * k

    best = min(range(most + 1), key=lambda k: fit(k, most)[1])
    tau = fit(best, best)[0]
    if tau == -math.inf:
        return 0.0
    # MacKinnon's published surface for the constant case; the second polynomial is for the upper part
    z = 2.1659 + 1.4412 * tau + 0.038269 * tau**2 if tau <= -1.61 else 1.7339 + 0.93202 * tau - 0.12745 * tau**2 - 0.010368 * tau**3
    return 0.5 * math.erfc(-z / math.sqrt(2)) if -18.83 <= tau <= 2.74 else float(tau > 0)


def stationary(x: np.ndarray, o: LinarOptions) -> tuple[np.ndarray, int] | None:
    """x differenced once, and again while a test rejects; None beyond the number of differences allowed."""
    for times in range(1, o.differences + 1):
        x = np.diff(x)
        if len(x) > 3 and adf_p(x) <= o.adf_level and f_test(x) >= o.f_level:
            return x, times
    return None


def ar_order(x: np.ndarray, max_lags: int) -> int:
    """The order of an autoregression with a constant, by AIC on common rows."""
    most = min(max_lags, max(0, (len(x) - 2) // 2))

    def aic(k: int) -> float:
        y, cols = x[most:], _lags(x, k, most)
        rss = _least_squares(y, cols)[1]
        return len(y) * math.log(max(rss, 1e-300) / len(y)) + 2 * (k + 1)

    return min(range(most + 1), key=aic)


def ar_forecast(x: np.ndarray, steps: int, max_lags: int) -> np.ndarray:
    """Forecast by an autoregression of the order that ar_order() gives."""
    lags = ar_order(x, max_lags)
    beta, _ = _least_squares(x[lags:], _lags(x, lags, lags))
    path = list(x)
    for _ in range(steps):
        path.append(beta[0] + sum(beta[k] * path[-k] for k in range(1, lags + 1)))
    return np.array(path[len(x) :])


def adjusted(forecast: np.ndarray, before: float, after: float) -> np.ndarray:
    """The forecast with its own line, from the value before to its last one, replaced by the line from before to after."""
    n = len(forecast)
    day = np.arange(1, n + 1)
    return forecast + day * ((after - before) / (n + 1) - (forecast[-1] - before) / n)


def linar_fill(q: np.ndarray, o: LinarOptions) -> tuple[np.ndarray, np.ndarray]:
    """Filled values and, for each, how (0 not, 1 linear, 2 autoregressive); gaps from left to right."""
    q, how = q.astype(float).copy(), np.zeros(len(q), np.int64)
    missing = np.isnan(q)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], missing.astype(int), [0]))))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        n = b - a
        if a == 0 or b == len(q) or n > o.max_linear:
            continue
        value, kind = q[a - 1] + (q[b] - q[a - 1]) * np.arange(1, n + 1) / (n + 1), 1
        known = q[max(0, a - o.learn) : a]
        if n <= o.max_linar and len(known) == o.learn and not np.isnan(known).any() and (found := stationary(known, o)):
            steps = ar_forecast(found[0], n, o.max_lags)
            for k in range(found[1] - 1, -1, -1):
                steps = np.diff(known, k)[-1] + np.cumsum(steps)
            value, kind = adjusted(steps, q[a - 1], q[b]), 2
        q[a:b], how[a:b] = value, kind
    return q, how


def linar(df: DataFrame, options: LinarOptions = LinarOptions()) -> DataFrame:
    """site, d, q, how: gaps of up to max_linar days by autoregression where it applies, of up to max_linear by lines."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        q, how = linar_fill(pdf["q"].to_numpy(float), options)
        return pd.DataFrame({"site": pdf["site"], "d": pdf["d"], "q": q, "how": how})

    out = fill_dates(df).groupBy("site").applyInPandas(fill, "site string, d date, q double, how long")
    return out.withColumn("q", F.when(~F.isnan("q"), F.col("q")))


def stationarity(df: DataFrame, options: LinarOptions = LinarOptions()) -> DataFrame:
    """site, n, f_p, adf_p, differences, lags: tests and orders of each site's last learn values; null where they don't apply.

    f_p and adf_p are those of the first differences, differences how many it takes, lags the order chosen for them.
    """

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("d")["q"].dropna().to_numpy(float)[-options.learn :]
        found = stationary(x, options) if len(x) > 3 else None
        row = {"site": pdf["site"].iloc[0], "n": len(x), "f_p": None, "adf_p": None, "differences": None, "lags": None}
        if len(x) > 3:
            row |= {"f_p": f_test(np.diff(x)), "adf_p": adf_p(np.diff(x))}
        if found:
            row |= {"differences": found[1], "lags": ar_order(found[0], options.max_lags)}
        return pd.DataFrame([row])

    return df.groupBy("site").applyInPandas(told, "site string, n long, f_p double, adf_p double, differences long, lags long")


FEATURES = ("doy", "month", "lag1", "lag2", "lead1", "lead2", "code")


def forest_fill(df: DataFrame, iterations: int = 2, datasets: int = 1, trees: int = 10, depth: int = 5, seed: int = 42) -> DataFrame:
    """site, d, q, filled: missing values predicted by forests from the season and neighbouring days, again and again.

    Values start from the site's median. With several datasets, forests of other seeds are averaged.
    """
    w = Window.partitionBy("site").orderBy("d")
    base = fill_dates(df).withColumn("missing", F.col("q").isNull()).withColumn("start", F.coalesce("q", F.median("q").over(Window.partitionBy("site")), F.lit(0.0)))
    base = base.withColumn("code", F.pmod(F.crc32(F.col("site").cast("string").cast("binary")), F.lit(1000)).cast("double"))
    total = None
    for k in range(datasets):
        now = base.withColumn("v", F.col("start"))
        for i in range(iterations):
            near = now.withColumn("doy", F.dayofyear("d").cast("double")).withColumn("month", F.month("d").cast("double"))
            for name, f, n in (("lag1", F.lag, 1), ("lag2", F.lag, 2), ("lead1", F.lead, 1), ("lead2", F.lead, 2)):
                near = near.withColumn(name, F.coalesce(f("v", n).over(w), F.col("v")))
            ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(near)
            model = RandomForestRegressor(labelCol="q", numTrees=trees, maxDepth=depth, seed=seed + 100 * k + i).fit(ready.filter("not missing"))
            scored = model.transform(ready)
            now = scored.select("site", "d", "q", "missing", "start", "code", F.when(F.col("missing"), F.col("prediction")).otherwise(F.col("q")).alias("v"))
        part = now.select("site", "d", "missing", "v")
        total = part if total is None else total.unionByName(part)
    return total.groupBy("site", "d", F.col("missing").alias("filled")).agg(F.avg("v").alias("q")).select("site", "d", "q", "filled")


#: Known values that a missing one may be drawn from.
DONORS = 5


def ranked(scored: DataFrame, *order: str) -> DataFrame:
    """scored (chain, site, missing, ...) with rank: of a known row its number by order in its chain and site, from 1; of a
    missing row the number of known rows before it."""
    w = Window.partitionBy("chain", "site").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return scored.withColumn("rank", F.sum(F.when(F.col("missing"), 0).otherwise(1)).over(w))


def matched(scored: DataFrame, donors: int = DONORS, salt: int = 0) -> DataFrame:
    """chain, site, d, v for the missing rows of scored (chain, site, d, q, missing, prediction): predictive mean matching.

    Predictions of known and missing rows are ranked together, so the nearest known ones have the ranks around a missing
    row's, and an equality join by rank finds them. Of those nearest (ties: the lower rank) one's value is drawn. A site
    without known values gives null.
    """
    rows = stored(ranked(scored, "prediction", "missing", "d"), "matching")
    known = rows.filter("not missing").select("chain", "site", "rank", F.col("q").alias("given"), F.col("prediction").alias("p"))
    asked = rows.filter("missing").select("chain", "site", "d", "prediction", F.explode(F.sequence(F.col("rank") - donors + 1, F.col("rank") + donors)).alias("rank"))
    near = asked.join(known, ["chain", "site", "rank"]).groupBy("chain", "site", "d").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.abs(F.col("p") - F.col("prediction")).alias("far"), "rank", "given"))), 1, donors).alias("near"))
    drawn = F.floor(uniform(F.col("chain"), F.col("site"), F.col("d"), salt) * F.size("near")).cast("int")
    found = near.select("chain", "site", "d", F.get("near", drawn)["given"].alias("v"))
    return rows.filter("missing").select("chain", "site", "d").join(found, ["chain", "site", "d"], "left")


def chained_fill(df: DataFrame, datasets: int = 5, iterations: int = 5, donors: int = DONORS, trees: int = 10, depth: int = 5, seed: int = 42) -> DataFrame:
    """site, d, dataset, q, filled: several completed datasets by chained equations with predictive mean matching.

    Missing values start as drawn known ones of their site. In each iteration every dataset predicts its days from the season
    and the neighbouring days as they stand, with a forest of its own fitted to known days, and draws each missing value from
    the known values with the nearest predictions. All datasets are one table, told apart by a column; their forests are
    fitted side by side. A site without known values keeps nulls.
    """
    filled = fill_dates(df).withColumn("missing", F.col("q").isNull())
    base = filled.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(datasets - 1)))).withColumn("code", F.pmod(F.crc32(F.col("site").cast("string").cast("binary")), F.lit(1000)).cast("double"))
    # a start is the known value whose number by date is drawn
    numbered = stored(ranked(base, "d"), "chains")
    known = numbered.filter("not missing").select("chain", "site", "rank", F.col("q").alias("v"))
    most = known.groupBy("chain", "site").agg(F.max("rank").alias("most"))
    draw = (F.floor(uniform(F.col("chain"), F.col("site"), F.col("d"), seed) * F.col("most")) + 1).alias("rank")
    starts = numbered.filter("missing").join(most, ["chain", "site"]).select("chain", "site", "d", draw).join(known, ["chain", "site", "rank"]).select("chain", "site", "d", "v")
    plain = numbered.select("chain", "site", "d", "q", "missing", "code")
    now = _with_values(plain, starts)
    w = Window.partitionBy("chain", "site").orderBy("d")
    for i in range(iterations):
        near = stored(now, "chains").filter("v is not null").withColumn("doy", F.dayofyear("d").cast("double")).withColumn("month", F.month("d").cast("double"))
        for name, f, n in (("lag1", F.lag, 1), ("lag2", F.lag, 2), ("lead1", F.lead, 1), ("lead2", F.lead, 2)):
            near = near.withColumn(name, F.coalesce(f("v", n).over(w), F.col("v")))
        ready = stored(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(near).select("chain", "site", "d", "q", "missing", "features"), "chains-ready")

        def predicted(k: int, ready: DataFrame = ready, i: int = i) -> DataFrame:
            own = ready.filter(F.col("chain") == k)
            train = own.filter("not missing")
            if train.isEmpty():
                return own.select("chain", "site", "d", "q", "missing", F.lit(0.0).alias("prediction"))
            model = RandomForestRegressor(labelCol="q", numTrees=trees, maxDepth=depth, seed=seed + 100 * k + i).fit(train)
            return model.transform(own).select("chain", "site", "d", "q", "missing", "prediction")

        with ThreadPool(datasets) as pool:
            scored = reduce(DataFrame.unionByName, pool.map(predicted, range(datasets)))
        now = _with_values(plain, stored(matched(scored, donors, seed + i), "chains-drawn"))
    return now.select("site", "d", F.col("chain").alias("dataset"), F.col("v").alias("q"), F.col("missing").alias("filled"))


def _with_values(plain: DataFrame, drawn: DataFrame) -> DataFrame:
    """plain with v: the known value, or the one drawn."""
    return plain.join(drawn, ["chain", "site", "d"], "left").withColumn("v", F.when(F.col("missing"), F.col("v")).otherwise(F.col("q")))
