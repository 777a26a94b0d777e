"""Queries on flow statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import flowstats as fs
from ..operators import prepare
from . import proxies as px
from .registry import query


@query("fs1_load", f"WITH {px.SQL_DAILY} SELECT site, d, q FROM daily")
def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.load_daily(px.daily(spark, sf_dir))


@query("fs3_exclude", f"WITH {px.SQL_DAILY} SELECT site, d, q FROM daily WHERE NOT d BETWEEN DATE '1996-03-01' AND DATE '1996-04-15' AND NOT d BETWEEN DATE '1999-12-31' AND DATE '1999-12-31'")
def exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.exclude(px.daily(spark, sf_dir), [("1996-03-01", "1996-04-15"), ("1999-12-31", "1999-12-31")])


@query("fs4_complete_years", f"WITH {px.SQL_YEARS} SELECT site, wy, d, q FROM years")
def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.years(spark, sf_dir)


_RANGES = """SELECT site, wy, min(d) AS first, max(d) AS last, count(*) AS n FROM (
SELECT site, wy, d, d - row_number() OVER (PARTITION BY site, wy ORDER BY d)::INT AS g FROM whole WHERE n_missing > 1 AND q IS NULL) GROUP BY site, wy, g"""


@query("fs5_missing_ranges", f"WITH {px.SQL_DAILY}, {px.sql_full('daily')} {_RANGES}")
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.missing_ranges(px.daily(spark, sf_dir))


_MOMENTS = f"""{px.SQL_SCOPED},
rk AS (SELECT site, scope, q, row_number() OVER (PARTITION BY site, scope ORDER BY q)::DOUBLE AS i FROM sc WHERE q IS NOT NULL),
pw AS (SELECT site, scope, count(*)::DOUBLE AS n, avg(q) AS b0, sum((i - 1) * q) AS s1, sum((i - 1) * (i - 2) * q) AS s2, sum((i - 1) * (i - 2) * (i - 3) * q) AS s3 FROM rk GROUP BY 1, 2),
bb AS (SELECT site, scope, b0, s1 / (n * (n - 1)) AS b1, s2 / (n * (n - 1) * (n - 2)) AS b2, s3 / (n * (n - 1) * (n - 2) * (n - 3)) AS b3 FROM pw),
lm AS (SELECT site, scope, b0 AS mean_l_moment, (2 * b1 - b0) / b0 AS l_cv, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) AS l_skew, (20 * b3 - 30 * b2 + 12 * b1 - b0) / (2 * b1 - b0) AS l_kurt FROM bb)"""
_LM = "mean_l_moment, l_cv, l_skew, l_kurt"


def _round(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


@query("fs6_l_moments", f"WITH {_MOMENTS} SELECT site, scope, {_round(_LM.split(', '))} FROM lm")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fs.l_moments(prepare.scoped(px.years(spark, sf_dir))))


def _family(*families: Callable[[], list[Column]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(fs.gathered(px.years(spark, sf_dir), *[f() for f in families]))


_AR1 = "corr(before, q) AS ar1_coefficient"
_SEASON_CTE = """ss AS (SELECT site, scope, max(round(n / 365)) AS k, max(n) AS n, sum((q - mean) * cos(2 * pi() * round(n / 365) * t / n)) AS re, -sum((q - mean) * sin(2 * pi() * round(n / 365) * t / n)) AS im FROM sc GROUP BY 1, 2),
season AS (SELECT site, scope, CASE WHEN k > 0 THEN 2 * sqrt(re * re + im * im) / n ELSE 0 END AS amplitude, CASE WHEN k > 0 THEN atan2(im, re) / (2 * pi()) * 365 + CASE WHEN atan2(im, re) < 0 THEN 365 ELSE 0 END END AS phase FROM ss)"""
_MONTHS = {f"{n}_month_{m:02d}": f"{f}(q) FILTER (month(d) = {m})" for n, f in (("mean", "avg"), ("median", "median")) for m in range(1, 13)}
_ROLL = "rl AS (SELECT *, " + ", ".join(f"CASE WHEN count(q) OVER w{s} = {s} THEN avg(q) OVER w{s} END AS r{s}" for s in fs.SPANS)
_ROLL += " FROM sc WINDOW " + ", ".join(f"w{s} AS (PARTITION BY site, scope ORDER BY d ROWS {s - 1} PRECEDING)" for s in fs.SPANS) + ")"
_EXTREMES = {f"{n}_{s}day": f"{n}(r{s})" for s in fs.SPANS for n in ("min", "max")}
_PULSE_CTE = """pf AS (SELECT *, q >= p75 AS high, q <= p25 AS low, coalesce(lag(q >= p75) OVER w, false) AS high0, coalesce(lag(q <= p25) OVER w, false) AS low0,
  sign(diff) AS turn, lag(sign(diff)) OVER w AS turn0 FROM rl WINDOW w AS (PARTITION BY site, scope ORDER BY d))"""
_PULSES = {}
for _s, _p in (("high", "p75"), ("low", "p25")):
    _PULSES |= {
        f"{_s}_pulse_count": f"count(*) FILTER ({_s} AND NOT {_s}0)",
        f"{_s}_pulse_avg_dur": f"coalesce(count(*) FILTER ({_s}) / nullif(count(*) FILTER ({_s} AND NOT {_s}0), 0), 0.0)",
        f"{_s}_thresh_used": f"max({_p})",
    }
_PULSE_RATES = {f"{s}_pulse_{n}_mean": f"avg(diff) FILTER ({s} AND diff {c} 0)" for s in ("high", "low") for n, c in (("rise", ">"), ("fall", "<"))}
_RATES = {"mean_rise_rate": "coalesce(avg(diff) FILTER (diff > 0), 0)", "mean_fall_rate": "coalesce(avg(diff) FILTER (diff < 0), 0)", "reversals": "count(*) FILTER (turn * turn0 < 0)"}
_TIMING = {"julian_max": "arg_max(dayofyear(d), {'a': q, 'b': -t})", "julian_min": "arg_min(dayofyear(d), {'a': q, 'b': t})", "center_of_timing": "sum(dayofyear(d) * q) / sum(q)"}
_VARIABILITY = {"std_daily": "stddev_samp(q)", "cv_daily": "stddev_samp(q) / avg(q)"}
_BASE = {"bfi": "min(r7) / avg(q)"}
_INTS = {"high_pulse_count", "low_pulse_count", "reversals"}


def _select(parts: dict[str, str], ints: bool = True) -> str:
    out = []
    for n, e in parts.items():
        if n in ("julian_max", "julian_min"):
            out.append(f"({e})::INTEGER AS {n}")
        elif n in _INTS and ints:
            out.append(f"({e})::BIGINT AS {n}")
        else:
            out.append(f"round({e}, 6) + 0.0 AS {n}")
    return ", ".join(out)


_ALL_CTE = f"{px.SQL_SCOPED}, {_ROLL}, {_PULSE_CTE}"
for _name, _parts, _f in (
    ("fs10_monthly", _MONTHS, fs.monthly), ("fs11_extremes", _EXTREMES, fs.extremes), ("fs12_pulses", _PULSES, fs.pulses), ("fs13_pulse_rates", _PULSE_RATES, fs.pulse_rates),
    ("fs14_rates", _RATES, fs.rates), ("fs15_timing", _TIMING, fs.timing), ("fs17_variability", _VARIABILITY, fs.variability), ("fs18_baseflow", _BASE, fs.baseflow),
    ("fs7_ar1", {"ar1_coefficient": "corr(before, q)"}, fs.ar1),
):
    query(_name, f"WITH {_ALL_CTE} SELECT site, scope, {_select(_parts)} FROM pf GROUP BY 1, 2")(_family(_f))
query("fs8_season", f"WITH {px.SQL_SCOPED}, {_SEASON_CTE} SELECT site, scope, round(amplitude, 6) + 0.0 AS amplitude, round(phase, 6) + 0.0 AS phase FROM season")(_family(fs.season))
_MAG7 = ["mean_l_moment", "l_cv", "l_skew", "l_kurt", "ar1_coefficient", "amplitude", "phase"]


@query("fs22_magnificent_seven", f"WITH {_MOMENTS}, {_SEASON_CTE}, ar AS (SELECT site, scope, {_AR1} FROM sc GROUP BY 1, 2) SELECT site, scope, {_round(_MAG7)} FROM lm JOIN season USING (site, scope) JOIN ar USING (site, scope)")
def magnificent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fs.magnificent_seven(px.years(spark, sf_dir)))


query("fs9_mag7_per_year", f"WITH {_MOMENTS}, {_SEASON_CTE}, ar AS (SELECT site, scope, {_AR1} FROM sc GROUP BY 1, 2) SELECT site, scope, {_round(_MAG7)} FROM lm JOIN season USING (site, scope) JOIN ar USING (site, scope) WHERE scope <> 'all_years'")(
    lambda spark, sf_dir: magnificent(spark, sf_dir).filter("scope <> 'all_years'")
)
_CVJ_CTE = """yj AS (SELECT site, scope, arg_max(dayofyear(d), {'a': q, 'b': -t}) AS jx, arg_min(dayofyear(d), {'a': q, 'b': t}) AS jn FROM sc WHERE scope <> 'all_years' GROUP BY 1, 2),
cvj AS (SELECT site, stddev_samp(jx) / avg(jx) AS cv_julian_max, stddev_samp(jn) / avg(jn) AS cv_julian_min, count(*) AS n_years FROM yj GROUP BY 1)"""


@query("fs16_cv_julian", f"WITH {px.SQL_SCOPED}, {_CVJ_CTE} SELECT site, {_round(['cv_julian_max', 'cv_julian_min'])}, n_years FROM cvj")
def cv_julian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fs.cv_julian(fs.gathered(px.years(spark, sf_dir), fs.timing())))


_CVA_CTE = "cva AS (SELECT site, scope, stddev_samp(m) / avg(m) AS cv_annual FROM (SELECT site, scope, year(d) AS y, avg(q) AS m FROM sc GROUP BY 1, 2, 3) GROUP BY 1, 2)"
_FH5_CTE = "fh AS (SELECT site, scope, avg(k) AS fh5_mean, median(k) AS fh5_median FROM (SELECT site, scope, year(d) AS y, count(*) FILTER (q > p50) AS k FROM sc GROUP BY 1, 2, 3) GROUP BY 1, 2)"
_BINS = " + ".join(f"(m * {b} <= log10(q))::INT" for b in fs.BREAKS)
_COLWELL_CTE = f"""c0 AS (SELECT site, scope, q, row_number() OVER (PARTITION BY site, scope, year(d) ORDER BY d) AS day, log10(avg(q) OVER (PARTITION BY site, scope)) AS m FROM sc WHERE NOT (month(d) = 2 AND day(d) = 29) AND q IS NOT NULL),
c1 AS (SELECT site, scope, day, {_BINS} AS bin, count(*) AS k FROM c0 GROUP BY ALL),
c2 AS (SELECT *, sum(k) OVER (PARTITION BY site, scope) AS z FROM c1),
cx AS (SELECT site, scope, sum(-p * log10(p)) AS hx FROM (SELECT site, scope, day, sum(k) / any_value(z) AS p FROM c2 GROUP BY 1, 2, 3) GROUP BY 1, 2),
cy AS (SELECT site, scope, sum(-p * log10(p)) AS hy FROM (SELECT site, scope, bin, sum(k) / any_value(z) AS p FROM c2 GROUP BY 1, 2, 3) GROUP BY 1, 2),
cz AS (SELECT site, scope, sum(-(k / z) * log10(k / z)) AS hxy FROM c2 GROUP BY 1, 2),
cw AS (SELECT site, scope, 1 - hy / log10(11) AS colwell_constancy, 100 * (1 - (hxy - hx) / log10(11)) - (1 - hy / log10(11)) AS colwell_contingency, 100 * (1 - (hxy - hx) / log10(11)) AS colwell_predictability FROM cx JOIN cy USING (site, scope) JOIN cz USING (site, scope))"""
_TA3_CTE = f"""t0 AS (SELECT site, scope, d, q FROM sc WHERE NOT (month(d) = 2 AND day(d) = 29)),
t1 AS (SELECT site, scope, quantile_cont(peak, {fs.FLOOD}) AS flood FROM (SELECT site, scope, year(d), max(q) AS peak FROM t0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
ta AS (SELECT site, scope, max(k) / nullif(sum(k), 0) AS ta3 FROM (SELECT site, scope, (month(d) + 2) % 12 // 2 AS s, count(*) FILTER (q > flood) AS k FROM t0 JOIN t1 USING (site, scope) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
_COLWELL = ["colwell_constancy", "colwell_contingency", "colwell_predictability"]
for _name, _cte, _from, _names, _op in (
    ("fs17b_cv_annual", _CVA_CTE, "cva", ["cv_annual"], fs.cv_annual), ("fs19_colwell", _COLWELL_CTE, "cw", _COLWELL, fs.colwell),
    ("fs20_ta3", _TA3_CTE, "ta", ["ta3"], fs.ta3), ("fs21_fh5", _FH5_CTE, "fh", ["fh5_mean", "fh5_median"], fs.fh5),
):
    query(_name, f"WITH {px.SQL_SCOPED}, {_cte} SELECT site, scope, {_round(_names)} FROM {_from}")(lambda spark, sf_dir, op=_op: rounded(op(prepare.scoped(px.years(spark, sf_dir)))))

_SUMS = _MONTHS | _EXTREMES | _PULSES | _PULSE_RATES | _RATES | _VARIABILITY | _BASE
_PER_YEAR = lambda n: f"round(CASE WHEN scope = 'all_years' THEN {n} / n_years ELSE {n} END, 6) + 0.0 AS {n}"
_ALL_SQL = f"""WITH {_ALL_CTE}, {_MOMENTS.removeprefix(px.SQL_SCOPED + ",")}, {_SEASON_CTE}, {_CVJ_CTE}, {_CVA_CTE}, {_FH5_CTE}, {_COLWELL_CTE}, {_TA3_CTE},
agg AS (SELECT site, scope, {_AR1}, {", ".join(f"{e} AS {n}" for n, e in (_SUMS | _TIMING).items())} FROM pf GROUP BY 1, 2)
SELECT site, scope, {_round([*_MAG7, *[n for n in _SUMS if n not in _INTS], "center_of_timing", "cv_annual", "fh5_mean", "fh5_median", *_COLWELL, "ta3"])},
  julian_max::INTEGER AS julian_max, julian_min::INTEGER AS julian_min, {", ".join(map(_PER_YEAR, sorted(_INTS)))},
  round(CASE WHEN scope = 'all_years' THEN cv_julian_max END, 6) + 0.0 AS cv_julian_max, round(CASE WHEN scope = 'all_years' THEN cv_julian_min END, 6) + 0.0 AS cv_julian_min
FROM agg JOIN lm USING (site, scope) JOIN season USING (site, scope) JOIN cva USING (site, scope) JOIN fh USING (site, scope) JOIN cw USING (site, scope) JOIN ta USING (site, scope) JOIN cvj USING (site)"""


@query("fs23_all_stats", _ALL_SQL)
def all_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fs.all_stats(px.years(spark, sf_dir)))


def _hiap_sql(middle: str) -> str:
    return f"""WITH {px.SQL_SCOPED}, {_SEASON_CTE}, {_COLWELL_CTE},
h0 AS (SELECT *, row_number() OVER y AS r, quantile_cont(q, 0.25) OVER s AS p25, quantile_cont(q, 0.5) OVER s AS p50, quantile_cont(q, 0.75) OVER s AS p75,
  avg(q) OVER (PARTITION BY site, wy ORDER BY d ROWS 2 PRECEDING) AS r3, avg(q) OVER (PARTITION BY site, wy ORDER BY d ROWS 6 PRECEDING) AS r7 FROM years WINDOW y AS (PARTITION BY site, wy ORDER BY d), s AS (PARTITION BY site)),
h1 AS (SELECT *, coalesce(q <= p25, false) AS f1, coalesce(q >= p75, false) AS f2, coalesce(q >= p50, false) AS f3 FROM h0),
h2 AS (SELECT *, f1 AND NOT coalesce(lag(f1) OVER y, false) AS s1, f2 AND NOT coalesce(lag(f2) OVER y, false) AS s2, f3 AND NOT coalesce(lag(f3) OVER y, false) AS s3 FROM h1 WINDOW y AS (PARTITION BY site, wy ORDER BY d)),
py AS (SELECT site, wy, avg(q) AS Ma1, stddev_samp(q) / avg(q) AS Ma3, min(r7) / avg(q) AS Ml17, count(*) FILTER (s1)::DOUBLE AS Fl1, count(*) FILTER (s2)::DOUBLE AS Fh1, count(*) FILTER (s3)::DOUBLE AS Fh5,
  arg_max(dayofyear(d), {{'a': q, 'b': -r}})::DOUBLE AS Th1, arg_min(dayofyear(d), {{'a': q, 'b': r}})::DOUBLE AS low, max(r3) AS Dh2 FROM h2 GROUP BY 1, 2),
fl AS (SELECT site, quantile_cont(q, {fs.FLOOD}) AS flood FROM years GROUP BY 1),
t3 AS (SELECT site, max(k) / nullif(sum(k), 0) AS Ta3 FROM (SELECT site, (month(d) - 1) // 2 AS s, count(*) FILTER (q > flood) AS k FROM years JOIN fl USING (site) GROUP BY 1, 2) GROUP BY 1),
al AS (SELECT site, {", ".join(f"{middle}({n}) AS {n}" for n in ("Ma3", "Ml17", "Fl1", "Fh1", "Fh5", "Dh2"))}, 100 * stddev_samp(low) / avg(low) AS Tl2, 100 * stddev_samp(Th1) / avg(Th1) AS Th1 FROM py GROUP BY 1),
un AS (SELECT site, wy::VARCHAR AS scope, Ma1, Ma3, Ml17, Fl1, Fh1, Fh5, NULL::DOUBLE AS Tl2, Th1, Dh2, NULL::DOUBLE AS Ta2, NULL::DOUBLE AS Ta3, NULL::DOUBLE AS Phase FROM py
  UNION ALL SELECT site, 'all_years', m.Ma1, Ma3, Ml17, Fl1, Fh1, Fh5, Tl2, Th1, Dh2, colwell_predictability, t3.Ta3, phase FROM al JOIN (SELECT site, avg(q) AS Ma1 FROM years GROUP BY 1) m USING (site)
  JOIN t3 USING (site) JOIN (SELECT * FROM cw WHERE scope = 'all_years') USING (site) JOIN (SELECT * FROM season WHERE scope = 'all_years') USING (site))
SELECT site, scope, {_round(["Ma1", "Ma3", "Ml17", "Fl1", "Fh1", "Fh5", "Tl2", "Th1", "Dh2", "Ta2", "Ta3", "Phase"])} FROM un"""


query("fs24_hiap_mean", _hiap_sql("avg"))(lambda spark, sf_dir: rounded(fs.hiap(px.years(spark, sf_dir))))
query("fs24_hiap_median", _hiap_sql("median"))(lambda spark, sf_dir: rounded(fs.hiap(px.years(spark, sf_dir), use_median=True)))
