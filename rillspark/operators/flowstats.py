"""Hydrologic indices per site and scope (a water year or all_years).

All windows and aggregates run over (site, scope), so one shuffle serves every family; order by day and order by flow
are two sorts of the same partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import TAU, cv, log_share, not_leap_day, pearson, ratio
from .graph import cut
from .prepare import scoped

KEYS = ["site", "scope"]
SPANS = (1, 3, 7, 30, 90)
#: Share of days above the flood threshold: one in 1.67 years.
FLOOD = 1 - 1 / 1.67
#: Bins of log flow as multiples of the log mean.
BREAKS = (0.1, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.25)


def _all() -> Window:
    return Window.partitionBy(*KEYS)


def _order() -> Window:
    return _all().orderBy("d")


def rolling(span: int, least: int | None = None) -> Column:
    """Trailing mean of q over so many rows, where at least so many of them (all, by default) have a value."""
    w = _order().rowsBetween(1 - span, 0)
    return F.when(F.count("q").over(w) >= (least or span), F.avg("q").over(w))


def annotated(years: DataFrame) -> DataFrame:
    """Scoped days with the columns that the aggregates below need."""
    df = scoped(years)
    df = df.withColumn("t", F.row_number().over(_order()) - 1).withColumn("n", F.count("*").over(_all()))
    df = df.withColumn("before", F.lag("q").over(_order())).withColumn("mean", F.avg("q").over(_all()))
    df = df.withColumn("diff", F.col("q") - F.col("before")).withColumn("turn", F.signum("diff"))
    df = df.withColumn("turned", F.col("turn") * F.lag("turn").over(_order()) < 0)
    for p in (25, 75):
        df = df.withColumn(f"p{p}", F.percentile("q", p / 100).over(_all()))
    df = df.withColumn("high", F.col("q") >= F.col("p75")).withColumn("low", F.col("q") <= F.col("p25"))
    for side in ("high", "low"):
        df = df.withColumn(f"{side}_start", F.col(side) & ~F.coalesce(F.lag(side).over(_order()), F.lit(False)))
    for span in SPANS:
        df = df.withColumn(f"r{span}", rolling(span))
    return df


def l_moments(days: DataFrame) -> DataFrame:
    """mean_l_moment, l_cv, l_skew, l_kurt by probability-weighted moments; null under four values."""
    ranked = days.filter("q is not null").withColumn("i", F.row_number().over(_all().orderBy("q")).cast("double"))
    i, q = F.col("i"), F.col("q")
    sums = ranked.groupBy(*KEYS).agg(F.count("*").cast("double").alias("n"), F.avg(q).alias("b0"), F.sum((i - 1) * q).alias("s1"), F.sum((i - 1) * (i - 2) * q).alias("s2"), F.sum((i - 1) * (i - 2) * (i - 3) * q).alias("s3"))
    n = F.col("n")
    b0, b1, b2 = F.col("b0"), ratio(F.col("s1"), n * (n - 1)), ratio(F.col("s2"), n * (n - 1) * (n - 2))
    b3 = ratio(F.col("s3"), n * (n - 1) * (n - 2) * (n - 3))
    l2, l3, l4 = 2 * b1 - b0, 6 * b2 - 6 * b1 + b0, 20 * b3 - 30 * b2 + 12 * b1 - b0
    enough = lambda x: F.when(n >= 4, x)
    return sums.select(*KEYS, enough(b0).alias("mean_l_moment"), enough(ratio(l2, b0)).alias("l_cv"), enough(ratio(l3, l2)).alias("l_skew"), enough(ratio(l4, l2)).alias("l_kurt"))


def ar1() -> list[Column]:
    both = F.col("before").isNotNull() & F.col("q").isNotNull()
    return [pearson(F.when(both, F.col("before")), F.when(both, F.col("q"))).alias("ar1_coefficient")]


def season() -> list[Column]:
    """Amplitude and phase of the Fourier bin next to one cycle in 365 days; one bin takes two weighted sums."""
    k = F.round(F.col("n") / 365)
    angle = F.lit(TAU) * k * F.col("t") / F.col("n")
    off = F.col("q") - F.col("mean")
    re, im, cycles = F.sum(off * F.cos(angle)), -F.sum(off * F.sin(angle)), F.round(F.max("n") / 365)
    turn = F.atan2(im, re) / TAU * 365
    amplitude = F.when(cycles > 0, 2 * F.sqrt(re * re + im * im) / F.max("n")).otherwise(0.0)
    return [amplitude.alias("amplitude"), F.when(cycles > 0, F.when(turn < 0, turn + 365).otherwise(turn)).alias("phase")]


def monthly() -> list[Column]:
    month = lambda m: F.when(F.month("d") == m, F.col("q"))
    return [f(month(m)).alias(f"{name}_month_{m:02d}") for name, f in (("mean", F.avg), ("median", F.median)) for m in range(1, 13)]


def extremes() -> list[Column]:
    return [f(f"r{s}").alias(f"{name}_{s}day") for s in SPANS for name, f in (("min", F.min), ("max", F.max))]


def pulses() -> list[Column]:
    out = []
    for side, p in (("high", 75), ("low", 25)):
        count = F.count_if(f"{side}_start")
        out += [count.alias(f"{side}_pulse_count"), F.coalesce(ratio(F.count_if(side), count), F.lit(0.0)).alias(f"{side}_pulse_avg_dur"), F.max(f"p{p}").alias(f"{side}_thresh_used")]
    return out


def pulse_rates() -> list[Column]:
    """Mean rise and fall on pulse days, each against the day before, whether that is in the pulse or not."""
    return [F.avg(F.when(F.col(side) & (F.col("diff") * sign > 0), F.col("diff"))).alias(f"{side}_pulse_{name}_mean") for side in ("high", "low") for name, sign in (("rise", 1), ("fall", -1))]


def rates() -> list[Column]:
    """Mean rise and fall (0 without any; null under two days) and the number of turns, which a flat day breaks."""
    side = lambda sign: F.when(F.count("q") > 1, F.coalesce(F.avg(F.when(F.col("diff") * sign > 0, F.col("diff"))), F.lit(0.0)))
    return [side(1).alias("mean_rise_rate"), side(-1).alias("mean_fall_rate"), F.when(F.count("q") > 1, F.count_if("turned")).alias("reversals")]


def timing() -> list[Column]:
    day = F.dayofyear("d")
    return [
        F.max_by(day, F.when(F.col("q").isNotNull(), F.struct("q", -F.col("t")))).alias("julian_max"),
        F.min_by(day, F.when(F.col("q").isNotNull(), F.struct("q", "t"))).alias("julian_min"),
        ratio(F.sum(day * F.col("q")), F.sum("q")).alias("center_of_timing"),
    ]


def variability() -> list[Column]:
    return [F.stddev_samp("q").alias("std_daily"), cv(F.col("q")).alias("cv_daily")]


def baseflow() -> list[Column]:
    return [ratio(F.min("r7"), F.avg("q")).alias("bfi")]


def cv_annual(days: DataFrame) -> DataFrame:
    """Variation of calendar-year means; a water year spans two."""
    years = days.groupBy(*KEYS, F.year("d").alias("y")).agg(F.avg("q").alias("m"))
    return years.groupBy(*KEYS).agg(cv(F.col("m")).alias("cv_annual"))


def fh5(days: DataFrame) -> DataFrame:
    """Mean and median number of days over the median per calendar year."""
    over = days.withColumn("p50", F.median("q").over(_all())).groupBy(*KEYS, F.year("d").alias("y")).agg(F.count_if(F.col("q") > F.col("p50")).alias("k"))
    return over.groupBy(*KEYS).agg(F.avg("k").alias("fh5_mean"), F.median("k").alias("fh5_median"))


def colwell(days: DataFrame) -> DataFrame:
    """Constancy, contingency and predictability from the entropies of days, flow bins and both.

    The day is the row's number within its calendar year; constancy is a share and predictability a percentage, as the
    indices are defined.
    """
    base = days.filter(not_leap_day(F.col("d"))).filter("q is not null")
    base = base.withColumn("day", F.row_number().over(Window.partitionBy(*KEYS, F.year("d")).orderBy("d"))).withColumn("m", F.log10(F.avg("q").over(_all())))
    bin_ = sum((F.col("m") * b <= F.log10("q")).cast("int") for b in BREAKS)
    cells = base.withColumn("bin", bin_).groupBy(*KEYS, "day", "bin").agg(F.count("*").alias("k"))
    cells = cells.withColumn("z", F.sum("k").over(_all()))
    entropy = lambda by, name: cells.groupBy(*KEYS, *by).agg((F.sum("k") / F.first("z")).alias("p")).groupBy(*KEYS).agg(F.sum(log_share(F.col("p"))).alias(name))
    all_ = entropy(["day"], "hx").join(entropy(["bin"], "hy"), KEYS).join(entropy(["day", "bin"], "hxy"), KEYS)
    top = F.log10(F.lit(len(BREAKS) + 1.0))
    constancy, predictability = 1 - F.col("hy") / top, 100 * (1 - (F.col("hxy") - F.col("hx")) / top)
    return all_.select(*KEYS, constancy.alias("colwell_constancy"), (predictability - constancy).alias("colwell_contingency"), predictability.alias("colwell_predictability"))


def ta3(days: DataFrame) -> DataFrame:
    """Largest share of flood days in one of six two-month seasons from October; null without flood days."""
    base = days.filter(not_leap_day(F.col("d")))
    peaks = base.groupBy(*KEYS, F.year("d").alias("y")).agg(F.max("q").alias("peak")).groupBy(*KEYS).agg(F.percentile("peak", F.lit(FLOOD)).alias("flood"))
    season_ = F.floor(F.pmod(F.month("d") + 2, F.lit(12)) / 2)
    counts = base.join(peaks, KEYS).groupBy(*KEYS, season_.alias("s")).agg(F.count_if(F.col("q") > F.col("flood")).alias("k"))
    return counts.groupBy(*KEYS).agg(ratio(F.max("k"), F.sum("k")).alias("ta3"))


def gathered(years: DataFrame, *families: list[Column]) -> DataFrame:
    """The given aggregates of annotated days, in one pass."""
    return annotated(years).groupBy(*KEYS).agg(*[c for f in families for c in f])


def magnificent_seven(years: DataFrame) -> DataFrame:
    days = scoped(years)
    return l_moments(days).join(gathered(years, ar1(), season()), KEYS)


def cv_julian(stats: DataFrame) -> DataFrame:
    """Variation of the per-year days of maximum and minimum, one row per site."""
    per_year = stats.filter("scope <> 'all_years'")
    return per_year.groupBy("site").agg(cv(F.col("julian_max")).alias("cv_julian_max"), cv(F.col("julian_min")).alias("cv_julian_min"), F.count("*").alias("n_years"))


def all_stats(years: DataFrame) -> DataFrame:
    """Every index per water year and, under all_years, of the whole record; there counts of pulses and turns are per year."""
    years = cut(years)  # all families start from the same days
    days = scoped(years)
    stats = gathered(years, ar1(), season(), monthly(), extremes(), pulses(), pulse_rates(), rates(), timing(), variability(), baseflow())
    for more in (l_moments(days), cv_annual(days), fh5(days), colwell(days), ta3(days)):
        stats = stats.join(more, KEYS, "left")
    stats = cut(stats)
    stats = stats.join(cv_julian(stats), "site", "left")
    whole = F.col("scope") == "all_years"
    for c in ("cv_julian_max", "cv_julian_min"):
        stats = stats.withColumn(c, F.when(whole, F.col(c)))
    for c in ("high_pulse_count", "low_pulse_count", "reversals"):
        stats = stats.withColumn(c, F.when(whole, ratio(F.col(c), F.col("n_years"))).otherwise(F.col(c)).cast("double"))
    return stats.drop("n_years")


def hiap(years: DataFrame, use_median: bool = False) -> DataFrame:
    """Twelve indices per water year and, under all_years, their mean or median over years or their own whole-record rule."""
    years = cut(years)
    year = Window.partitionBy("site", "wy").orderBy("d")
    site = Window.partitionBy("site")
    df = years.withColumn("t", F.row_number().over(year))
    for p in (25, 50, 75):
        df = df.withColumn(f"p{p}", F.percentile("q", p / 100).over(site))
    for span in (3, 7):
        df = df.withColumn(f"r{span}", F.avg("q").over(year.rowsBetween(1 - span, 0)))
    tests = {"Fl1": F.col("q") <= F.col("p25"), "Fh1": F.col("q") >= F.col("p75"), "Fh5": F.col("q") >= F.col("p50")}
    for name, test in tests.items():
        df = df.withColumn(f"_{name}", F.coalesce(test, F.lit(False)))
        df = df.withColumn(name, F.col(f"_{name}") & ~F.coalesce(F.lag(f"_{name}").over(year), F.lit(False)))
    day, have = F.dayofyear("d"), F.col("q").isNotNull()
    per = df.groupBy("site", "wy").agg(
        F.avg("q").alias("Ma1"), cv(F.col("q")).alias("Ma3"), ratio(F.min("r7"), F.avg("q")).alias("Ml17"),
        *[F.count_if(n).cast("double").alias(n) for n in tests],
        F.max_by(day, F.when(have, F.struct("q", -F.col("t")))).cast("double").alias("Th1"), F.min_by(day, F.when(have, F.struct("q", "t"))).cast("double").alias("low"), F.max("r3").alias("Dh2"),
    )
    none = F.lit(None).cast("double")
    names = ["Ma1", "Ma3", "Ml17", "Fl1", "Fh1", "Fh5", "Tl2", "Th1", "Dh2", "Ta2", "Ta3", "Phase"]
    yearly = per.select("site", F.col("wy").cast("string").alias("scope"), *[F.col(n) if n in per.columns else none.alias(n) for n in names])
    middle = F.median if use_median else F.avg
    whole = per.groupBy("site").agg(*[middle(n).alias(n) for n in ("Ma3", "Ml17", "Fl1", "Fh1", "Fh5", "Dh2")], (100 * cv(F.col("low"))).alias("Tl2"), (100 * cv(F.col("Th1"))).alias("Th1"))
    flood = years.withColumn("flood", F.percentile("q", F.lit(FLOOD)).over(site))
    seasons = flood.groupBy("site", F.floor((F.month("d") - 1) / 2).alias("s")).agg(F.count_if(F.col("q") > F.col("flood")).alias("k"))
    days = scoped(years).filter("scope = 'all_years'")
    for more in (
        years.groupBy("site").agg(F.avg("q").alias("Ma1")),
        seasons.groupBy("site").agg(ratio(F.max("k"), F.sum("k")).alias("Ta3")),
        colwell(days).select("site", F.col("colwell_predictability").alias("Ta2")),
        gathered(years, season()).filter("scope = 'all_years'").select("site", F.col("phase").alias("Phase")),
    ):
        whole = whole.join(more, "site", "left")
    return yearly.unionByName(whole.select("site", F.lit("all_years").alias("scope"), *names))
