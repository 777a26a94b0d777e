"""Column functions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def water_year(d: Column, start_month: int = 10) -> Column:
    """The water year of a date; with start month 1 each calendar year is labelled with the next."""
    return F.year(d) + (F.month(d) >= start_month).cast("int")


def water_year_start(wy: Column, start_month: int = 10) -> Column:
    return F.make_date(wy - 1, F.lit(start_month), F.lit(1))


def not_leap_day(d: Column) -> Column:
    return ~((F.month(d) == 2) & (F.dayofmonth(d) == 29))


def floored(q: Column, least: float = 1e-6) -> Column:
    """q, at least a positive floor; null stays null."""
    return F.when(q.isNotNull(), F.greatest(q, F.lit(least)))


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def to_number(x: Column) -> Column:
    """A double from text; null where it isn't one."""
    return null_if_nan(x.cast("string").try_cast("double"))


def to_id(x: Column) -> Column:
    """A long id from text such as 123.0; null where it isn't one."""
    return x.cast("string").try_cast("double").try_cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def cv(x: Column) -> Column:
    """Sample standard deviation over mean, an aggregate."""
    return F.try_divide(F.stddev_samp(x), F.avg(x))


def pearson(x: Column, y: Column) -> Column:
    """Correlation from moments, an aggregate; null where a side is constant. x and y are both null or neither."""
    n = F.count(x)
    xy = F.sum(x * y) - F.try_divide(F.sum(x) * F.sum(y), n)
    xx, yy = (F.sum(v * v) - F.try_divide(F.sum(v) * F.sum(v), n) for v in (x, y))
    return F.try_divide(xy, F.sqrt(F.greatest(xx, F.lit(0.0)) * F.greatest(yy, F.lit(0.0))))


def log_share(p: Column) -> Column:
    return -p * F.log10(p)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, other columns as they are; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


TAU = 2 * math.pi


def in_clause(field: str, values: list | None) -> str | None:
    """SQL that holds where field is one of values: texts quoted, numbers as they are; None without values."""
    if not values:
        return None
    quoted = ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else str(v) for v in values]
    return f"{field} IN ({', '.join(quoted)})"
