"""Column functions with the null and tie rules that the panel needs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def eom(day: Column | str) -> Column:
    return F.last_day(day)


def month_number(day: Column | str) -> Column:
    """Months since year 0, for calendar windows."""
    return F.year(day) * 12 + F.month(day)


def lookup(codes: Mapping, key: Column) -> Column:
    """Value of a literal map; an unknown or null key is null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), key)


def finite(x: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.nanvl(x, F.lit(None).cast("double"))


def zscore(x: Column, mean: Column, deviation: Column) -> Column:
    """0 in every row where the deviation is 0 or undefined, whatever the value."""
    return F.when(deviation.isNull() | (deviation == 0), F.lit(0.0)).otherwise((x - mean) / deviation)


def weighted_mean(x: str | Column, w: str | Column) -> Column:
    """A null value takes its weight with it."""
    x, w = (F.col(c) if isinstance(c, str) else c for c in (x, w))
    return F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition.cast("double"), F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Aggregate over flags: rows with both over rows with any, null where none has one."""
    return F.try_divide(F.sum((a & b).cast("double")), F.sum((a | b).cast("double")))


def r_squared(y: str, fitted: str) -> Column:
    """Out-of-sample: against the rows' own mean; null where y doesn't vary."""
    residual = F.sum((F.col(y) - F.col(fitted)) ** 2)
    return 1 - F.try_divide(residual, F.nullif(F.regr_syy(F.col(y), F.col(y)), F.lit(0.0)))


def mean_abs_error(y: str, fitted: str) -> Column:
    return F.avg(F.abs(F.col(y) - F.col(fitted)))


def rmse(y: str, fitted: str) -> Column:
    return F.sqrt(F.avg((F.col(y) - F.col(fitted)) ** 2))


def direction_hits(y: str, fitted: str) -> Column:
    """Share of equal signs; zero against zero is a hit."""
    return F.avg((F.signum(y) == F.signum(fitted)).cast("double"))


def percent(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def fixed(x: Column, digits: int = 3) -> Column:
    return F.format_string(f"%.{digits}f", x)
