"""Column helpers with pandas' missing-value semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar names and seasons by month.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SEASONS = ("Winter", "Pre-monsoon", "Monsoon", "Post-monsoon")


def null_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pairwise-complete Pearson correlation; null where a side is constant.

    Extremes tell a constant: its deviation, merged from several tasks, can round to more than zero.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def season_id(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), 0).when(month <= 5, 1).when(month <= 9, 2).otherwise(3)


def season(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEASONS)), season_id(month) + 1)


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), month)
