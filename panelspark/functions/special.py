"""Tail probabilities as column expressions.

Each is a ratio of two integrals of the same density over a grid of fixed
size, so normalising constants cancel and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS, REACH = 400, 12.0


def _tail_share(density: Callable[[Column], Column], start: Column, stop: Column) -> Column:
    """Simpson's rule over [start, stop] divided by that over [0, stop]."""

    def integral(lo: Column) -> Column:
        h = (stop - lo) / STEPS
        weight = lambda i: F.when(i.isin(0, STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return h * F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda s, i: s + weight(i) * density(lo + i * h))

    return F.when(start.isNull() | stop.isNull(), None).when(start >= stop, 0.0).otherwise(integral(start) / integral(F.lit(0.0)))


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-square with ``df`` degrees > x), integrated over the radius."""
    return _tail_share(lambda r: F.pow(r, df - 1.0) * F.exp(-r * r / 2), F.sqrt(x), F.sqrt(df) + REACH)


def f_tail(x: Column, d1: Column, d2: Column) -> Column:
    """P(F with ``d1`` and ``d2`` degrees > x), integrated over the angle."""
    stop = F.least(F.lit(pi / 2), (F.sqrt(d1) + REACH) / F.sqrt(d2))
    density = lambda a: F.pow(F.sin(a), d1 - 1.0) * F.pow(F.cos(a), d2 - 1.0)
    return _tail_share(density, F.atan(F.sqrt(d1 * x / d2)), stop)


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t."""
    return f_tail(t * t, F.lit(1.0), df)


def ks_tail(d: Column, n: Column) -> Column:
    """Kolmogorov's limit distribution with the usual small-sample factor."""
    z = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * d
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * z * z))
    return F.when(z < 0.2, 1.0).otherwise(F.least(F.greatest(terms, F.lit(0.0)), F.lit(1.0)))


def normal_test(skew: Column, kurt: Column, n: Column) -> Column:
    """D'Agostino and Pearson's statistic from population skewness and excess kurtosis."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    z1 = F.asinh(y * F.sqrt((w2 - 1) / 2)) / F.sqrt(F.log(w2) / 2)
    mean, var = -6 / (n + 1), 24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt - mean) / F.sqrt(var)
    b = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b * (2 / b + F.sqrt(1 + 4 / (b * b)))
    root = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.sign(root) * F.pow(F.abs(root), 1 / 3)) / F.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2
