"""Trend and season of every series, and tests for stationarity.

Series are dealt by key; each function below works on one series in arrays.
"""

from __future__ import annotations

from math import ceil, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.features import autocorrelation

PARTS = "city string, date date, observed double, trend double, seasonal double, resid double"
# Response surface of the unit-root test with a constant, and the table of the level-stationarity test.
UNIT_ROOT_SPLIT, UNIT_ROOT_RANGE = -1.61, (-18.83, 2.74)
UNIT_ROOT_LOW, UNIT_ROOT_HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
LEVEL_CRITICAL, LEVEL_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def harmonics(t: np.ndarray, period: float, order: int) -> np.ndarray:
    angle = 2 * np.pi * np.outer(t, np.arange(1, order + 1)) / period
    return np.hstack([np.sin(angle), np.cos(angle)])


def robust_fit(x: np.ndarray, y: np.ndarray, eps: float = 1.35, rounds: int = 30) -> np.ndarray:
    """Huber's regression by reweighted least squares; ``rounds`` 0 is least squares."""
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(rounds):
        r = np.abs(y - x @ beta)
        scale = max(1.4826 * np.median(r), 1e-9)
        w = np.sqrt(np.minimum(1.0, eps * scale / np.maximum(r, 1e-12)))
        beta, old = np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0], beta
        if np.abs(beta - old).max() < 1e-8:
            break
    return beta


def harmonic_parts(y: np.ndarray, period: int, order: int = 4, degree: int = 2, robust: bool = True):
    t = np.arange(len(y), dtype=float)
    poly = np.vander(t / max(len(y) - 1, 1), degree + 1, increasing=True)
    beta = robust_fit(np.hstack([poly, harmonics(t, period, order)]), y, rounds=30 if robust else 0)
    return poly @ beta[: degree + 1], harmonics(t, period, order) @ beta[degree + 1 :]


def loess(y: np.ndarray, span: int, w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Locally linear fit with tricube weights at the places ``at`` of an even grid, in blocks."""
    n, q = len(y), min(span, len(y))
    out = np.empty(len(at))
    for a in range(0, len(at), 2048):
        p = at[a : a + 2048].astype(float)[:, None]
        ix = np.clip(np.round(p).astype(int) - q // 2, 0, n - q) + np.arange(q)
        d = np.abs(ix - p)
        k = np.clip(1 - (d / (d.max(axis=1, keepdims=True) + max(span - n, 0) // 2 + 1e-9)) ** 3, 0, None) ** 3 * w[ix] + 1e-12
        k /= k.sum(axis=1, keepdims=True)
        xm, ym = (k * ix).sum(axis=1), (k * y[ix]).sum(axis=1)
        dx = ix - xm[:, None]
        slope = (k * dx * y[ix]).sum(axis=1) / np.maximum((k * dx * dx).sum(axis=1), 1e-9)
        out[a : a + 2048] = ym + slope * (p[:, 0] - xm)
    return out


def stl_parts(y: np.ndarray, period: int, seasonal: int = 91, inner: int = 2, outer: int = 5):
    """Seasonal-trend decomposition by loess with bisquare robustness rounds."""
    n, t = len(y), np.arange(len(y))
    span = ceil(1.5 * period / (1 - 1.5 / seasonal)) | 1
    low = (period + 1) | 1
    trend, season, w = np.zeros(n), np.zeros(n), np.ones(n)
    mean = lambda x, k: np.convolve(x, np.full(k, 1 / k), "valid")
    for _ in range(outer + 1):
        for _ in range(inner):
            cycle = np.empty(n + 2 * period)
            for phase in range(period):
                sub = (y - trend)[phase::period]
                cycle[phase::period] = loess(sub, seasonal, w[phase::period], np.arange(-1, len(sub) + 1))
            flat = mean(mean(mean(cycle, period), period), 3)
            season = cycle[period : period + n] - loess(flat, low, np.ones(n), t)
            trend = loess(y - season, span, w, t)
        r = np.abs(y - trend - season)
        w = np.clip(1 - (r / max(6 * np.median(r), 1e-9)) ** 2, 0, None) ** 2
    return trend, season


def usable_period(n: int, period: int) -> int:
    """The period, or a shorter one for series of under two cycles."""
    return period if n >= 2 * period else max(7, n // 3)


def parts_of(y: np.ndarray, period: int = 365, method: str = "auto", periods=None):
    """Trend and season by method; several ``periods`` are removed in turn, those of under two cycles left out."""
    if method not in ("auto", "stl", "harmonic", "mstl"):
        raise ValueError(f"unknown method {method}")
    if method == "mstl":
        kept = [p for p in sorted(periods or (7, 365)) if len(y) >= 2 * p] or [7]
        found = dict.fromkeys(kept, np.zeros(len(y)))
        for _ in range(2):
            for p in kept:
                trend, found[p] = stl_parts(y - sum(v for q, v in found.items() if q != p), p)
        return trend, sum(found.values())
    if method == "harmonic" or (method == "auto" and len(y) < 3 * period):
        return harmonic_parts(y, period)
    return stl_parts(y, period)


def decompose(panel: DataFrame, period: int = 365, method: str = "auto", column: str = "temp_avg", periods=None) -> DataFrame:
    """``(city, date, observed, trend, seasonal, resid)``: harmonics under three cycles, loess otherwise."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y = pdf["observed"].to_numpy(float)
        trend, season = parts_of(y, usable_period(len(y), period), method, periods) if len(y) >= 14 else (np.full(len(y), y.mean()), np.zeros(len(y)))
        return pdf.assign(trend=trend, seasonal=season, resid=y - trend - season)

    rows = panel.where(F.col(column).isNotNull()).select("city", "date", F.col(column).cast("double").alias("observed"))
    return rows.groupBy("city").applyInPandas(run, PARTS)


def strengths(parts: DataFrame) -> DataFrame:
    """Shares of variance that trend and season hold beside the remainder."""
    share = lambda c: F.greatest(F.lit(0.0), F.coalesce(1 - F.try_divide(F.var_pop("resid"), F.var_pop(F.col("resid") + F.col(c))), F.lit(0.0)))
    return parts.groupBy("city").agg(share("trend").alias("trend_strength"), share("seasonal").alias("seasonal_strength"))


def unit_root(y: np.ndarray):
    """Augmented unit-root test with a constant; lags by AIC on a common sample."""
    n, dy = len(y), np.diff(y)
    most = max(min(ceil(12 * (n / 100) ** 0.25), n // 2 - 3), 0)

    def fit(p: int, start: int):
        x = np.column_stack([np.ones(len(dy) - start), y[start:-1], *[dy[start - k : len(dy) - k] for k in range(1, p + 1)]])
        beta, z = np.linalg.lstsq(x, dy[start:], rcond=None)[0], dy[start:]
        return x, beta, ((z - x @ beta) ** 2).sum()

    aic = [len(dy[most:]) * np.log(fit(p, most)[2] / len(dy[most:]) + 1e-300) + 2 * (p + 2) for p in range(most + 1)]
    best = int(np.argmin(aic))
    x, beta, sse = fit(best, best)
    se = sqrt(max(sse / (len(x) - x.shape[1]) * np.linalg.pinv(x.T @ x)[1, 1], 1e-300))
    tau = beta[1] / se
    if not UNIT_ROOT_RANGE[0] <= tau <= UNIT_ROOT_RANGE[1]:
        return tau, float(tau > 0)
    z = np.polyval((UNIT_ROOT_LOW if tau <= UNIT_ROOT_SPLIT else UNIT_ROOT_HIGH)[::-1], tau)
    return tau, (1 + erf(z / sqrt(2))) / 2


def level_stationary(y: np.ndarray):
    """Statistic of stationarity around a level; bandwidth chosen from the data."""
    n, r = len(y), y - y.mean()
    s0, s1 = (r @ r) / n, 0.0
    for i in range(1, int(n ** (2 / 9)) + 1):
        c = 2 * (r[i:] @ r[:-i]) / n
        s0, s1 = s0 + c, s1 + i * c
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)) if s0 else 0, n - 1)
    lrv = (r @ r + 2 * sum((1 - k / (lags + 1)) * (r[k:] @ r[:-k]) for k in range(1, lags + 1))) / n
    eta = (np.cumsum(r) ** 2).sum() / n**2 / max(lrv, 1e-300)
    return eta, float(np.interp(eta, LEVEL_CRITICAL, LEVEL_P))


def stationarity(panel: DataFrame, alpha: float = 0.05, column: str = "temp_avg") -> DataFrame:
    """Both tests per series and what they say together; under 20 rows or constant: null."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("date")["y"].to_numpy(float)
        if len(y) < 20 or y.std() < 1e-12:
            return pd.DataFrame([(key[0], None, None, None, None, None)])
        (tau, p), (eta, q) = unit_root(y), level_stationary(y)
        words = {(True, True): "stationary", (False, False): "non-stationary", (True, False): "trend-stationary", (False, True): "difference-stationary"}
        return pd.DataFrame([(key[0], tau, p, eta, q, words[p < alpha, q > alpha])])

    rows = panel.where(F.col(column).isNotNull()).select("city", "date", F.col(column).cast("double").alias("y"))
    return rows.groupBy("city").applyInPandas(run, "city string, adf_stat double, adf_p double, kpss_stat double, kpss_p double, verdict string")


def _once(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _partial(r: Column) -> Column:
    """Partial correlations from correlations 1.. by the Durbin-Levinson recursion, a fold over orders.

    The state holds the coefficients of the last order, the share of variance
    they leave and the partial correlations so far.
    """
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def order(state: Column, k: Column) -> Column:
        phi, back = state["phi"], F.reverse(F.slice(r, F.lit(1), k - 1))
        last = F.try_divide(F.get(r, k - 1) - add(F.zip_with(phi, back, lambda p, q: p * q)), state["left"])

        def grown(a: Column) -> Column:
            new = F.concat(F.zip_with(phi, F.reverse(phi), lambda p, q: p - a * q), F.array(a))
            return F.struct(new.alias("phi"), (state["left"] * (1 - a * a)).alias("left"), F.concat(state["out"], F.array(a)).alias("out"))

        return _once(last, grown)

    none = F.array().cast("array<double>")
    start = F.struct(none.alias("phi"), F.lit(1.0).alias("left"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.size(r)), start, order, lambda s: s["out"])


def acf_pacf(panel: DataFrame, lags: int = 60, column: str = "temp_avg") -> DataFrame:
    """Autocorrelations and partial ones (Yule-Walker on adjusted autocovariances) at lags under half the rows.

    A series' ``lags`` numbers are gathered into one row, never its values. A
    constant series has no rows.
    """
    size = panel.groupBy("city").agg(F.count(column).alias("n"))
    acf = autocorrelation(panel, lags, column).join(F.broadcast(size), "city").where("acf is not null")  # one row a series
    acf = acf.where(F.col("lag") <= F.floor(F.col("n") / 2) - 1).withColumn("r", F.col("acf") * F.col("n") / (F.col("n") - F.col("lag")))
    rows = acf.groupBy("city").agg(F.array_sort(F.collect_list(F.struct("lag", "acf", "band", "r"))).alias("x"))
    rows = rows.withColumn("pacf", _partial(F.col("x.r")))
    return rows.select("city", F.inline(F.zip_with("x", "pacf", lambda x, p: F.struct(x["lag"].alias("lag"), x["acf"].alias("acf"), p.alias("pacf"), x["band"].alias("band")))))
