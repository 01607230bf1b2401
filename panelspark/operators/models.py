"""Fitted forecasters per series: smoothing, autoregression with harmonics; steps that boosting shares.

Like the baselines they answer for all origins at once and see only rows
dated at or before an origin. Per-series models are dealt by series and origin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators import features
from panelspark.operators.decompose import harmonics, parts_of, usable_period
from panelspark.operators.forecast import COLUMNS, _train

FIELDS = "city string, origin date, horizon int, y_pred double, lower double, upper double"


def _by_series(panel: DataFrame, origins: DataFrame, column: str, extra, name: str, run) -> DataFrame:
    train = _train(panel, origins, column)
    if extra:
        train = train.join(panel.select("city", "date", *[F.col(c).cast("double").alias(c) for c in extra]), ["city", "date"])

    def each(key, pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf.sort_values("date"))
        return pd.DataFrame({"city": key[0], "origin": key[1], "horizon": np.arange(1, len(out) + 1), "y_pred": out[:, 0], "lower": out[:, 1], "upper": out[:, 2]})

    out = train.where("y is not null").groupBy("city", "origin").applyInPandas(each, FIELDS)
    return out.select(F.lit(name).alias("model"), "city", "origin", F.date_add("origin", F.col("horizon")).alias("target_date"), "horizon", "y_pred", "lower", "upper")


def _damped(y: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Damped additive trend; smoothing weights by least one-step error over a grid run side by side."""
    a, b, phi = (v.ravel() for v in np.meshgrid((0.05, 0.1, 0.2, 0.4, 0.7, 0.95), (0.0, 0.01, 0.05, 0.2), (0.8, 0.9, 0.98)))
    level, slope, sse = np.full(len(a), y[0]), np.zeros(len(a)), np.zeros(len(a))
    for v in y[1:]:
        guess = level + phi * slope
        sse += (v - guess) ** 2
        new = guess + a * (v - guess)
        slope, level = phi * slope + b * (new - level - phi * slope), new
    k = int(np.argmin(sse))
    return level[k] + slope[k] * np.cumsum(phi[k] ** ahead)


def smoothing(panel: DataFrame, origins: DataFrame, horizon: int = 14, period: int = 365, method: str = "harmonic", column: str = "temp_avg") -> DataFrame:
    """Season removed, damped smoothing of the rest, season of the same phase added again."""

    def run(pdf: pd.DataFrame) -> np.ndarray:
        y, ahead = pdf["y"].to_numpy(float), np.arange(1, horizon + 1)
        m = usable_period(len(y), period)
        season = parts_of(y, m, method)[1] if len(y) >= 28 else np.zeros(len(y))
        back = len(y) - 1 + ahead - m * np.ceil(ahead / m).astype(int)
        add = season[back] if len(y) >= m else 0.0
        return np.column_stack([_damped(y - season, ahead) + add, np.full((horizon, 2), np.nan)])

    return _by_series(panel, origins, column, (), "stl_ets", run).select(*COLUMNS)


def autoregression(panel: DataFrame, origins: DataFrame, horizon: int = 14, order=(2, 2), terms: int = 3, period: float = 365.25, exog=(), column: str = "temp_avg") -> DataFrame:
    """Regression on harmonics (and yesterday's channels) with ARMA errors, by least squares in steps.

    A long autoregression gives the innovations, a second fit the ARMA
    weights; 90% bounds follow from the weights' impulse response. Channels
    keep their last value over the horizon.
    """
    p, q = order
    exog = list(exog)

    def run(pdf: pd.DataFrame) -> np.ndarray:
        y, n = pdf["y"].to_numpy(float), len(pdf)
        if n < 60:
            return np.column_stack([np.full(horizon, y[-1]), np.full((horizon, 2), np.nan)])
        z = pdf[exog].ffill().bfill().fillna(0.0).to_numpy(float)
        z = (z - z.mean(axis=0)) / np.where(z.std(axis=0) > 1e-9, z.std(axis=0), 1.0) if exog else z
        t = np.arange(n + horizon)
        x = np.hstack([np.ones((n + horizon, 1)), harmonics(t, period, terms), np.vstack([z[:1], z[:-1], np.repeat(z[-1:], horizon, axis=0)])])
        beta = np.linalg.lstsq(x[:n], y, rcond=None)[0]
        u = y - x[:n] @ beta
        lag = lambda v, k: np.column_stack([np.r_[np.zeros(j), v[:-j]] for j in range(1, k + 1)])
        long = lag(u, 20)
        e = u - long @ np.linalg.lstsq(long[20:], u[20:], rcond=None)[0]
        design = np.hstack([lag(u, p), lag(e, q)])
        w = np.linalg.lstsq(design[25:], u[25:], rcond=None)[0]
        ar, ma = w[:p], w[p:]
        roots = np.abs(np.roots(np.r_[1.0, -ar])) if p else np.zeros(1)
        if roots.size and roots.max() >= 1:
            ar = ar * (0.98 / roots.max()) ** np.arange(1, p + 1)
        e, su = u - design @ np.r_[ar, ma], list(u[-p:])
        sigma, se, psi, out = e[25:].std(), list(e[-q:]), [1.0], []
        for h in range(1, horizon + 1):
            v = sum(ar[j] * su[-1 - j] for j in range(p)) + sum(ma[j] * se[-1 - j] for j in range(q))
            width = 1.6448536269514722 * sigma * np.sqrt(np.square(psi).sum())
            mean = x[n + h - 1] @ beta + v
            out.append((mean, mean - width, mean + width))
            su.append(v), se.append(0.0)
            psi.append(sum(ar[j] * psi[h - 1 - j] for j in range(min(p, h))) + (ma[h - 1] if h <= q else 0.0))
        return np.array(out)

    return _by_series(panel, origins, column, exog, "sarimax_exog" if exog else "sarimax_fourier", run)


def anomaly_persistence(panel: DataFrame, clim: DataFrame, column: str = "temp_avg") -> DataFrame:
    """One row: mean lag-one correlation (held in [0, 0.98]) and deviation of anomalies over series with 30 rows or more."""
    a = panel.withColumn("doy", F.dayofyear("date")).join(clim, ["city", "doy"]).select("city", "date", (F.col(column) - F.col("clim")).alias("a"))
    by = a.withColumn("l", F.lag("a").over(features.by_city())).groupBy("city").agg(
        F.count("a").alias("n"), features.safe_corr(F.col("a"), F.col("l")).alias("r"), F.stddev_pop("a").alias("s"))
    return by.where("n >= 30 and s >= 1e-9").agg(F.least(F.greatest(F.avg("r"), F.lit(0.0)), F.lit(0.98)).alias("rho"), F.avg("s").alias("sigma"))


def shrinkage(predicted: DataFrame, persistence: DataFrame) -> DataFrame:
    """Factors by model and horizon that cap the spread of predicted anomalies at what persistence allows; never rising with the horizon.

    ``predicted`` holds ``(model, horizon, anomaly)``.
    """
    s = predicted.groupBy("model", "horizon").agg(F.count("*").alias("n"), F.stddev_pop("anomaly").alias("sd")).crossJoin(F.broadcast(persistence))  # one row
    cap = F.least(F.greatest(F.try_divide(F.col("sigma") * F.pow("rho", F.col("horizon")), F.col("sd")), F.lit(0.0)), F.lit(1.0))
    raw = F.when((F.col("n") >= 20) & (F.col("sd") >= 1e-9), cap).otherwise(1.0)
    down = Window.partitionBy("model").orderBy("horizon")
    return s.withColumn("raw", raw).select("model", "horizon", "raw", F.min("raw").over(down).alias("factor"))


def inference_rows(panel: DataFrame, origins: DataFrame, horizon: int = 14, column: str = "temp_avg") -> DataFrame:
    """The features of supervised rows at each origin and horizon, known at the origin and without a target."""
    now = features.all_history(panel, column).join(F.broadcast(origins.withColumnRenamed("origin", "date")), "date").withColumnRenamed("date", "origin")  # a handful
    ask = now.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("target_date", F.date_add("origin", F.col("horizon")))
    first = panel.agg(F.min("date").alias("_day0"))
    return features.calendar_terms(ask.crossJoin(F.broadcast(first)), date="target_date", origin=F.col("_day0")).drop("_day0")  # one row


def chronological_split(rows: DataFrame, days: int = 90) -> DataFrame:
    """``rows(origin)`` with ``validation``: whether the origin lies in the last ``days`` days of origins."""
    last = rows.agg(F.max("origin").alias("_last"))
    return rows.crossJoin(F.broadcast(last)).withColumn("validation", F.col("origin") > F.date_sub("_last", days)).drop("_last")  # one row


def in_sample_residuals(rows: DataFrame, anomaly: str = "anomaly", predicted: str = "prediction") -> DataFrame:
    """Residuals of training rows ``(city, origin, horizon)``; the factors by horizon are not applied."""
    return rows.select("city", "origin", "horizon", (F.col(anomaly) - F.col(predicted)).alias("residual"))
