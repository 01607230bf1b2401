"""Baseline forecasters and walk-forward backtests as single plans.

Every forecaster takes the panel and a table of origins and answers for all
origins at once: training rows are those dated at or before an origin.
Forecasts are ``(model, city, origin, target_date, horizon, y_pred)``.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.features import smoothed_year
from panelspark.sources.panel import rolling_origins

COLUMNS = ("model", "city", "origin", "target_date", "horizon", "y_pred")


def _train(panel: DataFrame, origins: DataFrame, column: str) -> DataFrame:
    """Rows known at each origin; origins are a handful, checked by rolling_origins."""
    return panel.select("city", "date", F.col(column).alias("y")).join(origins, F.col("date") <= F.col("origin"))


def _ahead(df: DataFrame, horizon: int) -> DataFrame:
    h = df.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return h.withColumn("target_date", F.date_add("origin", F.col("horizon")))


def _known(panel: DataFrame, origins: DataFrame, value, name: str) -> DataFrame:
    """A running ``value`` of each series as of its last row at or before each origin: one pass, then a lookup.

    Between two rows of a series the value holds, so each row knows until when.
    """
    by = Window.partitionBy("city").orderBy("date")
    rows = panel.select("city", "date", value(by).alias(name), F.lead("date").over(by).alias("next"))
    at = (F.col("date") <= F.col("origin")) & (F.col("next").isNull() | (F.col("next") > F.col("origin")))
    return rows.join(F.broadcast(origins), at).select("city", "origin", name)  # a handful of origins


def naive(panel: DataFrame, origins: DataFrame, horizon: int = 14, column: str = "temp_avg") -> DataFrame:
    panel = checked(panel, (column,))
    last = _known(panel, origins, lambda by: F.last(column, True).over(by), "y_pred").where("y_pred is not null")
    return as_predictions(_ahead(last, horizon), "naive")


def seasonal_naive(panel: DataFrame, origins: DataFrame, horizon: int = 14, period: int = 365, column: str = "temp_avg") -> DataFrame:
    """The value ``period`` days before the target, else the mean of the last seven rows."""
    panel = checked(panel, (column,))
    base = _known(panel, origins, lambda by: F.avg(column).over(by.rowsBetween(-6, 0)), "fallback")
    past = panel.select("city", F.date_add("date", period).alias("target_date"), F.col("date").alias("seen"), F.col(column).alias("past"))
    out = _ahead(base, horizon).join(past, ["city", "target_date"], "left")
    past_known = F.when(F.col("seen") <= F.col("origin"), F.col("past"))
    return as_predictions(out.withColumn("y_pred", F.coalesce(past_known, "fallback")), "seasonal_naive")


def climatology_by_origin(panel: DataFrame, origins: DataFrame, window: int = 15, column: str = "temp_avg") -> DataFrame:
    """``(city, origin, doy, clim)``: the climatology that each origin knows, from one pass over the panel.

    Each row is summed once, into its day of the year between two origins;
    an origin's state is the sum of the states up to it.
    """
    asked = origins.select("origin").distinct()
    between = asked.withColumn("after", F.lag("origin").over(Window.orderBy("origin")))  # one row an origin
    within = (F.col("date") <= F.col("origin")) & (F.col("after").isNull() | (F.col("date") > F.col("after")))
    rows = panel.select("city", "date", F.col(column).cast("double").alias("y")).join(F.broadcast(between), within)
    states = rows.groupBy("city", F.dayofyear("date").alias("doy"), F.col("origin").alias("until")).agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    merged = states.join(F.broadcast(asked), F.col("until") <= F.col("origin")).groupBy("city", "origin", "doy").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    key = merged.select(F.struct("city", "origin").alias("city"), "doy", "m")
    return smoothed_year(key, window).select("city.city", "city.origin", "doy", "clim")


def climatology_persistence(panel: DataFrame, origins: DataFrame, horizon: int = 14, decay: float = 0.85, window: int = 15, column: str = "temp_avg", recent: int = 7) -> DataFrame:
    """Climatology fitted per origin plus the mean anomaly of the last ``recent`` rows times ``decay ** horizon``; decay 0 is climatology alone."""
    panel = checked(panel, (column,))
    clim = climatology_by_origin(panel, origins, window, column)
    row = F.struct(F.dayofyear("date").alias("doy"), F.col(column).cast("double").alias("y"))
    last = _known(panel, origins, lambda by: F.collect_list(row).over(by.rowsBetween(1 - recent, 0)), "last")
    last = last.select("city", "origin", F.inline("last")).join(clim, ["city", "origin", "doy"])
    anomaly = last.groupBy("city", "origin").agg(F.avg(F.col("y") - F.col("clim")).alias("anomaly"))
    out = _ahead(anomaly, horizon).withColumn("doy", F.dayofyear("target_date")).join(clim, ["city", "origin", "doy"])
    damp = F.pow(F.lit(float(decay)), F.col("horizon")) if decay else F.lit(0.0)
    name = "climatology_persistence" if decay else "climatology"
    return as_predictions(out.withColumn("y_pred", F.col("clim") + F.coalesce("anomaly", F.lit(0.0)) * damp), name)


def checked(panel: DataFrame, columns=("temp_avg",)) -> DataFrame:
    """The training panel if a model can be fitted on it: rows and the needed columns, else ValueError."""
    missing = [c for c in ("city", "date", *columns) if c not in panel.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if panel.isEmpty():
        raise ValueError("no training rows")
    return panel


def scaffold(cities: DataFrame, origins: DataFrame, horizon: int = 14) -> DataFrame:
    """Every series, origin and horizon, without predictions."""
    return _ahead(cities.select("city").distinct().crossJoin(F.broadcast(origins)), horizon).withColumns({"model": F.lit(None).cast("string"), "y_pred": F.lit(None).cast("double")}).select(*COLUMNS)


def as_predictions(rows: DataFrame, model: str, *extra: str) -> DataFrame:
    """``rows(city, origin, horizon, y_pred)`` as forecasts of ``model``; ``extra`` columns pass."""
    missing = [c for c in ("city", "origin", "horizon", "y_pred") if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.withColumns({"model": F.lit(model), "target_date": F.date_add("origin", F.col("horizon"))}).select(*COLUMNS, *extra)


TIMINGS = "model string, origin date, seconds double, rows long, status string"


def backtest(panel: DataFrame, factories: dict, origins: DataFrame, horizon: int, out: str, column: str = "temp_avg") -> tuple[DataFrame, DataFrame]:
    """Scored forecasts of each of ``factories`` (functions of panel, origins, horizon), and how each went at each origin.

    Every model is one plan over all origins, written under ``out``, a folder
    that driver and executors share. Where a plan fails, the model is asked for
    one origin after another, so a failure stays with its own model and origin.
    The second table is ``(model, origin, seconds, rows, status)``; origins that
    one plan served share its seconds. RuntimeError if nothing succeeds.
    """
    spark = panel.sparkSession
    days = [r["origin"] for r in origins.select("origin").distinct().orderBy("origin").collect()]  # a handful
    went, good = [], []

    def attempt(name: str, make, asked: list, path: str) -> str:
        began = time.time()
        try:
            some = origins.where(F.col("origin").isin(asked))
            walk_forward(panel, make(panel, some, horizon).select(*COLUMNS), column).write.mode("overwrite").parquet(path)
            rows = {r["origin"]: r["count"] for r in spark.read.parquet(path).groupBy("origin").count().collect()}
            status = "ok"
            good.append(path)
        except Exception as e:  # whatever a model raises is its own failure
            rows, status = {}, f"{type(e).__name__}: {str(e)[:200]}"
        if status == "ok" or len(asked) == 1:
            went.extend((name, d, (time.time() - began) / len(asked), rows.get(d, 0), status) for d in asked)
        return status

    for name, make in factories.items():
        if attempt(name, make, days, f"{out}/name={name}") != "ok" and len(days) > 1:
            for d in days:
                attempt(name, make, [d], f"{out}/name={name}-{d}")
    if not good:
        raise RuntimeError(f"every model failed: {went}")
    return spark.read.parquet(*good), spark.createDataFrame(went, TIMINGS)


def walk_forward(panel: DataFrame, forecasts: DataFrame, column: str = "temp_avg") -> DataFrame:
    """Forecasts with their truth; targets without a truth are dropped."""
    truth = panel.select("city", F.col("date").alias("target_date"), F.col(column).alias("y_true")).where("y_true is not null")
    return forecasts.join(truth, ["city", "target_date"])


def calibration_origins(panel: DataFrame, horizon: int = 14, n: int = 6, tests: int = 8, stride: int = 14, min_train: int = 400, calibration_days: int = 90) -> DataFrame:
    """Origins before the test window, one horizon apart, whose targets end at or before the first test origin."""
    first = rolling_origins(panel, horizon, tests, stride, min_train).agg(F.min("origin").alias("first_origin"))
    before = panel.join(F.broadcast(first), F.col("date") <= F.col("first_origin"))  # one row
    return rolling_origins(before, horizon, n, horizon, min_train - calibration_days)
