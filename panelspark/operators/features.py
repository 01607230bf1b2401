"""Audit statistics, calendar terms, climatology and leakage-safe features."""

from __future__ import annotations

import re
from math import log1p, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.stats import safe_corr, season_id


def by_city():
    return Window.partitionBy("city").orderBy("date")


LAGS, WINDOWS = (1, 2, 3, 7, 14, 21, 28, 365), (7, 14, 28, 90)
#: Lags up to this one must be known in supervised rows.
SHORT = 28
CALENDAR = ("month", "imd_season", "doy", "weekday", "time_idx")


def autocorrelation(panel: DataFrame, lags: int = 7, column: str = "temp_avg") -> DataFrame:
    """Biased autocorrelations 1..lags per series and the white-noise band."""
    x = panel.select("city", "date", (F.col(column) - F.avg(column).over(Window.partitionBy("city"))).alias("x"))
    x = x.select("city", "x", *[F.lag("x", k).over(by_city()).alias(f"l{k}") for k in range(1, lags + 1)])
    wide = x.groupBy("city").agg(F.count("x").alias("n"), *[F.try_divide(F.sum(F.col("x") * F.col(f"l{k}")), F.sum(F.col("x") * F.col("x"))).alias(str(k)) for k in range(1, lags + 1)])
    return wide.unpivot(["city", "n"], [str(k) for k in range(1, lags + 1)], "lag", "acf").select("city", F.col("lag").cast("long").alias("lag"), "acf", (1.96 / F.sqrt("n")).alias("band"))


def year_over_year(panel: DataFrame, column: str = "temp_avg") -> DataFrame:
    """Correlation of a series' first two years by day of the year."""
    first = Window.partitionBy("city")
    d = panel.select("city", (F.year("date") - F.min(F.year("date")).over(first)).alias("y"), F.dayofyear("date").alias("doy"), column).where("y < 2")
    by = d.groupBy("city", "doy").agg(F.avg(F.when(F.col("y") == 0, F.col(column))).alias("a"), F.avg(F.when(F.col("y") == 1, F.col(column))).alias("b"))
    return by.where("a is not null and b is not null").groupBy("city").agg(F.count("*").alias("n"), safe_corr(F.col("a"), F.col("b")).alias("yoy_corr"))


def predictability(panel: DataFrame, column: str = "temp_avg") -> DataFrame:
    """In-sample share explained by day of year, lag-1 share, and their capped sum."""
    y = F.col(column)
    d = panel.select("city", "date", y.alias("y"), F.avg(y).over(Window.partitionBy("city", F.dayofyear("date"))).alias("m"), F.lag(y, 1).over(by_city()).alias("l"))
    out = d.groupBy("city").agg((1 - F.try_divide(F.avg((F.col("y") - F.col("m")) ** 2), F.var_samp("y"))).alias("seasonal_r2"), safe_corr(F.col("y"), F.col("l")).alias("r1"))
    return out.select("city", "seasonal_r2", (F.col("r1") ** 2).alias("lag1_r2"), F.least(F.lit(1.0), F.col("seasonal_r2") + F.col("r1") ** 2).alias("ceiling"))


def lag_of(name: str) -> int | None:
    """The lag that a feature's name ends with, if it names one."""
    found = re.search(r"(?:^|_)lag(\d+)$", name)
    return int(found[1]) if found else None


def calendar_terms(panel: DataFrame, order: int = 2, include=CALENDAR, date: str = "date", origin=None) -> DataFrame:
    """Calendar columns (``include`` names which) and Fourier terms of ``date``.

    ``time_idx`` counts days from ``origin``, the panel's first date if none is
    given. An unknown name raises ValueError.
    """
    unknown = [c for c in include if c not in CALENDAR]
    if unknown:
        raise ValueError(f"unknown calendar features: {', '.join(unknown)}")
    day = F.col(date)
    if "time_idx" in include and origin is None:
        panel = panel.crossJoin(F.broadcast(panel.agg(F.min(date).alias("_first"))))  # one row
        origin = F.col("_first")
    since = F.lit(None) if origin is None else F.datediff(day, origin if isinstance(origin, Column) else F.lit(origin))
    terms = {"month": F.month(day), "imd_season": season_id(F.month(day)), "doy": F.dayofyear(day), "weekday": F.weekday(day), "time_idx": since}
    frac = F.dayofyear(day) / F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    waves = {f"{n}{k}": f(2 * pi * k * frac) for k in range(1, order + 1) for n, f in (("sin", F.sin), ("cos", F.cos))}
    return panel.withColumns({c: terms[c] for c in include} | waves).drop("_first")


def climatology(panel: DataFrame, window: int = 15, column: str = "temp_avg") -> DataFrame:
    """Smoothed mean by series and day of year 1..366, circular in both steps."""
    return smoothed_year(panel.groupBy("city", F.dayofyear("date").alias("doy")).agg(F.avg(column).alias("m")), window)


def smoothed_year(mean: DataFrame, window: int = 15) -> DataFrame:
    """``(city, doy, clim)`` from ``mean(city, doy, m)``: gaps filled along the circle, then a running mean."""
    grid = mean.select("city").distinct().select("city", F.explode(F.sequence(F.lit(1), F.lit(366))).alias("doy"))
    three = grid.join(mean, ["city", "doy"], "left").select("city", "doy", "m", F.explode(F.array(*map(F.lit, (-366, 0, 366)))).alias("turn"))
    t = three.withColumn("t", F.col("doy") + F.col("turn"))
    by = Window.partitionBy("city").orderBy("t")
    back, ahead = by, Window.partitionBy("city").orderBy(F.desc("t"))  # both frames grow
    at = F.when(F.col("m").isNotNull(), F.col("t"))
    v0, v1, t0, t1 = F.last("m", True).over(back), F.last("m", True).over(ahead), F.last(at, True).over(back), F.last(at, True).over(ahead)
    line = F.coalesce("m", v0 + (v1 - v0) * F.try_divide((F.col("t") - t0).cast("double"), (t1 - t0).cast("double")), v0, v1)
    half = window // 2
    smooth = t.withColumn("line", line).withColumn("clim", F.avg("line").over(by.rowsBetween(-half, half)))
    return smooth.where("turn = 0").select("city", "doy", "clim")


def history_columns(column: str = "temp_avg", lags=LAGS, windows=WINDOWS) -> dict[str, Column]:
    """Lags, trailing statistics and differences known at each origin."""
    y = F.col(column)
    out = {f"lag{k}": F.lag(y, k - 1).over(by_city()) for k in lags}
    for w in windows:
        over = by_city().rowsBetween(1 - w, 0)
        enough = F.count(y).over(over) >= max(2, w // 3)
        for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            out[f"r{name}{w}"] = F.when(enough, f(y).over(over))
    out |= {f"diff{k}": y - F.lag(y, k).over(by_city()) for k in (1, 7)}
    w7, w28 = by_city().rowsBetween(-6, 0), by_city().rowsBetween(-27, 0)
    out["trend7"] = F.when(F.count(y).over(w7) >= 3, F.avg(y).over(w7)) - F.when(F.count(y).over(w28) >= 7, F.avg(y).over(w28))
    return out


def _with(panel: DataFrame, columns: dict[str, Column], *keep: str) -> DataFrame:
    """The columns over series in date order: one shuffle, one sort, however many there are."""
    return panel.select("city", "date", *keep, *[c.alias(n) for n, c in columns.items()])


def history(panel: DataFrame, column: str = "temp_avg", lags=LAGS, windows=WINDOWS) -> DataFrame:
    return _with(panel, history_columns(column, lags, windows), column)


def _decayed(rate: float):
    return lambda acc, x: F.coalesce(acc + (x - acc) * rate, x)


def smoothed_columns(spans=(7, 30), column: str = "temp_avg") -> dict[str, Column]:
    """Exponential moving averages with decay 2 / (span + 1), started at the first value.

    A fold over so many of the last values that older ones weigh less than
    rounding, so the work is linear in the rows. Nulls are skipped.
    """
    out = {}
    for s in spans:
        rate = 2.0 / (s + 1)
        rows = int(36.8 / -log1p(-rate)) + 1
        last = F.collect_list(F.col(column).cast("double")).over(by_city().rowsBetween(1 - rows, 0))
        out[f"ewm{s}"] = F.aggregate(last, F.lit(None).cast("double"), _decayed(rate))
    return out


def smoothed(panel: DataFrame, spans=(7, 30), column: str = "temp_avg") -> DataFrame:
    return _with(panel, smoothed_columns(spans, column))


def all_history(panel: DataFrame, column: str = "temp_avg", channels=()) -> DataFrame:
    """Every feature known at an origin, in one pass: lags, trailing statistics, smoothed means and those of the other channels."""
    channels = [c for c in channels if c != column and c in panel.columns]
    others = channel_columns(channels, {"temp_max", "temp_min"} <= set(panel.columns)) if channels else {}
    return _with(panel, history_columns(column) | smoothed_columns(column=column) | others, column)


def supervised(panel: DataFrame, horizon: int = 14, column: str = "temp_avg", channels=(), complete: bool = True, known: bool = True) -> DataFrame:
    """``(city, origin, horizon, target_date, features, target)``: history at the origin, calendar of the target date.

    Rows without a target go unless ``known`` is off, and with ``complete``
    those without all lags up to SHORT. The panel must lie on a gap-free calendar.
    """
    h = all_history(panel, column, channels)
    ahead = F.array(*[F.struct(F.lit(k).alias("horizon"), F.lead(column, k).over(by_city()).alias("target")) for k in range(1, horizon + 1)])
    rows = h.withColumn("ahead", ahead)
    if complete:
        rows = rows.where(" and ".join(f"lag{k} is not null" for k in LAGS if k <= SHORT))
    rows = rows.withColumn("a", F.explode("ahead")).drop("ahead")
    rows = rows.where("a.target is not null") if known else rows
    names = [c for c in h.columns if c not in ("city", "date", column)]
    rows = rows.select("city", F.col("date").alias("origin"), "a.horizon", F.date_add("date", F.col("a.horizon")).alias("target_date"), *names, "a.target")
    first = panel.agg(F.min("date").alias("_day0"))
    rows = rows.crossJoin(F.broadcast(first))  # one row
    return calendar_terms(rows, date="target_date", origin=F.col("_day0")).drop("_day0")


KEYS = ("city", "origin", "horizon", "target_date", "target")


def feature_names(rows: DataFrame) -> list[str]:
    """The features of supervised rows."""
    return [c for c in rows.columns if c not in KEYS]


def for_horizon(rows: DataFrame, horizon: int) -> DataFrame:
    return rows.where(F.col("horizon") == horizon)


def channel_columns(columns, span: bool, lags=(1, 7, 14)) -> dict[str, Column]:
    """Lags and weekly means of covariates known at each origin, and the daily range where both temperatures are there."""
    over = by_city().rowsBetween(-6, 0)
    weekly = lambda c: F.when(F.count(c).over(over) >= 3, F.avg(c).over(over))
    out = {f"{c}_lag{k}": F.lag(F.col(c).cast("double"), k - 1).over(by_city()) for c in columns for k in lags}
    out |= {f"{c}_rmean7": weekly(F.col(c).cast("double")) for c in columns}
    if span:
        daily = F.col("temp_max") - F.col("temp_min")
        out |= {"diurnal_range": daily, "diurnal_range_rmean7": weekly(daily)}
    return out


def channel_history(panel: DataFrame, columns, lags=(1, 7, 14)) -> DataFrame:
    return _with(panel, channel_columns(columns, {"temp_max", "temp_min"} <= set(panel.columns), lags))


def climatology_at(rows: DataFrame, clim: DataFrame, panel: DataFrame, date: str = "date", column: str = "temp_avg") -> DataFrame:
    """``rows`` with the climatology of their day; unknown series and days take the panel's mean."""
    overall = panel.agg(F.avg(column).alias("overall"))
    joined = rows.withColumn("doy", F.dayofyear(date)).join(clim, ["city", "doy"], "left").crossJoin(F.broadcast(overall))  # one row
    return joined.withColumn("clim", F.coalesce("clim", "overall")).drop("doy", "overall")


def encodings(supervised_rows: DataFrame, clim: DataFrame, panel: DataFrame) -> DataFrame:
    """Code of the series by name, climatology at the target date and the last anomaly against it."""
    names = supervised_rows.select("city").distinct()
    codes = names.withColumn("city_code", (F.row_number().over(Window.orderBy("city")) - 1).cast("long"))  # one row a series
    rows = climatology_at(supervised_rows, clim, panel, "target_date").join(codes, "city")
    return rows.withColumnRenamed("clim", "target_clim").withColumn("anomaly_lag1", F.col("lag1") - F.col("target_clim"))
