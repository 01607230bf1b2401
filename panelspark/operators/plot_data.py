"""The data behind the usual plots, and comparisons of two forecasters."""

from __future__ import annotations

from math import pi
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.ordering import lagged, numbered
from panelspark.functions.quantiles import quantiles
from panelspark.functions.special import t_tail
from panelspark.functions.stats import safe_corr


def histogram(panel: DataFrame, bins: int = 10, column: str = "temp_avg") -> DataFrame:
    """Counts and density per series over equal bins of the series' own range."""
    own = Window.partitionBy("city")
    x = panel.where(F.col(column).isNotNull()).select("city", F.col(column).alias("x"), F.min(column).over(own).alias("lo"), F.max(column).over(own).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), width)), F.lit(bins - 1)), F.lit(0)).cast("long")
    out = x.groupBy("city", at.alias("bin")).agg(F.count("*").alias("n"), F.max(width).alias("width"))
    return out.select("city", "bin", "n", F.try_divide(F.col("n").cast("double"), F.sum("n").over(own) * F.col("width")).alias("density"))


def monthly_boxes(panel: DataFrame, column: str = "temp_avg") -> DataFrame:
    """Quartiles, whiskers (the last value within 1.5 quartile ranges) and the number of outliers, by series and month."""
    own = ["city", "month"]
    rows = panel.where(F.col(column).isNotNull()).select("city", F.month("date").alias("month"), F.col(column).alias("v"))
    box = quantiles(rows, own, "v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col("v").between(F.col("q25") - reach, F.col("q75") + reach)
    return rows.join(box, own).groupBy(*own, "q25", "median", "q75").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.count_if(~inside).alias("outliers")
    )


def density_curves(panel: DataFrame, points: int = 25, column: str = "temp_avg") -> DataFrame:
    """The normal and the uniform density of each series' moments and range, at equal steps over its range."""
    s = panel.groupBy("city").agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("sd"), F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    normal = F.exp(-0.5 * ((F.col("x") - F.col("m")) / F.col("sd")) ** 2) / (F.col("sd") * (2 * pi) ** 0.5)
    return at.select("city", F.col("i").cast("long").alias("i"), "x", F.when(F.col("sd") > 0, normal).alias("normal"), F.try_divide(F.lit(1.0), F.col("hi") - F.col("lo")).alias("uniform"))


def residual_diagnostics(scored: DataFrame, bins: int = 45, lags: int = 40, quantiles: int = 19) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of each model's residuals: a histogram, quantiles beside those of a normal, and autocorrelations within series."""
    r = scored.select("model", "city", "origin", "horizon", (F.col("y_true") - F.col("y_pred")).alias("r"))
    as_panel = r.select(F.col("model").alias("city"), "r")
    hist = histogram(as_panel, bins, "r").withColumnRenamed("city", "model")
    share = [(i + 1) / (quantiles + 1) for i in range(quantiles)]
    q = r.groupBy("model").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.percentile("r", F.array(*map(F.lit, share))).alias("q"))
    normal = F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in share])
    pairs = q.select("model", "m", "sd", F.posexplode(F.arrays_zip(normal.alias("z"), F.col("q"))).alias("i", "pair"))
    qq = pairs.select("model", F.col("i").cast("long").alias("i"), (F.col("m") + F.col("sd") * F.col("pair.z")).alias("expected"), F.col("pair.q").alias("observed"))
    by = Window.partitionBy("model", "city").orderBy("origin", "horizon")
    c = r.withColumn("x", F.col("r") - F.avg("r").over(Window.partitionBy("model", "city")))
    c = c.select("model", "x", *[F.lag("x", k).over(by).alias(f"l{k}") for k in range(1, lags + 1)])
    names = [str(k) for k in range(1, lags + 1)]
    acf = c.groupBy("model").agg(F.count("x").alias("n"), *[F.try_divide(F.sum(F.col("x") * F.col(f"l{k}")), F.sum(F.col("x") * F.col("x"))).alias(k) for k in names])
    acf = acf.unpivot(["model", "n"], names, "lag", "acf").select("model", F.col("lag").cast("long").alias("lag"), "acf", (1.96 / F.sqrt("n")).alias("band"))
    return hist, qq, acf


def ecdf(panel: DataFrame, column: str = "temp_avg") -> DataFrame:
    """Share of rows up to each row in order of value and date; ties keep their own steps."""
    own = Window.partitionBy("city")
    rank = F.row_number().over(own.orderBy(column, "date"))
    return panel.where(F.col(column).isNotNull()).select("city", "date", column, (rank / F.count("*").over(own)).alias("share"))


def scatter_fit(panel: DataFrame, x: str, y: str) -> DataFrame:
    return panel.groupBy("city").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), safe_corr(F.col(x), F.col(y)).alias("r"), F.count("*").alias("n"))


def city_overview(panel: DataFrame, column: str = "temp_avg") -> DataFrame:
    return panel.groupBy("date").agg(F.avg(column).alias("mean"), F.count(column).alias("n"))


def pivot_predictions(scored: DataFrame, models) -> DataFrame:
    """One column per model beside the truth."""
    return scored.groupBy("city", "origin", "target_date", "horizon", "y_true").pivot("model", list(models)).agg(F.avg("y_pred"))


def diebold_mariano(scored: DataFrame, a: str, b: str, h: int = 1, loss: str = "mae", by_series: bool = False) -> DataFrame:
    """Statistic and p-value of equal accuracy, with the small-sample factor; negative favours ``a``.

    Losses (``mae`` or ``mse``) are compared over all rows in the order of
    series, origin and horizon, or with ``by_series`` within each series, so
    that no lag crosses one. Fewer than ten pairs give null.
    """
    if loss not in ("mae", "mse"):
        raise ValueError("loss must be 'mae' or 'mse'")
    wide = pivot_predictions(scored, (a, b)).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    of = lambda m: F.abs(F.col("y_true") - F.col(m)) if loss == "mae" else (F.col("y_true") - F.col(m)) ** 2
    d = wide.select("city", "origin", "horizon", (of(a) - of(b)).alias("d"))
    if by_series:
        own = Window.partitionBy("city")
        by = own.orderBy("origin", "horizon")
        c = d.withColumn("m", F.avg("d").over(own)).withColumn("c", F.col("d") - F.col("m"))
        c = c.select("city", "m", "c", *[F.lag("c", k).over(by).alias(f"l{k}") for k in range(1, h)])
    else:
        mean = d.agg(F.avg("d").alias("m"))
        c = numbered(d, "city", "origin", "horizon").crossJoin(F.broadcast(mean)).withColumn("c", F.col("d") - F.col("m"))  # one row
        c = lagged(c, "c", range(1, h))
    long_run = F.avg(F.col("c") ** 2) + sum((2 * (1 - k / h) * F.avg(F.col("c") * F.col(f"l{k}")) for k in range(1, h)), F.lit(0.0))
    out = c.groupBy(*["city"][: int(by_series)]).agg(F.count("*").alias("n"), F.avg("m").alias("mean_loss_diff"), F.greatest(long_run, F.lit(1e-12)).alias("lrv"))
    n = F.col("n")
    factor = F.sqrt(F.greatest((n + 1 - 2 * h + h * (h - 1) / n) / n, F.lit(0.0)))
    stat = F.when(n >= 10, factor * F.col("mean_loss_diff") / F.sqrt(F.col("lrv") / n))
    out = out.withColumn("dm", stat).drop("lrv")
    return out.withColumn("p_value", t_tail(F.abs("dm"), n.cast("double") - 1))


def mase(panel: DataFrame, scored: DataFrame, seasonality: int = 7, column: str = "temp_avg", by_series: bool = False) -> DataFrame:
    """MAE by model over the in-sample seasonal naive error, of all rows one after another or with ``by_series`` within series.

    Null where the scale is null or next to zero.
    """
    if by_series:
        before = panel.withColumn("_l", F.lag(column, seasonality).over(Window.partitionBy("city").orderBy("date")))
    else:
        before = lagged(numbered(panel.select("city", "date", column), "city", "date"), column, [seasonality]).withColumnRenamed(f"l{seasonality}", "_l")
    scale = before.agg(F.avg(F.abs(F.col(column) - F.col("_l"))).alias("scale"))
    mae = scored.groupBy("model").agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))
    return mae.crossJoin(F.broadcast(scale)).select("model", F.when(F.col("scale") > 1e-12, F.col("mae") / F.col("scale")).alias("mase"))  # one row


def calendar_grid(panel: DataFrame, years, column: str = "temp_avg") -> DataFrame:
    """Day of the year against the given years."""
    days = panel.select(F.dayofyear("date").alias("doy"), F.year("date").alias("year"), column)
    return days.groupBy("doy").pivot("year", list(years)).agg(F.avg(column))


def forecast_example(panel: DataFrame, scored: DataFrame, city: str, rows: int = 90, column: str = "temp_avg") -> DataFrame:
    """One series' last ``rows`` days before its last origin, then forecasts of every model beside the truth, with their band if they have one."""
    own = scored.where(F.col("city") == city)
    last = own.agg(F.max("origin").alias("origin"))
    past = panel.where(F.col("city") == city).join(F.broadcast(last), F.col("date").between(F.date_sub("origin", rows - 1), F.col("origin")))  # one row
    none = F.lit(None).cast("double")
    band = [F.col(c) if c in scored.columns else none.alias(c) for c in ("lower", "upper")]
    ahead = own.join(F.broadcast(last), "origin").select(F.col("target_date").alias("date"), "model", "y_true", "y_pred", *band)
    before = past.select("date", F.lit("history").alias("model"), F.col(column).alias("y_true"), *[none.alias(c) for c in ("y_pred", "lower", "upper")])
    return before.unionByName(ahead)
