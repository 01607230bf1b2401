"""Forecast accuracy, interval scores and split-conformal intervals."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: A bound often is one of the residuals: rounding must not put it outside.
EDGE = 1e-9


def point_metrics():
    y, p = F.col("y_true"), F.col("y_pred")
    half = (F.abs(y) + F.abs(p)) / 2
    return [
        F.count("*").alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) ** 2)).alias("rmse"), F.avg(p - y).alias("bias"),
        (100 * F.avg(F.when(F.abs(y) > 1e-8, F.abs((y - p) / y)))).alias("mape"), (100 * F.avg(F.when(half > 1e-8, F.abs(y - p) / half))).alias("smape"),
        (1 - F.try_divide(F.sum((y - p) ** 2), F.var_pop(y) * F.count("*"))).alias("r2"),
    ]


def leaderboard(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model").agg(*point_metrics())


def by_horizon(scored: DataFrame) -> DataFrame:
    e = F.col("y_true") - F.col("y_pred")
    return scored.groupBy("model", "horizon").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e**2)).alias("rmse"), F.count("*").alias("n"))


def mae_by_city(scored: DataFrame, cities) -> DataFrame:
    return scored.groupBy("model").pivot("city", list(cities)).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))))


def conformal_widths(scored: DataFrame, coverage: float = 0.9) -> DataFrame:
    """Half widths by model and horizon: an order statistic of absolute residuals.

    Horizons with too few residuals take the model's ``overall`` width, which
    also stands beside each; without any residual ValueError is raised.
    """
    alpha = 1 - coverage
    gate = max(10, ceil(1 / alpha))
    r = scored.select("model", "horizon", F.abs(F.col("y_true") - F.col("y_pred")).alias("r")).where("r is not null and not isnan(r)")
    if r.isEmpty():
        raise ValueError("no finite residuals to calibrate on")

    def pick(*keys: str) -> DataFrame:
        """The order statistic of each group, by rank: groups are sorted, not gathered."""
        own = Window.partitionBy(*keys)
        n = F.count("*").over(own)
        level = F.least(F.lit(1.0), F.ceil((n + 1) * (1 - alpha)) / n)
        ranked = r.select(*keys, "r", n.alias("n"), F.row_number().over(own.orderBy("r")).alias("i"), (F.ceil(level * (n - 1)) + 1).alias("at"))
        return ranked.where("i = at").select(*keys, "n", "r")

    overall = pick("model").select("model", F.col("r").alias("overall"))
    each = pick("model", "horizon")
    return each.join(overall, "model").select("model", "horizon", "n", F.when(F.col("n") >= gate, F.col("r")).otherwise(F.col("overall")).alias("width"), "overall")


def intervals(forecasts: DataFrame, widths: DataFrame) -> DataFrame:
    """Forecasts with bounds; a horizon that was not calibrated takes its model's overall width, a model without widths has null bounds."""
    overall = widths.groupBy("model").agg(F.max("overall").alias("overall"))  # equal in all rows of a model
    joined = forecasts.join(widths.select("model", "horizon", "width"), ["model", "horizon"], "left").join(overall, "model", "left")
    joined = joined.withColumn("width", F.coalesce("width", "overall")).drop("overall")
    return joined.withColumns({"lower": F.col("y_pred") - F.col("width"), "upper": F.col("y_pred") + F.col("width")})


def interval_metrics(scored: DataFrame, alpha: float = 0.1, by=("model",)) -> DataFrame:
    """Coverage, mean width and interval score by ``by``; with horizon, the coverage by horizon."""
    y, lo, hi = F.col("y_true"), F.col("lower"), F.col("upper")
    miss = F.greatest(lo - y, F.lit(0.0)) + F.greatest(y - hi, F.lit(0.0))
    return scored.groupBy(*by).agg(F.avg(y.between(lo - EDGE, hi + EDGE).cast("double")).alias("coverage"), F.avg(hi - lo).alias("mean_width"), F.avg(hi - lo + miss * (2 / alpha)).alias("interval_score"))


def compare_boards(a: DataFrame, b: DataFrame) -> DataFrame:
    """Errors of the models of two leaderboards side by side, and their ratio."""
    left, right = a.select("model", F.col("mae").alias("mae_a")), b.select("model", F.col("mae").alias("mae_b"))
    return left.join(right, "model", "full").withColumn("ratio", F.try_divide("mae_a", "mae_b"))


def models(scored: DataFrame) -> DataFrame:
    return scored.select("model").distinct().orderBy("model")


def for_model(scored: DataFrame, model: str) -> DataFrame:
    return scored.where(F.col("model") == model)
