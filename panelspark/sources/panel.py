"""Reading, checking and completing panels of daily series."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.quantiles import with_quantiles

# Headers of the raw files and the columns they become.
HEADERS = {
    "Date": "date", "City": "city", "State": "state", "Temperature_Max (°C)": "temp_max", "Temperature_Min (°C)": "temp_min",
    "Temperature_Avg (°C)": "temp_avg", "Humidity (%)": "humidity", "Rainfall (mm)": "rainfall", "Wind_Speed (km/h)": "wind_speed",
    "AQI": "aqi", "AQI_Category": "aqi_category", "Pressure (hPa)": "pressure", "Cloud_Cover (%)": "cloud_cover",
}
CHANNELS = ("temp_avg", "temp_max", "temp_min", "humidity", "rainfall", "wind_speed", "aqi", "pressure", "cloud_cover")


class DataValidationError(ValueError):
    """The panel breaks a rule that every operator relies on."""


def read_csv(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Panel of a CSV file with all HEADERS, in order of series and date; further columns pass through.

    A missing path raises FileNotFoundError, a missing header or (with
    ``check``) a broken rule raises DataValidationError.
    """
    try:
        raw = spark.read.csv(path, header=True)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    missing = [h for h in HEADERS if h not in raw.columns]
    if missing:
        raise DataValidationError(f"missing columns: {', '.join(missing)}")
    out = raw.withColumnsRenamed(HEADERS).withColumn("date", F.to_date("date"))
    out = out.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in CHANNELS})
    if check:
        validate(out)
    return out.orderBy("city", "date")


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    """The checked panel of a file on its whole calendar."""
    return fill_calendar(read_csv(spark, path))


def cities(panel: DataFrame) -> DataFrame:
    return panel.select("city").distinct().orderBy("city")


def date_range(panel: DataFrame) -> DataFrame:
    return panel.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def violations(panel: DataFrame) -> DataFrame:
    """One row: duplicate keys, temperatures out of [-40, 60], minima over maxima."""
    dup = panel.groupBy("city", "date").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    rest = panel.agg(
        F.count_if((F.col("temp_avg") < -40) | (F.col("temp_avg") > 60)).alias("out_of_range"),
        F.count_if(F.col("temp_min") > F.col("temp_max")).alias("min_over_max"),
    )
    return dup.crossJoin(rest)  # one row each


def validate(panel: DataFrame) -> None:
    """Raises DataValidationError on violations; missing days only warn."""
    for name, n in violations(panel).first().asDict().items():
        if n:
            raise DataValidationError(f"{name}: {n}")
    missing = gaps(panel).agg(F.sum("missing_days"), F.count_if(F.col("missing_days") > 0)).first()
    if missing[0]:
        warnings.warn(f"{missing[0]} missing days in {missing[1]} series", stacklevel=2)


def gaps(panel: DataFrame) -> DataFrame:
    """Missing days of each series within its own first and last date."""
    return panel.groupBy("city").agg(
        (F.datediff(F.max("date"), F.min("date")) + 1 - F.count_distinct("date")).cast("long").alias("missing_days")
    )


def fill_calendar(panel: DataFrame, columns=None, per_city: bool = False) -> DataFrame:
    """Every series on the daily grid of the whole panel, or of its own days.

    CHANNELS are interpolated by time inside a series and carried to its ends;
    other columns are carried forward, then backward. ``columns`` limits which
    are kept. One shuffle by series; the way back is a growing frame over the
    reversed order, so both directions are linear.
    """
    columns = [c for c in panel.columns if c not in ("city", "date")] if columns is None else list(columns)
    if per_city:
        grid = panel.groupBy("city").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    else:
        grid = panel.select("city").distinct().crossJoin(panel.agg(F.min("date").alias("lo"), F.max("date").alias("hi")))  # one row
    grid = grid.select("city", F.explode(F.sequence("lo", "hi")).alias("date"))
    full = grid.join(panel.select("city", "date", *columns), ["city", "date"], "left")
    series = Window.partitionBy("city")
    back, ahead = series.orderBy("date"), series.orderBy(F.desc("date"))
    known = lambda c: F.struct(F.col(c).alias("v"), F.col("date").alias("d"))
    near = {}
    for c in columns:
        seen = F.when(F.col(c).isNotNull(), known(c))
        near[f"_{c}_0"], near[f"_{c}_1"] = F.last(seen, True).over(back), F.last(seen, True).over(ahead)
    out = {}
    for c in columns:
        v0, d0, v1, d1 = (F.col(f"_{c}_{i}.{x}") for i in (0, 1) for x in ("v", "d"))
        if c in CHANNELS:
            between = v0 + (v1 - v0) * F.try_divide(F.datediff("date", d0).cast("double"), F.datediff(d1, d0).cast("double"))
            out[c] = F.coalesce(F.col(c).cast("double"), between, v0.cast("double"), v1.cast("double"))
        else:
            out[c] = F.coalesce(v0, v1)
    return full.withColumns(near).withColumns(out).select("city", "date", *columns)


def city_series(panel: DataFrame, city: str) -> DataFrame:
    """One series on its own calendar; KeyError if the panel has no such series."""
    own = panel.where(F.col("city") == city)
    if own.isEmpty():
        raise KeyError(city)
    return fill_calendar(own, per_city=True)


def wide(panel: DataFrame, names, column: str = "temp_avg") -> DataFrame:
    """The filled ``column`` by date, one column for each of the series ``names``."""
    return fill_calendar(panel, [column]).groupBy("date").pivot("city", list(names)).agg(F.first(column))


def summary(panel: DataFrame, column: str = "temp_avg") -> DataFrame:
    stats = panel.groupBy("city").agg(
        F.count("*").alias("n_obs"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"),
        F.max(column).alias("max"), (F.max(column) - F.min(column)).alias("range"),
    )
    out = with_quantiles(stats, panel, ["city"], column, {"p05": 0.05, "median": 0.5, "p95": 0.95})
    return out.select("city", "n_obs", "mean", "std", "min", "p05", "median", "p95", "max", "range")


def split_by_date(panel: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    return panel.where(F.col("date") <= F.lit(cutoff)), panel.where(F.col("date") > F.lit(cutoff))


def rolling_origins(panel: DataFrame, horizon: int = 14, n: int = 8, stride: int = 14, min_train: int = 400, strict: bool = False) -> DataFrame:
    """Up to ``n`` origins, ``stride`` dates apart, the last with ``horizon`` dates after it.

    The dates are those of the calendar, so one task numbers days, not rows.
    ``strict`` raises ValueError if the dates do not leave a horizon after the
    training rows, or if no origin is left.
    """
    dates = panel.select("date").distinct()
    idx = dates.withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1).withColumn("last", F.count("*").over(Window.partitionBy()) - horizon - 1)
    ok = ((F.col("last") - F.col("idx")) % stride == 0) & (F.col("idx") <= F.col("last")) & (F.col("idx") >= min_train)
    out = idx.where(ok & (F.col("idx") > F.col("last") - n * stride)).select(F.col("date").alias("origin"))
    if strict:
        days = dates.count()
        if days < min_train + horizon:
            raise ValueError(f"{days} dates are fewer than {min_train} for training and {horizon} ahead")
        if out.isEmpty():
            raise ValueError("no origin fits")
    return out
