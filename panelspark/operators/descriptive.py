"""Descriptive statistics of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.lineage import written
from panelspark.functions.quantiles import average_ranks, with_quantiles
from panelspark.functions.stats import MONTHS, SEASONS, month_name, safe_corr, season

# Upper bounds of the air-quality classes, in order.
AQI_CLASSES = (("Good", 50), ("Satisfactory", 100), ("Moderate", 200), ("Poor", 300), ("Very Poor", 400), ("Severe", None))


def add_calendar(panel: DataFrame) -> DataFrame:
    m = F.month("date")
    return panel.withColumns({"year": F.year("date"), "month": m, "month_name": month_name(m), "season": season(m)})


def dataset_profile(panel: DataFrame) -> DataFrame:
    row = panel.agg(
        F.count("*").alias("rows"), F.count_distinct("city").alias("cities"), F.count_distinct("state").alias("states"),
        F.count_distinct("city", "date").alias("keys"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("days"),
        sum(F.count_if(F.col(c).isNull()) for c in panel.columns).alias("missing_cells"),
    )
    expected = F.col("cities") * F.col("days")
    return row.select("rows", "cities", "states", F.col("days").cast("long").alias("days"), expected.cast("long").alias("expected_rows"),
                      (100 * F.col("rows") / expected).alias("completeness_pct"), (F.col("rows") - F.col("keys")).alias("duplicate_rows"), "missing_cells")


def numeric_columns(panel: DataFrame, columns) -> list[str]:
    """Which of ``columns`` the panel has."""
    return [c for c in columns if c in panel.columns]


def column_inventory(panel: DataFrame, columns=None) -> DataFrame:
    """Type, missing and distinct values of every column, and the range of numeric ones."""
    kinds = {c: t for c, t in panel.dtypes if columns is None or c in columns}
    number = lambda c: F.col(c).cast("double") if kinds[c] in ("double", "float", "int", "bigint") else F.lit(None).cast("double")
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("dtype"), F.col(c).cast("string").alias("s"), number(c).alias("v")) for c, t in kinds.items()])
    long = panel.select(F.explode(each).alias("e")).select("e.*")
    missing = F.count_if(F.col("s").isNull())
    return long.groupBy("column_name", "dtype").agg(
        missing.alias("n_missing"), (100 * missing / F.count("*")).alias("pct_missing"), F.count_distinct("s").alias("n_unique"), F.min("v").alias("min"), F.max("v").alias("max")
    )


def numeric_summary(panel: DataFrame, columns) -> DataFrame:
    long = panel.select(*[F.col(c).cast("double") for c in columns]).unpivot([], list(columns), "column_name", "v").where("v is not null")
    stats = long.groupBy("column_name").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"),
        (100 * F.try_divide(F.stddev_samp("v"), F.avg("v"))).alias("cv_pct"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurtosis"),
    )
    out = with_quantiles(stats, long, ["column_name"], "v", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return out.select("column_name", "n", "mean", "std", "min", "q25", "median", "q75", "max", (F.col("q75") - F.col("q25")).alias("iqr"), "cv_pct", "skew", "kurtosis")


def city_profile(panel: DataFrame, column: str = "temp_avg") -> DataFrame:
    """Two grouped steps: sums by month carry all that the series level needs."""
    m = panel.groupBy("city", F.month("date").alias("month")).agg(
        F.avg(column).alias("m"), F.max("state").alias("state"), F.count(column).alias("n"), F.sum(column).alias("s"), F.min(column).alias("lo"),
        F.max(column).alias("hi"), F.var_pop(column).alias("v"), F.sum(F.col("temp_max") - F.col("temp_min")).alias("dr"), F.count(F.col("temp_max") - F.col("temp_min")).alias("dn"),
    )
    m = m.withColumn("mean", F.sum("s").over(Window.partitionBy("city")) / F.sum("n").over(Window.partitionBy("city")))
    spread = F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("mean")) ** 2))
    return m.groupBy("city", "mean").agg(
        F.max("state").alias("state"), F.sqrt(F.try_divide(spread, F.sum("n") - 1)).alias("std"), F.min("lo").alias("min"), F.max("hi").alias("max"), (F.max("hi") - F.min("lo")).alias("range"),
        (F.max("m") - F.min("m")).alias("seasonal_amplitude"),
        F.max_by("month", F.struct("m", -F.col("month"))).cast("long").alias("hottest_month"),
        F.min_by("month", F.struct("m", F.col("month"))).cast("long").alias("coldest_month"), F.try_divide(F.sum("dr"), F.sum("dn")).alias("diurnal_range"),
    )


def rank_cities(table: DataFrame, metric: str, top: int) -> DataFrame:
    if metric not in table.columns:
        raise KeyError(metric)
    best = table.orderBy(F.desc(metric), "city").limit(top)
    return best.select("city", metric, F.row_number().over(Window.orderBy(F.desc(metric), "city")).cast("long").alias("rank"))


def period_profile(panel: DataFrame, period, column: str = "temp_avg", city: str | None = None) -> DataFrame:
    """Statistics by month or season and the deviation from the overall mean, of all series or of one."""
    if city is not None:
        panel = panel.where(F.col("city") == city)
    rows = panel.select(period.alias("period"), F.col(column).cast("double").alias("v"))
    by = rows.groupBy("period").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    by = with_quantiles(by, rows, ["period"], "v", {"median": 0.5}).select("period", "n", "mean", "std", "min", "median", "max")
    every = Window.partitionBy()  # at most twelve rows
    overall = F.sum(F.col("mean") * F.col("n")).over(every) / F.sum("n").over(every)
    return by.withColumn("deviation", F.col("mean") - overall)


def city_month_matrix(panel: DataFrame, column: str = "temp_avg") -> DataFrame:
    return panel.withColumn("m", month_name(F.month("date"))).groupBy("city").pivot("m", list(MONTHS)).agg(F.avg(column))


def eta_squared(panel: DataFrame, column: str = "temp_avg") -> DataFrame:
    """Share of each series' variance that the calendar month explains."""
    by = panel.groupBy("city", F.month("date").alias("month")).agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.var_pop(column).alias("v"))
    every = Window.partitionBy("city")
    mean = F.sum(F.col("n") * F.col("m")).over(every) / F.sum("n").over(every)
    parts = by.withColumn("mean", mean).groupBy("city").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), (F.max("m") - F.min("m")).alias("monthly_range")
    )
    return parts.select("city", "monthly_range", F.try_divide("between", F.col("between") + F.col("within")).alias("eta_squared"),
                        (100 * F.try_divide("between", F.col("between") + F.col("within"))).alias("pct_of_variance"))


def extreme_days(panel: DataFrame, hot: float = 35, cold: float = 15) -> DataFrame:
    is_hot, is_cold = F.coalesce("temp_max", "temp_avg") >= hot, F.coalesce("temp_min", "temp_avg") <= cold
    return panel.groupBy("city").agg(
        F.count_if(is_hot).alias("hot_days"), (100 * F.count_if(is_hot) / F.count("*")).alias("hot_pct"),
        F.count_if(is_cold).alias("cold_days"), (100 * F.count_if(is_cold) / F.count("*")).alias("cold_pct"),
    )


def heat_spells(panel: DataFrame, hot: float = 35) -> DataFrame:
    """Longest run of hot rows against the run that independent days would give."""
    flag = F.coalesce(F.coalesce("temp_max", "temp_avg") >= hot, F.lit(False))
    by = Window.partitionBy("city").orderBy("date")
    rows = panel.select("city", "date", flag.alias("f")).withColumn("at", F.row_number().over(by)).withColumn("nth", F.sum(F.col("f").cast("int")).over(by))
    runs = rows.groupBy("city", (F.col("at") - F.col("nth")).alias("island")).agg(F.count_if("f").alias("run"), F.count("*").alias("n"))
    out = runs.groupBy("city").agg(F.sum("run").alias("hot_days"), F.max("run").alias("longest_run"), F.sum("n").alias("n"))
    p = F.col("hot_days") / F.col("n")
    expected = F.when((p > 0) & (p < 1), F.try_divide(F.log(F.col("n") * (1 - p)), -F.log(p))).otherwise(0.0)
    return out.select("city", "hot_days", "longest_run", expected.alias("expected_run"), F.try_divide("longest_run", expected).alias("clustering"))


def diurnal_profile(panel: DataFrame) -> DataFrame:
    d = panel.select("city", (F.col("temp_max") - F.col("temp_min")).alias("d"), "cloud_cover", season(F.month("date")).alias("season"))
    by_season = [F.avg(F.when(F.col("season") == s, F.col("d"))).alias(s.lower().replace("-", "_")) for s in SEASONS]
    return d.groupBy("city").agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"), F.min("d").alias("min"), F.max("d").alias("max"), *by_season, safe_corr(F.col("d"), F.col("cloud_cover")).alias("corr_cloud"))


def channel_correlation(panel: DataFrame, columns, method: str = "pearson") -> DataFrame:
    """Pairwise-complete correlations of all channel pairs in one aggregate, then one row per pair.

    ``spearman`` correlates average ranks over the rows that have both
    channels; ranks come from counts by value over ranges of each pair's values.
    Rows meet their ranks by value, so the channels are written once: computed
    anew, sums merged in another order end in other bits and lose their ranks.
    """
    cols = list(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if method == "pearson":
        wide = panel.agg(*[safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
        return wide.unpivot([], wide.columns, "pair", "r").select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")
    if method != "spearman":
        raise ValueError(f"unknown method {method}")
    fixed = written(panel.select(*[F.col(c).cast("double").alias(c) for c in cols]), "channels")
    long = fixed.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])).alias("p")).select("p.*")
    long = long.where("x is not null and y is not null")

    ranked = long
    for c in ("x", "y"):
        ranked = ranked.join(average_ranks(long, ["a", "b"], c, f"rank_{c}"), ["a", "b", c])
    return ranked.groupBy("a", "b").agg(safe_corr(F.col("rank_x"), F.col("rank_y")).alias("r"))


def cross_city_correlation(panel: DataFrame, column: str = "temp_avg") -> DataFrame:
    a = panel.select("date", F.col("city").alias("city_a"), F.col(column).alias("x"))
    b = panel.select("date", F.col("city").alias("city_b"), F.col(column).alias("y"))
    return a.join(b, (a["date"] == b["date"]) & (F.col("city_a") < F.col("city_b"))).groupBy("city_a", "city_b").agg(safe_corr(F.col("x"), F.col("y")).alias("r"))


def aqi_class(aqi):
    out = F.when(aqi.isNull(), None)
    for name, top in AQI_CLASSES:
        out = out.otherwise(name) if top is None else out.when(aqi <= top, name)
    return out


def aqi_burden(panel: DataFrame) -> DataFrame:
    c = panel.select("city", aqi_class(F.col("aqi")).alias("k"))
    return c.groupBy("city").agg(*[(100 * F.try_divide(F.count_if(F.col("k") == n), F.count("k"))).alias(n.lower().replace(" ", "_")) for n, _ in AQI_CLASSES])


def aqi_seasonality(panel: DataFrame) -> DataFrame:
    s = panel.select("city", season(F.month("date")).alias("s"), "aqi")
    avg = lambda n: F.round(F.avg(F.when(F.col("s") == n, F.col("aqi"))), 1)
    out = s.groupBy("city").agg(*[avg(n).alias(n.lower().replace("-", "_")) for n in SEASONS])
    return out.withColumn("winter_minus_monsoon", F.round(F.col("winter") - F.col("monsoon"), 1))
