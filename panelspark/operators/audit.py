"""Tests with p-values, and the verdict whether a panel can be forecast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.lineage import written
from panelspark.functions.quantiles import average_ranks
from panelspark.functions.special import chi2_tail, f_tail, ks_tail, normal_test, t_tail
from panelspark.functions.stats import safe_corr
from panelspark.operators.descriptive import cross_city_correlation, eta_squared
from panelspark.operators.features import autocorrelation, predictability, year_over_year

# Annual mean and annual range of reference places, in degrees.
REFERENCE_CLIMATE = (
    ("Mumbai", 27.5, 6.0), ("Delhi", 25.0, 20.0), ("Bengaluru", 24.0, 6.0), ("Chennai", 28.5, 7.0), ("Kolkata", 26.5, 14.0),
    ("Hyderabad", 26.5, 10.0), ("Ahmedabad", 27.5, 16.0), ("Jaipur", 25.5, 19.0), ("Lucknow", 25.5, 20.0), ("Bhopal", 25.0, 16.0),
)


def _number(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _channels(panel: DataFrame, columns, target: str) -> DataFrame:
    """The channels with the target as ``y``, written once: sums that are merged anew can end in other last bits."""
    return written(panel.select(_number(target).alias("y"), *[_number(c).alias(c) for c in columns]), "channels")


def _beside(channels: DataFrame, columns) -> DataFrame:
    return channels.unpivot(["y"], list(columns), "variable", "x").where("x is not null and y is not null")


def distribution_shape(panel: DataFrame, column: str = "temp_avg") -> DataFrame:
    """Moments per series and tests against the normal and the uniform of its own range, over all rows."""
    own = Window.partitionBy("city")
    x = panel.where(F.col(column).isNotNull()).select("city", _number(column).alias("x"))
    ranked = x.select("city", "x", F.row_number().over(own.orderBy("x")).alias("i"), F.count("*").over(own).alias("m"), F.min("x").over(own).alias("lo"), F.max("x").over(own).alias("hi"))
    u = F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    gap = F.greatest(F.col("i") / F.col("m") - u, u - (F.col("i") - 1) / F.col("m"))
    s = ranked.groupBy("city").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("excess_kurtosis"), F.max(gap).alias("d")
    )
    n = _number("n")
    p_normal = F.when((F.col("n") >= 8) & (F.col("std") > 0), F.exp(-normal_test(F.col("skew"), F.col("excess_kurtosis"), n) / 2))
    out = s.withColumns({"p_normal": p_normal, "p_uniform": ks_tail(F.col("d"), n)})
    return out.withColumn("closest_shape", F.when(F.col("p_uniform") > F.col("p_normal"), "uniform").otherwise("normal-ish")).drop("d")


def plausibility(panel: DataFrame, reference=REFERENCE_CLIMATE, least_eta: float = 0.25) -> DataFrame:
    """Series whose mean and yearly range agree with a table of known climates."""
    known = panel.sparkSession.createDataFrame(list(reference), "city string, reference_mean double, reference_amplitude double")
    mean = panel.groupBy("city").agg(F.round(F.avg("temp_avg"), 2).alias("observed_mean"))
    shape = eta_squared(panel).select("city", F.round("monthly_range", 2).alias("observed_amplitude"), F.round("eta_squared", 4).alias("eta_squared"))
    out = mean.join(shape, "city").join(F.broadcast(known), "city")  # a constant table
    gap, ratio = F.col("observed_mean") - F.col("reference_mean"), F.col("observed_amplitude") / F.col("reference_amplitude")
    good = (F.abs(gap) < 4) & ratio.between(0.5, 1.8) & (F.col("eta_squared") >= least_eta)
    return out.withColumns({"mean_gap": F.round(gap, 2), "amplitude_ratio": F.round(ratio, 3), "plausible": F.coalesce(good, F.lit(False))})


def correlation_significance(panel: DataFrame, columns, target: str = "temp_avg", level: float = 0.05) -> DataFrame:
    """Pearson and Spearman correlations with the target, p-values and thresholds by rank.

    Every channel is compared with its own threshold; a failure does not stop
    those after it.
    """
    long = _beside(_channels(panel, columns, target), columns)  # rows meet their ranks by value

    ranked = long
    for c in ("x", "y"):
        ranked = ranked.join(average_ranks(long, ["variable"], c, f"rank_{c}"), ["variable", c])
    out = ranked.groupBy("variable").agg(F.count("*").alias("n"), safe_corr(F.col("x"), F.col("y")).alias("pearson_r"), safe_corr(F.col("rank_x"), F.col("rank_y")).alias("spearman_rho"))

    def p(r: str) -> Column:
        return F.when(F.col("n") > 2, F.coalesce(t_tail(F.abs(F.col(r)) * F.sqrt(F.try_divide(F.col("n") - 2.0, 1 - F.col(r) ** 2)), _number("n") - 2), F.when(F.col(r).isNotNull(), 0.0)))

    few = Window.orderBy("pearson_p", F.desc(F.abs("pearson_r")), "variable")  # one row a channel
    out = out.withColumns({"pearson_p": p("pearson_r"), "spearman_p": p("spearman_rho")}).withColumn("rank", F.row_number().over(few))
    threshold = level / (F.lit(len(columns)) - F.col("rank") + 1)
    return out.withColumn("threshold", threshold).withColumn("significant", F.coalesce(F.col("pearson_p") < threshold, F.lit(False)))


def ljung_box(panel: DataFrame, lags=(7, 14, 30), column: str = "temp_avg") -> DataFrame:
    """Portmanteau statistic and its chi-square tail by series and number of lags."""
    n = panel.groupBy("city").agg(F.count(column).alias("n"))
    acf = autocorrelation(panel, max(lags), column).join(n, "city")
    upto = acf.withColumn("lags", F.explode(F.array(*[F.lit(k).cast("long") for k in lags]))).where("lag <= lags and n > lag")
    q = upto.groupBy("city", "lags").agg((F.first("n") * (F.first("n") + 2.0) * F.sum(F.col("acf") ** 2 / (F.col("n") - F.col("lag")))).alias("q"))
    return q.withColumn("p_value", chi2_tail(F.col("q"), _number("lags")))


def seasonality(panel: DataFrame, column: str = "temp_avg") -> DataFrame:
    """Variance by month with its F test, and the correlation of the first two years."""
    size = panel.where(F.col(column).isNotNull()).groupBy("city").agg(F.count("*").alias("n"), F.count_distinct(F.month("date")).alias("k"))
    out = eta_squared(panel, column).join(size, "city").join(year_over_year(panel, column).where("n > 30").select("city", "yoy_corr"), "city", "left")
    d1, d2 = _number("k") - 1, _number("n") - F.col("k")
    f = F.when((d1 > 0) & (d2 > 0), F.try_divide(F.col("eta_squared") * d2, (1 - F.col("eta_squared")) * d1))
    out = out.withColumn("f_statistic", f).withColumn("p_value", f_tail(F.col("f_statistic"), d1, d2))
    return out.select("city", "yoy_corr", "monthly_range", "eta_squared", "f_statistic", "p_value", F.coalesce((F.col("eta_squared") > 0.15) & (F.col("p_value") < 0.05), F.lit(False)).alias("seasonal"))


def cross_series(panel: DataFrame, column: str = "temp_avg") -> DataFrame:
    r = cross_city_correlation(panel, column)
    return r.agg(F.avg("r").alias("mean"), F.median("r").alias("median"), F.max("r").alias("max"), F.min("r").alias("min"), F.avg((F.col("r") > 0.5).cast("double")).alias("share_above_half"))


def mutual_information(panel: DataFrame, columns, target: str = "temp_avg", bins: int = 16) -> DataFrame:
    """Mutual information of each channel with the target over equal-width bins, less its small-sample bias.

    Counts are pre-aggregated by bin pair, so later steps see at most ``bins`` squared rows a channel.
    Bins start at the least value, so a second reading must not find a lesser one: channels are written once.
    """
    return _information(_beside(_channels(panel, columns, target), columns), bins)


def _information(long: DataFrame, bins: int = 16) -> DataFrame:
    span = long.groupBy("variable").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda v, lo, hi: F.coalesce(F.least(F.floor(bins * F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo))), F.lit(bins - 1)), F.lit(0))
    cells = long.join(F.broadcast(span), "variable").groupBy("variable", at("x", "x0", "x1").alias("bx"), at("y", "y0", "y1").alias("by")).agg(F.count("*").alias("c"))  # one row a channel
    over = lambda *k: F.sum("c").over(Window.partitionBy("variable", *k))
    c = cells.select("variable", "bx", "by", "c", over().alias("n"), over("bx").alias("cx"), over("by").alias("cy"))
    bias = (F.count("*") - F.count_distinct("bx") - F.count_distinct("by") + 1) / (2.0 * F.first("n"))
    return c.groupBy("variable").agg(F.greatest(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * _number("n") / (F.col("cx") * F.col("cy")))) - bias, F.lit(0.0)).alias("mutual_info"))


def exogenous(panel: DataFrame, columns, target: str = "temp_avg") -> DataFrame:
    """Linear and general dependence of the target on each channel."""
    fixed = _channels(panel, columns, target)
    r = fixed.agg(*[safe_corr(F.col(c), F.col("y")).alias(c) for c in columns]).unpivot([], list(columns), "variable", "pearson_r")
    out = r.join(_information(_beside(fixed, columns)), "variable", "left")
    return out.withColumn("informative", F.coalesce((F.abs("pearson_r") > 0.15) | (F.col("mutual_info") > 0.05), F.lit(False)))


def verdict(panel: DataFrame, columns, target: str = "temp_avg") -> DataFrame:
    """One row: five checks of the (filled) panel and what they say together.

    Each check reads the panel: a caller that fills it persists and releases it.
    """
    lags = autocorrelation(panel, 7, target).groupBy("city").agg(F.count_if(F.abs("acf") > F.col("band")).alias("k")).agg(F.avg((F.col("k") > 1).cast("double")).alias("short_lag_share"))
    noise = ljung_box(panel, column=target).groupBy("city").agg(F.min("p_value").alias("p")).agg(F.avg((F.col("p") < 0.05).cast("double")).alias("ljung_box_share"))
    season = seasonality(panel, target).agg(F.avg(F.col("seasonal").cast("double")).alias("seasonal_share"))
    cross = cross_series(panel, target).select(F.col("mean").alias("mean_correlation"))
    outside = exogenous(panel, columns, target).agg(F.count_if("informative").alias("informative"))
    one = reduce(DataFrame.crossJoin, [lags, noise, season, cross, outside])  # one row each
    failed = [F.col("short_lag_share") < 0.3, F.col("ljung_box_share") < 0.5, F.col("seasonal_share") < 0.5, F.abs("mean_correlation") < 0.2, F.col("informative") == 0]
    n = sum(F.coalesce(f, F.lit(True)).cast("long") for f in failed)
    return one.withColumn("failed_checks", n).withColumn("verdict", F.when(n >= 4, "NOT FORECASTABLE").when(n >= 2, "WEAKLY FORECASTABLE").otherwise("FORECASTABLE"))


def evidence(verdict_row: DataFrame) -> DataFrame:
    """The verdict with ``evidence``, one line a check."""
    share = lambda c: F.coalesce(F.round(100 * F.col(c), 1), F.lit(0.0)).cast("string")
    lines = [
        F.concat(share("short_lag_share"), F.lit("% of series have more than one short lag outside the noise band")),
        F.concat(share("ljung_box_share"), F.lit("% of series are told apart from white noise")),
        F.concat(share("seasonal_share"), F.lit("% of series are seasonal")),
        F.concat(F.lit("mean correlation between series "), F.coalesce(F.round("mean_correlation", 3).cast("string"), F.lit("unknown"))),
        F.concat(F.col("informative").cast("string"), F.lit(" informative channels")),
    ]
    return verdict_row.withColumn("evidence", F.array(*lines))


def report(panel: DataFrame, columns, target: str = "temp_avg") -> dict[str, DataFrame]:
    """The six tables of the audit and the verdict with its evidence, by name."""
    return {
        "autocorrelation": autocorrelation(panel, 7, target),
        "ljung_box": ljung_box(panel, column=target),
        "seasonality": seasonality(panel, target),
        "cross_series": cross_series(panel, target),
        "exogenous": exogenous(panel, columns, target),
        "ceiling": predictability(panel, target),
        "verdict": evidence(verdict(panel, columns, target)),
    }


def report_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, row)``: every row of every table as JSON, nulls included, so that one table holds the whole report."""
    rows = [df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def report_table(rows: DataFrame, name: str, schema) -> DataFrame:
    """One table of ``report_rows`` read back."""
    return rows.where(F.col("table") == name).select(F.from_json("row", schema).alias("r")).select("r.*")


def print_report(tables: dict[str, DataFrame], rows: int = 20) -> None:
    """The first ``rows`` of each table, then the verdict and its evidence."""
    for name, df in tables.items():
        if name != "verdict":
            print(name.replace("_", " "))
            df.show(rows, truncate=False)
    one = tables["verdict"].first()
    print(one["verdict"], *(f"- {line}" for line in one["evidence"]), sep="\n")


def significance(scored: DataFrame, best: str, challengers, h: int = 14, by_series: bool = False) -> DataFrame:
    """The best model against each challenger by absolute loss, one verdict a challenger, or with ``by_series`` one a series too."""
    from panelspark.operators.plot_data import diebold_mariano

    scored = written(scored.where(F.col("model").isin(best, *challengers)), "scored")  # read once a challenger
    each = [diebold_mariano(scored, best, c, h, by_series=by_series).withColumn("challenger", F.lit(c)) for c in challengers]
    out = reduce(DataFrame.unionByName, each)
    better = F.when(F.col("dm") < 0, "best significantly better").otherwise("challenger better")
    return out.withColumn("verdict", F.when(F.col("p_value") < 0.05, better).otherwise("no significant difference"))
