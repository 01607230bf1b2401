"""Panel operators: oracles, and properties on small hand-made panels."""

import datetime as dt
import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from oracle import connect, differences  # noqa: E402

from panelspark.functions import quantiles
from panelspark.operators import anomaly, audit, descriptive, evaluate, features, forecast
from panelspark.plans import queries as plans
from panelspark.sources import panel as source

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, duck, name):
    assert not differences(plans.queries()[name](spark, SF), duck.sql(plans.oracle_sql()[name]))


def rows(spark, values, city="A"):
    start = dt.date(2020, 1, 1)
    data = [(city, start + dt.timedelta(days=i), float(v)) for i, v in values]
    return spark.createDataFrame(data, "city string, date date, temp_avg double")


def test_gap_is_filled_by_time(spark):
    out = source.fill_calendar(rows(spark, [(0, 10.0), (1, 11.0), (4, 14.0)])).orderBy("date").collect()
    assert [r.temp_avg for r in out] == [10, 11, 12, 13, 14]


def test_bad_panels_are_refused(spark):
    for p in (rows(spark, [(0, 99.0)]), rows(spark, [(0, 1.0), (0, 1.0)])):
        with pytest.raises(source.DataValidationError):
            source.validate(p.withColumn("temp_min", F.lit(0.0)).withColumn("temp_max", F.lit(1.0)))


def test_constant_channel_has_no_correlation(spark):
    p = rows(spark, [(i, 5.0) for i in range(9)]).withColumn("h", F.rand(1))
    assert descriptive.channel_correlation(p, ("temp_avg", "h")).first().r is None


@pytest.fixture(scope="module")
def dealt(spark):
    """Constant channels in many tasks, whose merged deviations are not exactly zero."""
    i = F.col("id")  # 98 rows a task: 1.0 / 98 * 98 is not 1.0
    p = spark.range(0, 98 * 6, 1, 6).select(
        F.lit("A").alias("city"), F.date_add(F.lit(dt.date(2020, 1, 1)), i.cast("int")).alias("date"), (i * i % 17).cast("double").alias("temp_avg"),
        F.lit(2.0).alias("temp_max"), F.lit(1.0).alias("temp_min"), (i % 7).cast("double").alias("cloud_cover"),
    )
    assert p.agg(F.stddev_pop("temp_min")).first()[0] > 0
    return p


def test_constant_diurnal_range_has_no_correlation(dealt):
    assert descriptive.diurnal_profile(dealt).first().corr_cloud is None


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_constant_channels_in_many_tasks_have_no_correlation(dealt, method):
    got = {(r.a, r.b): r.r for r in descriptive.channel_correlation(dealt, ("temp_avg", "temp_max", "temp_min", "cloud_cover"), method).collect()}
    assert {k for k, r in got.items() if r is not None} == {("temp_avg", "cloud_cover")}


def test_constant_channels_in_many_tasks_are_not_informative(dealt):
    got = {r.variable: r for r in audit.exogenous(dealt, ("temp_max", "temp_min", "cloud_cover")).collect()}
    assert [got[c].pearson_r for c in ("temp_max", "temp_min")] == [None, None] and not got["temp_max"].informative
    assert got["cloud_cover"].pearson_r is not None


@pytest.fixture(scope="module")
def unsteady():
    """A column with other last bits each time it is computed, as sums merged in another order have."""
    return F.udf(lambda v: v + os.urandom(1)[0] * 2.0**-44, "double").asNondeterministic()


def test_ranks_keep_rows_whose_last_bits_change(spark, unsteady):
    i = F.col("id")  # 0 to 210 in another order: ranks are values
    p = spark.range(0, 211, 1, 3).select(unsteady(i.cast("double")).alias("x"), unsteady((i * 7 % 211).cast("double")).alias("y"))
    apart = sum((k - k * 7 % 211) ** 2 for k in range(211))
    assert descriptive.channel_correlation(p, ("x", "y"), "spearman").first().r == pytest.approx(1 - 6 * apart / (211 * (211**2 - 1)), abs=1e-12)


def test_significance_keeps_rows_whose_last_bits_change(spark, unsteady):
    i = F.col("id")
    p = spark.range(0, 211, 1, 3).select(unsteady((i * 7 % 211).cast("double")).alias("temp_avg"), unsteady(i.cast("double")).alias("x"))
    assert audit.correlation_significance(p, ("x",)).first().n == 211


def test_ranks_agree_on_the_edges_of_ranges(spark, monkeypatch):
    """Edges that differ each time they are computed, as those of sketches merged in another order do."""
    edges = F.udf(lambda n: sorted(b / 256 * n for b in os.urandom(7)), "array<double>").asNondeterministic()
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda v, shares, accuracy: edges(F.count(v)))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        p = spark.range(300).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
        got = quantiles.average_ranks(p, ["k"], "v", "r").collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert len(got) == 300 and all(r.r == r.v + 1 for r in got)


def test_bins_hold_rows_whose_last_bits_change(spark, unsteady):
    i, names = F.col("id"), [f"c{k}" for k in range(8)]
    p = spark.range(0, 960, 1, 3).select((i % 16 + i % 3 * 4).cast("double").alias("temp_avg"), (i % 16).cast("double").alias("steady"), *[unsteady((i % 16).cast("double")).alias(c) for c in names])
    for rows in (audit.exogenous(p, ["steady", *names]).collect(), audit.mutual_information(p, ["steady", *names]).collect()):
        got = {r.variable: r.mutual_info for r in rows}
        assert got["steady"] > 0 and [got[c] for c in names] == pytest.approx([got["steady"]] * 8, abs=1e-12)


def test_history_ignores_the_future(spark):
    p = rows(spark, [(i, float(i * i % 17)) for i in range(60)])
    cut = dt.date(2020, 2, 9)
    whole = features.history(p).where(F.col("date") <= cut).orderBy("date").collect()
    assert whole == features.history(p.where(F.col("date") <= cut)).orderBy("date").collect()
    assert all(r.lag1 == r.temp_avg for r in whole)


def test_longest_run(spark):
    p = rows(spark, [(i, v) for i, v in enumerate([40.0, 41, 1, 40, 40, 40, 2])])
    p = p.withColumn("temp_max", F.col("temp_avg")).withColumn("temp_min", F.col("temp_avg"))
    r = descriptive.heat_spells(p, 35).first()
    assert (r.hot_days, r.longest_run) == (5, 3)


def test_forecast_contract_and_order(spark):
    import math

    p = rows(spark, [(i, 25 + 9 * math.sin(2 * math.pi * i / 365) + (i * 7919 % 13 - 6) / 4) for i in range(800)])
    o = source.rolling_origins(p, n=3)
    f = forecast.naive(p, o).unionByName(forecast.climatology_persistence(p, o)).cache()
    assert f.columns == list(forecast.COLUMNS) and f.count() == 2 * 3 * 14
    assert f.where(F.datediff("target_date", "origin") != F.col("horizon")).count() == 0
    board = {r.model: r.mae for r in evaluate.leaderboard(forecast.walk_forward(p, f)).collect()}
    assert board["climatology_persistence"] < board["naive"]


def test_spike_is_flagged(spark):
    p = rows(spark, [(i, 20.0 + i % 3 + (30 if i == 50 else 0)) for i in range(120)])
    flagged = anomaly.mad_scores(anomaly.monthly_residual(p)).where("flag_mad").collect()
    assert [r.date for r in flagged] == [dt.date(2020, 2, 20)]


def test_short_series_has_no_profile(spark):
    out = anomaly.matrix_profile(rows(spark, [(i, float(i)) for i in range(20)])).collect()
    assert len(out) == 20 and not any(r.flag_profile for r in out)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_unknown_series_and_too_few_dates(spark):
    p = rows(spark, [(i, float(i)) for i in range(100)])
    with pytest.raises(KeyError):
        source.city_series(p, "B")
    with pytest.raises(ValueError, match="fewer than"):
        source.rolling_origins(p, strict=True)
    with pytest.raises(ValueError, match="no origin"):
        source.rolling_origins(p, horizon=14, min_train=86, n=0, strict=True)
    assert source.rolling_origins(p, min_train=50, strict=True).count() == 3


def test_other_columns_are_carried(spark):
    p = rows(spark, [(0, 10.0), (2, 12.0)]).withColumn("state", F.when(F.col("temp_avg") == 12, "x"))
    assert [(r.temp_avg, r.state) for r in source.fill_calendar(p).orderBy("date").collect()] == [(10, "x"), (11, "x"), (12, "x")]


def test_ranks_see_what_is_not_linear(spark):
    p = rows(spark, [(i, float(i)) for i in range(30)]).withColumn("h", F.exp(F.col("temp_avg") / 3)).withColumn("g", F.when(F.col("temp_avg") > 4, -F.col("h")))
    got = {(r.a, r.b): r.r for r in descriptive.channel_correlation(p, ("temp_avg", "h", "g"), "spearman").collect()}
    assert got == pytest.approx({("temp_avg", "h"): 1.0, ("temp_avg", "g"): -1.0, ("h", "g"): -1.0})
    with pytest.raises(ValueError):
        descriptive.channel_correlation(p, ("temp_avg", "h"), "other").collect()


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_quantiles_by_selection(spark, ranges):
    import numpy as np
    from panelspark.functions.quantiles import quantiles

    r = np.random.default_rng(3)
    groups = {"a": r.normal(size=500), "b": np.repeat([1.0, 2.0, 5.0], [400, 1, 99]), "c": np.array([7.0]), "d": np.arange(10.0)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("e", None)]
    shares = {"low": 0.05, "mid": 0.5, "high": 0.95, "first": 0.0, "last": 1.0}
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {q.g: q for q in quantiles(df, ["g"], "x", shares, ranges).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert [got[g][n] for n in shares] == pytest.approx(np.quantile(x, list(shares.values())).tolist(), abs=1e-12)
    whole = quantiles(df, [], "x", shares, ranges).first()
    assert [whole[n] for n in shares] == pytest.approx(np.quantile(np.concatenate(list(groups.values())), list(shares.values())).tolist(), abs=1e-12)
    assert quantiles(df.limit(0), ["g"], "x", shares).count() == 0


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_average_ranks_over_ranges(spark, ranges):
    import numpy as np
    import pandas as pd
    from panelspark.functions.quantiles import average_ranks

    r = np.random.default_rng(5)
    # all distinct, one value in most rows, all alike, a lone row
    groups = {"a": r.normal(size=700), "b": np.where(r.random(900) < 0.7, 0.0, r.integers(-3, 4, 900)), "c": np.full(40, 2.5), "d": np.array([1.0])}
    data = [(g, float(v)) for g, x in groups.items() for v in x]
    df = spark.createDataFrame([*data, ("a", None), ("e", None)], "g string, x double").repartition(5)
    got = {(q.g, q.x): q.place for q in average_ranks(df, ["g"], "x", "place", ranges).collect()}
    p = pd.DataFrame(data, columns=["g", "x"])
    p["place"] = p.groupby("g").x.rank()
    want = {(g, x): place for g, x, place in p.itertuples(index=False)}
    assert got == want
    assert average_ranks(df.limit(0), ["g"], "x", "place", ranges).count() == 0
    plan = average_ranks(df, ["g"], "x", "place")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(g#" in plan and all("_range#" in line for line in plan.split("\n") if "windowspecdefinition" in line)
