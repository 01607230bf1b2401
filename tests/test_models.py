"""Tests, decomposition, fitted models and detectors: oracles, and properties on made panels."""

import datetime as dt
import math
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from oracle import connect, differences  # noqa: E402

from panelspark.functions import special
from panelspark.operators import anomaly, audit, boosting, decompose, descriptive, evaluate, features, forecast, models, plot_data
from panelspark.plans import model_queries as plans
from panelspark.plans.queries import CHANNELS
from panelspark.sources import panel as source

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.fixture(scope="module")
def weather(spark):
    """Ten made series over two years: a season, a shared and an own persistent part, channels that follow."""
    r = np.random.default_rng(13)
    n, rows, start = 731, [], dt.date(2023, 1, 1)

    def persistent(keep, size):
        out = [0.0]
        for e in r.normal(0, size * math.sqrt(1 - keep * keep), n - 1):
            out.append(keep * out[-1] + e)
        return np.array(out)

    shared = persistent(0.8, 1.4)
    wave = np.sin(2 * np.pi * (np.arange(n) - 100) / 365.25)
    for k in range(10):
        mean, half = 22 + k, 5 + 0.4 * k
        temp = mean + half * wave + shared + persistent(0.75, 1.0)
        away = temp - mean
        channels = {
            "humidity": np.clip(60 - 1.5 * away + r.normal(0, 5, n), 5, 100), "rainfall": np.maximum(0, r.normal(-1, 3, n) - 0.3 * away), "wind_speed": 8 - 0.2 * away + r.normal(0, 1, n),
            "aqi": np.round(np.clip(150 - 5 * away + r.normal(0, 20, n), 10, 490)), "pressure": 1010 - 0.5 * away + r.normal(0, 1, n), "cloud_cover": np.clip(50 - 3 * away + r.normal(0, 8, n), 0, 100),
        }
        for i in range(n):
            rows.append((start + dt.timedelta(days=i), f"S{k}", f"T{k % 3}", *(round(float(temp[i] + d), 1) for d in (5, -5, 0)), *(round(float(c[i]), 1) for c in channels.values())))
    names = ["temp_max", "temp_min", "temp_avg", "humidity", "rainfall", "wind_speed", "aqi", "pressure", "cloud_cover"]
    made = spark.createDataFrame(rows, "date date, city string, state string, " + ", ".join(f"{c} double" for c in names))
    return made.withColumn("aqi_category", descriptive.aqi_class(F.col("aqi"))).persist()


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_oracle(spark, duck, name):
    assert not differences(plans.queries()[name](spark, SF), duck.sql(plans.oracle_sql()[name]))


@pytest.fixture(scope="module")
def steady(tmp_path_factory):
    """Order lines with the same greatest and least quantity on every day: two channels are constant. Sums are exact."""
    path = tmp_path_factory.mktemp("steady")
    duck = connect(str(path))
    duck.sql(f"""COPY (SELECT f[1] l_returnflag, f[2] l_linestatus, TIMESTAMP '2000-01-01' + CAST(d AS INT) * INTERVAL 1 DAY l_shipdate, CAST(l % 7 + 1 AS INT) l_linenumber,
      CASE l WHEN 0 THEN 50e0 WHEN 1 THEN 1e0 ELSE 2e0 + (d * 7 + l * 5 + d * d * l) % 47 END l_quantity, 1000e0 + (d * 37 + l * 911) % 5000 l_extendedprice,
      ((d * 3 + l * d) % 8) / 64e0 l_discount, ((d * d + l) % 5) / 64e0 l_tax
      FROM range(60) a(d), range(8) b(l), (VALUES (['A', 'F']), (['R', 'O'])) c(f) WHERE l < 6 + d % 3) TO '{path}/lineitem.parquet' (FORMAT parquet)""")
    return str(path), connect(str(path))


@pytest.mark.parametrize("name", ["a21_correlation_significance", "f5_exogenous"])
def test_constant_channels_as_in_sql(spark, steady, name):
    path, duck = steady
    found = plans.queries()[name](spark, path)
    assert not differences(found, duck.sql(plans.oracle_sql()[name]))
    assert {r.variable for r in found.collect() if math.isnan(r.pearson_r)} == {"temp_max", "temp_min"}


def series(spark, values, city="A"):
    start = dt.date(2020, 1, 1)
    return spark.createDataFrame([(city, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "city string, date date, temp_avg double")


def spiked():
    r = np.random.default_rng(1)
    y = 27 + 9 * np.sin(2 * np.pi * np.arange(731) / 365) + r.normal(0, 0.8, 731)
    y[[90, 200, 365, 500, 650]] += 14
    return y


def test_tails_of_tables(spark):
    lit = lambda x: F.lit(float(x))
    row = spark.range(1).select(special.chi2_tail(lit(14.067), lit(7)), special.t_tail(lit(2.228), lit(10)), special.f_tail(lit(2.866), lit(4), lit(20)), special.t_tail(lit(1.96), lit(1e6))).first()
    assert all(abs(p - 0.05) < 2e-4 for p in row)


def test_verdicts(spark, weather):
    assert audit.verdict(weather, CHANNELS[1:]).first().verdict == "FORECASTABLE"
    u = random.Random(3)
    start = dt.date(2020, 1, 1)
    noise = [(c, start + dt.timedelta(days=i), u.uniform(18, 42), u.uniform(0, 1)) for c in "ABCD" for i in range(731)]
    p = spark.createDataFrame(noise, "city string, date date, temp_avg double, humidity double")
    assert audit.verdict(p, ("humidity",)).first().verdict == "NOT FORECASTABLE"
    assert {r.closest_shape for r in audit.distribution_shape(p).collect()} == {"uniform"}


def test_harmonics_keep_the_noise(spark):
    out = decompose.decompose(series(spark, spiked())).toPandas()
    assert np.allclose(out.observed, out.trend + out.seasonal + out.resid)
    assert 0.6 < np.median(np.abs(out.resid)) * 1.4826 < 1.0


def test_loess_finds_the_season(spark):
    y = [math.sin(2 * math.pi * i / 20) * 5 + i * 0.01 for i in range(200)]
    out = decompose.decompose(series(spark, y), period=20, method="stl").toPandas().sort_values("date")
    assert np.abs(out.resid[20:-20]).max() < 0.3
    with pytest.raises(Exception, match="unknown method"):
        decompose.decompose(series(spark, y), method="other").collect()


def test_stationarity_of_noise_and_walk(spark):
    r = np.random.default_rng(0)
    both = series(spark, r.normal(size=600), "noise").unionByName(series(spark, r.normal(size=600).cumsum(), "walk")).unionByName(series(spark, [1.0] * 30, "flat"))
    got = {x.city: x.verdict for x in decompose.stationarity(both).collect()}
    assert got["noise"] == "stationary" and got["walk"] in ("non-stationary", "difference-stationary") and got["flat"] is None


def test_partial_autocorrelation_of_first_order(spark):
    r = np.random.default_rng(2)
    y = [0.0]
    for e in r.normal(size=3000):
        y.append(0.7 * y[-1] + e)
    got = {x.lag: x for x in decompose.acf_pacf(series(spark, y), 5).collect()}
    assert abs(got[1].pacf - 0.7) < 0.05 and all(abs(got[k].pacf) < 0.06 for k in (2, 3, 4, 5)) and abs(got[2].acf - 0.49) < 0.08


def test_spikes_are_flagged_and_bands_cover(spark):
    p = series(spark, spiked()).withColumn("humidity", F.lit(50.0))
    parts = decompose.decompose(p)
    voted = anomaly.detect(p, parts, ("temp_avg", "humidity")).where("flag_ensemble").collect()
    days = {(r.date - dt.date(2020, 1, 1)).days for r in voted}
    assert {90, 200, 365, 500, 650} <= days
    assert anomaly.brutlag_bands(parts).where("not flag_brutlag").count() > 0.85 * 731


def test_autoregression_beats_persistence(spark, weather):
    o = source.rolling_origins(weather, n=3)
    ar = models.autoregression(weather, o)
    board = {r.model: r.mae for r in evaluate.leaderboard(forecast.walk_forward(weather, forecast.naive(weather, o).unionByName(ar.select(*forecast.COLUMNS)))).collect()}
    assert board["sarimax_fourier"] < board["naive"]
    inside = evaluate.interval_metrics(forecast.walk_forward(weather, ar)).first()
    assert 0.75 < inside.coverage <= 1


@pytest.fixture(scope="module")
def blocks(weather):
    o = source.rolling_origins(weather, n=6)
    return boosting.fit_blocks(weather, o, refit_every=6)


def test_boosting_uses_every_origin_and_beats_climatology(spark, weather, blocks):
    o = source.rolling_origins(weather, n=6)
    gbm = boosting._all(blocks).select(F.lit("gbm").alias("model"), "city", "origin", "target_date", "horizon", F.col("y0").alias("y_pred"))
    assert gbm.count() == 10 * 6 * 14 and gbm.select("origin").distinct().count() == 6
    some = blocks[0].training
    assert some.select("origin").distinct().count() == (blocks[0].until - some.agg(F.min("origin")).first()[0]).days  # all of them, the last without a known target
    for f in (forecast.naive(weather, o), forecast.climatology_persistence(weather, o, decay=0.0), forecast.climatology_persistence(weather, o)):
        gbm = gbm.unionByName(f)
    scored = forecast.walk_forward(weather, gbm).cache()
    mae = {r.model: r.mae for r in evaluate.leaderboard(scored).collect()}
    assert mae["climatology_persistence"] < mae["gbm"] < mae["climatology"] and mae["gbm"] < 1.05 * mae["climatology_persistence"]
    at = {(r.model, r.horizon): r.mae for r in evaluate.by_horizon(scored).collect()}
    assert at["gbm", 1] < at["climatology_persistence", 1] and at["gbm", 14] < 1.15 * at["climatology", 14] and at["naive", 1] < at["naive", 14]


def test_boosted_factors_importance_and_residuals(spark, blocks):
    block = blocks[-1]
    f = [r.factor for r in block.factors.orderBy("horizon").collect()]
    assert f == sorted(f, reverse=True) and 0 <= f[-1] <= f[0] <= 1 and len(f) == 14
    top = boosting.importance(block.models[0.5], block.names, 10).collect()
    assert [r.gain for r in top] == sorted((r.gain for r in top), reverse=True) and len(top) == 10 and "persisted" in {r.feature for r in top}
    every = boosting.importance(block.models[0.5], block.names, 99).agg(F.sum("gain_pct"), F.sum("split")).first()
    assert abs(every[0] - 100) < 1e-6 and every[1] == sum((t.numNodes - 1) // 2 for t, _ in block.models[0.5].trees)
    assert not {"doy", "time_idx", "weekday"} & set(block.names)
    r = boosting.training_residuals(block).agg(F.avg(F.abs("residual")), F.count("*")).first()
    assert 0.5 < r[0] < 3 and r[1] == block.training.count()


def test_blocks_know_dates_up_to_their_first_origin(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=14 * i) for i in range(5)]
    made = boosting.blocks_of(spark.createDataFrame([(d,) for d in reversed(days)], "origin date"), 2)
    assert [(b.origins, b.until) for b in made] == [(days[:2], days[0]), (days[2:4], days[2]), (days[4:], days[4])]


def test_boosting_stops_early_where_asked(spark):
    from pyspark.ml.feature import VectorAssembler

    r = np.random.default_rng(2)
    rows = [(float(x), float((x > 0) + r.normal(0, 0.3)), bool(i >= 1500)) for i, x in enumerate(r.normal(size=2000))]
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.createDataFrame(rows, "x double, label double, validation boolean"))
    m = boosting.boost(df, rounds=6, depth=2, step=0.7, patience=2)
    assert len(m.losses) == len(m.trees) + 1 and m.losses[-1] == min(m.losses) < 0.6 * m.losses[0]
    assert len(boosting.boost(df, rounds=3, depth=2).trees) == 3
    high = boosting.boost(df, 0.9, rounds=6, depth=2, step=0.7).score(df)
    assert 0.87 < high.agg(F.avg((F.col("label") <= F.col("prediction")).cast("double"))).first()[0] < 0.93
    with pytest.raises(ValueError, match="no training rows"):
        boosting.boost(df.limit(0))


def test_boosted_bounds_cover_and_know_nothing_ahead(spark, weather):
    o = source.rolling_origins(weather, n=6)
    made = boosting.quantile_boosted(weather, o, refit_every=6, rounds=6).cache()
    assert made.where("lower > y_pred or y_pred > upper").count() == 0
    inside = evaluate.interval_metrics(forecast.walk_forward(weather, made)).first()
    assert 0.84 <= inside.coverage <= 0.96
    first = o.agg(F.min("origin")).first()[0]
    seen = boosting.quantile_boosted(weather.where(F.col("date") <= first), o.where(F.col("origin") == first), refit_every=6, rounds=6)
    key = lambda df: sorted(map(tuple, df.where((F.col("origin") == first) & (F.col("city") == "S3")).collect()))
    assert key(made) == key(seen)


def test_models_do_not_see_the_future(spark, weather):
    o = source.rolling_origins(weather, n=1)
    cut = o.first().origin
    for model in (models.autoregression, forecast.climatology_persistence):
        whole = model(weather, o).where("city = 'S3'").orderBy("horizon").collect()
        assert whole == model(weather.where(F.col("date") <= cut), o).where("city = 'S3'").orderBy("horizon").collect()


def test_climatology_states_equal_fits_of_each_origin(spark, weather):
    p = weather.where("city in ('S1', 'S2')")
    o = source.rolling_origins(p, n=4)
    got = {(r.city, r.origin, r.doy): r.clim for r in forecast.climatology_by_origin(p, o).collect()}
    for (origin,) in o.collect():
        want = features.climatology(p.where(F.col("date") <= origin)).collect()
        assert all(abs(got[r.city, origin, r.doy] - r.clim) < 1e-9 for r in want) and len(want) == 2 * 366
    plan = forecast.climatology_persistence(p, o)._jdf.queryExecution().optimizedPlan().toString()
    assert "NestedLoop" not in plan


@pytest.mark.parametrize("model", [forecast.naive, forecast.seasonal_naive, forecast.climatology_persistence, boosting.boosted, boosting.quantile_boosted])
def test_forecasters_refuse_what_cannot_be_fitted(weather, model):
    o = source.rolling_origins(weather, n=1)
    with pytest.raises(ValueError, match="no training rows"):
        model(weather.limit(0), o)
    with pytest.raises(ValueError, match="missing columns: temp_avg"):
        model(weather.drop("temp_avg"), o)


@pytest.mark.parametrize("stretch", [1, 5, 7, 1 << 16])
def test_lags_cross_stretches(spark, stretch):
    from panelspark.functions.ordering import lagged, numbered

    r = random.Random(4)
    rows = sorted((f"c{r.randint(0, 3)}", i, r.random()) for i in range(60))
    df = spark.createDataFrame(r.sample(rows, len(rows)), "city string, at int, v double").repartition(5)
    got = lagged(numbered(df, "city", "at"), "v", (1, 3, 6), stretch).orderBy("idx").collect()
    v = [x[2] for x in rows]
    assert [(g.idx, g.v, g.l1, g.l3, g.l6) for g in got] == [(i, x, *(v[i - k] if i >= k else None for k in (1, 3, 6))) for i, x in enumerate(v)]


def test_report_reads_back(spark, weather, tmp_path, capsys):
    from panelspark.sources.sinks import write_report

    tables = audit.report(weather.where("city < 'S3'"), ("humidity", "pressure"))
    path = write_report(audit.report_rows(tables), str(tmp_path))
    rows = spark.read.text(path).withColumnRenamed("value", "row")
    assert {r.table for r in rows.select("table").distinct().collect()} == set(tables) and len(tables) == 7
    for name in ("seasonality", "exogenous", "verdict"):
        again = audit.report_table(rows, name, tables[name].schema)
        assert sorted(map(repr, again.collect())) == sorted(map(repr, tables[name].collect()))
    audit.print_report(tables, 3)
    told = capsys.readouterr().out
    one = tables["verdict"].first()
    assert one.verdict in told and len(one.evidence) == 5 and all(line in told for line in one.evidence)


def test_missing_days_warn(weather):
    with pytest.warns(UserWarning, match="1 missing days in 1 series"):
        source.validate(weather.where("not (city = 'S1' and date = '2023-05-05')"))


def test_bad_losses_are_refused(spark, weather):
    with pytest.raises(ValueError, match="loss must be"):
        plot_data.diebold_mariano(weather, "a", "b", loss="huber")


def test_widths_of_unseen_horizons_and_of_nothing(spark):
    rows = [("m", h, 0.0, float(i)) for h in (1, 2) for i in range(1, 21)]
    w = evaluate.conformal_widths(spark.createDataFrame(rows, "model string, horizon int, y_true double, y_pred double"))
    ahead = spark.createDataFrame([("m", 1, 5.0), ("m", 9, 5.0), ("other", 1, 5.0)], "model string, horizon int, y_pred double")
    got = {(r.model, r.horizon): r.width for r in evaluate.intervals(ahead, w).collect()}
    assert got["m", 9] == w.first().overall == 19.0 and got["m", 1] == {r.horizon: r.width for r in w.collect()}[1] and got["other", 1] is None
    for bad in ([], [("m", 1, None, 1.0)], [("m", 1, float("nan"), 1.0)]):
        with pytest.raises(ValueError, match="residuals"):
            evaluate.conformal_widths(spark.createDataFrame(bad, "model string, horizon int, y_true double, y_pred double"))


def test_example_has_history_and_band(spark, weather):
    o = source.rolling_origins(weather, n=2)
    scored = forecast.walk_forward(weather, forecast.naive(weather, o))
    rows = plot_data.forecast_example(weather, evaluate.intervals(scored, evaluate.conformal_widths(scored)), "S4", 30).collect()
    assert sum(r.model == "history" for r in rows) == 30 and all(r.lower < r.y_pred < r.upper for r in rows if r.model == "naive")
    assert sum(r.model == "naive" for r in rows) == 14 and all(r.lower is None for r in plot_data.forecast_example(weather, scored, "S4").collect())


def test_panel_is_written_and_read(spark, weather, tmp_path):
    from panelspark.sources.sinks import write_panel

    write_panel(weather, str(tmp_path / "panel"))
    again = source.read_csv(spark, str(tmp_path / "panel"))
    assert again.select("city", "date", "temp_avg", "aqi", "aqi_category").exceptAll(weather.select("city", "date", "temp_avg", "aqi", "aqi_category")).count() == 0
    assert again.count() == weather.count()


def test_read_checks_what_it_reads(spark, weather, tmp_path):
    from panelspark.sources.sinks import write_panel

    with pytest.raises(FileNotFoundError):
        source.read_csv(spark, str(tmp_path / "nothing"))
    write_panel(weather.where("date < '2023-02-01' and date <> '2023-01-10'"), str(tmp_path / "gap"))
    whole = source.load_panel(spark, str(tmp_path / "gap"))
    assert whole.count() == 310 and whole.where("temp_avg is null or humidity is null or state is null or aqi_category is null").count() == 0
    write_panel(weather.limit(3).withColumn("temp_avg", F.lit(99.0)), str(tmp_path / "hot"))
    with pytest.raises(source.DataValidationError):
        source.read_csv(spark, str(tmp_path / "hot"))


def test_command_line_writes_its_tables(spark, weather, tmp_path):
    import json

    from panelspark import cli
    from panelspark.sources.sinks import write_panel

    write_panel(weather.where("city in ('S1', 'S2')"), str(tmp_path / "panel"))
    board = cli.run(spark, source.read_csv(spark, str(tmp_path / "panel")), str(tmp_path / "out"), "t", origins=2, slow=False, eda=False)
    assert {r.model for r in board.collect()} == {"naive", "seasonal_naive", "climatology", "climatology_persistence", "gbm"}
    assert {n.split("__")[0] for n in os.listdir(tmp_path / "out")} >= {"timings", "importance", "forecast_example", "verdict", "leaderboard", "by_horizon", "intervals", "coverage_by_horizon", "anomalies"}


def test_backtest_isolates_a_failure(spark, weather, tmp_path):
    def broken(panel, origins, horizon):
        raise ValueError("no")

    o = source.rolling_origins(weather, n=2)
    scored, went = forecast.backtest(weather, {"naive": forecast.naive, "broken": broken}, o, 7, str(tmp_path / "bt"))
    went = went.orderBy("model", "origin").collect()
    assert [(w.model, w.status[:10], w.rows) for w in went] == [("broken", "ValueError", 0)] * 2 + [("naive", "ok", 70)] * 2 and all(w.seconds >= 0 for w in went)
    assert {r.model for r in evaluate.models(scored).collect()} == {"naive"} and evaluate.for_model(scored, "naive").count() == 10 * 2 * 7

    def late(panel, origins, horizon):
        if origins.count() > 1 or origins.first().origin == last:
            raise ValueError("late")
        return forecast.naive(panel, origins, horizon)

    last = o.agg(F.max("origin")).first()[0]
    scored, went = forecast.backtest(weather, {"late": late}, o, 7, str(tmp_path / "late"))
    assert [(w.origin == last, w.rows, w.status[:10]) for w in went.orderBy("origin").collect()] == [(False, 70, "ok"), (True, 0, "ValueError")] and scored.count() == 70
    with pytest.raises(RuntimeError):
        forecast.backtest(weather, {"broken": broken}, o, 7, str(tmp_path / "none"))


def test_fit_and_predict_contracts(spark, weather):
    with pytest.raises(ValueError, match="no training rows"):
        forecast.checked(weather.limit(0))
    with pytest.raises(ValueError, match="missing columns: soil"):
        forecast.checked(weather, ("temp_avg", "soil"))
    with pytest.raises(ValueError, match="missing columns"):
        forecast.as_predictions(weather, "m")
    o = source.rolling_origins(weather, n=1)
    empty = forecast.scaffold(weather, o, 3)
    assert empty.columns == list(forecast.COLUMNS) and empty.count() == 30 and empty.where("y_pred is not null").count() == 0
    made = forecast.as_predictions(empty.select("city", "origin", "horizon", F.lit(1.0).alias("y_pred"), F.lit(0.0).alias("lower")), "m", "lower")
    assert made.where("target_date = date_add(origin, horizon) and model = 'm'").count() == 30


def test_split_and_residuals_of_training_rows(spark, weather):
    rows = features.supervised(weather.where("city = 'S0'"), 2)
    split = models.chronological_split(rows, 30)
    last = rows.agg(F.max("origin")).first()[0]
    assert {r.origin for r in split.where("validation").select("origin").distinct().collect()} == {last - dt.timedelta(days=i) for i in range(30)}
    assert features.for_horizon(rows, 2).count() * 2 - rows.count() in (-1, 0)
    assert "target" not in features.feature_names(rows) and {"lag365", "ewm7", "ewm30", "doy", "sin1", "time_idx"} <= set(features.feature_names(rows))
    assert (features.lag_of("lag14"), features.lag_of("humidity_lag7"), features.lag_of("rmean7")) == (14, 7, None)
    with pytest.raises(ValueError, match="unknown calendar"):
        features.calendar_terms(weather, include=("month", "moon"))
    r = models.in_sample_residuals(rows.withColumn("anomaly", F.col("target")).withColumn("prediction", F.col("target") - 2))
    assert r.where("abs(residual - 2) > 1e-9").count() == 0


def test_profile_against_all_pairs(spark):
    r = np.random.default_rng(7)
    y = np.concatenate([r.normal(size=150).cumsum(), np.ones(30), r.normal(size=60)])
    got = anomaly.matrix_profile(series(spark, y), window=10, top_k=5, tile=37).orderBy("date").collect()
    w = np.lib.stride_tricks.sliding_window_view(y, 10)
    sd = w.std(axis=1)
    z = (w - w.mean(axis=1)[:, None]) / np.where(sd < 1e-8, 1, sd)[:, None]
    want = [min(math.sqrt(max(20 - 2 * z[i] @ z[j], 0)) for j in range(len(z)) if abs(i - j) > 5) for i in range(len(z))]
    assert [x.distance for x in got[: len(z)]] == pytest.approx(want, abs=1e-6) and all(x.distance is None for x in got[len(z) :])
    cut = np.percentile(want, 100 * (1 - 5 / len(want)))
    assert [x.flag_profile for x in got[: len(z)]] == [d >= cut - 1e-9 for d in want]


def test_flags_by_name(spark):
    v = anomaly.votes([series(spark, [1, 2, 3]).select("city", "date", (F.col("temp_avg") > 2).alias("flag_a"))], 1)
    assert anomaly.flag_columns(v) == ["flag_a", "flag_ensemble"] and anomaly.anomalies(v).count() == 1
    with pytest.raises(KeyError):
        anomaly.anomalies(v, "flag_b")
