"""``python -m panelspark.cli``: audit, description, backtest, intervals and anomalies of one panel as tables."""

from __future__ import annotations

import argparse
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.lineage import new_path
from panelspark.operators import anomaly, audit, boosting, decompose, descriptive, evaluate, forecast, models, plot_data
from panelspark.sources import panel as source
from panelspark.sources.sinks import write_csv, write_json, write_report


def forecasters(slow: bool = True) -> dict:
    """Names and functions of (panel, origins, horizon); ``slow`` adds the models fitted per series and origin."""
    out = {
        "naive": forecast.naive,
        "seasonal_naive": forecast.seasonal_naive,
        "climatology": lambda p, o, h: forecast.climatology_persistence(p, o, h, decay=0.0),
        "climatology_persistence": forecast.climatology_persistence,
        "gbm": boosting.boosted,
    }
    if slow:
        out |= {"stl_ets": models.smoothing, "sarimax_fourier": models.autoregression, "sarimax_exog": lambda p, o, h: models.autoregression(p, o, h, exog=("humidity", "pressure", "cloud_cover"))}
    return out


def models_of(went: DataFrame) -> set[str]:
    """Models that answered for an origin or more."""
    return {r["model"] for r in went.where("status = 'ok'").select("model").distinct().collect()}  # a handful


def run(spark: SparkSession, panel: DataFrame, out: str, tag: str, horizon: int = 14, origins: int = 8, stride: int = 14, slow: bool = True, eda: bool = True) -> DataFrame:
    """Writes every table under ``out`` and returns the leaderboard."""
    source.validate(panel)
    filled = source.fill_calendar(panel).persist()
    tables = audit.report(filled, source.CHANNELS[1:])
    write_report(audit.report_rows(tables), out, "report", tag)
    write_json(tables["verdict"], out, "verdict", tag)
    if eda:
        for name, f in {"summary": source.summary, "city_profile": descriptive.city_profile, "numeric_summary": lambda p: descriptive.numeric_summary(p, source.CHANNELS),
                        "shape": audit.distribution_shape, "heat_spells": descriptive.heat_spells, "stationarity": decompose.stationarity}.items():
            write_csv(f(panel if name == "city_profile" else filled), out, name, tag)
    at = source.rolling_origins(filled, horizon, origins, stride).persist()
    scored, went = forecast.backtest(filled, forecasters(slow), at, horizon, new_path(spark, "backtest"))
    write_csv(went, out, "timings", tag)
    board = evaluate.leaderboard(scored).orderBy("mae").persist()  # one row a model
    write_csv(board, out, "leaderboard", tag)
    write_csv(evaluate.by_horizon(scored), out, "by_horizon", tag)
    before = forecast.calibration_origins(filled, horizon, tests=origins, stride=stride)
    seen = forecast.walk_forward(filled, forecast.climatology_persistence(filled, before, horizon))
    banded = evaluate.intervals(scored.where("model = 'climatology_persistence'"), evaluate.conformal_widths(seen))
    write_json(evaluate.interval_metrics(banded), out, "intervals", tag)
    write_csv(evaluate.interval_metrics(banded, by=("model", "horizon")), out, "coverage_by_horizon", tag)
    write_csv(plot_data.forecast_example(filled, banded, source.cities(filled).first()["city"]), out, "forecast_example", tag)
    if "gbm" in models_of(went):
        block = boosting.fit_blocks(filled, at.orderBy(F.desc("origin")).limit(1), horizon)[0]
        write_csv(boosting.importance(block.models[0.5], block.names), out, "importance", tag)
    parts = decompose.decompose(filled).persist()
    voted = anomaly.detect(filled, parts, ("temp_avg", "humidity", "pressure"))
    write_csv(anomaly.flag_counts(voted), out, "anomalies", tag)
    for df in (parts, at, filled):
        df.unpersist()
    return board


def main(argv=None) -> None:
    a = argparse.ArgumentParser(prog="panelspark")
    a.add_argument("data", help="panel to read: a CSV file, or a folder of them")
    a.add_argument("--out", default="reports", help="folder of the tables")
    a.add_argument("--tag", default="data", help="end of the tables' names")
    a.add_argument("--horizon", type=int, default=14)
    a.add_argument("--origins", type=int, default=8)
    a.add_argument("--stride", type=int, default=14)
    a.add_argument("--no-slow", action="store_true", help="leave out models that are fitted per series and origin")
    a.add_argument("--skip-eda", action="store_true", help="leave out the descriptive tables")
    args = a.parse_args(argv)
    spark = SparkSession.builder.appName("panelspark").getOrCreate()
    panel = source.read_csv(spark, args.data)
    run(spark, panel, args.out, args.tag, args.horizon, args.origins, args.stride, not args.no_slow, not args.skip_eda)


if __name__ == "__main__":
    main()
