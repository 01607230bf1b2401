"""Driver queries of the panel operators, with their SQL oracles.

The panel is derived from the order lines. Oracles are written for DuckDB;
floating results are rounded to six places on both sides.
"""

from __future__ import annotations

import math
import re
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import anomaly, audit, descriptive, evaluate, features, forecast, plot_data
from panelspark.sources import panel as source

PANEL_SQL = """
SELECT l_returnflag || '-' || l_linestatus AS city, l_returnflag AS state, CAST(l_shipdate AS DATE) AS date,
       avg(l_quantity) AS temp_avg, max(l_quantity) AS temp_max, min(l_quantity) AS temp_min,
       avg(l_discount) * 1000 AS humidity, avg(l_tax) * 100 AS rainfall, CAST(count(*) AS DOUBLE) AS wind_speed,
       CAST(floor(avg(l_extendedprice) / 200) AS INT) AS aqi, 1000 + avg(l_linenumber) AS pressure,
       100 * avg(CASE WHEN l_discount >= 0.05 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS cloud_cover
FROM lineitem GROUP BY 1, 2, 3
"""
CHANNELS = ("temp_avg", "temp_max", "temp_min", "humidity", "rainfall", "wind_speed", "aqi", "pressure", "cloud_cover")
HOT, COLD = 45.0, 6.0
GAMMA = 0.3684211
#: All series that the panel can have.
CITIES = ("A-F", "A-O", "N-F", "N-O", "R-F", "R-O")


def panel(spark, sf_dir: str) -> DataFrame:
    """The derived panel: one row per series and day of the order lines."""
    return spark.sql(PANEL_SQL.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def _filled(spark, sf_dir, columns=("temp_avg",)):
    return source.fill_calendar(panel(spark, sf_dir), columns)


def _split_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    n = lambda df, name: df.groupBy("city").agg(F.count("*").alias(name))
    return n(before, "n_train").join(n(after, "n_test"), "city", "full")


def _forecasts(spark, sf_dir):
    p = _filled(spark, sf_dir)
    o = source.rolling_origins(p)
    models = [forecast.naive(p, o), forecast.seasonal_naive(p, o), forecast.climatology_persistence(p, o, decay=0.0), forecast.climatology_persistence(p, o)]
    out = models[0]
    for m in models[1:]:
        out = out.unionByName(m)
    return forecast.walk_forward(p, out)


def _simple(spark, sf_dir):
    p = _filled(spark, sf_dir)
    o = source.rolling_origins(p)
    return forecast.walk_forward(p, forecast.naive(p, o).unionByName(forecast.seasonal_naive(p, o)))


def monthly_parts(p: DataFrame) -> DataFrame:
    """A fixed decomposition that SQL can state: no trend, the month's mean as season."""
    r = anomaly.monthly_residual(p)
    return r.select("city", "date", F.col("value").alias("observed"), F.lit(0.0).alias("trend"), (F.col("value") - F.col("resid")).alias("seasonal"), "resid")


def _votes(spark, sf_dir):
    """Bands, residuals and profile on fixed parts; the random forest has no SQL."""
    p = panel(spark, sf_dir)
    parts = monthly_parts(p)
    bands = anomaly.brutlag_bands(parts).select("city", "date", "flag_brutlag")
    resid = anomaly.mad_scores(parts.select("city", "date", F.col("observed").alias("value"), "resid"), 2.0).select("city", "date", F.col("flag_mad").alias("flag_stl"))
    return anomaly.votes([bands, resid, anomaly.matrix_profile(p).select("city", "date", "flag_profile")])


def _coverage_by_horizon(spark, sf_dir):
    s = _simple(spark, sf_dir)
    return evaluate.interval_metrics(evaluate.intervals(s, evaluate.conformal_widths(s)), by=("model", "horizon"))


def _intervals(spark, sf_dir):
    s = _simple(spark, sf_dir)
    return evaluate.interval_metrics(evaluate.intervals(s, evaluate.conformal_widths(s)))


def queries() -> dict:
    on_panel = {
        "d1_violations": source.violations,
        "d3_gaps": source.gaps,
        "d6_cities": source.cities,
        "d6_date_range": source.date_range,
        "d7_fill_calendar": source.fill_calendar,
        "d8_city_series": lambda p: source.city_series(p, "N-O").select("city", "date", "temp_avg"),
        "d9_wide": lambda p: source.wide(p, CITIES),
        "d10_summary": source.summary,
        "d11_split": lambda p: _split_counts(*source.split_by_date(p, "2000-01-01")),
        "d12_rolling_origins": source.rolling_origins,
        "a1_calendar_columns": lambda p: descriptive.add_calendar(p).select("city", "date", "year", "month", "month_name", "season"),
        "a3_dataset_profile": descriptive.dataset_profile,
        "a4_column_inventory": descriptive.column_inventory,
        "a5_numeric_summary": lambda p: descriptive.numeric_summary(p, CHANNELS),
        "a8_city_profile": descriptive.city_profile,
        "a10_rank_cities": lambda p: descriptive.rank_cities(descriptive.city_profile(p), "mean", 3),
        "a11_monthly_profile": lambda p: descriptive.period_profile(p, F.month("date")),
        "a11_monthly_profile_of_one": lambda p: descriptive.period_profile(p, F.month("date"), city="N-O"),
        "a12_seasonal_profile": lambda p: descriptive.period_profile(p, descriptive.season(F.month("date"))),
        "a13_city_month_matrix": descriptive.city_month_matrix,
        "a14_eta_squared": descriptive.eta_squared,
        "a16_extreme_days": lambda p: descriptive.extreme_days(p, HOT, COLD),
        "a18_heat_spells": lambda p: descriptive.heat_spells(p, HOT),
        "a20_diurnal_profile": descriptive.diurnal_profile,
        "a22_channel_correlation": lambda p: descriptive.channel_correlation(p, CHANNELS),
        "a22_channel_correlation_ranks": lambda p: descriptive.channel_correlation(p, CHANNELS, "spearman"),
        "a23_cross_city_correlation": descriptive.cross_city_correlation,
        "a24_aqi_burden": descriptive.aqi_burden,
        "a25_aqi_seasonality": descriptive.aqi_seasonality,
        "f1_autocorrelation": features.autocorrelation,
        "f3_year_over_year": features.year_over_year,
        "f6_predictability": features.predictability,
        "x3_calendar_terms": lambda p: features.calendar_terms(p).select("city", "date", *features.CALENDAR, "sin1", "cos1", "sin2", "cos2"),
        "x4_climatology": features.climatology,
        "x7_history": features.history,
        "n2_mad_scores": lambda p: anomaly.mad_scores(anomaly.monthly_residual(p), 2.0),
        "n5_matrix_profile": anomaly.matrix_profile,
        "f4_cross_series": audit.cross_series,
        "p8_histogram": plot_data.histogram,
        "p8_density_curves": plot_data.density_curves,
        "p9_monthly_boxes": plot_data.monthly_boxes,
        "p11_ecdf": plot_data.ecdf,
        "p14_scatter_fit": lambda p: plot_data.scatter_fit(p, "humidity", "temp_avg"),
        "p17_city_overview": plot_data.city_overview,
    }
    out = {name: (lambda spark, sf_dir, f=f: rounded(f(panel(spark, sf_dir)))) for name, f in on_panel.items()}
    out |= {
        "x15_supervised": lambda s, d: rounded(features.supervised(_filled(s, d)).select("city", "origin", "horizon", "target_date", "lag1", "lag7", "rmean7", "target")),
        "x15_supervised_features": lambda s, d: rounded(features.supervised(_filled(s, d, CHANNELS), 1, channels=CHANNELS)),
        "m4_m5_backtest": lambda s, d: rounded(_simple(s, d)),
        "b1_walk_forward": lambda s, d: rounded(_forecasts(s, d)),
        "v14_by_horizon": lambda s, d: rounded(evaluate.by_horizon(_simple(s, d))),
        "v15_leaderboard": lambda s, d: rounded(evaluate.leaderboard(_simple(s, d))),
        "v15_leaderboard_all": lambda s, d: rounded(evaluate.leaderboard(_forecasts(s, d))),
        "c1_conformal_widths": lambda s, d: rounded(evaluate.conformal_widths(_simple(s, d)).drop("overall")),
        "v12_interval_metrics": lambda s, d: rounded(_intervals(s, d)),
        "b4_pivot_predictions": lambda s, d: rounded(plot_data.pivot_predictions(_simple(s, d), ("naive", "seasonal_naive"))),
        "v6_mase": lambda s, d: rounded(plot_data.mase(_filled(s, d), _simple(s, d), by_series=True)),
        "v6_mase_in_one_order": lambda s, d: rounded(plot_data.mase(_filled(s, d), _simple(s, d))),
        "v13_diebold_mariano": lambda s, d: rounded(plot_data.diebold_mariano(_simple(s, d), "naive", "seasonal_naive", 2, "mse", True).drop("p_value")),
        "v16_mae_by_city": lambda s, d: rounded(evaluate.mae_by_city(_simple(s, d), CITIES)),
        "p5_residual_histogram": lambda s, d: rounded(plot_data.residual_diagnostics(_simple(s, d))[0]),
        "p5_residual_quantiles": lambda s, d: rounded(plot_data.residual_diagnostics(_simple(s, d))[1]),
        "p5_residual_acf": lambda s, d: rounded(plot_data.residual_diagnostics(_simple(s, d))[2]),
        "p7_coverage_by_horizon": lambda s, d: rounded(_coverage_by_horizon(s, d)),
        "b3_models": lambda s, d: evaluate.models(_simple(s, d)),
        "b3_for_model": lambda s, d: rounded(evaluate.for_model(_simple(s, d), "naive")),
        "m3_scaffold": lambda s, d: rounded(forecast.scaffold(_filled(s, d), source.rolling_origins(_filled(s, d)))),
        "n6_votes": lambda s, d: _votes(s, d),
        "n8_anomalies": lambda s, d: anomaly.anomalies(_votes(s, d), "flag_profile"),
        "n9_agreement": lambda s, d: anomaly.agreement(_votes(s, d)),
    }
    return out


# --- DuckDB ---------------------------------------------------------------
_P = f"WITH panel AS ({PANEL_SQL})"
_FILL = """, span AS (SELECT min(date) lo, max(date) hi FROM panel),
grid AS (SELECT c.city, CAST(g.d AS DATE) date FROM (SELECT DISTINCT city FROM panel) c, span, generate_series(lo, hi, INTERVAL 1 DAY) g(d)),
j AS (SELECT g.city, g.date, p.temp_avg y, CASE WHEN p.temp_avg IS NOT NULL THEN g.date END dy FROM grid g LEFT JOIN panel p USING (city, date)),
w AS (SELECT city, date, y, last_value(y IGNORE NULLS) OVER b v0, last_value(dy IGNORE NULLS) OVER b d0, first_value(y IGNORE NULLS) OVER a v1, first_value(dy IGNORE NULLS) OVER a d1
  FROM j WINDOW b AS (PARTITION BY city ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY city ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT city, date, coalesce(y, v0 + (v1 - v0) * (date - d0) / nullif(d1 - d0, 0), v0, v1) temp_avg FROM w)"""
_SERIES = ("state", *CHANNELS)
_FILL_ALL = """, span AS (SELECT min(date) lo, max(date) hi FROM panel),
grid AS (SELECT c.city, CAST(g.d AS DATE) date FROM (SELECT DISTINCT city FROM panel) c, span, generate_series(lo, hi, INTERVAL 1 DAY) g(d)),
j AS (SELECT g.city, g.date, """ + ", ".join(f"p.{c}" for c in _SERIES) + """ FROM grid g LEFT JOIN panel p USING (city, date)),
w AS (SELECT city, date, """ + ", ".join(
    f"{c}, last_value({c} IGNORE NULLS) OVER b {c}0, last_value(CASE WHEN {c} IS NOT NULL THEN date END IGNORE NULLS) OVER b {c}d0, "
    f"first_value({c} IGNORE NULLS) OVER a {c}1, first_value(CASE WHEN {c} IS NOT NULL THEN date END IGNORE NULLS) OVER a {c}d1"
    for c in _SERIES
) + """ FROM j WINDOW b AS (PARTITION BY city ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY city ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT city, date, coalesce(state0, state1) state, """ + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), {c}0 + ({c}1 - {c}0) * (date - {c}d0) / nullif({c}d1 - {c}d0, 0), {c}0, {c}1) {c}" for c in CHANNELS
) + " FROM w)"
_ORIGINS = """, ix AS (SELECT date, row_number() OVER (ORDER BY date) - 1 i, count(*) OVER () - 15 l FROM (SELECT DISTINCT date FROM {t})),
origins AS (SELECT date origin FROM ix WHERE (l - i) % 14 = 0 AND i <= l AND i >= 400 AND i > l - 112)"""
_SIMPLE = _FILL + _ORIGINS.format(t="filled") + """, hz AS (SELECT unnest(generate_series(1, 14)) h),
tr AS (SELECT f.city, o.origin, f.date, f.temp_avg y, row_number() OVER (PARTITION BY f.city, o.origin ORDER BY f.date DESC) rn FROM filled f JOIN origins o ON f.date <= o.origin),
b AS (SELECT city, origin, max(CASE WHEN rn = 1 THEN y END) last_y, avg(CASE WHEN rn <= 7 THEN y END) m7 FROM tr GROUP BY 1, 2),
fc AS (SELECT 'naive' model, city, origin, origin + CAST(h AS INT) target_date, h horizon, last_y y_pred FROM b, hz
  UNION ALL SELECT 'seasonal_naive', b.city, origin, origin + CAST(h AS INT), h, coalesce(f.temp_avg, m7) FROM b CROSS JOIN hz LEFT JOIN filled f ON f.city = b.city AND f.date = b.origin + CAST(h AS INT) - 365),
scored AS (SELECT fc.*, f.temp_avg y_true FROM fc JOIN filled f ON f.city = fc.city AND f.date = fc.target_date)"""
#: The four baselines: the climatology of every origin from all its rows, and the anomaly of its last seven.
_BASELINES = _SIMPLE + """, om AS (SELECT city, origin, dayofyear(date) doy, avg(y) m FROM tr GROUP BY 1, 2, 3),
ot AS (SELECT c.city, c.origin, CAST(d AS BIGINT) doy, turn, d + turn t, m FROM (SELECT DISTINCT city, origin FROM tr) c
  CROSS JOIN generate_series(1, 366) g(d) CROSS JOIN (VALUES (-366), (0), (366)) k(turn) LEFT JOIN om ON om.city = c.city AND om.origin = c.origin AND om.doy = d),
ow AS (SELECT *, last_value(m IGNORE NULLS) OVER b v0, last_value(CASE WHEN m IS NOT NULL THEN t END IGNORE NULLS) OVER b t0,
  first_value(m IGNORE NULLS) OVER a v1, first_value(CASE WHEN m IS NOT NULL THEN t END IGNORE NULLS) OVER a t1 FROM ot
  WINDOW b AS (PARTITION BY city, origin ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY city, origin ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
os AS (SELECT city, origin, doy, turn, avg(coalesce(m, v0 + (v1 - v0) * (t - t0) / nullif(t1 - t0, 0), v0, v1))
  OVER (PARTITION BY city, origin ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) clim FROM ow),
oc AS (SELECT * FROM os WHERE turn = 0),
oa AS (SELECT city, origin, avg(y - clim) a FROM tr JOIN oc USING (city, origin) WHERE rn <= 7 AND oc.doy = dayofyear(tr.date) GROUP BY 1, 2),
both_clim AS (SELECT model, oa.city, oa.origin, oa.origin + CAST(h AS INT) target_date, h horizon, clim + a * CASE WHEN decay = 0 THEN 0 ELSE pow(decay, h) END y_pred
  FROM oa CROSS JOIN hz CROSS JOIN (VALUES ('climatology', 0::DOUBLE), ('climatology_persistence', 0.85::DOUBLE)) v(model, decay)
  JOIN oc ON oc.city = oa.city AND oc.origin = oa.origin AND oc.doy = dayofyear(oa.origin + CAST(h AS INT))),
scored_all AS (SELECT * FROM scored UNION ALL SELECT b.*, f.temp_avg FROM both_clim b JOIN filled f ON f.city = b.city AND f.date = b.target_date)"""
_SEASON = "CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) <= 5 THEN 'Pre-monsoon' WHEN month(date) <= 9 THEN 'Monsoon' ELSE 'Post-monsoon' END"
_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_LONG = ", long AS (" + " UNION ALL ".join(f"SELECT '{c}' column_name, CAST({c} AS DOUBLE) v FROM panel" for c in CHANNELS) + ")"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def _corr(x: str, y: str, name: str) -> str:
    return _r(f"CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END", name)


def _profile(period: str) -> str:
    return f"""{_P} SELECT period, n, {_r('mean', 'mean')}, {_r('std', 'std')}, {_r('lo', 'min')}, {_r('med', 'median')}, {_r('hi', 'max')},
      {_r('mean - sum(mean * n) OVER () / sum(n) OVER ()', 'deviation')}
      FROM (SELECT {period} period, count(temp_avg) n, avg(temp_avg) mean, stddev_samp(temp_avg) std, min(temp_avg) lo, quantile_cont(temp_avg, 0.5) med, max(temp_avg) hi FROM panel GROUP BY 1)"""


def oracle_sql() -> dict[str, str]:
    p = _P
    hist = {f"lag{k}": f"lag(y, {k - 1}) OVER b" for k in features.LAGS}
    for w in features.WINDOWS:
        f = f"OVER (PARTITION BY city ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            hist[f"r{name}{w}"] = f"CASE WHEN count(y) {f} >= {max(2, w // 3)} THEN {fn}(y) {f} END"
    hist |= {f"diff{k}": f"y - lag(y, {k}) OVER b" for k in (1, 7)}
    f7, f28 = ("OVER (PARTITION BY city ORDER BY date ROWS BETWEEN %d PRECEDING AND CURRENT ROW)" % (w - 1) for w in (7, 28))
    hist["trend7"] = f"CASE WHEN count(y) {f7} >= 3 THEN avg(y) {f7} END - CASE WHEN count(y) {f28} >= 7 THEN avg(y) {f28} END"
    # an average that starts at the first value: sums of decayed values over so many rows that older ones vanish
    def ewm(span: int) -> str:
        a, rows = 2 / (span + 1), int(36.8 / -math.log1p(-2 / (span + 1))) + 1
        return f"list_reduce(list(temp_avg) OVER (PARTITION BY city ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW), lambda u, v: u + (v - u) * {a!r}::DOUBLE)"

    f7e = "OVER (PARTITION BY city ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    supervised_history = {n: re.sub(r"\by\b", "temp_avg", x) for n, x in hist.items()} | {f"ewm{k}": ewm(k) for k in (7, 30)}
    for c in CHANNELS[1:]:
        supervised_history |= {f"{c}_lag{k}": f"lag({c}, {k - 1}) OVER b" for k in (1, 7, 14)}
    supervised_history |= {f"{c}_rmean7": f"CASE WHEN count({c}) {f7e} >= 3 THEN avg({c}) {f7e} END" for c in CHANNELS[1:]}
    supervised_history |= {"diurnal_range": "temp_max - temp_min", "diurnal_range_rmean7": f"CASE WHEN count(temp_max - temp_min) {f7e} >= 3 THEN avg(temp_max - temp_min) {f7e} END"}
    season = "CAST(CASE WHEN month(date) IN (12, 1, 2) THEN 0 WHEN month(date) <= 5 THEN 1 WHEN month(date) <= 9 THEN 2 ELSE 3 END AS BIGINT)"
    residual = ", r AS (SELECT city, date, temp_avg AS value, temp_avg - avg(temp_avg) OVER (PARTITION BY city, month(date)) resid FROM panel)"
    mad = residual + """, med AS (SELECT city, median(resid) med, stddev_samp(resid) sd FROM r GROUP BY 1), d AS (SELECT r.*, med, sd FROM r JOIN med USING (city)),
      m AS (SELECT city, 1.4826 * median(abs(resid - med)) mad FROM d GROUP BY 1),
      z AS (SELECT city, date, value, (resid - med) / CASE WHEN mad > 1e-9 THEN mad WHEN sd > 1e-9 THEN sd ELSE 1 END z FROM d JOIN m USING (city))"""
    profile = """, t AS (SELECT city, date, temp_avg y, row_number() OVER w - 1 t, count(*) OVER (PARTITION BY city) n, list(temp_avg) OVER (PARTITION BY city ORDER BY date ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING) v FROM panel WINDOW w AS (PARTITION BY city ORDER BY date)),
      nw AS (SELECT city, t, list_transform(v, lambda x: (x - list_avg(v)) / CASE WHEN list_stddev_pop(v) < 1e-8 THEN 1 ELSE list_stddev_pop(v) END) z FROM t WHERE n >= 42 AND len(v) = 14),
      dist AS (SELECT a.city, a.t, min(sqrt(greatest(28 - 2 * list_dot_product(a.z, b.z), 0))) distance FROM nw a JOIN nw b ON a.city = b.city AND abs(a.t - b.t) > 7 GROUP BY 1, 2),
      lim AS (SELECT city, count(*) m, list_sort(list(distance)) ds FROM dist GROUP BY 1),
      thr AS (SELECT city, m, (1 - 10 / m) * (m - 1) pl, ds FROM lim),
      prof AS (SELECT t.city, t.date, distance, coalesce(m > 10 AND distance >= ds[CAST(floor(pl) AS INT) + 1] + (pl - floor(pl)) * (ds[CAST(ceil(pl) AS INT) + 1] - ds[CAST(floor(pl) AS INT) + 1]) - 1e-9, false) flag_profile
        FROM t LEFT JOIN dist USING (city, t) LEFT JOIN thr USING (city))"""
    bands = f""", b AS (SELECT *, abs(resid) e, avg(abs(resid)) OVER w run, row_number() OVER w - 1 t, count(*) OVER (PARTITION BY city) n FROM r WINDOW w AS (PARTITION BY city ORDER BY date)),
      c AS (SELECT *, t % CASE WHEN n >= 730 THEN 365 ELSE greatest(7, n // 3) END ph FROM b),
      k AS (SELECT *, row_number() OVER (PARTITION BY city, ph ORDER BY t) - 1 k, first_value(run) OVER (PARTITION BY city, ph ORDER BY t) run0 FROM c),
      bd AS (SELECT city, date, abs(resid) > 1.96::DOUBLE * pow(1 - {GAMMA}::DOUBLE, k) * (sum({GAMMA}::DOUBLE * e * pow(1 - {GAMMA}::DOUBLE, -k)) OVER (PARTITION BY city, ph ORDER BY t) + (1 - {GAMMA}::DOUBLE) * run0) flag_brutlag FROM k)"""
    votes = mad + bands + profile + """,
      v AS (SELECT city, date, flag_brutlag, coalesce(abs(z) > 2, false) flag_stl, flag_profile FROM bd JOIN z USING (city, date) JOIN prof USING (city, date)),
      voted AS (SELECT *, CAST(flag_brutlag AS BIGINT) + CAST(flag_stl AS BIGINT) + CAST(flag_profile AS BIGINT) n_votes, CAST(flag_brutlag AS INT) + CAST(flag_stl AS INT) + CAST(flag_profile AS INT) >= 2 flag_ensemble FROM v)"""
    flags = ("flag_brutlag", "flag_stl", "flag_profile", "flag_ensemble")
    e = "abs(y_true - y_pred)"
    lags = ", ".join(f"lag(x, {k}) OVER (PARTITION BY city ORDER BY date) l{k}" for k in range(1, 8))
    widths = f""", q AS (SELECT model, horizon, list_sort(list({e})) r, count(*) n FROM scored GROUP BY 1, 2), qa AS (SELECT model, list_sort(list({e})) r, count(*) n FROM scored GROUP BY 1),
      wd AS (SELECT q.model, horizon, q.n, CASE WHEN q.n >= 11 THEN q.r[CAST(ceil(least(1.0, ceil((q.n + 1) * CAST(0.9 AS DOUBLE)) / q.n) * (q.n - 1)) AS INT) + 1]
        ELSE qa.r[CAST(ceil(least(1.0, ceil((qa.n + 1) * CAST(0.9 AS DOUBLE)) / qa.n) * (qa.n - 1)) AS INT) + 1] END width FROM q JOIN qa USING (model))"""
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
    doy = "dayofyear(date)"
    frac = f"2 * pi() * {doy} / dayofyear(make_date(year(date), 12, 31))"
    return {
        "d1_violations": f"{p} SELECT (SELECT count(*) FROM panel) - (SELECT count(*) FROM (SELECT DISTINCT city, date FROM panel)) duplicates, count(*) FILTER (temp_avg < -40 OR temp_avg > 60) out_of_range, count(*) FILTER (temp_min > temp_max) min_over_max FROM panel",
        "d3_gaps": f"{p} SELECT city, CAST(max(date) - min(date) + 1 - count(DISTINCT date) AS BIGINT) missing_days FROM panel GROUP BY 1",
        "d6_cities": f"{p} SELECT DISTINCT city FROM panel",
        "d6_date_range": f"{p} SELECT min(date) first_date, max(date) last_date FROM panel",
        "d7_fill_calendar": f"{p}{_FILL_ALL} SELECT city, date, state, {', '.join(_r(c, c) for c in CHANNELS)} FROM filled",
        "d9_wide": f"{p}{_FILL} SELECT date, " + ", ".join(_r(f"max(temp_avg) FILTER (city = '{c}')", f'"{c}"') for c in CITIES) + " FROM filled GROUP BY 1",
        "d8_city_series": f"WITH panel AS (SELECT * FROM ({PANEL_SQL}) WHERE city = 'N-O'){_FILL} SELECT city, date, {_r('temp_avg', 'temp_avg')} FROM filled",
        "d10_summary": f"{p} SELECT city, count(*) n_obs, {_r('avg(temp_avg)', 'mean')}, {_r('stddev_samp(temp_avg)', 'std')}, {_r('min(temp_avg)', 'min')}, {_r('quantile_cont(temp_avg, 0.05)', 'p05')}, {_r('quantile_cont(temp_avg, 0.5)', 'median')}, {_r('quantile_cont(temp_avg, 0.95)', 'p95')}, {_r('max(temp_avg)', 'max')}, {_r('max(temp_avg) - min(temp_avg)', 'range')} FROM panel GROUP BY 1",
        "d11_split": f"{p} SELECT city, nullif(count(*) FILTER (date <= DATE '2000-01-01'), 0) n_train, nullif(count(*) FILTER (date > DATE '2000-01-01'), 0) n_test FROM panel GROUP BY 1",
        "d12_rolling_origins": f"{p}{_ORIGINS.format(t='panel')} SELECT origin FROM origins",
        "a1_calendar_columns": f"{p} SELECT city, date, year(date) AS year, month(date) AS month, ({list(_MONTHS)})[month(date)] AS month_name, {_SEASON} season FROM panel",
        "a3_dataset_profile": f"{p} SELECT count(*) AS rows, count(DISTINCT city) cities, count(DISTINCT state) states, CAST(max(date) - min(date) + 1 AS BIGINT) AS days, CAST(count(DISTINCT city) * (max(date) - min(date) + 1) AS BIGINT) expected_rows, {_r('100.0 * count(*) / (count(DISTINCT city) * (max(date) - min(date) + 1))', 'completeness_pct')}, count(*) - count(DISTINCT (city, date)) duplicate_rows, CAST({' + '.join(f'count(*) FILTER ({c} IS NULL)' for c in ('city', 'state', 'date', *CHANNELS))} AS BIGINT) missing_cells FROM panel",
        "a4_column_inventory": f"{p} " + " UNION ALL ".join(
            f"SELECT '{c}' column_name, '{k}' dtype, count(*) FILTER ({c} IS NULL) n_missing, {_r(f'100.0 * count(*) FILTER ({c} IS NULL) / count(*)', 'pct_missing')}, count(DISTINCT {c}) n_unique, {_r(f'min({v})', 'min')}, {_r(f'max({v})', 'max')} FROM panel"
            for c, k in (("city", "string"), ("state", "string"), ("date", "date"), *((c, "int" if c == "aqi" else "double") for c in CHANNELS))
            for v in [c if k in ("int", "double") else "CAST(NULL AS DOUBLE)"]
        ),
        "a5_numeric_summary": f"{p}{_LONG}, c AS (SELECT *, v - avg(v) OVER (PARTITION BY column_name) d FROM long WHERE v IS NOT NULL) SELECT column_name, count(*) n, {_r('avg(v)', 'mean')}, {_r('stddev_samp(v)', 'std')}, {_r('min(v)', 'min')}, {_r('quantile_cont(v, 0.25)', 'q25')}, {_r('quantile_cont(v, 0.5)', 'median')}, {_r('quantile_cont(v, 0.75)', 'q75')}, {_r('max(v)', 'max')}, {_r('quantile_cont(v, 0.75) - quantile_cont(v, 0.25)', 'iqr')}, {_r('100 * stddev_samp(v) / nullif(avg(v), 0)', 'cv_pct')}, {_r('avg(d * d * d) / pow(avg(d * d), 1.5)', 'skew')}, {_r('avg(d * d * d * d) / pow(avg(d * d), 2) - 3', 'kurtosis')} FROM c GROUP BY 1",
        "a8_city_profile": f"{p}, m AS (SELECT city, month(date) AS month, avg(temp_avg) m FROM panel GROUP BY 1, 2), a AS (SELECT city, max(m) - min(m) amp, arg_max(month, (m, -month)) hot, arg_min(month, (m, month)) cold FROM m GROUP BY 1) SELECT city, max(state) state, {_r('avg(temp_avg)', 'mean')}, {_r('stddev_samp(temp_avg)', 'std')}, {_r('max(temp_avg) - min(temp_avg)', 'range')}, {_r('min(temp_avg)', 'min')}, {_r('max(temp_avg)', 'max')}, {_r('any_value(amp)', 'seasonal_amplitude')}, any_value(hot) hottest_month, any_value(cold) coldest_month, {_r('avg(temp_max - temp_min)', 'diurnal_range')} FROM panel JOIN a USING (city) GROUP BY 1",
        "a10_rank_cities": f"{p} SELECT city, {_r('m', 'mean')}, row_number() OVER (ORDER BY m DESC, city) AS rank FROM (SELECT city, avg(temp_avg) m FROM panel GROUP BY 1) QUALIFY rank <= 3",
        "a11_monthly_profile": _profile("month(date)"),
        "a11_monthly_profile_of_one": lambda p: descriptive.period_profile(p, F.month("date"), city="N-O"),
        "a11_monthly_profile_of_one": _profile("month(date)").replace("FROM panel GROUP BY 1", "FROM panel WHERE city = 'N-O' GROUP BY 1"),
        "a12_seasonal_profile": _profile(_SEASON),
        "a13_city_month_matrix": f"{p} SELECT city, " + ", ".join(_r(f"avg(temp_avg) FILTER (month(date) = {i})", n) for i, n in enumerate(_MONTHS, 1)) + " FROM panel GROUP BY 1",
        "a14_eta_squared": f"{p}, c AS (SELECT city, temp_avg - avg(temp_avg) OVER (PARTITION BY city) d, avg(temp_avg) OVER (PARTITION BY city, month(date)) mm, avg(temp_avg) OVER (PARTITION BY city) m FROM panel) SELECT city, {_r('max(mm) - min(mm)', 'monthly_range')}, {_r('sum((mm - m) * (mm - m)) / nullif(sum(d * d), 0)', 'eta_squared')}, {_r('100 * sum((mm - m) * (mm - m)) / nullif(sum(d * d), 0)', 'pct_of_variance')} FROM c GROUP BY 1",
        "a16_extreme_days": f"{p} SELECT city, count(*) FILTER (temp_max >= {HOT}) hot_days, {_r(f'100.0 * count(*) FILTER (temp_max >= {HOT}) / count(*)', 'hot_pct')}, count(*) FILTER (temp_min <= {COLD}) cold_days, {_r(f'100.0 * count(*) FILTER (temp_min <= {COLD}) / count(*)', 'cold_pct')} FROM panel GROUP BY 1",
        "a18_heat_spells": f"{p}, f AS (SELECT city, temp_max >= {HOT} f, row_number() OVER (PARTITION BY city ORDER BY date) - sum(CAST(temp_max >= {HOT} AS INT)) OVER (PARTITION BY city ORDER BY date) g FROM panel), s AS (SELECT city, g, count(*) FILTER (f) AS run, count(*) n FROM f GROUP BY 1, 2), t AS (SELECT city, CAST(sum(run) AS BIGINT) hot_days, max(run) longest_run, sum(n) n, sum(run) / sum(n) pr FROM s GROUP BY 1), u AS (SELECT *, CASE WHEN pr > 0 AND pr < 1 THEN ln(n * (1 - pr)) / -ln(pr) ELSE 0 END ex FROM t) SELECT city, hot_days, longest_run, {_r('ex', 'expected_run')}, {_r('longest_run / nullif(ex, 0)', 'clustering')} FROM u",
        "a20_diurnal_profile": f"{p}, d AS (SELECT city, temp_max - temp_min d, cloud_cover, {_SEASON} s FROM panel) SELECT city, {_r('avg(d)', 'mean')}, {_r('stddev_samp(d)', 'std')}, {_r('min(d)', 'min')}, {_r('max(d)', 'max')}, " + ", ".join(_r(f"avg(d) FILTER (s = '{n}')", n.lower().replace("-", "_")) for n in descriptive.SEASONS) + f", {_corr('d', 'cloud_cover', 'corr_cloud')} FROM d GROUP BY 1",
        "a22_channel_correlation": " UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, {_corr(a, b, 'r')} FROM ({PANEL_SQL})" for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1 :]),
        "a22_channel_correlation_ranks": f"{p} " + " UNION ALL ".join(
            f"SELECT '{a}' a, '{b}' b, {_corr('x', 'y', 'r')} FROM (SELECT {rank(a)} x, {rank(b)} y FROM panel)" for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1 :]
        ),
        "a23_cross_city_correlation": f"{p} SELECT a.city city_a, b.city city_b, {_corr('a.temp_avg', 'b.temp_avg', 'r')} FROM panel a JOIN panel b ON a.date = b.date AND a.city < b.city GROUP BY 1, 2",
        "a24_aqi_burden": f"{p}, k AS (SELECT city, CASE WHEN aqi <= 50 THEN 'good' WHEN aqi <= 100 THEN 'satisfactory' WHEN aqi <= 200 THEN 'moderate' WHEN aqi <= 300 THEN 'poor' WHEN aqi <= 400 THEN 'very_poor' ELSE 'severe' END k FROM panel) SELECT city, " + ", ".join(_r(f"100.0 * count(*) FILTER (k = '{n.lower().replace(' ', '_')}') / count(*)", n.lower().replace(" ", "_")) for n, _ in descriptive.AQI_CLASSES) + " FROM k GROUP BY 1",
        "a25_aqi_seasonality": f"{p}, s AS (SELECT city, " + ", ".join(f"round(avg(aqi) FILTER ({_SEASON} = '{n}'), 1) {n.lower().replace('-', '_')}" for n in descriptive.SEASONS) + " FROM panel GROUP BY 1) SELECT *, round(winter - monsoon, 1) winter_minus_monsoon FROM s",
        "f1_autocorrelation": f"{p}, c AS (SELECT city, date, temp_avg - avg(temp_avg) OVER (PARTITION BY city) x FROM panel), l AS (SELECT city, x, {lags} FROM c) " + " UNION ALL ".join(f"SELECT city, CAST({k} AS BIGINT) lag, {_r(f'sum(x * l{k}) / sum(x * x)', 'acf')}, {_r('1.96 / sqrt(count(*))', 'band')} FROM l GROUP BY city" for k in range(1, 8)),
        "f3_year_over_year": f"{p}, y AS (SELECT city, year(date) - min(year(date)) OVER (PARTITION BY city) y, {doy} doy, temp_avg FROM panel), b AS (SELECT city, doy, avg(temp_avg) FILTER (y = 0) a, avg(temp_avg) FILTER (y = 1) b FROM y GROUP BY 1, 2 HAVING a IS NOT NULL AND b IS NOT NULL) SELECT city, count(*) n, {_corr('a', 'b', 'yoy_corr')} FROM b GROUP BY 1",
        "f6_predictability": f"{p}, d AS (SELECT city, temp_avg y, avg(temp_avg) OVER (PARTITION BY city, {doy}) m, lag(temp_avg) OVER (PARTITION BY city ORDER BY date) l FROM panel), s AS (SELECT city, 1 - avg((y - m) * (y - m)) / var_samp(y) s, corr(y, l) r FROM d GROUP BY 1) SELECT city, {_r('s', 'seasonal_r2')}, {_r('r * r', 'lag1_r2')}, {_r('least(1.0, s + r * r)', 'ceiling')} FROM s",
        "x3_calendar_terms": f"{p} SELECT city, date, month(date) AS month, CAST(date - (SELECT min(date) FROM panel) AS BIGINT) time_idx, {doy} doy, CAST(CASE WHEN month(date) IN (12, 1, 2) THEN 0 WHEN month(date) <= 5 THEN 1 WHEN month(date) <= 9 THEN 2 ELSE 3 END AS BIGINT) imd_season, isodow(date) - 1 weekday, {_r(f'sin({frac})', 'sin1')}, {_r(f'cos({frac})', 'cos1')}, {_r(f'sin(2 * {frac})', 'sin2')}, {_r(f'cos(2 * {frac})', 'cos2')} FROM panel",
        "x4_climatology": f"""{p}, m AS (SELECT city, {doy} doy, avg(temp_avg) m FROM panel GROUP BY 1, 2),
          t AS (SELECT c.city, CAST(d AS BIGINT) doy, turn, d + turn t, m FROM (SELECT DISTINCT city FROM panel) c CROSS JOIN generate_series(1, 366) g(d) CROSS JOIN (VALUES (-366), (0), (366)) k(turn) LEFT JOIN m ON m.city = c.city AND m.doy = d),
          w AS (SELECT *, last_value(m IGNORE NULLS) OVER b v0, last_value(CASE WHEN m IS NOT NULL THEN t END IGNORE NULLS) OVER b t0, first_value(m IGNORE NULLS) OVER a v1, first_value(CASE WHEN m IS NOT NULL THEN t END IGNORE NULLS) OVER a t1 FROM t
            WINDOW b AS (PARTITION BY city ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY city ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
          s AS (SELECT city, doy, turn, avg(coalesce(m, v0 + (v1 - v0) * (t - t0) / nullif(t1 - t0, 0), v0, v1)) OVER (PARTITION BY city ORDER BY t ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) clim FROM w)
          SELECT city, doy, {_r('clim', 'clim')} FROM s WHERE turn = 0""",
        "x7_history": f"{p}, y AS (SELECT city, date, temp_avg y FROM panel) SELECT city, date, {_r('y', 'temp_avg')}, " + ", ".join(_r(x, n) for n, x in hist.items()) + " FROM y WINDOW b AS (PARTITION BY city ORDER BY date)",
        "x15_supervised": f"{p}{_FILL}, h AS (SELECT city, date, temp_avg, lag(temp_avg, 6) OVER b l7, lag(temp_avg, 27) OVER b l28, avg(temp_avg) OVER (PARTITION BY city ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) m FROM filled WINDOW b AS (PARTITION BY city ORDER BY date)) SELECT h.city, h.date origin, k horizon, h.date + CAST(k AS INT) target_date, {_r('h.temp_avg', 'lag1')}, {_r('l7', 'lag7')}, {_r('m', 'rmean7')}, {_r('f.temp_avg', 'target')} FROM h CROSS JOIN generate_series(1, 14) g(k) JOIN filled f ON f.city = h.city AND f.date = h.date + CAST(k AS INT) WHERE l28 IS NOT NULL",
        "x15_supervised_features": f"{p}{_FILL_ALL}, h AS (SELECT city, date, temp_avg y, " + ", ".join(f"{x} {n}" for n, x in supervised_history.items()) + " FROM filled WINDOW b AS (PARTITION BY city ORDER BY date)"
        + f"), cal AS (SELECT DISTINCT date, month(date) AS month, {season} imd_season, {doy} doy, isodow(date) - 1 weekday, CAST(date - (SELECT min(date) FROM filled) AS BIGINT) time_idx, sin({frac}) sin1, cos({frac}) cos1, sin(2 * {frac}) sin2, cos(2 * {frac}) cos2 FROM filled) "
        + "SELECT h.city, h.date origin, k horizon, h.date + CAST(k AS INT) target_date, " + ", ".join(_r(f"h.{n}", n) for n in supervised_history)
        + ", cal.month, cal.imd_season, cal.doy, cal.weekday, cal.time_idx, " + ", ".join(_r(f"cal.{n}", n) for n in ("sin1", "cos1", "sin2", "cos2"))
        + f", {_r('f.temp_avg', 'target')} FROM h CROSS JOIN generate_series(1, 1) g(k) JOIN filled f ON f.city = h.city AND f.date = h.date + CAST(k AS INT) JOIN cal ON cal.date = f.date WHERE h.lag28 IS NOT NULL",
        "m4_m5_backtest": f"{p}{_SIMPLE} SELECT model, city, origin, target_date, horizon, {_r('y_pred', 'y_pred')}, {_r('y_true', 'y_true')} FROM scored",
        "v14_by_horizon": f"{p}{_SIMPLE} SELECT model, horizon, {_r(f'avg({e})', 'mae')}, {_r('sqrt(avg(pow(y_true - y_pred, 2)))', 'rmse')}, count(*) n FROM scored GROUP BY 1, 2",
        "b1_walk_forward": f"{p}{_BASELINES} SELECT model, city, origin, target_date, horizon, {_r('y_pred', 'y_pred')}, {_r('y_true', 'y_true')} FROM scored_all",
        "v15_leaderboard_all": f"{p}{_BASELINES} SELECT model, count(*) n, {_r(f'avg({e})', 'mae')}, {_r('sqrt(avg(pow(y_true - y_pred, 2)))', 'rmse')}, {_r('avg(y_pred - y_true)', 'bias')}, {_r('100 * avg(CASE WHEN abs(y_true) > 1e-8 THEN abs((y_true - y_pred) / y_true) END)', 'mape')}, {_r('100 * avg(abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2))', 'smape')}, {_r('1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*))', 'r2')} FROM scored_all GROUP BY 1",
        "v15_leaderboard": f"{p}{_SIMPLE} SELECT model, count(*) n, {_r(f'avg({e})', 'mae')}, {_r('sqrt(avg(pow(y_true - y_pred, 2)))', 'rmse')}, {_r('avg(y_pred - y_true)', 'bias')}, {_r('100 * avg(CASE WHEN abs(y_true) > 1e-8 THEN abs((y_true - y_pred) / y_true) END)', 'mape')}, {_r('100 * avg(abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2))', 'smape')}, {_r('1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*))', 'r2')} FROM scored GROUP BY 1",
        "c1_conformal_widths": f"{p}{_SIMPLE}{widths} SELECT model, horizon, n, {_r('width', 'width')} FROM wd",
        "v12_interval_metrics": f"{p}{_SIMPLE}{widths} SELECT model, {_r('avg(CAST(abs(y_true - y_pred) <= width + 1e-9 AS DOUBLE))', 'coverage')}, {_r('avg(2 * width)', 'mean_width')}, {_r('avg(2 * width + 20 * (greatest(y_pred - width - y_true, 0) + greatest(y_true - y_pred - width, 0)))', 'interval_score')} FROM scored JOIN wd USING (model, horizon) GROUP BY 1",
        "f4_cross_series": f"{p}, c AS (SELECT covar_pop(a.temp_avg, b.temp_avg) / (stddev_pop(a.temp_avg) * stddev_pop(b.temp_avg)) r FROM panel a JOIN panel b ON a.date = b.date AND a.city < b.city GROUP BY a.city, b.city) SELECT {_r('avg(r)', 'mean')}, {_r('median(r)', 'median')}, {_r('max(r)', 'max')}, {_r('min(r)', 'min')}, {_r('avg(CAST(r > 0.5 AS DOUBLE))', 'share_above_half')} FROM c",
        "p8_histogram": f"{p}, x AS (SELECT city, temp_avg x, min(temp_avg) OVER (PARTITION BY city) lo, max(temp_avg) OVER (PARTITION BY city) hi FROM panel), b AS (SELECT city, CAST(least(floor((x - lo) / ((hi - lo) / 10)), 9) AS BIGINT) bin, count(*) n, max((hi - lo) / 10) w FROM x GROUP BY 1, 2) SELECT city, bin, n, {_r('n / (sum(n) OVER (PARTITION BY city) * w)', 'density')} FROM b",
        "p8_density_curves": f"{p}, s AS (SELECT city, avg(temp_avg) m, stddev_samp(temp_avg) sd, min(temp_avg) lo, max(temp_avg) hi FROM panel GROUP BY 1), c AS (SELECT *, lo + (hi - lo) * i / 24 x FROM s, generate_series(0, 24) g(i)) SELECT city, i, {_r('x', 'x')}, {_r('CASE WHEN sd > 0 THEN exp(-0.5 * pow((x - m) / sd, 2)) / (sd * sqrt(2 * pi())) END', 'normal')}, {_r('1 / nullif(hi - lo, 0)', 'uniform')} FROM c",
        "p9_monthly_boxes": f"{p}, q AS (SELECT city, month(date) AS month, quantile_cont(temp_avg, 0.25) a, quantile_cont(temp_avg, 0.5) b, quantile_cont(temp_avg, 0.75) c FROM panel GROUP BY 1, 2), v AS (SELECT q.*, temp_avg, temp_avg BETWEEN a - 1.5::DOUBLE * (c - a) AND c + 1.5::DOUBLE * (c - a) ok FROM panel p JOIN q ON q.city = p.city AND q.month = month(p.date)) SELECT city, month, {_r('a', 'q25')}, {_r('b', 'median')}, {_r('c', 'q75')}, {_r('min(temp_avg) FILTER (ok)', 'whisker_low')}, {_r('max(temp_avg) FILTER (ok)', 'whisker_high')}, count(*) FILTER (NOT ok) outliers FROM v GROUP BY city, month, a, b, c",
        "p11_ecdf": f"{p} SELECT city, date, {_r('temp_avg', 'temp_avg')}, {_r('row_number() OVER (PARTITION BY city ORDER BY temp_avg, date) / count(*) OVER (PARTITION BY city)', 'share')} FROM panel",
        "p14_scatter_fit": f"{p} SELECT city, {_r('regr_slope(temp_avg, humidity)', 'slope')}, {_r('regr_intercept(temp_avg, humidity)', 'intercept')}, {_corr('humidity', 'temp_avg', 'r')}, count(*) n FROM panel GROUP BY 1",
        "p17_city_overview": f"{p} SELECT date, {_r('avg(temp_avg)', 'mean')}, count(temp_avg) n FROM panel GROUP BY 1",
        "b4_pivot_predictions": f"{p}{_SIMPLE} SELECT city, origin, target_date, horizon, {_r('y_true', 'y_true')}, " + ", ".join(_r(f"avg(y_pred) FILTER (model = '{m}')", m) for m in ("naive", "seasonal_naive")) + " FROM scored GROUP BY city, origin, target_date, horizon, scored.y_true",
        "v6_mase_in_one_order": f"{p}{_SIMPLE}, sc AS (SELECT avg(d) s FROM (SELECT abs(temp_avg - lag(temp_avg, 7) OVER (ORDER BY city, date)) d FROM filled)) SELECT model, {_r(f'avg({e}) / any_value(s)', 'mase')} FROM scored, sc GROUP BY 1",
        "v6_mase": f"{p}{_SIMPLE}, sc AS (SELECT avg(d) s FROM (SELECT abs(temp_avg - lag(temp_avg, 7) OVER (PARTITION BY city ORDER BY date)) d FROM filled)) SELECT model, {_r(f'avg({e}) / any_value(s)', 'mase')} FROM scored, sc GROUP BY 1",
        "v13_diebold_mariano": f"""{p}{_SIMPLE}, dl AS (SELECT city, origin, horizon, sum(CASE WHEN model = 'naive' THEN 1 ELSE -1 END * pow(y_true - y_pred, 2)) d FROM scored GROUP BY 1, 2, 3),
          dc AS (SELECT *, avg(d) OVER (PARTITION BY city) m, d - avg(d) OVER (PARTITION BY city) c FROM dl), lg AS (SELECT *, lag(c) OVER (PARTITION BY city ORDER BY origin, horizon) l FROM dc),
          st AS (SELECT city, count(*) n, avg(m) m, greatest(avg(c * c) + avg(c * l), 1e-12) v FROM lg GROUP BY 1)
          SELECT city, n, {_r('m', 'mean_loss_diff')}, {_r('CASE WHEN n >= 10 THEN sqrt((n + 1 - 4 + CAST(2 AS DOUBLE) / n) / n) * m / sqrt(v / n) END', 'dm')} FROM st""",
        "v16_mae_by_city": f"{p}{_SIMPLE} SELECT model, " + ", ".join(_r(f"avg({e}) FILTER (city = '{c}')", f'"{c}"') for c in CITIES) + " FROM scored GROUP BY 1",
        "p5_residual_histogram": f"{p}{_SIMPLE}, x AS (SELECT model, y_true - y_pred x, min(y_true - y_pred) OVER (PARTITION BY model) lo, max(y_true - y_pred) OVER (PARTITION BY model) hi FROM scored), bn AS (SELECT model, CAST(least(floor((x - lo) / ((hi - lo) / 45)), 44) AS BIGINT) bin, count(*) n, max((hi - lo) / 45) w FROM x GROUP BY 1, 2) SELECT model, bin, n, {_r('n / (sum(n) OVER (PARTITION BY model) * w)', 'density')} FROM bn",
        "p5_residual_quantiles": f"{p}{_SIMPLE}, r AS (SELECT model, y_true - y_pred r FROM scored), s AS (SELECT model, avg(r) m, stddev_samp(r) sd FROM r GROUP BY 1) " + " UNION ALL ".join(
            f"SELECT model, {i} i, {_r(f'm + sd * ({NormalDist().inv_cdf((i + 1) / 20)!r}::DOUBLE)', 'expected')}, {_r(f'(SELECT quantile_cont(r, {(i + 1) / 20}) FROM r WHERE r.model = s.model)', 'observed')} FROM s" for i in range(19)
        ),
        "p5_residual_acf": f"{p}{_SIMPLE}, c AS (SELECT model, city, origin, horizon, y_true - y_pred - avg(y_true - y_pred) OVER (PARTITION BY model, city) x FROM scored), l AS (SELECT model, x, " + ", ".join(f"lag(x, {k}) OVER w l{k}" for k in range(1, 41)) + " FROM c WINDOW w AS (PARTITION BY model, city ORDER BY origin, horizon)) "
        + " UNION ALL ".join(f"SELECT model, CAST({k} AS BIGINT) lag, {_r(f'sum(x * l{k}) / sum(x * x)', 'acf')}, {_r('1.96 / sqrt(count(*))', 'band')} FROM l GROUP BY 1" for k in range(1, 41)),
        "p7_coverage_by_horizon": f"{p}{_SIMPLE}{widths} SELECT model, horizon, {_r('avg(CAST(abs(y_true - y_pred) <= width + 1e-9 AS DOUBLE))', 'coverage')}, {_r('avg(2 * width)', 'mean_width')}, {_r('avg(2 * width + 20 * (greatest(y_pred - width - y_true, 0) + greatest(y_true - y_pred - width, 0)))', 'interval_score')} FROM scored JOIN wd USING (model, horizon) GROUP BY 1, 2",
        "b3_models": f"{p}{_SIMPLE} SELECT DISTINCT model FROM scored",
        "b3_for_model": f"{p}{_SIMPLE} SELECT model, city, origin, target_date, horizon, {_r('y_pred', 'y_pred')}, {_r('y_true', 'y_true')} FROM scored WHERE model = 'naive'",
        "m3_scaffold": f"{p}{_FILL}{_ORIGINS.format(t='filled')} SELECT CAST(NULL AS VARCHAR) model, city, origin, origin + CAST(h AS INT) target_date, h horizon, CAST(NULL AS DOUBLE) y_pred FROM (SELECT DISTINCT city FROM filled), origins, generate_series(1, 14) g(h)",
        "n2_mad_scores": f"{p}{mad} SELECT city, date, {_r('value', 'value')}, {_r('z', 'z')}, coalesce(abs(z) > 2, false) flag_mad FROM z",
        "n5_matrix_profile": f"{p}{profile} SELECT city, date, {_r('distance', 'distance')}, flag_profile FROM prof",
        "n6_votes": f"{p}{votes} SELECT * FROM voted",
        "n8_anomalies": f"{p}{votes} SELECT * FROM voted WHERE flag_profile",
        "n9_agreement": f"{p}{votes} " + " UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, count(*) FILTER ({a} AND {b}) n FROM voted" for a in flags for b in flags),
    }
