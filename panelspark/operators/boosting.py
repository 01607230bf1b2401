"""Boosted trees over all series: quantile loss, early stopping, one fit per block of origins.

Spark's own boosting knows the squared and the mean absolute error. Here each
round fits one of Spark's regression trees to the gradient of the quantile loss
and gives every leaf the quantile of its residuals, from mergeable sketches; the
middle quantile is the absolute error. For the tails the gradient is the sign
of the residuals, for the median the residuals themselves within bounds, which
tell a tree more and are as safe against outliers.
With ``patience`` the latest origins are held out and rounds stop when they no
longer improve. That is off by default: beside a climatology the held-out loss
is nearly flat, and boosting would end at once.

The supervised rows of all origins are written once; blocks filter them by the
last date they may know.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.lineage import new_path, written
from panelspark.operators import features
from panelspark.operators.forecast import COLUMNS, checked
from panelspark.operators.models import anomaly_persistence, chronological_split, in_sample_residuals, shrinkage

#: Stands for a missing feature: below every value, so that a tree can part it.
MISSING = -1e6
#: Rows that early stopping needs on either side.
LEAST_VALIDATION, LEAST_TRAINING = 200, 500
#: Features that name single days: trees would learn dates by heart.
IDENTIFIERS = ("doy", "time_idx", "weekday")
#: Rounds between two written tables of rows and scores.
KEEP = 4
#: Share of the first residuals that bounds leave as they are.
WITHIN = 0.9
#: Relative error of leaf quantiles is one over this.
ACCURACY = 2_000


@dataclass
class Boosted:
    """Trees with the value of each of their leaves, after a start value."""

    start: float
    trees: list[tuple[DecisionTreeRegressionModel, dict[float, float]]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def score(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        """``rows(features)`` with ``name``; at most 2 ** depth leaves a tree stand in the plan."""
        total, leaves = F.lit(self.start), []
        for i, (tree, value) in enumerate(self.trees):
            leaf = f"_leaf{i}"
            rows = tree.setLeafCol(leaf).setPredictionCol(f"_mean{i}").transform(rows)
            total = total + _value(F.col(leaf), value)
            leaves += [leaf, f"_mean{i}"]
        return rows.withColumn(name, total).drop(*leaves)


def _value(leaf: Column, value: dict[float, float]) -> Column:
    known = F.create_map(*[F.lit(x) for kv in value.items() for x in kv])
    return F.coalesce(F.try_element_at(known, leaf), F.lit(0.0))


def quantile_loss(residual: Column, q: float) -> Column:
    return F.greatest(residual * q, residual * (q - 1))


def boost(rows: DataFrame, q: float = 0.5, rounds: int = 12, depth: int = 4, step: float = 0.3, patience: int = 0, least: float = 0.01, seed: int = 42) -> Boosted:
    """A model of the ``q`` quantile of ``label`` from ``rows(features, label, validation)``.

    With ``patience`` and enough rows on both sides, boosting ends that many
    rounds after the best loss on validation rows and keeps the rounds up to it;
    else all rows train and all rounds count. A leaf holds ``least`` of the rows
    or more: neighbouring origins and horizons share most of what they say, so a
    small count of rows is hardly one observation. Every KEEP rounds the rows and
    their scores are written, which cuts their lineage.
    """
    sizes = {r["validation"]: r["count"] for r in rows.groupBy("validation").count().collect()} if patience else {}
    held_out = sizes.get(True, 0) >= LEAST_VALIDATION and sizes.get(False, 0) >= LEAST_TRAINING
    trains = ~F.col("validation") if held_out else F.lit(True)
    start = rows.where(trains).agg(F.percentile_approx("label", q, ACCURACY)).first()[0]
    if start is None:
        raise ValueError("no training rows")
    model, residual = Boosted(float(start)), F.col("label") - F.col("prediction")
    gradient = F.lit(q) - (residual < 0).cast("double")
    if q == 0.5:
        bound = rows.where(trains).agg(F.percentile_approx(F.abs(F.col("label") - model.start), WITHIN, ACCURACY)).first()[0]
        gradient = F.greatest(F.least(residual, F.lit(bound)), F.lit(-bound))
    learner = DecisionTreeRegressor(labelCol="gradient", predictionCol="_mean", maxDepth=depth, minWeightFractionPerNode=least, maxBins=64, seed=seed)
    now = rows.withColumn("prediction", F.lit(model.start))
    loss = lambda df: df.where(F.col("validation")).agg(F.avg(quantile_loss(residual, q))).first()[0]
    if held_out:
        model.losses.append(loss(now))
    for k in range(rounds):
        fit = now.where(trains).select("features", "label", "prediction", gradient.alias("gradient"))
        tree = learner.fit(fit).setLeafCol("leaf")
        if tree.numNodes == 1:
            break
        leaves = tree.setPredictionCol("_mean").transform(fit).groupBy("leaf").agg(F.percentile_approx(residual, q, ACCURACY).alias("v")).collect()  # at most 2 ** depth
        value = {float(r["leaf"]): step * float(r["v"]) for r in leaves}
        model.trees.append((tree, value))
        scored = tree.setLeafCol("leaf").setPredictionCol("_mean").transform(now)
        now = scored.withColumn("prediction", F.col("prediction") + _value(F.col("leaf"), value)).drop("leaf", "_mean")
        now = written(now, "boosted") if k % KEEP == KEEP - 1 else now
        if held_out:
            model.losses.append(loss(now))
            best = min(range(len(model.losses)), key=model.losses.__getitem__)
            if k + 1 - best >= patience:
                break
    if held_out:
        best = min(range(len(model.losses)), key=model.losses.__getitem__)
        model.trees, model.losses = model.trees[:best], model.losses[: best + 1]
    return model


def importance(model: Boosted, names: list[str], top: int = 25) -> DataFrame:
    """``(feature, gain, split, gain_pct)`` of the ``top`` features, from the node tables of the fitted trees.

    A node's gain is weighted by its rows; ``split`` counts nodes.
    """
    spark = SparkSession.active()
    nodes = spark.createDataFrame([], "at int, gain double")
    for tree, _ in model.trees:
        path = new_path(spark, "tree")
        tree.write().save(path)
        one = spark.read.parquet(f"{path}/data").where("leftChild >= 0").select(F.col("split.featureIndex").alias("at"), (F.col("gain") * F.col("rawCount")).alias("gain"))
        nodes = nodes.unionAll(one)
    total = nodes.groupBy("at").agg(F.sum("gain").alias("gain"), F.count("*").alias("split"))
    known = spark.createDataFrame(list(enumerate(names)), "at int, feature string")  # one row a feature
    all_gain = total.agg(F.sum("gain").alias("_all"))
    out = total.join(F.broadcast(known), "at").crossJoin(F.broadcast(all_gain))  # one row
    return out.select("feature", "gain", "split", (100 * F.try_divide("gain", "_all")).alias("gain_pct")).orderBy(F.desc("gain"), "feature").limit(top)


@dataclass
class Block:
    """Origins that one fit serves, the last date it may know, and what it gave."""

    origins: list[date]
    until: date
    names: list[str] = field(default_factory=list)
    models: dict[float, Boosted] = field(default_factory=dict)
    training: DataFrame | None = None
    held: DataFrame | None = None
    factors: DataFrame | None = None
    forecasts: DataFrame | None = None


def blocks_of(origins: DataFrame, size: int) -> list[Block]:
    """Origins in order, ``size`` a block; each block knows dates up to its first origin."""
    days = sorted(r["origin"] for r in origins.select("origin").distinct().collect())  # a handful, checked by rolling_origins
    return [Block(days[i : i + size], days[i]) for i in range(0, len(days), size)]


def _dataset(rows: DataFrame, clim: DataFrame, past: DataFrame, rho: float) -> tuple[DataFrame, list[str]]:
    """Rows with label and vector. ``persisted`` is what the last anomaly leaves at the horizon if it decays by ``rho`` a day."""
    rows = features.encodings(rows, clim, past).withColumn("persisted", F.col("anomaly_lag1") * F.pow(F.lit(rho), F.col("horizon")))
    names = ["horizon", *[c for c in rows.columns if c not in (*features.KEYS, *IDENTIFIERS)]]
    # floats as doubles; missing values and NaN stand below all others
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(MISSING)), F.lit(MISSING)) for c in names if c not in ("target_clim", "horizon")}
    rows = rows.withColumns(filled | {"label": F.col("target") - F.col("target_clim")})
    return VectorAssembler(inputCols=names, outputCol="features").transform(rows), names


def fit_blocks(
    panel: DataFrame, origins: DataFrame, horizon: int = 14, quantiles=(0.5,), refit_every: int = 4, validation_days: int = 90, held_days: int = 0,
    channels=("humidity", "pressure", "cloud_cover"), column: str = "temp_avg", **boosting,
) -> list[Block]:
    """Fitted blocks with forecasts ``(city, origin, target_date, horizon, y_pred, q...)`` of their origins.

    Every origin up to a block's first one trains it, if its target is known by
    then. The label is the departure from a climatology fitted on the same
    rows. ``refit_every`` origins share a fit; 1 refits at each.
    ``validation_days`` days of origins stop boosting early where ``patience``
    asks for it; ``held_days`` days before the block neither train nor enter the
    climatology, and stay as ``held`` rows with forecasts of the models.
    """
    panel = checked(panel, (column,))
    rows = written(features.supervised(panel, horizon, column, channels, complete=False, known=False), "supervised")
    lags = " and ".join(f"lag{k} is not null" for k in features.LAGS if k <= features.SHORT)
    out = blocks_of(origins, refit_every)
    for block in out:
        until = F.lit(block.until)
        fitted = F.date_sub(until, held_days)
        past = panel.where(F.col("date") <= fitted)
        clim = written(features.climatology(past, column=column), "climatology")
        persistence = anomaly_persistence(past, clim, column).first()
        rho, sigma = (persistence["rho"] or 0.0, persistence["sigma"] or 1.0) if persistence else (0.0, 1.0)
        known = rows.where((F.col("target_date") <= until) & F.col("target").isNotNull()).where(lags)
        data, block.names = _dataset(known.where(F.col("target_date") <= fitted), clim, past, rho)
        # validation targets may be known only after the split: origins part the rows, as a forecast would see them
        training = chronological_split(data.select("city", "origin", "horizon", "label", "features"), validation_days)
        # every round passes over these rows several times: deal them evenly once, by their key
        block.training = written(training.repartition("city", "origin", "horizon"), "training")
        block.models = {q: boost(block.training.select("features", "label", "validation"), q, **boosting) for q in quantiles}
        middle = min(quantiles, key=lambda q: abs(q - 0.5))
        own = block.models[middle].score(block.training.select("horizon", "features"))
        persists = panel.sparkSession.createDataFrame([(float(rho), float(sigma))], "rho double, sigma double")
        block.factors = shrinkage(own.select(F.lit("gbm").alias("model"), "horizon", F.col("prediction").alias("anomaly")), persists)
        def scored(some: DataFrame) -> DataFrame:
            some, _ = _dataset(some, clim, past, rho)
            for i, q in enumerate(quantiles):
                some = block.models[q].score(some, f"q{i}")
            return some

        block.held = scored(known.where(F.col("origin") > fitted)) if held_days else None
        asked = scored(rows.where(F.col("origin").isin(block.origins)))
        asked = asked.join(F.broadcast(block.factors.select("horizon", "factor")), "horizon")  # one row a horizon
        at = lambda i: F.col("target_clim") + F.col(f"q{i}") * F.col("factor")
        plain = [(F.col("target_clim") + F.col(f"q{i}")).alias(f"p{i}") for i in range(len(quantiles))]
        block.forecasts = asked.select("city", "origin", "target_date", "horizon", *[at(i).alias(f"y{i}") for i in range(len(quantiles))], *plain)
    return out


def _all(blocks: list[Block]) -> DataFrame:
    df = blocks[0].forecasts
    for b in blocks[1:]:
        df = df.unionByName(b.forecasts)
    return df


def boosted(panel: DataFrame, origins: DataFrame, horizon: int = 14, **options) -> DataFrame:
    """Forecasts of the boosted median, shrunk by horizon. Raises ValueError on an empty panel or missing columns."""
    return _all(fit_blocks(panel, origins, horizon, (0.5,), **options)).select(F.lit("gbm").alias("model"), "city", "origin", "target_date", "horizon", F.col("y0").alias("y_pred")).select(*COLUMNS)


def quantile_boosted(panel: DataFrame, origins: DataFrame, horizon: int = 14, coverage: float = 0.9, held_days: int = 90, refit_every: int = 8, **options) -> DataFrame:
    """Boosted median with bounds from boosted quantiles of the tails.

    Trees know their own rows too well, so bounds are moved by what they missed
    on ``held_days`` days that no fit has seen: the ``coverage`` quantile of the
    distance outside (negative inside) over all held rows. Crossed bounds are
    swapped and both enclose the median.
    """
    tail, out = (1 - coverage) / 2, None
    for b in fit_blocks(panel, origins, horizon, (0.5, tail, 1 - tail), held_days=held_days, refit_every=refit_every, **options):
        low, high = F.least("q1", "q2"), F.greatest("q1", "q2")
        missed = F.greatest(low - F.col("label"), F.col("label") - high)
        margin = b.held.agg(F.coalesce(F.percentile_approx(missed, coverage, ACCURACY), F.lit(0.0)).alias("margin")) if held_days else panel.sparkSession.range(1).select(F.lit(0.0).alias("margin"))
        one = b.forecasts.crossJoin(F.broadcast(margin))  # one row
        one = one.withColumns({"lower": F.least("p1", "p2") - F.col("margin"), "upper": F.greatest("p1", "p2") + F.col("margin")})
        out = one if out is None else out.unionByName(one)
    return out.select(
        F.lit("quantile_gbm").alias("model"), "city", "origin", "target_date", "horizon", F.col("y0").alias("y_pred"),
        F.least("y0", "lower").alias("lower"), F.greatest("y0", "upper").alias("upper"),
    )


def training_residuals(block: Block, q: float = 0.5) -> DataFrame:
    """``(city, origin, horizon, residual)`` of a block's training rows, from its fitted model and without factors."""
    return in_sample_residuals(block.models[q].score(block.training), "label")
