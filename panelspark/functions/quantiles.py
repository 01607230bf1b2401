"""Exact quantiles and ranks in groups of any size: values cut into ranges instead of one buffer or window of all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.lineage import written

#: Ranges that a group's values are cut into; each is sorted by itself, for quantiles only those that hold an asked rank.
RANGES = 64


def with_quantiles(stats: DataFrame, rows: DataFrame, keys, value: str, shares: dict[str, float]) -> DataFrame:
    """``stats`` of groups with the columns of ``quantiles`` joined on ``keys``."""
    q = quantiles(rows, keys, value, shares)
    return stats.join(q, list(keys), "left") if keys else stats.crossJoin(F.broadcast(q))  # one row


def _join(a: DataFrame, b: DataFrame, keys: list[str], *on: str) -> DataFrame:
    return a.join(b, [*keys, *on]) if keys or on else a.crossJoin(F.broadcast(b))  # without keys b is one row


def _ranges(rows: DataFrame, keys: list[str], value: str, ranges: int, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(keys, _v, _c, _n, _range)``, the distinct values with their counts, and ``(keys, _range, _held, _n, _start)``, the rows in a range and before it.

    Equal values are counted where they are read; approximate quantiles of the distinct values are the edges.
    They depend on the order in which tasks' sketches merge; with ``once`` they are written, so that both tables have the same.
    """
    counted = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    edges = F.percentile_approx("_v", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(ranges * 20))
    groups = counted.groupBy(*keys).agg(edges.alias("_edges"), F.sum("_c").alias("_n"))
    groups = written(groups, "edges") if once else groups
    dealt = _join(counted, groups, keys).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    held = dealt.groupBy(*keys, "_range").agg(F.sum("_c").alias("_held"), F.max("_n").alias("_n"))
    return dealt, held.withColumn("_start", F.coalesce(F.sum("_held").over(before), F.lit(0)))


def average_ranks(rows: DataFrame, keys, value: str, name: str, ranges: int = RANGES) -> DataFrame:
    """``(keys, value, name)``: each distinct value's average rank from 1 in its group of ``keys`` (one or more, not null).

    Running counts see one row a distinct value of one range. NaN ranks above all numbers; nulls have no row.
    ``rows`` are read more than once and must have the same values each time, to the last bit.
    """
    keys = list(keys)
    dealt, held = _ranges(rows, keys, value, max(2, ranges), once=True)
    inner = Window.partitionBy(*keys, "_range").orderBy("_v")
    upto = F.col("_start") + F.sum("_c").over(inner)
    counted = dealt.drop("_n").join(held.select(*keys, "_range", "_start"), [*keys, "_range"])
    return counted.select(*keys, F.col("_v").alias(value), (upto - (F.col("_c") - 1) / 2).alias(name))


def quantiles(rows: DataFrame, keys, value: str, shares: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """One row a group of ``keys`` (not null) with a linearly interpolated quantile of ``value`` for each of ``shares``.

    The counts of ranges of values say in which range each asked rank lies;
    inside those ranges running counts find it.
    Null values are left out, a group of nulls has no row.
    """
    keys, v = list(keys), F.col("_v")
    dealt, held = _ranges(rows, keys, value, max(2, ranges))
    asked = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("_n") - 1)
        asked += [F.struct(F.lit(name).alias("name"), F.lit(part).alias("part"), f(at).cast("long").alias("rank")) for part, f in (("low", F.floor), ("high", F.ceil))]
    ask = held.withColumn("_ask", F.explode(F.array(*asked))).where((F.col("_ask.rank") >= F.col("_start")) & (F.col("_ask.rank") < F.col("_start") + F.col("_held")))
    wanted = ask.groupBy(*keys, "_range").agg(F.max("_start").alias("_start"), F.collect_list("_ask").alias("_asks"))  # two asks a share
    inner = Window.partitionBy(*keys, "_range").orderBy("_v")
    ranked = _join(dealt, wanted, keys, "_range").withColumn("_upto", F.col("_start") + F.sum("_c").over(inner))
    hit = F.filter("_asks", lambda a: (a["rank"] < F.col("_upto")) & (a["rank"] >= F.col("_upto") - F.col("_c")))
    found = ranked.select(*keys, "_v", "_n", F.explode(hit).alias("_ask"))

    def result(name: str, share: float):
        low, high = (F.max(F.when((F.col("_ask.name") == name) & (F.col("_ask.part") == part), v)) for part in ("low", "high"))
        at = F.lit(float(share)) * (F.max("_n") - 1)
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return found.groupBy(*keys).agg(*[result(n, s) for n, s in shares.items()])
