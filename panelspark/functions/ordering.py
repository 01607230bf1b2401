"""Lags over one order of all rows, without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the order that one window holds.
STRETCH = 1 << 16


def numbered(df: DataFrame, within: str, *order: str) -> DataFrame:
    """``df`` with ``idx``, the place from 0 in the order of ``within``, then ``order``: places in each group after the rows of all groups before."""
    before = Window.orderBy(within).rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    sizes = df.groupBy(within).agg(F.count("*").alias("_n"))
    starts = sizes.select(F.col(within), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(within).orderBy(*order))
    return df.withColumn("_own", own).join(starts, within).withColumn("idx", F.col("_start") + F.col("_own") - 1).drop("_own", "_start")


def lagged(df: DataFrame, column: str, lags, stretch: int = STRETCH) -> DataFrame:
    """``df(idx)`` with ``l<k>``, the value of ``column`` k places before, for each of ``lags``.

    The order is cut into stretches; the last rows of each are carried to the next.
    """
    far = max(lags, default=0)
    if far <= 0:
        return df
    stretch = max(stretch, far)
    at = F.floor(F.col("idx") / stretch)
    carried = F.when(F.col("idx") % stretch >= stretch - far, F.array(at, at + 1)).otherwise(F.array(at))
    rows = df.withColumn("_stretch", F.explode(carried)).withColumn("_guest", F.col("_stretch") != at)
    by = Window.partitionBy("_stretch").orderBy("idx")
    return rows.withColumns({f"l{k}": F.lag(column, k).over(by) for k in lags}).where(~F.col("_guest")).drop("_stretch", "_guest")
