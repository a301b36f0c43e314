"""Running sums over rows in random-key order, without a task that holds a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import share_of


def running_before(df: DataFrame, group: str, key: str, weight: Column, name: str) -> DataFrame:
    """Add the sum of ``weight`` over the rows of the same group that come before, in order of ``key``.

    ``key`` is a hex digest, so equal slices of its range hold about equally
    many rows.  With n rows the range is cut into sqrt(n) slices: a task sorts
    one slice of one group, and the slices' sums, sqrt(n) of them for a group,
    are summed up in turn.  ``group`` must not be null.  Rows with equal keys
    keep an arbitrary order among themselves.
    """
    slices = max(1, math.isqrt(df.count()))
    sliced = df.withColumn("_slice", F.floor(share_of(key) * slices).cast("int")).withColumn("_weight", weight)
    within = Window.partitionBy(group, "_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sliced.groupBy(group, "_slice").agg(F.sum("_weight").alias("_total"))
    starts = sums.select(group, "_slice", (F.sum("_total").over(across) - F.col("_total")).alias("_start"))
    local = sliced.withColumn("_local", F.sum("_weight").over(within) - F.col("_weight"))
    return (local.join(starts, [group, "_slice"])
            .withColumn(name, F.col("_start") + F.col("_local")).drop("_slice", "_weight", "_local", "_start"))
