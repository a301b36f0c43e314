"""Exact quantiles that no single task has to hold (used by R7).

Spark's ``percentile`` keeps every distinct value of a group in one task.  Here
the values are first counted (copies collapse map-side).  Groups of few values
go to ``percentile``.  Of a larger one a bounded sketch cuts the values into
bands of about equal numbers, the bands holding the wanted positions are found
from exact band sizes, and only those are ordered.  The sketch decides how even
the bands are, not the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite

BANDS = 128
FEW = 100_000           # values of a group that one task may hold


def banded(counted: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Add ``_band``: how many of the group's cut points lie below the value."""
    cuts = counted.groupBy(*by).agg(F.approx_percentile(value, [i / BANDS for i in range(1, BANDS)]).alias("_cuts"))
    return (counted.join(cuts, list(by))
            .withColumn("_band", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], few: int = FEW) -> DataFrame:
    """Per group: ``q0, q1, ..`` linearly interpolated, and ``n, lowest, highest``.

    Only finite values count.  Groups without any, and null groups, are absent.
    Groups are counted first, by a job that runs at once: only if one has more
    than ``few`` rows, the plan has a part that cuts the groups of more than
    ``few`` values into bands.
    """
    by = list(by)
    values = df.select(*by, finite(F.col(value).cast("double")).alias("_v")).dropna(subset=[*by, "_v"])
    most = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()[0]
    if (most or 0) <= few:
        return _together(values.withColumn("_n", F.lit(1).cast("long")), by, probs)
    # both parts begin with the same plan, so that its shuffle is done once
    counted = values.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    large = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("_values")).where(F.col("_values") > few).select(*by)
    small = _together(counted.join(large, by, "left_anti"), by, probs)
    return small.unionByName(_of_bands(banded(counted.join(large, by, "left_semi"), by, "_v"), by, probs))


def _together(counted: DataFrame, by: list[str], probs: Sequence[float]) -> DataFrame:
    """The quantiles of values (``_v``, ``_n``) in groups that a task can hold."""
    found = counted.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.min("_v").alias("lowest"), F.max("_v").alias("highest"),
        F.percentile("_v", [float(p) for p in probs], F.col("_n")).alias("_q"))
    return found.select(*by, "n", "lowest", "highest", *[F.get("_q", F.lit(i)).alias(f"q{i}") for i in range(len(probs))])


def _of_bands(counted: DataFrame, by: list[str], probs: Sequence[float]) -> DataFrame:
    """The quantiles of values (``_v``, ``_n``, ``_band``) of which only the bands in question are ordered."""
    bands = counted.groupBy(*by, "_band").agg(
        F.sum("_n").alias("_size"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bands = bands.select(
        *by, "_band",
        F.sum("_size").over(upto).alias("_end"), "_size",
        F.sum("_size").over(whole).alias("n"),
        F.min("_low").over(whole).alias("lowest"),
        F.max("_high").over(whole).alias("highest"),
    )
    # 0-based positions around each quantile, and the weight of the upper one
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    places = [(F.floor(a), F.ceil(a)) for a in at]
    start = F.col("_end") - F.col("_size")
    hit = F.lit(False)
    for low, high in places:
        for place in (low, high):
            hit = hit | ((place >= start) & (place < F.col("_end")))
    wanted = bands.where(hit)

    ordered = Window.partitionBy(*by, "_band").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    near = (
        counted.join(wanted, [*by, "_band"])
        .withColumn("_upto", F.col("_end") - F.col("_size") + F.sum("_n").over(ordered))
    )
    bounds = []
    for i, (low, high) in enumerate(places):
        bounds += [
            F.min(F.when(F.col("_upto") > low, F.col("_v"))).alias(f"_a{i}"),
            F.min(F.when(F.col("_upto") > high, F.col("_v"))).alias(f"_b{i}"),
        ]
    found = near.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("lowest").alias("lowest"),
        F.first("highest").alias("highest"), *bounds)
    weights = [a - F.floor(a) for a in at]
    return found.select(*by, "n", "lowest", "highest", *[
        (F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * w).alias(f"q{i}")
        for i, w in enumerate(weights)
    ])
