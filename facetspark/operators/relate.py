"""Relationships: scatter sets, trends, point sizes, sampling.

A scatter set is long: one row per point, with ``x_name`` and ``series``.
Fits and sizes group by those two, whose number the caller's column lists
bound; everything per point stays in one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite, named, number, per_thousand, real
from ..spec import DatasetSpec, FilterSpec
from .filters import read_filtered
from .leading import HEARD, Key, leading
from .quantiles import exact_quantiles

SERIES = ("x_name", "series")
CURVE_POINTS = 100

# Point diameters and the quantiles that span them.
SIZE_DEFAULT = 8.0
SIZE_BASE = 6.0
SIZE_GAIN = 10.0
SIZE_QUANTILES = (0.05, 0.95)


def stable_sample(rows: DataFrame, n: int, key_text: str, ds: DatasetSpec, heard: int = HEARD) -> DataFrame:
    """The same n rows for the same key text, on any cluster.

    Rows are ranked by a digest of the text and their key, rows of equal key by
    all their sortable columns; n <= 0 keeps all.  No full sort takes place.
    """
    if n <= 0:
        return rows
    digest = F.md5(F.concat(F.lit(f"{key_text}#"), F.coalesce(named(ds.key).cast("string"), F.lit(""))))
    ties = [named(f.name) for f in rows.schema if f.name != ds.key and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return leading(rows, [Key(c, nulls_first=True) for c in (digest, named(ds.key), *ties)], int(n), heard)


def measure_values(rows: DataFrame, measures: Sequence[str], metric: str, ds: DatasetSpec) -> dict[str, Column]:
    """Y per measure: stored percentage, raw count, or count per 1000 of the total.

    Measures whose column the table lacks are skipped.
    """
    if metric == "percentage":
        found = [m for m in measures if ds.share_column(m) in rows.columns]
        return {m: real(rows, ds.share_column(m)) for m in found}
    found = [m for m in measures if ds.count_column(m) in rows.columns]
    if metric == "raw":
        return {m: real(rows, ds.count_column(m)) for m in found}
    if metric != "per1k":
        raise ValueError("metric is 'percentage', 'raw' or 'per1k'")
    if not ds.total or ds.total not in rows.columns:
        return {m: F.lit(None).cast("double") for m in found}
    whole = number(rows, ds.total)
    return {m: finite(per_thousand(number(rows, ds.count_column(m)), whole)) for m in found}


def scatter(rows: DataFrame, xs: Sequence[str], ys: Mapping[str, Column], ds: DatasetSpec) -> DataFrame:
    """One row per (x column, series, entity) whose x and y are both present."""
    points = [
        F.struct(F.lit(x).alias("x_name"), real(rows, x).alias("x"), F.lit(s).alias("series"), y.alias("y"))
        for x in xs if x in rows.columns for s, y in ys.items()
    ]
    ids = [named(c) for c in dict.fromkeys([ds.title, ds.key]) if c in rows.columns]
    if ds.total and ds.total in rows.columns:
        ids.append(number(rows, ds.total).cast("double").alias("total"))
    if not points:
        none = F.lit(None).cast("double")
        return rows.select(*ids, F.lit("").alias("x_name"), none.alias("x"),
                           F.lit("").alias("series"), none.alias("y")).where(F.lit(False))
    return rows.select(*ids, F.inline(F.array(*points))).dropna(subset=["x", "y"])


def measure_scatter(
    main: DataFrame, tags: DataFrame | None, spec: FilterSpec, ds: DatasetSpec,
    measures: Sequence[str], xs: Sequence[str], metric: str = "percentage",
    point_cap: int = 0, cap_key: str = "",
) -> DataFrame:
    """Measures against environment columns (R2); the point cap precedes the null drop."""
    columns = [ds.key, ds.title, ds.total or ds.key, *xs,
               *map(ds.share_column, measures), *map(ds.count_column, measures)]
    rows = stable_sample(read_filtered(main, tags, spec, ds, columns), point_cap, cap_key, ds)
    return scatter(rows, xs, measure_values(rows, measures, metric, ds), ds)


def metric_scatter(
    main: DataFrame, tags: DataFrame | None, spec: FilterSpec, ds: DatasetSpec,
    metric_column: str, xs: Sequence[str], point_cap: int = 0, cap_key: str = "",
) -> DataFrame:
    """One metric column against environment columns."""
    columns = [ds.key, ds.title, ds.total or ds.key, *xs, metric_column]
    rows = stable_sample(read_filtered(main, tags, spec, ds, columns), point_cap, cap_key, ds)
    ys = {metric_column: real(rows, metric_column)} if metric_column in rows.columns else {}
    return scatter(rows, xs, ys, ds)


def _axis(col: Column, log: bool) -> Column:
    """Finite values; on a log axis the log of the positive ones."""
    value = finite(col.cast("double"))
    return F.when(value > 0, F.log10(value)) if log else value


def trend_fit(
    points: DataFrame, by: Sequence[str] = SERIES, x: str = "x", y: str = "y",
    log_x: bool = False, log_y: bool = False,
) -> DataFrame:
    """Least-squares line per series, in axis units: slope, intercept, x range, n.

    Fewer than two points, or a constant x, give no line.
    """
    ready = points.select(*by, _axis(F.col(x), log_x).alias("_x"), _axis(F.col(y), log_y).alias("_y"))
    ready = ready.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    fit = ready.groupBy(*by).agg(
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.min("_x").alias("x_min"),
        F.max("_x").alias("x_max"),
        F.count(F.lit(1)).alias("n"),
    )
    return fit.where((F.col("n") >= 2) & (F.col("x_min") < F.col("x_max")))


def trend_curve(
    fit: DataFrame, by: Sequence[str] = SERIES, log_x: bool = False, log_y: bool = False,
    points: int = CURVE_POINTS,
) -> DataFrame:
    """The fitted lines at evenly spaced x, both ends included, in data units."""
    last = points - 1
    step = (F.col("x_max") - F.col("x_min")) / F.lit(float(last))
    at = F.when(F.col("i") == last, F.col("x_max")).otherwise(F.col("x_min") + F.col("i") * step)
    line = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("i")).withColumn("_x", at)
    line = line.withColumn("_y", F.col("intercept") + F.col("slope") * F.col("_x"))
    ten = F.lit(10.0)
    return line.select(
        *by, "i",
        (F.pow(ten, F.col("_x")) if log_x else F.col("_x")).alias("x"),
        (F.pow(ten, F.col("_y")) if log_y else F.col("_y")).alias("y"),
    )


def point_sizes(points: DataFrame, by: Sequence[str] = SERIES, total: str = "total") -> DataFrame:
    """Add ``size``: area grows with the total between its outer quantiles, per series."""
    stats = exact_quantiles(points, by, total, SIZE_QUANTILES)
    quantiles_differ = F.col("q1") > F.col("q0")
    stats = stats.select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "n",
        F.when(quantiles_differ, F.col("q0")).otherwise(F.col("lowest")).alias("_lo"),
        F.when(quantiles_differ, F.col("q1")).otherwise(F.col("highest")).alias("_hi"),
    )
    same = [F.col(c) == F.col(f"_by{i}") for i, c in enumerate(by)]
    value = finite(F.col(total).cast("double"))
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1.0))
    part = F.greatest(F.least((value - F.col("_lo")) / span, F.lit(1.0)), F.lit(0.0))
    scaled = F.when(value.isNotNull(), F.lit(SIZE_BASE) + F.lit(SIZE_GAIN) * F.sqrt(part))
    flat = F.col("n").isNull() | (F.col("n") < 2) | (F.col("_hi") <= F.col("_lo"))
    return points.join(stats, same, "left").select(
        *points.columns, F.when(flat, F.lit(SIZE_DEFAULT)).otherwise(scaled).alias("size"))
