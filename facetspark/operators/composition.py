"""Measure totals and composition by rank.

Sums are taken in wide form, one column per measure, so a group costs one row
per map task however large it is; only the finished groups are unpivoted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import amount, finite, named, real
from ..spec import DatasetSpec, FilterSpec, known_steps
from .filters import apply_filters, require_columns

MISSING_GROUP = "NA"


def _columns(main: DataFrame, wanted: Sequence[str] | None, found: list[str]) -> list[str]:
    return [c for c in wanted if c in main.columns] if wanted else found


def _measure(column: str, suffix: str) -> str:
    return column.removesuffix(suffix)


def _long(wide: DataFrame, ids: list[str], names: list[str], label: str, value: str) -> DataFrame:
    """One row per named column; an empty list gives no rows.

    ``inline`` keeps the partitioning of its input, so sorting the few rows of a
    global aggregate needs no further exchange.
    """
    cells = [F.struct(F.lit(n).alias(label), named(n).cast("double").alias(value)) for n in names]
    none = F.array(F.struct(F.lit("").alias(label), F.lit(0.0).alias(value)))
    rows = wide.select(*ids, F.inline(F.array(*cells) if cells else none))
    return rows if cells else rows.where(F.lit(False))


def _totals(
    main: DataFrame,
    tags: DataFrame | None,
    spec: FilterSpec,
    ds: DatasetSpec,
    count_columns: Sequence[str] | None,
    apply_share: bool,
) -> DataFrame:
    columns = _columns(main, count_columns, ds.count_columns(main.columns))
    names = [_measure(c, ds.count_suffix) for c in columns]
    rows = apply_filters(main, tags, spec, ds, apply_share)
    sums = [F.coalesce(F.sum(amount(rows, c)), F.lit(0)).alias(n) for c, n in zip(columns, names)]
    return _long(rows.agg(*sums) if sums else rows, [], names, "biotype", "count")


def measure_totals(
    main: DataFrame,
    tags: DataFrame | None,
    spec: FilterSpec,
    ds: DatasetSpec,
    count_columns: Sequence[str] | None = None,
    apply_share: bool = True,
) -> DataFrame:
    """(biotype, count) over the filtered rows, largest first (A2)."""
    return _totals(main, tags, spec, ds, count_columns, apply_share).orderBy(F.desc("count"), "biotype")


def measure_means(
    main: DataFrame,
    tags: DataFrame | None,
    spec: FilterSpec,
    ds: DatasetSpec,
    metric: str = "pct",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """(biotype, value): mean stored share, or summed count (A1).

    This summary honours ranks, categories and tags only: ranges and the share
    filter do not apply to it.
    """
    if metric not in ("pct", "count"):
        raise ValueError("metric is 'pct' or 'count'")
    found = ds.share_columns(main.columns) if metric == "pct" else ds.count_columns(main.columns)
    suffix = ds.share_suffix if metric == "pct" else ds.count_suffix
    columns = _columns(main, columns, found)
    narrow = FilterSpec(ranks=spec.ranks, categories=spec.categories,
                        tag_levels=spec.tag_levels, tag_values=spec.tag_values)
    rows = apply_filters(main, tags, narrow, ds)

    def summary(c: str) -> Column:
        value = finite(real(rows, c))
        total = F.avg(value) if metric == "pct" and c.endswith(suffix) else F.sum(value)
        return F.coalesce(total, F.lit(0.0)).alias(_measure(c, suffix))

    wide = rows.agg(*[summary(c) for c in columns]) if columns else rows
    return _long(wide, [], [_measure(c, suffix) for c in columns], "biotype", "value").orderBy(
        F.desc("value"), "biotype")


def _group_sums(
    main: DataFrame,
    tags: DataFrame | None,
    spec: FilterSpec,
    ds: DatasetSpec,
    rank: str,
    count_columns: Sequence[str] | None,
) -> tuple[DataFrame, list[str]]:
    """Per group of a rank: each measure's share of the group's total, in wide form."""
    require_columns(main, [rank])
    columns = _columns(main, count_columns, ds.count_columns(main.columns))
    rows = apply_filters(main, tags, spec, ds)
    group = F.coalesce(named(rank).cast("string"), F.lit(MISSING_GROUP)).alias("group")
    sums = [F.sum(F.coalesce(amount(rows, c), F.lit(0))).cast("double").alias(c) for c in columns]
    has_total = bool(ds.total and ds.total in main.columns)
    if has_total:
        sums.append(F.sum(F.coalesce(amount(rows, ds.total), F.lit(0))).cast("double").alias("_whole"))
    grouped = rows.groupBy(group).agg(*sums) if sums else rows.groupBy(group).count()
    if not has_total:
        whole = reduce(add, [named(c) for c in columns]) if columns else F.lit(0.0)
        grouped = grouped.withColumn("_whole", whole)
    names = [_measure(c, ds.count_suffix) for c in columns]
    shares = [(named(c) / F.col("_whole") * F.lit(100.0)).alias(n) for c, n in zip(columns, names)]
    return grouped.where(F.col("_whole") > 0).select("group", *shares), names


def composition(
    main: DataFrame,
    tags: DataFrame | None,
    spec: FilterSpec,
    ds: DatasetSpec,
    rank: str,
    count_columns: Sequence[str] | None = None,
) -> DataFrame:
    """(group, biotype, value): each measure's percentage of its group's total.

    Without a total column the denominator is the sum of the included counts.
    Null counts are zero; groups whose denominator is not positive are left out.
    """
    wide, names = _group_sums(main, tags, spec, ds, rank, count_columns)
    return _long(wide, ["group"], names, "biotype", "value").orderBy("group", "biotype")


def composition_matrix(
    main: DataFrame,
    tags: DataFrame | None,
    spec: FilterSpec,
    ds: DatasetSpec,
    rank: str,
    count_columns: Sequence[str] | None = None,
) -> DataFrame:
    """Group by measure, missing as 0 (C2): the aggregate before its unpivot."""
    wide, names = _group_sums(main, tags, spec, ds, rank, count_columns)
    return wide.select("group", *[F.coalesce(named(n), F.lit(0.0)).alias(n) for n in names]).orderBy("group")


def measure_order(
    main: DataFrame,
    tags: DataFrame | None,
    spec: FilterSpec,
    ds: DatasetSpec,
    apply_share: bool = False,
) -> DataFrame:
    """(biotype, biotype_rank) by total, largest first.

    One row per measure column of the table, so the window is a handful of rows.
    """
    totals = _totals(main, tags, spec, ds, None, apply_share)
    place = Window.orderBy(F.desc_nulls_last("count"), "biotype")
    return totals.select("biotype", F.row_number().over(place).alias("biotype_rank"))


def composition_ordered(
    main: DataFrame,
    tags: DataFrame | None,
    spec: FilterSpec,
    ds: DatasetSpec,
    rank: str,
    apply_share: bool = False,
) -> DataFrame:
    """Composition with each measure's place in the overall order.

    The order ignores the share filter unless ``apply_share`` is set.
    """
    order = measure_order(main, tags, spec, ds, apply_share)
    # the broadcast side has one row per measure named in the dataset spec
    return composition(main, tags, spec, ds, rank).join(F.broadcast(order), "biotype", "left").select(
        "group", "biotype", "value", "biotype_rank")


def composition_drill(
    main: DataFrame,
    tags: DataFrame | None,
    spec: FilterSpec,
    ds: DatasetSpec,
    path: Sequence[Mapping],
    rank: str | None = None,
) -> DataFrame:
    """Composition below a drill path.

    The grouping is the given rank, else the one under the last step, else
    (H3) the deepest filtered rank, else the broadest one.  Steps without a
    known rank or a value count for nothing.
    """
    last = next((r for r, _ in reversed(known_steps(path, ds))), None)
    rank = rank or ds.next_rank(last) or last or spec.deepest_rank(ds) or ds.ranks[0]
    return composition(main, tags, spec.with_drill(path, ds), ds, rank)


def with_labels(rows: DataFrame, column: str, ds: DatasetSpec, names: Sequence[str]) -> DataFrame:
    """Add ``label`` for the column names held in ``column``."""
    pairs = [part for n in names for part in (F.lit(n), F.lit(ds.label(n)))]
    lookup = F.create_map(*pairs) if pairs else None
    label = F.coalesce(F.try_element_at(lookup, named(column)), named(column)) if pairs else named(column)
    return rows.withColumn("label", label)
