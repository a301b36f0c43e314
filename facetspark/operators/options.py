"""Option lists: distinct values, cascades, pruning.

Every distinct is a partial/final aggregate, so a value shared by a third of
all rows costs one row per map task.  Lists are complete unless the caller sets
a limit; they then hold the smallest values in sort order and a column
``more`` that says whether any were left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import named
from ..spec import DatasetSpec, FilterSpec, rank_selections
from .filters import apply_filters, in_values, require_columns
from .leading import Key, leading

WINDOWED = 1000         # lists from this length on are not cut by windows, which then keep whole groups


def _listed(values: DataFrame, limit: int | None) -> DataFrame:
    """Sorted values; with a limit the first of them and ``more``."""
    if limit is None:
        return values.orderBy("value")
    # one more than asked for shows whether there are more; the windows see at most that many rows
    place = F.row_number().over(Window.orderBy("value"))
    few = leading(values, [Key(F.col("value"))], limit + 1).withColumn("_place", place)
    more = F.max("_place").over(Window.partitionBy(F.lit(0))) > limit
    return few.withColumn("more", more).where(F.col("_place") <= limit).drop("_place").orderBy("value")


def distinct_values(
    main: DataFrame,
    column: str,
    ds: DatasetSpec,
    spec: FilterSpec = FilterSpec(),
    tags: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Sorted distinct non-null values, as text, under the filters."""
    require_columns(main, [column])
    values = (
        apply_filters(main, tags, spec, ds)
        .select(named(column).cast("string").alias("value"))
        .where(F.col("value").isNotNull())
        .distinct()
    )
    return _listed(values, limit)


def cascaded_options(
    main: DataFrame,
    selections: Mapping[str, Sequence] | None,
    ds: DatasetSpec,
    spec: FilterSpec = FilterSpec(),
    tags: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """(rank, value): each facet's values under the selections of broader facets.

    One scan serves all facets: each row offers its value for every facet whose
    broader selections it satisfies.  Sorted, broad facets first; with a limit there is ``more`` for each rank.
    """
    require_columns(main, ds.facets)
    chosen = rank_selections(ds.facets, selections or {})
    offers, broader = [], []
    for facet in ds.facets:
        value = named(facet).cast("string")
        allowed = F.when(reduce(and_, broader), value) if broader else value
        offers.append(F.struct(F.lit(facet).alias("rank"), allowed.alias("value")))
        picked = in_values(main, facet, chosen.get(facet, ()))
        if picked is not None:
            broader.append(picked)
    options = (
        apply_filters(main, tags, spec, ds)
        .select(F.inline(F.array(*offers)))
        .where(F.col("value").isNotNull())
        .distinct()
    )
    broad_first = [F.array_position(F.array(*map(F.lit, ds.facets)), F.col("rank")), F.col("value")]
    if limit is None:
        return options.orderBy(*broad_first)
    if limit >= WINDOWED:
        few = [leading(options.where(F.col("rank") == r), [Key(F.col("value"))], limit + 1) for r in ds.facets]
        place = F.row_number().over(Window.partitionBy("rank").orderBy("value"))
        options = reduce(DataFrame.unionAll, few).withColumn("_place", place)
        more = F.max("_place").over(Window.partitionBy("rank")) > limit
        return options.withColumn("more", more).where(F.col("_place") <= limit).drop("_place").orderBy(*broad_first)
    # one more than asked for per slice of tasks, then per rank: the last step sees a bounded number of rows of each slice
    slices = int(main.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    options = options.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(slices)))
    for group in (["rank", "_slice"], ["rank"]):
        place = F.row_number().over(Window.partitionBy(*group).orderBy("value"))
        options = options.withColumn("_place", place).where(F.col("_place") <= limit + 1)
    more = F.max("_place").over(Window.partitionBy("rank")) > limit
    options = options.withColumn("more", more).where(F.col("_place") <= limit).drop("_place", "_slice")
    return options.orderBy(*broad_first)


def tag_levels(tags: DataFrame, ds: DatasetSpec, limit: int | None = None) -> DataFrame:
    """Sorted distinct tag levels."""
    return _listed(
        tags.select(named(ds.tag_level).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct(), limit)


def tag_values(
    tags: DataFrame, levels: Sequence[str] | None, ds: DatasetSpec, limit: int | None = None,
) -> DataFrame:
    """Sorted distinct tag values, under the selected levels if any."""
    if levels:
        tags = tags.where(named(ds.tag_level).isin([str(v) for v in levels]))
    return _listed(
        tags.select(named(ds.tag_value).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct(), limit)


def prune_selections(
    main: DataFrame, selections: Mapping[str, Sequence] | None, ds: DatasetSpec,
) -> DataFrame:
    """(rank, value) selections that the cascade still offers.

    Filtering the uncapped options by the selections keeps the work to one
    scan; the selection lists are literals, so nothing is joined.
    """
    chosen = rank_selections(ds.facets, selections or {})
    options = cascaded_options(main, chosen, ds, limit=None)
    return _selected(options, "rank", chosen)


def prune_tag_values(
    tags: DataFrame, levels: Sequence[str] | None, values: Sequence[str] | None, ds: DatasetSpec,
) -> DataFrame:
    """Selected tag values that the selected levels still offer."""
    return tag_values(tags, levels, ds, limit=None).where(F.col("value").isin(list(values or ())))


def _selected(options: DataFrame, name: str, chosen: Mapping[str, Sequence[str]]) -> DataFrame:
    wanted = [(F.col(name) == r) & F.col("value").isin(list(vals)) for r, vals in chosen.items()]
    return options.where(reduce(or_, wanted) if wanted else F.lit(False))
