"""Headline figures, extents, breakpoints, tag lists.

Distinct counts are exact and uncapped.  They are taken by listing
(figure, value) pairs, removing copies in a partial/final aggregate and
counting what is left, so one scan serves all ranks and a dominant value
costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import amount, finite, named, number, thousands
from ..spec import DatasetSpec, FilterSpec
from .composition import measure_totals
from .filters import apply_filters, filter_rows, keep_keys, require_columns, spread_join, tag_rows


def matching_entities(
    main: DataFrame, tags: DataFrame | None, spec: FilterSpec, ds: DatasetSpec,
) -> DataFrame:
    """Distinct keys of the entities under the full contract (K2).

    Keys are made distinct before the tag semi join: it then moves keys only.
    """
    keys = filter_rows(main, spec, ds).select(named(ds.key)).where(named(ds.key).isNotNull()).distinct()
    if not spec.has_tags:
        return keys
    if tags is None:
        raise ValueError("tag filters need the tag table")
    return keep_keys(keys, ds.key, tag_rows(tags, spec, ds), ds.tag_key)


def tag_distinct_counts(
    main: DataFrame, tags: DataFrame, spec: FilterSpec, ds: DatasetSpec,
) -> DataFrame:
    """(level, values): distinct tag values among matching entities.

    Every configured level appears, with 0 if it has none.
    """
    entities = apply_filters(main, tags, spec, ds)
    return _tag_counts(entities, tags, ds)


def _tag_counts(entities: DataFrame, tags: DataFrame, ds: DatasetSpec) -> DataFrame:
    level, value = named(ds.tag_level), named(ds.tag_value)
    kept = keep_keys(
        tags.where(level.isin(list(ds.tag_levels)) & value.isNotNull())
        .select(named(ds.tag_key), level.alias("level"), value.alias("value")),
        ds.tag_key, entities, ds.key, hot=not ds.buckets)
    counts = kept.select("level", "value").distinct().agg(*[
        F.count_if(F.col("level") == v).alias(v) for v in ds.tag_levels])
    return _as_rows(counts, ds.tag_levels, "level", "values")


def _as_rows(one_row: DataFrame, names: Sequence[str], label: str, value: str) -> DataFrame:
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias(label), named(n).alias(value)) for n in names])))


def kpi_figures(
    main: DataFrame, tags: DataFrame, spec: FilterSpec, ds: DatasetSpec,
) -> DataFrame:
    """(figure, value) rows: distinct ranks, entities, tags, and the total (K1-K4)."""
    rows = apply_filters(main, tags, spec, ds)
    require_columns(main, ds.ranks)
    total = amount(rows, ds.total).try_cast("long") if ds.total and ds.total in main.columns else F.lit(0).cast("long")
    offers = [F.struct(F.lit(r).alias("figure"), named(r).cast("string").alias("item"),
                       F.lit(None).cast("long").alias("amount")) for r in ds.ranks]
    offers.append(F.struct(F.lit("accessions").alias("figure"), named(ds.key).cast("string").alias("item"),
                           total.alias("amount")))
    items = rows.select(F.inline(F.array(*offers))).groupBy("figure", "item").agg(
        F.sum("amount").alias("amount"))
    names = [*ds.ranks, "accessions"]
    counts = items.agg(
        *[F.count_if((F.col("figure") == n) & F.col("item").isNotNull()).alias(n) for n in names],
        F.coalesce(F.sum("amount"), F.lit(0)).alias("total_genes"))
    return _as_rows(counts, [*names, "total_genes"], "figure", "value").unionByName(
        _tag_counts(rows, tags, ds).toDF("figure", "value"))


def kpi_summary(
    main: DataFrame, tags: DataFrame, spec: FilterSpec, ds: DatasetSpec,
) -> DataFrame:
    """All figures as one row (K6); a figure with nothing under it is 0."""
    figures = kpi_figures(main, tags, spec, ds)
    names = [*ds.ranks, "accessions", *ds.tag_levels, "total_genes"]
    return figures.agg(*[
        F.coalesce(F.max(F.when(F.col("figure") == n, F.col("value"))), F.lit(0)).alias(n) for n in names])


def top_measures(
    main: DataFrame, tags: DataFrame | None, spec: FilterSpec, ds: DatasetSpec,
    k: int = 5, apply_share: bool = False,
) -> DataFrame:
    """The k measures with the largest totals (K5, L2); ignores the share filter."""
    return measure_totals(main, tags, spec, ds, apply_share=apply_share).limit(k)


def top_measures_text(
    main: DataFrame, tags: DataFrame | None, spec: FilterSpec, ds: DatasetSpec, k: int = 5,
) -> DataFrame:
    """The top-k as one line of text (K5, X3).  At most k rows are listed."""
    listed = F.array_sort(F.collect_list(F.struct(
        (-F.col("count")).alias("place"), "biotype",
        F.concat("biotype", F.lit(": "), thousands(F.col("count"))).alias("text"))))
    line = F.concat_ws(" • ", listed.getField("text"))
    return top_measures(main, tags, spec, ds, k).agg(
        F.when(F.count(F.lit(1)) == 0, F.lit("No biotypes under current filters")).otherwise(line).alias("text"))


def extents(main: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, min, max) of numeric columns, null and NaN skipped (M1).

    Whole-number columns are one aggregate of bare columns, all others
    another; an unknown column gives nulls.  Where the caller's session reads
    Parquet by the newer source (``spark.sql.sources.useV1SourceList`` without
    parquet) with ``spark.sql.parquet.aggregatePushdown``, the first is
    answered from file statistics.  Floats are always read, since statistics
    don't tell about NaN.
    """
    wanted = list(dict.fromkeys(columns))
    known = [c for c in wanted if c in main.columns]
    whole = [c for c in known if isinstance(main.schema[c].dataType, T.IntegralType)]
    parts = [_extent_rows(main, [(c, named(c)) for c in whole])] if whole else []
    rest = [c for c in wanted if c not in whole]
    if rest or not whole:
        none = F.lit(None).cast("double")
        parts.append(_extent_rows(main, [(c, F.nanvl(number(main, c).cast("double"), none) if c in known else none) for c in rest]))
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionAll, parts).orderBy(F.array_position(F.array(*map(F.lit, wanted)), F.col("column")))


def _extent_rows(main: DataFrame, values: Sequence[tuple[str, Column]]) -> DataFrame:
    aggs = [f(v).alias(f"_{side}{i}") for i, (_, v) in enumerate(values) for side, f in (("lo", F.min), ("hi", F.max))]
    return main.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_lo{i}").cast("double").alias("min"), F.col(f"_hi{i}").cast("double").alias("max"))
        for i, (c, _) in enumerate(values)
    ])))


def breakpoints(ranges: DataFrame) -> DataFrame:
    """(column, mark): whole-number marks at the quarters of each range (M2).

    Takes ``extents`` rows.  Quarters of the span, rounded half to even, each
    mark once; a reversed range is swapped, a non-finite one gives nothing.
    """
    lo, hi = finite(F.least("min", "max")), finite(F.greatest("min", "max"))
    both = F.col("min").isNotNull() & F.col("max").isNotNull()
    marks = [F.bround(lo + F.lit(f) * (hi - lo)).cast("long") for f in (0.0, 0.25, 0.5, 0.75)]
    marks.append(F.bround(hi).cast("long"))
    return (
        ranges.where(both & lo.isNotNull() & hi.isNotNull())
        .select("column", F.explode(F.array_distinct(F.array(*marks))).alias("mark"))
    )


def _tags_of(tags: DataFrame, entities: DataFrame, levels: Sequence[str], ds: DatasetSpec) -> DataFrame:
    key, level, value = named(ds.tag_key), named(ds.tag_level), named(ds.tag_value)
    wanted = tags.where(
        key.isNotNull() & level.isNotNull() & level.isin([str(v) for v in levels]) & value.isNotNull())
    return keep_keys(wanted.select(key, level, value), ds.tag_key, entities, ds.key, hot=not ds.buckets)


def entity_tags(
    tags: DataFrame, entities: DataFrame, levels: Sequence[str], ds: DatasetSpec,
) -> DataFrame:
    """Distinct (key, level, value) of the given entities."""
    return _tags_of(tags, entities, levels, ds).distinct()


LIST = 100_000          # values of an entity and level that one row, and so one task, may hold


def tags_by_entity(
    tags: DataFrame, entities: DataFrame, levels: Sequence[str], ds: DatasetSpec, as_map: bool = False, parts: int = 1, most: int = LIST,
) -> DataFrame:
    """(key, level, part, values): each entity's sorted tags per level.

    A list is one row, part 0, unless some entity and level has more than
    ``most`` tag rows (counted by a job at once).  The lists of those are cut
    by the ranges of a sort over key, level and value, so that their parts lie
    in several tasks and, one after the other, are the sorted list.  With
    ``parts`` the caller deals every list into so many parts by digest instead.
    With ``as_map``, one row per entity and part with a level -> values map.
    """
    key, level, value = named(ds.tag_key), named(ds.tag_level), named(ds.tag_value)
    kept = _tags_of(tags, entities, levels, ds)
    ids = [ds.tag_key, ds.tag_level]
    listed = F.array_sort(F.collect_set(value)).alias("values")
    counted = tags.groupBy(key, level).agg(F.count(F.lit(1)).alias("_rows"))
    if parts > 1:
        digest = F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")
        lists = kept.groupBy(key, level, (digest % parts).alias("part")).agg(listed)
    elif (counted.agg(F.max("_rows")).first()[0] or 0) <= most:
        lists = kept.groupBy(key, level).agg(listed).select(*map(named, ids), F.lit(0).cast("long").alias("part"), "values")
    else:
        long = counted.where(F.col("_rows") > most).select(key.alias("_key"), level.alias("_level"))
        of_long = {ds.tag_key: "_key", ds.tag_level: "_level"}
        short = spread_join(kept, long, of_long, "left_anti").groupBy(key, level).agg(listed)
        # a partition of the sort holds a range of values; there are at most as many pieces of a list as partitions
        slices = int(tags.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cut = (spread_join(kept, long, of_long, "left_semi").distinct().repartitionByRange(slices, key, level, value)
               .withColumn("_slice", F.spark_partition_id().cast("long")))
        pieces = cut.groupBy(key, level, "_slice").agg(listed)
        place = F.row_number().over(Window.partitionBy(key, level).orderBy("_slice")) - 1
        lists = short.select(*map(named, ids), F.lit(0).cast("long").alias("part"), "values").unionByName(
            pieces.select(*map(named, ids), place.cast("long").alias("part"), "values"))
    if not as_map:
        return lists
    return lists.groupBy(key, "part").agg(
        F.map_from_entries(F.collect_list(F.struct(level, F.col("values")))).alias("tags"))
