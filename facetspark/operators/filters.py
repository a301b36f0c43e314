"""The shared filter contract.

A ``FilterSpec`` becomes one Catalyst predicate plus, when tags are selected,
one left-semi join.  Literals are coerced to the column's type beforehand, so
rank, range and stored-share filters all reach the Parquet scan.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_number, named, number, percent, row_sum
from ..spec import DatasetSpec, FilterSpec, ShareRange, coerce_values, integral_bounds, whole_bounds


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown column(s) {unknown}; have {df.columns}")


def in_values(df: DataFrame, column: str, values: Iterable) -> Column | None:
    """``column IN values`` after coercion; None when no value is usable."""
    dtype = df.schema[column].dataType
    literals = coerce_values(dtype, values)
    if not literals:
        return None
    limits = integral_bounds(dtype)
    if limits is not None:
        literals = [v for v in literals if limits[0] <= v <= limits[1]]
        if not literals:
            return F.lit(False)
    col = named(column)
    return (col if is_number(dtype) or isinstance(dtype, T.StringType) else col.cast("string")).isin(literals)


def in_range(df: DataFrame, column: str, lo: float, hi: float) -> Column:
    """``column BETWEEN lo AND hi``, both ends included; null and NaN fail."""
    dtype = df.schema[column].dataType
    if math.isnan(lo) or math.isnan(hi):
        return F.lit(False)
    if integral_bounds(dtype) is not None:
        whole = whole_bounds(dtype, lo, hi)
        return F.lit(False) if whole is None else named(column).between(*whole)
    inside = number(df, column).between(F.lit(lo), F.lit(hi))
    if hi == math.inf and not isinstance(dtype, T.DecimalType):
        inside &= ~F.isnan(number(df, column).cast("double"))
    return inside


def rank_predicates(df: DataFrame, spec: FilterSpec, ds: DatasetSpec) -> list[Column]:
    """OR inside one facet's list, AND across facets (F1, F8)."""
    require_columns(df, [r for r, values in spec.ranks.items() if values])
    picked = [in_values(df, r, values) for r, values in spec.ranks.items() if values]
    if spec.categories and ds.category:
        require_columns(df, [ds.category])
        picked.append(in_values(df, ds.category, spec.categories))
    return [p for p in picked if p is not None]


def range_predicates(df: DataFrame, spec: FilterSpec) -> list[Column]:
    """Inclusive ranges; columns the table lacks are ignored."""
    return [in_range(df, c, *pair) for c, pair in spec.ranges if c in df.columns]


def entity_share(df: DataFrame, measure: str, ds: DatasetSpec) -> Column:
    """A measure's share of the entity's total, from counts.

    Without a total column the denominator is the sum of all measure counts.
    """
    part = number(df, ds.count_column(measure))
    if ds.total and ds.total in df.columns:
        return percent(part, number(df, ds.total))
    return percent(part, row_sum([number(df, c) for c in ds.count_columns(df.columns)]))


def share_predicates(df: DataFrame, share: ShareRange | None, ds: DatasetSpec) -> list[Column]:
    """The stored share if the table has it, else the computed one."""
    if share is None:
        return []
    if ds.share_column(share.measure) in df.columns:
        return [in_range(df, ds.share_column(share.measure), share.low, share.high)]
    if ds.count_column(share.measure) in df.columns:
        return [entity_share(df, share.measure, ds).between(F.lit(share.low), F.lit(share.high))]
    return []


def filter_rows(df: DataFrame, spec: FilterSpec, ds: DatasetSpec, apply_share: bool = True) -> DataFrame:
    """The part of the contract one row can decide by itself."""
    parts = rank_predicates(df, spec, ds) + range_predicates(df, spec)
    if apply_share:
        parts += share_predicates(df, spec.share, ds)
    return df.where(reduce(and_, parts)) if parts else df


def tag_rows(tags: DataFrame, spec: FilterSpec, ds: DatasetSpec) -> DataFrame:
    """Tag rows that satisfy the level and the value selection at once."""
    require_columns(tags, [ds.tag_key, ds.tag_level, ds.tag_value])
    return selected(tags, spec, ds)


def selected(tags: DataFrame, spec: FilterSpec, ds: DatasetSpec) -> DataFrame:
    """The rows of any table with the tag level and value that the selection names."""
    for column, values in ((ds.tag_level, spec.tag_levels), (ds.tag_value, spec.tag_values)):
        if values:
            tags = tags.where(named(column).isin(list(values)))
    return tags


def spread_join(left: DataFrame, right: DataFrame, on: Mapping[str, str], how: str) -> DataFrame:
    """Join ``left`` columns to ``right`` columns so that a hot key can be split.

    Joining on the keys *and* their hash changes no row, as long as the keys'
    types are the same, which is required.  It makes both inputs come straight
    from shuffles of this join's own, and lets no later grouping by the keys
    count on them: the two conditions under which adaptive execution may cut a
    hot key's left rows into several tasks.
    """
    for a, b in on.items():
        same_type(left, a, right, b)
    equal = [named(a) == right[b] for a, b in on.items()]
    hashes = F.xxhash64(*[named(a) for a in on]) == F.xxhash64(*[right[b] for b in on.values()])
    return left.join(right, reduce(and_, equal) & hashes, how)


def same_type(left: DataFrame, a: str, right: DataFrame, b: str) -> None:
    """Keys of different types would be compared after a cast, or never match: refuse them."""
    types = left.schema[a].dataType, right.schema[b].dataType
    if types[0] != types[1]:
        raise ValueError(f"keys {a!r} and {b!r} have different types: {types[0].simpleString()}, {types[1].simpleString()}")


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys of a table as ``_key``, each once; copies of a hot key collapse map-side."""
    return df.where(named(key).isNotNull()).select(named(key).alias("_key")).distinct()


def keep_keys(df: DataFrame, key: str, keys: DataFrame, keys_column: str, hot: bool = False) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys`` (J1, J2, J3); never multiplies rows.

    The optimizer and adaptive execution choose the join.  An entity's key is
    nearly unique, so entity tables are joined on the key alone, which can use
    a layout by that key; ``hot`` is for tables with many rows of one key.
    """
    right = distinct_keys(keys, keys_column)
    if hot:
        return spread_join(df, right, {key: "_key"}, "left_semi")
    same_type(df, key, right, "_key")
    return df.join(right, named(key) == right["_key"], "left_semi")


def entities_with_tags(tags: DataFrame, spec: FilterSpec, ds: DatasetSpec) -> DataFrame:
    """Entities with at least one tag row matching the selection."""
    return distinct_keys(tag_rows(tags, spec, ds), ds.tag_key).withColumnRenamed("_key", ds.key)


def apply_filters(
    main: DataFrame,
    tags: DataFrame | None,
    spec: FilterSpec,
    ds: DatasetSpec,
    apply_share: bool = True,
) -> DataFrame:
    """The whole contract (F10).  A tag selection matching nothing gives no rows."""
    rows = filter_rows(main, spec, ds, apply_share)
    if not spec.has_tags:
        return rows
    if tags is None:
        raise ValueError("tag filters need the tag table")
    return keep_keys(rows, ds.key, tag_rows(tags, spec, ds), ds.tag_key)


def read_filtered(
    main: DataFrame, tags: DataFrame | None, spec: FilterSpec, ds: DatasetSpec, columns: Iterable[str],
) -> DataFrame:
    """Filtered rows with the existing wanted columns, each once."""
    have = set(main.columns)
    wanted = [c for c in dict.fromkeys(columns) if c in have]
    return apply_filters(main, tags, spec, ds).select(*[named(c) for c in wanted])
