"""Row browsing: pages, counts, links.

A page is a stretch of the ordered rows, selected by thresholds (``leading``) so
that only what it shows is sorted.  For the next page of a long walk give the
cursor of the last one; for many pages anywhere in a large result write the
numbered rows once with ``write_numbered``.  All three follow one order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal, InvalidOperation
from functools import reduce
from operator import or_
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_number, markdown_link, named
from ..spec import DatasetSpec, FilterSpec, integral_bounds
from .filters import apply_filters, require_columns
from .leading import HEARD, Key, between

_ROW_BITS = 33                     # layout of monotonically_increasing_id


class ColumnFilter(NamedTuple):
    """A filter on one shown column.

    ``op`` is contains, not_contains, equals, not_equal, starts_with,
    ends_with, blank, not_blank, less, at_most, greater, at_least or between.
    Text is compared without regard to case.  A null is only found by blank,
    and by not_contains and not_equal on text.
    """

    column: str
    op: str
    value: Any = None
    upper: Any = None


class AnyOf(NamedTuple):
    """Column filters of which one has to hold, such as the two conditions of one column joined by OR."""

    filters: tuple[ColumnFilter | AnyOf, ...]


class Cursor(NamedTuple):
    """The last shown row by its order, and how many rows equal to it have been shown.

    A page of nothing but equal rows, that isn't the first, doesn't tell how
    many of them came before it.  ``seen`` is then None; ``shown`` rows have
    been shown since ``base`` (None: since the start), and the next page counts.
    """

    values: tuple
    seen: int | None
    shown: int = 0
    base: Cursor | None = None


class Grid(NamedTuple):
    rows: DataFrame
    total: DataFrame


TEXT_OPS = ("contains", "not_contains", "starts_with", "ends_with")
ORDER_OPS = ("equals", "not_equal", "less", "at_most", "greater", "at_least", "between")


def column_predicate(df: DataFrame, f: ColumnFilter | AnyOf) -> Column | None:
    """The filter as a predicate; None when a number column is compared with something that is no number.

    Alternatives that come to None are left out; if all do, so does the whole.
    """
    if isinstance(f, AnyOf):
        tests = [t for t in (column_predicate(df, one) for one in f.filters) if t is not None]
        return reduce(or_, tests) if tests else None
    require_columns(df, [f.column])
    dtype = df.schema[f.column].dataType
    col = named(f.column)
    text = F.lower(col.cast("string"))
    if f.op == "blank":
        return col.isNull() | (F.trim(text) == "")
    if f.op == "not_blank":
        return F.trim(text) != ""
    if f.op in TEXT_OPS:
        wanted = F.lit(str(f.value).lower())
        test = {"contains": F.contains, "not_contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}
        found = test[f.op](text, wanted)
        return F.coalesce(~found, F.lit(True)) if f.op == "not_contains" else found
    if f.op not in ORDER_OPS:
        raise ValueError(f"unknown column filter {f.op!r}")
    if is_number(dtype):
        return _number_predicate(col, dtype, f)
    if isinstance(dtype, T.StringType):
        return _compare(text, f.op, str(f.value).lower(), str(f.upper).lower(), null_differs=True)
    return _compare(col, f.op, f.value, f.upper)


def _compare(col: Column, op: str, value: Any, upper: Any, null_differs: bool = False) -> Column:
    if op == "between":
        return col.between(F.lit(value), F.lit(upper))
    if op == "not_equal":
        return F.coalesce(col != F.lit(value), F.lit(True)) if null_differs else col != F.lit(value)
    test = {"equals": "__eq__", "less": "__lt__", "at_most": "__le__", "greater": "__gt__", "at_least": "__ge__"}
    return getattr(col, test[op])(F.lit(value))


def _number_predicate(col: Column, dtype: T.DataType, f: ColumnFilter) -> Column | None:
    """Compares in the column's own type, so that nothing is cast, every digit counts and the scan sees it."""
    try:
        low = Decimal(str(f.value).strip())
        high = Decimal(str(f.upper).strip()) if f.op == "between" else low
    except InvalidOperation:
        return None
    limits = integral_bounds(dtype)
    if limits is None or low.is_nan() or high.is_nan():
        kind = (lambda x: x) if isinstance(dtype, T.DecimalType) else float
        return _compare(col, f.op, kind(low), kind(high))

    def whole(x: Decimal, up: bool) -> int:
        if x.is_infinite():
            return limits[1] + 1 if x > 0 else limits[0] - 1
        return math.ceil(x) if up else math.floor(x)

    # as [from, to] of whole numbers
    first, last = limits
    if f.op in ("equals", "between", "not_equal"):
        first, last = whole(low, True), whole(high, False)
    elif f.op in ("less", "at_most"):
        last = whole(low, True) - 1 if f.op == "less" else whole(low, False)
    else:
        first = whole(low, False) + 1 if f.op == "greater" else whole(low, True)
    first, last = max(first, limits[0]), min(last, limits[1])
    if f.op == "not_equal":
        return col.isNotNull() if first > last else col != F.lit(first)
    if first > last:
        return F.lit(False)
    return col == F.lit(first) if first == last else col.between(F.lit(first), F.lit(last))


def _order_keys(order_by: Sequence[str], ds: DatasetSpec, columns: Sequence[str]) -> list[tuple[str, bool]]:
    """(column, descending): the sort keys, the entity key, then the shown columns.

    Rows that are equal in all of these look the same, so it does not matter
    which of them a page shows first.
    """
    keys = [(k[1:], True) if k.startswith("-") else (k, False) for k in order_by]
    named_already = {k for k, _ in keys}
    return keys + [(c, False) for c in dict.fromkeys([ds.key, *columns]) if c not in named_already]


def _sort_keys(keys: Sequence[tuple[str, bool]]) -> list[Key]:
    return [Key(named(c), down) for c, down in keys]


def _not_before(keys: Sequence[Key], values: Sequence[Any], strictly: bool = False) -> Column:
    """Rows at or after a place in the order, or strictly ``before`` it if so asked.

    What the first key alone implies is named too, so that the scan can use it.
    """
    equal, found = F.lit(True), []
    for key, value in zip(keys, values):
        found.append(equal & (key.before(value) if strictly else key.after(value)))
        equal = equal & key.equals(value)
    first = keys[0].reach(values[0], strictly)
    return first & reduce(or_, found if strictly else [*found, equal])


def matching_rows(
    main: DataFrame,
    tags: DataFrame | None,
    spec: FilterSpec,
    ds: DatasetSpec,
    column_filters: Sequence[ColumnFilter | AnyOf] = (),
) -> DataFrame:
    rows = apply_filters(main, tags, spec, ds)
    for f in column_filters:
        test = column_predicate(rows, f)
        rows = rows if test is None else rows.where(test)
    return rows


def page_rows(
    main: DataFrame,
    tags: DataFrame | None,
    spec: FilterSpec,
    ds: DatasetSpec,
    columns: Sequence[str],
    page: int = 1,
    page_size: int = 50,
    column_filters: Sequence[ColumnFilter | AnyOf] = (),
    order_by: Sequence[str] = (),
    after: Cursor | None = None,
    heard: int = HEARD,
) -> DataFrame:
    """One 1-based page of filtered rows, in the requested columns (B1, L1).

    Pages before the first count as the first; pages past the end are empty.
    With ``after`` (see ``next_cursor``) the pages count from there, and what
    lies before is not read again.  ``heard`` is as in ``leading.between``,
    which runs its rounds when this is called.
    """
    require_columns(main, columns)
    names = _order_keys(order_by, ds, columns)
    keys = _sort_keys(names)
    rows = matching_rows(main, tags, spec, ds, column_filters)
    start = (max(1, int(page)) - 1) * int(page_size)
    if after is not None:
        start += _seen(rows, keys, after)
        rows = rows.where(_not_before(keys, after.values))
    rows = rows.select(*[named(c) for c in dict.fromkeys([*[k for k, _ in names], *columns])])
    return between(rows, keys, start, int(page_size), heard).select(*[named(c) for c in columns])


def _seen(rows: DataFrame, keys: Sequence[Key], cursor: Cursor) -> int:
    """How many rows equal to the cursor's have been shown; counts what lies between it and its base if it has to."""
    if cursor.seen is not None:
        return cursor.seen
    since = rows.where(_not_before(keys, cursor.values, strictly=True))
    shown = cursor.shown
    if cursor.base is not None:
        since = since.where(_not_before(keys, cursor.base.values))
        shown += _seen(rows, keys, cursor.base)
    return shown - since.count()


def next_cursor(
    shown: Sequence[Row | Mapping], ds: DatasetSpec, columns: Sequence[str], order_by: Sequence[str] = (), after: Cursor | None = None,
    page: int = 1, page_size: int = 50,
) -> Cursor | None:
    """Where the next page starts, from the collected rows of this one; None if it was empty.

    ``after``, ``page`` and ``page_size`` are those that gave this page.  The
    sort keys and the entity key must be among the shown columns.
    """
    names = [c for c, _ in _order_keys(order_by, ds, columns)]
    hidden = [c for c in names if c not in columns]
    if hidden:
        raise ValueError(f"a cursor needs the columns {hidden} to be shown")
    if not shown:
        return None
    values = [tuple(row[c] for c in names) for row in shown]
    seen = next((n for n, v in enumerate(reversed(values)) if v != values[-1]), len(values))
    skipped = (max(1, int(page)) - 1) * int(page_size)
    if seen < len(values) or (skipped == 0 and after is None):
        return Cursor(values[-1], seen)
    if after is not None and after.values == values[-1]:
        # all that the cursor skipped, and what the pages before this one showed, is equal too
        return after._replace(seen=after.seen + skipped + seen) if after.seen is not None else after._replace(shown=after.shown + skipped + seen)
    return Cursor(values[-1], seen) if skipped == 0 else Cursor(values[-1], None, skipped + seen, after)


def write_numbered(rows: DataFrame, ds: DatasetSpec, path: str, order_by: Sequence[str] = ()) -> DataFrame:
    """Write rows with their 1-based ``row_no`` in page order under ``path`` and open them.  Runs two jobs at once.

    A range-partitioned sort is written first; ``monotonically_increasing_id``
    then holds each row's partition and place in it, and adding the sizes of
    the earlier partitions numbers the rows without gathering them anywhere.
    Rows equal in every column are interchangeable and spread at random.
    Pages are then read by ``page_of``, which reaches the row groups it needs.
    """
    order = [*[k.order for k in _sort_keys(_order_keys(order_by, ds, rows.columns))], F.col("_tie")]
    placed = rows.withColumn("_tie", F.rand(7)).orderBy(*order).drop("_tie").withColumn("_id", F.monotonically_increasing_id())
    placed.write.mode("overwrite").parquet(f"{path}/sorted")
    placed = rows.sparkSession.read.parquet(f"{path}/sorted")
    part = F.shiftright("_id", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition of the sort: as many as spark.sql.shuffle.partitions at most
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    numbered = (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("row_no", F.col("_before") + F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1) + 1)
        .drop("_part", "_before", "_id")
    )
    numbered.write.mode("overwrite").parquet(f"{path}/numbered")
    return rows.sparkSession.read.parquet(f"{path}/numbered")


def page_of(numbered: DataFrame, page: int, page_size: int) -> DataFrame:
    """A page of rows numbered by ``write_numbered``, in order."""
    start = (max(1, int(page)) - 1) * int(page_size)
    return (
        numbered.where(F.col("row_no").between(start + 1, start + int(page_size)))
        .orderBy("row_no").drop("row_no")
    )


def count_rows(
    main: DataFrame, tags: DataFrame | None, spec: FilterSpec, ds: DatasetSpec,
    column_filters: Sequence[ColumnFilter | AnyOf] = (),
) -> DataFrame:
    """How many rows match (N1), as one row."""
    return matching_rows(main, tags, spec, ds, column_filters).agg(F.count(F.lit(1)).alias("rows"))


def with_links(rows: DataFrame, ds: DatasetSpec) -> DataFrame:
    """URL columns as markdown links."""
    return rows.select(*[
        markdown_link(named(c)).alias(c) if c in ds.urls else named(c) for c in rows.columns])


def grid(
    main: DataFrame,
    tags: DataFrame | None,
    spec: FilterSpec,
    ds: DatasetSpec,
    columns: Sequence[str] | None = None,
    page: int = 1,
    page_size: int = 50,
    column_filters: Sequence[ColumnFilter | AnyOf] = (),
    order_by: Sequence[str] = (),
    after: Cursor | None = None,
) -> Grid:
    """What the table view shows: a page with links last, and the total, both under its column filters (B2).

    With ``after`` the pages count from a cursor, as in ``page_rows``; the total doesn't.
    """
    shown = ds.display_columns(main.columns, columns)
    rows = page_rows(main, tags, spec, ds, shown, page, page_size, column_filters, order_by, after)
    return Grid(with_links(rows, ds), count_rows(main, tags, spec, ds, column_filters))
