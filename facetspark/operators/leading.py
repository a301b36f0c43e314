"""Rows by their place in an order (L1, L4, L5): the first n, or any page, for every n.

``between`` doesn't sort what it doesn't show.  Histograms of the first sort
key, refined round by round around the wanted place, give the bin in which it
lies; when one value fills a bin, the next key goes on inside it.  The rows up
to that bin then pass a filter on the keys, which reaches the scan, and only
they are ordered: the wanted rows and a bin at each end.

A round is two aggregates over the keys: even cut points from a bounded sketch,
then exact counts between them.  The driver sees the counts of ``2 * CUTS + 2``
bins.  Where all tasks together would send no more than ``HEARD`` rows to the
last one, they send their first rows at once and no round is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_
from os.path import commonprefix
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUTS = 31
HEARD = 100_000         # rows that the last task may hear of
_WINDOW = 6             # bytes of a text that one round tells apart


def _nan(value: Any) -> bool:
    return isinstance(value, float) and value != value


class Key(NamedTuple):
    """A sort key."""

    col: Column
    down: bool = False
    nulls_first: bool = False

    @property
    def order(self) -> Column:
        if self.nulls_first:
            return self.col.desc_nulls_first() if self.down else self.col.asc_nulls_first()
        return self.col.desc_nulls_last() if self.down else self.col.asc_nulls_last()

    def equals(self, value: Any) -> Column:
        if value is None:
            return self.col.isNull()
        return F.isnan(self.col) if _nan(value) else self.col == F.lit(value)

    def before(self, value: Any) -> Column:
        """Rows that come strictly before a value in the order of this key.

        NaN, the greatest number, is asked for by name: column statistics, which
        may spare a scan a comparison, don't count it.
        """
        if value is None:
            return F.lit(False) if self.nulls_first else self.col.isNotNull()
        if _nan(value):
            first = F.lit(False) if self.down else ~F.isnan(self.col)
        elif self.down:
            first = self.col > F.lit(value)
            first = first | F.isnan(self.col) if isinstance(value, float) else first
        else:
            first = self.col < F.lit(value)
        return first | self.col.isNull() if self.nulls_first else first

    def after(self, value: Any) -> Column:
        return Key(self.col, not self.down, not self.nulls_first).before(value)

    def reach(self, value: Any, before: bool) -> Column:
        """Rows at a value or ``before`` it (else after it): one comparison that a scan can use."""
        if value is None or _nan(value):
            return (self.before(value) if before else self.after(value)) | self.equals(value)
        if self.down != before:
            side = self.col <= F.lit(value)
        else:
            side = self.col >= F.lit(value)
            side = side | F.isnan(self.col) if isinstance(value, float) else side
        return side | self.col.isNull() if self.nulls_first == before else side


class Bin(NamedTuple):
    """Rows with equal values in some keys and, in the next one, values from ``first`` to ``last``."""

    equal: tuple[Any, ...]
    span: tuple[Any, Any] | None
    passed: int             # rows before the bin
    rows: int

    def _side(self, keys: Sequence[Key], end: bool) -> Column:
        """Rows not after the bin's end, or not before its start."""
        tests, same = [], F.lit(True)
        for key, value in zip(keys, self.equal):
            tests.append(same & (key.before(value) if end else key.after(value)))
            same = same & key.equals(value)
        if self.span is not None:
            key = keys[len(self.equal)]
            same = same & key.reach(self.span[1] if end else self.span[0], end)
        bounds = [*self.equal, *([self.span[1] if end else self.span[0]] if self.span else [])]
        implied = keys[0].reach(bounds[0], end) if bounds else F.lit(True)
        return implied & reduce(or_, [*tests, same])

    def not_after(self, keys: Sequence[Key]) -> Column:
        return self._side(keys, True)

    def not_before(self, keys: Sequence[Key]) -> Column:
        return self._side(keys, False)


def _code(col: Column, dtype: T.DataType, depth: int) -> Column:
    """A number, date or time in the order of the key; of texts that share ``depth`` bytes the next few."""
    if isinstance(dtype, T.StringType):
        part = F.substring(F.encode(col, "UTF-8"), depth + 1, _WINDOW)
        return F.conv(F.rpad(F.hex(part), 2 * _WINDOW, "0"), 16, 10).cast("long")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(col, F.lit(None).cast(dtype))
    return col.cast("int") if isinstance(dtype, T.BooleanType) else col


def _place(code: Column, cuts: Sequence[Any], low: int, high: int) -> Column:
    """The number of a value's bin: 2 i lies below cut i and above the one before, 2 i + 1 is cut i."""
    if low == high:
        return F.lit(2 * low)
    middle = (low + high) // 2
    cut = F.lit(cuts[middle])
    return (F.when(code == cut, F.lit(2 * middle + 1)).when(code < cut, _place(code, cuts, low, middle))
            .otherwise(_place(code, cuts, middle + 1, high)))


def _measurable(dtype: T.DataType) -> bool:
    text = isinstance(dtype, T.StringType) and dtype.collation in (None, "UTF8_BINARY")
    return text or isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))


def _histogram(rows: DataFrame, key: Key, depth: int) -> list[tuple[int, Any, Any]]:
    """(rows, first, last) of consecutive bins in the order of the key; its nulls are a bin."""
    dtype = rows.select(key.col.alias("k")).schema[0].dataType
    values = rows.select(key.col.alias("k"), _code(key.col, dtype, depth).alias("c"))
    cuts = values.agg(F.approx_percentile("c", [i / (CUTS + 1) for i in range(1, CUTS + 1)], 2000)).first()[0] or []
    cuts = list(dict.fromkeys(cuts))
    # NaN, which has no code, comes after all numbers
    place = (F.when(F.col("k").isNull(), -1).when(F.col("c").isNull(), 2 * len(cuts) + 1)
             .otherwise(_place(F.col("c"), cuts, 0, len(cuts))))
    counts = values.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
    found = counts.agg(F.collect_list(F.struct("bin", "n", "low", "high"))).first()[0]
    filled = sorted((r for r in found if r.bin >= 0), key=lambda r: r.bin, reverse=key.down)
    bins = [(r.n, r.high, r.low) if key.down else (r.n, r.low, r.high) for r in filled]
    nulls = [(r.n, None, None) for r in found if r.bin < 0]
    return nulls + bins if key.nulls_first else bins + nulls


def locate(rows: DataFrame, keys: Sequence[Key], place: int, room: int) -> Bin | None:
    """The bin that holds the row of a 1-based place: ``room`` rows at most, unless they are equal in all keys that have a histogram.

    None if there are fewer rows.  Runs the rounds at once.
    """
    at = Bin((), None, 0, -1)
    depth = 0
    types = [f.dataType for f in rows.select(*[k.col.alias(f"k{i}") for i, k in enumerate(keys)]).schema]
    while at.rows < 0 or at.rows > room:
        if len(at.equal) == len(keys) or not _measurable(types[len(at.equal)]):
            return at
        inside = rows
        if at.rows >= 0:
            inside = rows.where(at.not_after(keys) & at.not_before(keys))
        passed = at.passed
        for n, first, last in _histogram(inside, keys[len(at.equal)], depth):
            if passed + n >= place:
                break
            passed += n
        else:
            return None
        one = first == last or (_nan(first) and _nan(last))
        at = Bin((*at.equal, first), None, passed, n) if one else Bin(at.equal, (first, last), passed, n)
        text = isinstance(first, str) and not one
        depth = len(commonprefix([first.encode(), last.encode()])) if text else 0
    return at


def _tasks(rows: DataFrame) -> int:
    """About how many tasks read the rows, by the optimizer's estimate of their size."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    part = rows.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(1, -(-size // part))


def stretch(rows: DataFrame, keys: Sequence[Key], start: int, n: int, room: int | None = None) -> tuple[DataFrame, int]:
    """The rows of the bins from place ``start`` + 1 to ``start`` + ``n``, and how many of them come before that place.

    Runs the rounds at once; ``room`` is the size of a bin, ``n`` (1,000 at least) by default.
    """
    room = max(n, 1000) if room is None else room
    low = locate(rows, keys, start + 1, room)
    if low is None:
        return rows.where(F.lit(False)), 0
    high = locate(rows, keys, start + n, room)
    inside = rows.where(low.not_before(keys))
    return inside if high is None else inside.where(high.not_after(keys)), start - low.passed


def between(rows: DataFrame, keys: Sequence[Key], start: int, n: int, heard: int = HEARD, room: int | None = None) -> DataFrame:
    """``n`` rows in order, after the first ``start``.

    Rows equal in all keys are interchangeable.  With ``heard`` = 0 the rows
    are always selected by thresholds.  Binary and nested keys have no
    histogram: from the first of them on a bin stays whole.
    """
    skip = start
    histogram = n > 0 and _measurable(rows.select(keys[0].col.alias("k")).schema[0].dataType)
    if histogram and (start + n) * _tasks(rows) > heard:
        rows, skip = stretch(rows, keys, start, n, room)
    return rows.orderBy(*[k.order for k in keys]).offset(skip).limit(n)


def leading(rows: DataFrame, keys: Sequence[Key], n: int, heard: int = HEARD, room: int | None = None) -> DataFrame:
    """The first ``n`` rows, in order."""
    return between(rows, keys, 0, n, heard, room)
