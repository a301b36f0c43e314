"""Scalar column expressions (X1-X8), all JVM built-ins and ANSI-safe."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a link's host is, and the host prefix its label omits.
HOST_PATTERN = r"(?i)^https?://(?:[^/?#]*@)?([^/?#:]+)"
SCHEME_PATTERN = r"(?i)^https?://"
HOST_PREFIX = "www."


def named(name: str) -> Column:
    """A column by its exact name, dots and reserved words included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def number(df: DataFrame, name: str) -> Column:
    """Lenient number (X5): text that does not parse becomes null."""
    col = named(name)
    return col if is_number(df.schema[name].dataType) else col.try_cast("double")


def real(df: DataFrame, name: str) -> Column:
    """A column as double, unparseable text and NaN becoming null."""
    return F.nanvl(number(df, name).cast("double"), F.lit(None).cast("double"))


def finite(col: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when((col > F.lit(float("-inf"))) & (col < F.lit(float("inf"))), col)


def amount(df: DataFrame, name: str) -> Column:
    """A number to be summed: NaN, infinities and text that does not parse become null."""
    col = number(df, name)
    exact = isinstance(df.schema[name].dataType, (T.IntegralType, T.DecimalType))
    return col if exact else finite(col.cast("double"))


def row_sum(cols: Sequence[Column]) -> Column:
    """Sum across columns of one row, nulls counting as zero."""
    return reduce(add, [F.coalesce(c, F.lit(0)) for c in cols])


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; null where the whole is null or not positive."""
    whole = whole.cast("double")
    return F.try_divide(part.cast("double"), F.when(whole > 0, whole)) * F.lit(100.0)


def per_thousand(part: Column, whole: Column) -> Column:
    """``1000 * part / whole``, null instead of infinity."""
    return F.lit(1000.0) * F.try_divide(part.cast("double"), whole.cast("double"))


def markdown_link(col: Column) -> Column:
    """``[host](href)`` for a URL or a bare host, "" for a blank."""
    text = F.trim(F.coalesce(col.cast("string"), F.lit("")))
    href = F.when(text.rlike(SCHEME_PATTERN), text).otherwise(F.concat(F.lit("https://"), text))
    host = F.lower(F.regexp_extract(href, HOST_PATTERN, 1))
    label = F.replace(F.when(host == "", href).otherwise(host), F.lit(HOST_PREFIX), F.lit(""))
    return F.when(text == "", F.lit("")).otherwise(
        F.concat(F.lit("["), label, F.lit("]("), href, F.lit(")")))


def thousands(col: Column) -> Column:
    """A whole number with thousands separators, cutting decimals off."""
    return F.format_number(col.cast("long"), 0)


# ---- nested fields (E2, E4, E8, E9, X7, X8) ---------------------------------
def struct_type(dtype: T.DataType | None) -> T.StructType | None:
    """The struct behind a struct or list-of-struct type."""
    if isinstance(dtype, T.ArrayType):
        dtype = dtype.elementType
    return dtype if isinstance(dtype, T.StructType) else None


def first_struct(df: DataFrame, name: str) -> tuple[Column | None, T.StructType | None]:
    """A struct column, or the first element of a list of structs."""
    if name not in df.columns:
        return None, None
    dtype = df.schema[name].dataType
    col = F.get(named(name), F.lit(0)) if isinstance(dtype, T.ArrayType) else named(name)
    return col, struct_type(dtype)


def child(parent: Column | None, dtype: T.DataType | None, name: str) -> tuple[Column | None, T.DataType | None]:
    """A field of a struct, or (None, None) where the schema has no such field."""
    if parent is None or not isinstance(dtype, T.StructType) or name not in dtype.names:
        return None, None
    return parent.getField(name), dtype[name].dataType


def or_null(col: Column | None, type_name: str) -> Column:
    """The column, or a typed null where the source lacks it (S3)."""
    return F.lit(None).cast(type_name) if col is None else col
