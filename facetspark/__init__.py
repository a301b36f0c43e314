"""Faceted analytics over wide entity tables, as Spark DataFrame operators."""

from .spec import DatasetSpec, Drill, FilterSpec, ShareRange, SourceLayout

__all__ = ["DatasetSpec", "Drill", "FilterSpec", "ShareRange", "SourceLayout"]
