"""Nested source -> flat tables.

The entity table is one projection: no shuffle, no Python.  Looking a measure
up in its array uses ``array_position`` on the reversed key list rather than
lambda functions, which keeps the expression in generated code.  The tag and
child tables explode their arrays and shuffle once, for the distinct; copies
of a row collapse in the map-side half of that aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import child, first_struct, named, or_null
from ..sources.tables import (
    FacetTables,
    existing,
    open_main,
    open_table,
    publish,
    read_tables,
    version_folder,
    write_children,
    write_main,
    write_tags,
)
from ..spec import DatasetSpec, SourceLayout


def build_main(source: DataFrame, layout: SourceLayout, ds: DatasetSpec, also: Sequence[str] = ()) -> DataFrame:
    """The wide entity table, one output row per source row, in a fixed order; columns in ``also`` come last, as they are."""
    wanted = [
        *also,
        layout.key, layout.rank_struct, layout.measure_array, layout.grid_struct,
        layout.url_struct, *layout.plain,
        *[column for column, _, _ in layout.flat_stats],
        *[column for column, _, _ in layout.grouped_stats],
    ]
    source = existing(source, wanted)
    front = [
        _key(source, layout),
        *_ranks(source, layout, ds),
        *[_plain(source, c, layout.plain_type).alias(c) for c in layout.plain],
        *_grid(source, layout),
        *_urls(source, layout),
    ]
    return source.select(
        *front, *_measures(source, layout, ds), *_flat_stats(source, layout),
        *_grouped_stats(source, layout), *[named(c) for c in also])


def _key(source: DataFrame, layout: SourceLayout) -> Column:
    """The entity key as text, in all three tables, whatever the source holds."""
    return _plain(source, layout.key, "string").cast("string").alias(layout.key)


def _plain(source: DataFrame, name: str, type_name: str) -> Column:
    return or_null(named(name) if name in source.columns else None, type_name)


def _ranks(source: DataFrame, layout: SourceLayout, ds: DatasetSpec) -> list[Column]:
    parent, dtype = first_struct(source, layout.rank_struct)
    fallback = {ds.id_facet: "long"}
    return [
        or_null(child(parent, dtype, f)[0], fallback.get(f, "string")).alias(f)
        for f in layout.rank_fields
    ]


def _grid(source: DataFrame, layout: SourceLayout) -> list[Column]:
    parent, dtype = first_struct(source, layout.grid_struct)
    out = []
    for var in layout.grid_vars:
        block = child(parent, dtype, var)
        for stat in layout.grid_stats:
            out.append(or_null(child(*block, stat)[0], "double")
                       .alias(f"{layout.grid_prefix}_{var}_{stat}"))
    return out


def _urls(source: DataFrame, layout: SourceLayout) -> list[Column]:
    parent, dtype = first_struct(source, layout.url_struct)
    return [or_null(child(parent, dtype, f)[0], "string").alias(c) for f, c in layout.url_fields]


def _measures(source: DataFrame, layout: SourceLayout, ds: DatasetSpec) -> list[Column]:
    """Total, then count and share per measure, from the measure array.

    The last entry of a repeated measure wins, so entries are searched from
    the end: the first hit in the reversed array is the last one.  ``get``
    returns null for position -1, which is what an absent key gives.
    """
    entries = None
    if layout.measure_array in source.columns:
        element = source.schema[layout.measure_array].dataType.elementType
        entries = F.reverse(named(layout.measure_array))

    def values(name: str) -> Column | None:
        return entries.getField(name) if entries is not None and name in element.names else None

    keys, counts, shares = (
        values(n) for n in (layout.measure_key, layout.measure_count, layout.measure_share))

    def pick(column: Column | None, measure: str) -> Column | None:
        if column is None or keys is None:
            return None
        return F.get(column, (F.array_position(keys, measure) - 1).cast("int"))

    total = None
    if ds.total and values(layout.measure_total) is not None:
        # distinct keeps first appearances and folds all nulls into one entry,
        # so the first total is in one of the first two places
        seen = F.array_distinct(named(layout.measure_array).getField(layout.measure_total))
        total = F.coalesce(F.get(seen, F.lit(0)), F.get(seen, F.lit(1)))

    out = [or_null(total, "long").cast("long").alias(ds.total)] if ds.total else []
    for measure in ds.measures:
        out.append(or_null(pick(counts, measure), "long").cast("long").alias(ds.count_column(measure)))
        out.append(or_null(pick(shares, measure), "float").cast("float").alias(ds.share_column(measure)))
    return out


def _flat_stats(source: DataFrame, layout: SourceLayout) -> list[Column]:
    out = []
    for column, prefix, fields in layout.flat_stats:
        parent, dtype = first_struct(source, column)
        out += [or_null(child(parent, dtype, f)[0], "double").alias(f"{prefix}_{f}") for f in fields]
    return out


def _grouped_stats(source: DataFrame, layout: SourceLayout) -> list[Column]:
    out = []
    for column, prefix, groups in layout.grouped_stats:
        parent, dtype = first_struct(source, column)
        for source_group, group, fields in groups:
            block = child(parent, dtype, source_group)
            out += [or_null(child(*block, f)[0], "double").alias(f"{prefix}_{group}_{f}")
                    for f in fields]
    return out


def build_tags(source: DataFrame, layout: SourceLayout, ds: DatasetSpec) -> DataFrame:
    """Distinct (entity, level, value) rows, each level on its own.

    Exploding step by step drops null lists, null inner lists and null strings
    without lambda functions, at any nesting depth.
    """
    names = (ds.tag_key, ds.tag_level, ds.tag_value)
    parent, dtype = first_struct(source, layout.tag_struct)
    levels = []
    for level in ds.tag_levels:
        lists, list_type = child(*child(parent, dtype, level), layout.tag_values)
        if lists is not None:
            levels.append((level, lists, list_type))
    if not levels or layout.key not in source.columns:
        return source.sparkSession.createDataFrame([], ", ".join(f"`{n}` string" for n in names))

    key = named(layout.key).cast("string").alias(names[0])
    long = source.where(named(layout.key).isNotNull()).select(
        key,
        F.inline(F.array(*[
            F.struct(F.lit(level).alias(names[1]), lists.alias(names[2]))
            for level, lists, _ in levels
        ])))
    element = levels[0][2]
    while isinstance(element, T.ArrayType):
        long = long.select(names[0], names[1], F.explode(names[2]).alias(names[2]))
        element = element.elementType
    return (
        long.where(F.col(names[2]).isNotNull())
        .select(names[0], names[1], F.col(names[2]).cast("string").alias(names[2]))
        .distinct()
    )


def build_children(source: DataFrame, layout: SourceLayout) -> DataFrame:
    """One distinct row per child record, nested place names flattened."""
    if layout.child_array not in source.columns:
        return source.sparkSession.createDataFrame(
            [], ", ".join(f"`{c}` string" for c in layout.child_columns))
    record_type = source.schema[layout.child_array].dataType.elementType
    records = source.select(
        _key(source, layout),
        F.explode(named(layout.child_array)).alias("_record"),
    ).where(F.col("_record").isNotNull())

    record = F.col("_record")
    columns = {layout.key: named(layout.key)}
    for f in layout.child_fields:
        columns[f] = or_null(child(record, record_type, f)[0], "string")
    place = child(record, record_type, layout.child_place)
    for level in layout.child_place_levels:
        name, _ = child(*child(*place, level), layout.child_place_field)
        columns[f"{layout.child_place}_{level}_{layout.child_place_field}"] = or_null(name, "string")
    return records.select(*[columns[c].alias(c) for c in layout.child_columns]).distinct()


def build_all(
    source: DataFrame,
    layout: SourceLayout,
    ds: DatasetSpec,
    tag_source: DataFrame | None = None,
    child_source: DataFrame | None = None,
) -> FacetTables:
    """All three tables, lazily.

    Tags and children may come from tables of their own, for instance when an
    entity has too many of them to sit in one nested row.
    """
    return FacetTables(
        build_main(source, layout, ds),
        build_tags(source if tag_source is None else tag_source, layout, ds),
        build_children(source if child_source is None else child_source, layout),
    )


def staged(source: DataFrame, layout: SourceLayout, ds: DatasetSpec) -> tuple[DataFrame, list[str]]:
    """The entity table with the nested columns of the other two beside it, and the names of those."""
    main = build_main(source, layout, ds)
    nested = [c for c in dict.fromkeys([layout.tag_struct, layout.child_array]) if c in source.columns]
    if clash := [c for c in nested if c in main.columns]:
        raise ValueError(f"nested column(s) {clash} have names of the entity table")
    return build_main(source, layout, ds, also=nested), nested


def run_etl(
    spark: SparkSession,
    source_path: str,
    out_dir: str,
    layout: SourceLayout,
    ds: DatasetSpec,
    cluster_by: tuple[str, ...] = (),
) -> FacetTables:
    """Read one nested source, write the three flat tables, publish and open them (S6, E15).  Runs the jobs at once.

    The source is read once: the entity table is written with the nested
    columns of the other two, which are made from there; a scan of the entity
    table doesn't touch them, and ``read_tables`` hides them.
    """
    version = uuid4().hex
    folder = version_folder(out_dir, version)
    records, hidden = staged(open_table(spark, source_path), layout, ds)
    write_main(records, folder, ds, cluster_by)
    records = open_main(spark, folder, ds)
    write_tags(build_tags(records, layout, ds), folder, ds)
    write_children(build_children(records, layout), folder, ds)
    publish(spark, out_dir, version, ds.buckets, hidden)
    return read_tables(spark, out_dir, ds)
