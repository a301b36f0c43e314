"""A bitmap index of the tags.

Entities get dense numbers, in the order of the numbered table (``browse.write_numbered``).
For each (level, value) the index holds the entities that have it as bitmaps of
32,768 numbers each, so a selection of any number of values is an OR of a few
small rows, and figures are ANDs.  No tag row is read.  Where few of the 32,768
have a tag, their places are listed instead, so that the index grows with the
tags and not with values times entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named
from ..spec import DatasetSpec, FilterSpec
from .filters import filter_rows, selected, spread_join

NUMBER, PART, BITS, PLACES = "row_no", "part", "bits", "places"
LISTED = 1024           # places of two bytes that take half of a bitmap


def _part(number: str) -> Column:
    return F.bitmap_bucket_number(F.col(number))


def build_tag_index(numbered: DataFrame, tags: DataFrame, ds: DatasetSpec) -> DataFrame:
    """(level, value, part, bits, places): which entities have a tag, as a bitmap or as the list of their places.

    The pairs are dealt before anything is gathered: a bitmap of every map task
    would be far larger than the few pairs in it.  Copies of a pair count once.  A tag without level or value is kept, since
    it meets a selection of the other.
    """
    level, value = named(ds.tag_level), named(ds.tag_value)
    rows = tags.select(named(ds.tag_key), level, value)
    entities = numbered.where(named(ds.key).isNotNull()).select(named(ds.key).alias("_key"), NUMBER)
    # tags are on the left: a hot entity's rows can be split
    pairs = spread_join(rows, entities, {ds.tag_key: "_key"}, "inner")
    dealt = pairs.select(level, value, _part(NUMBER).alias(PART), F.bitmap_bit_position(F.col(NUMBER)).cast("short").alias("_at")).repartition(level, value, PART)
    grouped = dealt.groupBy(level, value, PART).agg(F.bitmap_construct_agg(F.col("_at").cast("long")).alias(BITS), F.collect_set("_at").alias(PLACES))
    few = F.size(PLACES) <= LISTED
    return grouped.withColumns({BITS: F.when(~few, F.col(BITS)), PLACES: F.when(few, F.col(PLACES))})


def write_tag_index(index: DataFrame, path: str, ds: DatasetSpec) -> None:
    order = [named(ds.tag_level), named(ds.tag_value), F.col(PART)]
    index.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def _has_bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*[byte.bitwiseAND(1 << b) for b in range(8)]), (at % 8).cast("int")) != 0


def filter_indexed(numbered: DataFrame, index: DataFrame, spec: FilterSpec, ds: DatasetSpec) -> DataFrame:
    """The whole filter contract on the numbered table; tags are looked up in the index.

    The selected bitmaps have an eighth of a byte per entity; the optimizer
    sends them to the rows or the rows to them.
    """
    rows = filter_rows(numbered, spec, ds)
    if not spec.has_tags:
        return rows
    named_ones = selected(index, spec, ds)
    listed = named_ones.select(PART, F.explode(PLACES).alias("_at")).groupBy(PART).agg(F.bitmap_construct_agg(F.col("_at").cast("long")).alias(BITS))
    chosen = named_ones.where(F.col(BITS).isNotNull()).select(PART, BITS).unionByName(listed).groupBy(PART).agg(F.bitmap_or_agg(BITS).alias(BITS))
    chosen = chosen.select(F.col(PART).alias("_part"), F.col(BITS).alias("_bits"))
    return rows.join(chosen, _part(NUMBER) == F.col("_part")).where(_has_bit(F.col("_bits"), F.bitmap_bit_position(F.col(NUMBER)))).drop("_part", "_bits")


def tag_counts_indexed(numbered: DataFrame, index: DataFrame, spec: FilterSpec, ds: DatasetSpec) -> DataFrame:
    """(level, values): distinct tag values among matching entities, from the index (K3).

    A value counts if its bitmap and that of the matching entities share a bit,
    or if that of the matching entities has one of its listed places.
    """
    matching = filter_indexed(numbered, index, spec, ds)
    wanted = matching.groupBy(_part(NUMBER).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(NUMBER))).alias("_bits"))
    level, value = named(ds.tag_level), named(ds.tag_value)
    offered = index.where(level.isin(list(ds.tag_levels)) & value.isNotNull()).select(level.alias("level"), value.alias("value"), PART, BITS, PLACES)
    offered = offered.join(wanted, F.col(PART) == F.col("_part"))
    listed = offered.where(F.exists(PLACES, lambda at: _has_bit(F.col("_bits"), at))).select("level", "value")
    both = offered.where(F.col(BITS).isNotNull()).select("level", "value", PART, F.explode(F.array(BITS, "_bits")).alias("b"))
    shared = both.groupBy("level", "value", PART).agg(F.bitmap_and_agg("b").alias("b")).where(F.bitmap_count("b") > 0)
    counts = shared.select("level", "value").unionByName(listed).distinct().agg(*[F.count_if(F.col("level") == v).alias(v) for v in ds.tag_levels])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(v).alias("level"), named(v).alias("values")) for v in ds.tag_levels])))
