"""Stored summaries of the entity table: rank paths, a rollup of the measures, sketches.

They are tables for questions whose filters name nothing but ranks, as drills,
cascades and rank figures do.  Columns are named as in the entity table, so
that the operators for that table take paths and rollup in its place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import amount, named
from ..spec import DatasetSpec, FilterSpec, known_steps
from .composition import composition, measure_totals
from .filters import filter_rows, require_columns

DEPTH, ENTITIES = "depth", "entities"


def only_ranks(spec: FilterSpec, names: Sequence[str]) -> None:
    """Refuse filters that a summary by these ranks can't answer."""
    other = [r for r, values in spec.ranks.items() if values and r not in names]
    if other or spec.categories or spec.ranges or spec.share or spec.has_tags:
        raise ValueError(f"a summary by {list(names)} answers filters on those only")


# ---- rollup -----------------------------------------------------------------
def build_rollup(main: DataFrame, ds: DatasetSpec) -> DataFrame:
    """Per prefix of the ranks: number of entities and the sum of every measure, in one pass.

    ``depth`` says how many ranks a row groups by; deeper ones are null.  The
    grouping sets are aggregated before the shuffle, so a group is one row per
    map task and depth.
    """
    require_columns(main, ds.ranks)
    columns = [*ds.count_columns(main.columns), *([ds.total] if ds.total and ds.total in main.columns else [])]
    prefixes = [[named(r) for r in ds.ranks[:n]] for n in range(1, len(ds.ranks) + 1)]
    # a rank that isn't grouped by sets its bit of the grouping id, the deepest one the lowest
    grouped = len(ds.ranks) - F.bit_count(F.grouping_id())
    sums = [F.sum(F.coalesce(amount(main, c), F.lit(0))).alias(c) for c in columns]
    return main.groupingSets(prefixes, *[named(r) for r in ds.ranks]).agg(
        F.count(F.lit(1)).alias(ENTITIES), *sums, grouped.cast("int").alias(DEPTH)).select(
            DEPTH, *[named(r) for r in ds.ranks], ENTITIES, *[named(c) for c in columns])


def write_rollup(rollup: DataFrame, path: str, ds: DatasetSpec) -> None:
    """One folder per depth, in the order of the ranks: a drill reads a part of one."""
    order = [F.col(DEPTH), *[named(r) for r in ds.ranks]]
    rollup.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(DEPTH).parquet(path)


def _at_depth(rollup: DataFrame, spec: FilterSpec, ds: DatasetSpec, rank: str) -> DataFrame:
    """The rows of the least depth that tells apart the grouping and all filtered ranks."""
    only_ranks(spec, ds.ranks)
    asked = [r for r, values in spec.ranks.items() if values] + [rank]
    return rollup.where(F.col(DEPTH) == max(ds.ranks.index(r) for r in asked) + 1).drop(DEPTH, ENTITIES)


def composition_rolled(rollup: DataFrame, spec: FilterSpec, ds: DatasetSpec, rank: str, count_columns: Sequence[str] | None = None) -> DataFrame:
    """``composition`` under rank filters, from the rollup."""
    return composition(_at_depth(rollup, spec, ds, rank), None, spec, ds, rank, count_columns)


def drill_rolled(rollup: DataFrame, spec: FilterSpec, ds: DatasetSpec, path: Sequence[Mapping], rank: str | None = None) -> DataFrame:
    """``composition_drill`` under rank filters, from the rollup (H2): each step down reads the next depth."""
    last = next((r for r, _ in reversed(known_steps(path, ds))), None)
    rank = rank or ds.next_rank(last) or last or spec.deepest_rank(ds) or ds.ranks[0]
    return composition_rolled(rollup, spec.with_drill(path, ds), ds, rank)


def totals_rolled(rollup: DataFrame, spec: FilterSpec, ds: DatasetSpec) -> DataFrame:
    """``measure_totals`` under rank filters, from the rollup (A2)."""
    return measure_totals(_at_depth(rollup, spec, ds, ds.ranks[0]), None, spec, ds)


# ---- paths ------------------------------------------------------------------
def build_paths(main: DataFrame, ds: DatasetSpec) -> DataFrame:
    """Every combination of facet values that occurs, with its number of entities."""
    require_columns(main, ds.facets)
    return main.groupBy(*[named(f) for f in ds.facets]).agg(F.count(F.lit(1)).alias(ENTITIES))


def write_paths(paths: DataFrame, path: str, ds: DatasetSpec) -> None:
    """Clustered by path, so that a broad selection reads few row groups."""
    order = [named(f) for f in ds.facets]
    paths.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def rank_counts(paths: DataFrame, spec: FilterSpec, ds: DatasetSpec) -> DataFrame:
    """(figure, value): distinct values of each rank, and the entities, under facet filters (K1).

    ``paths`` is the path table; cascades and pruning take it as their entity table.
    """
    only_ranks(spec, ds.facets)
    rows = filter_rows(paths, spec, ds)
    offers = [F.struct(F.lit(r).alias("figure"), named(r).cast("string").alias("item"), F.lit(0).cast("long").alias("n")) for r in ds.ranks]
    offers.append(F.struct(F.lit("accessions").alias("figure"), F.lit(None).cast("string").alias("item"), F.col(ENTITIES).alias("n")))
    items = rows.select(F.inline(F.array(*offers))).groupBy("figure", "item").agg(F.sum("n").alias("n"))
    counts = items.agg(*[F.count_if((F.col("figure") == r) & F.col("item").isNotNull()).alias(r) for r in ds.ranks],
                       F.coalesce(F.sum("n"), F.lit(0)).alias("accessions"))
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("figure"), named(n).alias("value")) for n in (*ds.ranks, "accessions")])))


# ---- sketches ---------------------------------------------------------------
#: Relative error of a figure from sketches: 2.6 % at two standard errors with 2 ** 12 registers.
SKETCH_BITS = 12


def build_sketches(main: DataFrame, ds: DatasetSpec, depth: int = 2) -> DataFrame:
    """Per prefix of the first ``depth`` ranks, none included: a mergeable sketch of each rank's values and of the entities.

    For tables with far more paths than the exact figures should read; a row
    holds a few kB per sketch, whatever the number of entities.
    """
    require_columns(main, [*ds.ranks, ds.key])
    broad = ds.ranks[:depth]
    prefixes = [[named(r) for r in broad[:n]] for n in range(len(broad) + 1)]
    grouped = len(broad) - F.bit_count(F.grouping_id())
    # the ranks that are grouped are counted by copies: grouping sets empty the originals
    copies = main.select("*", *[named(c).cast("string").alias(f"_of_{c}") for c in (*ds.ranks, ds.key)])
    sketches = [F.hll_sketch_agg(named(f"_of_{c}"), SKETCH_BITS).alias(f"sketch_{c}") for c in (*ds.ranks, ds.key)]
    return copies.groupingSets(prefixes, *[named(r) for r in broad]).agg(*sketches, grouped.cast("int").alias(DEPTH)).select(
        DEPTH, *[named(r) for r in broad], *[named(f"sketch_{c}") for c in (*ds.ranks, ds.key)])


def rank_counts_sketched(sketches: DataFrame, spec: FilterSpec, ds: DatasetSpec) -> DataFrame:
    """(figure, value): ``rank_counts`` estimated from sketches, under filters on the ranks they are stored by (K1).

    Distinct entities are counted, not rows.  The exact figures are beside it in ``rank_counts`` and ``kpi``.
    """
    broad = [r for r in ds.ranks if r in sketches.columns]
    only_ranks(spec, broad)
    deepest = max((broad.index(r) + 1 for r, values in spec.ranks.items() if values), default=0)
    rows = filter_rows(sketches.where(F.col(DEPTH) == deepest), spec, ds)
    merged = rows.agg(*[F.hll_sketch_estimate(F.hll_union_agg(named(f"sketch_{c}"))).alias(f"n{i}") for i, c in enumerate((*ds.ranks, ds.key))])
    return merged.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("figure"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("value")) for i, n in enumerate((*ds.ranks, "accessions"))])))
