"""One query per operator of the inventory, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from uuid import uuid4
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import markdown_link, thousands
from ..operators import browse, composition, filters, kpi, options, relate, summaries, tag_index
from ..operators.flatten import build_main, build_tags, run_etl
from ..sources.tables import list_columns, open_table, shared_folder
from ..spec import Drill, FilterSpec, ShareRange
from . import fixtures
from .fixtures import BUCKETED, DATASET, MEASURES, published_tables

# ---- selections -------------------------------------------------------------
KINGDOMS = ("ASIA", "EUROPE", "AFRICA")
RANKS = FilterSpec.build(ranks={"kingdom": [*KINGDOMS, None, ""], "phylum": []})
RANGES = FilterSpec.build(
    climate_ranges={"clim_bio1_mean": (4.5, 5.5), "no_such_column": (0, 1), "clim_bio7_mean": ("x", 1)},
    area_ranges={"range_km2": (500_000, 3_000_000), "total_gene_biotypes": (20.5, 60.0)},
)
SHARE = FilterSpec.build(share=ShareRange("SMALL", 12.5, 20.0))
SUPPLIERS = ("Supplier#000000003", "Supplier#000000007")
TAGS = FilterSpec.build(tag_levels=["ecoregion"], tag_values=list(SUPPLIERS))
ALL = FilterSpec.build(
    ranks={"kingdom": list(KINGDOMS)},
    tag_levels=["ecoregion", "realm"],
    tag_values=[*SUPPLIERS, "Supplier#000000001", "Supplier#000000005"],
    climate_ranges={"clim_bio1_mean": (4.0, 6.0)},
    area_ranges={"range_km2": (500_000, 4_000_000)},
    share=ShareRange("ECONOMY", 10.0, 30.0),
)
DRILL = ({"rank": "kingdom", "value": "ASIA"}, {"rank": "kingdom", "value": " EUROPE "},
         {"rank": "phylum", "value": "NATION_3"}, {"rank": "no_rank", "value": "x"},
         {"rank": "phylum", "value": "NATION_2"}, {"rank": "phylum", "value": "NATION_12"})
CLICKED = Drill.start(DATASET).click("ASIA", DATASET).click("NATION_7", DATASET).down(DATASET)
SELECTIONS = {
    "kingdom": ["ASIA", "EUROPE"],
    "phylum": ["NATION_2", "NATION_3", "NATION_12", "NATION_1"],
    "class": ["NATION_2/MACHINERY", "NATION_1/MACHINERY"],
}
SHOWN = ["accession", "kingdom", "tax_id", "total_gene_biotypes", "range_km2"]
XS = ["clim_bio1_mean", "range_km2"]

Query = Callable[[SparkSession, str], DataFrame]


def _filtered(spec: FilterSpec, drop: tuple[str, ...] = (), dataset=DATASET) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = published_tables(spark, sf_dir)
        return filters.read_filtered(t.main.drop(*drop), t.tags, spec, dataset, SHOWN)
    return run


def _on_tables(build) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(published_tables(spark, sf_dir))
    return run


def _shares() -> tuple[str, ...]:
    return tuple(DATASET.share_column(m) for m in MEASURES)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_table(spark, f"{sf_dir}/lineitem.parquet")


def _page_columns(t) -> list[str]:
    return DATASET.display_columns(t.main.columns, DATASET.preset_columns(t.main.columns, "measures"))


def _matching(t) -> DataFrame:
    return filters.apply_filters(t.main, t.tags, RANKS, DATASET)


def _measure_points(t, metric: str = "per1k", spec: FilterSpec = RANKS, cap: int = 0) -> DataFrame:
    return relate.measure_scatter(
        t.main, t.tags, spec, DATASET, MEASURES, XS, metric, point_cap=cap, cap_key="scatter")


def _placed(df: DataFrame) -> DataFrame:
    """A limited, ordered result with each row's place in the output, which is one partition."""
    return df.withColumn("position", F.monotonically_increasing_id())


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_BY_FLAG = ["l_returnflag", "l_linestatus"]


def _line_fit(log: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fit = relate.trend_fit(_lines(spark, sf_dir), _BY_FLAG, "l_quantity", "l_extendedprice", log, log)
        return _rounded(fit, 6 if log else 4, "slope", "intercept", "x_min", "x_max")
    return run


def _curve(t) -> DataFrame:
    line = relate.trend_curve(relate.trend_fit(_measure_points(t), log_x=True), log_x=True)
    return _rounded(line, 4, "x", "y")


def _sizes(t) -> DataFrame:
    sized = relate.point_sizes(_measure_points(t, "raw"))
    return _rounded(sized, 6, "size").select("accession", "x_name", "series", "total", "size")


GRID_FILTERS = [
    browse.ColumnFilter("phylum", "not_contains", "nation_1"), browse.ColumnFilter("phylum", "starts_with", "Nation"),
    browse.ColumnFilter("kingdom", "not_equal", "africa"), browse.ColumnFilter("total_gene_biotypes", "not_blank"),
    browse.ColumnFilter("tax_id", "at_least", "3.5"), browse.ColumnFilter("tax_id", "at_most", 1400), browse.ColumnFilter("accession", "ends_with", "7"),
]


def _typed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source's keys are whole numbers; the ETL makes both tables' keys text."""
    def bare(source: DataFrame) -> DataFrame:
        return source.withColumn("accession", F.substring("accession", 5, 20).cast("long"))

    main = build_main(bare(fixtures.nested_entities(spark, sf_dir)), fixtures.SOURCE, DATASET)
    tags = build_tags(bare(fixtures.nested_tags(spark, sf_dir)), fixtures.SOURCE, DATASET)
    return filters.read_filtered(main, tags, TAGS, DATASET, SHOWN)


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older records: ranks and links as lists, null elements, each measure twice."""
    source = fixtures.nested_entities(spark, sf_dir)
    return build_main(source.withColumns({
        "taxonomy": F.array("taxonomy"), "meta_urls": F.array("meta_urls"),
        "gene_biotypes": F.concat(F.array(F.lit(None)), "gene_biotypes", F.array(F.lit(None)), "gene_biotypes"),
    }), fixtures.SOURCE, DATASET)


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written source through the whole ETL, its table as read back."""
    folder = f"{shared_folder(spark)}/round-{spark.sparkContext.applicationId}-{crc32(sf_dir.encode()):08x}"
    fixtures.nested_entities(spark, sf_dir).write.mode("overwrite").parquet(f"{folder}/source.parquet")
    return run_etl(spark, f"{folder}/source.parquet", folder, fixtures.SOURCE, DATASET, ("kingdom", "phylum")).main


TIED = replace(DATASET, key="o_custkey")
TIED_COLUMNS = ["o_custkey", "o_orderstatus", "o_orderkey"]


def _tied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of rows whose key repeats, put together again."""
    orders = open_table(spark, f"{sf_dir}/orders.parquet")
    pages = [browse.page_rows(orders, None, FilterSpec(), TIED, TIED_COLUMNS, page, 70, order_by=["-o_orderstatus"]) for page in (1, 2, 3)]
    return reduce(DataFrame.unionAll, pages)


def _page_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page by the first one's cursor."""
    orders = open_table(spark, f"{sf_dir}/orders.parquet")
    first = browse.page_rows(orders, None, FilterSpec(), TIED, TIED_COLUMNS, 1, 70, order_by=["-o_orderstatus"]).head(70)
    cursor = browse.next_cursor(first, TIED, TIED_COLUMNS, ["-o_orderstatus"])
    return browse.page_rows(orders, None, FilterSpec(), TIED, TIED_COLUMNS, 1, 70, order_by=["-o_orderstatus"], after=cursor)


def _with_nan(main: DataFrame) -> DataFrame:
    nan = F.lit(float("nan"))
    return main.withColumns({
        "SMALL_count": F.when(F.col("tax_id") % 7 == 0, nan).otherwise(F.col("SMALL_count").cast("double")),
        "total_gene_biotypes": F.when(F.col("tax_id") % 5 == 0, nan).otherwise(F.col("total_gene_biotypes").cast("double")),
    })

# what the page queries below order by; pages and samples are selected by thresholds at every size
LINES = replace(DATASET, key="l_orderkey")
LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"]
LINE_ORDER = ["l_returnflag", "-l_extendedprice"]
STATUS = replace(DATASET, key="o_orderstatus")


def _page_beyond(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.page_rows(_lines(spark, sf_dir), None, FilterSpec(), LINES, LINE_COLUMNS, 90, 60, order_by=LINE_ORDER, heard=0)


def _after_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the third one, by the cursor of the third, where all rows of a status look the same."""
    orders = open_table(spark, f"{sf_dir}/orders.parquet").select("o_orderstatus", F.floor(F.col("o_orderkey") % 2).alias("half"))
    columns = ["o_orderstatus", "half"]
    third = browse.page_rows(orders, None, FilterSpec(), STATUS, columns, 3, 40).head(40)
    cursor = browse.next_cursor(third, STATUS, columns, page=3, page_size=40)
    return browse.page_rows(orders, None, FilterSpec(), STATUS, columns, 1, 1300, after=cursor)


def _sketched(t) -> DataFrame:
    """The exact figures, and whether those from sketches lie within 5 % of them."""
    told = summaries.rank_counts_sketched(t.sketches, RANKS, DATASET).withColumnRenamed("value", "told")
    near = F.abs(F.col("told") - F.col("value")) <= F.col("value") * 0.05
    return summaries.rank_counts(t.paths, RANKS, DATASET).join(told, "figure").select("figure", "value", near.alias("near"))


EITHER = [browse.AnyOf((browse.ColumnFilter("phylum", "equals", "nation_1"), browse.ColumnFilter("phylum", "ends_with", "_12"))),
          browse.AnyOf((browse.ColumnFilter("tax_id", "less", 900), browse.ColumnFilter("range_km2", "blank")))]


QUERIES: dict[str, Query] = {
    # ETL
    "etl_main": fixtures.flat_main,
    "etl_bridge": fixtures.flat_tags,
    "etl_children": fixtures.flat_children,
    "etl_legacy": _legacy,
    "etl_round_trip": _round_trip,
    # filters
    "filter_ranks": _filtered(RANKS),
    "filter_category": _filtered(
        FilterSpec.build(categories=["F", "O"]), dataset=replace(DATASET, category="ena_assembly_level")),
    "filter_coerced": _filtered(
        FilterSpec.build(categories=["40.9", "41", " 42 ", "many", "", None]),
        dataset=replace(DATASET, category="ena_scaffold_count")),
    "filter_ranges": _filtered(RANGES),
    "filter_share_stored": _filtered(SHARE),
    "filter_share_computed": _filtered(SHARE, drop=_shares()),
    "filter_share_no_total": _filtered(SHARE, drop=(*_shares(), "total_gene_biotypes")),
    "filter_tags": _filtered(TAGS),
    "filter_tags_bucketed": _on_tables(lambda t: filters.read_filtered(
        t.bucketed.main, t.bucketed.tags, TAGS, BUCKETED, SHOWN)),
    "filter_tags_indexed": _on_tables(lambda t: tag_index.filter_indexed(
        t.numbered, t.tag_index, TAGS, DATASET).select(*SHOWN)),
    "filter_tags_counted": lambda spark, sf: filters.keep_keys(
        published_tables(spark, sf).main.select(*SHOWN), "accession",
        filters.tag_rows(published_tables(spark, sf).tags, TAGS, DATASET), "accession"),
    "filter_tags_typed_keys": _typed_keys,
    "filter_tags_empty": _filtered(FilterSpec.build(tag_levels=["realm"], tag_values=list(SUPPLIERS))),
    "filter_all": _filtered(ALL),
    "filter_drill": _filtered(FilterSpec().with_drill(DRILL, DATASET)),
    "filter_prune": _on_tables(lambda t: options.prune_selections(t.main, SELECTIONS, DATASET)),
    "filter_prune_tags": _on_tables(lambda t: options.prune_tag_values(
        t.tags, ["realm", "biome"], ["ASIA", "NATION_3", *SUPPLIERS], DATASET)),
    # browsing
    "page_rows": _on_tables(lambda t: browse.page_rows(t.main, t.tags, RANKS, DATASET, SHOWN, page=2)),
    "page_deep": _on_tables(lambda t: browse.page_rows(
        t.main, t.tags, RANKS, DATASET, SHOWN, page=9)),
    "page_placed": _on_tables(lambda t: _placed(browse.page_rows(
        t.main, t.tags, RANKS, DATASET, SHOWN, page=2, page_size=20, order_by=["-range_km2"]))),
    "page_tied": _tied_pages,
    "page_after": _page_after,
    "page_numbered": lambda spark, sf: browse.page_of(browse.write_numbered(
        published_tables(spark, sf).main.where(F.col("kingdom").isin(*KINGDOMS)).select(*SHOWN), DATASET,
        f"{shared_folder(spark)}/numbered-{uuid4().hex}", ["-range_km2"]), 3, 20),
    "page_beyond": _page_beyond,
    "page_cursor_after_number": _after_number,
    "page_default_columns": _on_tables(lambda t: browse.grid(t.main, t.tags, RANKS, DATASET, None, 2, 30).rows),
    "page_either": _on_tables(lambda t: browse.page_rows(
        t.main, t.tags, RANKS, DATASET, SHOWN, 1, 100, EITHER, ["phylum", "-tax_id"])),
    "schema_columns": _on_tables(lambda t: t.main.sparkSession.createDataFrame(
        list(enumerate(list_columns(t.main))), "place int, name string")),
    "grid_filtered_rows": _on_tables(lambda t: browse.grid(
        t.main, t.tags, RANKS, DATASET, SHOWN, 1, 80, GRID_FILTERS, ["phylum", "-tax_id"]).rows),
    "grid_filtered_total": _on_tables(lambda t: browse.grid(
        t.main, t.tags, RANKS, DATASET, SHOWN, 1, 80, GRID_FILTERS, ["phylum", "-tax_id"]).total),
    "page_preset": _on_tables(lambda t: browse.page_rows(
        t.main, t.tags, RANKS, DATASET, _page_columns(t), page=1, page_size=100)),
    "page_links": _on_tables(lambda t: browse.grid(
        t.main, t.tags, RANKS, DATASET, _page_columns(t), page=1, page_size=100).rows),
    "page_column_filter": _on_tables(lambda t: browse.page_rows(
        t.main, t.tags, RANKS, DATASET, SHOWN, page=1, page_size=50,
        column_filters=[
            browse.ColumnFilter("phylum", "contains", "nation_1"),
            browse.ColumnFilter("range_km2", "between", 500_000, 4_000_000),
            browse.ColumnFilter("tax_id", "greater", 10),
        ],
        order_by=["-range_km2"])),
    "count_rows": _on_tables(lambda t: browse.count_rows(t.main, t.tags, ALL, DATASET)),
    # measures and composition
    "measure_means": _on_tables(lambda t: _rounded(
        composition.measure_means(t.main, t.tags, ALL, DATASET), 6, "value")),
    "measure_sums": _on_tables(lambda t: composition.measure_means(t.main, t.tags, TAGS, DATASET, "count")),
    "measure_totals": _on_tables(lambda t: composition.measure_totals(t.main, t.tags, ALL, DATASET)),
    "composition_by_rank": _on_tables(lambda t: composition.composition(
        t.main, t.tags, FilterSpec(), DATASET, "kingdom")),
    "composition_filtered": _on_tables(lambda t: composition.composition(
        t.main, t.tags, ALL, DATASET, "order")),
    "composition_no_total": _on_tables(lambda t: composition.composition(
        t.main.drop("total_gene_biotypes"), t.tags, RANKS, DATASET, "phylum")),
    "composition_pivot": _on_tables(lambda t: composition.composition_matrix(
        t.main, t.tags, RANKS, DATASET, "class")),
    "composition_ordered": _on_tables(lambda t: composition.composition_ordered(
        t.main, t.tags, replace(RANKS, share=ShareRange("SMALL", 12.5, 20.0)), DATASET, "phylum")),
    "composition_drill": _on_tables(lambda t: composition.composition_drill(
        t.main, t.tags, FilterSpec(), DATASET, DRILL)),
    "composition_rollup": _on_tables(lambda t: summaries.composition_rolled(t.rollup, RANKS, DATASET, "phylum")),
    "composition_rollup_drill": _on_tables(lambda t: summaries.drill_rolled(t.rollup, FilterSpec(), DATASET, DRILL)),
    "measure_totals_rollup": _on_tables(lambda t: summaries.totals_rolled(t.rollup, RANKS, DATASET)),
    "composition_clicked": _on_tables(lambda t: composition.composition_drill(
        t.main, t.tags, RANKS, DATASET, CLICKED.steps, CLICKED.rank)),
    "composition_deepest": _on_tables(lambda t: composition.composition_drill(
        t.main, t.tags, FilterSpec.build(ranks={"kingdom": ["ASIA"], "phylum": ["NATION_2", "NATION_7", "NATION_12"]}),
        DATASET, [])),
    "nan_totals": _on_tables(lambda t: composition.measure_totals(_with_nan(t.main), t.tags, RANKS, DATASET)),
    "nan_composition": _on_tables(lambda t: composition.composition(_with_nan(t.main), t.tags, RANKS, DATASET, "kingdom")),
    "nan_kpi": _on_tables(lambda t: kpi.kpi_summary(_with_nan(t.main), t.tags, RANKS, DATASET)),
    # headline figures
    "kpi_summary": _on_tables(lambda t: kpi.kpi_summary(t.main, t.tags, RANKS, DATASET)),
    "kpi_summary_filtered": _on_tables(lambda t: kpi.kpi_summary(t.main, t.tags, ALL, DATASET)),
    "kpi_entities": _on_tables(lambda t: kpi.matching_entities(t.main, t.tags, ALL, DATASET)),
    "kpi_tags": _on_tables(lambda t: kpi.tag_distinct_counts(t.main, t.tags, ALL, DATASET)),
    "kpi_tags_bucketed": _on_tables(lambda t: kpi.tag_distinct_counts(t.bucketed.main, t.bucketed.tags, ALL, BUCKETED)),
    "kpi_tags_indexed": _on_tables(lambda t: tag_index.tag_counts_indexed(t.numbered, t.tag_index, ALL, DATASET)),
    "kpi_ranks_paths": _on_tables(lambda t: summaries.rank_counts(t.paths, RANKS, DATASET)),
    "kpi_ranks_sketched": _on_tables(_sketched),
    "kpi_top": _on_tables(lambda t: kpi.top_measures(t.main, t.tags, ALL, DATASET, k=3)),
    "kpi_top_placed": _on_tables(lambda t: _placed(kpi.top_measures(t.main, t.tags, ALL, DATASET))),
    "kpi_top_text": _on_tables(lambda t: kpi.top_measures_text(t.main, t.tags, ALL, DATASET)),
    "extents": _on_tables(lambda t: kpi.extents(
        t.main, ["clim_bio1_mean", "clim_bio12_mean", "range_km2", "total_gene_biotypes", "no_such_column"])),
    "breakpoints": _on_tables(lambda t: kpi.breakpoints(
        kpi.extents(t.main, ["clim_bio1_mean", "clim_bio12_mean", "range_km2", "no_such_column"]))),
    "metric_extents": _on_tables(lambda t: composition.with_labels(
        kpi.extents(t.main, DATASET.metric_columns(t.main.schema)), "column", DATASET,
        DATASET.metric_columns(t.main.schema))),
    # option lists
    "options_distinct": _on_tables(lambda t: options.distinct_values(t.main, "class", DATASET, ALL, t.tags)),
    "options_unfiltered": _on_tables(lambda t: options.distinct_values(t.main, "tax_id", DATASET)),
    "options_limited": _on_tables(lambda t: options.distinct_values(t.main, "tax_id", DATASET, limit=100)),
    "options_cascaded_limited": _on_tables(lambda t: options.cascaded_options(t.main, SELECTIONS, DATASET, limit=3)),
    "options_cascaded": _on_tables(lambda t: options.cascaded_options(t.main, SELECTIONS, DATASET)),
    "options_cascaded_paths": _on_tables(lambda t: options.cascaded_options(t.paths, SELECTIONS, DATASET)),
    "options_cascaded_beyond": _on_tables(lambda t: options.cascaded_options(t.main, {"kingdom": ["ASIA", "EUROPE"]}, DATASET, limit=1200)),
    "options_tag_levels": _on_tables(lambda t: options.tag_levels(t.tags, DATASET)),
    "options_tag_values": _on_tables(lambda t: options.tag_values(t.tags, ["realm", "biome"], DATASET)),
    "tags_by_entity": _on_tables(lambda t: kpi.tags_by_entity(
        t.tags, _matching(t), ["realm", "biome", "ecoregion"], DATASET).select(
            "accession", "level", "part", F.array_join("values", "|").alias("value_list"))),
    "tags_of_entities": _on_tables(lambda t: kpi.entity_tags(
        t.tags, _matching(t), ["biome", "ecoregion"], DATASET)),
    # relationships
    "scatter_long": _on_tables(lambda t: _rounded(_measure_points(t), 9, "y")),
    "scatter_share": _on_tables(lambda t: _measure_points(t, "percentage", ALL)),
    "scatter_metric": _on_tables(lambda t: relate.metric_scatter(
        t.main, t.tags, RANKS, DATASET, "ens_assembly_gc_percentage", XS)),
    "scatter_capped": _on_tables(lambda t: _measure_points(t, "raw", cap=300)),
    "trend_fit": _line_fit(False),
    "trend_fit_log": _line_fit(True),
    "trend_curve": _on_tables(_curve),
    "point_sizes": _on_tables(_sizes),
    "sample_stable": lambda spark, sf: relate.stable_sample(
        open_table(spark, f"{sf}/customer.parquet"), 400, "plot", replace(DATASET, key="c_custkey"),
    ).select("c_custkey", "c_name"),
    "sample_large": lambda spark, sf: relate.stable_sample(
        open_table(spark, f"{sf}/orders.parquet"), 5000, "plot", replace(DATASET, key="o_orderkey"), heard=0,
    ).select("o_orderkey", "o_custkey"),
    # scalar functions
    "links": lambda spark, sf: open_table(spark, f"{sf}/pages.parquet").select(
        "page_id", markdown_link(F.col("url")).alias("link")),
    "format_kpi": _on_tables(lambda t: composition.measure_totals(
        t.main, t.tags, FilterSpec(), DATASET).select("biotype", thousands(F.col("count")).alias("text"))),
}
