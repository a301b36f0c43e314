"""Threshold selection, layouts and summaries: the same answers, with the plans they are for."""

import random
import re
import shutil
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from facetspark.genome import GENOME, GENOME_SOURCE
from facetspark.operators import browse, composition, filters, flatten, kpi, options, relate, summaries, tag_index
from facetspark.operators.leading import Key, between, leading, locate, stretch
from facetspark.sources import tables
from facetspark.sources.tables import FacetTables, read_tables, write_tables
from facetspark.spec import FilterSpec, ShareRange


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- threshold selection ----------------------------------------------------
@pytest.fixture(scope="module")
def numbers(spark, tmp_path_factory):
    """120,000 rows in 8 files: ``a`` is skewed with a value that half of the rows have, ``s`` repeats, ``i`` is unique."""
    path = f"{tmp_path_factory.mktemp('numbers')}/n"
    rows = spark.range(0, 120_000, 1, 8).select(
        F.col("id").alias("i"),
        F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise((F.xxhash64("id") % 5000).cast("int")).alias("a"),
        F.concat(F.lit("same prefix "), F.substring(F.md5(F.col("id").cast("string")), 1, 2)).alias("s"),
        F.when(F.col("id") % 5 == 0, float("nan")).when(F.col("id") % 7 == 0, None).otherwise(F.sqrt("id") - 200).alias("d"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("n", [10, 1001, 50_000])
def test_only_the_wanted_rows_and_a_bin_are_ordered(numbers, n):
    keys = [Key(F.col("a"), down=True), Key(F.col("s")), Key(F.col("i"))]
    inside, skip = stretch(numbers, keys, 0, n)
    assert skip == 0 and n <= inside.count() <= n + max(n, 1000)
    got = leading(numbers, keys, n, heard=0)
    plan = plan_of(got)
    assert not re.search(r"\bSort\b|Window", plan) and "TakeOrderedAndProject" in plan
    assert re.search(r"PushedFilters: \[.*GreaterThan", plan)
    assert [r.i for r in got.collect()] == [r.i for r in numbers.orderBy(*[k.order for k in keys]).limit(n).collect()]


@pytest.mark.parametrize("start, n", [(0, 1), (59_990, 25), (119_990, 50), (120_000, 5)])
def test_any_stretch_of_any_order(numbers, start, n):
    for keys in ([Key(F.col("a")), Key(F.col("i"), True)], [Key(F.col("s"), True), Key(F.col("d"), nulls_first=True), Key(F.col("i"))]):
        inside, skip = stretch(numbers, keys, start, n, room=500)
        assert inside.count() <= n + 2 * 500 and 0 <= skip < max(1, 500)
        want = numbers.orderBy(*[k.order for k in keys]).offset(start).limit(n).select("i")
        assert [r.i for r in between(numbers, keys, start, n, heard=0, room=500).collect()] == [r.i for r in want.collect()]


def test_rows_equal_in_all_keys_fill_a_bin(spark):
    same = spark.range(5000).select(F.lit("x").alias("k"), F.lit(None).cast("int").alias("m"))
    found = locate(same, [Key(F.col("k")), Key(F.col("m"))], 3000, 10)
    assert (found.equal, found.passed, found.rows) == (("x", None), 0, 5000)
    assert between(same, [Key(F.col("k")), Key(F.col("m"))], 100, 20, heard=0, room=10).count() == 20


def test_types_of_keys(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("i"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("day"),
        F.timestamp_seconds(F.col("id") * 977 % 3001).alias("time"), (F.col("id") % 2 == 0).alias("flag"),
        (F.col("id") % 97).cast("decimal(10,2)").alias("price"), F.array("id").alias("nested"), F.encode(F.hex("id"), "UTF-8").alias("raw"))
    for name in ("day", "time", "flag", "price", "nested", "raw"):
        keys = [Key(F.col(name), down=True), Key(F.col("i"))]
        want = [r.i for r in rows.orderBy(*[k.order for k in keys]).limit(900).collect()][850:]
        assert [r.i for r in between(rows, keys, 850, 50, heard=0, room=40).collect()] == want


def test_few_rows_take_one_job(numbers):
    """Where the last task would hear of few rows nothing is measured first."""
    plan = plan_of(leading(numbers, [Key(F.col("a")), Key(F.col("i"))], 50))
    assert "TakeOrderedAndProject" in plan and "GreaterThan" not in plan


def test_samples_of_any_size(numbers):
    ds = replace(GENOME, key="i")
    for n in (100, 5000):
        direct = relate.stable_sample(numbers, n, "key", ds)
        assert sorted(r.i for r in direct.collect()) == sorted(r.i for r in relate.stable_sample(numbers, n, "key", ds, heard=0).collect())


def test_long_option_lists_are_cut_without_windows_over_groups(spark):
    ds = replace(GENOME, ranks=("kingdom", "phylum"), id_facet="tax_id")
    main = spark.range(4000).select(F.concat(F.lit("k"), F.col("id") % 3).alias("kingdom"), F.concat(F.lit("p"), F.col("id") % 2500).alias("phylum"), F.col("id").alias("tax_id"))
    got = options.cascaded_options(main, {"kingdom": ["k1"]}, ds, limit=1500)
    whole = options.cascaded_options(main, {"kingdom": ["k1"]}, ds)
    for rank in ("kingdom", "phylum", "tax_id"):
        values = [r.value for r in whole.where(F.col("rank") == rank).collect()]
        rows = got.where(F.col("rank") == rank).collect()
        assert [r.value for r in rows] == values[:1500] and {r.more for r in rows} == {len(values) > 1500}


# ---- cursors ----------------------------------------------------------------
@pytest.mark.parametrize("page, after_page", [(2, None), (3, None), (2, 1), (2, 2)])
def test_cursor_of_equal_rows_by_number(spark, page, after_page):
    """200 rows that look the same: a cursor after a page by number lets 200 - page * 50 follow."""
    ds = replace(GENOME, key="k")
    rows = spark.range(200).select(F.lit("x").alias("k"), F.lit(1).alias("v"))
    show = lambda p, after: browse.page_rows(rows, None, FilterSpec(), ds, ["k", "v"], p, 50 if p < 9 else 500, after=after)
    shown, after = 0, None
    if after_page:
        after = browse.next_cursor(show(after_page, None).collect(), ds, ["k", "v"], page=after_page, page_size=50)
        shown = 50 * after_page
    got = show(page, after).collect()
    shown += 50 * page
    cursor = browse.next_cursor(got, ds, ["k", "v"], after=after, page=page, page_size=50)
    if shown >= 200 and not got:
        assert cursor is None
    else:
        assert browse.page_rows(rows, None, FilterSpec(), ds, ["k", "v"], 1, 500, after=cursor).count() == 200 - shown


def test_walk_with_cursors_over_ties(spark):
    rng = random.Random(3)
    ds = replace(GENOME, key="k")
    data = [(rng.choice("aab"), rng.choice([1, 1, 2, None])) for _ in range(90)]
    rows = spark.createDataFrame(data, "k string, v int").repartition(3)
    whole = [tuple(r) for r in browse.page_rows(rows, None, FilterSpec(), ds, ["k", "v"], 1, 500).collect()]
    for size, page in ((20, 2),):
        seen, after = list(whole[:(page - 1) * size]), None
        while True:
            shown = browse.page_rows(rows, None, FilterSpec(), ds, ["k", "v"], page, size, after=after).collect()
            seen += [tuple(r) for r in shown]
            after = browse.next_cursor(shown, ds, ["k", "v"], after=after, page=page, page_size=size)
            if after is None:
                break
            page = 1
        assert seen == whole


def test_grid_takes_a_cursor_and_alternatives(spark):
    ds = replace(GENOME, key="k", urls=())
    rows = spark.createDataFrame([(f"k{i:02}", i % 5) for i in range(60)], "k string, v int")
    either = [browse.AnyOf((browse.ColumnFilter("v", "equals", 1), browse.ColumnFilter("v", "greater", 3), browse.ColumnFilter("v", "less", "none")))]
    first = browse.grid(rows, None, FilterSpec(), ds, ["k", "v"], 1, 10, either)
    after = browse.next_cursor(first.rows.collect(), ds, ["k", "v"])
    second = browse.grid(rows, None, FilterSpec(), ds, ["k", "v"], 1, 100, either, after=after)
    assert {r.v for r in second.rows.collect()} == {1, 4} and second.rows.count() == 14 and second.total.first()[0] == 24
    assert browse.column_predicate(rows, browse.AnyOf((browse.ColumnFilter("v", "less", "x"),))) is None


# ---- layouts ----------------------------------------------------------------
RANKED = replace(GENOME, ranks=("kingdom", "phylum", "class"), id_facet="tax_id", measures=("x", "y"), total="total", tag_levels=("realm", "biome"))


@pytest.fixture(scope="module")
def facet(spark, tmp_path_factory):
    """Main with nulls and repeated keys, tags with a hot entity, in folders of their own."""
    rng = random.Random(5)
    main = [(f"e{i % 380}", rng.choice(["k1", "k2", None]), rng.choice(["p1", "p2", "p3", None]), rng.choice(["c1", "c2"]), rng.choice([i, None]),
             rng.choice([i, None]), i % 17, rng.choice([100, None])) for i in range(400)]
    main.append((None, "k1", "p1", "c1", 1, 1, 1, 1))
    tags = [(f"e{rng.randrange(390)}", rng.choice(["realm", "biome", "other"]), f"v{rng.randrange(40)}") for _ in range(1500)]
    tags += [("e7", "biome", f"v{i}") for i in range(700)] + [(None, "realm", "v1"), ("e1", None, "v1"), ("e1", "realm", None)]
    root = tmp_path_factory.mktemp("facet")
    spark.createDataFrame(main, "accession string, kingdom string, phylum string, class string, tax_id int, x_count long, y_count long, total long"
                          ).repartition(3).write.parquet(f"{root}/main")
    spark.createDataFrame(tags, "accession string, level string, value string").distinct().repartition(3).write.parquet(f"{root}/tags")
    t = FacetTables(spark.read.parquet(f"{root}/main"), spark.read.parquet(f"{root}/tags"), spark.range(3).select(F.col("id").cast("string").alias("accession")))
    return t, str(root)


SPECS = [FilterSpec(), FilterSpec.build(tag_values=["v1", "v2"]), FilterSpec.build(ranks={"kingdom": ["k1"]}, tag_levels=["realm"]),
         FilterSpec.build(ranks={"phylum": ["p1", "p2"]}, tag_levels=["biome"], tag_values=["v3", "v600"]), FilterSpec.build(tag_levels=["none"])]


def test_bucketed_tables_join_without_exchange(spark, facet, rows):
    t, root = facet
    bucketed = replace(RANKED, buckets=4)
    write_tables(t, f"{root}/bucketed", bucketed)
    b = read_tables(spark, f"{root}/bucketed", bucketed)
    again = spark.newSession()
    again.sql(f"DROP TABLE IF EXISTS {tables.table_name('nothing')}")
    for spec in SPECS:
        assert rows(filters.apply_filters(b.main, b.tags, spec, bucketed)) == rows(filters.apply_filters(t.main, t.tags, spec, RANKED))
        assert rows(kpi.tag_distinct_counts(b.main, b.tags, spec, bucketed)) == rows(kpi.tag_distinct_counts(t.main, t.tags, spec, RANKED))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan_of(filters.apply_filters(b.main, b.tags, SPECS[1], bucketed))
        plan = plan_of(kpi.tag_distinct_counts(b.main, b.tags, SPECS[1], bucketed))
        assert "SortMergeJoin" in plan and not re.search(r"Exchange hashpartitioning\(accession|Exchange hashpartitioning\(_key", plan)
        assert "Exchange hashpartitioning(accession" in plan_of(filters.apply_filters(t.main, t.tags, SPECS[1], RANKED))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    with pytest.raises(ValueError, match="buckets"):
        read_tables(spark, f"{root}/bucketed", RANKED)


def test_bucketed_tables_open_in_another_application(spark, facet, rows):
    """What another application would do: the catalog doesn't know the table, the files are there."""
    t, root = facet
    path = f"{root}/again/tags"
    tables.write_bucketed(t.tags, path, "accession", 3)
    spark.sql(f"DROP TABLE {tables.table_name(path)}")
    opened = tables.open_bucketed(spark, path, "accession", 3)
    assert rows(opened) == rows(t.tags)
    assert "Exchange" not in plan_of(opened.groupBy("accession").count())


@pytest.fixture(scope="module")
def indexed(spark, facet):
    t, root = facet
    numbered = browse.write_numbered(t.main, RANKED, f"{root}/entities", ["kingdom"])
    tag_index.write_tag_index(tag_index.build_tag_index(numbered, t.tags, RANKED), f"{root}/index", RANKED)
    return numbered, spark.read.parquet(f"{root}/index")


def test_tag_index_answers_like_the_tags(facet, indexed, rows):
    t, _ = facet
    numbered, index = indexed
    for spec in SPECS:
        got = tag_index.filter_indexed(numbered, index, spec, RANKED)
        assert rows(got.drop("row_no")) == rows(filters.apply_filters(t.main, t.tags, spec, RANKED))
        counts = tag_index.tag_counts_indexed(numbered, index, spec, RANKED)
        assert rows(counts) == rows(kpi.tag_distinct_counts(t.main, t.tags, spec, RANKED))
        for frame in (got, counts):
            assert not [f for f in frame.inputFiles() if "/tags/" in f]


def test_bitmaps_over_many_parts(spark):
    """Numbers on both sides of the borders of bitmaps and bytes."""
    numbered = spark.range(1, 70_001).select(F.concat(F.lit("e"), F.col("id")).alias("accession"), F.col("id").alias("row_no"))
    wanted = [1, 7, 8, 9, 16, 32767, 32768, 32769, 65536, 65537, 70_000]
    tags = spark.createDataFrame([(f"e{i}", "realm", "in") for i in wanted] * 2, "accession string, level string, value string")
    index = tag_index.build_tag_index(numbered, tags, RANKED)
    got = tag_index.filter_indexed(numbered, index, FilterSpec.build(tag_values=["in"]), RANKED)
    assert sorted(r.row_no for r in got.collect()) == wanted and index.count() == 3


@pytest.fixture(scope="module")
def summed(spark, facet):
    t, root = facet
    summaries.write_rollup(summaries.build_rollup(t.main, RANKED), f"{root}/rollup", RANKED)
    summaries.write_paths(summaries.build_paths(t.main, RANKED), f"{root}/paths", RANKED)
    return spark.read.parquet(f"{root}/rollup"), spark.read.parquet(f"{root}/paths")


def test_rollup_answers_like_the_entities(facet, summed, rows):
    t, _ = facet
    rollup, _ = summed
    specs = [FilterSpec(), FilterSpec.build(ranks={"kingdom": ["k1"]}), FilterSpec.build(ranks={"class": ["c1"], "phylum": ["p1", "p3"]})]
    for spec in specs:
        for rank in RANKED.ranks:
            got = summaries.composition_rolled(rollup, spec, RANKED, rank)
            assert rows(got) == rows(composition.composition(t.main, None, spec, RANKED, rank))
            assert not [f for f in got.inputFiles() if "/main/" in f]
        assert rows(summaries.totals_rolled(rollup, spec, RANKED)) == rows(composition.measure_totals(t.main, None, spec, RANKED))
    path = [{"rank": "kingdom", "value": "k1"}]
    assert rows(summaries.drill_rolled(rollup, FilterSpec(), RANKED, path)) == rows(composition.composition_drill(t.main, None, FilterSpec(), RANKED, path))
    assert rollup.agg(F.sum("entities")).first()[0] == 3 * t.main.count()
    assert "depth" in re.search(r"PartitionFilters: \[(.*?)\]", plan_of(summaries.composition_rolled(rollup, specs[1], RANKED, "phylum"))).group(1)
    for spec in (FilterSpec.build(share=ShareRange("x", 1, 2)), FilterSpec.build(tag_levels=["realm"]), FilterSpec.build(ranks={"tax_id": ["1"]}),
                 FilterSpec.build(climate_ranges={"total": (1, 2)})):
        with pytest.raises(ValueError):
            summaries.composition_rolled(rollup, spec, RANKED, "phylum")


def test_paths_answer_like_the_entities(facet, summed, rows):
    t, _ = facet
    _, paths = summed
    assert paths.count() == t.main.select(*RANKED.facets).distinct().count()
    chosen = {"kingdom": ["k1"], "phylum": ["p1", "p2"]}
    assert rows(options.cascaded_options(paths, chosen, RANKED)) == rows(options.cascaded_options(t.main, chosen, RANKED))
    assert rows(options.prune_selections(paths, chosen, RANKED)) == rows(options.prune_selections(t.main, chosen, RANKED))
    spec = FilterSpec.build(ranks={"kingdom": ["k1"]})
    got = dict(summaries.rank_counts(paths, spec, RANKED).collect())
    kept = filters.apply_filters(t.main, None, spec, RANKED)
    assert got == {**{r: kept.select(r).distinct().dropna().count() for r in RANKED.ranks}, "accessions": kept.count()}


def test_sketches_stay_within_their_error(spark):
    ds = replace(RANKED, ranks=("kingdom", "phylum", "class"))
    main = spark.range(60_000).select(
        F.concat(F.lit("e"), F.col("id") % 50_000).alias("accession"), F.concat(F.lit("k"), F.col("id") % 3).alias("kingdom"),
        F.when(F.col("id") % 10 != 0, F.concat(F.lit("p"), F.col("id") % 700)).alias("phylum"), F.concat(F.lit("c"), F.col("id") % 20_011).alias("class"),
        F.col("id").alias("tax_id"))
    sketches = summaries.build_sketches(main, ds).cache()
    for spec in (FilterSpec(), FilterSpec.build(ranks={"kingdom": ["k1", "k2"]}), FilterSpec.build(ranks={"phylum": ["p1", "p2", "p3"]}),
                 FilterSpec.build(ranks={"kingdom": ["none"]})):
        kept = filters.apply_filters(main, None, spec, ds)
        told = dict(summaries.rank_counts_sketched(sketches, spec, ds).collect())
        for figure, column in [(r, r) for r in ds.ranks] + [("accessions", "accession")]:
            exact = kept.select(column).distinct().dropna().count()
            assert abs(told[figure] - exact) <= 0.05 * exact, (spec, figure)
    with pytest.raises(ValueError):
        summaries.rank_counts_sketched(sketches, FilterSpec.build(ranks={"class": ["c1"]}), ds)


# ---- publication ------------------------------------------------------------
def test_a_failed_publication_leaves_the_old_tables(spark, facet, rows):
    t, root = facet
    out = f"{root}/published"
    write_tables(t, out, RANKED)
    broken = t.children.withColumn("accession", F.raise_error(F.lit("no third table")))
    with pytest.raises(Exception, match="no third table"):
        write_tables(FacetTables(t.main.limit(1), t.tags.limit(1), broken), out, RANKED)
    back = read_tables(spark, out, RANKED)
    assert rows(back.main) == rows(t.main) and rows(back.tags) == rows(t.tags) and rows(back.children) == rows(t.children)
    write_tables(FacetTables(t.main.limit(1), t.tags, t.children), out, RANKED)
    assert read_tables(spark, out, RANKED).main.count() == 1
    assert rows(back.main) == rows(t.main)          # a reader keeps the version it has opened


def test_publications_at_once_do_not_mix(spark, facet):
    t, root = facet
    out = f"{root}/raced"
    one = [FacetTables(*[x.withColumn("run", F.lit(n)) for x in t]) for n in range(4)]
    threads = [threading.Thread(target=write_tables, args=(x, out, RANKED)) for x in one]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert tables.manifests(spark, out).count() == 4
    back = read_tables(spark, out, RANKED)
    assert len({x.first().run for x in back}) == 1


def test_the_source_is_read_once(spark, facet, rows, monkeypatch):
    """The source disappears as soon as the entity table is written."""
    _, root = facet
    source = spark.createDataFrame(
        [("a", [("biome", 3)], (([["x", "y"], ["x"]],),), [("o1",)]), ("b", [], (([["z"]],),), []), (None, [], None, [("o2",)])],
        "accession string, gene_biotypes array<struct<gene_biotype: string, gene_biotype_count: int>>, "
        "biogeo_Ecoregion struct<realm: struct<values: array<array<string>>>>, gbif_occs array<struct<occurrenceID: string>>")
    source.write.parquet(f"{root}/nested")
    opened = spark.read.parquet(f"{root}/nested")
    whole = flatten.build_all(opened, GENOME_SOURCE, GENOME)
    want = [rows(x) for x in whole]
    write = flatten.write_main

    def then_gone(*args):
        write(*args)
        shutil.rmtree(f"{root}/nested")

    monkeypatch.setattr(flatten, "write_main", then_gone)
    got = flatten.run_etl(spark, f"{root}/nested", f"{root}/etl", GENOME_SOURCE, GENOME, cluster_by=("kingdom",))
    assert got.main.columns == whole.main.columns and [rows(x) for x in got] == want


def test_plain_folders_still_open(spark, facet, rows):
    t, root = facet
    tables.write_main(t.main, f"{root}/plain", RANKED)
    tables.write_tags(t.tags, f"{root}/plain", RANKED)
    tables.write_children(t.children, f"{root}/plain", RANKED)
    assert rows(read_tables(spark, f"{root}/plain", RANKED).tags) == rows(t.tags)


# ---- figures ----------------------------------------------------------------
def test_a_hot_entity_has_its_tags_in_several_tasks(spark, facet):
    """A list over the limit is cut by ranges: its parts are in order, whole, and in different partitions."""
    t, _ = facet
    levels = ["realm", "biome"]
    whole = {(r.accession, r.level): r["values"] for r in kpi.tags_by_entity(t.tags, t.main, levels, RANKED).collect()}
    cut = kpi.tags_by_entity(t.tags, t.main, levels, RANKED, most=100).withColumn("task", F.spark_partition_id()).collect()
    lists = {}
    for r in sorted(cut, key=lambda r: r.part):
        assert r.part == len(lists.setdefault((r.accession, r.level), []))
        lists[r.accession, r.level].append(r["values"])
    assert {k: sum(v, []) for k, v in lists.items()} == whole
    hot = [r for r in cut if (r.accession, r.level) == ("e7", "biome")]
    assert len(hot) > 1 and max(len(r["values"]) for r in hot) < 600 and len(whole["e7", "biome"]) >= 700
    assert all(len(v) == 1 for k, v in lists.items() if k != ("e7", "biome"))


def test_extents_of_whole_numbers_come_from_statistics(spark, facet):
    t, root = facet
    t.main.withColumn("x_real", F.col("x_count").cast("double")).write.parquet(f"{root}/stats")
    columns = ["x_count", "total", "x_real", "none"]
    want = kpi.extents(spark.read.parquet(f"{root}/stats"), columns).collect()
    spark.conf.set("spark.sql.sources.useV1SourceList", "")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        got = kpi.extents(spark.read.parquet(f"{root}/stats"), columns)
        plan = plan_of(got)
        assert "PushedAggregation: [MIN(x_count), MAX(x_count), MIN(total), MAX(total)]" in plan
        assert sorted(got.collect(), key=lambda r: r.column) == sorted(want, key=lambda r: r.column)
    finally:
        spark.conf.unset("spark.sql.sources.useV1SourceList")
        spark.conf.unset("spark.sql.parquet.aggregatePushdown")
