"""Steps whose cost has to grow no faster than their input."""

import re

from pyspark.sql import functions as F

from facetspark.operators import filters, kpi, tag_index
from facetspark.plans import fixtures
from facetspark.plans.fixtures import DATASET


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_by_customer_once(spark, sf_dir, monkeypatch, rows):
    tags, main = fixtures.flat_tags(spark, sf_dir), fixtures.flat_main(spark, sf_dir)
    assert len(re.findall(r"Exchange hashpartitioning\(accession", plan_of(tags))) == 1
    assert not re.search(r"Exchange hashpartitioning\([^)]*p_type", plan_of(main))
    # a customer with many lines: every grouping deals its own
    monkeypatch.setattr(fixtures, "MANY", 1)
    assert re.search(r"Exchange hashpartitioning\([^)]*p_type", plan_of(fixtures.flat_main(spark, sf_dir)))
    assert rows(fixtures.flat_tags(spark, sf_dir)) == rows(tags)
    assert rows(fixtures.flat_main(spark, sf_dir)) == rows(main)


def test_what_is_written_in_order_is_made_once(spark, sf_dir, tmp_path, monkeypatch, rows):
    """An ordered write samples its rows: it reads them, and no join or grouping runs twice."""
    plans = []
    writes = {name: getattr(fixtures, name) for name in ("write_main", "write_tags")}
    for name, write in writes.items():
        monkeypatch.setattr(fixtures, name, lambda df, *more, write=write: (plans.append(plan_of(df)), write(df, *more)))
    tables = fixtures.PublishedTables(spark, sf_dir)
    tables._folder = str(tmp_path)
    main, tags = tables.main, tables.tags
    assert len(plans) == 2
    for plan in plans:
        assert plan.count("FileScan parquet") == 1 and not re.search("Exchange|Aggregate|Join", plan)
    assert rows(main) == rows(fixtures.flat_main(spark, sf_dir)) and rows(tags) == rows(fixtures.flat_tags(spark, sf_dir))
    assert {p.name for p in tmp_path.iterdir()} == {DATASET.main_file, DATASET.tag_file}


def test_tasks_of_the_tags_grow_in_number(spark, sf_dir, monkeypatch, rows):
    whole = fixtures.flat_tags(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    monkeypatch.setattr(fixtures, "TASK", 500)
    cut = fixtures.flat_tags(spark, sf_dir)
    assert re.search(rf"Exchange hashpartitioning\(accession#\d+, {round(lines / 500)}\)", plan_of(cut))
    assert rows(cut) == rows(whole)


def test_index_grows_with_the_tags(spark, rows):
    """Rare values are listed, a common one is a bitmap; both are found, and no map task sends bitmaps."""
    numbered = spark.range(1, 70_001).select(F.concat(F.lit("e"), F.col("id")).alias("accession"), F.col("id").alias("row_no"), (F.col("id") % 3).alias("kingdom"))
    rare = spark.range(1, 70_001, 50).select(
        F.concat(F.lit("e"), F.col("id")).alias("accession"), F.lit("biome").alias("level"), F.concat(F.lit("v"), F.col("id") % 700).alias("value"))
    common = spark.range(1, 70_001, 2).select(F.concat(F.lit("e"), F.col("id")).alias("accession"), F.lit("realm").alias("level"), F.lit("common").alias("value"))
    tags = rare.unionAll(rare).unionAll(common)
    index = tag_index.build_tag_index(numbered, tags, DATASET)
    assert index.agg(F.sum(F.coalesce(F.octet_length("bits"), 2 * F.size("places")))).first()[0] <= 4 * 4096 + 2 * 1400
    assert "partial_bitmap_construct_agg" not in plan_of(index).split("Exchange hashpartitioning(level", 1)[1]
    for spec in (filters.FilterSpec.build(tag_values=["v1", "common"]), filters.FilterSpec.build(tag_values=["v1", "v51"]), filters.FilterSpec.build(tag_levels=["biome"])):
        got = tag_index.filter_indexed(numbered, index, spec, DATASET)
        assert rows(got) == rows(filters.apply_filters(numbered, tags, spec, DATASET)) and got.count()
        assert rows(tag_index.tag_counts_indexed(numbered, index, spec, DATASET)) == rows(kpi.tag_distinct_counts(numbered, tags, spec, DATASET))
