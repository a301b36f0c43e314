from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from facetspark.genome import GENOME
from facetspark.operators import filters, kpi
from facetspark.operators.filters import apply_filters, read_filtered
from facetspark.spec import FilterSpec

DS = replace(GENOME, ranks=("kingdom", "phylum"), measures=("m", "n"), tag_levels=("realm", "biome"), category="cat")


@pytest.fixture(scope="module")
def main(spark):
    nan = float("nan")
    return spark.createDataFrame([
        ("A", "K1", "P1", 1, 1.0, 10, 30, 100, 10.0, 30.0, 5.0),
        ("B", "K1", "P2", 2, nan, 20, 0, 100, 20.0, 0.0, 6.0),
        ("C", "K2", "P1", 3, None, 5, 5, 0, 50.0, 50.0, 5.0),
        ("D", None, "P3", 4, 3.0, None, 5, 100, None, 5.0, None),
        ("E", "K2", None, 5, 4.0, 7, 7, None, nan, 7.0, 5.0),
        ("A", "K2", "P1", 6, 5.0, 90, 10, 100, 90.0, 10.0, 7.0),
    ], "accession string, kingdom string, phylum string, tax_id long, x double, m_count long, n_count long, "
       "total_gene_biotypes long, m_percentage float, n_percentage float, cat double")


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame([
        ("A", "realm", "r1"), ("A", "biome", "b1"), ("B", "realm", "b1"), ("C", "biome", "b2"), (None, "realm", "r1"),
    ], "accession string, level string, value string")


def ids(df):
    return sorted(r["tax_id"] for r in df.select("tax_id").collect())


def apply(main, tags=None, ds=DS, **parts):
    return ids(apply_filters(main, tags, FilterSpec.build(**parts), ds))


def test_ranks_are_or_inside_and_across(main):
    assert apply(main, ranks={"kingdom": ["K1", "K2"], "phylum": ["P1"]}) == [1, 3, 6]
    assert apply(main, ranks={"kingdom": [" K1 "]}) == [1, 2]
    assert apply(main, ranks={"tax_id": ["2.9", "3"]}) == [2, 3]
    assert apply(main, ranks={"tax_id": ["many"]}) == [1, 2, 3, 4, 5, 6]     # nothing usable: no filter
    assert apply(main, ranks={"tax_id": ["1e30"]}) == []                     # usable, but matches nothing
    with pytest.raises(ValueError):
        apply(main, ranks={"nope": ["x"]})


def test_category_facet_coerces(main):
    assert apply(main, categories=["5.0", "hot"]) == [1, 3, 5]
    assert apply(main, categories=["hot"]) == [1, 2, 3, 4, 5, 6]


def test_ranges_are_inclusive_and_drop_null_and_nan(main):
    assert apply(main, climate_ranges={"x": (1, 4)}) == [1, 4, 5]
    assert apply(main, climate_ranges={"x": (1, float("inf"))}) == [1, 4, 5, 6]
    assert apply(main, climate_ranges={"x": (1, 4)}, area_ranges={"tax_id": (1.5, 4.5), "nope": (0, 1)}) == [4]
    assert apply(main, climate_ranges={"x": ("a", 4)}) == [1, 2, 3, 4, 5, 6]
    assert apply(main, climate_ranges={"tax_id": (1.2, 1.8)}) == []
    assert apply(main, climate_ranges={"x": (float("nan"), 4)}) == []


def test_same_column_in_both_range_groups_is_intersected(main):
    assert apply(main, climate_ranges={"tax_id": (1, 4)}, area_ranges={"tax_id": (3, 6)}) == [3, 4]


def test_share_uses_stored_column(main):
    assert apply(main, share=("m", 10, 50)) == [1, 2, 3]
    assert apply(main, share=("unknown", 10, 50)) == [1, 2, 3, 4, 5, 6]
    assert ids(apply_filters(main, None, FilterSpec.build(share=("m", 10, 50)), DS, apply_share=False)) == [1, 2, 3, 4, 5, 6]


def test_share_is_computed_without_the_stored_column(main):
    bare = main.drop("m_percentage", "n_percentage")
    assert apply(bare, share=("m", 10, 50)) == [1, 2]               # total 0 and null drop the row
    no_total = bare.drop("total_gene_biotypes")
    assert apply(no_total, share=("m", 25, 50)) == [1, 3, 5]        # denominator: sum of all counts


def test_stored_and_computed_share_agree_on_whole_numbers(main):
    whole = main.where("total_gene_biotypes = 100")
    bare = whole.drop("m_percentage")
    assert apply(whole, share=("m", 10, 20)) == apply(bare, share=("m", 10, 20)) == [1, 2]


def test_tags_need_one_row_matching_both(main, tags):
    assert apply(main, tags, tag_levels=["realm"], tag_values=["b1"]) == [2]
    assert apply(main, tags, tag_values=["b1"]) == [1, 2, 6]
    assert apply(main, tags, tag_levels=["biome"]) == [1, 3, 6]
    assert apply(main, tags, tag_values=["nothing"]) == []
    with pytest.raises(ValueError):
        apply(main, None, tag_values=["b1"])
    got = filters.entities_with_tags(tags, FilterSpec.build(tag_values=["b1"]), DS)
    assert sorted(r[0] for r in got.collect()) == ["A", "B"]


@pytest.mark.parametrize("kind", ["string", "int", "long"])
def test_keys_of_one_type_match_and_of_two_are_refused(spark, kind):
    left = spark.createDataFrame([(1,), (2,), (3,)], "accession int").select(F.col("accession").cast(kind))
    right = spark.createDataFrame([(2,), (3,), (3,)], "accession int")
    same = right.select(F.col("accession").cast(kind))
    for hot in (False, True):
        assert sorted(str(r[0]) for r in filters.keep_keys(left, "accession", same, "accession", hot).collect()) == ["2", "3"]
        with pytest.raises(ValueError):
            filters.keep_keys(left, "accession", right.select(F.col("accession").cast("double")), "accession", hot)


def test_everything_at_once(main, tags):
    assert apply(main, tags, ranks={"kingdom": ["K1", "K2"]}, tag_values=["b1"], share=("m", 0, 95),
                 climate_ranges={"x": (0, 10)}) == [1, 6]


def test_read_filtered_projects_existing_columns_once(main):
    df = read_filtered(main, None, FilterSpec(), DS, ["x", "nope", "tax_id", "x"])
    assert df.columns == ["x", "tax_id"]


def test_filters_reach_the_parquet_scan(spark, main, tmp_path):
    main.write.parquet(f"{tmp_path}/m")
    stored = spark.read.parquet(f"{tmp_path}/m")
    spec = FilterSpec.build(ranks={"kingdom": ["K1"], "tax_id": ["1"]}, share=("m", 5, 50),
                            climate_ranges={"x": (0, 2)}, area_ranges={"n_count": (0.5, 90.5)})
    df = read_filtered(stored, None, spec, DS, ["accession"])
    formatted = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for name in ("EqualTo(kingdom,K1)", "EqualTo(tax_id,1)", "GreaterThanOrEqual(x", "GreaterThanOrEqual(n_count,1)", "LessThanOrEqual(n_count,90)",
                 "GreaterThanOrEqual(m_percentage"):
        assert name in formatted.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "phylum" not in formatted and "Python" not in formatted


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
}


@pytest.fixture
def hot(spark, tmp_path):
    """A table and a tag table where one key has a third of all rows, and settings small enough to split it."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
    noise = F.sha2(F.col("id").cast("string"), 256)
    spark.range(60_000).select(key.alias("accession"), noise.alias("payload"), F.col("id").alias("tax_id")).write.parquet(f"{tmp_path}/m")
    spark.range(90_000).select(key.alias("accession"), F.lit("realm").alias("level"), noise.alias("value")).write.parquet(f"{tmp_path}/t")
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield spark.read.parquet(f"{tmp_path}/m"), spark.read.parquet(f"{tmp_path}/t")
    for k in SKEW:
        spark.conf.unset(k)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def test_hot_key_is_split_under_an_aggregate(hot):
    main, tags = hot
    df = filters.keep_keys(main, "accession", tags, "accession", hot=True).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("payload").alias("d"), F.sum("tax_id").alias("s"))
    assert tuple(df.collect()[0]) == (60_000, 60_000, sum(range(60_000)))
    assert "skew=true" in final_plan(df)


def test_hot_key_is_split_even_before_grouping_by_it(hot):
    main, tags = hot
    df = filters.keep_keys(main, "accession", tags, "accession", hot=True).groupBy("accession").agg(
        F.count(F.lit(1)).alias("n"), F.max("payload").alias("p"))
    assert max(r["n"] for r in df.collect()) == 20_000
    assert "skew=true" in final_plan(df)


def test_hot_entity_is_split_when_its_tags_are_listed(hot):
    main, tags = hot
    df = kpi.tags_by_entity(tags, main, ["realm"], DS, parts=30)
    got = [(r["accession"], len(r["values"])) for r in df.collect()]
    assert sum(n for _, n in got) == tags.join(main, "accession", "left_semi").count()
    sizes = [n for k, n in got if k == "hot"]
    assert sum(sizes) == 30_000 and len(sizes) == 30 and max(sizes) < 1_300
    assert "skew=true" in final_plan(df)
