from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from facetspark.genome import GENOME
from facetspark.functions.columns import markdown_link, thousands
from facetspark.operators import browse, options
from facetspark.spec import FilterSpec

DS = replace(GENOME, ranks=("kingdom", "phylum"), measures=("m",), urls=("url",), tag_levels=("realm", "biome"))


@pytest.fixture(scope="module")
def main(spark):
    return spark.createDataFrame([
        (f"E{i:03d}", ["K1", "K2", None][i % 3], f"P{i % 4}", i, float(i % 10), f"www.h{i}.org") for i in range(60)
    ], "accession string, kingdom string, phylum string, tax_id long, x double, url string")


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame([
        ("E001", "realm", "r2"), ("E001", "realm", "r1"), ("E002", "biome", "b1"), ("E003", "biome", None),
    ], "accession string, level string, value string")


def column(df, name="value"):
    return [r[name] for r in df.collect()]


# ---- pages ------------------------------------------------------------------
def walk(main, columns, size, order_by=(), spec=FilterSpec()):
    """All rows, page by page, each found by the cursor of the one before."""
    shown, cursor = [], None
    while True:
        page = browse.page_rows(main, None, spec, DS, columns, 1, size, order_by=order_by, after=cursor).collect()
        if not page:
            return shown
        shown += page
        cursor = browse.next_cursor(page, DS, columns, order_by, cursor)


def test_pages_cover_the_rows_once_in_order(main):
    spec = FilterSpec.build(ranks={"kingdom": ["K1", "K2"]})
    pages = [column(browse.page_rows(main, None, spec, DS, ["tax_id"], p, 15), "tax_id") for p in range(1, 5)]
    assert [len(p) for p in pages] == [15, 15, 10, 0]
    assert sum(pages, []) == [i for i in range(60) if i % 3 != 2]
    total = browse.count_rows(main, None, spec, DS).first()["rows"]
    assert total == sum(map(len, pages))


def test_page_below_one_is_the_first(main):
    assert column(browse.page_rows(main, None, FilterSpec(), DS, ["tax_id"], -3, 2), "tax_id") == [0, 1]


def test_every_path_shows_rows_of_repeated_keys_once(spark, tmp_path):
    """Three keys, nulls and whole copies of rows: all pages together are the table."""
    rows = [(f"k{i % 3}", None if i % 7 == 0 else float(i % 5), i % 40) for i in range(200)]
    table = spark.createDataFrame(rows, "accession string, x double, n long").repartition(6)
    columns, order = ["accession", "x", "n"], ["-x"]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0], r[2]))
    pages = [browse.page_rows(table, None, FilterSpec(), DS, columns, p, 50, order_by=order) for p in range(1, 6)]
    assert [tuple(r) for p in pages for r in p.collect()] == want
    assert [tuple(r) for r in walk(table, columns, 70, order)] == want
    assert [tuple(r) for r in walk(table, columns, 60)] == sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))
    numbered = browse.write_numbered(table, DS, f"{tmp_path}/n", order)
    assert [tuple(r) for p in range(1, 6) for r in browse.page_of(numbered, p, 50).collect()] == want


def test_cursor_needs_its_columns(main):
    with pytest.raises(ValueError):
        browse.next_cursor([], DS, ["tax_id"])
    assert browse.next_cursor([], DS, ["accession"]) is None


def test_cursor_reaches_the_scan(spark, main, tmp_path):
    main.write.parquet(f"{tmp_path}/m")
    page = browse.page_rows(spark.read.parquet(f"{tmp_path}/m"), None, FilterSpec(), DS, ["accession"], 1, 5, after=browse.Cursor(("E030",), 1))
    assert column(page, "accession") == ["E031", "E032", "E033", "E034", "E035"]
    assert "GreaterThanOrEqual(accession,E030)" in page._jdf.queryExecution().executedPlan().toString()


def test_column_filters_and_order(main):
    df = browse.page_rows(
        main, None, FilterSpec(), DS, ["accession", "x"], 1, 5,
        column_filters=[browse.ColumnFilter("accession", "contains", "e0"), browse.ColumnFilter("x", "between", 2, 9),
                        browse.ColumnFilter("tax_id", "less", 40), browse.ColumnFilter("tax_id", "greater", 9)],
        order_by=["-x"])
    assert [tuple(r) for r in df.collect()] == [
        ("E019", 9.0), ("E029", 9.0), ("E039", 9.0), ("E018", 8.0), ("E028", 8.0)]
    with pytest.raises(ValueError):
        browse.column_predicate(main, browse.ColumnFilter("x", "like", 1))


@pytest.mark.parametrize("op,value,upper,want", [
    ("equals", "k1", None, lambda k, i: k == "K1"), ("not_equal", "k1", None, lambda k, i: k != "K1"),
    ("not_contains", "1", None, lambda k, i: k != "K1"), ("starts_with", "k", None, lambda k, i: k is not None),
    ("ends_with", "2", None, lambda k, i: k == "K2"), ("blank", None, None, lambda k, i: k is None),
    ("not_blank", None, None, lambda k, i: k is not None), ("at_most", "k1", None, lambda k, i: k == "K1"),
])
def test_text_operators(main, op, value, upper, want):
    got = main.where(browse.column_predicate(main, browse.ColumnFilter("kingdom", op, value, upper)))
    assert sorted(column(got, "tax_id")) == [i for i in range(60) if want(["K1", "K2", None][i % 3], i)]


@pytest.mark.parametrize("op,value,upper,want", [
    ("equals", "3", None, lambda i: i == 3), ("equals", 3.5, None, lambda i: False), ("not_equal", 3, None, lambda i: i != 3),
    ("less", 3.5, None, lambda i: i < 3.5), ("at_most", 3, None, lambda i: i <= 3), ("greater", "56.5", None, lambda i: i > 56.5),
    ("at_least", 57, None, lambda i: i >= 57), ("between", 2.5, "4.5", lambda i: 2.5 <= i <= 4.5), ("less", 1e300, None, lambda i: True),
    ("greater", "1e400", None, lambda i: False), ("at_least", "-inf", None, lambda i: True), ("between", 9, 3, lambda i: False),
])
def test_number_operators(main, op, value, upper, want):
    for name, kind in (("tax_id", "long"), ("d", "double"), ("c", "decimal(20,2)")):
        if kind.startswith("decimal") and str(value) in ("1e400", "-inf", "1e+300"):
            continue
        table = main.withColumn(name, F.col("tax_id").cast(kind))
        got = table.where(browse.column_predicate(table, browse.ColumnFilter(name, op, value, upper)))
        assert sorted(column(got, "tax_id")) == [i for i in range(60) if want(i)], kind


def test_numbers_keep_every_digit_and_reach_the_scan(spark, tmp_path):
    big = 2**53 + 1
    spark.createDataFrame([(big - 1,), (big,)], "n long").write.parquet(f"{tmp_path}/n")
    table = spark.read.parquet(f"{tmp_path}/n")
    got = table.where(browse.column_predicate(table, browse.ColumnFilter("n", "equals", str(big))))
    assert column(got, "n") == [big]
    assert f"EqualTo(n,{big})" in got._jdf.queryExecution().executedPlan().toString()
    assert browse.column_predicate(table, browse.ColumnFilter("n", "less", "many")) is None


def test_numbering_spreads_copies_of_a_hot_key(spark, tmp_path):
    """A third of the rows are copies of one row; numbers are still 1..n, each once."""
    hot = spark.range(9_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("accession"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = browse.write_numbered(hot.repartition(6), DS, f"{tmp_path}/n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stats = numbered.agg(F.count("row_no"), F.min("row_no"), F.max("row_no"), F.countDistinct("row_no")).first()
    assert tuple(stats) == (9_000, 1, 9_000, 9_000)
    keys = column(numbered.orderBy("row_no"), "accession")
    assert keys == sorted(keys)
    assert column(browse.page_of(numbered, 2, 3), "accession") == keys[3:6]
    assert numbered.where("accession = 'hot'").select(F.input_file_name().alias("f")).distinct().count() > 1


def test_grid_is_filtered_and_sorted(main):
    picks = [browse.ColumnFilter("tax_id", "at_least", 10)]
    view = browse.grid(main, None, FilterSpec.build(ranks={"phylum": ["P1"]}), DS, ["accession", "url"], 1, 2, picks, ["-accession"])
    assert column(view.rows, "accession") == ["E057", "E053"] and view.total.first()["rows"] == 12


def test_grid_links_and_total(main):
    view = browse.grid(main, None, FilterSpec.build(ranks={"phylum": ["P1"]}), DS, ["url", "accession"], 1, 2)
    assert view.rows.columns == ["accession", "url"]
    assert [tuple(r) for r in view.rows.collect()] == [
        ("E001", "[h1.org](https://www.h1.org)"), ("E005", "[h5.org](https://www.h5.org)")]
    assert view.total.first()["rows"] == 15


def test_links(spark):
    cases = {
        None: "", "  ": "", "example.org": "[example.org](https://example.org)",
        " http://WWW.Example.org:80/a?b#c ": "[example.org](http://WWW.Example.org:80/a?b#c)",
        "HTTPS://user:pw@a.www.b.org/x": "[a.b.org](HTTPS://user:pw@a.www.b.org/x)",
        "https://my_host/x": "[my_host](https://my_host/x)", "https:///nohost": "[https:///nohost](https:///nohost)",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string").select(markdown_link(F.col("u")).alias("l"))
    assert column(df, "l") == list(cases.values())


def test_thousands_truncates(spark):
    df = spark.createDataFrame([(1234567.9,), (12.0,), (None,)], "n double").select(thousands(F.col("n")).alias("t"))
    assert column(df, "t") == ["1,234,567", "12", None]


# ---- options ----------------------------------------------------------------
def test_distinct_values_sorted_capped_and_as_text(main, tags):
    assert column(options.distinct_values(main, "kingdom", DS)) == ["K1", "K2"]
    few = options.distinct_values(main, "tax_id", DS, limit=3).collect()
    assert [tuple(r) for r in few] == [("0", True), ("1", True), ("10", True)]
    assert len(options.distinct_values(main, "tax_id", DS).collect()) == 60
    assert {r["more"] for r in options.distinct_values(main, "tax_id", DS, limit=60).collect()} == {False}
    spec = FilterSpec.build(tag_values=["r1", "b1"])
    assert column(options.distinct_values(main, "phylum", DS, spec, tags)) == ["P1", "P2"]
    with pytest.raises(ValueError):
        options.distinct_values(main, "nope", DS)


def test_cascade_restricts_by_broader_ranks_only(main, rows):
    picks = {"kingdom": ["K1"], "phylum": ["P0", "P1"]}
    listed = [tuple(r) for r in options.cascaded_options(main, picks, DS).collect()]
    got = rows(options.cascaded_options(main, picks, DS))
    assert listed == got                        # kingdom, phylum, tax_id happen to sort alike
    brute = [i for i in range(60) if i % 3 == 0]
    assert [v for r, v in got if r == "kingdom"] == ["K1", "K2"]
    assert [v for r, v in got if r == "phylum"] == sorted({f"P{i % 4}" for i in brute})
    assert [v for r, v in got if r == "tax_id"] == sorted(str(i) for i in brute if i % 4 in (0, 1))
    few = rows(options.cascaded_options(main, {}, DS, limit=1))
    assert few == [("kingdom", "K1", True), ("phylum", "P0", True), ("tax_id", "0", True)]
    assert {r["more"] for r in options.cascaded_options(main, {}, DS, limit=60).collect()} == {False}


def test_cascade_scans_once(spark, main, tmp_path):
    main.write.parquet(f"{tmp_path}/m")
    plan = options.cascaded_options(spark.read.parquet(f"{tmp_path}/m"), {"kingdom": ["K1"]}, DS)
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def test_pruning(main, tags, rows):
    picks = {"kingdom": ["K1", "gone"], "phylum": ["P1", "P9"], "tax_id": ["9", "2"]}
    assert rows(options.prune_selections(main, picks, DS)) == [
        ("kingdom", "K1"), ("phylum", "P1"), ("tax_id", "9")]
    assert options.prune_selections(main, {}, DS).count() == 0
    assert column(options.prune_tag_values(tags, ["realm"], ["r1", "b1"], DS)) == ["r1"]


def test_tag_options(tags):
    assert column(options.tag_levels(tags, DS)) == ["biome", "realm"]
    assert column(options.tag_values(tags, [], DS)) == ["b1", "r1", "r2"]
    assert options.tag_values(tags, ["realm"], DS, limit=1).collect() == [("r1", True)]
    assert options.tag_levels(tags, DS, limit=5).collect() == [("biome", False), ("realm", False)]
