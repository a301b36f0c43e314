import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetspark.genome import GENOME
from facetspark.operators import composition, kpi, relate
from facetspark.operators.quantiles import banded, exact_quantiles
from facetspark.spec import FilterSpec

DS = replace(GENOME, ranks=("kingdom", "phylum"), measures=("a", "b", "c"), tag_levels=("realm", "biome"))
NAN = float("nan")


@pytest.fixture(scope="module")
def main(spark):
    return spark.createDataFrame([
        ("A", "K1", "P1", 1, 10, 5, 0, 20, 50.0, 25.0),
        ("B", "K1", "P1", 2, None, 5, 0, 10, None, 50.0),
        ("C", "K1", "P2", 3, 10, 0, 0, None, NAN, 0.0),
        ("D", None, "P3", 4, 1, 1, 0, 4, 25.0, 25.0),
        ("E", "K2", "P4", 5, 7, 7, 0, 0, 1.0, 1.0),
        (None, "K1", "P1", 6, 1, 1, 0, 100, 1.0, 1.0),
    ], "accession string, kingdom string, phylum string, tax_id long, a_count long, b_count long, c_count long, "
       "total_gene_biotypes long, a_percentage float, b_percentage float")


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame([
        ("A", "realm", "r1"), ("B", "realm", "r1"), ("B", "realm", "r2"), ("B", "realm", None), ("X", "biome", "b1"),
    ], "accession string, level string, value string")


def table(df):
    return [tuple(r) for r in df.collect()]


# ---- totals and composition ---------------------------------------------------
def test_totals_sorted_with_name_as_tie_break(main):
    assert table(composition.measure_totals(main, None, FilterSpec(), DS)) == [("a", 29.0), ("b", 19.0), ("c", 0.0)]
    none = FilterSpec.build(ranks={"kingdom": ["none"]})
    assert table(composition.measure_totals(main, None, none, DS)) == [("a", 0.0), ("b", 0.0), ("c", 0.0)]
    assert composition.measure_totals(main, None, FilterSpec(), DS, ["nope"]).count() == 0


def test_means_skip_null_and_nan_and_ignore_ranges(main):
    spec = FilterSpec.build(climate_ranges={"tax_id": (1, 1)}, share=("a", 99, 100))
    assert table(composition.measure_means(main, None, spec, DS)) == [
        ("a", (50 + 25 + 1 + 1) / 4), ("b", (25 + 50 + 0 + 25 + 1 + 1) / 6)]
    assert table(composition.measure_means(main, None, spec, DS, "count"))[0] == ("a", 29.0)
    none = FilterSpec.build(ranks={"kingdom": ["none"]})
    assert table(composition.measure_means(main, None, none, DS)) == [("a", 0.0), ("b", 0.0)]


def test_composition_by_rank(main):
    got = table(composition.composition(main, None, FilterSpec(), DS, "kingdom"))
    assert got == [
        ("K1", "a", 21 / 130 * 100), ("K1", "b", 11 / 130 * 100), ("K1", "c", 0.0),
        ("NA", "a", 25.0), ("NA", "b", 25.0), ("NA", "c", 0.0)]               # K2 has total 0
    with pytest.raises(ValueError):
        composition.composition(main, None, FilterSpec(), DS, "nope")


def test_composition_without_total_uses_included_counts(main):
    got = table(composition.composition(main.drop("total_gene_biotypes"), None, FilterSpec(), DS, "kingdom", ["a_count", "b_count"]))
    assert got == [("K1", "a", 21 / 32 * 100), ("K1", "b", 11 / 32 * 100), ("K2", "a", 50.0), ("K2", "b", 50.0),
                   ("NA", "a", 50.0), ("NA", "b", 50.0)]


def test_matrix_equals_pivoted_long_form(main):
    long = composition.composition(main, None, FilterSpec(), DS, "phylum")
    pivot = long.groupBy("group").pivot("biotype", ["a", "b", "c"]).agg(F.avg("value")).na.fill(0).orderBy("group")
    assert table(composition.composition_matrix(main, None, FilterSpec(), DS, "phylum")) == table(pivot)


def test_order_ignores_the_share_filter(main):
    spec = FilterSpec.build(share=("b", 50, 100))                              # only B: a=0, b=5
    got = {r["biotype"]: r["biotype_rank"] for r in
           composition.composition_ordered(main, None, spec, DS, "kingdom").collect()}
    assert got == {"a": 1, "b": 2, "c": 3}
    got = {r["biotype"]: r["biotype_rank"] for r in
           composition.composition_ordered(main, None, spec, DS, "kingdom", apply_share=True).collect()}
    assert got == {"b": 1, "a": 2, "c": 3}


def test_drill_groups_by_the_next_rank(main):
    path = [{"rank": "kingdom", "value": "K1"}]
    child = composition.composition_drill(main, None, FilterSpec(), DS, path)
    assert [r["group"] for r in child.where("biotype = 'a'").collect()] == ["P1"]      # P2's total is null
    deepest = composition.composition_drill(main, None, FilterSpec.build(ranks={"phylum": ["P1"]}), DS, [])
    assert {r["group"] for r in deepest.collect()} == {"P1"}
    top = composition.composition_drill(main, None, FilterSpec(), DS, [])
    assert {r["group"] for r in top.collect()} == {"K1", "NA"}


def test_labels(spark):
    ds = replace(GENOME, metric_prefixes=(("ena_", "ENA"),), labels={"x": "The X"})
    df = composition.with_labels(spark.createDataFrame([("ena_q_r",), ("x",), ("z",)], "column string"), "column", ds, ["ena_q_r", "x"])
    assert table(df) == [("ena_q_r", "ENA: q r"), ("x", "The X"), ("z", "z")]


# ---- headline figures -----------------------------------------------------------
def test_summary_counts_are_exact(main, tags):
    got = kpi.kpi_summary(main, tags, FilterSpec(), DS).first().asDict()
    assert got == {"kingdom": 2, "phylum": 4, "accessions": 5, "realm": 2, "biome": 0, "total_genes": 134}
    got = kpi.kpi_summary(main, tags, FilterSpec.build(tag_values=["nothing"]), DS).first().asDict()
    assert set(got.values()) == {0}
    got = kpi.kpi_summary(main, tags, FilterSpec.build(tag_values=["r2"]), DS).first().asDict()
    assert got == {"kingdom": 1, "phylum": 1, "accessions": 1, "realm": 2, "biome": 0, "total_genes": 10}


def test_entities_and_tag_counts(main, tags):
    assert table(kpi.matching_entities(main, tags, FilterSpec.build(tag_values=["r1"]), DS).orderBy("accession")) == [("A",), ("B",)]
    assert dict(table(kpi.tag_distinct_counts(main, tags, FilterSpec.build(ranks={"phylum": ["P1"]}), DS))) == {"realm": 2, "biome": 0}


def test_top_and_its_text(main):
    assert table(kpi.top_measures(main, None, FilterSpec(), DS, 2)) == [("a", 29.0), ("b", 19.0)]
    assert kpi.top_measures_text(main, None, FilterSpec(), DS, 2).first()["text"] == "a: 29 • b: 19"
    none = kpi.top_measures_text(main.drop("a_count", "b_count", "c_count"), None, FilterSpec(), DS)
    assert none.first()["text"] == "No biotypes under current filters"


def test_total_of_top_equals_total_when_measures_are_exhaustive(spark, tags):
    df = spark.createDataFrame([("A", "K", "P", 1, 2, 3, 6), ("B", "K", "P", 4, 5, 6, 15)],
                               "accession string, kingdom string, phylum string, a_count long, b_count long, c_count long, total_gene_biotypes long")
    total = kpi.kpi_summary(df, tags, FilterSpec(), DS).first()["total_genes"]
    assert total == composition.measure_totals(df, None, FilterSpec(), DS).agg(F.sum("count")).first()[0]


def test_extents_and_breakpoints(spark):
    df = spark.createDataFrame([(1.0, NAN, 3, None), (NAN, None, None, None), (8.0, NAN, 7, None)],
                               "x double, allnan double, n long, allnull double")
    got = table(kpi.extents(df, ["x", "allnan", "n", "allnull", "nope"]))
    assert got == [("x", 1.0, 8.0), ("allnan", None, None), ("n", 3.0, 7.0), ("allnull", None, None), ("nope", None, None)]
    ranges = spark.createDataFrame([
        ("a", 0.0, 10.0), ("swap", 10.0, 0.0), ("point", 2.5, 2.5), ("narrow", 0.0, 1.0),
        ("inf", 0.0, float("inf")), ("nan", NAN, 1.0), ("none", None, 1.0)], "column string, min double, max double")
    marks = {}
    for name, mark in table(kpi.breakpoints(ranges)):
        marks.setdefault(name, []).append(mark)
    assert marks == {"a": [0, 2, 5, 8, 10], "swap": [0, 2, 5, 8, 10], "point": [2], "narrow": [0, 1]}


def test_tags_by_entity(spark, tags):
    entities = spark.createDataFrame([("B",), ("B",), ("A",)], "accession string")
    got = table(kpi.tags_by_entity(tags, entities, ["realm"], DS).orderBy("accession"))
    assert got == [("A", "realm", 0, ["r1"]), ("B", "realm", 0, ["r1", "r2"])]
    got = kpi.tags_by_entity(tags, entities, ["realm", "biome"], DS, as_map=True).orderBy("accession")
    assert table(got) == [("A", 0, {"realm": ["r1"]}), ("B", 0, {"realm": ["r1", "r2"]})]


def test_long_tag_lists_come_in_parts_and_are_whole(spark):
    rows = [("hot", "realm", f"v{i:03d}") for i in range(95)] * 2 + [("cold", "realm", f"v{i}") for i in range(10)]
    tags = spark.createDataFrame(rows, "accession string, level string, value string")
    assert len(table(kpi.tags_by_entity(tags, tags, ["realm"], DS))) == 2
    got = table(kpi.tags_by_entity(tags, tags, ["realm"], DS, parts=10))
    hot = [r for r in got if r[0] == "hot"]
    assert {r[2] for r in hot} == set(range(10)) and max(len(r[3]) for r in hot) < 30
    assert sorted(v for r in hot for v in r[3]) == [f"v{i:03d}" for i in range(95)]
    assert all(r[3] == sorted(r[3]) for r in hot)
    assert sorted(v for r in got if r[0] == "cold" for v in r[3]) == [f"v{i}" for i in range(10)]


def test_tag_lists_take_one_pass(spark, tags, tmp_path):
    tags.write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    plan = kpi.tags_by_entity(stored, spark.createDataFrame([("A",)], "accession string"), ["realm"], DS)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") <= 2 and text.count("Exchange") <= 4


# ---- quantiles ------------------------------------------------------------------
def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    data = {"heavy": np.concatenate([np.full(400, 1000.0), rng.lognormal(8, 2, 799)]),
            "signed": rng.normal(0, 1e-3, 257), "one": np.array([3.0]), "two": np.array([-5.0, 7.0]),
            "ints": rng.integers(0, 50, 1000).astype(float)}
    frame = pd.DataFrame([(g, v) for g, vs in data.items() for v in vs], columns=["g", "v"])
    extra = pd.DataFrame([("ints", None), ("ints", np.inf), ("empty", None)], columns=["g", "v"])
    df = spark.createDataFrame(pd.concat([frame, extra])).repartition(5)
    df = df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    probs = [0.05, 0.5, 0.95, 0.0, 1.0]
    whole = {few: {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs, few).collect()} for few in (10, 300, 100_000)}
    assert all(set(got) == set(data) for got in whole.values())
    for g, values, few in [(*item, few) for item in data.items() for few in whole]:
        row = whole[few][g]
        assert (row["n"], row["lowest"], row["highest"]) == (len(values), values.min(), values.max())
        for i, p in enumerate(probs):
            assert row[f"q{i}"] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("low,high", [(0.0, 1e-4), (1e6 - 50, 1e6 + 50), (-1e300, 1e300)])
def test_bands_split_any_range(spark, low, high):
    values = [(0, low + (high / 1000 - low / 1000) * i) for i in range(1000)]
    df = spark.createDataFrame(values, "g int, v double")
    sizes = [r["count"] for r in banded(df, ["g"], "v").groupBy("_band").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) > 50 and max(sizes) < 40
    row = exact_quantiles(df, ["g"], "v", [0.05, 0.5], few=100).first()
    assert [row["q0"], row["q1"]] == pytest.approx(np.quantile([v for _, v in values], [0.05, 0.5]))


def test_nan_counts_for_nothing(spark):
    rows = spark.createDataFrame([("a", "K", 1.0, float("nan")), ("b", "K", float("nan"), 4.0), ("c", "K", 2.0, float("inf"))],
                                 "accession string, kingdom string, m_count double, total_gene_biotypes double")
    ds = replace(GENOME, ranks=("kingdom",), measures=("m",), tag_levels=("realm",))
    assert table(composition.measure_totals(rows, None, FilterSpec(), ds)) == [("m", 3.0)]
    assert table(composition.composition(rows, None, FilterSpec(), ds, "kingdom")) == [("K", "m", 75.0)]
    assert composition.measure_means(rows, None, FilterSpec(), ds, "count").first()["value"] == 3.0
    figures = kpi.kpi_figures(rows, spark.createDataFrame([], "accession string, level string, value string"), FilterSpec(), ds)
    assert dict(figures.collect())["total_genes"] == 4


def test_drill_skips_steps_without_rank_or_value(spark):
    rows = spark.createDataFrame([("a", "K", "P", 1.0)], "accession string, kingdom string, phylum string, m_count double")
    ds = replace(GENOME, ranks=("kingdom", "phylum"), measures=("m",), total=None)
    for odd in ({"rank": "nowhere", "value": "x"}, {"value": "x"}, {"rank": "phylum"}, {"rank": "phylum", "value": " "}):
        got = composition.composition_drill(rows, None, FilterSpec(), ds, [{"rank": "kingdom", "value": "K"}, odd])
        assert [r["group"] for r in got.collect()] == ["P"]


# ---- relationships ---------------------------------------------------------------
def brute_sizes(totals):
    """Point sizes restated with NumPy, for one series."""
    t = np.array([np.nan if v is None or not math.isfinite(v) else v for v in totals], dtype=float)
    known = t[np.isfinite(t)]
    if known.size < 2:
        return np.full(t.shape, 8.0)
    lo, hi = np.quantile(known, [0.05, 0.95])
    if hi <= lo:
        lo, hi = known.min(), known.max()
    if hi <= lo:
        return np.full(t.shape, 8.0)
    return 6 + 10 * np.sqrt(np.clip((t - lo) / max(hi - lo, 1.0), 0, 1))


@pytest.mark.parametrize("totals", [
    [1.0, 5.0, 9.0, 100.0, None, 42.0, float("inf")], [3.0, 3.0, 3.0], [7.0], [None, None], [0.1, 0.2, 0.3],
    [1.0] * 50 + [2.0],
])
def test_point_sizes(spark, totals):
    df = spark.createDataFrame([("x", "s", i, v) for i, v in enumerate(totals)] + [("x", "other", 99, 1.0)],
                               "x_name string, series string, i int, total double")
    got = [r["size"] for r in relate.point_sizes(df).where("series = 's'").orderBy("i").collect()]
    want = brute_sizes(totals)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert (g is None and math.isnan(w)) or g == pytest.approx(w, abs=1e-12)


def test_measure_values_and_scatter(main):
    rows = table(relate.measure_scatter(
        main.withColumn("x", F.when(F.col("tax_id") != 2, F.col("tax_id").cast("double"))), None, FilterSpec(), DS,
        ["a", "nope"], ["x", "unknown"], "per1k").select("series", "x", "y"))
    assert sorted(rows) == [("a", 1.0, 500.0), ("a", 4.0, 250.0), ("a", 6.0, 10.0)]      # null or 0 total: no point
    raw = table(relate.measure_scatter(main, None, FilterSpec(), DS, ["a"], ["tax_id"], "raw").select("x", "y"))
    assert sorted(raw) == [(1.0, 10.0), (3.0, 10.0), (4.0, 1.0), (5.0, 7.0), (6.0, 1.0)]
    stored = table(relate.measure_scatter(main, None, FilterSpec(), DS, ["a", "c"], ["tax_id"]).select("series", "x"))
    assert sorted(stored) == [("a", 1.0), ("a", 4.0), ("a", 5.0), ("a", 6.0)]            # NaN share dropped
    assert relate.measure_scatter(main, None, FilterSpec(), DS, [], ["tax_id"]).count() == 0
    with pytest.raises(ValueError):
        relate.measure_values(main, ["a"], "per2k", DS)


def test_metric_scatter_reads_text_leniently(spark):
    df = spark.createDataFrame([("A", "s", "1.5", 2.0), ("B", "s", "n/a", 3.0), ("C", "s", None, 1.0), ("D", "s", "4", None)],
                               "accession string, species string, metric string, x double")
    got = table(relate.metric_scatter(df, None, FilterSpec(), DS, "metric", ["x"]).select("accession", "y"))
    assert got == [("A", 1.5)]
    assert relate.metric_scatter(df, None, FilterSpec(), DS, "nope", ["x"]).count() == 0


def test_trend_matches_polyfit(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(0.5, 40, 60), [-3.0, 0.0]])
    y = 3 * np.abs(x) ** 1.5 + rng.normal(0, 1, x.size).clip(-0.4, 0.4) + 1
    y[-2:] = 2.0
    points = [("e", "s", float(a), float(b)) for a, b in zip(x, y)] + [
        ("e", "s", None, 1.0), ("e", "s", 1.0, NAN), ("e", "s", float("inf"), 1.0),
        ("e", "single", 1.0, 1.0), ("e", "constant", 2.0, 1.0), ("e", "constant", 2.0, 5.0)]
    df = spark.createDataFrame(points, "x_name string, series string, x double, y double")
    for log in (False, True):
        fit = relate.trend_fit(df, log_x=log, log_y=log).collect()
        assert [r["series"] for r in fit] == ["s"]
        keep = (x > 0) & (y > 0) if log else np.full(x.size, True)
        X, Y = (np.log10(x[keep]), np.log10(y[keep])) if log else (x, y)
        slope, intercept = np.polyfit(X, Y, 1)
        assert fit[0]["n"] == keep.sum()
        assert fit[0]["slope"] == pytest.approx(slope) and fit[0]["intercept"] == pytest.approx(intercept)
        curve = relate.trend_curve(relate.trend_fit(df, log_x=log, log_y=log), log_x=log, log_y=log).orderBy("i").collect()
        xs = np.linspace(X.min(), X.max(), 100)
        ys = intercept + slope * xs
        assert [r["x"] for r in curve] == pytest.approx((10 ** xs if log else xs).tolist())
        assert [r["y"] for r in curve] == pytest.approx((10 ** ys if log else ys).tolist())


def test_sample_is_stable_and_exact(spark):
    df = spark.range(500).select(F.concat(F.lit("E"), F.col("id").cast("string")).alias("accession"))
    first = set(table(relate.stable_sample(df, 50, "k", DS)))
    again = set(table(relate.stable_sample(df.repartition(7), 50, "k", DS)))
    other = set(table(relate.stable_sample(df, 50, "other", DS)))
    assert len(first) == 50 and first == again and first != other
    assert relate.stable_sample(df, 0, "k", DS).count() == 500
    assert relate.stable_sample(df, 900, "k", DS).count() == 500


def test_cap_precedes_the_null_drop(spark):
    df = spark.createDataFrame([(f"E{i}", "s", None if i % 2 else float(i), 1.0) for i in range(40)],
                               "accession string, species string, m double, x double")
    capped = relate.metric_scatter(df, None, FilterSpec(), DS, "m", ["x"], point_cap=20, cap_key="k")
    sampled = relate.stable_sample(df, 20, "k", DS).where("m IS NOT NULL")
    assert capped.count() == sampled.count() < 20
