"""Every registered query against DuckDB over the same base tables, and plan checks."""

import pathlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from facetspark.plans import fixtures
from facetspark.plans.catalog import QUERIES
from facetspark.plans.oracle import ORACLE

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
# a selection nothing matches, and a page past the end of this smallest scale
EMPTY_HERE = {"filter_tags_empty", "page_deep"}
PACKAGE = pathlib.Path(entry.__file__).parent / "facetspark"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry.queries().items()
    assert ORACLE.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
    assert len(got) > 0 or name in EMPTY_HERE


def test_entry(spark):
    assert entry.entry(spark).count() == 25


def test_fold_is_bounded_and_loses_nothing(spark, sf_dir, monkeypatch):
    whole_tags = sorted(map(tuple, fixtures.flat_tags(spark, sf_dir).collect()))
    whole_children = fixtures.flat_children(spark, sf_dir).count()
    monkeypatch.setattr(fixtures, "FOLD", 4)
    nested = fixtures.nested_children(spark, sf_dir)
    assert max(len(r["gbif_occs"]) for r in nested.collect()) <= 4
    assert fixtures.flat_children(spark, sf_dir).count() == whole_children
    assert sorted(map(tuple, fixtures.flat_tags(spark, sf_dir).collect())) == whole_tags


def test_plans_stay_in_the_jvm(spark, sf_dir):
    for name, query in QUERIES.items():
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in plan, (name, node)


def test_library_neither_collects_nor_uses_udfs():
    banned = (".collect()", ".toPandas(", "toLocalIterator", "localCheckpoint", "crossJoin", ".rdd", "udf(", "applyIn",
              "mapIn", ".sample(")
    for path in PACKAGE.rglob("*.py"):
        if "llm" in path.relative_to(PACKAGE).parts:
            continue
        text = path.read_text()
        assert not [b for b in banned if b in text], path


def test_bucketed_tables_need_no_other_publication(spark, sf_dir):
    """The bucketed queries read entities and tags laid out by key; nothing else is written for them."""
    tables = fixtures.PublishedTables(spark, sf_dir)
    tables._folder += "-bucketed-alone"
    before = set(fixtures._written)
    assert tables.bucketed.main.count() and tables.bucketed.tags.count()
    assert {path.removeprefix(f"{tables._folder}/") for path in fixtures._written - before} == {"bucketed/main", "bucketed/tags"}
