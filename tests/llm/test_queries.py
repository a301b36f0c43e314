"""The registered queries on the smallest tables, their SQL, and the pipeline."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from facetspark.llm import decontamination, mixing, packing, quality, simhash
from facetspark.llm.queries import ORACLE, QUERIES


def normal(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)), key=repr)


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert QUERIES.items() <= entry.queries().items() and ORACLE.items() <= entry.oracle_sql().items()
    assert entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert normal(QUERIES[name](spark, sf_dir).toPandas()) == normal(con.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", ["op2_kd_tree_shards", "op8_source_mixing", "op9_benchmark_decontamination"])
def test_native_plans_hold_no_python(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    """Each stage against a plain version on what the stage before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    judge = quality.Judge(quality.Rule())

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for t in items.text]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{n}")
        after = spark.read.parquet(f"{tmp_path}/{n}")
        if n < 4:
            assert after.columns == docs.columns
            rows = after.collect()
            assert all(r == before[r.doc_id] for r in rows)
            kept = {r.doc_id for r in rows}
        if n == 0:
            assert kept == {i for i, r in before.items() if judge(r.text.encode())[-1]} and len(kept) < len(before)
        elif n == 1:
            prints = {i: simhash.fingerprint(r.text.encode()) % (1 << 64) for i, r in before.items()}
            held = {i: shingles(r.text) or {tuple(r.text.encode().lower().split())} for i, r in before.items()}

            def linked(i, j):
                shared = len(held[i] & held[j])
                return (prints[i] ^ prints[j]).bit_count() <= 2 or shared * 5 >= 4 * (len(held[i]) + len(held[j]) - shared)

            least = {}
            for i in sorted(prints):
                if i not in least:
                    todo, least[i] = [i], i
                    while todo:
                        a = todo.pop()
                        for j in prints:
                            if j not in least and linked(a, j):
                                least[j] = i
                                todo.append(j)
            assert kept == set(least.values()) and len(rows) == len(kept)
        elif n == 2:
            held = {i: shingles(r.text) for i, r in before.items()}
            assert kept == {i for i, h in held.items() if not any(len(s & h) * 5 >= 4 * len(s) for s in sets if s)}
        elif n == 3:
            copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            counted: dict = {}
            for r in rows:
                counted[r.doc_id] = counted.get(r.doc_id, 0) + 1
            assert counted == {i: c for i, c in copies.items() if c}
        else:
            ids = [i for r in after.collect() for i, s in zip(r.doc_ids, r.starts) if s == 0]
            assert sorted(ids) == sorted(r.doc_id for r in docs.collect())
        docs = after
    assert decontamination.WIDTH == 5 and packing.Layout().length == 2048


def test_run_equals_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["pack_id", "n_tokens", "ids", "cu_seqlens", "position_ids", "doc_ids", "starts"] and rows.count() > 0
