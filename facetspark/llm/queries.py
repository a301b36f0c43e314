"""One query for each operator: its name, production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import debruijn, decontamination, kdtree, masked_lm, merkle, mixing, packing, periodic, pii, quality, simhash, subspaces, suffixes
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.compression_profile(documents(spark, sf_dir))


def op2_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.kd_shards(documents(spark, sf_dir), ("lang", "source", "n_chars", "doc_id"), shards=24)


def op3_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(documents(spark, sf_dir))


def op4_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_spans(documents(spark, sf_dir))


def op5_de_bruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.repeated_spans(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_difference_cover_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_strings(documents(spark, sf_dir))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows, by the checksum of their id, are checked after their text has lost its line breaks."""
    docs = documents(spark, sf_dir)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", merkle.leaf_digest([F.col(c) for c in LEAF]).alias("leaf"),
                         merkle.leaf_digest([*[F.col(c) for c in LEAF[:-1]], found]).alias("found"))
    proven = merkle.manifest(leaves, "source", "doc_id", "leaf").select(
        "row.doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof_text(F.col("proof")), 256).alias("proof_sha256"),
        merkle.folded(F.col("row.found"), F.col("proof")).alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic.periodic_runs(periodic.with_periods(documents(spark, sf_dir)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    best = runs.withColumn("best", periodic.longest_exponent("runs"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op13_subspace_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspaces.linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_compression_bands, op2_kd_tree_shards, op3_masked_pseudo_likelihood, op4_weak_supervision_pii, op5_de_bruijn_spans,
    op6_best_fit_packing, op7_difference_cover_suffixes, op8_source_mixing,
    op9_benchmark_decontamination, op10_simhash_balls,
    op11_merkle_manifest, op12_periodic_runs, op13_subspace_vectors,
)}

ORACLE: dict[str, str] = {
    "op8_source_mixing": r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')) AS key
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight,
         sum(source_size) OVER ()::BIGINT AS everything FROM sources
), filled AS (
  SELECT *, (source_size * 3)::DOUBLE / weight AS fill,
         (everything - coalesce(sum(source_size * 3) OVER before, 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY (source_size * 3)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, least((source_size * 3)::DOUBLE, weight * (
           SELECT level FROM filled WHERE level <= fill ORDER BY fill, source NULLS LAST LIMIT 1)) AS target
  FROM filled
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS before FROM rows
), taken AS (
  SELECT s.*, t.source_size, t.target, floor(t.target / t.source_size) AS whole,
         t.target - floor(t.target / t.source_size) * t.source_size AS rest
  FROM summed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), counted AS (
  SELECT *, CASE WHEN size > 0
    THEN whole + CASE WHEN before < rest AND (rest - before) * 2 >= size THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies
  FROM taken
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, source, copies FROM counted
""",
    "op9_benchmark_decontamination": r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS row,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), held AS (
  SELECT DISTINCT row, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM texts
), parts AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle
  FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x20\x09-\x0D]+') AS w FROM benchmark)
), sized AS (
  SELECT item_id, count(*) AS n FROM parts GROUP BY item_id
), shared AS (
  SELECT row, item_id, count(*) AS n FROM held JOIN parts USING (shingle) GROUP BY row, item_id
), found AS (
  SELECT row, s.item_id FROM shared s JOIN sized z ON s.item_id = z.item_id AND s.n * 5 >= z.n * 4
), each AS (
  SELECT row, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM found GROUP BY row
)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items, coalesce(items, '') AS items
FROM texts LEFT JOIN each USING (row)
""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         list_reduce(list_concat([4294967295::BIGINT], list_transform(
             range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
             lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, source, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 2 = 1 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
              ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS found
  FROM rows
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS n FROM hashed
), nodes AS (
  SELECT 0 AS level, tree, place, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT level + 1, tree, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY level, tree, place // 3
), subroots AS (
  SELECT tree, digest AS subroot FROM nodes WHERE n = 1
), top AS (
  SELECT 0 AS level, tree AS place, subroot AS digest, (SELECT count(*) FROM subroots) AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (max(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY level, place // 3
), runs AS (
  SELECT tree, level, place // 3 AS run, list(digest ORDER BY place) AS d FROM nodes WHERE n > 1 GROUP BY tree, level, place // 3
), top_runs AS (
  SELECT level, place // 3 AS run, list(digest ORDER BY place) AS d FROM top WHERE n > 1 GROUP BY level, place // 3
), walk AS (
  SELECT doc_id, leaf, tree, place, 0 AS level, n, '' AS proof, found AS value FROM leaves
  UNION ALL
  SELECT w.doc_id, w.leaf, w.tree, w.place // 3, w.level + 1, (w.n + 2) // 3,
         w.proof || array_to_string(d[:w.place % 3], '') || array_to_string(d[w.place % 3 + 2:], ''),
         sha256(array_to_string(d[:w.place % 3], '') || w.value || array_to_string(d[w.place % 3 + 2:], ''))
  FROM walk w JOIN runs r ON r.tree = w.tree AND r.level = w.level AND r.run = w.place // 3
), climb AS (
  SELECT doc_id, leaf, tree, tree AS place, 0 AS level, (SELECT count(*) FROM subroots) AS n, proof, value FROM walk WHERE n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.tree, w.place // 3, w.level + 1, (w.n + 2) // 3,
         w.proof || array_to_string(d[:w.place % 3], '') || array_to_string(d[w.place % 3 + 2:], ''),
         sha256(array_to_string(d[:w.place % 3], '') || w.value || array_to_string(d[w.place % 3 + 2:], ''))
  FROM climb w JOIN top_runs r ON r.level = w.level AND r.run = w.place // 3
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, value AS folded_root,
       value = (SELECT digest FROM top WHERE n = 1) AS verified
FROM climb JOIN subroots USING (tree) WHERE n = 1
""",
    "op13_subspace_vectors": """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), false)
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), roots AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM roots LEFT JOIN counts USING (vec_id)
""",
}
