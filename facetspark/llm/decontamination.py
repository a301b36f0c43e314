"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so similarity of the two sets says
little; what counts is the share of the item's shingles that the document
holds.  Items are parted by size.  Each keeps the smallest hashes of its
shingles, as many as its part needs for a document that holds enough of the
item to hold at least one of them, whichever are missing.  Documents whose
shingles meet such a sketch are candidates, and they are verified on the
shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, passing_steps, row_key, written

WIDTH = 5
CONTAINMENT = 0.8


def words(text: str) -> Column:
    return F.array_remove(F.split(ascii_lower(F.col(text)), r"[\x20\x09-\x0D]+"), "")


def _windows(array: str, width: int, window) -> Column:
    """``window(i)`` for the start i of every full window of ``array``."""
    starts = F.size(array) - width + 1
    return F.when(starts > 0, F.transform(F.sequence(F.lit(1), starts), window))


def shingle_hashes(array: str, width: int) -> Column:
    """Hashes of the windows of an array of word hashes."""
    return _windows(array, width, lambda i: F.xxhash64(*[F.element_at(array, i + k) for k in range(width)]))


def shingles(array: str, width: int) -> Column:
    """The distinct windows of an array of words, joined by blanks."""
    return F.array_distinct(_windows(array, width, lambda i: F.concat_ws(" ", F.slice(F.col(array), i, width))))


def _hashed(df: DataFrame, text: str, width: int) -> DataFrame:
    """Add ``_hash``, one row for each window of the text."""
    return (df.withColumn("_hashes", F.transform(words(text), lambda w: F.xxhash64(w)))
            .withColumn("_hash", F.explode(shingle_hashes("_hashes", width))).drop("_hashes"))


def sketches(items: DataFrame, width: int, containment: float) -> DataFrame:
    """(``_hash``, ``_item``): the smallest hashes of each item of ``items`` (``_item``, ``_text``).

    Part p holds the items of 2^p to 2^(p+1)-1 different shingles.  Of n
    shingles at most (1 - containment) n can be missing, so one more than that,
    for the largest n of the part, always leaves one that is there.
    """
    hashes = _hashed(items, "_text", width).select("_item", "_hash").distinct()
    sizes = hashes.groupBy("_item").agg(F.count("*").alias("_n"))
    largest = F.pow(F.lit(2), F.length(F.bin("_n"))) - 1
    kept = F.floor(largest * (1 - containment) + 1e-9) + 1
    rank = F.row_number().over(Window.partitionBy("_item").orderBy("_hash"))
    return (hashes.withColumn("_rank", rank).join(sizes.select("_item", kept.alias("_kept")), "_item")
            .where("_rank <= _kept").select("_hash", "_item"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """(``_key``, ``item_id``, ``shared``, ``of``) for every row key of ``docs`` and item whose shingles it holds.

    ``of`` counts the item's different shingles of ``width`` words (A-Z in
    lower case), ``shared`` those in the document.  Items of fewer words or
    without text can't be found; items without id are, under a null id; equal
    items count once.  Texts that are null, empty or short hold nothing.  Equal
    rows share a key.
    """
    with passing_steps(docs.sparkSession):
        return _contaminated(docs, items, doc_id, text, item_id, item_text, width, containment)


def _contaminated(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, width: int,
                  containment: float) -> DataFrame:
    bench = items.select(items[item_id].alias("item_id"), items[item_text].alias("_text")).dropna(subset=["_text"]).distinct()
    bench = bench.withColumn("_item", row_key("item_id", "_text"))
    parts = (bench.withColumn("_words", words("_text"))
             .select("_item", "item_id", F.explode(shingles("_words", width)).alias("_shingle")))
    sizes = parts.groupBy("_item").agg(F.count("*").alias("of"))
    parts = written(parts.join(sizes, "_item"))
    sketch = written(sketches(bench, width, containment))

    rows = docs.select(docs[doc_id].alias("_id"), docs[text].alias("_text")).withColumn("_key", row_key("_id", "_text"))
    probes = _hashed(rows, "_text", width).select("_key", "_hash")
    candidates = written(probes.join(sketch, "_hash").select("_key", "_item").distinct())
    held = (rows.join(candidates.select("_key").distinct(), "_key", "left_semi").select("_key", "_text").withColumn("_words", words("_text"))
            .select("_key", F.explode(shingles("_words", width)).alias("_shingle")))
    # only items whose sketch a document met are compared with it; equal rows have equal keys and shingles: counted once
    found = (candidates.join(parts, "_item").join(held, ["_key", "_shingle"]).groupBy("_key", "_item", "item_id", "of")
             .agg(F.count_distinct("_shingle").alias("shared")))
    least = round(containment * 1_000_000)
    return written(found.where(F.col("shared") * 1_000_000 >= F.col("of") * least).select("_key", "item_id", "shared", "of"), keep=True)


def decontamination_report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, items (ids in ascending order, comma-joined; empty if none).

    Rows with null ids are judged like others.  An item with a text but no id
    contaminates, but has no id to list or count.
    """
    found = contaminated(docs, items, doc_id, text, item_id, item_text)
    each = (found.groupBy("_key").agg(F.sort_array(F.collect_set("item_id")).alias("_items"))
            .select("_key", F.size("_items").cast("long").alias("_n"), F.array_join("_items", ",").alias("_ids")))
    rows = docs.select(docs[doc_id].alias("_id"), docs[text].alias("_text")).select("_id", row_key("_id", "_text").alias("_key"))
    return rows.join(each, "_key", "left").select(
        F.col("_id").alias("doc_id"), F.col("_n").isNotNull().alias("contaminated"),
        F.coalesce("_n", F.lit(0)).alias("n_items"), F.coalesce("_ids", F.lit("")).alias("items"))


def without_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    Null, empty and short texts hold none and stay; repeated rows stay or go together; items need no id.
    """
    found = contaminated(docs, items, doc_id, text).select(F.col("_key").alias("_found")).distinct()
    return docs.join(found, row_key(doc_id, text) == F.col("_found"), "left_anti")
