"""Mixing sources to target weights.

Documents get hash-random keys; each source is range-sorted by key; running
sums of sizes are taken across the whole cluster; and each source is cut at its
budget, after as many whole epochs as the budget holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, passing_steps, row_key, written
from .prefix import running_before

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def _group(source: str) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Budgets of sources; ``sizes`` has one row (``source``, ``source_size``) for each.

    The weights go round the sources in order of code points, null last.  All
    words are shared out by weight; a share stops at ``max_epochs`` times its
    source and the rest is shared again among the others, until none is above.
    Sources filled in order of size per weight: those before the first that is
    not filled by its share of what is left are full, the others share the rest.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    every = Window.partitionBy(F.lit(0))
    fill = every.orderBy("_fill", F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limit = F.col("source_size") * max_epochs
    left = F.sum("source_size").over(every) - (F.sum(limit).over(upto) - limit)
    weight_left = F.sum("weight").over(every) - (F.sum("weight").over(upto) - F.col("weight"))
    level = F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "_level"))).over(every)["_level"]
    return (sizes.withColumn("weight", weight)
            .withColumn("_fill", limit / F.col("weight"))
            .withColumn("_level", left / weight_left)
            .withColumn("_level", level)
            .select("source", "source_size", "weight",
                    F.least(limit.cast("double"), F.col("_level") * F.col("weight")).alias("target")))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """How often each document is taken: doc_id, source, key, size, source_size, target, copies, taken.

    A document's size is its number of words (null text: 0).  Every document is
    taken once for each whole epoch of its source's target; of the rest, the
    documents in key order up to the cut nearest to the target are taken once
    more.  A target is never over ``max_epochs`` times its source, so no
    document is taken more often.  Sources without words take nothing.  Ties
    and repeated rows: equal rows have equal keys and are interchangeable; null
    ids and sources count as values.  Rerunning gives the same rows.
    """
    rows = written(docs.select(
        docs[doc_id].alias("doc_id"), docs[source].alias("source"), docs[text].alias("text"),
    ).select("doc_id", "source", row_key("doc_id", "text").alias("key"), n_words("text").alias("size"),
             _group("source").alias("_group")))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    targets = written(targets.withColumn("_group", _group("source")).drop("source", "weight"))
    summed = running_before(rows, "_group", "key", F.col("size"), "_before")
    size, whole = F.col("source_size"), F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - whole * size
    more = (F.col("_before") < rest) & ((rest - F.col("_before")) * 2 >= F.col("size")) & (F.col("size") > 0)
    copies = F.when(size > 0, whole + F.when(more, 1).otherwise(0)).otherwise(0).cast("long")
    return (summed.join(targets, "_group")
            .withColumn("copies", copies)
            .select("doc_id", "source", "key", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as many times as ``mix`` takes it, with all its columns.

    Rows equal in id, text and source share their copies as evenly as possible,
    whatever their other columns hold.  Nulls and ties as in ``mix``; an empty
    table gives an empty one.
    """
    with passing_steps(docs.sparkSession):
        taken = written(mix(docs, doc_id, text, source, weights, max_epochs)
                        .groupBy("key", _group("source").alias("_of"))
                        .agg(F.sum("copies").alias("_sum"), F.count("*").alias("_rows"))
                        .where("_sum > 0").withColumnRenamed("key", "_key"), keep=True)
        keyed = docs.withColumns({"_key": row_key(doc_id, text), "_of": _group(source)})
        # within a source at most one group of equal rows is cut: only its rows need an order, and they are sorted in slices
        cut = taken.where("_sum % _rows > 0")
        rows = written(keyed.join(cut, ["_key", "_of"]).withColumn("_row", F.monotonically_increasing_id()), keep=True)
        rows = rows.withColumns({"_cut": F.md5(F.concat_ws(" ", "_key", "_of")), "_at": F.md5(F.col("_row").cast("string"))})
        ranked = running_before(rows, "_cut", "_at", F.lit(1), "_nth")
        over = F.col("_sum") % F.col("_rows")
        times = F.floor(F.col("_sum") / F.col("_rows")) + F.when(F.col("_nth") < over, 1).otherwise(0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    even = keyed.join(taken.where("_sum % _rows = 0"), ["_key", "_of"]).select(*columns, (F.col("_sum") / F.col("_rows")).cast("int").alias("_times"))
    return (even.union(ranked.select(*columns, times.cast("int").alias("_times")))
            .where("_times > 0")
            .withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            .select(*columns))
