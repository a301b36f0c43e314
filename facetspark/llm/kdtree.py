"""K-d tree partitioning of documents into shards of nearly equal bytes.

Every node is cut along its widest metadata dimension at a weighted median of
its bytes, until each leaf is one shard.  A cut is found by histograms that
Spark sums in parallel, each refining one bin of the one before: no row is
moved to find it, and what a step yields for a node is a single row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, share_of, written
from .prefix import running_before

BINS = 512
EMPTY_ROW_BYTES = 8


def place(column: str, kind: str) -> Column:
    """A column as a number that keeps its order; of strings the first six bytes count.  Null comes first."""
    if kind == "string":
        head = F.rpad(F.hex(F.encode(F.col(column), "UTF-8")).substr(1, 12), 12, "0")
        return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(-1.0))
    return F.coalesce(F.col(column).cast("double"), F.lit(-1.0))


def _crossing(rows: DataFrame, bin_: Column, name: str) -> DataFrame:
    """For each node the bin in which the running sum of bytes passes what the node still has to give to the left,
    and what is left to give within it.  ``rows`` holds ``lo``, ``size`` and ``goal``."""
    sums = rows.groupBy("lo", "goal", bin_.alias(name)).agg(F.sum("size").alias("_sum"))
    order = Window.partitionBy("lo").orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("_sum").over(order) - F.col("_sum")
    return (sums.withColumn("_before", before).where("_before <= goal")
            .groupBy("lo").agg(F.max(F.struct(name, (F.col("goal") - F.col("_before")).alias("rest"),
                                              F.col("_sum").alias("held"))).alias("_at"))
            .select("lo", f"_at.{name}", "_at.rest", "_at.held"))


def split_level(rows: DataFrame, dims: Sequence[str], bins: int = BINS) -> DataFrame:
    """Cut every node of more than one leaf in two; ``rows`` has ``lo`` (first leaf), ``leaves``, ``size``, ``u`` and ``dims``.

    What a step finds of the nodes, one row for each, goes through the driver
    to the next step, so that no plan holds the steps before it; there are no
    more nodes than shards.
    """
    ends = rows.where("leaves > 1").groupBy("lo", "leaves").agg(
        F.sum("size").alias("_bytes"), *[f(d).alias(f"_{f.__name__}_{d}") for d in dims for f in (F.min, F.max)])
    widest = F.greatest(*[F.struct((F.col(f"_max_{d}") - F.col(f"_min_{d}")).alias("width"), F.lit(-n).alias("nth"),
                                   F.col(f"_min_{d}").alias("least")) for n, d in enumerate(dims)]) \
        if len(dims) > 1 else F.struct((F.col(f"_max_{dims[0]}") - F.col(f"_min_{dims[0]}")).alias("width"), F.lit(0).alias("nth"),
                                       F.col(f"_min_{dims[0]}").alias("least"))
    left = F.floor(F.col("leaves") / 2)
    nodes = (ends.withColumn("_widest", widest)
             .select("lo", left.cast("int").alias("left"), "_widest.width", (-F.col("_widest.nth")).alias("dim"), "_widest.least",
                     F.floor(F.col("_bytes") * left / F.col("leaves")).alias("goal"))).toArrow()
    if not nodes.num_rows:
        return rows
    value = F.element_at(F.array(*dims), F.col("dim") + 1)
    cell = F.when(F.col("width") > 0, F.least(F.floor((value - F.col("least")) / F.col("width") * bins * bins), F.lit(bins * bins - 1)))

    def placed(how: str) -> DataFrame:
        return (rows.join(F.broadcast(rows.sparkSession.createDataFrame(nodes)), "lo", how)
                .withColumn("_cell", F.coalesce(cell, F.lit(0)).cast("int"))
                .withColumn("_tie", F.floor(F.col("u") * bins * bins).cast("int")))

    # each step looks only at the rows of the bin that the last one found
    within = F.lit(True)
    for name, bin_ in (("b1", F.floor(F.col("_cell") / bins)), ("cell", F.col("_cell")),
                       ("b3", F.floor(F.col("_tie") / bins)), ("tie", F.col("_tie"))):
        found = _crossing(placed("inner").where(within), bin_, name).toArrow()
        nodes = nodes.drop_columns([c for c in ("goal", "held") if c in nodes.column_names]).join(
            found.rename_columns({"rest": "goal"}), "lo", join_type="inner")
        within = within & (bin_ == F.col(name))
    # the last bin goes to the side that brings the sum nearer to the goal
    tie = F.col("tie") + (F.col("goal") * 2 >= F.col("held")).cast("int")
    right = (F.col("_cell") > F.col("cell")) | ((F.col("_cell") == F.col("cell")) & (F.col("_tie") >= tie))
    moved = F.when(F.col("left").isNull(), F.lit(0)).when(right, F.col("left")).otherwise(F.lit(0))
    leaves = (F.when(F.col("left").isNull(), F.col("leaves")).when(right, F.col("leaves") - F.col("left")).otherwise(F.col("left")))
    return placed("left").select(*[leaves.cast("int").alias(c) if c == "leaves" else (F.col("lo") + moved).cast("int").alias(c) if c == "lo"
                                   else F.col(c) for c in rows.columns])


def kd_shards(docs: DataFrame, dims: Sequence[str], doc_id: str = "doc_id", text: str = "text",
              shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    ``shards``, or as many shards as bring a leaf to ``target_bytes``.  A row
    weighs its UTF-8 bytes plus 8 (null text: 8).  Rows at the cut of a node
    are told apart by a random key, so a dominant value of a dimension, or
    equal texts, are split like any others; only rows equal in id and text stay
    together.  Null dimensions come before all values.  An empty table gives no
    rows.  Slots count from 0 in each shard, in random order.
    """
    kinds = dict(docs.dtypes)
    rows = docs.select(
        docs[doc_id].alias("doc_id"), docs[text].alias("text"), *[place(d, kinds[d]).alias(f"d{n}") for n, d in enumerate(dims)])
    names = [f"d{n}" for n in range(len(dims))]
    rows = written(rows.select("doc_id", row_key("doc_id", "text").alias("key"),
                               (F.coalesce(F.octet_length("text"), F.lit(0)) + EMPTY_ROW_BYTES).cast("long").alias("size"),
                               F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.lit(0).alias("lo"), *names))
    whole = rows.agg(F.sum("size").alias("size"), *[f(d).alias(f"{f.__name__}_{d}") for d in names for f in (F.min, F.max)]).first()
    if shards is None:
        shards = max(1, math.ceil((whole["size"] or 0) / target_bytes))
    tree = rows.select("doc_id", "key", "size", "text_crc32", share_of("key").alias("u"), "lo", F.lit(shards).alias("leaves"),
                       *[((F.col(d) - F.lit(whole[f"min_{d}"])) / F.lit((whole[f"max_{d}"] or 0) - (whole[f"min_{d}"] or 0) or 1.0)).alias(d)
                         for d in names])
    for _ in range(math.ceil(math.log2(shards))):
        tree = written(split_level(tree, names))
    return running_before(tree, "lo", "key", F.lit(1), "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("lo").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
