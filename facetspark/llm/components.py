"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``a``, ``b``); the root is the smallest node reachable.

    Every round each node takes the smallest label among itself and its
    neighbours, then the label of its label, so that labels travel twice as far
    each time.  A round is written out, and the rounds end when no label has
    changed.  Sums and joins are on nodes or labels; adaptive execution splits
    the join when one label has most of the nodes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
                     .select("node", F.least("node", "_least").alias("root")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_near")))
        pulled = written(labels.join(near, "node").select("node", F.least("root", "_near").alias("root"),
                                                          F.col("root").alias("_was")))
        jump = pulled.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        after = written(pulled.join(jump, "root").select("node", F.least("root", "_next").alias("root"), "_was"))
        labels = after.select("node", "root")
        if after.where("root <> _was").isEmpty():
            return labels
