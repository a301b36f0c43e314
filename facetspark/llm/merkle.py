"""Merkle manifest of a dataset by time-forward processing.

Every group of rows is a tree over its leaves in order: each run of ``FAN``
consecutive nodes becomes the digest of their digests, level by level, until
one is left.  The roots of the groups, in the groups' order, are the leaves of
one more tree.

Nodes are labelled by the last leaf below them, then by level, so children come
before parents.  A sweep in label order takes a node's child digests from a
priority queue, hashes them and sends the digest on to the label of the parent;
a second sweep in the reverse order sends each child its proof, which is its
siblings and the proof of the parent.  The queue is external: a task sweeps one
block of ``FAN ** levels`` consecutive leaves, messages beyond it are rows of a
table in the shared folder, which Spark deals and sorts by label for the next
layer, each layer that many times smaller than the one below.  So no group, and
no source however large, is in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import equal_runs, written

FAN = 3
LEVELS = 7                                  # of a block, unless the caller chooses
_ROW_BITS = 33                              # layout of monotonically_increasing_id
_PROOF = "array<struct<before: string, after: string>>"
_STEP = pa.struct([("before", pa.string()), ("after", pa.string())])


def digest(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as its UTF-8 length, a colon and itself, or ``-`` if null; numbers as decimals."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def _label(level: int, index: int, leaves: int) -> tuple[int, int]:
    return min((index + 1) * FAN ** level, leaves) - 1, level


def sweep_up(leaves: Sequence[str], levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The digest ``levels`` above the leaves, and the child digests of every (level, index) on the way."""
    n, children, queue = len(leaves), {}, []

    def send(level: int, index: int, value: str) -> None:
        heapq.heappush(queue, (_label(level + 1, index // FAN, n), index, value))

    top = leaves[0]
    for at, leaf in enumerate(leaves):
        if levels:
            send(0, at, leaf)
        while queue and queue[0][0][0] == at:
            label, index, value = heapq.heappop(queue)
            level, node, got = label[1], index // FAN, [value]
            while queue and queue[0][0] == label:
                got.append(heapq.heappop(queue)[2])
            children[level, node], top = got, digest(got)
            if level < levels:
                send(level, node, top)
    return top, children


def sweep_down(n: int, levels: int, children: dict[tuple[int, int], list[str]], above: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The proof of every leaf: the siblings before and after it, level by level upwards, then those of the block's top."""
    proofs: list = [None] * n
    queue = [((1 - n, -levels), 0, above)]
    while queue:
        (_, level), index, proof = heapq.heappop(queue)
        if level == 0:
            proofs[index] = proof
            continue
        got = children[-level, index]
        for k in range(len(got)):
            child = index * FAN + k
            last, below = _label(-level - 1, child, n)
            heapq.heappush(queue, ((-last, -below), child, [("".join(got[:k]), "".join(got[k + 1:])), *proof]))
    return proofs


def _inside(levels: int, group_rows: int) -> int:
    """Levels inside a block of a group of so many nodes: all of them if the block holds the group."""
    return levels if group_rows > FAN ** levels else height(group_rows)


def _dealt(nodes: DataFrame) -> DataFrame:
    """Rows of a block together, in label order; what comes from above stands first."""
    spot = F.concat_ws(",", F.col("tree").cast("string"), F.col("block").cast("string"))
    return nodes.withColumn("spot", spot).repartition("spot").sortWithinPartitions("spot", "pos")


def _with_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / FAN ** levels))


def _tops(levels: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in equal_runs(batches, "spot"):
        tree, rows, pos = (block.column(c)[0].as_py() for c in ("tree", "rows", "pos"))
        top, _ = sweep_up(block.column("digest").to_pylist(), _inside(levels, rows))
        width = FAN ** levels
        yield pa.RecordBatch.from_pydict({"tree": [tree], "rows": [-(-rows // width)], "pos": [pos // width], "digest": [top]})


def _layers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """(tree, rows, pos, digest) of the given nodes and of every layer of block tops above, up to one node a tree."""
    layers = [nodes]
    while not layers[-1].where("rows > 1").isEmpty() or len(layers) == 1:
        dealt = _dealt(_with_block(layers[-1].select("tree", "rows", "pos", "digest"), levels))
        layers.append(written(dealt.mapInArrow(
            partial(_tops, levels), "tree bigint, rows bigint, pos bigint, digest string")))
    return layers


def _proofs(columns: list[str], inner: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in equal_runs(batches, "spot"):
        above = [(s["before"], s["after"]) for s in block.column("proof")[0].as_py()]
        root, subroot = (block.column(c)[0].as_py() for c in ("root", "subroot"))
        nodes = block.slice(1)
        levels = _inside(inner, nodes.column("rows")[0].as_py())
        _, children = sweep_up(nodes.column("digest").to_pylist(), levels)
        proofs = sweep_down(nodes.num_rows, levels, children, above)
        offsets = [0]
        for p in proofs:
            offsets.append(offsets[-1] + len(p))
        steps = [s for p in proofs for s in p]
        struct = pa.StructArray.from_arrays([pa.array([s[k] for s in steps], pa.string()) for k in (0, 1)], fields=list(_STEP))
        proof = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)
        n = nodes.num_rows
        arrays = [c.combine_chunks() for c in nodes.select(columns).columns]
        yield pa.RecordBatch.from_arrays([*arrays, proof, pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string())],
                                         [*columns, "proof", "subroot", "root"])


def _down(nodes: DataFrame, above: DataFrame, columns: list[str], levels: int) -> DataFrame:
    """``columns`` of the nodes, with proof, subroot and root, from the (tree, pos, proof, subroot, root) of the blocks' tops."""
    ready = _with_block(nodes, levels)
    from_above = above.select("tree", F.lit(-1).cast("long").alias("pos"), F.col("pos").alias("block"), "proof", "subroot", "root")
    kinds = dict(nodes.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in columns], f"proof {_PROOF}", "subroot string", "root string"])
    return _dealt(ready.unionByName(from_above, allowMissingColumns=True)).mapInArrow(partial(_proofs, columns, levels), schema)


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with ``part`` and ``at``: the part of a range-partitioned sort they are in, and their number over all, from 0."""
    tie = F.rand(7)                         # rows equal in the whole order are interchangeable
    sorted_rows = written(rows.withColumn("_tie", tie).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
                          .drop("_tie").withColumn("_id", F.monotonically_increasing_id()))
    sorted_rows = sorted_rows.withColumn("part", F.shiftright("_id", _ROW_BITS))
    sizes = sorted_rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    # one row for each partition of the sort, so as many as shuffle partitions at most
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    place = F.col("before") + F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    return sorted_rows.join(F.broadcast(before), "part").withColumn("at", place).drop("_id", "before")


def manifest(rows: DataFrame, group: str, order: str, leaf: str, levels: int = LEVELS) -> DataFrame:
    """``rows`` with ``subroot``, ``root`` and ``proof``, under names of their own: what was in ``rows`` is in the struct ``row``.

    ``leaf`` holds the digests of the rows.  Groups come in the order of their
    values, null first; in a group the leaves ascend by ``order``, null first,
    rows equal in it by digest.  Rows equal in all three are interchangeable:
    each gets the proof of a place of its own.  ``proof`` holds, level by level
    from the leaf to the root, the joined digests of the siblings before and
    after; a lone node has none.  An empty table gives no rows.
    """
    # what was in ``rows`` travels as one struct, so that its names can't clash
    nested = rows.select(F.struct("*").alias("row"), F.col(leaf).alias("digest"), F.col(group).alias("group"), F.col(order).alias("order"))
    placed = _numbered(written(nested), [F.col("group").asc_nulls_first(), F.col("order").asc_nulls_first(), F.col("digest")])
    # a group's first number and size come back by part of the sort, so that a large group's rows stay spread
    parts = placed.groupBy("part", "group").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    groups = parts.groupBy("group").agg(F.min("first").alias("tree"), F.sum("size").alias("rows"))
    places = written(parts.select("part", "group").join(
        groups.withColumnRenamed("group", "_group"), F.col("group").eqNullSafe(F.col("_group"))).drop("_group"))
    same = (F.col("part") == F.col("_part")) & F.col("group").eqNullSafe(F.col("_group"))
    leaves = placed.select("row", "digest", "group", "part", "at").join(
        places.select(F.col("part").alias("_part"), F.col("group").alias("_group"), "tree", "rows"), same)
    leaves = written(leaves.select("tree", "rows", (F.col("at") - F.col("tree")).alias("pos"), "digest", "row"))

    layers = _layers(leaves, levels)
    roots = written(_numbered(layers[-1].select("tree", "digest"), [F.col("tree")]))
    of_groups = roots.select(F.lit(0).cast("long").alias("tree"), F.lit(roots.count()).cast("long").alias("rows"), F.col("at").alias("pos"), "digest")
    upper = _layers(of_groups, levels)
    none = F.array().cast(_PROOF)
    above = upper[-1].select("tree", "pos", none.alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for layer in reversed(upper[:-1]):
        above = written(_down(layer, above, ["tree", "pos"], levels))
    above = roots.select("at", F.col("tree").alias("_tree"), "digest").join(above, F.col("at") == F.col("pos")).select(
        F.col("_tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof", F.col("digest").alias("subroot"), "root")
    for layer in reversed(layers[1:-1]):
        above = written(_down(layer, above, ["tree", "pos"], levels))
    return _down(leaves, above, ["row", "digest"], levels).withColumnRenamed("digest", "leaf")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give; it differs from the manifest's if the row has been changed."""
    return F.aggregate(proof, leaf, lambda value, step: F.sha2(F.concat(step["before"], value, step["after"]), 256))


def proof_text(proof: Column) -> Column:
    """All sibling digests from the leaf to the root, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")
