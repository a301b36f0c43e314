"""Near-duplicate vectors by a pigeonhole join over subspaces.

Unit vectors of cosine s lie at squared distance 2 - 2 s.  A rotation spreads
that distance over all coordinates; they are cut into blocks of few dimensions
and every block gets the share of the squared distance that its width has of
all.  Two vectors within the distance are within the share in one block at
least, so a range join in each block finds all of them, and the union of the
candidates is verified by the cosine in double precision.

The range join lays a lattice over the first axes of a block.  A vector lives
in its cell and visits the cells its ball reaches that come earlier in order,
so that a pair meets in one cell of a block only; and it counts in the first
block that holds it.  So no pair counts twice and no pairs are written: a task
gives, for every vector of a cell, the number of its links there and the least
vector it hangs together with.  Cells of more than a tile are dealt out as
pairs of parts.  Equal vectors are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import equal_runs, written
from .components import components

_SLACK = 1e-9          # what rounding may add to a squared distance of unit vectors
_PIECE = 1 << 14       # pairs verified at once
_BITS = 15             # of a lattice coordinate in a cell's number


@dataclass(frozen=True)
class Subspaces:
    """``similarity`` links; blocks of ``width`` dimensions, the lattice on ``axes`` (at most 4) of them, ``tile`` vectors a part."""

    similarity: float = 0.98
    width: int = 8
    axes: int = 4
    tile: int = 2048

    @property
    def distance(self) -> float:
        return 2 - 2 * self.similarity

    def blocks(self, size: int) -> int:
        return max(1, size // self.width)

    def budget(self, size: int) -> float:
        """A block's share of the squared distance: its width over all, the same for every block."""
        return self.distance / self.blocks(size) + _SLACK

    def side(self, size: int) -> float:
        """Of a cell: four radii, so that a ball reaches one neighbour at most on each axis."""
        return max(4 * self.budget(size) ** 0.5, 2.0 ** (2 - _BITS))


def _folded(x: np.ndarray, to: int = 1) -> np.ndarray:
    """Sums over the last axis, a power of two long, down to ``to`` sums of neighbours; element by element, so that the
    result doesn't depend on how many rows are taken at once."""
    while x.shape[-1] > to:
        x = x[..., 0::2] + x[..., 1::2]
    return x


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows with their largest component 1, filled with zeros up to a power of two."""
    n, d = vectors.shape
    out = np.zeros((n, 1 << max(0, d - 1).bit_length()))
    out[:, :d] = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return out


def rotated(rows: np.ndarray) -> np.ndarray:
    """Unit rows after two rounds of fixed sign changes and a Walsh-Hadamard transform, which is a rotation."""
    y = rows / np.sqrt(_folded(rows * rows))
    size = y.shape[1]
    signs = np.random.default_rng(13).choice([-1.0, 1.0], (2, size))
    for k in range(2):
        y = y * signs[k]
        step = 1
        while step < size:
            pairs = y.reshape(len(y), -1, 2, step)
            y = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(y), size)
            step *= 2
        y = y / np.sqrt(size)
    return y


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_folded(a * b) / np.sqrt(_folded(a * a) * _folded(b * b)))[:, 0]


def cells(y: np.ndarray, plan: Subspaces) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(block, rows, cell numbers, whether they live there): the home of every row, then its visits to earlier cells."""
    size = y.shape[1]
    m, side, radius = plan.blocks(size), plan.side(size), plan.budget(size) ** 0.5
    axes = min(plan.axes, size // m)
    place = 1 << (_BITS * np.arange(axes)[::-1])
    for block in range(m):
        at = y[:, block * (size // m):][:, :axes] / side
        home = np.floor(at)
        inside = (at - home) * side
        step = np.where(inside <= radius, -1, np.where(inside >= side - radius, 1, 0))
        number = ((home.astype(np.int64) + (1 << _BITS - 1)) * place).sum(axis=1)
        yield block, np.arange(len(y)), number, True
        for k in range(1, axes + 1):
            for chosen in combinations(range(axes), k):
                # the first axis that differs decides which cell comes earlier
                rows = np.flatnonzero((step[:, chosen[0]] < 0) & (step[:, chosen] != 0).all(axis=1))
                if len(rows):
                    yield block, rows, number[rows] + (step[rows][:, chosen] * place[list(chosen)]).sum(axis=1), False


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The list column of equally long vectors as rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _members(reps: DataFrame, plan: Subspaces, with_vectors: bool) -> DataFrame:
    kinds = dict(reps.dtypes)
    schema = f"block int, dims int, cell bigint, label {kinds['label']}"
    if with_vectors:
        schema += f", rid bigint, copies bigint, lives boolean, vector {kinds['vector']}"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = whole.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths):
                part = whole.take(pa.array(np.flatnonzero(lengths == dims)))
                for start in range(0, part.num_rows, 1024):
                    batch = part.slice(start, 1024)
                    for block, rows, numbers, lives in cells(rotated(scaled(_matrix(batch.column("vector")))), plan):
                        n, took = len(rows), batch.take(pa.array(rows))
                        out = {"block": pa.array(np.full(n, block, np.int32)), "dims": pa.array(np.full(n, dims, np.int32)),
                               "cell": pa.array(numbers), "label": took.column("label")}
                        if with_vectors:
                            out |= {"rid": took.column("rid"), "copies": took.column("copies"),
                                    "lives": pa.array(np.full(n, lives)), "vector": took.column("vector")}
                        yield pa.RecordBatch.from_pydict(out)

    return reps.select("rid", "copies", "label", "vector").mapInArrow(emit, schema)


def tile_links(x: np.ndarray, lives: np.ndarray, left: np.ndarray, right: np.ndarray, block: int, plan: Subspaces) -> Iterator[tuple]:
    """(i, j) of the links between rows ``left`` and ``right`` (or within, if they are the same) that count in this block."""
    y = rotated(x)
    size = y.shape[1]
    m = plan.blocks(size)
    width, budget = size // m, plan.budget(size)
    part = y[:, block * width:(block + 1) * width]
    square = (part * part).sum(axis=1)
    within = left is right
    for at in range(0, len(left), 256):
        a = left[at:at + 256]
        far = square[a][:, None] + square[right][None, :] - 2 * part[a] @ part[right].T
        near = (far <= budget + _SLACK) & (lives[a][:, None] | lives[right][None, :])
        if within:
            near &= np.arange(len(right))[None, :] > np.arange(at, at + len(a))[:, None]
        i, j = np.nonzero(near)
        for piece in range(0, len(i), _PIECE):
            p, q = a[i[piece:piece + _PIECE]], right[j[piece:piece + _PIECE]]
            each = _folded((y[p] - y[q]) ** 2, m) <= budget
            first = each.any(axis=1) & (each.argmax(axis=1) == block)
            p, q = p[first], q[first]
            linked = cosines(x[p], x[q]) >= plan.similarity
            yield p[linked], q[linked]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least row that each row hangs together with by the links."""
    label = np.arange(n)
    while True:
        after = label.copy()
        np.minimum.at(after, i, label[j])
        np.minimum.at(after, j, label[i])
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def _tiles(members: DataFrame, plan: Subspaces) -> DataFrame:
    """(rid, links, root) of every vector with links in a tile; the rows come dealt and sorted by ``tile``."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in equal_runs(batches, "tile"):
            if rows.num_rows < 2:
                continue
            rows = rows.combine_chunks()
            rid, copies, part = (rows.column(c).to_numpy() for c in ("rid", "copies", "part"))
            low, high, block = (rows.column(c)[0].as_py() for c in ("low", "high", "block"))
            left = np.flatnonzero(part == low)
            right = left if low == high else np.flatnonzero(part == high)
            lives = rows.column("lives").to_numpy(zero_copy_only=False).astype(bool)
            x = scaled(_matrix(rows.column("vector").combine_chunks()))
            found = list(tile_links(x, lives, left, right, block, plan))
            i, j = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
            if len(i) == 0:
                continue
            n = len(rid)
            links = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_pydict({
                "rid": pa.array(rid[some]), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(rid[_roots(n, i, j)[some]])})

    return members.mapInArrow(match, "rid bigint, links bigint, root bigint")


def _usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null, NaN or infinite components."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda c: c != 0)


def linked_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", plan: Subspaces = Subspaces(),
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors of one label are linked when their cosine reaches the similarity.
    A vector that is null, empty, zero, or holds a null or non-finite
    component, or has no label, is linked with nothing, and so are vectors of
    different length.  ``n_links`` counts other rows, equal ones included.
    Null ids take part; a component is named by its least id, null if it has
    none, and a row is kept if it has that id, so rows equal in everything are
    kept together.  An empty table gives none.  Other columns are not read.
    """
    rows = vectors.select(vectors[vec_id].alias("vec_id"), vectors[vector].alias("vector"), vectors[label].alias("label"))
    usable = rows.where(F.col("label").isNotNull() & F.coalesce(_usable(F.col("vector")), F.lit(False)))
    reps = written(usable.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
                   .withColumn("rid", F.monotonically_increasing_id()))
    cell = ["block", "dims", "cell", "label"]
    large = written(_members(reps, plan, False).groupBy(*cell).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > plan.tile))
    members = _members(reps, plan, True).join(large, cell, "left")
    parts = F.coalesce(F.ceil(F.col("rows") / plan.tile), F.lit(1))
    members = members.withColumn("part", F.pmod(F.xxhash64("rid"), parts)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    members = members.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    # the label comes last: whatever it holds, no two tiles have one name
    members = members.withColumn("tile", F.concat_ws(",", "block", "dims", "cell", "low", "high", F.col("label").cast("string")))
    dealt = members.select("tile", "block", "low", "high", "part", "rid", "copies", "lives", "vector").repartition("tile")
    found = written(_tiles(dealt.sortWithinPartitions("tile"), plan))
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rid")
    each = (reps.join(links, "rid", "left").join(groups, "rid", "left")
            .withColumn("root", F.coalesce("root", "rid")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1))
    least = each.groupBy("root").agg(F.min("least").alias("component_id"))
    each = each.join(least, "root").select(F.col("label").alias("_label"), F.col("vector").alias("_vector"), "links", "component_id", F.lit(True).alias("_met"))
    joined = rows.join(each, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left")
    named = F.when(F.col("_met"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), named.alias("component_id"), F.col("vec_id").eqNullSafe(named).alias("kept"))
