"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, passing_steps, row_key, texts_of, written
from .components import components
from .jaccard import WIDTH, similar_links

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 2
CROWD = 4096                # fingerprints that share a segment's value before their other bits are cut too
_BLOCK = 1 << 15


def fingerprint(text: bytes) -> int:
    """The signed 64-bit SimHash of the three-word shingles of a text, repeats included."""
    words = text.lower().split()  # bytes: A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    ends = [e - 1 for e in starts[min(SHINGLE, len(words)):]]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _BLOCK], ends[at:at + _BLOCK])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``key``, ``t``, ``fingerprint``) of every row; a text without words (or null) has fingerprint 0."""
    kind = dict(docs.dtypes)[doc_id]

    def table(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "t": batch.column("t"),
                "fingerprint": pa.array([fingerprint(t) for t in texts_of(batch)], pa.int64())}

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    rows = rows.withColumns({"key": row_key("doc_id", "text"), "t": F.xxhash64("text")})
    return arrow_map(rows, f"doc_id {kind}, key string, t bigint, fingerprint bigint", table)


def segments(bits: int, radius: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, ball) of the segments of a number of ``bits`` bits: two numbers that differ in at most
    ``radius`` bits differ in no more than its ball in one of them.

    With r = pieces * each + more, the first more + 1 segments have a ball of
    ``each`` and the rest of one less: numbers beyond all of them differ in at
    least r + 1 bits.  The number of pieces keeps balls at a radius of 1.
    """
    pieces = max(2, radius // 2 + 1)
    each, more = divmod(radius, pieces)
    cuts = [bits * n // pieces for n in range(pieces + 1)]
    return [(low, high - low, ball) for n, (low, high) in enumerate(zip(cuts, cuts[1:])) if (ball := each - (n > more)) >= 0]


def _value(number: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(number, low).bitwiseAND(F.lit((1 << width) - 1))


def _entries(number: Column, cut: list[tuple[int, int, int]]) -> Column:
    """What a number enters in the tables: (``segment``, ``value``), once for each segment."""
    return F.array(*[F.struct(F.lit(n).alias("segment"), _value(number, low, width).alias("value")) for n, (low, width, _) in enumerate(cut)])


def _masks(width: int, ball: int) -> list[int]:
    """The bits to change for each value in a ball, none first."""
    return [sum(1 << b for b in bits) for k in range(ball + 1) for bits in combinations(range(width), k)]


def _probes(number: Column, cut: list[tuple[int, int, int]]) -> Column:
    """Where a number looks: (``segment``, ``value``) for all values in the Hamming ball of each of its segments."""
    found = []
    for n, (low, width, ball) in enumerate(cut):
        found += [F.struct(F.lit(n).alias("segment"), _value(number, low, width).bitwiseXOR(F.lit(c).cast("long")).alias("value"))
                  for c in _masks(width, ball)]
    return F.array(*found)


def _rest(number: Column, low: int, width: int) -> Column:
    """The number turned so that a segment is on top and the other bits lie together below it."""
    return F.shiftleft(number, 64 - low - width).bitwiseOR(F.shiftrightunsigned(number, low + width))


def links(prints: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """All pairs (``a`` < ``b``) of different fingerprints that differ in at most ``radius`` bits.

    Every fingerprint enters one table for each of its segments, and looks up
    the Hamming ball of each segment there; what it meets is compared on all
    bits inside the join, so that only links come out.  A value that more than
    ``crowd`` fingerprints share is cut again by the segments of their other
    bits in the same way, so that those who meet there share half of these too.
    """
    cut = segments(BITS, radius)
    prints = prints.select("fingerprint").distinct()
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    looking = prints.select(F.col("fingerprint").alias("a"), F.inline(_probes(F.col("fingerprint"), cut)))
    tables = prints.select(F.col("fingerprint").alias("b"), F.inline(_entries(F.col("fingerprint"), cut)))
    crowded = written(tables.groupBy("segment", "value").count().where(F.col("count") > crowd).select("segment", "value"))
    at = ["segment", "value"]
    if crowded.isEmpty():
        return looking.join(tables, at).where(near).select("a", "b").distinct()
    found = looking.join(tables.join(crowded, at, "left_anti"), at).where(near).select("a", "b")
    for n, (low, width, _) in enumerate(cut):
        of = crowded.where(F.col("segment") == n)
        finer = segments(BITS - width, radius)
        one, two = (side.where(F.col("segment") == n).join(of, at, "left_semi").select(
            c, F.col("value").alias("first"), F.inline(keys(_rest(F.col(c), low, width), finer)))
            for side, c, keys in ((looking, "a", _probes), (tables, "b", _entries)))
        found = found.union(one.join(two, ["first", *at]).where(near).select("a", "b"))
    return found.distinct()


def _similar(docs: DataFrame, prints: DataFrame, text: str, similarity: float, width: int) -> DataFrame:
    """Links (``a``, ``b``) between the fingerprints of texts whose shingles reach the similarity."""
    found = similar_links(docs.select(F.xxhash64(docs[text]).alias("t"), docs[text].alias("text")), similarity, width)
    of = written(prints.join(found.select(F.col("a").alias("t")).union(found.select("b")).distinct(), "t", "left_semi")
                 .groupBy("t").agg(F.min("fingerprint").alias("f")))
    return (found.join(of.select(F.col("t").alias("a"), F.col("f").alias("_a")), "a")
            .join(of.select(F.col("t").alias("b"), F.col("f").alias("_b")), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def _grouped(docs: DataFrame, doc_id: str, text: str, similarity: float | None = None, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, key, fingerprint, root (a fingerprint of the group) and component_id of every row."""
    prints = written(fingerprints(docs, doc_id, text))
    each = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    close = links(each, radius)
    roots = components(close if similarity is None else close.union(_similar(docs, prints, text, similarity, width)))
    named = each.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = named.withColumn("root", F.coalesce("root", "fingerprint"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "root").select("fingerprint", "root", "component_id"), "fingerprint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id of its group).

    Fingerprints link at ``radius`` or fewer differing bits.  Copies collapse
    to one fingerprint before anything is compared.  Empty and
    null texts form one group (fingerprint 0).  Null ids take part but never
    name a group unless it has no other id; repeated rows stay repeated.
    """
    return _grouped(docs, doc_id, text, radius=radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float | None = None, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the least id, null last, ties by text.

    A row that repeats stays once.  With a ``similarity`` also texts whose
    shingles of ``width`` words have that Jaccard similarity or more are
    linked, however many bits their fingerprints differ in.  Only the keys of
    the rows kept stay on disk.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    with passing_steps(docs.sparkSession):
        grouped = _grouped(docs, doc_id, text, similarity, width)
        best = written(grouped.groupBy("root").agg(F.min(rank).alias("_best")).select(F.col("_best.key").alias("_kept")), keep=True)
    kept = docs.withColumn("_row", row_key(doc_id, text)).join(best, F.col("_row") == F.col("_kept"), "left_semi")
    return kept.dropDuplicates(["_row"]).drop("_row")
