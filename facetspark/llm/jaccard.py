"""Exact similarity join: pairs of texts whose word shingles reach a Jaccard similarity.

Shingles get one order over the corpus, rarer ones first by the counts of a
fixed number of hash cells.  Two sets of similarity s share one of the first
n - ceil(s n) + 1 shingles of either in whichever order, so the cells decide
only how many candidates there are, never which pairs are found.  The same
holds for parities of the sets in a fixed number of cells: they differ in no
more bits than the sets do in shingles, and only pairs that pass are compared on
the shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, passing_steps, texts_of, written
from .components import components

WIDTH = 5
CELLS = 1 << 18
#: Parities of a set of shingles, in columns of 64.
PARITIES = tuple(f"b{k}" for k in range(8))
#: Pivots of a bucket in the first round, and how many times as many there are after each further one.
FIRST, GROWTH = 2, 4
_MILLION = 1_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a text (A-Z in lower case); a shorter text is one shingle."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w) for w in words], np.uint64)
    n = max(1, len(words) - width + 1) if words else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = out * _FACTOR + hashes[k:k + n]
    return np.unique(out)


def _odd(held: np.ndarray, bits: int) -> np.ndarray:
    """Which of a number of cells hold an odd number of shingles, packed."""
    cells = (held >> np.uint64(32)).astype(np.int64) % bits
    return np.packbits(np.bincount(cells, minlength=bits).astype(np.uint8) & 1)


def _parities(held: np.ndarray) -> list[int]:
    return _odd(held, 64 * len(PARITIES)).view(np.int64).tolist()


def sketch(held: np.ndarray) -> bytes:
    """Parities in a power of two of cells: 64 at least, and as many as there are shingles."""
    return _odd(held, max(64, 1 << (len(held) - 1).bit_length())).tobytes()


def differing(one: bytes, other: bytes) -> int:
    """In how many cells two sketches differ; a longer one is folded to the other's cells."""
    x, y = sorted((np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)), key=len)
    while len(x) < len(y):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _cells(texts: DataFrame, width: int) -> np.ndarray:
    """How many shingles fall into each cell; tasks send their own sums, and at most ``CELLS`` rows come back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in texts_of(batch):
                np.add.at(counts, (shingles(text, width) % np.uint64(CELLS)).astype(np.int64), 1)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": cells.astype(np.int32), "n": counts[cells]})

    summed = texts.select("text").mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(CELLS, np.int64)
    total[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return total


def _features(texts: DataFrame, least: int, width: int) -> DataFrame:
    """(``t``, ``size``, parities, ``sketch``, ``prefix``) of texts with words: the shingles that each is found by, rarest first."""
    sent = texts.sparkSession.sparkContext.broadcast(_cells(texts, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sent.value, set()
        for batch in batches:
            rows, sketches, prefixes = [], [], []
            for t, text in zip(batch.column("t").to_pylist(), texts_of(batch)):
                if t in seen:
                    continue
                seen.add(t)
                held = shingles(text, width)
                if n := len(held):
                    first = n + (-n * least) // _MILLION + 1  # n - ceil(n * similarity) + 1
                    order = np.lexsort((held, counts[(held % np.uint64(CELLS)).astype(np.int64)]))[:first]
                    prefixes.append(held[order].view(np.int64))
                    sketches.append(sketch(held))
                    rows.append((t, n, *_parities(held)))
            if rows:
                offsets = pa.array(np.cumsum([0, *map(len, prefixes)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in zip(*rows)), pa.array(sketches, pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes)))],
                    ["t", "size", *PARITIES, "sketch", "prefix"])

    numbers = ", ".join(f"{c} bigint" for c in ("t", "size", *PARITIES))
    return written(texts.mapInArrow(run, f"{numbers}, sketch binary, prefix array<bigint>"))


def _may(one: Column, other: Column, ahead: Column, least: int) -> Column:
    """Whether two sizes, and what follows the first shared shingle in either at least, allow the similarity."""
    return ((one * _MILLION >= other * least) & (other * _MILLION >= one * least)
            & (ahead * (_MILLION + least) >= (one + other) * least))


def _members(features: DataFrame, least: int) -> DataFrame:
    """(``bucket``, ``t``, ``size``, ``place``, ``n``, ``other``, parities): shingles that n > 1 texts are found by, their place in each text's prefix.

    A bucket that two rows meet in is settled by counting: its least and greatest values are those of the pair.  If
    sizes and places allow the similarity, one row without bucket names the ``other`` text, once however many such
    buckets the two share; only the members of larger buckets are joined.
    """
    # dealt once: what the buckets hold and the rows that it chooses come from the same shuffle
    found = features.select("t", "size", F.posexplode("prefix").alias("place", "bucket")).repartition("bucket")
    pair = _may(F.col("_small"), F.col("_large"), F.col("_ahead"), least)
    shared = (found.groupBy("bucket").agg(F.count("*").alias("_rows"), F.min("t").alias("_a"), F.max("t").alias("_b"), F.min("size").alias("_small"),
                                          F.max("size").alias("_large"), F.min(F.col("size") - F.col("place")).alias("_ahead"))
              .where((F.col("_a") != F.col("_b")) & ((F.col("_rows") > 2) | pair))
              .select("bucket", F.when(F.col("_rows") == 2, F.col("_a")).alias("_a"), F.when(F.col("_rows") == 2, F.col("_b")).alias("other")))
    met = (found.join(shared, "bucket").where(F.col("_a").isNull() | (F.col("t") == F.col("_a"))).drop("_a")
           .dropDuplicates(["bucket", "t"])  # a text may come from several tasks
           .withColumn("n", F.when(F.col("other").isNull(), F.count("*").over(Window.partitionBy("bucket"))).otherwise(2))
           .withColumn("bucket", F.when(F.col("other").isNull(), F.col("bucket"))))
    each = features.select("t", *PARITIES).dropDuplicates(["t"])
    return written(written(met).repartition("t").dropDuplicates(["t", "bucket", "other"]).join(each, "t"), keep=True)


def _near(pairs: DataFrame, sketches: DataFrame, least: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sketches allow the similarity."""
    def near(batch: pa.RecordBatch) -> dict:
        one, two, sizes = (batch.column(c).to_pylist() for c in ("_a", "_b", "_sizes"))
        kept = pa.array([differing(x, y) * (_MILLION + least) <= n * (_MILLION - least) for x, y, n in zip(one, two, sizes)], pa.bool_())
        return {c: batch.column(c).filter(kept) for c in "ab"}

    one, two = (sketches.select(F.col("t").alias(c), F.col("size").alias(f"_n{c}"), F.col("sketch").alias(f"_{c}")) for c in "ab")
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "_a", "_b", (F.col("_na") + F.col("_nb")).alias("_sizes"))
    return arrow_map(joined, "a bigint, b bigint", near)


def _verified(pairs: DataFrame, texts: DataFrame, least: int, width: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose shingles reach the similarity; texts travel, which take less than their shingles."""
    def similar(batch: pa.RecordBatch) -> dict:
        kept, last, two = [], None, None
        for b, x, y in zip(batch.column("b").to_pylist(), texts_of(batch, "_a"), texts_of(batch, "_b")):
            if b != last:  # rows of a text come together
                last, two = b, shingles(y, width)
            one = shingles(x, width)
            shared = len(np.intersect1d(one, two, assume_unique=True))
            kept.append(shared * (_MILLION + least) >= (len(one) + len(two)) * least)
        return {c: batch.column(c).filter(pa.array(kept, pa.bool_())) for c in "ab"}

    # a step of known size, small as a rule: planned over a shuffle still to run, all texts were dealt to meet it
    named = written(pairs.select(F.col("a").alias("t")).union(pairs.select("b")).distinct())
    wanted = texts.join(named, "t", "left_semi").dropDuplicates(["t"])
    one, two = (wanted.select(F.col("t").alias(c), F.col("text").alias(f"_{c}")) for c in "ab")
    return arrow_map(pairs.join(one, "a").join(two, "b").select("a", "b", "_a", "_b"), "a bigint, b bigint", similar)


def similar_links(texts: DataFrame, similarity: float, width: int = WIDTH) -> DataFrame:
    """Links (``a``, ``b``) that join the same groups as all pairs of texts (``t``, ``text``) of that similarity or more.

    Buckets of two give pairs at once.  Members of a larger one are compared with
    some of it, the pivots, and with more of them each round, up to all.  Sizes,
    places (what follows the first shared shingle bounds the overlap) and
    parities are compared inside the join, sketches of the pairs that it gives
    out after it, so texts travel for hardly more than links.  A pair is left
    out only when links already join it, so a large group of near copies costs
    a few rows for each member.
    """
    least = round(similarity * _MILLION)
    with passing_steps(texts.sparkSession):
        features = _features(texts, least, width)
        sketches = written(features.select("t", "size", "sketch").dropDuplicates(["t"]), keep=True)
        members = _members(features, least)
    pairs = members.where("other is not null").select(F.col("t").alias("a"), F.col("other").alias("b"))
    members = members.where("other is null").drop("other").withColumn("root", F.col("t"))
    at = F.pmod(F.xxhash64("t", F.lit(1)), F.lit(1 << 30)) / float(1 << 30) * F.col("n")
    sizes = F.col("size") + F.col("_size")
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in PARITIES), F.lit(0)).cast("long")
    ahead = F.least(F.col("size") - F.col("place"), F.col("_size") - F.col("_place"))
    may = ((F.col("root") != F.col("_root")) & _may(F.col("size"), F.col("_size"), ahead, least)
           & (apart * (_MILLION + least) <= sizes * (_MILLION - least)))
    links, before, limit = None, 0, FIRST
    while True:
        pivots = members.where((at >= before) & (at < limit)).select(
            F.col("bucket").alias("_bucket"), F.col("t").alias("_t"), *[F.col(c).alias(f"_{c}") for c in ("root", "size", "place", *PARITIES)])
        met = (members.join(pivots, (F.col("bucket") == F.col("_bucket")) & may)
               .select(F.least("t", "_t").alias("a"), F.greatest("t", "_t").alias("b")).distinct())
        pairs = written(_near(met.union(pairs).distinct() if pairs is not None else met, sketches, least))
        new = _verified(pairs, texts, least, width)
        links = written(new if links is None else links.union(new))
        roots = components(links).select(F.col("node").alias("t"), F.col("root").alias("_new"))
        members = members.drop("root").join(roots, "t", "left").withColumn("root", F.coalesce("_new", "t")).drop("_new")
        split = members.groupBy("bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi")
        members = written(members.where(F.col("n") > limit).join(split, "bucket", "left_semi"))
        if members.isEmpty():
            return links
        pairs, before, limit = None, limit, limit * GROWTH
