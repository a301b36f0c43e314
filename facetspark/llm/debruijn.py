"""Long spans repeated across documents, by compaction of a de Bruijn graph of word k-mers.

A text is cut at anchors, the k-mers that are least within some run of
neighbouring k-mers.  The stretch from one anchor to the end of the next is an
edge of the graph: a token k-mer of varying length whose ends are the anchors.
Any span of ``SPAN`` words holds an edge that its words alone determine, so
only edges that occur in several texts matter.  Repeated edges that always
follow one another are compacted into paths by joins that double the distance
seen.  A text that runs through a whole path of which an earlier document also
has the whole needs no closer look; every other window along repeated edges is
verified at its source coordinates, by digests of its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts_of, written

SPAN = 50
K = 8
REACH = (SPAN - K + 1) // 2  # two anchors, each the least of so many k-mers, fit into every span
_MEMO = 1 << 19
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Powers:
    """Powers of an odd number modulo 2^64, and of its inverse, as far as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            grow = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))])
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up, self.down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def least_in_runs(values: np.ndarray, run: int) -> np.ndarray:
    """For each full run of ``run`` values the position of the least (the first of equals)."""
    n = len(values) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, have = values.copy(), np.arange(len(values)), 1
    while have < run:
        step = min(have, run - have)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at, have = np.where(take, right, left), np.where(take, at[step:], at[:-step]), have + step
    return at[:n]


class Words:
    """Hashes of words and of windows of words; a bounded number of words is remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.powers = [Powers(b) for b in _BASES]

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > _MEMO:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word, 7)
        return np.array([known[w] for w in words], np.uint64)

    def windows(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        up, down = self.powers[which].upto(len(hashes) + 1)
        salt = hashes if which == 0 else mixed(hashes)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(salt * up[:len(salt)])])
        return mixed((sums[ends] - sums[starts]) * down[starts])

    def anchors(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The anchors, and for each run of k-mers which of them is its least."""
        if len(hashes) < SPAN:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.arange(len(hashes) - K + 1)
        least = least_in_runs(self.windows(hashes, starts, starts + K), REACH)
        return np.unique(least, return_inverse=True)

    def edges(self, hashes: np.ndarray) -> np.ndarray:
        anchors, _ = self.anchors(hashes)
        return self.windows(hashes, anchors[:-1], anchors[1:] + K) if len(anchors) > 1 else np.zeros(0, np.uint64)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64 if kind == pa.int64() else np.int32), kind))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_edges(rows: DataFrame) -> DataFrame:
    """Edges, number of words and digest of every text; rows without an id have no edges."""
    kind = dict(rows.dtypes)["doc_id"]

    def table(batch: pa.RecordBatch) -> dict:
        coder, counts, digests, edges = Words(), [], [], []
        for id_, text in zip(batch.column("doc_id"), texts_of(batch)):
            words = text.split()
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            edges.append(_signed(coder.edges(coder.hashes(words))) if id_.is_valid and len(words) >= SPAN else np.zeros(0, np.int64))
        return {"row": batch.column("row"), "doc_id": batch.column("doc_id"), "t1": batch.column("t1"), "t2": batch.column("t2"),
                "n_words": pa.array(counts, pa.int64()), "whole": digests, "edges": _lists(edges, pa.int64())}

    return arrow_map(rows, f"row bigint, doc_id {kind}, t1 bigint, t2 bigint, n_words bigint, whole string, edges array<bigint>", table)


def paths(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Compact edges: (``edge``, ``path``, ``after``, ``n``), the edge's path, the edges after it in the path, and the path's size.

    ``steps`` (``a``, ``b``) says that edge b follows edge a in some text.  Edges
    join where a has no other follower and b no other forerunner.  Each round
    replaces the farthest edge known by the farthest that edge knows, for the
    edges whose farthest is not the end of its path; the others are put aside.
    On open paths there are fewer of them every round, so once their number
    stays, all that are left lie on rings, which have no end: they stay single.
    """
    one = lambda key, other: (steps.groupBy(key).agg(F.min(other).alias("x"), F.max(other).alias("y"))
                              .where("x = y").select(key, F.col("x").alias(other)))
    links = written(one("a", "b").join(one("b", "a"), ["a", "b"]).where("a <> b"))
    goes_on = links.select(F.col("a").alias("b"), F.lit(True).alias("open"))
    known = written(links.join(goes_on, "b", "left").select(
        F.col("a").alias("edge"), F.col("b").alias("far"), F.lit(1).cast("long").alias("after"), F.coalesce("open", F.lit(False)).alias("open")))
    ended, moving, left = known.where("not open"), known.where("open"), None
    while (now := moving.count()) and now != left:
        left = now
        ahead = ended.unionByName(moving).select(
            F.col("edge").alias("far"), F.col("far").alias("_far"), F.col("after").alias("_after"), F.col("open").alias("_open"))
        known = written(moving.drop("open").join(ahead, "far").select(
            "edge", F.col("_far").alias("far"), (F.col("after") + F.col("_after")).alias("after"), F.col("_open").alias("open")))
        ended, moving = ended.unionByName(known.where("not open")), known.where("open")
    ended = written(ended.select("edge", "far", "after"))
    sizes = ended.groupBy("far").agg((F.max("after") + 1).alias("n"))
    placed = (edges.join(ended, "edge", "left").select("edge", F.coalesce("far", "edge").alias("path"), F.coalesce("after", F.lit(0)).cast("int").alias("after")))
    return placed.join(sizes.withColumnRenamed("far", "path"), "path", "left").select(
        "edge", "path", "after", F.coalesce("n", F.lit(1)).cast("int").alias("n"))


def _steps(batch: pa.RecordBatch) -> dict:
    a, b = [], []
    for row in batch.column("found"):
        found = row.as_py()
        for x, y in zip(found, found[1:]):
            if y["nth"] == x["nth"] + 1:
                a.append(x["edge"])
                b.append(y["edge"])
    return {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}


def _walks(batch: pa.RecordBatch) -> dict:
    """Where a text runs through a whole path: its row and first document, the path, its first and last edge's number."""
    out: dict[str, list] = {"row": [], "first": [], "path": [], "i": [], "j": []}
    for row, first, found in zip(batch.column("row"), batch.column("first"), batch.column("found")):
        start = None
        before = None
        for x in found.as_py():
            if before is None or x["nth"] != before["nth"] + 1 or x["path"] != before["path"] or x["after"] != before["after"] - 1:
                start = x["nth"] if x["after"] == x["n"] - 1 else None
            if x["after"] == 0 and start is not None:
                for name, value in (("row", row.as_py()), ("first", first.as_py()), ("path", x["path"]), ("i", start), ("j", x["nth"])):
                    out[name].append(value)
                start = None
            before = x
    return {name: pa.array(v, pa.int32() if name in "ij" else pa.int64()) for name, v in out.items()}


def _windows(batch: pa.RecordBatch) -> dict:
    """The windows of a text to be verified, and the ranges of windows that whole paths settle."""
    coder, at, one, two, lows, highs = Words(), [], [], [], [], []
    for text, nths, walks in zip(texts_of(batch), batch.column("nths"), batch.column("walks")):
        hashes = coder.hashes(text.split())
        anchors, least = coder.anchors(hashes)
        n = len(hashes) - SPAN + 1
        seen = np.zeros(len(anchors), np.int64)
        seen[np.array(nths.as_py(), np.int64) + 1] = 1
        seen = np.cumsum(seen)  # edge e leads from anchor e to anchor e+1
        a, b = least[:n], least[SPAN - K + 1 - REACH:][:n]
        open_ = (seen[b] - seen[a] == b - a) & (b > a)
        low, high = [], []
        for walk in walks.as_py() or ():
            lo, hi = int(anchors[walk["i"]]), int(anchors[walk["j"] + 1]) + K - SPAN
            if hi >= lo:
                low.append(lo)
                high.append(hi)
                open_[lo:hi + 1] = False
        starts = np.flatnonzero(open_)
        at.append(starts)
        one.append(_signed(coder.windows(hashes, starts, starts + SPAN, 0)))
        two.append(_signed(coder.windows(hashes, starts, starts + SPAN, 1)))
        lows.append(np.array(low, np.int64))
        highs.append(np.array(high, np.int64))
    return {"row": batch.column("row"), "first": batch.column("first"), "text": batch.column("text"),
            "at": _lists(at, pa.int32()), "w1": _lists(one, pa.int64()), "w2": _lists(two, pa.int64()),
            "lows": _lists(lows, pa.int32()), "highs": _lists(highs, pa.int32())}


def _kept(batch: pa.RecordBatch) -> dict:
    removed, digests = [], []
    for text, lows, highs, more in zip(texts_of(batch), batch.column("lows"), batch.column("highs"), batch.column("more")):
        words = text.split()
        change = np.zeros(len(words) + 1, np.int64)
        more = np.array(more.as_py() or (), np.int64)
        np.add.at(change, np.concatenate([np.array(lows.as_py(), np.int64), more]), 1)
        np.add.at(change, np.concatenate([np.array(highs.as_py(), np.int64), more]) + SPAN, -1)
        gone = np.cumsum(change[:-1]) > 0
        removed.append(int(gone.sum()))
        digests.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest())
    return {"row": batch.column("row"), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": digests}


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    A word goes if a window of 50 words that covers it also starts in a
    document of smaller id.  Equal texts are compared once, for the smallest of
    their ids; of the others every word goes, if there are 50.  Null and short
    texts lose nothing, rows with null ids neither lose words nor count as a
    source, and rows repeated with the same id are no sources for each other.
    Texts are told apart by 128 bits, and so are the verified windows.
    """
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), F.col("text")).alias("t2"))
    cut = written(text_edges(rows.withColumn("row", F.monotonically_increasing_id())))
    meta = cut.drop("edges")
    firsts = written(meta.where("doc_id is not null").groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "row")).alias("_at"))
                     .select("t1", "t2", F.col("_at.doc_id").alias("first"), F.col("_at.row").alias("row")))

    placed = cut.select("row", "t1", F.posexplode("edges").alias("nth", "edge"))
    shared = written(placed.groupBy("edge").agg(F.min("t1").alias("x"), F.max("t1").alias("y")).where("x <> y").select("edge"))
    found = placed.select("row", "nth", "edge").join(shared, "edge", "left_semi").join(firsts.select("row", "first"), "row")
    by_text = written(found.groupBy("row", "first").agg(F.sort_array(F.collect_list(F.struct("nth", "edge"))).alias("found")))
    labels = written(paths(arrow_map(by_text.select("found"), "a bigint, b bigint", _steps), shared))
    labelled = (by_text.select("row", "first", F.explode("found").alias("x")).select("row", "first", "x.nth", "x.edge")
                .join(labels, "edge").groupBy("row", "first").agg(F.sort_array(F.collect_list(F.struct("nth", "path", "after", "n"))).alias("found")))
    walks = written(arrow_map(labelled, "row bigint, first bigint, path bigint, i int, j int", _walks))
    least = written(walks.groupBy("path").agg(F.min("first").alias("least")))  # apart, so that the join can split a hot path
    settled = (walks.join(least, "path").where("least < first")
               .groupBy("row").agg(F.collect_list(F.struct("i", "j")).alias("walks")))

    wanted = (by_text.select("row", "first", F.col("found.nth").alias("nths")).join(settled, "row", "left")
              .join(firsts.select("row", "t1", "t2"), "row"))
    # one row for each text: repeated rows of the first document are alike
    wanted = wanted.select("row", "first", "nths", "walks", F.col("t1").alias("u1"), F.col("t2").alias("u2"))
    ours = rows.join(wanted, (F.col("doc_id") == F.col("first")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")))
    work = written(arrow_map(ours.select("row", "first", "text", "nths", "walks"),
                             "row bigint, first bigint, text string, at array<int>, w1 array<bigint>, w2 array<bigint>, "
                             "lows array<int>, highs array<int>", _windows))
    windows = work.select("row", "first", F.explode(F.arrays_zip("at", "w1", "w2")).alias("w")).select("row", "first", "w.*")
    source = written(windows.groupBy("w1", "w2").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most")
                     .select("w1", "w2", "least"))  # apart, so that the join can split a hot window
    more = (windows.join(source, ["w1", "w2"]).where("least < first")
            .groupBy("row").agg(F.collect_set("at").alias("more")))
    lost = written(arrow_map(work.select("row", "text", "lows", "highs").join(more, "row", "left"),
                             "row bigint, n_removed bigint, kept_sha256 string", _kept)).distinct()

    copies = meta.join(firsts.select("t1", "t2", "first", F.col("row").alias("of")), ["t1", "t2"], "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= SPAN)
    own = F.when(F.col("doc_id") == F.col("first"), F.col("of"))
    return (copies.withColumn("own", own).join(lost.withColumnRenamed("row", "own"), "own", "left").select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256")))
