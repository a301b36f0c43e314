"""Byte strings that occur twice, by blockwise suffix sorting with a difference cover.

Suffixes are sorted in buckets.  The bucket of a suffix is the content-chosen
anchor inside its first ``LENGTH`` bytes, so equal strings share a bucket, and
neighbouring suffixes mostly do: they travel as one run of bytes.  Runs whose
anchor occurs nowhere else are left out, equal runs travel once.  One task sorts
one block of buckets at a time: suffixes by their first ``V`` bytes, and where
these tie, by the ranks of a cover sample, the positions whose residue modulo
``V`` lies in a difference cover.  For any two suffixes the cover has one offset
below ``V`` at which both are sampled, so their ranks there tell them apart, and
no task compares or holds more than its block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts_of, written
from .debruijn import _BASES, Powers, _lists, _signed, mixed
from .prefix import running_before

LENGTH = 400
GRAM = 32
V = 73
#: A difference cover modulo 73: the powers of two.  Every difference occurs.
COVER = tuple(sorted(pow(2, i, V) for i in range(9)))
RANKED = 4 * V              # bytes that a cover rank tells apart, after two doublings
TAIL = LENGTH - RANKED      # the last bytes of a string, beyond what the rank at offset 0 sees
BLOCK = 1 << 18             # suffixes of the largest bucket that one task sorts; a task gets fewer than twice as many
TOGETHER = 1 << 16          # suffixes of small buckets sorted together
PIECE = 1 << 20             # suffixes of one text looked at together
SENT = 1 << 22              # bytes of runs that a task gives out at a time


class Bytes:
    """Rolling digests of byte strings and their anchors."""

    def __init__(self):
        self.salts = [mixed(np.arange(256, dtype=np.uint64) + np.uint64(s)) for s in (1 << 20, 1 << 30)]
        self.powers = [Powers(b) for b in _BASES]

    def digests(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        up, down = self.powers[which].upto(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.salts[which][data] * up[:len(data)])])
        return mixed((sums[ends] - sums[starts]) * down[starts])

    def runs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of suffixes with the same anchor: first suffix, number of suffixes, digest of the anchor."""
        starts, sizes, anchors = [], [], []
        for base in range(0, len(data) - LENGTH + 1, PIECE):
            piece = data[base:base + PIECE + LENGTH - 1]
            at = np.arange(len(piece) - GRAM + 1)
            grams = self.digests(piece, at, at + GRAM)
            least, have, want = (grams & ~np.uint64((1 << 23) - 1)) | at.astype(np.uint64), 1, LENGTH - GRAM + 1
            while have < want:
                step = min(have, want - have)
                least, have = np.minimum(least[:-step], least[step:]), have + step
            chosen = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
            first = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
            starts.append(first + base)
            sizes.append(np.diff(np.concatenate([first, [len(chosen)]])))
            anchors.append(grams[chosen[first]])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(anchors)


def _dense(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of values, and how often each value occurs."""
    _, rank, count = np.unique(values, return_inverse=True, return_counts=True)
    return rank.reshape(-1), count


def _strings(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    picked = np.lib.stride_tricks.sliding_window_view(data, size)[starts]
    return np.ascontiguousarray(picked).view(np.dtype((np.void, size))).reshape(-1)


def cover_ranks(data: np.ndarray, room: int) -> np.ndarray:
    """For each position of the cover its rank by ``RANKED`` bytes, else -1; ``data`` has ``room`` bytes after the text."""
    n = len(data) - room
    residues = np.zeros(V, bool)
    residues[list(COVER)] = True
    sample = np.flatnonzero(residues[np.arange(n) % V])
    rank = np.full(len(data), -1, np.int64)
    rank[sample] = _dense(_strings(data, sample, V))[0]
    for reach in (V, 2 * V):
        after = rank[sample + reach] + 1  # a sampled position again, its residue being the same
        rank[sample] = _dense(rank[sample] * (len(sample) + 1) + after)[0]
    return rank


def repeated_in_block(runs: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """For every run of suffixes which of them share their first ``LENGTH`` bytes with another suffix of the block."""
    room = LENGTH + RANKED
    data = np.frombuffer(b"".join(runs) + bytes(room), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    every = np.concatenate([np.arange(o, o + n) for o, n in zip(offsets, sizes)])
    repeated = np.zeros(len(every), bool)
    lead, count = _dense(_strings(data, every, V))
    tied = np.flatnonzero(count[lead] > 1)
    if len(tied):
        at = every[tied]
        tail, kinds = _dense(_strings(data, at + LENGTH - TAIL, TAIL))
        base = lead[tied] * len(kinds) + tail
        base, count = _dense(base)
        longer = count[base] > 1
        tied, at, base = tied[longer], at[longer], base[longer]
    if len(tied):
        rank = cover_ranks(data, room)
        top = int(rank.max()) + 1
        # two equal suffixes meet at the offset where the cover has both, each at a residue of its own
        offsets = [(residue - at) % V for residue in COVER]
        key, count = _dense(np.concatenate([(base * V + offset) * top + rank[at + offset] for offset in offsets]))
        found = (count[key] > 1).reshape(len(COVER), -1).any(axis=0)
        repeated[tied] = found
    return np.split(repeated, np.cumsum(sizes)[:-1])


def _ranges(flags: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist()


# ---- steps in Arrow batches ------------------------------------------------------------------------------------------

def _anchors(batch: pa.RecordBatch) -> dict:
    coder, sizes, digests, anchors = Bytes(), [], [], []
    for text in texts_of(batch):
        sizes.append(len(text))
        digests.append(hashlib.sha256(text).hexdigest())
        anchors.append(_signed(coder.runs(np.frombuffer(text, np.uint8))[2]))
    return {name: batch.column(name) for name in ("row", "doc_id", "t1", "t2")} | {
        "n_bytes": pa.array(sizes, pa.int64()), "whole": digests, "anchors": _lists(anchors, pa.int64())}


_RUN = "row bigint, start int, size int, anchor bigint, d1 bigint, d2 bigint, bytes binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chosen runs of each text, a row each, given out before they come to ``SENT`` bytes and a run."""
    coder = Bytes()
    for batch in batches:
        for row, text, nths in zip(batch.column("row").to_pylist(), texts_of(batch), batch.column("nths")):
            data = np.frombuffer(text, np.uint8)
            starts, sizes, anchors = (x[np.array(nths.as_py())] for x in coder.runs(data))
            ends = starts + sizes + LENGTH - 1
            d1, d2 = (coder.digests(data, starts, ends, which) for which in (0, 1))
            parts = np.cumsum(ends - starts) // SENT
            for part in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(parts)) + 1):
                yield pa.RecordBatch.from_pydict({
                    "row": np.full(len(part), row, np.int64), "start": starts[part].astype(np.int32), "size": sizes[part].astype(np.int32),
                    "anchor": _signed(anchors[part]), "d1": _signed(d1[part]), "d2": _signed(d2[part]),
                    "bytes": pa.array([text[s:e] for s, e in zip(starts[part].tolist(), ends[part].tolist())], pa.binary())})


_FOUND = "d1 bigint, d2 bigint, lows array<int>, highs array<int>"


def _sorted_block(table: pa.Table) -> pa.Table:
    """What repeats in a block, a few whole buckets at a time: ``TOGETHER`` suffixes, or one bucket that has more."""
    table = table.sort_by("anchor")
    sizes, anchors = table["size"].to_numpy().astype(np.int64), table["anchor"].to_numpy()
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(anchors)) + 1])
    parts, held = [0], 0
    for first, n in zip(firsts.tolist(), np.add.reduceat(sizes, firsts).tolist()):
        if held and held + n > TOGETHER:
            parts.append(first)
            held = 0
        held += n
    lows, highs = [], []
    for start, end in zip(parts, [*parts[1:], len(table)]):
        flags = repeated_in_block(table["bytes"].slice(start, end - start).to_pylist(), sizes[start:end].tolist())
        for low, high in map(_ranges, flags):
            lows.append(low)
            highs.append(high)
    kind = pa.list_(pa.int32())
    return pa.table({"d1": table["d1"], "d2": table["d2"], "lows": pa.array(lows, kind), "highs": pa.array(highs, kind)})


def _suffixes(batch: pa.RecordBatch) -> dict:
    """One row for each suffix of the runs: their digests and places."""
    coder, parts = Bytes(), []
    for d1, d2, size, data in zip(batch.column("d1"), batch.column("d2"), batch.column("size"), batch.column("bytes")):
        data, at = np.frombuffer(data.as_py(), np.uint8), np.arange(size.as_py())
        parts.append((_signed(coder.digests(data, at, at + LENGTH, 0)), _signed(coder.digests(data, at, at + LENGTH, 1)),
                      np.full(len(at), d1.as_py()), np.full(len(at), d2.as_py()), at.astype(np.int32)))
    return dict(zip(("s1", "s2", "d1", "d2", "at"), map(np.concatenate, zip(*parts))))


def _kept(batch: pa.RecordBatch) -> dict:
    removed, spans, digests = [], [], []
    for text, ranges in zip(texts_of(batch), batch.column("ranges")):
        change = np.zeros(len(text) + 1, np.int64)
        for r in ranges.as_py():
            np.add.at(change, r["start"] + np.array(r["lows"], np.int64), 1)
            np.add.at(change, r["start"] + np.array(r["highs"], np.int64) + LENGTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        removed.append(int(gone.sum()))
        spans.append(len(_ranges(gone)[0]))
        digests.append(hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest())
    return {"row": batch.column("row"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": digests}


def repeated_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A byte goes if a string of 400 bytes that covers it starts at any other
    place of the table too.  Rows with equal texts of 400 bytes or more lose
    everything; the text takes part once in the search for others.  Null,
    empty and short texts lose nothing; null and repeated ids do not matter.
    Texts and runs are told apart by 128 bits; inside a block bytes are compared.

    A bucket with more than ``block`` suffixes is not sorted in one task: its
    suffixes are told apart by 128-bit digests, counted across the cluster.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), F.col("text")).alias("t2"))
    cut = written(arrow_map(rows.withColumn("row", F.monotonically_increasing_id()),
                            f"row bigint, doc_id {kind}, t1 bigint, t2 bigint, n_bytes bigint, whole string, anchors array<bigint>", _anchors))
    firsts = written(cut.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "row")).alias("_at"), F.count("*").alias("times"))
                     .select("t1", "t2", "times", F.col("_at.doc_id").alias("of_id"), F.col("_at.row").alias("row")))
    placed = (cut.select("row", "anchors").join(firsts.select("row"), "row", "left_semi")
              .select("row", F.posexplode("anchors").alias("nth", "anchor")))
    shared = written(placed.groupBy("anchor").count().where("count > 1").select("anchor"))
    wanted = (placed.join(shared, "anchor", "left_semi").groupBy("row").agg(F.sort_array(F.collect_list("nth")).alias("nths"))
              .join(firsts.select("row", "of_id", F.col("t1").alias("u1"), F.col("t2").alias("u2")), "row"))
    ours = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("of_id")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")))
    ours = written(ours.select("row", "text", "nths"))
    runs = written(ours.mapInArrow(_runs, _RUN))
    # rows repeated with the same id and text bring the same places again, so places are told apart, not rows
    kinds = written(runs.groupBy("d1", "d2").agg(F.min(F.struct("row", "start")).alias("a"), F.max(F.struct("row", "start")).alias("b"),
                                                 F.first("anchor").alias("anchor"), F.first("size").alias("size")))
    buckets = written(kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("size").alias("suffixes")).where("n > 1"))
    # buckets go to blocks in random order by a running sum of their sizes
    sized = buckets.where(F.col("suffixes") <= block).select(F.lit(0).alias("_all"), "anchor", "suffixes", F.md5(F.col("anchor").cast("string")).alias("_key"))
    blocks = running_before(sized, "_all", "_key", F.col("suffixes"), "_before").select(
        F.col("anchor"), F.floor(F.col("_before") / block).alias("block"))
    chosen = kinds.select("d1", "d2", "anchor", "a.row", "a.start")
    chosen = chosen.join(buckets, "anchor").select("d1", "d2", "row", "start", "anchor", (F.col("suffixes") > block).alias("hot"))
    carried = (runs.select("row", "start", "size", "bytes").join(chosen, ["row", "start"])
               .dropDuplicates(["d1", "d2"]).select("d1", "d2", "size", "bytes", "anchor", "hot"))
    carried = written(carried)
    sorted_ = (carried.where("not hot").join(blocks, "anchor")
               .groupBy("block").applyInArrow(_sorted_block, _FOUND))
    suffixes = arrow_map(carried.where("hot").select("d1", "d2", "size", "bytes"), "s1 bigint, s2 bigint, d1 bigint, d2 bigint, at int", _suffixes)
    twice = suffixes.groupBy("s1", "s2").count().where("count > 1").select("s1", "s2")
    counted = (suffixes.join(twice, ["s1", "s2"], "left_semi").groupBy("d1", "d2").agg(F.sort_array(F.collect_list("at")).alias("lows"))
               .select("d1", "d2", "lows", F.col("lows").alias("highs")))
    whole = kinds.where("a <> b").select("d1", "d2", F.array(F.lit(0)).alias("lows"), F.array(F.col("size") - 1).alias("highs"))
    found = written(sorted_.union(counted).where(F.size("lows") > 0).union(whole))

    ranges = (runs.select("row", "start", "d1", "d2").join(found, ["d1", "d2"])
              .groupBy("row").agg(F.collect_list(F.struct("start", "lows", "highs")).alias("ranges")))
    lost = written(arrow_map(ours.select("row", "text").join(ranges, "row"),
                             "row bigint, n_removed bigint, n_spans bigint, kept_sha256 string", _kept)).distinct()
    copies = cut.drop("anchors").join(firsts.select("t1", "t2", "times"), ["t1", "t2"])
    gone = (F.col("times") > 1) & (F.col("n_bytes") >= LENGTH)
    return copies.join(lost, "row", "left").select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))
