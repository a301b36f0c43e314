"""Periodic runs of words by a suffix automaton with link-cut access.

The suffix links of the automaton of a text form a tree; the path from the node
of a prefix to the root holds all suffixes of that prefix.  Words are appended
one at a time: the path of the new prefix is accessed in a link-cut tree, which
gives all its nodes one colour, the new end.  A segment of the path that had
another colour p before holds suffixes, the longest of them L words, whose last
earlier occurrence ended at p.  With d = end - p <= L the last L + d words have
period d: a square, and d is their smallest period, as a smaller one would have
given a later occurrence.  Every square is extended to its maximal run once.
Recolouring costs O(log n) segments a word, amortised.

Documents go through in Arrow batches, without a shuffle, in groups of bounded
size.  Only stretches that can hold a run are appended: in a run of period q
with the least length, all three-word sequences behind the first q + 2 words
have occurred within the last q words, which is tested for all documents of a
group at once, for q up to each power of two.  Nothing is lost by it.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, texts_of

GROUP_WORDS = 1 << 18
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Least(NamedTuple):
    """The least length of a run: ``words`` (4 or more), and ``periods`` (3 or more) times its period."""

    words: int = 6
    periods: int = 4

    def holds(self, length: int, period: int) -> bool:
        return length >= max(self.words, self.periods * period)


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of a word sequence: suffix links and lengths of its states, and the state of every prefix.

    State 0 is none, state 1 the empty word.
    """
    link, length, follow = [0, 0], [0, 0], [{}, {}]
    prefix = []
    last = 1
    for n, w in enumerate(words, 1):
        new = len(link)
        link.append(1)
        length.append(n)
        follow.append({})
        p = last
        while p and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p:
            q = follow[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                follow.append(follow[q].copy())
                link[q] = link[new] = clone
                while p and follow[p].get(w) == q:
                    follow[p][w] = clone
                    p = link[p]
        last = new
        prefix.append(new)
    return link, length, prefix


class LinkCut:
    """Preferred paths of a rooted tree as splay trees; every path has a colour, kept at the root of its splay tree."""

    def __init__(self, parent: list[int]):
        self.up = list(parent)                      # parent in the splay tree, else parent of the path
        self.left = array("i", bytes(4 * len(parent)))
        self.right = array("i", bytes(4 * len(parent)))
        self.colour = array("i", [-1]) * len(parent)

    def _raise(self, x: int) -> None:
        """Rotate x above its splay parent."""
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[z] == y:
            left[z] = x
        elif right[z] == y:
            right[z] = x
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner:
            up[inner] = y
        up[y] = x
        up[x] = z

    def splay(self, x: int) -> None:
        up, left, right, top = self.up, self.left, self.right, x
        while (y := up[x]) and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                self._raise(y if (left[y] == x) == (left[z] == y) else x)
                top = z
            else:
                top = y
            self._raise(x)
        if top != x:
            self.colour[x] = self.colour[top]

    def access(self, x: int, colour: int) -> Iterator[tuple[int, int]]:
        """Give the path from x to the root one colour; yields (deepest node, colour before) of its former segments."""
        below, node = 0, x
        while node:
            self.splay(node)
            before = self.colour[node]
            if (cut := self.right[node]):
                self.colour[cut] = before
            if before >= 0:
                yield node, before
            self.right[node] = below
            below, node = node, self.up[node]
        self.colour[below] = colour


def runs_of(words: list[int], first: int, last: int, least: Least) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs with a square in ``words[first:last]``, extended over all words."""
    link, length, prefix = automaton(words[first:last])
    tree = LinkCut(link)
    ends: dict[int, int] = {}                       # of the last run of a period
    found = []
    for at, node in enumerate(prefix):
        for deepest, before in tree.access(node, at):
            d, long = at - before, length[deepest]
            if d > long or ends.get(d, -1) >= first + at:
                continue
            end, start = first + at, first + at - long - d + 1
            while end + 1 < len(words) and words[end + 1] == words[end + 1 - d]:
                end += 1
            while start and words[start - 1] == words[start - 1 + d]:
                start -= 1
            ends[d] = end
            if least.holds(end - start + 1, d):
                found.append((start, end - start + 1, d))
    return sorted(found, key=lambda run: (run[0], run[2]))


def stretches(ids: np.ndarray, starts: np.ndarray, least: Least) -> list[tuple[int, int]]:
    """Disjoint [first, last) parts of the concatenated documents, none over a border, that hold every run."""
    n = len(ids)
    if n == 0:
        return []
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = mixed.copy()
    key[1:] += mixed[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    key[2:] += mixed[:-2] * np.uint64(0x165667B19E3779F9)
    begin = np.repeat(starts[:-1], np.diff(starts))
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    back = np.full(n, n + 1, np.int64)
    back[order[again + 1]] = order[again + 1] - order[again]
    place = np.arange(n) - begin
    back[(place < 2) | (back > place - 2)] = n + 1  # within the document only, both times
    widest = int(np.diff(starts).max()) // least.periods
    found, q = [], 1
    while q < 2 * widest:
        near = np.diff(np.concatenate(([False], back <= q, [False])).astype(np.int8))
        low, high = np.flatnonzero(near == 1), np.flatnonzero(near == -1)
        # the least such a stretch has in a run whose period is above q / 2, at most q
        shortest = max(1, (least.periods - 1) * (q // 2 + 1) - 2, least.words - q - 2)
        keep = high - low >= shortest
        found += [(max(int(a) - q - 2, int(begin[a])), int(b)) for a, b in zip(low[keep], high[keep])]
        q *= 2
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1] and begin[a] == begin[merged[-1][0]]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def group_runs(texts: list[bytes], least: Least) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Number of words and runs of every text, in the order of their starts, then periods."""
    numbers: dict[bytes, int] = {}
    ids = [np.array([numbers.setdefault(w, len(numbers)) for w in t.split()], np.int64) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    found: list[list] = [[] for _ in texts]
    for a, b in stretches(np.concatenate(ids) if ids else np.empty(0, np.int64), starts, least):
        n = int(np.searchsorted(starts, a, "right")) - 1
        found[n] += runs_of(ids[n].tolist(), a - int(starts[n]), b - int(starts[n]), least)
    return [(len(x), sorted(runs, key=lambda r: (r[0], r[2]))) for x, runs in zip(ids, found)]


def collapse(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without what a run holds after its first period."""
    words = text.split()
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [w for w, inside in zip(words, np.cumsum(change[:-1]).tolist()) if not inside]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: Least = Least()) -> DataFrame:
    """(``doc_id``, ``n_words``, ``runs``, ``collapsed``) of every row.

    ``runs`` holds (start, length, period) in words numbered from 0, by start,
    then period; ``collapsed`` the words left when every run keeps its first
    period.  Words are compared as they are.  A text that is null, empty or
    without words has no runs and an empty ``collapsed``; repeated rows and
    rows without id stay as they are.  Other columns are not read.
    """
    if least.words < 4 or least.periods < 3:
        raise ValueError("runs take four words and three periods at least")
    kind = dict(docs.dtypes)[doc_id]

    def group(ids: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        found = group_runs(texts, least)
        runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs] for _, runs in found], pa.list_(RUN))
        clean = pa.array([collapse(t, runs).decode() for t, (_, runs) in zip(texts, found)], pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), pa.array([n for n, _ in found], pa.int64()), runs, clean], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for n, t in enumerate(texts_of(batch)):
                ids.append(batch.column("doc_id").slice(n, 1))
                texts.append(t)
                size += len(t)
                if size >= 6 * GROUP_WORDS:
                    yield group(ids, texts)
                    ids, texts, size = [], [], 0
            if texts:
                yield group(ids, texts)

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def longest_exponent(runs: str) -> Column:
    """The run with the greatest length / period as (start, length, period); ties go to the least start, then period.

    The quotients are compared as doubles, which tell different ones apart as
    long as a run has fewer than 2^26 words.
    """
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def with_periods(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a tenth of the texts made periodic, by the rule that the query fixes.

    With h = crc32 of the decimal id and g = h // 10, where h is divisible by
    ten and there are n > 0 words, the p words from word a on are repeated to
    the end: a = g mod n and p = 1 + (n - a) // (3 + g mod 8).  Rows without id stay.
    """
    h = F.crc32(docs[doc_id].cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(docs[text], F.lit(WORD), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1)).cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    periodic = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), repeated), " ")
    return docs.withColumn(text, F.when((h % 10 == 0) & docs[text].rlike(WORD), periodic).otherwise(docs[text]))
