"""Masked pseudo-likelihood of documents under a bidirectional window network.

A small network guesses every token from the ``WINDOW`` tokens on either side;
the sum of the log-probabilities of the true tokens is the document's score.
The vocabulary comes from word counts over the whole corpus, other words share
hashed classes.  The output is a two-level softmax: first the token's group,
then the token within the group, so that a guess costs twice the root of the
vocabulary.

Training is data-parallel: every task runs gradient descent over its share of
the documents from the same weights, and Spark averages the weights by the
number of tokens seen.  Every document takes part in every round, and every
position is a training target: the places in a stretch of ``stride`` are dealt
to the rounds, so the rounds together look at all of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, written

_MEMO = 1 << 18


class Setting(NamedTuple):
    groups: int = 32        # groups of tokens, and tokens in a group: 1,024 ids
    other: int = 128        # of these for words outside the vocabulary
    window: int = 3         # tokens seen on each side
    width: int = 24
    rounds: int = 2
    stride: int = 8
    batch: int = 4096       # positions looked at together
    rate: float = 1.0
    seed: int = 11

    @property
    def ids(self) -> int:
        return self.groups * self.groups


def vocabulary(docs: DataFrame, setting: Setting) -> list[bytes]:
    """The most frequent words of all texts (A-Z in lower case; ties by code points); their number is a parameter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()).cast(pa.string()), "count": list(counts.values())})

        for batch in batches:
            for text in texts_of(batch):
                counts.update(text.lower().split())
                if len(counts) > _MEMO:
                    yield told()
                    counts.clear()
        if counts:
            yield told()

    words = docs.select("text").mapInArrow(run, "word string, count bigint")
    top = words.groupBy("word").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "word").limit(setting.ids - setting.other)
    return [row["word"].encode() for row in top.collect()]


class Coder:
    """Texts to ids: a word's place in the vocabulary, or one of the last ``other`` ids by its hash.

    Ids are dealt to the groups in turn, so that each group has frequent and rare words.
    """

    def __init__(self, words: list[bytes], setting: Setting):
        self.setting, self.known = setting, {w: i for i, w in enumerate(words)}
        self.first = setting.ids - setting.other

    def ids(self, text: bytes) -> np.ndarray:
        of, other, first = self.known.get, self.setting.other, self.first
        return np.array([crc32(w) % other + first if (rank := of(w)) is None else rank for w in text.lower().split()], np.int32)


def encoded(docs: DataFrame, words: list[bytes], setting: Setting) -> DataFrame:
    """(``doc_id``, ``ids``) of every row of (``doc_id``, ``text``): the ids of the text's words, packed."""
    kind, size = dict(docs.dtypes)["doc_id"], _packed(setting)
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent.value, setting)
        for batch in batches:
            ids = [coder.ids(text).astype(size).tobytes() for text in texts_of(batch)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.binary())})

    return docs.mapInArrow(run, f"doc_id {kind}, ids binary")


def _packed(setting: Setting) -> np.dtype:
    return np.min_scalar_type(setting.ids).newbyteorder("<")


def _ids_of(batch: pa.RecordBatch, coder: Coder) -> Iterator[np.ndarray]:
    """The ids of every row, from what ``encoded`` gave or from the text."""
    if "ids" not in batch.schema.names:
        return map(coder.ids, texts_of(batch))
    return (np.frombuffer(value.as_py(), _packed(coder.setting)).astype(np.int32) for value in batch.column("ids"))


class Network:
    """Embeddings by place in the window, one nonlinear layer, two softmax levels.  Float32 throughout."""

    def __init__(self, setting: Setting, flat: np.ndarray | None = None):
        s, g, d = setting, setting.groups, setting.width
        self.setting = s
        # one row more for beyond the text's ends
        self.shapes = {"embed": (s.ids + 1, d), "place": (2 * s.window, d), "mix": (d, d), "bias": (d,),
                       "group": (d, g), "group_bias": (g,), "token": (g, d, g), "token_bias": (g, g)}
        sizes = [int(np.prod(x)) for x in self.shapes.values()]
        fresh = flat is None
        self.flat = flat = (np.random.default_rng(s.seed).standard_normal(sum(sizes)) * 0.1).astype(np.float32) if fresh else flat
        for (name, shape), part in zip(self.shapes.items(), np.split(flat, np.cumsum(sizes)[:-1])):
            setattr(self, name, part.reshape(shape))  # views: a step changes ``flat``
        if fresh:
            self.place += 1

    def contexts(self, parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What is seen around the positions of each part: ids of a text, and positions in ascending order."""
        w, ends = self.setting.window, np.full(self.setting.window, self.setting.ids, np.int32)
        held, places, start = [], [], 0
        for ids, at in parts:
            # only the stretch around the positions is copied: a long text comes in many parts
            low, high = max(0, at[0] - w), at[-1] + w + 1
            held += [ends, ids[low:high], ends]
            places.append(at + (start + w - low))
            start += min(high, len(ids)) - low + 2 * w
        padded, at = np.concatenate(held), np.concatenate(places)
        return np.stack([padded.take(at + k) for k in range(-w, w + 1) if k]).T

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # an id weighs the same wherever it is seen at a place, so it is weighed once
        seen = np.zeros((len(context), self.setting.width), np.float32)
        for weight, at in zip(self.place, context.T):
            seen += (self.embed * weight).take(at, axis=0)
        hidden = seen @ self.mix
        hidden += self.bias
        return seen, np.tanh(hidden, out=hidden)

    def by_group(self, group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order that sorts the rows by group, and the rows of each group that occurs in it."""
        order = np.argsort(group.astype(np.min_scalar_type(self.setting.groups)), kind="stable")
        ends = np.cumsum(np.bincount(group, minlength=self.setting.groups)).tolist()
        return order, [(k, slice(a, b)) for k, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]

    def logits(self, hidden: np.ndarray, groups: list[tuple[int, slice]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the groups, and of the tokens in each row's group; a column for each row, which are sorted by group."""
        outer, inner = self.group.T @ hidden.T, np.empty((self.setting.groups, len(hidden)), np.float32)
        outer += self.group_bias[:, None]
        for k, rows in groups:
            inner[:, rows] = self.token[k].T @ hidden[rows].T + self.token_bias[k][:, None]
        return outer, inner

    @staticmethod
    def _exp(x: np.ndarray) -> np.ndarray:
        """Exponentials in place, against the greatest of each column; their sums."""
        x -= x.max(0)
        return np.exp(x, out=x).sum(0)

    def log_likelihood(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target given what is around it."""
        g, at = self.setting.groups, np.arange(len(target))
        order, groups = self.by_group(target % g)
        _, hidden = self.forward(context[order])
        sorted_ = target[order]
        found = np.zeros(len(target), np.float32)
        for x, true in zip(self.logits(hidden, groups), (sorted_ % g, sorted_ // g)):
            x -= x.max(0)
            found += x[true, at]
            found -= np.log(np.exp(x, out=x).sum(0))
        out = np.empty_like(found)
        out[order] = found
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean log loss; gradients of rows are scaled by how often a row is used."""
        g, n, at = self.setting.groups, len(target), np.arange(len(target))
        order, groups = self.by_group(target % g)
        context, target = context[order], target[order]
        seen, hidden = self.forward(context)
        error, inner = self.logits(hidden, groups)
        for x, true in ((error, target % g), (inner, target // g)):
            x /= self._exp(x)
            x[true, at] -= 1
        back = error.T @ self.group.T
        for k, rows in groups:
            wrong, share = inner[:, rows], np.float32(rate / (rows.stop - rows.start))
            back[rows] += wrong.T @ self.token[k].T
            self.token[k] -= share * (hidden[rows].T @ wrong.T)
            self.token_bias[k] -= share * np.add.reduce(wrong, axis=1)
        self.group -= rate / n * (hidden.T @ error.T)
        self.group_bias -= rate / n * error.sum(1)
        hidden *= hidden
        back *= np.subtract(1, hidden, out=hidden)
        back_seen = back @ self.mix.T
        if self.setting.width % 2 == 0:
            back_seen = back_seen.view(np.complex64)  # two columns are summed at a time
        self.mix -= rate / n * (seen.T @ back)
        self.bias -= rate / n * back.sum(0)
        # the rows that see an id at a place are summed once, for the id's vector and for the place
        small = context.T.astype(np.min_scalar_type(self.setting.ids))
        change, times = np.zeros_like(self.embed), np.zeros(len(self.embed), np.int64)
        for k, ids in enumerate(small):
            sorted_, counts = np.argsort(ids, kind="stable"), np.bincount(ids, minlength=len(times))
            used = np.flatnonzero(counts)
            sums = np.add.reduceat(back_seen.take(sorted_, axis=0), (np.cumsum(counts) - counts)[used], axis=0).view(np.float32)
            change[used] += sums * self.place[k]
            self.place[k] -= rate / n * (self.embed[used] * sums).sum(0)
            times += counts
        self.embed -= rate / np.sqrt(np.maximum(times, 1))[:, None].astype(np.float32) / np.float32(np.sqrt(n)) * change


def _in_batches(texts: Iterable, size: int, pick: Callable[..., Iterable[tuple]]) -> Iterator[list]:
    """The parts that are picked of the texts (a tuple whose second item holds the positions), ``size`` positions at a time."""
    held, n = [], 0
    for text in texts:
        for part in pick(text):
            held.append(part)
            n += len(part[1])
            if n >= size:
                yield held
                held, n = [], 0
    if n:
        yield held


def targets(n: int, round_: int, setting: Setting) -> np.ndarray:
    """The positions of a text of ``n`` tokens that a round trains on; all rounds together train on every one."""
    # shifted by one from stretch to stretch, so that no round sees only some words of a text that repeats itself
    shares, at = min(setting.rounds, setting.stride), np.arange(n)
    return at[(at % setting.stride + at // setting.stride) % shares == round_ % shares]


def train(docs: DataFrame, words: list[bytes], setting: Setting) -> np.ndarray:
    """The weights after ``setting.rounds`` rounds over all documents (``doc_id``, and ``text`` or ``ids``)."""
    spark, weights, column = docs.sparkSession, Network(setting).flat, "ids" if "ids" in docs.columns else "text"
    for round_ in range(setting.rounds):
        sent = spark.sparkContext.broadcast((words, weights))  # its size is fixed by the setting

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, start = sent.value
            coder, net, seen = Coder(known, setting), Network(setting, start.copy()), 0

            def pick(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                at = targets(len(ids), round_, setting)
                for i in range(0, len(at), setting.batch):
                    yield ids, at[i:i + setting.batch]

            texts = (ids for batch in batches for ids in _ids_of(batch, coder))
            for parts in _in_batches(texts, setting.batch, pick):
                target = np.concatenate([ids[at] for ids, at in parts])
                net.step(net.contexts(parts), target, setting.rate / (1 + round_))
                seen += len(target)
            if seen:
                yield pa.RecordBatch.from_pydict({"seen": pa.array([seen], pa.int64()), "weights": pa.array([net.flat.tolist()], pa.list_(pa.float32()))})

        local = docs.select(column).mapInArrow(run, "seen bigint, weights array<float>")
        mean = (local.select("seen", F.posexplode("weights").alias("at", "weight")).groupBy("at")
                .agg((F.sum(F.col("weight").cast("double") * F.col("seen")) / F.sum("seen")).alias("weight")))
        got = mean.toPandas()
        if len(got):
            weights = np.empty(len(got), np.float32)
            weights[got["at"].to_numpy()] = got["weight"].to_numpy()
        sent.unpersist()
    return weights


def score(docs: DataFrame, words: list[bytes], weights: np.ndarray, setting: Setting) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood of every row of (``doc_id``, and ``text`` or ``ids``)."""
    kind = dict(docs.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast((words, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, flat = sent.value
        coder, net = Coder(known, setting), Network(setting, flat)
        for batch in batches:
            sums, counts = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)

            def pick(row: tuple[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
                n, ids = row
                counts[n] = len(ids)
                for i in range(0, len(ids), setting.batch):
                    yield ids, np.arange(i, min(len(ids), i + setting.batch)), n

            for parts in _in_batches(enumerate(_ids_of(batch, coder)), setting.batch, pick):
                target = np.concatenate([ids[at[0]:at[-1] + 1] for ids, at, _ in parts])
                row = np.repeat([n for _, _, n in parts], [len(at) for _, at, _ in parts])
                likely = net.log_likelihood(net.contexts([part[:2] for part in parts]), target)
                sums += np.bincount(row, likely, len(sums))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": counts, "log_likelihood": sums})

    return (docs.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, log_likelihood double")
            .withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))))


def pseudo_likelihood(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", setting: Setting = Setting()) -> DataFrame:
    """Train on ``docs`` and score every row: doc_id, n_tokens, log_likelihood (a sum), mean_log_likelihood.

    Null and empty texts have no tokens, a sum of 0 and no mean; they do not
    train.  Null ids pass through, repeated rows train as often as they come
    and score alike.  Nothing but weights and a vocabulary of fixed size
    reaches the driver, and a task holds a few thousand positions at a time.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    words = vocabulary(rows, setting)
    rows = written(encoded(rows, words, setting))  # the rounds and the scores read ids
    return score(rows, words, train(rows, words, setting), setting)
