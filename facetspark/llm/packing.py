"""Token-id output: best-fit-decreasing packing into fixed rows.

Texts become token ids of a public tokenizer, texts longer than a row are split
without loss, and the pieces of one block are packed: longest first, each into
the fullest open row that still holds it, found in a segment tree over the free
capacities.  Blocks are of bounded size and independent, so nothing is
shuffled, and a lost task is simply run again with the same result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SCHEMA = ("pack_id bigint, n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, "
          "doc_ids array<bigint>, starts array<bigint>")
#: Fixed value: the pieces of the vocabulary's byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Layout(NamedTuple):
    length: int = 2048          # tokens in a row
    block_tokens: int = 1 << 21  # tokens packed together: 1,024 rows
    end_id: int | None = 50256  # put after each text
    pad_id: int = 50256


class Coder:
    """Texts to ids by a byte-level BPE vocabulary file of ranks; no text counts as a special token."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.dtype = "<u2" if len(ranks) < 1 << 16 else "<u4"

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), self.dtype)


class FreeSpace:
    """Segment tree over capacities 0..length: how many open rows have each; finds the least that is enough."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and give (capacity, row) of the tightest row with at least ``need`` free."""
        node = need + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows as lists of piece numbers; equal sizes keep their order."""
    free, rows = FreeSpace(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = free.take(sizes[i])
        if found is None:
            capacity, row = length, len(rows)
            rows.append([])
        else:
            capacity, row = found
        rows[row].append(i)
        if capacity > sizes[i]:
            free.add(capacity - sizes[i], row)
    return rows


def position_type(length: int) -> str:
    """The type of positions in rows of that length."""
    return "<u2" if length <= 1 << 16 else "<u4"


def _block(pieces: list[tuple[int | None, int, np.ndarray]], layout: Layout, dtype: str, first_id: int) -> pa.RecordBatch:
    rows = best_fit_decreasing([len(p[2]) for p in pieces], layout.length)
    out: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
    for n, row in enumerate(rows):
        ids, places = np.full(layout.length, layout.pad_id, dtype), np.zeros(layout.length, position_type(layout.length))
        ends = [0]
        for i in row:
            piece, at = pieces[i][2], ends[-1]
            ids[at:at + len(piece)] = piece
            places[at:at + len(piece)] = np.arange(len(piece))
            ends.append(at + len(piece))
        places[ends[-1]:] = np.arange(layout.length - ends[-1])
        for name, value in (("pack_id", first_id + n), ("n_tokens", ends[-1]), ("ids", ids.tobytes()), ("cu_seqlens", ends),
                            ("position_ids", places.tobytes()), ("doc_ids", [pieces[i][0] for i in row]),
                            ("starts", [pieces[i][1] for i in row])):
            out[name].append(value)
    return pa.RecordBatch.from_pydict(out, pa.schema([
        ("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
        ("position_ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))]))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
         layout: Layout = Layout()) -> DataFrame:
    """Packed rows of ``layout.length`` ids.

    ``ids`` and ``position_ids`` hold little-endian unsigned integers: ids of
    two bytes if the vocabulary has at most 65,536, positions of two bytes in
    rows of at most 65,536 (``position_type``), else four.  Segment k
    of a row is ``ids[cu_seqlens[k]:cu_seqlens[k+1]]`` and belongs to
    ``doc_ids[k]``, from its token ``starts[k]`` on; positions start again at 0
    with each segment and with the padding.  A text is followed by ``end_id``
    and cut every ``length`` ids if it is longer.  Null and empty texts have no
    tokens and no segment; repeated rows are packed as often as they come; a
    null id stays null; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(tokenizer)
        dtype, next_id = coder.dtype, TaskContext.get().partitionId() << 33
        end = np.array([layout.end_id], dtype) if layout.end_id is not None else None
        pieces, held = [], 0
        for batch in batches:
            for key, value in zip(batch.column("doc_id"), batch.column("text")):
                if not (value := value.as_py()):
                    continue
                ids, key = coder.ids(value), key.as_py()
                if end is not None:
                    ids = np.concatenate([ids, end])
                for at in range(0, len(ids), layout.length):
                    piece = ids[at:at + layout.length]
                    if held + len(piece) > layout.block_tokens:
                        block = _block(pieces, layout, dtype, next_id)
                        next_id += block.num_rows
                        yield block
                        pieces, held = [], 0
                    pieces.append((key, at, piece))
                    held += len(piece)
        if pieces:
            yield _block(pieces, layout, dtype, next_id)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, SCHEMA)
