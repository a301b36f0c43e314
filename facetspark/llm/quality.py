"""Quality rules: compression bands.

A text is compressed whole and in chunks of a fixed size.  Repetitive text
compresses far better, and random or encoded text far worse, than prose of the
same length, so each length has its own lowest and highest ratio.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import arrow_map, texts_of

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50


class Band(NamedTuple):
    """Ratios (bytes before / after) that prose of at most ``upto`` bytes may have."""

    upto: float
    lowest: float
    highest: float


#: zstandard at level 3, without dictionary.  Short texts hardly compress; long prose comes to about 3.  Above 256 bytes
#: the lowest limits lie between base64 (1.15 at 512 bytes, 1.26, 1.30, 1.31, then up to 1.33; base32 up to 1.60) and
#: the least of prose (1.35 at 257 to 512 bytes, 1.44, 1.69, 1.84, 2.09 and more); below, the two meet.
BANDS = (
    Band(256, 0.90, 2.4),
    Band(512, 1.25, 2.8),
    Band(1024, 1.35, 2.8),
    Band(2048, 1.50, 3.2),
    Band(4096, 1.62, 3.2),
    Band(16384, 1.65, 3.6),
    Band(65536, 1.65, 4.2),
    Band(float("inf"), 1.65, 5.0),
)


class Rule(NamedTuple):
    bands: Sequence[Band] = BANDS
    chunk_bytes: int = 4096
    odd_share: float = 0.02
    level: int = 3


PROFILE = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "base_failed boolean, ratio double, odd_chunk_bytes bigint, kept boolean")


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered[i] = covered[i + 1] = covered[i + 2] = 1
    return sum(covered)


def in_band(n_bytes: int, ratio: float, bands: Sequence[Band]) -> bool:
    band = next(b for b in bands if n_bytes <= b.upto)
    return band.lowest <= ratio <= band.highest


class Judge:
    """Figures and verdict of one text; holds one compressor."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.packer = zstandard.ZstdCompressor(level=rule.level, write_content_size=False, write_checksum=False)

    def ratio(self, data: bytes) -> float:
        return len(data) / max(1, len(self.packer.compress(data)))

    def bands(self, text: bytes) -> tuple[float, int, bool]:
        rule = self.rule
        ratio, odd = self.ratio(text), 0
        good = not text or in_band(len(text), ratio, rule.bands)
        if len(text) > rule.chunk_bytes:
            for at in range(0, len(text), rule.chunk_bytes):
                chunk = text[at:at + rule.chunk_bytes]
                if not in_band(len(chunk), self.ratio(chunk), rule.bands):
                    odd += len(chunk)
        return ratio, odd, good and odd <= rule.odd_share * len(text)

    def __call__(self, text: bytes) -> tuple:
        words = text.split()
        lines = [line for line in text.split(b"\n") if line.strip()]
        n, repeats = len(words), repeat_words(words)
        failed = n < MIN_WORDS or 100 * repeats > 50 * n
        ratio, odd, good = self.bands(text)
        return (n, sum(len(w.decode()) for w in words) if not text.isascii() else sum(map(len, words)),
                len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeats,
                failed, ratio, odd, good and not failed)


def compression_profile(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One row per document: its id, the counts, the ratios and the verdict ``kept``.

    A null or empty text has no words and fails; a null id is passed through;
    repeated rows are judged alike; other columns are not read.  Each row is
    judged alone: no shuffle, and memory for one batch of texts.
    """
    names = [part.split()[0] for part in PROFILE.split(", ")]
    kind = dict(docs.dtypes)[doc_id]

    def table(batch: pa.RecordBatch) -> dict:
        judge = Judge(rule)
        rows = zip(*map(judge, texts_of(batch, "text")))
        return {"doc_id": batch.column("doc_id")} | {name: pa.array(values) for name, values in zip(names, rows)}

    return arrow_map(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), f"doc_id {kind}, {PROFILE}", table)


def keep_prose(docs: DataFrame, text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` that ``compression_profile`` keeps, with all their columns."""
    def table(batch: pa.RecordBatch) -> pa.RecordBatch:
        judge = Judge(rule)
        return batch.filter(pa.array([judge(t)[-1] for t in texts_of(batch, text)]))

    return arrow_map(docs, docs.schema, table)
