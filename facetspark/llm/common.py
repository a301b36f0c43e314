"""Helpers of the training-data operators: words, keys, written steps, Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

#: A word is a run of characters other than space and ``\\t\\n\\v\\f\\r``; ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: The steps of the blocks that are open, the innermost last.
_STEPS: ContextVar[tuple[list[str], ...]] = ContextVar("steps", default=())


@contextmanager
def passing_steps(spark: SparkSession) -> Iterator[None]:
    """Remove the steps written inside when the block ends, save those written to be kept: they go with the block around it, if any.

    Nothing that outlives the block may read a step that goes.
    """
    mine: list[str] = []
    token = _STEPS.set((*_STEPS.get(), mine))
    try:
        yield
    finally:
        _STEPS.reset(token)
        for path in mine:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to the folder that all executors share and read it back.

    This runs the plan once, cuts the lineage, and survives lost executors.
    ``keep`` exempts the step from the innermost ``passing_steps``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    if steps := _STEPS.get()[:-1] if keep else _STEPS.get():
        steps[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_key(doc_id: str, text: str) -> Column:
    """A random-looking hex key of a row; rows share it only if id and text are equal."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit(""))))


def share_of(key: str) -> Column:
    """The hex key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(1 << 48)


def arrow_map(df: DataFrame, schema: str, table: Callable[[pa.RecordBatch], dict | pa.RecordBatch | None]) -> DataFrame:
    """Apply a function of one Arrow batch to every batch; it gives columns by name, a batch, or nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := table(batch)) is not None:
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The texts as UTF-8, null as empty, one at a time."""
    for value in batch.column(column):
        yield (value.as_py() or "").encode()


def equal_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of a sorted partition, one table for each run of equal keys, however the batches cut it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        if held and held[-1].column(key)[-1] != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cuts = (np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            if start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)
