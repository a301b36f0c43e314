"""Parquet sources and sinks (S1-S3, S6, S7) and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from hashlib import md5
from typing import NamedTuple
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import named
from ..spec import DatasetSpec


class FacetTables(NamedTuple):
    """The three flat tables every query runs on."""

    main: DataFrame
    tags: DataFrame
    children: DataFrame


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """Open a Parquet dataset; Spark raises PATH_NOT_FOUND if it is missing."""
    return spark.read.parquet(path)


def read_columns(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """Only the wanted columns that exist, in the wanted order."""
    df = open_table(spark, path)
    return existing(df, wanted)


def existing(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[named(c) for c in dict.fromkeys(wanted) if c in have])


def list_columns(df: DataFrame) -> list[str]:
    return list(df.columns)


def write_table(df: DataFrame, path: str, cluster_by: Sequence[str] = ()) -> None:
    """Write one table, range-partitioned and sorted on ``cluster_by`` if given.

    Parquet row-group statistics then let filters on those columns skip most of
    the files.
    """
    if cluster_by:
        order = [named(c) for c in dict.fromkeys(cluster_by)]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("overwrite").parquet(path)


@contextmanager
def settled(df: DataFrame, path: str) -> Iterator[DataFrame]:
    """``df`` written to ``path`` as it comes and read back, for writing it in order; removed when the block ends.

    An ordered write samples the rows first, so all that makes them after the
    last shuffle would run twice; this way only the reading does.
    """
    spark = df.sparkSession
    try:
        write_table(df, path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table_name(path: str) -> str:
    """The catalog name of a bucketed table; the catalog alone knows its buckets."""
    return f"facet_{md5(path.encode()).hexdigest()}"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write one table in buckets by a key, sorted by it; one file a bucket.

    Joins and groupings by the key then need no shuffle.  A key with a large
    share of the rows makes a bucket as large: keep such a table unbucketed.
    """
    dealt = df.repartition(buckets, named(key)).sortWithinPartitions(named(key))
    dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(table_name(path))


def open_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """Open a table that ``write_bucketed`` wrote, in this application or another."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        quoted = "`" + key.replace("`", "``") + "`"
        spark.sql(f"CREATE TABLE {name} ({open_table(spark, path).schema.toDDL()}) USING parquet CLUSTERED BY ({quoted}) SORTED BY ({quoted}) "
                  f"INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_tables(
    tables: FacetTables,
    out_dir: str,
    ds: DatasetSpec,
    cluster_by: Sequence[str] = (),
) -> str:
    """Write the three tables and publish them together (S6); returns the version.  Runs the jobs at once.

    They go to a folder of their own; the manifest that names it is written
    last.  Readers see the three tables before or after, never a mixture, also
    of two runs at once, and a run that fails leaves what was there.
    """
    version = uuid4().hex
    folder = version_folder(out_dir, version)
    write_main(tables.main, folder, ds, cluster_by)
    write_tags(tables.tags, folder, ds)
    write_children(tables.children, folder, ds)
    publish(tables.main.sparkSession, out_dir, version, ds.buckets)
    return version


def version_folder(out_dir: str, version: str) -> str:
    return f"{out_dir}/versions/{version}"


_MANIFEST = "number bigint, version string, buckets int, hidden array<string>"


def manifests(spark: SparkSession, out_dir: str) -> DataFrame:
    """(number, version, buckets, hidden) of everything published here, none if nothing was."""
    try:
        return spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).json(f"{out_dir}/publications")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def latest(spark: SparkSession, out_dir: str) -> Row | None:
    """The manifest in force: the greatest number; of runs that published at once the greatest version."""
    found = manifests(spark, out_dir)
    return found.agg(F.max(F.struct("number", "version", "buckets", "hidden")).alias("m")).select("m.*").where("version is not null").first()


def publish(spark: SparkSession, out_dir: str, version: str, buckets: int = 0, hidden: Sequence[str] = ()) -> None:
    """Put a version in force: one small file, which appears whole or not at all."""
    before = latest(spark, out_dir)
    row = (before.number + 1 if before else 1, version, buckets, list(hidden))
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.json(f"{out_dir}/publications/{version}")


def write_main(main: DataFrame, out_dir: str, ds: DatasetSpec, cluster_by: Sequence[str] = ()) -> None:
    """``cluster_by`` orders the table; the entity key is added, which splits a dominant rank value over partitions.

    A dataset with buckets is laid out by the entity key instead.
    """
    path = f"{out_dir}/{ds.main_file}"
    if ds.buckets:
        write_bucketed(main, path, ds.key, ds.buckets)
    else:
        write_table(main, path, (*cluster_by, ds.key) if cluster_by else ())


def write_tags(tags: DataFrame, out_dir: str, ds: DatasetSpec) -> None:
    """Ordered by level and value, so that a tag selection reads few row groups; or in buckets by the entity key."""
    path = f"{out_dir}/{ds.tag_file}"
    if ds.buckets:
        write_bucketed(tags, path, ds.tag_key, ds.buckets)
    else:
        write_table(tags, path, (ds.tag_level, ds.tag_value, ds.tag_key))


def write_children(children: DataFrame, out_dir: str, ds: DatasetSpec) -> None:
    write_table(children, f"{out_dir}/{ds.child_file}")


def open_main(spark: SparkSession, folder: str, ds: DatasetSpec) -> DataFrame:
    path = f"{folder}/{ds.main_file}"
    return open_bucketed(spark, path, ds.key, ds.buckets) if ds.buckets else open_table(spark, path)


def open_tags(spark: SparkSession, folder: str, ds: DatasetSpec) -> DataFrame:
    path = f"{folder}/{ds.tag_file}"
    return open_bucketed(spark, path, ds.tag_key, ds.buckets) if ds.buckets else open_table(spark, path)


def read_tables(spark: SparkSession, out_dir: str, ds: DatasetSpec) -> FacetTables:
    """The three tables of the version in force; without a manifest those directly in the folder."""
    manifest = latest(spark, out_dir)
    if manifest is not None and manifest.buckets != ds.buckets:
        raise ValueError(f"the tables have {manifest.buckets} buckets, the dataset says {ds.buckets}")
    folder = out_dir if manifest is None else version_folder(out_dir, manifest.version)
    hidden = manifest.hidden if manifest is not None else []
    return FacetTables(
        open_main(spark, folder, ds).drop(*hidden), open_tags(spark, folder, ds), open_table(spark, f"{folder}/{ds.child_file}"))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only a local session, whose driver and executors are one machine, gets a
    folder of its own when ``spark.checkpoint.dir`` is unset; it goes when
    Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="facetspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")
