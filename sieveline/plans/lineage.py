"""Reuse of intermediate results that several branches of one plan read."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_shared: list[DataFrame] = []
_written: weakref.WeakKeyDictionary[SparkSession, list[str]] = weakref.WeakKeyDictionary()
_named: weakref.WeakKeyDictionary[SparkSession, list[str]] = weakref.WeakKeyDictionary()


def _folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A session whose driver is its only executor may go without one and gets a folder of its own;
    on a cluster every executor would write to another disk, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sieveline-checkpoint-"))
    return context.getCheckpointDir()


def place(spark: SparkSession, table: str | None = None) -> str:
    """A new path in the checkpoint folder; ``release`` deletes what is written there.

    ``table`` names the catalog table over it, if there is one, which is dropped then too.
    """
    path = f"{_folder(spark)}/{table or 'table'}-{uuid.uuid4().hex}"
    _written.setdefault(spark, []).append(path)
    if table:
        _named.setdefault(spark, []).append(table)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the checkpoint folder and continue from its files.

    The rows are computed once, and later rounds start from the files. ``release`` deletes them.
    """
    spark = df.sparkSession
    path = place(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever store it is in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def pin(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` with its partition layout, for plans that rely on partition numbers.

    A checkpoint computes its input again while writing, so the rows are held meanwhile.
    """
    _folder(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    written = kept.checkpoint()
    kept.unpersist()
    return written


def share(df: DataFrame) -> DataFrame:
    """Keep a slim intermediate for the branches that read it twice.

    Blocks spill to disk and are recomputed from lineage when an executor is lost.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _shared.append(kept)
    return kept


def release(spark: SparkSession) -> None:
    """Drop everything ``share`` kept and ``cut`` wrote for this session; results must be read by then."""
    for df in _shared[:]:
        if df.sparkSession is spark:
            df.unpersist()
            _shared.remove(df)
    for table in _named.pop(spark, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in _written.pop(spark, []):
        delete(spark, path)


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread small rows that carry heavy per-row work over all shuffle partitions.

    Adaptive execution sizes partitions by bytes and would put thousands of such rows into
    one task; a requested partition number is kept.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)
