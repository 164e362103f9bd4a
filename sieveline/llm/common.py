"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.plans.lineage import cut

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file; imported here so that only token operators need it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under names that no other column can clash with."""
    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("body"))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """Write an intermediate into the shared folder once and go on from its files.

    The shuffle files behind it are not needed after that, so Spark may drop them at once.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        out = cut(df)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables that ``saved`` wrote, once everything made of them has been saved too."""
    for df in written:
        spark = df.sparkSession
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str) -> str:
    """A column name that a caller's table does not hold."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def slots(df: DataFrame, share: int = 1) -> int:
    """Partition number for rows that are few but carry work: the session's shuffle setting."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // share)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application; they may not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="sieveline-package-")
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(context.applicationId)
