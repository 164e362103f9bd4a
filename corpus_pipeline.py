"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame
that is written and read again as the next one's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import classifier, packing, passages, rules, simhash
from sieveline.llm.common import saved, ship, table, tokenizer_path


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` after a change of the text; columns keep their order."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier scores under its threshold."""
    ship(spark)
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the learned rules reject."""
    return rules.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked fingerprints."""
    ship(spark)
    return simhash.keep_one(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages out that an earlier document has too; no document goes."""
    ship(spark)
    return _sized(passages.remove_passages(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place all tokens in as few sequences as can be."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_path()).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality classifier", keep_quality),
    ("quality rules", keep_by_rules),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_passages),
    ("best-fit packing", pack),
]
#: The classifier, the passages and the tokens have no SQL equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
