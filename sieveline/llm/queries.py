"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    balltree,
    classifier,
    counts,
    packing,
    passages,
    prefixtrie,
    projections,
    rules,
    sentencepieces,
    simhash,
    suffixes,
    tokenfiles,
    whitening,
)
from .common import ship, table, tokenizer_path
from .sql import ORACLE as ORACLE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return fn(spark, d)

    QUERIES[fn.__name__] = run
    return run


@query
def op3_packing(spark: SparkSession, d: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, d, "documents"), tokenizer_path())
    return placed.withColumnRenamed("doc", "doc_id")


@query
def op10_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, d, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("group").alias("component_id"),
    )


@query
def op6_rules(spark: SparkSession, d: str) -> DataFrame:
    rated, _ = rules.judged(table(spark, d, "documents"), table(spark, d, "labels"))
    return rated.select(
        F.col("doc").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule",
    )


@query
def op1_classifier(spark: SparkSession, d: str) -> DataFrame:
    rated = classifier.scores(table(spark, d, "documents"), table(spark, d, "labels"))
    return rated.withColumnRenamed("doc", "doc_id")


@query
def op7_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return projections.near_vectors(table(spark, d, "embeddings"))


@query
def op9_suffixes(spark: SparkSession, d: str) -> DataFrame:
    cleaned = suffixes.remove_repeats(table(spark, d, "documents"))
    return cleaned.select(
        F.col("doc").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


@query
def op4_passages(spark: SparkSession, d: str) -> DataFrame:
    found = passages.passages_by_text(passages.near_passages(table(spark, d, "documents")))
    return found.select(F.col("doc").alias("doc_id"), F.explode("spans").alias("s")).select(
        "doc_id", F.col("s.low").alias("first_word"), (F.col("s.high") - F.col("s.low")).alias("n_words"),
        F.array_sort("s.others").alias("repeats_doc_ids"),
    )


@query
def op5_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    coded = sentencepieces.encode_and_decode(table(spark, d, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return coded.select(F.col("doc").alias("doc_id"), "n_ids", "ids_crc32", "round_trip", (F.col("differing_pieces") == 0).alias("parity"))


@query
def op2_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokenfiles.encode_and_read(table(spark, d, "documents"), tokenizer_path()).withColumnRenamed("doc", "doc_id")


@query
def op8_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.count_redacted(table(spark, d, "documents"), tokenizer_path()).withColumnRenamed("doc", "doc_id")


@query
def op11_products(spark: SparkSession, d: str) -> DataFrame:
    return balltree.largest_products(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"))


@query
def op13_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, d, "conversations"))
