"""Retrieval runs: chunk, score, cut, and fill the context budget."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..operators.chunking import explode_pages, web_chunks, with_content
from ..operators.ranking import (
    bm25_scores,
    dense_scores,
    normalised_relevance,
    pool_statistics,
    rescore,
    select_context,
    term_features,
    top_k,
)
from ..operators.skew import salted_join
from .lineage import share

METHODS = ("bm25", "dense", "dense_reranked")


@dataclass(frozen=True)
class Scored:
    """Slim scored chunks (no text) and the pool statistics of every question."""

    chunks: DataFrame
    statistics: DataFrame


def score_pages(
    questions: DataFrame, pages: DataFrame, chunk_words: int, k1: float = 1.5, b: float = 0.75
) -> Scored:
    """BM25 over each question's own pages.

    Pages that carry their question's ``q_terms`` (``asked_pages``) are chunked where they are;
    others meet the terms first, in salts for heavy questions. From there to the counted features
    everything is narrow. The features are read twice (statistics, then scores), so these slim rows
    are kept rather than tokenising every page again. The statistics, a row for each question, are worked
    out before the scores, so that the planner knows their size and leaves the features where they are.
    """
    if "q_terms" not in pages.columns:
        asked = questions.select("interaction_id", query_terms("query").alias("q_terms"))
        pages = salted_join(pages, asked, "interaction_id", "page_index")
    chunks = web_chunks(pages, chunk_words, ("q_terms",))
    features = share(term_features(chunks.drop("source_title", "source_time")))
    statistics = share(pool_statistics(features))
    statistics.count()
    return Scored(bm25_scores(features, statistics, k1, b), statistics)


def asked_pages(records: DataFrame) -> DataFrame:
    """Pages of nested records, each with the terms of the question it came with: no join."""
    return explode_pages(records.withColumn("q_terms", query_terms("query")), ("q_terms",))


def ranked_pool(scored: Scored, pages: DataFrame, size: int) -> DataFrame:
    """Top candidates per question with text and normalised relevance.

    The candidates are worked out before their texts are asked for: with their size known, the planner
    sends few of them to the pages instead of exchanging the pages.
    """
    pool = share(normalised_relevance(top_k(scored.chunks.drop("n_candidates", "n_terms"), size)))
    pool.count()
    return with_content(pool, pages)


def candidates(pool: DataFrame) -> DataFrame:
    """A ranked pool as selection candidates; a page without address is named by position."""
    reference = F.when(F.col("source_url") != "", F.col("source_url")).otherwise(
        F.concat(F.lit("page:"), F.col("page_index").cast("string"))
    )
    return pool.select(
        "interaction_id",
        "evidence_id",
        "content",
        "source_kind",
        reference.alias("source_ref"),
        "relevance",
    )


def retrieval_run(
    questions: DataFrame, pages: DataFrame, chunk_words: int = 200, limit: int = 3,
    max_words: int = 600,
) -> DataFrame:
    """One row per question: pool size, context size, best evidence and its score."""
    scored = score_pages(questions, pages, chunk_words)
    context = select_context(scored.chunks, limit, max_words)
    return (
        questions.select("interaction_id")
        .join(scored.statistics.select("interaction_id", "n_candidates"), "interaction_id", "left")
        .join(context, "interaction_id", "left")
        .select(
            "interaction_id",
            F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
            F.coalesce(F.size("selected"), F.lit(0)).alias("n_selected"),
            F.coalesce("context_words", F.lit(0)).alias("context_words"),
            F.get("selected", F.lit(0))["evidence_id"].alias("top_evidence_id"),
            F.round(F.get("selected", F.lit(0))["score"], 6).alias("top_score"),
        )
    )


def selected_spans(context: DataFrame, chunks: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Chosen evidence as rows, with the span columns of its chunk."""
    rows = context.select(*by, F.posexplode("selected").alias("position", "e")).select(
        *by, "position", "e.evidence_id", "e.score"
    )
    spans = chunks.select(
        "interaction_id", "evidence_id", "page_index", "source_url", "field", "char_start",
        "char_end", "word_count",
    )
    return rows.join(spans, ["interaction_id", "evidence_id"])


def compare_methods(
    lexical: DataFrame,
    vectors: DataFrame,
    question_vectors: DataFrame,
    second_scorer: Callable[[DataFrame], DataFrame],
    dense_top_k: int,
    limit: int,
    max_words: int,
) -> tuple[DataFrame, DataFrame]:
    """BM25, dense, and dense re-ranked by a second scorer on one pool and one word budget.

    ``second_scorer`` gets the dense shortlist (interaction_id, evidence_id) and returns a score for
    each of its rows; it never sees the rest of the pool. Vectors become scores where they are, and only
    those meet the pool; the shortlist is worked out before the second scorer looks its rows up. Returns
    the scored union and the filled contexts, both keyed by (question, method).
    """
    slim = lexical.select("interaction_id", "evidence_id", "word_count", "score")
    own = vectors.select("interaction_id", "evidence_id", "vector")
    question_vectors = share(question_vectors)
    question_vectors.count()
    near = dense_scores(own, question_vectors, measured=slim)
    dense = share(slim.drop("score").join(near, ["interaction_id", "evidence_id"]))
    shortlist = share(top_k(dense, dense_top_k))
    shortlist.count()
    refined = rescore(shortlist, second_scorer(shortlist.select("interaction_id", "evidence_id")))
    named = lambda df, m: df.withColumn("method", F.lit(m))
    union = (
        named(slim, METHODS[0])
        .unionByName(named(dense, METHODS[1]))
        .unionByName(named(refined, METHODS[2]))
    )
    return union, select_context(union, limit, max_words, ("interaction_id", "method"))
