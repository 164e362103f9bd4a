"""Per-question BM25 and dense ranking, top-k cuts and the budgeted context walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import is_int, not_finite, require, violations
from ..functions.text import let, terms
from ..plans.lineage import pin
from .skew import salted_join

# Scores are rounded before they are compared: the last bits of a float depend on the order
# in which an engine adds, and must not decide a rank.
SCORE_DIGITS = 9


def term_features(chunks: DataFrame) -> DataFrame:
    """Replace chunk text by the counts BM25 needs.

    ``chunks`` carries the question's sorted distinct terms as ``q_terms``; the result has the
    chunk's term total and (term, n) for the query terms it holds, in sorted order. Terms are
    counted inside the row, so no word leaves its chunk, and a chunk's cost depends on the
    terms it shares with the question rather than on the question's length. What a removal takes away is
    counted, as it needs no step of an expression for every word.
    """
    found = chunks.withColumn("terms", terms("content")).drop("content")
    shared = F.array_intersect("q_terms", "terms")
    counts = F.transform(
        shared,
        lambda q: F.struct(
            q.alias("term"), (F.size("terms") - F.size(F.array_remove("terms", q))).alias("n")
        ),
    )
    return (
        found.withColumn("n_terms", F.size("terms")).withColumn("tf", counts).drop("terms", "q_terms")
    )


def pool_statistics(features: DataFrame) -> DataFrame:
    """Pool size, mean length and document frequencies per question.

    Both levels combine map-side, so a question that owns most chunks ships only one partial
    row per term and task. The two totals travel under names no term can have.
    """
    entry = lambda term, value: F.struct(
        term.alias("term"), value.cast("long").alias("value")
    )
    totals = F.array(entry(F.lit("#"), F.lit(1)), entry(F.lit("##"), F.col("n_terms")))
    present = F.transform("tf", lambda e: entry(e["term"], F.lit(1)))
    rows = features.select("interaction_id", F.explode(F.concat(totals, present)).alias("e"))
    sums = rows.groupBy("interaction_id", "e.term").agg(F.sum("e.value").alias("value"))
    pick = lambda name: F.max(F.when(F.col("term") == name, F.col("value")))
    frequency = F.collect_list(
        F.when(~F.col("term").isin("#", "##"), F.struct("term", "value"))
    )
    return sums.groupBy("interaction_id").agg(
        pick("#").alias("n_candidates"),
        (pick("##") / pick("#")).alias("mean_terms"),
        F.map_from_entries(frequency).alias("df"),
    )


def bm25_scores(
    features: DataFrame, statistics: DataFrame, k1: float = 1.5, b: float = 0.75
) -> DataFrame:
    """Score every chunk against its own question's pool; chunks without a hit score 0.

    The statistics row of a question holds its own terms only and is joined in salted buckets,
    so a question that owns a third of all chunks is scored by many tasks.
    """
    require(k1 > 0 and 0 <= b <= 1, "k1 has to be above 0 and b between 0 and 1")
    joined = salted_join(features, statistics, "interaction_id", "evidence_id")
    norm = F.lit(k1) * (
        F.lit(1 - b) + F.lit(b) * F.col("n_terms") / F.nullif(F.col("mean_terms"), F.lit(0.0))
    )

    def part(hit: Column, df: Column, length: Column) -> Column:
        idf = F.log(1 + (F.col("n_candidates") - df + 0.5) / (df + 0.5))
        return idf * hit["n"] * (k1 + 1) / (hit["n"] + length)

    score = let(
        norm,
        lambda length: F.aggregate(
            "tf",
            F.lit(0.0),
            lambda total, hit: total
            + let(F.element_at("df", hit["term"]), lambda df: part(hit, df, length)),
        ),
    )
    return joined.withColumn("score", F.coalesce(score, F.lit(0.0))).drop("tf", "df", "mean_terms")


def rank_order(score: str = "score", identity: str = "evidence_id") -> list[Column]:
    return [F.round(score, SCORE_DIGITS).desc(), F.col(identity).asc()]


def finite_score(score: str = "score") -> Column:
    """The score; a missing or non-finite one stops the query instead of taking a rank."""
    return F.when(not_finite(F.col(score)), F.raise_error(F.lit("a candidate has no finite score")).cast("double")).otherwise(
        F.col(score)
    )


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("interaction_id",)) -> DataFrame:
    """Best ``k`` rows of each group with their 1-based rank.

    The rank filter becomes a group limit below the exchange: each task ships at most ``k``
    rows of a group, however large the group is. A missing or non-finite score stops the query.
    """
    require(is_int(k) and k >= 1, "k must be positive")
    scored = scored.withColumn("score", finite_score())
    window = Window.partitionBy(*by).orderBy(*rank_order())
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def full_rank(scored: DataFrame, by: str = "interaction_id") -> DataFrame:
    """Exact rank of every row, also when one group does not fit a task.

    Range partitions follow (group, order), so a hot group spans many of them. Ranks are
    local row numbers plus the rows in the group's earlier partitions; the layout is written
    out first because partition numbers must not change between the two reads. A missing or
    non-finite score stops the query.
    """
    order = rank_order()
    scored = scored.withColumn("score", finite_score())
    laid = pin(scored.repartitionByRange(F.col(by), *order)).withColumn(
        "part", F.spark_partition_id()
    )
    local = Window.partitionBy("part", by).orderBy(*order)
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy(by, "part").agg(F.count("*").alias("n"))
    offsets = sizes.select(by, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    ranked = laid.withColumn("local", F.row_number().over(local)).join(offsets, [by, "part"])
    return ranked.withColumn("rank", F.col("local") + F.col("skip")).drop("part", "local", "skip")


def select_context(
    scored: DataFrame, limit: int, max_words: int, by: tuple[str, ...] = ("interaction_id",)
) -> DataFrame:
    """Walk the ranking and keep what still fits, skipping what does not, until ``limit`` items.

    Among items of one word count only the first ``limit`` in rank order can ever be taken:
    if one of them was skipped for space, every later item of that size is skipped too. That
    keeps at most ``limit * (max_words + 2)`` slim rows per question, and the cut is exact; all sizes
    that never fit are one class, kept so that a question of which nothing fits gets an empty
    selection. Items without words cost nothing. A missing or non-finite score stops the query.
    """
    require(
        all(is_int(v) and v >= 1 for v in (limit, max_words)),
        "limit and max_words have to be at least 1",
    )
    scored = scored.withColumn("score", finite_score())
    fits = F.coalesce((F.col("word_count") >= 0) & (F.col("word_count") <= max_words), F.lit(False))
    sized = scored.withColumn("size_class", F.when(fits, F.col("word_count")).otherwise(max_words + 1))
    window = Window.partitionBy(*by, "size_class").orderBy(*rank_order())
    short = sized.withColumn("n", F.row_number().over(window)).where(F.col("n") <= limit)
    item = F.struct(
        (-F.round("score", SCORE_DIGITS)).alias("key"), "evidence_id", "word_count", "score"
    )
    pools = short.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when(F.col("size_class") <= max_words, item))).alias("pool")
    )
    taken_type = "array<struct<evidence_id:string,word_count:int,score:double>>"
    empty = F.struct(F.lit(0).alias("used"), F.array().cast(taken_type).alias("taken"))

    def step(state: Column, row: Column) -> Column:
        used = state["used"] + row["word_count"]
        one = F.array(F.struct(row["evidence_id"], row["word_count"], row["score"])).cast(taken_type)
        fits_now = (used <= max_words) & (F.size(state["taken"]) < limit)
        return F.when(
            fits_now, F.struct(used.alias("used"), F.concat(state["taken"], one).alias("taken"))
        ).otherwise(state)

    walked = pools.select(*by, F.aggregate("pool", empty, step).alias("s"))
    return walked.select(*by, F.col("s.taken").alias("selected"), F.col("s.used").alias("context_words"))


def unit_vector(vector: Column) -> Column:
    """Vector of length 1 in double precision; a zero vector stays zero."""

    def scaled(values: Column) -> Column:
        norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
        return let(
            F.greatest(norm, F.lit(1e-12)), lambda n: F.transform(values, lambda x: x / n)
        )

    return let(vector.cast("array<double>"), scaled)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def dense_scores(
    candidates: DataFrame, questions: DataFrame, vector: str = "vector", measured: DataFrame | None = None
) -> DataFrame:
    """Cosine of each candidate vector with its own question's vector.

    ``measured`` is a cheaper table with about the candidates' shares of the questions.
    """
    query = questions.select("interaction_id", unit_vector(F.col(vector)).alias("q_vector"))
    joined = salted_join(candidates, query, "interaction_id", "evidence_id", measured=measured).withColumn(
        vector, unit_vector(F.col(vector))
    )
    return joined.withColumn("score", dot(F.col(vector), F.col("q_vector"))).drop(
        "q_vector", vector
    )


def rescore(shortlist: DataFrame, scores: DataFrame) -> DataFrame:
    """Replace first-stage scores by a second scorer's, keyed by (question, evidence)."""
    second = scores.select("interaction_id", "evidence_id", F.col("score").alias("second"))
    joined = shortlist.drop("rank").join(second, ["interaction_id", "evidence_id"], "left")
    return joined.withColumn("score", finite_score("second")).drop("second")


def score_violations(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """A scorer must return exactly one finite score for every candidate and nothing else."""
    key = ["interaction_id", "evidence_id"]
    counted = scores.groupBy(*key).agg(
        F.count("*").alias("n"), F.max(not_finite(F.col("score"))).alias("bad")
    )
    pool = candidates.select(*key).distinct().withColumn("known", F.lit(True))
    joined = pool.join(counted, key, "full")
    return violations(
        joined,
        F.concat_ws("/", *key),
        [
            ("missing_score", F.col("n").isNull(), F.lit("no score")),
            ("repeated_score", F.coalesce("n", F.lit(0)) > 1, F.col("n")),
            ("unknown_candidate", F.col("known").isNull(), F.lit("not in the pool")),
            ("score_not_finite", F.col("n").isNotNull() & F.col("bad"), F.lit("score")),
        ],
    )


def normalised_relevance(pool: DataFrame) -> DataFrame:
    """score / best score of the pool; a pool whose best score is 0 divides by 1.

    Meant for a pool already cut to a few candidates per question.
    """
    best = F.max("score").over(Window.partitionBy("interaction_id"))
    return pool.withColumn(
        "relevance", F.col("score") / F.coalesce(F.nullif(best, F.lit(0.0)), F.lit(1.0))
    )
