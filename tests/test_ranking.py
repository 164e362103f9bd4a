import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieveline.functions.text import query_terms
from sieveline.operators import ranking as R

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, 12))) or "..." for _ in range(n)]


def plain_bm25(query, items, k1=1.5, b=0.75):
    find = lambda t: re.findall(r"\w+", t.casefold())
    counts = [Counter(find(t)) for _, t in items]
    total = [sum(c.values()) for c in counts]
    mean = sum(total) / len(total)
    if mean == 0:
        return {i: 0.0 for i, _ in items}
    df = Counter(t for c in counts for t in c)
    out = {}
    for (i, _), c, n in zip(items, counts, total, strict=True):
        out[i] = sum(
            math.log(1 + (len(items) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1)
            / (c[t] + k1 * (1 - b + b * n / mean))
            for t in sorted(set(find(query))) if c[t]
        )
    return out


def pools(spark):
    """One question owns most chunks; one has only punctuation."""
    data = {"hot": texts(1, 400), "a": texts(2, 20), "dots": ["...", "!!"]}
    rows = [(q, f"{q}{i:04d}", t) for q, ts in data.items() for i, t in enumerate(ts)]
    asked = {"hot": "alpha beta beta delta", "a": "zeta Eta", "dots": "alpha"}
    chunks = spark.createDataFrame(rows, "interaction_id string, evidence_id string, content string")
    questions = spark.createDataFrame(list(asked.items()), "interaction_id string, query string")
    chunks = chunks.join(questions, "interaction_id").withColumn("q_terms", query_terms("query"))
    chunks = chunks.drop("query").withColumn("word_count", F.size(F.split("content", " ")))
    expected = {
        (q, i): s
        for q in data
        for i, s in plain_bm25(asked[q], [(r[1], r[2]) for r in rows if r[0] == q]).items()
    }
    return chunks, expected


def scored(spark):
    chunks, expected = pools(spark)
    features = R.term_features(chunks)
    return R.bm25_scores(features, R.pool_statistics(features)), expected


def test_scores_and_every_rank_match_a_plain_loop(spark):
    got, expected = scored(spark)
    rows = R.full_rank(got.select("interaction_id", "evidence_id", "score")).collect()
    assert len(rows) == len(expected)
    for r in rows:
        assert math.isclose(r.score, expected[r.interaction_id, r.evidence_id], abs_tol=1e-9)
    for q in ("hot", "a", "dots"):
        order = sorted(
            (-round(s, 9), i) for (owner, i), s in expected.items() if owner == q
        )
        ranked = sorted((r.rank, r.evidence_id) for r in rows if r.interaction_id == q)
        assert ranked == [(n, i) for n, (_, i) in enumerate(order, 1)]


def test_top_k_limits_below_the_exchange(spark):
    got, _ = scored(spark)
    top = R.top_k(got, 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the exchange by question
    assert {r.interaction_id: r["count"] for r in top.groupBy("interaction_id").count().collect()} == {
        "hot": 3, "a": 3, "dots": 2,
    }


@pytest.mark.parametrize("limit,max_words", [(3, 10), (5, 17), (1, 2), (50, 40)])
def test_context_walk_skips_and_continues(spark, limit, max_words):
    got, _ = scored(spark)
    rows = got.select("interaction_id", "evidence_id", "score", "word_count").collect()
    expected = {}
    for q in {r.interaction_id for r in rows}:
        used, taken = 0, []
        mine = [r for r in rows if r.interaction_id == q]
        for r in sorted(mine, key=lambda r: (-round(r.score, 9), r.evidence_id)):
            if used + r.word_count <= max_words and len(taken) < limit:
                used, taken = used + r.word_count, [*taken, r.evidence_id]
        if taken:
            expected[q] = (used, taken)
    walked = R.select_context(got, limit, max_words).collect()
    assert {
        r.interaction_id: (r.context_words, [e.evidence_id for e in r.selected]) for r in walked
    } == expected


def test_parameters_are_checked(spark):
    got, _ = scored(spark)
    for bad in ({"k1": 0}, {"b": 1.5}):
        with pytest.raises(ValueError):
            R.bm25_scores(got, got, **bad)
    with pytest.raises(ValueError):
        R.select_context(got, 0, 5)


def test_dense_and_second_stage(spark):
    pool = spark.createDataFrame(
        [("q", "a", [3.0, 4.0]), ("q", "b", [1.0, 0.0]), ("q", "z", [0.0, 0.0])],
        "interaction_id string, evidence_id string, vector array<float>",
    )
    own = spark.createDataFrame([("q", [2.0, 0.0])], "interaction_id string, vector array<float>")
    dense = {r.evidence_id: round(r.score, 6) for r in R.dense_scores(pool, own).collect()}
    assert dense == {"a": 0.6, "b": 1.0, "z": 0.0}
    second = spark.createDataFrame(
        [("q", "a", 9.0), ("q", "b", 1.0)], "interaction_id string, evidence_id string, score double"
    )
    two = R.top_k(R.rescore(R.top_k(R.dense_scores(pool, own), 2), second), 2).collect()
    assert [(r.rank, r.evidence_id) for r in sorted(two, key=lambda r: r.rank)] == [(1, "a"), (2, "b")]
    found = {(r.location, r.rule) for r in R.score_violations(pool, second).collect()}
    assert found == {("q/z", "missing_score")}
