"""Large pages and features stay where they are when few rows ask for them."""

import pytest
from pyspark.sql import functions as F

from sieveline.plans import retrieval as ret
from sieveline.plans.lineage import release


@pytest.fixture
def small_broadcasts(spark):
    """Tables of more than 40 kB are large here."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "40000")
    yield
    spark.conf.set(key, before)
    release(spark)


def asked(spark):
    rows = [(f"q{i}", f"alpha w{i} w{i + 1}") for i in range(4)]
    return spark.createDataFrame(rows, "interaction_id string, query string")


def paged(spark):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.concat(F.lit("w"), ((F.col("id") * k) % 97).cast("string"))), " ")
    return spark.range(400).select(
        F.concat(F.lit("q"), (F.col("id") % 4).cast("string")).alias("interaction_id"),
        F.expr("cast(id div 4 as int)").alias("page_index"), F.lit("n").alias("page_name"), F.lit("u").alias("page_url"),
        F.lit("").alias("page_snippet"), text.alias("page_result"), F.lit("").alias("page_last_modified"),
    )


def planned(df):
    """Names of the plan's own operators, without those behind kept tables."""

    def names(node):
        below = node.children()
        return [node.nodeName(), *[n for i in range(below.size()) for n in names(below.apply(i))]]

    return names(df._jdf.queryExecution().sparkPlan())


def test_winners_go_to_their_pages(spark, small_broadcasts, tmp_path):
    paged(spark).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    pool = ret.ranked_pool(ret.score_pages(asked(spark), pages, 20), pages, 3)
    assert "SortMergeJoin" not in planned(pool)
    words = {r.evidence_id: r.content for r in pool.collect()}
    assert len(words) == 12
    assert all(len(text.split()) == 20 for text in words.values())


def test_scores_meet_statistics_without_moving_features(spark, small_broadcasts):
    scored = ret.score_pages(asked(spark), paged(spark), 20)
    assert "SortMergeJoin" not in planned(scored.chunks.select("interaction_id", "evidence_id", "score"))
    assert scored.chunks.count() == 400 * 15
