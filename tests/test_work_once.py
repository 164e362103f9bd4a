"""Audited runs are worked out once; only what has to move is moved."""

import pytest
from pyspark.sql import functions as F

from fixtures import catalog, views
from sieveline.operators.asof import alias_dictionary
from sieveline.plans import retrieval as ret
from sieveline.plans.lineage import release


@pytest.mark.parametrize(("name", "step"), [("selection_audit", "_problems"), ("generated_audit", "_generated"), ("packet_violations", "_packet")])
def test_audit_works_its_run_out_once(spark, monkeypatch, name, step):
    calls, work = [], getattr(catalog, step)
    monkeypatch.setattr(catalog, step, lambda *a: calls.append(a) or work(*a))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    release(spark)
    assert len(calls) == 1


def test_retry_audit_works_its_decisions_out_once(spark, monkeypatch):
    decided, asked = [], []
    decide, request = catalog._decisions, views.prior_close_requests
    monkeypatch.setattr(catalog, "_decisions", lambda *a: decided.append(a) or decide(*a))
    monkeypatch.setattr(views, "prior_close_requests", lambda *a: asked.append(a) or request(*a))
    found = catalog.QUERIES["retry_audit"](spark, "/root/testdata/sf0.001").select("rule").distinct().collect()
    release(spark)
    assert len(decided) == 1 and len(asked) == 1
    assert {"released_answer_differs", "combined_reserved_tokens_differs"} <= {r.rule for r in found}


def test_dictionary_tells_the_lengths_that_occur(spark):
    rows = [("Alpha", "A"), ("one two three", "B"), ("four, five six", "C"), ("...", "D")]
    aliases = spark.createDataFrame(rows, "alias string, symbol string")
    assert alias_dictionary(aliases)[1] == [1, 3]


def test_vectors_become_scores_before_they_meet_the_pool(spark, monkeypatch, tmp_path):
    kept, share = [], ret.share
    monkeypatch.setattr(ret, "share", lambda df: kept.append(df) or share(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
    try:
        spark.range(2000).select(
            (F.col("id") % 3).cast("string").alias("interaction_id"), F.col("id").cast("string").alias("evidence_id"),
            F.lit(3).alias("word_count"), (F.col("id") % 5).cast("double").alias("score"),
            F.array(F.col("id") * 1.0, F.lit(1.0)).alias("vector"),
        ).write.parquet(str(tmp_path / "rows"))
        rows = spark.read.parquet(str(tmp_path / "rows"))
        own = rows.where("cast(evidence_id as int) < 3").select("interaction_id", "vector")
        second = lambda few: few.withColumn("score", F.lit(1.0))
        _, contexts = ret.compare_methods(rows.drop("vector"), rows.select("interaction_id", "evidence_id", "vector"), own, second, 2, 2, 9)
        assert contexts.count() == 9

        def joins(node):
            below = node.children()
            here = [node.output().mkString(" ")] if node.nodeName() == "SortMergeJoin" else []
            return here + [j for i in range(below.size()) for j in joins(below.apply(i))]

        moved = [j for df in kept for j in joins(df._jdf.queryExecution().sparkPlan())]
        assert not any("vector#" in j for j in moved)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        release(spark)
