"""Audits over rows that have no partner on the other side of their join."""

from pyspark.sql import functions as F

from sieveline.operators import audits as A
from sieveline.plans import retrieval as ret


def found(df):
    return {(r.location, r.rule) for r in df.collect()}


def test_method_audit_reports_a_stranger_once(spark):
    schema = "interaction_id string, method string, evidence_id string, word_count int, score double"
    trace = spark.createDataFrame([("q", "m", "known", 3, 1.0), ("q", "m", "stranger", 2, 0.5), ("q", "m", "longer", 4, 0.4)], schema)
    pool = spark.createDataFrame([("q", "known", 3), ("q", "longer", 5)], "interaction_id string, evidence_id string, word_count int")
    runs = spark.createDataFrame([("q", "m", 9)], "interaction_id string, method string, context_words int")
    assert found(A.method_audit(trace, pool, runs, ("m",), 3, 10)) == {
        ("q/m/stranger", "not_in_pool"), ("q/m/longer", "word_count_differs"),
    }


def test_routing_audit_reports_an_unknown_question_once(spark):
    plans = spark.sql(
        """select 'gone' interaction_id, 'adaptive' policy, array('web') requested_hints,
        array(named_struct('name', 'x', 'reason', 'unavailable')) blocked_hints, array(named_struct('name', 'web', 'tokens', 5)) allocations,
        5 evidence_budget, 1 reserved_tokens, 6 total_budget, 1 max_source_calls, 'not_executed' execution_status"""
    )
    eligible = spark.sql("select 'other' interaction_id, array('web') eligible, map('x', 'unavailable') reasons")
    one = ("adaptive",)
    assert found(A.routing_audit(plans, eligible, one)) == {("gone/adaptive", "question_unknown"), ("other/adaptive", "plan_missing")}
    known = eligible.withColumn("interaction_id", F.lit("gone"))
    assert found(A.routing_audit(plans, known, one)) == set()


def test_span_audit_of_unknown_pages(spark):
    trace = spark.sql(
        "select 'q' interaction_id, 'e' evidence_id, 7 page_index, 'u' source_url, 'page_result' field, 0 char_start, 3 char_end, 'abc' content, 1 word_count"
    )
    pages = spark.sql("select 'q' interaction_id, 0 page_index, 'u' page_url, 'abc' page_result, '' page_snippet")
    assert found(A.span_audit(trace, pages)) == {("q/e", "page_unknown")}


def test_pages_that_carry_their_terms_need_no_join(spark):
    records = spark.sql(
        """select 'q' interaction_id, 'alpha beta' query, array(named_struct('page_name', 'n', 'page_url', 'u', 'page_snippet', '',
        'page_result', 'alpha beta gamma alpha', 'page_last_modified', '')) search_results"""
    )
    scored = ret.score_pages(records, ret.asked_pages(records), 2)
    apart = ret.score_pages(records, ret.explode_pages(records), 2)
    key = lambda s: sorted((r.evidence_id, r.score) for r in s.chunks.collect())
    assert key(scored) == key(apart) and len(key(scored)) == 2
    chunks = ret.web_chunks(ret.asked_pages(records), 2, ("q_terms",))
    assert "Join" not in chunks._jdf.queryExecution().executedPlan().toString()
