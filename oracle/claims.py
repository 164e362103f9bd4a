"""SQL equivalents: claims, verdicts, retries, metrics and prediction reviews."""

from __future__ import annotations

from .base import CTES, compose

ORACLE: dict[str, str] = {}


def _answer(shift: int) -> str:
    return f"""coalesce(CASE ((event_id // 12) + {shift}) % 6
    WHEN 0 THEN coalesce(CAST(close AS VARCHAR), '0.5')
    WHEN 1 THEN CAST(CAST(round(close) AS BIGINT) AS VARCHAR)
    WHEN 2 THEN '$' || coalesce(CAST(close AS VARCHAR), '0.5')
    WHEN 3 THEN ticker || '''s closing price yesterday (' || strftime(requested_date, '%Y-%m-%d')
      || ') was ' || coalesce(CAST(close AS VARCHAR), '0.5') || '.'
    WHEN 4 THEN 'I don''t know.'
    ELSE 'about ' || coalesce(CAST(close AS VARCHAR), '0.5') END, 'unknown')"""


CTES["e_pred"] = f"""
SELECT *, {_answer(0)} AS prediction, {_answer(3)} AS second_prediction,
  sha256(query || '|' || CASE WHEN uses THEN coalesce(content, '') ELSE '' END) AS prompt_sha256,
  uses AND close IS NOT NULL AS uses_price
FROM (SELECT r.interaction_id, p.policy, q.event_id, q.query, r.ticker, r.requested_date,
    e.close, e.content, 100 + event_id % 50 AS input_tokens, 5 + event_id % 20 AS output_tokens,
    event_id % 10 / 10.0::DOUBLE AS generation_seconds,
    event_id % 4 / 4.0::DOUBLE AS retrieval_seconds,
    p.policy = 'all_available' OR (p.policy = 'adaptive' AND contains(q.query, 'stock price'))
      AS uses
  FROM e_request r JOIN e_query q USING (interaction_id)
  LEFT JOIN e_evidence e USING (interaction_id)
  CROSS JOIN (VALUES ('fixed_web'), ('all_available'), ('adaptive')) p(policy))"""
CTES["e_claim"] = """
SELECT interaction_id, policy, close AS value, CAST(NULL AS VARCHAR) AS currency FROM e_pred WHERE uses_price
UNION ALL SELECT interaction_id, policy, close + 1, CAST(NULL AS VARCHAR) FROM e_pred
WHERE uses_price AND event_id % 7 = 0
UNION ALL SELECT interaction_id, policy, close * 2, 'USD' FROM e_pred
WHERE uses_price AND event_id % 5 = 0"""
CTES["e_extra"] = """
SELECT interaction_id, policy, close AS value, CAST(NULL AS VARCHAR) AS currency FROM e_pred
WHERE close IS NOT NULL"""
_NUMBER = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)"


def _state(claims: str) -> str:
    return f"""
SELECT interaction_id, policy, CAST(sum(n) AS BIGINT) AS n_claims, bool_or(apart) AS conflict,
  list_distinct(flatten(list(vals))) AS vals
FROM (SELECT interaction_id, policy, currency, count(*) AS n, max(value) - min(value) > 1e-6
    AS apart, list(value) AS vals FROM {claims} GROUP BY ALL) GROUP BY ALL"""


def _verdict(claims: str, prediction: str, guard: str = "true") -> str:
    """Verdict per prediction row against a claims table."""
    text = f"p.{prediction}"
    head = "p.ticker || '''s closing price yesterday (' || strftime(p.requested_date, '%Y-%m-%d') || ') was '"
    tail = f"substring({text}, length({head}) + 1)"
    stated = rf"""CASE WHEN regexp_full_match({text}, '{_NUMBER}') THEN CAST({text} AS DOUBLE)
      WHEN starts_with({text}, {head}) AND regexp_full_match({tail}, '{_NUMBER}\.')
      THEN CAST(rtrim({tail}, '.') AS DOUBLE) END"""
    return f"""
SELECT p.interaction_id, p.policy, p.{prediction} AS answer, coalesce(s.n_claims, 0) AS n_claims,
  coalesce(s.conflict, false) AS conflict,
  coalesce(s.n_claims, 0) > 0 AND NOT coalesce(s.conflict, false) AS sufficient,
  CASE WHEN lower({text}) = 'i don''t know.' THEN 'generator_abstained'
    WHEN s.n_claims IS NULL THEN 'missing_dated_evidence'
    WHEN {guard} AND s.conflict THEN 'unresolved_conflict'
    WHEN {stated} IS NULL THEN 'unparsed_or_unsupported_details'
    WHEN len(list_filter(s.vals, lambda v: abs(v - {stated}) <= 1e-6)) > 0
      THEN 'supported_price_field'
    ELSE 'price_mismatch' END AS verdict
FROM e_pred p LEFT JOIN ({_state(claims)}) s USING (interaction_id, policy)"""


CTES["e_before"] = _verdict("e_claim", "prediction")
CTES["e_held"] = """
SELECT * FROM e_claim UNION ALL
SELECT x.* FROM e_extra x JOIN e_before b USING (interaction_id, policy) WHERE NOT b.sufficient"""
CTES["e_loose"] = _verdict("e_held", "prediction", "false")
CTES["e_tight"] = _verdict("e_held", "prediction")
CTES["e_second"] = _verdict("e_extra", "second_prediction")

ORACLE["claim_conflicts"] = compose("""
SELECT interaction_id, policy, n_claims, conflict, sufficient FROM e_before""")
ORACLE["bounded_retry"] = compose("""
SELECT b.interaction_id, b.policy, CAST(NOT b.sufficient AS INTEGER) AS extra_calls,
  (SELECT count(*) FROM e_held h WHERE h.interaction_id = b.interaction_id
    AND h.policy = b.policy) AS claims FROM e_before b""")
ORACLE["answer_verdicts"] = compose("""
SELECT interaction_id, policy, verdict, CASE WHEN verdict = 'supported_price_field' THEN answer
  ELSE 'I don''t know.' END AS released_answer FROM e_before""")
_NAMES = (
    "generator_abstained missing_dated_evidence unresolved_conflict "
    "unparsed_or_unsupported_details price_mismatch supported_price_field"
).split()
_COUNTS = ", ".join(f"count_if(verdict = '{v}') AS {v}" for v in _NAMES)
ORACLE["reliability_replay"] = compose(f"""
SELECT variant, policy, count(*) AS requests, count_if(sufficient) AS sufficient,
  CAST(sum(extra) AS BIGINT) AS extra_calls, {_COUNTS},
  count_if(verdict <> 'supported_price_field') AS withheld
FROM (SELECT 'verify_only' AS variant, policy, sufficient, 0 AS extra, verdict FROM e_before
  UNION ALL SELECT 'retry_without_conflict_guard', l.policy, l.sufficient,
    CAST(NOT b.sufficient AS INTEGER), l.verdict
  FROM e_loose l JOIN e_before b USING (interaction_id, policy)
  UNION ALL SELECT 'retry_and_verify', t.policy, t.sufficient,
    CAST(NOT b.sufficient AS INTEGER), t.verdict
  FROM e_tight t JOIN e_before b USING (interaction_id, policy)) GROUP BY ALL""")
CTES["e_decision"] = """
SELECT interaction_id, policy, retried, before_verdict, after_verdict, final_prediction,
  CASE WHEN after_verdict = 'supported_price_field' THEN final_prediction
    ELSE 'I don''t know.' END AS released_answer,
  CASE WHEN retried THEN CAST(input_tokens + 20 + 96 AS INTEGER) END AS round_reserved_tokens,
  CASE WHEN retried THEN CAST(2 * input_tokens + 20 + 192 AS INTEGER) END
    AS combined_reserved_tokens
FROM (SELECT b.interaction_id, b.policy, NOT b.sufficient AS retried,
    b.verdict AS before_verdict,
    CASE WHEN b.sufficient THEN b.verdict ELSE s.verdict END AS after_verdict,
    CASE WHEN b.sufficient THEN b.answer ELSE s.answer END AS final_prediction, p.input_tokens
  FROM e_before b JOIN e_second s USING (interaction_id, policy)
  JOIN e_pred p USING (interaction_id, policy))"""
ORACLE["retry_decisions"] = compose("""
SELECT * REPLACE (coalesce(round_reserved_tokens, 0) AS round_reserved_tokens,
  coalesce(combined_reserved_tokens, 0) AS combined_reserved_tokens) FROM e_decision""")
ORACLE["retry_summary"] = compose("""
SELECT policy, count(*) AS requests, count_if(retried) AS retries,
  count_if(before_verdict = 'supported_price_field') AS supported_before,
  count_if(after_verdict = 'supported_price_field') AS supported_after,
  count_if(before_verdict = 'missing_dated_evidence') AS missing_before,
  count_if(after_verdict = 'missing_dated_evidence') AS missing_after,
  count_if(after_verdict = 'unresolved_conflict') AS conflict_after,
  coalesce(max(combined_reserved_tokens), 0) AS maximum_combined_reserved_tokens
FROM e_decision GROUP BY policy""")
CTES["e_extra_retry"] = """
SELECT interaction_id FROM e_decision
WHERE policy = 'all_available' AND NOT retried AND length(interaction_id) % 2 = 0"""
ORACLE["retry_audit"] = compose("""
SELECT interaction_id || '/adaptive' AS location, 'combined_reserved_tokens_differs' AS rule,
  'combined_reserved_tokens' AS detail FROM e_decision WHERE policy = 'adaptive' AND retried
UNION ALL SELECT interaction_id || '/adaptive', 'request_over_cap',
  CAST(combined_reserved_tokens + 4000 AS VARCHAR) FROM e_decision
WHERE policy = 'adaptive' AND retried AND combined_reserved_tokens + 4000 > 4096
UNION ALL SELECT interaction_id || '/' || policy, 'released_answer_differs', 'released_answer'
FROM e_decision WHERE after_verdict = 'supported_price_field'
UNION ALL SELECT interaction_id || '/all_available', r.rule, r.detail FROM e_extra_retry,
  (VALUES ('retried_differs', 'retried'), ('round_over_cap', 'none'), ('request_over_cap', 'none')) r(rule, detail)
UNION ALL SELECT 'run', 'too_many_calls', CAST(count(*) + (SELECT count(*) + count_if(retried) FROM e_decision) AS VARCHAR)
FROM e_extra_retry HAVING count(*) > 0""")


def _outcome(text: str, *answers: str) -> str:
    hit = " OR ".join(f"lower({text}) = lower({a})" for a in answers)
    return f"""CASE WHEN lower({text}) IN ('i don''t know', 'i don''t know.', 'i do not know',
    'i do not know.') THEN 'abstained' WHEN {hit} THEN 'exact_agreement'
    ELSE 'needs_semantic_review' END"""


_CLOSE = "coalesce(CAST(p.close AS VARCHAR), '0.5')"
ORACLE["latest_round"] = compose(f"""
SELECT d.interaction_id, d.policy, d.final_prediction AS prediction,
  CAST(CASE WHEN d.retried THEN p.input_tokens + 20 ELSE p.input_tokens END AS INTEGER)
    AS input_tokens, CASE WHEN d.retried THEN 2 ELSE 1 END AS regeneration_round,
  {_outcome('d.final_prediction', _CLOSE)} AS outcome
FROM e_decision d JOIN e_pred p USING (interaction_id, policy)""")
ORACLE["control_comparison"] = compose("""
SELECT count(*) AS pairs, count_if(prediction = 'I don''t know.') AS only_first,
  0::BIGINT AS only_second, count_if(prediction <> 'I don''t know.') AS same_prompt,
  count_if(prediction <> 'I don''t know.' AND NOT starts_with(prediction, 'about'))
    AS same_prediction FROM e_pred""")
ORACLE["claim_violations"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS location, 'price_not_finite' AS rule, 'value' AS detail
FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'date_not_iso', '2024-13-01'
FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'ticker_missing', 'ticker'
FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'provenance_missing', 'source_ref'
FROM orders WHERE o_orderkey % 13 = 0"""

# ---- metrics and reviews of predictions --------------------------------------------------

CTES["e_eval"] = f"""
SELECT p.*, lower(prediction) IN (lower({_CLOSE}), lower('about ' || {_CLOSE})) AS exact,
  lower(prediction) = 'i don''t know.' AS abstained,
  {_outcome('prediction', _CLOSE, f"'about ' || {_CLOSE}")} AS outcome FROM e_pred p"""
ORACLE["literal_evaluation"] = compose("""
SELECT interaction_id, policy, exact AS exact_agreement, abstained, outcome FROM e_eval""")
ORACLE["numeric_diagnostic"] = compose(rf"""
SELECT interaction_id, policy, regexp_full_match(prediction, '{_NUMBER}') AS pure_numeric,
  coalesce(regexp_full_match(prediction, '{_NUMBER}')
    AND abs(TRY_CAST(prediction AS DOUBLE) - close) <= 1e-6, false) AS matches_price_field
FROM e_pred""")
ORACLE["generation_summary"] = compose("""
SELECT policy, count(*) AS questions, count_if(outcome = 'abstained') AS abstained,
  count_if(outcome = 'exact_agreement') AS exact_agreement,
  count_if(outcome = 'needs_semantic_review') AS needs_semantic_review,
  round(avg(CAST(exact AS INTEGER)), 6) AS exact_agreement_rate,
  round(avg(CAST(abstained AS INTEGER)), 6) AS abstention_rate,
  round(avg(input_tokens), 6) AS mean_input_tokens,
  round(avg(output_tokens), 6) AS mean_output_tokens,
  CAST(max(input_tokens + output_tokens) AS INTEGER) AS maximum_total_tokens,
  round(avg(generation_seconds), 6) AS mean_generation_seconds,
  round(avg(retrieval_seconds), 6) AS mean_retrieval_seconds FROM e_eval GROUP BY policy""")
ORACLE["policy_agreement"] = compose("""
SELECT count(*) AS questions, count_if(a = 1) AS identical_prompts,
  count_if(b = 1) AS identical_predictions
FROM (SELECT count(DISTINCT prompt_sha256) AS a, count(DISTINCT prediction) AS b
  FROM e_pred GROUP BY interaction_id)""")
CTES["e_review"] = """
SELECT *, CASE WHEN decision = 'abstained' THEN 'not_applicable' WHEN event_id % 11 = 0
  THEN 'pending' ELSE 'supported' END AS support
FROM (SELECT *, CASE WHEN outcome = 'abstained' AND event_id % 10 <> 0 THEN 'abstained'
    WHEN event_id % 5 = 0 THEN 'pending' WHEN event_id % 5 = 1 THEN 'correct'
    WHEN event_id % 5 = 2 THEN 'incorrect' WHEN event_id % 35 = 3 THEN 'invented'
    ELSE 'uncertain' END AS decision
  FROM e_eval WHERE event_id % 13 <> 0 OR policy = 'adaptive')"""
CTES["e_bound"] = """
SELECT e.policy, count(*) AS predictions, count(r.decision) AS review_records,
  count_if(r.decision = 'correct') AS correct, count_if(r.decision = 'incorrect') AS incorrect,
  count_if(r.decision = 'abstained') AS abstained,
  count_if(r.decision IS NULL OR r.decision IN ('pending', 'uncertain')) AS unresolved,
  count_if(r.support = 'supported') AS supported
FROM e_eval e LEFT JOIN e_review r USING (interaction_id, policy) GROUP BY e.policy"""
ORACLE["review_bounds"] = compose("""
SELECT *, round(correct / predictions, 6) AS lower_bound,
  round((correct + unresolved) / predictions, 6) AS upper_bound FROM e_bound""")
ORACLE["review_completeness"] = compose("""
SELECT CAST(sum(predictions) AS BIGINT) AS subjects,
  CAST(sum(review_records) AS BIGINT) AS reviewed, CAST(sum(unresolved) AS BIGINT) AS unresolved,
  sum(predictions) = sum(review_records) AS full_coverage, sum(unresolved) = 0 AS all_resolved
FROM e_bound""")
ORACLE["review_histogram"] = compose("""
SELECT 'decision' AS field, decision AS value, count(*) AS n FROM e_review GROUP BY ALL
UNION ALL SELECT 'support', support, count(*) FROM e_review GROUP BY ALL""")
_RULES = {
    "prediction_differs": "event_id % 17 = 0 AND prediction <> 'changed'",
    "decision_unknown": "decision = 'invented'",
    "notes_missing": "event_id % 23 = 0",
    "decided_without_attestation": "decision <> 'pending' AND (event_id % 19 = 0 OR support = 'pending')",
    "abstention_contradicts": "decision <> 'pending' AND (decision = 'abstained') <> (outcome = 'abstained')",
}
ORACLE["generated_review_violations"] = compose(
    "\nUNION ALL ".join(
        f"SELECT interaction_id || '/' || policy AS location, '{rule}' AS rule FROM e_review WHERE {test}"
        for rule, test in _RULES.items()
    )
)
ORACLE["outcome_scores"] = """
SELECT lang, count(*) AS total, count_if(quality = 1) AS n_correct,
  count_if(quality = 1 AND toxic = 0) AS n_correct_exact,
  count_if(quality = 0 AND toxic = 0) AS n_miss,
  round((2 * count_if(quality = 1) + count_if(quality = 0 AND toxic = 0)) / count(*) - 1, 6)
    AS score,
  round(count_if(quality = 1 AND toxic = 0) / count(*), 6) AS exact_accuracy,
  round(count_if(quality = 1) / count(*), 6) AS accuracy,
  round(count_if(quality = 0 AND toxic = 1) / count(*), 6) AS hallucination,
  round(count_if(quality = 0 AND toxic = 0) / count(*), 6) AS missing
FROM labels JOIN documents USING (doc_id) GROUP BY lang"""
ORACLE["outcome_violations"] = """
SELECT CAST(doc_id AS VARCHAR) AS location, 'outcome_not_evaluated' AS rule, 'pending' AS detail
FROM labels JOIN documents USING (doc_id) WHERE lang <> 'en'"""
