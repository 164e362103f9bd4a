"""SQL equivalents: record rules, artifacts, sampling, reviews and prepared requests."""

from __future__ import annotations

from .base import CTES, RECURSIVE, WS, _bm25, _chunks, compose, fold, walk, words
from .routing import EVIDENCE_ID, prompt

ORACLE: dict[str, str] = {}

ORACLE["record_violations"] = """
SELECT CAST(d.doc_id AS VARCHAR) AS location, k.rule, k.detail
FROM documents d JOIN (VALUES (1, 'blank_row', 'blank'), (2, 'invalid_json', 'not JSON'),
  (3, 'answer_not_scalar', 'answer'), (4, 'answer_not_scalar', 'answer'),
  (5, 'alternates_not_list', 'alt_ans'), (6, 'page_field_not_text', 'page_snippet'),
  (7, 'required_text', 'query'), (8, 'required_text', 'domain'),
  (9, 'pages_not_list', 'search_results'), (10, 'alternate_not_scalar', 'alt_ans'),
  (11, 'not_an_object', 'array')) k(kind, rule, detail) ON k.kind = d.doc_id % 12"""
ORACLE["repeated_keys"] = """
SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last
FROM documents GROUP BY text HAVING count(*) > 1"""
ORACLE["answer_views"] = """
SELECT 'd' || doc_id AS interaction_id, CASE
  WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN n_chars || '|' || lang
  WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR)
  WHEN doc_id % 3 = 0 THEN source || '|' || n_chars || '|' || lang
  ELSE source END AS answers FROM documents"""
ORACLE["inference_views"] = """
SELECT 'd' || doc_id AS interaction_id, source || ' ' || lang AS query,
  '03/05/2024, 23:18:31 PT' AS query_time, 0 AS page_index, source AS page_name,
  sha256(text) AS page_sha256, CAST(length(substring(text, 1, 200)) AS INTEGER) AS snippet_chars
FROM documents"""
ORACLE["dataset_profile"] = f"""
WITH n AS (SELECT count(*) AS a, count_if(doc_id % 3 = 0) AS c, count_if(doc_id % 4 <> 0) AS s,
  count_if(doc_id % 2 = 0) AS e,
  count_if(NOT regexp_matches(text, '[^{WS}]')) AS blank FROM documents)
SELECT 'domain' AS section, lang AS key, count(*) AS n FROM documents GROUP BY ALL
UNION ALL
SELECT x.section, x.key, x.n FROM n, LATERAL (VALUES
  ('total', 'rows', a), ('total', 'web_pages', a), ('total', 'empty_web_pages', blank),
  ('total', 'numeric_alternate_answers', c), ('question_type', 'simple', a),
  ('static_or_dynamic', 'static', a), ('split', '1', s), ('split', 'absent', a - s),
  ('web_pages_per_query', '1', a), ('answer_types', 'int', e), ('answer_types', 'string', a - e),
  ('alternate_answer_types', 'int', c), ('alternate_answer_types', 'string', 2 * c),
  ('row_fields', 'interaction_id', a), ('row_fields', 'query', a), ('row_fields', 'query_time', a),
  ('row_fields', 'domain', a), ('row_fields', 'question_type', a),
  ('row_fields', 'static_or_dynamic', a), ('row_fields', 'answer', a),
  ('row_fields', 'search_results', a), ('row_fields', 'alt_ans', c), ('row_fields', 'split', s),
  ('optional_field_counts', 'kg_info', 0), ('optional_field_counts', 'kg_infos', 0),
  ('optional_field_counts', 'api_results', 0), ('optional_field_counts', 'supporting_facts', 0),
  ('optional_field_counts', 'evidence_ids', 0)) x(section, key, n)"""
ORACLE["asset_violations"] = """
WITH m AS (SELECT page_id % 9 AS k, length(html) AS bytes, CASE page_id % 9
  WHEN 0 THEN '../out/' || page_id WHEN 1 THEN 'data/x/../../up/' || page_id
  WHEN 2 THEN '/abs/' || page_id WHEN 3 THEN 'data/shared/' || (page_id % 5)
  WHEN 4 THEN 'a/../../b/' || page_id ELSE 'data/' || page_id END AS local_path FROM pages)
SELECT 'manifest' AS location, 'budget_exceeded' AS rule, CAST(sum(bytes) AS VARCHAR) AS detail
FROM m HAVING sum(bytes) > 1000
UNION ALL SELECT local_path, 'repeated_destination', CAST(count(*) AS VARCHAR) FROM m
GROUP BY local_path HAVING count(*) > 1
UNION ALL SELECT local_path, 'destination_escapes_root', local_path FROM m WHERE k IN (0, 2, 4)"""
_WORDS = ", ".join(
    f"CAST(sum(CAST('0x' || substring(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)
)
ORACLE["run_fingerprint"] = f"""
SELECT count(*) AS rows, sha256(concat_ws('-', {_WORDS})) AS fingerprint
FROM (SELECT sha256(concat_ws(chr(0), CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR),
  event_type, props)) AS h FROM events)"""
ORACLE["file_checksums"] = """
WITH d AS (SELECT doc_id, CAST(doc_id % 64 AS VARCHAR) AS name, doc_id % 97 = 5 AS longer,
  doc_id % 97 <> 5 AND doc_id % 89 = 3 AND reverse(text) <> text AS turned FROM documents)
SELECT name AS location, 'size_differs' AS rule FROM d GROUP BY name HAVING bool_or(longer)
UNION ALL SELECT name, 'sha256_differs' FROM d GROUP BY name HAVING bool_or(longer OR turned)
UNION ALL SELECT '64', 'file_missing' FROM d WHERE doc_id % 1000 = 0 HAVING count(*) > 0"""
ORACLE["run_manifest"] = f"""
SELECT sha256('{{"limit": null}}') AS config_sha256, rows AS trace_rows, fingerprint AS trace_fingerprint,
  (SELECT sha256(concat_ws('-', {_WORDS})) FROM (SELECT sha256(concat_ws(chr(0), CAST(event_id AS VARCHAR),
    CAST(user_id AS VARCHAR))) AS h FROM events)) AS order_fingerprint,
  (SELECT count(DISTINCT user_id) FROM events) AS sources
FROM ({ORACLE["run_fingerprint"]})"""

# ---- sampling ---------------------------------------------------------------------------

_SEED = "disjoint-sample-v1"
ORACLE["exposure_ledger"] = """
SELECT conv_id || '-' || turn AS interaction_id FROM conversations
UNION SELECT 'i' || conv_id FROM conversations
UNION SELECT 'k' || role FROM conversations UNION SELECT 'z' || role FROM conversations"""
ORACLE["shuffle_order"] = f"""
SELECT 'd' || doc_id AS interaction_id, sha256('{_SEED}' || chr(0) || 'd' || doc_id) AS position
FROM documents"""
CTES["sam"] = rf"""
SELECT row_number() OVER (ORDER BY position) AS rn, * FROM (
  SELECT 'd' || d.doc_id AS interaction_id, d.text AS query,
    sha256('{_SEED}' || chr(0) || 'd' || d.doc_id) AS position,
    array_to_string(regexp_extract_all({fold('d.text')}, '[\p{{L}}\p{{N}}_]+'), ' ') AS txt,
    regexp_replace(regexp_replace(regexp_replace(lower(split_part(d.url, '#', 1)),
      '^https?://', ''), '^www\.', ''), '/+($|\?)', '\1') AS url,
    coalesce(l.toxic, 0) = 1 AS prior, regexp_matches(d.text, '[^{WS}]') AS has_text
  FROM doc_page d LEFT JOIN labels l USING (doc_id))"""
CTES["sam_old"] = """
SELECT list(DISTINCT txt) AS txts, list(DISTINCT url) AS urls FROM sam WHERE prior"""
RECURSIVE.add("sam_scan")
_STEP = """CASE WHEN r.prior THEN 'prior_question'
    WHEN list_contains({t}, r.txt) THEN 'duplicate_question_text'
    WHEN list_contains({u}, r.url) THEN 'shared_source_page'
    WHEN NOT r.has_text THEN 'empty_source_text' ELSE 'chosen' END"""
CTES["sam_scan"] = f"""
  SELECT 0::BIGINT AS rn, ''::VARCHAR AS interaction_id, ''::VARCHAR AS position,
    ''::VARCHAR AS outcome, coalesce(txts, []) AS txts, coalesce(urls, []) AS urls,
    0::BIGINT AS n FROM sam_old
  UNION ALL
  SELECT rn, interaction_id, position, outcome,
    CASE WHEN outcome = 'chosen' THEN list_append(txts, txt) ELSE txts END,
    CASE WHEN outcome = 'chosen' THEN list_append(urls, url) ELSE urls END,
    n + CAST(outcome = 'chosen' AS BIGINT)
  FROM (SELECT r.rn, r.interaction_id, r.position, r.txt, r.url, s.txts, s.urls, s.n,
      {_STEP.format(t='s.txts', u='s.urls')} AS outcome
    FROM sam_scan s JOIN sam r ON r.rn = s.rn + 1
    WHERE s.n < (SELECT greatest(1, count(*) // 4) FROM pages))"""
ORACLE["disjoint_sample"] = compose(
    "SELECT interaction_id, position, outcome FROM sam_scan WHERE rn > 0"
)
ORACLE["sample_rejections"] = compose("""
SELECT outcome AS reason, count(*) AS n FROM sam_scan WHERE rn > 0 AND outcome <> 'chosen'
GROUP BY ALL""")
CTES["d_query"] = """
SELECT s.interaction_id, s.query FROM sam s JOIN sam_scan c USING (interaction_id)
WHERE c.outcome = 'chosen'"""
CTES["d_page"] = """
SELECT interaction_id, 0::INTEGER AS page_index, '' AS page_name, '' AS page_url,
  '' AS page_last_modified, query AS page_result, '' AS page_snippet,
  (SELECT p.url FROM doc_page p WHERE 'd' || p.doc_id = interaction_id) AS url FROM d_query"""
_chunks("d", 120)
_bm25("d", 120)
CTES["d_kind"] = """
SELECT interaction_id, CAST(substring(interaction_id, 2) AS BIGINT) % 6 AS k FROM d_query"""
CTES["d_leaf"] = """
SELECT interaction_id, 'question' AS part, '' AS place,
  sha256(concat_ws(chr(0), '+' || interaction_id, '+' || query, '+')) AS digest FROM d_query
UNION ALL SELECT interaction_id, 'page', '0', sha256(concat_ws(chr(0), '+' || interaction_id, '+0', '+', '+' || url, '+',
  '+' || page_result, '+')) FROM d_page
UNION ALL SELECT interaction_id, 'candidate', CAST(rank AS VARCHAR), sha256(concat_ws(chr(0), '+' || interaction_id,
  '+' || rank, '+' || evidence_id, '+' || page_index, '+' || field, '+' || char_start, '+' || char_end, '+' || content,
  '+' || word_count)) FROM d_bm_120_rank WHERE rank <= 12"""
ORACLE["evaluation_packet"] = compose(f"""
SELECT interaction_id, 1 AS pages, candidates, leaves, root, evidence
FROM (SELECT interaction_id, count(*) AS candidates, string_agg(evidence_id, ',' ORDER BY rank) AS evidence
  FROM d_bm_120_rank WHERE rank <= 12 GROUP BY interaction_id)
JOIN (SELECT interaction_id, count(*) AS leaves, sha256(concat_ws('-', CAST(count(*) AS VARCHAR), {_WORDS})) AS root
  FROM (SELECT interaction_id, sha256(concat_ws(chr(0), part, place, digest)) AS h FROM d_leaf) GROUP BY interaction_id)
USING (interaction_id)""")
ORACLE["packet_violations"] = compose("""
SELECT interaction_id || '/question' AS location, CASE k WHEN 0 THEN 'question_changed' ELSE 'question_missing' END AS rule
FROM d_kind WHERE k IN (0, 3)
UNION ALL SELECT interaction_id || '/page/0', CASE k WHEN 1 THEN 'page_changed' ELSE 'page_missing' END FROM d_kind WHERE k IN (1, 4)
UNION ALL SELECT interaction_id || '/candidate/' || p.place, CASE WHEN c.many > 1 THEN 'candidate_changed'
  WHEN p.place = 1 THEN 'candidate_missing' ELSE 'candidate_unexpected' END
FROM d_kind JOIN (SELECT interaction_id, count(*) AS many FROM d_bm_120_rank GROUP BY 1) c USING (interaction_id),
  (VALUES (1), (2)) p(place) WHERE k = 2
UNION ALL SELECT DISTINCT 'ledger/d' || doc_id || CASE doc_id % 4 WHEN 0 THEN '' ELSE 'x' END,
  CASE doc_id % 4 WHEN 0 THEN 'ledger_missing' ELSE 'ledger_unexpected' END FROM labels WHERE toxic = 1 AND doc_id % 4 IN (0, 1)""")

# ---- reviews ----------------------------------------------------------------------------

ORACLE["decision_violations"] = """
SELECT 'c' || conv_id AS location, k.rule
FROM (SELECT DISTINCT conv_id FROM conversations) c
JOIN (VALUES (0, 'reviewed_unresolved'), (1, 'set_invalid'), (2, 'set_invalid'),
  (3, 'set_repeated'), (4, 'sets_contradict_answerability'), (5, 'packet_differs'),
  (6, 'status_unknown'), (7, 'reviewed_unresolved')) k(kind, rule) ON k.kind = c.conv_id % 8"""
ORACLE["draft_review_violations"] = """
WITH d AS (SELECT doc_id, 'd' || doc_id AS id, doc_id % 13 AS n, length(text) AS size, text
  FROM documents),
both_refs AS (SELECT d.*, r.pos FROM d, (VALUES (0), (1)) r(pos))
SELECT id || '/' || pos AS location, 'page_out_of_range' AS rule FROM both_refs WHERE n = 1
UNION ALL SELECT id || '/' || pos, 'field_unsupported' FROM both_refs WHERE n = 2
UNION ALL SELECT id || '/' || pos, 'source_url_differs' FROM both_refs WHERE n = 3
UNION ALL SELECT id || '/1', 'span_out_of_range' FROM d WHERE n = 4
UNION ALL SELECT id || '/1', 'quote_differs' FROM d WHERE n = 5
UNION ALL SELECT id, 'status_unknown' FROM d WHERE n = 6
UNION ALL SELECT id, 'validation_flag_contradicts' FROM d WHERE n IN (6, 7)
UNION ALL SELECT id, 'notes_missing' FROM d WHERE n = 8
UNION ALL SELECT id, 'reviewed_without_attestation' FROM d WHERE n = 9
UNION ALL SELECT id, 'inspection_shape' FROM d WHERE n = 10
UNION ALL SELECT id, 'draft_identity_differs' FROM d WHERE n = 11
UNION ALL SELECT id, 'draft_status_changed' FROM d WHERE n = 12"""

# ---- requests ---------------------------------------------------------------------------

CTES["u_plan"] = f"""
SELECT q.interaction_id, q.query, q.query_time, p.policy, 512 - 96 - empty AS budget, empty,
  CASE WHEN priced THEN (512 - 96 - empty + 1) // 2 ELSE 0 END AS api_budget,
  CASE WHEN priced THEN (512 - 96 - empty) // 2 ELSE 512 - 96 - empty END AS web_budget, priced
FROM (SELECT q.*, p.policy, {words(prompt("''"))} AS empty,
    q.interaction_id IN (SELECT interaction_id FROM u_evidence) AND (p.policy = 'all_available'
      OR (p.policy = 'adaptive' AND q.interaction_id IN
        (SELECT interaction_id FROM u_hint WHERE name = 'finance_prices'))) AS priced
  FROM u_query q CROSS JOIN (VALUES ('fixed_web'), ('all_available'), ('adaptive')) p(policy)) q,
  LATERAL (SELECT q.policy) p(policy)"""
CTES["u_item"] = f"""
SELECT *, {words("'[' || evidence_id || '] ' || kind || ' ' || ref || chr(10) || content")} AS n
FROM (SELECT interaction_id, evidence_id, content, 'web' AS kind, page_url AS ref,
    score / coalesce(nullif(max(score) OVER (PARTITION BY interaction_id), 0), 1) AS relevance
  FROM u_bm_120_rank WHERE rank <= 12
  UNION ALL SELECT interaction_id, {EVIDENCE_ID}, content, 'api', source_ref, 1.0::DOUBLE
  FROM u_evidence)"""
CTES["u_turn"] = """
SELECT p.interaction_id, p.policy, p.web_budget, p.api_budget, i.evidence_id, i.kind, i.n,
  row_number() OVER (PARTITION BY p.interaction_id, p.policy
    ORDER BY round(i.relevance, 9) DESC, i.n, i.evidence_id) AS rn
FROM u_plan p JOIN u_item i USING (interaction_id) WHERE i.kind = 'web' OR p.priced"""
RECURSIVE.add("u_walk")
CTES["u_walk"] = """
  SELECT interaction_id, policy, 0::BIGINT AS rn, 0::BIGINT AS web, 0::BIGINT AS api,
    []::VARCHAR[] AS taken FROM u_plan
  UNION ALL
  SELECT interaction_id, policy, rn,
    web + CASE WHEN fits AND kind = 'web' THEN n ELSE 0 END,
    api + CASE WHEN fits AND kind = 'api' THEN n ELSE 0 END,
    CASE WHEN fits THEN list_append(taken, evidence_id) ELSE taken END
  FROM (SELECT w.interaction_id, w.policy, t.rn, w.web, w.api, w.taken, t.kind, t.n,
      t.evidence_id, len(w.taken) < 5 AND CASE t.kind WHEN 'web' THEN w.web + t.n <= t.web_budget
        ELSE w.api + t.n <= t.api_budget END AS fits
    FROM u_walk w JOIN u_turn t ON t.interaction_id = w.interaction_id AND t.policy = w.policy
      AND t.rn = w.rn + 1)"""
CTES["u_done"] = """
SELECT interaction_id, policy, list_sort(taken) AS taken FROM u_walk
QUALIFY row_number() OVER (PARTITION BY interaction_id, policy ORDER BY rn DESC) = 1"""
CTES["u_request_text"] = f"""
SELECT *, {prompt('context')} AS prompt FROM (
  SELECT p.*, array_to_string(d.taken, ',') AS selected, coalesce((SELECT string_agg('[' ||
      i.evidence_id || '] ' || i.kind || ' ' || i.ref || chr(10) || i.content,
      chr(10) || chr(10) ORDER BY i.evidence_id) FROM u_item i
    WHERE i.interaction_id = p.interaction_id AND list_contains(d.taken, i.evidence_id)), '')
    AS context,
    coalesce((SELECT string_agg(t.evidence_id, ',' ORDER BY t.evidence_id) FROM u_turn t
      WHERE t.interaction_id = p.interaction_id AND t.policy = p.policy), '') AS candidate_ids
  FROM u_plan p JOIN u_done d USING (interaction_id, policy))"""
ORACLE["prepared_requests"] = compose(f"""
SELECT interaction_id, policy, CASE WHEN priced THEN 'finance_prices:' || api_budget || ','
    ELSE '' END || 'web:' || web_budget AS allocations, candidate_ids, selected,
  sha256(prompt) AS prompt_sha256, CAST({words('prompt')} AS INTEGER) AS input_tokens,
  1 AS web_calls, CAST(priced AS INTEGER) AS finance_calls FROM u_request_text""")
ORACLE["preflight"] = compose(f"""
SELECT policy, count(*) AS requests, CAST(max({words('prompt')} + 96) AS INTEGER)
    AS maximum_request_tokens, count_if({words('prompt')} + 96 > 512) AS over_budget,
  count(*) AS web_calls, count_if(priced) AS finance_calls FROM u_request_text GROUP BY policy""")
CTES["u_run"] = f"""
SELECT r.*, {words('answer')} AS output_tokens, {words('prompt')} AS input_tokens,
  lower(answer) IN (close, 'about ' || close) AS exact
FROM (SELECT t.*, coalesce(CAST(e.close AS VARCHAR), '0.5') AS close,
    coalesce(CASE CAST(substring(t.interaction_id, 2) AS BIGINT) % 6
      WHEN 0 THEN coalesce(CAST(e.close AS VARCHAR), '0.5') WHEN 1 THEN CAST(CAST(round(e.close) AS BIGINT) AS VARCHAR)
      WHEN 2 THEN '$' || coalesce(CAST(e.close AS VARCHAR), '0.5')
      WHEN 3 THEN e.ticker || chr(39) || 's closing price yesterday (' || strftime(e.requested_date, '%Y-%m-%d')
        || ') was ' || CAST(e.close AS VARCHAR) || '.'
      WHEN 4 THEN 'I don' || chr(39) || 't know.' ELSE 'about ' || coalesce(CAST(e.close AS VARCHAR), '0.5') END, 'unknown') AS answer
  FROM u_request_text t LEFT JOIN u_evidence e USING (interaction_id)) r"""
ORACLE["generated_audit"] = compose("""
SELECT interaction_id || '/fixed_web' AS location, r.rule, r.detail FROM u_query,
  (VALUES ('prompt_sha256_differs', 'prompt_sha256'), ('generation_seconds_invalid', 'seconds'))
  r(rule, detail)
UNION ALL SELECT interaction_id || '/adaptive', 'output_too_long', '500' FROM u_query
UNION ALL SELECT interaction_id || '/all_available', 'evaluation_differs', 'evaluation' FROM u_run
WHERE policy = 'all_available' AND exact
UNION ALL SELECT 'fixed_web', 'mean_generation_seconds_differs', 'mean_generation_seconds'
UNION ALL SELECT 'adaptive', 'mean_output_tokens_differs', 'mean_output_tokens'
UNION ALL SELECT 'adaptive', 'maximum_total_tokens_differs', 'maximum_total_tokens'
UNION ALL SELECT 'all_available', 'exact_agreement_rate_differs', 'exact_agreement_rate'
FROM u_run WHERE policy = 'all_available' HAVING bool_or(exact)""")


def _matrix(audit: str, source: str, location: str, damage: list[tuple[str, str]]) -> str:
    """Damaged rows by share of the location's hash; every one of them has to be caught."""
    drawn = f"CAST('0x' || substring(sha256({location}), 1, 8) AS BIGINT) % {len(damage) + 1}"
    chosen = " ".join(f"WHEN {k} THEN CASE WHEN {able} THEN {k} END" for k, (_, able) in enumerate(damage))
    names = ", ".join(f"({k}, '{name}')" for k, (name, _) in enumerate(damage))
    return f"""
SELECT '{audit}' AS audit, coalesce(m.name, 'sound') AS mutation, count(*) AS damaged, count(m.name) AS caught,
  0::BIGINT AS strayed
FROM (SELECT CASE {drawn} {chosen} END AS nth FROM {source}) r LEFT JOIN (VALUES {names}) m(nth, name) ON m.nth = r.nth
GROUP BY m.name"""


_AT = "interaction_id || '/' || policy"
_TWICE = ("row:repeat:repeated_row", "true")
_GONE = ("row:drop:row_missing", "true")
_VERDICTS = ("before_verdict", "after_verdict", "final_prediction", "released_answer")
_PARTS = [
    _matrix("routing", "e_plan", _AT, [
        ("reserved_tokens:change:budget_not_conserved", "true"), ("allocations:change:budget_not_spent", "n > 0"),
        ("allocations:change:source_not_eligible", "n > 0 AND policy = 'all_available'"),
        ("max_source_calls:change:call_count_differs", "true"),
        ("blocked_hints:change:block_reason_differs", "blocked_hints <> ''"),
        ("execution_status:change:already_executed", "true"), ("row:drop:plan_missing", "true"), _TWICE,
    ]),
    _matrix("generated", "u_run", _AT, [
        ("prompt_sha256:change:prompt_sha256_differs", "true"),
        ("candidate_ids:change:candidate_ids_differs", "candidate_ids <> ''"),
        ("allocations:change:allocations_differs", "true"), ("evaluation:change:evaluation_differs", "true"),
        ("input_tokens:change:input_tokens_differs", "true"), ("output_tokens:change:output_too_long", "true"),
        ("generation_seconds:change:generation_seconds_invalid", "true"),
        ("retrieval_seconds:change:retrieval_seconds_invalid", "true"), _GONE, _TWICE,
    ]),
    _matrix("retry", "e_decision", _AT, [
        ("retried:change:retried_differs", "retried"), *[(f"{f}:change:{f}_differs", "true") for f in _VERDICTS],
        ("combined_reserved_tokens:change:combined_reserved_tokens_differs", "retried"), _GONE, _TWICE,
    ]),
    _matrix("spans", "(SELECT interaction_id, unnest(taken) AS evidence_id FROM walk_end)",
        "interaction_id || '/' || evidence_id", [
        ("page_index:change:page_unknown", "true"), ("source_url:change:source_url_differs", "true"),
        ("char_end:change:span_differs", "true"), ("word_count:change:word_count_differs", "true"),
    ]),
]
ORACLE["mutation_matrix"] = compose(" UNION ALL ".join(_PARTS), walk("q_bm_50_rank", ("interaction_id",), 5, 170))
