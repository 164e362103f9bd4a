"""SQL equivalents: text functions, hints, gates, plans and price lookups."""

from __future__ import annotations

from .base import CTES, STOP, compose, strip, terms, words

ORACLE: dict[str, str] = {}
_STOP = ", ".join(f"'{w}'" for w in STOP)

ORACLE["term_totals"] = f"""
SELECT doc_id, len(t) AS terms, len(list_distinct(t)) AS distinct_terms,
  sha256(array_to_string(t, ' ')) AS question_key_sha256
FROM (SELECT doc_id, {terms('text')} AS t FROM documents)"""

ORACLE["query_requirements"] = f"""
SELECT conv_id, turn, CASE WHEN len(r) = 0 THEN '__no_terms__' ELSE array_to_string(r, ' ') END
  AS requirements
FROM (SELECT conv_id, turn, list_sort(list_filter(list_distinct({terms('text')}),
  lambda t: NOT list_contains([{_STOP}], t))) AS r FROM conversations)"""

ORACLE["canonical_urls"] = rf"""
WITH raw AS (
  SELECT page_id, trim(CASE page_id % 8
    WHEN 1 THEN '  HTTPS://user:pw@WWW.' || regexp_replace(url, '^https?://', '') || ' '
    WHEN 2 THEN 'ftp://' || regexp_replace(url, '^https?://', '')
    WHEN 3 THEN url || '//'
    WHEN 4 THEN regexp_replace(url, '(example\.[a-z]+)', '\1:8080')
    WHEN 5 THEN 'http://' WHEN 6 THEN url || '?' ELSE url END) AS u FROM pages),
cut AS (SELECT page_id, regexp_matches(u, '^(?i)https?://') AS web,
  split_part(regexp_replace(u, '^(?i)https?://', ''), '#', 1) AS rest FROM raw),
part AS (SELECT page_id, web, regexp_extract(rest, '^[^/?]*') AS auth, rest FROM cut),
piece AS (SELECT page_id, web,
  regexp_replace(lower(regexp_extract(regexp_replace(auth, '^.*@', ''), '^[^:]*')),
    '^www\.', '') AS host,
  rtrim(regexp_extract(substring(rest, length(auth) + 1), '^[^?]*'), '/') AS path,
  regexp_extract(rest, '\?(.*)$', 1) AS query FROM part)
SELECT page_id, CASE WHEN web AND host <> '' THEN
  host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical_url
FROM piece"""

ORACLE["query_dates"] = compose("""
SELECT interaction_id, strftime(date, '%Y-%m-%d') AS asked,
  strftime(date - 1, '%Y-%m-%d') AS previous_day FROM e_query""")

ORACLE["policy_rotation"] = compose("""
SELECT interaction_id, CASE event_id % 3 WHEN 0 THEN 'fixed_web,all_available,adaptive'
  WHEN 1 THEN 'all_available,adaptive,fixed_web' ELSE 'adaptive,fixed_web,all_available' END
  AS "order" FROM e_query""")


def prompt(context: str) -> str:
    nl = "chr(10)"
    return (
        f"'system' || {nl} || 'Answer only from the evidence.' || {nl} || 'user' || {nl} || "
        f"'Question timestamp: ' || query_time || {nl} || 'Question: ' || query || {nl} || "
        f"'<evidence>' || {nl} || {context} || {nl} || '</evidence>' || {nl} || 'Answer:'"
    )


ORACLE["prompts"] = compose(f"""
SELECT interaction_id, sha256({prompt("''")}) AS prompt_sha256,
  CAST({words(prompt("''"))} AS INTEGER) AS words FROM e_query""")

CTES["hint_pattern"] = r"""
SELECT * FROM (VALUES
  ('finance_market_cap', '\bmarket cap(?:italization)?s?\b'),
  ('finance_ticker', '\bticker\b'),
  ('finance_prices', '\b(?:stock price|share price|best performer|daily moves|price change)\b'),
  ('sports_stats', '\b(?:per game|3-point|three-point|batting|touchdowns)\b'),
  ('movie_knowledge', '\b(?:movie|film|oscar)\b'),
  ('company_history', '\b(?:ceo|previously work|prior employer)\b')) v(name, pattern)"""
for _k in ("e", "u"):
    CTES[f"{_k}_hit"] = f"""
SELECT interaction_id, name, len(regexp_extract_all(lower(query), pattern)) AS weight,
  regexp_matches(lower(query), '\\b(?:historical|decade|over time|when|past years)\\b') AS past
FROM {_k}_query, hint_pattern"""
    CTES[f"{_k}_hint"] = f"""
SELECT interaction_id, 'web' AS name, 1 AS weight FROM {_k}_query
UNION ALL
SELECT interaction_id,
  CASE WHEN past AND name = 'finance_market_cap' THEN 'finance_timeseries' ELSE name END,
  CASE WHEN past AND name = 'finance_market_cap' THEN 1 ELSE weight END
FROM {_k}_hit WHERE weight > 0"""
CTES["cap"] = """
SELECT name, available, dated, CAST(as_of AS DATE) AS as_of FROM (VALUES
  ('web', true, false, NULL), ('finance_market_cap', true, true, '2024-01-15'),
  ('finance_ticker', true, true, NULL), ('finance_prices', false, true, '2024-01-10'),
  ('sports_stats', true, false, NULL)) v(name, available, dated, as_of)"""
CTES["e_gate"] = """
SELECT interaction_id, name, CASE WHEN NOT available THEN 'unavailable'
  WHEN dated AND as_of IS NULL THEN 'snapshot_date_unknown'
  WHEN dated AND as_of <> date THEN 'snapshot_date_mismatch' END AS reason
FROM e_query, cap"""
CTES["e_source"] = """
SELECT interaction_id, 'fixed_web' AS policy, name, 1 AS weight FROM e_gate
WHERE reason IS NULL AND name = 'web'
UNION ALL SELECT interaction_id, 'all_available', name, 1 FROM e_gate WHERE reason IS NULL
UNION ALL SELECT interaction_id, 'adaptive', name, h.weight
FROM e_gate g JOIN e_hint h USING (interaction_id, name) WHERE reason IS NULL"""
CTES["e_share"] = """
SELECT interaction_id, policy, name, tokens FROM (
  SELECT *, part + CASE WHEN row_number() OVER (PARTITION BY interaction_id, policy
      ORDER BY rest DESC, name) <= 1279 - sum(part) OVER (PARTITION BY interaction_id, policy)
    THEN 1 ELSE 0 END AS tokens
  FROM (SELECT *, 1279 * weight // total AS part, 1279 * weight % total AS rest
    FROM (SELECT *, CAST(sum(weight) OVER (PARTITION BY interaction_id, policy) AS BIGINT)
      AS total FROM e_source))) WHERE tokens > 0"""
CTES["e_plan"] = """
SELECT q.interaction_id, p.policy, h.requested_hints, coalesce(b.blocked_hints, '')
  AS blocked_hints, coalesce(a.allocations, '') AS allocations, coalesce(a.n, 0) AS n
FROM e_query q CROSS JOIN (VALUES ('fixed_web'), ('all_available'), ('adaptive')) p(policy)
JOIN (SELECT interaction_id, string_agg(name, ',' ORDER BY name) AS requested_hints
  FROM e_hint GROUP BY ALL) h USING (interaction_id)
LEFT JOIN (SELECT h.interaction_id, string_agg(h.name || ':' ||
    coalesce(g.reason, 'capability_not_provisioned'), ',' ORDER BY h.name) AS blocked_hints
  FROM e_hint h LEFT JOIN e_gate g USING (interaction_id, name)
  WHERE g.name IS NULL OR g.reason IS NOT NULL GROUP BY ALL) b USING (interaction_id)
LEFT JOIN (SELECT interaction_id, policy, count(*) AS n,
    string_agg(name || ':' || tokens, ',' ORDER BY name) AS allocations
  FROM e_share GROUP BY ALL) a USING (interaction_id, policy)"""

ORACLE["source_hints"] = compose(
    "SELECT interaction_id, name, CAST(weight AS INTEGER) AS weight FROM e_hint"
)
ORACLE["capability_gate"] = compose("SELECT interaction_id, name, reason FROM e_gate")
ORACLE["routing_plans"] = compose("""
SELECT interaction_id, policy, requested_hints, blocked_hints, allocations,
  1279 AS evidence_budget, 257 AS reserved_tokens, 1536 AS total_budget,
  CAST(n AS INTEGER) AS max_source_calls, 'not_executed' AS execution_status FROM e_plan""")
ORACLE["routing_summary"] = compose("""
SELECT 'blocked_hint' AS section, h.name || ':' || coalesce(g.reason,
    'capability_not_provisioned') AS key, count(*) AS n
FROM e_hint h LEFT JOIN e_gate g USING (interaction_id, name)
WHERE g.name IS NULL OR g.reason IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'allocated_source', policy || ':' || name, count(*) FROM e_share GROUP BY ALL
UNION ALL SELECT 'total', 'questions', count(*) FROM e_query
UNION ALL SELECT 'total', 'plans', 3 * count(*) FROM e_query
UNION ALL SELECT 'total', 'equivalent_allocations', count(*) FROM (
  SELECT interaction_id FROM e_plan GROUP BY ALL HAVING count(DISTINCT allocations) = 1)""")
ORACLE["routing_audit"] = compose("""
SELECT p.interaction_id || '/all_available' AS location, 'budget_not_spent' AS rule,
  CAST(1279 + p.n AS VARCHAR) AS detail FROM e_plan p
WHERE p.policy = 'all_available' AND p.n > 0
  AND NOT EXISTS (SELECT 1 FROM e_hint h WHERE h.interaction_id = p.interaction_id
    AND h.name = 'finance_prices')""")
ORACLE["capability_violations"] = """
SELECT CAST(p_partkey AS VARCHAR) AS location, 'name_missing' AS rule, 'name' AS detail
FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'available_not_boolean', 'maybe'
FROM part WHERE p_partkey % 7 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'requires_as_of_not_boolean', NULL
FROM part WHERE p_partkey % 11 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'as_of_date_not_iso', '2024-02-30'
FROM part WHERE p_partkey % 13 = 0 AND p_partkey % 3 <> 0"""

# ---- prices -----------------------------------------------------------------------------

ORACLE["price_violations"] = """
SELECT ticker || '/' || stamp AS location, rule, count(*) AS n FROM (
  SELECT 'U' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS ticker,
    CASE WHEN event_type = 'error' THEN 'unknown'
      ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp,
    CASE event_type WHEN 'error' THEN 'dated_key_required' WHEN 'view' THEN 'open_close_required'
      WHEN 'signup' THEN 'value_not_finite' END AS rule
  FROM events) WHERE rule IS NOT NULL GROUP BY ALL"""
ORACLE["daily_prices"] = compose("""
SELECT ticker, strftime(date, '%Y-%m-%d') AS date, open, close, ticks FROM price""")
ORACLE["price_lookup"] = compose("""
SELECT q.interaction_id, q.ticker, strftime(q.date + 3, '%Y-%m-%d') AS date, p.row_timestamp,
  coalesce(p.close, -1) AS close FROM e_query q LEFT JOIN price p ON p.ticker = q.ticker AND p.date = q.date + 3""")
ORACLE["price_coverage"] = compose("""
SELECT ticker, count(*) AS rows, strftime(min(date), '%Y-%m-%d') AS first_date,
  strftime(max(date), '%Y-%m-%d') AS last_date,
  count(*) FILTER (WHERE date = DATE '2024-01-15') > 0 AS probe_available
FROM price GROUP BY ticker""")
ORACLE["market_cap_violations"] = """
SELECT 'P' || p_partkey AS location, 'value_not_finite' AS rule, 'P' || p_partkey AS detail
FROM part WHERE p_size % 10 IN (0, 1)"""
ORACLE["company_lookup"] = """
WITH named AS (SELECT p_name AS name, max(p_partkey) AS k FROM part GROUP BY p_name),
asked AS (SELECT p_partkey AS asked,
  CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || ' Inc' END AS name FROM part)
SELECT a.asked, a.name, 'P' || n.k AS symbol, coalesce(p.p_retailprice, -1) AS market_cap
FROM asked a LEFT JOIN named n USING (name) LEFT JOIN part p ON p.p_partkey = n.k"""
ORACLE["probe_violations"] = """
SELECT CASE WHEN p_partkey % 4 = 1 THEN 'X' ELSE 'P' END || p_partkey AS location,
  CASE p_partkey % 4 WHEN 1 THEN 'known_key_missing' WHEN 2 THEN 'value_differs'
    ELSE 'unknown_key_found' END AS rule,
  CASE WHEN p_partkey % 4 = 1 THEN 'X' ELSE 'P' END || p_partkey AS detail
FROM part WHERE p_partkey % 4 <> 0"""
ORACLE["prior_close_requests"] = compose("""
SELECT interaction_id, ticker, strftime(requested_date, '%Y-%m-%d') AS requested_date,
  strftime(available_as_of, '%Y-%m-%d') AS available_as_of FROM e_request""")
EVIDENCE_ID = """sha256(concat_ws(chr(0), ticker, strftime(requested_date, '%Y-%m-%d'),
    row_timestamp, content, source_ref))"""
ORACLE["prior_close_evidence"] = compose(f"""
SELECT interaction_id, content, source_ref, ticker,
  strftime(requested_date, '%Y-%m-%d') AS requested_date, row_timestamp,
  strftime(available_as_of, '%Y-%m-%d') AS available_as_of, close,
  {EVIDENCE_ID} AS evidence_id FROM e_evidence""")
CTES["e_entity"] = r"""
SELECT interaction_id, list_sort(list_distinct(list_filter([
  CASE WHEN regexp_matches(lower(query), '\b(apple|aapl)\b') THEN 'AAPL' END,
  CASE WHEN regexp_matches(lower(query), '\b(microsoft|msft)\b') THEN 'MSFT' END,
  CASE WHEN regexp_matches(lower(query), '\b(tesla|tsla)\b') THEN 'TSLA' END],
  lambda x: x IS NOT NULL))) AS symbols FROM e_query"""
ORACLE["entity_symbols"] = compose("""
SELECT interaction_id, array_to_string(symbols, ',') AS symbols FROM e_entity""")
CTES["e_expansion"] = r"""
SELECT w.interaction_id, w.ticker FROM (
  SELECT DISTINCT interaction_id,
    unnest(regexp_extract_all(upper(query), '\b[A-Z][A-Z0-9]{2,}\b')) AS ticker
  FROM e_query JOIN (SELECT interaction_id FROM e_hint WHERE name = 'finance_prices')
    USING (interaction_id)) w
WHERE w.ticker IN (SELECT ticker FROM price)"""
ORACLE["expansion_symbols"] = compose("SELECT interaction_id, ticker FROM e_expansion")
CTES["e_eligible"] = """
SELECT q.interaction_id, strftime(q.date, '%Y-%m-%d') AS date,
  h.interaction_id IS NOT NULL AS price_hinted, len(e.symbols) = 1 AS single_entity,
  len(e.symbols) = 1 AND EXISTS (SELECT 1 FROM price p WHERE p.ticker = e.symbols[1]
    AND p.date = q.date) AS date_eligible,
  x.ticker AS expansion_ticker, r.ticker AS prior_close_ticker,
  v.interaction_id IS NOT NULL AS prior_close_supported
FROM e_query q JOIN e_entity e USING (interaction_id)
LEFT JOIN (SELECT interaction_id FROM e_hint WHERE name = 'finance_prices') h
  USING (interaction_id)
LEFT JOIN (SELECT interaction_id, min(ticker) AS ticker FROM e_expansion
  GROUP BY ALL HAVING count(*) = 1) x0 USING (interaction_id)
LEFT JOIN LATERAL (SELECT x0.ticker WHERE EXISTS (SELECT 1 FROM price p
  WHERE p.ticker = x0.ticker AND p.date = q.date)) x ON true
LEFT JOIN e_request r USING (interaction_id) LEFT JOIN e_evidence v USING (interaction_id)"""
ORACLE["price_eligibility_detail"] = compose("SELECT * FROM e_eligible")
ORACLE["price_eligibility"] = compose("""
SELECT count(*) AS questions, count_if(price_hinted) AS price_hinted_questions,
  count_if(single_entity) AS single_entity_questions, count_if(date_eligible) AS date_eligible,
  count_if(date_eligible AND price_hinted) AS date_eligible_and_hinted,
  count(expansion_ticker) AS expansion_candidates,
  count(prior_close_ticker) AS prior_close_prepared,
  count_if(prior_close_supported) AS prior_close_supported FROM e_eligible""")
ORACLE["provisioned_plans"] = compose("""
SELECT interaction_id, policy, CASE WHEN policy = 'all_available' OR (policy = 'adaptive'
    AND interaction_id IN (SELECT interaction_id FROM e_hint WHERE name = 'finance_prices'))
  THEN 'finance_prices:640,web:640' ELSE 'web:1280' END AS allocations
FROM e_evidence, (VALUES ('fixed_web'), ('all_available'), ('adaptive')) p(policy)""")

ORACLE["named_entities"] = f"""
WITH a AS (SELECT 'B' || item_id AS symbol,
    {terms("array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ')")} AS w FROM benchmark),
k AS (SELECT DISTINCT array_to_string(w, ' ') AS key, symbol FROM a WHERE len(w) > 0),
g AS (SELECT doc_id, unnest(list_transform(range(0, len(w) - n + 1), lambda i: array_to_string(list_slice(w, i + 1, i + n), ' '))) AS key
  FROM (SELECT doc_id, {terms('text')} AS w FROM documents), (SELECT DISTINCT len(w) AS n FROM a) r WHERE n > 0 AND len(w) >= n)
SELECT DISTINCT 'd' || doc_id AS interaction_id, symbol FROM g JOIN k USING (key)"""
ORACLE["query_time_violations"] = """
SELECT 'e' || event_id AS location, 'query_time_format' AS rule FROM events WHERE event_id % 9 IN (0, 1, 2)"""
