"""SQL equivalents: chunks, ranking, context walks and set selection."""

from __future__ import annotations

from .base import CTES, STOP, compose, terms, walk, words

ORACLE: dict[str, str] = {}

ORACLE["web_chunks"] = compose("""
SELECT evidence_id, interaction_id, 'web' AS source_kind, page_index, page_url AS source_url,
  page_name AS source_title, page_last_modified AS source_time, field, char_start, char_end,
  word_count FROM q_chunk_50""")

ORACLE["chunk_words_120"] = compose("""
SELECT interaction_id, field, count(*) AS chunks, CAST(sum(word_count) AS BIGINT) AS words,
  CAST(sum(length(content)) AS BIGINT) AS chars, min(evidence_id) AS first_id
FROM u_chunk_120 GROUP BY ALL""")

ORACLE["bm25_scores"] = compose("""
SELECT interaction_id, evidence_id, n_candidates, n_terms, round(score, 6) AS score
FROM q_bm_50""")

ORACLE["bm25_top_k"] = compose("""
SELECT interaction_id, evidence_id, rank, round(score, 6) AS score
FROM q_bm_50_rank WHERE rank <= 12""")

ORACLE["bm25_full_rank"] = compose("SELECT interaction_id, evidence_id, rank FROM q_bm_50_rank")

ORACLE["select_context"] = compose(
    """
SELECT interaction_id, array_to_string(taken, ',') AS evidence, used AS context_words
FROM walk_end""",
    walk("q_bm_50_rank", ("interaction_id",), 5, 170),
)

_RUN = """
SELECT q.interaction_id, coalesce(a.n_candidates, 0) AS n_candidates,
  coalesce(len(w.taken), 0) AS n_selected, coalesce(w.used, 0) AS context_words,
  w.taken[1] AS top_evidence_id, round(w.first_score, 6) AS top_score
FROM q_query q LEFT JOIN q_bm_200_avg a USING (interaction_id)
LEFT JOIN walk_end w USING (interaction_id)"""
_RUN_WALK = walk("q_bm_200_rank", ("interaction_id",), 3, 600)

ORACLE["retrieval_run"] = compose(_RUN, _RUN_WALK)
ORACLE["retrieval_summary"] = compose(
    f"""
SELECT count(*) AS questions, round(avg(n_candidates), 6) AS mean_candidates,
  round(avg(n_selected), 6) AS mean_selected, round(avg(context_words), 6) AS mean_context_words,
  max(context_words) AS max_context_words FROM ({_RUN})""",
    _RUN_WALK,
)

CTES["q_dense"] = """
SELECT v.interaction_id, v.evidence_id, list_cosine_similarity(v.vector, o.vector) AS score,
  -list_sum(list_transform(range(1, len(v.vector) + 1),
    lambda i: (v.vector[i] - o.vector[i]) * (v.vector[i] - o.vector[i]))) AS second
FROM q_vec v JOIN q_own o USING (interaction_id)"""
CTES["q_dense_rank"] = """
SELECT *, row_number() OVER (PARTITION BY interaction_id
  ORDER BY round(score, 9) DESC, evidence_id) AS rank FROM q_dense"""

ORACLE["dense_rank"] = compose("""
SELECT interaction_id, evidence_id, rank, round(score, 6) + 0.0 AS score
FROM q_dense_rank WHERE rank <= 10""")

ORACLE["rerank_two_stage"] = compose("""
SELECT interaction_id, evidence_id, row_number() OVER (PARTITION BY interaction_id
  ORDER BY round(second, 9) DESC, evidence_id) AS rank, round(second, 6) + 0.0 AS score
FROM q_dense_rank WHERE rank <= 10""")

CTES["m_pool"] = """
SELECT c.interaction_id, c.evidence_id, c.word_count, c.score,
  list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), o.vector) AS cosine,
  -list_sum(list_transform(range(1, len(o.vector) + 1),
    lambda i: (CAST(e.embedding[i] AS DOUBLE) - o.vector[i])
      * (CAST(e.embedding[i] AS DOUBLE) - o.vector[i]))) AS second
FROM q_bm_50 c
JOIN embeddings e ON e.vec_id =
  CAST('0x' || substring(c.evidence_id, 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings)
JOIN q_own o USING (interaction_id)"""
CTES["m_dense"] = """
SELECT *, row_number() OVER (PARTITION BY interaction_id
  ORDER BY round(cosine, 9) DESC, evidence_id) AS r FROM m_pool"""
CTES["m_scored"] = """
SELECT interaction_id, 'bm25' AS method, evidence_id, word_count, score FROM m_pool
UNION ALL SELECT interaction_id, 'dense', evidence_id, word_count, cosine FROM m_pool
UNION ALL SELECT interaction_id, 'dense_reranked', evidence_id, word_count, second
FROM m_dense WHERE r <= 10"""
CTES["m_rank"] = """
SELECT *, row_number() OVER (PARTITION BY interaction_id, method
  ORDER BY round(score, 9) DESC, evidence_id) AS rank FROM m_scored"""
METHOD_WALK = walk("m_rank", ("interaction_id", "method"), 3, 150)

ORACLE["method_comparison"] = compose(
    """
SELECT interaction_id, method, array_to_string(taken, ',') AS evidence, used AS context_words
FROM walk_end""",
    METHOD_WALK,
)

ORACLE["method_audit"] = compose(
    """
SELECT interaction_id || '/' || method || '/' || unnest(taken) AS location,
  'score_not_finite' AS rule FROM walk_end WHERE method = 'dense'
UNION ALL
SELECT CASE rule WHEN 'run_missing' THEN interaction_id || '/bm25' ELSE interaction_id END, rule
FROM walk_end, (VALUES ('method_set_differs'), ('run_missing')) r(rule)
WHERE method = 'bm25' AND used % 2 = 1""",
    METHOD_WALK,
)

ORACLE["score_violations"] = compose("""
SELECT interaction_id || '/' || evidence_id AS location, 'missing_score' AS rule,
  'no score' AS detail FROM q_vec WHERE label IN (0, 3)
UNION ALL SELECT interaction_id || '/' || evidence_id, 'repeated_score', '2'
FROM q_vec WHERE label = 1
UNION ALL SELECT interaction_id || '/' || evidence_id, 'score_not_finite', 'score'
FROM q_vec WHERE label = 2
UNION ALL SELECT interaction_id || '/' || evidence_id || 'x', 'unknown_candidate',
  'not in the pool' FROM q_vec WHERE label = 3""")

ORACLE["retrieval_audit"] = compose(
    f"""
SELECT t.interaction_id || '/' || t.evidence_id AS location, 'source_url_differs' AS rule
FROM traced t WHERE t.page_index % 2 = 1
UNION ALL
SELECT t.interaction_id || '/' || t.evidence_id, 'span_differs' FROM traced t
WHERE t.field = 'page_snippet'
UNION ALL
SELECT interaction_id, 'context_words_differ' FROM walk_end WHERE len(taken) % 2 = 1
UNION ALL
SELECT t.interaction_id || '/' || t.evidence_id, 'word_count_differs' FROM traced t
WHERE {words('t.content')} <> t.word_count""",
    walk("q_bm_50_rank", ("interaction_id",), 5, 170),
    """traced AS (
  SELECT c.* FROM (SELECT interaction_id, unnest(taken) AS evidence_id FROM walk_end) e
  JOIN q_bm_50 c USING (interaction_id, evidence_id))""",
)

# ---- selection --------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in STOP)
CTES["s_pool"] = """
SELECT interaction_id, evidence_id, content, page_url, word_count, rank,
  score / coalesce(nullif(max(score) OVER (PARTITION BY interaction_id), 0), 1) AS relevance,
  row_number() OVER (PARTITION BY interaction_id ORDER BY evidence_id) AS i
FROM q_bm_50_rank WHERE rank <= 10"""
CTES["s_need"] = f"""
SELECT interaction_id, CASE WHEN len(r) = 0 THEN ['__no_terms__'] ELSE r END AS need
FROM (SELECT interaction_id, list_sort(list_filter(list_distinct({terms('query')}),
  lambda t: NOT list_contains([{_STOP}], t))) AS r FROM q_query)"""
CTES["s_item"] = f"""
SELECT p.*, n.need, list_distinct({terms('p.content')}) AS found,
  list_transform(n.need, lambda r: CASE WHEN list_contains(
    {terms('p.content')}, r) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS support,
  {words("'[' || p.evidence_id || '] web ' || p.page_url || chr(10) || p.content")} AS cost
FROM s_pool p JOIN s_need n USING (interaction_id)"""
CTES["s_pair"] = """
SELECT a.interaction_id, a.i AS i, b.i AS j, a.evidence_id AS id_a, b.evidence_id AS id_b,
  len(list_intersect(a.found, b.found))::DOUBLE
    / greatest(1, len(list_distinct(list_concat(a.found, b.found)))) AS value
FROM s_item a JOIN s_item b ON a.interaction_id = b.interaction_id AND a.i < b.i"""
# Every affordable subset of up to three candidates with its objective parts.
CTES["s_sub"] = """
SELECT interaction_id, []::BIGINT[] AS ids, 0 AS n, 0::BIGINT AS cost, 0.0::DOUBLE AS relevance,
  0.0::DOUBLE AS coverage, 0.0::DOUBLE AS redundancy, '' AS selected FROM q_query
UNION ALL
SELECT interaction_id, [i], 1, cost, relevance / 3, list_sum(support) / len(need), 0.0,
  evidence_id FROM s_item
UNION ALL
SELECT a.interaction_id, [a.i, b.i], 2, a.cost + b.cost, (a.relevance + b.relevance) / 3,
  list_sum(list_transform(range(1, len(a.need) + 1),
    lambda k: greatest(a.support[k], b.support[k]))) / len(a.need),
  p.value / 3, a.evidence_id || ',' || b.evidence_id
FROM s_item a JOIN s_item b ON b.interaction_id = a.interaction_id AND b.i > a.i
JOIN s_pair p ON p.interaction_id = a.interaction_id AND p.i = a.i AND p.j = b.i
UNION ALL
SELECT a.interaction_id, [a.i, b.i, c.i], 3, a.cost + b.cost + c.cost,
  (a.relevance + b.relevance + c.relevance) / 3,
  list_sum(list_transform(range(1, len(a.need) + 1),
    lambda k: greatest(a.support[k], b.support[k], c.support[k]))) / len(a.need),
  (p.value + q.value + r.value) / 3,
  a.evidence_id || ',' || b.evidence_id || ',' || c.evidence_id
FROM s_item a JOIN s_item b ON b.interaction_id = a.interaction_id AND b.i > a.i
JOIN s_item c ON c.interaction_id = a.interaction_id AND c.i > b.i
JOIN s_pair p ON p.interaction_id = a.interaction_id AND p.i = a.i AND p.j = b.i
JOIN s_pair q ON q.interaction_id = a.interaction_id AND q.i = a.i AND q.j = c.i
JOIN s_pair r ON r.interaction_id = a.interaction_id AND r.i = b.i AND r.j = c.i"""
CTES["s_fit"] = """
SELECT *, 0.2::DOUBLE * relevance + 0.6::DOUBLE * coverage - 0.1::DOUBLE * redundancy AS objective
FROM s_sub WHERE cost <= 150"""

_GAIN = {
    "top_k": "x.relevance",
    "mmr": """0.7::DOUBLE * x.relevance - 0.3::DOUBLE * coalesce((SELECT max(p.value)
      FROM s_pair p WHERE p.interaction_id = s.interaction_id
      AND ((p.i = x.i AND list_contains(s.ids, p.j))
        OR (p.j = x.i AND list_contains(s.ids, p.i)))), 0)""",
    "coverage": "o.coverage - s.coverage",
    "joint": "o.objective - s.objective",
}
for _m, _gain in _GAIN.items():
    _size = "o.n - s.n IN (1, 2)" if _m == "joint" else "o.n = s.n + 1"
    _item = (
        "JOIN s_item x ON x.interaction_id = s.interaction_id AND list_contains(o.ids, x.i)"
        " AND NOT list_contains(s.ids, x.i)"
        if _m in ("top_k", "mmr")
        else ""
    )
    _stop = "WHERE gain > 0" if _m in ("coverage", "joint") else ""
    CTES[f"s_{_m}_0"] = "SELECT * FROM s_fit WHERE n = 0"
    for _round in (1, 2, 3):
        _before = f"s_{_m}_{_round - 1}"
        CTES[f"s_{_m}_{_round}"] = f"""
SELECT s.interaction_id, coalesce(b.ids, s.ids) AS ids, coalesce(b.n, s.n) AS n,
  coalesce(b.cost, s.cost) AS cost, coalesce(b.relevance, s.relevance) AS relevance,
  coalesce(b.coverage, s.coverage) AS coverage, coalesce(b.redundancy, s.redundancy) AS redundancy,
  coalesce(b.selected, s.selected) AS selected, coalesce(b.objective, s.objective) AS objective
FROM {_before} s LEFT JOIN (
  SELECT * FROM (
    SELECT o.*, round({_gain}, 9) AS gain
    FROM {_before} s JOIN s_fit o ON o.interaction_id = s.interaction_id AND {_size}
      AND list_has_all(o.ids, s.ids) {_item}
    QUALIFY row_number() OVER (PARTITION BY o.interaction_id
      ORDER BY gain DESC, o.cost, o.ids) = 1) {_stop}
) b ON b.interaction_id = s.interaction_id"""
    CTES[f"s_{_m}"] = f"SELECT '{_m}' AS method, * FROM s_{_m}_3"
CTES["s_exact"] = """
SELECT 'exact' AS method, interaction_id, ids, n, cost, relevance, coverage, redundancy, selected,
  objective FROM s_fit
QUALIFY row_number() OVER (PARTITION BY interaction_id
  ORDER BY round(objective, 9) DESC, cost, ids) = 1"""
CTES["s_every"] = "\nUNION ALL ".join(
    f"SELECT * FROM s_{m}" for m in ("top_k", "mmr", "coverage", "joint", "exact")
)

for _m in (*_GAIN, "exact"):
    ORACLE[f"select_{_m}"] = compose(f"""
SELECT interaction_id, selected, CAST(cost AS INTEGER) AS context_cost,
  round(objective, 6) AS objective FROM s_{_m}""")

ORACLE["normalised_relevance"] = compose("""
SELECT interaction_id, evidence_id, round(relevance, 6) AS relevance,
  sha256(content) AS content_sha256 FROM s_pool""")
ORACLE["support_vectors"] = compose("""
SELECT interaction_id, evidence_id, array_to_string(
  list_transform(support, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), '') AS support
FROM s_item""")
ORACLE["pair_redundancy"] = compose(
    "SELECT interaction_id, id_a, id_b, round(value, 6) AS value FROM s_pair"
)
ORACLE["problem_violations"] = compose("""
SELECT DISTINCT interaction_id AS location, CASE len(need) % 4
    WHEN 1 THEN 'candidate_without_provenance' WHEN 2 THEN 'feature_out_of_range'
    ELSE 'support_length' END AS rule,
  CASE len(need) % 4 WHEN 1 THEN CAST(count(*) OVER (PARTITION BY interaction_id) AS VARCHAR)
    WHEN 2 THEN 'relevance or support' ELSE CAST(len(need) AS VARCHAR) END AS detail
FROM s_item WHERE len(need) % 4 <> 0""")
ORACLE["objective_components"] = compose("""
SELECT interaction_id, method, round(relevance, 6) AS relevance, round(coverage, 6) AS coverage,
  0.0::DOUBLE AS complementarity, round(redundancy, 6) AS redundancy, 0.0::DOUBLE AS conflict
FROM s_every""")
ORACLE["optimality_gap"] = compose("""
SELECT e.interaction_id, round(e.objective, 6) AS exact_objective,
  round(j.objective, 6) AS joint_objective, round(e.objective - j.objective, 6) AS gap
FROM s_exact e JOIN s_joint j USING (interaction_id)""")
ORACLE["selection_summary"] = compose("""
SELECT method, count(*) AS questions, CAST(max(cost) AS INTEGER) AS max_context_cost,
  round(avg(objective), 6) AS mean_objective FROM s_every GROUP BY method""")
ORACLE["rendered_context"] = compose("""
SELECT interaction_id, CAST(cost AS INTEGER) AS context_cost, sha256(coalesce(text, ''))
  AS context_sha256
FROM s_exact e LEFT JOIN (SELECT x.interaction_id, string_agg('[' || i.evidence_id || '] web '
    || i.page_url || chr(10) || i.content, chr(10) || chr(10) ORDER BY i.evidence_id) AS text
  FROM s_exact x JOIN s_item i ON i.interaction_id = x.interaction_id
    AND list_contains(x.ids, i.i) GROUP BY x.interaction_id) t USING (interaction_id)""")
ORACLE["selection_audit"] = compose("""
SELECT m.interaction_id || '/mmr' AS location, 'cost_differs' AS rule,
  CAST(m.cost + 1 AS VARCHAR) AS detail FROM s_mmr m
UNION ALL SELECT interaction_id || '/mmr', 'over_budget', CAST(cost + 1 AS VARCHAR)
FROM s_mmr WHERE cost + 1 > 150
UNION ALL SELECT interaction_id || '/joint', 'objective_differs', 'objective' FROM s_joint
UNION ALL SELECT j.interaction_id || '/joint', 'above_optimum', 'objective'
FROM s_joint j JOIN s_exact e USING (interaction_id)
WHERE j.objective + 0.5::DOUBLE > e.objective + 1e-9
UNION ALL SELECT interaction_id || '/coverage', 'unknown_selection',
  'made-up' || CASE WHEN contains(selected, ',') THEN substring(selected, instr(selected, ',')) ELSE '' END
FROM s_every WHERE method = 'coverage' AND selected <> ''
UNION ALL SELECT interaction_id || '/top_k', 'selection_missing', 'no row'
FROM s_every WHERE method = 'top_k' AND CAST(substring(interaction_id, 2) AS BIGINT) % 3 = 0""")

_TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t-\r]"
CTES["t_item"] = f"""
SELECT * REPLACE (len(regexp_extract_all('[' || evidence_id || '] web ' || page_url || chr(10) || content, '{_TOKENS}')) AS cost)
FROM s_item"""
CTES["t_sub"] = CTES["s_sub"].replace("s_item", "t_item")
ORACLE["token_budget_selection"] = compose("""
SELECT interaction_id, selected, CAST(cost AS INTEGER) AS context_cost, round(objective, 6) AS objective
FROM (SELECT *, 0.2::DOUBLE * relevance + 0.6::DOUBLE * coverage - 0.1::DOUBLE * redundancy AS objective
  FROM t_sub WHERE cost <= 300)
QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY round(objective, 9) DESC, cost, ids) = 1""")
CTES["g_sub"] = """
SELECT s.*, len(n.need) AS needs, coalesce((SELECT list(x.support) FROM s_item x
    WHERE x.interaction_id = s.interaction_id AND list_contains(s.ids, x.i)), []) AS sups,
  coalesce((SELECT count(*) FROM s_pair p WHERE p.interaction_id = s.interaction_id AND p.value > 0.02
    AND list_contains(s.ids, p.i) AND list_contains(s.ids, p.j)), 0) * 0.1::DOUBLE / 3 AS conflict
FROM s_sub s JOIN s_need n USING (interaction_id) WHERE cost <= 150"""
CTES["g_rated"] = """
SELECT *, len(list_filter(range(1, least(needs, 4)), lambda k:
    len(list_filter(sups, lambda v: v[k] = 1)) > 0 AND len(list_filter(sups, lambda v: v[k + 1] = 1)) > 0
    AND len(list_filter(sups, lambda v: v[k] = 1 AND v[k + 1] = 1)) = 0))::DOUBLE
  / greatest(1, least(needs, 4) - 1) AS complementarity FROM g_sub"""
ORACLE["grouped_selection"] = compose("""
SELECT interaction_id, selected, round(objective, 6) AS objective, round(relevance, 6) AS relevance,
  round(coverage, 6) AS coverage, round(complementarity, 6) AS complementarity, round(redundancy, 6) AS redundancy,
  round(conflict, 6) AS conflict
FROM (SELECT *, 0.2::DOUBLE * relevance + 0.6::DOUBLE * coverage + 0.2::DOUBLE * complementarity
    - 0.1::DOUBLE * redundancy - 0.5::DOUBLE * conflict AS objective FROM g_rated)
QUALIFY row_number() OVER (PARTITION BY interaction_id ORDER BY round(objective, 9) DESC, cost, ids) = 1""")
