"""SQL equivalents of the registered queries that SQL can express on whole tables.

The classifier, tokenizers, learned rules, XXH64 fingerprints and eigenvectors have none; tests compare those with
brute force.
"""

ORACLE: dict[str, str] = {}

ORACLE["op7_embeddings"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM v
  UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.vec_id AND link.b > reach.r)
SELECT x.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.r, x.vec_id) AS component_id,
  coalesce(c.r, x.vec_id) = x.vec_id AS kept
FROM embeddings x
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY 1) n USING (vec_id)
LEFT JOIN (SELECT vec_id, min(r) AS r FROM reach GROUP BY 1) c USING (vec_id)"""

ORACLE["op9_suffixes"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
block AS (SELECT doc_id, length(h) // 2 - 399 AS n, h,
    unnest(range(0, greatest(length(h) // 2 - 399, 0), 500)) AS b FROM d),
piece AS (SELECT doc_id, b, least(500, n - b) AS m, substring(h, 2 * b + 1, 1798) AS t FROM block),
s AS (SELECT doc_id, unnest(list_transform(range(0, m),
    lambda p: {'p': b + p, 'k': md5(substring(t, 2 * p + 1, 800))})) AS x FROM piece),
k AS (SELECT x.k AS k FROM s GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, x.p AS p FROM s WHERE x.k IN (SELECT k FROM k)),
island AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (
    SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new
    FROM hit)),
span AS (SELECT doc_id, min(p) AS low, max(p) + 400 AS high FROM island GROUP BY doc_id, g),
gap AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS done FROM span),
cut AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans,
    string_agg(substring(h, 2 * done + 1, 2 * (low - done)), '' ORDER BY low) || substring(any_value(h), 2 * max(high) + 1) AS rest
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

ORACLE["op11_products"] = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor(256 * c)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER best AS INTEGER) AS rank, c.vec_id,
  CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
WINDOW best AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.x, c.x) DESC, c.vec_id)
QUALIFY row_number() OVER best <= 5"""

ORACLE["op13_prefixes"] = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS head, n, xor(4294967295, list_reduce(list_concat([4294967295],
      flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
        lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x)
      ELSE xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END) END)) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY 1)),
turn AS (SELECT c.conv_id, t.p AS d, role, text FROM c JOIN t ON t.conv_id = c.head AND t.p <= c.h
  UNION ALL SELECT c.conv_id, t.p - c.h + least(c.h, coalesce(f.n, 0)), role, text
  FROM c JOIN t USING (conv_id) LEFT JOIN c f ON f.conv_id = c.head WHERE t.p > c.h),
member AS (SELECT conv_id, d, strlen(text) AS bytes, string_agg(md5(length(role) || ':' || role || text), '')
    OVER (PARTITION BY conv_id ORDER BY d) AS k FROM turn
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
    string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE d = last) AS ends
  FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM member) GROUP BY k, d),
kids AS (SELECT left(k, length(k) - 32) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
sums AS (SELECT left(a.k, 32 * a.up) AS k, count(*) FILTER (WHERE kids.n IS NULL) AS leaves, sum((a.n - 1) * a.bytes) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM node) a LEFT JOIN kids ON kids.k = a.k GROUP BY 1)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(kids.n, 0) AS n_children,
  sums.leaves AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM node x JOIN sums ON sums.k = x.k LEFT JOIN kids ON kids.k = x.k
LEFT JOIN node p ON x.d > 0 AND p.k = left(x.k, length(x.k) - 32)"""
