"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.keeper AS gone
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n,
         array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS p FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
c AS (SELECT doc_id, count(DISTINCT i) AS n_hit
      FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS i FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
       coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP6 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT payload, min(page_id) AS first_id FROM p GROUP BY payload),
h AS (SELECT p.page_id, strlen(p.payload)::BIGINT AS payload_bytes, sha1(p.payload) AS hex, f.first_id
      FROM p JOIN f ON p.payload = f.payload)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, ((i // 4) * 5 + 1)::INT, 5))::INT >> (5 * (3 - i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM h
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
s AS (SELECT count(*) AS N, sum(len(w))::BIGINT AS L FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * len(w) * N) // L) AS m FROM d, s WHERE len(w) > 0),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
t AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
g AS (SELECT term, floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM t, s),
i AS (
  SELECT row_number() OVER () AS ir, item_id, regexp_extract_all(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
q AS (SELECT ir, term, count(*)::BIGINT AS times FROM (SELECT ir, unnest(w) AS term FROM i) GROUP BY ir, term),
c AS (
  SELECT q.ir, tf.r, sum(q.times * g.weight * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m)))::BIGINT AS score
  FROM q JOIN tf ON q.term = tf.term JOIN g ON q.term = g.term JOIN m ON tf.r = m.r GROUP BY q.ir, tf.r),
k AS (
  SELECT c.ir, m.doc_id, c.score,
         row_number() OVER (PARTITION BY c.ir ORDER BY c.score DESC, m.doc_id NULLS FIRST) AS rank
  FROM c JOIN m ON c.r = m.r WHERE c.score > 0)
SELECT i.item_id, k.rank::INT AS rank, k.doc_id, k.score FROM k JOIN i ON k.ir = i.ir WHERE k.rank <= 20
"""

OP13 = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
         sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
digits AS (
  SELECT DISTINCT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)) AS b FROM t),
c AS (  -- crc32 by its definition, a bit at a time
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         (xor(list_reduce(list_concat([4294967295], range(0, 8 * len(b))), lambda a, j:
            xor((CASE WHEN j % 8 = 0 THEN xor(a, b[j // 8 + 1]) ELSE a END) >> 1,
                3988292384 * ((CASE WHEN j % 8 = 0 THEN xor(a, b[j // 8 + 1]) ELSE a END) & 1))), 4294967295) % 4)::INT AS h
  FROM digits),
r AS (
  SELECT c.conv_id, 0 AS src, t.i, t.key, t.words FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.i, t.key, t.words FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, words, string_agg(key, '') OVER w AS path,
         count(*) OVER (PARTITION BY conv_id) AS turns
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY src, i ROWS UNBOUNDED PRECEDING)),
a AS (
  SELECT conv_id, depth, words, path, depth = turns AS last FROM p
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (
  SELECT path, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM a GROUP BY path),
k AS (SELECT p.path, count(x.path) AS n_children FROM n p
      LEFT JOIN n x ON x.depth = p.depth + 1 AND substr(x.path, 1, 64 * p.depth::INT) = p.path GROUP BY p.path),
u AS (  -- every node with all nodes above it and itself
  SELECT substr(n.path, 1, (64 * z)::INT) AS path, (n.n_convs - 1) * n.words AS saved, (k.n_children = 0)::INT AS leaf
  FROM (SELECT *, unnest(range(0, depth + 1)) AS z FROM n) n JOIN k ON n.path = k.path),
s AS (SELECT path, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM u GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       k.n_children::BIGINT AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN k ON n.path = k.path JOIN s ON n.path = s.path
LEFT JOIN n q ON n.depth > 0 AND q.path = substr(n.path, 1, (64 * (n.depth - 1))::INT)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op5_decontamination": OP5, "op6_warc": OP6,
            "op12_ranked_search": OP12, "op13_prefix_trie": OP13}
