"""DuckDB SQL of the queries on vectors and on the structure of conversations."""

#: crc32 (fixed polynomial) of ASCII strings: a table of 256 values, and the fold over a string.
_CRC_TABLE = """bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"""


def _crc32(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


VECTOR_CELLS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(e, lambda x: x <> 0)) > 0),
near AS (
  SELECT a.r, b.r AS other FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(r, other) AS (SELECT r, r FROM v UNION SELECT reach.r, near.other FROM reach JOIN near ON near.r = reach.other),
least AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.other GROUP BY reach.r),
links AS (SELECT r, count(*) AS n_links FROM near GROUP BY r)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN links USING (r)"""

PREFIX_TRIE = f"""
WITH RECURSIVE {_CRC_TABLE},
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
joined AS (
  SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos < c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, role, text FROM joined),
steps(conv_id, depth, path, parent, chars) AS (
  SELECT conv_id, 0, '', CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM c
  UNION ALL SELECT s.conv_id, s.depth + 1, sha256(s.path || p.role || chr(10) || length(p.role) || chr(10) || p.text), s.path, length(p.text)
  FROM steps s JOIN placed p ON p.conv_id = s.conv_id AND p.depth = s.depth + 1),
lengths AS (SELECT conv_id, max(depth) AS last FROM steps GROUP BY conv_id),
nodes AS (
  SELECT path, depth, any_value(parent) AS parent, min(s.conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id) FILTER (WHERE s.depth = l.last), '')) AS ends_sha256
  FROM steps s JOIN lengths l USING (conv_id) GROUP BY path, depth),
children AS (SELECT parent AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
valued AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n_convs - 1) * chars AS saved FROM nodes n LEFT JOIN children k USING (path)),
above AS (  -- every node with itself and the nodes above it, read from the rows of its least member
  SELECT v.path, v.n_children, v.saved, s.path AS top FROM valued v JOIN steps s ON s.conv_id = v.conv_id AND s.depth <= v.depth),
sums AS (SELECT top AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY top)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM valued v JOIN sums s USING (path) LEFT JOIN nodes p ON p.path = v.parent"""

# Repair: the least (cost, audit) by row and state of the role pattern (0 nothing, 1 s, 2 an open u, 3 a closed ua), row after row.
# ``ways`` lists, for each state, up to two insertions; a step is insertions, then the edit of one row.
_WAYS = """ways(state, cost, letters, roles, after) AS (
  VALUES (0, 0, '', 0, 0), (0, 5, 'I', 1, 2), (0, 10, 'II', 2, 3), (1, 0, '', 0, 1), (1, 5, 'I', 1, 2), (1, 10, 'II', 2, 3),
         (2, 0, '', 0, 2), (2, 5, 'I', 1, 3), (2, 10, 'II', 2, 2), (3, 0, '', 0, 3), (3, 5, 'I', 1, 2), (3, 10, 'II', 2, 3))"""
_WANTED = "CASE WHEN w.after = 2 THEN 'assistant' ELSE 'user' END"
_INSERTED = """CASE WHEN w.roles = 0 THEN CAST([] AS VARCHAR[]) WHEN w.roles = 1 THEN [CASE WHEN w.state = 2 THEN 'assistant:' ELSE 'user:' END]
                WHEN w.state = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END"""

TURN_REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE},
{_WAYS},
dealt AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS d FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, range(CASE WHEN d = 0 THEN 0 WHEN d = 3 THEN 2 ELSE 1 END)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         left(role, 1) AS initial,
         regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM damaged),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM r),
f AS (
  SELECT *, CASE WHEN body = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(body, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id),
edits AS (  -- each row's edits from each state after insertions: letter, cost, next state, what is said
  SELECT f.conv_id, f.i, w.after AS state, 'D' AS letter, 2 AS cost, w.after, CAST([] AS VARCHAR[]) AS said FROM f, (SELECT DISTINCT after FROM ways) w
  UNION ALL SELECT f.conv_id, f.i, w.after, 'K', CASE WHEN fault = 't' THEN 5 ELSE 0 END,
                   CASE WHEN initial = 's' THEN 1 WHEN w.after = 2 THEN 3 ELSE 2 END, [role || ':' || text]
  FROM f, (SELECT DISTINCT after FROM ways) w
  WHERE fault IN ('', 't') AND ((initial = 's' AND w.after = 0) OR (initial = 'a' AND w.after = 2) OR (initial = 'u' AND w.after <> 2))
  UNION ALL SELECT f.conv_id, f.i, w.after, 'R', CASE WHEN fault = 't' THEN 6 ELSE 1 END, CASE WHEN w.after = 2 THEN 3 ELSE 2 END, [{_WANTED} || ':' || text]
  FROM f, (SELECT DISTINCT after FROM ways) w WHERE fault IN ('', 't')),
best(conv_id, i, state, b) AS (
  SELECT conv_id, 0, 0, {{'cost': 0, 'audit': '', 'said': CAST([] AS VARCHAR[])}} FROM counts
  UNION ALL
  SELECT conv_id, i, state, min(b) FROM (
    SELECT s.conv_id, e.i, e.after AS state,
           {{'cost': s.b.cost + w.cost + e.cost, 'audit': s.b.audit || w.letters || e.letter, 'said': list_concat(list_concat(s.b.said, {_INSERTED}), e.said)}} AS b
    FROM best s JOIN ways w ON w.state = s.state JOIN edits e ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.i = s.i + 1 AND e.state = w.after) x
  GROUP BY conv_id, i, state),
ended AS (
  SELECT s.conv_id, min({{'cost': s.b.cost + w.cost, 'audit': s.b.audit || w.letters, 'said': list_concat(s.b.said, {_INSERTED})}}) AS b
  FROM best s JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = c.n JOIN ways w ON w.state = s.state WHERE w.after IN (0, 3) GROUP BY s.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(e.b.cost, 0) AS BIGINT) AS cost, coalesce(e.b.audit, '') AS audit,
       sha256(coalesce(array_to_string(e.b.said, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id"""
