"""SQL with the same results, for the queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(regexp_replace(replace(text, '␛', '␛0'),
    '([<\[])(\|turn\|>|\|says\|>|/s>|s>|\|image\|>|\|audio\|>|\|document\|>|INST\]|/INST\]|<SYS>>|</SYS>>|unk>|pad>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|eot_id\|>)',
    '\1␛1\2', 'g')) + length(role) + 8 + 8 + 4 AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id
"""

HARD_NEGATIVES = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS alike, CAST(list_inner_product(a.e, o.e) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, s.other_id AS negative_id, positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

# A state is its cost in nine digits and then the edits, so the least text is the cheapest and then the ASCII-least.
REPAIR = r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS s FROM conversations),
c AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))),
    lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, t),
r AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM c WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         regexp_replace(text, '[ 	-
]+', '', 'g') AS solid FROM r),
f AS (
  SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(solid, '[.!?]$') THEN 'truncated' ELSE '' END AS fault,
    role[1] AS ini, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM f GROUP BY conv_id),
d AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS p, CAST(NULL AS VARCHAR) AS s, '000000002I' AS u, '000000004II' AS a FROM n
  UNION ALL
  SELECT conv_id, i, p, s, least(u, u2), least(a, a2) FROM (
    SELECT *, least(@(a, 2, 'I'), @(p, 2, 'I'), @(s, 2, 'I')) AS u2, @(least(u, @(p, 2, 'I'), @(s, 2, 'I')), 2, 'I') AS a2 FROM (
      SELECT d.conv_id, f.i, @(d.p, 3, 'D') AS p,
        least(@(d.s, 3, 'D'), CASE WHEN g AND ini = 's' THEN @(d.p, w, 'K') END) AS s,
        least(@(d.u, 3, 'D'), CASE WHEN g THEN least(@(d.p, 2 + w, 'R'), @(d.s, 2 + w, 'R'), @(d.a, 2 + w, 'R')) END,
              CASE WHEN g AND ini = 'u' THEN least(@(d.p, w, 'K'), @(d.s, w, 'K'), @(d.a, w, 'K')) END) AS u,
        least(@(d.a, 3, 'D'), CASE WHEN g THEN @(d.u, 2 + w, 'R') END, CASE WHEN g AND ini = 'a' THEN @(d.u, w, 'K') END) AS a
      FROM d JOIN (SELECT *, fault IN ('', 'truncated') AS g, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS w FROM f) AS f
        ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i + 1) AS x) AS y),
e AS (
  SELECT n.*, least(d.p, d.a) AS best FROM n JOIN d ON d.conv_id IS NOT DISTINCT FROM n.conv_id AND d.i = n.size),
z AS (
  SELECT e.conv_id, best[10:] AS audit, CAST(0 AS BIGINT) AS done, CAST(0 AS BIGINT) AS i, '' AS last, '' AS made FROM e
  UNION ALL
  SELECT z.conv_id, z.audit, done + 1, z.i + CASE WHEN op = 'I' THEN 0 ELSE 1 END,
         CASE op WHEN 'D' THEN last WHEN 'K' THEN f.ini ELSE CASE WHEN last = 'u' THEN 'a' ELSE 'u' END END,
         made || CASE op WHEN 'D' THEN '' ELSE (CASE WHEN made = '' THEN '' ELSE chr(10) END)
           || (CASE op WHEN 'K' THEN f.role ELSE CASE WHEN last = 'u' THEN 'assistant' ELSE 'user' END END) || ':'
           || (CASE op WHEN 'I' THEN '' ELSE f.text END) END
  FROM (SELECT *, audit[done + 1] AS op FROM z WHERE done < length(audit)) AS z
  LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM z.conv_id AND f.i = z.i + 1)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(best[1:9] AS BIGINT), 0) AS cost, coalesce(z.audit, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS q
LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM q.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM q.conv_id AND z.done = length(z.audit)
"""


def _priced(sql: str) -> str:
    """``@(state, cost, edit)`` spelled out: the state after one more edit."""
    while "@(" in sql:
        start = sql.rindex("@(")
        end, depth = start + 1, 0
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if not depth:
                break
            end += 1
        state, cost, edit = sql[start + 2:end].rsplit(",", 2)
        sql = f"{sql[:start]}(lpad(CAST(CAST(({state})[1:9] AS INTEGER) + {cost.strip()} AS VARCHAR), 9, '0') || ({state})[10:] || {edit.strip()}){sql[end + 1:]}"
    return sql


ORACLES = {"op13_structure_repair": _priced(REPAIR), "op12_hard_negatives": HARD_NEGATIVES, "op1_exact_dedup": EXACT_DEDUP, "op6_chat_formatting": CHAT, "op8_jaccard_join": JACCARD}
