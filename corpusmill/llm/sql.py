"""SQL for DuckDB that gives the same rows as the queries, by other ways."""

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"



def _after(low: str, high: str) -> str:
    """The place after the strongest boundary in (low, high] of ``text``, times ten, plus its strength."""
    wide, inner = f"substr(text, ({low})::BIGINT, ({high} - {low} + 1)::BIGINT)", f"substr(text, ({low} + 1)::BIGINT, ({high} - {low})::BIGINT)"
    part, told, white = (rf"regexp_extract({x}, '(?s)^.*{p}')" for x, p in ((wide, r"\n\n"), (wide, r"[.!?][ \t\n]"), (inner, r"[ \t\n]")))
    return f"CASE WHEN {part} <> '' THEN 10 * ({low} - 1 + length({part})) + 3 WHEN {told} <> '' THEN 10 * ({low} - 1 + length({told})) + 2 WHEN {white} <> '' THEN 10 * ({low} + length({white})) + 1 ELSE 10 * ({high}) END"


def _next(end: str) -> str:
    """Where the piece after one that ends there begins."""
    head = f"regexp_extract(substr(text, {end} - 150, 151), '(?s)^(.*?[ \\t\\n])[^ \\t\\n]', 1)"
    return f"CASE WHEN {head} <> '' THEN {end} - 151 + length({head}) ELSE {end} - 150 END"


ITEMS = r"""t AS (
  SELECT 'section' AS origin, extract_id AS item_id, (n - 1)::INTEGER AS section_no, sections[n].text AS text
  FROM (SELECT extract_id, sections, unnest(range(1, len(sections) + 1)) AS n FROM extracted_documents)
  UNION ALL SELECT 'result', result_id, 0, text FROM search_results),
big AS (SELECT * FROM t WHERE length(text) > 1200)"""
CONVERSATIONS = r"""m AS (SELECT id, lower(regexp_replace(session_id, '^\s+|\s+$', '', 'g')) AS session,
    lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) AS role, received_at, content,
    TRY_CAST(CASE WHEN regexp_matches(trim(created_at), '^\d{4}-\d\d-\d\d[T ]\d\d:\d\d') THEN
      CASE WHEN regexp_matches(trim(created_at), '(Z|[+-]\d\d:?\d\d)$') THEN trim(created_at) ELSE trim(created_at) || 'Z' END END AS TIMESTAMPTZ) AS ts,
    coalesce(regexp_matches(content, '\S'), false) AS said
  FROM messages),
d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST, ts DESC NULLS LAST, session DESC NULLS LAST, role DESC NULLS LAST, said DESC, content DESC NULLS LAST) = 1),
r AS (SELECT *, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 END AS code FROM d
      WHERE session IN (SELECT lower(trim(id)) FROM chat_sessions)),
o AS (SELECT *, row_number() OVER w AS turn, lag(code) OVER w AS before, lead(code) OVER w AS after
      FROM r WINDOW w AS (PARTITION BY session ORDER BY ts, code, id)),
g AS (SELECT session FROM o GROUP BY session HAVING bool_and(coalesce(ts IS NOT NULL AND code IS NOT NULL AND said
        AND CASE WHEN turn = 1 THEN code IN (0, 1) WHEN code = 1 THEN before IN (0, 2) WHEN code = 2 THEN before = 1 ELSE false END
        AND (after IS NOT NULL OR code = 2), false)))"""
# cuts are sought again with one more piece whenever a target has no room or the last piece is too long
LOW, HIGH, TARGET, REACH = "greatest(start + 150, target - reach)", "least(target + reach, start + 1200, n)", "(2 * n * k + pieces) // (2 * pieces)", "greatest(1, least(262, n // (3 * pieces)))"

ORACLES = {
    "p1_classes": rf"""
WITH x AS (SELECT text, min(chunk_key) AS class_key, count(*) AS copies, {WORDS} AS ws FROM chunks WHERE text IS NOT NULL GROUP BY text),
t AS (SELECT DISTINCT class_key, array_to_string(ws[i : i + 4], ' ') AS run FROM (SELECT class_key, ws, unnest(range(1, len(ws) - 3)) AS i FROM x WHERE len(ws) >= 5)),
n AS (SELECT class_key, count(*) AS n FROM t GROUP BY 1),
o AS (SELECT a.class_key AS x, b.class_key AS y, count(*) AS shared FROM t a JOIN t b ON a.run = b.run AND a.class_key <> b.class_key GROUP BY 1, 2),
l AS (SELECT x AS class_key, count(*) AS links FROM o JOIN n na ON na.class_key = x JOIN n nb ON nb.class_key = y WHERE shared >= 0.8 * (na.n + nb.n - shared) - 1e-9 GROUP BY 1)
SELECT c.chunk_key, x.class_key, x.copies, coalesce(links, 0) AS links FROM chunks c JOIN x USING (text) LEFT JOIN l ON l.class_key = x.class_key
""",
    "p2_turns": f"WITH {CONVERSATIONS} SELECT session AS session_id, turn::INTEGER AS turn_no, role, content FROM o WHERE session IN (FROM g)",
    "p4_balanced": f"""
WITH RECURSIVE {ITEMS}, go AS (
  SELECT origin, item_id, section_no, text, length(text) AS n, greatest(2, (length(text) - 150 + 1049) // 1050) AS pieces, 1 AS k, 0::BIGINT AS start, []::BIGINT[] AS ends, []::BIGINT[] AS begins, false AS done FROM big
  UNION ALL
  SELECT origin, item_id, section_no, text, n, CASE WHEN fits THEN pieces ELSE pieces + 1 END, CASE WHEN fits THEN k + 1 ELSE 1 END, CASE WHEN fits THEN onward ELSE 0 END,
    CASE WHEN fits THEN list_append(ends, stop) ELSE [] END, CASE WHEN fits THEN list_append(begins, start) ELSE [] END, fits AND k = pieces
  FROM (SELECT *, CASE WHEN k = pieces THEN n - start <= 1200 ELSE high > low END AS fits, CASE WHEN k = pieces THEN n ELSE stop_ END AS stop, CASE WHEN k < pieces AND high > low THEN {_next('stop_')} ELSE 0 END AS onward
    FROM (SELECT *, CASE WHEN near % 10 >= later % 10 AND abs(near // 10 - target) <= abs(later // 10 - target) AND target > low THEN near // 10 ELSE later // 10 END AS stop_
      FROM (SELECT *, CASE WHEN high > low THEN {_after('low', 'high')} END AS later, CASE WHEN high > low AND target > low THEN {_after('low', 'least(high, target)')} END AS near
        FROM (SELECT *, {LOW} AS low, {HIGH} AS high FROM (SELECT *, {TARGET} AS target, {REACH} AS reach FROM go WHERE NOT done))))))
SELECT origin, item_id, section_no, p::INTEGER AS piece_no, begins[p]::INTEGER AS start_pos, ends[p]::INTEGER AS end_pos FROM (SELECT *, unnest(range(1, len(ends) + 1)) AS p FROM go WHERE done)
""",
    "p7_cleaned": rf"""
WITH d AS (SELECT doc_id, text, {WORDS} AS ws, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS raw, string_split_regex(text, '[\p{{L}}\p{{N}}]+') AS seps FROM documents),
g AS (SELECT DISTINCT array_to_string(ws[k : k + 11], ' ') AS run FROM (SELECT ws, unnest(range(1, len(ws) - 10)) AS k FROM (SELECT {WORDS} AS ws FROM eval_items))),
h AS (SELECT doc_id, k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM d) WHERE array_to_string(ws[k : k + 11], ' ') IN (FROM g)),
j AS (SELECT DISTINCT doc_id, unnest(range(k, k + 12)) AS k FROM h),
s AS (SELECT doc_id, count(*) AS leaked, count(*) FILTER (new) AS spans, list(k) AS ks FROM (SELECT doc_id, k, coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k) <> k - 1, true) AS new FROM j) GROUP BY 1),
c AS (SELECT doc_id, string_agg(CASE WHEN list_contains(ks, i) AND list_contains(ks, i - 1) THEN '' ELSE seps[i] END || CASE WHEN i > len(raw) OR list_contains(ks, i) THEN '' ELSE raw[i] END, '' ORDER BY i) AS text
  FROM (SELECT doc_id, raw, seps, ks, unnest(range(1, len(raw) + 2)) AS i FROM d JOIN s USING (doc_id)) GROUP BY 1)
SELECT doc_id, coalesce(spans, 0)::INTEGER AS spans, coalesce(leaked, 0)::INTEGER AS leaked_words, coalesce(len(ws), 0)::INTEGER AS words, coalesce(leaked > 0.5 * len(ws), false) AS dropped,
  CASE WHEN leaked IS NULL THEN d.text WHEN leaked <= 0.5 * len(ws) THEN c.text END AS text FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    "p1_found": rf"""
WITH w AS (SELECT chunk_key, {WORDS} AS ws FROM chunks WHERE text IS NOT NULL),
t AS (SELECT DISTINCT chunk_key, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
      FROM (SELECT chunk_key, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 20)),
n AS (SELECT chunk_key, count(*) AS n FROM t GROUP BY 1),
o AS (SELECT a.chunk_key AS x, b.chunk_key AS y, count(*) AS shared
      FROM t a JOIN t b ON a.tri = b.tri AND a.chunk_key < b.chunk_key GROUP BY 1, 2)
SELECT x AS chunk_a, y AS chunk_b FROM o JOIN n na ON na.chunk_key = x JOIN n nb ON nb.chunk_key = y
WHERE shared * 2 >= na.n + nb.n - shared
""",
    "p2_found": f"WITH {CONVERSATIONS} SELECT session AS session_id, turn::INTEGER AS turn_no, id AS message_id FROM o WHERE session IN (FROM g)",
    "p3_found": r"""
WITH e AS (SELECT chunk_key, unnest(CASE WHEN json_valid(entities) AND json_type(entities) = 'ARRAY' THEN json_extract(entities, '$[*]') END) AS x FROM chunks),
i AS (SELECT DISTINCT 'entities' AS field, chunk_key, trim(regexp_replace(lower(x ->> '$.name'), '\s+', ' ', 'g')) AS item FROM e
      WHERE json_type(x) = 'OBJECT' AND json_type(x, '$.name') = 'VARCHAR'
      UNION SELECT 'concept_tags', chunk_key, lower(regexp_replace(t, '^\s+|\s+$', '', 'g')) FROM (SELECT chunk_key, unnest(string_split(concept_tags, ',')) AS t FROM chunks)),
k AS (SELECT * FROM i WHERE item <> ''),
n AS (SELECT field, count(DISTINCT chunk_key) AS n FROM k GROUP BY 1),
c AS (SELECT field, item, count(*) AS c FROM k GROUP BY 1, 2),
p AS (SELECT a.field, a.item AS item_a, b.item AS item_b, count(*) AS shared
      FROM k a JOIN k b ON a.field = b.field AND a.chunk_key = b.chunk_key AND a.item < b.item GROUP BY ALL)
SELECT p.field, item_a, item_b FROM p JOIN n USING (field) JOIN c a ON a.field = p.field AND a.item = item_a JOIN c b ON b.field = p.field AND b.item = item_b
WHERE shared >= 4 AND n.n * shared >= 8 * a.c * b.c
""",
    "p4_found": f"WITH RECURSIVE {ITEMS}," + r"""
cut AS (
  SELECT origin, item_id, section_no, text, 0 AS piece, 0 AS s, 0 AS e, 0 AS nxt FROM big
  UNION ALL
  SELECT origin, item_id, section_no, text, piece + 1, nxt, z,
    CASE WHEN z >= length(text) THEN -1 ELSE
      CASE WHEN regexp_extract(substr(text, z - 150, 151), '(?s)^(.*?[ \t\n])[^ \t\n]', 1) <> ''
        THEN z - 151 + length(regexp_extract(substr(text, z - 150, 151), '(?s)^(.*?[ \t\n])[^ \t\n]', 1)) ELSE z - 150 END END
  FROM (SELECT *, CASE WHEN length(text) - nxt <= 1200 THEN length(text)
      WHEN regexp_matches(substr(text, nxt + 600, 601), '\n\n') THEN nxt + 599 + length(regexp_extract(substr(text, nxt + 600, 601), '(?s)^.*\n\n'))
      WHEN regexp_matches(substr(text, nxt + 600, 601), '[.!?][ \t\n]') THEN nxt + 599 + length(regexp_extract(substr(text, nxt + 600, 601), '(?s)^.*[.!?][ \t\n]'))
      WHEN regexp_matches(substr(text, nxt + 601, 600), '[ \t\n]') THEN nxt + 600 + length(regexp_extract(substr(text, nxt + 601, 600), '(?s)^.*[ \t\n]'))
      ELSE nxt + 1200 END AS z FROM cut WHERE nxt >= 0))
SELECT origin, item_id, section_no, piece::INTEGER AS piece_no, s::INTEGER AS start_pos, e::INTEGER AS end_pos FROM cut WHERE piece > 0
""",
    "p7_found": rf"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents), i AS (SELECT item_id, {WORDS} AS ws FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(ws[k : k + 11], ' ') AS run FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM i)),
h AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 11], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (run)
""",
}
