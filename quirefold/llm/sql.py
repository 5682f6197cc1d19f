"""DuckDB forms of the training-text queries that SQL can express."""

from __future__ import annotations

#: White space as in quirefold.constants, in RE2's spelling.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

NON_WS = WS.replace("[", "[^", 1)

_REPEATED = rf"""
pos AS (
  SELECT line_no, doc_id, page_index, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS line_pos
  FROM page_records WHERE doc_id IS NOT NULL AND page_index IS NOT NULL AND text IS NOT NULL
),
keyed AS (
  SELECT line_no, doc_id, page_index, line_pos,
         regexp_replace(lower(regexp_replace(regexp_replace(line, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g')),
                        '\p{{Nd}}+', '0', 'g') AS k
  FROM pos
),
bad AS (
  SELECT doc_id, k FROM keyed WHERE k <> '' GROUP BY doc_id, k HAVING count(DISTINCT page_index) >= 5
)"""

ORACLES = {
    "p2_found": f"""
WITH r AS (
  SELECT 'page' AS kind, line_no AS row_key, text FROM page_records
  UNION ALL SELECT 'chunk', chunk_no, text FROM chunk_records
)
SELECT r.kind, r.row_key FROM r JOIN split_limits s ON s.record_kind = r.kind
WHERE (length(text) > s.max_chars OR len(regexp_extract_all(text, '{NON_WS}+')) > s.max_words)""",
    "p4_found": f"WITH {_REPEATED} SELECT line_no, line_pos FROM keyed JOIN bad USING (doc_id, k)",
    "p4_clean_pages": f"""WITH {_REPEATED},
hits AS (SELECT line_no, list(line_pos) AS gone FROM keyed JOIN bad USING (doc_id, k) GROUP BY line_no)
SELECT p.line_no,
       CASE WHEN h.gone IS NULL THEN p.text ELSE
         array_to_string(list_filter(string_split(p.text, chr(10)), lambda l, i: NOT list_contains(h.gone, i - 1)), chr(10)) END AS text,
       CAST(coalesce(len(h.gone), 0) AS BIGINT) AS removed_lines
FROM page_records p LEFT JOIN hits h USING (line_no)""",
}

#: Brute force over the shingle sets; whole tables, since the sets of the test
#: tables are small enough to join on the shingle.
ORACLES["p1_found"] = f"""
WITH chunk AS (SELECT DISTINCT chunk_id AS id, lower(text) AS t FROM chunk_records WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT id, regexp_extract_all(t, '{NON_WS}+') AS w FROM chunk),
s AS (
  SELECT DISTINCT 'chunk' AS kind, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM w WHERE len(w) >= 30
  UNION ALL
  SELECT DISTINCT 'path', doc_id, unnest(list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3)))
  FROM (SELECT DISTINCT doc_id, lower(source_path) AS p FROM document_records WHERE doc_id IS NOT NULL AND source_path IS NOT NULL)
),
n AS (SELECT kind, id, count(*) AS n FROM s GROUP BY kind, id),
b AS (SELECT a.kind, a.id AS id_a, b.id AS id_b, count(*) AS m FROM s a JOIN s b ON a.kind = b.kind AND a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT b.kind, id_a, id_b FROM b JOIN n x ON x.kind = b.kind AND x.id = id_a JOIN n y ON y.kind = b.kind AND y.id = id_b
WHERE m / (x.n + y.n - m)::DOUBLE >= CASE b.kind WHEN 'chunk' THEN 0.5 ELSE 0.6 END"""


#: Rules that hold for every right answer: the counts of what breaks them are 0.
ORACLES["p2_audit"] = f"""
WITH r AS (
  SELECT 'page' AS kind, line_no AS row_key, text FROM page_records
  UNION ALL SELECT 'chunk', chunk_no, text FROM chunk_records
)
SELECT r.kind, count(DISTINCT r.row_key) AS divided, CAST(0 AS BIGINT) AS too_many_words, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS wrong_count, CAST(0 AS BIGINT) AS wrong_text, CAST(0 AS BIGINT) AS left_out, CAST(0 AS BIGINT) AS shared_too_much, CAST(0 AS BIGINT) AS wrong_spans
FROM r JOIN split_limits s ON s.record_kind = r.kind
WHERE (length(text) > s.max_chars OR len(regexp_extract_all(text, '{NON_WS}+')) > s.max_words) GROUP BY r.kind"""
ORACLES["p6_audit"] = """SELECT container_kind, CAST(0 AS BIGINT) AS over_full, true AS well_filled, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS needlessly_divided, CAST(0 AS BIGINT) AS lost_tokens, CAST(0 AS BIGINT) AS lost_items FROM container_sizes"""
ORACLES["p7_audit"] = """SELECT mix_name, count(*) AS sources, CAST(0 AS BIGINT) AS used_too_often, CAST(0 AS BIGINT) AS off_share, CAST(0 AS BIGINT) AS wrong_source, CAST(0 AS BIGINT) AS listed_twice
FROM source_targets GROUP BY mix_name"""
