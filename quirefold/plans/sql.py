"""DuckDB forms of the core queries."""

from __future__ import annotations

import re

from quirefold.functions.sentences import ABBREVIATIONS, EDGES

#: White space as in quirefold.constants, in RE2's spelling.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WS = WS.replace("[", "[^", 1)

BASE = f"""
docs AS (
  SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM document_records WHERE doc_id IS NOT NULL)
  WHERE rn = 1
),
pg AS (
  SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY line_no) AS rn FROM page_records
    WHERE doc_id IS NOT NULL AND page_index IS NOT NULL)
  WHERE rn = 1 AND doc_id IN (SELECT doc_id FROM docs)
),
judged AS (
  SELECT *, text IS NULL OR NOT regexp_matches(text, '{NON_WS}') AS blank,
         CASE WHEN coalesce(needs_ocr, false) THEN 'needs_ocr'
              WHEN text IS NULL OR NOT regexp_matches(text, '{NON_WS}') THEN 'empty_text' END AS reason
  FROM pg
),
usable AS (SELECT *, len(regexp_extract_all(text, '{NON_WS}+')) AS n_words FROM judged WHERE reason IS NULL)"""


def _runs(source: str, key: str, text: str = "text") -> str:
    """Word runs with offsets: (key.., s, e, w) for words only, w counted from 0."""
    return f"""
r0 AS (SELECT {key}, regexp_extract_all({text}, '({NON_WS}+|{WS}+)') AS rs FROM {source}),
r1 AS (SELECT {key}, unnest(rs) AS r, unnest(range(len(rs))) AS i FROM r0),
r2 AS (SELECT {key}, r, i, sum(length(r)) OVER (PARTITION BY {key} ORDER BY i) AS e FROM r1),
words AS (SELECT {key}, CAST(e - length(r) AS BIGINT) AS s, CAST(e AS BIGINT) AS e,
                 row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS w
          FROM r2 WHERE regexp_matches(r, '^{NON_WS}'))"""


def _windows(key: str, size: int, step: int) -> str:
    return f"""
n AS (SELECT {key}, count(*) AS n FROM words GROUP BY {key}),
wins AS (SELECT {key}, n, unnest(range(CAST(1 + ceil(greatest(n - {size}, 0) / {step}.0) AS BIGINT))) AS k FROM n),
cut AS (
  SELECT {", ".join("x." + c for c in key.split(", "))}, k, a.s, b.e, least(k * {step} + {size}, n) - k * {step} AS token_count
  FROM wins x
  JOIN words a ON {" AND ".join(f"a.{c} = x.{c}" for c in key.split(", "))} AND a.w = k * {step}
  JOIN words b ON {" AND ".join(f"b.{c} = x.{c}" for c in key.split(", "))} AND b.w = least(k * {step} + {size}, n) - 1
)"""


_NUMBERED = """
SELECT printf('%s::c%04d', doc_id, chunk_index) AS chunk_id, doc_id, chunk_index, token_count, CAST(0 AS BIGINT) AS span_no, page_index,
       s AS char_start, e AS char_end
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, k) - 1 AS chunk_index FROM cut)"""


def _fixed(size: int, overlap: int) -> str:
    key = "doc_id, page_index"
    return f"WITH {BASE}, {_runs('usable', key)}, {_windows(key, size, size - overlap)} {_NUMBERED}"


_SENTENCES = f"""
lead0 AS (SELECT *, length(text) - length(regexp_replace(text, '^{WS}+', '')) AS lead,
                 regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS body FROM usable),
m0 AS (SELECT doc_id, page_index, lead, string_split(regexp_replace(body, '([.!?])({WS}+)', '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1)) AS rs FROM lead0),
m1 AS (SELECT doc_id, page_index, lead, unnest(rs) AS r, unnest(range(len(rs))) AS i FROM m0),
m2 AS (SELECT *, lead + sum(length(r)) OVER (PARTITION BY doc_id, page_index ORDER BY i) AS e FROM m1),
sents AS (
  SELECT doc_id, page_index, i // 2 AS n, CAST(e - length(r) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, len(regexp_extract_all(r, '{NON_WS}+')) AS t
  FROM m2 WHERE i % 2 = 0
)"""


def _packs(most: int, overlap: int) -> str:
    """Packs as the orbit of sentence 0 under the next-start function, where no
    sentence is over the budget; those that are come out as word windows."""
    return f"""
WITH RECURSIVE {BASE}, {_SENTENCES},
b0 AS (SELECT *, sum(t) OVER (PARTITION BY doc_id, page_index ORDER BY n) AS after FROM sents),
bounds AS (
  SELECT doc_id, page_index, n, after - t AS b FROM b0
  UNION ALL SELECT doc_id, page_index, max(n) + 1, max(after) FROM b0 GROUP BY doc_id, page_index
),
j0 AS (SELECT doc_id, page_index, n, b,
              max(n) OVER (PARTITION BY doc_id, page_index ORDER BY b RANGE BETWEEN CURRENT ROW AND {most} FOLLOWING) AS j,
              min(n) OVER (PARTITION BY doc_id, page_index ORDER BY b RANGE BETWEEN {overlap} PRECEDING AND CURRENT ROW) AS kk FROM bounds),
nxt AS (
  SELECT s.doc_id, s.page_index, s.n, s.t, x.j, s.s, s.e,
         CASE WHEN s.t > {most} THEN s.n + 1 WHEN {overlap} = 0 THEN x.j ELSE greatest(y.kk, s.n + 1) END AS nx
  FROM sents s JOIN j0 x USING (doc_id, page_index, n)
  LEFT JOIN j0 y ON y.doc_id = s.doc_id AND y.page_index = s.page_index AND y.n = x.j
),
orbit AS (
  SELECT doc_id, page_index, n, nx FROM nxt WHERE n = 0
  UNION ALL
  SELECT o.doc_id, o.page_index, q.n, q.nx FROM orbit o JOIN nxt q ON q.doc_id = o.doc_id AND q.page_index = o.page_index AND q.n = o.nx
),
packs AS (
  SELECT o.doc_id, o.page_index, o.n, q.s, z.e, q.t, 0 AS sub
  FROM orbit o JOIN nxt q USING (doc_id, page_index, n) JOIN sents z ON z.doc_id = o.doc_id AND z.page_index = o.page_index AND z.n = q.j - 1
  WHERE q.t <= {most}
),
big AS (SELECT o.doc_id, o.page_index, o.n, q.s AS base, substring(u.text, q.s + 1, q.e - q.s) AS text
        FROM orbit o JOIN nxt q USING (doc_id, page_index, n) JOIN usable u USING (doc_id, page_index) WHERE q.t > {most}),
{_runs("big", "doc_id, page_index, n, base")},
{_windows("doc_id, page_index, n, base", most, most - overlap).replace("n AS (SELECT", "cnt AS (SELECT", 1).replace("count(*) AS n ", "count(*) AS c ").replace("base, n, unnest", "base, c, unnest").replace("greatest(n - ", "greatest(c - ").replace("FROM n)", "FROM cnt)").replace(f"+ {most}, n)", f"+ {most}, c)")},
every AS (
  SELECT doc_id, page_index, n, s, e, 0 AS sub FROM packs
  UNION ALL SELECT doc_id, page_index, n, base + s, base + e, k FROM cut
),
counted AS (SELECT x.*, len(regexp_extract_all(substring(u.text, x.s + 1, x.e - x.s), '{NON_WS}+')) AS token_count
            FROM every x JOIN usable u USING (doc_id, page_index))
SELECT printf('%s::c%04d', doc_id, chunk_index) AS chunk_id, doc_id, chunk_index, token_count, CAST(0 AS BIGINT) AS span_no, page_index,
       CAST(s AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, n, sub) - 1 AS chunk_index FROM counted)"""


_SECTIONS = """
entries AS (
  SELECT doc_id, page_count, e.text AS title, e.level AS level, e.page_index AS page, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM (SELECT doc_id, page_count, unnest(toc) AS e, unnest(range(len(toc))) AS pos FROM docs) WHERE e.page_index IS NOT NULL
),
chain AS (
  SELECT a.doc_id, a.i, b.i AS j, b.title
  FROM entries a JOIN entries b ON a.doc_id = b.doc_id AND b.i <= a.i
  WHERE b.i = a.i OR b.level < (SELECT min(c.level) FROM entries c WHERE c.doc_id = a.doc_id AND c.i > b.i AND c.i <= a.i)
),
paths AS (SELECT doc_id, i, string_agg(title, ' > ' ORDER BY j) AS path FROM chain GROUP BY doc_id, i),
upto AS (SELECT d.doc_id, greatest(coalesce(any_value(d.page_count), 0), max(p.page_index) + 1) AS upper FROM docs d JOIN pg p USING (doc_id) GROUP BY d.doc_id),
ranges AS (
  SELECT e.doc_id, e.i, greatest(e.page, 0) AS lo, coalesce(lead(e.page) OVER (PARTITION BY e.doc_id ORDER BY e.i), u.upper) AS hi
  FROM entries e JOIN upto u USING (doc_id)
),
sections AS (
  SELECT p.doc_id, p.page_index, arg_max(x.path, r.i) AS section_path
  FROM (SELECT DISTINCT doc_id, page_index FROM pg) p JOIN ranges r ON r.doc_id = p.doc_id AND r.lo <= p.page_index AND p.page_index < r.hi
  JOIN paths x ON x.doc_id = r.doc_id AND x.i = r.i
  GROUP BY p.doc_id, p.page_index
)"""

_STREAM = """
lines AS (
  SELECT line_no, 'document' AS kind, doc_id, CAST(NULL AS BIGINT) AS page_index FROM document_records
  UNION ALL SELECT line_no, 'page', doc_id, page_index FROM page_records
),
seen AS (
  SELECT row_number() OVER (ORDER BY line_no) AS stream_line, *,
         last_value(CASE WHEN kind = 'document' THEN doc_id END IGNORE NULLS) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS owner,
         max(CASE WHEN kind = 'document' THEN line_no END) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS owner_line
  FROM lines
)"""

_STREAM_CHUNKS = f"""
named AS (SELECT s.*, d.stream_line AS document_line FROM seen s LEFT JOIN seen d ON d.line_no = s.owner_line AND d.kind = 'document'),
own AS (
  SELECT n.document_line, n.stream_line, p.* FROM named n JOIN page_records p USING (line_no)
  WHERE n.kind = 'page' AND n.owner = n.doc_id
),
fit AS (SELECT *, len(regexp_extract_all(text, '{NON_WS}+')) AS token_count FROM own WHERE NOT needs_ocr AND regexp_matches(text, '{NON_WS}')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_line ORDER BY page_index, stream_line) - 1 AS chunk_index FROM fit)"""

ORACLES = {
    "q01_page_chunks": f"""WITH {BASE} SELECT printf('%s::c%04d', doc_id, chunk_index) AS chunk_id, doc_id, chunk_index, page_index, n_words AS token_count, text
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS chunk_index FROM usable)""",
    "q02_word_offsets": f"WITH {BASE}, {_runs('pg', 'doc_id, page_index')} SELECT doc_id, page_index, w AS token_no, s AS char_start, e AS char_end FROM words",
    "q03_token_count": f"SELECT line_no, len(regexp_extract_all(text, '{NON_WS}+')) AS token_count, NOT regexp_matches(text, '{NON_WS}') AS blank FROM page_records",
    "q04_fixed_tiles": _fixed(64, 0),
    "q05_fixed_sliding": _fixed(64, 16),
    "q25_file_tokenizer": _fixed(64, 16),
    "q06_fixed_cross_page": f"""WITH {BASE},
whole AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_index) AS text FROM usable GROUP BY doc_id),
seg AS (SELECT doc_id, page_index, length(text) AS len, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM usable),
{_runs("whole", "doc_id")}, {_windows("doc_id", 64, 64)},
hit AS (SELECT c.doc_id, k, token_count, page_index, greatest(c.s, off) - off AS a, least(c.e, off + len) - off AS b
        FROM cut c JOIN seg g ON g.doc_id = c.doc_id AND g.off < c.e AND c.s < g.off + g.len)
SELECT printf('%s::c%04d', doc_id, k) AS chunk_id, doc_id, k AS chunk_index, token_count, row_number() OVER (PARTITION BY doc_id, k ORDER BY page_index) - 1 AS span_no,
       page_index, CAST(a AS BIGINT) AS char_start, CAST(b AS BIGINT) AS char_end FROM hit""",
    "q07_paragraphs": f"""WITH {BASE},
m0 AS (SELECT doc_id, page_index, string_split(regexp_replace(text, '(\\n\\n+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS rs FROM pg WHERE text <> ''),
m1 AS (SELECT doc_id, page_index, unnest(rs) AS r, unnest(range(len(rs))) AS i FROM m0),
m2 AS (SELECT *, sum(length(r)) OVER (PARTITION BY doc_id, page_index ORDER BY i) AS e FROM m1)
SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY i) - 1 AS paragraph_no, CAST(e - length(r) AS BIGINT) AS char_start, CAST(e AS BIGINT) AS char_end
FROM m2 WHERE i % 2 = 0 AND r <> ''""",
    "q08_sentence_spans": f"WITH {BASE.replace('WHERE reason IS NULL', 'WHERE NOT blank')}, {_SENTENCES} SELECT doc_id, page_index, n AS sentence_no, s AS char_start, e AS char_end FROM sents",
    "q08b_sentence_counts": f"""SELECT line_no, CASE WHEN NOT regexp_matches(text, '{NON_WS}') THEN 0 ELSE
  len(string_split(regexp_replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))) END AS sentences FROM page_records""",
    "q09_sentence_pack": _packs(64, 0),
    "q10_sentence_overlap": _packs(64, 24),
    "q12_section_index": f"WITH {BASE}, {_SECTIONS} SELECT doc_id, page_index, section_path FROM sections",
    "q12b_section_groups": f"""WITH {BASE}, {_SECTIONS},
p AS (SELECT doc_id, page_index, coalesce(section_path, '') AS path FROM pg LEFT JOIN sections USING (doc_id, page_index)),
c AS (SELECT *, CASE WHEN path = lag(path) OVER (PARTITION BY doc_id ORDER BY page_index) THEN 0 ELSE 1 END AS new FROM p)
SELECT doc_id, page_index, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS BIGINT) AS section_no FROM c""",
    "q15_ocr_reasons": f"WITH {BASE} SELECT doc_id, page_index, reason AS under_skip, CASE WHEN blank THEN 'empty_text' END AS under_include FROM judged",
    "q16_ocr_include": f"""WITH {BASE} SELECT printf('%s::c%04d', doc_id, chunk_index) AS chunk_id, doc_id, chunk_index, page_index, token_count
FROM (SELECT *, len(regexp_extract_all(text, '{NON_WS}+')) AS token_count, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS chunk_index FROM judged WHERE NOT blank)""",
    "q17_skipped_pages": f"""WITH {BASE} SELECT doc_id, page_index, reason FROM judged WHERE reason IS NOT NULL
UNION ALL SELECT DISTINCT doc_id, page_index, 'invalid_record' FROM page_records WHERE doc_id IS NOT NULL AND page_index IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM docs)""",
    "q18_orphans": f"WITH {_STREAM} SELECT doc_id, page_index, stream_line FROM seen WHERE kind = 'page' AND owner IS DISTINCT FROM doc_id",
    "q18b_positional_pages": f"""WITH {_STREAM}
SELECT s.doc_id, s.page_index, s.stream_line, d.stream_line AS document_line FROM seen s JOIN seen d ON d.line_no = s.owner_line AND d.kind = 'document'
WHERE s.kind = 'page' AND s.owner = s.doc_id""",
    "q19_run_stats": f"""WITH {BASE} SELECT (SELECT count(*) FROM docs) AS documents_seen, (SELECT count(*) FROM pg) AS pages_seen,
(SELECT count(*) FROM usable) AS pages_chunked, (SELECT count(*) FROM usable) AS chunks_written, CAST(0 AS BIGINT) AS invalid_lines""",
    "q20_source_doc_join": f"""WITH {BASE} SELECT printf('%s::c%04d', u.doc_id, u.chunk_index) AS chunk_id, coalesce(d.metadata.Title, '') AS title, d.source_path
FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS chunk_index FROM usable) u JOIN docs d USING (doc_id)""",
    "q21_chunk_ids": f"""WITH {BASE}, n AS (SELECT doc_id, CAST(sum(ceil(n_words / 64.0)) AS BIGINT) AS n FROM usable GROUP BY doc_id),
x AS (SELECT doc_id, unnest(range(n)) AS chunk_index FROM n) SELECT doc_id, chunk_index, printf('%s::c%04d', doc_id, chunk_index) AS chunk_id FROM x""",
    "q22_jsonl_roundtrip": f"""WITH {_STREAM}, {_STREAM_CHUNKS}
SELECT printf('%s::c%04d', doc_id, chunk_index) AS chunk_id, doc_id, chunk_index, token_count, length(text) AS char_end FROM numbered""",
    "q23_manifest": f"""WITH {_STREAM}, {_STREAM_CHUNKS}, orphan AS (SELECT count(*) AS n FROM seen WHERE kind = 'page' AND owner IS DISTINCT FROM doc_id)
SELECT 'manifest' AS record_type, '2024-03-01T00:00:00+00:00' AS created_at, 'page' AS strategy, (SELECT count(*) FROM document_records) AS documents_seen,
       (SELECT count(*) FROM own) AS pages_seen, (SELECT count(*) FROM fit) AS pages_chunked, (SELECT count(*) FROM fit) AS chunks_written, n AS invalid_lines,
       (SELECT count(*) FROM own) - (SELECT count(*) FROM fit) + n AS skipped FROM orphan""",
    "q24_invalid_lines": f"""WITH {_STREAM} SELECT stream_line AS line_no FROM seen WHERE line_no % 7 = 0 OR line_no % 11 = 0""",
    "q26_dedup_page_sort": f"WITH {BASE} SELECT doc_id, page_index, line_no, length(text) AS n_chars FROM pg",
    "q28_views": f"""WITH {BASE}, {_SECTIONS} SELECT CASE WHEN section_path IS NULL THEN 0 ELSE len(string_split(section_path, ' > ')) END AS depth, count(*) AS chunks, CAST(sum(n_words) AS BIGINT) AS tokens
FROM usable LEFT JOIN sections USING (doc_id, page_index) GROUP BY 1""",
}
ORACLES["q27_streaming_assembly"] = f"""WITH {BASE} SELECT printf('%s::c%04d', doc_id, chunk_index) AS chunk_id, doc_id, chunk_index, n_words AS token_count
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1 AS chunk_index FROM usable)"""

_SEGMENTS = """
seg AS (SELECT doc_id, page_index, length(text) AS len, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g FROM pg),
whole AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_index) AS text FROM pg GROUP BY doc_id)"""
ORACLES["q29_unit_segments"] = f"WITH {BASE}, {_SEGMENTS} SELECT doc_id, page_index, g AS g_start, g + len AS g_end FROM seg"
ORACLES["q30_unit_texts"] = f"WITH {BASE}, {_SEGMENTS} SELECT doc_id, text FROM whole"
ORACLES["q31_token_windows"] = f"""WITH {BASE}, n AS (SELECT doc_id, page_index, len(regexp_extract_all(text, '{NON_WS}+')) AS n_tokens FROM pg),
w AS (SELECT *, unnest(range(CAST(1 + ceil(greatest(n_tokens - 64, 0) / 48.0) AS BIGINT))) AS window_no FROM n WHERE n_tokens > 0)
SELECT doc_id, page_index, n_tokens, window_no, window_no * 48 AS first_token, least(window_no * 48 + 64, n_tokens) - 1 AS last_token FROM w"""
ORACLES["q32_range_spans"] = f"""WITH {BASE}, {_SEGMENTS},
r AS (SELECT doc_id, length(text) AS size, unnest(range(length(text) // 500 + 1)) AS range_no FROM whole),
x AS (SELECT doc_id, range_no, range_no * 500 AS s, least(range_no * 500 + 500, size) AS e FROM r)
SELECT doc_id, range_no, page_index, greatest(s, g) - g AS char_start, least(e, g + len) - g AS char_end
FROM x JOIN seg USING (doc_id) WHERE g < e AND s < g + len"""


def _greedy(name: str, parts: str, key: str, most: int) -> str:
    """Neighbouring parts (key.., n, s, e, t) joined up to ``most``: (key.., n, s, e, t); larger parts stand alone."""
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in key.split(", "))
    return f"""
{name}_b0 AS (SELECT *, sum(t) OVER (PARTITION BY {key} ORDER BY n) AS after FROM {parts}),
{name}_b AS (
  SELECT {key}, n, after - t AS b FROM {name}_b0
  UNION ALL SELECT {key}, max(n) + 1, max(after) FROM {name}_b0 GROUP BY {key}
),
{name}_j AS (SELECT {key}, n, max(n) OVER (PARTITION BY {key} ORDER BY b RANGE BETWEEN CURRENT ROW AND {most} FOLLOWING) AS j FROM {name}_b),
{name}_x AS (SELECT p.*, CASE WHEN p.t > {most} THEN p.n + 1 ELSE greatest(j.j, p.n + 1) END AS nx FROM {parts} p JOIN {name}_j j ON {on("p", "j")} AND p.n = j.n),
{name}_o AS (
  SELECT {key}, n, nx FROM {name}_x WHERE n = 0
  UNION ALL SELECT {", ".join("o." + c for c in key.split(", "))}, x.n, x.nx FROM {name}_o o JOIN {name}_x x ON {on("o", "x")} AND x.n = o.nx
),
{name} AS (
  SELECT {", ".join("o." + c for c in key.split(", "))}, o.n, x.s, z.e, x.t FROM {name}_o o
  JOIN {name}_x x ON {on("o", "x")} AND x.n = o.n JOIN {name}_x z ON {on("o", "z")} AND z.n = o.nx - 1
)"""


def _cascade(units: str, key: str, most: int) -> str:
    """The recursive cascade over units (key.., text): pieces (key.., s, e, token_count)."""
    cols = key.split(", ")
    of = lambda a: ", ".join(f"{a}.{c}" for c in cols)
    count = lambda x: f"len(regexp_extract_all({x}, '{NON_WS}+'))"
    runs_key = f"{key}, base"
    return f"""
sized AS (SELECT {key}, text, {count("text")} AS n_all FROM {units}),
over AS (SELECT * FROM sized WHERE n_all > {most}),
pa0 AS (SELECT {key}, string_split(regexp_replace(text, '(\\n\\n+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS rs FROM over),
pa1 AS (SELECT {key}, unnest(rs) AS r, unnest(range(len(rs))) AS i FROM pa0),
pa2 AS (SELECT *, CAST(sum(length(r)) OVER (PARTITION BY {key} ORDER BY i) AS BIGINT) AS e FROM pa1),
paras AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS n, e - length(r) AS s, e, {count("r")} AS t FROM pa2 WHERE i % 2 = 0 AND r <> ''),
several AS (SELECT p.* FROM paras p JOIN (SELECT {key} FROM paras GROUP BY {key} HAVING count(*) > 1) m USING ({key})),
{_greedy("ppack", "several", key, most)},
regions AS (
  SELECT {key}, s AS base, e AS stop FROM ppack WHERE t > {most}
  UNION ALL SELECT {key}, 0, length(text) FROM over JOIN (SELECT {key} FROM paras GROUP BY {key} HAVING count(*) = 1) USING ({key})
),
rt AS (SELECT {of("r")}, base, stop, substring(text, base + 1, stop - base) AS text FROM regions r JOIN over u USING ({key})),
se0 AS (SELECT {runs_key}, base + length(text) - length(regexp_replace(text, '^{WS}+', '')) AS lead,
               string_split(regexp_replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '([.!?])({WS}+)', '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1)) AS rs FROM rt),
se1 AS (SELECT {runs_key}, lead, unnest(rs) AS r, unnest(range(len(rs))) AS i FROM se0),
se2 AS (SELECT *, CAST(lead + sum(length(r)) OVER (PARTITION BY {runs_key} ORDER BY i) AS BIGINT) AS e FROM se1),
sens AS (SELECT {runs_key}, i // 2 AS n, e - length(r) AS s, e, {count("r")} AS t FROM se2 WHERE i % 2 = 0),
many AS (SELECT p.* FROM sens p JOIN (SELECT {runs_key} FROM sens GROUP BY {runs_key} HAVING count(*) > 1) m USING ({runs_key})),
{_greedy("spack", "many", runs_key, most)},
wordy AS (
  SELECT {key}, s AS base, e AS stop FROM spack WHERE t > {most}
  UNION ALL SELECT {key}, base, stop FROM regions JOIN (SELECT {runs_key} FROM sens GROUP BY {runs_key} HAVING count(*) = 1) USING ({runs_key})
),
wt AS (SELECT {of("r")}, base, substring(text, base + 1, stop - base) AS text FROM wordy r JOIN over u USING ({key})),
{_runs("wt", runs_key)},
{_windows(runs_key, most, most).replace("n AS (SELECT", "cnt AS (SELECT", 1).replace("FROM n)", "FROM cnt)")},
ranges0 AS (
  SELECT {key}, 0 AS s, length(text) AS e FROM sized WHERE n_all <= {most}
  UNION ALL SELECT {key}, s, e FROM ppack WHERE t <= {most}
  UNION ALL SELECT {key}, s, e FROM spack WHERE t <= {most}
  UNION ALL SELECT {key}, base + s, base + e FROM cut
),
pieces AS (
  SELECT * FROM (SELECT {of("r")}, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, {count("substring(text, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT))")} AS token_count FROM ranges0 r JOIN sized u USING ({key}))
  WHERE token_count > 0
)"""


#: Usable pages with their section path, numbered, in units: runs of one path, or whole documents.
_PATHED = """
pathed AS (
  SELECT u.doc_id, u.page_index, u.text, u.n_words, coalesce(section_path, '') AS path, row_number() OVER (PARTITION BY u.doc_id ORDER BY u.page_index) AS i
  FROM usable u LEFT JOIN sections USING (doc_id, page_index)
)"""


def _joined(unit: str) -> str:
    """Texts of the units of ``member`` (doc_id, unit, page_index, text, path) and where each page lies in them."""
    return f"""
member AS (SELECT *, {unit} AS unit FROM pathed),
unit_texts AS (SELECT doc_id, unit, string_agg(text, chr(10) || chr(10) ORDER BY page_index) AS text FROM member GROUP BY doc_id, unit),
seg AS (SELECT doc_id, unit, page_index, path, length(text) AS len, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id, unit ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS g FROM member),
{_cascade("unit_texts", "doc_id, unit", 64)},
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit, s) AS i FROM pieces),
hit AS (SELECT p.doc_id, p.i, p.token_count, g.page_index, g.path, greatest(p.s, g.g) - g.g AS a, least(p.e, g.g + g.len) - g.g AS b
        FROM numbered p JOIN seg g ON g.doc_id = p.doc_id AND g.unit = p.unit AND g.g < p.e AND p.s < g.g + g.len),
piece AS (SELECT doc_id, i, any_value(token_count) AS n, arg_min(path, page_index) AS path FROM hit GROUP BY doc_id, i)"""


def _merged(source: str, least: int, most: int) -> str:
    """Pieces (doc_id, i from 1, n, path) with the number c of the chunk that holds each."""
    return f"""
fold AS (
  SELECT doc_id, i, CAST(0 AS BIGINT) AS c, CAST(n AS BIGINT) AS held, path FROM {source} WHERE i = 1
  UNION ALL
  SELECT f.doc_id, p.i, f.c + CASE WHEN p.n < {least} AND p.path = f.path AND f.held + p.n <= {most} THEN 0 ELSE 1 END,
         CASE WHEN p.n < {least} AND p.path = f.path AND f.held + p.n <= {most} THEN f.held + p.n ELSE p.n END,
         CASE WHEN p.n < {least} AND p.path = f.path AND f.held + p.n <= {most} THEN f.path ELSE p.path END
  FROM fold f JOIN {source} p ON p.doc_id = f.doc_id AND p.i = f.i + 1
)"""


_SPAN_ROWS = """
SELECT printf('%s::c%04d', doc_id, c) AS chunk_id, doc_id, c AS chunk_index, CAST(token_count AS BIGINT) AS token_count,
       row_number() OVER (PARTITION BY doc_id, c ORDER BY page_index) - 1 AS span_no, page_index, CAST(a AS BIGINT) AS char_start, CAST(b AS BIGINT) AS char_end"""

ORACLES["q11_recursive"] = f"""WITH RECURSIVE {BASE}, {_cascade("usable", "doc_id, page_index", 64)},
x AS (SELECT doc_id, page_index, s AS a, e AS b, token_count, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, s) - 1 AS c FROM pieces) {_SPAN_ROWS} FROM x"""
ORACLES["q13_section_chunks"] = f"""WITH RECURSIVE {BASE}, {_SECTIONS}, {_PATHED.replace("row_number() OVER (PARTITION BY u.doc_id ORDER BY u.page_index) AS i", "lag(coalesce(section_path, '')) OVER (PARTITION BY u.doc_id ORDER BY u.page_index) AS before")},
{_joined("sum(CASE WHEN path = before THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY page_index)")},
x AS (SELECT h.doc_id, i - 1 AS c, h.token_count, h.page_index, a, b, p.path FROM hit h JOIN piece p USING (doc_id, i)) {_SPAN_ROWS}, path AS section_path FROM x"""
ORACLES["q11b_recursive_cross_page"] = f"""WITH RECURSIVE {BASE}, {_SECTIONS}, {_PATHED}, {_joined("0")}, {_merged("piece", 8, 72)},
x AS (SELECT h.doc_id, f.c, h.page_index, min(a) AS a, max(b) AS b FROM hit h JOIN fold f USING (doc_id, i) GROUP BY h.doc_id, f.c, h.page_index),
y AS (SELECT x.*, t.token_count FROM x JOIN (SELECT doc_id, c, max(held) AS token_count FROM fold GROUP BY doc_id, c) t USING (doc_id, c)) {_SPAN_ROWS} FROM y"""
ORACLES["q14_runt_merge"] = f"""WITH RECURSIVE {BASE}, {_SECTIONS}, {_PATHED}, piece AS (SELECT doc_id, i, n_words AS n, path FROM pathed), {_merged("piece", 32, 96)},
y AS (SELECT f.doc_id, f.c, p.page_index, 0 AS a, length(p.text) AS b, t.token_count FROM fold f JOIN pathed p USING (doc_id, i)
      JOIN (SELECT doc_id, c, max(held) AS token_count FROM fold GROUP BY doc_id, c) t USING (doc_id, c)) {_SPAN_ROWS} FROM y"""
ORACLES["q33_rebuilt_texts"] = f"""WITH {BASE}, {_SECTIONS}, {_PATHED},
w AS (SELECT doc_id, CAST(sum(n_words) AS BIGINT) AS n FROM pathed GROUP BY doc_id),
first AS (SELECT doc_id, path, CAST(sum(n_words) OVER (PARTITION BY doc_id ORDER BY page_index) AS BIGINT) AS upto, n_words FROM pathed),
runt AS (
  SELECT w.doc_id FROM w JOIN first a ON a.doc_id = w.doc_id AND a.upto > (n // 64) * 64 AND a.upto - a.n_words <= (n // 64) * 64
  JOIN first b ON b.doc_id = w.doc_id AND b.upto > (n // 64 - 1) * 64 AND b.upto - b.n_words <= (n // 64 - 1) * 64
  WHERE n > 64 AND n % 64 BETWEEN 1 AND 7 AND a.path = b.path
)
SELECT true AS equal, CAST(sum(ceil(n / 64.0)) - (SELECT count(*) FROM runt) AS BIGINT) AS chunks FROM w"""


_MARKS = "[\"''”’)\\]]"
_ABBREVIATIONS = ", ".join(f"'{w}'" for w in sorted(ABBREVIATIONS))
ORACLES["q34_default_sentences"] = f"""WITH {BASE.replace("WHERE reason IS NULL", "WHERE NOT blank")},
lead0 AS (SELECT *, length(text) - length(regexp_replace(text, '^{WS}+', '')) AS lead, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS body FROM usable),
m0 AS (SELECT doc_id, page_index, lead, string_split(regexp_replace(body, '([.!?]{_MARKS}*)({WS}+)', '\\1' || chr(1) || '\\2' || chr(1), 'g'), chr(1)) AS rs FROM lead0),
m1 AS (SELECT doc_id, page_index, lead, unnest(rs) AS r, unnest(range(len(rs))) AS i FROM m0),
m2 AS (SELECT *, CAST(lead + sum(length(r)) OVER (PARTITION BY doc_id, page_index ORDER BY i) AS BIGINT) AS e FROM m1),
m3 AS (SELECT *, lag(r) OVER (PARTITION BY doc_id, page_index ORDER BY i) AS before FROM m2 WHERE i % 2 = 0),
m4 AS (SELECT *, lower(regexp_replace(regexp_extract(right(regexp_replace(before, '\\.{_MARKS}*$', ''), 24), '{NON_WS}+$'), '^[(\\["''“‘]+', '')) AS word,
              regexp_matches(before, '\\.{_MARKS}*$') AS stop FROM m3),
m5 AS (SELECT *, CASE WHEN before IS NULL OR regexp_matches(r, '^\\p{{Ll}}') OR stop AND (word IN ({_ABBREVIATIONS}) OR regexp_matches(word, '^\\p{{L}}$')) THEN 0 ELSE 1 END AS new FROM m4),
m6 AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id, page_index ORDER BY i) AS BIGINT) AS sentence_no FROM m5)
SELECT doc_id, page_index, sentence_no, min(e - length(r)) AS char_start, max(e) AS char_end FROM m6 GROUP BY ALL"""

_EDGES = "[" + re.escape(EDGES).replace("'", "''") + "]"
ORACLES["q35_learnt_abbreviations"] = f"""WITH w0 AS (SELECT unnest(string_split_regex(text, '{WS}+')) AS w FROM page_records),
w1 AS (SELECT regexp_replace(lower(w), '^{_EDGES}+|{_EDGES}+$', '', 'g') AS w FROM w0 WHERE w <> ''),
w2 AS (SELECT regexp_replace(w, '\\.$', '') AS word, w LIKE '%.' AS dot FROM w1),
c AS (SELECT word, count_if(dot) AS dotted, count_if(NOT dot) AS plain FROM w2 WHERE regexp_matches(word, '^\\p{{L}}[\\p{{L}}.]*$') GROUP BY word),
t AS (SELECT sum(dotted) / sum(dotted + plain) AS p FROM c),
l AS (SELECT *, length(replace(word, '.', '')) AS letters FROM c, t WHERE dotted > 0),
s AS (SELECT *, 2 * (dotted * ln(0.99) + plain * ln(0.01) - dotted * ln(p) - plain * ln(1 - p)) * exp(-letters) * (length(word) - letters + 1) / pow(letters, plain) AS score FROM l)
SELECT word, CAST(dotted AS BIGINT) AS dotted, CAST(plain AS BIGINT) AS plain FROM s WHERE score >= 0.3"""
ORACLES["q36_strict_refusal"] = f"WITH {_STREAM} SELECT min(stream_line) AS line_no FROM seen WHERE line_no % 13 = 12"
ORACLES["q37_scan_refusal"] = f"""WITH {BASE} SELECT 'document ''' || doc_id || ''', page ' || page_index || ': text recognition is needed' AS message
FROM pg WHERE needs_ocr ORDER BY doc_id, page_index LIMIT 1"""
ORACLES["q38_single_file"] = f"""WITH {_STREAM}, {_STREAM_CHUNKS},
x AS (SELECT row_number() OVER (ORDER BY document_line, chunk_index) - 1 AS pos, 'chunk' AS record_type, printf('%s::c%04d', doc_id, chunk_index) AS chunk_id FROM numbered)
SELECT * FROM x UNION ALL SELECT count(*), 'manifest', NULL FROM x"""
ORACLES["q39_skip_order"] = f"""WITH {_STREAM}, {_STREAM_CHUNKS},
d AS (SELECT stream_line, lead(stream_line) OVER (ORDER BY stream_line) AS closes FROM seen WHERE kind = 'document'),
x AS (
  SELECT stream_line AS place, 0 AS g, 0 AS document_line, page_index, stream_line, doc_id, 'invalid_record' AS reason FROM seen WHERE kind = 'page' AND owner IS DISTINCT FROM doc_id
  UNION ALL
  SELECT coalesce(d.closes, 4611686018427387904), 1, o.document_line, o.page_index, o.stream_line, o.doc_id, CASE WHEN needs_ocr THEN 'needs_ocr' ELSE 'empty_text' END
  FROM own o JOIN d ON d.stream_line = o.document_line WHERE needs_ocr OR NOT regexp_matches(text, '{NON_WS}')
)
SELECT row_number() OVER (ORDER BY place, g, document_line, page_index, stream_line) - 1 AS pos, doc_id, page_index, reason FROM x"""
ORACLES["q40_late_pages"] = """WITH top AS (SELECT greatest((SELECT max(line_no) FROM document_records), (SELECT max(line_no) FROM page_records)) + 1 AS top),
p AS (SELECT doc_id, page_index, min(line_no * 4 // top) AS k FROM page_records, top GROUP BY doc_id, page_index),
c AS (SELECT doc_id, k, max(page_count) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM (SELECT doc_id, line_no * 4 // top AS k, max(page_count) AS page_count FROM document_records, top GROUP BY 1, 2)),
steps AS (SELECT doc_id, k FROM p UNION SELECT doc_id, k FROM c),
state AS (SELECT s.doc_id, s.k, (SELECT max(n) FROM c WHERE c.doc_id = s.doc_id AND c.k <= s.k) AS n, (SELECT count(*) FROM p WHERE p.doc_id = s.doc_id AND p.k <= s.k) AS pages FROM steps s),
whole AS (SELECT doc_id, min(k) AS k FROM state WHERE n IS NOT NULL AND n <= pages GROUP BY doc_id)
SELECT w.doc_id, 'closed' AS event, CAST(NULL AS BIGINT) AS page_index, s.pages FROM whole w JOIN state s USING (doc_id, k)
UNION ALL
SELECT p.doc_id, 'late', p.page_index, (SELECT count(*) FROM p q WHERE q.doc_id = p.doc_id AND q.k < p.k) FROM p JOIN whole w ON w.doc_id = p.doc_id AND p.k > w.k"""
ORACLES["q41_lax_values"] = f"""WITH {_STREAM} SELECT s.doc_id, s.page_index, p.needs_ocr, s.stream_line FROM seen s JOIN page_records p USING (line_no) WHERE s.kind = 'page' AND s.owner = s.doc_id"""
ORACLES["q42_repeated_pages"] = f"""WITH {BASE},
u AS (SELECT *, len(regexp_extract_all(text, '{NON_WS}+')) AS token_count FROM page_records
      WHERE doc_id IN (SELECT doc_id FROM docs) AND page_index IS NOT NULL AND NOT coalesce(needs_ocr, false) AND regexp_matches(text, '{NON_WS}'))
SELECT printf('%s::c%04d', doc_id, chunk_index) AS chunk_id, doc_id, chunk_index, page_index, token_count
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, line_no) - 1 AS chunk_index FROM u)"""
