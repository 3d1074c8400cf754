"""SQL (DuckDB) of the queries that SQL can express over whole tables."""

from __future__ import annotations

from corvine.llm.line_dedup import SQL as LINE_DEDUP
from corvine.llm.quality_rules import DEFAULT_RULES, STOP_WORDS
from corvine.llm.warc import LEAST_REVISIT

_W = r"[^\x20\x09-\x0D]"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= {LEAST_REVISIT} THEN min(page_id) OVER (PARTITION BY d) END AS one FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN one IS NOT NULL AND one <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN one <> page_id THEN one END AS refers_to FROM f
"""


def _verdict() -> str:
    tests = [f"{r.measure} >= {float(r.low)}" for r in DEFAULT_RULES if r.low is not None]
    tests += [f"{r.measure} <= {float(r.high)}" for r in DEFAULT_RULES if r.high is not None]
    return " AND ".join(tests)


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_RATIO = "CASE WHEN {1} > 0 THEN CAST({0} AS DOUBLE) / {1} ELSE 0.0 END AS {2}"

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_W}+') AS ws FROM d),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) r(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS dots,
    count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•‣]')) AS bullets
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_W}') GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    coalesce(l.n, 0) AS lines, coalesce(l.dots, 0) AS dots, coalesce(l.bullets, 0) AS bullets, len(regexp_extract_all(text, '\p{{Lu}}')) AS upper,
    len(list_filter(ws, lambda x: list_contains([{_STOPS}], lower(x)))) AS stops
  FROM w LEFT JOIN lines l USING (doc_id) LEFT JOIN cover c USING (doc_id)),
r AS (SELECT *, {_RATIO.format("word_chars", "n_words", "mean_word_chars")}, {_RATIO.format("n_symbols", "n_words", "symbol_ratio")}, {_RATIO.format("stops", "n_words", "stop_ratio")},
    {_RATIO.format("n_dup_lines", "lines", "dup_line_ratio")}, {_RATIO.format("dots", "lines", "ellipsis_line_ratio")}, {_RATIO.format("bullets", "lines", "bullet_line_ratio")},
    {_RATIO.format("upper", "word_chars", "upper_ratio")}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_verdict()} AS kept FROM r
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.i >= 90 * (na.n + nb.n - p.i)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.b FROM reach r JOIN links l ON l.a = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id LEFT JOIN n USING (doc_id)
"""

SQL = {"op7_arc_to_warc": WARC, "op8_line_dedup": LINE_DEDUP, "op9_quality_rules": QUALITY, "op10_ngram_jaccard": NGRAM_JOIN}
