"""SQL of the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from palimpsest.llm.fair_mix import EPOCHS, SHARE, WEIGHTS
from palimpsest.llm.positional_index import WINDOW
from palimpsest.llm.quality_rules import BASE, DEFAULT, RULE_NAMES
from palimpsest.llm.warc_chain import BASE32

_WORD = r"[^\x20\x09-\x0D]+"

_RULES = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > 3 * n_words",
    "upper_case_heavy": "n_letters > 0 AND 10 * n_upper > 3 * n_letters",
    "bang_heavy": "10 * n_bangs > 3 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "few_distinct_words": "50 * n_distinct < n_words",
}
_BITS = " + ".join(f"CASE WHEN {_RULES[name]} THEN {1 << k} ELSE 0 END" for k, name in enumerate(RULE_NAMES))

QUALITY_RULES = f"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
tok AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
tri AS (SELECT doc_id, i, word AS a, lead(word, 1) OVER x AS b, lead(word, 2) OVER x AS c FROM tok WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY 1),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
 len(lines) AS n_lines, length(regexp_replace(text, '[^A-Za-z\\x{{80}}-\\x{{10FFFF}}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs, len(list_distinct(w)) AS n_distinct FROM t LEFT JOIN rw ON rw.doc_id = t.doc_id),
f AS (SELECT *, ({_BITS})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {BASE.mask} <> 0 AS base_failed, failures & {BASE.mask | DEFAULT.mask} = 0 AS kept, failures FROM f
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
b AS MATERIALIZED (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark) WHERE len(w) > 0),
iw AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b) WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT doc_id, item_id, i, dw.n FROM dw JOIN iw ON iw.k = dw.k AND iw.n = dw.n),
p AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""

FAIR_MIX = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':7') AS k FROM documents),
q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [{', '.join(f'{float(w)}' for w in WEIGHTS)}]::DOUBLE[] AS ws, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY 1),
w AS (SELECT source, source_size, n, ws[(n % {len(WEIGHTS)} + 1)::INT] AS weight, {float(EPOCHS)}::DOUBLE * source_size AS lim FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY lim / weight, n) AS place FROM w),
l AS (SELECT *, ({SHARE}::DOUBLE * (SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(lim) OVER p, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER p, 0)) AS level FROM o WINDOW p AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, place) AS fill FROM l WHERE level * weight <= lim),
t AS (SELECT source, source_size, CASE WHEN fill IS NULL THEN lim ELSE least(lim, fill * weight) END AS target FROM l, (SELECT (SELECT fill FROM f) AS fill))
SELECT q.doc_id, q.size, t.source_size, t.target, ({' + '.join(f'greatest(0, least(q.size, floor(t.target)::BIGINT - {e} * t.source_size - q.start))' for e in range(EPOCHS))})::BIGINT AS taken FROM q JOIN t ON t.source IS NOT DISTINCT FROM q.source
"""

_LETTERS = " || ".join(f"substr('{BASE32}', ((('0x' || substr(h, {5 * k + 1}, 5))::INT >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM f
"""

HARD_NEGATIVES = """
WITH r AS (
  SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
