"""DuckDB SQL for the registered queries that SQL can express on whole tables."""

from __future__ import annotations

import re

from . import chat
from . import quality_rules as Q

#: CRC-32 by its byte table, folded over the bytes of the text.
SHARDING = """
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
bytes AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
rows_ AS (
  SELECT doc_id, source, CAST(length(h) // 2 + 16 AS BIGINT) AS size,
    xor(list_reduce(list_transform(range(1, length(h), 2), lambda k: CAST('0x' || h[k:k + 1] AS BIGINT)),
      lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32,
    coalesce('s' || source, 'n') AS src, CAST('0x' || substr(md5('mixture:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key
  FROM bytes, tab),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY src ORDER BY key, doc_id) - CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY src) AS frac, count(*) OVER () AS total FROM rows_),
placed AS (SELECT *, row_number() OVER (ORDER BY frac, key, src, doc_id) - 1 AS place FROM ranked),
cut AS (SELECT *, CAST(place * 40 // total AS INT) AS shard FROM placed)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, shard, CAST(place - (shard * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM cut"""

NEAR_COPIES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
least_ AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON least_.a = d.doc_id"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda k: array_to_string(w[k:k + 12], ' '))) AS s, least(13, len(w)) AS l FROM items WHERE len(w) > 0),
lengths AS (SELECT DISTINCT l FROM windows),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS k, w FROM docs, lengths WHERE len(w) >= l),
found AS (SELECT g.doc_id, g.k, g.l, x.item_id FROM (SELECT doc_id, l, k, array_to_string(w[k:k + l - 1], ' ') AS s FROM grams) g JOIN windows x ON x.l = g.l AND x.s = g.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + l)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

_CONTROL = Q.RiskControl()
_RUNGS = ", ".join(f"('{rule}', {i}, CAST({c} AS DOUBLE))" for rule, ladder in _CONTROL.ladders.items() for i, c in enumerate(ladder))
_RISK = f"CAST({_CONTROL.rule_risk} AS DOUBLE)"
#: Sums of binomial terms by logarithms of factorials.
_CDF = f"""CASE WHEN n_good = 0 OR k >= n_good * {_RISK} THEN CAST(1 AS DOUBLE) ELSE least(1, list_sum(list_transform(range(k + 1), lambda j:
  exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({_RISK}) + (n_good - j) * ln(1 - {_RISK}))))) END"""
_RULES = ", ".join(f"max(cut) FILTER (WHERE rule = '{r}') AS cut_{r}" for r in _CONTROL.ladders)
_REJECTED = " OR ".join(f"coalesce({r} >= cut_{r}, false)" for r in _CONTROL.ladders)
RULES = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS c FROM grams),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM again WHERE c > 1) GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    coalesce(lines.n, 0) AS n_lines, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)),
m AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
  CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_ratio, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio FROM s),
labelled AS (SELECT m.*, good FROM m JOIN (SELECT doc_id, min(quality) = 1 AS good FROM labels GROUP BY 1) USING (doc_id)),
rungs(rule, i, c) AS (VALUES {_RUNGS}),
values_ AS (UNPIVOT (SELECT doc_id, lang, good, symbol_ratio, dup_line_ratio, upper_ratio, repeat_ratio FROM labelled) ON symbol_ratio, dup_line_ratio, upper_ratio, repeat_ratio INTO NAME rule VALUE v),
goods AS (SELECT lang, count(*) FILTER (WHERE good) AS n_good, count(*) OVER () AS strata FROM labelled GROUP BY 1),
tried AS (SELECT x.lang, x.rule, i, c, count(*) FILTER (WHERE good AND v >= c) AS k, count(*) FILTER (WHERE NOT good AND v >= c) AS b FROM values_ x JOIN rungs USING (rule) GROUP BY 1, 2, 3, 4),
tested AS (SELECT t.*, b - k AS gain, {_CDF} <= CAST({_CONTROL.delta} AS DOUBLE) / ({len(_CONTROL.ladders)} * strata) AS passed FROM tried t JOIN goods g ON g.lang IS NOT DISTINCT FROM t.lang),
walked AS (SELECT *, bool_and(passed) OVER (PARTITION BY lang, rule ORDER BY i) AS on_ FROM tested),
best AS (SELECT lang, rule, arg_max(c, gain * 1000 - i) AS cut FROM walked WHERE on_ AND gain > 0 GROUP BY 1, 2),
cuts AS (SELECT lang, {_RULES} FROM best GROUP BY 1),
judged AS (SELECT m.*, c.* EXCLUDE (lang), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m LEFT JOIN cuts c ON c.lang IS NOT DISTINCT FROM m.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_REJECTED}) AS kept, {", ".join(f"cut_{r}" for r in _CONTROL.ladders)} FROM judged"""

ARCHIVE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS first_ FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN page_id < first_ THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first_ THEN first_ END AS refers_to, true AS digest_ok FROM g"""

#: The marks of the default template.
_MARKS = "|".join(re.escape(c[1:]) for c in chat.Template().controls)
CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
esc AS (SELECT *, regexp_replace(text, '([<\[])(\\*)({_MARKS})', '\1\\\2\3', 'g') AS t, regexp_replace(role, '([<\[])(\\*)({_MARKS})', '\1\\\2\3', 'g') AS r FROM c),
near AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after, row_number() OVER w AS k FROM esc WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
said AS (SELECT *, CASE WHEN before = role THEN '[NEXT]' WHEN role = 'system' THEN '[SYS]' WHEN role = 'user' THEN '[INST]' WHEN role = 'assistant' THEN '<s>' ELSE '[ROLE]' || r || '[TEXT]' END || t
  || CASE WHEN after = role THEN '' WHEN role = 'system' THEN '[/SYS]' WHEN role = 'user' THEN '[/INST]' WHEN role = 'assistant' THEN '</s>' ELSE '[/ROLE]' END AS piece FROM near)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM counts GROUP BY 1, 2),
cells AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1)) // (coalesce(total, 0) + v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN vocabulary USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
whole AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // (total + v) AS q FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY 1, 2)
  JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY 1) USING (lang) JOIN vocabulary USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM cells JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


def _codes(rounds: int = 4) -> str:
    """Rounds of assignment and means, written out; entries and parts are lists of 16 integers or fewer."""
    near = "SELECT id, part, entry, d FROM (SELECT v.id, v.part, c.entry, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d, row_number() OVER (PARTITION BY v.id, v.part ORDER BY d, c.entry) AS r FROM cut v JOIN book{k} c ON c.part = v.part) WHERE r = 1"
    step = """near{k} AS MATERIALIZED ({near}),
mean{k} AS (SELECT part, entry, list(m ORDER BY j) AS x FROM (SELECT part, entry, j, CAST(floor(CAST(sum(y) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT n.part, n.entry, unnest(v.x) AS y, unnest(range(len(v.x))) AS j FROM near{k} n JOIN cut v ON v.id = n.id AND v.part = n.part) GROUP BY 1, 2, 3) GROUP BY 1, 2),
book{next} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m ON m.part = b.part AND m.entry = b.entry)"""
    steps = ",\n".join(step.format(k=k, next=k + 1, near=near.format(k=k)) for k in range(rounds))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT id, part, v[part * len(v) // 4 + 1:(part + 1) * len(v) // 4] AS x FROM kept, range(4) p(part)),
book0 AS MATERIALIZED (SELECT part, id AS entry, x FROM cut WHERE id < 256),
{steps},
last AS MATERIALIZED ({near.format(k=rounds)}),
out AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY 1),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM out JOIN kept USING (id), digest"""


ORACLES = {
    "op11_relational_chat": CHAT,
    "op12_source_divergence": DIVERGENCE,
    "op13_exact_vector_codes": _codes(),
    "op3_stratified_sharding": SHARDING,
    "op6_multi_order_jaccard": NEAR_COPIES,
    "op7_positional_index": CONTAMINATION,
    "op8_risk_controlled_rules": RULES,
    "op9_boundary_chain_warc": ARCHIVE,
}
