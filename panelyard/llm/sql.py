"""DuckDB SQL of the operators that SQL can state: certified quality rules, repeated bytes, near-duplicate
classes, mined url rules, repeated words, and the base spans of the secret scan.

Each text states the contract directly, over whole tables: all windows, all pairs of sets that share
a shingle, a closure over the links, all frequent token sets. It shares no method with the operators.
"""

from __future__ import annotations

from .quality import RULES as QUALITY_RULES
from .quality import rule_sets
from .url_rules import RULES as URL_RULES

#: op5: bytes as pairs of hexadecimal digits, in order.
REPEATED_BYTES = r"""
WITH bytes AS (
  SELECT doc_id, unnest(b) AS b, generate_subscripts(b, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(hex(encode(coalesce("text", ''))), '..') AS b FROM documents)
), windows AS (
  SELECT doc_id, i, string_agg(b, '') OVER f AS s, count(*) OVER f AS n
  FROM bytes WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
), first_seen AS (
  SELECT s, min(doc_id) AS first_doc FROM windows WHERE n = 50 GROUP BY s HAVING min(doc_id) < max(doc_id)
), starts AS (
  SELECT w.doc_id, w.i FROM windows w JOIN first_seen f ON w.s = f.s WHERE w.n = 50 AND f.first_doc < w.doc_id
), marked AS (
  SELECT b.doc_id, b.i, b.b, coalesce(count(s.i) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM bytes b LEFT JOIN starts s ON b.doc_id = s.doc_id AND b.i = s.i
), runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked
), sums AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
    string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents d LEFT JOIN sums USING (doc_id)
"""

#: op6: equal sets are one node; the closure runs over nodes.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS (
  SELECT doc_id, len(w) AS total, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), windows AS (
  SELECT doc_id, total, i, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n
  FROM placed WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), shingles AS (
  SELECT DISTINCT doc_id, s FROM windows WHERE n = 5 OR (total < 5 AND i = 1)
), sets AS (
  SELECT doc_id, list(s ORDER BY s) AS members FROM shingles GROUP BY doc_id
), named AS (
  SELECT doc_id, len(members) AS n, min(doc_id) OVER (PARTITION BY members) AS node FROM sets
), nodes AS (
  SELECT s, node, n FROM named JOIN shingles USING (doc_id) WHERE doc_id = node
), links AS (
  SELECT a.node AS u, b.node AS v FROM nodes a JOIN nodes b ON a.s = b.s AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT DISTINCT node AS u, node AS v FROM named
  UNION
  SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
), classes AS (
  SELECT u AS node, min(v) AS component_id FROM reach GROUP BY u
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
  coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN named n USING (doc_id) LEFT JOIN classes c USING (node)
"""

#: op10: a window is told apart by its words, joined by one space.
REPEATED_WORDS = r"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n
  FROM words WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS turn FROM windows WHERE n = 20
), marked AS (
  SELECT w.doc_id, w.i, w.word, count(r.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM words w LEFT JOIN ranked r ON w.doc_id = r.doc_id AND w.i = r.i AND r.turn > 1
), sums AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN sums USING (doc_id)
"""

_SHARES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_words, 1) * 10",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "word_chars / greatest(n_words, 1)",
    "short_words": "-(word_chars / greatest(n_words, 1))",
}
_SETS = rule_sets(QUALITY_RULES)
_REJECTS = ", ".join("(" + " OR ".join(f"{_SHARES[r]} > ({c})::DOUBLE" for r, c in x.items()) + ")" for x in _SETS)

#: op3: each set of rules is a test in each stratum; Holm's step; the best certified set decides.
QUALITY = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce("text", '') AS t FROM documents
), words AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), windows AS (
  SELECT doc_id, i, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n
  FROM placed WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), twice AS (
  SELECT *, n = 5 AND count(*) OVER (PARTITION BY doc_id, s, n) > 1 AS again FROM windows
), marked AS (
  SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM twice
), repeats AS (
  SELECT doc_id, count(*) FILTER (covered) AS n FROM marked GROUP BY doc_id
), counted AS (
  SELECT doc_id, lang, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN repeats USING (doc_id)
), measured AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{_REJECTS}] AS rejected FROM counted
), trials AS (
  SELECT lang, t, max(quality) AS quality, any_value(base_failed) AS base_failed, any_value(rejected) AS rejected
  FROM measured JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang, t
), judged AS (
  SELECT lang, quality, unnest(rejected) AS r, generate_subscripts(rejected, 1) AS i FROM trials WHERE NOT base_failed
), sums AS (
  SELECT lang, i, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND r) AS g, count(*) FILTER (quality = 0 AND r) AS b
  FROM judged GROUP BY lang, i
), tests AS (
  SELECT *, CASE WHEN g >= n * 0.01::DOUBLE THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(0, g + 1),
    lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.01::DOUBLE) + (n - k) * ln(0.99::DOUBLE)))) END AS p
  FROM sums WHERE n > 0
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY p, lang, i) AS turn, count(*) OVER () AS m FROM tests
), sure AS (
  SELECT *, bool_and(p <= 0.05::DOUBLE / (m - turn + 1)) OVER (ORDER BY turn) AS certified FROM ranked
), of_sets(i, parts, total) AS (
  VALUES {", ".join(f"({i + 1}, {len(x)}, ({sum(x.values())!r})::DOUBLE)" for i, x in enumerate(_SETS))}
), chosen AS (
  SELECT lang, i FROM (SELECT lang, i, row_number() OVER (PARTITION BY lang ORDER BY b DESC, g, parts, total DESC, i DESC) AS turn
    FROM sure JOIN of_sets USING (i) WHERE certified AND b > 0) WHERE turn = 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected[i], false) AS kept
FROM measured LEFT JOIN chosen USING (lang)
"""

_FITS = [f"({i}, '{h}', '{p}', '{v}')" for i, (h, p, v) in enumerate(URL_RULES)]

#: op9: all frequent token sets of bad pages, by growing them a token at a time; a page is blocked if
#: it holds one that is sure enough.
URL_VERDICTS = rf"""
WITH RECURSIVE cuts AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT *, regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1) AS raw FROM cuts
), split AS (
  SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substring(coalesce(rest, ''), length(raw) + 1), '^([^?#]*)', 1) AS path FROM hosts
), tokens AS (
  SELECT page_id, list_distinct(list_filter(
    list_transform(string_split(host, '.'), lambda x: 'host=' || x) || ['domain=' || array_to_string(list_reverse(string_split(host, '.'))[1:2], '.')]
    || list_transform(string_split(path, '/'), lambda x: 'path=' || regexp_replace(x, '[0-9]+', '0', 'g')) || ['type=' || regexp_extract(path, '\.([A-Za-z0-9]{{1,8}})$', 1)]
    || list_transform(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: 'query=' || split_part(x, '=', 1))
    || CASE WHEN instr(url, '#') > 0 THEN ['fragment'] ELSE [] END, lambda x: NOT ends_with(x, '='))) AS own
  FROM split WHERE url IS NOT NULL
), marked AS (
  SELECT doc_id AS page_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), baskets AS (
  SELECT row_number() OVER () AS basket, own, bad FROM split LEFT JOIN tokens USING (page_id) JOIN marked USING (page_id)
), least AS (
  SELECT ceil(greatest(0.002::DOUBLE, 20::DOUBLE / count(*)) * count(*)) AS n FROM baskets
), singles AS (
  SELECT token, list(basket) AS held, list(basket) FILTER (bad) AS bad_held FROM (SELECT basket, bad, unnest(own) AS token FROM baskets)
  GROUP BY token HAVING count(*) FILTER (bad) >= (SELECT n FROM least)
), grown AS (
  SELECT [token] AS items, token AS last, held, bad_held FROM singles
  UNION ALL
  SELECT list_append(items, token), token, list_intersect(g.held, s.held), list_intersect(g.bad_held, s.bad_held)
  FROM grown g JOIN singles s ON s.token > g.last WHERE len(list_intersect(g.bad_held, s.bad_held)) >= (SELECT n FROM least)
), rules AS (
  SELECT items FROM grown WHERE len(bad_held)::DOUBLE / len(held) >= 0.8::DOUBLE
), blocked AS (
  SELECT DISTINCT page_id FROM tokens JOIN rules ON list_has_all(own, items)
), fixed(turn, rule_host, rule_path, verdict) AS (
  VALUES {", ".join(_FITS)}
), found AS (
  SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM split JOIN fixed ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id, host, path
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, CASE WHEN b.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN found f USING (page_id, host, path) LEFT JOIN blocked b ON s.page_id = b.page_id
"""
