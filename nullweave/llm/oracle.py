"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from .quality_rules import Limits

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"""t AS (SELECT doc_id, text, regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM t)"""


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""WITH rules(h, p, v) AS (VALUES {listed}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, coalesce(arg_max(v, length(h || p)), 'allow') AS verdict
FROM s LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path"""


def substring_dedup(size: int = 50) -> str:
    return f"""WITH {_WORDS.format(text="text")},
win AS (SELECT doc_id, n, word, i, CASE WHEN i <= n - {size - 1} THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) END AS win FROM w),
hit AS (SELECT doc_id, word, i, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS hit FROM win),
cut AS (SELECT doc_id, word, i, max(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) AS gone FROM hit),
kept AS (SELECT doc_id, count(*) AS n, sum(gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM cut GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)"""


def jaccard_join(n: int = 4, percent: int = 85) -> str:
    return f"""WITH RECURSIVE {_WORDS.format(text=_LOWER.format("text"))},
s AS (SELECT DISTINCT doc_id, CASE WHEN n < {n} AND i = 1 THEN string_agg(word, ' ') OVER own WHEN i <= n - {n - 1} THEN string_agg(word, ' ') OVER (own ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) END AS g
  FROM w WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
s2 AS (SELECT DISTINCT doc_id, CASE WHEN n < {n} THEN word_all ELSE g END AS g FROM (SELECT s.doc_id, s.g, t.n, t.word_all FROM s JOIN (SELECT doc_id, len(ws) AS n, array_to_string(ws, ' ') AS word_all FROM t) t USING (doc_id)) WHERE n < {n} OR g IS NOT NULL),
size AS (SELECT doc_id, count(*) AS n FROM s2 GROUP BY doc_id),
link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s2 a JOIN s2 b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN size p ON p.doc_id = a.doc_id JOIN size q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= {percent} * (p.n + q.n - count(*))),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, CAST(coalesce(max(size.n), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id"""


def quality_rules(limits: Limits = Limits()) -> str:
    lengths = sorted({8, *limits.ngrams})
    wins = ", ".join(f"CASE WHEN i <= n - {k - 1} THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) END AS g{k}" for k in lengths)
    seen = ", ".join(f"CASE WHEN g{k} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{k}) > 1 THEN 1 ELSE 0 END AS m{k}" for k in lengths)
    inside = ", ".join(f"max(m{k}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS c{k}" for k in lengths)
    sums = ", ".join(f"CAST(sum(c{k} * length(word)) AS BIGINT) AS dup_chars_{k}" for k in lengths)
    over = " AND ".join([f"n_dup_lines <= {limits.duplicate_lines} * greatest(n_lines, 1)", f"dup_line_chars <= {limits.duplicate_line_chars} * greatest(word_chars, 1)", f"n_symbols <= {limits.symbols} * greatest(word_chars, 1)"] + [f"dup_chars_{k} <= {v} * greatest(word_chars, 1)" for k, v in limits.ngrams.items()])
    named = ", ".join(f"coalesce(dup_chars_{k}, 0) AS dup_chars_{k}" for k in lengths)
    return rf"""WITH {_WORDS.format(text="text")},
g AS (SELECT doc_id, word, i, {wins} FROM w), m AS (SELECT doc_id, word, i, {seen} FROM g), c AS (SELECT doc_id, word, {inside} FROM m),
per AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, CAST(sum(c8) AS BIGINT) AS n_repeat_words, {sums} FROM c GROUP BY doc_id),
l AS (SELECT doc_id, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS again
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ln AS (SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (again > 1) AS BIGINT) AS n_dup_lines, CAST(coalesce(sum(chars) FILTER (again > 1), 0) AS BIGINT) AS dup_line_chars FROM l GROUP BY doc_id),
a AS (SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {named}, coalesce(n_lines, 0) AS n_lines
  FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (SELECT *, n_words < {limits.min_words} OR 100 * n_repeat_words > {limits.repeat_words_percent} * n_words AS base_failed FROM a)
SELECT * EXCLUDE (n_lines), NOT base_failed AND {over} AS kept FROM f"""
