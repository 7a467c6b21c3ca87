"""DuckDB SQL with the results of those queries that SQL can express. Written apart from the operators' plans."""

from __future__ import annotations

import re

from vecscore.llm.licenses import PHRASES, TEMPLATES, block_length, needed
from vecscore.llm.lines import MIN_WORDS
from vecscore.llm.quality import LineLimits
from vecscore.llm.urls import PATTERNS, RULES

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def license_sql(threshold: float = 0.8) -> str:
    words_of = lambda words: f"[{', '.join(f"'{w}'" for w in words)}]::VARCHAR[]"
    rows = []
    for label, must, never, wording in TEMPLATES:
        tokens = sorted(set(wording.split()))
        rows.append(f"('{label}', {words_of(tokens)}, {words_of(must.split())}, {words_of(never.split())}, {needed(tokens, threshold)}, {block_length(wording.split())})")
    phrases = ", ".join(f"('{label}', [{', '.join(f"'{w}'" for w in phrase.split())}])" for phrase, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrase(label, p) AS (VALUES {phrases}),
place AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d WHERE len(w) > 0) x, phrase
  WHERE w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM place GROUP BY doc_id),
template(label, tokens, must, never, need, size) AS (VALUES {', '.join(rows)}),
likely AS (SELECT doc_id, w, template.* FROM d, template WHERE list_has_all(w, must)),
block AS (
  SELECT doc_id, label, tokens, must, never, need, list_distinct(w[i + 1 : i + size]) AS words
  FROM (SELECT *, unnest(range(0, len(w))) AS i FROM likely) WHERE list_contains(tokens, w[i + 1])),
hit AS (
  SELECT doc_id, label, len(list_intersect(words, tokens)) / len(tokens)::DOUBLE AS share
  FROM block WHERE len(list_intersect(words, tokens)) >= need AND list_has_all(words, must) AND NOT list_has_any(words, never)),
label AS (SELECT doc_id, label, 1.0::DOUBLE AS share, true AS is_base FROM place UNION ALL SELECT doc_id, label, share, false FROM hit),
labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM label GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id)
"""


def chat_sql(budget: int = 1024, history: int = 2) -> str:
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (
  SELECT *, row_number() OVER w - 1 AS i, sum(n) OVER w AS p FROM (
    SELECT *, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\x20\x09-\x0D\p{{L}}\p{{N}}]')) + 3 AS n,
      12 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 1 + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 11 AS size FROM raw)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
c AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss,
    max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS sys, max(CASE WHEN i = 0 AND role = 'system' THEN n ELSE 0 END) AS n0, max(CASE WHEN i = 0 THEN size END) AS size0
  FROM t GROUP BY conv_id),
span(conv_id, k, a, b) AS (
  SELECT c.conv_id, 0, CAST(0 AS BIGINT), coalesce((SELECT min(i) FROM t WHERE t.conv_id = c.conv_id AND i > 0 AND p > {budget}), n_turns) FROM c
  UNION ALL
  SELECT s.conv_id, k + 1, s.b, coalesce((SELECT min(t.i) FROM t, t AS f WHERE t.conv_id = s.conv_id AND f.conv_id = s.conv_id AND f.i = s.b AND t.i > s.b AND t.p - f.p + f.n > {budget} - c.n0), n_turns)
  FROM span s JOIN c ON c.conv_id = s.conv_id WHERE s.b < n_turns),
full_span AS (
  SELECT s.*, sys, size0, CASE WHEN k = 0 THEN 0 ELSE (
    SELECT count(*) FROM t WHERE t.conv_id = s.conv_id AND t.i >= s.a - {history} AND t.i < s.a AND t.i >= sys AND e.p - t.p + t.n <= {budget} - n0) END AS h
  FROM span s JOIN c ON c.conv_id = s.conv_id JOIN t e ON e.conv_id = s.conv_id AND e.i = s.b - 1),
size AS (
  SELECT s.conv_id, s.k, any_value(CASE WHEN k > 0 AND sys = 1 THEN size0 ELSE 0 END) + sum(t.size) AS chars
  FROM full_span s JOIN t ON t.conv_id = s.conv_id AND t.i >= s.a - s.h AND t.i < s.b GROUP BY s.conv_id, s.k),
total AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) AS n_windows FROM size GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, CAST(n_windows AS BIGINT) AS n_windows
FROM c JOIN total USING (conv_id)
"""


def quality_sql(limits: LineLimits = LineLimits()) -> str:
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS h, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, source, h, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM line WHERE regexp_matches(l, '{word}') GROUP BY doc_id),
norm AS (SELECT doc_id, source, h, trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS l FROM line),
host AS (SELECT source, count(DISTINCT h) AS n FROM d GROUP BY source),
freq AS (SELECT source, l, count(DISTINCT h) AS n FROM norm WHERE l <> '' GROUP BY source, l),
over AS (SELECT freq.source, l FROM freq JOIN host ON freq.source IS NOT DISTINCT FROM host.source WHERE freq.n > {limits.floor} AND freq.n > {limits.share} * host.n),
gone AS (SELECT doc_id, sum(len(string_split(norm.l, ' '))) AS n FROM norm JOIN over ON norm.l = over.l AND norm.source IS NOT DISTINCT FROM over.source GROUP BY doc_id),
f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (removed_words > 0 AND n_words - removed_words < {limits.min_words} AND n_words - removed_words <= {limits.min_kept_share} * n_words) AS kept, removed_words
FROM f
"""


def line_dedup_sql(min_words: int = MIN_WORDS) -> str:
    return rf"""
WITH line AS (
  SELECT doc_id, l, pos, regexp_extract_all(translate(l, {_AZ}), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
own AS (SELECT doc_id, pos, w, array_to_string(w, ' ') AS k FROM line WHERE len(w) > 0),
class AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM own) WHERE r = 1),
del AS (
  SELECT k, doc_id, pos, p, n, array_to_string(list_concat(w[1 : p - 1], w[p + 1 :]), ' ') AS v
  FROM (SELECT k, doc_id, pos, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS p FROM class WHERE len(w) >= {min_words})),
near AS (
  SELECT k FROM (SELECT k, row_number() OVER (PARTITION BY v, p ORDER BY doc_id, pos) AS r FROM del) WHERE r > 1
  UNION SELECT CASE WHEN (d.doc_id, d.pos) > (c.doc_id, c.pos) THEN d.k ELSE c.k END FROM del d JOIN class c ON d.v = c.k WHERE len(c.w) >= {min_words}),
stay AS (SELECT doc_id, pos FROM class ANTI JOIN near USING (k)),
marked AS (SELECT line.doc_id, line.pos, l, len(w) > 0 AS has_word, stay.pos IS NOT NULL AS kept FROM line LEFT JOIN stay ON line.doc_id = stay.doc_id AND line.pos = stay.pos),
d AS (
  SELECT doc_id, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (has_word AND NOT kept) AS n_removed, string_agg(l, chr(10) ORDER BY pos) FILTER (kept OR NOT has_word) AS t FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CASE WHEN text IS NULL OR n_removed = 0 THEN text WHEN n_removed = n_lines THEN '' ELSE t END AS text
FROM documents JOIN d USING (doc_id)
"""


def url_sql() -> str:
    def regex(pattern: str) -> str:
        parts = [re.escape(p).replace("'", "''") for p in re.split(r"(\*\*|\*)", pattern)]
        return "".join("(?s:.*)" if p == r"\*\*" else r"[^\x01\x02]*" if p == r"\*" else p.replace("\x01", r"\x01").replace("\x02", r"\x02") for p in parts)

    bad = " OR ".join(f"regexp_full_match(canon, '{regex(p)}')" for p in PATTERNS)
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return rf"""
WITH a AS (SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS after FROM a),
c AS (SELECT page_id, host, regexp_extract(after, '^[^?#]*') AS path, substr(after, length(regexp_extract(after, '^[^?#]*')) + 1) AS tail FROM b),
d AS (SELECT *, '.' || host || chr(1) || path || CASE WHEN tail <> '' THEN chr(2) || lower(tail) ELSE '' END AS canon FROM c),
rules(verdict, h, p) AS (VALUES {rules}),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM d, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host = '' OR {bad} THEN 'block' ELSE 'allow' END) AS verdict FROM d LEFT JOIN fits USING (page_id)
"""


ORACLE_SQL = {
    "op1_license_scan": license_sql(),
    "op2_chat_formatting": chat_sql(),
    "op5_line_dedup": line_dedup_sql(),
    "op7_quality_rules": quality_sql(),
    "op9_url_filter": url_sql(),
}
