"""DuckDB SQL with the same rows as the registered queries, written apart from their plans."""

from __future__ import annotations

from vecscore.operators import cleaning

_VECTORS = """
e AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT id, label, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS v FROM e),
m AS (
  SELECT side, list(x ORDER BY k) AS v FROM (
    SELECT side, k, avg(x) AS x FROM (SELECT label = 0 AS side, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM u) GROUP BY side, k) GROUP BY side),
c AS (SELECT side, [x / sqrt(list_dot_product(v, v)) FOR x IN v] AS v FROM m)
"""
_TO_REFERENCE = "SELECT u.id, 1 - list_dot_product(u.v, c.v) AS distance FROM u, c WHERE u.label <> 0 AND c.side"
_FROM_CORPUS = "SELECT u.id, 1 - list_dot_product(u.v, c.v) AS distance FROM u, c WHERE u.label = 0 AND NOT c.side"
_PAIRS = "SELECT a.id AS corpus_id, b.id AS reference_id, 1 - list_dot_product(a.v, b.v) AS distance FROM u a, u b WHERE a.label <> 0 AND b.label = 0"
_CORNER = "SELECT 1 - list_dot_product(a.v, b.v) AS distance FROM c a, c b WHERE a.side AND NOT b.side"


def _vectors(query: str, with_round: bool = True) -> str:
    return f"WITH {_VECTORS}, q AS ({query}) SELECT * REPLACE (round(distance, 6) AS distance) FROM q" if with_round else f"WITH {_VECTORS} {query}"


def _space(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[ \t\r\n\f\x0B]+', ' ', 'g'), ' ')"


def _ratio(x: str) -> str:
    return rf"(length(regexp_replace({x}, '[^\p{{L}}]', '', 'g')) / greatest(length(regexp_replace({x}, '[ \t\r\n\f\x0B]+', '', 'g')), 1)::DOUBLE)"


def clean_sql(mode: str, policy: str = "keep_title_only") -> str:
    """The cleaner's steps over ``documents`` as common table expressions; the last is ``cleaned``."""
    chars, ratio = cleaning.MODES[mode]
    pattern = lambda own: "(" + "|".join(own) + ")"
    alone = {"keep_title_only": "true", "discard": "false", "conditional": f"length(t) >= {cleaning.TITLE_CHARS} AND {_ratio('t')} >= {cleaning.TITLE_RATIO}"}[policy]
    return rf"""
raw AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, split_part(coalesce(text, ''), chr(10), 1) AS title, substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) AS abstract FROM documents),
s1 AS (SELECT *, {_space('title')} AS t, {_space('abstract')} AS r FROM raw),
s2 AS (SELECT *, {_space("regexp_replace(r, '<[^>]+>', ' ', 'g')")} AS a0 FROM s1),
s3 AS (
  SELECT *, CASE WHEN length(t) > 0 AND starts_with(lower(a0), lower(t)) THEN {_space(r"regexp_replace(substr(a0, length(lower(t)) + 1), '^[ \t\r\n\f\x0B:;,.\-]+', '')")} ELSE a0 END AS a FROM s2),
s4 AS (SELECT *, length(a) AS n, {_ratio('a')} AS share, lower(a) AS low FROM s3),
s5 AS (
  SELECT *, CASE WHEN regexp_matches(low, '{pattern(cleaning.HTML)}') AND n < {2 * chars} THEN 'html_artifact_short'
    WHEN regexp_matches(low, '{pattern(cleaning.BOILERPLATE)}') AND n < {2 * chars} THEN 'boilerplate_short'
    WHEN share < {ratio} THEN 'low_alpha_ratio' WHEN n < {chars} THEN 'too_short'
    WHEN regexp_matches(low, '{pattern(cleaning.PLACEHOLDERS)}') THEN 'placeholder' WHEN a = '' THEN 'empty_after_clean' WHEN r = '' THEN 'missing_abstract' ELSE '' END AS discard_reason FROM s4),
s6 AS (SELECT *, CASE WHEN discard_reason = '' THEN 'Title: ' || t || chr(10) || 'Abstract: ' || a WHEN {alone} THEN 'Title: ' || t END AS text FROM s5),
cleaned AS (
  SELECT *, CASE WHEN discard_reason = '' THEN 'title_abstract' ELSE 'title_only' END AS text_quality, r <> '' AS abstract_raw_present, discard_reason = '' AS abstract_kept, '{mode}' AS cleaning_mode
  FROM s6 WHERE text IS NOT NULL)"""


def _clean(mode: str, policy: str = "keep_title_only") -> str:
    return f"WITH {clean_sql(mode, policy)} SELECT id, md5(text) AS text_md5, text_quality, abstract_raw_present, abstract_kept, discard_reason, cleaning_mode FROM cleaned"


_CURVE = """
s AS (
  SELECT CAST(length(coalesce(text, '')) AS DOUBLE) / (CAST(length(coalesce(text, '')) AS DOUBLE) + 1500e0) AS score, quality AS label
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
g AS (SELECT min(score) AS low, max(score) AS high FROM s),
th AS (SELECT i, CASE WHEN i = 1000 THEN high ELSE low + i * ((high - low) / 1000e0) END AS threshold FROM g, (SELECT unnest(range(0, 1001)) AS i)),
k AS (
  SELECT i, threshold, count(*) FILTER (score > threshold AND label = 1) AS tp, count(*) FILTER (score > threshold AND label <> 1) AS fp, count(*) FILTER (score <= threshold AND label = 1) AS fn
  FROM th, s GROUP BY i, threshold),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall FROM k),
curve AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)
"""
_CURVE_COLUMNS = "round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"
_PLANE = """
p AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
f AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) + 0.1e0 AS a, covar_samp(x, y) AS b, var_samp(y) + 0.1e0 AS d FROM p WHERE label = 0),
area AS (SELECT id, (d * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * d - b * b) AS area_distance FROM p, f WHERE label <> 0)
"""
#: Of whole vectors: the covariance as a list of rows, inverted in place by Gauss-Jordan steps, one dimension each.
_AREA = """
z AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
parts AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM z WHERE label = 0),
mu AS (SELECT list(x ORDER BY k) AS mu, count(*) AS d FROM (SELECT k, avg(x) AS x FROM parts GROUP BY k)),
cov AS (SELECT a.k AS i, b.k AS j, covar_samp(a.x, b.x) + CASE WHEN a.k = b.k THEN 0.1e0 ELSE 0 END AS c FROM parts a JOIN parts b USING (id) GROUP BY a.k, b.k),
sigma AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i)),
step(k, m) AS (
  SELECT 1, m FROM sigma
  UNION ALL
  SELECT k + 1, [CASE WHEN i = k THEN r ELSE [CASE WHEN j = k THEN 0 ELSE m[i][j] END - m[i][k] * r[j] FOR j IN range(1, len(m) + 1)] END FOR i IN range(1, len(m) + 1)]
  FROM (SELECT k, m, [CASE WHEN j = k THEN 1 ELSE m[k][j] END / m[k][k] FOR j IN range(1, len(m) + 1)] AS r FROM step WHERE k <= len(m))),
inverse AS (SELECT m FROM step WHERE k = len(m) + 1),
delta AS (SELECT id, [v[i] - mu[i] FOR i IN range(1, d + 1)] AS x FROM z, mu WHERE label <> 0),
area AS (SELECT id, list_sum([x[i] * list_dot_product(m[i], x) FOR i IN range(1, len(m) + 1)]) AS area_distance FROM delta, inverse)
"""
_REQUESTS = """
line AS (SELECT id, '{"custom_id":"cid","method":"POST","url":"/v1/embeddings","body":{"model":"model-x","input":' || CAST(to_json(text) AS VARCHAR) || '}}' AS line FROM cleaned),
request AS (SELECT id, line, CAST(strlen(line) + 17 + 1 AS BIGINT) AS bytes FROM line)
"""
_PLAN = """
ordered AS (SELECT row_number() OVER (ORDER BY id) AS i, bytes FROM request),
walk(i, job, n, total) AS (
  SELECT i, CAST(0 AS BIGINT), 1, CAST(bytes AS BIGINT) FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.i, CASE WHEN full_ THEN job + 1 ELSE job END, CASE WHEN full_ THEN 1 ELSE n + 1 END, CASE WHEN full_ THEN bytes ELSE total + bytes END
  FROM (SELECT o.i, o.bytes, w.job, w.n, w.total, w.n + 1 > 100 OR w.total + o.bytes > 1048576 AS full_ FROM walk w JOIN ordered o ON o.i = w.i + 1) o)
"""
_SHARDS = """
rows AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, list_sum(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
shards AS (
  SELECT id, 1 AS batch, round(v + 1, 4) AS v FROM rows UNION ALL SELECT id, 2, round(v + 2, 4) FROM rows WHERE label BETWEEN 1 AND 5
  UNION ALL SELECT id, 3, round(v + 3, 4) FROM rows WHERE label = 5)
"""
_COMPARED = """
e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
b AS (SELECT id, a, [x * 0.9e0 + 0.01e0 FOR x IN a] AS b FROM e),
q AS (
  SELECT id, list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) AS cosine_similarity, list_max([abs(x - (x * 0.9e0 + 0.01e0)) FOR x IN a]) AS max_abs_diff FROM b)
"""

ORACLE_SQL = {
    "flagship": f"WITH {_VECTORS}, q AS ({_TO_REFERENCE}) SELECT id, round(1 - distance, 6) AS score FROM q ORDER BY score DESC, id LIMIT 20",
    "cosine_pairs": _vectors(_PAIRS),
    "cosine_matrix": _vectors(f"{_PAIRS} UNION ALL SELECT id, 'centroid', distance FROM ({_TO_REFERENCE}) UNION ALL SELECT 'centroid', id, distance FROM ({_FROM_CORPUS}) UNION ALL SELECT 'centroid', 'centroid', distance FROM ({_CORNER})"),
    "cosine_to_reference_centroid": _vectors(_TO_REFERENCE),
    "cosine_from_corpus_centroid": _vectors(_FROM_CORPUS),
    "cosine_centroid_corner": _vectors(_CORNER),
    "score_cosine_linear": f"WITH {_VECTORS}, q AS ({_TO_REFERENCE}) SELECT id, round(1 - distance, 6) AS distance FROM q",
    "score_cosine_exponential": f"WITH {_VECTORS}, q AS ({_TO_REFERENCE}) SELECT id, round(exp(-2 * distance), 6) AS distance FROM q",
    "clean_lenient": _clean("lenient"),
    "clean_balanced": _clean("balanced"),
    "clean_strict": _clean("strict"),
    "clean_policy_discard": _clean("balanced", "discard"),
    "clean_policy_conditional": _clean("balanced", "conditional"),
    "clean_flags": f"WITH {clean_sql('strict')} SELECT text_quality, discard_reason, count(*) AS n FROM cleaned GROUP BY ALL",
    "strip_html_pages": f"WITH s AS (SELECT page_id, {_space("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS t FROM pages) SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS n_chars FROM s",
    "calibrate_curve": f"WITH {_CURVE} SELECT CAST(i AS BIGINT) AS i, tp, fp, fn, {_CURVE_COLUMNS} FROM curve",
    "calibrate_f1": f"WITH {_CURVE} SELECT {_CURVE_COLUMNS} FROM (SELECT * FROM curve ORDER BY f1 DESC, i LIMIT 1)",
    "calibrate_precision_at_recall": f"WITH {_CURVE} SELECT {_CURVE_COLUMNS} FROM (SELECT * FROM curve ORDER BY CASE WHEN recall >= 0.8 THEN precision ELSE -1 END DESC, i LIMIT 1)",
    "area_mean": "SELECT CAST(k AS BIGINT) AS dim, round(avg(x), 6) AS mu FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE label = 0) GROUP BY k",
    "area_covariance": "WITH x AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings WHERE label = 0) SELECT CAST(a.k AS BIGINT) AS i, CAST(b.k AS BIGINT) AS j, round(covar_samp(a.x, b.x), 6) AS cov FROM x a JOIN x b USING (vec_id) GROUP BY a.k, b.k",
    "area_distance_2d": f"WITH {_PLANE} SELECT id, round(area_distance, 4) AS area_distance FROM area",
    "area_distance_full": f"WITH RECURSIVE {_AREA} SELECT id, round(area_distance, 6) AS area_distance FROM area",
    "area_score": f"WITH RECURSIVE {_AREA} SELECT id, round(exp(-0.05 * area_distance), 6) AS relevance_score, round(area_distance, 6) AS area_distance FROM area",
    "natural_join_distances": f"WITH RECURSIVE {_VECTORS}, {_AREA}, q AS ({_TO_REFERENCE}) SELECT id, round(distance, 6) AS distance, round(area_distance, 6) AS area_distance FROM q JOIN area USING (id)",
    "batch_request_lines": f"WITH {clean_sql('balanced')}, {_REQUESTS} SELECT id, CAST(20 AS BIGINT) AS custom_id_chars, md5(line) AS line_md5, bytes AS request_bytes FROM request",
    "batch_job_plan": f"WITH RECURSIVE {clean_sql('balanced')}, {_REQUESTS}, {_PLAN} SELECT job, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes FROM walk JOIN ordered USING (i) GROUP BY job",
    "changed_rows": f"WITH {clean_sql('balanced')} SELECT id, md5(text) AS text_md5 FROM cleaned WHERE lang IS DISTINCT FROM 'en'",
    "dry_run_preview": f"""WITH {clean_sql('balanced')} SELECT id, md5(title) AS title_md5, md5(abstract) AS abstract_md5, trim(t, ' ') AS cleaned_title,
      CASE WHEN abstract_kept THEN md5(trim(a, ' ')) END AS cleaned_md5, md5(text) AS text_md5, lang IS DISTINCT FROM 'en' AS would_embed FROM cleaned""",
    "keep_newest": f"WITH {_SHARDS} SELECT id, max(batch) AS batch, arg_max(v, batch) AS v FROM shards GROUP BY id",
    "superseded_rows": f"WITH {_SHARDS} SELECT s.* FROM shards s JOIN (SELECT id, max(batch) AS newest FROM shards GROUP BY id) USING (id) WHERE batch < newest",
    "duplicate_ids": "SELECT CAST(conv_id AS VARCHAR) AS id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1",
    "compare_embeddings": f"WITH {_COMPARED} SELECT id, round(cosine_similarity, 6) AS cosine_similarity, round(max_abs_diff, 6) AS max_abs_diff FROM q",
    "compare_summary": f"WITH {_COMPARED} SELECT count(*) AS matched_ids, round(avg(cosine_similarity), 6) AS mean_cosine_similarity, round(min(cosine_similarity), 6) AS min_cosine_similarity, round(max(max_abs_diff), 6) AS max_abs_diff FROM q",
    "similarity_neighbours": "WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT id, round(list_cosine_similarity(v, list_reverse(v)), 6) AS similarity FROM e",
    "batch_parse_output": "SELECT 'cid_' || vec_id AS custom_id, CAST(len(embedding) AS BIGINT) AS dim, round(CAST(embedding[1] AS DOUBLE), 6) AS v1 FROM embeddings",
    "batch_collected_rows": "SELECT CAST(vec_id AS VARCHAR) AS id, 'hash of ' || vec_id AS text_hash, 'openai' AS provider, 'model-x' AS model_id, CASE label WHEN 0 THEN 'reference' ELSE 'corpus' END AS part, CAST(len(embedding) AS BIGINT) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings",
    "queued_requests": f"WITH {clean_sql('balanced')}, {_REQUESTS} SELECT id, bytes AS request_bytes FROM request JOIN cleaned USING (id) WHERE lang IS DISTINCT FROM 'en'",
    "distance_neighbours": "WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT id, round(1 - list_cosine_similarity(v, list_reverse(v)), 6) AS distance FROM e",
    "usable_vectors": "SELECT CAST(label AS BIGINT) AS label, count(*) AS n, CAST(max(len(embedding)) AS BIGINT) AS dim, CAST(count(*) FILTER (len([x FOR x IN embedding IF NOT isfinite(x)]) > 0 OR list_sum([x * x FOR x IN CAST(embedding AS DOUBLE[])]) = 0) AS BIGINT) AS bad FROM embeddings GROUP BY label",
    "label_lookup": "SELECT CAST(vec_id AS VARCHAR) AS id, CASE label WHEN 0 THEN 'reference' WHEN 1 THEN 'corpus' ELSE 'other' END AS \"group\" FROM embeddings",
}
