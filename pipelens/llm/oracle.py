"""DuckDB twins of the queries of this folder that SQL can express."""

from __future__ import annotations

from pipelens.llm.licenses import TEMPLATES

# The base phrases stand here in full; the longer templates are data of the operator.
_PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]


def _license_rows() -> str:
    listed = [(label, text, True) for label, text in _PHRASES]
    listed += [(label, text, False) for label, texts in TEMPLATES.items() for text in texts]
    rows = []
    for k, (label, text, base) in enumerate(listed):
        words = text.split()
        rows += [f"({k}, '{label}', {base}, {len(words) - 1}, {i}, '{words[i]} {words[i + 1]}')"
                 for i in range(len(words) - 1)]
    return ",\n    ".join(rows)


LICENSES = rf"""
WITH docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT doc_id, text, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM docs),
pairs AS (
  SELECT doc_id, text, unnest(range(0, len(ws) - 1)) AS pos, unnest(ws[1:len(ws) - 1]) AS a,
         unnest(ws[2:len(ws)]) AS b FROM split WHERE len(ws) > 1),
templates(template, label, base, grams, place, gram) AS (VALUES
    {_license_rows()}),
votes AS (
  SELECT doc_id, text, template, label, base, grams, place, pos, pos - place AS diagonal
  FROM pairs JOIN templates ON gram = a || ' ' || b),
lines AS (
  SELECT doc_id, text, template, diagonal, count(DISTINCT place) AS voted
  FROM votes GROUP BY ALL),
apart AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w <= 3 THEN 0 ELSE 1 END AS starts
  FROM lines WINDOW w AS (PARTITION BY doc_id, text, template ORDER BY diagonal)),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY doc_id, text, template ORDER BY diagonal) AS span FROM apart),
spans AS (
  SELECT v.doc_id, v.text, v.template, n.span, any_value(v.label) AS label, any_value(v.base) AS base,
         any_value(v.grams) AS grams, count(DISTINCT v.place) AS votes, min(v.pos) AS b, max(v.pos) AS l,
         count(DISTINCT v.diagonal) FILTER (n.voted = v.grams) AS places,
         min(v.diagonal) FILTER (n.voted = v.grams) AS first_place,
         max(v.diagonal) FILTER (n.voted = v.grams) AS last_place
  FROM votes v JOIN numbered n
    ON v.doc_id IS NOT DISTINCT FROM n.doc_id AND v.text = n.text AND v.template = n.template AND v.diagonal = n.diagonal
  GROUP BY v.doc_id, v.text, v.template, n.span),
judged AS (
  SELECT *, base AND places > 0 AS is_base,
         NOT base AND votes / grams >= 0.75 AND l - b + 1 <= 1.5 * grams AS is_found FROM spans)
SELECT s.doc_id, any_value(len(s.ws)) AS n_words,
       CAST(coalesce(sum(j.places) FILTER (j.is_base), 0) AS BIGINT) AS n_base,
       min(j.first_place) FILTER (j.is_base) AS first_word, max(j.last_place) FILTER (j.is_base) AS last_word,
       coalesce(string_agg(DISTINCT j.label, ',' ORDER BY j.label) FILTER (j.is_base), '') AS base_labels,
       coalesce(string_agg(DISTINCT j.label, ',' ORDER BY j.label) FILTER (j.is_base OR j.is_found), '') AS labels,
       coalesce(max(CASE WHEN j.is_base THEN 1.0::DOUBLE WHEN j.is_found THEN j.votes / j.grams END), 0.0) AS score,
       count(*) FILTER (j.is_base OR j.is_found) AS n_spans
FROM split s LEFT JOIN judged j ON s.doc_id IS NOT DISTINCT FROM j.doc_id AND s.text = j.text
GROUP BY s.doc_id, s.text
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (
  SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       coalesce(vec_id = least(vec_id, coalesce(m, vec_id)), true) AS kept
FROM v LEFT JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""

MIXING = """
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM documents GROUP BY source),
totals AS (SELECT sum(chars) AS total, sum(pow(chars, 0.5)) AS weighed FROM sizes),
rates AS (
  SELECT source, CASE WHEN chars > 0 THEN 1.0::DOUBLE * pow(chars, 0.5) / weighed * total / chars
                      ELSE 1.0::DOUBLE END AS rate FROM sizes, totals),
parts AS (SELECT source, greatest(1, ceil(rate / 64.0))::INT AS parts, rate / greatest(1, ceil(rate / 64.0)) AS mean
          FROM rates),
steps AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS term, exp(-mean) AS cdf FROM parts
  UNION ALL
  SELECT source, mean, k + 1, term * mean / (k + 1), cdf + term * mean / (k + 1)
  FROM steps WHERE k < ceil(mean + 12 * sqrt(mean) + 30)),
numbers AS (
  SELECT d.*, j, ('0x' || substr(md5(concat_ws(':', '20240501', coalesce(d.doc_id::VARCHAR, 'null'), j::VARCHAR)), 1, 13)
                 )::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, unnest(range(1, parts + 1)) AS t(j)),
counted AS (
  SELECT n.doc_id, n.text, n.lang, n.source, n.n_chars, n.j, count(*) FILTER (s.cdf <= n.u) AS c
  FROM numbers n JOIN steps s ON n.source IS NOT DISTINCT FROM s.source GROUP BY ALL),
totalled AS (SELECT doc_id, text, lang, source, n_chars, sum(c)::BIGINT AS c FROM counted GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
       ('0x' || substr(md5(concat_ws(':', '20240501', 'place', coalesce(doc_id::VARCHAR, 'null'), copy::VARCHAR)), 1, 15)
       )::BIGINT AS shuffle_key
FROM totalled, unnest(range(1, c + 1)) AS t(copy)
"""

JACCARD = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, greatest(len(ws) - 3, 2))]) END AS s FROM split),
flat AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * o >= 75 * (len(p.s) + len(q.s) - o)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM sets LEFT JOIN least ON a = doc_id
"""

SQL = {"op1_license_scan": LICENSES, "op2_embedding_near_dedup": EMBEDDINGS, "op6_poisson_mix": MIXING,
       "op9_jaccard_join": JACCARD}
