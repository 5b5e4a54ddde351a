"""DuckDB twin of the URL filter."""

from __future__ import annotations

_RULES = [("org/", "org", "/", "allow"), ("example.org/es/", "example.org", "/es/", "block"),
          ("example.org/en/1", "example.org", "/en/1", "block"), ("com/fr/", "com", "/fr/", "allow"),
          ("com/de/", "com", "/de/", "block")]
_WORDS = ["adult", "bets", "casino", "porn", "poker", "spam", "viagra", "warez"]


def _level(k: int) -> str:
    tail = f"right(l.gram, {k})" if k else "''"
    return f"""
l{k} AS (SELECT right(gram, {k + 1}) AS gram, sum(a) AS a, sum(r) AS r FROM counts GROUP BY 1),
p{k} AS (
  SELECT gram, CASE WHEN na > 0 THEN (a + ta * pa) / (na + ta) ELSE pa END AS pa,
         CASE WHEN nr > 0 THEN (r + tr * pr) / (nr + tr) ELSE pr END AS pr
  FROM (
    SELECT l.gram, l.a, l.r, p.pa, p.pr, sum(l.a) OVER w AS na, sum(l.r) OVER w AS nr,
           count(*) FILTER (l.a > 0) OVER w AS ta, count(*) FILTER (l.r > 0) OVER w AS tr
    FROM l{k} l JOIN {f"p{k - 1}" if k else "uniform"} p ON p.gram = {tail}
    WINDOW w AS (PARTITION BY substr(l.gram, 1, {k})))),"""


URLS = rf"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
rules(rule, host, path, verdict) AS (VALUES {", ".join(str(r) for r in _RULES)}),
addresses AS (
  SELECT host || path AS address, substr(md5(host || path), 1, 1) IN ('0', '1', '2') AS held_out,
         NOT regexp_matches(host, '{"|".join(_WORDS)}')
         AND coalesce((SELECT arg_max(r.verdict, length(r.rule)) FROM rules r
                       WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)), 'allow') = 'allow' AS accepted
  FROM (SELECT DISTINCT host, path FROM parsed) p WHERE host || path <> ''),
strings AS (
  SELECT address, accepted, held_out, substr(padded, i, 5) AS gram
  FROM (SELECT *, repeat(chr(2), 4) || address || chr(3) AS padded, unnest(range(1, length(address) + 2)) AS i FROM addresses)),
counts AS (
  SELECT gram, count(*) FILTER (NOT held_out AND accepted) AS a, count(*) FILTER (NOT held_out AND NOT accepted) AS r
  FROM strings GROUP BY 1),
uniform AS (SELECT '' AS gram, 1.0::DOUBLE / count(DISTINCT right(gram, 1)) AS pa,
                   1.0::DOUBLE / count(DISTINCT right(gram, 1)) AS pr FROM counts),
{"".join(_level(k) for k in range(5))}
ratios AS (SELECT gram, CAST(floor((ln(pa) - ln(pr)) * 1e6 + 0.5) AS BIGINT) AS micro FROM p4),
scored AS (
  SELECT address, any_value(accepted) AS accepted, any_value(held_out) AS held_out,
         CAST(sum(micro) AS DOUBLE) / (count(*) * 1e6) AS score,
         CAST(floor(CAST(sum(micro) AS DOUBLE) / (count(*) * 10000)) AS BIGINT) AS step
  FROM strings JOIN ratios USING (gram) GROUP BY address),
steps AS (SELECT step, count(*) FILTER (accepted) AS a, count(*) FILTER (NOT accepted) AS r
          FROM scored WHERE held_out GROUP BY step),
running AS (SELECT CAST(floor((step + 1 + coalesce(lead(step) OVER (ORDER BY step), step + 1)) / 2) AS BIGINT) AS bar, sum(a) OVER (ORDER BY step) AS a, sum(r) OVER (ORDER BY step) AS r,
                   sum(a) OVER () AS all_a, sum(r) OVER () AS all_r FROM steps),
chosen AS (SELECT bar FROM running WHERE all_a > 0 AND all_r > 0 AND a <= 0.01 * all_a
           ORDER BY r * all_a - a * all_r DESC, bar LIMIT 1),
trained AS (SELECT count(*) FILTER (NOT held_out AND accepted) > 0 AND count(*) FILTER (NOT held_out AND NOT accepted) > 0 AS both_classes
            FROM addresses),
judged AS (
  SELECT p.*, (SELECT arg_max({{'rule': r.rule, 'verdict': r.verdict}}, length(r.rule)) FROM rules r
               WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS fits,
         s.score, CASE WHEN (SELECT both_classes FROM trained) AND s.step < coalesce((SELECT bar FROM chosen), 0)
                       THEN 'block' ELSE 'allow' END AS method_verdict
  FROM parsed p LEFT JOIN scored s ON s.address = p.host || p.path)
SELECT page_id, host, path, fits.rule AS rule, coalesce(fits.verdict, method_verdict) AS verdict, method_verdict, score
FROM judged
"""
