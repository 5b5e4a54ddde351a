"""DuckDB twin of the lineage chain (G family): recursive CTEs for the star
chains and the column closure, list aggregates for the final lineage."""

from __future__ import annotations

from pipelens.sources import driver_tables as D

# Fixed values, written out here so that a wrong constant of the engine shows.
SQL_KEYWORDS = """case when then else end and or not in like is null select from where
group by order having as on join left right inner outer cross union concat replace
lower upper trim cast substring coalesce validation plan mitigate monitor sustainability""".split()
INVALID_NAME_CHARS = '%,;<>=!?|&^~`'
PUNCTUATION_ONLY = "()[]{},.;:!@#$%^&*-+=<>?/\\|`~' \t\n\r"
DIRECT_LOGIC = 'Direct Pass-Through'
GRAPH_LOGIC_LEN = 150
CTAS_TARGET = '(?i)create\\s+table\\s+(\\w+)\\s+as'
CTAS_SELECT = '(?is)select\\s+(.*?)\\s+from'
CTAS_FROM = '(?i)from\\s+([\\w.]+)(?:\\s+(\\w+))?'
CTAS_AS_SPLIT = '(?i)\\s+as\\s+'
SIMPLE_SQL_EXCLUDES = ['case', 'concat', 'replace']


def _lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def tn(x: str) -> str:
    t = f"'t' || CAST({x} AS VARCHAR)"
    return (f"(CASE WHEN ({x}) % 5 = 0 THEN 'raw.' || {t} WHEN ({x}) % 17 = 0 THEN {t} || '_REPORT' "
            f"WHEN ({x}) % 19 = 0 THEN {t} || '_df' ELSE {t} END)")


def half(k: str) -> str:
    return tn(f"(({k} // 3) // 2) * 3 + {k} % 3")


def third(k: str) -> str:
    return tn(f"(({k} // 3) // 3) * 3 + {k} % 3")


def _class(chars: str) -> str:
    return "[" + "".join("\\" + ch if ch in "\\[]^-" else ch for ch in chars) + "]"


def valid(x: str) -> str:
    n = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    kw = ", ".join(_lit(k) for k in SQL_KEYWORDS)
    return ("coalesce(("
            f"{n} <> '' AND NOT regexp_matches({n}, '[''\"]') "
            f"AND NOT regexp_full_match({n}, '[0-9]+') AND NOT regexp_matches({n}, '[()]') "
            f"AND NOT regexp_matches({n}, {_lit(_class(INVALID_NAME_CHARS))}) "
            f"AND NOT regexp_matches({n}, '[\\n\\r\\t]') AND lower({n}) NOT IN ({kw}) "
            f"AND NOT regexp_full_match({n}, {_lit(_class(PUNCTUATION_ONLY) + '+')}) "
            f"AND regexp_matches({n}, '^[\\pL_]')), false)")


def bare(x: str) -> str:
    return f"coalesce({x} = '*' OR regexp_full_match({x}, '[A-Za-z0-9._]+'), false)"


def _c2_rows() -> str:
    parts = []
    for i, (text, refs) in enumerate(D.C2_TEMPLATES):
        if refs:
            for w, c in refs:
                src = half("k") if w == "half" else third("k")
                parts.append(f"SELECT k, 'c2', 2, {src}, {_lit(c)}, {_lit(text)} FROM lp "
                             f"WHERE k % 7 <> 0 AND k % {len(D.C2_TEMPLATES)} = {i}")
        else:
            parts.append(f"SELECT k, 'c2', 2, NULL, NULL, {_lit(text)} FROM lp "
                         f"WHERE k % 7 <> 0 AND k % {len(D.C2_TEMPLATES)} = {i}")
    return "\n  UNION ALL ".join(parts)


ASSIGN = f"""
entry AS (SELECT p_partkey AS k FROM part WHERE p_partkey < 3 OR p_size > 45),
lp AS (SELECT p_partkey AS k FROM part WHERE NOT (p_partkey < 3 OR p_size > 45)),
araw(k, target_column, ordinal, source_table, source_column, expression) AS (
  SELECT k, '*', 0, {half('k')}, NULL, '*' FROM lp WHERE k % 7 = 0
  UNION ALL SELECT k, 'c0', 0, {half('k')}, 'c0', NULL FROM lp WHERE k % 7 <> 0
  UNION ALL SELECT k, 'c1', 1, {third('k')}, 'c1', NULL FROM lp WHERE k % 7 <> 0
  UNION ALL SELECT k, 'c3', 3, {half('k')}, 'c3', NULL FROM lp WHERE k % 7 <> 0
  UNION ALL {_c2_rows()}
  UNION ALL SELECT k, 'case', 4, {half('k')}, 'c0', NULL FROM lp WHERE k % 7 <> 0 AND k % 11 = 0
  UNION ALL SELECT k, 'c5', 5, 'N/A', 'c5', NULL FROM lp WHERE k % 7 <> 0 AND k % 13 = 0
  UNION ALL SELECT k, 'c' || i, i, 'ext.s' || k, 'c' || i, NULL FROM entry, range(4) AS r(i) WHERE k % 2 = 0
  UNION ALL SELECT k, 'c0', 0, NULL, NULL, {_lit("'none'")} FROM entry WHERE k % 2 = 1),
assign AS (
  SELECT {_lit(D.LINEAGE_PIPELINE)} || (k % 3) AS pipeline_id, k AS stmt_order, {tn('k')} AS target_table,
         target_column, CAST(ordinal AS INTEGER) AS ordinal, CAST(source_table AS VARCHAR) AS source_table,
         CAST(source_column AS VARCHAR) AS source_column, CAST(expression AS VARCHAR) AS expression
  FROM araw),
latest AS (
  SELECT a.* FROM assign a
  JOIN (SELECT pipeline_id, target_table, max(stmt_order) AS m FROM assign GROUP BY ALL) l
    ON l.pipeline_id = a.pipeline_id AND l.target_table = a.target_table AND a.stmt_order = l.m),
defined AS (SELECT DISTINCT pipeline_id, target_table AS t FROM latest),
stars AS (SELECT pipeline_id, stmt_order, target_table, source_table AS src FROM latest
          WHERE target_column = '*'),
own AS (SELECT DISTINCT pipeline_id, target_table AS owner, target_column AS col FROM latest
        WHERE target_column <> '*'),
chain(pipeline_id, s, owner, hops) AS (
  SELECT DISTINCT pipeline_id, src, src, 0 FROM stars
  UNION
  SELECT c.pipeline_id, c.s, st.src, c.hops + 1 FROM chain c
  JOIN stars st ON st.pipeline_id = c.pipeline_id AND st.target_table = c.owner),
star_names AS (
  SELECT c.pipeline_id, c.s, o.col, arg_min(c.owner, (c.hops, c.owner)) AS star_owner
  FROM chain c JOIN own o ON o.pipeline_id = c.pipeline_id AND o.owner = c.owner GROUP BY ALL),
expanded AS (
  SELECT st.pipeline_id, st.stmt_order, st.target_table, n.col AS target_column,
         CAST(NULL AS INTEGER) AS ordinal, st.src AS source_table, n.col AS source_column,
         CAST(NULL AS VARCHAR) AS expression, n.star_owner
  FROM stars st JOIN star_names n ON n.pipeline_id = st.pipeline_id AND n.s = st.src
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.pipeline_id = st.pipeline_id
                    AND o.owner = st.target_table AND o.col = n.col)),
a AS (
  SELECT * FROM (
    SELECT *, CAST(NULL AS VARCHAR) AS star_owner FROM latest WHERE target_column <> '*'
    UNION ALL SELECT * FROM expanded)
  WHERE {valid('target_column')}),
cedges AS (
  SELECT DISTINCT pipeline_id, target_table AS tt, target_column AS tc, source_table AS st,
         source_column AS sc
  FROM a WHERE source_table IS NOT NULL AND source_column IS NOT NULL),
creach(pid, tt, tc, st, sc) AS (
  SELECT pipeline_id, tt, tc, st, sc FROM cedges
  UNION
  SELECT r.pid, r.tt, r.tc, e.st, e.sc FROM creach r
  JOIN cedges e ON e.pipeline_id = r.pid AND e.tt = r.st AND e.tc = r.sc),
bases0 AS (
  SELECT DISTINCT pid AS pipeline_id, tt AS target_table, tc AS target_column, st AS base_table,
         sc AS base_column
  FROM creach r WHERE NOT EXISTS (SELECT 1 FROM defined d WHERE d.pipeline_id = r.pid AND d.t = r.st)),
cols AS (SELECT pipeline_id, target_table, target_column, min(stmt_order) AS ord FROM a GROUP BY ALL),
has AS (SELECT DISTINCT pipeline_id, target_table, target_column FROM bases0),
ends AS (
  SELECT pid AS pipeline_id, tt AS target_table, tc AS target_column, st AS end_table, sc AS end_column
  FROM creach r
  WHERE EXISTS (SELECT 1 FROM defined d WHERE d.pipeline_id = r.pid AND d.t = r.st)
    AND NOT EXISTS (SELECT 1 FROM cedges e WHERE e.pipeline_id = r.pid AND e.tt = r.st AND e.tc = r.sc)),
leaves AS (
  SELECT pipeline_id, end_table AS target_table, end_column AS target_column FROM ends
  UNION
  SELECT pipeline_id, target_table, target_column FROM cols c
  WHERE NOT EXISTS (SELECT 1 FROM cedges e WHERE e.pipeline_id = c.pipeline_id AND e.tt = c.target_table
                    AND e.tc = c.target_column)),
donors0 AS (
  SELECT c.pipeline_id, c.target_column, arg_min(c.target_table, (c.ord, c.target_table)) AS fb
  FROM cols c JOIN has h USING (pipeline_id, target_table, target_column) GROUP BY ALL),
fallback0 AS (
  SELECT DISTINCT o.pipeline_id, o.target_table, o.target_column, b.base_table, b.base_column, d.fb
  FROM (SELECT * FROM ends UNION ALL
        SELECT pipeline_id, target_table, target_column, target_table, target_column FROM leaves) o
  JOIN donors0 d ON d.pipeline_id = o.pipeline_id AND d.target_column = o.end_column
  JOIN bases0 b ON b.pipeline_id = o.pipeline_id AND b.target_table = d.fb AND b.target_column = o.end_column),
bases1 AS (
  SELECT * FROM bases0
  UNION SELECT pipeline_id, target_table, target_column, base_table, base_column FROM fallback0),
has1 AS (SELECT DISTINCT pipeline_id, target_table, target_column FROM bases1),
donors1 AS (
  SELECT c.pipeline_id, c.target_column, arg_min(c.target_table, (c.ord, c.target_table)) AS fb
  FROM cols c JOIN has1 h USING (pipeline_id, target_table, target_column) GROUP BY ALL),
fallback AS (
  SELECT * FROM fallback0
  UNION ALL
  SELECT DISTINCT m.pipeline_id, m.target_table, m.target_column, b.base_table, b.base_column, d.fb
  FROM cols m JOIN donors1 d ON d.pipeline_id = m.pipeline_id AND d.target_column = m.target_column
  JOIN bases1 b ON b.pipeline_id = m.pipeline_id AND b.target_table = d.fb AND b.target_column = m.target_column
  WHERE NOT EXISTS (SELECT 1 FROM has1 h WHERE h.pipeline_id = m.pipeline_id
                    AND h.target_table = m.target_table AND h.target_column = m.target_column)),
bases AS (
  SELECT * FROM bases0
  UNION SELECT pipeline_id, target_table, target_column, base_table, base_column FROM fallback),
sch AS (
  SELECT p.pipeline_id, coalesce(split_part(f.t, '.', 1), 'default') AS schema
  FROM (SELECT DISTINCT pipeline_id FROM assign) p
  LEFT JOIN (
    SELECT pipeline_id, t, row_number() OVER (PARTITION BY pipeline_id ORDER BY so, pos, ord, t) AS rn
    FROM (SELECT pipeline_id, stmt_order AS so, 0 AS pos, 0 AS ord, target_table AS t FROM assign
          UNION ALL
          SELECT pipeline_id, stmt_order, 1, coalesce(ordinal, 0), source_table FROM assign)
    WHERE contains(t, '.')) f ON f.pipeline_id = p.pipeline_id AND f.rn = 1),
final AS (
  SELECT c.pipeline_id, c.target_table, c.target_column,
         coalesce(s.source_columns, []::VARCHAR[]) AS source_columns,
         coalesce(x.expressions, []::VARCHAR[]) AS expressions
  FROM (SELECT DISTINCT pipeline_id, target_table, target_column FROM a) c
  LEFT JOIN (
    SELECT b.pipeline_id, b.target_table, b.target_column,
           list_sort(list_distinct(list(
             CASE WHEN b.base_table IS NULL OR b.base_table = '' OR contains(b.base_table, '.')
                  THEN b.base_table ELSE sch.schema || '.' || b.base_table END
             || '.' || b.base_column))) AS source_columns
    FROM bases b JOIN sch USING (pipeline_id)
    WHERE coalesce(upper(b.base_table) <> 'N/A', false) AND {valid('b.base_column')}
    GROUP BY ALL) s USING (pipeline_id, target_table, target_column)
  LEFT JOIN (
    SELECT pipeline_id, target_table, target_column, list_sort(list_distinct(list(expression)))
             AS expressions
    FROM (
      SELECT pipeline_id, target_table, target_column, expression FROM a
      WHERE expression IS NOT NULL AND NOT {bare('expression')}
      UNION ALL
      SELECT x.pipeline_id, x.target_table, x.target_column, o.expression
      FROM a x JOIN a o ON o.pipeline_id = x.pipeline_id AND o.target_table = x.star_owner
           AND o.target_column = x.target_column
      WHERE x.star_owner IS NOT NULL AND o.expression IS NOT NULL AND NOT {bare('o.expression')})
    GROUP BY ALL) x USING (pipeline_id, target_table, target_column))"""

GRAPH = ASSIGN + f""",
tedges AS (SELECT DISTINCT pipeline_id, target_table, source_table FROM latest
           WHERE source_table IS NOT NULL),
treach(pid, tt, st) AS (
  SELECT pipeline_id, target_table, source_table FROM tedges
  UNION
  SELECT r.pid, r.tt, e.source_table FROM treach r
  JOIN tedges e ON e.pipeline_id = r.pid AND e.target_table = r.st),
base_tables AS (
  SELECT DISTINCT pid AS pipeline_id, tt AS target_table, st AS base_table FROM treach r
  WHERE NOT EXISTS (SELECT 1 FROM tedges d WHERE d.pipeline_id = r.pid AND d.target_table = r.st)
  UNION SELECT pipeline_id, target_table, source_table FROM tedges WHERE target_table = source_table),
nodes AS (
  SELECT pipeline_id AS graph_id, target_table AS id, target_table AS label, 'table' AS type,
         CAST(NULL AS VARCHAR) AS parent_id FROM latest
  UNION
  SELECT pipeline_id, target_table || '.' || target_column, target_column, 'column', target_table
  FROM latest WHERE target_column <> '*' AND {valid('target_column')}
  UNION
  SELECT pipeline_id, base_table, base_table, 'table', NULL FROM base_tables b
  WHERE NOT EXISTS (SELECT 1 FROM defined d WHERE d.pipeline_id = b.pipeline_id AND d.t = b.base_table)),
refs AS (
  SELECT r.pipeline_id, r.target_table, r.target_column, r.source_table, r.source_column,
         CASE WHEN r.expression IS NULL THEN {_lit(DIRECT_LOGIC)} ELSE substr(r.expression, 1, {GRAPH_LOGIC_LEN}) END
           AS logic,
         EXISTS (SELECT 1 FROM defined d WHERE d.pipeline_id = r.pipeline_id AND d.t = r.source_table)
           AS is_def
  FROM latest r
  WHERE r.source_table IS NOT NULL AND r.source_column IS NOT NULL AND r.target_column <> '*'
    AND {valid('r.target_column')} AND {valid('r.source_column')}),
cedges2 AS (
  SELECT r.pipeline_id, b.base_table AS st, b.base_column AS sc, r.target_table, r.target_column, r.logic
  FROM refs r JOIN bases b ON b.pipeline_id = r.pipeline_id AND b.target_table = r.source_table
       AND b.target_column = r.source_column
  WHERE r.is_def
  UNION ALL
  SELECT pipeline_id, source_table, source_column, target_table, target_column, logic FROM refs
  WHERE NOT is_def),
edges AS (
  SELECT DISTINCT ON (graph_id, source, target, coalesce(logic, ''))
         graph_id, source, target, flow_type, logic FROM (
    SELECT pipeline_id AS graph_id, source_table AS source, target_table AS target,
           'table_level' AS flow_type, CAST(NULL AS VARCHAR) AS logic FROM tedges
    UNION ALL
    SELECT pipeline_id, st || '.' || sc, target_table || '.' || target_column, 'column_level', logic
    FROM cedges2 WHERE {valid('sc')}))"""


W = "WITH RECURSIVE " + ASSIGN.strip()
WG = "WITH RECURSIVE " + GRAPH.strip()
K = "pipeline_id, target_table, target_column"
REF_PATTERN = "(?i)\\b(?:raw|derv)\\.([a-zA-Z_][a-zA-Z0-9_]*)\\b"
STOP = ", ".join(_lit(w) for w in ["YEAR", "MONTH", "DAY", "CAST", "DATE", "CASE", "WHEN", "THEN",
                                      "ELSE", "END", "IN", "AND", "OR", "NOT"])


def refs_of(expr: str) -> str:
    return (f"list_filter(regexp_extract_all({expr}, {_lit(REF_PATTERN)}, 1), "
            f"lambda r: upper(r) NOT IN ({STOP}))")


def strip_derv(x: str) -> str:
    return f"regexp_replace(lower({x}), '^derv_', '')"


def col_base(s: str) -> str:
    return strip_derv(f"string_split({s}, '.')[-1]")


FIX = f"""
fx0 AS (
  SELECT *, list_distinct(list_transform(flatten(list_transform(expressions, lambda e: {refs_of('e')})),
                                         lambda r: {strip_derv('r')})) AS refs
  FROM final),
fx1 AS (
  SELECT *, list_filter(source_columns, lambda s: list_contains(refs, {col_base('s')})) AS referenced,
         list_filter(source_columns, lambda s: NOT list_contains(refs, {col_base('s')})) AS unused
  FROM fx0),
fx2 AS (
  SELECT *, list_filter(list_transform(referenced, lambda s, i: CASE WHEN list_position(referenced, s) = i
                                        THEN s END), lambda s: s IS NOT NULL) AS kept,
         list_distinct(list_filter(referenced, lambda s: len(list_filter(referenced, lambda x: x = s)) > 1))
           AS dups
  FROM fx1),
fx3 AS (
  SELECT *, list_filter(refs, lambda r: NOT list_contains(list_transform(kept, lambda s: {col_base('s')}), r))
              AS missing,
         list_filter(list_transform(kept, lambda s: CASE WHEN len(string_split(s, '.')) >= 3
                     THEN regexp_extract(s, '^(.*)\\.[^.]*$', 1) END),
                     lambda t: t IS NOT NULL AND contains(lower(t), 'raw'))[1] AS home
  FROM fx2),
fx4 AS (
  SELECT *, list_sort(list_distinct(list_filter(
           CASE WHEN len(missing) = 0 THEN []::VARCHAR[]
                WHEN home IS NOT NULL THEN list_transform(missing, lambda m: home || '.' || m)
                ELSE list_transform(missing, lambda m: 'landing_raw.records.' || m) END,
           lambda x: NOT list_contains(kept, x)))) AS added
  FROM fx3),
fixed AS (
  SELECT {K},
         CASE WHEN len(expressions) > 0 THEN list_concat(kept, added) ELSE source_columns END
           AS source_columns,
         expressions,
         CASE WHEN len(expressions) > 0 THEN list_filter([
           CASE WHEN len(dups) > 0 THEN '  ' || target_column || ': Removed duplicate source columns: '
                || array_to_string(list_sort(dups), ', ') END,
           CASE WHEN len(unused) > 0 THEN '  ' || target_column || ': Removed unused source columns: '
                || array_to_string(list_sort(unused), ', ') END,
           CASE WHEN len(added) > 0 THEN '  ' || target_column || ': Added missing columns: '
                || array_to_string(list_sort(added), ', ') END], lambda x: x IS NOT NULL)
         ELSE []::VARCHAR[] END AS issues
  FROM fx4)"""

COL_LINEAGE = f""",
qbt AS (
  SELECT b.pipeline_id, b.target_table,
         list_sort(list_distinct(list(CASE WHEN b.base_table IS NULL OR b.base_table = ''
                  OR contains(b.base_table, '.') THEN b.base_table
                  ELSE sch.schema || '.' || b.base_table END))) AS source_tables
  FROM base_tables b JOIN sch USING (pipeline_id) GROUP BY ALL),
col_lineage AS (
  SELECT f.pipeline_id, f.target_table, f.target_column,
         coalesce(q.source_tables, []::VARCHAR[]) AS source_tables, f.source_columns, f.expressions
  FROM final f LEFT JOIN qbt q USING (pipeline_id, target_table))"""

LABEL = "CASE WHEN array_to_string(expressions, ', ') = '' THEN 'Raw Copy' ELSE array_to_string(expressions, ', ') END"

SQL = {
    "lin_last_definition_wins": W + "\nSELECT * FROM latest",
    "lin_expand_star": W + "\nSELECT * FROM expanded",
    "lin_base_tables": WG + "\nSELECT * FROM base_tables",
    "set_union_sources": WG + "\nSELECT * FROM base_tables WHERE target_table <> base_table "
                              "OR EXISTS (SELECT 1 FROM tedges e WHERE e.target_table = base_tables.target_table "
                              "AND e.source_table = base_tables.base_table AND e.target_table <> e.source_table)",
    "join_base_tables_anti": W + """
SELECT DISTINCT pipeline_id, source_table AS "table" FROM latest l
WHERE source_table IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM defined d WHERE d.pipeline_id = l.pipeline_id AND d.t = l.source_table)""",
    "lin_base_columns": W + "\nSELECT * FROM bases0",
    "lin_name_fallback": W + "\nSELECT pipeline_id, target_table, target_column, base_table, base_column, "
                             "fb AS fallback_table FROM fallback",
    "lin_final": W + "\nSELECT * FROM final",
    "agg_sources_per_target": W + f"""
SELECT {K}, list_sort(list_distinct(list(base_table || '.' || base_column))) AS sources
FROM bases JOIN (SELECT {K} FROM cols) USING ({K}) GROUP BY ALL""",
    "job_column_lineage": WG + COL_LINEAGE + "\nSELECT * FROM col_lineage",
    "lin_multi_hop_nodes": WG + "\nSELECT * FROM nodes",
    "set_dedup_nodes": WG + "\nSELECT graph_id, id FROM nodes",
    "lin_multi_hop_edges": WG + "\nSELECT * FROM edges",
    "set_dedup_edges": WG + "\nSELECT graph_id, source, target, coalesce(logic, '') AS logic_key FROM edges",
    "job_multi_hop": WG + """
SELECT e.*, s.type AS source_type, t.type AS target_type FROM edges e
LEFT JOIN nodes s ON s.graph_id = e.graph_id AND s.id = e.source
LEFT JOIN nodes t ON t.graph_id = e.graph_id AND t.id = e.target""",
    "lin_validate_fix": W + "," + FIX.strip() + "\nSELECT * FROM fixed",
    "set_missing_refs": W + "," + FIX.strip() + f"""
SELECT {K}, list_sort(list_filter(refs, lambda r: NOT list_contains(
  list_transform(source_columns, lambda s: {col_base('s')}), r))) AS missing_refs FROM fx0""",
    "set_unused_sources": W + "," + FIX.strip() + f"\nSELECT {K}, list_sort(unused) AS unused_sources FROM fx1",
    "set_unique_details": W + """
SELECT pipeline_id, target_column, list(CAST(to_json({'source_columns': source_columns, 'expressions': expressions}) AS VARCHAR)
                                        ORDER BY first_table) AS unique_details
FROM (SELECT pipeline_id, target_column, source_columns, expressions, min(target_table) AS first_table FROM final GROUP BY ALL)
GROUP BY ALL""",
    "sink_json": WG + COL_LINEAGE + "\nSELECT * FROM col_lineage",
    "src_lineage_json": WG + COL_LINEAGE + """
SELECT pipeline_id, 'definition' AS kind, target_column AS name, target_table AS owner, NULL AS type, NULL AS logic,
       source_columns AS sources, expressions FROM col_lineage
UNION ALL SELECT graph_id, 'node', id, parent_id, type, label, NULL, NULL FROM nodes
UNION ALL SELECT graph_id, 'edge', target, NULL, flow_type, logic, [source], NULL FROM edges
UNION ALL SELECT DISTINCT pipeline_id, 'malformed', NULL, NULL, NULL, '{"target_table": "' || target_table || '", ', NULL, NULL
FROM assign""",
    "fn_column_refs": W + f"""
SELECT DISTINCT {K}, expression, list_sort(list_distinct({refs_of('expression')})) AS refs
FROM latest WHERE expression IS NOT NULL""",
    "fn_strip_derv": W + f"""
SELECT DISTINCT {K}, list_sort(list_distinct(list_transform({refs_of('expression')},
  lambda r: {strip_derv('r')}))) AS base_refs
FROM latest WHERE expression IS NOT NULL""",
    "fn_truncate_logic": WG + """
SELECT graph_id, source, target, substr(coalesce(logic, 'Transform'), 1, 100) AS label FROM edges""",
    "pred_valid_column_name": f"""
SELECT token, {valid('token')} AS is_valid
FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents)""",
    "pred_not_na_table": W + """
SELECT "table", coalesce(upper("table") <> 'N/A', false) AS keep
FROM (SELECT DISTINCT source_table AS "table" FROM latest)""",
    "pred_target_table": WG + """
SELECT id, (ends_with(id, 'REPORT') OR contains(lower(id), 'derived')) AS is_report_target,
       (ends_with(id, 'REPORT') OR id = 'derived_df') AS is_node_target,
       (ends_with(id, '_df') OR id = 'derived_df') AS is_builder_target
FROM nodes WHERE type = 'table'""",
    "pred_bare_column": W + f"""
SELECT expression, {bare('expression')} AS is_bare
FROM (SELECT DISTINCT expression FROM latest WHERE expression IS NOT NULL)""",
    "fn_schema_prefix": WG + """
SELECT DISTINCT b.pipeline_id, b.base_table, s.schema,
       CASE WHEN b.base_table IS NULL OR b.base_table = '' OR contains(b.base_table, '.') THEN b.base_table
            ELSE s.schema || '.' || b.base_table END AS qualified
FROM base_tables b JOIN sch s USING (pipeline_id)""",
    "join_alias_resolve": W + f""",
refs AS (
  SELECT pipeline_id, stmt_order, target_column, ordinal,
         CASE WHEN stmt_order % 3 = 0 THEN 'a' WHEN stmt_order % 3 = 1 THEN NULL ELSE 'zz' END AS alias,
         source_column AS "column"
  FROM assign WHERE source_column IS NOT NULL),
srcs AS (
  SELECT DISTINCT pipeline_id, stmt_order, 'a' AS alias, {half('stmt_order')} AS "table", 0 AS ordinal
  FROM assign
  UNION ALL
  SELECT DISTINCT pipeline_id, stmt_order, 'b', {third('stmt_order')}, 1 FROM assign
  WHERE stmt_order % 5 <> 0)
SELECT r.pipeline_id, r.stmt_order, r.target_column, r.ordinal, r.alias, r."column",
       CASE WHEN r.alias IS NOT NULL THEN coalesce(
              (SELECT s."table" FROM srcs s WHERE s.pipeline_id = r.pipeline_id
                 AND s.stmt_order = r.stmt_order AND s.alias = r.alias), r.alias)
            ELSE (SELECT arg_min(s."table", s.ordinal) FROM srcs s WHERE s.pipeline_id = r.pipeline_id
                    AND s.stmt_order = r.stmt_order) END AS source_table
FROM refs r""",
    "agg_distinct_labels": WG + "\nSELECT DISTINCT label FROM nodes WHERE type = 'column' ORDER BY label",
    "graph_table_edges": WG + COL_LINEAGE + """
SELECT DISTINCT pipeline_id, target_table, unnest(source_tables) AS source_table FROM col_lineage""",
    "graph_column_edges": W + f"""
SELECT pipeline_id, unnest(source_columns) AS source, target_table || '.' || target_column AS target,
       {LABEL} AS label FROM final""",
    "graph_hub_edges": W + f"""
SELECT pipeline_id, unnest(source_columns) AS source,
       'transform_' || target_table || '.' || target_column AS target, CAST(NULL AS VARCHAR) AS label
FROM final WHERE len(source_columns) > 1
UNION ALL
SELECT pipeline_id, 'transform_' || target_table || '.' || target_column,
       target_table || '.' || target_column, {LABEL} FROM final WHERE len(source_columns) > 1
UNION ALL
SELECT pipeline_id, source_columns[1], target_table || '.' || target_column, {LABEL}
FROM final WHERE len(source_columns) = 1""",
    "graph_column_groups": WG + """
SELECT graph_id, parent_id, list_sort(list(label)) AS columns FROM nodes WHERE type = 'column'
GROUP BY ALL""",
    "graph_edge_details": WG + "\nSELECT * FROM edges WHERE contains(source, 'c2') OR contains(target, 'c2')",
    "graph_upstream": WG + """,
seeds AS (SELECT graph_id, id FROM nodes WHERE type = 'column' AND label = 'c0'),
up(graph_id, id) AS (
  SELECT graph_id, id FROM seeds
  UNION
  SELECT e.graph_id, e.source FROM up u JOIN edges e ON e.graph_id = u.graph_id AND e.target = u.id)
SELECT * FROM up""",
}

STMTS = f"""
stmts AS (
  SELECT {_lit(D.LINEAGE_PIPELINE)} AS pipeline_id, p_partkey AS stmt_order,
    CASE WHEN p_partkey % 8 = 4 THEN 'create table t' || p_partkey || E' as\\nselect\\n  a.c0 as x' || p_partkey
                  || E',\\n  a.c1,\\n\\tc2\\nfrom db.t' || (p_partkey // 2) || ' a' ELSE
    CASE p_partkey % 4
      WHEN 0 THEN 'create table t' || p_partkey || ' as select a.c0 as x' || p_partkey
                  || ', a.c1, c2 from db.t' || (p_partkey // 2) || ' a'
      WHEN 1 THEN 'CREATE TABLE T' || p_partkey || ' AS SELECT c0, c1 AS y FROM raw.src' || (p_partkey % 10)
      WHEN 2 THEN 'create table t' || p_partkey
                  || ' as select case when a.c0 > 1 then 1 else 0 end as flag from t' || (p_partkey // 3) || ' a'
      ELSE 'insert into t' || p_partkey || ' select c0 from t' || (p_partkey // 2) END END AS sql_text
  FROM part)"""

SQL["lin_simple_ctas"] = "WITH " + STMTS.strip() + f""",
b AS (
  SELECT pipeline_id, stmt_order, s,
         regexp_extract(s, {_lit(CTAS_TARGET)}, 1) AS target_table,
         regexp_extract(s, {_lit(CTAS_SELECT)}, 1) AS clause,
         regexp_extract(s, {_lit(CTAS_FROM)}, 1) AS source_table,
         nullif(regexp_extract(s, {_lit(CTAS_FROM)}, 2), '') AS source_alias
  FROM (SELECT *, regexp_replace(sql_text, '^\\s+|\\s+$', '', 'g') AS s FROM stmts)),
items AS (
  SELECT pipeline_id, stmt_order, target_table, source_table, source_alias,
         CAST(generate_subscripts(string_split(clause, ','), 1) - 1 AS INTEGER) AS position,
         regexp_replace(unnest(string_split(clause, ',')), '^\\s+|\\s+$', '', 'g') AS item
  FROM b
  WHERE target_table <> '' AND regexp_matches(s, {_lit(CTAS_SELECT)}) AND source_table <> '')
SELECT pipeline_id, stmt_order, target_table, source_table, source_alias, position,
       trim(CASE WHEN regexp_matches(item, {_lit(CTAS_AS_SPLIT)})
                 THEN string_split(regexp_split_to_array(item, {_lit(CTAS_AS_SPLIT)})[1], '.')[-1]
                 ELSE string_split(item, '.')[-1] END) AS source_column,
       trim(CASE WHEN regexp_matches(item, {_lit(CTAS_AS_SPLIT)}) THEN regexp_split_to_array(item, {_lit(CTAS_AS_SPLIT)})[2]
                 ELSE string_split(item, '.')[-1] END) AS target_column
FROM items"""

SQL["lin_simple_gate"] = "WITH " + STMTS.strip() + """
SELECT pipeline_id, stmt_order,
       coalesce(NOT contains(lower(sql_text), 'case') AND NOT contains(lower(sql_text), 'concat')
                AND NOT contains(lower(sql_text), 'replace')
                AND (length(sql_text) - length(replace(sql_text, 'create table', ''))) / 12 = 1, false)
         AS is_simple
FROM stmts"""
