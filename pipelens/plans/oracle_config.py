"""DuckDB twins of the configuration, QA and retrieval keys (section 2.13)."""

from __future__ import annotations

from pipelens.plans.oracle_lineage import STMTS

BASE = "WITH RECURSIVE " + STMTS.strip() + """,
docs AS (SELECT stmt_order AS k, sql_text FROM stmts),
valid AS (SELECT * FROM docs WHERE k % 97 <> 0 AND k % 89 <> 0 AND k % 83 <> 0),
flows AS (
  SELECT 'part' AS application, 'f' || k AS flow_id, 'frame_' || k AS register_name,
         CASE WHEN k % 3 = 0 THEN 'db.t' || k END AS storage_name, k % 3 = 0 AS save_output, k, sql_text
  FROM valid),
dp AS (
  SELECT 'f' || k AS v, unnest(list_distinct(list_filter(['f' || (k // 2), 'f' || (k // 3)],
                                             lambda d: d <> 'f' || k))) AS p
  FROM valid WHERE k >= 1),
links AS (
  SELECT DISTINCT * FROM (
    SELECT 'part' AS application, s.register_name AS source, t.register_name AS target,
           'frame_to_frame' AS link_type
    FROM dp JOIN flows s ON s.flow_id = dp.p JOIN flows t ON t.flow_id = dp.v
    UNION ALL
    SELECT 'part', register_name, storage_name, 'frame_to_table' FROM flows
    WHERE save_output AND storage_name IS NOT NULL))"""


def _cos(a: str, b: str) -> str:
    da, db = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return (f"list_dot_product({da}, {db}) / (sqrt(list_dot_product({da}, {da})) "
            f"* sqrt(list_dot_product({db}, {db})))")


Q = """
q AS (SELECT label, arg_min(embedding, vec_id) AS q_embedding, min(vec_id) AS query_id
      FROM embeddings GROUP BY label)"""

TOPK = """
SELECT query_id, vec_id, label, {extra}round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5"""

SQL = {
    "cfg_flatten": BASE + "\nSELECT application, flow_id, register_name, storage_name, save_output FROM flows",
    "cfg_schema_check": BASE + """
SELECT reason IS NULL AS is_valid, reason, count(*) AS n FROM (
  SELECT CASE WHEN k % 97 = 0 THEN 'malformed JSON' WHEN k % 89 = 0 THEN 'missing application.name'
              WHEN k % 83 = 0 THEN 'flow without flowId' END AS reason FROM docs)
GROUP BY ALL""",
    "cfg_frame_links": BASE + "\nSELECT * FROM links",
    "cfg_flow_dag": BASE + """,
paths(v, d) AS (
  SELECT flow_id, 1 FROM flows
  UNION
  SELECT e.v, pth.d + 1 FROM paths pth JOIN dp e ON e.p = pth.v JOIN flows f ON f.flow_id = e.v)
SELECT 'part' AS application, v AS flow_id, CAST(max(d) AS INTEGER) AS level FROM paths GROUP BY v""",
    "cfg_knowledge_graph": BASE + r""",
reads AS (SELECT flow_id, regexp_extract(sql_text, '(?i)\bfrom\s+([\w.]+)', 1) AS t FROM flows),
nodes AS (
  SELECT DISTINCT * FROM (
    SELECT 'part' AS id, 'application' AS type
    UNION ALL SELECT flow_id, 'flow' FROM flows
    UNION ALL SELECT flow_id || '#q0', 'query' FROM flows
    UNION ALL SELECT 'chk' || k, 'check' FROM flows WHERE k % 4 = 0
    UNION ALL SELECT register_name || '.c0', 'column' FROM flows WHERE k % 4 = 0
    UNION ALL SELECT register_name, 'frame' FROM flows
    UNION ALL SELECT t, 'table' FROM reads WHERE t <> ''
    UNION ALL SELECT storage_name, 'table' FROM flows WHERE save_output AND storage_name IS NOT NULL)),
edges AS (
  SELECT DISTINCT * FROM (
    SELECT 'part' AS source, flow_id AS target, 'has_flow' AS type FROM flows
    UNION ALL SELECT flow_id, flow_id || '#q0', 'runs_query' FROM flows
    UNION ALL SELECT flow_id || '#q0', t, 'reads_from' FROM reads WHERE t <> ''
    UNION ALL SELECT flow_id, 'chk' || k, 'has_check' FROM flows WHERE k % 4 = 0
    UNION ALL SELECT flow_id, register_name, 'registers' FROM flows
    UNION ALL SELECT flow_id, storage_name, 'writes_to' FROM flows WHERE save_output AND storage_name IS NOT NULL
    UNION ALL SELECT p, v, 'precedes' FROM dp
    UNION ALL SELECT 'chk' || k, register_name || '.c0', 'checks_column' FROM flows WHERE k % 4 = 0
    UNION ALL SELECT source, target, link_type FROM links)),
types AS (SELECT id, list_sort(list(type)) AS ts FROM nodes GROUP BY id)
SELECT 'part' AS application, e.source, e.target, e.type, s.ts AS source_types, t.ts AS target_types
FROM edges e LEFT JOIN types s ON s.id = e.source LEFT JOIN types t ON t.id = e.target""",
    "qa_feeders": BASE + """,
asked AS (SELECT 'f' || max(k) AS a FROM valid),
up(a, b, hops) AS (
  SELECT asked.a, dp.p, 1 FROM asked JOIN dp ON dp.v = asked.a
  UNION
  SELECT up.a, dp.p, up.hops + 1 FROM up JOIN dp ON dp.v = up.b)
SELECT f.application, u.a AS asked_flow, u.b AS flow_id, CAST(min(u.hops) AS INTEGER) AS hops,
       f.register_name, f.storage_name
FROM up u JOIN flows f ON f.flow_id = u.b GROUP BY ALL""",
    "qa_grounding": BASE + """
SELECT d.p AS source, d.v AS target FROM dp d
WHERE CAST(substr(d.v, 2) AS BIGINT) % 5 = 0
  AND NOT EXISTS (SELECT 1 FROM dp x WHERE x.v = d.p AND x.p = d.v)""",
    "ret_vector_topk": "WITH " + Q.strip() + f""",
scored AS (SELECT q.query_id, e.vec_id, e.label, {_cos('e.embedding', 'q.q_embedding')} AS score
           FROM embeddings e, q)""" + TOPK.format(extra=""),
    "ret_metadata_filter": "WITH " + Q.strip() + f""",
scored AS (SELECT q.query_id, e.vec_id, e.label, {_cos('e.embedding', 'q.q_embedding')} AS score
           FROM embeddings e JOIN q USING (label))""" + TOPK.format(extra=""),
    "ret_hybrid": "WITH " + Q.strip() + f""",
ve AS (SELECT vec_id AS src, vec_id // 2 AS dst FROM embeddings WHERE vec_id >= 1),
nb AS (SELECT DISTINCT * FROM (SELECT src AS query_id, dst AS vec_id FROM ve
                               UNION ALL SELECT dst, src FROM ve)),
scored AS (
  SELECT q.query_id, e.vec_id, e.label, {_cos('e.embedding', 'q.q_embedding')} AS cos,
         {_cos('e.embedding', 'q.q_embedding')}
           + CASE WHEN EXISTS (SELECT 1 FROM nb WHERE nb.query_id = q.query_id AND nb.vec_id = e.vec_id)
                  THEN 0.5 ELSE 0.0 END AS score
  FROM embeddings e JOIN q ON e.label = q.label
       OR EXISTS (SELECT 1 FROM nb WHERE nb.query_id = q.query_id AND nb.vec_id = e.vec_id))"""
    + TOPK.format(extra="round(cos, 6) AS cos, "),
}
