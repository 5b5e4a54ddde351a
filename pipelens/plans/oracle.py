"""DuckDB twins of the driver bindings (the correctness gate).

Each adapter of :mod:`pipelens.sources.driver_tables` is rebuilt here as a CTE
over the same parquet views; each key's SQL then applies the operator's
semantics in plain SQL (windows, ``WITH RECURSIVE``, list functions).
Doubles are rounded to 6 decimals; integer sums are cast back to BIGINT.
"""

from __future__ import annotations

SQL: dict[str, str] = {}


def q(key: str, sql: str) -> None:
    SQL[key] = sql.strip()


TASKS = """
tasks AS (
  SELECT l_returnflag AS app_id, l_suppkey AS stage_id, 0 AS stage_attempt_id,
         l_orderkey * 8 + l_linenumber AS task_id,
         CAST(l_partkey % 8 AS VARCHAR) AS executor_id,
         (epoch_us(l_shipdate) // 1000) AS launch_time,
         (epoch_us(l_shipdate) // 1000) + CAST(floor(l_extendedprice) AS BIGINT) AS finish_time,
         CAST(floor(l_extendedprice) AS BIGINT) AS task_runtime,
         CAST(floor(l_extendedprice) AS BIGINT) - l_linenumber AS executor_runtime,
         CAST(floor(l_extendedprice * (1 - l_discount)) * 1000000 AS BIGINT) AS executor_cpu_time,
         CAST(floor(l_discount * 1000000) AS BIGINT) AS memory_spill,
         CAST(floor(l_tax * 100000) AS BIGINT) AS disk_spill,
         CAST(l_quantity AS BIGINT) * 1024 AS input_bytes,
         CASE WHEN l_linenumber <> 1 THEN CAST(floor(l_extendedprice * l_quantity) AS BIGINT) END
           AS shuffle_read_bytes,
         CAST(floor(l_extendedprice * l_tax * 100) AS BIGINT) AS shuffle_write_bytes,
         CAST(l_quantity AS BIGINT) AS output_rows
  FROM lineitem)"""

APP_OF = "(['A','N','R'])[({k}) % 3 + 1]"

STAGES = f"""
stages AS (
  SELECT {APP_OF.format(k='p_partkey')} AS app_id, p_partkey AS stage_id, 0 AS stage_attempt_id,
         p_name AS stage_name, p_size AS num_tasks,
         p_partkey * 1000 AS submission_time, p_partkey * 1000 + p_size AS completion_time,
         CAST(p_size AS BIGINT) AS stage_time,
         list_distinct(list_filter([p_partkey // 2, p_partkey // 3],
                       lambda x: x <> p_partkey AND x % 3 = p_partkey % 3)) AS parents
  FROM part)"""

EVENTS = f"""
ev AS (
  SELECT event_id, user_id, event_type, value, props, epoch_us(ts) // 1000 AS ts_ms,
         {APP_OF.format(k='user_id')} AS app_id
  FROM events)"""

EXECUTIONS = f"""
per_user AS (
  SELECT user_id AS execution_id,
         min(CASE WHEN event_type = 'view' THEN ts_ms END) AS start_time,
         count(CASE WHEN event_type = 'view' THEN 1 END) AS n_views,
         count(CASE WHEN event_type = 'click' THEN 1 END) AS n_clicks
  FROM ev GROUP BY ALL),
ids AS (
  SELECT execution_id FROM per_user WHERE start_time IS NOT NULL
  UNION SELECT doc_id FROM documents WHERE doc_id IS NOT NULL
  UNION SELECT page_id FROM pages WHERE page_id IS NOT NULL),
executions AS (
  SELECT {APP_OF.format(k='i.execution_id')} AS app_id, i.execution_id, d.text AS query_text, p.html AS plan_text,
         u.start_time, coalesce(u.n_views, 0) AS n_views, coalesce(u.n_clicks, 0) AS n_clicks
  FROM ids i
  LEFT JOIN per_user u ON u.execution_id = i.execution_id AND u.start_time IS NOT NULL
  LEFT JOIN documents d ON d.doc_id = i.execution_id
  LEFT JOIN pages p ON p.page_id = i.execution_id),
children AS (
  SELECT app_id, execution_id, 'Scan' AS node_name, CAST(n_views AS BIGINT) AS estimated_rows
  FROM executions
  UNION ALL SELECT app_id, execution_id, 'Exchange', CAST(n_clicks AS BIGINT) FROM executions
  UNION ALL SELECT app_id, execution_id, 'Project', CAST(NULL AS BIGINT) FROM executions)"""

ENDS = """
ends AS (
  SELECT app_id, user_id AS execution_id, max(ts_ms) AS end_time
  FROM ev WHERE event_type = 'purchase' GROUP BY ALL)"""

UPDATES = """
updates AS (
  SELECT app_id, user_id AS execution_id,
         CASE WHEN value > 400 THEN 'SortMergeJoin(skew=true) ' || props ELSE props END AS plan_json
  FROM ev WHERE event_type = 'click')"""

ACTUAL = """
actual AS (SELECT app_id, CAST(sum(output_rows) AS BIGINT) AS actual_output_rows
           FROM tasks GROUP BY ALL)"""

CARD = """
card AS (
  SELECT c.app_id, c.execution_id, c.node_name, c.estimated_rows, a.actual_output_rows,
         a.actual_output_rows / (c.estimated_rows + 1) AS cardinality_error_ratio,
         log10(a.actual_output_rows / (c.estimated_rows + 1) + 1) AS log_cardinality_error,
         coalesce(a.actual_output_rows / (c.estimated_rows + 1) > 10, false)
           AS statistics_issue_flag
  FROM children c LEFT JOIN actual a USING (app_id))"""

# rank-based helpers: per-app exact stats over task runtime
RUNTIME_STATS = """
rt_rank AS (
  SELECT app_id, task_runtime AS v,
         row_number() OVER (PARTITION BY app_id ORDER BY task_runtime) AS i,
         count(*) OVER (PARTITION BY app_id) AS n
  FROM tasks WHERE task_runtime IS NOT NULL),
rt_gini AS (
  SELECT app_id,
         2.0 * sum(CAST(i AS DOUBLE) * v) / (max(n) * CAST(sum(v) AS DOUBLE))
           - (max(n) + 1.0) / max(n) AS gini_coefficient_runtime
  FROM rt_rank GROUP BY ALL),
rt_pct AS (
  SELECT app_id,
         quantile_cont(task_runtime, 0.95) AS task_runtime_p95,
         quantile_cont(task_runtime, 0.99) AS task_runtime_p99,
         quantile_cont(task_runtime, 0.5) AS task_runtime_median
  FROM tasks GROUP BY ALL),
part_rank AS (
  SELECT app_id, coalesce(shuffle_read_bytes, 0) AS b,
         row_number() OVER (PARTITION BY app_id ORDER BY coalesce(shuffle_read_bytes, 0)) - 1 AS idx,
         count(*) OVER (PARTITION BY app_id) AS n
  FROM tasks),
part_stats AS (
  SELECT app_id,
         max(b) / 1048576.0 AS max_partition_size_mb,
         min(b) / 1048576.0 AS min_partition_size_mb,
         max(CASE WHEN idx = n // 2 THEN b END) / 1048576.0 AS median_partition_size_mb,
         stddev_pop(b) AS partition_size_stddev,
         max(b) / (max(CASE WHEN idx = n // 2 THEN b END) + 1.0) AS partition_skew_ratio
  FROM part_rank GROUP BY ALL),
totals AS (
  SELECT app_id,
         CAST(sum(input_bytes) AS BIGINT) AS total_input_bytes,
         CAST(sum(shuffle_read_bytes) AS BIGINT) AS total_shuffle_read_bytes,
         CAST(sum(shuffle_write_bytes) AS BIGINT) AS total_shuffle_write_bytes,
         CAST(sum(memory_spill) AS BIGINT) AS total_spill_memory_bytes,
         CAST(sum(disk_spill) AS BIGINT) AS total_spill_disk_bytes,
         CAST(sum(executor_runtime) AS BIGINT) AS total_executor_runtime,
         CAST(sum(executor_cpu_time) AS BIGINT) AS total_executor_cpu_time,
         avg(task_runtime) AS task_runtime_mean,
         stddev_samp(task_runtime) AS task_runtime_stddev,
         max(task_runtime) AS task_runtime_max,
         min(task_runtime) AS task_runtime_min
  FROM tasks GROUP BY ALL)"""

STAGE_SUMMARY = """
stage_summary AS (
  SELECT app_id, count(*) AS num_stages, max(stage_time) AS longest_stage_time,
         avg(num_tasks) AS avg_tasks_per_stage, max(num_tasks) AS max_parallel_tasks
  FROM stages GROUP BY ALL)"""

CRITICAL = """
edges AS (SELECT app_id, stage_id AS v, unnest(parents) AS p FROM stages),
paths(app_id, v, d) AS (
  SELECT app_id, stage_id, stage_time FROM stages
  UNION
  SELECT e.app_id, e.v, pth.d + s.stage_time
  FROM paths pth
  JOIN edges e ON e.app_id = pth.app_id AND e.p = pth.v
  JOIN stages s ON s.app_id = e.app_id AND s.stage_id = e.v),
longest AS (SELECT app_id, v AS stage_id, max(d) AS path_time FROM paths GROUP BY ALL)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(c.strip() for c in ctes)


# ---------------------------------------------------------------- F family
from pipelens.plans import oracle_lineage, oracle_names  # noqa: E402

SQL.update(oracle_names.SQL)
SQL.update(oracle_lineage.SQL)

q("agg_task_skew", with_(TASKS) + """
SELECT app_id, stage_id, max(output_rows) AS max_task_output,
       round(avg(output_rows), 6) AS avg_task_output,
       round(max(output_rows) / avg(output_rows), 6) AS skew_ratio
FROM tasks GROUP BY ALL""")

SQL["sort_skew_desc"] = SQL["agg_task_skew"] + "\nORDER BY skew_ratio DESC, app_id, stage_id"

q("agg_gini_grouped", with_(TASKS) + """,
r AS (SELECT app_id, stage_id, output_rows AS v,
             row_number() OVER (PARTITION BY app_id, stage_id ORDER BY output_rows) AS i
      FROM tasks WHERE output_rows IS NOT NULL),
g AS (SELECT app_id, stage_id, count(*) AS n, sum(v) AS s, sum(i * v) AS w FROM r GROUP BY ALL)
SELECT t.app_id, t.stage_id,
       round(CASE WHEN g.n IS NULL THEN 0.0
                  ELSE 2.0 * g.w / (g.n * CAST(g.s AS DOUBLE)) - (g.n + 1.0) / g.n END, 6)
         AS gini_output
FROM (SELECT DISTINCT app_id, stage_id FROM tasks) t LEFT JOIN g USING (app_id, stage_id)""")

q("agg_gini_global", with_(TASKS, RUNTIME_STATS) + """
SELECT app_id, round(gini_coefficient_runtime, 6) AS gini_coefficient_runtime FROM rt_gini""")

q("agg_task_totals", with_(TASKS, RUNTIME_STATS) + """
SELECT app_id, total_input_bytes, total_shuffle_read_bytes, total_shuffle_write_bytes,
       total_spill_memory_bytes, total_spill_disk_bytes, total_executor_runtime,
       total_executor_cpu_time FROM totals""")

q("agg_runtime_moments", with_(TASKS, RUNTIME_STATS) + """
SELECT app_id, round(task_runtime_mean, 6) AS task_runtime_mean,
       round(task_runtime_stddev, 6) AS task_runtime_stddev, task_runtime_max, task_runtime_min
FROM totals""")

q("agg_runtime_percentiles", with_(TASKS, RUNTIME_STATS) + """
SELECT app_id, round(task_runtime_median, 6) AS task_runtime_median,
       round(task_runtime_p95, 6) AS task_runtime_p95,
       round(task_runtime_p99, 6) AS task_runtime_p99 FROM rt_pct""")

q("agg_output_rows", with_(TASKS, ACTUAL) + "\nSELECT * FROM actual")

q("agg_partition_stats", with_(TASKS, RUNTIME_STATS) + """
SELECT app_id, round(max_partition_size_mb, 6) AS max_partition_size_mb,
       round(min_partition_size_mb, 6) AS min_partition_size_mb,
       round(median_partition_size_mb, 6) AS median_partition_size_mb,
       round(partition_size_stddev, 6) AS partition_size_stddev,
       round(partition_skew_ratio, 6) AS partition_skew_ratio FROM part_stats""")

q("agg_stage_summary", with_(STAGES, STAGE_SUMMARY) + """
SELECT app_id, num_stages, longest_stage_time, round(avg_tasks_per_stage, 6) AS avg_tasks_per_stage,
       max_parallel_tasks FROM stage_summary""")

q("join_task_output", with_(TASKS) + """
SELECT a.app_id, a.stage_id, a.task_id, a.task_runtime, b.output_rows
FROM tasks a JOIN tasks b USING (app_id, stage_id, task_id)""")

q("agg_corr", with_(TASKS) + """
SELECT a.app_id, round(corr(b.output_rows, a.task_runtime), 6) AS corr_rows_runtime
FROM tasks a JOIN tasks b USING (app_id, stage_id, task_id) GROUP BY ALL""")

q("fn_row_amplification", with_(TASKS) + """
SELECT app_id, stage_id, CAST(sum(output_rows) AS BIGINT) AS total_output_rows,
       count(*) AS total_input_rows,
       round(sum(output_rows) / NULLIF(count(*), 0), 6) AS row_amplification
FROM tasks GROUP BY ALL""")

q("proj_tasks", with_(TASKS) + "\nSELECT * FROM tasks")

q("proj_stages", with_(STAGES) + """
SELECT app_id, stage_id, stage_attempt_id, stage_name, num_tasks, submission_time,
       completion_time, stage_time, CAST(len(parents) AS INTEGER) AS num_parents FROM stages""")

q("graph_critical_path", with_(STAGES, CRITICAL, recursive=True) + "\nSELECT * FROM longest")

q("proj_plan_children", with_(EVENTS, EXECUTIONS) + """
SELECT app_id, execution_id, node_name, estimated_rows FROM children""")

q("proj_query_meta", with_(EVENTS, EXECUTIONS) + """
SELECT app_id, execution_id, sha256(query_text) AS query_text_hash, start_time FROM executions""")

q("proj_conf_kv", """
SELECT event_id, 'k' AS key, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS value
FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")

q("proj_conf_lookup", """
SELECT event_id, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS value,
       CAST(NULL AS VARCHAR) AS missing_value FROM events""")

q("pred_aqe_enabled", with_(EVENTS) + """
SELECT DISTINCT app_id, app_id <> 'N' AS aqe_enabled FROM ev""")

PATTERNS = [("UDF", "num_udf"), ("With", "num_cte"), ("Subquery", "num_subqueries"),
            ("Join", "num_joins"), ("CASE", "num_case_when")]


def _count_sql(col: str) -> str:
    return ",\n       ".join(
        f"CAST(coalesce((length({col}) - length(replace({col}, '{p}', ''))) // {len(p)}, 0) AS INTEGER) AS {n}"
        for p, n in PATTERNS)


q("fn_pattern_counts", f"SELECT doc_id, {_count_sql('text')} FROM documents")

q("pred_join_strategy_changed", """
SELECT page_id, coalesce(contains(html, 'SortMergeJoin') AND contains(html, 'BroadcastHashJoin'), false)
  AS join_strategy_changed FROM pages""")

q("agg_aqe_updates", with_(EVENTS, UPDATES) + """
SELECT app_id, execution_id, count(*) AS aqe_plan_updated_count FROM updates GROUP BY ALL""")

q("pred_skew_join", with_(EVENTS, UPDATES) + """
SELECT app_id, execution_id, coalesce(contains(plan_json, 'skew'), false)
  AS skew_join_optimization_applied FROM updates""")

q("join_skew_flag", with_(EVENTS, EXECUTIONS, UPDATES) + """
SELECT e.app_id, e.execution_id, coalesce(f.flag, false) AS skew_join_optimization_applied
FROM executions e LEFT JOIN (
  SELECT app_id, execution_id, bool_or(contains(plan_json, 'skew')) AS flag FROM updates GROUP BY ALL
) f USING (app_id, execution_id)""")

q("join_aqe_updates", with_(EVENTS, EXECUTIONS, UPDATES) + """
SELECT e.app_id, e.execution_id, coalesce(u.n, 0) AS aqe_plan_updated_count
FROM executions e LEFT JOIN (
  SELECT app_id, execution_id, count(*) AS n FROM updates GROUP BY ALL
) u USING (app_id, execution_id)""")

q("join_exec_start_end", with_(EVENTS, EXECUTIONS, ENDS) + """
SELECT e.app_id, e.execution_id, e.start_time, x.end_time, x.end_time - e.start_time AS execution_time_ms
FROM executions e LEFT JOIN ends x USING (app_id, execution_id)""")

q("join_cardinality", with_(TASKS, EVENTS, EXECUTIONS, ACTUAL, CARD) + """
SELECT app_id, execution_id, node_name, estimated_rows, actual_output_rows,
       round(cardinality_error_ratio, 6) AS cardinality_error_ratio,
       round(log_cardinality_error, 6) AS log_cardinality_error, statistics_issue_flag
FROM card""")

q("job_app_features", with_(TASKS, STAGES, EVENTS, EXECUTIONS, ACTUAL, CARD, RUNTIME_STATS,
                            STAGE_SUMMARY) + """,
f AS (
  SELECT t.*, p.task_runtime_p95, p.task_runtime_p99, p.task_runtime_median,
         g.gini_coefficient_runtime, ps.max_partition_size_mb, ps.min_partition_size_mb,
         ps.median_partition_size_mb, ps.partition_size_stddev, ps.partition_skew_ratio,
         s.num_stages, s.longest_stage_time, s.avg_tasks_per_stage, s.max_parallel_tasks,
         t.total_spill_memory_bytes / (t.total_shuffle_write_bytes + 1) AS spill_ratio,
         t.total_executor_cpu_time / (t.total_executor_runtime + 1) AS cpu_efficiency,
         t.total_executor_cpu_time / 1e6 / NULLIF(t.total_executor_runtime, 0) AS cpu_utilization,
         t.task_runtime_max / (p.task_runtime_median + 1) AS runtime_skew_ratio,
         p.task_runtime_p99 / (p.task_runtime_median + 1) AS p99_to_median_ratio
  FROM totals t
  LEFT JOIN rt_pct p USING (app_id) LEFT JOIN rt_gini g USING (app_id)
  LEFT JOIN part_stats ps USING (app_id) LEFT JOIN stage_summary s USING (app_id)),
f2 AS (
  SELECT *, partition_skew_ratio * spill_ratio AS shuffle_risk_score,
         runtime_skew_ratio * gini_coefficient_runtime AS skew_severity_score,
         spill_ratio * 2 AS memory_risk_score
  FROM f)
SELECT f2.app_id, total_input_bytes, total_shuffle_read_bytes, total_shuffle_write_bytes,
       total_spill_memory_bytes, total_spill_disk_bytes, total_executor_runtime,
       total_executor_cpu_time, round(task_runtime_mean, 6) AS task_runtime_mean,
       round(task_runtime_stddev, 6) AS task_runtime_stddev, task_runtime_max, task_runtime_min,
       round(task_runtime_p95, 6) AS task_runtime_p95, round(task_runtime_p99, 6) AS task_runtime_p99,
       round(task_runtime_median, 6) AS task_runtime_median,
       round(gini_coefficient_runtime, 6) AS gini_coefficient_runtime,
       round(max_partition_size_mb, 6) AS max_partition_size_mb,
       round(min_partition_size_mb, 6) AS min_partition_size_mb,
       round(median_partition_size_mb, 6) AS median_partition_size_mb,
       round(partition_size_stddev, 6) AS partition_size_stddev,
       round(partition_skew_ratio, 6) AS partition_skew_ratio,
       num_stages, longest_stage_time, round(avg_tasks_per_stage, 6) AS avg_tasks_per_stage,
       max_parallel_tasks, round(spill_ratio, 6) AS spill_ratio,
       round(cpu_efficiency, 6) AS cpu_efficiency, round(cpu_utilization, 6) AS cpu_utilization,
       round(runtime_skew_ratio, 6) AS runtime_skew_ratio,
       round(p99_to_median_ratio, 6) AS p99_to_median_ratio,
       round(shuffle_risk_score, 6) AS shuffle_risk_score,
       round(skew_severity_score, 6) AS skew_severity_score,
       round(memory_risk_score, 6) AS memory_risk_score,
       round(0.25 * shuffle_risk_score + 0.25 * skew_severity_score + 0.25 * memory_risk_score
             + 0.25 * cpu_efficiency, 6) AS overall_health_score,
       c.node_name, c.estimated_rows, c.actual_output_rows,
       round(c.cardinality_error_ratio, 6) AS cardinality_error_ratio,
       round(c.log_cardinality_error, 6) AS log_cardinality_error, c.statistics_issue_flag
FROM f2 LEFT JOIN card c USING (app_id)""")

q("job_query_features", with_(TASKS, STAGES, EVENTS, EXECUTIONS, ENDS, UPDATES, ACTUAL, CARD,
                              CRITICAL, recursive=True) + f""",
cp AS (SELECT app_id, max(path_time) AS critical_path_stage_time FROM longest GROUP BY ALL),
upd AS (SELECT app_id, execution_id, count(*) AS n, bool_or(contains(plan_json, 'skew')) AS skew
        FROM updates GROUP BY ALL)
SELECT e.app_id, e.execution_id, sha256(e.query_text) AS query_text_hash, e.start_time,
       x.end_time, x.end_time - e.start_time AS execution_time_ms,
       {_count_sql('e.query_text')},
       e.app_id <> 'N' AS aqe_enabled, coalesce(u.n, 0) AS aqe_plan_updated_count,
       coalesce(contains(e.plan_text, 'SortMergeJoin') AND contains(e.plan_text, 'BroadcastHashJoin'),
                false) AS join_strategy_changed,
       coalesce(u.skew, false) AS skew_join_optimization_applied,
       cp.critical_path_stage_time, c.node_name, c.estimated_rows, c.actual_output_rows,
       round(c.cardinality_error_ratio, 6) AS cardinality_error_ratio, c.statistics_issue_flag
FROM executions e
LEFT JOIN ends x USING (app_id, execution_id)
LEFT JOIN upd u USING (app_id, execution_id)
LEFT JOIN cp USING (app_id)
LEFT JOIN card c USING (app_id, execution_id)""")




# ---------------------------------------------------------------- sources / sinks
q("src_event_log", with_(TASKS) + """
SELECT app_id, stage_id, CAST(stage_attempt_id AS BIGINT) AS stage_attempt_id, task_id, executor_id,
       launch_time, finish_time, finish_time - launch_time AS task_runtime, executor_runtime,
       executor_cpu_time, memory_spill, disk_spill, input_bytes, shuffle_read_bytes,
       shuffle_write_bytes, output_rows FROM tasks""")

q("src_event_route", with_(TASKS, STAGES) + """
SELECT 'SparkListenerTaskEnd' AS event, count(*) AS n FROM tasks
UNION ALL SELECT 'SparkListenerStageCompleted', count(*) FROM stages
  WHERE app_id IN (SELECT app_id FROM tasks)
UNION ALL SELECT 'SparkListenerApplicationStart', count(DISTINCT app_id) FROM tasks
UNION ALL SELECT 'SparkListenerLogStart', count(DISTINCT app_id) FROM tasks
UNION ALL SELECT 'malformed', count(DISTINCT app_id) FROM tasks""")

q("proj_app_info", with_(TASKS) + """
SELECT app_id, min(launch_time) AS start_time, '4.1.2' AS spark_version FROM tasks GROUP BY ALL""")

SQL["limit_one"] = SQL["proj_app_info"] + "\nORDER BY app_id LIMIT 1"

SQL["sink_parquet"] = SQL["job_app_features"]

# ---------------------------------------------------------------- configuration, retrieval
from pipelens.plans import oracle_config  # noqa: E402

SQL.update(oracle_config.SQL)

# ---------------------------------------------------------------- remaining section-2 keys
FEAT = with_(TASKS, STAGES, RUNTIME_STATS, STAGE_SUMMARY) + """,
f AS (
  SELECT t.*, p.task_runtime_p95, p.task_runtime_p99, p.task_runtime_median,
         g.gini_coefficient_runtime, ps.max_partition_size_mb, ps.min_partition_size_mb,
         ps.median_partition_size_mb, ps.partition_size_stddev, ps.partition_skew_ratio,
         s.num_stages, s.longest_stage_time, s.avg_tasks_per_stage, s.max_parallel_tasks,
         t.total_spill_memory_bytes / (t.total_shuffle_write_bytes + 1) AS spill_ratio,
         t.total_executor_cpu_time / (t.total_executor_runtime + 1) AS cpu_efficiency,
         t.total_executor_cpu_time / 1e6 / NULLIF(t.total_executor_runtime, 0) AS cpu_utilization,
         t.task_runtime_max / (p.task_runtime_median + 1) AS runtime_skew_ratio,
         p.task_runtime_p99 / (p.task_runtime_median + 1) AS p99_to_median_ratio
  FROM totals t
  LEFT JOIN rt_pct p USING (app_id) LEFT JOIN rt_gini g USING (app_id)
  LEFT JOIN part_stats ps USING (app_id) LEFT JOIN stage_summary s USING (app_id)),
f2 AS (
  SELECT *, partition_skew_ratio * spill_ratio AS shuffle_risk_score,
         runtime_skew_ratio * gini_coefficient_runtime AS skew_severity_score,
         spill_ratio * 2 AS memory_risk_score
  FROM f)"""

q("fn_spill_ratio", FEAT + """
SELECT app_id, total_spill_memory_bytes, total_shuffle_write_bytes, round(spill_ratio, 6) AS spill_ratio
FROM f2""")
q("fn_cpu_efficiency", FEAT + """
SELECT app_id, round(cpu_efficiency, 6) AS cpu_efficiency, round(cpu_utilization, 6) AS cpu_utilization
FROM f2""")
q("fn_runtime_skew", FEAT + """
SELECT app_id, task_runtime_max, round(task_runtime_median, 6) AS task_runtime_median,
       round(runtime_skew_ratio, 6) AS runtime_skew_ratio FROM f2""")
q("fn_p99_ratio", FEAT + """
SELECT app_id, round(task_runtime_p99, 6) AS task_runtime_p99,
       round(p99_to_median_ratio, 6) AS p99_to_median_ratio FROM f2""")
q("fn_risk_scores", FEAT + """
SELECT app_id, round(shuffle_risk_score, 6) AS shuffle_risk_score,
       round(skew_severity_score, 6) AS skew_severity_score,
       round(memory_risk_score, 6) AS memory_risk_score,
       round(0.25 * shuffle_risk_score + 0.25 * skew_severity_score + 0.25 * memory_risk_score
             + 0.25 * cpu_efficiency, 6) AS overall_health_score FROM f2""")
CARD_ALL = with_(TASKS, EVENTS, EXECUTIONS, ACTUAL, CARD)
q("fn_cardinality_error", CARD_ALL + """
SELECT app_id, execution_id, node_name, round(cardinality_error_ratio, 6) AS cardinality_error_ratio
FROM card""")
q("fn_log_cardinality", CARD_ALL + """
SELECT app_id, execution_id, node_name, round(log_cardinality_error, 6) AS log_cardinality_error
FROM card""")
q("pred_statistics_issue", CARD_ALL + """
SELECT app_id, execution_id, node_name, statistics_issue_flag FROM card""")
q("join_cross_scalar", with_(TASKS) + """
SELECT t.app_id, t.stage_id, t.task_id, t.task_runtime, round(a.m, 6) AS task_runtime_mean
FROM tasks t JOIN (SELECT app_id, avg(task_runtime) AS m FROM tasks GROUP BY ALL) a USING (app_id)""")
q("win_rank_for_gini", with_(TASKS) + """
SELECT app_id, task_runtime, copies,
       CAST(sum(copies) OVER (PARTITION BY app_id ORDER BY task_runtime) - copies + 1 AS BIGINT) AS first_rank,
       CAST(sum(copies) OVER (PARTITION BY app_id) AS BIGINT) AS n_tasks
FROM (SELECT app_id, task_runtime, count(*) AS copies FROM tasks
      WHERE task_runtime IS NOT NULL GROUP BY ALL)""")
SQL["join_change_udf"] = SQL["pred_join_strategy_changed"]
SQL["lin_assignments"] = oracle_lineage.W + "\nSELECT * FROM assign"
SQL["src_rule_csv"] = SQL["job_rename_v2"]
SQL["src_required_cols"] = oracle_names.JOBS_RAW_SQL_REQUIRED
SQL["src_drop_embedded_header"] = "SELECT count(*) + 1 AS rows_read, count(*) AS rows_kept FROM orders"
