"""F family end-to-end jobs: execution-log tables -> feature rows.

``app_features``   one feature set per application (x plan child)
``query_features`` one row per SQL execution (x plan child)

Inputs are the normalised tables of SURVEY 1.2 (``tasks``, ``stages``,
``executions``, ...), keyed by ``app_id`` so thousands of applications run in
one plan. Aggregates are per application; the scalar broadcasts of the
reference (``crossJoin`` of one-row frames) become equi-joins on ``app_id``
over one-row-per-app aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.functions import metrics as M
from pipelens.functions import text as T
from pipelens.operators import graph, stats

APP = ["app_id"]


def plan_children(executions: DataFrame, plan_col: str = "plan_json",
                  keys=("app_id", "execution_id")) -> DataFrame:
    """``proj_plan_children``: top-level plan children with their row estimate.

    Real plan JSON carries no ``statistics`` -> ``estimated_rows`` is null."""
    schema = "struct<children:array<struct<nodeName:string,statistics:struct<rowCount:long>>>>"
    parsed = executions.select(*keys, F.from_json(F.col(plan_col), schema).alias("_p"))
    return parsed.select(*keys, F.explode("_p.children").alias("_n")).select(
        *keys, F.col("_n.nodeName").alias("node_name"),
        F.col("_n.statistics.rowCount").alias("estimated_rows"))


def cardinality(children: DataFrame, tasks: DataFrame, keys=APP) -> DataFrame:
    """``join_cardinality``: plan children x actual rows written, one row per
    child (the fan-out is the grain), ratio, log ratio and issue flag."""
    actual = stats.output_rows(tasks, keys)
    return with_cardinality(children.join(actual, on=list(keys), how="left"))


def with_cardinality(rows: DataFrame) -> DataFrame:
    """Ratio, log ratio and flag for rows with actual and estimated rows."""
    return (rows.withColumn("cardinality_error_ratio", M.cardinality_error("actual_output_rows", "estimated_rows"))
            .withColumn("log_cardinality_error", M.log_cardinality("cardinality_error_ratio"))
            .withColumn("statistics_issue_flag", M.statistics_issue("cardinality_error_ratio")))


def app_task_features(tasks: DataFrame, keys=APP) -> DataFrame:
    """Totals, moments, exact percentiles, Gini of task runtime and the
    partition-size statistics per application (one row per app), from two scans:
    one aggregate of all sums, and one stacked histogram of the ranked metrics.
    ``actual_output_rows`` comes along for the plan children."""
    g = list(keys)
    totals_moments = tasks.groupBy(*g).agg(
        F.sum("input_bytes").alias("total_input_bytes"),
        F.sum("shuffle_read_bytes").alias("total_shuffle_read_bytes"),
        F.sum("shuffle_write_bytes").alias("total_shuffle_write_bytes"),
        F.sum("memory_spill").alias("total_spill_memory_bytes"),
        F.sum("disk_spill").alias("total_spill_disk_bytes"),
        F.sum("executor_runtime").alias("total_executor_runtime"),
        F.sum("executor_cpu_time").alias("total_executor_cpu_time"),
        F.avg("task_runtime").alias("task_runtime_mean"),
        F.stddev_samp("task_runtime").alias("task_runtime_stddev"),
        F.max("task_runtime").alias("task_runtime_max"),
        F.min("task_runtime").alias("task_runtime_min"),
        F.sum("output_rows").alias("actual_output_rows"),
        *stats.partition_aggregates())
    ranks = stats.stacked_histogram(tasks, g, {
        "runtime": "task_runtime", "partition": F.coalesce("shuffle_read_bytes", F.lit(0))})
    ranked = stats.summarise(
        ranks, g,
        stats.percentile_measure([0.95, 0.99, 0.5], ["task_runtime_p95", "task_runtime_p99", "task_runtime_median"], "runtime"),
        stats.gini_measure("gini_coefficient_runtime", "runtime"),
        stats.upper_median_measure("_med", "partition"))
    sums = [c for c in totals_moments.columns if c not in (*g, "_max", "_min", "partition_size_stddev")]
    return totals_moments.join(ranked, g, "left").select(
        *g, *sums, *[c for c in ranked.columns if c not in (*g, "_med")], *stats.partition_columns())


def app_feature_row(tasks: DataFrame, stages: DataFrame, keys=APP) -> DataFrame:
    """One feature row per application: totals, moments, percentiles, Gini,
    partition stats, stage summary, ratios and risk scores."""
    return _feature_row(tasks, stages, keys).drop("actual_output_rows")


def _feature_row(tasks: DataFrame, stages: DataFrame, keys) -> DataFrame:
    g = list(keys)
    f = app_task_features(tasks, g).join(stats.stage_summary(stages, g), g, "left")
    f = (f.withColumn("spill_ratio", M.spill_ratio("total_spill_memory_bytes",
                                                   "total_shuffle_write_bytes"))
         .withColumn("cpu_efficiency", M.cpu_efficiency("total_executor_cpu_time",
                                                        "total_executor_runtime"))
         .withColumn("cpu_utilization", M.cpu_utilization("total_executor_cpu_time",
                                                          "total_executor_runtime"))
         .withColumn("runtime_skew_ratio", M.runtime_skew("task_runtime_max",
                                                          "task_runtime_median"))
         .withColumn("p99_to_median_ratio", M.p99_ratio("task_runtime_p99",
                                                        "task_runtime_median")))
    for name, col in M.risk_scores().items():
        f = f.withColumn(name, col)
    return f


def app_features(tasks: DataFrame, stages: DataFrame, executions: DataFrame,
                 keys=APP) -> DataFrame:
    """``job_app_features``: one feature set per application, joined to one
    row per top-level plan child of its SQL executions."""
    g = list(keys)
    children = plan_children(executions, keys=g + ["execution_id"]).drop("execution_id").withColumn("_child", F.lit(True))
    f = _feature_row(tasks, stages, g).join(children, g, "left")
    actual = F.when(F.col("_child"), F.col("actual_output_rows"))
    rows = with_cardinality(f.withColumn("actual_output_rows", actual).drop("_child"))
    last = ["node_name", "estimated_rows", "actual_output_rows", "cardinality_error_ratio",
            "log_cardinality_error", "statistics_issue_flag"]
    return rows.select(*[c for c in rows.columns if c not in last], *last)


def query_features(executions: DataFrame, ends: DataFrame, updates: DataFrame,
                   conf: DataFrame, stages_df: DataFrame, tasks: DataFrame,
                   keys=APP) -> DataFrame:
    """``job_query_features``: one row per SQL execution x plan child.

    Differences from the reference, on purpose: the skew flag is aggregated
    per execution before the join (``join_skew_flag``), so each execution
    keeps one row per plan child; the critical path and actual rows are per
    application, not global.
    """
    g = list(keys)
    ek = g + ["execution_id"]
    q = executions.join(ends, ek, "left").withColumn(
        "execution_time_ms", M.elapsed("start_time", "end_time"))
    for name, col in T.pattern_counts("query_text").items():
        q = q.withColumn(name, col)
    aqe = conf.select(*g, F.coalesce(F.try_element_at("props", F.lit("spark.sql.adaptive.enabled"))
                                     == "true", F.lit(False)).alias("aqe_enabled"))
    q = q.join(aqe, g, "left").fillna({"aqe_enabled": False})
    upd = updates.groupBy(*ek).agg(
        F.count(F.lit(1)).alias("aqe_plan_updated_count"),
        F.bool_or(T.skew_join_applied("plan_json")).alias("skew_join_optimization_applied"))
    q = (q.join(upd, ek, "left")
         .fillna({"aqe_plan_updated_count": 0, "skew_join_optimization_applied": False})
         .withColumn("join_strategy_changed", T.join_strategy_changed("plan_text")))
    path = graph.longest_path(stages_df, g)
    q = q.join(graph.critical_path_time(path, g), g, "left")
    card = cardinality(plan_children(executions, keys=ek), tasks, g)
    q = q.join(card.select(*ek, "node_name", "estimated_rows", "actual_output_rows",
                           "cardinality_error_ratio", "statistics_issue_flag"), ek, "left")
    return q.select(
        *g, "execution_id", T.sha256("query_text").alias("query_text_hash"),
        "start_time", "end_time", "execution_time_ms",
        *[name for _, name in T.PATTERN_COLUMNS],
        "aqe_enabled", "aqe_plan_updated_count", "join_strategy_changed",
        "skew_join_optimization_applied", "critical_path_stage_time",
        "node_name", "estimated_rows", "actual_output_rows",
        "cardinality_error_ratio", "statistics_issue_flag")
