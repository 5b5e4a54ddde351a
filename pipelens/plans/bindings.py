"""Driver bindings: one ``(spark, sf_dir) -> DataFrame`` per operator key.

Each binding feeds an operator from the adapters in
:mod:`pipelens.sources.driver_tables` and rounds doubles to 6 decimals, the
same as its SQL twin in :mod:`pipelens.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from pipelens.functions import metrics as M
from pipelens.functions import text as T
from pipelens.operators import graph, stats
from pipelens.plans import features
from pipelens.sources import driver_tables as D

Binding = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Binding] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def register(key: str):
    def deco(fn: Binding) -> Binding:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir))
        run.__name__ = key
        run.__doc__ = fn.__doc__
        REGISTRY[key] = run
        return run
    return deco


TS = ["app_id", "stage_id"]
APP = ["app_id"]

# ---------------------------------------------------------------- F family


@register("agg_task_skew")
def _task_skew(spark, sf):
    return stats.task_skew(D.tasks(spark, sf), TS, "output_rows")


@register("sort_skew_desc")
def _sort_skew(spark, sf):
    return stats.sort_skew_desc(stats.task_skew(D.tasks(spark, sf), TS), TS)


@register("agg_gini_grouped")
def _gini_grouped(spark, sf):
    return stats.gini(D.tasks(spark, sf), TS, "output_rows", "gini_output")


@register("agg_gini_global")
def _gini_global(spark, sf):
    return stats.gini(D.tasks(spark, sf), APP, "task_runtime", "gini_coefficient_runtime")


@register("agg_task_totals")
def _totals(spark, sf):
    return stats.task_totals(D.tasks(spark, sf), APP)


@register("agg_runtime_moments")
def _moments(spark, sf):
    return stats.runtime_moments(D.tasks(spark, sf), APP)


@register("agg_runtime_percentiles")
def _percentiles(spark, sf):
    return stats.runtime_percentiles(D.tasks(spark, sf), APP)


@register("agg_output_rows")
def _output_rows(spark, sf):
    return stats.output_rows(D.tasks(spark, sf), APP)


@register("agg_partition_stats")
def _partition_stats(spark, sf):
    return stats.partition_stats(D.tasks(spark, sf), APP)


@register("agg_stage_summary")
def _stage_summary(spark, sf):
    return stats.stage_summary(D.stages(spark, sf), APP)


@register("join_task_output")
def _join_task_output(spark, sf):
    t = D.tasks(spark, sf)
    runtime = t.select("app_id", "stage_id", "task_id", "task_runtime")
    output = t.select("app_id", "stage_id", "task_id", "output_rows")
    return runtime.join(output, ["app_id", "stage_id", "task_id"])


@register("agg_corr")
def _corr(spark, sf):
    t = D.tasks(spark, sf)
    j = (t.select("app_id", "stage_id", "task_id", "task_runtime")
         .join(t.select("app_id", "stage_id", "task_id", "output_rows"),
               ["app_id", "stage_id", "task_id"]))
    return stats.correlation(j, APP, "output_rows", "task_runtime", "corr_rows_runtime")


@register("fn_row_amplification")
def _amplification(spark, sf):
    t = D.tasks(spark, sf)
    per_stage = t.groupBy(*TS).agg(F.sum("output_rows").alias("total_output_rows"),
                                   F.count(F.lit(1)).alias("total_input_rows"))
    return per_stage.withColumn("row_amplification",
                                M.row_amplification("total_output_rows", "total_input_rows"))


@register("proj_tasks")
def _proj_tasks(spark, sf):
    return D.tasks(spark, sf)


@register("proj_stages")
def _proj_stages(spark, sf):
    s = D.stages(spark, sf)
    return s.withColumn("num_parents", F.size("parents")).drop("parents")


@register("graph_critical_path")
def _critical_path(spark, sf):
    return graph.longest_path(D.stages(spark, sf), APP)


@register("proj_plan_children")
def _plan_children(spark, sf):
    return features.plan_children(D.executions(spark, sf))


@register("proj_query_meta")
def _query_meta(spark, sf):
    e = D.executions(spark, sf)
    return e.select("app_id", "execution_id", T.sha256("query_text").alias("query_text_hash"),
                    "start_time")


@register("proj_conf_kv")
def _conf_kv(spark, sf):
    p = D.event_props(spark, sf)
    return p.select("event_id", F.explode(F.map_entries("props")).alias("kv")).select(
        "event_id", F.col("kv.key").alias("key"), F.col("kv.value").alias("value"))


@register("proj_conf_lookup")
def _conf_lookup(spark, sf):
    p = D.event_props(spark, sf)
    return p.select("event_id", F.try_element_at("props", F.lit("k")).alias("value"),
                    F.try_element_at("props", F.lit("missing")).alias("missing_value"))


@register("pred_aqe_enabled")
def _aqe_enabled(spark, sf):
    c = D.app_conf(spark, sf)
    return c.select("app_id", F.coalesce(
        F.try_element_at("props", F.lit("spark.sql.adaptive.enabled")) == "true",
        F.lit(False)).alias("aqe_enabled"))


@register("fn_pattern_counts")
def _pattern_counts(spark, sf):
    d = D.table(spark, sf, "documents")
    return d.select("doc_id", *[c.alias(n) for n, c in T.pattern_counts("text").items()])


@register("pred_join_strategy_changed")
def _join_changed(spark, sf):
    p = D.table(spark, sf, "pages")
    return p.select("page_id", T.join_strategy_changed("html").alias("join_strategy_changed"))


@register("agg_aqe_updates")
def _aqe_updates(spark, sf):
    u = D.aqe_updates(spark, sf)
    return u.groupBy("app_id", "execution_id").agg(
        F.count(F.lit(1)).alias("aqe_plan_updated_count"))


@register("pred_skew_join")
def _skew_join(spark, sf):
    u = D.aqe_updates(spark, sf)
    return u.select("app_id", "execution_id",
                    T.skew_join_applied("plan_json").alias("skew_join_optimization_applied"))


@register("join_skew_flag")
def _join_skew_flag(spark, sf):
    e = D.executions(spark, sf).select("app_id", "execution_id")
    u = D.aqe_updates(spark, sf)
    flags = u.groupBy("app_id", "execution_id").agg(
        F.bool_or(T.skew_join_applied("plan_json")).alias("skew_join_optimization_applied"))
    return e.join(flags, ["app_id", "execution_id"], "left").fillna(
        {"skew_join_optimization_applied": False})


@register("join_aqe_updates")
def _join_aqe_updates(spark, sf):
    e = D.executions(spark, sf).select("app_id", "execution_id")
    u = D.aqe_updates(spark, sf).groupBy("app_id", "execution_id").agg(
        F.count(F.lit(1)).alias("aqe_plan_updated_count"))
    return e.join(u, ["app_id", "execution_id"], "left").fillna({"aqe_plan_updated_count": 0})


@register("join_exec_start_end")
def _exec_start_end(spark, sf):
    e = D.executions(spark, sf).select("app_id", "execution_id", "start_time")
    end = D.execution_ends(spark, sf)
    return e.join(end, ["app_id", "execution_id"], "left").withColumn(
        "execution_time_ms", M.elapsed("start_time", "end_time"))


@register("join_cardinality")
def _join_cardinality(spark, sf):
    ex = D.executions(spark, sf)
    return features.cardinality(features.plan_children(ex), D.tasks(spark, sf), APP)


@register("job_app_features")
def _app_features(spark, sf):
    return features.app_features(D.tasks(spark, sf), D.stages(spark, sf),
                                 D.executions(spark, sf))


@register("job_query_features")
def _query_features(spark, sf):
    return features.query_features(
        D.executions(spark, sf), D.execution_ends(spark, sf), D.aqe_updates(spark, sf),
        D.app_conf(spark, sf), D.stages(spark, sf), D.tasks(spark, sf))


# ---------------------------------------------------------------- N family
from pipelens.functions import names as N  # noqa: E402
from pipelens.plans import rename  # noqa: E402

INSTANCE, ENV = "E01", "P"


def _v2(spark, sf):
    return rename.rename_v2(D.jobs(spark, sf), D.rule_set(spark), INSTANCE, ENV, detail=True)


def _v1(spark, sf):
    return rename.rename_v1(D.jobs(spark, sf), D.rule_set(spark), INSTANCE, ENV, detail=True)


def _audit(df):
    return df.select("input_order", F.col("job_name").alias("old_job_name"), "new_job_name",
                     "status", "notes", "app_code", "instance", "env", "schedule", "as_job_type",
                     "subject_code", "etl_type", "job_id", "suffix",
                     F.col("job_type").alias("original_job_type"))


@register("job_rename_v2")
def _job_rename_v2(spark, sf):
    return rename.rename_v2(D.jobs(spark, sf), D.rule_set(spark), INSTANCE, ENV)


@register("job_rename_v1")
def _job_rename_v1(spark, sf):
    return rename.rename_v1(D.jobs(spark, sf), D.rule_set(spark), INSTANCE, ENV)


def _parsed(df):
    return df.select("input_order", "_p.app_prefix", "_p.schedule_token", "_p.type_suffix",
                     "_p.suffix_body", "_p.is_zzz")


@register("fn_parse_name_v2")
def _parse_v2(spark, sf):
    return D.jobs(spark, sf).select(
        "input_order", N.parse_name(rename.N.strip_ws(F.coalesce("job_name", F.lit(""))), 2)
        .alias("_p")).transform(_parsed)


@register("fn_parse_name_v1")
def _parse_v1(spark, sf):
    return D.jobs(spark, sf).select(
        "input_order", N.parse_name(rename.N.strip_ws(F.coalesce("job_name", F.lit(""))), 1)
        .alias("_p")).transform(_parsed)


@register("fn_candidate_tokens")
def _cands(spark, sf):
    return _v2(spark, sf).select("input_order", N.candidate_tokens("job_name").alias("candidates"),
                                 F.col("_cands").alias("derivation_candidates"))


@register("fn_category_from_tokens")
def _category(spark, sf):
    j = rename.prepare_jobs(D.jobs(spark, sf))
    return j.select("input_order", N.category_from_tokens("job_name").alias("token_category"))


@register("agg_token_pair_freq")
def _pair_freq(spark, sf):
    j = rename.prepare_jobs(D.jobs(spark, sf))
    return rename.token_pair_freq(j).select(F.col("_p0").alias("token_a"),
                                            F.col("_p1").alias("token_b"), "_pair_count") \
        .withColumnRenamed("_pair_count", "pair_count")


@register("fn_derive_subject")
def _derive(spark, sf):
    d = _v2(spark, sf)
    s = N.derive_subject("_cands", "_pair_count")
    return d.select("input_order", s["subject_code"].alias("derived_subject"),
                    s["strip"].alias("derived_strip"),
                    F.coalesce("_pair_count", F.lit(0)).alias("pair_count"))


@register("fn_app_code_v2")
def _app_code(spark, sf):
    return _v2(spark, sf).select("input_order", "app_code",
                                 F.col("_app_exc").alias("app_exception"))


@register("join_code_lookup")
def _code_lookup(spark, sf):
    return _v2(spark, sf).select("input_order", "schedule", F.col("_sched_hit").alias("sched_hit"),
                                 "as_job_type", F.col("_ast_hit").alias("ast_hit"), "etl_type",
                                 F.col("_etl_hit").alias("etl_hit"))


@register("join_rule_exact")
def _rule_exact(spark, sf):
    return _v2(spark, sf).select("input_order", F.col("_exact.subject_code").alias("exact_subject"),
                                 F.col("_exact.category").alias("exact_category"))


@register("join_rule_longest_prefix")
def _rule_prefix(spark, sf):
    return _v2(spark, sf).select("input_order",
                                 F.col("_prefix.subject_code").alias("prefix_subject"),
                                 F.col("_prefix.category").alias("prefix_category"),
                                 F.col("_prefix.strip").alias("prefix_strip"))


@register("join_rule_regex")
def _rule_regex(spark, sf):
    return _v2(spark, sf).select("input_order", F.col("_regex.subject_code").alias("regex_subject"),
                                 F.col("_regex.category").alias("regex_category"))


@register("join_rule_tiers")
def _rule_tiers(spark, sf):
    return _v2(spark, sf).select("input_order", "subject_code", "category",
                                 F.col("_subj.strip").alias("strip"),
                                 F.col("_derived").alias("is_derived"))


@register("win_first_match")
def _first_match(spark, sf):
    return _v2(spark, sf).select(
        "input_order",
        F.coalesce("_exact", "_prefix", "_regex")["subject_code"].alias("first_match_subject"))


@register("win_sequential_id_v2")
def _seq_v2(spark, sf):
    return _v2(spark, sf).select("input_order", "subject_code", "category", "job_id_num")


@register("win_sequential_id_v1")
def _seq_v1(spark, sf):
    return _v1(spark, sf).select("input_order", "subject_code", "category", "job_id_num")


@register("fn_guard_echo")
def _echo(spark, sf):
    return _v2(spark, sf).select("input_order", "app_code", "subject_code",
                                 (F.substring("subject_code", 1, 5) == F.col("app_code"))
                                 .alias("echo"))


@register("fn_clean_suffix")
def _clean_suffix(spark, sf):
    return _v2(spark, sf).select("input_order", F.col("_p.suffix_body").alias("suffix_body"),
                                 F.col("_suffix_full").alias("suffix_full"))


@register("fn_cut_suffix_v1")
def _cut_v1(spark, sf):
    return _v1(spark, sf).select("input_order", F.col("_suffix_full").alias("suffix_full"),
                                 "suffix")


@register("fn_build_name")
def _build_name(spark, sf):
    return _v2(spark, sf).select("input_order", "new_job_name")


@register("fn_validate_name")
def _validate(spark, sf):
    return _v2(spark, sf).select("input_order", "new_job_name",
                                 F.col("_viol").alias("violations"))


@register("fn_status_notes")
def _status_notes(spark, sf):
    return _v2(spark, sf).select("input_order", "status", "notes")


@register("agg_status_summary")
def _status_summary(spark, sf):
    return rename.status_summary(
        rename.rename_v2(D.jobs(spark, sf), D.rule_set(spark), INSTANCE, ENV))


@register("topk_exceptions")
def _topk(spark, sf):
    r = rename.rename_v2(D.jobs(spark, sf), D.rule_set(spark), INSTANCE, ENV)
    return rename.top_exceptions(r, 5)


# ---------------------------------------------------------------- G family
from pipelens.operators import lineage as L  # noqa: E402
from pipelens.plans import lineage_jobs as LJ  # noqa: E402

LP = L.P
LKEYS = [LP, "target_table", "target_column"]


def _assign(spark, sf):
    return D.assignments(spark, sf)


@register("lin_last_definition_wins")
def _latest(spark, sf):
    return L.last_definition(_assign(spark, sf))


@register("lin_expand_star")
def _expand_star(spark, sf):
    return L.expand_star(L.last_definition(_assign(spark, sf))).drop("star_column")


@register("lin_base_tables")
def _base_tables(spark, sf):
    return L.base_tables(L.last_definition(_assign(spark, sf)))


@register("set_union_sources")
def _union_sources(spark, sf):
    latest = L.last_definition(_assign(spark, sf))
    return LJ.union_sources(latest)


@register("join_base_tables_anti")
def _base_anti(spark, sf):
    return L.base_tables_anti(L.last_definition(_assign(spark, sf)))


def _expanded(spark, sf):
    """Latest definitions and star-expanded rows, written: both are read often."""
    root = scratch_path(spark, "expanded")
    latest = graph.materialize(L.last_definition(_assign(spark, sf)), f"{root}/latest")
    a = L.with_stars_expanded(latest).where(L.valid_column_name("target_column"))
    return latest, graph.materialize(a, f"{root}/assignments")


@register("lin_base_columns")
def _base_columns(spark, sf):
    latest, a = _expanded(spark, sf)
    return L.base_columns(a, defined=L.defined_tables(latest))


@register("lin_name_fallback")
def _fallback(spark, sf):
    latest, a = _expanded(spark, sf)
    ends = graph.materialize(L.column_terminals(a, defined=L.defined_tables(latest)), scratch_path(spark, "ends"))
    return L.name_fallback(a, ends)


@register("lin_final")
def _final(spark, sf):
    return L.final_lineage(_assign(spark, sf))


@register("agg_sources_per_target")
def _sources_per_target(spark, sf):
    return LJ.sources_per_target(_assign(spark, sf))


@register("job_column_lineage")
def _job_column_lineage(spark, sf):
    return LJ.column_lineage(_assign(spark, sf))


@register("lin_multi_hop_nodes")
def _nodes(spark, sf):
    return L.multi_hop_nodes(_assign(spark, sf))


@register("set_dedup_nodes")
def _dedup_nodes(spark, sf):
    return L.multi_hop_nodes(_assign(spark, sf)).select("graph_id", "id")


@register("lin_multi_hop_edges")
def _edges(spark, sf):
    return L.multi_hop_edges(_assign(spark, sf))


@register("set_dedup_edges")
def _dedup_edges(spark, sf):
    return L.multi_hop_edges(_assign(spark, sf)).select(
        "graph_id", "source", "target", F.coalesce("logic", F.lit("")).alias("logic_key"))


@register("job_multi_hop")
def _job_multi_hop(spark, sf):
    return LJ.multi_hop(_assign(spark, sf))


@register("lin_validate_fix")
def _validate_fix(spark, sf):
    return L.validate_fix(L.final_lineage(_assign(spark, sf)), default_table="landing_raw.records")


@register("set_missing_refs")
def _missing_refs(spark, sf):
    return LJ.missing_and_unused(L.final_lineage(_assign(spark, sf))).select(
        *LKEYS, "missing_refs")


@register("set_unused_sources")
def _unused(spark, sf):
    return LJ.missing_and_unused(L.final_lineage(_assign(spark, sf))).select(
        *LKEYS, "unused_sources")


@register("set_unique_details")
def _unique_details(spark, sf):
    details = LJ.unique_details(L.final_lineage(_assign(spark, sf)))
    return details.select(LP, "target_column", F.transform("unique_details", lambda d: F.to_json(d)).alias("unique_details"))


@register("fn_column_refs")
def _column_refs(spark, sf):
    latest = L.last_definition(_assign(spark, sf))
    e = latest.where(F.col("expression").isNotNull()).select(*LKEYS, "expression").distinct()
    return e.select(*LKEYS, "expression", F.sort_array(T.column_refs("expression")).alias("refs"))


@register("fn_strip_derv")
def _strip_derv(spark, sf):
    latest = L.last_definition(_assign(spark, sf))
    e = latest.where(F.col("expression").isNotNull()).select(*LKEYS, "expression").distinct()
    return e.select(*LKEYS, F.sort_array(F.array_distinct(F.transform(
        T.column_refs("expression"), T.strip_derv))).alias("base_refs"))


@register("fn_truncate_logic")
def _truncate(spark, sf):
    return L.multi_hop_edges(_assign(spark, sf)).select(
        "graph_id", "source", "target",
        T.truncate(F.coalesce("logic", F.lit("Transform")), L.LABEL_LOGIC_LEN).alias("label"))


@register("pred_valid_column_name")
def _valid_names(spark, sf):
    d = D.table(spark, sf, "documents")
    toks = d.select(F.explode(F.split("text", " ")).alias("token")).distinct()
    return toks.select("token", L.valid_column_name("token").alias("is_valid"))


@register("pred_not_na_table")
def _not_na(spark, sf):
    latest = L.last_definition(_assign(spark, sf))
    t = latest.select(F.col("source_table").alias("table")).distinct()
    return t.select("table", L.not_na_table("table").alias("keep"))


@register("pred_target_table")
def _target_pred(spark, sf):
    n = L.multi_hop_nodes(_assign(spark, sf)).where(F.col("type") == "table")
    return n.select("id", L.is_target_table("id", "report").alias("is_report_target"),
                    L.is_target_table("id", "node").alias("is_node_target"),
                    L.is_target_table("id", "builder").alias("is_builder_target"))


@register("pred_bare_column")
def _bare(spark, sf):
    latest = L.last_definition(_assign(spark, sf))
    e = latest.where(F.col("expression").isNotNull()).select("expression").distinct()
    return e.select("expression", L.bare_column("expression").alias("is_bare"))


@register("fn_schema_prefix")
def _schema_prefix(spark, sf):
    latest = L.last_definition(_assign(spark, sf))
    sch = L.counted_schema(_assign(spark, sf))
    bt = L.base_tables(latest).select(LP, "base_table").distinct()
    return bt.join(sch, LP).select(LP, "base_table", "schema",
                                   L.schema_prefix("base_table", "schema").alias("qualified"))


@register("join_alias_resolve")
def _alias_resolve(spark, sf):
    refs, sources = D.alias_refs(_assign(spark, sf))
    return L.resolve_aliases(refs, sources).select(LP, "stmt_order", "target_column", "ordinal",
                                                    "alias", "column", "source_table")


@register("agg_distinct_labels")
def _labels(spark, sf):
    n = L.multi_hop_nodes(_assign(spark, sf))
    return n.where(F.col("type") == "column").select("label").distinct().orderBy("label")


@register("graph_table_edges")
def _table_edges(spark, sf):
    return LJ.table_graph_edges(LJ.column_lineage(_assign(spark, sf)))


@register("graph_column_edges")
def _column_edges(spark, sf):
    return LJ.column_graph_edges(L.final_lineage(_assign(spark, sf)))


@register("graph_hub_edges")
def _hub_edges(spark, sf):
    return LJ.hub_edges(L.final_lineage(_assign(spark, sf)))


@register("graph_column_groups")
def _column_groups(spark, sf):
    return LJ.column_groups(L.multi_hop_nodes(_assign(spark, sf)))


@register("graph_edge_details")
def _edge_details(spark, sf):
    return LJ.edge_details(L.multi_hop_edges(_assign(spark, sf)), "c2")


@register("graph_upstream")
def _upstream(spark, sf):
    return LJ.upstream_of_label(L.multi_hop_nodes(_assign(spark, sf)),
                                L.multi_hop_edges(_assign(spark, sf)), "c0")


@register("lin_simple_ctas")
def _simple_ctas(spark, sf):
    return L.simple_ctas(D.statements(spark, sf))


@register("lin_simple_gate")
def _simple_gate(spark, sf):
    return L.simple_gate(D.statements(spark, sf))


# ---------------------------------------------------------------- sources / sinks
from pipelens.session import scratch_path  # noqa: E402
from pipelens.sources import csv_tables as C  # noqa: E402
from pipelens.sources import eventlog as EL  # noqa: E402
from pipelens.sources import lineage_documents as LD  # noqa: E402
from pipelens.sources import sinks as SK  # noqa: E402


def _event_log(spark, sf):
    """Write the task / stage adapters as Spark event logs; parse them once."""
    out = scratch_path(spark, "eventlog")
    D.write_event_log(D.tasks(spark, sf), D.stages(spark, sf), out)
    return EL.ingest(spark, out)


@register("src_event_log")
def _src_event_log(spark, sf):
    return EL.normalize(_event_log(spark, sf))["tasks"]


@register("src_event_route")
def _src_event_route(spark, sf):
    raw = _event_log(spark, sf)
    return raw.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@register("proj_app_info")
def _app_info(spark, sf):
    return EL.app_info(EL.normalize(_event_log(spark, sf))["apps"])


@register("limit_one")
def _limit_one(spark, sf):
    return EL.app_info(EL.normalize(_event_log(spark, sf))["apps"]).orderBy("app_id").limit(1)


@register("src_jobs_csv")
def _src_jobs_csv(spark, sf):
    out = scratch_path(spark, "jobs-csv")
    j = D.jobs(spark, sf).select(F.col("input_order").cast("string").alias("Row"),
                                 F.col("job_name").alias(" Job_Name "), F.col("job_type").alias("JOB_TYPE"),
                                 F.col("application_name").alias("application_name"))
    header_row = spark.createDataFrame([("Row", "job_name", "job_type", "application_name")], j.schema)
    C.write_csv(j.unionByName(header_row), out)
    return C.read_jobs_csv(spark, out).select("row", "job_name", "job_type", "application_name")


@register("sink_csv")
def _sink_csv(spark, sf):
    out = scratch_path(spark, "renamed-csv")
    C.write_csv(rename.rename_v1(D.jobs(spark, sf), D.rule_set(spark), INSTANCE, ENV), out)
    back = C.read_string_csv(spark, out)
    return back.withColumn("input_order", F.col("input_order").cast("long"))


@register("sink_parquet")
def _sink_parquet(spark, sf):
    out = scratch_path(spark, "features-parquet")
    SK.write_parquet(features.app_features(D.tasks(spark, sf), D.stages(spark, sf),
                                           D.executions(spark, sf)), out, ["app_id"])
    return spark.read.parquet(out)


@register("sink_json")
def _sink_json(spark, sf):
    """A document per target table, read back unchanged."""
    out = scratch_path(spark, "lineage-json")
    LD.write_documents(LD.direct_documents(LJ.column_lineage(_assign(spark, sf)), [LP]), out)
    return LD.read_documents(spark, out).definitions().drop("position")


@register("src_lineage_json")
def _src_lineage_json(spark, sf):
    """Documents of both formats and lines that are none, in one folder."""
    out = scratch_path(spark, "mixed-json")
    # written and resolved once for the documents of both formats
    assign = graph.materialize(_assign(spark, sf), scratch_path(spark, "mixed-assignments"))
    resolved = L.resolve(assign, True, "mixed")
    tables = graph.materialize(L.base_tables(resolved[0], "mixed-base"), scratch_path(spark, "mixed-tables"))
    LD.write_documents(LD.direct_documents(LJ.column_lineage(assign, resolved=resolved, tables=tables), [LP]), out)
    nodes = graph.materialize(L.multi_hop_nodes(assign, resolved[0], tables), scratch_path(spark, "mixed-nodes"))
    graphs = LD.graph_documents(nodes, L.multi_hop_edges(assign, resolved=resolved))
    LD.write_documents(graphs.withColumnRenamed("graph_id", LP), out)
    broken = assign.select(LP, F.format_string('{"target_table": "%s", ', "target_table").alias("value")).distinct()
    LD.write_documents(broken, out)
    return LD.read_documents(spark, out).records()


# ---------------------------------------------------------------- configuration, retrieval
from pipelens.plans import config as CFG  # noqa: E402
from pipelens.plans import retrieval as RT  # noqa: E402


def _configs(spark, sf):
    out = scratch_path(spark, "configs")
    D.config_lines(spark, sf).write.mode("overwrite").text(out)
    return CFG.read_configs(spark, out)


def _cfg_tables(spark, sf):
    return CFG.flatten(_configs(spark, sf))


@register("cfg_flatten")
def _cfg_flatten(spark, sf):
    return _cfg_tables(spark, sf)["flows"]


@register("cfg_schema_check")
def _cfg_schema_check(spark, sf):
    c = CFG.schema_check(_configs(spark, sf))
    return c.groupBy("is_valid", "reason").agg(F.count(F.lit(1)).alias("n"))


@register("cfg_frame_links")
def _cfg_frame_links(spark, sf):
    return CFG.frame_links(_cfg_tables(spark, sf))


@register("cfg_flow_dag")
def _cfg_flow_dag(spark, sf):
    return CFG.flow_dag(_cfg_tables(spark, sf))


@register("cfg_knowledge_graph")
def _cfg_kg(spark, sf):
    nodes, edges = CFG.knowledge_graph(_cfg_tables(spark, sf))
    source = nodes.groupBy("application", F.col("id").alias("source")).agg(
        F.sort_array(F.collect_set("type")).alias("source_types"))
    target = nodes.groupBy("application", F.col("id").alias("target")).agg(
        F.sort_array(F.collect_set("type")).alias("target_types"))
    return edges.join(source, ["application", "source"], "left").join(target, ["application", "target"], "left")


@register("qa_feeders")
def _qa_feeders(spark, sf):
    t = _cfg_tables(spark, sf)
    last = t["flows"].groupBy("application").agg(
        F.max_by("flow_id", F.col("flow_id").substr(2, 20).cast("long")).alias("flow_id"))
    return CFG.feeders(t, last)


@register("qa_grounding")
def _qa_grounding(spark, sf):
    t = _cfg_tables(spark, sf)
    dep = t["dependencies"].select(F.col("flow_id").alias("source"),
                                   F.col("depends_on").alias("target"))
    k = F.col("source").substr(2, 20).cast("long")
    fake = dep.where(k % 5 == 0).select(F.col("target").alias("source"),
                                        F.col("source").alias("target"))
    return CFG.grounding(dep.unionByName(fake), dep)


def _emb(spark, sf):
    return D.table(spark, sf, "embeddings")


@register("ret_vector_topk")
def _ret_topk(spark, sf):
    e = _emb(spark, sf)
    return RT.vector_topk(e, RT.query_vectors(e), 5)


@register("ret_metadata_filter")
def _ret_filter(spark, sf):
    e = _emb(spark, sf)
    return RT.metadata_filter_topk(e, RT.query_vectors(e), 5)


@register("ret_hybrid")
def _ret_hybrid(spark, sf):
    e = _emb(spark, sf)
    return RT.hybrid_topk(e, RT.query_vectors(e), D.vector_edges(spark, sf), 5)


# ---------------------------------------------------------------- remaining section-2 keys
def _app_row(spark, sf):
    return features.app_feature_row(D.tasks(spark, sf), D.stages(spark, sf))


@register("fn_spill_ratio")
def _spill(spark, sf):
    return _app_row(spark, sf).select("app_id", "total_spill_memory_bytes",
                                      "total_shuffle_write_bytes", "spill_ratio")


@register("fn_cpu_efficiency")
def _cpu(spark, sf):
    return _app_row(spark, sf).select("app_id", "cpu_efficiency", "cpu_utilization")


@register("fn_runtime_skew")
def _rt_skew(spark, sf):
    return _app_row(spark, sf).select("app_id", "task_runtime_max", "task_runtime_median",
                                      "runtime_skew_ratio")


@register("fn_p99_ratio")
def _p99(spark, sf):
    return _app_row(spark, sf).select("app_id", "task_runtime_p99", "p99_to_median_ratio")


@register("fn_risk_scores")
def _risk(spark, sf):
    return _app_row(spark, sf).select("app_id", *M.risk_scores().keys())


def _card(spark, sf):
    return features.cardinality(features.plan_children(D.executions(spark, sf)),
                                D.tasks(spark, sf), APP)


@register("fn_cardinality_error")
def _card_err(spark, sf):
    return _card(spark, sf).select("app_id", "execution_id", "node_name", "cardinality_error_ratio")


@register("fn_log_cardinality")
def _card_log(spark, sf):
    return _card(spark, sf).select("app_id", "execution_id", "node_name", "log_cardinality_error")


@register("pred_statistics_issue")
def _stat_issue(spark, sf):
    return _card(spark, sf).select("app_id", "execution_id", "node_name", "statistics_issue_flag")


@register("join_cross_scalar")
def _cross_scalar(spark, sf):
    t = D.tasks(spark, sf)
    per_app = stats.runtime_moments(t, APP).select("app_id", "task_runtime_mean")
    # the reference's crossJoin of a one-row aggregate, as an equi-join per app
    return t.select("app_id", "stage_id", "task_id", "task_runtime").join(per_app, "app_id")


@register("win_rank_for_gini")
def _rank_for_gini(spark, sf):
    h = stats.rank_histogram(D.tasks(spark, sf), APP, "task_runtime")
    return h.select("app_id", F.col("v").alias("task_runtime"), F.col("c").alias("copies"),
                    (F.col("below") + 1).alias("first_rank"), F.col("n").alias("n_tasks"))


@register("lin_assignments")
def _lin_assignments(spark, sf):
    return D.assignments(spark, sf)


@register("join_change_udf")
def _join_change_udf(spark, sf):
    p = D.table(spark, sf, "pages")
    return p.select("page_id", T.join_strategy_changed("html").alias("join_strategy_changed"))


def _rules_via_csv(spark):
    """Write the inline rule tables as the five mapping CSVs, read them back."""
    folder = scratch_path(spark, "mappings")
    rs = D.rule_set(spark)
    for key, (name, cols) in C.RULE_FILES.items():
        C.write_csv(getattr(rs, key).orderBy("rule_order").select(*cols).coalesce(1),
                    f"{folder}/{name}")
    return C.read_rule_csvs(spark, folder)


@register("src_rule_csv")
def _src_rule_csv(spark, sf):
    return rename.rename_v2(D.jobs(spark, sf), _rules_via_csv(spark), INSTANCE, ENV)


def _jobs_csv_path(spark, sf):
    out = scratch_path(spark, "jobs-csv")
    j = D.jobs(spark, sf).select(F.col("input_order").cast("string").alias("Row"),
                                 F.col("job_name").alias("job_name"), F.col("job_type").alias("job_type"))
    header_row = spark.createDataFrame([("Row", "job_name", "job_type")], j.schema)
    C.write_csv(j.unionByName(header_row), out)
    return out


@register("src_required_cols")
def _src_required(spark, sf):
    return C.read_jobs_csv(spark, _jobs_csv_path(spark, sf)).select("job_name", "job_type")


@register("src_drop_embedded_header")
def _src_drop_header(spark, sf):
    raw = C.read_string_csv(spark, _jobs_csv_path(spark, sf))
    return raw.agg(F.count(F.lit(1)).alias("rows_read"),
                   F.count(F.when(C.is_data_row("row"), 1)).alias("rows_kept"))
