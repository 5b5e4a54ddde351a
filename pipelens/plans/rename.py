"""N family end-to-end jobs: job list -> 14-column audit table.

``rename_v2`` (``job_rename_v2``) and ``rename_v1`` (``job_rename_v1``).
One plan per run: a projection that parses names, broadcast rule joins, one
aggregate (token-pair frequency, v2 only) joined back, one bucketed
numbering for the ids, then name building and validation as Columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.functions import names as N
from pipelens.operators import ids, rules as R
from pipelens.operators.graph import materialize, materialize_observed, sized
from pipelens.session import scratch_path

OUTPUT_COLUMNS = ["old_job_name", "new_job_name", "status", "notes", "app_code", "instance",
                  "env", "schedule", "as_job_type", "subject_code", "etl_type", "job_id",
                  "suffix", "original_job_type"]


@dataclass
class RuleSet:
    """The five rule tables, each with a ``rule_order`` (file position) column.

    app:      old_prefix, new_app_code   (used by v1 only, as in the reference)
    schedule: old_schedule, new_schedule
    etl:      old_suffix, new_etl_code
    as_type:  old_job_type, new_as_type
    subject:  pattern, match_type (exact / prefix / regex), subject_code, category
    """
    app: DataFrame
    schedule: DataFrame
    etl: DataFrame
    as_type: DataFrame
    subject: DataFrame


def _check_codes(instance_code: str, env_code: str) -> tuple[str, str]:
    inst, env = str(instance_code).strip(), str(env_code).strip()
    if len(inst) != 3:
        raise ValueError(f"instance_code must be exactly 3 characters, got: {instance_code!r}")
    if len(env) != 1:
        raise ValueError(f"env_code must be exactly 1 character, got: {env_code!r}")
    return inst.upper(), env.upper()


def prepare_jobs(jobs: DataFrame) -> DataFrame:
    """Strip the three text fields (null -> '')."""
    s = lambda c: N.strip_ws(F.coalesce(F.col(c).cast("string"), F.lit("")))
    cols = [F.col("input_order"), s("job_name").alias("job_name"), s("job_type").alias("job_type")]
    if "application_name" in jobs.columns:
        cols.append(s("application_name").alias("application_name"))
    else:
        cols.append(F.lit("").alias("application_name"))
    return jobs.select(*cols)


def token_pair_freq(jobs: DataFrame) -> DataFrame:
    """``agg_token_pair_freq``: count of (first, second) candidate tokens over
    all non-empty names, only pairs of total length <= 6 (no app-code skip)."""
    kept = "_kept" if "_kept" in jobs.columns else N.kept_tokens("job_name")
    return (jobs.where(F.col("job_name") != "").select(N.first_candidates(kept).alias("_c"))
            .where(N.pair_fits("_c"))
            .groupBy(N.at("_c", 1).alias("_p0"), N.at("_c", 2).alias("_p1"))
            .agg(F.count(F.lit(1)).alias("_pair_count")))


def _lookup_with_default(df: DataFrame, key: F.Column, rules: DataFrame, out: str) -> DataFrame:
    df = R.code_lookup(df, key, rules, f"_{out}_raw")
    hit = F.coalesce(F.col(f"_{out}_raw"), F.lit("")) != ""
    return df.withColumn(f"_{out}_hit", hit)


def _finish(df: DataFrame, found: F.Column, is_exception: F.Column,
            needs_review: F.Column, detail: bool = False) -> DataFrame:
    name = N.build_name("app_code", "instance", "env", "schedule", "as_job_type",
                        "subject_code", "etl_type", "job_id_num", "suffix")
    df = df.withColumn("new_job_name", name)
    viol = N.validate_name("new_job_name", "app_code", "instance", "schedule", "as_job_type",
                           "subject_code", "etl_type", "job_id_num")
    df = df.withColumn("_viol", viol)
    if detail:
        return (df.withColumn("status", N.status(is_exception, needs_review, "_viol"))
                .withColumn("notes", N.notes(found, "_viol"))
                .withColumn("job_id", N.zfill4("job_id_num")))
    return df.select(
        "input_order",
        F.col("job_name").alias("old_job_name"), "new_job_name",
        N.status(is_exception, needs_review, "_viol").alias("status"),
        N.notes(found, "_viol").alias("notes"),
        "app_code", "instance", "env", "schedule", "as_job_type", "subject_code", "etl_type",
        N.zfill4("job_id_num").alias("job_id"), "suffix",
        F.col("job_type").alias("original_job_type"))


def rename_v2(jobs: DataFrame, rule_set: RuleSet, instance_code: str, env_code: str,
              buckets: int = ids.DEFAULT_BUCKETS, detail: bool = False) -> DataFrame:
    """``job_rename_v2``: returns ``input_order`` + the 14 audit columns
    (``detail=True`` keeps every intermediate column)."""
    inst, env = _check_codes(instance_code, env_code)
    root = scratch_path(jobs.sparkSession, "rename-v2")
    # read for the pair counts, for the regex rules and for the jobs themselves
    prepared = prepare_jobs(jobs).withColumn("_kept", N.kept_tokens("job_name"))
    prepared = materialize(prepared, f"{root}/prepared")
    pairs, n_pairs = materialize_observed(token_pair_freq(prepared), f"{root}/pairs", rows=F.count(F.lit(1)))
    j = prepared.withColumn("_p", N.parse_name("job_name", 2))
    app = N.app_code_v2("application_name", "_p.app_prefix")
    j = j.withColumn("app_code", app["app_code"]).withColumn("_app_exc", app["is_exception"])
    j = j.withColumn("instance", F.lit(inst)).withColumn("env", F.lit(env))
    # schedule / as-type / etl lookups (broadcast, checked)
    j = _lookup_with_default(j, F.upper(F.col("_p.schedule_token")),
                             R.kv_rules(rule_set.schedule, "old_schedule", "new_schedule"), "sched")
    j = _lookup_with_default(j, F.upper(F.col("job_type")),
                             R.kv_rules(rule_set.as_type, "old_job_type", "new_as_type"), "ast")
    j = _lookup_with_default(j, F.upper(F.col("_p.type_suffix")),
                             R.kv_rules(rule_set.etl, "old_suffix", "new_etl_code"), "etl")
    j = (j.withColumn("schedule", F.when(F.col("_sched_hit"), F.col("_sched_raw")).otherwise("D"))
         .withColumn("as_job_type", F.when(F.col("_ast_hit"), F.col("_ast_raw")).otherwise("C"))
         .withColumn("etl_type", F.when(F.col("_etl_hit"), F.col("_etl_raw")).otherwise("C")))
    # subject tiers: exact, longest prefix, regex, then derivation
    sr = R.subject_rules(rule_set.subject)
    j = R.match_exact(j, "job_name", sr)
    j = R.match_longest_prefix(j, "job_name", sr)
    j = R.match_regex(j, "job_name", sr, path=f"{root}/regex")
    cands = N.first_candidates("_kept", F.array(N.alnum_upper("app_code")))
    j = j.withColumn("_cands", cands).drop("_kept").withColumn("_d0", N.at("_cands", 1)) \
        .withColumn("_d1", N.at("_cands", 2))
    j = j.join(sized(pairs, n_pairs["rows"]), (F.col("_d0") == F.col("_p0")) & (F.col("_d1") == F.col("_p1")), "left") \
        .drop("_p0", "_p1")
    derived = N.derive_subject("_cands", "_pair_count")
    tier4 = F.struct(derived["subject_code"].alias("subject_code"),
                     N.category_from_tokens("job_name").alias("category"),
                     derived["strip"].alias("strip"))
    j = j.withColumn("_derived", F.coalesce("_exact", "_prefix", "_regex").isNull())
    j = j.withColumn("_subj", F.coalesce("_exact", "_prefix", "_regex", tier4))
    j = j.withColumn("subject_code", F.col("_subj.subject_code")) \
        .withColumn("category", F.col("_subj.category"))
    # ids: sequential per (subject, category) in input order
    start = F.coalesce(F.element_at(F.create_map(*[x for k, v in N.CATEGORY_ID_START.items()
                                                    for x in (F.lit(k), F.lit(v))]),
                                    F.lower("category")), F.lit(N.CATEGORY_ID_START["other"]))
    j = j.withColumn("_gk_subject", F.upper("subject_code")).withColumn("_gk_cat", F.lower("category"))
    # one written copy feeds the numbering's three branches (and cuts lineage)
    j = materialize(j, f"{root}/jobs")
    # suffix, and the notes: before the numbering, whose shuffle then carries their texts
    full = N.clean_suffix("_p.suffix_body", "app_code", "_subj.strip")
    j = j.withColumn("_suffix_full", full).withColumn("suffix", N.cut_suffix("_suffix_full"))
    echo = F.substring("subject_code", 1, 5) == F.col("app_code")
    notes = [
        F.when(F.col("_app_exc"), N.fmt(N.NOTE_APP_V2, application_name="application_name")),
        F.when(~F.col("_sched_hit"), N.fmt(N.NOTE_SCHEDULE,
                                           schedule_token=F.upper(F.col("_p.schedule_token")))),
        F.when(~F.col("_ast_hit"), N.fmt(N.NOTE_AS_TYPE, job_type_key=F.upper("job_type"))),
        F.when(F.col("_derived"), F.lit(N.NOTE_SUBJECT_DERIVED)),
        F.when(echo, N.fmt(N.NOTE_ECHO, subject_code="subject_code", app_code="app_code")),
        F.when(~F.col("_etl_hit") & (F.col("_p.type_suffix") != ""),
               N.fmt(N.NOTE_ETL_UNKNOWN, type_suffix=F.upper(F.col("_p.type_suffix")))),
        F.when(~F.col("_etl_hit") & (F.col("_p.type_suffix") == ""), F.lit(N.NOTE_ETL_NONE)),
        F.when(F.length("_suffix_full") > N.MAX_SUFFIX_LEN,
               N.fmt(N.NOTE_TRUNCATED, length=F.length("_suffix_full"))),
    ]
    review = (~F.col("_sched_hit")) | (~F.col("_ast_hit")) | F.col("_derived") | echo \
        | (~F.col("_etl_hit"))
    j = j.withColumns({"_notes": F.array_compact(F.array(*notes)), "_review": review})
    j = ids.sequence_number(j, ["_gk_subject", "_gk_cat"], "input_order", "_seq", buckets)
    j = j.withColumn("job_id_num", (start + F.col("_seq") - 1).cast("long"))
    return _finish(j, F.col("_notes"), F.col("_app_exc"), F.col("_review"), detail)


def rename_v1(jobs: DataFrame, rule_set: RuleSet, instance_code: str, env_code: str,
              raw_id_start: int = 1000, curated_id_start: int = 3000,
              buckets: int = ids.DEFAULT_BUCKETS, detail: bool = False) -> DataFrame:
    """``job_rename_v1``: app code from the app table, subject tiers without
    derivation (fallback UNKNWN / curated), ids per (subject, raw or not)."""
    inst, env = _check_codes(instance_code, env_code)
    j = prepare_jobs(jobs).withColumn("_p", N.parse_name("job_name", 1))
    j = j.withColumn("instance", F.lit(inst)).withColumn("env", F.lit(env))
    j = _lookup_with_default(j, F.col("_p.app_prefix"),
                             R.kv_rules(rule_set.app, "old_prefix", "new_app_code"), "app")
    j = j.withColumn("app_code", F.when(F.col("_app_hit"), F.col("_app_raw")).otherwise(
        F.upper(F.substring(F.concat(F.col("_p.app_prefix"), F.lit("XXXXX")), 1, 5))))
    j = _lookup_with_default(j, F.upper(F.col("_p.schedule_token")),
                             R.kv_rules(rule_set.schedule, "old_schedule", "new_schedule"), "sched")
    j = _lookup_with_default(j, F.upper(F.col("job_type")),
                             R.kv_rules(rule_set.as_type, "old_job_type", "new_as_type"), "ast")
    j = _lookup_with_default(j, F.upper(F.col("_p.type_suffix")),
                             R.kv_rules(rule_set.etl, "old_suffix", "new_etl_code"), "etl")
    j = (j.withColumn("schedule", F.when(F.col("_sched_hit"), F.col("_sched_raw")).otherwise("D"))
         .withColumn("as_job_type", F.when(F.col("_ast_hit"), F.col("_ast_raw")).otherwise("C"))
         .withColumn("etl_type", F.when(F.col("_etl_hit"), F.col("_etl_raw")).otherwise("C")))
    sr = R.subject_rules(rule_set.subject)
    j = R.match_exact(j, "job_name", sr)
    j = R.match_longest_prefix(j, "job_name", sr)
    j = R.match_regex(j, "job_name", sr)
    fallback = F.struct(F.lit("UNKNWN").alias("subject_code"), F.lit("curated").alias("category"),
                        F.array().cast("array<string>").alias("strip"))
    j = j.withColumn("_subj", F.coalesce("_exact", "_prefix", "_regex", fallback))
    j = j.withColumn("subject_code", F.col("_subj.subject_code")) \
        .withColumn("category", F.col("_subj.category"))
    is_raw = F.lower("category") == "raw"
    j = j.withColumn("_gk_subject", F.upper("subject_code")).withColumn("_gk_raw", is_raw)
    j = materialize(j, scratch_path(j.sparkSession, "rename-v1"))
    j = ids.sequence_number(j, ["_gk_subject", "_gk_raw"], "input_order", "_seq", buckets)
    start = F.when(F.col("_gk_raw"), F.lit(int(raw_id_start))).otherwise(F.lit(int(curated_id_start)))
    j = j.withColumn("job_id_num", (start + F.col("_seq") - 1).cast("long"))
    j = j.withColumn("_suffix_full", F.col("_p.suffix_body")) \
        .withColumn("suffix", N.cut_suffix("_suffix_full"))
    unknown = F.col("subject_code") == "UNKNWN"
    notes = [
        F.when(~F.col("_app_hit"), N.fmt(N.NOTE_APP_V1, app_prefix="_p.app_prefix")),
        F.when(~F.col("_sched_hit"), N.fmt(N.NOTE_SCHEDULE,
                                           schedule_token=F.upper(F.col("_p.schedule_token")))),
        F.when(~F.col("_ast_hit"), N.fmt(N.NOTE_AS_TYPE, job_type_key=F.upper("job_type"))),
        F.when(unknown, F.lit(N.NOTE_SUBJECT_MISSING)),
        F.when(~F.col("_etl_hit") & (F.col("_p.type_suffix") != ""),
               N.fmt(N.NOTE_ETL_UNKNOWN, type_suffix=F.upper(F.col("_p.type_suffix")))),
        F.when(~F.col("_etl_hit") & (F.col("_p.type_suffix") == ""), F.lit(N.NOTE_ETL_NONE)),
        F.when(F.length("_suffix_full") > N.MAX_SUFFIX_LEN,
               N.fmt(N.NOTE_TRUNCATED, length=F.length("_suffix_full"))),
    ]
    review = (~F.col("_sched_hit")) | (~F.col("_ast_hit")) | unknown | (~F.col("_etl_hit"))
    return _finish(j, F.array_compact(F.array(*notes)), ~F.col("_app_hit"), review, detail)


def status_summary(renamed: DataFrame) -> DataFrame:
    """``agg_status_summary``: count and share per status (absent ones show 0)
    plus a TOTAL row; the total comes from the same aggregate via ``rollup``."""
    spark = renamed.sparkSession
    seed = spark.createDataFrame([(s,) for s in N.STATUS_ORDER], "status string")
    rolled = renamed.rollup("status").agg(F.count(F.lit(1)).alias("n"))
    total = rolled.where(F.col("status").isNull()).select(F.col("n").alias("total"),
                                                         F.lit(1).alias("_k"))
    per = (seed.join(rolled.where(F.col("status").isNotNull()), "status", "left")
           .withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k", "left")
           .select("status", F.coalesce("n", F.lit(0)).alias("n"),
                   F.coalesce("total", F.lit(0)).alias("total")))
    rows = per.select("status", "n", (F.lit(100.0) * F.col("n") / F.greatest("total", F.lit(1)))
                      .alias("pct"))
    tot = per.groupBy().agg(F.max("total").alias("n")).select(
        F.lit("TOTAL").alias("status"), F.coalesce("n", F.lit(0)).alias("n"),
        F.lit(100.0).alias("pct"))
    return rows.unionByName(tot)


def top_exceptions(renamed: DataFrame, k: int = 5) -> DataFrame:
    """``topk_exceptions``: first ``k`` EXCEPTION rows in input order."""
    return (renamed.where(F.col("status") == "EXCEPTION").orderBy("input_order").limit(k)
            .select("input_order", "old_job_name", "notes"))
