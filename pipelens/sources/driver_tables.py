"""Adapters from the driver's TPC-H-like tables to the engine's core schemas.

The operators never know about these: they take ``tasks``, ``stages``,
``executions``, ``jobs`` and ``assignments`` frames (SURVEY 1.2). Each adapter
is deterministic and has an SQL twin in :mod:`pipelens.plans.oracle`, so the
same inputs can be rebuilt in DuckDB for the correctness gate. Adapters read
whole tables; their work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.sources import eventlog as EL

APPS = ["A", "N", "R"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(ts) -> Column:
    """Epoch milliseconds of a wall-clock (timestamp_ntz) column, as UTC and
    independent of the session time zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            c.cast("timestamp_ntz"))


def app_of(key) -> Column:
    """One of three applications by key (a routing rule, not a filter)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.element_at(F.array(*[F.lit(a) for a in APPS]), (k % 3 + 1).cast("int"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task rows from ``lineitem``: app = return flag, stage = supplier,
    runtime = whole extended price; every metric is a long."""
    li = table(spark, sf_dir, "lineitem")
    launch = epoch_ms("l_shipdate")
    runtime = F.floor("l_extendedprice").cast("long")
    return li.select(
        F.col("l_returnflag").alias("app_id"),
        F.col("l_suppkey").alias("stage_id"),
        F.lit(0).alias("stage_attempt_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("task_id"),
        (F.col("l_partkey") % 8).cast("string").alias("executor_id"),
        launch.alias("launch_time"),
        (launch + runtime).alias("finish_time"),
        runtime.alias("task_runtime"),
        (runtime - F.col("l_linenumber")).cast("long").alias("executor_runtime"),
        (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))) * 1000000)
        .cast("long").alias("executor_cpu_time"),
        F.floor(F.col("l_discount") * 1000000).cast("long").alias("memory_spill"),
        F.floor(F.col("l_tax") * 100000).cast("long").alias("disk_spill"),
        (F.col("l_quantity").cast("long") * 1024).alias("input_bytes"),
        F.when(F.col("l_linenumber") != 1,
               F.floor(F.col("l_extendedprice") * F.col("l_quantity")).cast("long"))
        .alias("shuffle_read_bytes"),
        F.floor(F.col("l_extendedprice") * F.col("l_tax") * 100).cast("long")
        .alias("shuffle_write_bytes"),
        F.col("l_quantity").cast("long").alias("output_rows"),
    )


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage DAG from ``part``: vertex = part key, duration = size, parents
    ``k div 2`` and ``k div 3`` when they belong to the same application
    (application = key mod 3). Acyclic (parents are smaller), with diamonds."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    submit = k * 1000
    cand = F.array((k / 2).cast("long"), (k / 3).cast("long"))
    parents = F.array_distinct(F.filter(
        cand, lambda x: (x != k) & (x % 3 == k % 3)))
    return p.select(
        app_of("p_partkey").alias("app_id"),
        k.alias("stage_id"),
        F.lit(0).alias("stage_attempt_id"),
        F.col("p_name").alias("stage_name"),
        F.col("p_size").alias("num_tasks"),
        submit.alias("submission_time"),
        (submit + F.col("p_size")).alias("completion_time"),
        F.col("p_size").cast("long").alias("stage_time"),
        parents.alias("parents"),
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "user_id", "event_type", "value", "props",
                     epoch_ms("ts").alias("ts_ms"),
                     app_of("user_id").alias("app_id"))


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL executions: one for every user with a view, every document and every
    page, by id; start = the user's first view (null without one), the query text
    is the document, the physical plan text the page, and the plan JSON lists
    three children with row estimates."""
    ev = _events(spark, sf_dir)
    per_user = ev.groupBy(F.col("user_id").alias("execution_id")).agg(
        F.min(F.when(F.col("event_type") == "view", F.col("ts_ms"))).alias("start_time"),
        F.count(F.when(F.col("event_type") == "view", 1)).alias("_views"),
        F.count(F.when(F.col("event_type") == "click", 1)).alias("_clicks"))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("execution_id"), F.col("text").alias("query_text"))
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("execution_id"), F.col("html").alias("plan_text"))
    child = lambda name, rows: F.struct(
        F.lit(name).alias("nodeName"),
        F.struct(rows.alias("rowCount")).alias("statistics"))
    plan_json = F.to_json(F.struct(F.array(
        child("Scan", F.coalesce("_views", F.lit(0)).cast("long")),
        child("Exchange", F.coalesce("_clicks", F.lit(0)).cast("long")),
        F.struct(F.lit("Project").alias("nodeName"),
                 F.struct(F.lit(None).cast("long").alias("rowCount")).alias("statistics")),
    ).alias("children")))
    return (per_user.where(F.col("start_time").isNotNull())
            .join(docs.where("execution_id IS NOT NULL"), "execution_id", "full")
            .join(pages.where("execution_id IS NOT NULL"), "execution_id", "full")
            .select(app_of("execution_id").alias("app_id"), "execution_id", "query_text", "plan_text",
                    plan_json.alias("plan_json"), "start_time"))


def execution_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQLExecutionEnd rows: last purchase per user."""
    ev = _events(spark, sf_dir)
    return (ev.where(F.col("event_type") == "purchase")
            .groupBy("app_id", F.col("user_id").alias("execution_id"))
            .agg(F.max("ts_ms").alias("end_time")))


def aqe_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive plan updates: one per click; the plan mentions a skew join
    when the click's value is above 400."""
    ev = _events(spark, sf_dir)
    plan = F.when(F.col("value") > 400, F.concat(F.lit("SortMergeJoin(skew=true) "), F.col("props"))) \
        .otherwise(F.col("props"))
    return (ev.where(F.col("event_type") == "click")
            .select("app_id", F.col("user_id").alias("execution_id"), plan.alias("plan_json")))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event, its JSON props as a string map (``proj_conf_kv`` input)."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", F.from_json(F.col("props"), "map<string,string>").alias("props"))


def app_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark properties per application: the adaptive flag is off for N."""
    apps = _events(spark, sf_dir).select("app_id").distinct()
    return apps.select("app_id", F.create_map(
        F.lit("spark.sql.adaptive.enabled"),
        F.when(F.col("app_id") == "N", "false").otherwise("true")).alias("props"))


# ------------------------------------------------------------------ N family
# Token lists used to assemble legacy job names from order keys. They cover
# placeholders (P_, PR_, P-), the ZZZ form, category markers, LOAD, long
# tails, lower case and unknown codes.
NAME_HEADS = ["MORTA", "TXNDW", "GEMMA", "P_TXNDW", "PR_MORTA", "P-ODS", "ODS", "morta",
              "NEWAP", "P"]
NAME_SCHEDULES = ["D", "OD", "W", "M", "ZZZDAC", "ZZZ", "X", "daily", "H"]
NAME_BODIES = ["LOAN", "LOAN_FEE", "ABC_DEF", "RAW_LOAD", "CARD_TXN",
               "MORTA_LOAN_RAW_LOAD_X_DAILY", "CONF_GL", "KAFKA_EVENTS_API",
               "NDM_FILE_XFER", "A_B", "VERY_LONG_BODY_TOKEN_NUMBER_ONE_TWO_THREE_FOUR"]
NAME_TAILS = ["BX", "CMD", "CM", "FW", "", "LOAD", "XX"]
APPLICATION_NAMES = ["Morta Lending", "TXN-DW", "", "  ", "gemma", "x", "Loan Servicing Platform"]
PRIORITY_JOB_TYPES = [("1-URGENT", "CMD"), ("2-HIGH", "BOX"), ("3-MEDIUM", "fw"),
                      ("4-NOT SPECIFIED", ""), ("5-LOW", "FILE")]


def _pick(values, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job list from ``orders``: name assembled from token lists by key,
    application from the customer key, job type from the priority;
    ``input_order`` = order key."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    name = F.concat_ws("_", _pick(NAME_HEADS, k), _pick(NAME_SCHEDULES, (k / 10).cast("long")),
                       _pick(NAME_BODIES, (k / 90).cast("long")),
                       F.nullif(_pick(NAME_TAILS, (k / 990).cast("long")), F.lit("")))
    jt = F.lit(None).cast("string")
    for pr, t in reversed(PRIORITY_JOB_TYPES):
        jt = F.when(F.col("o_orderpriority") == pr, F.lit(t)).otherwise(jt)
    return o.select(k.alias("input_order"), name.alias("job_name"), jt.alias("job_type"),
                    _pick(APPLICATION_NAMES, F.col("o_custkey")).alias("application_name"))


# Inline rule tables (the same rows are VALUES lists in the SQL twin).
RULES_APP = [("MORTA", "MORTA"), ("TXNDW", "TXNDW"), ("GEMMA", "GEMMA"), ("P-ODS", "ODSXX"),
             ("ODS", "ODS01"), ("P", "PLACE")]
RULES_SCHEDULE = [("D", "D"), ("OD", "O"), ("W", "X"), ("W", "W"), ("M", "M"), ("DAILY", "D"),
                  (" h ", "h"), ("ZZZ", "")]
RULES_AS_TYPE = [("CMD", "C"), ("BOX", "B"), ("FW", "F"), ("FILE", "")]
RULES_ETL = [("BX", "B"), ("CMD", "C"), ("CM", "M"), ("FW", "")]
RULES_SUBJECT = [
    ("TXNDW_OD_LOAN_BX", "exact", "LNTXN1", "Curated "),
    ("txndw_od_loan_bx", "exact", "LNTXN2", "curated"),
    ("MORTA_D_LOAN", "prefix", "LOANXX", "raw"),
    ("MORTA_D", "prefix", "MORTAD", "other"),
    ("MORTA", "prefix", "MORTAX", "conformed"),
    ("GEMMA_ZZZ", "prefix", "GEMZZZ", "ndm"),
    ("morta_d", "prefix", "MORTA2", "raw"),
    ("_CARDS?_", "regex", "CARDSX", "streaming"),
    ("KAFKA", "regex", "KAFKAX", "streaming"),
    ("^ODS_.*_FW$", "regex", "ODSFWX", "weird"),
    ("card", "regex", "CARD2X", "raw"),
]


def rule_set(spark: SparkSession):
    from pipelens.plans.rename import RuleSet

    def frame(rows, schema):
        return spark.createDataFrame([(i,) + tuple(r) for i, r in enumerate(rows)],
                                     "rule_order long, " + schema)
    return RuleSet(
        app=frame(RULES_APP, "old_prefix string, new_app_code string"),
        schedule=frame(RULES_SCHEDULE, "old_schedule string, new_schedule string"),
        etl=frame(RULES_ETL, "old_suffix string, new_etl_code string"),
        as_type=frame(RULES_AS_TYPE, "old_job_type string, new_as_type string"),
        subject=frame(RULES_SUBJECT, "pattern string, match_type string, subject_code string, "
                                     "category string"),
    )


# ------------------------------------------------------------------ G family
LINEAGE_PIPELINE = "part"
# expression templates for column c2, chosen by key mod 5: (text, refs) where
# refs name the parent ('half' or 'third') and the column
C2_TEMPLATES = [
    ("coalesce(raw.c2, derv.derv_c3)", [("half", "c2"), ("third", "c3")]),
    ("upper(a.c2)", [("half", "c2")]),
    ("a.c2 + b.c1", [("half", "c2"), ("third", "c1")]),
    ("'N/A'", []),
    ("coalesce(raw.c2, case when raw.c3 > 0 then concat(upper(trim(derv.derv_c3)), '-', lower(trim(raw.c2))) "
     "when raw.c3 < 0 then replace(derv.derv_c3, 'x', 'y') else cast(raw.c2 as string) end)",
     [("half", "c2"), ("half", "c3")]),
]


def lineage_table_name(k: Column) -> Column:
    """Tables ``t<k>``; every fifth lives in schema ``raw``, and some have
    the names of report or derived tables."""
    t = F.concat(F.lit("t"), k.cast("string"))
    return (F.when(k % 5 == 0, F.concat(F.lit("raw."), t)).when(k % 17 == 0, F.concat(t, F.lit("_REPORT")))
            .when(k % 19 == 0, F.concat(t, F.lit("_df"))).otherwise(t))


def lineage_parents(k: Column) -> tuple[Column, Column]:
    """The ``half`` and ``third`` parent of a key: keys with one remainder
    mod 3 are a pipeline, in which number j reads j div 2 and j div 3."""
    j = (k / 3).cast("long")
    return (j / 2).cast("long") * 3 + k % 3, (j / 3).cast("long") * 3 + k % 3


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage facts from ``part``, one statement per key in three pipelines.
    The first of a pipeline and parts of size over 45 are entry tables: even
    keys copy c0..c3 from an outside table ``ext.s<k>``, odd ones define only
    the literal c0, so that reading their c1..c3 is an undefined reference.
    Of the others every 7th is ``SELECT *`` from its ``half`` parent; the rest
    define c0..c3 (c2 by an expression template), every 11th a column named
    ``case``, and every 13th a column from a table named ``N/A``."""
    k = F.col("p_partkey")
    half_key, third_key = lineage_parents(k)
    # a few megabytes of keys are one split but give gigabytes of rows: dealt out
    # first; names are columns, so that the code of a row names each only once
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey").withColumns({
        "_half": lineage_table_name(half_key), "_third": lineage_table_name(third_key), "_own": lineage_table_name(k)})
    half, third = F.col("_half"), F.col("_third")
    parent = {"half": half, "third": third}
    null_s = F.lit(None).cast("string")

    def row(col, ordinal, src_t, src_c, expr=null_s):
        return F.struct(F.lit(col).alias("target_column"), F.lit(ordinal).alias("ordinal"),
                        src_t.cast("string").alias("source_table"),
                        src_c.cast("string").alias("source_column"), expr.cast("string").alias("expression"))

    plain = [row("c0", 0, half, F.lit("c0")), row("c1", 1, third, F.lit("c1")), row("c3", 3, half, F.lit("c3"))]
    rows = F.array(*plain)
    none = F.filter(rows, lambda x: F.lit(False))
    for i, (text, refs) in enumerate(C2_TEMPLATES):
        items = [row("c2", 2, parent[w], F.lit(c), F.lit(text)) for w, c in refs] or \
                [row("c2", 2, null_s, null_s, F.lit(text))]
        rows = F.concat(rows, F.when(k % len(C2_TEMPLATES) == i, F.array(*items)).otherwise(none))
    rows = F.concat(rows, F.when(k % 11 == 0, F.array(row("case", 4, half, F.lit("c0")))).otherwise(none),
                    F.when(k % 13 == 0, F.array(row("c5", 5, F.lit("N/A"), F.lit("c5")))).otherwise(none))
    outside = F.concat(F.lit("ext.s"), k.cast("string"))
    entry = F.when(k % 2 == 0, F.array(*[row(f"c{i}", i, outside, F.lit(f"c{i}")) for i in range(4)])).otherwise(
        F.array(row("c0", 0, null_s, null_s, F.lit("'none'"))))
    rows = (F.when((k < 3) | (F.col("p_size") > 45), entry)
            .when(k % 7 == 0, F.array(row("*", 0, half, null_s, F.lit("*")))).otherwise(rows))
    return p.select(F.concat(F.lit(LINEAGE_PIPELINE), (k % 3).cast("string")).alias("pipeline_id"),
                    k.alias("stmt_order"), F.col("_own").alias("target_table"),
                    F.explode(rows).alias("r")) \
        .select("pipeline_id", "stmt_order", "target_table", "r.target_column", "r.ordinal",
                "r.source_table", "r.source_column", "r.expression")


def alias_refs(assign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alias-qualified references and statement sources for
    ``join_alias_resolve``: each reference uses alias ``a`` (k mod 3 = 0), no
    alias (1) or an unknown alias ``zz`` (2); statements list ``a`` = the
    ``half`` parent and, unless k mod 5 = 0, ``b`` = the ``third`` parent."""
    a = assign.where(F.col("source_column").isNotNull())
    k = F.col("stmt_order")
    refs = a.select("pipeline_id", "stmt_order", "target_column", "ordinal",
                    F.when(k % 3 == 0, F.lit("a")).when(k % 3 == 1, F.lit(None))
                    .otherwise(F.lit("zz")).alias("alias"),
                    F.col("source_column").alias("column"))
    stm = assign.select("pipeline_id", "stmt_order").distinct()
    src_a = stm.select("pipeline_id", "stmt_order", F.lit("a").alias("alias"),
                       lineage_table_name(lineage_parents(k)[0]).alias("table"),
                       F.lit(0).alias("ordinal"))
    src_b = stm.where(k % 5 != 0).select("pipeline_id", "stmt_order", F.lit("b").alias("alias"),
                                         lineage_table_name(lineage_parents(k)[1]).alias("table"),
                                         F.lit(1).alias("ordinal"))
    return refs, src_a.unionByName(src_b)


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL statements from ``part``: four shapes by key mod 4 -- aliased
    CTAS (over several lines where key mod 8 = 4), upper-case CTAS without
    alias, CTAS with CASE, and an INSERT."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    half = (F.col("p_partkey") / 2).cast("long").cast("string")
    third = (F.col("p_partkey") / 3).cast("long").cast("string")
    m = F.col("p_partkey") % 4
    text = (F.when(F.col("p_partkey") % 8 == 4, F.concat(
                F.lit("create table t"), k, F.lit(" as\nselect\n  a.c0 as x"), k, F.lit(",\n  a.c1,\n\tc2\nfrom db.t"),
                half, F.lit(" a")))
            .when(m == 0, F.concat(F.lit("create table t"), k, F.lit(" as select a.c0 as x"), k,
                                    F.lit(", a.c1, c2 from db.t"), half, F.lit(" a")))
            .when(m == 1, F.concat(F.lit("CREATE TABLE T"), k,
                                   F.lit(" AS SELECT c0, c1 AS y FROM raw.src"),
                                   (F.col("p_partkey") % 10).cast("string")))
            .when(m == 2, F.concat(F.lit("create table t"), k,
                                   F.lit(" as select case when a.c0 > 1 then 1 else 0 end as flag from t"),
                                   third, F.lit(" a")))
            .otherwise(F.concat(F.lit("insert into t"), k, F.lit(" select c0 from t"), half)))
    return p.select(F.lit(LINEAGE_PIPELINE).alias("pipeline_id"),
                    F.col("p_partkey").alias("stmt_order"), text.alias("sql_text"))


# ------------------------------------------------------------------ configurations
CONFIG_APPLICATION = "part"


def config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One configuration document per part key (JSON text): application
    ``part``, one flow ``f<k>`` depending on f<k div 2> and f<k div 3>,
    registering ``frame_<k>``, saving to ``db.t<k>`` when k mod 3 = 0, with a
    not-null check when k mod 4 = 0 and the statement of
    :func:`statements` as its query. Every 97th document is broken JSON,
    every 89th lacks the application name, every 83rd a flowId."""
    st = statements(spark, sf_dir)
    k = F.col("stmt_order")
    ks = k.cast("string")
    deps = F.array_distinct(F.filter(
        F.array(F.concat(F.lit("f"), (k / 2).cast("long").cast("string")),
                F.concat(F.lit("f"), (k / 3).cast("long").cast("string"))),
        lambda d: d != F.concat(F.lit("f"), ks)))
    deps = F.when(k >= 1, deps).otherwise(F.array().cast("array<string>"))
    flow = F.struct(
        F.when(k % 83 != 0, F.concat(F.lit("f"), ks)).alias("flowId"),
        deps.alias("seqDependencies"),
        F.array(F.col("sql_text")).alias("queries"),
        F.concat(F.lit("frame_"), ks).alias("registerName"),
        F.when(k % 3 == 0, F.concat(F.lit("db.t"), ks)).alias("storageName"),
        (k % 3 == 0).alias("saveOutput"),
        F.when(k % 4 == 0, F.array(F.struct(F.concat(F.lit("chk"), ks).alias("checkId"),
                                            F.lit("not_null").alias("type"),
                                            F.lit("c0").alias("column"))))
        .otherwise(F.array().cast("array<struct<checkId:string,type:string,column:string>>"))
        .alias("checks"))
    doc = F.to_json(F.struct(
        F.struct(F.when(k % 89 != 0, F.lit(CONFIG_APPLICATION)).alias("name"),
                 F.lit("team").alias("owner")).alias("application"),
        F.array(flow).alias("flows")))
    return st.select(F.when(k % 97 == 0, F.concat(F.lit("{bad json "), ks)).otherwise(doc)
                     .alias("value"))


def vector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbour graph over embeddings: vec_id -> vec_id div 2."""
    e = table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") >= 1).select(
        F.col("vec_id").alias("src"), (F.col("vec_id") / 2).cast("long").alias("dst"))


# ------------------------------------------------------------------ event logs
EVENTS_PER_FILE = 200_000  # where a log rolls: a compressed file is one split


def _event(name: str, *fields) -> F.Column:
    return F.to_json(F.struct(F.lit(name).alias("Event"), *fields))


def write_event_log(tasks: DataFrame, stages: DataFrame, out: str,
                    spark_version: str = "4.1.2") -> None:
    """Test fixture: write ``tasks`` / ``stages`` frames as
    rolling Spark event logs, one ``eventlog_v2_app=<app>`` folder for each
    application: LogStart, ApplicationStart (time = first task launch),
    StageCompleted, TaskEnd, and one line cut short. As Spark's logs, they are
    compressed and roll. Tasks are sorted by application before they become text,
    so that the write does not sort (and spill) the text."""
    t = tasks.sortWithinPartitions("app_id")
    task_ev = t.select("app_id", _event(
        EL.EVENTS["task_end"], F.col("stage_id").alias("Stage ID"),
        F.col("stage_attempt_id").cast("long").alias("Stage Attempt ID"),
        F.struct(F.col("task_id").alias("Task ID"), F.col("executor_id").alias("Executor ID"),
                 F.col("launch_time").alias("Launch Time"),
                 F.col("finish_time").alias("Finish Time")).alias("Task Info"),
        F.struct(F.col("executor_runtime").alias("Executor Run Time"),
                 F.col("executor_cpu_time").alias("Executor CPU Time"),
                 F.col("memory_spill").alias("Memory Bytes Spilled"),
                 F.col("disk_spill").alias("Disk Bytes Spilled"),
                 F.struct(F.col("input_bytes").alias("Bytes Read")).alias("Input Metrics"),
                 F.struct(F.col("output_rows").alias("Records Written")).alias("Output Metrics"),
                 F.struct(F.col("shuffle_read_bytes").alias("Remote Bytes Read"),
                          F.when(F.col("shuffle_read_bytes").isNotNull(), F.lit(0))
                          .alias("Local Bytes Read")).alias("Shuffle Read Metrics"),
                 F.struct(F.col("shuffle_write_bytes").alias("Shuffle Bytes Written"))
                 .alias("Shuffle Write Metrics")).alias("Task Metrics")).alias("value"))
    stage_ev = stages.select("app_id", _event(
        EL.EVENTS["stage_completed"], F.struct(
            F.col("stage_id").alias("Stage ID"), F.col("stage_attempt_id").cast("long")
            .alias("Stage Attempt ID"), F.col("stage_name").alias("Stage Name"),
            F.col("num_tasks").cast("long").alias("Number of Tasks"),
            F.col("parents").alias("Parent IDs"), F.col("submission_time").alias("Submission Time"),
            F.col("completion_time").alias("Completion Time")).alias("Stage Info")).alias("value"))
    apps = tasks.groupBy("app_id").agg(F.min("launch_time").alias("_t"))
    app_ev = apps.select("app_id", _event(EL.EVENTS["app_start"], F.col("app_id").alias("App ID"),
                                          F.col("app_id").alias("App Name"),
                                          F.col("_t").alias("Timestamp")).alias("value"))
    log_ev = apps.select("app_id", _event(EL.EVENTS["log_start"],
                                          F.lit(spark_version).alias("Spark Version")).alias("value"))
    cut = apps.select("app_id", F.lit('{"Event":"SparkListenerTaskEnd","Stage ID":').alias("value"))
    allev = log_ev.unionByName(app_ev).unionByName(stage_ev.join(apps.select("app_id"), "app_id", "left_semi"))
    for events, mode in ((allev.unionByName(cut), "overwrite"), (task_ev, "append")):
        (events.withColumnRenamed("app_id", "eventlog_v2_app").write.mode(mode).partitionBy("eventlog_v2_app")
         .option("compression", "gzip").option("maxRecordsPerFile", EVENTS_PER_FILE).text(out))
