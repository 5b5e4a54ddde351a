"""Spark event logs (JSON lines) -> the engine's normalised tables.

The log is parsed ONCE with an explicit schema (no inference scan): ``ingest``
writes it by event type, lines that do not parse among them, and what follows
reads only the folders of the event types it needs. It is normalised to ``apps``, ``conf``, ``executions``,
``execution_ends``, ``aqe_updates``, ``stages`` and ``tasks`` keyed by
``app_id``, so thousands of application logs are one set of tables.
Field names follow a log written by Spark 4.1 (SURVEY 1.1): SQL events carry
their full class name, ``Spark Properties`` is a JSON object (-> map),
``sparkPlanInfo`` is kept as raw JSON text, shuffle reads are remote + local.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, LongType, MapType, StringType, StructField,
                               StructType)

from pipelens.operators.rules import checked_broadcast
from pipelens.session import scratch_path

L, S = LongType(), StringType()


def _s(*fields) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


EVENT_SCHEMA = _s(
    ("Event", S), ("App ID", S), ("App Name", S), ("Timestamp", L), ("User", S),
    ("Spark Version", S), ("Spark Properties", MapType(S, S)),
    ("executionId", L), ("description", S), ("details", S), ("physicalPlanDescription", S),
    ("sparkPlanInfo", S), ("time", L),
    ("Stage Info", _s(("Stage ID", L), ("Stage Attempt ID", L), ("Stage Name", S),
                      ("Number of Tasks", L), ("Parent IDs", ArrayType(L)),
                      ("Submission Time", L), ("Completion Time", L))),
    ("Stage ID", L), ("Stage Attempt ID", L),
    ("Task Info", _s(("Task ID", L), ("Executor ID", S), ("Launch Time", L), ("Finish Time", L))),
    ("Task Metrics", _s(
        ("Executor Run Time", L), ("Executor CPU Time", L), ("Memory Bytes Spilled", L),
        ("Disk Bytes Spilled", L),
        ("Input Metrics", _s(("Bytes Read", L))),
        ("Output Metrics", _s(("Records Written", L))),
        ("Shuffle Read Metrics", _s(("Remote Bytes Read", L), ("Local Bytes Read", L))),
        ("Shuffle Write Metrics", _s(("Shuffle Bytes Written", L))))),
)

EVENTS = {
    "log_start": "SparkListenerLogStart",
    "app_start": "SparkListenerApplicationStart",
    "environment": "SparkListenerEnvironmentUpdate",
    "sql_start": "SparkListenerSQLExecutionStart",
    "sql_end": "SparkListenerSQLExecutionEnd",
    "aqe_update": "SparkListenerSQLAdaptiveExecutionUpdate",
    "stage_completed": "SparkListenerStageCompleted",
    "task_end": "SparkListenerTaskEnd",
}


MALFORMED = "malformed"


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """``src_event_log``: raw events with ``event`` (short type name) and
    ``log_file`` (one file = one application). A line that is no event gets the
    type ``malformed``; ``line`` is the text of any line with a fault, also of an
    event whose faulty fields are null. Blank lines are skipped."""
    bad = "_corrupt_record"
    schema = StructType([*EVENT_SCHEMA.fields, StructField(bad, S, True)])
    text = spark.read.option("recursiveFileLookup", "true").text(path).where(F.col("value").rlike(r"\S"))
    raw = text.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("_e"),
                      "value", log_unit(F.col("_metadata.file_path")).alias("log_file")).select("_e.*", "value", "log_file")
    return raw.withColumns({
        "event": F.coalesce(F.substring_index("Event", ".", -1), F.lit(MALFORMED)),
        "line": F.when(F.col("Event").isNull(), F.col("value")).otherwise(F.col(bad))}).drop("value", bad)


def ingest(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """Read and parse the log once, write it by event type (to ``out`` or a fresh
    shared folder), and return the routed events."""
    out = out or scratch_path(spark, "routed-log")
    write_routed(read_event_log(spark, path), out)
    return spark.read.parquet(out)


def malformed(raw: DataFrame) -> DataFrame:
    """(log_file, event, line) of the lines with faults: the quarantine, and
    events with faulty fields."""
    return raw.where(F.col("line").isNotNull()).select("log_file", "event", "line")


def log_unit(file_path) -> F.Column:
    """One application per log unit: the file itself, or its directory when
    that is a rolling log (``eventlog_v2_*``). Other folders, such as
    ``date=...`` partitions, say nothing about applications."""
    parent = F.regexp_extract(file_path, r"^(.*)/[^/]*$", 1)
    name = F.regexp_extract(parent, r"([^/]*)$", 1)
    return F.when(name.startswith("eventlog_v2_"), parent).otherwise(file_path)


def route(raw: DataFrame, kind: str) -> DataFrame:
    """``src_event_route``: keep one event type (short or full class name)."""
    return raw.where(F.col("event") == EVENTS[kind])  # prunes folders of a routed log


def write_routed(raw: DataFrame, out: str) -> None:
    """Write the log once partitioned by event type, so later scans prune."""
    raw.write.mode("overwrite").partitionBy("event").parquet(out)


def _app_keys(raw: DataFrame) -> DataFrame:
    """log file -> app id (ApplicationStart), one row per log file."""
    return (route(raw, "app_start").groupBy("log_file")
            .agg(F.first("App ID", ignorenulls=True).alias("app_id")))


def _with_app(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Application of each row. ``keys`` is broadcast after its size check: by
    shuffle all events of a log would meet in one task."""
    return df.join(keys, "log_file", "inner").drop("log_file")


def normalize(raw: DataFrame) -> dict[str, DataFrame]:
    """Raw events -> normalised tables, all keyed by ``app_id``."""
    keys = checked_broadcast(_app_keys(raw))
    version = route(raw, "log_start").groupBy("log_file").agg(
        F.first("Spark Version", ignorenulls=True).alias("spark_version"))
    apps = (route(raw, "app_start")
            .select("log_file", F.col("App ID").alias("application_id"),
                    F.col("App Name").alias("app_name"), F.col("Timestamp").alias("start_time"),
                    F.col("User").alias("user"))
            .join(version, "log_file", "left"))
    apps = _with_app(apps, keys).dropDuplicates(["app_id"])
    conf = _with_app(route(raw, "environment").select("log_file", F.col("Spark Properties")
                                                      .alias("props")), keys)
    conf = conf.groupBy("app_id").agg(F.first("props").alias("props"))
    execs = _with_app(route(raw, "sql_start").select(
        "log_file", F.col("executionId").alias("execution_id"),
        F.col("description").alias("query_text"),
        F.col("physicalPlanDescription").alias("plan_text"),
        F.col("sparkPlanInfo").alias("plan_json"), F.col("time").alias("start_time")), keys)
    ends = _with_app(route(raw, "sql_end").select(
        "log_file", F.col("executionId").alias("execution_id"), F.col("time").alias("end_time")),
        keys)
    ends = ends.groupBy("app_id", "execution_id").agg(F.max("end_time").alias("end_time"))
    updates = _with_app(route(raw, "aqe_update").select(
        "log_file", F.col("executionId").alias("execution_id"),
        F.col("sparkPlanInfo").alias("plan_json")), keys)
    si = F.col("Stage Info")
    stages = _with_app(route(raw, "stage_completed").select(
        "log_file", si["Stage ID"].alias("stage_id"), si["Stage Attempt ID"].alias("stage_attempt_id"),
        si["Stage Name"].alias("stage_name"), si["Number of Tasks"].alias("num_tasks"),
        si["Submission Time"].alias("submission_time"), si["Completion Time"].alias("completion_time"),
        F.coalesce(si["Parent IDs"], F.array().cast("array<bigint>")).alias("parents")), keys)
    # a retried stage keeps its highest attempt
    stages = (stages.groupBy("app_id", "stage_id")
              .agg(F.max_by(F.struct(*[c for c in stages.columns if c not in ("app_id", "stage_id")]),
                            "stage_attempt_id").alias("_s"))
              .select("app_id", "stage_id", "_s.*")
              .withColumn("stage_time", F.col("completion_time") - F.col("submission_time")))
    ti, tm = F.col("Task Info"), F.col("Task Metrics")
    tasks = _with_app(route(raw, "task_end").select(
        "log_file", F.col("Stage ID").alias("stage_id"),
        F.col("Stage Attempt ID").alias("stage_attempt_id"),
        ti["Task ID"].alias("task_id"), ti["Executor ID"].alias("executor_id"),
        ti["Launch Time"].alias("launch_time"), ti["Finish Time"].alias("finish_time"),
        (ti["Finish Time"] - ti["Launch Time"]).alias("task_runtime"),
        tm["Executor Run Time"].alias("executor_runtime"),
        tm["Executor CPU Time"].alias("executor_cpu_time"),
        tm["Memory Bytes Spilled"].alias("memory_spill"),
        tm["Disk Bytes Spilled"].alias("disk_spill"),
        tm["Input Metrics"]["Bytes Read"].alias("input_bytes"),
        (tm["Shuffle Read Metrics"]["Remote Bytes Read"]
         + tm["Shuffle Read Metrics"]["Local Bytes Read"]).alias("shuffle_read_bytes"),
        tm["Shuffle Write Metrics"]["Shuffle Bytes Written"].alias("shuffle_write_bytes"),
        tm["Output Metrics"]["Records Written"].alias("output_rows")), keys)
    return {"apps": apps, "conf": conf, "executions": execs, "execution_ends": ends,
            "aqe_updates": updates, "stages": stages, "tasks": tasks}


def conf_kv(conf: DataFrame) -> DataFrame:
    """``proj_conf_kv``: properties map -> (app_id, key, value) rows."""
    return conf.select("app_id", F.explode(F.map_entries("props")).alias("kv")).select(
        "app_id", F.col("kv.key").alias("key"), F.col("kv.value").alias("value"))


def conf_lookup(conf: DataFrame, key: str, alias: str | None = None) -> DataFrame:
    """``proj_conf_lookup``: value of one key per app, or null."""
    return conf.select("app_id", F.try_element_at("props", F.lit(key)).alias(alias or key))


def app_info(apps: DataFrame) -> DataFrame:
    """``proj_app_info`` / ``limit_one``: one row per application (the
    reference's ``limit(1)`` over a single log)."""
    return apps.select("app_id", "start_time", "spark_version")
