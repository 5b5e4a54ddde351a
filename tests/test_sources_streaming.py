import os
import uuid

from pyspark.sql import functions as F

from pipelens.session import checkpoint_root
from pipelens.sources import csv_tables as C
from pipelens.sources import driver_tables as D
from pipelens.sources import eventlog as EL
from pipelens.streaming import features as S


def _scratch(spark, name):
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:8]}")


def _tasks(spark):
    rows = [("app-1", 1, 0, 10, "1", 1000, 1100, 100, 90, 5_000_000, 0, 0, 10, 20, 30, 7),
            ("app-1", 1, 0, 11, "2", 1000, 1300, 300, 280, 9_000_000, 5, 1, 10, None, 30, 9),
            ("app-2", 4, 0, 12, "1", 2000, 2050, 50, 40, 1_000_000, 0, 0, 0, 1, 2, 3)]
    cols = ("app_id string, stage_id long, stage_attempt_id int, task_id long, executor_id string, "
            "launch_time long, finish_time long, task_runtime long, executor_runtime long, "
            "executor_cpu_time long, memory_spill long, disk_spill long, input_bytes long, "
            "shuffle_read_bytes long, shuffle_write_bytes long, output_rows long")
    return spark.createDataFrame(rows, cols)


def _stages(spark):
    return spark.createDataFrame(
        [("app-1", 1, 0, "s1", 2, 900, 1400, 500, []), ("app-2", 4, 0, "s4", 1, 1990, 2060, 70, [])],
        "app_id string, stage_id long, stage_attempt_id int, stage_name string, num_tasks int, "
        "submission_time long, completion_time long, stage_time long, parents array<long>")


def test_event_log_round_trip(spark):
    out = _scratch(spark, "evlog")
    D.write_event_log(_tasks(spark), _stages(spark), out)
    t = EL.normalize(EL.read_event_log(spark, out))
    got = sorted((r["app_id"], r["task_id"], r["shuffle_read_bytes"], r["task_runtime"])
                 for r in t["tasks"].collect())
    assert got == [("app-1", 10, 20, 100), ("app-1", 11, None, 300), ("app-2", 12, 1, 50)]
    apps = {r["app_id"]: r["spark_version"] for r in t["apps"].collect()}
    assert apps == {"app-1": "4.1.2", "app-2": "4.1.2"}
    assert t["stages"].count() == 2


def test_log_is_parsed_once_and_keeps_bad_lines(spark):
    out = _scratch(spark, "evlog")
    D.write_event_log(_tasks(spark), _stages(spark), out)
    more = ["no json at all", "", "  ", '{"other": 1}',
            '{"Event":"SparkListenerTaskEnd","Stage ID":"x","Task Info":{"Task ID":77,"Launch Time":1,"Finish Time":3}}']
    spark.createDataFrame([(x,) for x in more], "value string").coalesce(1).write.mode("append").text(f"{out}/eventlog_v2_app=app-1")
    raw = EL.ingest(spark, out)
    assert raw.where("event = 'malformed'").count() == 4  # two cut short, two lines that are no events
    bad = [(r.event, r.line) for r in EL.malformed(raw).collect()]
    assert len(bad) == 5 and ("SparkListenerTaskEnd", more[4]) in bad
    tables = EL.normalize(raw)
    task = {r.task_id: r for r in tables["tasks"].collect()}
    assert sorted(task) == [10, 11, 12, 77] and task[77].stage_id is None and task[77].app_id == "app-1"
    for frame in tables.values():  # only parts of the routed log are read
        plan = frame._jdf.queryExecution().toString()
        assert "FileScan text" not in plan and "FileScan json" not in plan
        assert "PartitionFilters: [isnotnull(event" in plan


def test_real_spark_event_log_shape(spark):
    """Lines in the exact shape Spark 4.1 writes (full SQL class names,
    Spark Properties as an object, plan info as nested JSON)."""
    path = _scratch(spark, "reallog")
    os.makedirs(path)
    lines = [
        '{"Event":"SparkListenerLogStart","Spark Version":"4.1.2"}',
        '{"Event":"SparkListenerApplicationStart","App Name":"x","App ID":"local-1","Timestamp":5,"User":"u"}',
        '{"Event":"SparkListenerEnvironmentUpdate","Spark Properties":{"spark.sql.adaptive.enabled":"true"}}',
        '{"Event":"org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart","executionId":0,'
        '"description":"q","details":"d","physicalPlanDescription":"SortMergeJoin BroadcastHashJoin",'
        '"sparkPlanInfo":{"nodeName":"X","simpleString":"s","children":[{"nodeName":"Scan","children":[]}],'
        '"metadata":{},"metrics":[]},"time":10}',
        '{"Event":"org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd","executionId":0,"time":30}',
    ]
    with open(os.path.join(path, "local-1"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    t = EL.normalize(EL.ingest(spark, path))
    assert EL.conf_lookup(t["conf"], "spark.sql.adaptive.enabled", "aqe").collect()[0]["aqe"] == "true"
    ex = t["executions"].collect()[0]
    assert ex["app_id"] == "local-1" and '"children"' in ex["plan_json"]
    assert t["execution_ends"].collect()[0]["end_time"] == 30


def test_jobs_csv_and_rules(spark):
    folder = _scratch(spark, "csv")
    jobs = spark.createDataFrame([("1", "A_D_X", "CMD"), ("Row", "job_name", "job_type"),
                                  ("2", "  B_D ", "")], "Row string, Job_Name string, job_type string")
    C.write_csv(jobs.coalesce(1), folder)
    got = C.read_jobs_csv(spark, folder).orderBy("row").collect()
    assert [(r["row"], r["job_name"], r["job_type"]) for r in got] == [("1", "A_D_X", "CMD"),
                                                                       ("2", "  B_D ", "")]


def test_positions_do_not_depend_on_splits(spark, tmp_path):
    names = [[f"JOB_{k}_{i}" for i in range(n)] for k, n in ((0, 3000), (1, 1), (2, 2000))]
    for k, jobs in enumerate(names):
        (tmp_path / f"jobs{k}.csv").write_text("job_name,job_type\n" + "".join(f"{j},CMD\n" for j in jobs))
    expected = [j for jobs in names for j in jobs]
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {k: spark.conf.get(k) for k in (size, cost)}
    try:
        for split, open_cost in (("64m", "4m"), ("1500b", "1b"), ("9k", "1b")):
            spark.conf.set(size, split)
            spark.conf.set(cost, open_cost)
            for multi_line in (True, False):
                rows = C.read_string_csv(spark, str(tmp_path), multi_line)
                got = sorted((r.input_order, r.job_name) for r in rows.collect())
                assert got == list(enumerate(expected))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_streaming_task_skew(spark):
    folder = _scratch(spark, "stream-in")
    D.write_event_log(_tasks(spark), _stages(spark), folder)
    raw = S.read_event_stream(spark, folder)
    name = "skew_" + uuid.uuid4().hex[:6]
    q = (S.stage_task_skew(S.task_stream(raw)).writeStream.outputMode("update")
         .format("memory").queryName(name)
         .option("checkpointLocation", _scratch(spark, "stream-ckpt")).start())
    q.processAllAvailable()
    q.stop()
    rows = spark.sql(f"SELECT stage_id, max_task_output, tasks FROM {name}").collect()
    assert sorted((r["stage_id"], r["max_task_output"], r["tasks"]) for r in rows) == [(1, 9, 2), (4, 3, 1)]


def test_dated_log_folders_keep_their_applications(spark):
    out = _scratch(spark, "dated")
    for app, start in (("app-1", 5), ("app-2", 9)):
        task = ('{"Event":"SparkListenerTaskEnd","Stage ID":1,"Task Info":{"Task ID":%d,"Launch Time":1,"Finish Time":3}}'
                % start)
        begin = '{"Event":"SparkListenerApplicationStart","App ID":"%s","App Name":"x","Timestamp":%d}' % (app, start)
        spark.createDataFrame([(begin,), (task,)], "value string").coalesce(1).write.mode("append").text(
            f"{out}/date=2026-01-01")
    t = EL.normalize(EL.read_event_log(spark, out))
    assert sorted((r.app_id, r.task_id) for r in t["tasks"].collect()) == [("app-1", 5), ("app-2", 9)]


def test_event_log_is_compressed_and_rolls(spark, monkeypatch):
    monkeypatch.setattr(D, "EVENTS_PER_FILE", 2)
    rows = _tasks(spark)
    many = rows.unionByName(rows.withColumn("task_id", F.col("task_id") + 100)).coalesce(1)
    out = _scratch(spark, "evlog")
    D.write_event_log(many, _stages(spark), out)
    files = [f for f in os.listdir(f"{out}/eventlog_v2_app=app-1") if f.startswith("part-")]
    assert len(files) >= 3 and all(f.endswith(".gz") for f in files)
    t = EL.normalize(EL.read_event_log(spark, out))
    assert sorted(r.task_id for r in t["tasks"].collect()) == [10, 11, 12, 110, 111, 112]


def test_events_of_one_log_do_not_meet_in_a_task(spark):
    out, key = _scratch(spark, "evlog"), "spark.sql.autoBroadcastJoinThreshold"
    D.write_event_log(_tasks(spark), _stages(spark), out)
    raw, before = EL.ingest(spark, out), spark.conf.get(key)
    spark.conf.set(key, "-1")  # as with more keys' files than the threshold
    try:
        plan = EL.normalize(raw)["tasks"]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
