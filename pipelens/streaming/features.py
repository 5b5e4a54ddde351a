"""Structured Streaming over event logs.

The reference has no streaming code; the stateless F-family projections work
on a streaming DataFrame as they are. This module wires them to
``readStream``: new event-log files in a folder are read with the explicit
event schema, task events are normalised, and

* ``task_stream``       -- normalised task rows (stateless, append mode);
* ``stage_task_skew``   -- per (application, stage, event-time window)
  running max / mean of task output and their ratio, with a watermark on the
  task finish time so state for old windows is dropped;
* ``sink_tasks``        -- ``foreachBatch`` append of each micro-batch to
  Parquet (idempotent per batch id: the batch is written under its id).

Application ids come from the ``App ID`` of the ApplicationStart event in the
same micro-batch; logs are expected to arrive whole (one file per finished
application, as Spark writes them on completion).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.sources.eventlog import EVENT_SCHEMA, EVENTS, log_unit


def read_event_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Event-log files arriving in ``folder`` as a stream of raw events."""
    raw = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files)
           .option("recursiveFileLookup", "true").json(folder).withColumn("log_file", log_unit(F.col("_metadata.file_path"))))
    return raw.withColumn("event", F.substring_index("Event", ".", -1))


def task_stream(raw: DataFrame) -> DataFrame:
    """Normalised task rows; ``app_id`` is the log unit until joined with the
    application start (batch side), ``finish_ts`` is the event time."""
    ti, tm = F.col("Task Info"), F.col("Task Metrics")
    t = raw.where(F.col("event") == EVENTS["task_end"])
    return t.select(
        F.col("log_file").alias("log_unit"),
        F.col("Stage ID").alias("stage_id"), ti["Task ID"].alias("task_id"),
        (ti["Finish Time"] - ti["Launch Time"]).alias("task_runtime"),
        tm["Output Metrics"]["Records Written"].alias("output_rows"),
        F.timestamp_millis(ti["Finish Time"]).alias("finish_ts"))


def stage_task_skew(tasks: DataFrame, window: str = "1 hour",
                    watermark: str = "1 day") -> DataFrame:
    """Running task skew per (log unit, stage, event-time window)."""
    return (tasks.withWatermark("finish_ts", watermark)
            .groupBy("log_unit", "stage_id", F.window("finish_ts", window).alias("w"))
            .agg(F.max("output_rows").alias("max_task_output"),
                 F.avg("output_rows").alias("avg_task_output"),
                 F.count(F.lit(1)).alias("tasks"))
            .withColumn("skew_ratio", F.try_divide(F.col("max_task_output"),
                                                   F.col("avg_task_output"))))


def sink_tasks(tasks: DataFrame, out: str, checkpoint: str):
    """Append each micro-batch of task rows to Parquet under ``out``; the
    checkpoint folder (shared storage) makes restarts exactly-once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    return (tasks.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).start())
