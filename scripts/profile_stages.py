"""Profile one registered query through Spark's own event log.

usage: python scripts/profile_stages.py <key> [sf_dir] [top]

Runs the query (noop sink) in a session that writes its event log to a fresh
scratch folder, then reads that log back with pipelens' event-log reader and
prints the slowest stages, task skew per stage and the critical path of the
stage DAG -- the F-family operators applied to our own runs.
"""

from __future__ import annotations

import glob
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from pipelens.operators import graph, stats  # noqa: E402
from pipelens.plans import bindings  # noqa: E402
from pipelens.session import build_session  # noqa: E402
from pipelens.sources import eventlog as EL  # noqa: E402


def main() -> None:
    key = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    top = int(sys.argv[3]) if len(sys.argv) > 3 else 15
    log_dir = tempfile.mkdtemp(prefix="run-evlog-")
    spark = build_session("local[8]", extra={"spark.eventLog.enabled": "true",
                                             "spark.eventLog.dir": log_dir,
                                             "spark.eventLog.compress": "false"})
    bindings.REGISTRY[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()
    query_log = sorted(glob.glob(f"{log_dir}/*"))[0]   # taken before the reader starts

    spark = build_session("local[4]", extra={"spark.eventLog.enabled": "false"})
    t = EL.normalize(EL.read_event_log(spark, query_log))
    t["stages"].orderBy(F.desc("stage_time")).select(
        "stage_id", "num_tasks", "stage_time", "stage_name").show(top, truncate=60)
    stats.sort_skew_desc(stats.task_skew(t["tasks"], ["stage_id"], "task_runtime")).show(top)
    path = graph.longest_path(t["stages"], ["app_id"])
    graph.critical_path_time(path, ["app_id"]).show()
    print("total stage time (ms):", t["stages"].agg(F.sum("stage_time")).collect()[0][0])


if __name__ == "__main__":
    main()
