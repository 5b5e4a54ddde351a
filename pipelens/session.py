"""Session construction and the shared folder used to cut lineage.

Iterative operators (closure, longest path, star expansion) write each round
to Parquet under the folder named by ``spark.checkpoint.dir``. On a cluster
that setting must point to shared storage; we only invent a folder when the
session runs in local mode and the setting is unset (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "pipelens", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # single-row-group files still split by size; rows go where their split says
        .config("spark.sql.files.maxPartitionBytes", "4m" if master.startswith("local") else "128m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for materialised rounds.

    Reads ``spark.checkpoint.dir`` from the session. When unset, only a local
    session may fall back to a fresh temporary folder (it is then recorded in
    the session so every operator of the run shares it).
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        pass
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if root:
        return root
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) before "
            "running iterative operators on a cluster")
    root = tempfile.mkdtemp(prefix="pipelens-ckpt-")
    spark.conf.set(_CHECKPOINT_KEY, root)
    if sc is not None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the checkpoint root for one operator run."""
    root = checkpoint_root(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")
