"""Parquet and flat JSON sinks / readers (``sink_parquet``; lineage documents are
in :mod:`pipelens.sources.lineage_documents`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FINAL_LINEAGE_SCHEMA = ("pipeline_id string, target_table string, target_column string, "
                        "source_columns array<string>, expressions array<string>")
NODES_SCHEMA = "graph_id string, id string, label string, type string, parent_id string"
EDGES_SCHEMA = "graph_id string, source string, target string, flow_type string, logic string"


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """``sink_parquet``: overwrite Parquet (optionally partitioned)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One flat JSON object per row."""
    df.write.mode("overwrite").json(path)


def read_lineage_json(spark: SparkSession, path: str, kind: str = "final") -> DataFrame:
    """Read flat lineage rows back with an explicit schema (``final``, ``nodes``
    or ``edges``)."""
    schema = {"final": FINAL_LINEAGE_SCHEMA, "nodes": NODES_SCHEMA, "edges": EDGES_SCHEMA}[kind]
    return spark.read.schema(schema).json(path)
