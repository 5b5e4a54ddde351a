"""Pipeline-configuration tables (section 2.13, described in prose only).

A configuration document is JSON: ``{"application": {...}, "flows": [...]}``
where a flow has ``flowId``, ``seqDependencies``, ``queries``,
``registerName`` (the frame it registers), ``storageName`` / ``saveOutput``
(the table it writes) and ``checks``. Documents are read as JSON lines with
an explicit schema and flattened with ``explode_outer``; nothing is gathered
per application.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.operators import graph

CONFIG_SCHEMA = (
    "application struct<name:string,owner:string>, "
    "flows array<struct<flowId:string,seqDependencies:array<string>,queries:array<string>,"
    "registerName:string,storageName:string,saveOutput:boolean,"
    "checks:array<struct<checkId:string,type:string,column:string>>>>, "
    "_corrupt_record string")


def read_configs(spark, path: str) -> DataFrame:
    """Configuration documents (JSON lines) with their file position."""
    return (spark.read.schema(CONFIG_SCHEMA).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
            .withColumn("doc_id", F.monotonically_increasing_id()))


def schema_check(configs: DataFrame) -> DataFrame:
    """``cfg_schema_check``: per document, valid or the reason it is rejected
    (unparseable JSON, no application name, a flow without ``flowId``)."""
    bad_flow = F.exists(F.coalesce("flows", F.array()), lambda f: f["flowId"].isNull())
    reason = (F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed JSON"))
              .when(F.col("application.name").isNull(), F.lit("missing application.name"))
              .when(bad_flow, F.lit("flow without flowId")))
    return configs.select("doc_id", F.col("application.name").alias("application"),
                          reason.isNull().alias("is_valid"), reason.alias("reason"))


def valid_configs(configs: DataFrame) -> DataFrame:
    checked = schema_check(configs).where("is_valid").select("doc_id")
    return configs.join(checked, "doc_id", "left_semi")


def flatten(configs: DataFrame) -> dict[str, DataFrame]:
    """``cfg_flatten``: application, flow, query, check and dependency tables."""
    v = valid_configs(configs)
    apps = v.select(F.col("application.name").alias("application"),
                    F.col("application.owner").alias("owner")).distinct()
    flows = v.select(F.col("application.name").alias("application"),
                     F.explode_outer("flows").alias("f")).where(F.col("f").isNotNull())
    flow_t = flows.select("application", F.col("f.flowId").alias("flow_id"),
                          F.col("f.registerName").alias("register_name"),
                          F.col("f.storageName").alias("storage_name"),
                          F.coalesce("f.saveOutput", F.lit(False)).alias("save_output"))
    queries = flows.select("application", F.col("f.flowId").alias("flow_id"),
                           F.posexplode_outer("f.queries").alias("query_pos", "query_text")) \
        .where(F.col("query_text").isNotNull())
    checks = flows.select("application", F.col("f.flowId").alias("flow_id"),
                          F.explode_outer("f.checks").alias("c")).where(F.col("c").isNotNull()) \
        .select("application", "flow_id", F.col("c.checkId").alias("check_id"),
                F.col("c.type").alias("check_type"), F.col("c.column").alias("check_column"))
    deps = flows.select("application", F.col("f.flowId").alias("flow_id"),
                        F.explode_outer("f.seqDependencies").alias("depends_on")) \
        .where(F.col("depends_on").isNotNull())
    return {"applications": apps, "flows": flow_t, "queries": queries, "checks": checks,
            "dependencies": deps}


def frame_links(t: dict[str, DataFrame]) -> DataFrame:
    """``cfg_frame_links``: frame -> frame edges from flow dependencies
    (the dependency's registered frame feeds the flow's frame) and
    frame -> table edges where a flow saves its output."""
    f = t["flows"]
    dep = (t["dependencies"].join(
        f.select("application", F.col("flow_id").alias("depends_on"),
                 F.col("register_name").alias("source")), ["application", "depends_on"])
        .join(f.select("application", "flow_id", F.col("register_name").alias("target")),
              ["application", "flow_id"])
        .select("application", "source", "target", F.lit("frame_to_frame").alias("link_type")))
    store = f.where(F.col("save_output") & F.col("storage_name").isNotNull()).select(
        "application", F.col("register_name").alias("source"),
        F.col("storage_name").alias("target"), F.lit("frame_to_table").alias("link_type"))
    return dep.unionByName(store).distinct()


def flow_dag(t: dict[str, DataFrame]) -> DataFrame:
    """``cfg_flow_dag``: execution level of each flow = longest dependency
    chain (weight 1 per flow), via the longest-path relaxation."""
    deps = t["dependencies"].groupBy("application", "flow_id").agg(
        F.collect_set("depends_on").alias("parents"))
    v = (t["flows"].select("application", "flow_id").join(deps, ["application", "flow_id"], "left")
         .select("application", "flow_id", F.lit(1).alias("w"),
                 F.coalesce("parents", F.array().cast("array<string>")).alias("parents")))
    lvl = graph.longest_path(v, ["application"], vertex="flow_id", weight="w", parents="parents",
                             name="flow-dag")
    return lvl.select("application", "flow_id", F.col("path_time").cast("int").alias("level"))


def knowledge_graph(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``cfg_knowledge_graph``: typed nodes (application, flow, query, check,
    column, frame, table) and typed edges between them. Ids are unique within
    ``application``, which every node and edge carries: two applications may
    use the same flow names."""
    app, f, q, c = t["applications"], t["flows"], t["queries"], t["checks"]
    saved = f.where(F.col("save_output") & F.col("storage_name").isNotNull())
    framed = f.where(F.col("register_name").isNotNull())
    q = q.withColumn("query_id", F.concat("flow_id", F.lit("#q"), F.col("query_pos").cast("string")))
    reads = q.withColumn("read", F.regexp_extract("query_text", r"(?i)\bfrom\s+([\w.]+)", 1)).where("read != ''")
    c = c.join(f.select("application", "flow_id", "register_name"), ["application", "flow_id"], "left") \
        .withColumn("column_id", F.concat_ws(".", F.coalesce("register_name", "flow_id"), "check_column"))

    def node(df, id_col, kind):
        return df.select("application", F.col(id_col).alias("id"), F.lit(kind).alias("type"))

    def edge(df, source, target, kind):
        return df.select("application", F.col(source).alias("source"), F.col(target).alias("target"),
                         F.lit(kind).alias("type"))

    nodes = reduce(DataFrame.unionByName, [
        node(app, "application", "application"), node(f, "flow_id", "flow"), node(q, "query_id", "query"),
        node(c, "check_id", "check"), node(c, "column_id", "column"), node(framed, "register_name", "frame"),
        node(saved, "storage_name", "table"), node(reads, "read", "table")]).distinct()
    edges = reduce(DataFrame.unionByName, [
        edge(f, "application", "flow_id", "has_flow"), edge(q, "flow_id", "query_id", "runs_query"),
        edge(reads, "query_id", "read", "reads_from"), edge(c, "flow_id", "check_id", "has_check"),
        edge(c, "check_id", "column_id", "checks_column"), edge(framed, "flow_id", "register_name", "registers"),
        edge(saved, "flow_id", "storage_name", "writes_to"),
        edge(t["dependencies"], "depends_on", "flow_id", "precedes"),
        frame_links(t).select("application", "source", "target", F.col("link_type").alias("type"))]).distinct()
    return nodes, edges


def feeders(t: dict[str, DataFrame], flow_ids: DataFrame) -> DataFrame:
    """``qa_feeders``: every flow upstream of the given flows (through
    ``seqDependencies``) with the frame it registers and the table it saves."""
    e = t["dependencies"].select("application", F.col("flow_id").alias("a"),
                                 F.col("depends_on").alias("b"))
    pairs = graph.reach(e, ["application", "a"], ["application", "b"], name="feeders",
                        starts=flow_ids.select("application", F.col("flow_id").alias("a")))
    up = pairs.select(F.col("start_application").alias("application"),
                      F.col("start_a").alias("asked_flow"), F.col("a").alias("flow_id"), "hops")
    return up.join(t["flows"], ["application", "flow_id"]).select(
        "application", "asked_flow", "flow_id", "hops", "register_name", "storage_name")


def grounding(claims: DataFrame, edges: DataFrame, keys=("source", "target")) -> DataFrame:
    """``qa_grounding``: claimed edges that do not exist."""
    return claims.join(edges.select(*keys).distinct(), list(keys), "left_anti")
