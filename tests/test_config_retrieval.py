import json
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipelens.plans import config as CFG
from pipelens.plans import retrieval as RT
from pipelens.session import checkpoint_root


def _configs(spark, docs):
    path = os.path.join(checkpoint_root(spark), f"cfg-{uuid.uuid4().hex[:8]}")
    spark.createDataFrame([(d,) for d in docs], "value string").coalesce(1).write.text(path)
    return CFG.read_configs(spark, path)


def _flow(fid, deps, frame, store=None):
    return {"flowId": fid, "seqDependencies": deps, "queries": [f"select * from {fid}"],
            "registerName": frame, "storageName": store, "saveOutput": store is not None,
            "checks": [{"checkId": f"chk_{fid}", "type": "not_null", "column": "id"}]}


def test_flatten_dag_links_and_checks(spark):
    doc = {"application": {"name": "app", "owner": "o"},
           "flows": [_flow("a", [], "fa"), _flow("b", ["a"], "fb"),
                     _flow("c", ["a", "b"], "fc", "db.c")]}
    cfgs = _configs(spark, [json.dumps(doc), "{not json", json.dumps({"application": {}, "flows": []})])
    check = {r["reason"] for r in CFG.schema_check(cfgs).collect()}
    assert check == {None, "malformed JSON", "missing application.name"}
    t = CFG.flatten(cfgs)
    assert t["flows"].count() == 3 and t["checks"].count() == 3 and t["dependencies"].count() == 3
    levels = {r["flow_id"]: r["level"] for r in CFG.flow_dag(t).collect()}
    assert levels == {"a": 1, "b": 2, "c": 3}
    links = {(r["source"], r["target"], r["link_type"]) for r in CFG.frame_links(t).collect()}
    assert ("fa", "fc", "frame_to_frame") in links and ("fc", "db.c", "frame_to_table") in links
    feed = {r["flow_id"] for r in CFG.feeders(t, t["flows"].where("flow_id = 'c'")).collect()}
    assert feed == {"a", "b"}
    claims = spark.createDataFrame([("b", "a"), ("a", "c")], "source string, target string")
    real = t["dependencies"].select(F.col("flow_id").alias("source"), F.col("depends_on").alias("target"))
    assert [tuple(r) for r in CFG.grounding(claims, real).collect()] == [("a", "c")]


def test_exact_topk_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(300, 8)).astype("float32")
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(vecs)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = RT.vector_topk(emb, RT.query_vectors(emb), k=4, salt=5).collect()
    for q in (0, 1, 2):
        qv = vecs[q].astype(float)
        sims = vecs.astype(float) @ qv / (np.linalg.norm(vecs.astype(float), axis=1) * np.linalg.norm(qv))
        want = list(np.argsort(-sims, kind="stable")[:4])
        have = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert have == want
        assert max(r["score"] for r in got if r["query_id"] == q) == pytest.approx(1.0)


def test_flows_of_two_applications_stay_apart(spark):
    rows = ['{"application": {"name": "%s", "owner": "o"}, "flows": [{"flowId": "f1", "seqDependencies": [], '
            '"queries": ["select a from db.x"], "registerName": "r", "checks": [{"checkId": "c", "type": "t", "column": "a"}]}]}'
            % app for app in ("one", "two")]
    docs = CFG.valid_configs(_configs(spark, rows))
    nodes, edges = CFG.knowledge_graph(CFG.flatten(docs))
    assert nodes.where("type = 'flow'").count() == 2
    ids = {(r.application, r.id) for r in nodes.collect()}
    assert all((e.application, e.source) in ids and (e.application, e.target) in ids for e in edges.collect())


def test_hybrid_keeps_neighbours_of_other_labels(spark):
    emb = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [1.0, 0.05], 1)],
                                "vec_id long, embedding array<float>, label int")
    queries = RT.query_vectors(emb.where("label = 0"))
    edges = spark.createDataFrame([(1, 3)], "src long, dst long")
    got = [r.vec_id for r in RT.hybrid_topk(emb, queries, edges, 3).orderBy("rank").collect()]
    assert got[0] in (1, 3) and set(got) == {1, 2, 3}
