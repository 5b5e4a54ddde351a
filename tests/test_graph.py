import random

import pytest
from pyspark.sql import functions as F

from pipelens.operators import graph


def test_critical_path_golden(spark):
    rows = [(0, 5, []), (1, 7, [0]), (2, 3, [0]), (3, 4, [1, 2]), (4, 9, [])]
    st = spark.createDataFrame([("app", s, d, p) for s, d, p in rows],
                               "app_id string, stage_id long, stage_time long, parents array<long>")
    path = {r["stage_id"]: r["path_time"] for r in graph.longest_path(st, ["app_id"]).collect()}
    assert path == {0: 5, 1: 12, 2: 8, 3: 16, 4: 9}
    ans = graph.critical_path_time(graph.longest_path(st, ["app_id"]), ["app_id"]).collect()[0]
    assert ans["critical_path_stage_time"] == 16


def test_missing_parent_counts_zero(spark):
    st = spark.createDataFrame([("a", 1, 4, [99])],
                               "app_id string, stage_id long, stage_time long, parents array<long>")
    assert graph.longest_path(st, ["app_id"]).collect()[0]["path_time"] == 4


def longest(rows):
    """Plain d(v) = w(v) + max d(p) over rows (vertex, weight, parents)."""
    weight, parents = {v: w for v, w, _ in rows}, {v: p for v, _, p in rows}
    done = {}
    while len(done) < len(rows):
        for v in weight:
            if v not in done and all(p in done or p not in weight or p == v for p in parents[v]):
                done[v] = weight[v] + max((done.get(p, 0) for p in parents[v] if p != v), default=0)
    return done


def stages_of(spark, rows, key="a"):
    return spark.createDataFrame([(key, *r) for r in rows],
                                 "app_id string, stage_id long, stage_time long, parents array<long>")


def test_longest_path_of_random_graphs(spark):
    rng = random.Random(5)
    for kind in range(4):
        rows = []
        for v in range(120):
            low = max(0, v - (3 if kind % 2 else 40))
            rows.append((v, rng.randrange(1, 50), rng.choices(range(low, v + 1), k=rng.randrange(0, 4)) if v else [500]))
        rows.append((900, 7, None))
        got = {r["stage_id"]: r["path_time"] for r in graph.longest_path(stages_of(spark, rows), ["app_id"]).collect()}
        assert got == longest([(v, w, p or []) for v, w, p in rows])


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, path, mode="overwrite": written.append(path) or plain(df, path, mode))
    n = 10_000
    rows = stages_of(spark, [(0, 1, [])] + [(i, 1, [i - 1]) for i in range(1, n)])
    assert graph.critical_path_time(graph.longest_path(rows, ["app_id"]), ["app_id"]).first()["critical_path_stage_time"] == n
    assert len(written) < 30


def test_layered_graph_touches_each_edge_about_once(spark, monkeypatch):
    """Vertices with several parents: an edge stays open until its parent is done."""
    rounds = []
    plain = graph.materialize

    def noted(df, path, mode="overwrite"):
        out = plain(df, path, mode)
        if "round=" in path:
            rounds.append(out.where("_p IS NOT NULL").count())
        return out

    monkeypatch.setattr(graph, "materialize", noted)
    rows = [(v, 1, [] if v < 50 else [(v // 50 - 1) * 50 + (v * k) % 50 for k in (1, 3, 7)]) for v in range(250)]
    got = {r["stage_id"]: r["path_time"] for r in graph.longest_path(stages_of(spark, rows), ["app_id"]).collect()}
    assert got == longest(rows)
    assert len(rounds) == 5


def test_cycle_is_an_error(spark):
    rows = [(0, 1, []), (1, 1, [0, 3]), (2, 1, [1]), (3, 1, [2]), (4, 1, [3])]
    with pytest.raises(RuntimeError, match="cycle"):
        graph.longest_path(stages_of(spark, rows), ["app_id"])


def test_reach_chain_and_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (5, 1)], "a long, b long")
    pairs = graph.reach(e, ["a"], ["b"])
    got = {(r["start_a"], r["a"]): r["hops"] for r in pairs.collect()}
    assert got[(5, 4)] == 4 and got[(1, 3)] == 2 and got[(2, 2)] == 3
    assert set(got) == {(s, t) for s in (1, 2, 3, 4, 5) for t in (1, 2, 3, 4)
                        if not (t == 1 and s != 5)} - {(1, 1)}


def test_reach_from_starts_and_upstream(spark):
    edges = spark.createDataFrame([("x", "y"), ("y", "z"), ("w", "z"), ("q", "r")],
                                  "source string, target string")
    nodes, rel = graph.upstream(edges, spark.createDataFrame([("z",)], "id string"))
    assert {r["id"] for r in nodes.collect()} == {"x", "y", "z", "w"}
    assert rel.count() == 3


def test_upstream_of_a_deep_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(90)], "source string, target string")
    nodes, _ = graph.upstream(edges, spark.createDataFrame([("n90",)], "id string"))
    assert nodes.count() == 91


def test_terminals(spark):
    rows = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (301, 50), (400, 401), (401, 400)]
    got = {(r["start_a"], r["a"]) for r in graph.terminals(
        spark.createDataFrame(rows, "a long, b long"), ["a"], ["b"]).collect()}
    assert got == {(i, 200) for i in range(200)} | {(300, 200), (301, 200)}


def plain_terminals(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reached(v):
        seen, todo = set(), [v]
        while todo:
            for w in out.get(todo.pop(), ()):
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    return {(v, w) for v in out for w in reached(v) if w not in out}


def test_terminals_of_random_graphs(spark):
    rng = random.Random(9)
    for n, k in ((60, 50), (60, 70), (80, 160), (40, 200)):
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(k)})
        got = [(r["start_a"], r["a"]) for r in graph.terminals(
            spark.createDataFrame(edges, "a long, b long"), ["a"], ["b"]).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_terminals(edges)
    none = spark.createDataFrame([(1, 2)], "a long, b long").where("false")
    assert graph.terminals(none, ["a"], ["b"]).count() == 0


def test_terminals_of_a_wide_layered_graph(spark, monkeypatch):
    """No written round is larger than the result."""
    sizes = []
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, path, mode="overwrite": sizes.append((path, plain(df, path, mode))) or sizes[-1][1])
    width, layers = 100, 6
    edges = [(layer * width + i, (layer + 1) * width + (i * m + 1) % width) for layer in range(layers) for i in range(width) for m in (1, 3)]
    got = {(r["start_a"], r["a"]) for r in graph.terminals(spark.createDataFrame(edges, "a long, b long"), ["a"], ["b"]).collect()}
    assert got == plain_terminals(edges)
    assert max(df.count() for path, df in sizes if "found" in path) <= len(got)


def test_terminals_rounds_read_written_steps(spark, monkeypatch):
    """The edges between branching nodes are made once; few new pairs pick the known ones
    that they meet, so that a round with few pairs does not shuffle all that are known."""
    rounds, pushed = {}, set()
    plain = graph.materialize_observed

    def noted(df, path, **aggregates):
        if "/found/" in path:
            rounds[int(path.rsplit("=", 1)[1])] = df
        if "/pushed/" in path:
            pushed.add(int(path.rsplit("=", 1)[1]))
        return plain(df, path, **aggregates)

    monkeypatch.setattr(graph, "materialize_observed", noted)
    rng = random.Random(11)
    edges = [(v, w) for v in range(1, 150) for w in {v // 2, v // 3}] + [(5, 17), (9, 90), (9, 9)]
    edges += [(v, 1000 + rng.randrange(9)) for v in range(1, 150, 7)]
    edges = sorted({(a, b) for a, b in edges if a % 13 or b >= 1000})
    for limit, few in ((60, True), (10_000, False)):
        monkeypatch.setattr(graph, "BROADCAST_ROWS", limit)
        rounds.clear(), pushed.clear()
        got = [(r["start_a"], r["a"]) for r in graph.terminals(spark.createDataFrame(edges, "a long, b long"), ["a"], ["b"]).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_terminals(edges)
        assert len(rounds) > 2 and all(not any("/core/" in f for f in df.inputFiles()) for r, df in rounds.items() if r)
        assert bool(pushed) == few
        for r in pushed:
            assert "SortMergeJoin" not in rounds[r]._jdf.queryExecution().executedPlan().toString()
