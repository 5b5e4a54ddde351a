import pytest
from pyspark.sql import functions as F

from pipelens.operators import graph
from pipelens.operators import lineage as L
from pipelens.plans import lineage_jobs as LJ
from pipelens.session import scratch_path
from pipelens.sources import driver_tables as D

SCHEMA = ("pipeline_id string, stmt_order long, target_table string, target_column string, "
          "ordinal int, source_table string, source_column string, expression string")


def _assign(spark, rows):
    return spark.createDataFrame([("p",) + tuple(r) for r in rows], SCHEMA)


def test_simple_ctas_golden(spark):
    st = spark.createDataFrame([("p", 1, "create table tgt as select a.x as y, a.z from db.src a")],
                               "pipeline_id string, stmt_order long, sql_text string")
    got = sorted((r["source_table"], r["source_column"], r["target_column"], r["source_alias"])
                 for r in L.simple_ctas(st).collect())
    assert got == [("db.src", "x", "y", "a"), ("db.src", "z", "z", "a")]
    gate = L.simple_gate(st).collect()[0]["is_simple"]
    assert gate is True


def test_base_columns_golden(spark):
    a = _assign(spark, [(1, "t1", "b", 0, "base", "a", None), (2, "t2", "c", 0, "t1", "b", None)])
    bases = {(r["target_table"], r["target_column"]): (r["base_table"], r["base_column"])
             for r in L.base_columns(a).collect()}
    assert bases[("t2", "c")] == ("base", "a")
    assert bases[("t1", "b")] == ("base", "a")


def test_diamond_is_order_independent(spark):
    a = _assign(spark, [(1, "m1", "x", 0, "b", "x", None), (2, "m2", "x", 0, "b", "y", None),
                        (3, "t", "x", 0, "m1", "x", "m1.x + m2.x"), (3, "t", "x", 0, "m2", "x", "m1.x + m2.x")])
    f = {r["target_column"]: r for r in L.final_lineage(a).where(F.col("target_table") == "t").collect()}
    assert f["x"]["source_columns"] == ["default.b.x", "default.b.y"]
    assert f["x"]["expressions"] == ["m1.x + m2.x"]


def test_star_expansion_and_last_definition(spark):
    a = _assign(spark, [(1, "s", "c1", 0, "base", "k1", None), (1, "s", "c2", 1, "base", "k2", "upper(x.k2)"),
                        (2, "t", "*", 0, "s", None, "*"),
                        (3, "u", "z", 0, "base", "old", None), (4, "u", "z", 0, "base", "new", None)])
    f = {(r["target_table"], r["target_column"]): r for r in L.final_lineage(a).collect()}
    assert f[("t", "c1")]["source_columns"] == ["default.base.k1"]
    assert f[("t", "c2")]["expressions"] == ["upper(x.k2)"]
    assert f[("u", "z")]["source_columns"] == ["default.base.new"]


def test_renames_through_nested_stars(spark):
    """u expands t, which expands s and passes c1 on as r1; u passes r1 on as q1."""
    a = _assign(spark, [(1, "s", "c1", 0, "base", "k1", "upper(x.k1)"), (1, "s", "c2", 1, "base", "k2", None),
                        (2, "t", "*", 0, "s", None, "*"), (2, "t", "r1", 1, "s", "c1", None),
                        (3, "u", "*", 0, "t", None, "*"), (3, "u", "q1", 1, "t", "r1", None),
                        (4, "v", "*", 0, "u", None, "*")])
    rows = {(r["target_table"], r["target_column"]): (r["source_table"], r["source_column"], r["star_owner"], r["star_column"])
            for r in L.expand_star(a).collect()}
    assert rows == {("t", "c2"): ("s", "c2", "s", "c2"), ("u", "c2"): ("t", "c2", "s", "c2"),
                    ("v", "c2"): ("u", "c2", "s", "c2"), ("v", "q1"): ("u", "q1", "u", "q1")}
    f = {(r["target_table"], r["target_column"]): r["source_columns"] for r in L.final_lineage(a).collect()}
    assert f[("v", "q1")] == f[("u", "q1")] == f[("t", "r1")] == ["default.base.k1"]
    assert ("u", "c1") not in f and ("v", "r1") not in f


def test_subquery_renames_cycles_and_equal_names(spark):
    a = _assign(spark, [(1, "s", "a", 0, "base", "k", "f(x.k)"), (1, "s", "b", 1, "base", "l", None), (2, "w", "a", 0, "base", "m", None),
                        (3, "t", "*", 0, "s", None, "*"), (3, "t", "*", 1, "w", None, "*"), (4, "u", "*", 0, "t", None, "*"),
                        (5, "x", "*", 0, "y", None, "*"), (6, "y", "*", 0, "x", None, "*"), (6, "y", "own", 1, "base", "o", None)])
    renamed = spark.createDataFrame([(a.first()[L.P], "t", "a", "z")], f"{L.P} string, target_table string, source_name string, target_name string")
    rows = sorted((r["target_table"], r["target_column"], r["source_table"], r["source_column"], r["star_owner"], r["star_column"])
                  for r in L.expand_star(a, subqueries=renamed).collect())
    assert rows == [("t", "b", "s", "b", "s", "b"), ("t", "z", "s", "a", "s", "a"), ("t", "z", "w", "a", "w", "a"),
                    ("u", "b", "t", "b", "s", "b"), ("u", "z", "t", "z", "s", "a"), ("x", "own", "y", "own", "y", "own")]
    plain = {(r["target_table"], r["target_column"], r["source_table"]) for r in L.expand_star(a).collect()}
    assert {("t", "a", "s"), ("t", "a", "w"), ("u", "a", "t")} <= plain


def test_name_fallback(spark):
    a = _assign(spark, [(1, "t1", "v", 0, "base", "v", None), (2, "t2", "v", 0, None, None, "'lit'")])
    f = {(r["target_table"], r["target_column"]): r for r in L.final_lineage(a).collect()}
    assert f[("t2", "v")]["source_columns"] == ["default.base.v"]


def test_validate_fix_golden(spark):
    final = spark.createDataFrame(
        [("t", ["s.raw_t.a", "s.raw_t.a", "s.raw_t.z"], ["coalesce(raw.a, derv.derv_b)"])],
        "target_column string, source_columns array<string>, expressions array<string>")
    r = L.validate_fix(final, "orders_raw.items").collect()[0]
    assert r["source_columns"] == ["s.raw_t.a", "s.raw_t.b"]
    assert r["issues"] == ["  t: Removed duplicate source columns: s.raw_t.a",
                           "  t: Removed unused source columns: s.raw_t.z",
                           "  t: Added missing columns: s.raw_t.b"]


def test_multi_hop_direct_pass_through(spark):
    a = _assign(spark, [(1, "t1", "b", 0, "base", "a", None)])
    edges = L.multi_hop_edges(a).collect()
    col = [e for e in edges if e["flow_type"] == "column_level"]
    assert [(e["source"], e["target"], e["logic"]) for e in col] == [("base.a", "t1.b", "Direct Pass-Through")]
    nodes = {r["id"]: r["type"] for r in L.multi_hop_nodes(a).collect()}
    assert nodes == {"t1": "table", "t1.b": "column", "base": "table"}


def test_valid_column_name(spark):
    names = ["ok_name", "", "'x'", "123", "f(x)", "a,b", "plan", "...", "9abc", "_x", "a b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r["n"]: r["v"] for r in df.select("n", L.valid_column_name("n").alias("v")).collect()}
    assert got == {"ok_name": True, "": False, "'x'": False, "123": False, "f(x)": False,
                   "a,b": False, "plan": False, "...": False, "9abc": False, "_x": True, "a b": True}


def test_validate_fix_passthrough_modes(spark):
    final = spark.createDataFrame([("t", ["s.raw_t.a"], [])],
                                  "target_column string, source_columns array<string>, expressions array<string>")
    kept = L.validate_fix(final, "orders_raw.items").collect()[0]
    assert kept["source_columns"] == ["s.raw_t.a"] and kept["issues"] == []
    wiped = L.validate_fix(final, "orders_raw.items", repair_passthrough=True).collect()[0]
    assert wiped["source_columns"] == []
    assert wiped["issues"] == ["  t: Removed unused source columns: s.raw_t.a"]


def test_hub_edges(spark):
    from pipelens.plans import lineage_jobs as LJ
    final = spark.createDataFrame(
        [("p", "t", "x", ["b.a", "b.c"], ["a + c"]), ("p", "t", "y", ["b.a"], [])],
        "pipeline_id string, target_table string, target_column string, "
        "source_columns array<string>, expressions array<string>")
    got = sorted((r["source"], r["target"], r["label"]) for r in LJ.hub_edges(final).collect())
    assert got == [("b.a", "t.y", "Raw Copy"), ("b.a", "transform_t.x", None),
                   ("b.c", "transform_t.x", None), ("transform_t.x", "t.x", "a + c")]


def test_fallback_by_source_name(spark):
    """A reference to a column its table lacks takes another target's column
    of that name; the resolved reference beside it stays."""
    a = _assign(spark, [(1, "t0", "y", 0, "raw.b", "y", None), (2, "t1", "z", 0, "raw.c", "z", None),
                        (3, "t2", "x", 0, "t1", "y", "t1.y + t1.z"), (3, "t2", "x", 0, "t1", "z", "t1.y + t1.z")])
    f = {(r["target_table"], r["target_column"]): r["source_columns"] for r in L.final_lineage(a).collect()}
    assert f[("t2", "x")] == ["raw.b.y", "raw.c.z"]
    edges = {(e["source"], e["target"]) for e in L.multi_hop_edges(a).collect() if e["flow_type"] == "column_level"}
    assert {("raw.b.y", "t2.x"), ("raw.c.z", "t2.x")} <= edges


def test_tables_without_sources_are_bases(spark):
    a = _assign(spark, [(1, "lit", "v", 0, None, None, "1 + 1"), (2, "d", "v", 0, "lit", "v", None)])
    assert [(r["target_table"], r["base_table"]) for r in L.base_tables(a).collect()] == [("d", "lit")]


def test_multi_line_ctas(spark):
    st = spark.createDataFrame([("p", 1, "create table t as\nselect\n  x,\n\ty as\n z\nfrom db.s")],
                               "pipeline_id string, stmt_order long, sql_text string")
    got = [(r["source_column"], r["target_column"]) for r in L.simple_ctas(st).orderBy("position").collect()]
    assert got == [("x", "x"), ("y", "z")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _written(spark, df, name):
    return graph.materialize(df, scratch_path(spark, name))


def test_last_definition_broadcasts_nothing(spark):
    rows = [(1, "t", "a", 0, "b", "x", None), (2, "t", "a", 0, "b", "y", None), (2, "t", "c", 1, "b", "z", None),
            (2, "t", "c", 1, "b", "z", None), (1, None, "a", 0, "b", "x", None), (None, "u", "a", 0, "b", "x", None),
            (None, "v", "a", 0, "b", "x", None), (3, "v", "a", 0, "b", "w", None)]
    a = _written(spark, _assign(spark, rows), "last-test")
    last = L.last_definition(a)
    assert "Broadcast" not in _plan(last)
    assert sorted((r.target_table, r.target_column, r.source_column) for r in last.collect()) == [
        ("t", "a", "y"), ("t", "c", "z"), ("t", "c", "z"), ("v", "a", "w")]


def test_joins_of_written_tables_are_not_broadcast(spark):
    a = _written(spark, _assign(spark, [(1, "s", "x", 0, "b", "k", None), (2, "t", "y", 0, "s", "x", "upper(s.x)"),
                                        (3, "u", "z", 0, "t", "q", None)]), "hint-test")
    edges, nodes = L.multi_hop_edges(a), L.multi_hop_nodes(a)
    assert "Broadcast" not in _plan(edges) and "Broadcast" not in _plan(nodes)
    got = {(r.source, r.target) for r in edges.where("flow_type = 'column_level'").collect()}
    assert got == {("b.k", "s.x"), ("b.k", "t.y")}
    hop = LJ.multi_hop(a)
    assert "Broadcast" not in _plan(hop) and hop.count() == 5


def test_sides_above_the_limit_are_shuffled(spark, monkeypatch):
    rows = [(1, "t1", "*", 0, "t0", None, "*"), (0, "t0", "x", 0, "b", "k", None), (0, "t0", "q", 1, None, None, "'n'"),
            (2, "t2", "y", 0, "t1", "x", None), (2, "t2", "y", 0, "t1", "q", None), (3, "t3", "z", 0, "t2", "y", None),
            (4, "t4", "q", 0, "c", "q", None), (5, "t5", "v", 0, "t3", "z", None), (5, "t5", "v", 0, "t2", "y", None)]
    a = _written(spark, _assign(spark, rows), "sized-test")

    def result():
        f = {(r.target_table, r.target_column, tuple(r.source_columns)) for r in L.final_lineage(a).collect()}
        nodes, edges = L.multi_hop_nodes(a), L.multi_hop_edges(a)
        up = {(r.graph_id, r.id) for r in LJ.upstream_of_label(nodes, edges, "v").collect()}
        return f, up, {tuple(r) for r in LJ.union_sources(L.last_definition(a)).collect()}

    small = result()
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    assert "Broadcast" not in _plan(graph.sized(a, 1).join(graph.sized(a, 1), "pipeline_id"))
    assert result() == small
    assert ("t5", "v", ("default.b.k", "default.c.q")) in small[0]


def test_keys_are_dealt_out_before_they_become_rows(spark, tmp_path):
    spark.range(60).selectExpr("id AS p_partkey", "int(id % 50) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    a = D.assignments(spark, str(tmp_path))
    assert "hashpartitioning(p_partkey" in _plan(a)
    assert {(r.target_table, r.source_table, r.source_column) for r in a.where("stmt_order = 17").collect()} == {
        ("t17_REPORT", "t8", "c0"), ("t17_REPORT", "raw.t5", "c1"), ("t17_REPORT", "t8", "c3"), ("t17_REPORT", "t8", "c2")}


def test_valid_names_trim_once_per_rule_set(spark):
    """One pattern for all rules; before, each of them trimmed the name again."""
    names = ["a", " _x1 ", "é", "9", "a9", "", " ", "a'b", "a(b", "a,b", "a\nb", "a\n", "\ta", "a.b", "-a", "[a", "a[b]", "CASE ", "cases", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    plan = _plan(df.where(L.valid_column_name("name")))
    assert plan.count("regexp_replace") <= 2
    assert [r.name for r in df.where(L.valid_column_name("name")).collect()] == [
        "a", " _x1 ", "é", "a9", "a\n", "\ta", "a.b", "a[b]", "cases"]


def _lineage_part(spark, folder):
    spark.range(60).selectExpr("id AS p_partkey", "int(id % 50) AS p_size").coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_fallback_reads_written_columns_and_bases(spark, tmp_path):
    """Ends, columns and known bases are made once, not at each of their uses."""
    latest = L.written_last_definition(D.assignments(spark, _lineage_part(spark, tmp_path)), "fallback-test")
    a = _written(spark, L.with_stars_expanded(latest), "fallback-test-a")
    ends = _written(spark, L.column_terminals(a, defined=L.defined_tables(latest)), "fallback-test-ends")
    files = L.name_fallback(a, ends).inputFiles()
    assert any("/columns/" in f for f in files) and any("/known/" in f for f in files)


def test_few_donors_leave_the_base_columns_in_place(spark, tmp_path, monkeypatch):
    """Counted donors are broadcast; above the limit the join is a shuffle and gives the same rows."""
    latest = L.written_last_definition(D.assignments(spark, _lineage_part(spark, tmp_path)), "donors-test")
    a = _written(spark, L.with_stars_expanded(latest), "donors-test-a")
    ends = _written(spark, L.column_terminals(a, defined=L.defined_tables(latest)), "donors-test-ends")
    plans, written = [], graph.materialize_observed

    def seen(df, path, **k):
        if path.endswith(("/given1", "/given2")):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, path, **k)
    monkeypatch.setattr(graph, "materialize_observed", seen)
    few = L.name_fallback(a, ends).collect()
    assert len(plans) == 2 and all("rightHint=(strategy=broadcast)" in p for p in plans)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    many = L.name_fallback(a, ends).collect()
    assert len(plans) == 4 and all("rightHint=(strategy=merge)" in p for p in plans[2:])
    assert few and sorted(map(tuple, few)) == sorted(map(tuple, many))


def test_schema_join_never_broadcasts_the_tables(spark, tmp_path, monkeypatch):
    """Above the limit nothing is broadcast; below it the schemas are, not the tables."""
    from pipelens.plans import bindings
    folder = _lineage_part(spark, tmp_path)
    few = bindings.REGISTRY["fn_schema_prefix"](spark, folder)
    rows = {tuple(r) for r in few.collect()}
    assert "BuildRight" in _plan(few) and "BuildLeft" not in _plan(few)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    many = bindings.REGISTRY["fn_schema_prefix"](spark, folder)
    assert {tuple(r) for r in many.collect()} == rows and "Broadcast" not in _plan(many)


@pytest.fixture(scope="module")
def resolved(spark, tmp_path_factory):
    """One folder of part with its resolved lineage and base tables, made once."""
    folder = _lineage_part(spark, tmp_path_factory.mktemp("resolved"))
    tables = L.resolve(D.assignments(spark, folder), True, "query-plans")
    return folder, tables, _written(spark, L.base_tables(tables[0]), "query-plans-bases")


@pytest.mark.parametrize("key", [
    "agg_sources_per_target", "fn_truncate_logic", "graph_column_edges", "graph_edge_details", "graph_hub_edges",
    "graph_table_edges", "job_column_lineage", "job_multi_hop", "lin_final", "lin_multi_hop_edges", "lin_validate_fix",
    "set_dedup_edges", "set_missing_refs", "set_unique_details", "set_unused_sources", "set_dedup_nodes",
    "lin_multi_hop_nodes", "fn_column_refs"])
def test_lineage_queries_broadcast_no_tables(spark, resolved, monkeypatch, key):
    """The files here are far below Spark's limit: a join side left to it is broadcast."""
    from pipelens.plans import bindings
    folder, tables, bases = resolved
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(L, "resolve", lambda *args, **more: tables)
    monkeypatch.setattr(L, "base_tables", lambda *args, **more: bases)
    assert "Broadcast" not in _plan(bindings.REGISTRY[key](spark, folder))
