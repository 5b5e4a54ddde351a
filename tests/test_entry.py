import duckdb

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"app_id", "stage_id", "skew_ratio", "gini_output"} <= set(df.columns)


def test_every_query_has_oracle():
    """All but the training-data operators, some of which SQL can't express;
    these are held against brute force in their own tests."""
    own = set(E.queries()) - set(E.LLM_QUERIES)
    assert len(own) == 127 and own == set(E.oracle_sql()) - set(E.LLM_SQL)
    assert set(E.oracle_sql()) <= set(E.queries())


def test_oracle_matches_for_fast_keys(spark):
    con = duckdb.connect()
    for t in ["lineitem", "orders", "part", "events", "documents", "pages"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for key in ["agg_task_skew", "agg_gini_grouped", "agg_partition_stats", "graph_critical_path",
                "job_rename_v2", "lin_final"]:
        df = E.queries()[key](spark, SF)
        cols = sorted(df.columns)
        a = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
        rel = con.execute(E.oracle_sql()[key])
        names = [d[0] for d in rel.description]
        b = sorted(repr(tuple(dict(zip(names, row))[c] for c in cols)) for row in rel.fetchall())
        assert a == b, key
