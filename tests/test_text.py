from pyspark.sql import functions as F

from pipelens.functions import metrics as M
from pipelens.functions import text as T


def test_pattern_counts_golden(spark):
    df = spark.createDataFrame([("Join x Join JOIN",), (None,)], "t string")
    rows = df.select(*[c.alias(n) for n, c in T.pattern_counts("t").items()]).collect()
    assert rows[0]["num_joins"] == 2 and rows[1]["num_joins"] == 0


def test_predicates_and_ratios(spark):
    df = spark.createDataFrame([("SortMergeJoin BroadcastHashJoin", "a skew b", 5, None)],
                               "p string, j string, a long, e long")
    r = df.select(T.join_strategy_changed("p").alias("j1"), T.skew_join_applied("j").alias("s"),
                  M.statistics_issue(M.cardinality_error("a", "e")).alias("f"),
                  M.row_amplification(F.lit(1), F.lit(0)).alias("amp")).collect()[0]
    assert r["j1"] and r["s"] and r["f"] is False and r["amp"] is None


def test_column_refs(spark):
    df = spark.createDataFrame([("coalesce(raw.a, derv.derv_b, raw.CASE)",)], "e string")
    r = df.select(F.sort_array(T.column_refs("e")).alias("r")).collect()[0]["r"]
    assert r == ["a", "derv_b"]
