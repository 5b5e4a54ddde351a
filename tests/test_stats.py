import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pipelens.operators import ids, stats


def test_gini_golden(spark):
    df = spark.createDataFrame([(1, v) for v in [1, 2, 3, 4]], "g int, v long")
    row = stats.gini(df, ["g"], "v").collect()[0]
    assert row["gini"] == pytest.approx(0.25)


def test_gini_all_null_is_zero_and_zero_sum_is_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 0), (2, 0)], "g int, v long")
    got = {r["g"]: r["gini"] for r in stats.gini(df, ["g"], "v").collect()}
    assert got[1] == 0.0
    assert got[2] is None


def test_gini_matches_pairwise_with_hot_group(spark):
    rng = np.random.default_rng(7)
    vals = rng.integers(0, 50, 3000)
    rows = [(0 if i % 3 else 1, int(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, v long")
    got = {r["g"]: r["gini"] for r in stats.gini(df, ["g"], "v", buckets=16).collect()}
    forced = {r["g"]: r["gini"] for r in stats.gini_from_hist(
        stats.rank_histogram(df, ["g"], "v", buckets=16, split_min=0), ["g"]).collect()}
    assert forced == pytest.approx(got)
    for g in (0, 1):
        x = np.array([v for gg, v in rows if gg == g], dtype=float)
        pair = np.abs(x[:, None] - x[None, :]).sum() / (2 * len(x) ** 2 * x.mean())
        assert got[g] == pytest.approx(pair, rel=1e-9)
        assert 0 <= got[g] < 1


def test_constant_gini_zero(spark):
    df = spark.createDataFrame([(1, 5)] * 10, "g int, v long")
    assert stats.gini(df, ["g"], "v").collect()[0]["gini"] == pytest.approx(0.0)


def test_partition_stats_golden(spark):
    df = spark.createDataFrame([("a", v) for v in [1, 2, 3, 4]], "app_id string, shuffle_read_bytes long")
    r = stats.partition_stats(df, ["app_id"]).collect()[0]
    mb = 1024 * 1024
    assert r["median_partition_size_mb"] * mb == pytest.approx(3)
    assert r["partition_size_stddev"] == pytest.approx(1.118034, rel=1e-6)
    assert r["partition_skew_ratio"] == pytest.approx(4 / 4)


def test_partition_stats_null_as_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", 10), ("a", 20)], "app_id string, shuffle_read_bytes long")
    r = stats.partition_stats(df, ["app_id"]).collect()[0]
    assert r["min_partition_size_mb"] == 0.0
    assert r["median_partition_size_mb"] * 1024 * 1024 == pytest.approx(10)


def test_exact_percentiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = [int(v) for v in rng.integers(0, 1000, 2001)]
    df = spark.createDataFrame([(1, v) for v in vals], "g int, v long")
    r = stats.exact_percentiles(df, ["g"], "v", [0.5, 0.95, 0.99], ["p50", "p95", "p99"],
                                buckets=8).collect()[0]
    h = stats.rank_histogram(df, ["g"], "v", buckets=8, split_min=0)
    r2 = stats.percentiles_from_hist(h, ["g"], [0.5], ["p50"]).collect()[0]
    assert r2["p50"] == pytest.approx(np.percentile(vals, 50))
    for name, p in (("p50", 50), ("p95", 95), ("p99", 99)):
        assert r[name] == pytest.approx(np.percentile(vals, p))


def test_rank_histogram_equals_window(spark):
    rows = [(i % 2, (i * 37) % 101) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, v long")
    h = stats.rank_histogram(df, ["g"], "v", buckets=7, split_min=10)
    w = Window.partitionBy("g").orderBy("v")
    ref = (df.groupBy("g", "v").agg(F.count("*").alias("c"))
           .withColumn("below", F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    a = sorted((r["g"], r["v"], r["c"], r["below"]) for r in h.collect())
    b = sorted((r["g"], r["v"], r["c"], r["below"]) for r in ref.collect())
    assert a == b


def test_sequence_number_dense_and_ordered(spark):
    rows = [(i, "hot" if i % 4 else f"k{i % 3}") for i in range(2000)]
    df = spark.createDataFrame(rows, "o long, g string")
    out = ids.sequence_number(df, ["g"], "o", "seq", buckets=9, split_min=100).collect()
    by = {}
    for r in out:
        by.setdefault(r["g"], []).append((r["o"], r["seq"]))
    for g, lst in by.items():
        lst.sort()
        assert [s for _, s in lst] == list(range(1, len(lst) + 1))


def test_task_skew_and_corr(spark):
    df = spark.createDataFrame([(1, 1, 10, 1.0), (1, 2, 30, 3.0), (2, 3, 5, 2.0)],
                               "stage_id int, task_id int, output_rows long, task_runtime double")
    sk = {r["stage_id"]: r for r in stats.task_skew(df, ["stage_id"]).collect()}
    assert sk[1]["skew_ratio"] == pytest.approx(30 / 20)
    c = stats.correlation(df, [], "output_rows", "task_runtime", "c").collect()[0]["c"]
    assert c == pytest.approx(np.corrcoef([10, 30, 5], [1, 3, 2])[0, 1])


def test_buckets_of_hot_groups_by_compared_points(spark):
    """Rows meet the split points by a broadcast join and comparisons, not by a
    lambda over all points; where no group is hot they meet nothing."""
    rows = [(0, (i * 37) % 500) for i in range(500)] + [(1, i) for i in range(20)] + [(0, None), (None, 5)]
    df = spark.createDataFrame(rows, "g int, v int")
    out = stats._with_buckets(df, ["g"], "v", 8, 100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "lambda" not in plan
    points = df.where("g = 0").select(F.percentile_approx("v", [k / 8 for k in range(1, 8)], 10000).alias("p")).first()["p"]
    got = sorted(out.collect(), key=str)
    assert got == sorted(((g, v, sum(p < v for p in points) if g == 0 and v is not None else 0) for g, v in rows), key=str)
    plan = stats._with_buckets(df, ["g"], "v", 8, 1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
