"""Distribution statistics that stay distributed under hot groups.

The core building block is :func:`stacked_histogram`: ranked metrics are melted
into rows (metric, group, value), counted in one pass with a map-side partial
aggregate, and written once. For every value ``v`` it then gives ``c`` (copies
of ``v``) and ``below`` (number of values strictly smaller than ``v``) in its
metric and group. Everything rank-based -- Gini, the upper median, exact
percentiles -- is an aggregate over it, and :func:`summarise` takes any number
of them, of any metrics, in one aggregate.

How it avoids one giant sort per group (a group may hold a third of all rows):

1. equal values collapse before the shuffle, which is keyed by (metric, group,
   value), so a hot group spreads out;
2. only where the written histogram shows groups of more than ``split_min``
   distinct values, ``approx_percentile`` over them gives split points;
   ``bucket`` = number of split points below ``v`` (monotone in ``v``), the
   running count is a window over (metric, group, bucket), and bucket offsets
   come from a window over the tiny bucket totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelens.operators import graph
from pipelens.session import scratch_path

DEFAULT_BUCKETS = 64
# groups with more distinct values than this are split into buckets
SPLIT_MIN = 1_000_000


def _cols(group_cols: Sequence[str] | str | None) -> list[str]:
    if group_cols is None:
        return []
    if isinstance(group_cols, str):
        return [group_cols]
    return list(group_cols)


def stacked_histogram(df: DataFrame, group_cols, metrics: Mapping[str, Column | str],
                      buckets: int = DEFAULT_BUCKETS, split_min: int = SPLIT_MIN) -> DataFrame:
    """(metric, group..., v, c, below, n) of several metrics from one scan.

    ``below`` counts values < v of the metric in the group, ``n`` the non-null
    ones. A null is a row with ``v`` null that counts in neither, so groups
    without any value remain visible. The counts are written once; what reads
    them does not scan ``df`` again."""
    g = _cols(group_cols)
    melted = df.select(*g, F.inline(F.array(*[
        F.struct(F.lit(k).alias("metric"), (F.col(c) if isinstance(c, str) else c).alias("v"))
        for k, c in metrics.items()])))
    path = scratch_path(df.sparkSession, "ranks")
    melted.groupBy("metric", *g, "v").agg(F.count(F.lit(1)).alias("c")).write.parquet(path)
    hist = df.sparkSession.read.parquet(path)
    k = F.when(F.col("v").isNotNull(), F.col("c")).otherwise(F.lit(0))
    group = ["metric", *g]
    before = Window.unboundedPreceding, -1
    if hist.count() <= split_min:  # then no group is larger
        w = Window.partitionBy(*group)
        return hist.select(
            *group, "v", "c",
            F.coalesce(F.sum(k).over(w.orderBy("v").rowsBetween(*before)), F.lit(0)).alias("below"),
            F.sum(k).over(w).alias("n"))
    hist = _with_buckets(hist, group, "v", buckets, split_min)
    w = Window.partitionBy(*group).orderBy("bucket")
    totals = hist.groupBy(*group, "bucket").agg(F.sum(k).alias("_bc")).select(
        *group, "bucket", F.coalesce(F.sum("_bc").over(w.rowsBetween(*before)), F.lit(0)).alias("_offset"),
        F.sum("_bc").over(Window.partitionBy(*group)).alias("n"))
    inside = Window.partitionBy(*group, "bucket").orderBy("v").rowsBetween(*before)
    hist = hist.withColumn("_run", F.coalesce(F.sum(k).over(inside), F.lit(0)))
    return hist.join(totals, group + ["bucket"]).select(
        *group, "v", "c", (F.col("_offset") + F.col("_run")).alias("below"), "n")


def rank_histogram(df: DataFrame, group_cols, value: str,
                   buckets: int = DEFAULT_BUCKETS, split_min: int = SPLIT_MIN) -> DataFrame:
    """(group..., v, c, below, n) of one metric, with nulls removed."""
    h = stacked_histogram(df, group_cols, {value: value}, buckets, split_min)
    return h.where(F.col("v").isNotNull()).drop("metric")


class Measure:
    """Aggregates over a rank histogram and the columns made of their results;
    ``metric`` picks the rows of one stacked metric."""

    def __init__(self, aggregates: dict[str, Column], columns: dict[str, Column]) -> None:
        self.aggregates, self.columns = aggregates, columns


def summarise(h: DataFrame, group_cols, *measures: Measure) -> DataFrame:
    """One row per group with the columns of all measures, in one aggregate."""
    g = _cols(group_cols)
    parts = h.groupBy(*g).agg(*[a.alias(n) for m in measures for n, a in m.aggregates.items()])
    return parts.select(*g, *[c.alias(n) for m in measures for n, c in m.columns.items()])


def _of(metric: str | None, x: Column, also: Column | None = None) -> Column:
    """``x`` where the row belongs to the metric, has a value and meets ``also``."""
    rows = F.col("v").isNotNull()
    if metric is not None:
        rows &= F.col("metric") == metric
    return F.when(rows if also is None else rows & also, x)


def _points_below(low: int, high: int, order_col: str) -> Column:
    """Number of the sorted ``_splits`` below ``order_col``, known to be from
    ``low`` to ``high``: a binary search in comparisons of columns."""
    if low == high:
        return F.lit(low)
    mid = (low + high) // 2
    return F.when(F.col(order_col) > F.col("_splits")[mid], _points_below(mid + 1, high, order_col)).otherwise(
        _points_below(low, mid, order_col))


def _with_buckets(df: DataFrame, g: list[str], order_col: str, buckets: int,
                  split_min: int, out: str = "bucket") -> DataFrame:
    """Add ``out``: 0 for groups of at most ``split_min`` rows, else the number
    of ``approx_percentile`` split points below ``order_col`` (monotone in it).
    The split-point table has one row per hot group only; it is written and
    counted, so that the rows are neither shuffled to meet it nor joined at all
    where no group is hot."""
    if buckets <= 1:
        return df.withColumn(out, F.lit(0))
    keys = g or ["_all"]
    d = df if g else df.withColumn("_all", F.lit(0))
    probs = [k / buckets for k in range(1, buckets)]
    hot = (d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_gsize"))
           .where(F.col("_gsize") > split_min).select(*keys))
    root, rows = scratch_path(df.sparkSession, "splits"), F.count(F.lit(1))
    hot, told = graph.materialize_observed(hot, f"{root}/hot", rows=rows)
    if not told["rows"]:
        return df.withColumn(out, F.lit(0))
    splits = (d.join(graph.sized(hot, told["rows"]), on=keys, how="left_semi").groupBy(*keys)
              .agg(F.percentile_approx(order_col, probs, 10000).alias("_splits")))
    splits = graph.materialize(splits, f"{root}/points")
    d = d.join(graph.sized(splits, told["rows"]), on=keys, how="left")
    d = d.withColumn(out, F.when(F.col("_splits").isNull(), F.lit(0))
                     .otherwise(_points_below(0, len(probs), order_col))).drop("_splits")
    return d if g else d.drop("_all")


def gini_measure(alias: str = "gini", metric: str | None = None, no_values: float | None = None) -> Measure:
    """Gini coefficient: with ``below`` = F values under v and c copies, the
    rank-weighted sum gains ``v * (c*F + c*(c+1)/2)``. ``no_values`` is the
    result of a group without any."""
    v, c = F.col("v").cast("double"), F.col("c").cast("double")
    n, s, w = (f"_{x}_{alias}" for x in "nsw")
    total = F.col(n).cast("double")
    ratio = 2 * F.col(w) / F.when(total * F.col(s) != 0, total * F.col(s)) - (total + 1) / total
    return Measure(
        {n: F.max(_of(metric, F.col("n"))), s: F.sum(_of(metric, v * c)),
         w: F.sum(_of(metric, v * (c * F.col("below") + c * (c + 1) / 2)))},
        {alias: F.when(F.col(n).isNull(), F.lit(no_values).cast("double")).otherwise(ratio)})


def upper_median_measure(alias: str = "median", metric: str | None = None) -> Measure:
    """``sorted(values)[n // 2]`` (the reference's median pick)."""
    k = F.floor(F.col("n") / 2)
    inside = (F.col("below") <= k) & (k < F.col("below") + F.col("c"))
    return Measure({f"_k_{alias}": F.max(_of(metric, F.col("v"), inside))}, {alias: F.col(f"_k_{alias}")})


def percentile_measure(probs: Sequence[float], aliases: Sequence[str], metric: str | None = None) -> Measure:
    """Exact percentiles with linear interpolation (Spark ``percentile``,
    DuckDB ``quantile_cont``); no group is ever buffered whole in one task."""
    aggs, columns = {}, {}
    for p, name in zip(probs, aliases):
        pos = (F.col("n") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("below") <= at) & (at < F.col("below") + F.col("c"))
            aggs[f"_{side}_{name}"] = F.max(_of(metric, F.col("v"), inside))
        aggs[f"_pos_{name}"] = F.max(_of(metric, pos))
        lo, hi = (F.col(f"_{side}_{name}").cast("double") for side in ("lo", "hi"))
        at = F.col(f"_pos_{name}")
        columns[name] = lo + (hi - lo) * (at - F.floor(at))
    return Measure(aggs, columns)


def gini(df: DataFrame, group_cols, value: str, alias: str = "gini",
         buckets: int = DEFAULT_BUCKETS, keep_empty_groups: bool = True) -> DataFrame:
    """Gini coefficient per group (``agg_gini_grouped`` / ``agg_gini_global``).

    Equal to the pairwise mean absolute difference / (2 * mean) over the
    non-null values. A group whose values are all null gives 0.0; a group
    whose values sum to zero gives null (the reference divides by zero).
    """
    h = stacked_histogram(df, group_cols, {value: value}, buckets)
    if not keep_empty_groups:
        h = h.where(F.col("v").isNotNull())
    return summarise(h, group_cols, gini_measure(alias, no_values=0.0))


def gini_from_hist(h: DataFrame, group_cols, alias: str = "gini") -> DataFrame:
    return summarise(h, group_cols, gini_measure(alias))


def upper_median(df: DataFrame, group_cols, value: str, alias: str = "median",
                 buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    return summarise(rank_histogram(df, group_cols, value, buckets), group_cols, upper_median_measure(alias))


def exact_percentiles(df: DataFrame, group_cols, value: str,
                      probs: Sequence[float], aliases: Sequence[str],
                      buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    return percentiles_from_hist(rank_histogram(df, group_cols, value, buckets), group_cols, probs, aliases)


def percentiles_from_hist(h: DataFrame, group_cols, probs: Sequence[float],
                          aliases: Sequence[str]) -> DataFrame:
    return summarise(h, group_cols, percentile_measure(probs, aliases))


def task_skew(tasks: DataFrame, group_cols=("stage_id",), value: str = "output_rows") -> DataFrame:
    """``agg_task_skew``: per stage max, mean and max/mean of a task metric."""
    g = _cols(group_cols)
    return (tasks.groupBy(*g)
            .agg(F.max(value).alias("max_task_output"),
                 F.avg(value).alias("avg_task_output"))
            .withColumn("skew_ratio",
                        F.try_divide(F.col("max_task_output"), F.col("avg_task_output"))))


def sort_skew_desc(skew: DataFrame, tie_cols=("stage_id",)) -> DataFrame:
    """``sort_skew_desc``: highest skew first, deterministic tie-break."""
    return skew.orderBy(F.col("skew_ratio").desc_nulls_last(), *[F.col(c) for c in tie_cols])


def runtime_moments(tasks: DataFrame, group_cols, value: str = "task_runtime",
                    prefix: str = "task_runtime") -> DataFrame:
    """``agg_runtime_moments``: mean, sample stddev, max, min."""
    g = _cols(group_cols)
    return tasks.groupBy(*g).agg(
        F.avg(value).alias(f"{prefix}_mean"),
        F.stddev_samp(value).alias(f"{prefix}_stddev"),
        F.max(value).alias(f"{prefix}_max"),
        F.min(value).alias(f"{prefix}_min"))


def runtime_percentiles(tasks: DataFrame, group_cols, value: str = "task_runtime",
                        exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """``agg_runtime_percentiles``: p50, p95, p99 (exact by default)."""
    g = _cols(group_cols)
    names = ["task_runtime_median", "task_runtime_p95", "task_runtime_p99"]
    probs = [0.5, 0.95, 0.99]
    if exact:
        return exact_percentiles(tasks, g, value, probs, names)
    arr = F.percentile_approx(value, probs, accuracy)
    return (tasks.groupBy(*g).agg(arr.alias("_p"))
            .select(*g, *[F.col("_p")[i].cast("double").alias(n) for i, n in enumerate(names)]))


def task_totals(tasks: DataFrame, group_cols) -> DataFrame:
    """``agg_task_totals``: the seven byte / time sums."""
    g = _cols(group_cols)
    return tasks.groupBy(*g).agg(
        F.sum("input_bytes").alias("total_input_bytes"),
        F.sum("shuffle_read_bytes").alias("total_shuffle_read_bytes"),
        F.sum("shuffle_write_bytes").alias("total_shuffle_write_bytes"),
        F.sum("memory_spill").alias("total_spill_memory_bytes"),
        F.sum("disk_spill").alias("total_spill_disk_bytes"),
        F.sum("executor_runtime").alias("total_executor_runtime"),
        F.sum("executor_cpu_time").alias("total_executor_cpu_time"))


def output_rows(tasks: DataFrame, group_cols) -> DataFrame:
    """``agg_output_rows``: records written over all tasks."""
    g = _cols(group_cols)
    return tasks.groupBy(*g).agg(F.sum("output_rows").alias("actual_output_rows"))


def stage_summary(stages: DataFrame, group_cols=("app_id",)) -> DataFrame:
    """``agg_stage_summary``: stage count, longest stage, mean and max tasks."""
    g = _cols(group_cols)
    return stages.groupBy(*g).agg(
        F.count(F.lit(1)).alias("num_stages"),
        F.max("stage_time").alias("longest_stage_time"),
        F.avg("num_tasks").alias("avg_tasks_per_stage"),
        F.max("num_tasks").alias("max_parallel_tasks"))


def partition_aggregates(value: str = "shuffle_read_bytes") -> list[Column]:
    """Extremes and spread of a metric whose nulls count as 0, for any groupBy."""
    filled = F.coalesce(F.col(value), F.lit(0))
    return [F.max(filled).alias("_max"), F.min(filled).alias("_min"),
            F.stddev_pop(filled).alias("partition_size_stddev")]


def partition_columns() -> list[Column]:
    """The partition-size columns of a row with these aggregates and ``_med``."""
    mb = 1024.0 * 1024.0
    return [(F.col("_max") / mb).alias("max_partition_size_mb"),
            (F.col("_min") / mb).alias("min_partition_size_mb"),
            (F.col("_med") / mb).alias("median_partition_size_mb"),
            F.col("partition_size_stddev"),
            (F.col("_max") / (F.col("_med") + 1)).alias("partition_skew_ratio")]


def partition_stats(tasks: DataFrame, group_cols, value: str = "shuffle_read_bytes",
                    buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """``agg_partition_stats``: max, min, upper median, population stddev of
    per-task shuffle-read bytes (null counts as 0), in MB, plus max/(median+1).
    All from one histogram; deviations are taken from the exact mean."""
    g = _cols(group_cols)
    h = stacked_histogram(tasks, g, {value: F.coalesce(F.col(value), F.lit(0))}, buckets)
    v, c = F.col("v").cast("double"), F.col("c")
    mean = F.sum(v * c).over(Window.partitionBy("metric", *g)) / F.col("n")
    h = h.withColumn("_square", c * F.pow(v - mean, F.lit(2)))
    spread = Measure({"_max": F.max("v"), "_min": F.min("v"), "_squares": F.sum("_square"), "_n": F.max("n")},
                     {"_max": F.col("_max"), "_min": F.col("_min"),
                      "partition_size_stddev": F.sqrt(F.col("_squares") / F.col("_n"))})
    return summarise(h, g, spread, upper_median_measure("_med")).select(*g, *partition_columns())


def correlation(df: DataFrame, group_cols, x: str, y: str, alias: str = "corr") -> DataFrame:
    """``agg_corr``: Pearson correlation, per group or global."""
    g = _cols(group_cols)
    return df.groupBy(*g).agg(F.corr(x, y).alias(alias))

