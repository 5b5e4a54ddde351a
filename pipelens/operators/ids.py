"""Sequential numbering per group without a single-partition window.

``sequence_number`` gives 1, 2, 3, ... per group in ``order_col`` order (the
``win_sequential_id`` operators). A plain ``row_number()`` over the group
would put a hot group -- say a third of all rows -- into one task. Instead:

1. per group, ``approx_percentile`` of the order column gives split points;
2. ``bucket`` = number of split points below the row's order value;
3. ``row_number`` runs inside (group, bucket);
4. each bucket's offset is a running sum over the tiny (group, bucket) counts.

The result equals ``row_number() OVER (PARTITION BY group ORDER BY order)``
whenever the order column is unique within the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipelens.operators.stats import _with_buckets

DEFAULT_BUCKETS = 64
# groups with more rows than this are split into buckets
SPLIT_MIN = 1_000_000


def sequence_number(df: DataFrame, group_cols, order_col: str, out: str = "seq",
                    buckets: int = DEFAULT_BUCKETS, split_min: int = SPLIT_MIN) -> DataFrame:
    g = list(group_cols)
    if buckets <= 1:
        w = Window.partitionBy(*g).orderBy(order_col)
        return df.withColumn(out, F.row_number().over(w))
    # only groups above split_min rows are split (see stats._with_buckets)
    d = _with_buckets(df, g, order_col, buckets, split_min, out="_bk")
    counts = d.groupBy(*g, "_bk").agg(F.count(F.lit(1)).alias("_cnt"))
    w_before = Window.partitionBy(*g).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*g, "_bk", F.coalesce(F.sum("_cnt").over(w_before), F.lit(0))
                            .alias("_off"))
    w_in = Window.partitionBy(*g, "_bk").orderBy(order_col)
    d = d.withColumn("_rn", F.row_number().over(w_in))
    d = d.join(offsets, on=g + ["_bk"], how="inner")
    return d.withColumn(out, (F.col("_off") + F.col("_rn")).cast("long")).drop("_bk", "_rn", "_off")
