"""Connected components by alternating large-star and small-star rounds.

A round hangs every node's larger neighbours on the smallest node it knows
(large star), then joins that node's smaller neighbours in the same way (small
star). Links shrink to stars around the smallest ids in a number of rounds that
grows with the logarithm of the longest path. A node's neighbours meet by a
map-side combined minimum and a join that adaptive execution can split; no
group is gathered. Every round is a written table, and one row of sums tells
whether it changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.session import scratch_path


def _stars(links: DataFrame) -> DataFrame:
    """Links (a, b), a > b, after one large and one small star."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(
        F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
                  ).alias("x")).select("x.*").where("a > b")
    return small.distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id that occurs in ``links(a, b)``; a component
    is its smallest id. Loops and repeated links do no harm."""
    spark = links.sparkSession

    def written(rows: DataFrame) -> tuple[DataFrame, tuple]:
        path = scratch_path(spark, "stars")
        rows.write.parquet(path)
        rows = spark.read.parquet(path)
        told = rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return rows, tuple(told)

    now, told = written(links.where("a != b").select(
        F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    while told[0]:
        now, after = written(_stars(now))
        if after == told:
            break
        told = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
