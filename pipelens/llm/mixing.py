"""Mixing sources to target weights by Poisson replication (operator 6).

A source of c characters whose target share is s gets the mean repetition rate
``epochs * s * total / c``. A document's uniform number comes from a hash of
seed and id, and the inverse Poisson distribution at that number is its count
of copies: 0 drops it from the mix, 3 repeats it three times. Copies are
exploded and spread by a hash of (seed, id, copy): hash partitioning followed
by a sort within partitions is a global random permutation that every rerun
reproduces.

Only DataFrame functions. Source sizes are one map-side combined aggregate; the
table of rates is broadcast after a check of its row count and otherwise joined
on (source, salt), so that a source with a third of all rows is still split.

Defined results: a null source is a source of its own; a null or empty text
counts no characters; a source without characters keeps rate ``epochs``;
sources without a given weight get weight 0 when weights are given; rows with
one id share their number and so their count; an empty table gives an empty
result. Columns ``copy`` and ``shuffle_key`` are added, and replace input
columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.llm.columns import set_aside
from pipelens.session import scratch_path

SEED, EPOCHS, ALPHA = 20240501, 1.0, 0.5
#: A rate is split into equal parts of at most this mean, each with a number of
#: its own; their sum has the wanted distribution and exp(-mean) stays exact.
PART_MEAN = 64.0
BROADCAST_ROWS, SALTS = 50_000, 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest of the parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def target_rates(docs: DataFrame, weights: dict[str, float] | None, epochs: float, alpha: float,
                 source_col: str, text_col: str) -> DataFrame:
    """(source, rate, parts, cdf): mean repetitions, and the distribution of one part."""
    spark = docs.sparkSession
    path = scratch_path(spark, "mix-sizes")
    (docs.groupBy(F.col(source_col).alias("_source"))
     .agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("double")).alias("_chars"))
     .write.parquet(path))
    sizes = spark.read.parquet(path)
    if weights is None:
        weight = F.pow("_chars", F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for source, w in weights.items():
            weight = F.when(F.col("_source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("_weight", weight)
    total, weighed = sizes.agg(F.sum("_chars"), F.sum("_weight")).first()
    rate = F.when((F.col("_chars") > 0) & F.lit(bool(weighed)),
                  F.lit(epochs) * F.col("_weight") / F.lit(weighed or 1.0) * F.lit(total or 0.0) / F.col("_chars")
                  ).otherwise(F.lit(float(epochs)))
    sizes = sizes.select("_source", rate.alias("_rate"))
    sizes = sizes.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART_MEAN)).cast("int"))
    mean = F.col("_rate") / F.col("_parts")
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int"))
    start = F.struct(F.exp(-mean).alias("term"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k
        return F.struct(term.alias("term"),
                        F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + term)).alias("cdf"))

    return sizes.withColumn("_cdf", F.aggregate(steps, start, step, lambda acc: acc["cdf"]))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = EPOCHS,
                alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """The documents, each repeated by its Poisson count, in a global random
    order. Without ``weights`` a source's target share is proportional to its
    characters to the power ``alpha``; ``epochs`` scales the whole mix."""
    docs, back = set_aside(docs, [id_col, source_col, text_col])
    rates = target_rates(docs, weights, epochs, alpha, source_col, text_col)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    if rates.count() <= BROADCAST_ROWS:
        joined = docs.join(F.broadcast(rates), F.col(source_col).eqNullSafe(F.col("_source")))
    else:
        salt = F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(SALTS)).cast("int")
        copies = rates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("_own", salt).join(
            copies, F.col(source_col).eqNullSafe(F.col("_source")) & (F.col("_own") == F.col("_salt")))
    counts = F.transform(
        F.sequence(F.lit(1), F.col("_parts")),
        lambda j: F.size(F.filter("_cdf", lambda c: c <= uniform(F.lit(str(seed)), ident, j.cast("string")))))
    count = F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    mixed = joined.withColumn("_count", count).where("_count > 0").select(
        *docs.columns, F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("place"), ident,
                                               F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    mixed = mixed.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return back(mixed, without=("copy", "shuffle_key"), plus=("copy", "shuffle_key"))
