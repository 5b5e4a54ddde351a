"""Quality classifier (operator 5): an interpolated modified Kneser-Ney n-gram
model of bytes, trained on trusted text; documents whose perplexity lies above
their language's limit are rejected.

Trusted are documents all of whose labels say quality 1. Half of them, by a
hash of the id and at most ``MAX_TRUSTED``, train the model; the other half,
which it has not seen, sets the limits, so that an unlabelled clean document
passes as often as a trusted one. Tasks count the n-grams of their blocks,
Spark adds them up, and lower orders, context totals and discounts follow by
aggregates and joins of the count tables on (order, context). The finished
tables are laid down in shards as sorted arrays that workers memory-map, so a
document's perplexity is a lookup join inside the scan: joining 700 distinct
n-grams of every document by shuffle would move ten times the text. Thresholds
come from that whole half by a mergeable quantile sketch.

A language's limit is the quantile over its unseen trusted documents from
``MIN_UNSEEN`` of them on. With fewer the logarithm of the limit lies between
that quantile and ``WIDE`` times the larger of it and the quantile over all
languages, nearer to the latter the fewer they are.

Defined results: a null or empty text has only its end to score; a null
language is a language of its own; one that the model was not trained on, or
without an unseen trusted document, has no limit and keeps everything; a
document with labels of both kinds is not trusted; equal rows are judged alike;
an empty table gives an empty result. Columns named in
``ADDED`` replace input columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipelens.llm import arrays
from pipelens.llm import blocks as B
from pipelens.llm.discounts import discounts
from pipelens.session import scratch_path

ORDER, MAX_TRUSTED, QUANTILE, MARGIN = 5, 20_000, 0.995, 1.05
#: A text is judged as if so many bytes of its language's mean stood before it,
#: which keeps short clean texts from passing the limit by chance.
PRIOR_BYTES = 200
#: Least unseen trusted documents for a limit of their own alone, and how wide
#: the limit is where there is almost none.
MIN_UNSEEN, WIDE = 200, 1.5
SHARDS, BROADCAST_ROWS = 13, 50_000
ADDED = ("perplexity", "n_bytes", "smoothed", "threshold", "kept")
_START, _END = 2, 3  # control bytes that stand before and after a text


def _padded(block: B.Block, order: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of a block, the last byte lowest, and each text's first."""
    n, rows = len(block.data), block.rows
    pad = order  # order - 1 starts and one end
    out = np.full(n + pad * rows, _START, np.uint8)
    text = np.repeat(np.arange(rows), np.diff(block.off))
    out[np.arange(n) + pad * text + pad - 1] = block.data
    ends = block.off[1:] + pad * np.arange(1, rows + 1) - 1
    out[ends] = _END
    codes = np.zeros(len(out), np.int64)
    for j in range(order):
        codes[j:] |= out[:len(out) - j].astype(np.int64) << (8 * j)
    predicted = np.ones(len(out), bool)
    for j in range(order - 1):
        predicted[block.off[:-1] + pad * np.arange(rows) + j] = False
    return codes[predicted], block.off[:-1] + np.arange(rows)


class ByteModel:
    """Reads the arrays of a trained model."""

    def __init__(self, root: str, order: int) -> None:
        self.root, self.order = root, order

    def _get(self, kind: str, k: int, keys: np.ndarray, default: float) -> np.ndarray:
        out = np.full(len(keys), default)
        shard = keys % SHARDS
        for s in range(SHARDS):
            own = np.flatnonzero(shard == s)
            at, there = arrays.find(arrays.load(self.root, f"{kind}{k}-{s}-key", "<i8"), keys[own])
            if there.any():
                out[own[there]] = arrays.load(self.root, f"{kind}{k}-{s}-value", "<f8")[at[there]]
        return out

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each n-gram's last byte."""
        p = np.full(len(grams), 1 / 257)
        for k in range(1, self.order + 1):
            own, back = np.unique(grams & ((1 << 8 * k) - 1), return_inverse=True)
            context, of = np.unique(own >> 8, return_inverse=True)
            direct = self._get("gram", k, own, 0.0)
            left = self._get("left", k, context, 1.0)[of]
            p = direct[back] + left[back] * p
        return np.log10(p)


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    return (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id"))
            .agg(F.min(F.coalesce(F.col(label_col), F.lit(0))).alias("_good")).where("_good = 1").select("_id"))


def _trains(ident: str) -> F.Column:
    return F.pmod(F.xxhash64(F.lit("half"), F.col(ident)), F.lit(2)) == 0


def _training_ids(labels: DataFrame, max_trusted: int) -> DataFrame:
    """The trusted documents of the model, at most ``max_trusted``: a bounded broadcast."""
    return trusted_ids(labels).where(_trains("_id")).orderBy(F.xxhash64("_id"), "_id").limit(max_trusted)


def train(docs: DataFrame, labels: DataFrame, max_trusted: int = MAX_TRUSTED, order: int = ORDER,
          id_col: str = "doc_id", text_col: str = "text") -> ByteModel:
    """Count, smooth and lay down the model of the trusted documents."""
    spark = docs.sparkSession
    B.small_batches(spark)
    root = scratch_path(spark, "quality-model")
    chosen = _training_ids(labels, max_trusted)
    texts = (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
             .join(F.broadcast(chosen), "_id", "left_semi").select("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.text_blocks(batch.column(0)):
                grams, counts = np.unique(_padded(block, order)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(counts)], ["gram", "c"])

    (texts.mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
     .write.parquet(f"{root}-top"))
    top = spark.read.parquet(f"{root}-top")
    levels = top.select(F.lit(order).alias("k"), "gram", "c")
    for k in range(order - 1, 0, -1):
        lower = (top.select(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).distinct()
                 .groupBy(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count("*").alias("c")))
        levels = levels.unionByName(lower.select(F.lit(k).alias("k"), "gram", "c"))
    levels.write.parquet(f"{root}-levels")
    levels = spark.read.parquet(f"{root}-levels").withColumn("context", F.shiftright("gram", 8))
    seen = levels.groupBy("k").agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5))).collect()
    by = {r.k: [float(x) for x in discounts(*r[1:])] for r in seen}

    def off(count, i):
        """The discount of order k for a count of i."""
        out = F.lit(0.0)
        for k, d in by.items():
            out = F.when(F.col("k") == k, F.lit(d[i])).otherwise(out)
        return out

    contexts = levels.groupBy("k", "context").agg(
        F.sum("c").alias("total"), *(F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2)),
        F.count_if(F.col("c") > 2).alias("n3"))
    cut = F.when(F.col("c") == 1, off("c", 1)).when(F.col("c") == 2, off("c", 2)).otherwise(off("c", 3))
    grams = levels.join(contexts, ["k", "context"]).select(
        F.concat(F.lit("gram"), F.col("k")).alias("kind"), F.col("gram").alias("key"),
        (F.greatest(F.col("c") - cut, F.lit(0.0)) / F.col("total")).alias("value"))
    left = contexts.select(
        F.concat(F.lit("left"), F.col("k")).alias("kind"), F.col("context").alias("key"),
        ((F.col("n1") * off("n1", 1) + F.col("n2") * off("n2", 2) + F.col("n3") * off("n3", 3))
         / F.col("total")).alias("value"))

    def lay_down(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        for column in ("key", "value"):
            arrays.save(root, f"{key[0].as_py()}-{key[1].as_py()}-{column}", table[column].to_numpy())
        return pa.table({"n": [len(table)]})

    (grams.unionByName(left).groupBy("kind", (F.col("key") % SHARDS).alias("shard"))
     .applyInArrow(lay_down, "n long").agg(F.sum("n")).collect())
    return ByteModel(root, order)


def with_perplexity(docs: DataFrame, model: ByteModel, text_col: str = "text") -> DataFrame:
    """The same rows with their perplexity per byte and number of bytes."""
    kept = [c for c in docs.columns if c not in ADDED]
    docs = docs.select(*kept)
    at = kept.index(text_col)
    B.small_batches(docs.sparkSession)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
            for block in B.text_blocks(batch.column(at)):
                grams, first = _padded(block, model.order)
                own, back = np.unique(grams, return_inverse=True)
                logs = np.add.reduceat(model.log10(own)[back], first)
                sizes.append(np.diff(np.append(first, len(grams))))
                found.append(10.0 ** (-logs / sizes[-1]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(found)), pa.array(np.concatenate(sizes))],
                [*kept, "perplexity", "n_bytes"])

    return docs.mapInArrow(scores, T.StructType([*docs.schema.fields, T.StructField("perplexity", T.DoubleType()),
                                                 T.StructField("n_bytes", T.LongType())]))


def judged(scored: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN,
           id_col: str = "doc_id", lang_col: str = "lang", max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Adds ``threshold`` and ``kept`` to scored rows. ``scored`` is read several
    times: pass a written table. ``max_trusted`` is that of the model."""
    good = (scored.select(F.col(id_col).cast("long").alias("_id"), F.col(lang_col).alias("_lang"), "perplexity",
                          "n_bytes").join(trusted_ids(labels).where(~_trains("_id")), "_id")
            .withColumn("_log", F.log10("perplexity")))
    spark = scored.sparkSession
    overall_mean = good.agg(F.avg("_log")).first()[0]
    by_lang = F.col(lang_col).eqNullSafe(F.col("_lang"))

    def smoothed():
        mean = F.coalesce(F.col("_mean"), F.lit(overall_mean).cast("double"), F.lit(0.0))
        total = F.log10("perplexity") * F.col("n_bytes") + mean * PRIOR_BYTES
        return F.pow(F.lit(10.0), total / (F.col("n_bytes") + PRIOR_BYTES))

    path = scratch_path(spark, "quality-means")
    good.groupBy("_lang").agg(F.avg("_log").alias("_mean")).write.parquet(path)
    means = spark.read.parquet(path)
    small = means.count() <= BROADCAST_ROWS

    def beside(rows: DataFrame, table: DataFrame, on) -> DataFrame:
        """A left join to one row per language, broadcast while that is small."""
        return rows.join(F.broadcast(table) if small else table, on, "left")

    rated = beside(good, means.withColumnRenamed("_lang", "_of"), F.col("_lang").eqNullSafe(F.col("_of"))).select(
        "_id", "_lang", smoothed().alias("_rated"))
    limit = (F.percentile_approx("_rated", quantile, 10_000) * margin).alias("_limit")
    overall = F.lit(rated.agg(limit).first()[0]).cast("double")
    known = (scored.select(F.col(id_col).cast("long").alias("_id"), F.col(lang_col).alias("_known"))
             .join(F.broadcast(_training_ids(labels, max_trusted)), "_id", "left_semi").select("_known").distinct())
    wide = F.greatest("_limit", overall) * WIDE
    trust = F.least(F.col("_n") / MIN_UNSEEN, F.lit(1.0))
    path = scratch_path(spark, "quality-limits")
    (rated.groupBy("_lang").agg(limit, F.count_distinct("_id").alias("_n"))
     .join(known, F.col("_lang").eqNullSafe(F.col("_known")), "left_semi")
     .withColumn("_limit", F.when(trust >= 1, F.col("_limit")).otherwise(F.pow("_limit", trust) * F.pow(wide, 1 - trust)))
     .drop("_n").join(means.withColumnRenamed("_lang", "_of"), F.col("_lang").eqNullSafe(F.col("_of"))).drop("_of")
     .write.parquet(path))
    return beside(scored, spark.read.parquet(path), by_lang).withColumns(
        {"smoothed": smoothed(), "threshold": F.col("_limit"),
         "kept": F.coalesce(smoothed() <= F.col("_limit"), F.lit(True))}).drop("_lang", "_limit", "_mean", "n_bytes")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Every document with its perplexity, threshold and verdict."""
    model = train(docs, labels, **options)
    path = scratch_path(docs.sparkSession, "quality-scores")
    with_perplexity(docs, model).write.parquet(path)
    return judged(docs.sparkSession.read.parquet(path), labels, max_trusted=options.get("max_trusted", MAX_TRUSTED))


def verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document without its text."""
    model = train(docs, labels, **options)
    path = scratch_path(docs.sparkSession, "quality-scores")
    with_perplexity(docs.select("doc_id", "lang", "text"), model).drop("text").write.parquet(path)
    return judged(docs.sparkSession.read.parquet(path), labels, max_trusted=options.get("max_trusted", MAX_TRUSTED))
