"""Embedding near-dedup by cross-polytope hashing (operator 2).

A table turns every vector by pseudo-random fast Hadamard rotations (sign
flips and a Walsh-Hadamard transform, three times) and names the nearest vertex
of the cross-polytope: the coordinate of largest size and its sign. Two such
vertices make a bucket. Multiprobe: a vector stands in the buckets of its best
``PROBES`` vertex pairs, by how little their coordinates fall short.

Equal vectors are one representative with a multiplicity. Representatives that
share a bucket meet in blocks: a bucket of n rows is cut into blocks of at most
``BLOCK`` rows and every pair of blocks is a task group of its own, so a hot
bucket is split and its pairs are verified by matrix products without being
emitted. A pair that meets in several buckets counts in the smallest one they
share. What leaves a block is one count per vector and a spanning forest of
its links; connected components follow from those.

Cosines are computed in double precision. Defined results: vectors that are
null, empty or zero, or hold null or non-finite components, link with nothing;
vectors of different length do not link; rows with equal id and vector are one
vector, given once; of rows with one id and different vectors each is given,
with the sums of the id; rows with a null id are given without links; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm.components import components
from pipelens.session import scratch_path

THRESHOLD, TABLES, PROBES, BLOCK, SEED = 0.95, 6, 3, 1024, 7


@lru_cache(maxsize=8)
def _flips(dimension: int, table: int, half: int) -> np.ndarray:
    """Signs of the three rotations of one of a table's two vertices."""
    rng = np.random.default_rng([SEED, dimension, table, half])
    return rng.choice([-1.0, 1.0], (3, dimension))


def rotate(x: np.ndarray, table: int, half: int) -> np.ndarray:
    """Rows of ``x`` turned; their length must be a power of two."""
    d = x.shape[1]
    for flip in _flips(d, table, half):
        x = x * flip
        step = 1
        while step < d:
            x = x.reshape(len(x), d // (2 * step), 2, step)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(-1, d)
            step *= 2
        x = x / np.sqrt(d)
    return x


def bucket_keys(x: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """For unit vectors, an array (rows, tables * probes) of bucket keys."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, wide - d)))
    out = np.empty((n, tables * probes), np.int64)
    row, few = np.arange(n)[:, None], min(probes, wide)
    for t in range(tables):
        vertex, short = [], []
        for half in range(2):
            y = rotate(x, t, half)
            best = np.argsort(-np.abs(y), 1, kind="stable")[:, :few]
            value = y[row, best]
            vertex.append(2 * best + (value < 0))
            short.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        # pairs of vertices, nearest first; few * few of them hold the best `probes`
        cost = (short[0][:, :, None] + short[1][:, None, :]).reshape(n, -1)
        pick = np.argsort(cost, 1, kind="stable")[:, :probes]
        code = (vertex[0][:, :, None] * (2 * wide) + vertex[1][:, None, :]).reshape(n, -1)
        code = code[row, pick]
        if code.shape[1] < probes:
            code = np.pad(code, ((0, 0), (0, probes - code.shape[1])), "edge")
        out[:, t * probes:(t + 1) * probes] = ((code * tables + t) << 16) | (d & 0xFFFF)
    return out


def valid(vector) -> F.Column:
    """Neither null, empty, zero, nor with null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array, width: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each vector length that occurs."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    start = np.append(0, np.cumsum(width))
    out = []
    for d in np.unique(width):
        rows = np.flatnonzero(width == d)
        x = flat[start[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
        out.append((rows, x / np.sqrt((x * x).sum(1, keepdims=True))))
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        width = batch.column(1).value_lengths().to_numpy()
        keys = np.empty((batch.num_rows, TABLES * PROBES), np.int64)
        for rows, x in _unit(batch.column(1), width):
            keys[rows] = bucket_keys(x)
        keys.sort(1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(
                pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.reshape(-1)))],
            ["rep", "keys"])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node linked to each of n nodes, by the links a-b."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (before == label).all():
            break
    return label


def _verified(threshold: float):
    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Counts and a spanning forest of one pair of blocks of a bucket."""
        bucket, one, other = (k.as_py() for k in key)
        table = table.combine_chunks()
        ids, block = table["rep"].to_numpy(), table["block"].to_numpy()
        times = table["times"].to_numpy()
        vectors = table["vector"].combine_chunks()
        ((_, x),) = _unit(vectors, vectors.value_lengths().to_numpy())
        keys = np.stack(table["keys"].to_numpy())
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == other)
        a, b = np.nonzero(x[left] @ x[right].T >= threshold)
        a, b = left[a], right[b]
        if one == other:
            a, b = a[a < b], b[a < b]
        shared = np.full(len(a), np.iinfo(np.int64).max)
        for column in range(keys.shape[1]):
            own = keys[a, column]
            there = (keys[b] == own[:, None]).any(1)
            np.minimum(shared, np.where(there, own, shared), out=shared)
        links = np.zeros(len(ids), np.int64)
        first = shared == bucket
        np.add.at(links, a[first], times[b[first]])
        np.add.at(links, b[first], times[a[first]])
        root = _forest(len(ids), a, b)
        told = (links > 0) | (root != np.arange(len(ids)))
        return pa.table({"rep": ids[told], "links": links[told], "to": ids[root[told]]})

    return meet


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """One row per vector: its number of links, its component, and whether it
    is the component's smallest id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).distinct()
    fine = rows.where(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    path = scratch_path(spark, "vectors")
    (fine.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"))
     .write.parquet(f"{path}-reps"))
    reps = spark.read.parquet(f"{path}-reps")
    reps.select("rep", "vector").mapInArrow(_hashed, "rep long, keys array<long>").write.parquet(f"{path}-keys")
    keyed = spark.read.parquet(f"{path}-keys")
    stands = keyed.select("rep", F.explode(F.array_distinct("keys")).alias("bucket"))
    sizes = stands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = (stands.join(sizes, "bucket").select("rep", "bucket", blocks.alias("blocks"))
           .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
           .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("rep", "bucket", "block", F.least("block", "with").alias("one"),
                   F.greatest("block", "with").alias("other")))
    (met.join(reps, "rep").join(keyed, "rep").select("rep", "times", "vector", "keys", "bucket", "block", "one", "other")
     .groupBy("bucket", "one", "other").applyInArrow(_verified(threshold), "rep long, links long, to long")
     .write.parquet(f"{path}-met"))
    found = spark.read.parquet(f"{path}-met")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # an id can hold several vectors: its representatives are then one node
    same = (fine.join(reps.select("vector", "rep", "times"), "vector").select("vec_id", "rep", "times"))
    joined = same.where("vec_id != rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    group = components(found.where("rep != to").select(F.col("rep").alias("a"), F.col("to").alias("b")).unionByName(joined))
    linked = (same.join(counts, "rep", "left").groupBy("vec_id")
              .agg(F.sum(F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
              .join(group.withColumnRenamed("id", "vec_id"), "vec_id", "left"))
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id").join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
