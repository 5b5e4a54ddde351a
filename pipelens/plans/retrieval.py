"""Vector retrieval over embedding tables (section 2.13).

Exact cosine top-k without ranking all candidates of a query in one task:
candidates are salted by ``vec_id`` into ``salt`` buckets, each bucket keeps
its own top k (a window over 1/salt of the rows), and the final top k is
taken from the at most ``salt * k`` survivors per query. The query set is
joined by an equi-key (or a checked broadcast); scores are plain Column
arithmetic over the float arrays (``zip_with`` + ``aggregate``) in double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelens.operators.rules import checked_broadcast

DEFAULT_SALT = 16


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def top_k(scored: DataFrame, query_cols, k: int, score: str = "score",
          tie: str = "vec_id", salt: int = DEFAULT_SALT) -> DataFrame:
    """Exact top ``k`` rows by ``score`` (desc, ``tie`` asc) per query, in two
    salted stages. Adds ``rank`` (1..k)."""
    q = list(query_cols)
    s = scored.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salt)))
    w1 = Window.partitionBy(*q, "_salt").orderBy(F.col(score).desc(), F.col(tie).asc())
    local = s.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*q).orderBy(F.col(score).desc(), F.col(tie).asc())
    return local.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k)


def query_vectors(emb: DataFrame) -> DataFrame:
    """One query per label: the vector with the lowest ``vec_id``."""
    return emb.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q_embedding"),
                                    F.min("vec_id").alias("query_id"))


def vector_topk(emb: DataFrame, queries: DataFrame, k: int = 5,
                salt: int = DEFAULT_SALT) -> DataFrame:
    """``ret_vector_topk``: the k nearest vectors (cosine) to every query over
    the whole table. The query side is small by construction and its size is
    checked before it is broadcast."""
    # every vector is scored against every query (Q x N is the work of exact
    # kNN); Q is one vector per label, broadcast only after its size check
    qv = checked_broadcast(queries.select("query_id", "q_embedding"))
    scored = emb.join(qv, F.lit(True))
    scored = scored.select("query_id", "vec_id", "label",
                           cosine("embedding", "q_embedding").alias("score"))
    return top_k(scored, ["query_id"], k, salt=salt)


def metadata_filter_topk(emb: DataFrame, queries: DataFrame, k: int = 5,
                         salt: int = DEFAULT_SALT, where: Column | None = None) -> DataFrame:
    """``ret_metadata_filter``: restrict candidates by metadata before scoring:
    by ``where`` over the vector's columns, and to the query's own label (an
    equi-join on label, no query x vector product)."""
    emb = emb if where is None else emb.where(where)
    scored = emb.join(checked_broadcast(queries), "label").select(
        "query_id", "vec_id", "label", cosine("embedding", "q_embedding").alias("score"))
    return top_k(scored, ["query_id"], k, salt=salt)


def hybrid_topk(emb: DataFrame, queries: DataFrame, edges: DataFrame, k: int = 5,
                bonus: float = 0.5, salt: int = DEFAULT_SALT) -> DataFrame:
    """``ret_hybrid``: candidates are the vectors of the query's label and the
    graph neighbours of the query vector, whatever their label (``edges``:
    src, dst, either direction); score = cosine, plus ``bonus`` for neighbours;
    top k."""
    nb = edges.select(F.col("src").alias("query_id"), F.col("dst").alias("vec_id")).unionByName(
        edges.select(F.col("dst").alias("query_id"), F.col("src").alias("vec_id"))).distinct() \
        .withColumn("_nb", F.lit(True))
    q = checked_broadcast(queries)
    same = emb.join(q, "label").join(nb, ["query_id", "vec_id"], "left")
    other = (nb.join(emb, "vec_id").join(q.withColumnRenamed("label", "_ql"), "query_id")
             .where(~F.col("label").eqNullSafe(F.col("_ql"))))
    columns = ["query_id", "vec_id", "label", "embedding", "q_embedding", "_nb"]
    scored = (same.select(*columns).unionByName(other.select(*columns))
              .select("query_id", "vec_id", "label", cosine("embedding", "q_embedding").alias("cos"), "_nb")
              .withColumn("score", F.col("cos") + F.when(F.col("_nb"), F.lit(bonus)).otherwise(0.0))
              .drop("_nb"))
    return top_k(scored, ["query_id"], k, salt=salt)
