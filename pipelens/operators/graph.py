"""Iterative graph operators: reachability, longest path, upstream trace.

Every round is a join + aggregate over what the round before found or left
open, written to Parquet under the session's ``spark.checkpoint.dir`` and read
back. That cuts the plan lineage each round (so plans stay small and a lost
executor only re-runs the current round) and sidesteps the constraint-propagation
failure that ``localCheckpoint`` of a growing union hits in Spark 4.1. Only row counts reach
the driver, for loop control, and the job that writes a round collects them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pipelens.session import scratch_path

# a written round of at most this many rows is broadcast to the next one's joins
BROADCAST_ROWS = 100_000


def materialize(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write ``df`` to Parquet at ``path`` and return a fresh scan of it."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def materialize_observed(df: DataFrame, path: str, **aggregates: Column) -> tuple[DataFrame, dict[str, int]]:
    """Write ``df`` and return a scan of it with aggregates over its rows that
    the same job collects."""
    seen = Observation()
    written = materialize(df.observe(seen, *[a.alias(k) for k, a in aggregates.items()]), path)
    return written, seen.get


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a join side that is never broadcast. Written tables of names are a
    tenth of their rows in memory, so the size of their files, by which Spark plans
    a broadcast, says little about what the driver would have to hold."""
    return df.hint("merge")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a join side: broadcast if it has few rows, else shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else shuffled(df)


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def reach(edges: DataFrame, src_cols, dst_cols, name: str = "reach",
          starts: DataFrame | None = None) -> DataFrame:
    """All (start, reached) pairs of the transitive closure of ``edges``.

    ``edges`` holds one row per directed edge, the source node in ``src_cols``
    and the target node in ``dst_cols`` (same arity). Output columns:
    ``start_<src col>`` for the start node, ``src_cols`` names for the
    reached node, and ``hops`` (shortest distance, >= 1). ``starts``
    (columns ``src_cols``) restricts the start nodes.

    Semi-naive path doubling: with R the pairs known so far and D those found
    in the last round, the next round finds (D.R u R.D) minus R. A pair whose
    shortest path has length L appears in round ceil(log2 L) + 1, so a graph
    of depth d needs about log2(d) + 2 rounds instead of d. Seen pairs are
    removed with a left-anti join, so cycles terminate. Hop counts are the
    minimum over the compositions of a round, which is the shortest distance.
    With ``starts`` the frontier only grows forward (D.E), as doubling would
    need the pairs of every node.
    """
    spark = _spark(edges)
    src_cols, dst_cols = list(src_cols), list(dst_cols)
    k = len(src_cols)
    a = [f"_a{i}" for i in range(k)]
    b = [f"_b{i}" for i in range(k)]
    s = [f"_s{i}" for i in range(k)]
    m = [f"_m{i}" for i in range(k)]
    e = edges.select(*[F.col(c).alias(x) for c, x in zip(src_cols, a)],
                     *[F.col(c).alias(x) for c, x in zip(dst_cols, b)]).distinct()
    root = scratch_path(spark, name)
    e = materialize(e, os.path.join(root, "edges"))
    seen_root = os.path.join(root, "seen")
    first, count = e, F.count(F.lit(1))
    if starts is not None:
        first = e.join(shuffled(starts.select(*[F.col(c).alias(x) for c, x in zip(src_cols, a)]).distinct()),
                       on=a, how="left_semi")
    # pair layout: start _s*, reached _a*, hops
    delta, told = materialize_observed(first.select(*[F.col(x).alias(y) for x, y in zip(a, s)],
                                     *[F.col(x).alias(y) for x, y in zip(b, a)],
                                     F.lit(1).alias("hops")).distinct(),
                        os.path.join(seen_root, "round=1"), rows=count)
    rounds, total = 1, told["rows"]
    while True:
        rows = told["rows"]
        rounds += 1
        known = spark.read.parquet(seen_root).drop("round")
        if starts is None:
            # D . R : start -> mid (delta), mid -> end (known)
            left = delta.select(*s, *[F.col(x).alias(y) for x, y in zip(a, m)],
                                F.col("hops").alias("_h1"))
            right = known.select(*[F.col(x).alias(y) for x, y in zip(s, m)], *a,
                                 F.col("hops").alias("_h2"))
            dr = sized(left, rows).join(right, on=m).select(*s, *a, (F.col("_h1") + F.col("_h2")).alias("hops"))
            # R . D
            left2 = known.select(*s, *[F.col(x).alias(y) for x, y in zip(a, m)],
                                 F.col("hops").alias("_h1"))
            right2 = delta.select(*[F.col(x).alias(y) for x, y in zip(s, m)], *a,
                                  F.col("hops").alias("_h2"))
            rd = left2.join(sized(right2, rows), on=m).select(*s, *a, (F.col("_h1") + F.col("_h2")).alias("hops"))
            cand = dr.unionByName(rd)
        else:
            step = e.select(*[F.col(x).alias(y) for x, y in zip(a, m)], *[F.col(x).alias(y)
                                                                        for x, y in zip(b, a)])
            cand = (sized(delta.select(*s, *[F.col(x).alias(y) for x, y in zip(a, m)], "hops"), rows)
                    .join(step, on=m).select(*s, *a, (F.col("hops") + 1).alias("hops")))
        new = (cand.groupBy(*s, *a).agg(F.min("hops").alias("hops"))
               .join(sized(known.select(*s, *a), total), on=s + a, how="left_anti"))
        delta, told = materialize_observed(new, os.path.join(seen_root, f"round={rounds}"), rows=count)
        total += told["rows"]
        if not told["rows"]:
            break
    out = spark.read.parquet(seen_root)
    return out.select(*[F.col(x).alias(f"start_{c}") for x, c in zip(s, src_cols)],
                      *[F.col(x).alias(c) for x, c in zip(a, src_cols)],
                      F.col("hops").cast("int").alias("hops"))


def terminals(edges: DataFrame, src_cols, dst_cols, name: str = "terminals") -> DataFrame:
    """(start, terminal) for every node and every node without outgoing edges
    that it reaches. Columns: ``start_<src col>`` and the ``src_cols`` names
    for the terminal.

    A node with one outgoing edge has the terminals of its successor, so chains
    of such nodes are condensed first: each takes the end of its chain by pointer
    jumping, in about log2 of the longest chain rounds; those that never leave
    their chain (cycles) have no terminal. Between the nodes that branch, pairs
    (node, terminal) are then pushed level by level against the edges: a round
    joins the edges with the pairs new in the round before and writes only pairs
    not known yet, so no round is larger than the result, and cycles end there.
    """
    spark = _spark(edges)
    src_cols, dst_cols = list(src_cols), list(dst_cols)
    k = range(len(src_cols))
    s, t, m = ([f"_{x}{i}" for i in k] for x in "stm")
    root = scratch_path(spark, name)

    def renamed(df, old, new, *more):
        return df.select(*[F.col(c).alias(x) for c, x in zip(old, new)], *more)

    def hint(rows: int):
        return lambda df: sized(df, rows)

    e, told = materialize_observed(
        edges.select(*[F.col(c).alias(x) for c, x in zip(src_cols, s)],
                     *[F.col(c).alias(x) for c, x in zip(dst_cols, t)]).distinct(),
        os.path.join(root, "edges"), rows=F.count(F.lit(1)))
    small = hint(told["rows"])
    degree = e.groupBy(*s).agg(F.count(F.lit(1)).alias("_n"), *[F.min(c).alias(c) for c in t])
    single = degree.where("_n = 1").drop("_n")

    # chains: (s, t, _open); t moves on while it is a node with one edge itself
    chain_root = os.path.join(root, "chains")
    again = renamed(single, s, t, F.lit(True).alias("_open"))
    now, told = materialize_observed(
        single.join(small(again), t, "left").select(*s, *t, F.coalesce("_open", F.lit(False)).alias("_open")),
        os.path.join(chain_root, "round=0"), rows=F.count(F.lit(1)), left=F.count_if("_open"))
    chained, left, r = told["rows"], told["left"], 0
    while left:
        r += 1
        known = spark.read.parquet(chain_root).where("NOT _open").drop("round").unionByName(now.where("_open"))
        step = renamed(known, s + t, t + m, F.col("_open").alias("_more"))
        now, told = materialize_observed(
            now.where("_open").select(*s, *t).join(hint(chained)(step), t).select(
                *s, *[F.col(x).alias(y) for x, y in zip(m, t)], F.col("_more").alias("_open")),
            os.path.join(chain_root, f"round={r}"), left=F.count_if("_open"))
        if told["left"] == left:
            break  # only cycles are left
        left = told["left"]
    ends = spark.read.parquet(chain_root).where("NOT _open").select(*s, *t)
    single = spark.read.parquet(os.path.join(chain_root, "round=0")).select(*s)
    inner = hint(chained)

    # edges of the nodes that branch, chains replaced by their ends
    branching = e.join(inner(single), s, "left_anti")
    moved = branching.join(inner(renamed(single, s, t, F.lit(True).alias("_chain"))), t, "left").join(
        inner(renamed(ends, s + t, t + m, F.lit(True).alias("_ends"))), t, "left").where(
        F.col("_chain").isNull() | F.col("_ends"))
    core, told = materialize_observed(
        moved.select(*s, *[F.when(F.col("_ends"), F.col(x)).otherwise(F.col(y)).alias(y) for x, y in zip(m, t)]).distinct(),
        os.path.join(root, "core"), rows=F.count(F.lit(1)))
    nodes = renamed(core, s, t, F.lit(True).alias("_node")).distinct()
    # a branching node may have lost all edges to cycles: e tells which nodes end
    sources = renamed(e, s, t, F.lit(True).alias("_source")).distinct()
    found_root = os.path.join(root, "found")
    new, told_new = materialize_observed(
        core.join(small(sources), t, "left_anti").select(*s, *t), os.path.join(found_root, "round=0"), rows=F.count(F.lit(1)))
    # written: every round reads the edges between them
    steps, told = materialize_observed(
        core.join(hint(told["rows"])(nodes), t, "left_semi").select(*s, *[F.col(x).alias(y) for x, y in zip(t, m)]),
        os.path.join(root, "steps"), rows=F.count(F.lit(1)))
    r, rows = 0, told_new["rows"]
    total = rows
    while rows:
        r += 1
        known, among = spark.read.parquet(found_root).drop("round"), total
        last = renamed(new, s + t, m + t)
        pushed = hint(told["rows"])(steps).join(last, m) if told["rows"] <= rows else steps.join(hint(rows)(last), m)
        pushed = pushed.select(*s, *t).distinct()
        if rows <= BROADCAST_ROWS < total:
            # few pairs against many known ones: counted, they pick those they meet without a shuffle
            pushed, told_pushed = materialize_observed(pushed, os.path.join(root, "pushed", f"round={r}"), rows=F.count(F.lit(1)))
            if told_pushed["rows"] <= BROADCAST_ROWS:
                known, among = known.join(F.broadcast(pushed), s + t, "left_semi"), told_pushed["rows"]
        new, told_new = materialize_observed(
            pushed.join(hint(among)(known), s + t, "left_anti"),
            os.path.join(found_root, f"round={r}"), rows=F.count(F.lit(1)))
        rows = told_new["rows"]
        total += rows
    found = spark.read.parquet(found_root).drop("round")
    direct = ends.join(small(sources), t, "left_anti").select(*s, *t)
    through = renamed(ends, s + t, s + m).join(hint(total)(renamed(found, s + t, m + t)), m).select(*s, *t)
    # written: the result is often read several times
    return materialize(found.unionByName(direct).unionByName(through).select(
        *[F.col(x).alias(f"start_{c}") for x, c in zip(s, src_cols)], *[F.col(x).alias(c) for x, c in zip(t, src_cols)]),
        os.path.join(root, "terminals"))


def longest_path(vertices: DataFrame, key_cols, vertex: str = "stage_id",
                 weight: str = "stage_time", parents: str = "parents",
                 name: str = "longest_path") -> DataFrame:
    """``graph_critical_path`` per vertex: d(v) = w(v) + max over parents d(p).

    ``vertices`` has one row per (key..., vertex) with its weight and an
    array of parent vertex ids. A parent without a row counts as 0 (a skipped
    stage never completes). Returns (key..., vertex, path_time).

    Vertices are peeled off as their parents become known, and only edges that
    are still open are touched. A row (v, p, x) says d(v) >= x + d(p); without
    ``p``, d(v) >= x. A vertex whose rows all lack ``p`` is done and leaves.
    In a round every open edge takes over the rows of its parent if that is
    done or has one open parent itself, so chains of single parents shrink to
    half their length, a chain of n stages takes about log2 n rounds, and other
    parts one round per level that branches. An acyclic rest always has a vertex
    whose parents are done; a round without one means a cycle -> error.
    """
    spark = _spark(vertices)
    g = list(key_cols)
    own = vertices.select(*g, F.col(vertex).alias("_v"), F.coalesce(F.col(weight), F.lit(0)).cast("long").alias("_x"),
                          F.col(parents).alias("_ps"))
    root = scratch_path(spark, name)
    own = materialize(own, os.path.join(root, "vertices"))
    listed = own.select(*g, "_v", "_x", F.explode_outer(F.array_distinct(F.filter(
        "_ps", lambda p: p != F.col("_v")))).alias("_p"))
    known = own.select(*g, F.col("_v").alias("_p"), F.lit(True).alias("_known")).distinct()
    rows = listed.join(known, g + ["_p"], "left").select(
        *g, "_v", F.when(F.col("_known"), F.col("_p")).alias("_p"), "_x")

    def counted(rows: DataFrame) -> DataFrame:
        """One row per (vertex, parent), with the vertex's number of open
        parents and what it has settled so far."""
        best = rows.repartition(*g, "_v").groupBy(*g, "_v", "_p").agg(F.max("_x").alias("_x"))
        of_vertex = Window.partitionBy(*g, "_v")
        return best.withColumns({"_open": F.count("_p").over(of_vertex),
                                 "_s": F.max(F.when(F.col("_p").isNull(), F.col("_x"))).over(of_vertex)})

    def row(p, x):
        return F.struct(p.alias("_p"), x.alias("_x"))

    no_parent = F.lit(None).cast(own.schema["_v"].dataType)
    r = 0
    while True:
        now, told = materialize_observed(
            counted(rows), os.path.join(root, "rounds", f"round={r}"), size=F.count(F.lit(1)),
            left=F.count("_p"), done=F.count_if(F.col("_open") == 0))
        if not told["left"]:
            break
        if not told["done"]:
            raise RuntimeError(f"{name}: stage graph has a cycle")
        small = F.broadcast if told["size"] <= BROADCAST_ROWS else (lambda df: df)
        ended = small(now.where(F.col("_open") == 0).select(*g, F.col("_v").alias("_p")))
        # one open parent, which is not done either (else the vertex is done next)
        single = now.where((F.col("_open") == 1) & F.col("_p").isNotNull()).join(ended, g + ["_p"], "left_anti")
        taken = single.unionByName(now.where(F.col("_open") == 0).withColumn("_s", F.lit(None).cast("long"))).select(
            *g, F.col("_v").alias("_p"), F.col("_p").alias("_q"), F.col("_x").alias("_add"), "_s", F.lit(True).alias("_hit"))
        moved = now.where(F.col("_p").isNotNull()).drop("_open", "_s").join(small(taken), g + ["_p"], "left")
        over = row(F.col("_q"), F.col("_x") + F.col("_add"))
        moved = moved.select(*g, "_v", F.inline(
            F.when(F.col("_hit").isNull(), F.array(row(F.col("_p"), F.col("_x"))))
            .when(F.col("_s").isNull(), F.array(over))
            .otherwise(F.array(over, row(no_parent, F.col("_x") + F.col("_s"))))))
        settled = now.where(F.col("_p").isNull() & (F.col("_open") > 0)).drop("_open", "_s")
        rows, r = moved.unionByName(settled), r + 1
    return (spark.read.parquet(os.path.join(root, "rounds")).where(F.col("_open") == 0)
            .select(*g, F.col("_v").alias(vertex), F.col("_x").alias("path_time")))


def critical_path_time(path: DataFrame, key_cols) -> DataFrame:
    """Answer per key: the longest path over all vertices."""
    g = list(key_cols)
    return path.groupBy(*g).agg(F.max("path_time").alias("critical_path_stage_time"))


def upstream(edges: DataFrame, seeds: DataFrame, source: str = "source",
             target: str = "target", name: str = "upstream") -> tuple[DataFrame, DataFrame]:
    """``graph_upstream``: every node and edge upstream of the seed nodes.

    ``seeds`` has one column ``id``. Returns (nodes(id), edges) where edges are
    all edges whose target is the seed or an upstream node.
    """
    rev = edges.select(F.col(target).alias("_from"), F.col(source).alias("_to")).distinct()
    seed_ids = seeds.select(F.col("id")).distinct()
    pairs = reach(rev, ["_from"], ["_to"], name=name,
                  starts=seed_ids.select(F.col("id").alias("_from")))
    nodes = pairs.select(F.col("_from").alias("id")).union(seed_ids).distinct()
    rel_edges = edges.join(nodes.select(F.col("id").alias(target)), on=target, how="left_semi")
    return nodes, rel_edges
