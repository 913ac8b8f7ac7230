"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import drop_written, hot_join, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): label is the least node it reaches.

    A round links each node's larger neighbours to its least one, then each
    node's smaller neighbours to the least of them, until nothing changes; the
    rounds grow with the logarithm of the nodes. Minima are aggregated before
    they are shuffled, and the minimum of a node with very many neighbours is
    broadcast to its edges, so that they do not meet in one task. Each round is
    written to the shared folder, so no round depends on an executor.

    Defined results: an edge of a node with itself, and repeated edges, change
    nothing; nodes whose only edges are with themselves are left out; without
    edges the result is empty. Edges have no nulls.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "edges")
    seen = _sum(now)
    while seen[0]:
        after = written(_small(_large(now)), "edges")
        drop_written(now)
        now, before, seen = after, seen, _sum(after)
        if seen == before:
            break
    stars = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return stars.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")), "least")
    out = hot_join(both, least, ["a"], "n").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    edges = written(edges, "large")
    least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    linked = hot_join(edges, least, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
