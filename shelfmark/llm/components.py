"""Connected components of a graph given as a table of edges, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import drop, written

ROUNDS = 60


def _mark(edges: DataFrame) -> tuple[int, int]:
    found = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0)).alias("h")).first()
    return found.n, found.h


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint), root being the smallest of its component.

    Alternates two steps until nothing changes. Large star: every node links its larger neighbours
    to the smallest node it knows, itself included. Small star: every node links its smaller neighbours
    and itself to the smallest of them. Both keep components as they are, and the number of edges never
    grows, so a node with very many neighbours costs one aggregate and one join. Each round is written
    to the shared folder. Self-links and repeated edges are ignored; rows with a null end too.
    """
    now = written(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = _mark(now)
    for _ in range(ROUNDS):
        if not seen[0]:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        earlier = now
        now = written(small.filter("e.b <> e.m").select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).distinct(), "edges")
        drop(earlier)
        before, seen = seen, _mark(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    nodes = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    roots = now.select(F.col("b").alias("node")).distinct()
    return nodes.unionAll(roots.join(nodes, "node", "left_anti").withColumn("root", F.col("node")))
