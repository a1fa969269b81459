"""Connected components of keys that rows share, without gathering any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import stored

ROUNDS = 100


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of ``edges`` (a, b: bigint); ``root`` is the least node it is connected with.

    Every node is tied to the least node near it, first those above it, then those below, until each has one tie and that is
    to a node without one above it. Distances halve, so the rounds grow with the logarithm of the longest path; edges never
    become more, and each round is stored.
    """
    ties = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct(), "ties")
    for _ in range(ROUNDS):
        near = ties.unionAll(ties.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = near.groupBy(F.col("high").alias("node")).agg(F.least(F.col("node"), F.min("low")).alias("to"))
        # the larger neighbours of each node go to the least it knows
        lifted = near.filter("low > high").join(least, F.col("high") == F.col("node")).select(F.col("low").alias("high"), F.col("to").alias("low"))
        lifted = lifted.unionAll(least.filter("node <> to").select(F.col("node").alias("high"), F.col("to").alias("low"))).distinct()
        # so do the smaller ones
        low = lifted.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("to"))
        moved = lifted.join(low, F.col("high") == F.col("node")).filter("low <> to").select(F.col("low").alias("high"), F.col("to").alias("low"))
        now = stored(moved.unionAll(low.select(F.col("node").alias("high"), F.col("to").alias("low"))).distinct(), "ties")
        loose = now.select("low").distinct().join(now.select(F.col("high").alias("low")), "low", "left_semi")
        several = now.groupBy("high").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        ties = now
        if loose.isEmpty() and several.isEmpty():
            roots = ties.select(F.col("low").alias("node")).distinct().withColumn("root", F.col("node"))
            return ties.select(F.col("high").alias("node"), F.col("low").alias("root")).unionAll(roots)
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
