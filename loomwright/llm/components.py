"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomwright.llm.common import discard, durable


def _star(edges: DataFrame) -> DataFrame:
    """One large-star then one small-star round over (a, b); each node's edges move to its least neighbour."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u != v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u")
    small = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(moved.select("u", "m"))
    return small.where("a != b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b: long): the smallest node reachable from it.

    Self-loops and nulls are ignored, repeated edges count once, and no edges give an empty table. Every
    round is written to the shared folder, so that plans stay short and lost executors lose one round at
    most. Only a count and a checksum, taken as a round is written, reach the driver. Rounds grow with the logarithm of the longest path.
    """

    def written(df: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        return durable(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges"), seen.get

    now, mark = written(edges.toDF("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if not mark.get("n"):
            break
        nxt, seen = written(_star(now))
        discard(now)
        now = nxt
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
