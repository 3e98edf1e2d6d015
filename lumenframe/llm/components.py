"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Rounds after which something is wrong: each one at least halves the height of the trees.
MOST_ROUNDS = 60


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of distinct edges either points to one smaller node or is pointed to."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    ends = edges.select(F.explode(F.array(F.struct(high.alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(low.alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the smallest node reachable.

    Nulls and loops are ignored, repeated edges count once, no edges give no rows. Every
    round is written to the shared folder, so a lost executor repeats one round at most.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a != b").distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if _are_stars(edges):
            break
        after = written(_small_star(_large_star(edges)), "edges")
        drop_written(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
