"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is one grouped aggregate and one join on node ids; a group is only ever reduced to its smallest neighbour, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node links its larger neighbours to the smallest of its neighbourhood; small star: its smaller
    ones and itself. A large star makes no more edges than it takes."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        out = linked.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    out = out.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return out if large else out.distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node has one edge down at most, and none that is pointed at has any."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("root").alias("root")).where("down + root > 1").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for each node that has an edge; ``root`` is the smallest node of its component. ``edges``: ``a, b``, any order."""
    now = store.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    for _ in range(rounds):
        if _settled(now):
            break
        now = store.keep(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
