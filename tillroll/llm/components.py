"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): root is the smallest id reachable.

    Each round halves the depth of the trees at least; the edges go to the checkpoint
    folder after each round, and only their number and a sum of their hashes come to the
    driver. Loops and repeated links are allowed, null ends are dropped; an empty table
    gives an empty result."""
    edges = checkpointed(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    loops = links.where("a = b").select(F.col("a").alias("id"))
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        edges = checkpointed(_small_star(_large_star(edges)))
    roots = edges.select(F.col("b").alias("id")).union(loops).distinct().join(edges.select(F.col("a").alias("id")), "id", "left_anti")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots.select("id", F.col("id").alias("root")))
