"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.session import materialize, remove_path, scratch_path


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node.

    Alternating large-star and small-star rounds, each a grouped minimum and a written table, so the lineage stays short and
    the number of rounds grows with the logarithm of the longest chain. Loops, repeated and reversed links change nothing;
    null ends are dropped. Only links whose ends differ are carried; a node with none of them isn't returned.
    """
    spark = links.sparkSession
    pairs = links.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("m")).distinct()
    path = scratch_path(spark, "links")
    current = materialize(pairs, path=path)
    before = _digest(current)
    for _ in range(max_rounds if before[0] else 0):
        # large star: every larger neighbour is linked to the node's smallest neighbour or itself
        both = current.select("n", "m").unionByName(current.select(F.col("m").alias("n"), F.col("n").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("n"), F.col("least").alias("m")).distinct()
        # small star: every smaller neighbour, and the node, is linked to the smallest
        least = large.groupBy("n").agg(F.min("m").alias("least"))
        small = large.join(least, "n").select(F.col("m").alias("n"), F.col("least").alias("m")).unionByName(least.select("n", F.col("least").alias("m"))).where("n != m").distinct()
        next_path = scratch_path(spark, "links")
        following = materialize(small, path=next_path)
        after = _digest(following)
        remove_path(spark, path)
        current, path = following, next_path
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    ends = current.select(F.col("n").alias("node"), F.col("m").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())


def _digest(links: DataFrame) -> tuple:
    """Number and two sums of hashes of the (distinct) links; equal for equal sets."""
    part = lambda seed: F.coalesce(F.sum(F.xxhash64("n", "m", F.lit(seed)).cast("decimal(38,0)")), F.lit(0))
    return tuple(links.agg(F.count("*"), part(1), part(2)).first())
