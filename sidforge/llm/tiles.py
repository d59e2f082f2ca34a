"""Cutting long groups into tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sides(posted: DataFrame, key: str, long: dict, by: str) -> DataFrame:
    kind = posted.schema[key].dataType.simpleString()
    # one row per long group: as many as (rows / rows of a tile) at most
    counts = posted.sparkSession.createDataFrame(sorted(long.items()), f"`{key}` {kind}, tiles int")
    tiled = posted.join(F.broadcast(counts), key, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    return tiled.withColumn("side", F.pmod(F.xxhash64(by), F.col("tiles")).cast("int"))


def paired_tiles(posted: DataFrame, key: str, long: dict, by: str = "id") -> DataFrame:
    """``posted`` with ``side`` and ``tile``: every two rows of a group of ``key`` meet in a tile.

    ``long`` gives the number of tiles of the groups that need more than one. A row is on one side, by hash, and goes into a
    tile with each side of its group; tile ``a * 65536 + b`` holds the sides a <= b.
    """
    if not long:
        return posted.select("*", F.lit(0).alias("side"), F.lit(0).alias("tile"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.least(o, F.col("side")) * 65536 + F.greatest(o, F.col("side")))
    return _sides(posted, key, long, by).withColumn("tile", F.explode(pairs)).drop("tiles")


def directed_tiles(posted: DataFrame, key: str, long: dict, member: str, by: str) -> DataFrame:
    """As :func:`paired_tiles` where only rows with ``member`` are looked for: tile ``a * 65536 + b`` holds the queries of side a and the members of side b."""
    if not long:
        return posted.select("*", F.lit(0).alias("side"), F.lit(0).alias("tile"))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    asking = F.transform(every, lambda o: F.col("side") * 65536 + o)
    asked = F.when(F.col(member), F.transform(every, lambda o: o * 65536 + F.col("side"))).otherwise(F.array().cast("array<int>"))
    return _sides(posted, key, long, by).withColumn("tile", F.explode(F.array_distinct(F.concat(asking, asked)))).drop("tiles")
