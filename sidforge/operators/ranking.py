"""Ranking metrics of beam predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hit(predictions: Column, label: Column) -> Column:
    """Rank (from 1) of the first prediction list that contains the label; null when none does."""
    hits = F.transform(predictions, lambda c, i: F.when(F.array_contains(c, label), i + 1))
    return F.array_min(hits)


def rank_metrics(df: DataFrame, rank: Column, ks: tuple[int, ...]) -> DataFrame:
    """``df`` with ``recall_at_k`` and ``ndcg_at_k`` for every k, from the rank of the label (null: not found)."""
    for k in ks:
        hit = rank.isNotNull() & (rank <= k)
        df = df.withColumn(f"recall_at_{k}", F.when(hit, 1.0).otherwise(0.0))
        df = df.withColumn(f"ndcg_at_{k}", F.when(hit, 1.0 / F.log2(rank + 1)).otherwise(0.0))
    return df


def mean_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the mean of every column, 0 when there are no rows."""
    return df.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns))
