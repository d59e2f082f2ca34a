"""Per-key results under heavy key skew, by dense accumulator arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A split hands on its arrays when its dictionary has this many keys, so its memory does not follow the input.
FLUSH_KEYS = 200_000
#: Keys of a block that the number of blocks aims at, so the arrays of one merging task stay small whatever the input.
BLOCK_KEYS = 50_000

_SCHEMA = "block int, lane int, keys array<string>, counts array<bigint>, sums array<double>"


def _accumulate(blocks: int, fan: int, flush_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str | None, int] = {}
        counts, sums, lane = np.zeros(1024, np.int64), np.zeros(1024), 0

        def flush() -> pa.RecordBatch:
            keys = np.array(list(slots), dtype=object)
            hashed = pd.util.hash_array(np.array(["" if k is None else k for k in keys], dtype=object), categorize=False) if len(keys) else np.zeros(0, np.uint64)
            block = (hashed % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0]) if len(keys) else np.zeros(0, int)
            groups = np.split(order, starts[1:]) if len(keys) else []
            return pa.record_batch(
                [
                    pa.array([int(block[g[0]]) for g in groups], pa.int32()),
                    pa.array([lane % fan for _ in groups], pa.int32()),
                    pa.array([keys[g].tolist() for g in groups], pa.list_(pa.string())),
                    pa.array([counts[g].tolist() for g in groups], pa.list_(pa.int64())),
                    pa.array([sums[g].tolist() for g in groups], pa.list_(pa.float64())),
                ],
                names=["block", "lane", "keys", "counts", "sums"],
            )

        from pyspark import TaskContext

        context = TaskContext.get()
        lane = context.partitionId() if context else 0
        for batch in batches:
            encoded = batch.column(0).dictionary_encode(null_encoding="encode")
            local = np.fromiter((slots.setdefault(k, len(slots)) for k in encoded.dictionary.to_pylist()), np.int64, len(encoded.dictionary))
            if len(slots) > len(counts):
                room = max(len(slots), 2 * len(counts))
                counts, sums = np.resize(counts, room) * (np.arange(room) < len(counts)), np.resize(sums, room) * (np.arange(room) < len(sums))
            codes = encoded.indices.to_numpy(zero_copy_only=False)
            values = pc.fill_null(batch.column(1), 0.0).to_numpy(zero_copy_only=False)
            counts[local] += np.bincount(codes, minlength=len(local))
            sums[local] += np.bincount(codes, weights=values, minlength=len(local))
            if len(slots) >= flush_keys:
                yield flush()
                slots, counts, sums = {}, np.zeros(1024, np.int64), np.zeros(1024)
        if slots:
            yield flush()

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = np.concatenate([np.asarray(x, dtype=object) for x in pdf["keys"]])
    codes, uniques = pd.factorize(keys, use_na_sentinel=False)
    counts, sums = np.zeros(len(uniques), np.int64), np.zeros(len(uniques))
    np.add.at(counts, codes, np.concatenate([np.asarray(x, np.int64) for x in pdf["counts"]]))
    np.add.at(sums, codes, np.concatenate([np.asarray(x, float) for x in pdf["sums"]]))
    uniques = [None if u is None or u != u else u for u in uniques]
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "lane": [0], "keys": [uniques], "counts": [counts], "sums": [sums]})


def _shape(rows: DataFrame) -> tuple[int, int]:
    """Blocks and lanes: blocks by the approximate number of keys, lanes the square root of the number of splits, so both merging steps take about as many arrays."""
    keys, splits = rows.select("key", F.spark_partition_id().alias("split")).agg(F.approx_count_distinct("key"), F.approx_count_distinct("split")).first()
    return max(8, -(-keys // BLOCK_KEYS)), max(1, int(np.ceil(np.sqrt(splits))))


def dense_key_totals(
    df: DataFrame, key: Column, value: Column | None = None, blocks: int | None = None, fan: int | None = None, flush_keys: int = FLUSH_KEYS
) -> DataFrame:
    """Rows and value sum per key: ``key, n_rows, value_sum``.

    Each input split dictionary-encodes its keys and counts them with ``bincount`` into dense arrays, whose slots are the
    split's dictionary; the arrays are cut into ``blocks`` by key hash and summed in two steps, first in ``fan`` lanes per
    block, then per block. A key that holds most rows costs each split one array slot, so no task has more than its share,
    and at most ``splits * distinct keys`` slots are shuffled, never rows. Blocks and lanes follow the number of keys and of
    splits (one pass over the key column) unless they are given, so a merging task has some BLOCK_KEYS keys of about
    sqrt(splits) arrays at any size.

    Null is a key of its own (key null). A null value counts as 0 in the sum but its row is counted. An empty input gives an
    empty result. Extra columns are ignored.
    """
    rows = df.select(key.cast("string").alias("key"), (F.lit(0.0) if value is None else value.cast("double")).alias("value"))
    if blocks is None or fan is None:
        found = _shape(rows)
        blocks, fan = blocks or found[0], fan or found[1]
    arrays = rows.mapInArrow(_accumulate(blocks, fan, flush_keys), _SCHEMA)
    lanes = arrays.groupBy("block", "lane").applyInPandas(_merge, _SCHEMA)
    merged = lanes.groupBy("block").applyInPandas(_merge, _SCHEMA)
    return merged.select(F.explode(F.arrays_zip("keys", "counts", "sums")).alias("z")).select(
        F.col("z.keys").alias("key"), F.col("z.counts").alias("n_rows"), F.col("z.sums").alias("value_sum")
    )


def dominant_keys(df: DataFrame, key: Column, share: float) -> DataFrame:
    """``key, n_rows`` of the non-null keys of ``df`` that hold at least ``share`` of all its rows, null-key rows included.

    The keys are accumulated once; the number of all rows is a count of its own, which reads no column.
    """
    totals = dense_key_totals(df, key)
    return totals.where(F.col("key").isNotNull() & (F.col("n_rows") >= df.count() * F.lit(share))).select("key", "n_rows")
