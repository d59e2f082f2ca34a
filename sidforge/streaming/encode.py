"""Encoding items as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sidforge.functions.sid import sid_from_codes
from sidforge.functions.text import clean_id
from sidforge.functions.vectors import usable
from sidforge.operators.codebook import Codebook, encode


def encode_stream(arrivals: DataFrame, book: Codebook, key: str = "pid", vector: str = "embedding") -> DataFrame:
    """``item_id, codes, sid`` of a stream of embeddings; rows without id or with an unusable vector are left out.

    The encoding is row-local, so the stream keeps no state and needs no watermark; batch and stream share the plan.
    """
    rows = arrivals.select(clean_id(key).alias("item_id"), F.col(vector).alias("v")).where(F.col("item_id").isNotNull() & usable(F.col("v"), book.dim))
    coded = encode(rows.withColumn("v", F.col("v").cast("array<double>")), book, "v")
    return coded.select("item_id", "codes", sid_from_codes("codes").alias("sid"))


def write_stream(coded: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet whatever has arrived, then stop; run again to go on from there, each row once."""
    return coded.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
