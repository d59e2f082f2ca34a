"""Unit vectors as 16-bit integers, the form in which they travel, and what decides where that is not exact enough."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidforge.functions.vectors import usable
from sidforge.session import materialize

#: Cosines of packed vectors are off by about 4e-6; nearer than this to a threshold they are taken again on the full vectors.
DOUBT = 1e-4


def usable_rows(df: DataFrame, key: Column, version: Column, vector: Column, dim: int) -> DataFrame:
    """``id, version, v`` of the rows with an id and a usable vector. Null, empty, short, long, non-finite and all-zero vectors and null ids give no row."""
    return df.select(key.cast("string").alias("id"), version.cast("bigint").alias("version"), vector.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), dim))


def usable_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """``id, version, vec`` of :func:`usable_rows`; of several rows of an id the highest version.

    ``vec`` is the unit vector as ``dim`` 16-bit integers in a binary, scaled so that the largest component fills the range;
    :func:`unpack` scales back to unit length.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            x = np.rint(x * (32_767 / np.abs(x).max(axis=1, keepdims=True, initial=0))).astype(np.int16)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(2 * dim)
            vec = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.record_batch([batch.column(0), batch.column(1), vec], names=["id", "version", "vec"])

    packed = rows.mapInArrow(pack, "id string, version bigint, vec binary")
    return packed.groupBy("id").agg(F.max(F.struct("version", "vec")).alias("m")).select("id", "m.version", "m.vec")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def unpack(column: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of packed binaries, in single precision."""
    return _unit(np.frombuffer(b"".join(column), np.int16).reshape(-1, dim))


def unpack_arrow(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """As :func:`unpack`, straight from the buffers of an Arrow column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if not len(column):
        return np.zeros((0, dim), np.float32)
    start = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
    return _unit(np.frombuffer(column.buffers()[2], np.int16, len(column) * dim, int(start)).reshape(-1, dim))


def exactly_similar(doubtful: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``doubtful(a, b, ...)`` whose cosine on the vectors of ``full`` (:func:`usable_rows`) reaches ``threshold``."""
    needed = doubtful.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    best = full.join(needed, "id", "left_semi").groupBy("id").agg(F.max_by("v", "version").alias("v"))
    best = best.select("id", F.transform("v", lambda x: x.cast("double") / F.array_max(F.transform("v", lambda y: F.abs(y.cast("double"))))).alias("v"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = doubtful.join(best.select(F.col("id").alias("a"), F.col("v").alias("_p")), "a").join(best.select(F.col("id").alias("b"), F.col("v").alias("_q")), "b")
    cosine = dot("_p", "_q") / F.sqrt(dot("_p", "_p") * dot("_q", "_q"))
    return both.where(cosine >= threshold).drop("_p", "_q").select(doubtful.columns)


def fingerprint() -> Column:
    """96 bits that equal vectors have in common."""
    return F.struct(F.xxhash64("vec").alias("h"), F.hash("vec").alias("g"))


def equal_vectors(base: DataFrame) -> DataFrame:
    """``print, representative`` of the vectors that occur more than once; the smallest id stands for all. Only prints are shuffled."""
    prints = base.select(fingerprint().alias("print"), "id").groupBy("print").agg(F.count("*").alias("n"), F.min("id").alias("representative"))
    return materialize(prints.where("n > 1").select("print", "representative"), "copies")


def without_copies(base: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of ``base`` that stand for themselves or for their copies."""
    if copies.isEmpty():
        return base
    marked = base.withColumn("print", fingerprint()).join(copies, "print", "left")
    return marked.where("representative is null or representative = id").select("id", "vec")
