"""Residual vector quantisation: encoding, decoding, losses and code statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPSILON = 1e-4
SAMPLE_ROWS = 10_000


class Codebook:
    """Centroids of all layers, in double precision; as large as a codebook, never as the data."""

    def __init__(self, layers: list[np.ndarray]):
        if not layers:
            raise ValueError("a codebook needs at least one layer")
        layers = [np.asarray(c, np.float64) for c in layers]
        if any(c.ndim != 2 or not len(c) for c in layers) or len({c.shape[1] for c in layers}) != 1:
            raise ValueError("every layer must hold centroids of one common dimension")
        if not all(np.isfinite(c).all() for c in layers):
            raise ValueError("centroids must be finite")
        self.layers = layers

    @property
    def n_layers(self) -> int:
        return len(self.layers)

    @property
    def dim(self) -> int:
        return self.layers[0].shape[1]

    @property
    def sizes(self) -> list[int]:
        return [len(c) for c in self.layers]

    @classmethod
    def from_table(cls, df: DataFrame, n_layers: int | None = None) -> Codebook:
        """From ``layer, code, centroid``; layers must run from 0, codes of each layer too. ``n_layers`` takes the first ones."""
        rows = df.where(F.col("layer") < n_layers).collect() if n_layers is not None else df.collect()
        by: dict[int, dict[int, list[float]]] = {}
        for r in rows:
            by.setdefault(int(r["layer"]), {})[int(r["code"])] = r["centroid"]
        if n_layers is not None and len(by) < n_layers:
            raise ValueError(f"{n_layers} layers asked for, {len(by)} available")
        if sorted(by) != list(range(len(by))) or any(sorted(c) != list(range(len(c))) for c in by.values()):
            raise ValueError("layers and codes must be numbered from 0 without a gap")
        return cls([np.array([codes[i] for i in range(len(codes))]) for _, codes in sorted(by.items())])

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(layer, code, [float(x) for x in v]) for layer, c in enumerate(self.layers) for code, v in enumerate(c)]
        return spark.createDataFrame(rows, "layer int, code int, centroid array<double>")

    def head(self, n_layers: int | None) -> Codebook:
        if n_layers is None:
            return self
        if not 0 < n_layers <= self.n_layers:
            raise ValueError(f"{n_layers} layers asked for, {self.n_layers} available")
        return Codebook(self.layers[:n_layers])

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of a block of vectors: per layer the nearest centroid of what is left, the lowest code among equals."""
        rest, out = np.array(x, np.float64), np.empty((len(x), self.n_layers), np.int64)
        for i, c in enumerate(self.layers):
            out[:, i] = nearest(rest, c)
            rest -= c[out[:, i]]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Sum of the centroids that the codes name."""
        out = np.zeros((len(codes), self.dim))
        for i, c in enumerate(self.layers[: codes.shape[1]]):
            if codes[:, i].min(initial=0) < 0 or codes[:, i].max(initial=0) >= len(c):
                raise ValueError(f"a code of layer {i} is outside its codebook")
            out += c[codes[:, i]]
        return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Row of the nearest centroid for each vector, the lowest among equals."""
    return (np.einsum("ij,ij->i", centroids, centroids)[None, :] - 2.0 * (x @ centroids.T)).argmin(axis=1)


def _stack(column: pd.Series, dtype: type = np.float64) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(dtype) if len(column) else np.zeros((0, 0), dtype)


def _spread(known: np.ndarray, rows) -> pd.Series:  # noqa: ANN001
    """A column with the rows where ``known`` and null elsewhere."""
    out = np.empty(len(known), dtype=object)
    for i, row in zip(np.flatnonzero(known), rows):
        out[i] = row
    return pd.Series(out)


def encoder(spark: SparkSession, book: Codebook, n_layers: int | None = None):
    """Column function: vector column to code column, null for null. Arrow batches; no shuffle."""
    sent = spark.sparkContext.broadcast(book.head(n_layers))

    @F.pandas_udf("array<bigint>")
    def encode(v: pd.Series) -> pd.Series:
        known = v.notna().to_numpy()
        return _spread(known, sent.value.encode(_stack(v[known])) if known.any() else [])

    return encode


def decoder(spark: SparkSession, book: Codebook):
    """Column function: code column to vector column, null for null."""
    sent = spark.sparkContext.broadcast(book)

    @F.pandas_udf("array<double>")
    def decode(codes: pd.Series) -> pd.Series:
        known = codes.notna().to_numpy()
        return _spread(known, sent.value.decode(_stack(codes[known], np.int64)) if known.any() else [])

    return decode


def encode(df: DataFrame, book: Codebook, vector: str = "embedding", n_layers: int | None = None, out: str = "codes") -> DataFrame:
    """``df`` with the codes of its vectors."""
    return df.withColumn(out, encoder(df.sparkSession, book, n_layers)(F.col(vector).cast("array<double>")))


def decode(df: DataFrame, book: Codebook, codes: str = "codes", out: str = "reconstruction") -> DataFrame:
    """``df`` with the vectors that its codes stand for."""
    return df.withColumn(out, decoder(df.sparkSession, book)(F.col(codes).cast("array<bigint>")))


def reconstruction_loss(df: DataFrame, book: Codebook, vector: str = "embedding", codes: str = "codes", epsilon: float = EPSILON) -> DataFrame:
    """One row ``n_items, mse, relative_loss`` over all components of all rows; 0 for an empty input.

    The relative loss is the mean of ``|x - y| / (max(|x|, |y|) + epsilon)``.
    """
    sent = df.sparkSession.sparkContext.broadcast(book)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x, y = _stack(frame["v"]), sent.value.decode(_stack(frame["c"], np.int64))
                relative = np.abs(x - y) / (np.maximum(np.abs(x), np.abs(y)) + epsilon)
                yield pd.DataFrame({"rows": [len(x)], "n": [x.size], "sse": [((x - y) ** 2).sum()], "rel": [relative.sum()]})

    rows = df.select(F.col(vector).cast("array<double>").alias("v"), F.col(codes).cast("array<bigint>").alias("c")).where("v is not null and c is not null")
    sums = rows.mapInPandas(partial, "rows bigint, n bigint, sse double, rel double").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "n", "sse", "rel")))
    n = F.greatest(F.col("n"), F.lit(1))
    return sums.select(F.col("rows").alias("n_items"), (F.col("sse") / n).alias("mse"), (F.col("rel") / n).alias("relative_loss"))


def first_rows(df: DataFrame, order: Column, most: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows in the stated order, of which the sampled loss is taken."""
    return df.orderBy(order).limit(most)


def reencode_loss(df: DataFrame, teacher: Codebook, target: Codebook, codes: str = "codes") -> DataFrame:
    """Loss of ``target`` on the vectors that the teacher's codes stand for."""
    restored = decode(df.select(codes), teacher, codes, "v")
    return reconstruction_loss(encode(restored, target, "v", out="c"), target, "v", "c")


def collision_stats(df: DataFrame, value: Column) -> DataFrame:
    """One row ``num_total, num_unique, collision_rate, num_collision_clusters, max_cluster_size`` of a value column, nulls left out."""
    counts = df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    several = F.when(F.col("n") > 1, F.col("n"))
    stats = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_total"), F.count("*").alias("num_unique"), F.count(several).alias("num_collision_clusters"), F.coalesce(F.max(several), F.lit(1)).alias("max_cluster_size"))
    rate = F.when(F.col("num_total") == 0, 0.0).otherwise(1.0 - F.col("num_unique") / F.col("num_total"))
    return stats.select("num_total", "num_unique", rate.alias("collision_rate"), "num_collision_clusters", "max_cluster_size")


def code_usage(codes: DataFrame, codebook: DataFrame, column: str = "codes") -> DataFrame:
    """``layer, code, usage_count`` of every code of the codebook table, unused ones with 0."""
    used = codes.select(F.posexplode(column).alias("layer", "code")).groupBy("layer", "code").agg(F.count("*").alias("n"))
    known = codebook.select(F.col("layer").cast("int").alias("layer"), F.col("code").cast("bigint").alias("code"))
    return known.join(used, ["layer", "code"], "left").select("layer", "code", F.coalesce("n", F.lit(0)).alias("usage_count"))


def code_coverage(usage: DataFrame) -> DataFrame:
    """``layer, codebook_size, active_codes, coverage_ratio`` of :func:`code_usage`."""
    active = F.count(F.when(F.col("usage_count") > 0, 1))
    return usage.groupBy("layer").agg(F.count("*").alias("codebook_size"), active.alias("active_codes"), (active / F.count("*")).alias("coverage_ratio"))
