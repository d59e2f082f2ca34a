"""Writers of the toolkit's results."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from sidforge.operators.codebook import Codebook
from sidforge.sources.readers import FORMAT


def write_table(df: DataFrame, path: str) -> str:
    """Parquet, parents made, an earlier result replaced."""
    df.write.mode("overwrite").parquet(path)
    return path


def derived_path(path: str, ending: str) -> str:
    """Default output beside an input: its name without the last ending, plus ``ending``."""
    return os.path.splitext(path.rstrip("/"))[0] + ending


def embeddings_path(items: str) -> str:
    return derived_path(items, "_embeddings.parquet")


def codes_path(embeddings: str) -> str:
    return derived_path(embeddings, "_codes.parquet")


def distilled_codes_path(embeddings: str) -> str:
    return derived_path(embeddings, "_distilled_codes.parquet")


def write_json(spark: SparkSession, path: str, document: dict) -> str:
    """A small JSON document as one file, on whatever file system the path names; returns its text."""
    text = json.dumps(document, indent=2, ensure_ascii=False)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    stream = system.create(target, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    return text


def write_codebook(spark: SparkSession, book: Codebook, path: str, metadata: dict) -> str:
    """Codebook table and, beside it, a JSON document that describes it."""
    write_table(book.to_table(spark).coalesce(1), path)
    described = {"format": FORMAT, "n_layers": book.n_layers, "dim": book.dim, "codebook_sizes": book.sizes, "metadata": metadata}
    write_json(spark, derived_path(path, "_metadata.json"), described)
    return path
