"""Readers of the toolkit's files; nothing is read but the columns asked for."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidforge.functions.sid import parse_codes, parse_sid
from sidforge.functions.text import clean_id
from sidforge.functions.vectors import doubles
from sidforge.operators.codebook import Codebook
from sidforge.sources.validate import id_column, require_columns, require_dim, require_none, require_rows, require_unique

INTERACTIONS = "user_id string, parent_asin string, rating string, timestamp string"
METADATA = "parent_asin string, title string, store string, main_category string, categories array<string>, features array<string>, description array<string>"
FORMAT = "residual-codebook-v1"


def suffix(path: str) -> str:
    """parquet or csv, by file name; anything else is an error."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if kind not in ("parquet", "csv"):
        raise ValueError(f"neither parquet nor csv: {path}")
    return kind


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """A CSV table with a header, all columns as strings; doubled quotes stand for one.

    Files whose quoted fields hold line breaks must be read whole (``multi_line``), others can be split between tasks. Unless
    told, the files are looked through first, in splits: a field that goes on leaves a line with an odd number of quotes.
    """
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    return spark.read.csv(path, header=True, multiLine=multi_line, quote='"', escape='"', encoding="UTF-8")


def read_by_suffix(spark: SparkSession, path: str) -> DataFrame:
    """A parquet or CSV table, CSV columns as strings."""
    return spark.read.parquet(path) if suffix(path) == "parquet" else read_csv(spark, path)


def read_interactions(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Interactions CSV with a header, all columns as strings; quoted line breaks and doubled quotes are read."""
    df = read_csv(spark, path, multi_line)
    require_columns(df, ["parent_asin"], "interactions")
    return df


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata JSON lines with ``line_no``; blank lines are skipped, a malformed line is an error.

    ``line_no`` orders lines by file, place of the split in it, and place in the split, however splits are packed into tasks.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"))
    lines = spark.read.text(path).select(place.alias("line_no"), "value").where(F.trim("value") != "")
    return lines.select("line_no", F.from_json("value", METADATA, {"mode": "FAILFAST"}).alias("m")).select("line_no", "m.*")


def domain_of(path: str) -> str:
    """Domain of a metadata file: its name without ending and without ``meta_``."""
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0].replace("meta_", "")


def read_embeddings(spark: SparkSession, path: str, dim: int | None = None, strict: bool = True) -> DataFrame:
    """``<id column>, embedding``; the id column is the first of item_id, pid, parent_asin.

    Strict (for training): rows with a null or blank id or a null vector are dropped, ids are trimmed; vectors must be finite
    and of one length, ids unique. Not strict (for encoding new items): nothing is dropped, ids become strings.
    """
    df = spark.read.parquet(path)
    key = id_column(df, "embeddings")
    require_columns(df, ["embedding"], "embeddings")
    if not strict:
        return df.select(F.col(key).cast("string").alias(key), doubles("embedding").alias("embedding"))
    rows = df.select(clean_id(F.col(key).cast("string")).alias(key), doubles("embedding").alias("embedding")).where(F.col(key).isNotNull() & F.col("embedding").isNotNull())
    require_dim(rows, "embedding", dim, "embeddings")
    require_unique(rows, key, "embeddings")
    return rows


def _codes_or_sid(df: DataFrame):  # noqa: ANN202
    have = []
    if "codes" in df.columns:
        column = F.col("codes")
        have.append(parse_codes(column) if df.schema["codes"].dataType.simpleString() == "string" else column.cast("array<bigint>"))
    if "sid" in df.columns:
        have.append(parse_sid(F.col("sid")))
    if not have:
        raise ValueError("neither a codes nor a sid column")
    return F.coalesce(*have)


def read_item_codes(spark: SparkSession, path: str, n_layers: int | None = None) -> DataFrame:
    """``item_id, codes`` cut to ``n_layers``; the codes column, where it can't be read the sid.

    Without ``n_layers`` the first readable row tells it. Rows without id or codes are dropped. Errors: shorter codes, no row,
    repeated ids.
    """
    df = read_by_suffix(spark, path)
    rows = df.select(clean_id(F.col(id_column(df, "item codes")).cast("string")).alias("item_id"), _codes_or_sid(df).alias("codes")).where("item_id is not null and codes is not null")
    require_rows(rows, "item codes")
    if n_layers is None:
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
        placed = df.select("*", place.alias("_place"))
        placed = placed.select("_place", clean_id(F.col(id_column(df, "item codes")).cast("string")).alias("item_id"), _codes_or_sid(df).alias("codes"))
        n_layers = placed.where("item_id is not null and codes is not null").agg(F.min_by(F.size("codes"), "_place")).first()[0]
    require_none(rows, F.size("codes") < n_layers, f"items with fewer than {n_layers} codes")
    require_unique(rows, "item_id", "item codes")
    return rows.withColumn("codes", F.slice("codes", 1, n_layers))


def read_sid_map(spark: SparkSession, path: str) -> DataFrame:
    """``item_id, codes`` of an item map, all of one length; repeated ids are allowed."""
    df = read_by_suffix(spark, path)
    rows = df.select(clean_id(F.col(id_column(df, "item map")).cast("string")).alias("item_id"), _codes_or_sid(df).alias("codes")).where("item_id is not null and codes is not null")
    lengths = rows.select(F.size("codes").alias("n")).distinct().limit(2).collect()
    if len(lengths) != 1:
        raise ValueError("item map is empty" if not lengths else "codes of the item map differ in length")
    return rows


def read_transport_map(spark: SparkSession, path: str) -> DataFrame:
    """Transport map from parquet or CSV, numbers typed."""
    df = read_by_suffix(spark, path)
    types = {"layer": "int", "teacher_code": "bigint", "target_code": "bigint", "distance_sq": "double", "usage_count": "bigint"}
    require_columns(df, types, "transport map")
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in types.items()), *(c for c in df.columns if c not in types))


def read_codebook(spark: SparkSession, path: str, n_layers: int | None = None) -> Codebook:
    """Codebook from a ``layer, code, centroid`` table, layers in numeric order."""
    df = spark.read.parquet(path)
    require_columns(df, ["layer", "code", "centroid"], "codebook")
    return Codebook.from_table(df.select("layer", "code", doubles("centroid").alias("centroid")), n_layers)
