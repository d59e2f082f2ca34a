"""From interactions and metadata to items, and from items and codes to the semantic id map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sidforge.functions.sid import normalize_codes, sid_from_codes
from sidforge.functions.text import clean_id, item_text
from sidforge.sources.validate import id_column, require_columns, require_none, require_unique

SCOPES = ("all_meta", "labels_only")


@dataclass(frozen=True)
class MetaSource:
    """Metadata of one domain. ``order`` numbers the lines; of a repeated id the last line counts."""

    rows: DataFrame
    domain: str
    order: str = "line_no"


def seen_items(interactions: DataFrame) -> DataFrame:
    """``item_id``: the distinct trimmed item ids of interactions; an error when there are none."""
    require_columns(interactions, ["parent_asin"], "interactions")
    return interactions.select(clean_id("parent_asin").alias("item_id")).where("item_id is not null").distinct()


def described_items(source: MetaSource, keep: DataFrame | None = None) -> DataFrame:
    """``item_id, domain, text, title, first_line, last_line`` of one source; only ids in ``keep`` where given.

    The text is built after filtering and after the last line of each id is chosen.
    """
    fields = ["title", "store", "main_category", "categories", "features", "description"]
    rows = source.rows.select(clean_id("parent_asin").alias("item_id"), F.col(source.order).alias("line"), *fields).where("item_id is not null")
    if keep is not None:
        rows = rows.join(keep, "item_id", "left_semi")
    latest = rows.groupBy("item_id").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.max_by(F.struct(*fields), "line").alias("r"))
    latest = latest.select("item_id", "first_line", "last_line", "r.*")
    return latest.select("item_id", F.lit(source.domain).alias("domain"), item_text("item_id").alias("text"), "title", "first_line", "last_line")


def prepare_items(interactions: DataFrame, target: MetaSource, sources: list[MetaSource] = (), scope: str = "all_meta") -> DataFrame:
    """``item_id, domain, is_target_candidate, text, title, source_no, first_line`` of all items.

    Target metadata gives candidates, with ``labels_only`` only those seen in the interactions; each further source adds its
    seen items. An item in several sources takes the whole record of the last one, so it loses the candidate flag. The place
    it is listed at (source_no, first_line) stays that of its first record.
    """
    if scope not in SCOPES:
        raise ValueError(f"scope {scope!r} is none of {SCOPES}")
    seen = seen_items(interactions)
    parts = [described_items(target, seen if scope == "labels_only" else None).select("*", F.lit(True).alias("is_target_candidate"), F.lit(0).alias("n"))]
    parts += [described_items(s, seen).select("*", F.lit(False).alias("is_target_candidate"), F.lit(i).alias("n")) for i, s in enumerate(sources, 1)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    record = F.struct("domain", "is_target_candidate", "text", "title")
    merged = every.groupBy("item_id").agg(F.max_by(record, "n").alias("r"), F.min(F.struct(F.col("n").alias("source_no"), "first_line")).alias("at"))
    return merged.select("item_id", "r.*", "at.*")


def missing_items(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id``: seen items that no metadata describes."""
    return seen_items(interactions).join(items.select("item_id"), "item_id", "left_anti")


def embed_items(items: DataFrame, embedder, text: str = "text") -> DataFrame:  # noqa: ANN001
    """``pid, embedding``: unit vectors of the item texts by a plug-in column function string -> array<float>.

    The plug-in may be a Pandas UDF; its result is a column of its own before it is scaled.
    """
    from sidforge.functions.vectors import unit

    raw = items.select(F.col("item_id").alias("pid"), embedder(F.col(text)).alias("embedding"))
    return raw.withColumn("embedding", unit(F.col("embedding").cast("array<double>")))


def build_sid_map(metadata: DataFrame, codes: DataFrame, layers: int = 3, codes_column: str = "codes") -> DataFrame:
    """``metadata`` with ``codes`` and ``sid``, one to one by item id.

    Errors: repeated ids on either side, key types that differ, an item without codes, codes that aren't ``layers`` numbers.
    Null ids match each other. The checks are jobs of their own; the result is one join.
    """
    require_columns(metadata, ["item_id"], "metadata")
    key = id_column(codes, "codes")
    require_columns(codes, [codes_column], "codes")
    if metadata.schema["item_id"].dataType != codes.schema[key].dataType:
        raise ValueError("item ids of metadata and codes differ in type")
    require_unique(codes, key, "codes")
    require_unique(metadata, "item_id", "metadata")
    right = codes.select(F.col(key).alias("_key"), F.col(codes_column).alias("codes"))
    joined = metadata.drop("codes", "sid").join(right, F.col("item_id").eqNullSafe(F.col("_key")), "left").drop("_key")
    require_none(joined, F.col("codes").isNull(), "items without codes")
    return joined.withColumn("codes", normalize_codes("codes", layers)).withColumn("sid", sid_from_codes("codes"))


def usable_rows(df: DataFrame, key: str, order: str, vector: str, dim: int) -> DataFrame:
    """``id, ord, v``: of each id the last row with a usable vector, in double precision."""
    from sidforge.functions.vectors import usable

    rows = df.select(clean_id(key).alias("id"), F.col(order).alias("ord"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), dim))
    latest = rows.groupBy("id").agg(F.max_by("v", "ord").alias("v"), F.max("ord").alias("ord"))
    return latest.select("id", "ord", F.col("v").cast("array<double>").alias("v"))


