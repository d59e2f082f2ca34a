"""Vocabulary lookups and the prefix table of constrained decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.functions.sid import SID_END, sid_token


def layer_tokens(sizes: DataFrame) -> DataFrame:
    """``layer, code, token`` of every code of ``sizes(layer, size)``."""
    codes = sizes.where("size > 0").select(F.col("layer").cast("int").alias("layer"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size").cast("bigint") - 1)).alias("code"))
    return codes.withColumn("token", sid_token(F.col("layer"), F.col("code")))


def resolve_tokens(tokens: DataFrame, vocabulary: DataFrame, unknown_id: int | None = None, strict: bool = True) -> DataFrame:
    """``tokens`` with ``token_id`` from ``vocabulary(token, token_id)``; an error where one is missing or unknown."""
    joined = tokens.join(vocabulary.select("token", "token_id"), "token", "left")
    known = F.col("token_id") if unknown_id is None else F.when(F.col("token_id") != unknown_id, F.col("token_id"))
    if not strict:
        return joined.withColumn("token_id", known)
    return joined.withColumn("token_id", F.coalesce(known, F.raise_error(F.concat(F.lit("no id for token "), F.col("token"))).cast("bigint")))


def suffix_tokens(df: DataFrame, vocabulary: DataFrame, key: str, codes: str = "codes") -> DataFrame:
    """``<key>, token_ids``: ids of an item's code tokens and the end marker, in order."""
    tokens = F.concat(F.transform(codes, lambda c, i: sid_token(i, c)), F.array(F.lit(SID_END)))
    rows = df.select(key, F.posexplode(tokens).alias("at", "token"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("at", "token_id"))), lambda x: x["token_id"])
    return resolve_tokens(rows, vocabulary).groupBy(key).agg(ids.alias("token_ids"))


def flat_ids(resolved: DataFrame) -> DataFrame:
    """``nth, token_id`` in the order of layer and code, numbered from 0; vocabulary-sized."""
    from pyspark.sql import Window as W

    return resolved.select((F.row_number().over(W.orderBy("layer", "code")) - 1).alias("nth"), "token_id")


def prefix_table(df: DataFrame, sequence: str, order: str | None = None) -> DataFrame:
    """``prefix, allowed``: every proper prefix of the sequences and the tokens that may follow it.

    The tokens are in the order in which ``order`` first brings them, or ascending without it. Two grouped steps: each
    (prefix, token) is counted once before tokens are put together, so a prefix of all sequences collects only its tokens.
    """
    s = F.col(sequence)
    steps = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.struct(F.slice(s, F.lit(1), i).alias("prefix"), F.get(s, i).alias("token")))
    rows = df.where(F.size(s) > 0).select(F.explode(steps).alias("x"), (F.lit(0) if order is None else F.col(order)).alias("at")).select("x.*", "at")
    distinct = rows.groupBy("prefix", "token").agg(F.min("at").alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"])
    return distinct.groupBy("prefix").agg(listed.alias("allowed"))


def allowed_tokens(queries: DataFrame, table: DataFrame, prefix: str = "prefix") -> DataFrame:
    """``queries`` with ``allowed``; an unknown prefix allows nothing."""
    joined = queries.join(table.select(F.col("prefix").alias("_p"), "allowed"), F.col(prefix) == F.col("_p"), "left").drop("_p")
    return joined.withColumn("allowed", F.coalesce("allowed", F.array().cast("array<bigint>")))


def selected_rows(resolved: DataFrame, layers: list[int]) -> DataFrame:
    """``token_id``: distinct ids of the given layers' tokens, the rows that a row-only training may change."""
    return resolved.where(F.col("layer").isin(layers)).select("token_id").distinct()


def trainable_elements(n_rows: int, width: int, shared: bool) -> int:
    """Numbers that such a training may change: rows times width, twice when the output matrix is one of its own."""
    if n_rows <= 0 or width <= 0:
        raise ValueError("nothing to train")
    return n_rows * width * (1 if shared else 2)
