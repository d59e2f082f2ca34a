"""Queries of the problems tagged llm, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidforge.functions.text import WHITESPACE, clean_id
from sidforge.llm.leakage import leaked_passages
from sidforge.llm.listings import product_groups
from sidforge.llm.mixture import cluster_profiles, similarity_clusters
from sidforge.llm.neighbours import nearest_neighbours, similar_pairs
from sidforge.llm.pairs import associations, memberships, update_pairs
from sidforge.llm.splitting import split_oversized
from sidforge.llm.tokens import encode_texts
from sidforge.llm.vectors16 import usable_rows, usable_vectors
from sidforge.session import table

SAME = 0.85


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "item_meta").withColumn("pid", clean_id("parent_asin"))
    return product_groups(rows, "pid", "row_no", "title", "store", "description", "categories")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listings of one product: all of a group, as its definition asks; ``p2_groups`` has them without pairing."""
    groups = _products(spark, sf_dir)
    return groups.select(F.col("id").alias("item_a"), "product").join(groups.select(F.col("id").alias("item_b"), "product"), "product").where("item_a < item_b").select("item_a", "item_b")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product of every listing."""
    return _products(spark, sf_dir)


def _kept_up(spark: SparkSession, sf_dir: str, *shares: float) -> DataFrame:
    """The pair table over all rows, built from those that arrived first and updated with each later part; shares of the rows part them by arrival."""
    rows = table(spark, sf_dir, "user_sequences")
    visits = lambda part: memberships(part, clean_id("user_id"), clean_id("parent_asin"))
    arrived = F.unix_micros(F.col("arrived_at").cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(arrived, list(shares))).first()[0] or []
    part = F.coalesce(sum((arrived > c).cast("int") for c in cuts) if cuts else F.lit(0), F.lit(0))
    state = None
    for i in range(len(cuts) + 1):
        state = update_pairs(spark, state, visits(rows.where(part == i)))
    return associations(state)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items that users touch together much more often than by chance; the last hundredth of the rows comes as an update."""
    return _kept_up(spark, sf_dir, 0.99).select("item_a", "item_b")


def p3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and scores of the found pairs, kept up over two updates: four fifths of the rows first, then most of the rest, then the last."""
    return _kept_up(spark, sf_dir, 0.8, 0.98).select("item_a", "item_b", "n_together", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable_rows(table(spark, sf_dir, "item_embeddings"), clean_id("pid"), F.col("row_no"), F.col("embedding"), 64)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similar vectors of which one is among the other's five nearest."""
    rows = _usable(spark, sf_dir)
    pairs = similar_pairs(nearest_neighbours(usable_vectors(rows, 64), 5), rows, SAME)
    return pairs.select(F.col("a").alias("pid_a"), F.col("b").alias("pid_b"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector, ranked."""
    return nearest_neighbours(usable_vectors(_usable(spark, sf_dir), 64), 5).withColumn("similarity", F.round("similarity", 4))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _usable(spark, sf_dir)
    return similarity_clusters(usable_vectors(rows, 64), rows, SAME)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest member and each other member of every cluster."""
    return _clusters(spark, sf_dir).where("id != cluster").select(F.col("cluster").alias("pid_a"), F.col("id").alias("pid_b"))


def p6_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical members of every cluster, with the codes of the most typical one."""
    profiles = cluster_profiles(_clusters(spark, sf_dir))
    codes = table(spark, sf_dir, "item_codes").select(clean_id("pid").alias("first"), "codes").where("first is not null and codes is not null")
    codes = codes.groupBy("first").agg(F.min("codes").alias("codes"))
    return profiles.withColumn("first", F.get("typical", F.lit(0))).join(codes, "first", "left").select("cluster", "size", "typical", "codes")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "eval_id", "passage")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a passage, with the passage."""
    return _leaks(spark, sf_dir).select("doc_id", "eval_id").distinct()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with the share of the passage's words and the number of sentences held."""
    return _leaks(spark, sf_dir)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents too large for one piece."""
    return _pieces(spark, sf_dir).where("piece_no = 0").select("doc_id").distinct()


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of oversized documents."""
    return _pieces(spark, sf_dir)


_WS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
_PAIR_SQL = f"""
with visits as (
  select distinct nullif(trim(user_id, {_WS}), '') as u, nullif(trim(parent_asin, {_WS}), '') as i from user_sequences
), clean as (select * from visits where u is not null and i is not null
), items as (select i, count(*) as n from clean group by i
), whole as (select count(distinct u) as n from clean
), likely as (select u, i from clean join items using (i), whole where items.n >= 12 and items.n * 5 <= whole.n
), together as (select a.i as item_a, b.i as item_b, count(*) as m from likely a join likely b on a.u = b.u and a.i < b.i group by all having count(*) >= 12
), scored as (
  select item_a, item_b, m as n_together, a.n as n_a, b.n as n_b, m * cast(whole.n as double) / (cast(a.n as double) * b.n) as lift
  from together join items a on a.i = item_a join items b on b.i = item_b, whole where m * cast(whole.n as double) >= 5 * cast(a.n as double) * b.n
)
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p6_found": p6_found,
    "p6_profiles": p6_profiles,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_pieces": p9_pieces,
}
ORACLES = {
    "p3_found": _PAIR_SQL + "select item_a, item_b from scored",
    "p3_scores": _PAIR_SQL + "select item_a, item_b, n_together, n_a, n_b, round(lift, 6) as lift from scored",
}
