"""Queries of the general problems: sessions (p1) and dominant keys (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidforge.functions.text import WHITESPACE, clean_id, epoch_millis, pytrim
from sidforge.operators.dense_keys import dense_key_totals, dominant_keys
from sidforge.operators.sessions import sessionize
from sidforge.session import table

SHARE = 0.015


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "user_sequences")
    return sessionize(rows, clean_id("user_id"), epoch_millis("timestamp"), (clean_id("parent_asin"),))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session of a user."""
    return _sessions(spark, sf_dir).select("user_id", "start_ms", "end_ms", "n_interactions")


def p1_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with number and duration."""
    return _sessions(spark, sf_dir).select("user_id", "session_no", "duration_ms", "n_interactions")


def _item_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "user_sequences")
    return dense_key_totals(rows, clean_id("parent_asin"), pytrim("rating").try_cast("double"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with at least 1.5 % of all rows of their table."""
    found = lambda name, key: dominant_keys(table(spark, sf_dir, name), clean_id(key), SHARE).select(F.lit(name).alias("table_name"), F.col("key").alias("key_value"))
    return found("user_sequences", "parent_asin").unionByName(found("item_sid_map", "sid"))


def p4_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and rating sum of every item; rating is null-safe, unreadable ratings count as 0."""
    return _item_totals(spark, sf_dir).select(F.col("key").alias("item_id"), "n_rows", F.round("value_sum", 3).alias("rating_sum"))


_WS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def sql_clean(column: str) -> str:
    """DuckDB text of :func:`clean_id`."""
    return f"nullif(trim({column}, {_WS}), '')"


_MILLIS = f"""
  select row_id, {sql_clean("user_id")} as user_id, {sql_clean("parent_asin")} as item_id, trim(timestamp, {_WS}) as t from user_sequences
), instants as (
  select user_id, item_id, case
    when regexp_full_match(t, '[0-9]{{1,16}}(\\.[0-9]*)?') then cast(floor(case when try_cast(t as double) < 1e11 then try_cast(t as double) * 1000 else try_cast(t as double) end) as bigint)
    when regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\\.[0-9]+)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})') then epoch_ms(try_cast(t as timestamptz))
  end as ms from raw
"""
_SESSION_SQL = f"""
with raw as ({_MILLIS}), events as (
  select distinct user_id, item_id, ms from instants where user_id is not null and ms >= 1514764800000 and ms < 2240524800000
), marked as (
  select *, case when ms - lag(ms) over (partition by user_id order by ms) <= 1800000 then 0 else 1 end as fresh from events
), numbered as (
  select *, sum(fresh) over (partition by user_id order by ms, fresh desc rows unbounded preceding) as session_no from marked
), sessions as (
  select user_id, cast(session_no as bigint) as session_no, min(ms) as start_ms, max(ms) as end_ms, count(*) as n_interactions from numbered group by all
)
"""

QUERIES = {"p1_found": p1_found, "p1_durations": p1_durations, "p4_found": p4_found, "p4_totals": p4_totals}
ORACLES = {
    "p1_found": _SESSION_SQL + "select user_id, start_ms, end_ms, n_interactions from sessions",
    "p1_durations": _SESSION_SQL + "select user_id, session_no, end_ms - start_ms as duration_ms, n_interactions from sessions",
    "p4_found": f"""
        select 'user_sequences' as table_name, k as key_value from (select {sql_clean("parent_asin")} as k from user_sequences)
        where k is not null group by k having count(*) >= {SHARE} * (select count(*) from user_sequences)
        union all
        select 'item_sid_map', k from (select {sql_clean("sid")} as k from item_sid_map)
        where k is not null group by k having count(*) >= {SHARE} * (select count(*) from item_sid_map)""",
    "p4_totals": f"""
        select {sql_clean("parent_asin")} as item_id, count(*) as n_rows, round(coalesce(sum(try_cast(trim(rating, {_WS}) as double)), 0), 3) as rating_sum
        from user_sequences group by 1""",
}
