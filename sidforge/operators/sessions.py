"""Grouping activity into sessions by start-end pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_MS = 1_800_000
#: Width of the time buckets into which every user's events are cut; a busy user becomes many small groups.
BUCKET_MS = 86_400_000


def sessionize(
    events: DataFrame,
    user: Column,
    millis: Column,
    identity: tuple[Column, ...] = (),
    gap_ms: int = GAP_MS,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Sessions of each user: ``user_id, session_no, start_ms, end_ms, duration_ms, n_interactions``.

    An event without another one of its user in the ``gap_ms`` before it starts a session, one without another in the
    ``gap_ms`` after it ends one; both are found with RANGE frames. Starts and ends are numbered separately per user, equal
    numbers belong together, and the running event numbers at both give the count.

    Rows whose user or instant is null are no events. Rows equal in user, instant and every ``identity`` column (nulls
    equal) are one event. Events of one instant belong to one session. An event exactly ``gap_ms`` later still belongs to
    the session. An empty input gives an empty result; extra columns are ignored, whatever their names.

    Scale: all windows run per (user, time bucket), not per user. Each instant is copied to a neighbouring bucket only when
    it lies within ``gap_ms`` of the border, so frames are exact; numbers are carried across buckets with a running sum over
    the per-bucket totals, of which a user has at most one per bucket of time, however many events there are.
    """
    if bucket_ms < gap_ms:
        raise ValueError("bucket_ms must not be smaller than gap_ms")
    keys = [f"_k{i}" for i in range(len(identity))]
    rows = events.select(user.alias("user_id"), millis.cast("bigint").alias("ms"), *(c.alias(k) for c, k in zip(identity, keys)))
    rows = rows.where("user_id is not null and ms is not null")
    if identity:
        rows = rows.distinct()
    home = F.expr(f"cast(floor(ms / {bucket_ms}) as bigint)")
    instants = (
        rows.groupBy("user_id", home.alias("home"), "ms").agg(F.count("*").alias("n"))
        # an instant near a border is also seen, with weight 0, by the bucket on the other side
        .withColumn(
            "bucket",
            F.explode(
                F.array_distinct(
                    F.array(F.col("home"), F.expr(f"cast(floor((ms - {gap_ms}) / {bucket_ms}) as bigint)"), F.expr(f"cast(floor((ms + {gap_ms}) / {bucket_ms}) as bigint)"))
                )
            ),
        )
        .repartition("user_id", "bucket")
    )
    frame = W.partitionBy("user_id", "bucket").orderBy("ms")
    flagged = (
        instants.withColumn("before", F.count("*").over(frame.rangeBetween(-gap_ms, -1)))
        .withColumn("after", F.count("*").over(frame.rangeBetween(1, gap_ms)))
        .where("bucket = home")
        .select("user_id", "bucket", "ms", "n", (F.col("before") == 0).cast("int").alias("is_start"), (F.col("after") == 0).cast("int").alias("is_end"))
    )
    upto = frame.rowsBetween(W.unboundedPreceding, 0)
    numbered = flagged.select(
        "*", F.sum("n").over(upto).alias("events"), F.sum("is_start").over(upto).alias("starts"), F.sum("is_end").over(upto).alias("ends")
    ).where("is_start = 1 or is_end = 1")
    earlier = W.partitionBy("user_id").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        flagged.groupBy("user_id", "bucket")
        .agg(F.sum("n").alias("n"), F.sum("is_start").alias("s"), F.sum("is_end").alias("e"))
        .select("user_id", "bucket", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("n", "s", "e")))
    )
    placed = numbered.join(offsets, ["user_id", "bucket"])
    starts = placed.where("is_start = 1").select("user_id", (F.col("starts") + F.col("s0")).alias("session_no"), F.col("ms").alias("start_ms"), (F.col("events") + F.col("n0") - F.col("n")).alias("first"))
    ends = placed.where("is_end = 1").select("user_id", (F.col("ends") + F.col("e0")).alias("session_no"), F.col("ms").alias("end_ms"), (F.col("events") + F.col("n0")).alias("last"))
    return starts.join(ends, ["user_id", "session_no"]).select(
        "user_id", "session_no", "start_ms", "end_ms", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), (F.col("last") - F.col("first")).alias("n_interactions")
    )
