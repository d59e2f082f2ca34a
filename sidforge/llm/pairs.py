"""Items that appear together: an incrementally kept table of pair counts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sidforge.session import materialize, scratch_path

BUCKETS = 48
MIN_TOGETHER = 12
MIN_LIFT = 5.0
#: Baskets with more tracked items are kept as membership lists, see :class:`PairTable`.
WIDE_ITEMS = 2_000
#: Wide baskets at most, one bit of a 64-bit mask each.
WIDE_BASKETS = 62
#: Tracked items per block of a basket; pairs are emitted block against block, so a large basket is many rows.
BLOCK_ITEMS = 256
#: Hash parts in which new items are numbered.
PARTS = 64
#: Bytes of keys that are broadcast at most; larger sides of a join are shuffled.
BROADCAST_BYTES = 32 << 20
#: Written parts of a table beyond which they are merged into one.
MAX_PARTS = 8


@dataclass(frozen=True)
class PairTable:
    """The persistent state. Logs are lists of written parts, whose rows add up; an update appends a part to each.

    ``memberships(basket, item, sign)``: log of what came to and went from the baskets. ``marginals(item, n)``: baskets per
    item. ``tracked(item, code, live)``: items whose pairs are counted (live), and the number that stands for them.
    ``wide(basket, bit)``: the at most ``min_together - 1`` baskets of more than ``WIDE_ITEMS`` tracked items that are kept
    apart; their pairs, quadratic in their size, are not emitted but counted exactly, by ``wide_members(basket, code)``, for
    the pairs that can still reach ``min_together``. ``pairs(a, b, n, bucket)``: log of counts over all other baskets by item
    number, a < b, in hash buckets. ``likely(a, b, n)``: the pairs that can reach ``min_together``. ``n_baskets``: baskets in all.
    """

    memberships: tuple[str, ...]
    marginals: DataFrame
    tracked: DataFrame
    wide: DataFrame
    wide_members: DataFrame
    pairs: tuple[str, ...]
    likely: DataFrame
    n_baskets: int
    min_together: int


_LOG = "basket string, item string, sign int"
_PAIRS = "a int, b int, n bigint, bucket int"


def _log(spark: SparkSession, parts: tuple[str, ...], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.schema(schema).parquet(p) for p in parts]) if parts else spark.createDataFrame([], schema)


def _small(keys: DataFrame) -> DataFrame:
    """``keys`` marked for broadcast when its measured size is within BROADCAST_BYTES, else left to a shuffled join."""
    strings = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in keys.schema.fields if f.dataType.simpleString() == "string"]
    size = keys.agg(F.sum(sum(strings, F.lit(32)))).first()[0] or 0
    return F.broadcast(keys) if size <= BROADCAST_BYTES else keys


def _net(log: DataFrame) -> DataFrame:
    """The memberships that a log adds up to."""
    return log.groupBy("basket", "item").agg(F.sum("sign").alias("sign")).where("sign > 0").select("basket", "item")


def update_pairs(
    spark: SparkSession,
    state: PairTable | None,
    added: DataFrame,
    removed: DataFrame | None = None,
    min_together: int = MIN_TOGETHER,
    min_lift: float = MIN_LIFT,
    buckets: int = BUCKETS,
    wide_items: int = WIDE_ITEMS,
    path: str | None = None,
) -> PairTable:
    """Apply changed baskets to the pair table and return its new version, written below ``path``.

    ``added`` and ``removed`` hold columns ``basket`` and ``item``; rows with a null in either are ignored, repeated rows and
    memberships already there (or not there) change nothing; a row in both is removed. Extra columns are ignored.

    Only baskets whose *tracked* items changed emit pair deltas: +1 for each pair with an item that came, -1 for each pair
    with one that went. Tracked are the items that can be in a pair passing both thresholds: n >= min_together, and, as a
    pair cannot be more frequent than its rarer item, min_lift * n <= n_baskets. An item that becomes or ceases to be tracked
    changes the baskets it is in, so the counts are at any time those of a full count over all baskets.

    An update reads the logs but shuffles only the baskets it touches, and appends: deltas of memberships to one log, of
    pairs to the other, by hash bucket. Of the tables that are written anew, marginals and tracked have a row an item, and
    likely the few pairs that are frequent. When a log has more than MAX_PARTS parts they are merged into one.
    """
    path = path or scratch_path(spark, "pairs")
    clean = lambda df: df.select(F.col("basket").cast("string").alias("basket"), F.col("item").cast("string").alias("item")).where("basket is not null and item is not null")
    wanted = clean(added).distinct().withColumn("want", F.lit(1))
    if removed is not None:
        gone = clean(removed).distinct()
        wanted = wanted.join(gone, ["basket", "item"], "left_anti").unionByName(gone.withColumn("want", F.lit(0)))
    old_log = _log(spark, state.memberships if state else (), _LOG)
    if state is None:
        delta = materialize(wanted.where("want = 1").select("basket", "item", F.lit(1).alias("sign")), path=f"{path}/memberships")
        n_baskets = delta.agg(F.count_distinct("basket")).first()[0]
        marginals = delta.groupBy("item").agg(F.count("*").alias("n"))
    else:
        wanted = materialize(wanted, "wanted")
        touched = _small(wanted.select("basket").distinct())
        present = materialize(_net(old_log.join(touched, "basket", "left_semi")), "present")
        both = wanted.join(present.withColumn("there", F.lit(1)), ["basket", "item"], "left")
        delta = both.select("basket", "item", (F.col("want") - F.coalesce("there", F.lit(0))).alias("sign")).where("sign != 0")
        delta = materialize(delta, path=f"{path}/memberships")
        # baskets that began or ceased to be
        sizes = present.select("basket", F.lit(1).alias("was"), F.lit(1).alias("is")).unionByName(delta.select("basket", F.lit(0).alias("was"), F.col("sign").alias("is")))
        sizes = sizes.groupBy("basket").agg(F.sum("was").alias("was"), F.sum("is").alias("is"))
        n_baskets = state.n_baskets + (sizes.agg(F.sum((F.col("is") > 0).cast("int") - (F.col("was") > 0).cast("int"))).first()[0] or 0)
        marginals = state.marginals.unionByName(delta.groupBy("item").agg(F.sum("sign").alias("n"))).groupBy("item").agg(F.sum("n").alias("n")).where("n > 0")
    marginals = materialize(marginals, path=f"{path}/marginals")
    eligible = marginals.where((F.col("n") >= min_together) & (F.col("n") * min_lift <= n_baskets)).select("item")
    tracked = materialize(_coded(eligible, None if state is None else state.tracked), path=f"{path}/tracked")
    live = _small(tracked.where("live").select("item", "code"))

    # the tracked items of the baskets that an update touches, before and after it
    none = spark.createDataFrame([], "basket string, code int")
    if state is None:
        before, after = none, materialize(delta.join(live, "item").select("basket", "code"), "after")
    else:
        was = state.tracked.where("live").select("item", F.col("code").alias("was"))
        turned = tracked.join(was, "item", "left").where(F.col("live") != F.col("was").isNotNull()).select("item")
        turned = _small(materialize(turned, "turned"))
        everything = old_log.unionByName(delta.select("basket", "item", F.col("sign").cast("int").alias("sign")))
        moved = delta.join(_small(tracked.select("item")), "item", "left_semi").select("basket").unionByName(everything.join(turned, "item", "left_semi").select("basket")).distinct()
        moved = _small(materialize(moved, "moved"))
        here = old_log.withColumn("late", F.lit(0)).unionByName(delta.select("basket", "item", F.col("sign").cast("int").alias("sign"), F.lit(1).alias("late")))
        here = here.join(moved, "basket", "left_semi").join(_small(tracked), "item")
        here = here.groupBy("basket", "code").agg(F.sum(F.when(F.col("late") == 0, F.col("sign")).otherwise(0)).alias("old"), F.sum("sign").alias("new"), F.first("live").alias("live"))
        here = materialize(here.join(F.broadcast(was.select(F.col("was").alias("code"), F.lit(True).alias("lived"))) if was.count() * 40 <= BROADCAST_BYTES else was.select(F.col("was").alias("code"), F.lit(True).alias("lived")), "code", "left"), "here")
        before = here.where("old > 0 and lived").select("basket", "code")
        after = here.where("new > 0 and live").select("basket", "code")

    # at most min_together - 1 baskets are wide; once wide, a basket stays so
    was_wide = [tuple(r) for r in state.wide.collect()] if state else []
    sizes = materialize(after.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ITEMS), "sizes")
    room = min(min_together - 1, WIDE_BASKETS) - len(was_wide)
    fresh = sizes.where(F.col("n") > wide_items).where(~F.col("basket").isin([b for b, _ in was_wide])).orderBy(F.desc("n"), "basket").limit(max(0, room)).collect()  # at most min_together - 1 rows
    wide_rows = was_wide + [(r[0], len(was_wide) + i) for i, r in enumerate(fresh)]
    wide = materialize(spark.createDataFrame(wide_rows, "basket string, bit int"), path=f"{path}/wide")
    old_wide, now_wide = [b for b, _ in was_wide], [b for b, _ in wide_rows]
    wide_members = after.where(F.col("basket").isin(now_wide))
    if state:
        wide_members = wide_members.unionByName(state.wide_members.join(moved, "basket", "left_anti"))
    wide_members = materialize(wide_members, path=f"{path}/wide_members")

    now = after.where(~F.col("basket").isin(now_wide))
    if state is None:
        rows = now.select("basket", "code", F.lit(1).alias("sign"))
        deltas = signed_pairs(rows, sizes.where(~F.col("basket").isin(now_wide)))
    else:
        changed = materialize(signed_difference(before.where(~F.col("basket").isin(old_wide)), now), "changed")
        stayed = now.join(changed.where("sign > 0").select("basket", "code"), ["basket", "code"], "left_anti").select("basket", "code", F.lit(0).alias("sign"))
        stayed = stayed.join(changed.select("basket").distinct(), "basket", "left_semi")
        rows = materialize(changed.unionByName(stayed), "rows")
        deltas = signed_pairs(rows, materialize(rows.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ITEMS), "sizes"))
    bucket = F.pmod(F.hash("a", "b"), F.lit(buckets)).alias("bucket")
    counted = deltas.groupBy("a", "b").agg(F.sum("sign").alias("n")).where("n != 0").select("a", "b", "n", bucket)
    pairs_path, log = f"{path}/pairs", (state.pairs if state else ())
    _write_pairs(counted, pairs_path)
    new = _log(spark, (pairs_path,), _PAIRS)
    least = max(1, min_together - len(wide_rows))
    if state is None or len(wide_rows) != len(was_wide) or min_together != state.min_together:
        likely = _log(spark, (*log, pairs_path), _PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    else:
        # only pairs that the update touched are counted again
        keys = _small(new.select("a", "b"))
        touched_pairs = _log(spark, log, _PAIRS).select("a", "b", "n").join(keys, ["a", "b"], "left_semi").unionByName(new.select("a", "b", "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
        likely = state.likely.join(keys, ["a", "b"], "left_anti").unionByName(touched_pairs.where(F.col("n") >= least))
    likely = materialize(likely, path=f"{path}/likely")
    memberships, parts = ((*state.memberships, f"{path}/memberships") if state else (f"{path}/memberships",)), (*log, pairs_path)
    if len(parts) > MAX_PARTS:
        materialize(_net(_log(spark, memberships, _LOG)).withColumn("sign", F.lit(1)), path=f"{path}/merged_memberships")
        _write_pairs(_log(spark, parts, _PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n != 0").select("a", "b", "n", bucket), f"{path}/merged_pairs")
        memberships, parts = (f"{path}/merged_memberships",), (f"{path}/merged_pairs",)
    return PairTable(memberships, marginals, tracked, wide, wide_members, parts, likely, n_baskets, min_together)


def _write_pairs(counted: DataFrame, path: str) -> None:
    """The rows are in place by bucket before they are written, so a part has few files."""
    # buckets are cut further, as the cluster's parallelism asks, so no task has to write a whole one
    cuts = max(1, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    counted.repartition("bucket", F.pmod(F.xxhash64("a", "b"), F.lit(cuts))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _coded(eligible: DataFrame, known: DataFrame | None) -> DataFrame:
    """``item, code, live``: items keep the number they once got; new ones are numbered on, in hash parts side by side."""
    first, fresh = 0, eligible
    if known is not None:
        last = known.agg(F.max("code")).first()[0]
        first = 0 if last is None else last + 1
        fresh = eligible.join(known, "item", "left_anti")
    parts = fresh.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(PARTS)).cast("int"))
    sizes = {r[0]: r[1] for r in parts.groupBy("part").count().collect()}  # at most PARTS rows
    starts, at = [], first
    for part, n in sorted(sizes.items()):
        starts.append((part, at))
        at += n
    offsets = F.broadcast(eligible.sparkSession.createDataFrame(starts, "part int, start bigint"))
    nth = F.row_number().over(W.partitionBy("part").orderBy("item")) - 1
    numbered = parts.withColumn("nth", nth).join(offsets, "part").select("item", (F.col("start") + F.col("nth")).cast("int").alias("code"), F.lit(True).alias("live"))
    if known is None:
        return numbered
    live = eligible.withColumn("live", F.lit(True))
    return known.drop("live").join(live, "item", "left").select("item", "code", F.coalesce("live", F.lit(False)).alias("live")).unionByName(numbered)


def signed_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Memberships only in ``after`` with sign 1, only in ``before`` with sign -1."""
    both = before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))
    return both.groupBy(*before.columns).agg(F.sum("sign").cast("int").alias("sign")).where("sign != 0")


def signed_pairs(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``a, b, sign`` of every pair of codes that the changes in ``rows(basket, code, sign)`` touch; sign 0 is a member that stayed.

    Per basket: a came or went together with a kept item, or two came, or two went. ``sizes`` names the baskets of more than
    one block; their items are put into blocks of bounded size by hash, and each pair of blocks is a row of its own, so no
    task has to emit a whole large basket.
    """
    large = sizes.select("basket", F.ceil(F.col("n") / BLOCK_ITEMS).cast("int").alias("blocks"))
    entries = F.sort_array(F.collect_list(F.struct("code", "sign")))
    some = not large.isEmpty()
    small = rows.join(large, "basket", "left_anti") if some else rows
    either = small.groupBy("basket").agg(entries.alias("left")).where(F.size("left") > 1).select("left", F.lit(True).alias("same"), F.col("left").alias("right"))
    if some:
        placed = rows.join(large, "basket").withColumn("block", F.pmod(F.hash("code"), F.col("blocks")))
        blocks = materialize(placed.groupBy("basket", "block", "blocks").agg(entries.alias("left")), "blocks")
        first = blocks.select("basket", "block", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"), "left")
        second = blocks.select("basket", F.explode(F.sequence(F.lit(0), "block")).alias("block"), F.col("block").alias("other"), F.col("left").alias("right"))
        either = either.unionByName(first.join(second, ["basket", "block", "other"]).select("left", (F.col("block") == F.col("other")).alias("same"), "right"))
    singles = either.select(F.posexplode("left").alias("at", "x"), "same", "right")
    others = F.when(F.col("same"), F.slice("right", F.col("at") + 2, F.size("right"))).otherwise(F.col("right"))
    pairs = singles.select("x", F.explode(others).alias("y"))
    # the sign of the change; one came and the other went: they never were together
    sign = F.when(F.col("x.sign") == F.col("y.sign"), F.col("x.sign")).when(F.col("x.sign") * F.col("y.sign") == 0, F.col("x.sign") + F.col("y.sign")).otherwise(0)
    return pairs.select(F.least("x.code", "y.code").alias("a"), F.greatest("x.code", "y.code").alias("b"), sign.alias("sign")).where("sign != 0")


def associations(state: PairTable, min_together: int | None = None, min_lift: float = MIN_LIFT) -> DataFrame:
    """Pairs passing both thresholds: ``item_a, item_b, n_together, n_a, n_b, expected, lift``.

    ``expected`` is n_a * n_b / n_baskets, ``lift`` the ratio of n_together to it. ``min_together`` is not less than that of
    the updates. Only the likely pairs are scored. The wide baskets' contribution is added here: each item carries a bit per
    wide basket, and two items share as many of these baskets as their bits agree.
    """
    min_together = state.min_together if min_together is None else min_together
    if min_together < state.min_together:
        raise ValueError("pairs below the min_together of the updates are not kept")
    items = state.tracked.where("live").join(state.marginals, "item").select("code", "item", F.col("n").alias("n_item"))
    bits = state.wide_members.join(F.broadcast(state.wide), "basket").groupBy("code").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))  # at most WIDE_BASKETS rows are broadcast
    items = items.join(bits, "code", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("bigint")))
    needed = _small(materialize(state.likely.select(F.explode(F.array("a", "b")).alias("code")).distinct(), "needed"))
    items = materialize(items.join(needed, "code", "left_semi"), "items")
    end = lambda x: items.select(F.col("code").alias(x), F.col("item").alias(f"item_{x}"), F.col("n_item").alias(f"n_{x}"), F.col("mask").alias(f"mask_{x}"))
    scored = state.likely.join(end("a"), "a").join(end("b"), "b").withColumn("n_together", F.col("n") + F.bit_count(F.col("mask_a").bitwiseAND(F.col("mask_b"))))
    product = F.col("n_a").cast("double") * F.col("n_b")
    swap = F.col("item_a") > F.col("item_b")
    ordered = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)
    return scored.where((F.col("n_together") >= min_together) & (F.col("n_together") * F.lit(float(state.n_baskets)) >= min_lift * product)).select(
        ordered("item_a", "item_b"), ordered("item_b", "item_a"), "n_together", ordered("n_a", "n_b"), ordered("n_b", "n_a"),
        (product / state.n_baskets).alias("expected"), (F.col("n_together") * F.lit(float(state.n_baskets)) / product).alias("lift"),
    )


def memberships(rows: DataFrame, basket: Column, item: Column) -> DataFrame:
    """``basket, item`` as strings."""
    return rows.select(basket.cast("string").alias("basket"), item.cast("string").alias("item"))
