import random

import pytest
from pyspark.sql import functions as F

from sidforge.functions.text import clean_id, epoch_millis
from sidforge.operators import dense_keys
from sidforge.operators.dense_keys import dense_key_totals, dominant_keys
from sidforge.operators.sessions import sessionize


def brute_sessions(events, gap):
    by = {}
    for u, i, m in {e for e in events if e[0] is not None and e[2] is not None}:
        by.setdefault(u, []).append(m)
    out = []
    for u, times in by.items():
        times.sort()
        start = prev = times[0]
        n = 1
        for t in times[1:]:
            if t - prev > gap:
                out.append((u, start, prev, n))
                start, n = t, 0
            prev, n = t, n + 1
        out.append((u, start, prev, n))
    return sorted(out)


def sessions(spark, events, **more):
    df = spark.createDataFrame(events, "u string, i string, m bigint")
    df = df.withColumn("bucket", F.lit("clash")).withColumn("user_id", F.lit(0)).withColumn("n", F.lit(None).cast("int"))
    found = sessionize(df, F.col("u"), F.col("m"), (F.col("i"),), **more)
    return sorted(tuple(r) for r in found.select("user_id", "start_ms", "end_ms", "n_interactions").collect())


@pytest.mark.parametrize("seed", range(4))
def test_sessions_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    events = [(rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", None]), rng.choice([None, *[rng.randrange(-500, 3000)] * 9])) for _ in range(500)]
    assert sessions(spark, events, gap_ms=10, bucket_ms=50) == brute_sessions(events, 10)


def test_session_edges(spark):
    assert sessions(spark, []) == []
    assert sessions(spark, [(None, "x", 1), ("a", "x", None)]) == []
    # exactly the gap stays together, one more parts; equal rows count once, null items are equal
    events = [("a", "x", 0), ("a", "x", 0), ("a", "y", 0), ("a", None, 10), ("a", None, 10), ("a", "z", 21)]
    assert sessions(spark, events, gap_ms=10, bucket_ms=10) == [("a", 0, 10, 3), ("a", 21, 21, 1)]
    with pytest.raises(ValueError):
        sessions(spark, [], gap_ms=10, bucket_ms=5)


def test_one_user_with_most_rows(spark):
    events = [("hot", str(i % 7), i * 3) for i in range(4000)] + [("cold", "x", 5)]
    assert sessions(spark, events, gap_ms=10, bucket_ms=100) == [("cold", 5, 5, 1), ("hot", 0, 11997, 4000)]


def test_timestamps(spark):
    texts = ["1546328465458", " 1546328465458 ", "1546328465", "1546328465458.0", "2019-01-02T06:33:43.866+02:00", "2019-01-02T04:33:43Z", "2023-13-45T99:00:00Z", "2019", "nan", "", None, "1000", "99999999999999999999"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r[0] for r in df.orderBy("i").select(epoch_millis("t")).collect()]
    assert found == [1546328465458, 1546328465458, 1546328465000, 1546328465458, 1546403623866, 1546403623000] + [None] * 7


@pytest.mark.parametrize("flush", [3, 100_000])
def test_dense_totals_equal_counts(spark, flush):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + [None, "", "ä", *map(str, range(40))]), rng.choice([None, 1.0, 2.5])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("key", F.lit(1)).repartition(5)
    found = {r["key"]: (r["n_rows"], r["value_sum"]) for r in dense_key_totals(df, F.col("k"), F.col("v"), blocks=4, fan=2, flush_keys=flush).collect()}
    wanted = {k: (sum(1 for x in rows if x[0] == k), sum(x[1] or 0 for x in rows if x[0] == k)) for k in {r[0] for r in rows}}
    assert found == wanted


def test_dominant_keys(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2 + [(None,)] * 4 + [(" ",)] * 4, "k string")
    assert [(r["key"], r["n_rows"]) for r in dominant_keys(df, clean_id("k"), 0.3).collect()] == [("a", 6)]
    assert {r["key"] for r in dominant_keys(df, clean_id("k"), 0.125).collect()} == {"a", "b"}
    assert dense_key_totals(df.limit(0), F.col("k")).collect() == []
    assert dominant_keys(df.limit(0), F.col("k"), 0.1).collect() == []


def test_blocks_follow_the_keys(spark, monkeypatch):
    monkeypatch.setattr(dense_keys, "BLOCK_KEYS", 20)
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") % 500).alias("key")).repartition(9)
    blocks, fan = dense_keys._shape(df)
    assert 20 <= blocks <= 32 and fan == 3
    assert {r["n_rows"] for r in dense_key_totals(df, F.col("key")).collect()} == {2}
