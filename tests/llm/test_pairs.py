import itertools
import random

import pytest

from sidforge.llm import pairs as P
from sidforge.session import scratch_path


def brute(rows, m, lift):
    sets = {}
    for b, i in rows:
        if b is not None and i is not None:
            sets.setdefault(b, set()).add(i)
    n, count, pair = len(sets), {}, {}
    for s in sets.values():
        for i in s:
            count[i] = count.get(i, 0) + 1
        for a, b in itertools.combinations(sorted(s), 2):
            pair[a, b] = pair.get((a, b), 0) + 1
    return sorted((a, b, c, count[a], count[b]) for (a, b), c in pair.items() if c >= m and c * n >= lift * count[a] * count[b])


def table(spark, rows):
    return spark.createDataFrame(rows, "basket string, item string")


def scores(state, m, lift):
    return sorted((r["item_a"], r["item_b"], r["n_together"], r["n_a"], r["n_b"]) for r in P.associations(state, m, lift).collect())


def log(rng, n):
    groups = [f"g{k}" for k in range(12)]
    out = []
    for _ in range(n):
        u = rng.choice([None, "hot", *(f"u{k}" for k in range(40))])
        g = rng.choice(groups)
        out.append((u, rng.choice([None, g + rng.choice("abc"), "everywhere", f"rare{rng.randrange(300)}"])))
    return out + [("hot", f"{g}{x}") for g in groups for x in "abc"]


@pytest.mark.parametrize("wide, block", [(2000, 256), (20, 256), (2000, 7), (12, 5)])
def test_updates_equal_a_full_count(spark, monkeypatch, wide, block):
    monkeypatch.setattr(P, "BLOCK_ITEMS", block)
    rng = random.Random(wide + block)
    m, lift, rows = 3, 1.2, []
    state = None
    for step in range(3):
        added = log(rng, 700)
        removed = rng.sample(rows, 60) if rows else []
        rows = [r for r in rows + added if r not in set(removed)]
        state = P.update_pairs(spark, state, table(spark, added), table(spark, removed) if removed else None, m, lift, 4, wide)
        wanted = brute(rows, m, lift)
        assert scores(state, m, lift) == wanted, step
    assert wanted


def test_empty_and_repeated(spark):
    state = P.update_pairs(spark, None, table(spark, []))
    assert scores(state, 12, 5) == []
    rows = [(f"u{i}", x) for i in range(12) for x in "ab"] + [(f"v{i}", "c") for i in range(60)]
    state = P.update_pairs(spark, None, table(spark, rows + rows), path=scratch_path(spark, "pairs"))
    assert scores(state, 12, 5) == [("a", "b", 12, 12, 12)]
    again = P.update_pairs(spark, state, table(spark, rows))
    assert scores(again, 12, 5) == [("a", "b", 12, 12, 12)]
    gone = P.update_pairs(spark, again, table(spark, []), table(spark, [("u0", "a")]))
    assert scores(gone, 12, 5) == []
