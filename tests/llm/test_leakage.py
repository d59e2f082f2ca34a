import random

import numpy as np
from pyspark.sql import functions as F

from sidforge.llm import leakage as L
from sidforge.llm import words as W

OPENING = "Please read the shopper history below and recommend the next item."


def sentence(rng):
    return " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(900)) for _ in range(18)).capitalize() + "."


def passages(rng, n):
    return [[OPENING] * (i % 2) + [sentence(rng) for _ in range(5)] for i in range(n)]


def changed(text, rng, share):
    return " ".join("zz9" if rng.random() < share else w for w in text.split())


def leaks(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("eval_id", F.lit("clash")).withColumn("passage", F.lit(1))
    e = spark.createDataFrame(items, "eval_id bigint, passage string").withColumn("text", F.lit(0))
    return sorted((r["doc_id"], r["eval_id"]) for r in L.leaked_passages(d, "doc_id", "text", e, "eval_id", "passage", **more).collect())


def test_planted_leaks(spark):
    rng = random.Random(4)
    p = passages(rng, 30)
    items = [(100 + i, " ".join(x)) for i, x in enumerate(p)]
    filler = lambda n: " ".join(sentence(rng) for _ in range(n))
    docs = [
        (0, items[0][1]),
        (1, filler(3) + " " + " ".join(p[1][-3:]) + " " + filler(400)),
        (2, filler(2) + " " + changed(items[2][1], rng, 0.03) + " " + filler(2)),
        (3, filler(5) + " " + p[3][-1] + " " + filler(5)),  # one sentence
        (4, OPENING + " " + filler(6)),  # a standard opening
        (5, filler(30)),
        (6, None), (7, ""), (8, "   "), (9, items[9][1].upper().replace(" ", "​ ​")),
        (10, " ".join(p[10]) + " " + " ".join(p[11])),
        (0, items[0][1]),
    ]
    wanted = [(0, 100), (0, 100), (1, 101), (2, 102), (9, 109), (10, 110), (10, 111)]
    assert leaks(spark, docs, items) == wanted
    assert leaks(spark, docs, items, items_per_pass=7) == wanted


def test_standard_opening_counts_beside_own_sentences(spark):
    rng = random.Random(7)
    own = [sentence(rng) for _ in range(5)]
    # 36 of 101 words in two own sentences, 47 with the opening; the threshold lies between
    items = [(1, " ".join([OPENING, *own])), (2, " ".join([OPENING, *(sentence(rng) for _ in range(5))]))]
    filler = " ".join(sentence(rng) for _ in range(4))
    docs = [(1, " ".join([OPENING, *own[:2], filler])), (2, " ".join([OPENING, filler])), (3, " ".join([OPENING, own[0], filler])), (4, " ".join([*own[:2], filler]))]
    assert leaks(spark, docs, items, min_share=0.4) == [(1, 1)]


def test_odd_items(spark):
    rng = random.Random(5)
    text = " ".join(sentence(rng) for _ in range(5))
    docs = [(1, text)]
    # repeated passages each leak; short, empty and null ones never do; a null id is no item
    assert leaks(spark, docs, [(1, text), (2, text), (3, "too short"), (4, ""), (5, None), (None, text)]) == [(1, 1), (1, 2)]
    assert leaks(spark, docs, []) == [] and leaks(spark, [], [(1, text)]) == []


def test_blocks_share_what_is_known_of_all_passages(spark):
    """Passages that share sentences, spread over passes: the same rows whatever the number of passages a pass."""
    rng = random.Random(8)
    common = [sentence(rng) for _ in range(6)]
    # every passage shares three of its six sentences with passages of other families; the last ones are revisions of the first
    p = [[sentence(rng), *rng.sample(common, 1), sentence(rng), *rng.sample(common, 1), sentence(rng), *rng.sample(common, 1)] for _ in range(18)]
    p += [[*x[:5], sentence(rng)] for x in p[:3]]
    items = [(i, " ".join(x)) for i, x in enumerate(p)]
    filler = " ".join(sentence(rng) for _ in range(6))
    docs = [(i, f"{filler} {' '.join(x)} {filler}") for i, x in enumerate(p)] + [(50 + i, f"{filler} {' '.join(x[1::2])}") for i, x in enumerate(p[:18])]
    rng.shuffle(items)
    whole = leaks(spark, docs, items)
    assert {(i, i) for i in range(21)} <= set(whole) and all(d < 50 for d, _ in whole)
    assert leaks(spark, docs, items, items_per_pass=7) == whole and leaks(spark, docs, items[::-1], items_per_pass=4) == whole


def test_candidates_miss_nothing(spark):
    rng = random.Random(6)
    p = passages(rng, 20)
    items = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(p)], "eval_id bigint, passage string")
    index = L.Passages(L.described_passages(items, "eval_id", "passage").orderBy("item").collect())
    for i, x in enumerate(p):
        words, _ = W.word_hashes([changed(" ".join(sentence(rng) for _ in range(200)) + " ".join(x[-3:]), rng, 0.02)])
        h = W.shingles(words)
        assert (0, i) in index.candidates(h, np.array([0, len(h)])) and index.worth(h, np.array([0, len(h)])).tolist() == [0]


def test_sketch_is_the_least_of_each_bin():
    h = np.random.default_rng(1).integers(0, 2**64, 300, dtype=np.uint64)
    least = {}
    for key in (h >> np.uint64(64 - L.BIN_BITS - 32)).tolist():
        least[key >> 32] = min(key, least.get(key >> 32, key))
    assert L.sketch(h).tolist() == sorted(least.values()) and len(L.sketch(h[:0])) == 0


def test_word_hashes_follow_the_words(monkeypatch):
    texts = ["One two, ONE! \ud55c\uad6d x_1", "", "two", "  \u00e9t\u00e9 e\u0301te\u0301 "]
    h, bounds = W.word_hashes(texts)
    assert bounds.tolist() == [0, 7, 7, 8, 10] and h[0] == h[2] and h[1] == h[7] and h[8] == h[9] and len(set(h[[0, 1, 3, 4, 5, 6, 8]].tolist())) == 7
    monkeypatch.setattr(W, "PART_CHARS", 4)
    W._powers.cache_clear()
    again, _ = W.word_hashes(texts)
    W._powers.cache_clear()
    assert again.tolist() == h.tolist()


def test_normal_text():
    assert W.normal("Gr\\u00f6\\u00dfe &amp; <p>Us\u0435r\u200b</p>\\n\u00e9e\u0301") == W.normal("Gr\u00f6\u00dfe & User\n\u00e9\u00e9").replace("user", " user").replace("\n", " \n")
