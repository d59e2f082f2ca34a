import numpy as np
import pytest
from pyspark.sql import functions as F

from sidforge.llm import listings as L

SCHEMA = "row_no bigint, parent_asin string, title string, store string, categories array<string>, description array<string>"


def test_facts():
    assert L.size_of("jug 12 litres") == ("v", 12000.0) and L.size_of('lamp 17.7" x2')[0] == "d" and L.size_of("no. 5 lamp") is None
    for a, b in (("250 ml", "8.5 fl. ounces"), ("0.15 kg", "5.3 oz"), ("450mm", "17.7 in"), ("25l", "6.6 gal"), ("0.55 lb", "250 grams")):
        assert L.size_of(a)[0] == L.size_of(b)[0] and abs(np.log(L.size_of(a)[1] / L.size_of(b)[1])) < L.SIZE_SLACK
    for text, n in (("pack of 4", 4), ("set of three", 3), ("x6 jar", 6), ("6 pcs", 6), ("2-pack", 2), ("two pieces", 2), ("jar", None)):
        assert L.pack_of(text) == n
    for text, colour in (("rose pink mat", "pink"), ("Blue-green".lower(), "teal"), ("navy blue", "navy"), ("off-white", "cream"), ("plain", None)):
        assert L.colour_of(text) == colour
    assert L.slips_between("quigloxo", "quiglooxo") and L.slips_between("abcd", "abdc", 1) and not L.slips_between("abcdef", "uvwxyz")


def test_training_brings_wordings_of_one_listing_together():
    rng = np.random.default_rng(0)
    syllables = ["pla", "vra", "kle", "zwe", "xo", "qui", "fo", "mu", "slo", "cre", "dri", "ja"]
    talk = [f"talk{i}" for i in range(30)]
    names = ["".join(rng.choice(syllables, 3)) for _ in range(400)]
    texts = [[f"brand{rng.integers(8)}", n, f"kind{rng.integers(5)}", *rng.choice(talk, 6)] for n in names]
    counts = np.zeros(L.RARITY_SLOTS, np.int64)
    for t in texts:
        counts[list({L.word_slot(w) for w in t})] += 1
    others = [[t[0], L.slip(t[1], rng), *rng.choice(talk, 8)] for t in texts]

    def margin(encoder):
        s = encoder(texts) @ encoder(others).T
        own = np.diag(s).copy()
        np.fill_diagonal(s, -1)
        return float((own > s.max(axis=1)).mean()), float(own.mean() - s.mean())

    raw, trained = margin(L.Encoder(counts, 400)), margin(L.Encoder(counts, 400).train(texts))
    assert trained[0] >= 0.75 and trained[1] > raw[1]


def test_counts_of_texts_by_word(spark):
    df = spark.createDataFrame([("a b a",), ("b c",), ("b",)], "text string").repartition(3)
    counts = L.texts_by_word(df)
    assert [int(counts[L.word_slot(w)]) for w in "abc"] == [1, 3, 1] and counts.sum() == 5


@pytest.fixture(scope="module")
def catalogue():
    kinds = {"Storage": ["Seasoning Jar", "Herb Container", "Spice Jar"], "Walking": ["Leash", "Dog Lead", "Walking Lead"]}
    lines = [("Novumi", "Plavrakle", "Storage", "Size: 250 ml.", '8.5 fl oz'), ("Limixo", "Prislodro", "Walking", 'Stated size 45 cm.', '17.7"'), ("Briard", "Vesheha", "Walking", "Size: 90 cm.", "0.9 m"), ("Galury", "Distivra", "Storage", "Size: 1 L.", "1000ml")]
    rows, n = [], 0
    for b, s, group, said, size in lines:
        for colour, other in (("black", "Jet Black"), ("green", "fern green")):
            for k in range(6):
                kind, leaf = kinds[group][k % 3], kinds[group][(k + 1) % 3]
                title = [f"{b} {s} {kind} {size} {other}", f"BEST SELLER! {b.upper()} {s.upper()} {kind.upper()}", f"{other} {kind} {s} - premium", f"{s} {kind}, {size}, {colour} best seller", f"premium {b} {s} {leaf} {size}", f"{b} {s} {kind} | {size}"][k]
                rows.append((n, f"I{n:03d}", title, [b, f"{b} Official", f"Visit the {b} Store"][k % 3], ["Home", group, leaf], [f"Made by {b}, series {s}. {said} Colour: {other}. Our {leaf.lower()} is best."]))
                n += 1
    return rows


def groups(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("brand", F.lit(1))
    found = {}
    for r in L.product_groups(df, "parent_asin", "row_no", "title", "store", "description", "categories").collect():
        found.setdefault(r["product"], set()).add(r["id"])
    return found


def test_groups(spark, catalogue):
    more = [
        (900, "S1", "Novumi Plavraakle spice jar, 0.25 L, matte black", None, ["Home", "Storage", "Herb Container"], []),
        (901, "R1", "Novumi Plavrakle replacement part for spice jar 250 ml black", None, None, None),
        (902, "X2", "Novumi Plavrakle spice jar 250 ml black x2", None, None, []),
        (903, "B3", "Novumi Plavrakle spice jar 500 ml black", None, None, [None]),
        (904, "N1", None, None, None, None), (905, "N2", "", " ", [], []), (906, None, "Novumi Plavrakle spice jar 250 ml black", None, None, None),
        (907, "L1", "Limixo Prislodro leash 45 cm black", None, None, None), (908, "L1", None, None, None, None),
        (909, "T1", None, "Novumi", None, ["Novumi Plavrakle spice jar.", "Size: 250ml.", "Finished in black."]),
    ]
    found = groups(spark, catalogue + more)
    assert found["I000"] == {f"I{i:03d}" for i in range(6)} | {"S1", "T1"}
    for i in range(1, 8):
        assert found[f"I{6 * i:03d}"] == {f"I{j:03d}" for j in range(6 * i, 6 * i + 6)}
    # another pack, size or a part is another product; the later, empty line of L1 counts; empty lines match nothing
    assert {"R1"} in found.values() and {"X2"} in found.values() and {"B3"} in found.values()
    assert not {"N1", "N2", "L1"} & set().union(*found.values())


def test_no_listings(spark):
    assert groups(spark, []) == {} and groups(spark, [(1, "a", None, None, None, None)]) == {}
    one = groups(spark, [(1, "a", "Zorblax Quirv lamp 10 cm red", "Zorblax", None, None)] * 3)
    assert one == {"a": {"a"}}


def test_one_product_with_most_listings(spark, catalogue):
    hot = [(1000 + i, f"H{i:04d}", ["Quorvex Zilpadi lamp 30 cm red", "red Quorvex Zilpadi lamp, 300 mm - best seller"][i % 2], "Quorvex", ["Home", "Light", "Lamp"], None) for i in range(600)]
    found = groups(spark, catalogue + hot)
    assert found["H0000"] == {f"H{i:04d}" for i in range(600)} and found["I000"] == {f"I{i:03d}" for i in range(6)}


def test_a_product_with_many_wordings_stays_whole(spark, catalogue):
    """More differing listings of one product than neighbours count, and the other groups as they are without it."""
    rng = np.random.default_rng(5)
    talk = ["practical", "reliable", "charming", "sturdy", "narrow", "glossy", "modern", "tidy"]
    hot = [(2000 + i, f"H{i:04d}", f"Quorvex Zilpadi lamp 30 cm red {' '.join(rng.choice(talk, 3))} a{i}", "Quorvex", ["Home", "Light", "Lamp"], ["Made by Quorvex, series Zilpadi."]) for i in range(150)]
    found = groups(spark, catalogue + hot)
    assert found["H0000"] == {f"H{i:04d}" for i in range(150)}
    assert {k: v for k, v in found.items() if k[0] == "I"} == groups(spark, catalogue)
