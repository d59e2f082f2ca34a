import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sidforge.functions import sid as S
from sidforge.functions import vectors as V
from sidforge.functions.text import WHITESPACE, clean_id, item_text, pytrim
from sidforge.sources import validate


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], ", ".join(f"{k} {t}" for k, (_, t) in values.items()))
    return df.select(column).first()[0]


def test_trim_is_that_of_python(spark):
    assert sorted(WHITESPACE) == [chr(i) for i in range(0x110000) if chr(i).isspace()]
    for text in ["  a b\t", "　x ", "\x1cx\x1f", "​x", " ", ""]:
        assert one(spark, pytrim("t"), t=(text, "string")) == text.strip()
    assert one(spark, clean_id("t"), t=(" ", "string")) is None and one(spark, clean_id("t"), t=(None, "string")) is None


META = "parent_asin string, title string, store string, main_category string, categories array<string>, features array<string>, description array<string>"


def test_item_text(spark):
    rows = [
        ("p", " T ", None, " ", ["a", " ", None, *map(str, range(20))], [], ["d1", "d2", "d3", "d4", "d5"]),
        ("p", None, "", None, None, [" "], []),
        (None, None, None, None, None, None, None),
    ]
    texts = [r[0] for r in spark.createDataFrame(rows, META).select(item_text()).collect()]
    assert texts[0] == "Title: T\nCategories: a; None; 0; 1; 2; 3; 4; 5; 6; 7\nDescription: d1 d2 d3 d4"
    assert texts[1:] == ["Item id: p", "Item id: "]


def test_sid_and_codes(spark):
    assert one(spark, S.sid_from_codes("c"), c=([1, 22, 3], "array<bigint>")) == "<|sid_begin|><s_a_1><s_b_22><s_c_3><|sid_end|>"
    assert one(spark, S.sid_from_codes("c"), c=([], "array<bigint>")) == "<|sid_begin|><|sid_end|>"
    assert one(spark, S.sid_from_codes("c"), c=([1, None], "array<bigint>")) is None
    assert one(spark, S.parse_sid("s"), s=("x<s_c_7> y <s_a_08>", "string")) == [7, 8]
    assert one(spark, S.parse_sid("s"), s=("<s_A_1>", "string")) is None and one(spark, S.parse_sid("s"), s=(None, "string")) is None
    for bad in ([1, 2], [1, 2, 3, 4], None, [1, None, 3]):
        with pytest.raises(PySparkException):
            one(spark, S.sid_from_exact("c"), c=(bad, "array<bigint>"))
    with pytest.raises(PySparkException):
        one(spark, S.sid_from_codes("c"), c=(list(range(27)), "array<bigint>"))


@pytest.mark.parametrize(
    "text, codes",
    [
        ("[1,2,3]", [1, 2, 3]), ("1,2,3", [1, 2, 3]), ("[1, 2.7]", [1, 2]), ("[-2.7]", [-2]), ('["1"," 2"]', [1, 2]), ("[1e3]", [1000]), ("5", None), ("[a,b]", None), ("[]", []), ("", None), (" ", None), (None, None),
        ('["2.7"]', None), ("[true, false]", [1, 0]), ("[null]", None), ("[[1]]", None), ('{"a": 1}', None), ("[1,,2", [1, 2]), ("[1] x", None), ("[1],[2]", None), ("2.5,1", None), ("null", None),
    ],
)
def test_parse_codes(spark, text, codes):
    assert one(spark, S.parse_codes("t"), t=(text, "string")) == codes


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=26))
def test_sid_round_trip(spark, codes):
    assert one(spark, S.parse_sid(S.sid_from_codes("c")), c=(codes, "array<bigint>")) == codes


def test_vectors(spark):
    assert one(spark, V.unit(F.col("v")), v=([3.0, 4.0], "array<double>")) == [0.6, 0.8]
    assert one(spark, V.unit(F.col("v")), v=([0.0, 0.0], "array<double>")) == [0.0, 0.0]
    for v, good in (([1.0, 0.0], True), ([0.0, 0.0], False), ([math.nan, 1.0], False), ([math.inf, 1.0], False), ([1.0], False), ([], False), (None, False), ([None, 1.0], False)):
        assert one(spark, V.usable(F.col("v"), 2), v=(v, "array<double>")) is good
    hidden = ([[1.0], [2.0], [3.0]], "array<array<double>>")
    for mask, left, wanted in (([1, 1, 0], False, 2.0), ([0, 1, 1], True, 3.0), ([1, 1, 1], True, 3.0)):
        assert one(spark, V.last_token(F.col("h"), F.col("m"), F.lit(left)), h=hidden, m=(mask, "array<int>")) == [wanted]


def test_options():
    assert validate.parse_sizes("256", 3) == [256] * 3 and validate.parse_sizes("4, 5", 2) == [4, 5]
    assert validate.parse_layers("all", 3) == [0, 1, 2] and validate.parse_layers("c,0,A", 3) == [0, 2]
    assert validate.parse_number_type("BF16") == "bfloat16"
    for call in (lambda: validate.parse_sizes("", 3), lambda: validate.parse_sizes("1,2", 3), lambda: validate.parse_sizes("0", 1), lambda: validate.parse_layers("d", 3), lambda: validate.parse_layers("-1", 3), lambda: validate.parse_number_type("int8")):
        with pytest.raises(ValueError):
            call()
