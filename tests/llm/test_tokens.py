import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sidforge.llm import splitting as P
from sidforge.llm import tokens as T

TEXT = st.one_of(st.text(max_size=120), st.text(alphabet=" \n\t'sdtlve中é​\xa0。1２!aA", max_size=200))


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 20))
def test_tree_equals_direct(text, leaf):
    codec = T.Codec(leaf_chars=leaf)
    assert codec.encode(text) == codec.direct(text)
    assert codec.decode_bytes(codec.encode(text)).decode() == text


@pytest.mark.parametrize("text", ["a" * 30_000, "中文字符" * 9_000, " " * 20_000, "ab1'" * 9_000, "'s" * 9_000, "\n" * 9_999 + "x", "é" * 9_000, "<|endoftext|>" * 2_000])
def test_long_unsplit_texts(text):
    assert T.codec().encode(text) == T.codec().direct(text)


def test_same_ids_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(T.VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    for text in ["Hello wörld's  <|endoftext|>\n\n 12ab", "", "日本語 テキスト", " \x85 x"]:
        assert T.codec().encode(text) == other.encode(text, add_special_tokens=False).ids


def test_encode_texts(spark):
    long = "lorem ipsum " * 30_000 + "x" * 50_000
    rows = [(1, None), (2, ""), (3, " "), (4, "ab"), (4, "ab"), (None, "ab"), (5, long), (5, long), (6, long + "!")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash")).withColumn("leaf", F.lit(None).cast("int"))
    for spread in (1_000_000, 100_000):
        found = sorted(((r["doc_id"] or 0), list(r["ids"])) for r in T.encode_texts(df, "doc_id", "text", spread_chars=spread).collect())
        assert found == sorted((k or 0, T.codec().direct(t or "")) for k, t in rows)
    assert T.encode_texts(df.limit(0), "doc_id", "text").collect() == []


def pieces_hold(text, max_tokens, overlap):
    codec = T.codec()
    pieces = P.split_text(text, codec, max_tokens, overlap)
    total = len(codec.direct(text))
    if total <= max_tokens:
        assert len(pieces) == (1 if total else 0)
        return pieces
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b in zip(pieces, pieces[1:]):
        assert b[0] <= a[1] < b[1] and a[0] < b[0]
    for begin, end, size, shared, _ in pieces:
        assert size == len(codec.direct(text[begin:end])) <= max_tokens and 0 <= shared <= overlap
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab c.\n,中。1'", max_size=1500))
def test_pieces_cover_the_text_within_the_limit(text):
    pieces_hold(text, 48, 8)


def test_pieces_of_words_share_about_the_overlap():
    pieces = pieces_hold("one two three four. " * 900, 1024, 64)
    assert all(60 <= p[3] <= 64 for p in pieces[1:]) and all(p[4] >= P.SENTENCE for p in pieces[1:])
    for run in ("x" * 20_000, "中" * 9_000, " " * 9_000, "é́" * 4_000):
        pieces_hold(run, 1024, 64)


def test_stronger_boundaries_survive():
    text = "\n\n".join(" ".join(["word"] * 30) + "." for _ in range(6))
    pieces = pieces_hold(text, 80, 8)
    assert all(p[4] == P.PARAGRAPH for p in pieces)


def test_split_oversized(spark):
    rows = [(1, None), (2, ""), (3, "short"), (4, "word " * 3000), (4, "word " * 3000), (5, " " * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("piece_no", F.lit("clash"))
    found = P.split_oversized(df, "doc_id", "text").collect()
    assert {r["doc_id"] for r in found} == {k for k, t in rows if len(T.codec().direct(t or "")) > 1024}
    assert sum(r["piece_no"] == 0 and r["doc_id"] == 4 for r in found) == 2
    assert P.split_oversized(df.limit(0), "doc_id", "text").collect() == []
    with pytest.raises(ValueError):
        P.split_oversized(df, "doc_id", "text", overlap=1024)
