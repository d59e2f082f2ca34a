import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sidforge.operators import chat, decoding, items, ranking
from sidforge.sources import readers, validate, writers

META = "line_no bigint, parent_asin string, title string, store string, main_category string, categories array<string>, features array<string>, description array<string>"


def meta(spark, rows):
    return spark.createDataFrame([(i, k, t, None, None, None, None, None) for i, (k, t) in enumerate(rows)], META)


def test_prepare_items(spark):
    seen = spark.createDataFrame([(" a ",), ("b",), ("s",), (None,), (" ",), ("lost",)], "parent_asin string")
    target = items.MetaSource(meta(spark, [("a", "old"), ("b", "B"), ("c", "C"), ("a ", "new"), (None, "x")]), "t")
    source = items.MetaSource(meta(spark, [("s", None), ("b", "B2"), ("unseen", "U")]), "s")
    rows = {r["item_id"]: tuple(r)[1:] for r in items.prepare_items(seen, target, [source]).collect()}
    assert rows["a"][:4] == ("t", True, "Title: new", "new") and rows["a"][4:] == (0, 0)
    # the later source takes the whole record, the flag included, but not the place
    assert rows["b"] == ("s", False, "Title: B2", "B2", 0, 1)
    assert rows["s"][2] == "Item id: s" and set(rows) == {"a", "b", "c", "s"}
    labels = items.prepare_items(seen, target, [source], "labels_only")
    assert {r["item_id"] for r in labels.collect()} == {"a", "b", "s"}
    assert [r[0] for r in items.missing_items(seen, labels).collect()] == ["lost"]
    with pytest.raises(ValueError):
        items.prepare_items(seen, target, [], "some")
    with pytest.raises(ValueError):
        items.seen_items(seen.withColumnRenamed("parent_asin", "x"))


def test_sid_map(spark):
    described = spark.createDataFrame([("a", "d"), (None, "e")], "item_id string, domain string")
    codes = spark.createDataFrame([("a", [1, 2, 3]), (None, [4, 5, 6])], "pid string, codes array<bigint>")
    assert {r["domain"]: r["sid"] for r in items.build_sid_map(described, codes).collect()} == {"d": "<|sid_begin|><s_a_1><s_b_2><s_c_3><|sid_end|>", "e": "<|sid_begin|><s_a_4><s_b_5><s_c_6><|sid_end|>"}
    for left, right in (
        (described, codes.where("pid = 'a'")),
        (described.union(described), codes),
        (described, codes.union(codes)),
        (described, codes.select(F.lit(1).alias("pid"), "codes").limit(1)),
        (described.withColumnRenamed("item_id", "x"), codes),
        (described, codes.withColumnRenamed("pid", "x")),
    ):
        with pytest.raises(ValueError):
            items.build_sid_map(left, right)
    with pytest.raises(PySparkException):
        items.build_sid_map(described, codes, layers=2).collect()


def test_files(spark, tmp_path):
    csv = tmp_path / "i.csv"
    csv.write_text('user_id,parent_asin,rating,timestamp\nu,"B""2",5,1\nv,"C\nD",4,2\n\nw, E ,,\nx\n', encoding="utf-8")
    assert {r[0] for r in items.seen_items(readers.read_interactions(spark, str(csv))).collect()} == {'B"2', "C\nD", "E"}
    lines = tmp_path / "meta_toys.jsonl"
    lines.write_text('{"parent_asin": "a", "title": "1"}\n\n{"parent_asin": "a", "title": "2"}\n', encoding="utf-8")
    described = items.described_items(items.MetaSource(readers.read_metadata(spark, str(lines)), readers.domain_of(str(lines))))
    assert tuple(described.select("item_id", "domain", "title").first()) == ("a", "toys", "2")
    broken = tmp_path / "broken.jsonl"
    broken.write_text('{"parent_asin": ', encoding="utf-8")
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.read_metadata(spark, str(broken)).collect()
    with pytest.raises(ValueError):
        validate.require_file(spark, str(tmp_path / "none"), "input")
    (tmp_path / "empty").write_text("")
    with pytest.raises(ValueError):
        validate.require_file(spark, str(tmp_path / "empty"), "input")
    validate.require_file(spark, str(csv), "input")


def save(df, path, name):
    return writers.write_table(df, str(path / name))


def test_readers(spark, tmp_path):
    vectors = spark.createDataFrame([("x", " a ", [1.0, 2.0]), ("y", None, [1.0, 2.0]), ("z", "b", None)], "other string, pid string, embedding array<float>")
    path = save(vectors, tmp_path, "v.parquet")
    assert [tuple(r) for r in readers.read_embeddings(spark, path).collect()] == [("a", [1.0, 2.0])]
    assert readers.read_embeddings(spark, path, strict=False).count() == 3
    with pytest.raises(ValueError):
        readers.read_embeddings(spark, path, dim=3)
    nan = save(vectors.withColumn("embedding", F.array(F.lit(float("nan")))), tmp_path, "n.parquet")
    with pytest.raises(ValueError):
        readers.read_embeddings(spark, nan)
    codes = spark.createDataFrame([("a", "[1, 2, 3]", None), ("b", None, "<s_a_4><s_b_5><s_c_6>"), (None, "[1,2,3]", None)], "item_id string, codes string, sid string")
    path = save(codes, tmp_path, "c.parquet")
    assert {r[0]: r[1] for r in readers.read_item_codes(spark, path, 2).collect()} == {"a": [1, 2], "b": [4, 5]}
    assert readers.read_sid_map(spark, path).count() == 2
    with pytest.raises(ValueError):
        readers.read_item_codes(spark, path, 4)
    with pytest.raises(ValueError):
        readers.read_sid_map(spark, save(codes.union(spark.createDataFrame([("c", "[1]", None)], codes.schema)), tmp_path, "d.parquet"))
    with pytest.raises(ValueError):
        readers.read_by_suffix(spark, "x.json")
    text = tmp_path / "t.csv"
    text.write_text("layer,teacher_code,target_code,distance_sq,usage_count\n0,1,0,0.5,7\n")
    assert tuple(readers.read_transport_map(spark, str(text)).first()) == (0, 1, 0, 0.5, 7)
    assert writers.codes_path("/x/e.parquet") == "/x/e_codes.parquet" and writers.distilled_codes_path("e.parquet") == "e_distilled_codes.parquet"


def test_codebook_files(spark, tmp_path):
    from test_codebook import BOOK

    path = writers.write_codebook(spark, BOOK, str(tmp_path / "book.parquet"), {"seed": 1})
    assert readers.read_codebook(spark, path).sizes == [3, 2]
    assert '"codebook_sizes"' in (tmp_path / "book_metadata.json").read_text()


MESSAGES = '[{"role":" user ","content":[{"text":" a "},"b",{"x":1},null]},{"role":"","content":"x"},7,{"role":"assistant","content":" yes "},{"role":"user","content":null}]'


def test_messages(spark):
    df = spark.createDataFrame([(1, MESSAGES)], "id int, messages string")
    parts = chat.prompt_completion_records(df).first()
    assert parts["prompt"] == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\n" and parts["completion"] == "yes<|im_end|>"
    for bad in ('[{"role":"assistant","content":"x"}]', "[]", "{}", '[{"role":"user","content":"x"}]', '[{"role":"user","content":"x"},{"role":"assistant","content":" "}]', None):
        with pytest.raises(PySparkException):
            chat.prompt_completion_records(spark.createDataFrame([(1, bad)], "id int, messages string")).collect()
    plain = spark.createDataFrame([("p", "c")], "prompt string, completion string")
    assert tuple(chat.prompt_completion_records(plain).first()) == ("p", "c")
    with pytest.raises(ValueError):
        chat.prompt_completion_records(plain.drop("prompt"))


def test_encode_and_collate(spark):
    df = spark.createDataFrame([(1, 0, "ab", "c"), (2, 0, "", "xyz"), (3, 1, "a", "b")], "id int, batch int, prompt string, completion string")
    rows = {r["id"]: r for r in chat.collate(chat.encode_pair(df, max_length=2), pad_id=0, end_id=9).collect()}
    assert rows[1]["input_ids"] == [98, 99] and rows[1]["labels"] == [-100, 99] and rows[2]["labels"] == [121, 122]
    whole = {r["id"]: r for r in chat.collate(chat.encode_pair(df, max_length=0), pad_id=0, end_id=9).collect()}
    assert whole[3]["input_ids"] == [97, 98] and whole[1]["attention_mask"] == [1, 1, 1]
    mixed = chat.collate(chat.encode_pair(df.withColumn("batch", F.lit(0)), max_length=3), pad_id=None, end_id=9)
    assert {r["id"]: r["input_ids"] for r in mixed.collect()}[3] == [97, 98, 9]
    with pytest.raises(PySparkException):
        chat.encode_pair(df.withColumn("completion", F.lit("")), max_length=1).collect()
    with pytest.raises(ValueError):
        chat.collate(df)


def test_prefixes(spark):
    df = spark.createDataFrame([(0, [1, 3]), (1, [1, 2, 5]), (2, [1, 3]), (3, []), (4, None)], "n int, s array<bigint>")
    table = decoding.prefix_table(df, "s", "n")
    assert {tuple(r["prefix"]): r["allowed"] for r in table.collect()} == {(): [1], (1,): [3, 2], (1, 2): [5]}
    asked = spark.createDataFrame([([1],), ([9],), ([1, 3],)], "prefix array<bigint>")
    assert {tuple(r["prefix"]): r["allowed"] for r in decoding.allowed_tokens(asked, table).collect()} == {(1,): [3, 2], (9,): [], (1, 3): []}


def test_vocabulary(spark):
    sizes = spark.createDataFrame([(0, 2), (1, 0)], "layer int, size bigint")
    vocabulary = spark.createDataFrame([("<s_a_0>", 7), ("<s_a_1>", 0)], "token string, token_id bigint")
    tokens = decoding.layer_tokens(sizes)
    assert [r["token_id"] for r in decoding.flat_ids(decoding.resolve_tokens(tokens, vocabulary)).orderBy("nth").collect()] == [7, 0]
    assert [r[0] for r in decoding.selected_rows(decoding.resolve_tokens(tokens, vocabulary), [0]).orderBy("token_id").collect()] == [0, 7]
    assert decoding.trainable_elements(2, 8, True) == 16 and decoding.trainable_elements(2, 8, False) == 32
    with pytest.raises(ValueError):
        decoding.trainable_elements(0, 8, True)
    for unknown, known in ((0, vocabulary), (None, vocabulary.limit(1))):
        with pytest.raises(PySparkException):
            decoding.resolve_tokens(tokens, known, unknown).collect()


def test_metrics(spark):
    df = spark.createDataFrame([("a", [["x"], ["a", "b"], ["a"]]), ("q", [["x"]]), ("z", [])], "label string, beams array<array<string>>")
    scored = ranking.rank_metrics(df, ranking.first_hit(F.col("beams"), F.col("label")), (1, 2))
    rows = {r["label"]: r for r in scored.collect()}
    assert (rows["a"]["recall_at_1"], rows["a"]["recall_at_2"]) == (0.0, 1.0) and rows["a"]["ndcg_at_2"] == pytest.approx(0.6309297536)
    assert rows["q"]["recall_at_2"] == rows["z"]["ndcg_at_1"] == 0.0
    assert ranking.mean_metrics(scored, ["recall_at_2"]).first()[0] == pytest.approx(1 / 3)
    assert ranking.mean_metrics(scored.limit(0), ["recall_at_2"]).first()[0] == 0.0
