import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_codebook import BOOK

from sidforge import cli
from sidforge.sources import readers, writers


def test_steps_from_files_to_rows(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    (tmp_path / "i.csv").write_text("user_id,parent_asin,rating,timestamp\nu,a,5,1\nu,b,5,1\nu,zz,5,1\n")
    (tmp_path / "meta_t.jsonl").write_text('{"parent_asin": "a", "title": "A"}\n{"parent_asin": "c", "title": "C"}\n')
    (tmp_path / "meta_s.jsonl").write_text('{"parent_asin": "b", "title": "B"}\n')
    cli.main(["prepare", "--interactions", p("i.csv"), "--target-meta", p("meta_t.jsonl"), "--target-domain", "t", "--source-meta", p("meta_s.jsonl"), "--output", p("items.parquet")])
    assert {(r["item_id"], r["domain"], r["is_target_candidate"]) for r in spark.read.parquet(p("items.parquet")).collect()} == {("a", "t", True), ("c", "t", True), ("b", "s", False)}
    writers.write_codebook(spark, BOOK, p("book.parquet"), {})
    spark.createDataFrame([("a", [5.0, 0.0]), ("b", [0.0, 0.9]), ("c", [4.0, 1.0])], "pid string, embedding array<float>").write.parquet(p("e.parquet"))
    cli.main(["encode", "--codebook", p("book.parquet"), "--embeddings", p("e.parquet")])
    cli.main(["sid-map", "--metadata", p("items.parquet"), "--codes", p("e_codes.parquet"), "--output", p("map.parquet"), "--layers", "2"])
    assert {r["item_id"]: r["sid"] for r in spark.read.parquet(p("map.parquet")).collect()}["a"] == "<|sid_begin|><s_a_1><s_b_1><|sid_end|>"
    cli.main(["distil", "--codebook", p("book.parquet"), "--embeddings", p("e.parquet"), "--output-dir", p("out"), "--sizes", "2"])
    stats = json.loads((tmp_path / "out" / "stats.json").read_text())
    assert stats["num_items"] == 3 and stats["n_layers"] == 2
    book = readers.read_codebook(spark, p("out/distilled_codebook.parquet"))
    cli.main(["encode", "--codebook", p("out/distilled_codebook.parquet"), "--embeddings", p("e.parquet"), "--distilled"])
    assert spark.read.parquet(p("e_distilled_codes.parquet")).count() == 3
    BOOK.to_table(spark).withColumnRenamed("centroid", "vec").write.parquet(p("rows.parquet"))
    cli.main(["init-rows", "--transport-map", p("out/transport_map.parquet"), "--item-sid-map", p("out/distilled_item_sid_map.parquet"), "--rows", p("rows.parquet"), "--output-dir", p("new")])
    rows = spark.read.parquet(p("new/rows.parquet")).collect()
    assert len(rows) == sum(book.sizes) and all(np.isfinite(r["vec"]).all() for r in rows)
    assert json.loads((tmp_path / "new" / "sid_embedding_init_summary.json").read_text())["layers"][0]["old_size"] == 3


def lengths(text):
    return F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))


def test_prepare_writes_embeddings(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    (tmp_path / "i.csv").write_text("user_id,parent_asin\nu,a\n")
    (tmp_path / "m.jsonl").write_text('{"parent_asin": "a", "title": "A"}\n')
    cli.main(["prepare", "--interactions", p("i.csv"), "--target-meta", p("m.jsonl"), "--target-domain", "t", "--output", p("items.parquet"), "--embedder", "test_cli:lengths"])
    rows = spark.read.parquet(p("items_embeddings.parquet")).collect()
    assert [r["pid"] for r in rows] == ["a"] and np.isclose(np.linalg.norm(rows[0]["embedding"]), 1)
    with pytest.raises(ValueError):
        cli.plug_in("no_colon")


def test_rows_of_a_model(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    token = lambda layer, code: f"<s_{'ab'[layer]}_{code}>"
    vocabulary = [(token(i, c), 100 + 10 * i + c) for i in range(2) for c in range(4)] + [("the", 1)]
    model = [(k, [float(k), 0.0]) for _, k in vocabulary]
    spark.createDataFrame(vocabulary, "token string, token_id bigint").write.parquet(p("v.parquet"))
    spark.createDataFrame(model, "token_id bigint, vec array<double>").write.parquet(p("m.parquet"))
    spark.createDataFrame([(k, [0.0, float(k)]) for k, _ in model], "token_id bigint, vec array<double>").write.parquet(p("h.parquet"))
    moves = [(0, 0, 1, 1.0, 3), (0, 1, 0, 1.0, 1), (0, 2, 1, 1.0, 1), (1, 0, 0, 1.0, 1), (1, 1, 0, 1.0, 1)]
    spark.createDataFrame(moves, "layer int, teacher_code bigint, target_code bigint, distance_sq double, usage_count bigint").write.parquet(p("t.parquet"))
    spark.createDataFrame([("x", [0, 0]), ("y", [1, 0])], "item_id string, codes array<bigint>").write.parquet(p("s.parquet"))
    base = ["init-rows", "--transport-map", p("t.parquet"), "--item-sid-map", p("s.parquet"), "--output-dir", p("o")]
    cli.main([*base, "--model-rows", p("m.parquet"), "--vocabulary", p("v.parquet"), "--head-rows", p("h.parquet"), "--overwrite-head"])
    found = {r["token_id"]: list(r["vec"]) for r in spark.read.parquet(p("o/input_rows.parquet")).collect()}
    wanted = dict(model) | {100: [101.0, 0.0], 101: [100.5, 0.0], 110: [110.5, 0.0]}
    assert found == wanted
    head = {r["token_id"]: list(r["vec"]) for r in spark.read.parquet(p("o/head_rows.parquet")).collect()}
    assert head[1] == [0.0, 1.0] and head[101] == [100.5, 0.0]
    summary = json.loads((tmp_path / "o" / "sid_embedding_init_summary.json").read_text())
    assert list(summary) == ["base_model_path", "transport_map", "item_sid_map", "weight_mode", "usage_power", "distance_temperature", "overwrite_lm_head", "layers", "output_dir"]
    with pytest.raises(ValueError):
        cli.main(base)
    spark.createDataFrame(vocabulary[1:], "token string, token_id bigint").write.parquet(p("v2.parquet"))
    with pytest.raises(Exception, match="no id for token"):
        cli.main([*base, "--model-rows", p("m.parquet"), "--vocabulary", p("v2.parquet")])


def test_failures(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    (tmp_path / "i.csv").write_text("user_id,parent_asin\nu, \n")
    (tmp_path / "m.jsonl").write_text("")
    with pytest.raises(ValueError):
        cli.main(["prepare", "--interactions", p("i.csv"), "--target-meta", p("m.jsonl"), "--target-domain", "t", "--output", p("o")])
    with pytest.raises(ValueError):
        cli.main(["sid-map", "--metadata", p("none"), "--codes", p("none"), "--output", p("o")])
    with pytest.raises(SystemExit):
        cli.main(["prepare"])
