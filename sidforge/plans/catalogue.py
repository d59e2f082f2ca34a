"""Queries of the toolkit's own operators, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sidforge.functions import sid as S
from sidforge.functions import vectors as V
from sidforge.functions.text import clean_id, item_text, pytrim
from sidforge.operators import chat, decoding, items, kmeans, ranking, transport
from sidforge.operators import codebook as C
from sidforge.plans.activity import sql_clean
from sidforge.plans.distill import distill
from sidforge.session import scratch_path, table
from sidforge.streaming.encode import encode_stream, write_stream

DIM, LAYERS, CODES, TARGETS = 64, 3, 128, 32
TARGET_DOMAIN = "home_kitchen"


# --- inputs ----------------------------------------------------------------------------------------------------------


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "item_meta")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, ord, v`` of the usable embeddings."""
    return items.usable_rows(table(spark, sf_dir, "item_embeddings"), "pid", "row_no", "embedding", DIM)


def _book(spark: SparkSession, sf_dir: str) -> C.Codebook:
    return C.Codebook.from_table(table(spark, sf_dir, "codebook"))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, codes`` with three known codes; of repeated ids the smallest list."""
    whole = (F.size("codes") == LAYERS) & ~F.exists("codes", lambda c: c.isNull() | (c < 0) | (c >= CODES))
    rows = table(spark, sf_dir, "item_codes").select(clean_id("pid").alias("item_id"), "codes").where(F.col("item_id").isNotNull() & F.col("codes").isNotNull() & whole)
    return rows.groupBy("item_id").agg(F.min("codes").alias("codes"))


def _cells(vector: F.Column) -> F.Column:
    """All components of a vector in units of 1e-5, as text."""
    return F.array_join(F.transform(vector, lambda x: F.round(x * 100_000).cast("bigint").cast("string")), ",")


def _text(codes: str) -> F.Column:
    return F.array_join(F.col(codes).cast("array<string>"), ",")


_USABLE = f"""usable as (
  select id, ord, v from (
    select {sql_clean("pid")} as id, row_no as ord, list_transform(embedding, lambda x: cast(x as double)) as v, row_number() over (partition by {sql_clean("pid")} order by row_no desc) as nth
    from item_embeddings where {sql_clean("pid")} is not null and len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIM} and len(list_filter(embedding, lambda x: x != 0)) > 0
  ) where nth = 1
)"""
_CODES = f"""coded as (
  select {sql_clean("pid")} as item_id, min(codes) as codes from item_codes
  where {sql_clean("pid")} is not null and len(codes) = {LAYERS} and len(list_filter(codes, lambda c: c is not null and c >= 0 and c < {CODES})) = {LAYERS} group by 1
)"""
_GAP = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _gap(a: str, b: str) -> str:
    return _GAP.format(a=a, b=b)


def _minus(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"


def _plus(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] + z[2])"


_TEXT_CODES = "array_to_string({0}, ',')"


def _sql_cells(vector: str) -> str:
    return f"array_to_string(list_transform({vector}, lambda x: cast(round(x * 100000) as bigint)), ',')"


def _encoded(source: str, first: str = "usable", codes: int = CODES) -> str:
    """CTEs ``near0 .. near2``, ``rest1 .. rest3`` and ``encoded`` over ``first(id, v)``, with the first codes of each layer."""
    parts = [source]
    for i in range(LAYERS):
        rest = first if i == 0 else f"rest{i}"
        parts.append(f"near{i} as materialized (select u.id, min({{'d': {_gap('u.v', 'c.centroid')}, 'code': c.code}}).code as code from {rest} u, codebook c where c.layer = {i} and c.code < {codes} group by u.id)")
        parts.append(f"rest{i + 1} as materialized (select n.id, {_minus('u.v', 'c.centroid')} as v from near{i} n join {rest} u on u.id = n.id join codebook c on c.layer = {i} and c.code = n.code)")
    parts.append("encoded as materialized (select id, [cast(near0.code as bigint), cast(near1.code as bigint), cast(near2.code as bigint)] as codes from near0 join near1 using (id) join near2 using (id))")
    return ", ".join(parts)


_ENCODED = _encoded(_USABLE)
_ARRIVED = f"""arrived as (
  select row_no as id, {sql_clean("pid")} as item_id, list_transform(embedding, lambda x: cast(x as double)) as v from item_embeddings
  where {sql_clean("pid")} is not null and len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIM} and len(list_filter(embedding, lambda x: x != 0)) > 0
)"""
_SID = "'<|sid_begin|>' || array_to_string(list_transform({0}, lambda c, i: '<s_' || chr(cast(96 + i as integer)) || '_' || c || '>'), '') || '<|sid_end|>'"


# --- items -----------------------------------------------------------------------------------------------------------


def distinct_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.seen_items(table(spark, sf_dir, "user_sequences"))


def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _meta(spark, sf_dir).withColumn("item_id", clean_id("parent_asin")).where("item_id is not null")
    return rows.select("row_no", "item_id", item_text("item_id").alias("text"))


def _prepared(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    rows = _meta(spark, sf_dir)
    part = lambda d: items.MetaSource(rows.where(F.col("domain") == d), d, "row_no")
    others = sorted(r[0] for r in rows.where(F.col("domain").isNotNull() & (F.col("domain") != TARGET_DOMAIN)).select("domain").distinct().collect())  # one row a source file
    return items.prepare_items(table(spark, sf_dir, "user_sequences"), part(TARGET_DOMAIN), [part(d) for d in others], scope)


def items_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir, "all_meta").select("item_id", "domain", "is_target_candidate", "title", "source_no", "first_line")


def items_labels_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir, "labels_only").groupBy("domain", "is_target_candidate").agg(F.count("*").alias("n_items"))


def missing_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.missing_items(table(spark, sf_dir, "user_sequences"), _prepared(spark, sf_dir, "all_meta"))


def item_sid_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = _prepared(spark, sf_dir, "all_meta").join(_codes(spark, sf_dir), "item_id", "left_semi")
    return items.build_sid_map(described.select("item_id", "domain"), _codes(spark, sf_dir), LAYERS).select("item_id", "domain", _text("codes").alias("codes"), "sid")


def text_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plug-in embedding of item texts; the stand-in embedder counts hashed words in 16 cells."""

    @F.pandas_udf("array<double>")
    def embedder(texts: pd.Series) -> pd.Series:
        words = texts.str.lower().str.split(r"\W+", regex=True)
        cells = pd.util.hash_array(words.explode().to_numpy(object), categorize=True) % 16
        row = np.repeat(np.arange(len(texts)), words.str.len())
        return pd.Series(list(np.bincount(row * 16 + cells.astype(np.int64), minlength=16 * len(texts)).reshape(-1, 16).astype(float)))

    rows = items.embed_items(_prepared(spark, sf_dir, "all_meta"), embedder)
    return rows.select("pid", F.round(V.total(F.transform("embedding", lambda x: x * x)), 6).alias("squared_length"), F.size("embedding").alias("dim"))


# --- vectors and codes -----------------------------------------------------------------------------------------------


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = V.unit(F.col("v"))
    return _vectors(spark, sf_dir).select("id", _cells(u).alias("cells"))


def residual_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.encode(_vectors(spark, sf_dir), _book(spark, sf_dir), "v").select("id", _text("codes").alias("codes"))


def streaming_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream gives every arrived row its codes; rows of one id are told apart afterwards."""
    source = table(spark, sf_dir, "item_embeddings")
    arrivals = spark.readStream.schema(source.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(_folder(spark, sf_dir, "item_embeddings"))
    path = scratch_path(spark, "stream")
    query = write_stream(encode_stream(arrivals, _book(spark, sf_dir)), f"{path}/out", f"{path}/state")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    out = spark.read.schema("item_id string, codes array<bigint>, sid string").parquet(f"{path}/out")
    return out.groupBy("item_id", "sid").agg(F.count("*").alias("n_rows"))


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder with the files of a table, which a stream needs; a single file is copied to one."""
    path = f"{sf_dir}/{name}.parquet"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return path
    copy = scratch_path(spark, "arrivals")
    spark.read.parquet(path).write.parquet(copy)
    return copy


def residual_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.decode(_codes(spark, sf_dir), _book(spark, sf_dir), out="v")
    return rows.select("item_id", _cells(F.col("v")).alias("cells"))


def recon_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    loss = C.reconstruction_loss(C.encode(_vectors(spark, sf_dir), book, "v"), book, "v")
    return loss.select("n_items", F.round("mse", 8).alias("mse"), F.round("relative_loss", 6).alias("relative_loss"))


def sampled_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss on the first 10,000 vectors, as the teacher's encoder reports it; the sample is the operator's definition."""
    book = _book(spark, sf_dir)
    loss = C.reconstruction_loss(C.encode(C.first_rows(_vectors(spark, sf_dir), F.col("ord")), book, "v"), book, "v")
    return loss.select("n_items", F.round("mse", 8).alias("mse"), F.round("relative_loss", 6).alias("relative_loss"))


def reencode(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    small = C.Codebook([c[:TARGETS] for c in book.layers])
    return C.reencode_loss(_codes(spark, sf_dir), book, small).select("n_items", F.round("mse", 8).alias("mse"))


def sid_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "item_codes").where(F.col("codes").isNotNull() & ~F.exists("codes", lambda c: c.isNull()))
    return rows.select(clean_id("pid").alias("item_id"), S.sid_from_codes("codes").alias("sid"))


def sid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.parse_sid("text").cast("array<string>"), ",").alias("codes"))


def codes_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lists written as text in three ways and read back."""
    rows = table(spark, sf_dir, "item_codes").where(F.col("codes").isNotNull() & ~F.exists("codes", lambda c: c.isNull()))
    joined = F.array_join(F.col("codes").cast("array<string>"), ", ")
    written = F.explode(F.array(F.concat(F.lit("["), joined, F.lit("]")), joined, F.concat(F.lit(' ["'), F.array_join(F.col("codes").cast("array<string>"), '","'), F.lit('"] ')))).alias("written")
    return rows.select(clean_id("pid").alias("item_id"), written).select("item_id", "written", F.array_join(S.parse_codes("written").cast("array<string>"), ",").alias("codes"))


def sid_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = C.collision_stats(table(spark, sf_dir, "item_sid_map"), clean_id("sid"))
    return stats.withColumn("collision_rate", F.round("collision_rate", 8))


def code_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.code_usage(_codes(spark, sf_dir), table(spark, sf_dir, "codebook"))


def code_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.code_coverage(code_usage(spark, sf_dir)).withColumn("coverage_ratio", F.round("coverage_ratio", 8))


def last_token_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token states of an item: its codes as one-component vectors; the mask hides code 0; batches by layer-0 code."""
    rows = _codes(spark, sf_dir).select("item_id", F.transform("codes", lambda c: F.array(c.cast("double"))).alias("hidden"), F.transform("codes", lambda c: (c > 0).cast("int")).alias("mask"), F.get("codes", F.lit(0)).alias("batch"))
    left = F.min(F.element_at("mask", -1)).over(W.partitionBy("batch")) == 1
    return rows.select("item_id", F.get(V.last_token(F.col("hidden"), F.col("mask"), left), F.lit(0)).alias("pooled"))


# --- training --------------------------------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("id", "v", F.lit(1.0).alias("w"))


def kmeans_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three Lloyd rounds from the first eight centroids of layer 0: size of each cluster and the final objective."""
    points = _points(spark, sf_dir)
    centers, _ = kmeans.refine(points, _book(spark, sf_dir).layers[0][:8], 3)
    final = kmeans.assign_round(points, centers)
    rows = [(i, int(final.counts[i]), round(final.objective, 5)) for i in range(len(centers))]
    return spark.createDataFrame(rows, "cluster int, size bigint, objective double")


def cluster_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = code_usage(spark, sf_dir).select("layer", F.col("code").alias("cluster"), F.col("usage_count").alias("weight"))
    return kmeans.relabel(usage).withColumn("new_cluster", F.col("new_cluster").cast("bigint"))


def kmeans_pp_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression of each layer to 16 centroids by seeded, restarted k-means on the driver."""
    book, rows = _book(spark, sf_dir), []
    weights = {(r["layer"], r["code"]): r["usage_count"] for r in code_usage(spark, sf_dir).collect()}
    for i, c in enumerate(book.layers):
        w = [float(weights[i, j]) for j in range(len(c))]
        centers, own, _ = kmeans.small_kmeans(c, np.array(w), 16, 4, 50, 42 + i)
        rows += [(i, k, int((own == k).sum())) for k in range(len(centers))]
    return spark.createDataFrame(rows, "layer int, cluster int, n_centroids int")


def train_codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A residual codebook trained from scratch, with the loss it leaves."""
    points = _points(spark, sf_dir)
    book = C.Codebook(kmeans.train_residual(points, [16, 16, 16], 5))
    return C.reconstruction_loss(C.encode(points, book, "v"), book, "v").select("n_items", "mse")


def _distilled(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    """Distillation on the teacher's first 16 codes a layer, all of them in use, so no cluster is left empty; two refinement rounds."""
    teacher = C.Codebook([c[:16] for c in _book(spark, sf_dir).layers])
    return distill(_vectors(spark, sf_dir), teacher, [16] * LAYERS, refine_iter=2)


def distilled_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distilled(spark, sf_dir).items.select("item_id", _text("teacher_codes").alias("teacher_codes"), _text("codes").alias("codes"), "sid")


def layer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _distilled(spark, sf_dir).stats["layer_stats"]
    rows = [(x["layer"], x["actual_target_size"], x["active_teacher_codes"], round(x["usage_coverage_ratio"], 8), round(x["layer_quantization_mse"], 6), int(x["top_refined_cluster_weights"][0])) for x in stats]
    return spark.createDataFrame(rows, "layer int, target_size bigint, active_codes bigint, coverage double, mse double, largest bigint")


def compressed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distillation from all 128 codes a layer to 32; its seeds and repairs have no plain SQL."""
    stats = distill(_vectors(spark, sf_dir), _book(spark, sf_dir), [TARGETS] * LAYERS, refine_iter=5).stats["layer_stats"]
    return spark.createDataFrame([(x["layer"], x["actual_target_size"], round(x["layer_quantization_mse"], 6)) for x in stats], "layer int, target_size bigint, mse double")


def farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors farthest from the first eight centroids of layer 0; the number is the operator's feature."""
    rows = kmeans.farthest(_points(spark, sf_dir), _book(spark, sf_dir).layers[0][:8], 20)
    return spark.createDataFrame([(r.tolist(),) for r in rows], "v array<double>").select(_cells(F.col("v")).alias("cells"))


# --- transport -------------------------------------------------------------------------------------------------------


def _transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = table(spark, sf_dir, "codebook")
    target = book.where(F.col("code") < TARGETS).withColumn("centroid", F.transform("centroid", lambda x: x * 0.9))
    return transport.transport_map(book, target, code_usage(spark, sf_dir))


def transport_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transport(spark, sf_dir).withColumn("distance_sq", F.round("distance_sq", 8))


def layer_sizes_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.sizes_from_transport(_transport(spark, sf_dir))


def layer_sizes_sid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.sizes_from_codes(_codes(spark, sf_dir))


def _init_rows(mode: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        old = table(spark, sf_dir, "codebook").select("layer", "code", F.col("centroid").alias("vec"))
        rows = transport.initial_rows(old, _transport(spark, sf_dir), mode, 0.5, 0.25)
        return rows.select("layer", "code", _cells(F.col("vec")).alias("cells"))

    return run


# --- decoding and ranking --------------------------------------------------------------------------------------------


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "codebook").select(S.sid_token(F.col("layer"), F.col("code")).alias("token"), (F.lit(50257).cast("bigint") + F.col("layer") * CODES + F.col("code")).alias("token_id"))
    end = spark.createDataFrame([(S.SID_END, 50256)], "token string, token_id bigint")
    return tokens.unionByName(end)


def vocab_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = decoding.layer_tokens(transport.sizes_from_codes(_codes(spark, sf_dir)))
    return decoding.resolve_tokens(tokens, _vocabulary(spark, sf_dir)).select("layer", "code", "token", "token_id")


def flat_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.flat_ids(vocab_resolve(spark, sf_dir)).withColumn("nth", F.col("nth").cast("bigint"))


def sid_suffix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = decoding.suffix_tokens(_codes(spark, sf_dir), _vocabulary(spark, sf_dir), "item_id")
    return ids.select("item_id", F.array_join(F.col("token_ids").cast("array<string>"), ",").alias("token_ids"))


def trie_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.prefix_table(_codes(spark, sf_dir), "codes").select(_text("prefix").alias("prefix"), _text("allowed").alias("allowed"))


def trie_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _codes(spark, sf_dir).select("item_id", F.array(F.get("codes", F.lit(1)), F.get("codes", F.lit(0))).alias("prefix"))
    found = decoding.allowed_tokens(asked, decoding.prefix_table(_codes(spark, sf_dir), "codes"))
    return found.select("item_id", _text("allowed").alias("allowed"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's last item against the most popular 50 items, ten lists of five."""
    rows = table(spark, sf_dir, "user_sequences").select("row_id", clean_id("user_id").alias("user_id"), clean_id("parent_asin").alias("item_id")).where("user_id is not null and item_id is not null")
    popular = rows.groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id").limit(50)
    beams = popular.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "item_id"))), lambda x: x["item_id"]).alias("p"))
    lists = beams.select(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.slice("p", i * 5 + 1, 5)).alias("beams")).scalar()
    labels = rows.groupBy("user_id").agg(F.max_by("item_id", "row_id").alias("label"))
    ranked = labels.withColumn("beams", lists).withColumn("hit", ranking.first_hit(F.col("beams"), F.col("label")))
    return ranking.rank_metrics(ranked, F.col("hit"), (1, 5, 10))


_METRICS = [f"{m}_at_{k}" for k in (1, 5, 10) for m in ("recall", "ndcg")]


def recall_ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("user_id", "label", *(F.round(c, 8).alias(c) for c in _METRICS))


def mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = ranking.mean_metrics(_ranked(spark, sf_dir), _METRICS)
    return means.select(*(F.round(c, 8).alias(c) for c in _METRICS))


# --- chat ------------------------------------------------------------------------------------------------------------


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("source = 'chat' and text is not null")  # the other sources are no conversations
    from_json = chat.messages_from_json(F.col("text"))
    return docs.select("doc_id", F.coalesce(from_json, chat.messages_from_lines(F.col("text"))).alias("messages"))


def prompt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chat.split_prompt_completion(_conversations(spark, sf_dir))
    return parts.select("doc_id", F.size("prompt_messages").alias("n_prompt"), "completion")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chat.split_prompt_completion(_conversations(spark, sf_dir))
    return parts.select("doc_id", chat.render_prompt(F.col("prompt_messages")).alias("prompt"), F.concat("completion", F.lit(S.MESSAGE_END)).alias("completion"))


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir)


def training_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records straight from the conversations that have a prompt and a completion; others would be an error."""
    records = chat.prompt_completion_records(_conversations(spark, sf_dir).join(_records(spark, sf_dir).select("doc_id"), "doc_id", "left_semi"))
    return records.select("doc_id", "prompt", "completion")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.encode_pair(_records(spark, sf_dir), max_length=512)


def encode_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", *(_text(c).alias(c) for c in ("input_ids", "labels", "attention_mask")))


def collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 16 consecutive document numbers, padded with id 50256."""
    batched = _pairs(spark, sf_dir).withColumn("batch", F.floor(F.col("doc_id") / 16))
    return chat.collate(batched, pad_id=0, end_id=50256).select("doc_id", *(_text(c).alias(c) for c in ("input_ids", "labels", "attention_mask")))


QUERIES = {
    f.__name__: f
    for f in (
        distinct_items, item_texts, items_upsert, items_labels_only, missing_meta, item_sid_map, text_embed, l2_normalize, residual_encode, streaming_encode, residual_decode, recon_mse, sampled_loss,
        reencode, sid_render, sid_parse, codes_parse, sid_collision, code_usage, code_coverage, last_token_pool, kmeans_refine, cluster_relabel, kmeans_pp_seed, train_codebook, distilled_map, layer_stats, compressed_stats, farthest, transport_map,
        layer_sizes_transport, layer_sizes_sid, vocab_resolve, flat_ids, sid_suffix_tokens, trie_children, trie_allowed, recall_ndcg_at_k, mean_metrics, prompt_split, prompt_render, training_records, encode_pair, collate,
    )
} | {f"init_rows_{m}": _init_rows(m) for m in transport.WEIGHT_MODES}

# --- SQL -------------------------------------------------------------------------------------------------------------

_WS_TRIM = sql_clean("{0}").removeprefix("nullif(").removesuffix(", '')")


def _trim(column: str) -> str:
    return _WS_TRIM.format(column)


def _listed(column: str, separator: str, most: int) -> str:
    trimmed = _trim("coalesce(x, 'None')")
    kept = f"list_filter(list_transform({column}, lambda x: {trimmed}), lambda x: x != '')"
    return f"coalesce(array_to_string(list_slice({kept}, 1, {most}), '{separator}'), '')"


def _line(label: str, value: str) -> str:
    return f"case when {value} != '' then '{label}: ' || {value} end"


_LINES = ", ".join(
    [_line(label, f"coalesce({_trim(c)}, '')") for label, c in (("Title", "title"), ("Store", "store"), ("Main category", "main_category"))]
    + [_line("Categories", _listed("categories", "; ", 10)), _line("Features", _listed("features", "; ", 8)), _line("Description", _listed("description", " ", 4))]
)
_SEEN = f"seen as (select distinct {sql_clean('parent_asin')} as item_id from user_sequences where {sql_clean('parent_asin')} is not null)"
_PREPARED = f"""{_SEEN}, lines as (
  select {sql_clean("parent_asin")} as item_id, row_no, domain, title, cast(case when domain = '{TARGET_DOMAIN}' then 0 else dense_rank() over (order by case when domain != '{TARGET_DOMAIN}' then domain end nulls last) end as integer) as n
  from item_meta where {sql_clean("parent_asin")} is not null and domain is not null
), parts as (
  select item_id, n, domain, arg_max({{'t': title}}, row_no).t as title, min(row_no) as first_line from lines where n is not null group by item_id, n, domain
), allowed as (select * from parts where (n = 0 and {{scope}}) or item_id in (select item_id from seen)
), prepared as (
  select item_id, arg_max(domain, n) as domain, arg_max(n, n) = 0 as is_target_candidate, arg_max({{'t': title}}, n).t as title, cast(min(n) as integer) as source_no, arg_min(first_line, n) as first_line from allowed group by item_id
)""".replace("{{'t'", "{'t'").replace("title}}", "title}")
_ALL, _LABELS = _PREPARED.replace("{scope}", "true"), _PREPARED.replace("{scope}", "item_id in (select item_id from seen)")
_DECODED = f"{_CODES}, decoded as (select item_id, codes, " + _plus(_plus("c0.centroid", "c1.centroid"), "c2.centroid") + " as v from coded join codebook c0 on c0.layer = 0 and c0.code = codes[1] join codebook c1 on c1.layer = 1 and c1.code = codes[2] join codebook c2 on c2.layer = 2 and c2.code = codes[3])"
_LOSS = "select count(*) as n_items, round(sum(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / (64 * count(*)), 8) as mse"
_RELATIVE = ", round(sum(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]) / (greatest(abs(z[1]), abs(z[2])) + 0.0001)))) / (64 * count(*)), 6) as relative_loss"
_USAGE = f"{_CODES}, used as (select 0 as layer, codes[1] as code from coded union all select 1, codes[2] from coded union all select 2, codes[3] from coded), usage as (select c.layer, cast(c.code as bigint) as code, count(u.code) as usage_count from codebook c left join used u on u.layer = c.layer and u.code = c.code group by all)"
_TARGETS = f"targets as (select layer, cast(code as bigint) as code, list_transform(centroid, lambda x: x * 0.9) as c from codebook where code < {TARGETS})"
_TRANSPORT = f"""{_USAGE}, {_TARGETS}, transport as (
  select t.layer, cast(t.code as bigint) as teacher_code, min({{'d': {_gap("t.centroid", "g.c")}, 'code': g.code}}) as near, any_value(u.usage_count) as usage_count
  from codebook t join targets g on g.layer = t.layer join usage u on u.layer = t.layer and u.code = t.code group by t.layer, t.code
), mapped as (select layer, teacher_code, near.code as target_code, near.d as distance_sq, usage_count, usage_count > 0 as is_active_in_target_items from transport)"""
_WEIGHTS = {"uniform": "1.0", "usage": "pow(greatest(usage_count, 1), 0.5)", "inverse_distance": "pow(greatest(usage_count, 1), 0.5) * exp(-distance_sq / 0.25)"}


def _init_sql(mode: str) -> str:
    return f"""with {_TRANSPORT}, cells as (
      select m.layer, m.target_code, {_WEIGHTS[mode]} as w, unnest(c.centroid) as x, generate_subscripts(c.centroid, 1) as pos from mapped m join codebook c on c.layer = m.layer and c.code = m.teacher_code
    ), means as (select layer, target_code, pos, sum(w * x) / sum(w) as x from cells group by all
    ), sized as (select layer, max(target_code) + 1 as n from mapped group by layer
    ), wanted as (select layer, unnest(range(n)) as code from sized
    ), filled as (
      select w.layer, w.code, m.pos, m.x from wanted w join means m on m.layer = w.layer and m.target_code = w.code
      union all
      select w.layer, w.code, generate_subscripts(c.centroid, 1), unnest(c.centroid) from wanted w join codebook c on c.layer = w.layer and c.code = least(w.code, 127) where not exists (select 1 from means m where m.layer = w.layer and m.target_code = w.code)
    ) select layer, code, {_sql_cells('list(x order by pos)')} as cells from filled group by layer, code"""


def _lloyd_sql(rounds: int) -> str:
    steps, centers = [], "(select code as k, centroid as c from codebook where layer = 0 and code < 8)"
    for r in range(rounds + 1):
        steps.append(f"own{r} as materialized (select u.id, any_value(u.v) as v, min({{'d': {_gap('u.v', 'c.c')}, 'k': c.k}}) as near from usable u, {centers} c group by u.id)")
        steps.append(f"centers{r} as materialized (select k, list(x order by pos) as c from (select near.k as k, pos, avg(x) as x from (select near, unnest(v) as x, generate_subscripts(v, 1) as pos from own{r}) group by 1, 2) group by k)")
        centers = f"centers{r}"
    return f"with {_USABLE}, {', '.join(steps)} select cast(near.k as integer) as cluster, count(*) as size, (select round(sum(near.d), 5) from own{rounds}) as objective from own{rounds} group by 1"


def _distil_sql(rounds: int, size: int) -> str:
    """Distillation without compression in plain SQL: ``encoded`` by the teacher, ``finals(layer, id, k, d)``, ``done0..2(id, code)``."""
    steps = [_encoded(_USABLE, codes=size)]
    for i in range(LAYERS):
        rest = "usable" if i == 0 else f"left{i}"
        steps.append(f"start{i} as materialized (select row_number() over (order by count(*) desc, c.code) - 1 as k, any_value(c.centroid) as c from encoded e join codebook c on c.layer = {i} and c.code = e.codes[{i + 1}] group by c.code)")
        centers = f"start{i}"
        for r in range(rounds + 1):
            steps.append(f"own{i}_{r} as materialized (select u.id, any_value(u.v) as v, min({{'d': {_gap('u.v', 'c.c')}, 'k': c.k}}) as near from {rest} u, {centers} c group by u.id)")
            if r < rounds:
                steps.append(f"centers{i}_{r} as materialized (select k, list(x order by pos) as c from (select near.k as k, pos, avg(x) as x from (select near, unnest(v) as x, generate_subscripts(v, 1) as pos from own{i}_{r}) group by 1, 2) group by k)")
                centers = f"centers{i}_{r}"
        steps.append(f"rank{i} as (select near.k as k, row_number() over (order by count(*) desc, near.k) - 1 as code from own{i}_{rounds} group by near.k)")
        steps.append(f"done{i} as materialized (select id, code from own{i}_{rounds} join rank{i} r on r.k = near.k)")
        steps.append(f"left{i + 1} as materialized (select o.id, {_minus('o.v', 'c.c')} as v from own{i}_{rounds} o join {centers} c on c.k = o.near.k)")
    finals = " union all ".join(f"select {i} as layer, id, near.k as k, near.d as d from own{i}_{rounds}" for i in range(LAYERS))
    starts = " union all ".join(f"select {i} as layer, count(*) as n_start from start{i}" for i in range(LAYERS))
    return f"with {', '.join(steps)}, finals as ({finals}), starts as ({starts}) "


_DISTIL = _distil_sql(2, 16)
_TOKENS = "vocabulary as (select '<s_' || chr(97 + layer) || '_' || code || '>' as token, cast(50257 + layer * 128 + code as bigint) as token_id, layer, cast(code as bigint) as code from codebook)"
_PREFIXES = f"{_CODES}, steps as (select '' as prefix, codes[1] as token from coded union select cast(codes[1] as varchar), codes[2] from coded union select codes[1] || ',' || codes[2], codes[3] from coded), trie as (select prefix, array_to_string(list(token order by token), ',') as allowed from steps group by prefix)"
_RANKED = f"""clicks as (
  select row_id, {sql_clean("user_id")} as user_id, {sql_clean("parent_asin")} as item_id from user_sequences where {sql_clean("user_id")} is not null and {sql_clean("parent_asin")} is not null
), popular as (select item_id, row_number() over (order by count(*) desc, item_id) as place from clicks group by item_id qualify place <= 50
), labels as (select user_id, arg_max(item_id, row_id) as label from clicks group by user_id
), ranked as (select user_id, label, (place + 4) // 5 as hit from labels left join popular on item_id = label)"""
_METRIC_SQL = {f"{m}_at_{k}": f"case when hit <= {k} then {'1.0' if m == 'recall' else '1.0 / log2(hit + 1)'} else 0.0 end" for k in (1, 5, 10) for m in ("recall", "ndcg")}
_CHAT = f"""chats as (
  select doc_id, text, json_valid(text) as is_json from documents where source = 'chat' and text is not null
), talks as (
  select doc_id, case when is_json then list_filter(list_transform(json_transform(case when is_json then text else '[]' end, '[{{"role":"VARCHAR","content":"VARCHAR"}}]'), lambda m: {{'role': coalesce({_trim("m.role")}, ''), 'content': coalesce(m.content, '')}}), lambda m: m.role != '')
  else list_transform(list_filter(string_split(regexp_replace(text, '(^|\\n)(system|user|assistant): ', chr(1) || '\\2: ', 'g'), chr(1)), lambda b: regexp_matches(b, '^(system|user|assistant): ')), lambda b: {{'role': split_part(b, ': ', 1), 'content': regexp_replace(b, '^[a-z]+: ', '')}}) end as messages from chats
), placed as (
  select doc_id, messages, len(messages) - list_position(list_reverse(list_transform(messages, lambda m: m.role)), 'assistant') as last from talks
), splits as (
  select doc_id, messages[1:last] as prompt_messages, {_trim("messages[last + 1].content")} as completion from placed where last > 0 and last < len(messages)
), records as (
  select doc_id, len(prompt_messages) as n_prompt, completion, array_to_string(list_transform(prompt_messages, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '') || '<|im_start|>assistant' || chr(10) as prompt
  from splits where completion != ''
), encoded as (
  select doc_id, list_transform(string_split(prompt, ''), lambda c: cast(unicode(c) as bigint)) as p, list_transform(string_split(completion || '<|im_end|>', ''), lambda c: cast(unicode(c) as bigint)) as c from records
), pairs as (
  select doc_id, least(len(p) + len(c), 512) as n, list_slice(list_concat(p, c), greatest(len(p) + len(c) - 511, 1), len(p) + len(c)) as ids,
  list_slice(list_concat(list_transform(p, lambda x: cast(-100 as bigint)), c), greatest(len(p) + len(c) - 511, 1), len(p) + len(c)) as labels from encoded
)"""

ORACLES = {
    "distinct_items": f"with {_SEEN} select * from seen",
    "item_texts": f"select row_no, {sql_clean('parent_asin')} as item_id, coalesce(nullif(concat_ws(chr(10), {_LINES}), ''), 'Item id: ' || {sql_clean('parent_asin')}) as text from item_meta where {sql_clean('parent_asin')} is not null",
    "items_upsert": f"with {_ALL} select * from prepared",
    "items_labels_only": f"with {_LABELS} select domain, is_target_candidate, count(*) as n_items from prepared group by all",
    "missing_meta": f"with {_ALL} select item_id from seen where item_id not in (select item_id from prepared)",
    "item_sid_map": f"with {_ALL}, {_CODES} select item_id, domain, {_TEXT_CODES.format('codes')} as codes, {_SID.format('codes')} as sid from prepared join coded using (item_id)",
    "l2_normalize": f"with {_USABLE}, units as (select id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) as u from usable) select id, {_sql_cells('u')} as cells from units",
    "residual_encode": f"with {_ENCODED} select id, {_TEXT_CODES.format('codes')} as codes from encoded",
    "streaming_encode": f"with {_encoded(_ARRIVED, 'arrived')} select item_id, {_SID.format('codes')} as sid, count(*) as n_rows from encoded join arrived using (id) group by 1, 2",
    "reencode": f"with {_encoded(_DECODED + ', restored as (select item_id as id, v from decoded)', 'restored', TARGETS)}, both_sides as (select u.v as x, {_minus('u.v', 'r.v')} as y from restored u join rest3 r using (id)) {_LOSS} from both_sides",
    "residual_decode": f"with {_DECODED} select item_id, {_sql_cells('v')} as cells from decoded",
    "recon_mse": f"with {_ENCODED}, both_sides as (select u.v as x, {_minus('u.v', 'r.v')} as y from usable u join rest3 r using (id)) {_LOSS}{_RELATIVE} from both_sides",
    "sampled_loss": f"with {_ENCODED}, both_sides as (select u.v as x, {_minus('u.v', 'r.v')} as y from (select * from usable order by ord limit 10000) u join rest3 r using (id)) {_LOSS}{_RELATIVE} from both_sides",
    "sid_render": f"select {sql_clean('pid')} as item_id, {_SID.format('codes')} as sid from item_codes where codes is not null and len(list_filter(codes, lambda c: c is null)) = 0",
    "sid_parse": "select doc_id, nullif(array_to_string(list_transform(regexp_extract_all(text, '<s_[a-z]_([0-9]+)>', 1), lambda x: cast(x as bigint)), ','), '') as codes from documents",
    "sid_collision": f"with counts as (select count(*) as n from item_sid_map where {sql_clean('sid')} is not null group by {sql_clean('sid')}) select cast(coalesce(sum(n), 0) as bigint) as num_total, count(*) as num_unique, round(case when sum(n) is null then 0.0 else 1.0 - count(*) / sum(n) end, 8) as collision_rate, count(*) filter (n > 1) as num_collision_clusters, coalesce(max(n) filter (n > 1), 1) as max_cluster_size from counts",
    "code_usage": f"with {_USAGE} select * from usage",
    "code_coverage": f"with {_USAGE} select layer, count(*) as codebook_size, count(*) filter (usage_count > 0) as active_codes, round(count(*) filter (usage_count > 0) / count(*), 8) as coverage_ratio from usage group by layer",
    "codes_parse": f"""with rows_ as (select {sql_clean('pid')} as item_id, array_to_string(codes, ', ') as j, array_to_string(codes, ',') as c, array_to_string(codes, '","') as q from item_codes where codes is not null and len(list_filter(codes, lambda c: c is null)) = 0)
        select item_id, '[' || j || ']' as written, c as codes from rows_ union all select item_id, j, c from rows_ union all select item_id, ' ["' || q || '"] ', c from rows_""",
    "last_token_pool": f"with {_CODES}, batches as (select codes[1] as batch, min(case when codes[3] > 0 then 1 else 0 end) = 1 as left_padded from coded group by 1) select item_id, cast(case when left_padded then codes[3] else codes[greatest(len(list_filter(codes, lambda c: c > 0)), 1)] end as double) as pooled from coded join batches on batch = codes[1]",
    "kmeans_refine": _lloyd_sql(3),
    "cluster_relabel": f"with {_USAGE} select layer, code as cluster, usage_count as weight, row_number() over (partition by layer order by usage_count desc, code) - 1 as new_cluster from usage",
    "transport_map": f"with {_TRANSPORT} select layer, teacher_code, target_code, round(distance_sq, 8) as distance_sq, usage_count, is_active_in_target_items from mapped",
    "layer_sizes_transport": f"with {_TRANSPORT} select layer, max(teacher_code) + 1 as old_size, max(target_code) + 1 as new_size from mapped group by layer",
    "layer_sizes_sid": f"with {_USAGE} select layer, max(code) + 1 as size from used group by layer",
    "vocab_resolve": f"with {_USAGE}, {_TOKENS}, sized as (select layer, max(code) + 1 as n from used group by layer) select v.layer, v.code, v.token, v.token_id from vocabulary v join sized s on s.layer = v.layer and v.code < s.n",
    "sid_suffix_tokens": f"with {_CODES} select item_id, array_to_string([50257 + codes[1], 50385 + codes[2], 50513 + codes[3], 50256], ',') as token_ids from coded",
    "trie_children": f"with {_PREFIXES} select prefix, allowed from trie",
    "trie_allowed": f"with {_PREFIXES} select item_id, coalesce(allowed, '') as allowed from coded left join trie on prefix = codes[2] || ',' || codes[1]",
    "recall_ndcg_at_k": f"with {_RANKED} select user_id, label, " + ", ".join(f"round(cast({s} as double), 8) as {c}" for c, s in _METRIC_SQL.items()) + " from ranked",
    "mean_metrics": f"with {_RANKED} select " + ", ".join(f"round(coalesce(avg(cast({s} as double)), 0.0), 8) as {c}" for c, s in _METRIC_SQL.items()) + " from ranked",
    "prompt_split": f"with {_CHAT} select doc_id, cast(n_prompt as integer) as n_prompt, completion from records",
    "prompt_render": f"with {_CHAT} select doc_id, prompt, completion || '<|im_end|>' as completion from records",
    "encode_pair": f"with {_CHAT} select doc_id, array_to_string(ids, ',') as input_ids, array_to_string(labels, ',') as labels, array_to_string(list_transform(ids, lambda x: 1), ',') as attention_mask from pairs",
    "collate": f"""with {_CHAT}, wide as (select *, max(n) over (partition by doc_id // 16) as longest from pairs), filled as (select *, range(longest - n) as more from wide)
        select doc_id, array_to_string(list_concat(ids, list_transform(more, lambda x: cast(50256 as bigint))), ',') as input_ids, array_to_string(list_concat(labels, list_transform(more, lambda x: cast(-100 as bigint))), ',') as labels,
        array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(more, lambda x: 0)), ',') as attention_mask from filled""",
    "training_records": f"with {_CHAT} select doc_id, prompt, completion || '<|im_end|>' as completion from records",
    "flat_ids": f"with {_USAGE}, {_TOKENS}, sized as (select layer, max(code) + 1 as n from used group by layer) select row_number() over (order by v.layer, v.code) - 1 as nth, v.token_id from vocabulary v join sized s on s.layer = v.layer and v.code < s.n",
    "farthest": f"with {_USABLE}, gaps as (select u.id, any_value(u.v) as v, min({_gap('u.v', 'c.centroid')}) as gap from usable u, codebook c where c.layer = 0 and c.code < 8 group by u.id) select {_sql_cells('v')} as cells from gaps order by gap desc, id limit 20",
    "layer_stats": _DISTIL + "select layer, n_start as target_size, n_start as active_codes, cast(n_start as double) / 16 as coverage, round(sum(d) / (count(*) * 64), 6) as mse, (select max(n) from (select layer as l, k, count(*) as n from finals group by 1, 2) where l = layer) as largest from finals join starts using (layer) group by layer, n_start",
    "distilled_map": _DISTIL + f"""select id as item_id, {_TEXT_CODES.format('teacher')} as teacher_codes, {_TEXT_CODES.format('codes')} as codes, {_SID.format('codes')} as sid from
        (select e.id, e.codes as teacher, [cast(a.code as bigint), cast(b.code as bigint), cast(c.code as bigint)] as codes from encoded e join done0 a using (id) join done1 b using (id) join done2 c using (id))""",
} | {f"init_rows_{m}": _init_sql(m) for m in transport.WEIGHT_MODES}
