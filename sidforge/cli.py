"""Command line: one command for each step from raw files to new token rows."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sidforge.operators import codebook as C
from sidforge.operators import decoding as D
from sidforge.operators import items as I  # noqa: E741
from sidforge.operators import transport as T
from sidforge.plans.distill import distill
from sidforge.session import ship_package
from sidforge.sources import readers as R
from sidforge.sources import validate as V
from sidforge.sources import writers as K


def plug_in(name: str):  # noqa: ANN201
    """The object ``module:name``, such as an embedder for ``items.embed_items``."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"not of the form module:name: {name}")
    return getattr(importlib.import_module(module), attribute)


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    """Interactions and metadata to the item table and, by an embedder (module:name of a text column function), the item embeddings."""
    if a.source_meta and a.source_domains and len(a.source_meta) != len(a.source_domains):
        raise ValueError("as many source domains as source files are needed")
    names = a.source_domains or [R.domain_of(p) for p in a.source_meta]
    sources = [I.MetaSource(R.read_metadata(spark, p), d) for p, d in zip(a.source_meta, names)]
    seen = R.read_interactions(spark, a.interactions)
    V.require_rows(I.seen_items(seen), "interactions with item ids")
    rows = I.prepare_items(seen, I.MetaSource(R.read_metadata(spark, a.target_meta), a.target_domain), sources, a.scope)
    V.require_rows(rows, "items")
    K.write_table(rows.drop("source_no", "first_line"), a.output)
    if a.embedder:
        K.write_table(I.embed_items(spark.read.parquet(a.output), plug_in(a.embedder)), a.embeddings_output or K.embeddings_path(a.output))
    lost = I.missing_items(seen, rows).count()
    if lost:
        print(f"{lost} seen items have no metadata")


def encode(spark: SparkSession, a: argparse.Namespace) -> None:
    """Embeddings to codes, with the loss on a sample or on all."""
    book = R.read_codebook(spark, a.codebook, a.layers)
    vectors = R.read_embeddings(spark, a.embeddings, strict=False)
    key = vectors.columns[0]
    coded = C.encode(vectors.withColumn("nth", F.monotonically_increasing_id()), book)
    path = K.write_table(coded.select(key, "codes"), a.output or (K.distilled_codes_path if a.distilled else K.codes_path)(a.embeddings))
    measured = coded if a.distilled else C.first_rows(coded, F.col("nth"))
    print(json.dumps({"output": path, **C.reconstruction_loss(measured, book).first().asDict()}))


def sid_map(spark: SparkSession, a: argparse.Namespace) -> None:
    """Item table and codes to the semantic id map."""
    V.require_file(spark, a.metadata, "metadata")
    V.require_file(spark, a.codes, "codes")
    codes = spark.read.parquet(a.codes)
    key = "pid" if "pid" in codes.columns else "item_id"
    V.require_columns(codes, [key, "codes"], "codes")
    K.write_table(I.build_sid_map(spark.read.parquet(a.metadata), codes.select(F.col(key).alias("item_id"), "codes"), a.layers), a.output)


def distil(spark: SparkSession, a: argparse.Namespace) -> None:
    """A smaller codebook fitted to the items; map, transport map, codebook and stats."""
    teacher = R.read_codebook(spark, a.codebook, a.layers)
    vectors = R.read_embeddings(spark, a.embeddings, dim=teacher.dim)
    done = distill(vectors.select(F.col(vectors.columns[0]).alias("id"), F.col("embedding").alias("v")), teacher, V.parse_sizes(a.sizes, teacher.n_layers), a.count_power, a.restarts, a.init_iterations, a.refine_iterations, a.seed)
    out = a.output_dir.rstrip("/")
    K.write_table(done.items, f"{out}/distilled_item_sid_map.parquet")
    K.write_table(done.transport, f"{out}/transport_map.parquet")
    K.write_codebook(spark, done.codebook, f"{out}/distilled_codebook.parquet", done.stats)
    print(K.write_json(spark, f"{out}/stats.json", done.stats))


def init_rows(spark: SparkSession, a: argparse.Namespace) -> None:
    """Token rows of the new codes from those of the old ones.

    The old rows are a table by layer and code (``rows``), or the rows of a model by token id (``model_rows``) with its
    vocabulary; then the new rows replace those of their tokens in the model's rows and, if asked for and there are any, in
    the rows of its output head.
    """
    transport = R.read_transport_map(spark, a.transport_map)
    sizes = T.check_sizes(transport, R.read_sid_map(spark, a.item_sid_map))
    V.parse_number_type(a.number_type)
    if bool(a.rows) == bool(a.model_rows) or bool(a.model_rows) != bool(a.vocabulary):
        raise ValueError("either rows, or model rows and a vocabulary are needed")
    out = a.output_dir.rstrip("/")
    if a.rows:
        rows = spark.read.parquet(a.rows)
        V.require_columns(rows, ["layer", "code", "vec"], "token rows")
        K.write_table(T.initial_rows(rows, transport, a.weight_mode, a.usage_power, a.temperature), f"{out}/rows.parquet")
    else:
        model, vocabulary = spark.read.parquet(a.model_rows), spark.read.parquet(a.vocabulary)
        V.require_columns(model, ["token_id", "vec"], "model rows")
        V.require_columns(vocabulary, ["token", "token_id"], "vocabulary")
        tokens = lambda nth: D.resolve_tokens(D.layer_tokens(spark.createDataFrame([(s[0], s[nth]) for s in sizes], "layer int, size bigint")), vocabulary).select("layer", "code", "token_id")
        old = tokens(1).join(model, "token_id").select("layer", "code", "vec")
        new = T.initial_rows(old, transport, a.weight_mode, a.usage_power, a.temperature)
        new = spark.read.parquet(K.write_table(new.join(tokens(2), ["layer", "code"]).select("layer", "code", "token_id", "vec"), f"{out}/rows.parquet"))
        K.write_table(T.overwritten(model, new), f"{out}/input_rows.parquet")
        if a.overwrite_head and a.head_rows:
            K.write_table(T.overwritten(spark.read.parquet(a.head_rows), new), f"{out}/head_rows.parquet")
    layers = [{"layer": layer, "old_size": before, "new_size": after, "num_rows_overwritten": after} for layer, before, after in sizes]
    summary = {
        "base_model_path": a.model_rows or a.rows, "transport_map": a.transport_map, "item_sid_map": a.item_sid_map, "weight_mode": a.weight_mode, "usage_power": a.usage_power,
        "distance_temperature": a.temperature, "overwrite_lm_head": a.overwrite_head, "layers": layers, "output_dir": a.output_dir,
    }
    print(K.write_json(spark, f"{out}/sid_embedding_init_summary.json", summary))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sidforge", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, **options) -> None:  # noqa: ANN001
        p = commands.add_parser(name, help=run.__doc__)
        p.set_defaults(run=run)
        for option, given in options.items():
            p.add_argument(f"--{option.replace('_', '-')}", **given)

    must, number, real = {"required": True}, lambda d: {"type": int, "default": d}, lambda d: {"type": float, "default": d}
    command("prepare", prepare, interactions=must, target_meta=must, target_domain=must, output=must, source_meta={"nargs": "*", "default": []}, source_domains={"nargs": "*", "default": []}, scope={"choices": I.SCOPES, "default": "all_meta"}, embedder={}, embeddings_output={})
    command("encode", encode, codebook=must, embeddings=must, output={}, layers=number(None), distilled={"action": "store_true"})
    command("sid-map", sid_map, metadata=must, codes=must, output=must, layers=number(3))
    command("distil", distil, codebook=must, embeddings=must, output_dir=must, sizes={"default": "256,256,256"}, layers=number(None), count_power=real(1.0), restarts=number(8), init_iterations=number(50), refine_iterations=number(20), seed=number(42))
    command("init-rows", init_rows, transport_map=must, item_sid_map=must, output_dir=must, rows={}, model_rows={}, vocabulary={}, head_rows={}, overwrite_head={"action": "store_true"}, weight_mode={"choices": T.WEIGHT_MODES, "default": "usage"}, usage_power=real(1.0), temperature=real(1.0), number_type={"default": "auto"})
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("sidforge").getOrCreate()
    ship_package(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
