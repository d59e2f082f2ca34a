"""Mapping old codes to new ones and starting new token rows from old ones."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sidforge.functions.vectors import squared_distance
from sidforge.sources.validate import require_columns

WEIGHT_MODES = ("usage", "uniform", "inverse_distance")
REQUIRED = ("layer", "teacher_code", "target_code", "distance_sq", "usage_count")


def transport_map(teacher: DataFrame, target: DataFrame, usage: DataFrame) -> DataFrame:
    """``layer, teacher_code, target_code, distance_sq, usage_count, is_active_in_target_items`` for every teacher code.

    ``teacher`` and ``target`` are codebook tables, ``usage`` counts the teacher's codes. The target is the nearest of its
    layer, the lowest code among equals. Codebook-sized throughout: the targets of a layer travel as one array per row.
    """
    candidates = target.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct(F.col("code").cast("bigint").alias("code"), F.col("centroid").cast("array<double>").alias("c")))).alias("targets"))
    near = F.array_min(F.transform("targets", lambda t: F.struct(squared_distance(F.col("v"), t["c"]).alias("d"), t["code"].alias("code"))))
    rows = teacher.select("layer", F.col("code").cast("bigint").alias("teacher_code"), F.col("centroid").cast("array<double>").alias("v"))
    mapped = rows.join(candidates, "layer").withColumn("near", near)
    counted = usage.select("layer", F.col("code").cast("bigint").alias("teacher_code"), "usage_count")
    n = F.coalesce("usage_count", F.lit(0)).cast("bigint")
    return mapped.join(counted, ["layer", "teacher_code"], "left").select("layer", "teacher_code", F.col("near.code").alias("target_code"), F.col("near.d").alias("distance_sq"), n.alias("usage_count"), (n > 0).alias("is_active_in_target_items"))


def sizes_from_transport(transport: DataFrame) -> DataFrame:
    """``layer, old_size, new_size``: one more than the highest code seen."""
    require_columns(transport, REQUIRED, "transport map")
    return transport.groupBy("layer").agg((F.max("teacher_code") + 1).alias("old_size"), (F.max("target_code") + 1).alias("new_size"))


def sizes_from_codes(df: DataFrame, codes: str = "codes") -> DataFrame:
    """``layer, size`` of a code column: one more than the highest code of each position."""
    return df.select(F.posexplode(codes).alias("layer", "code")).groupBy("layer").agg((F.max("code") + 1).alias("size"))


def check_sizes(transport: DataFrame, sid_map: DataFrame, codes: str = "codes") -> list[tuple[int, int, int]]:
    """(layer, old size, new size), after making sure that transport map and item map agree in layers and new sizes.

    The highest target code counts, so a last centroid that nothing is mapped to makes the two disagree.
    """
    of_map = {r["layer"]: r["size"] for r in sizes_from_codes(sid_map, codes).collect()}
    layers = sorted((r["layer"], r["old_size"], r["new_size"]) for r in sizes_from_transport(transport).collect())
    if [x[0] for x in layers] != list(range(len(layers))):
        raise ValueError("layers of the transport map must be numbered from 0 without a gap")
    if len(layers) != len(of_map):
        raise ValueError(f"transport map has {len(layers)} layers, item map {len(of_map)}")
    for layer, _, new in layers:
        if of_map[layer] != new:
            raise ValueError(f"layer {layer}: transport map ends at {new} codes, item map at {of_map[layer]}")
    return layers


def row_weight(mode: str, usage_power: float = 1.0, temperature: float = 1.0) -> Column:
    """Weight of a transport row; usage counts below 1 count as 1."""
    if mode not in WEIGHT_MODES:
        raise ValueError(f"weight mode {mode!r} is none of {WEIGHT_MODES}")
    if mode == "uniform":
        return F.lit(1.0)
    used = F.pow(F.greatest(F.col("usage_count").cast("double"), F.lit(1.0)), F.lit(float(usage_power)))
    return used if mode == "usage" else used * F.exp(-F.col("distance_sq") / F.lit(max(temperature, 1e-8)))


def initial_rows(rows: DataFrame, transport: DataFrame, mode: str = "usage", usage_power: float = 1.0, temperature: float = 1.0, sizes: DataFrame | None = None) -> DataFrame:
    """``layer, code, vec``: for each new code the weighted mean of the old rows mapped to it.

    ``rows`` is ``layer, code, vec``. A code that nothing is mapped to takes the old row of its number, or the last one;
    weights that are not finite or don't sum above 0 give the plain mean of the layer's old rows; a transport row without an
    old row is an error. ``sizes(layer, new_size)``
    defaults to the transport map's. All columns are summed in one grouped pass over (layer, target code, position).
    """
    require_columns(transport, REQUIRED, "transport map")
    weighted = transport.select("layer", F.col("teacher_code").cast("bigint").alias("code"), F.col("target_code").cast("bigint").alias("target"), row_weight(mode, usage_power, temperature).alias("w"))
    old = rows.select("layer", F.col("code").cast("bigint").alias("code"), F.col("vec").cast("array<double>").alias("vec"))
    lacking = F.raise_error(F.concat_ws(" ", F.lit("no row of old code"), F.col("code"), F.lit("in layer"), F.col("layer"))).cast("array<double>")
    cells = weighted.join(old, ["layer", "code"], "left").select("layer", "target", "w", F.posexplode(F.coalesce("vec", lacking)).alias("at", "x"))
    bad = F.max(F.isnan("w") | (F.abs("w") == math.inf))
    means = cells.groupBy("layer", "target", "at").agg((F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("x"), (~bad & (F.sum("w") > 0)).alias("good"))
    vectors = lambda df, *keys: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("vec"))
    averaged = vectors(means.where("good"), "layer", "target")
    touched = means.select("layer", "target", "good").where("not good").distinct()
    overall = vectors(old.select("layer", F.posexplode("vec").alias("at", "x")).groupBy("layer", "at").agg(F.avg("x").alias("x")), "layer").withColumnRenamed("vec", "mean")
    last = old.groupBy("layer").agg(F.max("code").alias("last"))
    sizes = sizes_from_transport(transport) if sizes is None else sizes
    wanted = sizes.where("new_size > 0").select("layer", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("new_size").cast("bigint") - 1)).alias("target"))
    filled = (
        wanted.join(averaged, ["layer", "target"], "left")
        .join(touched.withColumn("void", F.lit(True)).drop("good"), ["layer", "target"], "left")
        .join(overall, "layer")
        .join(last, "layer")
        .withColumn("code", F.least("target", "last"))
    )
    fallback = old.withColumnRenamed("vec", "old")
    chosen = F.coalesce("vec", F.when(F.col("void"), F.col("mean")), F.col("old"))
    return filled.join(fallback, ["layer", "code"]).select("layer", F.col("target").alias("code"), chosen.alias("vec"))


def overwritten(model: DataFrame, new: DataFrame) -> DataFrame:
    """``model(token_id, vec)`` with the rows of ``new(token_id, vec)`` in place of its own; a token that the model lacks is an error."""
    unknown = F.raise_error(F.concat(F.lit("the model has no row of token "), F.col("token_id").cast("string"))).cast("array<double>")
    both = model.select("token_id", F.col("vec").cast("array<double>").alias("_old")).join(new.select("token_id", F.col("vec").alias("_new")), "token_id", "full")
    return both.select("token_id", F.when(F.col("_old").isNull(), unknown).otherwise(F.coalesce("_new", "_old")).alias("vec"))
