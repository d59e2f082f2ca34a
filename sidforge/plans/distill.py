"""Distilling a codebook: fewer centroids per layer, fitted to the items at hand."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.functions.sid import sid_from_codes
from sidforge.operators import kmeans
from sidforge.operators.codebook import Codebook, code_usage, collision_stats, encode, reconstruction_loss
from sidforge.operators.transport import transport_map
from sidforge.session import materialize


@dataclass(frozen=True)
class Distilled:
    """Results: codebook, ``item_id, teacher_codes, teacher_sid, codes, sid``, transport map, and the stats document."""

    codebook: Codebook
    items: DataFrame
    transport: DataFrame
    stats: dict


def distill(
    items: DataFrame, teacher: Codebook, sizes: list[int], count_power: float = 1.0, n_init: int = 8, init_iter: int = 50, refine_iter: int = 20, seed: int = 42, update_first: bool = True
) -> Distilled:
    """Distil ``teacher`` on ``items(id, v)``.

    Per layer: the active teacher centroids are compressed by weighted k-means on the driver (they are codebook-sized, and
    all randomness is here), or, when there are no more than asked for, taken in order of use; then refined over the items'
    residuals and numbered by falling cluster size. Codes are the assignments of the last refinement. The residuals of a
    layer are recomputed from the vectors row by row, so nothing but centroids passes from layer to layer.
    """
    spark = items.sparkSession
    if len(sizes) != teacher.n_layers or min(sizes) <= 0:
        raise ValueError("one positive size per layer is needed")
    coded = materialize(encode(items.select("id", "v"), teacher, "v", out="teacher_codes"), "teacher")
    loss = reconstruction_loss(coded, teacher, "v", "teacher_codes").first()
    n = loss["n_items"]
    if not n:
        raise ValueError("no items")
    usage = materialize(code_usage(coded, teacher.to_table(spark), "teacher_codes"), "usage")
    counts = [np.zeros(s, np.int64) for s in teacher.sizes]
    for r in usage.collect():  # codebook-sized
        counts[r["layer"]][r["code"]] = r["usage_count"]
    points = coded.select("id", "v", F.lit(1.0).alias("w"))
    layers: list[np.ndarray] = []
    stats = []
    for i, wanted in enumerate(sizes):
        active = np.flatnonzero(counts[i])
        actual = min(wanted, len(active), n)
        if actual <= 0:
            raise ValueError(f"layer {i} has no active codes")
        weights = counts[i][active].astype(np.float64) ** count_power
        if actual == len(active):
            order = np.argsort(-weights, kind="stable")
            start, start_weights, start_objective = teacher.layers[i][active][order], weights[order], 0.0
        else:
            centers, own, start_objective = kmeans.small_kmeans(teacher.layers[i][active], weights, actual, n_init, init_iter, seed + i, update_first=update_first)
            start, _, start_weights = kmeans.by_weight(centers, own, weights)
        rest = kmeans.residual(points, layers)
        refined, _ = kmeans.refine(rest, start, refine_iter)
        final = kmeans.assign_round(rest, refined)
        order = np.argsort(-final.mass, kind="stable")
        layers.append(refined[order])
        stats.append({
            "layer": i, "teacher_codebook_size": teacher.sizes[i], "requested_target_size": wanted, "actual_target_size": actual, "active_teacher_codes": len(active),
            "usage_coverage_ratio": len(active) / teacher.sizes[i], "teacher_init_objective": start_objective, "refine_objective": final.objective,
            "layer_quantization_mse": final.objective / (n * teacher.dim), "top_teacher_cluster_weights": start_weights[:10].tolist(), "top_refined_cluster_weights": final.mass[order][:10].tolist(),
        })
    book = Codebook(layers)
    done = encode(coded, book, "v", out="codes").withColumn("teacher_sid", sid_from_codes("teacher_codes")).withColumn("sid", sid_from_codes("codes"))
    done = materialize(done, "distilled")
    transport = transport_map(teacher.to_table(spark), book.to_table(spark), usage)
    described = {
        "num_items": n, "embedding_dim": teacher.dim, "n_layers": teacher.n_layers, "teacher_codebook_sizes": teacher.sizes, "target_codebook_sizes": book.sizes,
        "teacher_embedding_mse": loss["mse"], "distilled_embedding_mse": reconstruction_loss(done, book, "v", "codes").first()["mse"], "layer_stats": stats,
        "sid_collision": collision_stats(done, F.col("sid")).first().asDict(),
    }
    return Distilled(book, done.select(F.col("id").alias("item_id"), "teacher_codes", "teacher_sid", "codes", "sid"), transport, described)
