"""Weighted k-means: small problems on the driver, refinement of centres over a distributed table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sidforge.operators.codebook import nearest

LEAST_WEIGHT = 1e-12
LANES = 32


def distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    gap = (x**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1)[None, :] - 2.0 * x @ centers.T
    return np.maximum(gap, 0.0)


def spread_seeds(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeds: the first drawn by weight, the others by weight times squared distance to the seeds so far."""
    pick = lambda p: int(rng.choice(len(points), p=p / p.sum())) if p.sum() > 0 else int(rng.integers(0, len(points)))
    rows = [pick(weights)]
    gap = distances(points, points[rows]).ravel()
    while len(rows) < k:
        rows.append(pick(weights * np.maximum(gap, LEAST_WEIGHT)))
        gap = np.minimum(gap, distances(points, points[rows[-1:]]).ravel())
    return points[rows].copy()


def small_kmeans(
    points: np.ndarray, weights: np.ndarray, k: int, n_init: int = 8, max_iter: int = 50, seed: int = 42, init: np.ndarray | None = None, update_first: bool = True, refill: str = "spread"
) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, assignments and objective of the best restart, for points of codebook size.

    ``init`` serves the first restart, the others are seeded by :func:`spread_seeds` from ``seed + restart``; the first of
    equal objectives wins. A restart ends when assignments stay as they are. Empty clusters move to the points of greatest
    weighted distance, each to another one (``refill`` "spread"), or, cluster by cluster in order, all to the one point of
    greatest weighted distance, which goes over to the cluster before later means are taken ("single"). With ``update_first`` false, a restart whose first assignment is all zeros ends
    before any update (as a start from zero assignments would). As many clusters as points: the points themselves.
    """
    if points.ndim != 2 or len(points) != len(weights):
        raise ValueError("points must be a matrix with one weight a row")
    if not 0 < k <= len(points):
        raise ValueError(f"k={k} must lie between 1 and the number of points, {len(points)}")
    if init is not None and init.shape != (k, points.shape[1]):
        raise ValueError(f"initial centres must have shape {(k, points.shape[1])}")
    if not np.isfinite(points).all():
        raise ValueError("points must be finite")
    if refill not in ("spread", "single"):
        raise ValueError(f"unknown way to refill clusters: {refill}")
    if len(points) == k:
        return points.copy(), np.arange(k), 0.0
    points, weights = np.asarray(points, np.float64), np.maximum(np.asarray(weights, np.float64), LEAST_WEIGHT)
    best: tuple[np.ndarray, np.ndarray, float] | None = None
    for restart in range(max(1, n_init)):
        centers = np.array(init, np.float64) if restart == 0 and init is not None else spread_seeds(points, weights, k, np.random.default_rng(seed + restart))
        own = np.full(len(points), -1 if update_first else 0)
        for _ in range(max(1, max_iter)):
            gap = distances(points, centers)
            now = gap.argmin(axis=1)
            if (now == own).all():
                break
            own = now
            if refill == "single":
                centers, own = _means_in_order(points, weights, centers, own, int((weights * gap.min(axis=1)).argmax()))
                continue
            mass = np.bincount(own, weights, k)
            sums = np.stack([np.bincount(own, weights * points[:, j], k) for j in range(points.shape[1])], axis=1)
            filled = np.bincount(own, minlength=k) > 0
            centers[filled] = sums[filled] / mass[filled, None]
            empty = np.flatnonzero(~filled)
            if len(empty):
                centers[empty] = points[np.argsort(-weights * gap.min(axis=1), kind="stable")[: len(empty)]]
        gap = distances(points, centers)
        own = gap.argmin(axis=1)
        objective = float((weights * gap[np.arange(len(points)), own]).sum())
        if best is None or objective < best[2]:
            best = centers.copy(), own, objective
    return best


def _means_in_order(points: np.ndarray, weights: np.ndarray, centers: np.ndarray, own: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means of the clusters, one after another; an empty one takes the point ``far`` from whichever has it by then."""
    centers, own = centers.copy(), own.copy()
    for cluster in range(len(centers)):
        mine = own == cluster
        if mine.any():
            centers[cluster] = weights[mine] @ points[mine] / weights[mine].sum()
        else:
            centers[cluster], own[far] = points[far], cluster
    return centers, own


def by_weight(centers: np.ndarray, own: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clusters renumbered by falling weight, the lower old number first among equals: centres, assignments, weights."""
    mass = np.bincount(own, weights, len(centers))
    order = np.argsort(-mass, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return centers[order], place[own], mass[order]


@dataclass(frozen=True)
class Round:
    """What one pass over the points found for a set of centres."""

    counts: np.ndarray
    mass: np.ndarray
    sums: np.ndarray
    objective: float
    #: digest of all assignments; equal digests mean that no point moved
    digest: int


def assign_round(points: DataFrame, centers: np.ndarray) -> Round:
    """One distributed pass over ``points(id, v, w)``: per split the sums of its points, added up in lanes, then here.

    To the driver comes one row per cluster and lane at most, whatever the number of points.
    """
    sent = points.sparkSession.sparkContext.broadcast(centers)
    k, dim = centers.shape

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        c, lane = sent.value, TaskContext.get().partitionId() % LANES
        counts, mass, sums, objective, digest = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, dim)), np.zeros(k), np.zeros(k, np.uint64)
        for frame in frames:
            if not len(frame):
                continue
            x, w = np.stack(frame["v"].to_numpy()).astype(np.float64), np.maximum(frame["w"].to_numpy(np.float64), LEAST_WEIGHT)
            own = nearest(x, c)
            gap = ((x - c[own]) ** 2).sum(axis=1)
            marks = pd.util.hash_array(frame["id"].to_numpy(), categorize=False)
            order = np.argsort(own, kind="stable")
            there, starts = np.unique(own[order], return_index=True)
            add = lambda a: np.add.reduceat(a[order], starts, axis=0)  # noqa: B023, E731
            counts[there] += add(np.ones(len(x), np.int64))
            mass[there] += add(w)
            sums[there] += add(x * w[:, None])
            objective[there] += add(w * gap)
            digest[there] += add(marks * (own.astype(np.uint64) + np.uint64(1)))
        hit = np.flatnonzero(counts)
        yield pd.DataFrame({"k": hit, "lane": lane, "n": counts[hit], "mass": mass[hit], "sums": list(sums[hit]), "objective": objective[hit], "digest": digest[hit].astype(np.int64)})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[:1].copy()
        with np.errstate(over="ignore"):
            first["n"], first["mass"], first["objective"], first["digest"] = frame["n"].sum(), frame["mass"].sum(), frame["objective"].sum(), frame["digest"].to_numpy().sum()
        first["sums"] = [np.sum(np.stack(frame["sums"].to_numpy()), axis=0)]
        return first

    schema = "k int, lane int, n bigint, mass double, sums array<double>, objective double, digest bigint"
    rows = points.select("id", "v", "w").mapInPandas(partial, schema).groupBy("k", "lane").applyInPandas(added, schema).collect()
    counts, mass, sums, objective, digest = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, dim)), 0.0, 0
    for r in sorted(rows, key=lambda r: (r["k"], r["lane"])):
        counts[r["k"]] += r["n"]
        mass[r["k"]] += r["mass"]
        sums[r["k"]] += np.asarray(r["sums"])
        objective += r["objective"]
        digest = (digest + r["digest"]) % (1 << 64)
    return Round(counts, mass, sums, objective, digest)


def farthest(points: DataFrame, centers: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` points of greatest weighted distance to their centre, ties by id."""
    sent = points.sparkSession.sparkContext.broadcast(centers)

    def gaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["v"].to_numpy()).astype(np.float64)
                gap = ((x - sent.value[nearest(x, sent.value)]) ** 2).sum(axis=1)
                yield frame[["id", "v"]].assign(gap=gap * np.maximum(frame["w"].to_numpy(np.float64), LEAST_WEIGHT))

    kind = points.schema["id"].dataType.simpleString()
    rows = points.select("id", "v", "w").mapInPandas(gaps, f"id {kind}, v array<double>, gap double").orderBy(F.desc("gap"), "id").limit(m).collect()
    return np.array([r["v"] for r in rows])


def refine(points: DataFrame, centers: np.ndarray, max_iter: int = 20) -> tuple[np.ndarray, list[float]]:
    """Lloyd rounds over ``points(id, v, w)`` from given centres: new centres and the objective before each round.

    Ends after ``max_iter`` rounds or when no point moved. The loop keeps no table between rounds: each is one pass over
    ``points`` with the centres of the last, so neither lineage nor plan grows. Empty clusters move to the farthest points.
    """
    centers, last, objectives = np.array(centers, np.float64), None, []
    for _ in range(max(1, max_iter)):
        found = assign_round(points, centers)
        if not found.counts.sum():
            raise ValueError("no points")
        objectives.append(found.objective)
        if found.digest == last:
            break
        last = found.digest
        filled = found.counts > 0
        moved = centers.copy()
        moved[filled] = found.sums[filled] / found.mass[filled, None]
        empty = np.flatnonzero(~filled)
        if len(empty):
            far = farthest(points, centers, len(empty))
            moved[empty[: len(far)]] = far
        centers = moved
    return centers, objectives


def relabel(sizes: DataFrame, weight: str = "weight", layer: str = "layer", cluster: str = "cluster") -> DataFrame:
    """``sizes`` with ``new_cluster``: rank by falling weight within the layer, the lower old number first among equals.

    The window runs over clusters, of which a layer has as many as its codebook, not over points.
    """
    order = W.partitionBy(layer).orderBy(F.desc(weight), cluster)
    return sizes.withColumn("new_cluster", F.row_number().over(order) - 1)


def train_residual(points: DataFrame, sizes: list[int], max_iter: int = 20, seed: int = 42, sample_rows: int = 20_000) -> list[np.ndarray]:
    """A residual codebook from scratch: per layer seeds from a hash sample of bounded size, refined over all points."""
    layers: list[np.ndarray] = []
    n = points.count()
    some = points if n <= sample_rows else points.where(F.xxhash64("id") < F.lit(int(sample_rows / n * 2**64) - 2**63))
    sample = np.array([r["v"] for r in sorted(some.select("id", "v").collect(), key=lambda r: r["id"])], np.float64)  # about sample_rows rows
    for i, k in enumerate(sizes):
        if not 0 < k <= len(sample):
            raise ValueError(f"layer {i} needs between 1 and {len(sample)} centroids, {k} asked for")
        start, _, _ = small_kmeans(sample, np.ones(len(sample)), k, 1, 10, seed + i)
        layers.append(refine(residual(points, layers), start, max_iter)[0])
        sample = sample - layers[-1][nearest(sample, layers[-1])]
    return layers


def residual(points: DataFrame, layers: list[np.ndarray]) -> DataFrame:
    """``points`` with what the given layers leave of their vectors, computed row by row."""
    if not layers:
        return points
    sent = points.sparkSession.sparkContext.broadcast(layers)

    def rest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["v"].to_numpy()).astype(np.float64)
                for c in sent.value:
                    x = x - c[nearest(x, c)]
                yield frame.assign(v=list(x))

    kind = points.schema["id"].dataType.simpleString()
    return points.select("id", "v", "w").mapInPandas(rest, f"id {kind}, v array<double>, w double")
