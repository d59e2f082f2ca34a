"""Similarity clusters by a Gaussian mixture, settled by exact similarities within its components."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sidforge.llm.cells import cut_cells, hash_sample
from sidforge.llm.graph import connected_components
from sidforge.llm.tiles import paired_tiles
from sidforge.llm.vectors16 import DOUBT, equal_vectors, exactly_similar, fingerprint, unpack_arrow, without_copies
from sidforge.session import materialize, remove_path, scratch_path

DIMENSIONS = 32
#: Iterations at most; fewer when the log likelihood of a row gains less than SETTLED.
ITERATIONS, SETTLED = 10, 0.02
RIDGE = 0.05
#: Rows by hash from which mixtures start; all rows then go into every iteration and into the criterion.
START_ROWS = 8_192
#: Starting rows per component at least, which bounds the grid of component numbers; those of up to TOGETHER components share their passes.
ROWS_PER_COMPONENT, TOGETHER = 8, 256
#: Iterations on the starting rows, before those on all rows.
START_ITERATIONS = 5
#: A vector belongs to every component whose joint log density is within so many nats of its best one, and to its three best within eight times that.
MARGIN = 2.0
#: A cell of more rows is cut by a mixture of its own, with PARTS components for so many rows, where it is compared; one that doesn't fall apart is compared whole.
CELL_ROWS, PARTS = 16_384, 32
#: Rows of a component that the number of components of the mixture that parts the rows aims at, and components of it at most.
PLACE_ROWS, MAX_PLACES = 3_000, 4_096
#: A cell of more rows is cut before it goes to a task; one that doesn't fall apart is compared in pairs of tiles of half as many rows.
TASK_ROWS = 196_608
#: Cuts of a cell, one within the other, where it is compared. Cosines in memory at once.
DEPTH, BLOCK_CELLS = 4, 4_194_304
TYPICAL = 3
LANES = 32


def _summed(df: DataFrame, partial: Callable[[np.ndarray], np.ndarray], dim: int, width: int) -> np.ndarray:
    """Sum over all rows of ``partial(block of vectors)``: per split, then per lane, then of the at most LANES rows here."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                total += partial(unpack_arrow(batch.column(0).slice(at, 4096), dim))
        yield pa.record_batch([pa.array([TaskContext.get().partitionId() % LANES], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["lane", "total"])

    def lane(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lane": pdf["lane"].iloc[:1], "total": [np.sum(np.stack(list(pdf["total"])), axis=0)]})

    parts = df.select("vec").mapInArrow(split, "lane int, total array<double>").groupBy("lane").applyInPandas(lane, "lane int, total array<double>")
    rows = parts.collect()  # at most LANES rows
    return np.sum([r["total"] for r in rows], axis=0) if rows else np.zeros(width)


def moments(x: np.ndarray) -> np.ndarray:
    """Number, sum and second moments of the rows, in one array."""
    x = x.astype(np.float64)
    return np.r_[len(x), x.sum(axis=0), (x.T @ x).ravel()]


class Reduction:
    """Standardisation followed by projection on the leading principal axes."""

    def __init__(self, sums: np.ndarray, dim: int, dimensions: int):
        n = max(1.0, sums[0])
        self.mean = sums[1 : dim + 1] / n
        covariance = sums[dim + 1 :].reshape(dim, dim) / n - np.outer(self.mean, self.mean)
        self.scale = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
        values, vectors = np.linalg.eigh(covariance / np.outer(self.scale, self.scale))
        self.variances = values[::-1][:dimensions]
        self.axes = (vectors[:, ::-1][:, :dimensions] / self.scale[:, None]).astype(np.float32)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean.astype(np.float32)) @ self.axes


class Mixture:
    """Gaussian mixture whose components share one covariance, the pooled one within components plus a ridge.

    Components then differ in place and weight only: none can grow broad and swallow a third of the rows, each costs the
    criterion d + 1 parameters, and the joint log densities of a row are linear in it up to a term all components have.
    """

    def __init__(self, weights: np.ndarray, means: np.ndarray, covariance: np.ndarray):
        self.weights, self.means, self.covariance = weights, means, covariance
        d = means.shape[1]
        self.precision = np.linalg.inv(covariance)
        linear = means @ self.precision
        constant = np.log(weights) - 0.5 * (np.linalg.slogdet(covariance)[1] + d * np.log(2 * np.pi) + (linear * means).sum(axis=1))
        self.constant, self.linear = constant.astype(np.float32), np.ascontiguousarray(linear.T.astype(np.float32))

    def scores(self, z: np.ndarray) -> np.ndarray:
        """Joint log densities of rows and components, without the term that is the same for all components."""
        return z @ self.linear + self.constant

    def common(self, z: np.ndarray) -> np.ndarray:
        """The term of each row that :meth:`scores` leaves out."""
        return -0.5 * np.einsum("ij,ij->i", z @ self.precision.astype(np.float32), z)

    def partial(self, z: np.ndarray) -> np.ndarray:
        """What the rows add to the log likelihood and to the sums of an iteration, in one array."""
        k, d = self.means.shape
        likelihood, n, sums, second = 0.0, np.zeros(k), np.zeros((k, d)), np.zeros((d, d))
        for at in range(0, len(z), 1024):
            part = z[at : at + 1024]
            r = self.scores(part)
            top = r.max(axis=1, keepdims=True)
            np.subtract(r, top, out=r)
            np.exp(r, out=r)
            total = r.sum(axis=1, keepdims=True)
            r /= total
            likelihood += float((top + np.log(total)).sum(dtype=np.float64) + self.common(part).sum(dtype=np.float64))
            n += r.sum(axis=0, dtype=np.float64)
            sums += r.T @ part
            second += part.T.astype(np.float64) @ part
        return np.r_[likelihood, n, sums.ravel(), second.ravel()]

    def width(self) -> int:
        """Length of :meth:`partial`."""
        k, d = self.means.shape
        return 1 + k + k * d + d * d

    def following(self, total: np.ndarray, rows: int, ridge: float) -> Mixture:
        """The mixture after an iteration whose sums over ``rows`` rows are ``total``."""
        k, d = self.means.shape
        n, sums, second = total[1 : 1 + k], total[1 + k : 1 + k + k * d].reshape(k, d), total[1 + k + k * d :].reshape(d, d)
        # a component that lost its rows keeps its place
        means = np.where((n > 1e-3)[:, None], sums / np.maximum(n, 1e-9)[:, None], self.means)
        covariance = (second - (means.T * n) @ means) / rows + ridge * np.eye(d)
        weights = np.maximum(n, 1e-6)
        return Mixture(weights / weights.sum(), means, covariance)

    def step(self, z: np.ndarray, ridge: float) -> tuple[float, Mixture]:
        """Log likelihood of the rows under this mixture, and the mixture after one iteration on them."""
        total = self.partial(z)
        return float(total[0]), self.following(total, len(z), ridge)

    def information(self, likelihood: float, n: int) -> float:
        """Bayesian information criterion; smaller is better."""
        k, d = self.means.shape
        return -2 * likelihood + (k * (1 + d) - 1 + d * (d + 1) / 2) * np.log(max(n, 2))


class Seeds:
    """Rows drawn one after another, each with a chance in proportion to its squared distance from the nearest one drawn so far."""

    def __init__(self, z: np.ndarray):
        self.z, self.rng, self.norms = z, np.random.default_rng(42), np.einsum("ij,ij->i", z, z)
        self.rows: list[int] = []
        self.far = np.ones(len(z), np.float32)

    def first(self, k: int) -> np.ndarray:
        """The first ``k`` rows of the sequence; fewer when all rows are equal to drawn ones."""
        while len(self.rows) < k and self.far.max(initial=0) > 0:
            total = np.cumsum(self.far, dtype=np.float64)
            at = int(min(np.searchsorted(total, self.rng.random() * total[-1], "right"), len(total) - 1))
            away = self.norms - 2 * (self.z @ self.z[at]) + self.norms[at]
            away[away < 1e-6] = 0
            self.far = np.minimum(self.far, away) if self.rows else away
            self.far[at] = 0
            self.rows.append(at)
        return self.z[self.rows[:k]].astype(np.float64)


def _started(z: np.ndarray, seeds: Seeds, k: int, iterations: int) -> tuple[float, Mixture]:
    """Log likelihood and mixture of ``k`` seeded components (fewer for lack of rows) after the iterations on ``z``."""
    spread, means = np.maximum(z.var(axis=0, dtype=np.float64), 1e-6), seeds.first(k)
    current, last = Mixture(np.full(len(means), 1 / len(means)), means, np.diag(spread) * (1.0 if k == 1 else 0.3)), -np.inf
    for _ in range(iterations):
        likelihood, following = current.step(z, RIDGE * float(spread.mean()))
        if likelihood - last < SETTLED * len(z):
            break
        current, last = following, likelihood
    return likelihood, current


def _grid(rows: int) -> list[int]:
    """Numbers of components: 1 and, doubling, 16, 32, ... as far as there are rows."""
    return [1] + [16 << i for i in range(32) if 16 << i <= rows / ROWS_PER_COMPONENT]


def fit_mixture(z: np.ndarray, iterations: int = ITERATIONS) -> tuple[Mixture, list[tuple[int, float]]]:
    """The mixture of least information criterion for the reduced rows ``z``, and the criterion of each number of components tried.

    Tried are 1 and, doubling, 16, 32, ..., until beyond 64 the criterion has risen or there are too few rows for more.
    """
    z = np.ascontiguousarray(z, dtype=np.float32)
    seeds, best, scores = Seeds(z), None, []
    for k in _grid(len(z)):
        likelihood, current = _started(z, seeds, k, iterations)
        scores.append((len(current.means), current.information(likelihood, len(z))))
        if best is None or scores[-1][1] < best[1]:
            best = current, scores[-1][1]
        elif k > 64 or len(current.means) < k:
            break
    return best[0], scores


def starting_mixtures(z: np.ndarray, sizes: list[int] | None = None, iterations: int = START_ITERATIONS) -> list[Mixture]:
    """A mixture of every number of components of ``sizes`` (the grid), to start from; distinct rows may end it."""
    z = np.ascontiguousarray(z, dtype=np.float32)
    seeds, found = Seeds(z), []
    for k in sizes or _grid(len(z)):
        found.append(_started(z, seeds, k, iterations)[1])
        if len(found[-1].means) < k:
            break
    return found


def fit_to_all(
    base: DataFrame, reduce: Reduction, starts: list[Mixture], n: int, dim: int, places: int = 1, iterations: int = ITERATIONS
) -> tuple[Mixture, list[tuple[int, float]], Mixture]:
    """As :func:`fit_mixture`, on all ``n`` rows of ``base``: likelihoods and the sums of every iteration come from all of them, one pass each.

    Mixtures of up to TOGETHER components share two passes; then each further one has two, until the criterion has risen.
    The best one has passes of its own until it settles. The last given is the least one of at least ``places`` components
    (else the largest), after two passes or more.
    """
    # standardised components have variance 1, so the reduced rows have these
    ridge = RIDGE * float(np.maximum(reduce.variances, 1e-6).mean())

    def passed(mixtures: list[Mixture]) -> tuple[list[float], list[Mixture]]:
        ends = np.cumsum([m.width() for m in mixtures])

        def partial(x: np.ndarray) -> np.ndarray:
            z = reduce(x)
            return np.concatenate([m.partial(z) for m in mixtures])

        totals = np.split(_summed(base, partial, dim, int(ends[-1])), ends[:-1])
        return [float(t[0]) for t in totals], [m.following(t, n, ridge) for m, t in zip(mixtures, totals)]

    tried, scores = [], []
    few = [m for m in starts if len(m.means) <= TOGETHER]
    for batch in [few, *([m] for m in starts[len(few) :])]:
        first = passed(batch)[1]
        tried += zip(first, *passed(first))
        scores = [(len(m.means), m.information(likelihood, n)) for m, likelihood, _ in tried]
        least = int(np.argmin([s for _, s in scores]))
        if least < len(tried) - 1:
            break
    current, last, following = tried[least]
    for _ in range(iterations - 2):
        (likelihood,), (further,) = passed([following])
        if likelihood - last < SETTLED * n:
            break
        current, last, following = following, likelihood, further
    if len(current.means) >= places:
        return current, scores, current
    at = next((i for i, m in enumerate(starts) if len(m.means) >= places), len(starts) - 1)
    return current, scores, tried[at][2] if at < len(tried) else passed(passed([starts[at]])[1])[1][0]


def memberships(scores: np.ndarray, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray]:
    """Row and component of every membership: components within ``margin`` of the row's best one, and of its three best those within eight times that."""
    best = scores.max(axis=1, keepdims=True)
    taken = scores >= best - margin
    few = min(3, scores.shape[1])
    near = np.argpartition(-scores, few - 1, axis=1)[:, :few]
    rows, nth = np.nonzero(np.take_along_axis(scores, near, 1) >= best - 8 * margin)
    taken[rows, near[rows, nth]] = True
    return np.nonzero(taken)


def _joined(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Group numbers after the groups of rows ``a`` and ``b`` are joined; a number is the group's first row."""
    a, b = group[a], group[b]
    while (a != b).any():
        a, b = a[a != b], b[a != b]
        np.minimum.at(group, np.maximum(a, b), np.minimum(a, b))
        # group numbers are rows; follow them to rows that stand for themselves
        while (group[group] != group).any():
            group = group[group]
        a, b = group[a], group[b]
    return group


def own_mixture(x: np.ndarray, k: int, iterations: int = 4) -> tuple[Reduction, Mixture] | None:
    """Rotation and mixture of at most ``k`` components of the rows of one cell; all go into every iteration. None when the cell has one place only."""
    own = Reduction(sum(moments(x[at : at + 4096]) for at in range(0, len(x), 4096)), x.shape[1], x.shape[1])
    z = np.concatenate([own(x[at : at + 4096]) for at in range(0, len(x), 4096)])
    # places to start from are drawn among rows at equal distances
    mixture = _started(z, Seeds(np.ascontiguousarray(z[:: max(1, len(z) // (64 * k))])), k, iterations)[1]
    return (own, mixture) if len(mixture.means) > 1 else None


def _placed(model: tuple[Reduction, Mixture], x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    parts = [(at, *memberships(model[1].scores(model[0](x[at : at + 4096])), margin)) for at in range(0, len(x), 4096)]
    return np.concatenate([at + r for at, r, _ in parts]), np.concatenate([c for _, _, c in parts])


def cell_groups(x: np.ndarray, threshold: float, cell_rows: int = CELL_ROWS, margin: float = MARGIN, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`linked_groups`; more than ``cell_rows`` rows are cut by a mixture of their own, and every two rows that share a last part are compared."""
    model = own_mixture(x, int(np.ceil(PARTS * len(x) / cell_rows))) if len(x) > cell_rows and depth else None
    if model is None:
        return linked_groups(x, threshold)
    rows, parts = _placed(model, x, margin)
    if np.bincount(parts).max() > 0.9 * len(x):
        return linked_groups(x, threshold)
    order = np.argsort(parts, kind="stable")
    group, unsure = np.arange(len(x)), []
    for own in np.split(rows[order], np.flatnonzero(np.diff(parts[order])) + 1):
        linked, doubtful = cell_groups(x[own], threshold, cell_rows, margin, depth - 1)
        moved = np.flatnonzero(linked != np.arange(len(own)))
        group = _joined(group, own[moved], own[linked[moved]])
        unsure.append(own[doubtful])
    unsure = np.unique(np.concatenate(unsure), axis=0)
    return group, unsure[group[unsure[:, 0]] != group[unsure[:, 1]]]


def linked_groups(x: np.ndarray, threshold: float, first: np.ndarray | None = None, second: np.ndarray | None = None, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each row: rows are linked when their cosine surely reaches ``threshold``, links carry over; and doubtful pairs.

    Every two rows are compared, or every row of ``first`` with every one of ``second``. A group is numbered by its first row.
    Doubtful are the pairs of different groups whose cosine is nearer to the threshold than packed vectors can tell.
    """
    group = np.arange(len(x))
    rows, others = (group.copy(), group.copy()) if first is None else (first, second)
    right = np.ascontiguousarray(x[others].T)
    unsure, block = [], max(1, min(block, BLOCK_CELLS // max(1, len(others))))
    for at in range(0, len(rows), block):
        part = rows[at : at + block]
        start = at if first is None else 0
        s = x[part] @ right[:, start:]
        hits = np.flatnonzero(s >= threshold - DOUBT)
        i, j = np.divmod(hits, len(others) - start)
        a, b = part[i], others[start + j]
        sure = s.reshape(-1)[hits] >= threshold + DOUBT
        unsure.append(np.stack([a[~sure & (a != b)], b[~sure & (a != b)]], axis=1))
        group = _joined(group, a[sure], b[sure])
    unsure = np.concatenate(unsure) if unsure else np.zeros((0, 2), np.int64)
    return group, unsure[group[unsure[:, 0]] != group[unsure[:, 1]]]


def similarity_clusters(
    vectors: DataFrame, full: DataFrame | None = None, threshold: float = 0.85, dim: int = 64, dimensions: int = DIMENSIONS, cell_rows: int = CELL_ROWS, margin: float = MARGIN, task_rows: int = TASK_ROWS, start_rows: int = START_ROWS
) -> DataFrame:
    """Cluster of every vector of ``usable_vectors``: ``id, cluster, density``.

    A Gaussian mixture is fitted by expectation-maximisation to the standardised, reduced vectors. Moments, the sums of its
    iterations and the Bayesian information criterion that chooses the number of components come from all rows; about
    ``start_rows`` of them, chosen by hash, only give places to start from. Where its components would be long, a mixture of
    more components, as many as the rows ask for and fitted likewise, parts the vectors instead: the criterion tells what
    describes them best, not what keeps comparisons few. Every vector joins its best component and the close ones
    (:func:`memberships`); a component of more than ``cell_rows`` rows is cut by a mixture of its own, fitted to all its
    rows in the task that compares them (:func:`cell_groups`), or before that when it has more than ``task_rows`` rows. Every
    two vectors sharing one of the last components are linked when their cosine reaches ``threshold`` (decided on the vectors of
    ``full`` where the packed ones leave a doubt); linked vectors are one cluster, named by its smallest id. ``density`` is the
    first mixture's log density. A vector similar to no other is a cluster of its own. Vectors that share none of the last
    components are not compared; links of others may still join them.

    Equal vectors are compared as one. A component that no mixture parts is compared whole, or in pairs of tiles, each a group
    of its own. An empty input gives an empty result.
    """
    spark = vectors.sparkSession
    base_path = scratch_path(spark, "vectors")
    base = materialize(vectors.select("id", "vec"), path=base_path)
    n = base.count()
    if not n:
        return spark.createDataFrame([], "id string, cluster string, density double")
    copies = equal_vectors(base)
    dimensions = min(dimensions, dim)
    reduce = Reduction(_summed(base, moments, dim, 1 + dim + dim * dim), dim, dimensions)

    def fit_first(group: pa.Table) -> pa.Table:
        x = unpack_arrow(group.column("vec"), dim)
        z = reduce(x[np.lexsort(x.T[: min(4, dim)])])
        return pa.table([pa.array([pickle.dumps([fit_mixture(z)[0]] if n <= start_rows else starting_mixtures(z, sizes))], pa.binary())], names=["models"])

    places = next((k for k in (16 << i for i in range(32)) if k * PLACE_ROWS >= n or k >= MAX_PLACES))
    sizes = sorted({*_grid(start_rows), *([places] if places * ROWS_PER_COMPONENT > start_rows else [])})
    sample = hash_sample(base.select("vec"), n, max(start_rows, places * ROWS_PER_COMPONENT)).withColumn("one", F.lit(0))
    started = sample.groupBy("one").applyInArrow(fit_first, "models binary").collect()  # one row
    starts = pickle.loads(started[0][0]) if started else []
    if n > start_rows and starts:
        mixture, _, parting = fit_to_all(base, reduce, starts, n, dim, places)
    else:
        mixture = parting = starts[0] if starts else None
    sent = spark.sparkContext.broadcast((reduce, mixture, parting))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduce, mixture, parting = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = reduce(unpack_arrow(part.column(1), dim))
                scores = mixture.scores(z) if mixture else np.zeros((len(z), 1), np.float32)
                top = scores.max(axis=1)
                density = top + np.log(np.exp(scores - top[:, None]).sum(axis=1)) + (mixture.common(z) if mixture else 0.0)
                rows, cells = memberships(scores if parting is mixture else parting.scores(z), margin)
                ends = np.cumsum(np.bincount(rows, minlength=len(z)))
                cells = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(1 + cells.astype(np.int64)))
                yield pa.record_batch([part.column(0), part.column(1), cells, pa.array(density.astype(np.float64))], names=["id", "vec", "cells", "density"])

    def refit(x: np.ndarray, rows: int) -> tuple[Reduction, Mixture] | None:
        return own_mixture(x, int(np.ceil(PARTS * rows / task_rows)))

    def partial(model: tuple[Reduction, Mixture], x: np.ndarray) -> np.ndarray:
        return np.r_[len(x), model[1].partial(model[0](x))]

    def following(model: tuple[Reduction, Mixture], total: np.ndarray) -> tuple[Reduction, Mixture]:
        return model[0], model[1].following(total[1:], int(total[0]), RIDGE * float(np.maximum(model[0].variances, 1e-6).mean()))

    placed = without_copies(base, copies).select("id", "vec").mapInArrow(post, "id string, vec binary, cells array<bigint>, density double")
    placed = materialize(placed, "placed")
    some = not copies.isEmpty()
    others = materialize(base.select("id", fingerprint().alias("print")).join(copies, "print").where("id != representative").select("id", "representative"), "others") if some else None
    remove_path(spark, base_path)
    posted = placed.select(F.explode("cells").alias("cell"), "id", "vec")
    cells = cut_cells(posted, refit, lambda model, x: _placed(model, x, margin), dim, task_rows, start_rows, partial=partial, following=following, rounds=2)
    compare = lambda x: cell_groups(x, threshold, cell_rows, margin)
    settled = materialize(_linked(cells, full, threshold, dim, compare, task_rows, n), "settled")
    labelled = placed.select("id", "density").join(settled, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"), "density")
    if not some:
        return labelled
    labelled = materialize(labelled, "labelled")
    theirs = others.join(labelled.withColumnRenamed("id", "representative"), "representative").select("id", "cluster", "density")
    return labelled.unionByName(theirs)


def _linked(posted: DataFrame, full: DataFrame | None, threshold: float, dim: int, compare: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], task_rows: int, n: int) -> DataFrame:
    """``id, cluster`` of the vectors that are linked within cells; the cluster is the smallest id."""
    # the cells that stayed long come to the driver: at most (rows / task_rows) of them
    long = {r[0]: -(-2 * r[1] // task_rows) for r in posted.groupBy("cell").count().where(F.col("count") > task_rows).collect()} if n > task_rows else {}
    posted = paired_tiles(posted, "cell", long)

    def settle(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("id").to_pylist(), dtype=object)
        order = np.argsort(ids)
        x = unpack_arrow(group.column("vec"), dim)[order]
        ids = ids[order]
        side = group.column("side").to_numpy()[order]
        first, second = divmod(int(group.column("tile")[0].as_py()), 65536)
        # two sides of a long cell are compared with each other only; each has a tile of its own for the rest
        linked, unsure = compare(x) if first == second else linked_groups(x, threshold, np.flatnonzero(side == first), np.flatnonzero(side == second))
        other = np.flatnonzero(linked != np.arange(len(x)))
        a, b = np.r_[linked[other], unsure[:, 0]], np.r_[other, unsure[:, 1]]
        doubt = np.arange(len(a)) >= len(other)
        return pa.table([pa.array(ids[b], pa.string()), pa.array(ids[a], pa.string()), pa.array(doubt)], names=["id", "first", "doubt"])

    # in each group every linked vector points to the smallest id of its group
    found = materialize(posted.groupBy("cell", "tile").applyInArrow(settle, "id string, first string, doubt boolean").distinct(), "stars")
    stars = found.where("not doubt").select("id", "first")
    doubtful = found.where("doubt").select(F.col("first").alias("a"), F.col("id").alias("b"))
    if not doubtful.isEmpty():
        checked = exactly_similar(doubtful, full, threshold) if full is not None else doubtful.limit(0)
        stars = materialize(stars.unionByName(checked.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("first"))).distinct(), "stars")
    # pointers that differ for one vector, or that point on, join groups; only these need the general algorithm
    named = stars.groupBy("id").agg(F.min("first").alias("least"), F.count("*").alias("k"))
    joints = stars.join(named.where("k > 1").select("id", "least"), "id").where("first != least").select(F.col("first").alias("a"), F.col("least").alias("b"))
    onward = stars.select("first").distinct().join(named.select(F.col("id").alias("first"), "least"), "first").select(F.col("first").alias("a"), F.col("least").alias("b"))
    components = connected_components(joints.unionByName(onward))
    direct = named.select("id", "least").join(components.withColumnRenamed("node", "least"), "least", "left").select("id", F.coalesce("component", "least").alias("cluster"))
    # a smallest id of one group may be a member of another
    firsts = components.where("node != component").select(F.col("node").alias("id"), F.col("component").alias("cluster")).join(named.select("id"), "id", "left_anti")
    return direct.unionByName(firsts)


def cluster_profiles(clusters: DataFrame, typical: int = TYPICAL) -> DataFrame:
    """``cluster, size, typical`` of :func:`similarity_clusters`: the ids of highest density, ties by id; two salted steps."""
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("density"), "id"))
    salted = clusters.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("nth", rank("cluster", "salt")).where(F.col("nth") <= typical)
    best = salted.withColumn("nth", rank("cluster")).where(F.col("nth") <= typical)
    best = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"]).alias("typical"))
    return clusters.groupBy("cluster").agg(F.count("*").alias("size")).join(best, "cluster")
