"""The permutation index within one cell: ordered nearest pivots, inverted files, footrule ranking, rerank."""

from __future__ import annotations

import numpy as np

#: Pivots in a permutation; a row is posted, with the place of the pivot, under each of them.
LENGTH = 8
#: Rows of a cell per pivot of it; the lists of a cell then hold LENGTH * ROWS_PER_PIVOT rows on average, whatever its size.
ROWS_PER_PIVOT = 8
#: Rows of least footrule distance that a query hands to the rerank (ties at the last place go along).
CANDIDATES = 224


def permutations(x: np.ndarray, pivots: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Numbers of the ``length`` most similar pivots of each row, most similar first."""
    length = min(length, len(pivots))
    out = np.empty((len(x), length), np.int32)
    right = np.ascontiguousarray(pivots.T)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ right
        near = np.argpartition(-s, length - 1, axis=1)[:, :length] if length < s.shape[1] else np.broadcast_to(np.arange(length), s.shape)
        out[at : at + 512] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
    return out


def agreement(length: int) -> np.ndarray:
    """What a pivot at places i and j of two permutations takes off their footrule distance, halved: (length, length)."""
    place = np.arange(length)
    return (length - np.maximum(place[:, None], place[None, :])).astype(np.uint8)


class InvertedFiles:
    """For each pivot the rows that have it in their permutation, with its place there."""

    def __init__(self, perms: np.ndarray, pivots: int):
        length = perms.shape[1]
        order = np.argsort(perms.reshape(-1), kind="stable")
        self.members, self.place = (order // length).astype(np.int32), (order % length).astype(np.uint8)
        self.sizes = np.bincount(perms.reshape(-1), minlength=pivots).astype(np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.perms, self.rows, self.weight = perms, len(perms), agreement(length).reshape(-1)

    def footrule(self, q: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of a query (its place in ``q``) and another row that share a pivot, by query, and their footrule distances.

        The lists of a query's pivots are read, and every entry takes its share off the distance of two permutations without
        a common pivot. ``total`` is working space of zeros, (queries, rows).
        """
        length = self.perms.shape[1]
        lists = self.perms[q].reshape(-1)
        reach = self.sizes[lists]
        ends = np.cumsum(reach, dtype=np.int32)
        spots = np.arange(int(ends[-1]), dtype=np.int32) + np.repeat(self.starts[lists] - (ends - reach), reach)
        own_place = np.repeat(np.tile(np.arange(length, dtype=np.uint8) * np.uint8(length), len(q)), reach)
        first = np.arange(len(q), dtype=np.int32) * np.int32(self.rows)
        cells = self.members[spots] + np.repeat(first, reach.reshape(len(q), -1).sum(axis=1))
        flat = total[: len(q)].reshape(-1)
        np.add.at(flat, cells, self.weight[own_place + self.place[spots]])
        flat[first + q.astype(np.int32)] = 0
        found = np.flatnonzero(flat)
        shared = flat[found].astype(np.int64)
        flat[found] = 0
        counts = np.diff(np.r_[np.searchsorted(found, first), len(found)])
        own = np.repeat(np.arange(len(q)), counts)
        return own, found - first[own], length * (length + 1) - 2 * shared


def closest(own: np.ndarray, distance: np.ndarray, queries: int, most: int) -> np.ndarray:
    """Which of the pairs are among their query's ``most`` of least distance; ties are kept whole."""
    top = int(distance.max(initial=0)) + 1
    table = np.bincount(own * top + distance, minlength=queries * top).reshape(queries, top)
    bound = (np.cumsum(table, axis=1) < most).sum(axis=1)
    return np.flatnonzero(distance <= bound[own])


def cell_neighbours(x: np.ndarray, k: int, stride: int = ROWS_PER_PIVOT, candidates: int = CANDIDATES, length: int = LENGTH, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a cell its ``k`` most similar others found by the index, -1 where there are fewer, and the cosines.

    Every ``stride``-th row is a pivot, so the rows should come in an order that says nothing about them.
    """
    n = len(x)
    rows, sims = np.full((n, k), -1, np.int64), np.full((n, k), -2.0, np.float32)
    if n < 2:
        return rows, sims
    pivots = x[::stride] if n > stride * length else x
    files = InvertedFiles(permutations(x, pivots, length), len(pivots))
    total = np.zeros((min(block, n), n), np.uint8)
    for at in range(0, n, block):
        q = np.arange(at, min(n, at + block))
        own, other, distance = files.footrule(q, total)
        counts = np.bincount(own, minlength=len(q))
        if counts.max(initial=0) > candidates:
            kept = closest(own, distance, len(q), candidates)
            own, other = own[kept], other[kept]
            counts = np.bincount(own, minlength=len(q))
        width = int(counts.max(initial=0))
        if not width:
            continue
        column = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        cosine, which = np.full((len(q), width), -2.0, np.float32), np.full((len(q), width), -1, np.int64)
        near, ends = x[other], np.cumsum(counts)
        cosine[own, column] = np.concatenate([near[end - c : end] @ x[i] for i, c, end in zip(q, counts, ends)])
        which[own, column] = other
        take = min(k, width)
        best = np.argpartition(-cosine, take - 1, axis=1)[:, :take]
        rows[q, :take], sims[q, :take] = np.take_along_axis(which, best, 1), np.take_along_axis(cosine, best, 1)
    return rows, sims
