"""The most similar vectors of every vector, by a permutation index over pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sidforge.llm.cells import cut_cells, hash_sample
from sidforge.llm.permutations import CANDIDATES, ROWS_PER_PIVOT, cell_neighbours
from sidforge.llm.tiles import paired_tiles
from sidforge.llm.vectors16 import DOUBT, equal_vectors, exactly_similar, fingerprint, unpack, unpack_arrow, without_copies
from sidforge.session import materialize

#: Cells of the first level that a vector is posted to, by the number of pivots at most, and cells of the levels below. The more
#: pivots, the seldomer two neighbours have one of their nearest in common: 3 of 66 pivots are enough for 0.996 of the similar
#: pairs, 3 of 4,096 for 0.963, 4 of 4,096 for 0.990.
POSTS, POSTS_BELOW = ((256, 3), (None, 4)), 3
#: Rows of a cell that the number of first-level pivots aims at, and beyond which a cell is cut again.
AIM_ROWS, CELL_ROWS = 7_500, 24_576
#: First-level pivots at most (of 10 million vectors and more); they are broadcast, 1 MB at 64 components. Longer cells are cut again.
MAX_PIVOTS = 4_096


def pivots_and_posts(n: int, aim_rows: int = AIM_ROWS, max_pivots: int = MAX_PIVOTS) -> tuple[int, int]:
    """Number of first-level pivots of ``n`` vectors, and of cells that each vector is posted to."""
    for most, posts in POSTS:
        m = int(np.clip(np.ceil(n * posts / aim_rows), 1, max_pivots))
        if most is None or m <= most:
            return m, posts


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, posts: int) -> np.ndarray:
    """Numbers of the ``posts`` most similar pivots of each row."""
    posts = min(posts, len(pivots))
    if posts == len(pivots):
        return np.broadcast_to(np.arange(posts, dtype=np.int64), (len(x), posts))
    return np.concatenate([np.argpartition(-(x[i : i + 1024] @ pivots.T), posts - 1, axis=1)[:, :posts] for i in range(0, len(x), 1024)] or [np.zeros((0, posts), np.int64)])


def nearest_neighbours(
    vectors: DataFrame, k: int = 5, dim: int = 64, posts: int | None = None, aim_rows: int = AIM_ROWS, cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS, stride: int = ROWS_PER_PIVOT, candidates: int = CANDIDATES
) -> DataFrame:
    """The ``k`` most similar other vectors of each vector of ``usable_vectors``: ``id, rank, neighbour, similarity``.

    Pivots on two levels or more. A vector goes to the cells of its ``posts`` nearest first-level pivots, by default three, or
    four where there are many pivots (:func:`pivots_and_posts`); a cell of more than
    ``cell_rows`` is cut again by pivots of its own, until all are short. Within a cell each row is described by its ordered
    nearest pivots, every ``stride``-th row of the cell being one, and posted in their inverted files with their places;
    reading the files of a query's pivots gives the footrule distances to all rows that share one, the ``candidates`` of
    least distance (ties whole) are reranked by cosine, and the results of a vector's cells are merged.

    Equal vectors are one entry of the index with their number; their ids are expanded again at the end: a vector's copies
    come first, in id order, and a third of all rows being copies costs nothing.

    Approximate: neighbours that share no cell, or are no candidates there, are missed; on this project's data at least 0.9
    of the true ones are found. Similarities are right to about 1e-5, ties within that are settled by id. Fewer than k other
    vectors: fewer rows. An empty input gives an empty result. First-level pivots are a sample by hash; every vector is
    indexed and every vector is a query.
    """
    spark = vectors.sparkSession
    base = materialize(vectors.select("id", "vec"), "vectors")
    n = base.count()
    if not n:
        return spark.createDataFrame([], "id string, rank int, neighbour string, similarity double")
    copies = equal_vectors(base)
    distinct = without_copies(base, copies)
    m, usual = pivots_and_posts(n, aim_rows, max_pivots)
    posts = posts or usual
    # about m rows; copies may leave fewer, which makes cells longer
    sample = sorted(r[0] for r in hash_sample(distinct.select("vec"), n, m).collect()) if m > posts else []
    pivot_rows = spark.sparkContext.broadcast(unpack(sample, dim) if len(sample) > posts else np.zeros((1, dim), np.float32))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = nearest_pivots(unpack_arrow(batch.column(1), dim), pivot_rows.value, posts)
            taken = batch.take(pa.array(np.repeat(np.arange(len(cells)), cells.shape[1])))
            yield pa.record_batch([pa.array(1 + cells.reshape(-1).astype(np.int64)), taken.column(0), taken.column(1)], names=["cell", "id", "vec"])

    def fit(x: np.ndarray, rows: int) -> np.ndarray | None:
        want = int(np.clip(2 * POSTS_BELOW * rows / cell_rows, 4, 1_024))
        return np.ascontiguousarray(x[:: max(1, len(x) // want)]) if len(x) >= 4 else None

    def place(pivots: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = nearest_pivots(x, pivots, POSTS_BELOW)
        return np.repeat(np.arange(len(x)), near.shape[1]), near.reshape(-1)

    posted = distinct.select("id", "vec").mapInArrow(post, "cell bigint, id string, vec binary")
    posted = cut_cells(posted, fit, place, dim, cell_rows, 4_096)
    # cells that wouldn't fall apart, if any, are searched in pairs of tiles: at most one row for every cell_rows rows comes here
    long = {r[0]: -(-2 * r[1] // cell_rows) for r in posted.groupBy("cell").count().where(F.col("count") > cell_rows).collect()} if n * posts > cell_rows else {}
    posted = paired_tiles(posted, "cell", long)

    def search(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("id").to_pylist(), dtype=object)
        x = unpack_arrow(group.column("vec"), dim)
        # an order that says nothing about the rows, the same in every run
        order = np.lexsort((ids, (x[:, : min(dim, 8)] * 1e6).astype(np.int64).sum(axis=1) * np.int64(2_654_435_761) % 1_000_003))
        ids, x = ids[order], np.ascontiguousarray(x[order])
        rows, sims = cell_neighbours(x, k, stride, candidates)
        sizes = (rows >= 0).sum(axis=1)
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        near = pa.ListArray.from_arrays(offsets, pa.array(ids[rows[rows >= 0]], pa.string()))
        return pa.table([pa.array(ids, pa.string()), near, pa.ListArray.from_arrays(offsets, pa.array(sims[rows >= 0], pa.float32()))], names=["id", "near", "sims"])

    found = posted.groupBy("cell", "tile").applyInArrow(search, "id string, near array<string>, sims array<float>")
    # per query: the union of what its cells gave, best first, ties by id; cosines of a pair from two cells may differ in the last bit
    entry = lambda i, s: F.struct(i.alias("near"), (-s).alias("minus"))
    merged = found.select("id", F.zip_with("near", "sims", entry).alias("e")).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    once = F.filter("e", lambda x, i: (i == 0) | (x["near"] != F.get("e", i - 1)["near"]))
    merged = merged.select("id", F.slice(F.array_sort(F.transform(once, lambda x: F.struct(x["minus"].alias("minus"), x["near"].alias("near")))), 1, k).alias("e"))
    links = merged.select("id", F.explode("e").alias("e")).select("id", F.col("e.near").alias("near"), (-F.col("e.minus")).cast("double").alias("similarity"))
    return _with_copies(base, copies, links, k)


def similar_pairs(near: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` (a < b): pairs of :func:`nearest_neighbours` of at least ``threshold``; where packing leaves a doubt the vectors of ``full`` decide."""
    pairs = near.where(F.col("similarity") >= threshold - DOUBT).groupBy(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).agg(F.max("similarity").alias("s"))
    pairs = materialize(pairs, "pairs")
    doubtful = pairs.where(F.col("s") < threshold + DOUBT)
    sure = pairs.where(F.col("s") >= threshold + DOUBT).select("a", "b")
    return sure if doubtful.isEmpty() else sure.unionByName(exactly_similar(doubtful, full, threshold).select("a", "b"))


def _with_copies(base: DataFrame, copies: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """Expand links between representatives to all ids: copies first, then the neighbours' copies, cut at ``k``."""
    if copies.isEmpty():
        return _numbered(links.withColumnRenamed("near", "neighbour"), k)
    by_rank = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("minus"), "neighbour")))
    members = base.select("id", fingerprint().alias("print")).join(copies, "print").select("id", "representative")
    order = W.partitionBy("representative").orderBy("id")
    # salted first k + 1 ids of each group: enough to name k others of any member
    salted = W.partitionBy("representative", "salt").orderBy("id")
    leading = (
        members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
        .withColumn("nth", F.row_number().over(salted))
        .where(F.col("nth") <= k + 1)
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= k + 1)
        .groupBy("representative")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    # a neighbour stands for its first k ids
    named = links.join(leading.withColumnRenamed("representative", "near"), "near", "left").select(
        "id", "similarity", F.explode(F.coalesce(F.slice("ids", 1, k), F.array("near"))).alias("neighbour")
    )
    single = named.join(members.select("id"), "id", "left_anti")
    # members of a group: their first k copies, then what the representative found
    of_group = named.withColumnRenamed("id", "representative").unionByName(leading.select("representative", F.lit(1.0).alias("similarity"), F.explode("ids").alias("neighbour")))
    best = of_group.groupBy("representative").agg(F.slice(by_rank, 1, 2 * k + 1).alias("e"))
    grouped = members.join(best, "representative").select("id", F.explode("e").alias("e")).select("id", F.col("e.neighbour").alias("neighbour"), (-F.col("e.minus")).alias("similarity")).where("id != neighbour")
    every = single.select("id", "neighbour", "similarity").unionByName(grouped.select("id", "neighbour", "similarity"))
    return _numbered(every, k)


def _numbered(links: DataFrame, k: int) -> DataFrame:
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("minus"), "neighbour"))), 1, k)
    ranked = links.groupBy("id").agg(best.alias("e"))
    return ranked.select("id", F.posexplode("e").alias("at", "e")).select("id", (F.col("at") + 1).alias("rank"), F.col("e.neighbour").alias("neighbour"), (-F.col("e.minus")).alias("similarity"))
