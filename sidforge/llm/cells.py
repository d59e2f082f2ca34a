"""Overlapping cells of vectors, cut level by level until each has a bounded number of rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sidforge.llm.vectors16 import unpack_arrow
from sidforge.session import materialize, remove_path, scratch_path

#: Rows that one task takes up when a long cell is cut.
PART_ROWS = 65_536
#: The cells of the first level are 1, 2, ..., FAN; one cut once more becomes the cells FAN * cell + 1, 2, ...; five levels fit into 60 bits.
FAN, LEVELS = 4_096, 5


def hash_sample(rows: DataFrame, n: int, want: int) -> DataFrame:
    """About ``want`` of the ``n`` rows, chosen by the hash of the vector; all of them when there are no more.

    Rows are filtered where they are, so neither a sort nor the driver ever sees more than the sample.
    """
    if n <= want:
        return rows
    return rows.where(F.xxhash64("vec") < F.lit(int(want / n * 2**64) - 2**63))


def cut_cells(
    posted: DataFrame, fit: Callable[[np.ndarray, int], object], place: Callable[[object, np.ndarray], tuple[np.ndarray, np.ndarray]], dim: int, cell_rows: int, sample_rows: int, part_rows: int = PART_ROWS,
    partial: Callable[[object, np.ndarray], np.ndarray] | None = None, following: Callable[[object, np.ndarray], object] | None = None, rounds: int = 0,
) -> DataFrame:
    """``posted(cell bigint, id, vec, ...)`` with every cell of more than ``cell_rows`` rows cut into smaller ones, which may overlap.

    At each level ``fit(sample, rows of the cell)`` gives the model of a long cell, from at most about ``sample_rows`` of its
    vectors, and ``place(model, vectors)`` the row numbers and the new cells (0, 1, ...) they go to. With ``rounds`` the sample
    only starts the model: as often, ``partial(model, vectors)`` is summed over all rows of the cell, and
    ``following(model, sum)`` is its next model. A long cell is worked on
    by one task for every ``part_rows`` rows, to each of which its model is sent; models are neither collected nor
    broadcast, so there may be any number of them. A cell that doesn't fall apart, or is still long after LEVELS levels, is
    returned as it is.
    """
    long = materialize(posted.groupBy("cell").count().where(F.col("count") > cell_rows), "long")
    if long.isEmpty():
        return posted
    finished = [posted.join(long.select("cell"), "cell", "left_anti").select(posted.columns)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in posted.schema.fields)
    current = posted.join(long.select("cell"), "cell", "left_semi").select(posted.columns)

    def fit_cell(key: tuple, group: pa.Table) -> pa.Table:
        x = unpack_arrow(group.column("vec"), dim)
        order = np.lexsort(x.T[: min(4, dim)])
        model = fit(x[order], int(group.column("count")[0].as_py()))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([pickle.dumps(model)], pa.binary())], names=["cell", "model"])

    def place_part(group: pa.Table, models: pa.Table) -> pa.Table:
        model = pickle.loads(models.column("model")[0].as_py()) if models.num_rows else None
        if model is None or not group.num_rows:
            return group.drop_columns(["part"]).append_column("stuck", pa.array(np.ones(group.num_rows, bool)))
        rows, cells = place(model, unpack_arrow(group.column("vec"), dim))
        taken = group.drop_columns(["part"]).take(pa.array(rows))
        taken = taken.set_column(taken.schema.get_field_index("cell"), "cell", pa.array(taken.column("cell").to_numpy() * FAN + 1 + cells, pa.int64()))
        return taken.append_column("stuck", pa.array(np.zeros(len(rows), bool)))

    def sum_part(group: pa.Table, models: pa.Table) -> pa.Table:
        model = pickle.loads(models.column("model")[0].as_py()) if models.num_rows else None
        none = model is None or not group.num_rows
        total = [] if none else [sum(partial(model, unpack_arrow(group.column("vec").slice(at, 4_096), dim)) for at in range(0, group.num_rows, 4_096)).tolist()]
        return pa.table([pa.array([] if none else group.column("cell")[:1].to_pylist(), pa.int64()), pa.array(total, pa.list_(pa.float64()))], names=["cell", "total"])

    def next_model(models: pa.Table, totals: pa.Table) -> pa.Table:
        if not models.num_rows or not totals.num_rows:
            return models
        total = np.sum([np.asarray(t.values) for t in totals.column("total")], axis=0)
        return pa.table([models.column("cell"), pa.array([pickle.dumps(following(pickle.loads(models.column("model")[0].as_py()), total))], pa.binary())], names=["cell", "model"])

    for level in range(1, LEVELS):
        level_path = scratch_path(posted.sparkSession, "level")
        current = materialize(current, path=level_path)
        sample = current.join(long, "cell").where(F.xxhash64("vec", F.lit(level)) / F.lit(2.0**64) + 0.5 < F.lit(float(sample_rows)) / F.col("count"))
        models = sample.select("cell", "vec", "count").groupBy("cell").applyInArrow(fit_cell, "cell bigint, model binary")
        parts = F.ceil(F.col("count") / part_rows).cast("int")
        to_parts = lambda models: models.join(long, "cell").select("cell", "model", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).groupBy("cell", "part")  # noqa: E731, B023
        split = current.join(long, "cell").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).select(*posted.columns, "part")
        for _ in range(rounds):
            models = materialize(models, "models")
            totals = split.select("cell", "vec", "part").groupBy("cell", "part").cogroup(to_parts(models)).applyInArrow(sum_part, "cell bigint, total array<double>")
            models = models.groupBy("cell").cogroup(totals.groupBy("cell")).applyInArrow(next_model, "cell bigint, model binary")
        placed = split.groupBy("cell", "part").cogroup(to_parts(models)).applyInArrow(place_part, f"{fields}, stuck boolean")
        placed = materialize(placed, "placed")
        remove_path(posted.sparkSession, level_path)
        long = materialize(placed.where(~F.col("stuck")).groupBy("cell").count().where(F.col("count") > cell_rows), "long")
        if level == LEVELS - 1 or long.isEmpty():
            finished.append(placed.drop("stuck"))
            break
        finished.append(placed.where("stuck").drop("stuck"))
        finished.append(placed.where("not stuck").join(long.select("cell"), "cell", "left_anti").select(posted.columns))
        current = placed.where("not stuck").join(long.select("cell"), "cell", "left_semi").select(posted.columns)
    return reduce(DataFrame.unionByName, finished)
