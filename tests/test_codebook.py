import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sidforge.operators import codebook as C
from sidforge.operators import kmeans
from sidforge.operators import transport as T
from sidforge.plans.distill import distill
from sidforge.streaming.encode import encode_stream, write_stream

BOOK = C.Codebook([np.array([[0.0, 0.0], [4.0, 0.0], [4.0, 0.0]]), np.array([[0.0, 1.0], [1.0, 0.0]])])


def vectors(spark, x):
    return spark.createDataFrame([(str(i), [float(a) for a in v]) for i, v in enumerate(x)], "id string, v array<double>")


def points(spark, x):
    return vectors(spark, x).withColumn("w", F.lit(1.0))


def test_encode_decode(spark):
    df = spark.createDataFrame([("a", [5.0, 0.0]), ("b", [0.0, 0.9]), ("c", None)], "id string, embedding array<double>")
    coded = C.decode(C.encode(df, BOOK), BOOK)
    assert {r["id"]: (r["codes"], r["reconstruction"]) for r in coded.collect()} == {"a": ([1, 1], [5.0, 0.0]), "b": ([0, 0], [0.0, 1.0]), "c": (None, None)}
    loss = C.reconstruction_loss(coded, BOOK).first()
    assert loss["n_items"] == 2 and loss["mse"] == pytest.approx(0.01 / 4)
    assert C.reconstruction_loss(coded.limit(0), BOOK).first()["mse"] == 0
    assert [r["codes"] for r in C.encode(df.where("id = 'a'"), BOOK, n_layers=1).collect()] == [[1]]


def test_codebook_checks(spark):
    assert C.Codebook.from_table(BOOK.to_table(spark)).sizes == [3, 2] and C.Codebook.from_table(BOOK.to_table(spark), 1).n_layers == 1
    for call in (lambda: BOOK.head(3), lambda: BOOK.decode(np.array([[3, 0]])), lambda: C.Codebook([]), lambda: C.Codebook([np.zeros((2, 2)), np.zeros((2, 3))]), lambda: C.Codebook([np.array([[np.nan]])]), lambda: C.Codebook.from_table(BOOK.to_table(spark).where("code > 0")), lambda: C.Codebook.from_table(BOOK.to_table(spark), 3)):
        with pytest.raises(ValueError):
            call()


def test_another_layer_with_a_zero_never_raises_the_loss(spark):
    x = np.random.default_rng(0).normal(size=(200, 4))
    one = C.Codebook([x[:8]])
    two = C.Codebook([x[:8], np.vstack([np.zeros(4), x[8:12] / 3])])
    df = vectors(spark, x)
    loss = [C.reconstruction_loss(C.encode(df, b, "v"), b, "v").first()["mse"] for b in (one, two)]
    assert loss[1] <= loss[0]
    assert C.reencode_loss(C.encode(df, one, "v"), one, one).first()["mse"] == pytest.approx(0, abs=1e-20)


def test_collisions(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    assert tuple(C.collision_stats(df, F.col("s")).first()) == (3, 2, pytest.approx(1 / 3), 1, 2)
    assert tuple(C.collision_stats(df.limit(0), F.col("s")).first()) == (0, 0, 0.0, 0, 1)


def test_small_kmeans():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.01, (20, 2)) for c in ((0, 0), (5, 5), (9, 0))])
    centers, own, objective = kmeans.small_kmeans(x, np.ones(60), 3, 4, 50, 1)
    assert objective < 0.1 and sorted(np.bincount(own)) == [20, 20, 20] and len(centers) == 3
    same, own, zero = kmeans.small_kmeans(x[:3], np.ones(3), 3)
    assert (same == x[:3]).all() and zero == 0 and list(own) == [0, 1, 2]
    mean, _, _ = kmeans.small_kmeans(x, np.ones(60), 1, 1, 5, 0)
    assert np.allclose(mean[0], x.mean(axis=0))
    # a start from zero assignments sees no change for one cluster and keeps the seed
    seed, _, _ = kmeans.small_kmeans(x, np.ones(60), 1, 1, 5, 0, init=x[:1], update_first=False)
    assert (seed == x[:1]).all()
    for bad in (lambda: kmeans.small_kmeans(x, np.ones(3), 2), lambda: kmeans.small_kmeans(x, np.ones(60), 0), lambda: kmeans.small_kmeans(x, np.ones(60), 61), lambda: kmeans.small_kmeans(x, np.ones(60), 2, init=x[:3]), lambda: kmeans.small_kmeans(x * np.nan, np.ones(60), 2)):
        with pytest.raises(ValueError):
            bad()


def test_empty_clusters_move_to_distinct_far_points(spark):
    x = np.array([[0.0, 0.0], [0.1, 0.0], [10.0, 0.0], [0.0, 20.0]])
    start = np.array([[0.0, 0.0], [99.0, 99.0], [99.0, 99.0]])
    centers, _ = kmeans.refine(points(spark, x), start, 1)
    assert centers[1].tolist() == [0.0, 20.0] and centers[2].tolist() == [10.0, 0.0]


def test_single_refill_takes_one_point_for_all_empty_clusters():
    x = np.array([[0.0], [1.0], [10.0], [11.0]])
    start = np.array([[0.5], [100.0], [200.0]])
    # all four points are nearest to the first start; both empty clusters take the farthest point, 11, one after the other
    centers, own, _ = kmeans.small_kmeans(x, np.ones(4), 3, 1, 1, init=start, refill="single")
    assert centers.ravel().tolist() == [5.5, 11.0, 11.0] and own.tolist() == [0, 0, 1, 1]
    spread, _, _ = kmeans.small_kmeans(x, np.ones(4), 3, 1, 1, init=start)
    assert spread.ravel().tolist() == [5.5, 11.0, 10.0]
    with pytest.raises(ValueError):
        kmeans.small_kmeans(x, np.ones(4), 3, refill="other")


def test_refine_equals_small_kmeans(spark):
    x = np.random.default_rng(5).normal(size=(300, 3))
    far, objectives = kmeans.refine(points(spark, x).repartition(3), x[:5], 20)
    near, _, _ = kmeans.small_kmeans(x, np.ones(300), 5, 1, 20, init=x[:5])
    assert np.allclose(far, near)
    assert all(b <= a + 1e-9 for a, b in zip(objectives, objectives[1:]))
    with pytest.raises(ValueError):
        kmeans.refine(points(spark, x).limit(0), x[:2])


def test_relabel(spark):
    df = spark.createDataFrame([(0, 0, 2.0), (0, 1, 5.0), (0, 2, 2.0), (1, 0, 1.0)], "layer int, cluster int, weight double")
    assert {(r["layer"], r["cluster"]): r["new_cluster"] for r in kmeans.relabel(df).collect()} == {(0, 0): 1, (0, 1): 0, (0, 2): 2, (1, 0): 0}


def transport_rows(spark, rows):
    return spark.createDataFrame(rows, "layer int, teacher_code bigint, target_code bigint, distance_sq double, usage_count bigint")


def test_initial_rows(spark):
    old = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [4.0, 0.0]), (0, 2, [0.0, 8.0])], "layer int, code bigint, vec array<double>")
    rows = transport_rows(spark, [(0, 0, 0, 0.0, 3), (0, 1, 0, 1e9, 1), (0, 2, 3, 0.5, 0)])
    get = lambda *a: {r["code"]: r["vec"] for r in T.initial_rows(old, rows, *a).collect()}
    # code 1 takes the old row of its number, code 2 too; 3 is mapped
    assert get() == {0: [1.0, 0.0], 1: [4.0, 0.0], 2: [0.0, 8.0], 3: [0.0, 8.0]}
    assert get("uniform")[0] == [2.0, 0.0] and get("inverse_distance")[0] == [0.0, 0.0]
    far = transport_rows(spark, [(0, 0, 0, 1e9, 1), (0, 1, 0, 1e9, 1)])
    assert T.initial_rows(old, far, "inverse_distance").first()["vec"] == pytest.approx([4 / 3, 8 / 3])
    with pytest.raises(ValueError):
        T.initial_rows(old, rows, "nearest")


def test_sizes_must_agree(spark):
    rows = transport_rows(spark, [(0, 3, 1, 0.0, 1), (1, 2, 2, 0.0, 1)])
    ids = spark.createDataFrame([([1, 0],), ([0, 2],)], "codes array<bigint>")
    assert T.check_sizes(rows, ids) == [(0, 4, 2), (1, 3, 3)]
    for bad in (spark.createDataFrame([([1],)], "codes array<bigint>"), spark.createDataFrame([([2, 2],)], "codes array<bigint>")):
        with pytest.raises(ValueError):
            T.check_sizes(rows, bad)
    with pytest.raises(ValueError):
        T.check_sizes(rows.where("layer = 1"), ids)


def test_distill(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4))
    teacher = C.Codebook([x[:20], x[20:32] / 3])
    done = distill(vectors(spark, x), teacher, [6, 40], refine_iter=4)
    stats = done.stats
    assert stats["target_codebook_sizes"][0] == 6 and stats["layer_stats"][0]["actual_target_size"] == 6
    assert stats["layer_stats"][1]["actual_target_size"] == stats["layer_stats"][1]["active_teacher_codes"]
    weights = stats["layer_stats"][0]["top_refined_cluster_weights"]
    assert weights == sorted(weights, reverse=True) and sum(weights) == 300
    assert done.items.count() == 300 and done.transport.count() == 32
    assert stats["distilled_embedding_mse"] == pytest.approx(stats["layer_stats"][1]["layer_quantization_mse"])
    json.dumps(stats)
    with pytest.raises(ValueError):
        distill(vectors(spark, x), teacher, [6])


def test_stream_equals_batch(spark, tmp_path):
    rows = [(" a ", [5.0, 0.0]), ("b", [0.0, 0.9]), ("", [1.0, 1.0]), (None, [1.0, 1.0]), ("z", [0.0, 0.0]), ("s", [1.0])]
    spark.createDataFrame(rows, "pid string, embedding array<float>").write.parquet(str(tmp_path / "in"))
    arrivals = spark.readStream.schema("pid string, embedding array<float>").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        write_stream(encode_stream(arrivals, BOOK), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {(r["item_id"], tuple(r["codes"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", (1, 1)), ("b", (0, 0))}
