"""The queries on the smallest tables, against SQL or a plain count."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from oracle import DATA, assert_same, connect

from sidforge.llm import queries as Q
from sidforge.llm.tokens import codec


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(Q.QUERIES[name](spark, DATA), connect(DATA), Q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_runs(spark, name):
    df = Q.QUERIES[name](spark, DATA)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def documents():
    return pq.read_table(f"{DATA}/documents.parquet").to_pandas()


def test_ids_and_sizes(spark):
    texts = documents()
    wanted = {k: codec().direct(t or "") for k, t in zip(texts["doc_id"], texts["text"])}
    assert {r["doc_id"]: list(r["ids"]) for r in Q.p7_ids(spark, DATA).collect()} == wanted
    assert {r[0] for r in Q.p9_found(spark, DATA).collect()} == {k for k, v in wanted.items() if len(v) > 1024}


def test_clusters_and_neighbours(spark):
    t = pq.read_table(f"{DATA}/item_embeddings.parquet").to_pandas()
    t["pid"] = t["pid"].fillna("").str.strip()
    good = [p != "" and v is not None and len(v) == 64 and np.isfinite(v.astype(float)).all() and np.any(v != 0) for p, v in zip(t["pid"], t["embedding"])]
    t = t[good].sort_values("row_no").drop_duplicates("pid", keep="last").sort_values("pid").reset_index(drop=True)
    x = np.stack(t["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    label = np.arange(len(x))
    for _ in range(len(x)):
        now = np.array([min(label[i], label[r].min(initial=len(x))) for i, r in enumerate(s >= 0.85)])
        if (now == label).all():
            break
        label = now
    wanted = {(t["pid"][j], t["pid"][i]) for i, j in enumerate(label) if i != j}
    assert {tuple(r) for r in Q.p6_found(spark, DATA).select("pid_a", "pid_b").collect()} == wanted
    near = {(t["pid"][i], t["pid"][j]) for i, r in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in r}
    found = {(r["id"], r["neighbour"]) for r in Q.p5_neighbours(spark, DATA).collect()}
    assert len(found & near) >= 0.9 * len(near)
