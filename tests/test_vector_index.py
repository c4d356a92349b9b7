"""The approximate vector index against exact search on all rows."""

import os

import numpy as np
import pytest

from hippospark.operators.vector_index import VectorIndex
from hippospark.plans.recall_queries import vector_index_search


def exact(held, q, k):
    ids = sorted(held)
    x = np.array([held[i] for i in ids])
    score = np.round(x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), 6)
    order = np.lexsort((ids, -score))[:k]
    return [ids[i] for i in order]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(30, 16))
    return {i: (centers[i % 30] + 0.6 * rng.normal(size=16)).tolist() for i in range(2_000)}


def test_recall_insertion_removal_and_compaction(spark, tmp_path, table):
    index = VectorIndex(spark, f"file://{tmp_path}/index", "long", per_list=40)
    frame = lambda x: spark.createDataFrame(list(x.items()), "id long, v array<double>")
    index.insert(frame({i: v for i, v in table.items() if i < 1_400}))
    index.insert(frame({i: v for i, v in table.items() if i >= 1_400}))
    assert index.state()[1]["live"] == 2_000 and len(index.state()[1]["centroids"]) == 35

    def recall(held, **more):
        hits = [set(exact(held, np.array(held[i]), 10)) & {r["id"] for r in index.search(held[i], 10, **more).collect()} for i in list(held)[:: len(held) // 12]]
        return sum(map(len, hits)) / (10 * len(hits))

    assert recall(table) >= 0.9 and recall(table, probes=1_000) == 1.0
    plan = index.search(table[0], 10)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "list#" in plan.split("PartitionFilters", 1)[1][:80]
    # removal and replacement
    gone = [i for i in table if i % 4 == 0]
    index.remove(spark.createDataFrame([(i,) for i in [*gone, 99_999]], "id long"))
    held = {i: v for i, v in table.items() if i % 4}
    assert index.state()[1]["live"] == len(held) and index.state()[1]["marked"] == len(gone)
    assert recall(held) >= 0.9 and not {r["id"] for r in index.search(table[0], 50).collect()} & set(gone)
    swapped = {i: table[i + 1] for i in list(held)[:30]}
    index.insert(frame(swapped))
    held |= swapped
    assert index.state()[1]["live"] == len(held)
    # more than half as many are marked now: written anew
    index.remove(spark.createDataFrame([(i,) for i in list(held)[-300:]], "id long"))
    held = {i: v for i, v in list(held.items())[:-300]}
    s = index.state()[1]
    assert s["live"] == len(held) and s["marked"] == 0 and len(s["segments"]) == 1 and not s["marks"]
    assert recall(held) >= 0.9 and recall(held, probes=1_000) == 1.0


def test_odd_vectors_take_no_part(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/index")
    assert index.search([1.0, 0.0]).count() == 0
    rows = [("a", [3.0, 4.0]), ("a", [3.0, 4.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [float("nan"), 1.0]), ("e", [float("inf"), 1.0]), (None, [1.0, 1.0]), ("f", [None, 1.0]), ("g", [4.0, 3.0])]
    index.insert(spark.createDataFrame(rows, "id string, v array<double>"))
    assert [tuple(r) for r in index.search([6.0, 8.0]).collect()] == [("a", 1.0), ("g", 0.96)]
    assert index.search([0.0, 0.0]).count() == 0
    index.insert(spark.createDataFrame([], "id string, v array<double>"))
    assert index.state()[1]["live"] == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_recall_of_the_query(spark):
    """Every query of it, against exact search over all embeddings."""
    d = "/root/testdata/sf0.01"
    held = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{d}/embeddings.parquet").collect() if r["embedding"] is not None}
    got = {}
    for r in vector_index_search(spark, d).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert set(got) == {i for i in held if i % 100 == 0}
    hits = [len(got[i] & set(exact(held, np.array(held[i], float), 10))) for i in got]
    assert sum(hits) >= 0.9 * 10 * len(hits)
