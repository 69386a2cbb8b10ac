"""Queries over whole tables, held against brute force."""

import os

import numpy as np
import pytest

from tablesense.operators import retrieval as R
from tablesense.plans import q_answers, q_text

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def test_dense_search_takes_every_twentieth_row_as_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(2500, 8))
    v[:1250] = np.round(v[1250:])  # many ties
    v[40], v[41] = 0, v[60]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in q_text.dense_topk(spark, str(tmp_path)).collect()}
    w = v.astype(np.float32).astype(float)
    norms = np.linalg.norm(w, axis=1)
    want = {}
    for q in range(0, 2500, 20):
        scores = np.round(np.divide(w @ w[q], norms * norms[q], out=np.zeros(2500), where=norms * norms[q] != 0), 6)
        for rank, i in enumerate(sorted(range(2500), key=lambda i: (-scores[i], i))[:6], 1):  # noqa: B023
            want[q, rank] = (i, scores[i])
    assert got.keys() == want.keys() and len(got) == 125 * 6
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-4 for k in want)


def test_nearest_of_odd_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0]), ("c", None), ("d", [None, 2.0]), (None, [3.0, 0.0, 4.0])]
    items = spark.createDataFrame(rows, "id string, v array<double>")
    got = R.nearest(items, items.select(R.F.col("id").alias("q"), R.F.col("v").alias("w")), "id", "v", "q", "w", 2).collect()
    assert len(got) == 10
    assert {(r["rank"], r["id"], r["score"]) for r in got if r["q"] == "a"} == {(1, "a", 1.0), (2, "b", 1.0)}
    assert {(r["rank"], r["id"], r["score"]) for r in got if r["q"] == "c"} == {(1, None, 0.0), (2, "a", 0.0)}
    assert R.nearest(items.limit(0), items.select(R.F.col("id").alias("q"), R.F.col("v").alias("w")), "id", "v", "q", "w").count() == 0


@needs_data
def test_answers_are_of_all_orders(spark):
    assert q_answers._gold(spark, DATA).count() == spark.read.parquet(f"{DATA}/orders.parquet").count()
