"""Nearest vectors against all inner products, over several shards, blocks and pieces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import knn


def brute(rows, k):
    own = [(i, np.floor(np.array(v, float) * 256)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in own:
        if i % 50 == 0:
            scored = [(-int(q @ x), j) for j, x in own if j != i and len(x) == len(q)]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(sorted(out.get(i, []) + scored)[:k])]
    return out


@pytest.mark.parametrize("shard", [64, 4096])
def test_top_k_equals_all_products(spark, monkeypatch, shard):
    for name, value in (("SHARD", shard), ("SHARDS", 6), ("QUERIES_IN_BLOCK", 5), ("LEAF", 16)):
        monkeypatch.setattr(knn, name, value)
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(8, 12))
    rows = [(i, (middles[i % 8] + 0.3 * rng.normal(size=12)).round(2).tolist()) for i in range(1200)]
    rows += [(1200 + i, rows[i][1]) for i in range(100)] + [(5000, [1.0, 2.0]), (5001, [2.0, 1.0]), (None, rows[0][1]), (6000, None), (6050, [float("nan")] * 12), (6100, [None] * 12), (6150, [])]
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, shard string").repartition(5)
    got = {}
    for r in knn.top_k(vectors, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == brute(rows, 5)


def test_empty_table_and_one_point(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"], r.vec_id) for r in knn.top_k(same, F.col("vec_id") % 50 == 0, 2).collect()}
    assert got >= {(0, 1, 1), (0, 2, 2), (50, 1, 0), (50, 2, 1)} and len(got) == 12
