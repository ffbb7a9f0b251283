"""Neighbours of all rows among all rows, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import knn, pivots


def brute(queries, rows, k, metric, exclude_self=False):
    """qid -> [(distance, key)] by plain loops over pairs."""
    out = {}
    for qid, q in queries:
        found = []
        for key, d in rows:
            if q is None or d is None or len(q) != len(d) or exclude_self and qid == key:
                continue
            a, b = np.array(q, float), np.array(d, float)
            if not (np.isfinite(a).all() and np.isfinite(b).all()):
                continue
            if metric == "cosine":
                if not a.any() or not b.any():
                    continue
                x = 1 - a @ b / np.sqrt((a @ a) * (b @ b))
            else:
                x = np.sqrt(((a - b) ** 2).sum()) if metric == "l2" else -(a @ b)
            found.append((x, key))
        if found:
            out[qid] = sorted(x for x, _ in found)[:k]
    return out


def clustered(n, seed, dims=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(8, dims)) * 6
    return [(i, (middle[0 if i % 3 == 0 else rng.integers(8)] + rng.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product"])
def test_exact_in_every_space(spark, metric, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 40)  # cells of several tiles, a third of all rows in one cell
    rows, queries = clustered(600, 1), [(i + 300, v) for i, v in clustered(200, 2)]
    got = pivots.knn_pivots(spark.createDataFrame(queries, "qid long, vector array<float>"), spark.createDataFrame(rows, "key long, vector array<float>"), 5, metric, True, 12)
    found = {}
    for r in got.hits.collect():
        found.setdefault(r.qid, []).append((r.rank, r.distance))
    want = brute(queries, rows, 5, metric, True)
    assert found.keys() == want.keys()
    for q, hits in found.items():
        assert [r for r, _ in sorted(hits)] == [1, 2, 3, 4, 5]
        np.testing.assert_allclose([d for _, d in sorted(hits)], want[q], atol=1e-6)
    w = got.work.first()
    assert w.pairs == 600 * 200 and w.compared < w.pairs * (0.9 if metric == "inner_product" else 0.6)


def test_odd_vectors_and_ties(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, []), (9, [None, 1.0])]
    r = spark.createDataFrame([(k, v, "x") for k, v in rows], "key long, vector array<double>, cell string")
    q = r.select(F.col("key").alias("qid"), "vector", F.lit(0).alias("edge"))
    for metric in ("cosine", "l2"):
        got = {}
        for h in pivots.knn_pivots(q, r, 2, metric, exclude_self=False, pivots=4).hits.collect():
            got.setdefault(h.qid, []).append((h.rank, h.key))
        assert sorted(got[1]) == sorted(got[2]) == [(1, 1), (2, 2)] and got[5] == [(1, 5)]
        assert not {4, 6, 8, 9} & got.keys() and (3 in got) == (metric == "l2") and {k for _, k in got[7]} == {7}
    none = pivots.knn_pivots(q.limit(0), r, 2)
    assert none.hits.count() == 0 and none.work.first().pairs == 0
    assert pivots.knn_pivots(q, r.limit(0), 2).hits.count() == 0
    with pytest.raises(ValueError):
        pivots.knn_pivots(q, r, metric="hamming")


def test_fewer_rows_than_neighbours(spark):
    rows = spark.createDataFrame(clustered(7, 3), "key long, vector array<float>")
    q = rows.withColumnRenamed("key", "qid")
    got = pivots.knn_pivots(q, rows, 10, "l2", True, pivots=3).hits
    assert got.count() == 42
    want = knn.knn(q, rows, 10, "l2", True)
    assert {(h.qid, h.rank, h.key) for h in got.collect()} == {(h.qid, h.rank, h.key) for h in want.collect()}
