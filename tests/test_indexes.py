"""Inverted lists and neighbour graphs: against plain numpy, against exact searches, and what they read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import graph, ivf, knn, metrics
from spindrift.sources import scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


@pytest.fixture(scope="module")
def queries(rows):
    return rows.where("key % 20 = 0").select(F.col("key").alias("qid"), "vector")


def hits(df):
    return sorted((r.qid, r.key, round(r.distance, 6), r["rank"]) for r in df.collect())


def recall(found, exact):
    return metrics.index_recall(found, exact).first()["index_recall"]


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product"])
def test_lists_are_trained_stored_and_searched(spark, rows, queries, metric):
    index = ivf.Index.build(rows, scratch.fresh(spark, "ivf"), 8, metric)
    again = ivf.Index.open(spark, index.path)
    assert again.metric == metric and again.counts == index.counts and np.allclose(again.centres, index.centres) and sum(index.counts.values()) == rows.count()
    exact = knn.knn(queries, rows, metric=metric)
    assert hits(again.search(queries, probes=8)) == hits(exact)
    found = [recall(again.search(queries, probes=p), exact) for p in (1, 2, 4, 8)]
    assert found == sorted(found) and found[-1] == 1
    assert hits(again.search(queries, k=3, probes=8, exclude_self=True, most=500)) == hits(knn.knn(queries, rows, k=3, metric=metric, exclude_self=True))


def test_training_is_plain_k_means(rows):
    centres = ivf.train(rows, 5, rounds=4)
    x = np.array([r.vector for r in rows.collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    start = [r.vector for r in rows.orderBy(F.md5(F.col("key").cast("string")), "key").limit(5).collect()]
    c = np.array(start) / np.linalg.norm(start, axis=1, keepdims=True)
    for _ in range(4):
        at = np.argmin(((x[:, None] - c) ** 2).sum(2), 1)
        c = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(5)])
        c /= np.linalg.norm(c, axis=1, keepdims=True)
    assert np.allclose(centres, c, atol=1e-9)
    got = {(r.key, r.list) for r in ivf.assigned(rows, centres).collect()}
    assert got == {(r.key, int(np.argmin(((v - c) ** 2).sum(1)))) for r, v in zip(rows.collect(), x)}


def test_only_probed_lists_are_read(spark, rows):
    index = ivf.Index.build(rows, scratch.fresh(spark, "ivf"), 16)
    df = index.search(rows.where("key = 0").select(F.col("key").alias("qid"), "vector"), probes=2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan
    near = [r["list"] for r in ivf.assigned(rows.where("key = 0"), index.centres, probes=2).collect()]
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert len(near) == 2 and all(str(c) in filters for c in near)
    read = index.rows().where(F.col("list").isin(near)).select(F.input_file_name().alias("f")).distinct().collect()
    assert {int(r.f.split("list=")[1].split("/")[0]) for r in read} == {c for c in near if c in index.counts}


def test_hot_list_is_split_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ivf, "FILE_ROWS", 50)
    data = [(i, [1.0, 0.0]) for i in range(400)] + [(1000 + i, [float(i), 1.0]) for i in range(40)] + [(2000, None), (2001, [0.0, 0.0]), (2002, [1.0]), (2003, [0.0, 1.0])]
    rows = spark.createDataFrame(data, "key long, vector array<float>")
    index = ivf.Index.build(rows, scratch.fresh(spark, "ivf"), 4)
    assert sum(index.counts.values()) == 442  # without the null and the shorter one
    hot = max(index.counts, key=index.counts.get)
    assert len(index.rows().where(F.col("list") == hot).inputFiles()) >= 4
    q = rows.where("key in (0, 1005, 2000, 2001, 2002, 2003)").select(F.col("key").alias("qid"), "vector")
    same_size = rows.where("size(vector) = 2")
    assert hits(index.search(q, probes=4)) == hits(knn.knn(q.where("qid <> 2002"), same_size))
    none = ivf.Index.build(rows.limit(0), scratch.fresh(spark, "ivf"), 4)
    assert none.search(q).count() == 0 and index.search(q.limit(0)).count() == 0 and ivf.Index.open(spark, none.path).search(q).count() == 0
    with pytest.raises(ValueError):
        ivf.train(rows, 8_000_000)


# Neighbour graphs.
def test_graph_finds_neighbours(spark, rows, queries):
    exact = knn.knn(rows.select(F.col("key").alias("qid"), "vector"), rows, k=10, exclude_self=True)
    g = graph.Graph.build(rows, 16)
    own = g.edges.select(F.col("key").alias("qid"), F.col("other").alias("key"), "distance")
    assert 0 < g.rounds <= graph.ROUNDS and recall(own, exact) >= 0.9
    assert g.edges.groupBy("key").count().agg(F.max("count")).first()[0] <= 16 and g.edges.where("key = other").count() == 0
    wanted = knn.knn(queries, rows)
    found = [recall(g.search(queries, ef=ef), wanted) for ef in (10, 64)]
    assert found[1] >= 0.9 and found[1] >= found[0]
    got = g.search(queries, k=5, ef=64, exclude_self=True)
    assert got.where("qid = key").count() == 0 and got.groupBy("qid").count().where("count <> 5").count() == 0
    true = {(r.qid, r.key): r.distance for r in exact.collect()}
    assert all(abs(true[r.qid, r.key] - r.distance) < 1e-9 for r in got.collect() if (r.qid, r.key) in true)


def test_graph_of_copies_and_odd_rows(spark):
    data = [(i, [1.0, 0.0, 0.5]) for i in range(700)] + [(1000 + i, [float(np.cos(i)), float(np.sin(i)), 0.1 * (i % 7)]) for i in range(300)] + [(2000, None), (2001, [0.0, 0.0, 0.0]), (2002, [1.0])]
    rows = spark.createDataFrame(data, "key long, vector array<float>")
    g = graph.Graph.build(rows, 8, "l2")
    assert g.rows.count() == 1001 and {r.key for r in g.edges.select("key").distinct().collect()} == {k for k, v in data if v and len(v) == 3}
    q = rows.where("key in (3, 1004, 2000)").select(F.col("key").alias("qid"), "vector")
    wanted = knn.knn(q, rows.where("size(vector) = 3"), metric="l2")
    assert recall(g.search(q, ef=64), wanted) >= 0.9
    assert graph.Graph.build(rows.limit(0)).search(q).count() == 0 and g.search(q.limit(0)).count() == 0
    one = graph.Graph.build(rows.where("key = 3"))
    assert one.edges.count() == 0 and [r.key for r in one.search(q.where("qid = 3")).collect()] == [3]


def test_a_round_compares_no_all_pairs(rows):
    g = graph.Graph.build(rows, 4, rounds=0)
    plan = graph._joined(g.rows, g.edges.withColumn("new", F.lit(True)), 4, "cosine")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_cells_leave_little_to_descent(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 256, raising=False)
    many = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    own = graph.Graph.build(many, 16, rounds=0).edges.select(F.col("key").alias("qid"), F.col("other").alias("key"), "distance")
    assert recall(own, knn.knn_block(many.select(F.col("key").alias("qid"), "vector"), many, exclude_self=True)) >= 0.9


def test_search_moves_no_vectors_of_queries(rows, queries):
    g = graph.Graph.build(rows, 16)
    assert hits(g.search(queries, most=64 * 10)) == hits(g.search(queries))  # in ten blocks or so, and in one
