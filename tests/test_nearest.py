"""The block kernel: the same hits as the expression kernel's, in the same order, however rows are cut into tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spindrift.operators import ivf, knn
from spindrift.sources import scratch

SF = "/root/testdata/sf0.001"


def hits(df):
    return sorted((r.qid, r["rank"], r.key, repr(r.distance + 0.0)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product"])
@pytest.mark.parametrize("alone", [True, False])
def test_equal_to_the_last_digit(spark, metric, alone, monkeypatch):
    monkeypatch.setattr(knn, "TILE", 500)
    monkeypatch.setattr(knn, "PAIRS", 70)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 21)).astype(np.float32)
    x[::3] = x[0]  # copies, of which the smaller keys are nearer
    x[100:130] = x[100] * (1 + np.arange(30)[:, None] * 1e-7)
    odd = [(1000, [float("nan")] * 21), (1001, [0.0] * 21), (1002, [None] + [1.0] * 20), (1003, [float("inf")] + [1.0] * 20), (1004, None), (1005, [1.0, 2.0]), (1006, [1e30] * 21)]
    own = [(int(k), v.tolist()) for k, v in zip(rng.permutation(300), x)] + odd
    rows = spark.createDataFrame(own, "key long, vector array<float>").repartition(5)
    q = rows.where("key % 5 = 0 or key >= 1000").select(F.col("key").alias("qid"), "vector")
    assert hits(knn.knn_block(q, rows, 7, metric, alone, most=400)) == hits(knn.knn(q, rows, 7, metric, alone))


def test_names_as_keys(spark):
    rows = spark.createDataFrame([(f"n{i}", [1.0, float(i % 4)]) for i in range(60)], "key string, vector array<double>")
    q = rows.where("key like 'n1%'").select(F.col("key").alias("qid"), "vector")
    assert hits(knn.knn_block(q, rows, 3, exclude_self=True)) == hits(knn.knn(q, rows, 3, exclude_self=True))


def test_a_null_component_does_not_move_lists(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 5)]) for i in range(80)], "key long, vector array<float>")
    q = rows.limit(6).select(F.col("key").alias("qid"), F.when(F.col("key") == 1, F.array(F.lit(None).cast("float"), F.lit(1.0).cast("float"), F.lit(1.0).cast("float"))).otherwise(F.col("vector")).alias("vector"))
    index = ivf.Index.build(rows, scratch.fresh(spark, "ivf"), 4)
    assert hits(index.search(q, probes=4)) == hits(knn.knn(q, rows))


@pytest.mark.parametrize("name", ["knn_cosine_top10", "knn_ip_top10", "knn_l2_top10", "index_recall_partial", "index_recall_ivf"])
def test_no_row_for_each_pair(spark, name):
    """A row for each pair, sorted, was 33 microseconds a pair."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["labelled_queries", "labelled_prune"])
def test_runs_of_words_are_found_by_place(spark, monkeypatch, name):
    """slice() copies the whole array, and split() stood in the lambda: a text's work was the square of its words."""
    kept = []
    monkeypatch.setattr(scratch, "kept", lambda df, kind="rows": kept.append(df) or df)
    df = entry.queries()[name](spark, SF)
    plan = (kept or [df])[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "transform(array(split(" in plan


def test_a_task_holds_few_texts_as_objects(spark):
    """All texts of an Arrow batch, ten thousand rows, were objects at once, and their vectors too."""
    from spindrift.operators import embed

    docs = spark.range(3000).coalesce(1).selectExpr("id as key", "cast(id as string) as text")

    def model(texts):
        import sys

        frame, held = sys._getframe(), 0
        while frame:
            held = max([held, *(len(v) for v in frame.f_locals.values() if isinstance(v, list) and v and isinstance(v[0], str))])
            frame = frame.f_back
        return [[float(held), float(t)] for t in texts]

    for batch, parallel in ((1, 1), (64, 1), (100, 1)):
        got = embed.embedded(docs, model, 2, batch, parallel).collect()
        assert len(got) == 3000 and all(r.vector[1] == r.key for r in got)
        assert max(r.vector[0] for r in got) <= 8 * batch + embed.HELD
