"""Order statistics by counting, against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import metrics, ranks

SCHEMA = "g string, v double"


@pytest.mark.parametrize("few", [40, 4096])
def test_ranks_against_sorted_lists(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "BINS", few)
    monkeypatch.setattr(ranks, "FEW", few)
    rng = random.Random(1)
    own = {
        "a": [rng.gauss(0, 1) for _ in range(501)], "b": [float(rng.randint(0, 5)) for _ in range(300)], "one": [7.5], "same": [2.0] * 90, None: [1.0, 3.0, 2.0],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-8, 8) for _ in range(80)], "huge": [1.7e308, -1.7e308, 5e-324, 0.0, -0.0], "odd": [math.inf, -math.inf, math.nan, 1.0, 2.0, math.inf],
    }
    rows = [(g, v) for g, vs in own.items() for v in vs] + [("a", None)] * 9 + [("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    order = lambda v: (v != v, v)
    got = {r.g: r for r in ranks.at_ranks(df, "v", ["g"], {"p10": ranks.nearest(0.1), "p50": ranks.nearest(0.5), "last": F.col("n")}).collect()}
    assert set(got) == set(own)
    for g, vs in own.items():
        vs = sorted(vs, key=order)
        want = [vs[max(1, math.ceil(len(vs) * 0.1)) - 1], vs[max(1, math.ceil(len(vs) * 0.5)) - 1], vs[-1]]
        assert got[g].n == len(vs) and all(a == b or a != a and b != b for a, b in zip((got[g].p10, got[g].p50, got[g].last), want)), g
    monkeypatch.setattr(ranks, "BROADCAST_RANGES", 0)
    again = {r.g: r for r in ranks.at_ranks(df, "v", ["g"], {"p50": ranks.nearest(0.5)}).collect()}
    assert all(again[g].p50 == got[g].p50 or got[g].p50 != got[g].p50 for g in own)


def test_no_rows_and_no_groups(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ranks.at_ranks(empty, "v", ["g"], {"p": ranks.nearest(0.5)}).count() == 0
    assert [tuple(r) for r in ranks.at_ranks(empty, "v", [], {"p": ranks.nearest(0.5)}).collect()] == [(0, None)]
    df = spark.createDataFrame([("x", float(i)) for i in range(10)], SCHEMA)
    assert [tuple(r) for r in ranks.at_ranks(df, "v", [], {"p": ranks.nearest(0.95)}).collect()] == [(10, 9.0)]
    assert [tuple(r) for r in metrics.bench_latencies(df, "v", "g").collect()] == [("x", 10, 4.5, 9.0)]


def test_no_group_is_sorted(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = metrics.latencies(df, "value", "event_type")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Percentile" not in plan


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_benchmark_percentiles(spark, n):
    vs = sorted(random.Random(n).random() for _ in range(n))
    r = metrics.bench_latencies(spark.createDataFrame([("x", v) for v in vs], SCHEMA), "v", "g").first()
    assert abs(r.p50 - (vs[(n - 1) // 2] + vs[n // 2]) / 2) < 1e-12 and r.p95 == vs[round(0.95 * (n - 1))]
