"""Tables of buckets, digests of ranges, and the stateful feed."""

import os
import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import digests, migrate
from spindrift.sources import scratch
from spindrift.sources.buckets import BucketTable, Conflict
from spindrift.streaming import feed


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def size(path):
    return sum(os.path.getsize(f"{d}/{n}") for d, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


# Tables of buckets.
def test_a_write_touches_what_it_changes(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t")
    df = spark.range(20_000).select(F.col("id").alias("key"), F.concat(*[F.sha2(F.concat("id", F.lit(f"-{k}")), 256) for k in range(12)]).alias("text"))
    t.create(df, "key", 100)
    before = size(tmp_path)
    first = rows_of(t.read().where("key < 50"))
    changed = df.where("key % 100 = 7").withColumn("text", F.lit("new")).unionByName(df.where("key < 3").withColumn("key", F.col("key") + 1_000_000))
    assert t.merge(changed, spark.createDataFrame([(5,), (12,), (999_999_999,)], "gone long")) == 2
    assert size(tmp_path) - before < 0.05 * before  # a hundredth of the rows, and what small files cost
    want = df.where("key not in (5, 12)").withColumn("text", F.when(F.col("key") % 100 == 7, F.lit("new")).otherwise(F.col("text"))).unionByName(df.where("key < 3").withColumn("key", F.col("key") + 1_000_000))
    now = scratch.kept(t.read())
    assert now.count() == 20_001 and rows_of(now.select("key", "text")) == rows_of(want.select("key", "text"))
    assert rows_of(t.read(1).where("key < 50")) == first  # an older version reads as it was
    got = t.lookup(spark.createDataFrame([(7,), (5,), (8,), (None,), (-1,)], "k long"))
    assert {r.key: r.text == "new" for r in got.collect()} == {7: True, 8: False}
    paths = {f.split("_bucket=")[1].split("/")[0] for f in got.inputFiles()}
    assert len(paths) <= 4

    for n in range(5):
        t.merge(df.where("key = 42").withColumn("text", F.lit(f"v{n}")))
    full = t.manifest()["changes"]
    touched = [b for b, names in full.items() if len(names) > 4]
    at = size(tmp_path)
    t.compact()
    assert len(touched) == 1 and size(tmp_path) - at < 0.05 * before and touched[0] not in t.manifest()["changes"]
    assert [r.text for r in t.lookup(spark.createDataFrame([(42,)], "k long")).collect()] == ["v4"] and t.read().count() == 20_001
    held = rows_of(t.read().select("key", "text"))
    assert t.vacuum(1) > 0 and len(t.versions()) == 1 and rows_of(t.read().select("key", "text")) == held
    with pytest.raises(LookupError):
        t.read(1)


def test_versions_are_made_once(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(LookupError):
        t.read()
    df = spark.createDataFrame([(1, "a"), (2, "b")], "key long, text string")
    t.create(df, "key", 4)
    with pytest.raises(Conflict):
        t.create(df, "key", 4)
    assert t.merge(df.limit(1), mark=("w", 3)) == 2 == t.merge(df.limit(1), mark=("w", 3)) == t.merge(df.limit(1), mark=("w", 2))
    bad = df.select("key", F.raise_error(F.lit("broken")).cast("string").alias("text"))
    with pytest.raises(Exception, match="broken"):
        t.merge(bad)
    assert t.versions() == [1, 2] and t.read().count() == 2
    e = BucketTable(spark, f"file://{tmp_path}/e")
    e.create(df.limit(0), "key", 4)
    assert e.read().count() == 0
    e.merge(df)
    assert rows_of(e.read()) == rows_of(df) and e.compact() == 2


# Digests.
def test_digests_find_what_join_finds(spark):
    rng = random.Random(4)
    src = [(i, rng.choice([f"t{i}", " ", None, "same"]), rng.choice(['{"a":1}', None, "x"])) for i in range(3000)]
    other = [(k if rng.random() > 0.01 else k + 10_000, t if rng.random() > 0.01 else "old", p if rng.random() > 0.01 else '{"a": 1.0}') for k, t, p in src if rng.random() > 0.01]
    schema = "key long, text string, payload string"
    a, b = spark.createDataFrame(src, schema), spark.createDataFrame(other, schema)
    for payload in (True, False):
        assert rows_of(digests.differences(a, b, payload)) == rows_of(migrate.differences(a, b, payload))
    assert digests.differences(a, a.where("text is not null and trim(text) <> ''")).count() == 0
    assert rows_of(digests.differences(a.limit(0), b)) == rows_of(migrate.differences(a.limit(0), b))
    assert digests.differences(a.limit(0), b.limit(0)).count() == 0


def test_only_ranges_that_differ_are_joined(spark):
    a = spark.range(50_000).select(F.col("id").alias("key"), F.col("id").cast("string").alias("text"), F.lit("{}").alias("payload"))
    b = a.withColumn("text", F.when(F.col("key") % 10_000 == 1, F.lit("x")).otherwise(F.col("text")))
    value = [F.col("text")]
    ranges = digests.differing(digests.tree(a, "key", value), digests.tree(b, "key", value))
    assert 0 < ranges.count() <= 5 and digests.narrowed(a, "key", ranges).count() < 200
    assert digests.changed_rows(a, b) == 5 == digests.changed_rows(b.where("key <> 1"), a)
    twice, other = (spark.createDataFrame([(1, t)] * 2, "key long, text string") for t in ("p", "q"))
    assert digests.changed_rows(twice.limit(1), other.limit(1)) == 1 and digests.differing(digests.tree(twice, "key", value), digests.tree(other, "key", value)).count() == 1


# The feed.
SCHEMA = "id long, updated_at timestamp, deleted boolean, value double, event_id long"


def changes(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 40), None if rng.random() < 0.1 else 1_700_000_000 + rng.randint(0, 50), rng.choice([True, False, False, None]), rng.random(), i) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, at long, deleted boolean, value double, event_id long").select("id", F.timestamp_seconds("at").alias("updated_at"), "deleted", "value", "event_id"), rows


def run(spark, t, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    feed.keep_up(stream, t, f"file://{tmp_path}/ck").awaitTermination(60)


def test_stateful_feed_is_the_newest_of_all(spark, tmp_path):
    df, _ = changes(spark)
    parts = df.randomSplit([1.0] * 4, 3)
    t = BucketTable(spark, f"file://{tmp_path}/t")
    t.create(spark.createDataFrame([], SCHEMA).drop("deleted"), "id", 8)
    for k, p in enumerate(parts):  # stopped and started anew after the second
        p.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (1, 3):
            run(spark, t, tmp_path)
    want = migrate.newest(df, order="event_id").select("id", "event_id", "value")
    assert rows_of(t.read().select("id", "event_id", "value")) == rows_of(want)
    versions = t.versions()
    run(spark, t, tmp_path)  # nothing new
    assert t.versions() == versions


def test_late_changes_do_not_bring_deleted_ids_back(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t")
    t.create(spark.createDataFrame([], SCHEMA).drop("deleted"), "id", 2)
    put = lambda *rows: spark.createDataFrame(list(rows), "id long, at long, deleted boolean, value double, event_id long").select("id", F.timestamp_seconds("at").alias("updated_at"), "deleted", "value", "event_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put((1, 100, False, 1.0, 1), (2, 100, False, 2.0, 2), (1, 200, True, 0.0, 3))
    run(spark, t, tmp_path)
    put((1, 150, False, 9.0, 4), (2, 90, False, 8.0, 5))
    run(spark, t, tmp_path)
    assert [(r.id, r.value) for r in t.read().collect()] == [(2, 2.0)]


def test_feed_keeps_newest_changes_without_python(spark, tmp_path):
    df, _ = changes(spark)
    df.write.parquet(f"{tmp_path}/in")
    newest = feed.winners(spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in"))
    plan = newest._jdf.queryExecution().analyzed().toString()
    assert newest.columns == df.columns and "Aggregate" in plan and "Pandas" not in plan and "TransformWithState" not in plan
    best = feed.winners(df)  # a batch gives the same
    assert rows_of(best.where("not coalesce(deleted, false)").select("id", "event_id", "value")) == rows_of(migrate.newest(df, order="event_id").select("id", "event_id", "value"))
