"""What a model is asked and what that costs: the cache in the path, measured tokens, the probe."""

import uuid

import pytest
from pyspark.sql import functions as F

from spindrift.operators import embed, migrate
from spindrift.operators.cache import EmbeddingCache
from spindrift.plans import job, spec
from spindrift import service


@pytest.fixture
def store(spark, tmp_path):
    def f(df):
        p = str(tmp_path / uuid.uuid4().hex)
        df.write.parquet(p)
        return spark.read.schema(df.schema).parquet(p)

    return f


def counting(spark, bad=()):
    """A model of one dimension that counts a token for each character, and what it was asked."""
    asked = spark.sparkContext.accumulator(0)

    def model(texts):
        if any(t in bad for t in texts):
            raise ValueError("no")
        asked.add(len(texts))
        out = embed.Answer([float(len(t))] for t in texts)
        out.tokens = sum(map(len, texts))
        return out

    return (lambda df: embed.embedded(df, model, 1, 4, 2)), asked, model


def rows(spark, texts):
    return spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "key long, text string, new_vector array<float>")


def test_each_text_is_asked_once_and_never_again(spark, store, tmp_path):
    texts = ["same"] * 30 + [f"text {i}" for i in range(10)] + [None, " ", "bad", "bad"]
    model, asked, _ = counting(spark, {"bad"})
    cache = EmbeddingCache(spark, f"{tmp_path}/cache", "m|1", buckets_=4)
    out = migrate.apply(rows(spark, texts), model, store, price=1e6, cache=cache)
    assert asked.value == 11 and (out.rows_written, out.asked, out.rejected, out.remaining) == (40, 12, 2, 0)
    assert out.tokens == 4 + 60 and out.spent_usd == pytest.approx(64) and cache.size() == 11
    assert {r.text: r.new_vector for r in out.table.where("new_vector is not null").collect()} == {"same": [4.0]} | {f"text {i}": [6.0] for i in range(10)}
    # another table with the same texts and one more: only that one costs, and a budget for it suffices
    again = migrate.apply(rows(spark, texts[:40] + ["one more"]), model, store, price=1e6, budget=8.5, cache=cache)
    assert asked.value == 12 and (again.status, again.rows_written, again.tokens, again.spent_usd) == ("complete", 41, 8, 8.0)
    other = EmbeddingCache(spark, f"{tmp_path}/cache", "m|2").split(spark.createDataFrame([(1, "same"), (2, None)], "key long, text string"))
    assert other.misses.count() == 1  # another model's vectors are not this one's
    assert cache.split(spark.createDataFrame([], "key long, text string")).answered(model).count() == 0


def test_concurrent_additions_to_a_cache(spark, tmp_path, monkeypatch):
    a, b = (EmbeddingCache(spark, f"{tmp_path}/c", "m", buckets_=2) for _ in range(2))
    entry = lambda k: spark.createDataFrame([(k, [1.0])], "cache_key string, vector array<float>")
    a.put(entry("x"))
    manifest, late = a.table.manifest, []

    def slow(version=None):
        m = manifest(version)
        if not late:
            late.append(b.put(entry("y")))  # commits between a's read and its commit
        return m

    monkeypatch.setattr(a.table, "manifest", slow)
    a.put(entry("z"))
    assert {r[0] for r in b.table.read().select("cache_key").collect()} == {"x", "y", "z"}
    for i in range(12):  # folders of changes are put together
        b.put(entry(f"k{i}"))
    assert b.size() == 15 and max(map(len, b.table.manifest()["changes"].values())) <= 9


def test_measured_tokens_bound_the_budget(spark, store):
    model, asked, _ = counting(spark)
    texts = ["x" * 100 for _ in range(40)]
    # by characters / 4 a chunk costs 0.25, as measured 1.0: three chunks are paid before the ratio forbids the fourth
    out = migrate.apply(rows(spark, texts), model, store, price=1e3, budget=3.5, chunk=10)
    assert (out.status, out.rows_written, out.tokens) == ("budget", 30, 3000) and out.spent_usd == pytest.approx(3.0)


def test_probe(spark):
    model = counting(spark, {"bad"})[2]
    docs = spark.createDataFrame([(i, "abc" if i else None) for i in range(40)], "key long, text string")
    found = embed.probe(docs, model)
    assert (found["rows"], found["dims"], found["tokens_per_char"]) == (16, 1, 1.0) and found["docs_per_second"] > 0
    assert embed.probe(docs.limit(0), model)["rows"] == 0
    assert "no" in embed.probe(docs.withColumn("text", F.lit("bad")), model)["error"]
    assert embed.probe(docs, lambda t: [[1.0]] * len(t))["tokens_per_char"] is None


def test_payload_and_shared_cache_through_a_migration(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("key"), "text", "lang", "source").withColumn("payload", F.lit("own"))
    embed.hash_blake(docs, 8).join(docs, "key").withColumnRenamed("vector", "embedding").write.parquet(f"{tmp_path}/t")
    data = {"name": "x", "source": {"table": f"{tmp_path}/t"}, "model": "hash/16,price=1", "limits": {"parallel": 2, "budget_usd": 1000}, "cache": f"file://{tmp_path}/cache"}
    j = job.parse(data)
    planned = service.plan(spark, j, probe=True)
    assert planned["ok"] and planned["probe"]["rows"] == 16 and planned["estimates"]["seconds_by"] == "measured speed"
    first = service.apply(spark, j, f"file://{tmp_path}/a")
    assert first["status"] == "complete" and first["asked"] == docs.select("text").where("trim(text) <> ''").distinct().count() and first["tokens"] > 0
    second = service.apply(spark, j, f"file://{tmp_path}/b")
    assert second["status"] == "complete" and (second["asked"], second["tokens"], second["spent_usd"]) == (0, 0, 0.0) and second["rows_written"] == first["rows_written"]
    assert service.status(spark, j, f"file://{tmp_path}/a")["tokens"] == first["tokens"]
    from spindrift.sources.tables import VectorTable

    t = VectorTable(spark, f"file://{tmp_path}/a")
    assert t.read("new").join(docs.select("key", "lang"), "key").where(F.get_json_object("payload", "$.lang") == F.col("lang")).where(F.get_json_object("payload", "$.payload") == "own").count() == docs.count()
    versions = [p.name for p in (tmp_path / "a").iterdir() if p.name.startswith("v-")]
    assert sorted(versions) == sorted(t.pointer.values())  # nothing that no role names is left
    with pytest.raises(job.JobError):
        job.parse(data | {"cache": 3})
    with pytest.raises(job.JobError):
        job.parse(data | {"limits": {"parallel": 1.5}})
    assert spec.space(j.model) != spec.space(spec.parse("hash/32"))
