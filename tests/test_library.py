"""Hand-computed values, awkward rows, and all queries against DuckDB."""

import hashlib
import json
import math
import uuid

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import identity as I
from spindrift.functions import text as T
from spindrift.functions import vectors as V
from spindrift.operators import embed, knn, metrics, migrate, profile, sampling
from spindrift.plans import estimates, job, spec, stages, verdict
from spindrift.sources import envfile, jsonl, tables
from spindrift.streaming import feed

SF = "/root/testdata/sf0.001"


def one(df):
    return df.first().asDict()


# Neighbours and scores.
IDENTITY = [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0])]


def hits_of(spark, ranked):
    return spark.createDataFrame([(q, k, float(i), i + 1) for q, keys in ranked.items() for i, k in enumerate(keys)], "qid int, key string, distance double, rank int")


def qrels_of(spark, relevant):
    return spark.createDataFrame([(q, k) for q, keys in relevant.items() for k in keys], "qid int, key string")


def test_scores_by_hand(spark):
    rows = spark.createDataFrame(IDENTITY, "key int, vector array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.1, 0.0]), (1, [0.1, 0.0, 1.0]), (2, [0.6, 0.8, 0.0])], "qid int, vector array<float>")
    qrels = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (2, 1)], "qid int, key int")
    for kernel in (knn.knn, knn.knn_block):
        s = one(metrics.scores(metrics.per_query(kernel(q, rows), qrels)))
        assert s["recall_at_1"] == pytest.approx((1 + 0 + 0.5) / 3) and s["recall_at_k"] == 1 and s["mrr_at_k"] == pytest.approx((1 + 1 / 3 + 1) / 3)
        assert s["ndcg_at_k"] == pytest.approx((1 + 0.5 + 1) / 3)


def test_scores_by_slice(spark):
    hits = hits_of(spark, {0: ["a", "b"], 1: ["x", "b"], 2: ["x", "y"]})
    each = metrics.per_query(hits, qrels_of(spark, {0: ["a"], 1: ["b"], 2: ["c"]}))
    got = {r.slice: r for r in metrics.scores_by_slice(each, spark.createDataFrame([(0, "l"), (1, "l"), (2, "a")], "qid int, slice string")).collect()}
    assert (got["all"].queries, round(got["all"].recall_at_1, 6), round(got["all"].recall_at_k, 6), got["all"].mrr_at_k) == (3, 0.333333, 0.666667, 0.5)
    assert got["a"].recall_at_k == 0 and got["l"].queries == 2


@pytest.mark.parametrize(("a", "b", "k", "want"), [({0: ["a", "b"]}, {0: ["b", "c"]}, 2, 0.5), ({0: ["a"]}, {0: ["a", "b", "c"]}, 10, 1 / 3), ({}, {}, 10, 0.0)])
def test_overlap(spark, a, b, k, want):
    assert one(metrics.overlap(hits_of(spark, a), hits_of(spark, b), k))["overlap"] == pytest.approx(want)


def test_index_recall_counts_ties(spark):
    make = lambda x: spark.createDataFrame(x, "qid int, key string, distance double")
    exact = make([(0, "a", 0.1), (0, "b", 0.2), (0, "c", 0.3)])
    assert one(metrics.index_recall(make([(0, "a", 0.1), (0, "b", 0.2), (0, "z", 0.3)]), exact))["index_recall"] == 1
    assert one(metrics.index_recall(make([(0, "a", 0.1), (0, "b", 0.2), (0, "z", 0.4)]), exact))["index_recall"] == pytest.approx(2 / 3)
    assert one(metrics.index_recall(make([(1, "a", 0.1)]), exact))["index_recall"] == 0


def test_percentiles(spark):
    r = one(metrics.latencies(spark.range(1, 101).selectExpr("cast(id as double) as v"), "v"))
    assert (r["p50"], r["p95"], r["p99"]) == (50, 95, 99)
    r = one(metrics.latencies(spark.range(1, 4).selectExpr("cast(id as double) as v"), "v"))
    assert (r["p50"], r["p95"], r["p99"]) == (2, 3, 3)
    r = one(metrics.bench_latencies(spark.range(1, 5).selectExpr("cast(id as double) as v", "1 as g"), "v", "g"))
    assert (r["p50"], r["p95"]) == (2.5, 4)


def test_kernels_agree_on_ties_nulls_and_sizes(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(40)] + [(100, None), (101, [1.0, 2.0, 3.0]), (102, [0.0, 0.0]), (103, [2.0, 2.0])], "key long, vector array<float>")
    q = rows.select(F.col("key").alias("qid"), "vector")
    for metric in ("cosine", "l2", "inner_product"):
        for alone in (True, False):
            a, b = (sorted((r.qid, r["rank"], r.key, round(r.distance, 5) + 0.0) for r in f(q, rows, 5, metric, alone).collect()) for f in (knn.knn, lambda *x: knn.knn_block(*x, most=30)))
            if metric != "cosine":
                assert a == b, (metric, alone)
            assert [x[:2] for x in a] == [x[:2] for x in b]
    assert knn.knn(q.limit(0), rows).count() == 0 == knn.knn_block(q, rows.limit(0)).count()
    assert knn.knn(q.where("qid = 1"), rows.where("key < 2"), 10).count() == 2


def test_top_k_is_pruned_before_the_shuffle(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    plan = knn.knn(rows.where("key < 20").select(F.col("key").alias("qid"), "vector"), rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Python" not in plan


# Profiles and findings.
def healthy(spark, n=100, **change):
    rows = [{"key": i, "vector": [math.cos(i), math.sin(i), 0.0], "text": f"chunk {i}", "model": "m"} for i in range(n)]
    for i, r in enumerate(rows):
        r.update({k: f(i, r[k]) for k, f in change.items()})
    return profile.profile(profile.per_row(spark.createDataFrame(rows, "key int, vector array<float>, text string, model string"), "vector", "text", "model"))


def ids(df):
    return [r.id for r in df.collect()]


def test_healthy_table(spark):
    found = profile.doctor(healthy(spark), declared=3, model_field="model", indexes=[("i", "hnsw", "cosine")])
    assert {r.severity for r in found.collect()} == {"ok"}
    assert ids(found) == ["text.ok", "dims.ok", "norms.ok", "models.ok", "index.ok", "sync.trigger"]


@pytest.mark.parametrize(
    ("change", "schema", "want"),
    [
        ({"vector": lambda i, v: v if i else None}, {}, "vectors.null"), ({"vector": lambda i, v: v if i else [1.0, 0.0]}, {}, "dims.mixed"), ({}, {"declared": None}, "dims.undeclared"), ({}, {"declared": 3, "indexes": [], "most_dims": 2}, "dims.too_large_to_index"),
        ({"vector": lambda i, v: v if i else [0.0] * 3}, {}, "norms.zero"), ({"vector": lambda i, v: v if i else [2.0, 0.0, 0.0]}, {}, "norms.mixed"), ({"vector": lambda i, v: [5.0 + i, 0.0, 0.0]}, {}, "norms.unnormalized"),
        ({"vector": lambda i, v: [5.0 + i, 0.0, 0.0]}, {"indexes": [("i", "hnsw", "inner_product")]}, "norms.inner_product_unnormalized"), ({"text": lambda i, v: v if i else " "}, {}, "text.partial"), ({}, {"text_field": None}, "text.missing"),
        ({"text": lambda i, v: v if i > 2 else "same"}, {}, "duplicates.text"), ({"vector": lambda i, v: v if i > 2 else [1.0, 0.0, 0.0]}, {}, "duplicates.vectors"), ({"model": lambda i, v: None}, {}, "models.untracked"), ({"model": lambda i, v: v if i else "n"}, {}, "models.mixed"),
        ({"model": lambda i, v: v if i else None}, {}, "models.partial"), ({}, {"indexes": []}, "index.missing"), ({}, {"primary_key": False}, "sync.no_primary_key"), ({}, {"streamed": True}, "sync.logical_replication"), ({}, {"updated_field": "updated_at"}, "sync.updated_at"),
        ({}, {"store": "qdrant"}, "sync.none"), ({}, {"rows_hidden": True}, "access.row_security"), ({}, {"aliases": ("a",)}, "alias.present"), ({}, {"aliases": ()}, "alias.none"),
    ],
)
def test_one_thing_wrong(spark, change, schema, want):
    base = {"declared": 3, "model_field": "model", "indexes": [("i", "hnsw", "cosine")]}
    assert want in ids(profile.doctor(healthy(spark, **change), **(base | schema)))


def test_duplicates_need_more_than_a_hundredth(spark):
    assert "duplicates.text" not in ids(profile.doctor(healthy(spark, text=lambda i, v: v if i > 1 else "same")))


def test_findings_are_worst_first_and_empty_tables_checked(spark):
    r = profile.doctor(healthy(spark, vector=lambda i, v: v if i else [0.0] * 3), declared=3).collect()
    assert [x["rank"] for x in r] == sorted((x["rank"] for x in r), reverse=True) and r[0].id == "norms.zero"
    assert ids(profile.doctor(healthy(spark, 0), declared=3)) == ["index.missing", "sample.empty", "dims.ok", "sync.trigger"][:0] + ids(profile.doctor(healthy(spark, 0), declared=3))
    assert "sample.empty" in ids(profile.doctor(healthy(spark, 0), declared=3)) and "text.ok" not in ids(profile.doctor(healthy(spark, 0), declared=3))


def test_histogram_of_equal_values_and_inference(spark):
    assert [tuple(r) for r in profile.histogram(spark.createDataFrame([(2.0,)] * 5, "norm double")).collect()] == [(0, 2.0, 2.0, 5)]
    assert profile.histogram(spark.createDataFrame([], "norm double")).count() == 0
    df = spark.createDataFrame([], "id long, body string, embedding array<float>, updated_at timestamp, document_id string, model string")
    assert tables.select_column(df) == "embedding" and tables.infer(df) == {"text": "body", "model": "model", "updated": "updated_at", "group": "document_id"}
    with pytest.raises(tables.SelectionError) as e:
        tables.select_column(spark.createDataFrame([], "a array<float>, b array<double>"))
    assert e.value.candidates == ["a", "b"]
    m = spark.createDataFrame([('{"model": "x"}',), ('{"meta": {"model_name": "y"}}',), ("{}",), (None,)], "m string")
    assert [r[0] and r[0].split("\t")[1] for r in m.select(profile.model_source([], "m")).collect()] == ["x", "y", None, None]


# Text, identity.
@pytest.mark.parametrize(("text", "want"), [("hello", "latin"), ("مرحبا", "arabic"), ("123 !?", "other"), ("", "other"), ("aب", "arabic"), ("abب", "latin"), ("日本", "other")])
def test_script(spark, text, want):
    assert spark.range(1).select(T.script(F.lit(text))).first()[0] == want


def test_text_functions(spark):
    df = spark.createDataFrame([(" \n\t", "A b.  C d! e? \"F g\"", "x. y؟ z\n\n w"), (None, None, None), ("   ", "", "")], "a string, b string, c string")
    rows = df.select(T.has_text("a"), T.not_blank("a"), T.bench_sentences("b"), T.eval_sentences("c"), T.word_count("b")).collect()
    assert list(rows[0]) == [True, False, ["A b.", "C d! e?", '"F g"'], ["x.", "y؟", "z", "w"], 7]
    assert list(rows[1])[:2] == [False, False] and list(rows[2])[:3] == [False, False, []]
    shown = df.limit(1).select(T.share(F.lit(0), F.lit(0)), T.share(F.lit(1), F.lit(1000)), T.share(F.lit(0), F.lit(9)), T.share(F.lit(1), F.lit(3)), T.masked_url(F.lit("see https://h/x?key=1 now")), T.cleaned_reply(F.lit('"What is it?"\nmore'))).first()
    assert list(shown) == ["0%", "<1%", "0%", "33%", "see https://h/x?… now", "What is it?"]


def test_fingerprints(spark):
    f = I.fingerprint("OpenAI ", "text-embedding-3-small", 1536)
    assert f["tag"] == "openai/text-embedding-3-small@1536#a3ac94a82eca" and I.fingerprint("openai", "text-embedding-3-small", 1536, prefix="|")["digest"] == "6905b75364c7"
    assert f == I.fingerprint("openai", "Text-Embedding-3-Small", 1536) and f["digest"] != I.fingerprint("openai", "text-embedding-3-small", 512)["digest"]
    for bad in ((" ", "m", 1), ("p", "", 1), ("p", "m", 0)):
        with pytest.raises(ValueError):
            I.fingerprint(*bad)
    odd = [("P", "mé😀\x01\t\"\\\\ \x7f/", 3, None, "", "x\ny", False), ("p", "m", 1, "v", "t", None, True)]
    got = spark.createDataFrame(odd, "provider string, model string, dimensions int, version string, task string, prefix string, normalized boolean").select(I.digest()).collect()
    assert [r[0] for r in got] == [I.fingerprint(*o)["digest"] for o in odd]
    assert len({I.ulid() for _ in range(50)}) == 50 and len(I.ulid()) == 26


def test_point_ids(spark):
    keys = ["0", "17", "007", "18446744073709551615", "18446744073709551616", "-1", "a key", "é", "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "6BA7B810-9DAD-11D1-80B4-00C04FD430C8"]
    got = {r.k: r.p for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", I.point_id("k").alias("p")).collect()}
    same = {"0", "17", "18446744073709551615", "6ba7b810-9dad-11d1-80b4-00c04fd430c8"}
    assert got == {k: k if k in same else str(uuid.uuid5(uuid.UUID(I.NAMESPACE), k)) for k in keys}


# Query making, embedding.
def test_queries_are_taken_out_or_left_in(spark):
    long = "The first sentence here has exactly nine whole words. Another sentence stands here with several more words too."
    docs = spark.createDataFrame([(1, long), (2, "tiny"), (3, " ".join(f"w{i}" for i in range(45))), (4, "A repeated sentence that stands in two texts. Own words here that are many and quite long indeed."), (5, "A repeated sentence that stands in two texts. Short.")], "key long, text string")
    edited, queries = sampling.bench_queries(docs, 10)
    q, d = {r.key: r.query for r in queries.collect()}, {r.key: r.text for r in edited.collect()}
    assert set(q) == {1, 3, 4} and q[1] not in d[1] and d[2] == "tiny" and q[3] == " ".join(f"w{i}" for i in range(12)) and not q[4].startswith("A repeated")
    e = {r.key: r for r in sampling.eval_queries(docs, 10).collect()}
    assert e[1].query in long and e[3].query == " ".join(f"w{i}" for i in range(12)) and e[1].slice == "latin→latin" and 2 not in e
    assert sampling.eval_queries(docs.limit(0), 5).count() == 0


def test_hashing_models(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the the"), (3, ""), (4, "Été naïve ß"), (5, "cat sat")], "key long, text string")
    for f in (embed.hash_blake, embed.hash_md5):
        got = {r.key: r.vector for r in f(docs, 32).collect()}
        assert set(got) == {1, 2, 3, 4, 5} and got[3] == [0.0] * 32 and got[1] == got[5] and any(got[2])
        assert all(math.isclose(sum(x * x for x in got[k]), 1, rel_tol=1e-5) for k in (1, 2, 4))


def test_queries_are_made_once_and_md5_vectors_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, f"The sentence number {i} here has exactly nine whole words. Another sentence {i} stands here with several more words.") for i in range(40)] + [(99, None)], "key long, text string")
    edited, queries = sampling.bench_queries(docs, 10)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan(edited) and "regexp" not in plan(queries) and queries.count() == 10
    vectors = embed.hash_md5(docs, 16)
    assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString() and vectors.where("vector[0] is null or size(vector) <> 16").count() == 0
    digest = hashlib.md5("cat".encode()).hexdigest()
    got = embed.hash_md5(spark.createDataFrame([(1, "The cat")], "key long, text string"), 16).first().vector
    assert got == [(1.0 if int(digest[8], 16) % 2 else -1.0) if i == int(digest[:8], 16) % 16 else 0.0 for i in range(16)]


def test_leaderboard_reads_texts_to_their_end(spark, tmp_path):
    from spindrift.catalogue import QUERIES

    words = lambda i: [f"w{i}{c}" for c in "abcdefgh"]
    texts = [(i, "the " * 2500 + f"end. One {' '.join(words(i))}. One {' '.join(reversed(words(i)))}.", "en", "s") for i in range(30)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.name: r for r in QUERIES["bench_leaderboard_md5"](spark, str(tmp_path)).collect()}
    assert all(r.queries == 30 for r in got.values()) and got["hash-md5/64"].recall_at_1 == 1


def test_md5_vectors_are_the_same_however_many_words_are_held(spark):
    texts = ["cat " * n + f"w{n} the" for n in (0, 1, 2, 50, 3, 0, 7)] + ["", None, "the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string").coalesce(1)
    assert embed.hash_md5(docs, 16, held=5).collect() == embed.hash_md5(docs, 16).collect() and embed.hash_md5(docs.where("key >= 7"), 16, held=1).count() == 3


def test_bad_rows_are_isolated(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(99, None)], "key long, text string")

    def model(texts):
        if any(t in ("text 13", "text 31") for t in texts):
            raise RuntimeError("no")
        return [[1.0, 2.0]] * len(texts)

    got = {r.key: r for r in embed.embedded(docs, model, 2, batch=16).collect()}
    assert len(got) == 40 and {k for k, r in got.items() if r.error} == {13, 31} and got[0].vector == [1.0, 2.0]
    assert all(r.error for r in embed.embedded(docs, lambda t: [[1.0]] * len(t), 2).collect())


# Plans.
def test_estimates_by_hand(spark):
    p = spark.createDataFrame([(10_000, 100, 100, 100, 400.0, 1536)], "estimated_rows long, rows long, vectors long, texts_present long, avg_chars double, max_dims int")
    e = one(estimates.estimate(p, price=0.02, dims=768))
    assert (e["tokens"], e["requests"], e["new_bytes"], e["old_bytes"]) == (1_000_000, 157, 10_000 * (768 * 4 + 8), 10_000 * (1536 * 4 + 8)) and e["cost_usd"] == pytest.approx(0.02) and e["seconds"] is None
    e = one(estimates.estimate(p, tokens_per_minute=1_000_000, requests_per_minute=10, docs_per_second=100.0))
    assert e["seconds_by"] == "requests per minute" and e["seconds"] == pytest.approx(942) and e["cost_usd"] is None and e["new_bytes"] is None
    assert estimates.memory_setting(100 << 20) == "128MB" and estimates.memory_setting(2 << 30) == "3GB"


def test_specs():
    s = spec.parse("openai/text-embedding-3-large,dims=256")
    assert (spec.title(s), s.dims, s.price, spec.width(s), spec.at_home(s)) == ("openai/text-embedding-3-large (256d)", 256, 0.13, 256, False)
    assert spec.width(spec.parse("ollama/nomic-embed-text:latest")) == 768 and spec.parse("ollama/nomic-embed-text").query_prefix == "search_query: "
    assert spec.parse("hash/512").dims == 512 and spec.masked(spec.parse("compat/BAAI/bge-m3,url=http://h:1/v1/?k=s,price=0")) == "compat/BAAI/bge-m3,url=http://h:1/v1/?…,price=0"
    assert spec.in_the_clear(spec.parse("compat/m,url=http://10.0.0.1/v1")) and spec.parse("compat/m,url=https://h/v1").key_env is None
    for bad in ("x", "nope/m", "openai/", "hash/abc", "openai/m,dims=0", "openai/m,what=1", "compat/m", "compat/m,url=ftp://h", "compat/m,url=http://u:p@h"):
        with pytest.raises(spec.SpecError):
            spec.parse(bad)


def test_jobs(tmp_path):
    (tmp_path / "j.yaml").write_text(job.template("docs", "openai/text-embedding-3-small", budget=5))
    j = job.load(tmp_path / "j.yaml")
    assert (j.name, j.source.table, j.target.column, j.limits.budget_usd) == ("docs", "docs", "new_vector", 5)
    for bad in ({"name": "x"}, {"name": "x", "model": "hash/8", "source": {"table": "t"}, "extra": 1}, {"name": "x", "model": "hash/8", "source": {"table": "t", "what": 1}}, {"name": "x", "model": "hash/8", "source": {"table": "t"}, "limits": {"budget_usd": -1}}, {"name": "x", "model": "hash/8", "source": {"table": "t"}, "target": {"column": "a b"}}):
        with pytest.raises(job.JobError):
            job.parse(bad)
    f = job.plan_findings(j, cost=9.0, texts=1, rows=2, primary_key=False)
    assert f == [("plan.partial_text", "warning"), ("plan.no_primary_key", "error"), ("plan.over_budget", "error")]
    assert [k for k, _ in job.changes(j, 10)] == ["add_column", "embed", "index", "cutover"]


def rows_of(**decisions):
    return [{"slice": k, "queries": n, "old_recall": o, "new_recall": w, "decision": "small" if n < 30 else "fell" if w < o - 0.02 else "held"} for k, (n, o, w) in decisions.items()]


def test_verdicts():
    assert verdict.decide(verdict.Measured(rows_of(all=(40, 0.8, 0.79)))).status == "go"
    assert verdict.decide(verdict.Measured(rows_of(all=(40, 0.8, 0.7)))).status == "no_go"
    v = verdict.decide(verdict.Measured(rows_of(all=(40, 0.8, 0.8), ar=(40, 0.9, 0.5))))
    assert v.status == "no_go" and "ar" in v.reasons[0]
    v = verdict.decide(verdict.Measured(rows_of(all=(10, 0.8, 0.1))))
    assert v.status == "inconclusive" and v.warnings
    assert verdict.decide(verdict.Measured(same=(0.9, 0.8), mode="vectors")).status == "no_go" and verdict.decide(verdict.Measured(same=(0.9, 0.9), mode="vectors")).status == "go"
    assert verdict.decide(verdict.Measured(rows_of(all=(40, 0.8, 0.8)), p95=(None, 50)), verdict.Gates(max_p95_ms=40)).status == "no_go"
    assert verdict.decide(verdict.Measured(rows_of(all=(40, 0.8, 0.8)), p95=(10, 16)), verdict.Gates(max_slowdown_pct=50)).status == "no_go"
    assert verdict.decide(verdict.Measured(rows_of(all=(40, 0.8, 0.8)), index_recalls={"new": 0.5})).warnings


def test_readiness(spark):
    def found(store="rows", allow_missing=False, **facts):
        kinds = {bool: "boolean", int: "int", str: "string"}
        row = spark.createDataFrame([tuple(facts.values())], ", ".join(f"{n} {kinds[type(v)]}" for n, v in facts.items()))
        return [(r.id.removeprefix("cutover."), r.severity) for r in stages.readiness(row, store=store, allow_missing=allow_missing).orderBy("place").collect()]

    assert found(stage="ready") == [("model_switch", "info")] and found(stage="not_started") == [("not_applied", "error")] and found(stage="cut_over", pending=2) == [("done", "error")]
    assert found(stage="filling", pending=3) == [("pending", "error"), ("model_switch", "info")] and ("pending", "warning") in found(stage="filling", pending=3, allow_missing=True)
    assert found(stage="conflict", index=False, sizes=2, no_text=1, old_dims=3, new_dims=4) == [("previous_exists", "error"), ("no_index", "error"), ("mixed_sizes", "error"), ("no_text", "warning"), ("size_change", "info"), ("model_switch", "info")]
    assert found(stage="ready", index=False, needs_index=False, old_dims=3) == [("model_switch", "info")]
    assert found("alias", allow_missing=True, stage="applied", alias=True, taken=True, moved=True, pending=1, unindexed=5, sizes=2) == [("alias_conflict", "error"), ("alias_moved", "error"), ("pending", "error"), ("indexing", "warning"), ("mixed_sizes", "error"), ("model_switch", "info")]
    assert found("alias", stage="not_applied") == [("not_applied", "error")] and found("alias", stage="cut_over", alias=False, taken=True, pending=1) == [("done", "error"), ("no_alias", "error")]


# Migration.
def migrating(spark, n=40):
    return spark.createDataFrame([(i, f"text {i}" if i % 10 else "  ", None, None) for i in range(n)], "key long, text string, vector array<float>, new_vector array<float>")


@pytest.fixture
def store(spark, tmp_path):
    def f(df):
        p = str(tmp_path / uuid.uuid4().hex)
        df.write.parquet(p)
        return spark.read.parquet(p)

    return f


def lengths(df):
    return embed.embedded(df, lambda texts: [[float(len(t))] * 4 for t in texts], 4)


def test_apply_fills_and_is_idempotent(spark, store):
    out = migrate.apply(migrating(spark), lengths, store)
    assert (out.status, out.rows_written, out.remaining) == ("complete", 36, 0)
    again = migrate.apply(out.table, lengths, store)
    assert (again.rows_written, again.passes) == (0, 0)
    assert {r.key: r.new_vector for r in out.table.collect()}[1] == [6.0] * 4


def test_apply_until_budget_stop_and_poison(spark, store):
    part = migrate.guarded_write(migrating(spark, 101).where("key % 10 <> 0"), migrating(spark, 101).where("key <= 20").selectExpr("key", "md5(text) as text_hash", "array(cast(1 as float)) as new_vector"))
    out = migrate.apply(part, lengths, store, until=0.5)
    assert out.rows_written == 45 - 18 and out.status == "stopped"
    rows = spark.createDataFrame([(i, "x" * 4000, None) for i in range(50)], "key long, text string, new_vector array<float>")
    out = migrate.apply(rows, lengths, store, price=0.1, budget=0.0035, chunk=10)
    assert (out.status, out.rows_written) == ("budget", 30) and out.spent_usd == pytest.approx(0.003)
    assert migrate.apply(rows, lengths, store, should_stop=lambda: True).status == "stopped"

    def poison(df):
        return embed.embedded(df, lambda texts: [[1.0]] * len(texts) if not any(t == "text 13" for t in texts) else 1 / 0)

    out = migrate.apply(migrating(spark), poison, store)
    assert [r.key for r in out.failed.collect()] == [13] and (out.rows_written, out.rejected) == (35, 1)
    again = migrate.apply(out.table, poison, store, failed=out.failed)
    assert (again.passes, again.remaining) == (0, 0)


def test_stale_vectors_are_replaced(spark, store):
    rows = spark.createDataFrame([(1, "new text", [1.0], "old"), (2, "same", [1.0], hashlib.md5(b"same").hexdigest()), (3, "none", None, None)], "key long, text string, new_vector array<float>, new_hash string")
    out = migrate.apply(rows, lengths, store)
    assert (out.status, out.rows_written, out.remaining, out.passes) == ("complete", 2, 0, 1)
    assert {r.key: (r.new_vector[0], r.new_hash == hashlib.md5(r.text.encode()).hexdigest()) for r in out.table.collect()} == {1: (8.0, True), 2: (1.0, True), 3: (4.0, True)}


def test_edits_during_a_run_are_not_lost(spark, store):
    state = {"n": 0}

    def edit(table):
        state["n"] += 1
        return table.withColumn("text", F.when(F.col("key") == 1, F.lit("edited")).otherwise(F.col("text"))) if state["n"] == 1 else table

    out = migrate.apply(migrating(spark), lengths, store, changed=edit)
    assert out.remaining == 0 and {r.key: r.new_vector[0] for r in out.table.where("new_vector is not null").collect()}[1] == 6.0 and out.passes == 2


def test_late_rows_at_the_switch(spark, tmp_path):
    from spindrift.plans import switch

    def table_of(path, missing):
        t = tables.VectorTable(spark, f"file://{tmp_path}/{path}")
        rows = migrating(spark, 200).where("text is not null and trim(text) <> ''")
        keys = [r.key for r in rows.select("key").orderBy("key").limit(missing).collect()]
        full = rows.withColumn("new_vector", F.when(~F.col("key").isin(keys), F.array(F.lit(1.0).cast("float"))).cast("array<float>"))
        t.write(full.select("key", "text", "new_vector"), "live")
        return t, full, t.write(full, "new")

    t, full, _ = table_of("a", 7)
    assert switch.cutover(t, lambda: full, lengths, late=7) == 7 and t.stage == "cut_over"
    assert migrate.pending(t.read("live")).count() == 0
    t, full, _ = table_of("b", 8)
    with pytest.raises(switch.StillPending) as e:
        switch.cutover(t, lambda: full, lengths, late=7)
    assert e.value.rows == 8 and t.stage == "filling"
    state = {"now": full, "n": 0}

    def catch_up():
        state["n"] += 1
        state["now"] = switch.fill(t, full, lengths).table

    assert switch.cutover(t, lambda: state["now"], lengths, catch_up, late=7) == 0 and state["n"] == 1
    t, full, _ = table_of("c", 3)
    poison = lambda df: df.select("key", F.lit(None).cast("array<float>").alias("vector"), F.lit("no").alias("error"))
    with pytest.raises(switch.StillPending):
        switch.cutover(t, lambda: full, poison)
    assert switch.cutover(t, lambda: full, poison, allow_missing=True) == 0 and t.stage == "cut_over"

    # Each row reaches the model once; a model that answers once and then no more loses nothing.
    t, full, _ = table_of("d", 5)
    calls = spark.sparkContext.accumulator(0)
    seen = tmp_path / "seen"
    seen.mkdir()

    def once(df):
        def run(parts):
            for p in parts:
                calls.add(len(p))
                new = [not (seen / str(k)).exists() for k in p["key"]]
                for k in p["key"]:
                    (seen / str(k)).touch()
                yield p.assign(vector=[[1.0] if ok else None for ok in new], error=[None if ok else "no" for ok in new])[["key", "vector", "error"]]

        return df.select("key", "text").mapInPandas(run, "key long, vector array<float>, error string")

    charged = []
    assert switch.cutover(t, lambda: full, once, price=1e6, budget=1e9, charge=charged.append) == 5 and calls.value == 5
    assert migrate.pending(t.read("live")).count() == 0 and charged[0].usd > 0 and charged[0].embedded == 5
    silent = lambda df: df.select("key", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("error"))
    t, full, _ = table_of("e", 5)
    for allowed in (False, True):  # no answer is not a rejection
        with pytest.raises(switch.StillPending):
            switch.cutover(t, lambda: full, silent, allow_missing=allowed)
    with pytest.raises(switch.OverBudget):
        switch.cutover(t, lambda: full, lengths, price=1e9, budget=0.01)
    assert t.stage == "filling"

    # A row that changes while others are embedded is embedded too, in another attempt.
    t, full, _ = table_of("f", 2)
    state = {"now": full, "n": 0}

    def busy(df):
        state["n"] += 1
        if state["n"] == 1:
            state["now"] = full.withColumn("text", F.when(F.col("key") == 3, F.lit("changed meanwhile")).otherwise(F.col("text")))
        return lengths(df)

    def now():
        done = t.read("new").select("key", F.col("text").alias("_t"), F.col("new_vector").alias("_v"))
        own = state["now"].drop("new_vector").join(done, "key", "left")
        return own.withColumn("new_vector", F.when(F.col("text").eqNullSafe(F.col("_t")), F.col("_v"))).drop("_t", "_v")

    assert switch.cutover(t, now, busy) == 3 and state["n"] == 2
    assert migrate.pending(t.read("live")).count() == 0 and t.read("live").where("text = 'changed meanwhile'").count() == 1


def test_differences_catch_up(spark):
    src = spark.createDataFrame([(i, None if i % 10 == 0 else f"t{i}", "{}") for i in range(25)], "key long, text string, payload string")
    copy = src.where("text is not null")
    now = src.withColumn("text", F.when(F.col("key") == 3, F.lit("new")).when(F.col("key") == 5, F.lit("")).otherwise(F.col("text"))).withColumn("payload", F.when(F.col("key") == 4, F.lit('{"a": 1}')).otherwise(F.col("payload"))).where("key <> 6").unionByName(spark.createDataFrame([(99, "fresh", "{}")], src.schema))
    got = {r.key: r.action for r in migrate.differences(now, copy).collect()}
    assert got == {3: "embed", 99: "embed", 4: "payload", 5: "delete", 6: "delete"}
    synced = migrate.sync_payload(copy, now)
    assert {r.key: r.payload for r in synced.collect()}[4] == '{"a": 1}' and synced.count() == copy.count()


def test_payload_equality(spark):
    pairs = [('{"a": 1, "b": 2}', '{"b": 2, "a": 1.0}', True), ('{"a": true}', '{"a": 1}', False), (None, None, True), ("{}", None, False), ("[1, 2]", "[2, 1]", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select(migrate.same_payload("a", "b").alias("got"), "want").collect())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(0, 5)), st.booleans()), max_size=12))
def test_last_writer_wins(spark, versions):
    rows = [(k, at, gone, n) for n, (k, at, gone) in enumerate(versions)]
    best = {}
    for k, at, gone, n in rows:
        if k not in best or at is not None and (best[k][0] is None or at > best[k][0]):
            best[k] = (at, gone, n)
    df = spark.createDataFrame(rows, "id int, updated_at int, deleted boolean, n int")
    want = {k: n for k, (_, gone, n) in best.items() if not gone}
    assert {r.id: r.n for r in migrate.newest(df, order="n").collect()} == want
    one_by_one = df.limit(0)
    for r in rows:
        one_by_one = feed.merged(one_by_one, spark.createDataFrame([r], df.schema))
        if len(rows) > 5:  # long chains of plans are slow to compile
            one_by_one = spark.createDataFrame(one_by_one.collect(), df.schema)
    assert {r.id: r.n for r in feed.live(one_by_one).collect()} == want


def test_versions_and_pointer(spark, tmp_path):
    t = tables.VectorTable(spark, f"file://{tmp_path}/t")
    assert t.stage == "not_started"
    t.write(spark.range(3).toDF("key"), "live")
    t.write(spark.range(5).toDF("key"), "new")
    assert t.stage == "filling" and t.read().count() == 3
    t.cutover()
    assert t.stage == "cut_over" and t.read().count() == 5
    t.rollback()
    assert t.read().count() == 3 and t.read("new").count() == 5
    t.cutover()
    with pytest.raises(tables.SelectionError):
        t.cleanup("wrong")
    t.cleanup(t.pointer["old"])
    assert t.stage == "cleaned_up" and [h["event"] for h in t.state.history] == ["cutover", "rollback", "cutover", "cleanup"]


def test_stream_follows_a_feed(spark, tmp_path):
    schema = "id int, updated_at int, deleted boolean, v string"
    t = tables.VectorTable(spark, f"file://{tmp_path}/t")
    t.write(spark.createDataFrame([(1, 1, False, "a"), (2, 1, False, "b")], schema), "live")
    spark.createDataFrame([(1, 2, False, "c"), (2, 0, False, "old"), (3, 1, False, "d"), (3, 2, True, None)], schema).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        feed.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), t, f"{tmp_path}/ck").awaitTermination()
    assert sorted((r.id, r.v) for r in feed.live(t.read()).collect()) == [(1, "c"), (2, "b")]


# Files.
def test_jsonl(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text('{"id": "a", "text": "one"}\n\n{"text": "two"}\n{"id": "c", "text": " "}\n')
    assert sorted(map(tuple, jsonl.load_documents(spark, str(p)).collect())) == [("3", "two"), ("a", "one")]
    for bad in ('{"id": 1}\n', '{"id": 1, "text": "x"}\n{"id": 1, "text": "y"}\n', "nope\n", '{"text": "  "}\n'):
        p.write_text(bad)
        with pytest.raises(jsonl.CorpusError):
            jsonl.load_documents(spark, str(p))
    q = tmp_path / "q.jsonl"
    q.write_text('{"query": " why ", "relevant": ["b", "a"]}\n{"query": "é", "relevant": 7}\n')
    rows = jsonl.load_queries(spark, str(q))
    assert [(r.query, sorted(r.relevant)) for r in rows.orderBy("qid").collect()] == [("why", ["a", "b"]), ("é", ["7"])]
    jsonl.save_queries(rows, str(tmp_path / "out"))
    assert {json.dumps(r.asDict(), ensure_ascii=False) for r in spark.read.json(str(tmp_path / "out")).select("query", "relevant").collect()} == {'{"query": "why", "relevant": ["a", "b"]}', '{"query": "é", "relevant": ["7"]}'}


def test_envfile(tmp_path, monkeypatch):
    p = tmp_path / ".env"
    assert envfile.parse("A=1\n# no\nexport B='x y' # c\nC=\"a\\nb\"\nD=v # c\n") == {"A": "1", "B": "x y", "C": "a\nb", "D": "v"}
    with pytest.raises(envfile.EnvFileError):
        envfile.parse("what is this")
    envfile.save(p, "SPINDRIFT_T", 'q"uo\\te')
    envfile.save(p, "SPINDRIFT_T", "two")
    assert envfile.parse('A="x\\ty\\$z\\q"\nB=a#b # c\nC=#\nD=\n') == {"A": "x\ty$z\\q", "B": "a#b", "C": "", "D": ""}
    envfile.save(p, "OTHER", 'a"\\$\t\n')
    assert envfile.parse(p.read_text()) == {"SPINDRIFT_T": "two", "OTHER": 'a"\\$\t\n'} and envfile.load(tmp_path / "none") == []
    monkeypatch.setenv("OTHER", "")
    assert p.stat().st_mode & 0o777 == 0o600
    monkeypatch.setenv("SPINDRIFT_T", "kept")
    assert envfile.load(p) == []


# All queries.
def cells(rows, names):
    def cell(v):
        return str([cell(x) for x in v]) if isinstance(v, (list, tuple)) else "NULL" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[n]) for n in names) for r in rows)


def test_queries_equal_sql(spark):
    from spindrift.catalogue import ORACLES, QUERIES

    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark", "events", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, f in QUERIES.items():
        df = f(spark, SF)
        got = df.collect()
        if name in ORACLES:
            out = c.sql(ORACLES[name])
            assert sorted(out.columns) == sorted(df.columns), name
            want = [dict(zip(out.columns, r)) for r in out.fetchall()]
            assert cells(got, sorted(df.columns)) == cells(want, sorted(df.columns)), name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["label", "queries", "same_group"] and set(e.oracle_sql()) <= set(e.queries())
