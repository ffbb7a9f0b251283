"""Whole migrations through the command line, and models behind HTTP."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from spindrift import cli, service
from spindrift.operators import embed, remote
from spindrift.plans import spec, verdict


@pytest.fixture
def server():
    """Gives [length, index in the batch] for each text; every first request is refused."""
    seen = {"n": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen["n"] += 1
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen["auth"] = self.headers.get("Authorization")
            code = 429 if seen["n"] == 1 else 400 if "bad" in str(body) else 200
            out = {"data": [{"index": i, "embedding": [float(len(t)), float(i)]} for i, t in enumerate(body["input"])][::-1]} if "input" in body else {"choices": [{"message": {"content": '"A question?"\nmore'}}]}
            data = json.dumps(out).encode()
            self.send_response(code)
            self.send_header("Retry-After", "0")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/v1", seen
    s.shutdown()


def test_http_models(server, spark, monkeypatch):
    url, seen = server
    monkeypatch.setenv("MY_KEY", "k1")
    s = spec.parse(f"compat/m,url={url},key_env=MY_KEY,doc_prefix=p:")
    assert remote.embedder(s)(["a", "bcd"]) == [[3.0, 0.0], [5.0, 1.0]] and seen["n"] == 2 and seen["auth"] == "Bearer k1"
    with pytest.raises(remote.EmbeddingError) as e:
        remote.embedder(s)(["bad"])
    assert "k1" not in str(e.value)
    assert remote.question_writer(s)("text") == "A question?"
    rows = {r.key: r for r in embed.embedded(spark.createDataFrame([(1, "x"), (2, "bad"), (3, "yy")], "key long, text string"), remote.embedder(s), 2).collect()}
    assert rows[2].error and rows[1].vector[0] == 3.0 and rows[3].vector[0] == 4.0
    with pytest.raises(remote.EmbeddingError):
        remote.credentials(spec.parse("compat/m,url=http://example.com/v1,key_env=MY_KEY"))


def test_a_whole_migration(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("key"), "text").dropDuplicates(["text"])
    embed.hash_blake(docs, 16).join(docs, "key").withColumnRenamed("vector", "embedding").write.parquet(f"{tmp_path}/t")
    (tmp_path / "j.yaml").write_text(f"name: x\nsource:\n  table: {tmp_path}/t\n  model: hash/16\nmodel: hash/64\n")
    job, work = str(tmp_path / "j.yaml"), f"file://{tmp_path}/w"

    def call(*args):
        code = cli.main([*args])
        return json.loads(capsys.readouterr().out), code

    out, code = call("doctor", f"{tmp_path}/t")
    assert code == 0 and {f["id"] for f in out["findings"]} >= {"text.ok", "norms.ok", "dims.undeclared"} and out["dimensions"] == {"16": out["facts"]["rows"]}
    out, code = call("plan", job)
    assert code == 0 and out["estimates"]["est_rows"] == docs.count() and out["estimates"]["cost_usd"] == 0
    assert call("status", job, work)[0]["stage"] == "not_started"
    out, code = call("apply", job, work, "--until", "0.5")
    assert code == 3 and out["rows_written"] == -(-docs.count() // 2) and call("status", job, work)[0]["stage"] == "filling"
    out, code = call("apply", job, work)
    assert code == 0 and out["remaining"] == 0 and call("status", job, work)[0]["stage"] == "ready"
    out, code = call("eval", job, work, "--queries", "60")
    assert code == 0 and out["verdict"]["status"] == "go" and out["mode"] == "queries" and 0 < out["overlap"] < 1
    assert call("cutover", job, work)[0]["stage"] == "cut_over" and call("status", job, work)[0]["late"] == 0
    spark.createDataFrame([(-5, "a row that came late", [0.0] * 16)], "key long, text string, embedding array<float>").write.mode("append").parquet(f"{tmp_path}/t")
    assert call("status", job, work)[0]["late"] == 1
    assert call("rollback", job, work)[0] == {"stage": "filling", "without_vector": 1}
    assert call("cutover", job, work, "--check")[1] == 1  # the late row is pending
    assert call("apply", job, work)[0]["asked"] == 1 and call("cutover", job, work, "--check")[1] == 0
    assert call("cleanup", job, work, "x")[1] == 2


def test_small_commands(capsys):
    assert cli.main(["fingerprint", "openai", "text-embedding-3-small", "1536"]) == 0
    assert json.loads(capsys.readouterr().out)["tag"].endswith("#a3ac94a82eca")
    assert cli.main(["init", "my table", "hash/64"]) == 0 and "model: hash/64" in capsys.readouterr().out
    assert cli.main(["plan", "/nowhere.yaml"]) == 2


def test_evaluation_without_the_old_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("key"), "text", "source")
    rows = docs.join(embed.hash_blake(docs, 8), "key").join(embed.hash_blake(docs, 64).withColumnRenamed("vector", "new_vector"), "key")
    out = service.evaluate(rows, None, spec.parse("hash/64"), 40, group=docs.select("key", F.col("source").alias("group")))
    assert out["mode"] == "vectors" and out["verdict"]["status"] in ("go", "no_go") and set(out["same_group"]) == {"old", "new"}
    assert service.evaluate(rows, None, spec.parse("hash/64"), 40)["verdict"]["status"] == "inconclusive" and verdict.EXIT_CODES["inconclusive"] == 3


def test_bench_ranks_models(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("key"), "text")
    out = service.bench(docs, [spec.parse("hash/8"), spec.parse("hash/128")], 30)
    assert out["models"][0]["name"] == "hash/128" and out["models"][0]["recall_at_k"] > out["models"][1]["recall_at_k"]


def test_evaluation_measures_indexes_and_searches(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("key"), "text", "source")
    rows = docs.join(embed.hash_blake(docs, 16), "key").join(embed.hash_blake(docs, 64).withColumnRenamed("vector", "new_vector"), "key")
    old, new = spec.parse("hash/16"), spec.parse("hash/64")
    out = service.evaluate(rows, old, new, 40, gates=verdict.Gates(max_p95_ms=0.001, least_index_recall=1.1), lists=6, probes=2, sweep=(6,), timed=2)
    assert set(out["index_recall"]) == {"old", "new"} and all(r[6] == 1.0 and 0 < r[2] <= 1 for r in out["index_recall"].values())
    assert [(r["side"], r["probes"], r["n"]) for r in out["latency"]] == [("new", 2, 2), ("new", 6, 2), ("old", 2, 2), ("old", 6, 2)]
    assert all(r["end_to_end_p95"] >= r["p95"] > 0 for r in out["latency"])
    assert out["verdict"]["status"] == "no_go" and any("p95" in r for r in out["verdict"]["reasons"]) and sum("index" in w for w in out["verdict"]["warnings"]) == 2
    rows.withColumnRenamed("vector", "embedding").drop("new_vector").withColumn("odd name", F.lit("x")).write.parquet(f"{tmp_path}/t")
    from spindrift.plans import job

    j = job.parse({"name": "x", "source": {"table": f"{tmp_path}/t", "group_by": "odd name"}, "model": "hash/64"})
    found = service.groups(spark, j, spark.createDataFrame([(1, '{"odd name":"a"}'), (2, '{"odd name":3}'), (3, None), (4, "{}")], "key long, payload string"))
    assert {r.key: r.group for r in found.collect()} == {1: "a", 2: "3", 3: None, 4: None}
