"""What the command line offers, as functions over tables in files. They return plain dictionaries."""

from __future__ import annotations

import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text, vectors
from spindrift.operators import digests, embed, ivf, knn, lookup, metrics, migrate, profile, remote, sampling
from spindrift.operators.cache import EmbeddingCache
from spindrift.plans import estimates, job, spec, stages, switch, verdict
from spindrift.sources import scratch, tables


def _columns(df: DataFrame, vector: str | None = None, text_column: str | None = None) -> dict:
    found = tables.infer(df)
    return found | {"vector": tables.select_column(df, vector), "text": text_column or found["text"]}


def doctor(df: DataFrame, vector: str | None = None, text_column: str | None = None, sample: int | None = None, **schema) -> dict:
    """Facts and findings about a vector table; a sample is spread over all rows by hash."""
    c = _columns(df, vector, text_column)
    total = df.count()
    rows = sampling.spread(df.withColumn("_key", F.xxhash64(*df.columns)), sample, "_key") if sample and sample < total else df
    each = profile.per_row(rows, c["vector"], c["text"], c["model"])
    p = profile.profile(each)
    found = profile.doctor(p, text_field=c["text"], model_field=c["model"], updated_field=c["updated"], estimated_rows=total, **schema)
    return {
        "columns": c, "sample": {"rows": min(total, sample or total), "method": sampling.sampling_method(total, min(total, sample or total))}, "facts": p.first().asDict(),
        "dimensions": {str(r.value): r.n for r in profile.counts(each, "dims").collect()}, "models": {r.value: r.n for r in profile.counts(each, "model").orderBy(F.desc("n"), "value").limit(1000).collect()},
        "histogram": [r.asDict() for r in profile.histogram(each).orderBy("bin").collect()], "findings": [r.asDict() for r in found.collect()],
    }


def _key(df: DataFrame) -> str:
    return next((k for k in ("key", "id", "doc_id") if k in df.columns), df.columns[0])


def plan(spark: SparkSession, j: job.Job, probe: bool = False) -> dict:
    """Estimates, findings, changes. ``probe``: a few texts are embedded first, so that tokens and time are estimated by what they took."""
    df = spark.read.parquet(j.source.table)
    c = _columns(df, j.source.vector_column, j.source.text_column)
    own = df.agg(F.count(F.lit(1)).alias("rows"), F.count(c["vector"]).alias("vectors"), F.count_if(text.has_text(c["text"]) if c["text"] else F.lit(False)).alias("texts_present"), (F.avg(F.length(c["text"])) if c["text"] else F.lit(0.0)).alias("avg_chars"), F.max(vectors.dims(c["vector"])).alias("max_dims")).withColumn("estimated_rows", F.col("rows"))
    tried = embed.probe(df.select(F.col(_key(df)).alias("key"), F.col(c["text"]).alias("text")), remote.embedder(j.model)) if probe and c["text"] else {}
    e = estimates.estimate(own, j.model.price, j.model.batch, spec.width(j.model), kind=j.target.vector_type, tokens_per_minute=j.limits.tokens_per_minute, requests_per_minute=j.limits.requests_per_minute, tokens_per_char=tried.get("tokens_per_char"), docs_per_second=tried.get("docs_per_second"), hnsw=j.target.index == "hnsw").first().asDict()
    n = own.first()
    found = job.plan_findings(j, e["cost_usd"], text_field=c["text"], texts=n["texts_present"], rows=n["rows"])
    if "error" in tried:
        found.append(("plan.probe_failed", "error"))
    return {"estimates": e, "probe": tried or None, "findings": [{"id": i, "severity": s} for i, s in found], "changes": [{"kind": k, "summary": s} for k, s in job.changes(j, e["est_rows"])], "ok": all(s != "error" for _, s in found)}


def _migrating(spark: SparkSession, j: job.Job, t: tables.VectorTable) -> DataFrame:
    """key, text, payload (all other columns, as JSON), vector, new_vector: the source as it is now, with new vectors where they are of its present texts."""
    df = spark.read.parquet(j.source.table)
    c = _columns(df, j.source.vector_column, j.source.text_column)
    key = _key(df)
    others = [n for n in df.columns if n not in (key, c["text"], c["vector"])]
    payload = F.to_json(F.struct(*[F.col(f"`{n}`") for n in others]), {"ignoreNullFields": "false"}) if others else F.lit(None).cast("string")
    own = df.select(F.col(key).alias("key"), F.col(c["text"]).alias("text"), payload.alias("payload"), F.col(c["vector"]).alias("vector"))
    if t.pointer.get("new"):
        done = t.read("new").select("key", F.col("text").alias("_t"), "new_vector")
        own = own.join(done, "key", "left").withColumn("new_vector", F.when(F.col("text").eqNullSafe(F.col("_t")), F.col("new_vector"))).drop("_t")
        return own
    return own.withColumn("new_vector", F.lit(None).cast("array<float>"))


def apply(spark: SparkSession, j: job.Job, work: str, until: float | None = None) -> dict:
    """Embeds what is pending and writes the table's new version; run it again to catch up."""
    checked = plan(spark, j)
    if not checked["ok"]:
        return {"status": "refused", "findings": checked["findings"]}
    t = tables.VectorTable(spark, work)
    state = t.state
    model, dims = remote.embedder(j.model), spec.width(j.model)
    failed = t.read("failed") if t.pointer.get("failed") else None
    out = migrate.apply(
        _migrating(spark, j, t), lambda df: embed.embedded(df, model, dims, j.model.batch, j.limits.parallel or 1), t.write, j.model.price, j.limits.budget_usd,
        until=until, failed=failed, already=state.spent_usd, cache=_cache(spark, j, work), forget=t.forget,
    )
    if not t.pointer.get("live"):
        t.write(out.table.select("key", "text", "payload", "vector"), "live")
    t.adopt(out.table, "new", drop=True)
    if out.rejected:
        t.adopt(out.failed, "failed", drop=True)
    state.runs += 1
    state.rows_written += out.rows_written
    state.tokens += out.tokens
    state.spent_usd, state.failed = out.spent_usd, out.failed.count() if out.failed is not None else 0
    t.save(state)
    return {"status": out.status, "rows_written": out.rows_written, "asked": out.asked, "tokens": out.tokens, "spent_usd": out.spent_usd, "remaining": out.remaining, "failed": state.failed, "passes": out.passes}


def _cache(spark: SparkSession, j: job.Job, work: str) -> EmbeddingCache:
    """The job's cache, which jobs that name the same folder share; else one of its own."""
    return EmbeddingCache(spark, j.cache or f"{work.rstrip('/')}/cache", spec.space(j.model))


def cutover(spark: SparkSession, j: job.Job, work: str) -> dict:
    """Switches; rows that changed last are embedded on the way, after a catch-up where they are many."""
    t = tables.VectorTable(spark, work)
    model, dims = remote.embedder(j.model), spec.width(j.model)

    def charge(filled: switch.Filled) -> None:
        state = t.state
        state.spent_usd, state.rows_written = state.spent_usd + filled.usd, state.rows_written + filled.embedded
        state.tokens += filled.tokens
        t.save(state)

    budget = None if j.limits.budget_usd is None else j.limits.budget_usd - t.state.spent_usd
    try:
        late = switch.cutover(t, lambda: _migrating(spark, j, t), lambda df: embed.embedded(df, model, dims, j.model.batch, j.limits.parallel or 1), lambda: apply(spark, j, work), price=j.model.price, budget=budget, charge=charge, cache=_cache(spark, j, work))
    except switch.StillPending as e:
        return {"stage": t.stage, "pending": e.rows}
    except switch.OverBudget as e:
        return {"stage": t.stage, "budget": str(e)}
    return {"stage": t.stage, "embedded": late}


def rollback(spark: SparkSession, j: job.Job, work: str) -> dict:
    """Goes back to the old vectors; ``without_vector``: rows with text that have none there, as they came or were empty when the switch was made."""
    t = tables.VectorTable(spark, work)
    t.rollback()
    old = t.read("live").where("vector is not null").select("key")
    return {"stage": t.stage, "without_vector": _migrating(spark, j, t).where(text.has_text("text")).join(old, "key", "left_anti").count()}


def status(spark: SparkSession, j: job.Job, work: str) -> dict:
    """Stage, spending, what is missing; after a switch, how many rows of the source were written since (``late``)."""
    t = tables.VectorTable(spark, work)
    s = t.stage
    out = {"stage": s, "runs": t.state.runs, "tokens": t.state.tokens, "spent_usd": t.state.spent_usd}
    if s == "filling":
        c = migrate.status_counts(_migrating(spark, j, t)).first().asDict()
        out |= c
        if not c["missing"]:
            out["stage"] = s = "ready"
    if s == "cut_over":
        out["late"] = digests.changed_rows(_migrating(spark, j, t), t.read("live"))
    return out | {"next": stages.NEXT[s]}


def groups(spark: SparkSession, j: job.Job, rows: DataFrame) -> DataFrame | None:
    """key, group of a job's rows (key, payload): by the column that it names, or one that is called as groups are; None where there is none."""
    name = j.source.group_by or tables.infer(spark.read.parquet(j.source.table))["group"]
    return rows.select("key", F.variant_get(F.try_parse_json("payload"), f"$['{name}']", "string").alias("group")) if name and "payload" in rows.columns else None


def _searches(index: ivf.Index, asked: list, model: spec.ModelSpec, k: int, probes: int, sweep: tuple[int, ...]) -> list[tuple]:
    """(probes, embed_ms, search_ms) of single queries (key, query), each at every setting, beginning with another one each time."""
    out, call = [], remote.embedder(model, "query")
    for n, r in enumerate(asked):
        began = time.perf_counter()
        vector = call([r["query"]])[0]
        embedded = 1000 * (time.perf_counter() - began)
        one = index.spark.createDataFrame([(r["key"], vector)], "qid long, vector array<float>" if isinstance(r["key"], int) else "qid string, vector array<float>")
        for setting in knn.sweep(probes, list(sweep), n):
            began = time.perf_counter()
            index.search(one, k, setting).collect()
            out.append((setting, embedded, 1000 * (time.perf_counter() - began)))
    return out


def evaluate(
    rows: DataFrame, old: spec.ModelSpec | None, new: spec.ModelSpec, queries: int = 200, k: int = 10, gates: verdict.Gates = verdict.Gates(), group: DataFrame | None = None,
    lists: int = 0, probes: int = 4, sweep: tuple[int, ...] = (), timed: int = 0,
) -> dict:
    """Old and new vectors (key, text, vector, new_vector) compared on queries made from the rows. Without the old model only neighbours count.

    ``lists``: an index of so many inverted lists is built of each side, and its recall measured when ``probes`` of them are searched, and at each
    setting of ``sweep``. ``timed``: so many queries are also embedded and searched one at a time, each search a job of its own."""
    made = sampling.eval_queries(rows.select("key", "text"), queries).cache()
    sides, same, recalls, times = {}, {}, {}, []
    qrels = made.select(F.col("key").alias("qid"), "key")
    slices = made.select(F.col("key").alias("qid"), "slice")
    top = {}
    for side, model, column in (("old", old, "vector"), ("new", new, "new_vector")):
        have = rows.where(F.col(column).isNotNull()).select("key", F.col(column).alias("vector"))
        if model is not None:
            q = embed.embedded(made.select("key", F.col("query").alias("text")), remote.embedder(model, "query"), spec.width(model)).select(F.col("key").alias("qid"), "vector")
            top[side] = knn.knn_block(q, have, k)
            sides[side] = metrics.scores_by_slice(metrics.per_query(top[side], qrels, k), slices)
            if lists:
                index, exact = ivf.Index.build(have, scratch.fresh(rows.sparkSession, "ivf"), lists), scratch.kept(top[side], "exact")
                recalls[side] = {p: metrics.index_recall(index.search(q, k, p), exact).first()["index_recall"] for p in sorted({probes, *sweep})}
                scratch.drop(exact)
                if timed:
                    asked = made.select("key", "query").orderBy(F.md5(F.col("key").cast("string")), "key").limit(timed).collect()  # a stated number
                    times += [(side, *t) for t in _searches(index, asked, model, k, probes, sweep)]
        if group is not None:
            near = knn.knn_block(have.join(made.select("key"), "key", "left_semi").select(F.col("key").alias("qid"), "vector"), have, k, exclude_self=True)
            same[side] = metrics.same_group(near, group).agg(F.avg("same")).first()[0]
    mode = "queries" if "old" in sides else "vectors"
    decided = verdict.by_slice(sides["old"], sides["new"], gates).collect() if mode == "queries" else []
    latency = []
    if times:
        measured = rows.sparkSession.createDataFrame(times, "side string, probes int, embed double, search double")
        embedding = metrics.latencies(measured, "embed", "side", "probes").select("side", "probes", F.col("p95").alias("embed_p95"))
        latency = [r.asDict() for r in metrics.latencies(measured, "search", "side", "probes").join(embedding, ["side", "probes"]).withColumn("end_to_end_p95", lookup.end_to_end("embed_p95", "p95")).orderBy("side", "probes").collect()]
    at = {r["side"]: r["end_to_end_p95"] for r in latency if r["probes"] == probes}
    v = verdict.decide(verdict.Measured(tuple(decided), (same.get("old"), same.get("new")), (at.get("old"), at.get("new")), {s: r[probes] for s, r in recalls.items()}, mode), gates)
    out = {"index_recall": recalls, "latency": latency, "mode": mode, "verdict": asdict(v), "slices": [r.asDict() for r in decided], "same_group": same, "overlap": metrics.overlap(top["old"], top["new"], k).first()["overlap"] if len(top) == 2 else None}
    made.unpersist()
    return out


def bench(docs: DataFrame, specs: list[spec.ModelSpec], queries: int = 100, seed: str = "0", labelled: DataFrame | None = None) -> dict:
    """Models ranked on queries taken out of the documents (key, text), or on labelled ones (qid, query, relevant)."""
    if labelled is None:
        docs, made = sampling.bench_queries(docs, queries, seed)
        asked, qrels = made.select(F.col("key").alias("qid"), "query"), made.select(F.col("key").alias("qid"), "key")
    else:
        kept = sampling.labelled_queries(labelled, docs)
        asked, qrels = kept.select("qid", "query"), kept.select("qid", F.explode("relevant").alias("key"))
    docs = docs.withColumn("text", text.clip("text"))
    out = []
    for n, s in enumerate(specs):
        try:
            d = embed.embedded(docs, remote.embedder(s), spec.width(s))
            q = embed.embedded(asked.select(F.col("qid").alias("key"), F.col("query").alias("text")), remote.embedder(s, "query"), spec.width(s))
            score = metrics.scores(metrics.per_query(knn.knn_block(q.select(F.col("key").alias("qid"), "vector"), d), qrels)).first().asDict()
        except Exception as e:  # noqa: BLE001  a model that fails is ranked last
            score = {"error": str(e)[:300]}
        out.append({"name": spec.title(s), "ordinal": n, "gb": (spec.width(s) or 0) * 4 / 1000} | score)
    return {"models": sorted(out, key=lambda m: ("error" in m, -m.get("recall_at_k", 0), m["ordinal"]))}


