"""All queries of the library by name, over the test tables, and DuckDB SQL to compare them with.

Roles of the tables: embeddings are a vector table (key vec_id, group label), documents a text corpus (key
doc_id, group source, slice lang), labels a column that is filled in part, events a change feed and a
table of latencies. Every float of a result is rounded to six digits, as engines add in other orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions import identity as I
from spindrift.functions import text as T
from spindrift.functions import vectors as V
from spindrift.operators import cache, digests, embed, graph, ivf, knn, lookup, metrics, migrate, pivots, profile, sampling
from spindrift.plans import estimates, stages, verdict
from spindrift.sources import buckets, scratch, tables
from spindrift.streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _vectors(spark, sf) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")


def _docs(spark, sf) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text", "lang", "source")


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)  # no negative zero


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f"`{n}`").alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])


# Neighbours: the query set is every vector whose id is divisible by 20, against all vectors.
def _queries(spark, sf) -> DataFrame:
    return _vectors(spark, sf).where(F.col("key") % 20 == 0).select(F.col("key").alias("qid"), "vector")


def _hits_sql(distance: str, where: str = "true", rows: str = "embeddings", k: int = 10) -> str:
    return f"""select * from (select q.vec_id as qid, d.vec_id as key, {distance} as distance,
      row_number() over (partition by q.vec_id order by {distance}, d.vec_id) as rank
      from embeddings q join {rows} d on {where} where q.vec_id % 20 = 0) where rank <= {k}"""


_DOT = "list_dot_product(q.embedding::double[], d.embedding::double[])"
_COS = f"1 - {_DOT} / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(d.embedding::double[], d.embedding::double[])))"
_L2 = "list_distance(q.embedding::double[], d.embedding::double[])"


def _knn_sql(distance: str) -> str:
    return f"select qid, key, round(distance, 6) + 0.0::double as distance, rank::int as rank from ({_hits_sql(distance)})"


@query(_knn_sql(_COS))
def knn_cosine_top10(spark, sf):
    return rounded(knn.knn_block(_queries(spark, sf), _vectors(spark, sf)))


@query(_knn_sql(_L2))
def knn_l2_top10(spark, sf):
    return rounded(knn.knn_block(_queries(spark, sf), _vectors(spark, sf), metric="l2"))


@query(_knn_sql("-" + _DOT))
def knn_ip_top10(spark, sf):
    return rounded(knn.knn_block(_queries(spark, sf), _vectors(spark, sf), metric="inner_product"))


@query(_knn_sql(_COS))
def knn_block_kernel(spark, sf):
    return rounded(knn.knn_block(_queries(spark, sf), _vectors(spark, sf)))


@query("select qid, key, round(distance, 6) + 0.0::double as distance, rank::int as rank from (" + _hits_sql(_COS, "q.vec_id <> d.vec_id").replace("where q.vec_id % 20 = 0", "") + ")")
def knn_all_vectors(spark, sf):
    """Every vector's ten nearest others, by pivots: neither side is broadcast."""
    own = _vectors(spark, sf)
    return rounded(pivots.knn_pivots(own.select(F.col("key").alias("qid"), "vector"), own, exclude_self=True).hits)


def _neighbours(spark, sf) -> DataFrame:
    return knn.knn_block(_queries(spark, sf), _vectors(spark, sf), exclude_self=True)


_NEAR = _hits_sql(_COS, "q.vec_id <> d.vec_id")


@query(f"""with h as ({_NEAR}), s as (select h.qid, o.label as own, avg((g.label = o.label)::int) as same
  from h join embeddings o on o.vec_id = h.qid join embeddings g on g.vec_id = h.key group by h.qid, o.label)
select own as label, count(*) as queries, round(avg(same), 6) as same_group from s group by own""")
def knn_neighbours_same_group(spark, sf):
    """The share of each vector's ten nearest others that have its label, by label."""
    groups = _vectors(spark, sf).select("key", F.col("label").alias("group"))
    same = metrics.same_group(_neighbours(spark, sf), groups)
    return same.groupBy(F.col("group").alias("label")).agg(F.count("qid").alias("queries"), r6(F.avg("same")).alias("same_group"))


@query()
def index_recall_ivf(spark, sf):
    """What share of the exact neighbours an inverted-file search finds. No SQL: its lists are trained and searched in part."""
    found = _index(spark, sf).search(_queries(spark, sf), probes=8)
    return rounded(metrics.index_recall(found, knn.knn_block(_queries(spark, sf), _vectors(spark, sf))))


def _index(spark, sf, lists: int = 16) -> ivf.Index:
    return ivf.Index.build(_vectors(spark, sf), scratch.fresh(spark, "ivf"), lists)


@query()
def index_recall_by_probes(spark, sf):
    """Recall of one trained index by the number of lists searched, up to all of them."""
    index, exact, out = _index(spark, sf), scratch.kept(knn.knn_block(_queries(spark, sf), _vectors(spark, sf))), None
    for probes in (1, 2, 4, 8, 16):
        own = metrics.index_recall(index.search(_queries(spark, sf), probes=probes), exact).select(F.lit(probes).alias("probes"), "queries", "index_recall")
        out = own if out is None else out.unionByName(own)
    return rounded(out)


@query()
def index_recall_graph(spark, sf):
    """Recall of a search on a neighbour graph by the width of its beam. No SQL: the graph is found by descent."""
    g, exact, out = graph.Graph.build(_vectors(spark, sf)), scratch.kept(knn.knn_block(_queries(spark, sf), _vectors(spark, sf))), None
    for ef in (16, 64):
        own = metrics.index_recall(g.search(_queries(spark, sf), ef=ef), exact).select(F.lit(ef).alias("ef"), "queries", "index_recall")
        out = own if out is None else out.unionByName(own)
    return rounded(out)


@query(_knn_sql(_COS))
def ivf_all_lists(spark, sf):
    """A search of all lists of a stored index is exact."""
    return rounded(_index(spark, sf).search(_queries(spark, sf), probes=16))


@query(f"""with t as ({_hits_sql(_COS)}), f as ({_hits_sql(_COS, rows="(select * from embeddings where vec_id % 2 = 0)")}),
e as (select qid, count(*) as n, max(distance) as edge from t group by qid),
m as (select f.qid, count(*) as m from f join e using (qid) where f.distance <= e.edge + 1e-6 * greatest(1, abs(e.edge)) group by f.qid)
select count(*) as queries, round(avg(least(coalesce(m, 0), n) / n), 6) as index_recall from e left join m using (qid)""")
def index_recall_partial(spark, sf):
    """The same for an index that has half of the vectors, those with even ids."""
    rows = _vectors(spark, sf)
    return rounded(metrics.index_recall(knn.knn_block(_queries(spark, sf), rows.where(F.col("key") % 2 == 0)), knn.knn_block(_queries(spark, sf), rows)))


def _cut(df: DataFrame, n: int = 32) -> DataFrame:
    return df.withColumn("vector", F.slice("vector", 1, n))


_HALF = _NEAR.replace(_COS, _COS.replace("embedding::", "embedding[1:32]::"))


@query(f"""with a as ({_NEAR}), b as ({_HALF}), c as (select a.qid, count(b.key) as n from a left join b on a.qid = b.qid and a.key = b.key group by a.qid)
select count(*) as queries, round(avg(n / 10.0), 6) as overlap from c""")
def overlap_at_10(spark, sf):
    """How far neighbours agree when vectors are cut to half their size."""
    half = knn.knn_block(_cut(_queries(spark, sf)), _cut(_vectors(spark, sf)), exclude_self=True)
    return rounded(metrics.overlap(_neighbours(spark, sf), half))


def _relevant(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Relevant to a query vector: the others of its label. (queries, groups)"""
    rows = _vectors(spark, sf).withColumnRenamed("label", "group")
    return rows.where(F.col("key") % 20 == 0).select(F.col("key").alias("qid"), "group"), rows.select("key", "group")


def _scores_sql(hits: str) -> str:
    return f"""select qid, n as n_relevant, coalesce(one / n, 0) as recall_at_1, coalesce(found / n, 0) as recall_at_k, coalesce(1 / first, 0) as mrr_at_k, coalesce(gain / ideal, 0) as ndcg_at_k from
(select q.vec_id as qid, count(d.vec_id) as n, (select sum(1 / log2(i + 1)) from range(1, least(count(d.vec_id), 10) + 1) t(i)) as ideal from embeddings q join embeddings d on q.label = d.label and q.vec_id <> d.vec_id where q.vec_id % 20 = 0 group by q.vec_id) r
left join (select h.qid, count(*) filter (where rank = 1) as one, count(*) as found, min(rank) as first, sum(1 / log2(rank + 1)) as gain from ({hits}) h
  join embeddings o on o.vec_id = h.qid join embeddings g on g.vec_id = h.key where o.label = g.label group by h.qid) f using (qid)"""


@query(f"select count(*) as queries, round(avg(recall_at_1), 6) as recall_at_1, round(avg(recall_at_k), 6) as recall_at_k, round(avg(mrr_at_k), 6) as mrr_at_k, round(avg(ndcg_at_k), 6) as ndcg_at_k from ({_scores_sql(_NEAR)})")
def retrieval_scores_all(spark, sf):
    return rounded(metrics.scores(metrics.per_query_by_group(_neighbours(spark, sf), *_relevant(spark, sf))))


def _slices(spark, sf) -> DataFrame:
    return _vectors(spark, sf).select(F.col("key").alias("qid"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("slice"))


_BY_SLICE = f"""select case when grouping(slice) = 1 then 'all' else slice end as slice, count(*) as queries, avg(recall_at_1) as recall_at_1, avg(recall_at_k) as recall_at_k, avg(mrr_at_k) as mrr_at_k, avg(ndcg_at_k) as ndcg_at_k
from (select s.*, 'label ' || e.label as slice from ({{}}) s join embeddings e on e.vec_id = s.qid) group by grouping sets ((), (slice))"""


@query("select slice, queries, round(recall_at_1, 6) as recall_at_1, round(recall_at_k, 6) as recall_at_k, round(mrr_at_k, 6) as mrr_at_k, round(ndcg_at_k, 6) as ndcg_at_k from (" + _BY_SLICE.format(_scores_sql(_NEAR)) + ")")
def retrieval_scores_by_slice(spark, sf):
    return rounded(metrics.scores_by_slice(metrics.per_query_by_group(_neighbours(spark, sf), *_relevant(spark, sf)), _slices(spark, sf)))


@query(f"""with o as ({_BY_SLICE.format(_scores_sql(_NEAR))}), n as ({_BY_SLICE.format(_scores_sql(_HALF))})
select slice, o.queries, round(o.recall_at_k, 6) as old_recall, round(n.recall_at_k, 6) as new_recall,
  case when o.queries < 5 then 'small' when n.recall_at_k < o.recall_at_k - 0.02 then 'fell' else 'held' end as decision from o join n using (slice)""")
def verdict_by_slice(spark, sf):
    """Whether neighbours got worse when vectors are cut to half, by label."""
    relevant, slices = _relevant(spark, sf), _slices(spark, sf)
    half = knn.knn_block(_cut(_queries(spark, sf)), _cut(_vectors(spark, sf)), exclude_self=True)
    old, new = (metrics.scores_by_slice(metrics.per_query_by_group(h, *relevant), slices) for h in (_neighbours(spark, sf), half))
    return rounded(verdict.by_slice(old, new, verdict.Gates(min_slice=5)))


@query("select event_type, count(value) as n, percentile_disc(0.5) within group (order by value) as p50, percentile_disc(0.95) within group (order by value) as p95, percentile_disc(0.99) within group (order by value) as p99 from events group by event_type")
def latency_percentiles_disc(spark, sf):
    return metrics.latencies(_table(spark, sf, "events"), "value", "event_type")


@query("""select event_type, count(*) as n, round(median(value), 6) as p50, max(case when i = round_even(0.95 * (n - 1), 0) + 1 then value end) as p95
from (select event_type, value, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events where value is not null) group by event_type""")
def latency_percentiles_bench(spark, sf):
    return rounded(metrics.bench_latencies(_table(spark, sf, "events"), "value", "event_type"))


# Profiles and findings. Some vectors are changed so that there is something to find.
def _messy(spark, sf) -> DataFrame:
    k = F.col("key")
    v = F.when(k % 50 == 0, F.lit(None)).when(k % 50 == 1, F.transform("vector", lambda x: x * 0)).when(k % 50 == 2, F.transform("vector", lambda x: x * 3)).when(k % 50 == 3, F.slice("vector", 1, 32)).otherwise(F.col("vector"))
    return _vectors(spark, sf).withColumn("vector", v).withColumn("text", F.when(k % 25 == 0, F.lit("  ")).otherwise(F.concat(F.lit("text "), (k % 300).cast("string")))).withColumn("model", F.when(k % 10 < 9, F.concat(F.lit("model-"), (F.col("label") % 2).cast("string"))))


_MESSY = """select vec_id as key, label, case when vec_id % 50 = 0 then null when vec_id % 50 = 1 then list_transform(embedding, lambda x: x * 0::float) when vec_id % 50 = 2 then list_transform(embedding, lambda x: x * 3::float) when vec_id % 50 = 3 then embedding[1:32] else embedding end as vector,
  case when vec_id % 25 = 0 then '  ' else 'text ' || (vec_id % 300) end as text, case when vec_id % 10 < 9 then 'model-' || (label % 2) end as model from embeddings"""
_PER_ROW = f"select *, len(vector) as dims, sqrt(list_dot_product(vector::double[], vector::double[])) as norm, vector::varchar as vh, trim(text) <> '' as has_text from ({_MESSY})"
_PROFILE = f"""select count(*) as rows, count(*) filter (where vector is null) as null_vectors, count(vector) as vectors, count(*) filter (where has_text) as texts_present,
  count(*) filter (where has_text) - count(distinct case when has_text then text end) as duplicate_texts, count(vh) - count(distinct vh) as duplicate_vectors, count(distinct dims) as sizes, min(dims)::int as min_dims, max(dims)::int as max_dims,
  count(*) filter (where norm < 1e-9) as zero, count(*) filter (where norm >= 1e-9 and abs(norm - 1) <= 0.01) as unit, min(norm) as min_norm, median(norm) as median_norm, max(norm) as max_norm,
  min(norm) filter (where norm >= 1e-9) as min_nonzero, max(norm) filter (where norm >= 1e-9) as max_nonzero, count(case when vector is not null then model end) as models_recorded, count(distinct case when vector is not null then model end) as models from ({_PER_ROW})"""


def _profile(spark, sf) -> DataFrame:
    return profile.profile(profile.per_row(_messy(spark, sf), "vector", "text", "model"))


@query(f"select * replace (round(min_norm, 6) as min_norm, round(median_norm, 6) as median_norm, round(max_norm, 6) as max_norm, round(min_nonzero, 6) as min_nonzero, round(max_nonzero, 6) as max_nonzero) from ({_PROFILE})")
def profile_vectors(spark, sf):
    return rounded(_profile(spark, sf))


@query("""with d as (select doc_id, text, trim(text) <> '' as ok from documents)
select count(*) as rows, count(*) filter (where ok) as texts_present, count(*) filter (where ok) - count(distinct case when ok then text end) as duplicate_texts from d""")
def profile_text(spark, sf):
    rows = _docs(spark, sf).withColumn("vector", F.lit(None).cast("array<float>"))
    return profile.profile(profile.per_row(rows, "vector", "text")).select("rows", "texts_present", "duplicate_texts")


def _scaled(spark, sf) -> DataFrame:
    return _vectors(spark, sf).select((V.norm("vector") * (1 + F.col("key") % 97 / 10.0)).alias("norm"))


@query("""with n as (select sqrt(list_dot_product(embedding::double[], embedding::double[])) * (1 + (vec_id % 97) / 10.0) as norm from embeddings), b as (select min(norm) as lo, max(norm) as hi, (max(norm) - min(norm)) / 20 as w from n)
select i::int as bin, round(lo + i * w, 6) as start, round(lo + (i + 1) * w, 6) as "end", count(norm) as n from b, range(20) t(i) left join n on least(floor((norm - (select lo from b)) / (select w from b)), 19) = i group by i, lo, w""")
def norm_histogram(spark, sf):
    return rounded(profile.histogram(_scaled(spark, sf)))


@query(f"select model as value, count(*) as n from ({_MESSY}) where model is not null and vector is not null group by model")
def model_breakdown(spark, sf):
    return profile.counts(profile.per_row(_messy(spark, sf), "vector", "text", "model"), "model")


@query(f"select dims as value, count(*) as n from ({_PER_ROW}) where dims is not null group by dims")
def dims_breakdown(spark, sf):
    return profile.counts(profile.per_row(_messy(spark, sf)), "dims").select(F.col("value").cast("long").alias("value"), "n")


_RULES = f"""with p as ({_PROFILE}), f as (select unnest([
  case when texts_present < rows then {{'id': 'text.partial', 'severity': 'warning'}} end, case when texts_present = rows then {{'id': 'text.ok', 'severity': 'ok'}} end,
  case when null_vectors > 0 then {{'id': 'vectors.null', 'severity': 'warning'}} end, case when sizes > 1 then {{'id': 'dims.mixed', 'severity': 'error'}} end, {{'id': 'dims.undeclared', 'severity': 'warning'}},
  case when zero > 0 then {{'id': 'norms.zero', 'severity': 'error'}} end, case when unit > 0 and unit < vectors - zero then {{'id': 'norms.mixed', 'severity': 'warning'}} end, case when vectors > zero and unit = vectors - zero then {{'id': 'norms.ok', 'severity': 'ok'}} end,
  case when vectors > zero and unit = 0 then {{'id': 'norms.unnormalized', 'severity': 'info'}} end, case when unit < vectors - zero then {{'id': 'norms.inner_product_unnormalized', 'severity': 'warning'}} end,
  case when duplicate_texts > 0.01 * texts_present then {{'id': 'duplicates.text', 'severity': 'warning'}} end, case when duplicate_vectors > 0.01 * vectors then {{'id': 'duplicates.vectors', 'severity': 'warning'}} end,
  case when models = 0 then {{'id': 'models.untracked', 'severity': 'info'}} end, case when models > 1 then {{'id': 'models.mixed', 'severity': 'error'}} end, case when models = 1 then {{'id': 'models.ok', 'severity': 'ok'}} end,
  case when models > 0 and models_recorded < vectors then {{'id': 'models.partial', 'severity': 'warning'}} end, {{'id': 'index.ok', 'severity': 'ok'}}, {{'id': 'sync.trigger', 'severity': 'ok'}}]) as f from p)
select f.id as id, f.severity as severity, (list_position(['ok', 'info', 'warning', 'error'], f.severity) - 1)::int as rank from f where f is not null"""


def _findings(spark, sf) -> DataFrame:
    return profile.doctor(_profile(spark, sf), model_field="model", indexes=[("by_vector", "hnsw", "inner_product")])


@query(_RULES)
def findings_doctor(spark, sf):
    return _findings(spark, sf).select("id", "severity", "rank")


@query(f"select severity, count(*) as n, severity = 'error' as worst from ({_RULES}) group by severity")
def severity_counts(spark, sf):
    return profile.severity_counts(_findings(spark, sf))


# Samples, text, queries.
_MD5 = "md5(doc_id::varchar)"


@query(f"select doc_id as key from documents order by {_MD5}, doc_id limit 100")
def spread_sample(spark, sf):
    return sampling.spread(_docs(spark, sf), 100).select("key")


@query(f"select doc_id as key from documents where doc_id % 97 = 0 union all (select doc_id from documents where doc_id % 97 <> 0 order by {_MD5}, doc_id limit (select greatest(0, 200 - count(*)) from documents where doc_id % 97 = 0))")
def sample_keep_ids(spark, sf):
    docs = _docs(spark, sf)
    return sampling.keeping(docs, 200, docs.where(F.col("key") % 97 == 0)).select("key")


@query(f"select doc_id as key from documents left join labels using (doc_id) where trim(text) <> '' and quality is not null and toxic is not null order by {_MD5}, doc_id limit 60")
def eval_row_sample(spark, sf):
    joined = _docs(spark, sf).join(_table(spark, sf, "labels").withColumnRenamed("doc_id", "key"), "key", "left")
    return sampling.with_both_vectors(joined, 60, old="quality", new="toxic").select("key")


@query("select lang, sum(length(text))::bigint as chars, sum(length(substr(text, 1, 8000)))::bigint as bench, sum(length(substr(text, 1, 24000)))::bigint as embed, count(*) filter (where length(text) > 8000) as clipped, round(avg(length(text)), 6) as mean from documents group by lang")
def clip_stats(spark, sf):
    d = _docs(spark, sf)
    total = lambda c: F.sum(F.length(c)).cast("long")
    return rounded(d.groupBy("lang").agg(total(F.col("text")).alias("chars"), total(T.clip("text")).alias("bench"), total(T.clip("text", T.EMBED_CLIP)).alias("embed"), F.count_if(F.length("text") > T.BENCH_CLIP).alias("clipped"), F.avg(F.length("text")).alias("mean")))


@query(r"select doc_id as key, len(regexp_extract_all(text, '\S+'))::int as n_words from documents")
def word_counts(spark, sf):
    return _docs(spark, sf).select("key", T.word_count("text").alias("n_words"))


@query(r"""select doc_id as key, case when a = 0 and l = 0 then 'other' when a >= l then 'arabic' else 'latin' end as script, lang || '→' || case when a = 0 and l = 0 then 'other' when a >= l then 'arabic' else 'latin' end as slice
from (select *, len(regexp_extract_all(text, '[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]')) as a, len(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ɏ]')) as l from documents)""")
def script_of_text(spark, sf):
    return _docs(spark, sf).select("key", T.script("text").alias("script"), T.slice_label("lang", T.script("text")).alias("slice"))


# RE2 can't look behind: the place of a split is marked first, then split. A match takes the whole of the white space, so the next one can't begin inside it.
_BENCH_SPLIT = r"""list_filter(string_split(regexp_replace(regexp_replace(trim(text), '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_matches(s, '\S'))"""
_EVAL_SPLIT = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?؟۔])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"""
_NORM = r"trim(regexp_replace(lower(s), '\s+', ' ', 'g'))"


@query(f"select key, len(p)::int as n, md5(array_to_string(p, '|')) as digest from (select doc_id as key, {_BENCH_SPLIT} as p from documents)")
def sentences_bench(spark, sf):
    p = T.bench_sentences("text")
    return _docs(spark, sf).select("key", p.alias("p")).select("key", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


@query(f"select key, len(p)::int as n, md5(array_to_string(p, '|')) as digest from (select doc_id as key, {_EVAL_SPLIT} as p from documents)")
def sentences_eval(spark, sf):
    p = T.eval_sentences("text")
    return _docs(spark, sf).select("key", p.alias("p")).select("key", F.size("p").alias("n"), F.md5(F.array_join("p", "|")).alias("digest"))


@query(f"select norm, count(*) as n from (select {_NORM} as norm from (select unnest(list_distinct({_EVAL_SPLIT})) as s from documents)) group by norm having count(*) > 1")
def boilerplate_sentences(spark, sf):
    return sampling.boilerplate(_docs(spark, sf).select("key", T.eval_sentences("text").alias("sentences"))).where("n > 1")


def _one_sentence(split: str, low: int, high: int) -> str:
    return f"""with parts as (select doc_id as key, text, {split} as p from documents),
s as (select key, i - 1 as i, p[i] as s from (select key, p, unnest(range(1, len(p) + 1)) as i from parts)),
c as (select norm from (select {_NORM} as norm from (select key, unnest(list_distinct(p)) as s from parts)) group by norm having count(*) = 1),
u as (select key, i, s from (select *, {_NORM} as norm from s where len(regexp_extract_all(s, '\\S+')) between {low} and {high}) join c using (norm)),
one as (select key, i, s from (select *, row_number() over (partition by key order by md5(key || '|0|' || i), i) as r from u) where r = 1),
w as (select key, text, p, regexp_extract_all(text, '\\S+') as w from parts)"""


@query(_one_sentence(_EVAL_SPLIT, 5, 40) + """, made as (select key, coalesce(s, case when len(w) >= 12 then array_to_string(w[1:least(12, len(w) // 2)], ' ') end) as query from w left join one using (key))
select key, query from made where query is not null order by md5(key || '0'), key limit 200""")
def proxy_queries_eval(spark, sf):
    return sampling.eval_queries(_docs(spark, sf), 200).select("key", "query")


@query(_one_sentence(_BENCH_SPLIT, 6, 40) + """, g as (select key, s, w, i, case when i is not null and len(p) >= 2 then array_to_string(list_concat(p[1:i], p[i + 2:]), ' ') end as rest from w left join one using (key)),
made as (select key, case when len(regexp_extract_all(rest, '\\S+')) >= 8 then s when len(w) >= 20 then array_to_string(w[1:least(12, len(w) // 3)], ' ') end as query,
  case when len(regexp_extract_all(rest, '\\S+')) >= 8 then rest when len(w) >= 20 then array_to_string(w[least(12, len(w) // 3) + 1:], ' ') end as kept from g)
select key, query, md5(kept) as rest from made where query is not null order by md5(key || '0'), key limit 200""")
def proxy_queries_bench(spark, sf):
    docs, queries = sampling.bench_queries(_docs(spark, sf), 200)
    return queries.join(docs, "key").select("key", "query", F.md5("text").alias("rest"))


_PASSAGES = "select b.item_id as qid, d.doc_id as key from benchmark b join documents d on contains(d.text, b.text)"


_ANCHOR = 5


def _labelled(spark, sf) -> DataFrame:
    """Passages whose documents are known: those that contain them. A document has all inner words of a passage that it contains.

    So the first inner words of a passage are looked up among all runs of words, by hash, and whole passages are looked for in the
    documents found. Passages too short for that are few and looked for everywhere."""
    words = lambda c: F.split(F.col(c), " ")
    b = _table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    long = F.size(words("query")) >= _ANCHOR + 2
    run = lambda w, i: F.xxhash64(*[F.get(w, i + c) for c in range(_ANCHOR)])
    anchors = b.where(long).withColumn("anchor", run(words("query"), F.lit(1)))
    docs = _docs(spark, sf).select("key", "text")
    # a text is split once, and a run of words found by its place: work is in proportion to the words, not to their square
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - _ANCHOR, F.lit(0))), lambda i: run(w, i))
    split = F.transform(F.array(words("text")), runs)[0]
    met = docs.select("key", F.explode(F.array_distinct(split)).alias("anchor")).join(anchors, "anchor").select("key", "qid", "query")
    found = met.join(docs, "key").where(F.col("text").contains(F.col("query"))).select("qid", "key")
    short = docs.join(F.broadcast(b.where(~long & (F.col("query") != ""))), F.col("text").contains(F.col("query"))).select("qid", "key")
    pairs = found.unionByName(short)
    return b.join(pairs.groupBy("qid").agg(F.collect_set("key").alias("relevant")), "qid", "left").withColumn("relevant", F.coalesce("relevant", F.array().cast("array<long>")))


@query(f"select qid, count(*)::int as n_relevant, min(key) as first, max(key) as last from ({_PASSAGES}) group by qid")
def labelled_queries(spark, sf):
    own = sampling.labelled_queries(_labelled(spark, sf), _docs(spark, sf))
    return own.select("qid", F.size("relevant").alias("n_relevant"), F.array_min("relevant").alias("first"), F.array_max("relevant").alias("last"))


@query(f"select count(distinct b.item_id) as queries, count(distinct p.qid) filter (where p.key % 2 = 0) as usable, count(distinct b.item_id) - count(distinct p.qid) filter (where p.key % 2 = 0) as skipped from benchmark b left join ({_PASSAGES}) p on p.qid = b.item_id")
def labelled_prune(spark, sf):
    """Labels that are outside a corpus of half the documents are dropped, and queries without any left are skipped."""
    all_queries = scratch.kept(_labelled(spark, sf), "labelled")
    left = sampling.labelled_queries(all_queries, _docs(spark, sf).where(F.col("key") % 2 == 0))
    return all_queries.agg(F.count("qid").alias("queries")).crossJoin(left.agg(F.count("qid").alias("usable"))).withColumn("skipped", F.col("queries") - F.col("usable"))  # one row each


_VARIANTS = [
    ("props", "props"), ("props", """'{"x": 1.50,  "k":' || k || '.0}'"""), ("""'{"x":1.5,"k":' || k || '}'""", """'{"k":' || k || ',  "x":1.50}'"""), ("props", """'{"k":"' || k || '"}'"""),
    ("null", "props"), ("""'{"k":null}'""", "'{}'"), ("""'{"k":[' || k || ',2]}'""", """'{"k":[2,' || k || ']}'"""), ("""'{"k":' || k || '.00}'""", "props"), ("null", "null"), ("'k=' || k", "'k=' || k"), ("'k=' || k", "'k =' || k"),
]
_PAYLOADS_SQL = ", ".join("case event_id % 11 " + " ".join(f"when {i} then {v[side]}" for i, v in enumerate(_VARIANTS)) + f" end as {name}" for side, name in enumerate("ab"))
_FLAT = lambda c: f"""list_sort(list_transform(json_keys({c}), lambda n: n || ' ' || case when json_type({c}, '$.' || n) in ('UBIGINT', 'BIGINT', 'DOUBLE') then 'n' || json_extract({c}, '$.' || n)::double else json_type({c}, '$.' || n) || json_extract({c}, '$.' || n) end))"""


@query(f"""with p as (select event_id as key, {_PAYLOADS_SQL} from (select *, json_extract_string(props, '$.k') as k from events)),
f as (select *, case when json_valid(a) then {_FLAT("a")} end as fa, case when json_valid(b) then {_FLAT("b")} end as fb from p)
select key, a is not distinct from b or coalesce(fa = fb, false) as same from f""")
def payload_diff_json(spark, sf):
    """Payloads and variants of them compared as values: the order of keys, blanks and zeros at the end of numbers don't matter, kinds do."""
    own = _table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    sides = [F.expr(_PAYLOADS_SQL.split(" end as ")[0] + " end").alias("a"), F.expr("case" + _PAYLOADS_SQL.split("case")[2].removesuffix(" as b")).alias("b")]
    return own.select(F.col("event_id").alias("key"), *sides).select("key", migrate.same_payload("a", "b").alias("same"))


@query("""with t as (select doc_id as key, text, case when doc_id % 3 > 0 then 1.0 end as old, doc_id % 3 = 2 as fresh, doc_id % 4 > 0 as sent, doc_id % 5 = 0 as changed from documents),
w as (select *, sent and not changed and (old is null or not fresh) as ok from t)
select count(*) as rows, count(*) filter (where ok) as written, count(*) filter (where ok or fresh) as right_hash, count(*) filter (where not ok and not fresh and trim(text, E' \\t\\n\\r\\f\\v') <> '') as still_pending from w""")
def stale_rewrite(spark, sf):
    """Vectors made from an older text are replaced, those of the present text and rows whose text changed meanwhile are not."""
    return _rewritten(migrate.guarded_write(*_stale(spark, sf)))


def _stale(spark, sf) -> tuple[DataFrame, DataFrame]:
    k = F.col("key")
    t = _docs(spark, sf).select("key", "text", F.when(k % 3 > 0, F.array(F.lit(1.0))).alias("new_vector"), F.when(k % 3 == 2, F.md5("text")).when(k % 3 == 1, F.lit("old")).alias("new_hash"))
    sent = t.where(k % 4 > 0).select("key", F.when(k % 5 == 0, F.md5(F.lit("before"))).otherwise(F.md5("text")).alias("text_hash"), F.array(F.lit(2.0)).alias("new_vector"))
    return t, sent


def _rewritten(out: DataFrame) -> DataFrame:
    here = F.col("new_hash").eqNullSafe(F.md5("text"))
    left = migrate.pending(out).agg(F.count("key").alias("still_pending"))
    return out.agg(F.count("key").alias("rows"), F.count_if(F.col("new_vector")[0] == 2.0).alias("written"), F.count_if(here).alias("right_hash")).crossJoin(left)  # one row each


@query(ORACLES["stale_rewrite"])
def bucketed_rewrite(spark, sf):
    """The same in a table of buckets: only rows that get a vector are written, and read back with the others."""
    t, sent = _stale(spark, sf)
    table = buckets.BucketTable(spark, scratch.fresh(spark, "buckets"))
    table.create(t, "key", 16)
    now = table.read()
    table.merge(migrate.guarded_write(now.join(sent.select("key"), "key", "left_semi"), sent).where(F.col("new_vector")[0] == 2.0))
    return _rewritten(table.read())


@query(r"""select doc_id as key, 'see ' || regexp_replace(url, '(https?://[^\s?,]+)\?[^\s,]*', '\1?…') || ' now' as masked,
md5(regexp_replace(trim(string_split(trim(case doc_id % 3 when 0 then '"' || text else ' “' || text || '”' end, ' '), chr(10))[1], ' '), '^["''“”]+|["''“”]+$', '', 'g')) as cleaned
from documents join pages on page_id = doc_id""")
def masked_and_cleaned(spark, sf):
    """Addresses without what they ask for, and the first lines of quoted texts, as chat models reply, without their quotes."""
    pages = _table(spark, sf, "pages").select(F.col("page_id").alias("key"), F.concat(F.lit("see "), "url", F.lit(" now")).alias("url"))
    reply = F.when(F.col("key") % 3 == 0, F.concat(F.lit('"'), "text")).otherwise(F.concat(F.lit(" “"), "text", F.lit("”")))
    return _docs(spark, sf).join(pages, "key").select("key", T.masked_url("url").alias("masked"), F.md5(T.cleaned_reply(reply)).alias("cleaned"))


@query("""select label, count(*) as vectors, round(max(sqrt(list_sum(list_transform(embedding, lambda x: ((x::double / n)::float::double) ^ 2)))), 6) as longest
from (select *, sqrt(list_sum(list_transform(embedding, lambda x: x::double ^ 2))) as n from embeddings) group by label""")
def unit_vectors(spark, sf):
    """Rows brought to length one."""
    own = _vectors(spark, sf).select("label", V.normalized("vector").alias("v"))
    return rounded(own.groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.max(V.norm("v")).alias("longest")))


# Embedding.
@query()
def embed_hash256(spark, sf):
    """The exact hashing model. No SQL: engines have no BLAKE2b."""
    out = embed.hash_blake(_docs(spark, sf).select("key", "text"), 256)
    return out.select("key", V.dims("vector").alias("dims"), r6(V.norm("vector")).alias("norm"), r6(F.element_at("vector", 1).cast("double")).alias("first"))


_STOP = ", ".join(f"'{w}'" for w in embed.STOPWORDS)
_EMBED64 = f"""with a as (select doc_id as key, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as al from documents), b as (select key, al, list_filter(al, lambda x: not list_contains([{_STOP}], x)) as so from a),
w as (select key, unnest(case when len(so) > 0 then so else al end) as word from b), h as (select key, (('0x' || substr(md5(word), 1, 8))::bigint % 64)::int as idx, case when ('0x' || substr(md5(word), 9, 1))::int % 2 = 1 then 1 else -1 end as sign from w),
c as (select key, idx, sum(sign) as c from h group by key, idx having sum(sign) <> 0), v as (select key, idx, sign(c) * (1 + ln(abs(c))) as v from c), nn as (select key, sqrt(sum(v * v)) as n from v group by key)"""


@query(_EMBED64 + " select key, count(*) as cells, round(sum((v / n)::float::double), 4) as total, round(max((v / n)::float::double), 6) as top from v join nn using (key) group by key")
def embed_md5_64(spark, sf):
    """The hashing model by MD5, which SQL has too."""
    out = embed.hash_md5(_docs(spark, sf).select("key", "text"), 64)
    cells = out.select("key", F.posexplode("vector").alias("i", "x")).where("x <> 0")
    return cells.groupBy("key").agg(F.count("i").alias("cells"), F.round(F.sum(F.col("x").cast("double")), 4).alias("total"), r6(F.max(F.col("x").cast("double"))).alias("top"))


@query()
def bench_leaderboard_md5(spark, sf):
    """Two hashing models ranked on queries taken out of the documents, whose texts are used whole. No SQL: near ties of 32-bit vectors fall as the order of sums does."""
    docs, queries = sampling.bench_queries(_docs(spark, sf).select("key", "text"), 50)
    qrels = queries.select(F.col("key").alias("qid"), "key")
    out = None
    for n, dims in enumerate((16, 64)):
        d = embed.hash_md5(docs, dims)
        q = embed.hash_md5(queries.select("key", F.col("query").alias("text")), dims).select(F.col("key").alias("qid"), "vector")
        s = metrics.scores(metrics.per_query(knn.knn_block(q, d), qrels)).select(F.lit(f"hash-md5/{dims}").alias("name"), F.lit(n).alias("ordinal"), "queries", "recall_at_1", "recall_at_k", "mrr_at_k", "ndcg_at_k", F.lit(dims * 4 / 1000).alias("gb"))
        out = s if out is None else out.unionByName(s)
    return rounded(metrics.leaderboard(out))


@query("""with m as (select event_type as name, row_number() over (order by event_type) as ordinal, avg(value) / 100 as recall, case when event_type = 'click' then null else count(*) / 1000.0 end as cost, max(value) as gb, median(value) as ms from events where event_type <> 'error' group by event_type),
ok as (select *, max(recall) over () as top from m)
select (select name from ok order by recall desc, ordinal limit 1) as best, (select name from ok where recall >= top - 0.02 order by cost is null, coalesce(cost, 0), gb, ordinal limit 1) as value, (select name from ok order by ms, ordinal limit 1) as fastest""")
def bench_picks(spark, sf):
    """Best, best value and fastest of some candidates."""
    e = _table(spark, sf, "events").where("event_type <> 'error'").groupBy(F.col("event_type").alias("name")).agg((F.avg("value") / 100).alias("recall_at_k"), F.count(F.lit(1)).alias("n"), F.max("value").alias("gb"), F.percentile("value", 0.5).alias("ms"))
    m = e.withColumn("ordinal", F.row_number().over(Window.orderBy("name"))).withColumn("cost", F.when(F.col("name") != "click", F.col("n") / 1000.0))
    return metrics.picks(m)


@query("""with c as (select distinct text from documents where doc_id % 3 = 0), d as (select *, text in (select text from c) as hit from documents)
select count(*) filter (where hit) as hits, count(distinct case when not hit then text end) as misses, min(case when not hit then sha256('m|64' || chr(0) || 'document' || chr(0) || text) end) as first_miss from d""")
def embedding_cache_misses(spark, sf):
    docs = _docs(spark, sf)
    cache = docs.where(F.col("key") % 3 == 0).select(I.cache_key("m|64", "document", "text").alias("cache_key"), F.array(F.lit(1.0)).alias("vector")).dropDuplicates(["cache_key"])
    hits, misses = embed.cache_split(docs.select("key", "text"), cache, "m|64")
    return hits.agg(F.count("key").alias("hits")).crossJoin(misses.agg(F.count("text").alias("misses"), F.min("cache_key").alias("first_miss")))  # one row each


@query("""with c as (select distinct text from documents where doc_id % 3 = 0 and text is not null)
select doc_id as key, length(text)::bigint as size, case when text in (select text from c) or doc_id > min(doc_id) over (partition by text) then 0 else length(text) end::bigint as tokens from documents where text is not null""")
def cache_in_path(spark, sf):
    """A third of the documents through a model that counts a token a character, then all through the cache: the model sees the other texts, each once."""

    def model(texts):
        out = embed.Answer([float(len(t))] for t in texts)
        out.tokens = sum(map(len, texts))
        return out

    asked = lambda df: embed.embedded(df, model, 1, 1)
    docs, store = _docs(spark, sf).select("key", "text"), cache.EmbeddingCache(spark, scratch.fresh(spark, "cache"), "characters")
    scratch.kept(store.split(docs.where(F.col("key") % 3 == 0)).answered(asked), "first")
    return store.split(docs).answered(asked).select("key", F.col("vector")[0].cast("long").alias("size"), "tokens")


@query(r"""with p as (select text from documents where trim(text, E' \t\n\r\f\v') <> '' order by md5(doc_id::varchar), doc_id limit 16), r as (select sum(len(regexp_extract_all(substr(text, 1, 24000), '\S+')))::double / sum(length(substr(text, 1, 24000))) as per_char from p),
s as (select count(*) as rows, avg(length(text)) as chars from documents) select round(per_char, 6) + 0.0 as tokens_per_char, round_even(rows * chars * per_char, 0)::bigint as tokens, round(round_even(rows * chars * per_char, 0) * 0.02 / 1e6, 6) as cost_usd from r, s""")
def plan_estimates_probed(spark, sf):
    """The cost of all documents by what sixteen of them take, from a model that counts words as tokens."""

    def model(texts):
        out = embed.Answer([1.0] for _ in texts)
        out.tokens = sum(len(t.split()) for t in texts)
        return out

    docs = _docs(spark, sf)
    ratio = embed.probe(docs.select("key", "text"), model)["tokens_per_char"]
    own = docs.agg(F.count("*").alias("estimated_rows"), F.count("*").alias("rows"), F.lit(0).alias("vectors"), F.count("*").alias("texts_present"), F.avg(F.length("text")).alias("avg_chars"), F.lit(0).alias("max_dims"))
    return rounded(estimates.estimate(own, 0.02, tokens_per_char=ratio).select(F.lit(ratio).alias("tokens_per_char"), "tokens", "cost_usd"))


# Identity.
@query("""with s as (select distinct ' ' || upper(source) || ' ' as provider, lang || '-Model' as model, n_chars::int + 1 as dimensions, case when n_chars % 2 = 0 then 'v' || n_chars % 7 end as version, case when n_chars % 3 = 0 then 'search' end as task, case when n_chars % 5 = 0 then lang || '"|' end as prefix, n_chars % 4 > 0 as normalized from documents),
j as (select *, lower(trim(provider)) as p, lower(trim(model)) as m from s),
h as (select *, substr(sha256('{"dimensions":' || dimensions || ',"model":' || to_json(m) || ',"normalized":' || normalized || ',"prefix":' || coalesce(to_json(prefix), 'null') || ',"provider":' || to_json(p) || ',"task":' || coalesce(to_json(task), 'null') || ',"version":' || coalesce(to_json(version), 'null') || '}'), 1, 12) as digest from j)
select digest, p || '/' || m || '@' || dimensions || '#' || digest as tag from h""")
def fingerprint_tags(spark, sf):
    """Vector spaces named after the sources, languages and lengths of documents."""
    n = F.col("n_chars")
    s = _table(spark, sf, "documents").select(
        F.concat(F.lit(" "), F.upper("source"), F.lit(" ")).alias("provider"), F.concat("lang", F.lit("-Model")).alias("model"), (n.cast("int") + 1).alias("dimensions"), F.when(n % 2 == 0, F.concat(F.lit("v"), n % 7)).alias("version"),
        F.when(n % 3 == 0, "search").alias("task"), F.when(n % 5 == 0, F.concat("lang", F.lit('"|'))).alias("prefix"), (n % 4 > 0).alias("normalized"),
    ).distinct()
    return s.select(I.digest().alias("digest"), I.tag().alias("tag"))


@query()
def uuid5_point_ids(spark, sf):
    """Keys of a row store as point ids. No SQL: DuckDB makes no UUID from bytes; tested against Python's."""
    return _docs(spark, sf).select("key", I.point_id(F.when(F.col("key") % 2 == 0, F.col("key").cast("string")).otherwise(F.concat(F.lit("doc-"), F.col("key").cast("string")))).alias("point"))


# Plans.
@query("""with s as (select count(*) as rows, count(*) filter (where trim(text) <> '') as present, avg(length(text)) as chars from documents), e as (select round_even(rows * 10 * present / rows, 0)::bigint as est_rows, rows * 10 as total, chars from s),
t as (select *, round_even(est_rows * chars * 0.25, 0)::bigint as tokens, ceil(est_rows / 64)::bigint as requests from e)
select est_rows, tokens, requests, round(tokens * 0.02 / 1e6, 6) as cost_usd, round(greatest(60 * tokens / 1000000, 60 * requests / 3000), 6) as seconds,
  case when 60 * tokens / 1000000 > 60 * requests / 3000 then 'tokens per minute' else 'requests per minute' end as seconds_by, est_rows * (1536 * 4 + 8) as new_bytes, est_rows * (1536 * 4 + 208) as index_bytes, round_even(total * (256 * 4 + 8), 0)::bigint as old_bytes from t""")
def plan_estimates(spark, sf):
    """What embedding ten times the documents with a known model would take."""
    d = _docs(spark, sf)
    p = d.agg(F.count(F.lit(1)).alias("rows"), F.count_if(T.has_text("text")).alias("texts_present"), F.avg(F.length("text")).alias("avg_chars")).select(F.col("rows") * 10, "*").toDF("estimated_rows", "rows", "texts_present", "avg_chars").withColumn("vectors", F.col("rows")).withColumn("max_dims", F.lit(256))
    return rounded(estimates.estimate(p, price=0.02, dims=1536, tokens_per_minute=1_000_000, requests_per_minute=3000))


@query("select d::int as dims, (d * 4 + 8)::bigint as vector, (d * 2 + 8)::bigint as halfvec, (d * 4)::bigint as collection from (select distinct len(embedding) as d from embeddings union select 768 union select 3072)")
def bytes_per_vector(spark, sf):
    d = _vectors(spark, sf).select(V.dims("vector").alias("dims")).distinct().unionByName(spark.createDataFrame([(768,), (3072,)], "dims int")).distinct()
    return d.select("dims", *[V.bytes_per_vector("dims", k).alias(k) for k in ("vector", "halfvec", "collection")])


@query("select event_id, n, greatest(1, case when n <= 1000000 then n // 1000 else floor(sqrt(n)) end)::bigint as lists from (select event_id, event_id * event_id as n from events)")
def ivf_lists(spark, sf):
    """Lists for tables of as many rows as the squares of all events' numbers."""
    return _table(spark, sf, "events").select("event_id", (F.col("event_id") * F.col("event_id")).alias("n")).withColumn("lists", V.ivf_lists("n"))


@query("""with q as (select doc_id, lang as query from documents where doc_id % 10 = 0), c as (select (select sum(length(text)) from documents) + (select sum(length(query)) from q) + (select sum(length(query)) from (select query from q order by doc_id limit 20)) as chars)
select chars::bigint as chars, floor(chars / 4)::bigint as tokens, round(floor(chars / 4) * 0.13 / 1e6, 6) as cost_usd from c""")
def bench_estimate(spark, sf):
    d = _docs(spark, sf)
    return rounded(estimates.bench_estimate(d, d.where(F.col("key") % 10 == 0).select(F.col("key").alias("qid"), F.col("lang").alias("query")), 0.13))


@query("select lang, round(sum(length(text)) // 4 / count(*), 6) as tokens_per_doc, round(sum(length(text)) // 4 / count(*) * 0.02, 6) as cost, 6.144 as gb from documents group by lang")
def cost_per_million(spark, sf):
    d = _docs(spark, sf).groupBy("lang").agg(F.floor(F.sum(F.length("text")) / 4).alias("tokens"), F.count(F.lit(1)).alias("docs")).withColumn("price", F.lit(0.02)).withColumn("dims", F.lit(1536))
    return rounded(d.select("lang", *estimates.per_million()))


# Migration: a quality label stands for the new vector, so the documents without a label are pending.
def _migrating(spark, sf) -> DataFrame:
    lab = _table(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.array(F.col("quality").cast("float")).alias("new_vector"))
    return _docs(spark, sf).select("key", "text").withColumn("vector", F.when(F.col("key") % 11 != 0, F.array(F.lit(1.0).cast("float")))).join(lab, "key", "left")


@query("select doc_id as key from documents d where trim(text) <> '' and doc_id not in (select doc_id from labels) and doc_id % 13 <> 0")
def pending_rows(spark, sf):
    t = _migrating(spark, sf)
    return migrate.pending(t, failed=t.where(F.col("key") % 13 == 0)).select("key")


@query("select doc_id as key from documents d where trim(text) <> '' and doc_id not in (select doc_id from labels) and doc_id > 100 order by doc_id limit 64")
def pending_page(spark, sf):
    return migrate.fetch(_migrating(spark, sf), 100, 64).select("key")


@query("""select count(*) as rows, count(*) filter (where trim(text) <> '') as with_text, count(*) filter (where trim(text) <> '' and quality is null) as missing, count(*) filter (where doc_id % 11 <> 0 and not trim(text) <> '') as orphans,
  count(*) filter (where doc_id % 11 = 0 and trim(text) <> '') as rollback_missing, round(1 - count(*) filter (where trim(text) <> '' and quality is null) / count(*) filter (where trim(text) <> ''), 6) as filled from documents left join labels using (doc_id)""")
def status_counts(spark, sf):
    return rounded(migrate.status_counts(_migrating(spark, sf)))


@query("""with s as (select count(*) filter (where trim(text) <> '') as t, count(*) filter (where trim(text) <> '' and quality is not null) as d from documents left join labels using (doc_id))
select u as until, greatest(0, ceil(t * u) - d)::bigint as quota from s, (values (0.1), (0.5), (1.0)) v(u)""")
def until_quota(spark, sf):
    s = migrate.status_counts(_migrating(spark, sf))
    until = F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(1.0))).alias("until")
    return s.select("with_text", (F.col("with_text") - F.col("missing")).alias("done"), until).select("until", F.greatest(F.lit(0), F.ceil(F.col("with_text") * F.col("until")) - F.col("done")).cast("long").alias("quota"))


@query("""select doc_id as key, case when quality is not null then quality::double when doc_id % 7 <> 0 and doc_id % 3 <> 0 then 9.0 end as first from documents left join labels using (doc_id)""")
def guarded_write(spark, sf):
    """Vectors for every third row fewer than all; those of texts that changed meanwhile (every seventh) are refused, as are those of rows that have one."""
    t = _migrating(spark, sf)
    w = t.where(F.col("key") % 3 != 0).select("key", F.md5(F.when(F.col("key") % 7 == 0, F.lit("before")).otherwise(F.col("text"))).alias("text_hash"), F.array(F.lit(9.0).cast("float")).alias("new_vector"))
    return migrate.guarded_write(t, w).select("key", F.get("new_vector", 0).cast("double").alias("first"))


def _source_copy(spark, sf) -> tuple[DataFrame, DataFrame]:
    src = _docs(spark, sf).select("key", F.when(F.col("key") % 17 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("text"), F.concat(F.lit('{"lang": "'), F.col("lang"), F.lit('"}')).alias("payload"))
    k = F.col("key")
    copy = _docs(spark, sf).where(k % 5 != 0).select("key", F.when(k % 6 == 0, F.lit("old")).otherwise(F.col("text")).alias("text"), F.when(k % 8 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"lang": "'), F.col("lang"), F.lit('"}'))).alias("payload"))
    return src, copy.unionByName(copy.where(k % 50 == 1).withColumn("key", -k))


_ACTIONS = """with s as (select doc_id as key, text, lang from documents where doc_id % 17 <> 0 and regexp_matches(text, '\\S')), c as (select doc_id as key, doc_id as k from documents where doc_id % 5 <> 0 union all select -doc_id, doc_id from documents where doc_id % 5 <> 0 and doc_id % 50 = 1),
a as (select coalesce(s.key, c.key) as key, case when s.key is null then 'delete' when c.key is null or (k % 6 = 0 and s.text <> 'old') then 'embed' when k % 8 = 0 then 'payload' end as action from s full join c on s.key = c.key)
select key, action from a where action is not null"""


@query(_ACTIONS)
def source_copy_diff(spark, sf):
    return migrate.differences(*_source_copy(spark, sf))


@query(_ACTIONS)
def range_digest_diff(spark, sf):
    """The same differences, found by digests of ranges of keys: only ranges that differ are joined."""
    return digests.differences(*_source_copy(spark, sf))


@query(f"select key from ({_ACTIONS}) where action = 'delete'")
def deleted_points(spark, sf):
    return migrate.differences(*_source_copy(spark, sf)).where("action = 'delete'").select("key")


@query("select doc_id as key, case when doc_id % 8 = 0 and (doc_id % 6 = 0 or doc_id % 17 = 0) then '{}' else '{\"lang\": \"' || lang || '\"}' end as payload from documents where doc_id % 5 <> 0 union all select -doc_id, '{\"lang\": \"' || lang || '\"}' from documents where doc_id % 5 <> 0 and doc_id % 50 = 1")
def payload_sync(spark, sf):
    src, copy = _source_copy(spark, sf)
    return migrate.sync_payload(copy, src).select("key", "payload")


def _versions(spark, sf) -> DataFrame:
    e = _table(spark, sf, "events")
    return e.select(F.col("user_id").alias("id"), F.when(F.col("event_id") % 19 != 0, F.col("ts")).alias("updated_at"), (F.col("event_type") == "error").alias("deleted"), "value", "event_id")


@query("""select id, event_id, value from (select user_id as id, event_id, value, event_type, row_number() over (partition by user_id order by case when event_id % 19 <> 0 then ts end desc nulls last, event_id) as r from events) where r = 1 and event_type <> 'error'""")
def lww_upsert_tombstone(spark, sf):
    """The newest state of every user; users whose newest event is an error are deleted."""
    return migrate.newest(_versions(spark, sf), order="event_id").select("id", "event_id", "value")


@query("""select id, event_id, value from (select user_id as id, event_id, value, event_type, row_number() over (partition by user_id order by case when event_id % 19 <> 0 then ts end desc nulls last, event_id) as r from events) where r = 1 and event_type <> 'error'""")
def feed_merge(spark, sf):
    """The same by three batches of changes merged one after the other."""
    v = _versions(spark, sf).select("id", "updated_at", "deleted", "value", "event_id")
    best = lambda x: migrate.newest(x.withColumn("gone", F.lit(False)), deleted="gone", order="event_id").drop("gone")
    n = v.agg(F.max("event_id").alias("m"))
    parts = [v.crossJoin(F.broadcast(n)).where(f"event_id * 3 >= m * {k} and event_id * 3 < m * {k + 1} or {k} = 2 and event_id * 3 >= m * 3").drop("m") for k in range(3)]  # one row
    table = best(parts[0])
    for p in parts[1:]:
        table = feed.merged(table, best(p))
    return feed.live(table).select("id", "event_id", "value")


@query(ORACLES["lww_upsert_tombstone"])
def feed_stateful(spark, sf):
    """The same by a stream of changes in shuffled files, with the newest change of each id in the state store and a table of buckets behind it."""
    v, at = _versions(spark, sf), scratch.fresh(spark, "feed")
    v.repartition(4, F.md5(F.col("event_id").cast("string"))).write.parquet(f"{at}/in")
    table = buckets.BucketTable(spark, f"{at}/table")
    table.create(v.limit(0).drop("deleted"), "id", 16)
    feed.keep_up(spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in"), table, f"{at}/checkpoint").awaitTermination()
    return table.read().select("id", "event_id", "value")


@query("select event_type, sum(json_extract_string(props, '$.k')::bigint)::bigint as total, count(*) filter (where json_extract_string(props, '$.none.deeper') is null) as absent from events group by event_type")
def json_path_payload(spark, sf):
    return _table(spark, sf, "events").groupBy("event_type").agg(F.sum(profile.json_path("props", "k").cast("long")).alias("total"), F.count_if(profile.json_path("props", "none.deeper").isNull()).alias("absent"))


@query("select distinct unnest(json_keys(props)) as key from events")
def json_keys(spark, sf):
    return tables.json_keys(_table(spark, sf, "events"), "props")


@query("select user_id, event_id, round(sum(value) over (partition by user_id order by event_id), 6) as total_usd, sum(1) over (partition by user_id order by event_id)::bigint as total_rows from events")
def running_spend(spark, sf):
    b = _table(spark, sf, "events").select("user_id", "event_id", F.lit(1).alias("rows"), F.col("value").alias("usd"))
    return rounded(migrate.running_spend(b, "event_id", ("user_id",)).select("user_id", "event_id", "total_usd", "total_rows"))


@query("""select doc_id as case_id, case when n and o then 'conflict' when o then 'cut_over' when n and m = 0 and ix then 'ready' when n then 'filling' when c then 'cleaned_up' else 'not_started' end as stage
from (select doc_id, doc_id % 2 = 1 as n, doc_id % 3 = 1 as o, case when quality is not null then toxic end as m, doc_id % 5 > 1 as ix, doc_id % 7 = 2 as c from documents left join labels using (doc_id))""")
def stage_machine(spark, sf):
    """Every document as a migration: which columns it has by its id, what is missing by its label (null: not counted)."""
    s = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id", "left")
    k = F.col("doc_id")
    return s.select(k.alias("case_id"), stages.stage(k % 2 == 1, k % 3 == 1, F.when(F.col("quality").isNotNull(), F.col("toxic")), k % 5 > 1, k % 7 == 2).alias("stage"))


@query("""with c as (select count(*) filter (where trim(text) <> '' and quality is null) as pending, count(*) filter (where not trim(text) <> '') as no_text from documents left join labels using (doc_id))
select unnest(list_filter([case when pending > 0 then 'cutover.pending' end, case when no_text > 0 then 'cutover.no_text' end, 'cutover.size_change', 'cutover.model_switch'], lambda x: x is not null)) as id from c""")
def cutover_readiness(spark, sf):
    c = migrate.status_counts(_migrating(spark, sf))
    facts = c.select(F.lit("ready").alias("stage"), F.col("missing").alias("pending"), (F.col("rows") - F.col("with_text")).alias("no_text"), F.lit(2).alias("old_dims"), F.lit(1).alias("new_dims"))
    return stages.readiness(facts).select("id")


@query("""with c as (select source as name, count(*) filter (where quality is null) as pending, count(*) filter (where lang = 'ar') as unindexed, max(doc_id) % 4 as k from documents left join labels using (doc_id) group by source)
select name, unnest(case when k = 0 then ['cutover.not_applied'] when k = 1 then ['cutover.done'] else list_filter([case when k = 3 then 'cutover.alias_moved' end, case when pending > 0 then 'cutover.pending' end, case when unindexed > 0 then 'cutover.indexing' end, 'cutover.model_switch'], lambda x: x is not null) end) as id from c""")
def alias_readiness(spark, sf):
    """Every source as a collection behind an alias: what stands against moving each."""
    k = F.max("key") % 4
    own = _docs(spark, sf).join(_table(spark, sf, "labels").withColumnRenamed("doc_id", "key"), "key", "left").groupBy(F.col("source").alias("name"))
    facts = own.agg(stages.alias_stage(k == 1, k != 0).alias("stage"), F.count_if(F.col("quality").isNull()).alias("pending"), F.count_if(F.col("lang") == "ar").alias("unindexed"), (k == 3).alias("moved"))
    return stages.readiness(facts, "name", store="alias").select("name", "id")


# Rows by key, page or chance; formats.
@query("select doc_id as key, text, lang from documents where doc_id in (select distinct doc_id from labels where doc_id % 7 = 0)")
def retrieved_points(spark, sf):
    docs = _docs(spark, sf).select("key", "text", "lang", F.array(F.lit(1.0)).alias("vector"))
    return lookup.retrieve(docs, _table(spark, sf, "labels").where("doc_id % 7 = 0").select(F.col("doc_id").alias("key")))


@query("select doc_id as key, md5(text) as text from documents where trim(text, E' \\t\\n\\r\\f\\v') <> '' and doc_id in (select doc_id from labels where doc_id % 9 = 1)")
def looked_up_texts(spark, sf):
    return lookup.texts(_docs(spark, sf), _table(spark, sf, "labels").where("doc_id % 9 = 1").select(F.col("doc_id").alias("key"))).select("key", F.md5("text").alias("text"))


@query("""with p as (select doc_id as key, case when doc_id % 3 <> 0 then text end as text, row_number() over (order by doc_id) as r from documents where doc_id >= 40)
select key, (select key from p where r = 31) as next from p where r <= 30 and text is not null and trim(text, E' \\t\\n\\r\\f\\v') <> ''""")
def scrolled_page(spark, sf):
    """A page of thirty from a key on; rows without text are left out, the cursor goes past them."""
    docs = _docs(spark, sf).select("key", F.when(F.col("key") % 3 != 0, F.col("text")).alias("text"))
    return lookup.scroll(docs, 40, 30).select("key", "next")


@query("select doc_id as key, lang from documents order by md5(doc_id || '|s1'), doc_id limit 25")
def random_sample(spark, sf):
    return lookup.random_sample(_docs(spark, sf), 25, "s1").select("key", "lang")


_SWITCHES = "select event_type as store, 'a' || user_id % 5 as alias, 'n' || user_id % 3 as new, case event_id % 4 when 0 then 'apply' when 1 then 'cutover' when 2 then 'rollback' end as event, case when event_id % 9 > 0 then event_id // 50 end as at from events"


def _switches(spark, sf) -> DataFrame:
    """The events of the feed as a history of switches: several at one time, some without one."""
    kind, k, user = F.col("event_id") % 4, F.col("event_id"), F.col("user_id")
    event = F.when(kind == 0, "apply").when(kind == 1, "cutover").when(kind == 2, "rollback")
    return _table(spark, sf, "events").select(
        F.col("event_type").alias("store"), F.concat(F.lit("a"), user % 5).alias("alias"), F.concat(F.lit("n"), user % 3).alias("new"), event.alias("event"), F.when(k % 9 > 0, F.floor(k / 50)).alias("at")
    )


@query(f'select event, "at" from ({_SWITCHES}) where store = \'click\' and alias = \'a1\' and new = \'n1\'')
def switch_history(spark, sf):
    return lookup.history(_switches(spark, sf), "click", "a1", "n1").select("event", "at")


@query(f"""select store, alias, case r when 0 then null when 1 then 'apply' when 2 then 'cutover' else 'rollback' end as event, "at" from (select store, alias, "at", max(case event when 'apply' then 1 when 'cutover' then 2 when 'rollback' then 3 else 0 end) as r
from ({_SWITCHES}) s where "at" = (select max("at") from ({_SWITCHES}) o where o.store = s.store and o.alias = s.alias) group by all)""")
def latest_events(spark, sf):
    return lookup.latest(_switches(spark, sf), "store", "alias")


@query("""select page_id as index, unnest(p) as "column", generate_subscripts(p, 1)::int as ordinal from (select page_id, string_split(url, '/') as p from pages)""")
def key_ordinality(spark, sf):
    """The parts of every page's address with their places."""
    return lookup.key_columns(_table(spark, sf, "pages").select(F.col("page_id").alias("index"), F.split("url", "/").alias("columns")))


@query("select event_id, round(coalesce(case when event_id % 3 <> 0 then value end, 0) + case when event_id % 4 <> 0 then 2 * value end, 6) as p95 from events")
def end_to_end_p95(spark, sf):
    e = _table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("e"), F.when(F.col("event_id") % 4 != 0, 2 * F.col("value")).alias("s"))
    return e.select("event_id", r6(lookup.end_to_end("e", "s")).alias("p95"))


@query("""select event_id, case when whole = 0 then '0%' when part > 0 and 100.0 * part / whole < 1 then '<1%' else round_even(100.0 * part / whole, 0)::int || '%' end as share
from (select event_id, event_id % 97 as part, event_id % 1000 as whole from events)""")
def share_formats(spark, sf):
    return _table(spark, sf, "events").select("event_id", (F.col("event_id") % 97).alias("part"), (F.col("event_id") % 1000).alias("whole")).select("event_id", T.share("part", "whole").alias("share"))


@query("select doc_id as key, md5('query: ' || text) as as_query, md5('passage: ' || text) as as_document from documents where lang = 'en'")
def prefix_modes(spark, sf):
    own = _docs(spark, sf).where("lang = 'en'")
    return own.select("key", *[F.md5(T.prefixed("text", mode, "query: ", "passage: ")).alias(f"as_{mode}") for mode in ("query", "document")])


@query("""select key, coalesce(len(v) > 0 and list_aggregate(list_transform(v, lambda x: coalesce(isfinite(x), false)), 'bool_and'), false) as valid
from (select vec_id as key, case vec_id % 5 when 0 then embedding::double[] when 1 then [] when 3 then list_append(embedding::double[], null) when 4 then list_append(embedding::double[], 'nan'::double) end as v from embeddings)""")
def vector_validity(spark, sf):
    """Every fifth vector as it is; others empty, null, with a null or with a NaN in them."""
    v, k = F.col("vector").cast("array<double>"), F.col("key") % 5
    odd = F.when(k == 0, v).when(k == 1, F.array().cast("array<double>")).when(k == 3, F.concat(v, F.array(F.lit(None).cast("double")))).when(k == 4, F.concat(v, F.array(F.lit(float("nan")))))
    return _vectors(spark, sf).select("key", odd.alias("v")).select("key", V.is_valid("v").alias("valid"))


@query("""select doc_id as key, case when quality = 1 then 'cut_over' when quality is not null then 'applied' else 'not_applied' end as stage from documents left join labels using (doc_id)""")
def alias_stages(spark, sf):
    """Every document as a collection: the new one exists where it has a label, the alias points at it where that is 1."""
    rows = _table(spark, sf, "documents").join(_table(spark, sf, "labels"), "doc_id", "left")
    return rows.select(F.col("doc_id").alias("key"), stages.alias_stage(F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("quality").isNotNull()).alias("stage"))


@query("select vec_id as key, left(repeat('c' || vec_id, 20), 59) || '_old' as old, left(repeat('c' || vec_id, 20), 52) || '_hnsw_index' as index from embeddings where vec_id between 100 and 199")
def derived_names(spark, sf):
    own = _vectors(spark, sf).where("key between 100 and 199").select("key", F.repeat(F.concat(F.lit("c"), F.col("key").cast("string")), 20).alias("base"))
    return own.select("key", lookup.derived_name("base", "old").alias("old"), lookup.derived_name("base", "hnsw_index").alias("index"))


@query("select page_id as key, strftime(timestamp '2024-02-28 23:59:58' + to_seconds(page_id * 7), '%Y-%m-%dT%H:%M:%SZ') as \"at\" from pages")
def utc_times(spark, sf):
    start = F.to_timestamp(F.lit("2024-02-28T23:59:58Z"))
    own = _table(spark, sf, "pages").select(F.col("page_id").alias("key"), F.timestamp_add("SECOND", (F.col("page_id") * 7).cast("int"), start).alias("t"))
    return own.select("key", lookup.utc("t").alias("at"))
