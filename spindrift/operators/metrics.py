"""Retrieval scores from ranked hits, in two-level aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import ranks


def per_query_by_group(hits: DataFrame, queries: DataFrame, groups: DataFrame, k: int = 10) -> DataFrame:
    """per_query() where all others of a query's group are relevant, without a row for each such pair.

    hits: qid, key, rank. queries: qid, group. groups: key, group. A group without others gives no row."""
    size = groups.groupBy("group").agg(F.count("key").alias("size"))
    relevant = queries.join(size, "group").select("qid", (F.col("size") - 1).alias("n")).where("n > 0")
    own = hits.where((F.col("rank") <= k) & (F.col("qid") != F.col("key"))).join(queries, "qid")
    return _scored(relevant, own.join(groups, ["key", "group"], "left_semi"), k)


def per_query(hits: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """qid, n_relevant, recall_at_1, recall_at_k, mrr_at_k, ndcg_at_k for every query of ``qrels``.

    hits: qid, key, rank. qrels: qid, key, each relevant pair once. Recall divides by the number of
    relevant rows, so recall at 1 can be below 1 for a perfect hit."""
    relevant = qrels.groupBy("qid").agg(F.count("key").alias("n"))
    good = hits.where(F.col("rank") <= k).join(qrels.select("qid", "key"), ["qid", "key"], "left_semi")
    return _scored(relevant, good, k)


def _scored(relevant: DataFrame, good: DataFrame, k: int) -> DataFrame:
    """relevant: qid, n. good: hits that are relevant."""
    found = good.groupBy("qid").agg(
        F.count_if(F.col("rank") == 1).alias("one"), F.count("rank").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("gain")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1.0))
    of = lambda c: F.coalesce(c, F.lit(0.0))
    return relevant.join(found, "qid", "left").select(
        "qid", F.col("n").alias("n_relevant"), of(F.col("one") / F.col("n")).alias("recall_at_1"), of(F.col("found") / F.col("n")).alias("recall_at_k"), of(1 / F.col("first")).alias("mrr_at_k"), of(F.col("gain") / ideal).alias("ndcg_at_k")
    )


def scores(each: DataFrame) -> DataFrame:
    """One row: queries and the mean of every score."""
    return each.agg(F.count("qid").alias("queries"), *[F.avg(c).alias(c) for c in ("recall_at_1", "recall_at_k", "mrr_at_k", "ndcg_at_k")])


def scores_by_slice(each: DataFrame, slices: DataFrame) -> DataFrame:
    """slice, queries, scores for all queries ('all') and for each slice, by GROUPING SETS. slices: qid, slice."""
    joined = each.join(slices.select("qid", "slice"), "qid")
    grouped = joined.groupingSets([[], ["slice"]], "slice").agg(F.grouping("slice").alias("g"), F.count("qid").alias("queries"), *[F.avg(c).alias(c) for c in ("recall_at_1", "recall_at_k", "mrr_at_k", "ndcg_at_k")])
    return grouped.where("g = 1 or slice is not null").withColumn("slice", F.when(F.col("g") == 1, "all").otherwise(F.col("slice"))).drop("g")


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries, overlap, the mean share of common keys among the k best. Two empty lists overlap wholly; no query, no overlap."""
    top = lambda x, n: x.where(F.col("rank") <= k).groupBy("qid").agg(F.collect_set("key").alias(n))  # noqa: E731  k keys at most
    none = F.array().cast(f"array<{a.schema['key'].dataType.simpleString()}>")
    both = top(a, "x").join(top(b, "y"), "qid", "full").select(F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
    size = F.least(F.lit(k), F.greatest(F.size("x"), F.size("y")))
    each = F.when(size == 0, 1.0).otherwise(F.size(F.array_intersect("x", "y")) / size)
    return both.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.avg(each), F.lit(0.0)).alias("overlap"))


def index_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, index_recall. A hit as near as the exact list's last counts, whichever row it is: ties don't matter.

    An empty exact list counts as found."""
    truth = exact.groupBy("qid").agg(F.count("key").alias("n"), F.max("distance").alias("edge"))
    near = found.join(truth, "qid").where(F.col("distance") <= F.col("edge") + 1e-6 * F.greatest(F.lit(1.0), F.abs("edge")))
    each = truth.join(near.groupBy("qid").agg(F.count("key").alias("m")), "qid", "left")
    return each.agg(F.count("qid").alias("queries"), F.avg(F.least(F.coalesce("m", F.lit(0)), "n") / F.col("n")).alias("index_recall"))


def same_group(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """qid, same: the share of a row's neighbours in its own group, of rows with a group and a neighbour. groups: key, group."""
    own = groups.select(F.col("key").alias("qid"), F.col("group").alias("own")).where("own is not null")
    return hits.join(own, "qid").join(groups.select("key", "group"), "key", "left").groupBy("qid", "own").agg(F.avg((F.coalesce(F.col("group") == F.col("own"), F.lit(False))).cast("double")).alias("same")).select("qid", F.col("own").alias("group"), "same")


def latencies(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, p50, p95, p99 by nearest rank, for each group: the smallest value that such a share of all values don't exceed."""
    return ranks.at_ranks(rows, value, list(by), {f"p{p}": ranks.nearest(p / 100) for p in (50, 95, 99)})


def bench_latencies(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, p50, p95 as benchmarks report them: the median between two values, and the value at the index 0.95 (n - 1), rounded half to even."""
    at = F.bround(0.95 * (F.col("n") - 1), 0) + 1
    found = ranks.at_ranks(rows, value, list(by), {"_low": ranks.lower_middle(), "_high": ranks.upper_middle(), "p95": at})
    return found.select(*by, "n", ((F.col("_low") + F.col("_high")) / 2).alias("p50"), "p95")


def leaderboard(models: DataFrame) -> DataFrame:
    """models (name, ordinal, recall_at_k, ..., null where a model failed) with their place: best recall first, failed ones last, ties as they came."""
    from pyspark.sql import Window

    order = Window.orderBy(F.col("recall_at_k").isNull(), F.desc("recall_at_k"), "ordinal")
    return models.withColumn("place", F.row_number().over(order))


def picks(models: DataFrame, close: float = 0.02) -> DataFrame:
    """One row: best (highest recall), value (cheapest within ``close`` of it, then smallest; unpriced ones only if none has a price), fastest.

    models: name, ordinal, recall_at_k, cost, gb, ms."""
    ok = models.where("recall_at_k is not null")
    top = ok.agg(F.max("recall_at_k").alias("top"))
    near = ok.crossJoin(F.broadcast(top)).where(F.col("recall_at_k") >= F.col("top") - close)  # one row
    best = ok.agg(F.min_by("name", F.struct(-F.col("recall_at_k"), "ordinal")).alias("best"), F.min_by("name", F.when(F.col("ms").isNotNull(), F.struct("ms", "ordinal"))).alias("fastest"))
    value = near.agg(F.min_by("name", F.struct(F.col("cost").isNull(), F.coalesce("cost", F.lit(0.0)), F.coalesce("gb", F.lit(float("inf"))), "ordinal")).alias("value"))
    return best.crossJoin(value).select("best", "value", "fastest")
