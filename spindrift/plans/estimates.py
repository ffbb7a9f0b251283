"""What embedding a table anew costs: rows, tokens, requests, money, time, bytes, as columns of one row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHARS_PER_TOKEN, INDEX_BYTES = 4, 200


def _opt(x, kind: str = "double") -> Column:
    return F.lit(x).cast(kind)


def estimate(
    p: DataFrame, price: float | None = None, batch: int = 64, dims: int | None = None, old_dims: int | None = None, kind: str = "vector", tokens_per_minute: float | None = None,
    requests_per_minute: float | None = None, tokens_per_char: float | None = None, docs_per_second: float | None = None, hnsw: bool = True,
) -> DataFrame:
    """One row from one row (estimated_rows, rows, vectors, texts_present, avg_chars, max_dims): sample and table sizes.

    The time is the longest that a limit or the measured speed asks for, with its name."""
    per = {"vector": (4, 8), "halfvec": (2, 8), "collection": (4, 0)}[kind]
    own = p.select("estimated_rows", "rows", F.bround(F.col("estimated_rows") * F.coalesce(F.try_divide(F.col("texts_present"), F.col("rows")), F.lit(0.0)), 0).cast("long").alias("est_rows"), "avg_chars", "vectors", "max_dims")
    own = own.withColumn("tokens", F.bround(F.col("est_rows") * F.col("avg_chars") * (tokens_per_char or 1 / CHARS_PER_TOKEN), 0).cast("long"))
    own = own.withColumn("requests", F.ceil(F.col("est_rows") / batch).cast("long")).withColumn("cost_usd", F.col("tokens") * _opt(price) / 1e6)
    limits = [(60 * F.col("tokens") / _opt(tokens_per_minute), "tokens per minute"), (60 * F.col("requests") / _opt(requests_per_minute), "requests per minute"), (F.col("est_rows") / _opt(docs_per_second), "measured speed")]
    longest = F.array_max(F.array_compact(F.array(*[F.when(t.isNotNull(), F.struct(t.alias("s"), F.lit(m).alias("by"))) for t, m in limits])))
    size = None if dims is None else dims * per[0] + per[1]
    before = F.coalesce(_opt(old_dims, "int"), F.col("max_dims"))
    return own.withColumn("_t", longest).select(
        "est_rows", "tokens", "requests", "cost_usd", F.col("_t.s").alias("seconds"), F.col("_t.by").alias("seconds_by"),
        (F.col("est_rows") * _opt(size, "long")).alias("new_bytes"), (F.col("est_rows") * (_opt(size, "long") + (INDEX_BYTES if hnsw else 0))).alias("index_bytes"),
        F.bround(F.col("estimated_rows") * F.coalesce(F.try_divide(F.col("vectors"), F.col("rows")), F.lit(0.0)) * (before * per[0] + per[1]), 0).cast("long").alias("old_bytes"),
    )


def memory_setting(need: int) -> str:
    """A round amount of memory, a quarter more than needed."""
    mb = math.ceil(need * 1.25 / 2**20 / 64) * 64
    return f"{mb}MB" if mb < 1024 else f"{math.ceil(mb / 1024)}GB"


def over_budget(spent: float, chars: int, price: float | None, budget: float | None) -> bool:
    """Whether the next batch would pass the budget."""
    return budget is not None and price is not None and spent + chars / CHARS_PER_TOKEN * price / 1e6 > budget


def bench_estimate(docs: DataFrame, queries: DataFrame, price: float, timed: int = 20) -> DataFrame:
    """One row: chars, tokens, cost of a benchmark run: documents, queries, and the first queries once more to time them. queries: qid, query."""
    again = queries.orderBy("qid").limit(timed).agg(F.coalesce(F.sum(F.length("query")), F.lit(0)).alias("n"))
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).unionByName(queries.agg(F.coalesce(F.sum(F.length("query")), F.lit(0)).alias("n"))).unionByName(again).agg(F.sum("n").alias("chars"))
    return chars.select("chars", F.floor(F.col("chars") / CHARS_PER_TOKEN).alias("tokens")).withColumn("cost_usd", F.col("tokens") * F.lit(float(price)) / 1e6)


def per_million(tokens: str = "tokens", docs: str = "docs", price: str = "price", dims: str = "dims") -> list[Column]:
    """tokens_per_doc, cost (of a million documents), gb (of a million vectors)."""
    each = F.try_divide(F.col(tokens), F.col(docs))
    return [each.alias("tokens_per_doc"), (each * F.col(price)).alias("cost"), (F.col(dims) * 4 / 1000).alias("gb")]
