"""Documents and labelled queries as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as T


class CorpusError(ValueError):
    """A file without usable documents or queries."""


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line (its number in the file, from 1), value. One file is read as one task, which keeps the order; the corpora of benchmarks are small."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).select((F.col("line") + 1).alias("line"), "value").where(T.not_blank("value"))


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """key, text, clipped for benchmarks. The id defaults to the line's number; blank texts are left out.

    A line without a text, an id that occurs twice, and a file without documents are errors."""
    raw = _lines(spark, path).select("line", F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.text").alias("text"), F.try_parse_json("value").isNull().alias("broken"))
    own = raw.select(F.coalesce("id", F.col("line").cast("string")).alias("key"), "text", "line", "broken")
    bad = own.where("broken or text is null").agg(F.min("line").alias("line")).first()["line"]
    if bad is not None:
        raise CorpusError(f"{path}, line {bad}: not an object with a text")
    docs = own.where(T.not_blank("text")).select("key", T.clip("text").alias("text"))
    twice = docs.groupBy("key").count().where("count > 1").limit(1).collect()
    if twice:
        raise CorpusError(f"{path}: id {twice[0]['key']!r} occurs more than once")
    if not docs.limit(1).count():
        raise CorpusError(f"{path} has no documents")
    return docs


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, query (stripped), relevant array<string>, from one id or a list of ids."""
    raw = _lines(spark, path)
    many = F.from_json(F.get_json_object("value", "$.relevant"), "array<string>")
    out = raw.select(F.col("line").alias("qid"), F.regexp_replace(F.get_json_object("value", "$.query"), r"^\s+|\s+$", "").alias("query"), F.array_distinct(F.coalesce(many, F.array(F.get_json_object("value", "$.relevant")))).alias("relevant"))
    if out.where("query is null or query = '' or exists(relevant, x -> x is null)").limit(1).count():
        raise CorpusError(f"{path}: every line needs query and relevant")
    return out


def save_queries(queries: DataFrame, path: str) -> None:
    """One line a query, with its relevant ids in order."""
    queries.select("query", F.array_sort("relevant").alias("relevant")).write.mode("overwrite").json(path)
