"""Vectors by what they were made from: a table that grows with every distinct text a model was asked.

A vector's key is the digest of model, mode and text, so entries never change. The table is one of hash
buckets: a lookup reads the buckets that the asked keys fall in, an addition writes new rows only. Of texts
that stand in many rows the model sees one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import identity
from spindrift.sources import buckets, scratch

#: Attempts of an addition when other writers are faster; folders of changes from which a bucket is written anew.
ATTEMPTS, FOLDERS = 8, 8


@dataclass
class Split:
    """Rows asked about, by what the cache knows. ``misses``: key (the cache's) and text of each distinct text that the model has to see."""

    cache: EmbeddingCache
    keyed: DataFrame
    known: DataFrame
    misses: DataFrame

    def answered(self, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """key, vector, error, tokens of all rows; new vectors are in the cache by then. Of several rows with a text, the one of the smallest key has its tokens."""
        got = scratch.kept(embed(self.misses.select("key", "text")), "answers")
        self.cache.put(got.where("error is null and vector is not null").select(F.col("key").alias("cache_key"), "vector"))
        tokens = F.col("tokens") if "tokens" in got.columns else F.lit(None).cast("long")
        new = got.join(self.misses.select("key", "first"), "key").select(F.col("key").alias("cache_key"), F.col("vector").cast("array<float>").alias("vector"), "error", tokens.alias("tokens"), "first")
        old = self.known.select("cache_key", "vector", F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast(self.keyed.schema["key"].dataType).alias("first"))
        return self.keyed.join(old.unionByName(new), "cache_key").select("key", "vector", "error", F.when(F.col("first").isNull() | (F.col("key") == F.col("first")), F.col("tokens")).otherwise(0).alias("tokens"))

    def drop(self) -> None:
        scratch.drop(self.keyed, self.misses)


class EmbeddingCache:
    """The cache in a folder that several jobs and models may share. ``space``: all that determines a vector but its text."""

    def __init__(self, spark: SparkSession, path: str, space: str, mode: str = "document", buckets_: int = 64):
        self.spark, self.space, self.mode, self.buckets = spark, space, mode, buckets_
        self.table = buckets.BucketTable(spark, path)

    def split(self, docs: DataFrame) -> Split:
        """docs: key, text; rows without text are left out. Equal keys have equal texts."""
        keyed = scratch.kept(docs.where("text is not null").select("key", "text", identity.cache_key(self.space, self.mode, "text").alias("cache_key")), "asked")
        none = self.spark.createDataFrame([], "cache_key string, vector array<float>")
        known = self.table.lookup(keyed.select("cache_key")) if self.table.versions() else none
        # partial aggregates: a text in a third of all rows is one row of each task
        misses = keyed.groupBy("cache_key").agg(F.first("text").alias("text"), F.min("key").alias("first")).join(known.select("cache_key"), "cache_key", "left_anti")
        return Split(self, keyed, known, scratch.kept(misses.withColumnRenamed("cache_key", "key"), "misses"))

    def put(self, rows: DataFrame) -> int:
        """Adds vectors (cache_key, vector), each key once; says which version has them."""
        rows = rows.select("cache_key", F.col("vector").cast("array<float>").alias("vector"))
        if rows.isEmpty():
            return max(self.table.versions(), default=0)
        for attempt in range(ATTEMPTS):
            try:
                version = self.table.merge(rows) if self.table.versions() else self.table.create(rows, "cache_key", self.buckets)
                return max(version, self.table.compact(FOLDERS))
            except buckets.Conflict:  # another writer was first: its rows are of other texts or equal ones
                if attempt + 1 == ATTEMPTS:
                    raise
        raise AssertionError

    def size(self) -> int:
        return self.table.read().count() if self.table.versions() else 0
