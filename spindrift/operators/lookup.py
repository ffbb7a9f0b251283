"""Rows by key, page or chance, and the events of a store's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T


def texts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """key, text of the rows among ``keys`` (key) that have text."""
    return rows.where(T.has_text("text")).join(keys.select("key").distinct(), "key", "left_semi").select("key", "text")


def retrieve(rows: DataFrame, keys: DataFrame, vectors: bool = False) -> DataFrame:
    """The rows among ``keys`` (key), their vectors on demand."""
    found = rows.join(keys.select("key").distinct(), "key", "left_semi")
    return found if vectors else found.drop("vector")


def scroll(rows: DataFrame, start, limit: int) -> DataFrame:
    """key, text, next of the page of ``limit`` rows that begins with key ``start`` itself; ``next``: where the following page begins.

    Rows without text are left out of the page, but the page counts them, so it may be short or empty and not be the last."""
    own = (rows if start is None else rows.where(F.col("key") >= F.lit(start))).select("key", "text").orderBy("key").limit(limit + 1)
    page = own.agg(F.array_sort(F.collect_list(F.struct("key", "text"))).alias("p"))  # a page
    page = page.select(F.slice("p", 1, limit).alias("p"), F.get("p", F.lit(limit))["key"].alias("next"))
    return page.select(F.explode("p").alias("r"), "next").select("r.key", "r.text", "next").where(T.has_text("text"))


def random_sample(rows: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """``n`` rows, the same ones for a seed; another seed draws others."""
    return rows.orderBy(F.md5(F.concat(F.col("key").cast("string"), F.lit("|"), F.lit(seed))), "key").limit(n)


def history(events: DataFrame, store: str, alias: str, new: str) -> DataFrame:
    """The events (store, alias, new, event, at) of one switch."""
    return events.where((F.col("store") == store) & (F.col("alias") == alias) & (F.col("new") == new))


def latest(events: DataFrame, *by: str) -> DataFrame:
    """The last event of each group; of several at one time the one that comes last by name. One aggregate, with partial maxima."""
    return events.where("at is not null").groupBy(*by).agg(F.max(F.struct("at", "event")).alias("e")).select(*by, "e.event", "e.at")


def key_columns(indexes: DataFrame) -> DataFrame:
    """index, column, ordinal (from 1) of indexes (index, columns array)."""
    return indexes.select("index", F.posexplode("columns").alias("i", "column")).select("index", "column", (F.col("i") + 1).alias("ordinal"))


def end_to_end(embed_p95: str, search_p95: str) -> Column:
    """Embedding counts as nothing where it was not measured; without a search time there is none."""
    return F.coalesce(F.col(embed_p95), F.lit(0.0)) + F.col(search_p95)


#: Fixed value: longest name of a column, table or index in the row stores that names are made for.
LONGEST_NAME = 63


def derived_name(base: str, suffix: str) -> Column:
    """base_suffix, the base cut so that the whole fits."""
    return F.concat(F.substring(F.col(base), 1, LONGEST_NAME - 1 - len(suffix)), F.lit(f"_{suffix}"))


def utc(at: str) -> Column:
    """ISO 8601 in UTC, to seconds."""
    return F.date_format(F.to_utc_timestamp(F.col(at), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
