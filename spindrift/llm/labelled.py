"""Bounded samples of labelled documents to train on."""

from __future__ import annotations

import zlib
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A class gives at most so many training documents, those whose ids have the smallest hashes.
SAMPLE = 1500
#: Of a longer text eight slices of an eighth of this are trained on, spread evenly over the whole. It bounds what the driver gathers.
LONGEST = 20_000


def remainder(doc_id: str, folds: int):
    """crc32 of doc_id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def _slices(text: str, longest: int, parts: int = 8):
    n, size = F.length(text), longest // parts
    cut = [F.substring(F.col(text), (F.lit(1) + F.floor((n - size) * k / (parts - 1))).cast("int"), F.lit(size)) for k in range(parts)]
    return F.when(n <= longest, F.col(text)).otherwise(F.concat_ws("\n", *cut))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int = SAMPLE, longest: int = LONGEST) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most`` documents of each class that are not held out, each of at most about ``longest`` characters.

    Rows without an id, a text or a label of 0 or 1 are left out, of rows with one id one is taken. Twice
    as many ids as needed are drawn, as some have no text."""
    known = labels.where(F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.max(label).alias("label"))

    def of(value: int):
        ids = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)  # a bounded number of ids: small enough to broadcast
        rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
        rows = rows.select("doc_id", _slices("text", longest).alias("text")).groupBy("doc_id").agg(F.min("text").alias("text"))
        return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()

    with ThreadPoolExecutor(2) as pool:
        zero, one = pool.map(of, (0, 1))
    both = sorted([(zlib.crc32(b"%d" % r.doc_id), r.text, v) for rows, v in ((zero, 0), (one, 1)) for r in rows])
    return [t for _, t, _ in both], [v for _, _, v in both]
