"""What differs between two tables, found by digests of ranges.

A row's place is the hash of its key, and the places are cut into ranges. A range's digest doesn't depend on the order of its
rows: their number, sums of both halves of their hashes, and the exclusive or of them. Sixteen ranges make
one of the level above, up to one for the whole table. Two trees are compared from the top: only children of ranges
that differ are looked at, and only the rows of the lowest ranges that differ are joined. A tree is a
small table that can be kept beside a version, so an unchanged table is known as such without being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators import migrate
from spindrift.functions import text as T
from spindrift.sources import scratch

#: Levels below the top; each has sixteen times as many ranges as the one above.
LEVELS = 3
_SUMS = ("n", "low", "high", "parity")


def place(key: str, levels: int = LEVELS) -> Column:
    """The lowest range of a row."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string")), 64 - 4 * levels).cast("long")


def _summed(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.bit_xor("parity").alias("parity"))


def tree(df: DataFrame, key: str, values: list[Column], levels: int = LEVELS) -> DataFrame:
    """level, range, n, low, high, parity: digests of all ranges that have rows, from the whole table (level 0) down."""
    h = F.xxhash64(F.col(key).cast("string"), *[F.concat(F.when(v.isNull(), "-").otherwise("+"), F.coalesce(v.cast("string"), F.lit(""))) for v in values])
    rows = df.select(place(key, levels).alias("range"), h.alias("h")).select("range", F.lit(1).cast("long").alias("n"), F.expr("h & 4294967295").alias("low"), F.shiftrightunsigned("h", 32).alias("high"), F.col("h").alias("parity"))
    now = scratch.kept(_summed(rows, "range").withColumn("level", F.lit(levels)), "digests")  # 16 ** levels rows at most
    out = now
    for level in range(levels - 1, -1, -1):
        now = _summed(now.withColumn("range", F.shiftrightunsigned("range", 4)), "range").withColumn("level", F.lit(level))
        out = out.unionByName(now)
    return scratch.kept(out.select("level", "range", *_SUMS), "digests")


def differing(a: DataFrame, b: DataFrame, levels: int = LEVELS) -> DataFrame:
    """range: the lowest ranges in which two trees differ."""
    found = None
    for level in range(levels + 1):
        x, y = (t.where(F.col("level") == level).drop("level") for t in (a, b))
        if found is not None:
            above = found.select(F.col("range").alias("_up"))
            x, y = (t.join(above, F.shiftrightunsigned("range", 4) == F.col("_up"), "left_semi") for t in (x, y))
        y = y.select(F.col("range"), *[F.col(c).alias(f"_{c}") for c in _SUMS])
        same = F.lit(True)
        for c in _SUMS:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        found = x.join(y, "range", "full").where(~same).select("range")
    return scratch.kept(found, "differing")


def narrowed(df: DataFrame, key: str, ranges: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The rows in these ranges, of which there are 16 ** levels at most."""
    own = F.broadcast(ranges.select(F.col("range").alias("_range")))
    return df.join(own, place(key, levels) == F.col("_range"), "left_semi")


def differences(source: DataFrame, copy: DataFrame, payload: bool = True, levels: int = LEVELS) -> DataFrame:
    """What migrate.differences() says of a copy (key, text, payload) and its source, without a join of what is the same."""
    source = source.where(T.not_blank("text"))
    values = [F.col("text"), *([migrate.plain_payload("payload")] if payload else [])]
    ranges = differing(tree(source, "key", values, levels), tree(copy, "key", values, levels), levels)
    return migrate.differences(narrowed(source, "key", ranges, levels), narrowed(copy, "key", ranges, levels), payload)


def changed_rows(now: DataFrame, then: DataFrame, levels: int = LEVELS) -> int:
    """Rows (key, text) whose text is another now, that came since, or that are gone."""
    ranges = differing(tree(now, "key", [F.col("text")], levels), tree(then, "key", [F.col("text")], levels), levels)
    a = narrowed(now, "key", ranges, levels).select("key", F.md5("text").alias("_now"), F.lit(True).alias("_n"))
    b = narrowed(then, "key", ranges, levels).select("key", F.md5("text").alias("_then"), F.lit(True).alias("_t"))
    return a.join(b, "key", "full").where(F.col("_n").isNull() | F.col("_t").isNull() | ~F.col("_now").eqNullSafe(F.col("_then"))).count()
