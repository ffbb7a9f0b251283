"""Exact order statistics without sorting or gathering a group.

The value of a rank is found by repeated counting: the range it lies in is cut into ``BINS`` bins, each
task counts its values by bin, and the rank falls into one bin, whose smallest and largest value are the next range.
It ends where both are equal, or where the range has ``FEW`` values at most, which are then brought together. So a group
of any size, one that has a third of all rows too, moves a few counts from each task. Nulls are left out; NaN is the largest value, after infinity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.sources import scratch

BINS, FEW = 2048, 4096
#: So many ranges are sent to every task; more are joined by group.
BROADCAST_RANGES = 50_000


def _same(keys: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def at_ranks(rows: DataFrame, value: str, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """``by``, n (values of the group), and for each of ``ranks`` the value at that place from 1. Ranks are columns of ``n``.

    A group without values has no row; without ``by`` there is one row, of nulls where there is no value."""
    keys = [f"_g{i}" for i in range(len(by))]
    v = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("_v")).where("_v is not null")
    inf = F.lit(float("inf"))
    finite = (F.abs("_v") < inf) & ~F.isnan("_v")
    some = F.when(finite, F.col("_v"))
    stats = v.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("_v") == -inf).alias("_below"), F.count(some).alias("_m"), F.count_if(F.col("_v") == inf).alias("_above"), F.min(some).alias("lo"), F.max(some).alias("hi"))
    named = stats.select(*keys, "n", "_below", "_m", "_above", "lo", "hi", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("k")) for name, r in ranks.items()])).alias("t")).select("*", "t.*")
    nan = F.lit(float("nan"))
    special = F.when(F.col("n") == 0, F.lit(None).cast("double")).when(F.col("k") <= F.col("_below"), -inf).when(F.col("k") > F.col("_below") + F.col("_m") + F.col("_above"), nan).when(F.col("k") > F.col("_below") + F.col("_m"), inf)
    now = scratch.kept(named.select(*keys, "n", "name", (F.col("k") - F.col("_below")).alias("k"), F.col("_m").alias("size"), F.coalesce(special, "lo").alias("lo"), F.coalesce(special, "hi").alias("hi")), "ranks")
    open_ = ~F.col("lo").eqNullSafe(F.col("hi"))  # NaN equals itself here

    def inside(some: DataFrame, n: int) -> DataFrame:
        """The values of the ranges of ``some``."""
        r = some.select(*keys, "lo", "hi").distinct()
        r = F.broadcast(r) if n <= BROADCAST_RANGES else r
        return v.alias("v").join(r.alias("r"), _same(keys, "v", "r") & (F.col("_v") >= F.col("r.lo")) & (F.col("_v") <= F.col("r.hi"))).select(*[F.col(f"v.{k}").alias(k) for k in keys], "lo", "hi", "_v")

    def follow(some: DataFrame, with_: DataFrame, more: Column, lo: Column, hi: Column, k: Column, size: Column) -> DataFrame:
        both = some.alias("t").join(with_.alias("b"), _same(keys, "t", "b") & (F.col("t.lo") == F.col("b.lo")) & (F.col("t.hi") == F.col("b.hi")) & more)
        return both.select(*[F.col(f"t.{k}").alias(k) for k in keys], "n", "name", k.alias("k"), size.alias("size"), lo.alias("lo"), hi.alias("hi"))

    while True:
        left = now.agg(F.count_if(open_ & (F.col("size") <= FEW)).alias("few"), F.count_if(open_ & (F.col("size") > FEW)).alias("many")).first()
        if not left["few"] and not left["many"]:
            break
        after = now.where(~open_)
        if left["few"]:
            some = now.where(open_ & (F.col("size") <= FEW))
            own = inside(some, left["few"]).groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list("_v")).alias("own"))  # FEW values at most
            value = F.get("own", (F.col("k") - 1).cast("int"))
            after = after.unionByName(follow(some, own, F.lit(True), value, value, F.lit(1).cast("long"), F.lit(1).cast("long")))
        if left["many"]:
            # a range's width may be more than a double holds
            width, half = F.col("hi") - F.col("lo"), lambda c: F.col(c) / 2
            share = F.when(width < inf, F.try_divide(F.col("_v") - F.col("lo"), width)).otherwise(F.try_divide(half("_v") - half("lo"), half("hi") - half("lo")))
            bin_ = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
            some = now.where(open_ & (F.col("size") > FEW))
            counted = inside(some, left["many"]).groupBy(*keys, "lo", "hi", bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("_v").alias("a"), F.max("_v").alias("z"))
            counted = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin")))  # BINS rows at most
            after = after.unionByName(follow(some, counted, (F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("c")), F.col("a"), F.col("z"), F.col("k") - F.col("upto") + F.col("c"), F.col("c")))
        stored = scratch.kept(after, "ranks")
        scratch.drop(now)
        now = stored
    out = now.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in ranks])
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.coalesce("n", F.lit(0).cast("long")).alias("n"), *ranks)


def nearest(p: float) -> Column:
    """The nearest rank: the first that has a share ``p`` of all values up to it."""
    return F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * F.lit(p), 9)))


def lower_middle() -> Column:
    return F.floor((F.col("n") + 1) / 2)


def upper_middle() -> Column:
    return F.floor(F.col("n") / 2) + 1
