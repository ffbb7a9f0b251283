"""Embedding a table anew, step by step: pending rows, guarded merges, deletions, payloads, passes.

A table is (key, text, payload, vector, new_vector, new_hash). Instead of a trigger, each new vector has
the hash of the text it was made from: a row is pending while it has text and no new vector of that text.
Merges are joins that write a whole new version; nothing is updated in place.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators.cache import EmbeddingCache

#: Passes after the first; what may be left for a run to count as done; rows embedded while switching.
MORE_PASSES, SETTLED_ROWS, SETTLED_SHARE, LATE_ROWS = 5, 100, 0.001, 500
CHARS_PER_TOKEN = 4


def pending(df: DataFrame, text: str = "text", target: str = "new_vector", failed: DataFrame | None = None) -> DataFrame:
    """Rows with text whose target vector is missing or was made from another text; rows that failed (key) are left out."""
    stale = F.col(target).isNull()
    if "new_hash" in df.columns:
        stale = stale | ~F.col("new_hash").eqNullSafe(F.md5(text))
    out = df.where(stale & T.has_text(text))
    return out if failed is None else out.join(failed.select("key"), "key", "left_anti")


def fetch(df: DataFrame, after, limit: int, **more) -> DataFrame:
    """The next ``limit`` pending rows after a key, for runs that are resumed by key."""
    out = pending(df, **more)
    return (out if after is None else out.where(F.col("key") > F.lit(after))).orderBy("key").limit(limit)


def status_counts(df: DataFrame, text: str = "text", target: str = "new_vector") -> DataFrame:
    """One row: rows, with_text, missing, filled, orphans (vector, no text), rollback_missing (text, no live vector), all in one pass."""
    has = T.has_text(text)
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(has).alias("with_text"), F.count_if(has & F.col(target).isNull()).alias("missing"),
        *([F.count_if(F.col("vector").isNotNull() & ~has).alias("orphans"), F.count_if(F.col("vector").isNull() & has).alias("rollback_missing")] if "vector" in df.columns else []),
    )
    return counted.withColumn("filled", F.when(F.col("with_text") == 0, 1.0).otherwise((F.col("with_text") - F.col("missing")) / F.col("with_text")))


def quota(total: int, done: int, until: float) -> int:
    """How many more rows fill the share ``until``."""
    return max(0, math.ceil(total * until) - done)


def settled(remaining: int, backlog: int) -> bool:
    return remaining <= max(SETTLED_ROWS, math.ceil(SETTLED_SHARE * backlog))


def guarded_write(df: DataFrame, written: DataFrame) -> DataFrame:
    """The table with new vectors where the row has none of its text and its text is still the one that was embedded. written: key, text_hash, new_vector.

    A row whose text changed meanwhile, or that has a vector of its text by now, keeps what it has. Where the table has a
    new_hash, it says what text a vector was made from, and is written with it."""
    joined, ok = _accepted(df, written)
    if "new_hash" in df.columns:
        joined = joined.withColumn("new_hash", F.when(ok, F.col("_hash")).otherwise(F.col("new_hash")))
    return joined.withColumn("new_vector", F.when(F.col("_ok"), F.col("_new")).otherwise(F.col("new_vector"))).drop("_hash", "_new", "_ok")


def _accepted(df: DataFrame, written: DataFrame) -> tuple[DataFrame, Column]:
    w = written.select("key", F.col("text_hash").alias("_hash"), F.col("new_vector").alias("_new"))
    lacks = F.col("new_vector").isNull()
    if "new_hash" in df.columns:
        lacks = lacks | ~F.col("new_hash").eqNullSafe(F.md5("text"))
    ok = F.coalesce(F.col("_new").isNotNull() & lacks & (F.col("_hash") == F.md5("text")), F.lit(False))
    return df.join(w, "key", "left").withColumn("_ok", ok), F.col("_ok")


def accepted(df: DataFrame, written: DataFrame) -> int:
    """How many rows guarded_write() changes."""
    joined, ok = _accepted(df, written)
    return joined.where(ok).count()


def same_payload(a: str, b: str) -> Column:
    """Whether two JSON texts are equal as values: 1 and 1.0 are, true and 1 aren't, the order of keys doesn't matter. What is no JSON equals itself only."""
    return F.col(a).eqNullSafe(F.col(b)) | plain_payload(a).eqNullSafe(plain_payload(b))


def plain_payload(c: str) -> Column:
    """A JSON text as one of all that are equal as values: variants keep keys in order and numbers without trailing zeros."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), F.col(c))


def differences(source: DataFrame, copy: DataFrame, payload: bool = True) -> DataFrame:
    """key, action: what a copy (key, text, payload) needs to follow its source: embed, payload, delete. Rows that need nothing are left out."""
    s = source.where(T.not_blank("text")).select("key", F.col("text").alias("st"), F.col("payload").alias("sp"), F.lit(True).alias("_s"))
    c = copy.select("key", F.col("text").alias("ct"), F.col("payload").alias("cp"), F.lit(True).alias("_c"))
    both = s.join(c, "key", "full")
    stale = ~same_payload("sp", "cp") if payload else F.lit(False)
    action = F.when(F.col("_s").isNull(), "delete").when(F.col("_c").isNull() | ~F.col("st").eqNullSafe(F.col("ct")), "embed").when(stale, "payload")
    return both.select("key", action.alias("action")).where("action is not null")


def upsert(table: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """The table with whole rows replaced or added; both have the same columns."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def remove(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def sync_payload(copy: DataFrame, source: DataFrame) -> DataFrame:
    """The copy with the payloads of its source where the text is the same; vectors stay."""
    s = source.select("key", F.col("payload").alias("_p"), F.col("text").alias("_t"), F.lit(True).alias("_there"))
    take = F.col("_there").isNotNull() & F.col("text").eqNullSafe(F.col("_t"))
    return copy.join(s, "key", "left").withColumn("payload", F.when(take, F.col("_p")).otherwise(F.col("payload"))).drop("_p", "_t", "_there")


def newest(rows: DataFrame, key: str = "id", at: str = "updated_at", deleted: str = "deleted", order: str | None = None) -> DataFrame:
    """Last writer wins: of each id the row with the latest time (null is oldest, earlier in ``order`` wins ties); tombstones then go.

    One aggregate, with partial maxima before the shuffle, so an id with many versions is no hot task."""
    others = [c for c in rows.columns if c != key]
    rank = F.struct(F.col(at).isNotNull(), F.col(at), *([-F.col(order)] if order else []))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), rank).alias("r"))
    return best.select(key, "r.*").where(~F.coalesce(F.col(deleted), F.lit(False)))


def running_spend(batches: DataFrame, order: str = "batch", by: tuple[str, ...] = ()) -> DataFrame:
    """Batch events with totals of rows and cost so far."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return batches.withColumn("total_rows", F.sum("rows").over(w)).withColumn("total_usd", F.sum("usd").over(w))


def spent(got: DataFrame) -> DataFrame:
    """One row: tokens, calls (that counted them), rejected, good, from answers (text, vector, error, tokens where counted).

    Where a call counted none, a quarter of the characters stands for it."""
    counted = F.col("tokens") if "tokens" in got.columns else F.lit(None).cast("long")
    length = F.length("text")
    of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return got.agg(
        of(F.coalesce(counted, length / CHARS_PER_TOKEN)).alias("tokens"), F.coalesce(F.sum(F.when(counted > 0, 1)), F.lit(0)).alias("calls"),
        F.count_if(F.col("error").isNotNull()).alias("rejected"), F.count_if(F.col("error").isNull() & F.col("vector").isNotNull()).alias("good"),
    )


@dataclass
class Outcome:
    """complete, stopped, budget or failed. Texts the model was ``asked`` and what they cost; ``failed``: key, error of all rows rejected so far, ``rejected`` of them in this run."""

    status: str
    table: DataFrame
    rows_written: int = 0
    spent_usd: float = 0.0
    passes: int = 0
    remaining: int = 0
    tokens: int = 0
    asked: int = 0
    rejected: int = 0
    failed: DataFrame | None = None


def apply(
    table: DataFrame, embed: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], DataFrame], price: float | None = None, budget: float | None = None, chunk: int | None = None,
    until: float | None = None, failed: DataFrame | None = None, already: float = 0.0, cache: EmbeddingCache | None = None, forget: Callable[..., None] = lambda *tables: None, changed: Callable[[DataFrame], DataFrame] | None = None, should_stop: Callable[[], bool] = lambda: False,
) -> Outcome:
    """Fills new vectors until nothing is pending, a quota is reached, the budget would be passed, or too little is left to matter.

    ``embed``: (key, text) -> (key, vector, error, and tokens where calls count them). ``store``: writes a version and reads it again, ``forget``
    removes versions that nothing reads any more. ``already``: what was spent before. With a ``cache`` the model is asked for texts that it doesn't hold, each once, and only these cost.
    ``changed``: what the application did to the table meanwhile. Each pass is bounded by what was pending
    when it began; rows that failed are not tried again until they are taken off ``failed`` (key, error)."""
    out = Outcome("complete", store(table), spent_usd=already, failed=failed)
    ratio = 1 / CHARS_PER_TOKEN
    last = out.table
    first = status_counts(out.table).first()
    left = None if until is None else quota(first["with_text"], first["with_text"] - first["missing"], until)

    for k in range(1 + MORE_PASSES):
        todo = pending(out.table, failed=out.failed)
        backlog = todo.count()
        if k == 0:
            before = backlog
        if not backlog:
            break
        out.passes += 1
        done = 0
        while done < backlog:
            if should_stop():
                out.status = "stopped"
                break
            limit = min(x for x in (chunk or backlog, backlog - done, left if left is not None else backlog) if x is not None)
            if limit <= 0:
                break
            part = todo if limit >= backlog - done and left is None else todo.orderBy("key").limit(limit)  # all that is pending needs no order
            some = store(part.select("key", T.clip("text", T.EMBED_CLIP).alias("text"), F.md5("text").alias("text_hash")))
            n = some.count()
            if not n:
                break
            split = cache.split(some.select("key", "text")) if cache else None
            size = (split.misses if split else some).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
            if budget is not None and out.spent_usd + size["chars"] * ratio * (price or 0.0) / 1e6 > budget:
                out.status = "budget"
                break
            got = store(some.join(split.answered(embed) if split else embed(some.select("key", "text")), "key"))
            paid = spent(got).first()
            if paid["calls"] and size["chars"]:
                ratio = paid["tokens"] / size["chars"]  # as measured, for the next check of the budget
            if paid["rejected"]:
                bad = got.where("error is not null").select("key", "error")
                was, out.failed = out.failed, store(bad if out.failed is None else out.failed.unionByName(bad))
                if was is not None and was is not failed:
                    forget(was)
            good = got.where("error is null").select("key", "text_hash", F.col("vector").alias("new_vector"))
            if changed is not None:
                out.table = changed(out.table)
            wrote = accepted(out.table, good)
            gone, out.table = last, store(guarded_write(out.table, good))
            last = out.table
            forget(some, got, gone)
            if split:
                split.drop()
            out.rows_written += wrote
            out.tokens += round(paid["tokens"])
            out.spent_usd += paid["tokens"] * (price or 0.0) / 1e6
            out.asked += size["n"]
            out.rejected += paid["rejected"]
            done += n
            if left is not None:
                left -= wrote
            todo = pending(out.table, failed=out.failed)
        if out.status != "complete" or left is not None and left <= 0 or not done:
            break
    out.remaining = pending(out.table, failed=out.failed).count()
    if out.status == "complete" and left is not None and left <= 0 and out.remaining:
        out.status = "stopped"
    elif out.status == "complete" and not settled(out.remaining, max(before, out.rows_written)):
        out.status = "stopped"
    return out
