"""Switching a table over to its new vectors when rows are still changing.

A few rows that changed last are embedded as part of the switch. If there are more of them, a catch-up
comes first, and the switch is tried again, a bounded number of times.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import digests, migrate
from spindrift.operators.cache import EmbeddingCache
from spindrift.sources.tables import VectorTable

ATTEMPTS = 3


class StillPending(RuntimeError):
    """Too many rows have no vector of their present text."""

    def __init__(self, rows: int):
        super().__init__(f"{rows} rows have no new vector; catch up first")
        self.rows = rows


class OverBudget(RuntimeError):
    """Embedding the last rows would cost more than is left."""


@dataclass
class Filled:
    """A version with vectors for what was pending: rows embedded, rows that the model rejected, rows that are pending still, tokens, what it cost."""

    table: DataFrame
    embedded: int = 0
    rejected: int = 0
    left: int = 0
    usd: float = 0.0
    tokens: int = 0


def fill(t: VectorTable, table: DataFrame, embed: Callable[[DataFrame], DataFrame], price: float | None = None, budget: float | None = None, cache: EmbeddingCache | None = None) -> Filled:
    """The table with vectors for what is pending, as a version of ``t``.

    What is asked and what the model answered are stored before either is used, so the model sees each row once; whether a row is
    pending still is counted in what was written. ``budget``: what may be spent, at ``price`` a million tokens."""
    todo = t.write(migrate.pending(table).select("key", T.clip("text", T.EMBED_CLIP).alias("text"), F.md5("text").alias("text_hash")))
    split = cache.split(todo.select("key", "text")) if cache else None
    usd = ((split.misses if split else todo).agg(F.sum(F.length("text"))).first()[0] or 0) / migrate.CHARS_PER_TOKEN * (price or 0.0) / 1e6
    if budget is not None and usd > budget:
        t.forget(todo)
        raise OverBudget(f"the last rows cost {usd:.4f}, {budget:.4f} is left")
    got = t.write(todo.join(split.answered(embed) if split else embed(todo.select("key", "text")), "key", "left"))
    n = migrate.spent(got).first()
    good = got.where("error is null and vector is not null").select("key", "text_hash", F.col("vector").alias("new_vector"))
    done = t.write(migrate.guarded_write(table, good))
    t.forget(todo, got)
    if split:
        split.drop()
    return Filled(done, n["good"], n["rejected"], migrate.pending(done).count(), n["tokens"] * (price or 0.0) / 1e6, round(n["tokens"]))


def cutover(
    t: VectorTable, current: Callable[[], DataFrame], embed: Callable[[DataFrame], DataFrame], catch_up: Callable[[], object] | None = None, late: int = migrate.LATE_ROWS, allow_missing: bool = False, attempts: int = ATTEMPTS,
    price: float | None = None, budget: float | None = None, charge: Callable[[Filled], None] = lambda filled: None, cache: EmbeddingCache | None = None,
) -> int:
    """Switches, and says how many rows were embedded on the way. ``current``: the table as it is now, with what new vectors it has.

    Any row that is pending after the write forbids the switch; those that the model rejects don't where ``allow_missing`` is set.
    Rows that change while others are embedded are seen before the pointer moves, and another attempt is made. ``charge`` gets what each attempt spent."""
    embedded = 0
    for k in range(attempts):
        table = t.write(current())
        left = migrate.pending(table).count()
        if left <= late:
            filled = fill(t, table, embed, price, budget, cache) if left else Filled(table)
            if left:
                charge(filled)
                embedded += filled.embedded
                budget = None if budget is None else budget - filled.usd
            if filled.left > (filled.rejected if allow_missing else 0):
                raise StillPending(filled.left)
            t.adopt(filled.table, "new")
            if filled.table is not table:
                t.forget(table)
            if digests.changed_rows(current(), filled.table) == 0:
                t.cutover()
                return embedded
            continue
        if catch_up is None:
            break
        t.forget(table)
        catch_up()
    raise StillPending(left)
