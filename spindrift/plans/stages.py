"""Where a migration stands, from which columns there are and what is missing; and what stands against a switch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(has_new: Column, has_old: Column, missing: Column, index_ready: Column, cleaned: Column) -> Column:
    """not_started, filling, ready, cut_over, cleaned_up or conflict."""
    return (
        F.when(has_new & has_old, "conflict").when(has_old, "cut_over").when(has_new & (missing == 0) & index_ready, "ready").when(has_new, "filling").when(cleaned, "cleaned_up").otherwise("not_started")
    )


NEXT = {
    "not_started": "apply", "filling": "apply again", "ready": "eval, then cutover", "cut_over": "cleanup, or rollback", "cleaned_up": "nothing", "conflict": "remove one of the columns",
}


def next_step(stage_column: str) -> Column:
    out = F.lit(None).cast("string")
    for k, v in NEXT.items():
        out = F.when(F.col(stage_column) == k, v).otherwise(out)
    return out


def alias_stage(points_at_new: Column, new_exists: Column) -> Column:
    """For stores that switch by an alias."""
    return F.when(points_at_new, "cut_over").when(new_exists, "applied").otherwise("not_applied")


def _fact(facts: DataFrame, name: str, otherwise) -> Column:
    return F.coalesce(F.col(name), F.lit(otherwise)) if name in facts.columns else F.lit(otherwise)


def readiness(facts: DataFrame, *by: str, store: str = "rows", allow_missing: bool = False) -> DataFrame:
    """``by``, place, id, severity of what stands against each switch of ``facts``, a row each; errors forbid it. A fact that is absent or null is as it should be.

    facts: stage, pending, sizes, and for ``rows`` (new vectors beside the old): index, needs_index, no_text, old_dims, new_dims, previous_exists; for
    ``alias`` (a name moves to another collection): alias (there is one), taken (a collection has its name), moved (it points elsewhere), unindexed."""
    of = lambda name, otherwise: _fact(facts, name, otherwise)
    stage, pending, sizes = F.col("stage"), of("pending", 0) > 0, of("sizes", 1) > 1
    waits = "warning" if allow_missing else "error"
    rules = {
        "rows": [
            ("previous_exists", "error", of("previous_exists", False) | (stage == "conflict")), ("pending", waits, pending), ("no_index", "error", of("needs_index", True) & ~of("index", True)), ("mixed_sizes", "error", sizes),
            ("no_text", "warning", of("no_text", 0) > 0), ("size_change", "info", of("old_dims", 0) * of("new_dims", 0) * (of("old_dims", 0) - of("new_dims", 0)) != 0),
        ],
        "alias": [
            ("alias_moved", "error", of("moved", False)), ("pending", "error", pending), ("indexing", "warning", of("unindexed", 0) > 0), ("mixed_sizes", "error", sizes),
        ],
    }[store]
    early, done = stage.isin("not_started", "cleaned_up", "not_applied"), stage == "cut_over"
    open_ = ~early & ~done
    named = [("no_alias", "error", ~of("alias", True)), ("alias_conflict", "error", of("alias", True) & of("taken", False))] if store == "alias" else []  # at every stage
    every = [("not_applied", "error", early), ("done", "error", done), *named, *[(i, s, open_ & c) for i, s, c in rules], ("model_switch", "info", open_)]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("place"), F.lit(f"cutover.{i}").alias("id"), F.lit(s).alias("severity"))) for n, (i, s, c) in enumerate(every)]))
    return facts.select(*by, F.explode(found).alias("f")).select(*by, "f.*")
