"""Go, no-go or inconclusive: an old and a new embedding of the same rows compared."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gates:
    tolerance: float = 0.02
    min_slice: int = 30
    max_p95_ms: float | None = None
    max_slowdown_pct: float | None = None
    least_index_recall: float = 0.9


@dataclass
class Verdict:
    status: str
    reasons: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def by_slice(old: DataFrame, new: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """slice, queries, old_recall, new_recall, decision: small, fell or held. old, new: slice, queries, recall_at_k."""
    o = old.select("slice", "queries", F.col("recall_at_k").alias("old_recall"))
    both = o.join(new.select("slice", F.col("recall_at_k").alias("new_recall")), "slice")
    fell = F.col("new_recall") < F.col("old_recall") - gates.tolerance
    return both.withColumn("decision", F.when(F.col("queries") < gates.min_slice, "small").when(fell, "fell").otherwise("held"))


@dataclass(frozen=True)
class Measured:
    """All that a decision may rest on. ``slices``: rows of by_slice(), a handful."""

    slices: tuple = ()
    same: tuple[float | None, float | None] = (None, None)
    p95: tuple[float | None, float | None] = (None, None)
    index_recalls: dict = field(default_factory=dict)
    mode: str = "queries"


def _slice_says(m: Measured, g: Gates):
    for r in m.slices if m.mode == "queries" else ():
        who, change = {"all": "overall"}.get(r["slice"], r["slice"]), f"{r['old_recall']:.3f} to {r['new_recall']:.3f}"
        yield {"small": ("warns", f"{who}: {r['queries']} queries are too few to decide on"), "fell": ("against", f"{who}: recall@10 fell from {change}"), "held": ("for", who)}[r["decision"]]


def _neighbours_say(m: Measured, g: Gates):
    before, after = m.same
    if None not in m.same:
        yield ("against", f"fewer neighbours of the same document: {before:.3f} before, {after:.3f} after") if after < before - g.tolerance else ("for", "")


def _latency_says(m: Measured, g: Gates):
    before, after = m.p95
    if after is not None and g.max_p95_ms is not None and after > g.max_p95_ms:
        yield "against", f"p95 is {after:.1f} ms, the limit {g.max_p95_ms:g} ms"
    if after is not None and before and g.max_slowdown_pct is not None and after > before * (1 + g.max_slowdown_pct / 100):
        yield "against", f"p95 is {after:.1f} ms, {before:.1f} ms before: more than {g.max_slowdown_pct:g}% slower"


def _index_says(m: Measured, g: Gates):
    yield from (("warns", f"the {side} index finds {r:.0%} of the exact neighbours") for side, r in m.index_recalls.items() if r is not None and r < g.least_index_recall)


def _mode_says(m: Measured, g: Gates):
    if m.mode != "queries":
        yield "warns", "the old side is judged by its stored vectors only"


#: Each looks at the measurements and says things ``for``, ``against``, or ones that only warn.
GATES = (_mode_says, _slice_says, _neighbours_say, _latency_says, _index_says)


def decide(m: Measured, gates: Gates = Gates()) -> Verdict:
    """One thing said against is a no-go. A go needs something said for it."""
    said: dict[str, list[str]] = {"for": [], "against": [], "warns": []}
    for gate in GATES:
        for kind, words in gate(m, gates):
            said[kind].append(words)
    if said["against"]:
        return Verdict("no_go", said["against"], said["warns"])
    if not said["for"]:
        return Verdict("inconclusive", ["not enough evidence to decide"], said["warns"])
    held = ", ".join(filter(None, said["for"]))
    return Verdict("go", [f"recall@10 held: {held}"] if held else [], said["warns"])


EXIT_CODES = {"go": 0, "no_go": 1, "error": 2, "inconclusive": 3}
