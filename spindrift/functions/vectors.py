"""Vector arithmetic on ARRAY<FLOAT> columns, in double precision and without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A shorter vector than this counts as zero; a length within UNIT of 1 counts as normalized.
ZERO, UNIT = 1e-9, 0.01
METRICS = ("cosine", "l2", "inner_product", "l1")


def _fold(v: Column, term) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + term(x.cast("double")))


def dims(v) -> Column:
    """Number of components; null for a null vector."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(v.isNotNull(), F.size(v))


def norm(v) -> Column:
    """Euclidean length."""
    v = F.col(v) if isinstance(v, str) else v
    return F.sqrt(_fold(v, lambda x: x * x))


def dot(a, b) -> Column:
    """Inner product; null where the sizes differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    v = F.col(v) if isinstance(v, str) else v
    n = norm(v)
    return F.transform(v, lambda x: (x.cast("double") / F.when(n > 0, n).otherwise(F.lit(1.0))).cast("float"))


def distance(a, b, metric: str = "cosine") -> Column:
    """Smaller is nearer. Cosine of a zero vector is null."""
    if metric == "cosine":
        return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))
    if metric == "inner_product":
        return -dot(a, b)
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    if metric == "l2":
        return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))
    if metric == "l1":
        return F.aggregate(gap, F.lit(0.0), lambda s, x: s + F.abs(x))
    raise ValueError(f"metric is one of {', '.join(METRICS)}, not {metric!r}")


def is_zero(v) -> Column:
    return norm(v) < ZERO


def is_unit(v) -> Column:
    return F.abs(norm(v) - 1) <= UNIT


def is_valid(v) -> Column:
    """A vector with components, none of which is null or NaN."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(False))


def bytes_per_vector(d, kind: str = "vector") -> Column:
    """Stored size: 4 bytes a component (2 for half precision) and 8 more in a row store; the collection store has no overhead."""
    d = F.col(d) if isinstance(d, str) else d
    each = {"vector": (4, 8), "halfvec": (2, 8), "collection": (4, 0)}[kind]
    return (d.cast("long") * each[0] + each[1]).cast("long")


def ivf_lists(rows) -> Column:
    """rows / 1000 up to a million rows, then the square root; 1 at least."""
    rows = F.col(rows) if isinstance(rows, str) else rows
    return F.greatest(F.lit(1), F.when(rows <= 1_000_000, F.floor(rows / 1000)).otherwise(F.floor(F.sqrt(rows)))).cast("long")
